"""Chat formatting in budgeted, turn-aligned windows with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.wordtok import default_vocabulary, word_ids
from blockloom.scratch import partitions

OPEN, CLOSE, ESCAPE = "<s>", "</s>", "\u241b"
#: Strings that a text must not show unescaped: this template's marks and common ones of others.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
BUDGET, HISTORY, MARKS = 1024, 256, 4
_SPLIT = re.compile("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    """Doubles the escape character and puts one after the first character of each control string."""
    return _SPLIT.sub(ESCAPE, text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return re.sub(ESCAPE + f"({ESCAPE}?)", r"\1", text)


def turn_block(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text stands in it."""
    head = OPEN + escape(role).replace("\n", ESCAPE + "n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turns(window: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    out = []
    for block in window.split(CLOSE)[:-1]:
        role, _, text = block[len(OPEN) :].partition("\n")
        out.append((unescape(re.sub(f"(?<!{ESCAPE})((?:{ESCAPE}{ESCAPE})*){ESCAPE}n", r"\1\n", role)), unescape(text)))
    return out


@dataclass
class _Conversation:
    """Windows of one conversation, turn by turn; holds the open window and the history it may repeat."""

    budget: int
    history: int
    system: tuple[str, int] | None = None
    blocks: list[str] = field(default_factory=list)
    spans: list[dict] = field(default_factory=list)
    chars: int = 0
    tokens: int = 0
    repeated: int = 0
    fresh: int = 0
    recent: deque = field(default_factory=deque)
    recent_tokens: int = 0
    total: int = 0
    number: int = 0

    def _append(self, block: str, tokens: int) -> None:
        self.blocks.append(block)
        self.chars += len(block)
        self.tokens += tokens

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        block, begin, end = turn_block(role, text)
        if self.fresh and self.tokens + tokens > self.budget:
            yield self.close()
            # The system turn is retained wherever it fits beside the new turn.
            if self.system and role != "system" and self.system[1] + tokens <= self.budget:
                self._append(*self.system)
            # The prefix sums of the recent turns choose the longest tail that the history budget and the window allow.
            room = min(self.history, self.budget - self.tokens - tokens)
            tail = [x for x in self.recent if self.total - x[2] <= room]
            for old, n, _ in tail:
                if not self.system or old is not self.system[0]:
                    self._append(old, n)
            self.repeated = len(self.blocks)
        if role == "assistant":
            self.spans.append({"start": self.chars + begin, "end": self.chars + end})
        self._append(block, tokens)
        self.fresh += 1
        if role == "system":
            self.system = (block, tokens)
            return
        self.recent.append((block, tokens, self.total))
        self.total += tokens
        while self.recent and self.total - self.recent[0][2] > self.history:
            self.recent.popleft()

    def close(self) -> tuple:
        row = (self.number, "".join(self.blocks), self.spans, self.repeated, self.tokens)
        self.number += 1
        self.blocks, self.spans, self.chars, self.tokens, self.repeated, self.fresh = [], [], 0, 0, 0, 0
        return row


WINDOWS = "conv_id long, window int, text string, loss array<struct<start:int,end:int>>, repeated int, tokens int"
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("repeated", pa.int32()), ("tokens", pa.int32())])


def _formatter(vocabulary: str, budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary).ids
        now, state, rows, held = None, None, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                role, text = role or "", text or ""
                if state is None or conv != now:
                    if state is not None:
                        rows.append((now, *state.close()))
                    now, state = conv, _Conversation(budget, history)
                for row in state.add(role, text, len(encode(text.encode())) // 4 + MARKS):
                    rows.append((now, *row))
                    held += len(row[1])
                if len(rows) >= 4096 or held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
                    rows, held = [], 0
        if state is not None:
            rows.append((now, *state.close()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return run


def format_chats(turns: DataFrame, vocabulary: str | None = None, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Training windows of ``turns(conv_id, turn, role, text)``: ``conv_id, window, text, loss, repeated, tokens``.

    A window holds at most ``budget`` tokens of whole turns: the conversation's last system turn, a tail of turns of earlier
    windows of up to ``history`` tokens as prefix sums choose it, and new turns. Two cases give way: a turn that alone is
    over the budget has a window to itself, the only kind that exceeds it, and where the system turn and a new one are over it
    together, the window is without the system turn. ``loss`` has the character ranges of the texts of its new assistant
    turns; the first ``repeated`` turns were shown before and are masked.

    Turns are ordered by turn, role and text, so ties have a defined order and repeated rows stay repeated; null roles
    and texts are empty; rows without conv_id form one conversation; other columns are ignored; an empty table
    gives an empty result. A conversation streams through one task, since its order and digests are sequential; a task
    holds a window and its history, never a conversation.
    """
    rows = turns.select(F.col("conv_id").cast("long"), "role", "text", "turn").repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_formatter(vocabulary or default_vocabulary(), budget, history), WINDOWS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (2, 4) else pa.int64()) for k, c in enumerate(zip(*rows))], names)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, rows = None, None, []

    def result() -> tuple:
        return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    for batch in batches:
        for conv, number, text, loss, repeated in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if state is None or number == 0:
                if state is not None:
                    rows.append(result())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in read_turns(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
            for span in loss:
                target = unescape(text[span["start"] : span["end"]])
                state[2] += len(target)
                state[3].update(target.encode())
            state[4] += len(text)
        if len(rows) > 4096:
            yield _digest_batch(rows)
            rows = []
    if state is not None:
        rows.append(result())
    if rows:
        yield _digest_batch(rows)


def chat_digests(windows: DataFrame) -> DataFrame:
    """Turns and targets of each conversation, parsed from the windows of ``format_chats`` in their order."""
    return windows.mapInArrow(_read_back, DIGESTS)

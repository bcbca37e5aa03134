import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.llm.chat import BUDGET, CONTROL, chat_digests, escape, format_chats, read_turns, turn_block, unescape

SCHEMA = "conv_id long, turn long, role string, text string"
odd = st.lists(st.sampled_from([*CONTROL, "\u241b", "\u241bn", "\n", "<", "[", "/", "x", "s>", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(odd, odd)
def test_template_is_reversible(role, text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROL)
    block, begin, end = turn_block(role, text)
    assert read_turns(block * 2) == [(role, text)] * 2
    assert unescape(block[begin:end]) == text


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        all_ = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_against_brute_force(spark):
    rows = [(1, k, ["system", "user", "assistant"][min(k, 1 + (k - 1) % 2)], f"turn {k} " + "word </s> " * (k * 7)) for k in range(60)]
    rows += [(2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (3, 0, "assistant", "w " * 5000), (None, 1, "user", "x")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", window string")
    windows = format_chats(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_digests(windows).collect()}
    assert got == brute(rows)
    kept = windows.where("conv_id = 1").collect()
    assert len(kept) > 5 and all(w.tokens <= BUDGET or len(read_turns(w.text)) - w.repeated == 1 for w in kept)
    assert all(read_turns(w.text)[0][0] == "system" or w.tokens > BUDGET - 100 for w in kept) and sum(read_turns(w.text)[0][0] == "system" for w in kept) > 5 and max(w.repeated for w in kept) > 1
    assert chat_digests(format_chats(df.limit(0))).count() == 0


def test_windows_keep_to_the_budget(spark):
    sizes = [900, 500, 500, 30, 30, 900, 5000, 40, 200, 300, 400, 100, 1000, 20]
    roles = ["system", "user", "assistant", "user", "assistant", "user", "assistant", "user", "assistant", "system", "user", "assistant", "user", "assistant"]
    rows = [(1, k, r, f"t{k} " + "word " * n) for k, (r, n) in enumerate(zip(roles, sizes))]
    windows = format_chats(spark.createDataFrame(rows, SCHEMA)).orderBy("window").collect()
    seen = []
    for w in windows:
        turns = read_turns(w.text)
        assert w.tokens <= BUDGET or len(turns) == 1
        new = turns[w.repeated :]
        seen += new
        for system in [t for t in turns[: w.repeated] if t[0] == "system"]:
            assert system == [t for t in seen[: len(seen) - len(new)] if t[0] == "system"][-1]
        assert len(turns) == len({t[1] for t in turns})
    assert seen == [(r[2], r[3]) for r in rows]
    late = [w for w in windows if any(t[1].startswith("t13") for t in read_turns(w.text))]
    assert any(read_turns(w.text)[0][1].startswith("t9") for w in windows[-4:]) and len(late) == 1

"""Device configuration: a reader and writer of the HCL subset that devices need, and overlay nesting."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r'\s*(?:(#|//)[^\n]*|("(?:[^"\\]|\\.)*")|([A-Za-z_][\w-]*)|(-?\d+(?:\.\d+)?)|([{}=]))')
_SIZE = re.compile(r"(\d+)([bkmg]?)$", re.I)


@dataclass
class Block:
    """A block: its type, its label, its attributes and the blocks in it, all in order."""

    kind: str
    label: str = ""
    attributes: dict[str, str | int | float | bool] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)

    def child(self, kind: str) -> Block | None:
        return next((b for b in self.blocks if b.kind == kind), None)


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if text[at:].strip():
                raise ValueError(f"unexpected text: {text[at : at + 20]!r}")
            break
        at = m.end()
        for kind, value in zip(("comment", "string", "name", "number", "mark"), m.groups()):
            if value and kind != "comment":
                out.append((kind, value))
    return out


def _value(kind: str, text: str):
    if kind == "string":
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    if kind == "number":
        return float(text) if "." in text else int(text)
    if text in ("true", "false"):
        return text == "true"
    raise ValueError(f"not a value: {text}")


def read_config(text: str) -> list[Block]:
    """Top-level blocks of a configuration."""
    tokens = _tokens(text)
    root, stack = Block(""), []
    now, k = root, 0
    while k < len(tokens):
        kind, word = tokens[k]
        following = tokens[k + 1][1] if k + 1 < len(tokens) else ""
        if (kind, word) == ("mark", "}"):
            if not stack:
                raise ValueError("unmatched }")
            now, k = stack.pop(), k + 1
        elif kind == "name" and following == "=":
            if k + 2 >= len(tokens):
                raise ValueError(f"{word} has no value")
            now.attributes[word], k = _value(*tokens[k + 2]), k + 3
        elif kind == "name":
            block, k = Block(word), k + 1
            if k < len(tokens) and tokens[k][0] == "string":
                block.label, k = _value(*tokens[k]), k + 1
            if k >= len(tokens) or tokens[k][1] != "{":
                raise ValueError(f"{word} has no body")
            now.blocks.append(block)
            stack.append(now)
            now, k = block, k + 1
        else:
            raise ValueError(f"unexpected {word}")
    if stack:
        raise ValueError("a block isn't closed")
    return root.blocks


def _shown(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    return str(value)


def write_config(blocks: list[Block], depth: int = 0) -> str:
    """Configuration text: attributes with aligned signs first, then blocks, each set off by an empty line."""
    out = []
    for n, b in enumerate(blocks):
        pad = "  " * depth
        head = f"{b.kind} {_shown(b.label)}" if b.label else b.kind
        width = max(map(len, b.attributes), default=0)
        lines = [f"{pad}  {k.ljust(width)} = {_shown(v)}\n" for k, v in b.attributes.items()]
        inner = write_config(b.blocks, depth + 1)
        gap = "\n" if lines and inner else ""
        out.append(("\n" if n else "") + f"{pad}{head} {{\n{''.join(lines)}{gap}{inner}{pad}}}\n")
    return "".join(out)


def size_of(text: str) -> int:
    """``64k``, ``1G``, ``900`` in bytes."""
    if not text:
        return 0
    m = _SIZE.match(text)
    if not m:
        raise ValueError(f"not a size: {text}")
    return int(m[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()]


def nest_overlays(device: Block, files: list[str], prefix: str, block_size: str = "") -> Block:
    """The device over a chain of overlays: files ``prefix*.overlay`` by name, each with its ``.state``; later names lie outside.

    Each layer becomes the read-only ``source`` of the next one.
    """
    now = device
    for name in sorted(f for f in files if f.startswith(prefix) and f.endswith(".overlay")):
        size = {"blocksize": block_size} if block_size else {k: v for k, v in now.attributes.items() if k == "blocksize"}
        attributes = {"size": now.attributes.get("size", ""), "system": "sparsefile", **size, "location": name}
        outer = Block("device", device.label, attributes, [Block("source", name.removesuffix(".overlay") + ".state", dict(now.attributes), list(now.blocks))])
        now = outer
    return now


def devices(spark: SparkSession, text: str, default_block: int = 4096) -> DataFrame:
    """``device, size, block_size, num_blocks, system, parent, shared`` of all devices and the sources in them."""
    rows = []

    def walk(b: Block, name: str) -> None:
        size = size_of(str(b.attributes.get("size", "")))
        block = size_of(str(b.attributes.get("blocksize", ""))) or default_block
        source = b.child("source")
        parent = f"{name}/source" if source else None
        system = b.attributes.get("system")
        if system not in ("memory", "file", "sparsefile"):
            raise ValueError(f"device {name}: system {system} is not supported")
        rows.append((name, size, block, -(-size // block), system, parent, bool(b.attributes.get("sourceshared", False))))
        if source:
            walk(source, parent)

    for b in read_config(text):
        if b.kind == "device":
            walk(b, b.label)
    return spark.createDataFrame(rows, "device string, size long, block_size long, num_blocks long, system string, parent string, shared boolean")

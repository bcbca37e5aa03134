"""Column names of callers kept apart from those that operators add."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def seal(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with columns that aren't ``used`` under names that no operator adds; ``toDF(*docs.columns)`` gives their own back."""
    left = set(used)
    inner = [c if c in left and not left.discard(c) else f"other_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*inner)


def _holds(kind: T.DataType, what: tuple[type, ...]) -> bool:
    if isinstance(kind, what):
        return True
    if isinstance(kind, T.StructType):
        return any(_holds(f.dataType, what) for f in kind.fields)
    return isinstance(kind, T.ArrayType) and _holds(kind.elementType, what)


def row_hash(docs: DataFrame) -> Column:
    """64-bit hash of all columns of a row; maps and variants, which don't hash, count by their JSON text."""
    odd = (T.MapType, T.VariantType)
    return F.xxhash64(*(F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if _holds(f.dataType, odd) else F.col(f"`{f.name}`") for f in docs.schema.fields))


def tidied(batches_of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps_words: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function, after which its process gives memory that it no longer uses back to the machine.

    Python workers serve one task after the other and would keep the most that any of them needed. What tasks of one operator
    keep there for the next, as word ids, goes when a task of another begins; ``keeps_words`` marks those that use word ids.
    """

    @functools.wraps(batches_of)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sys.modules.get("blockloom.llm.wordtok")
        if words and not keeps_words:
            words.forget()
        yield from batches_of(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
        if trim:
            trim(0)

    return run

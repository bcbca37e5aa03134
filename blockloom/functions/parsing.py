"""Sizes, durations and process map lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of Go-style durations, in nanoseconds.
UNITS = {"ns": 1, "us": 1000, "µs": 1000, "μs": 1000, "ms": 1000000, "s": 1000000000, "m": 60000000000, "h": 3600000000000}


def parse_bytes(text: Column) -> Column:
    """``64k``, ``1G``, ``900``: bytes, by powers of 1024; empty is 0; anything else raises."""
    t = F.lower(text)
    number = F.regexp_extract(t, r"^(\d+)[bkmg]?$", 1)
    unit = F.element_at(F.create_map(*(x for k, v in (("", 1), ("b", 1), ("k", 1 << 10), ("m", 1 << 20), ("g", 1 << 30)) for x in (F.lit(k), F.lit(v).cast("long")))), F.regexp_extract(t, r"^\d+([bkmg]?)$", 1))
    return F.when(t == "", F.lit(0).cast("long")).when(number == "", F.raise_error(F.concat(F.lit("not a size: "), text)).cast("long")).otherwise(F.when(number != "", number).cast("long") * unit)


def parse_duration(text: Column) -> Column:
    """``1h2m``, ``-1.5s``, ``100ms``: nanoseconds; anything else raises."""
    part = r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)"
    units = F.create_map(*(x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v).cast("decimal(20,0)"))))
    parts = F.regexp_extract_all(text, F.lit(part), F.lit(0))
    one = lambda x: (F.regexp_extract(x, "^" + part, 1).cast("decimal(20,9)") * F.element_at(units, F.regexp_extract(x, "^" + part, 2))).cast("decimal(38,9)")
    total = F.aggregate(parts, F.lit(0).cast("decimal(38,9)"), lambda a, x: (a + one(x)).cast("decimal(38,9)"))
    good = text.rlike(f"^[-+]?(({part})+|0)$")
    signed = F.when(F.substring(text, 1, 1) == "-", -total).otherwise(total)
    return F.when(good, signed.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a duration: "), text)).cast("long"))


def format_duration(nanos: Column) -> Column:
    """Whole nanoseconds below a millisecond, whole milliseconds below a second, else seconds with three digits."""
    return (
        F.when(nanos < 1000000, F.concat(nanos.cast("string"), F.lit("ns")))
        .when(nanos < 1000000000, F.concat(F.floor(nanos / 1000000).cast("string"), F.lit("ms")))
        .otherwise(F.format_string("%.3fs", nanos / 1e9))
    )


def parse_maps(lines: DataFrame, column: str = "line") -> DataFrame:
    """Columns of ``/proc/<pid>/maps`` lines. Addresses are DECIMAL(20, 0), as kernel ones pass 2^63; the path is its first word."""
    words = F.split(F.trim(column), r"\s+")
    hexed = lambda c: F.conv(c, 16, 10).cast("decimal(20,0)")
    rows = lines.withColumn("_w", words)
    ends = F.split(F.col("_w")[0], "-")
    got = rows.withColumns({"addr_start": hexed(ends[0]), "addr_end": hexed(ends[1]), "offset": hexed(F.col("_w")[2]), "dev": F.col("_w")[3], "inode": F.col("_w")[4], "pathname": F.coalesce(F.get("_w", F.lit(5)), F.lit(""))})
    perms = {"perm_read": "r", "perm_write": "w", "perm_exec": "x", "perm_shared": "s", "perm_private": "p"}
    return got.withColumns({k: F.contains(F.col("_w")[1], F.lit(v)) for k, v in perms.items()}).drop("_w")


def parse_smaps(lines: DataFrame) -> DataFrame:
    """Sums of the kB fields of ``pathname, line`` rows in bytes: ``pathname, field, bytes``."""
    field = F.regexp_extract("line", r"^(\w+):\s+(\d+) kB", 1)
    value = F.regexp_extract("line", r"^(\w+):\s+(\d+) kB", 2)
    return lines.select("pathname", field.alias("field"), value.alias("v")).where("field <> ''").groupBy("pathname", "field").agg((F.sum(F.col("v").cast("long")) * 1024).alias("bytes"))


def children(texts: DataFrame, column: str = "children") -> DataFrame:
    """Process ids of a ``children`` file's text, one a row; direct children only."""
    return texts.select("*", F.explode(F.filter(F.split(F.trim(column), r"\s+"), lambda x: x != "")).alias("child")).withColumn("child", F.col("child").cast("int"))

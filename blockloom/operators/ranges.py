"""Address ranges: runs of pages, regions, slot maps, and joins on ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRESENT, SWAPPED, FILE, EXCLUSIVE, SOFT_DIRTY = 63, 62, 61, 56, 55
BUCKET = 2 << 20  # bytes of address space that the range join puts together


def flags(pages: DataFrame) -> DataFrame:
    """``pagemap`` words as flags, and the low 55 bits as frame number."""
    bit = lambda n: F.getbit("pagemap", F.lit(n)) == 1
    named = {"present": PRESENT, "swapped": SWAPPED, "file": FILE, "exclusive": EXCLUSIVE, "soft_dirty": SOFT_DIRTY}
    return pages.withColumns({k: bit(n) for k, n in named.items()} | {"pfn": F.col("pagemap").bitwiseAND(F.lit((1 << 55) - 1))})


def islands(rows: DataFrame, key: str, step: int, *groups: str) -> DataFrame:
    """Adds ``_island`` (equal within a run of keys ``step`` apart) and ``_n`` (position in the run).

    Keys need not be aligned: runs are sought among keys of one remainder.
    """
    rest = F.col(key) % step
    w = Window.partitionBy(*groups, rest).orderBy(key)
    rows = rows.withColumn("_rest", rest).withColumn("_island", F.expr(f"{key} div {step}") - F.row_number().over(w))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*groups, "_rest", "_island").orderBy(key)) - 1)


def page_runs(flagged: DataFrame, page: int = 4096, chunk: int | None = None) -> DataFrame:
    """Runs of soft-dirty pages that are present or swapped: ``start, stop, swapped_bytes``; cut every ``chunk`` bytes if given."""
    rows = islands(flagged.where("soft_dirty and (present or swapped)"), "page_addr", page)
    part = F.expr(f"_n * {page} div {chunk}") if chunk else F.lit(0)
    runs = rows.groupBy("_rest", "_island", part.alias("_part")).agg(F.min("page_addr").alias("start"), (F.max("page_addr") + page).alias("stop"), (F.count_if("swapped") * page).alias("swapped_bytes"))
    return runs.select("start", "stop", "swapped_bytes")


def chunks(ranges: DataFrame, chunk: int) -> DataFrame:
    """Ranges ``start, stop`` in pieces of at most ``chunk`` bytes."""
    rows = ranges.where("stop > start").withColumn("at", F.explode(F.expr(f"sequence(start, stop - 1, {chunk}L)")))
    return rows.select(F.col("at").alias("start"), F.least(F.col("at") + chunk, "stop").alias("stop"))


def regions(ids: DataFrame, block: int, max_size: int = 0) -> DataFrame:
    """``start, length`` of runs of consecutive blocks, of at most ``max_size`` bytes rounded up to blocks (0: any)."""
    rows = islands(ids.select("id"), "id", block)
    part = F.expr(f"_n div {-(-max_size // block)}") if max_size else F.lit(0)
    return rows.groupBy("_rest", "_island", part.alias("_part")).agg(F.min("id").alias("start"), (F.count("*") * block).alias("length")).select("start", "length")


def allocate(mapped: DataFrame, wanted: DataFrame, n_slots: int) -> DataFrame:
    """``id, slot`` after writing ``wanted(id)``: known ids keep their slots, new ones get the lowest free ones in order of id.

    Ids beyond the last free slot have a null slot: out of space.
    """
    spark = mapped.sparkSession
    free = spark.range(n_slots).select(F.col("id").alias("slot")).join(mapped.select("slot"), "slot", "left_anti")
    free = free.withColumn("n", F.row_number().over(Window.orderBy("slot")))
    fresh = wanted.select("id").distinct().join(mapped.select("id"), "id", "left_anti").withColumn("n", F.row_number().over(Window.orderBy("id")))
    return mapped.select("id", "slot").union(fresh.join(free, "n", "left").select("id", "slot"))


def slots_for(mapped: DataFrame, wanted: DataFrame) -> int:
    """Slots that hold all mapped and new ids: up to the highest mapped slot, and one more for each new id."""
    fresh = wanted.select("id").distinct().join(mapped.select("id"), "id", "left_anti")
    return mapped.agg(F.coalesce(F.max("slot") + 1, F.lit(0))).first()[0] + fresh.count()


def allocate_run(mapped: DataFrame, n: int, n_slots: int) -> DataFrame:
    """``slot``: the start of the first run of ``n`` free slots, a run at the very end included; empty if there is none."""
    free = mapped.sparkSession.range(n_slots).select(F.col("id").alias("slot")).join(mapped.select("slot"), "slot", "left_anti")
    runs = islands(free, "slot", 1).groupBy("_island").agg(F.min("slot").alias("slot"), F.count("*").alias("size"))
    return runs.where(F.col("size") >= n).agg(F.min("slot").alias("slot")).where("slot is not null")


def defragment(mapped: DataFrame) -> DataFrame:
    """Dense slots in order of id: ``id, slot, new_slot``. Ranks come from a range partition's offsets, not from one sorted task."""
    by = mapped.withColumn("_b", F.expr("id div 16777216"))
    sums = by.groupBy("_b").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = by.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy("id"))).join(sums.select("_b", "_before"), "_b")
    return rows.select("id", "slot", (F.col("_before") + F.col("_k") - 1).alias("new_slot"))


def map_stats(mapped: DataFrame, block: int) -> DataFrame:
    """``size`` and ``used_size`` (up to the highest slot) of a slot map; zero when empty."""
    return mapped.agg((F.count("*") * block).alias("size"), F.coalesce((F.max("slot") + 1) * block, F.lit(0)).alias("used_size"))


def subtract_maps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` but those that equal, in all columns, the only row of ``b`` with their range.

    Ranges that ``b`` has twice or more remove nothing.
    """
    names = a.columns
    single = b.withColumn("_n", F.count("*").over(Window.partitionBy("addr_start", "addr_end"))).where("_n = 1")
    same = [a[c].eqNullSafe(single[c]) for c in names]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return a.join(single, condition & (a["addr_start"] == single["addr_start"]), "left_anti")


def bucketed(ranges: DataFrame, low: str, high: str, bucket: int) -> DataFrame:
    """One row for each bucket of address space that ``[low, high)`` touches."""
    return ranges.where(F.col(high) > F.col(low)).withColumn("_bucket", F.explode(F.expr(f"sequence({low} div {bucket}, ({high} - 1) div {bucket})")))


def range_lookup(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, size: int = 1, how: str = "inner", bucket: int = BUCKET) -> DataFrame:
    """Join points with the ranges ``[low, high)`` that hold ``[point, point + size)``: an equi-join on buckets, then exact bounds.

    Each point lies in one bucket, so no match is found twice.
    """
    p = points.withColumn("_bucket", F.expr(f"{point} div {bucket}"))
    r = bucketed(ranges, low, high, bucket).withColumnRenamed("_bucket", "_rb")
    on = (p["_bucket"] == r["_rb"]) & (p[point] >= r[low]) & (p[point] + size <= r[high])
    return p.join(r, on, how).drop("_bucket", "_rb")


def added_pages(new: DataFrame, old: DataFrame, page: int = 4096) -> DataFrame:
    """Pages of map entries of ``new`` that aren't ``old``'s, and that no range of ``old`` contains."""
    entries = subtract_maps(new, old).where("addr_end - addr_start >= 4096" if page == 4096 else f"addr_end - addr_start >= {page}")
    pages = entries.select(F.explode(F.expr(f"sequence(addr_start, addr_end - {page}, {page}L)")).alias("page"))
    return range_lookup(pages, old.select("addr_start", "addr_end"), "page", "addr_start", "addr_end", page, "left_anti")


def resolve_segments(pages: DataFrame, segments: DataFrame, bucket: int = 512) -> DataFrame:
    """Each page's source: the disjoint segment (inclusive ends) that holds it, else the base; ``page, start_pg, source``."""
    s = segments.select("start_pg", (F.col("end_pg") + 1).alias("_stop"))
    found = range_lookup(pages, s, "page", "start_pg", "_stop", 1, "left", bucket)
    return found.select("page", "start_pg", F.when(F.col("start_pg").isNull(), "base").otherwise("overlay").alias("source"))

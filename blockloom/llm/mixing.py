"""Mixing sources to target weights, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.columns import row_hash, seal
from blockloom.scratch import materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a source that share a leading part of their keys, roughly; sixteen times finer where it would be more.
RANGE_ROWS = 1024
#: Equal rows that one row with counts stands for where rows are repeated.
COPIES = 64


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def _grown(column: str) -> Column:
    """A source without its null: code point order puts the null source last."""
    return F.struct(F.col(column).isNull().alias("none"), F.coalesce(column, F.lit("")).alias("name"))


def source_targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size`` (one row per source) -> the same with ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes.
    A target stops at ``most`` times its source's size, and what that frees is shared anew by weight. The
    end of that process is a water level: with sources sorted by cap over weight, those below the level get
    their cap and the others weight times level. The windows run over one row per source.
    """
    order = Window.orderBy(_grown("source"))
    everything = Window.partitionBy()
    table = F.array(*(F.lit(float(w)) for w in weights))
    got = totals.withColumn("weight", F.element_at(table, ((F.row_number().over(order) - 1) % len(weights)) + 1))
    got = got.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    up = Window.orderBy(F.col("cap") / F.col("weight"), _grown("source"))
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - before
    got = got.withColumn("level", left / after).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return got.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level)).select("source", "source_size", "target")


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """Words that a mix takes from each row of ``sized(doc_id, source, size, ...)``: adds ``source_size, target, taken``.

    Each row gets a hash-random key; the rows of a source are range-sorted by it and taken in that order until
    the words taken are the source's budget, its target rounded down. Whole passes over the source come first (a
    budget of 1.3 times the source repeats each document at least once), the row that the last pass ends in gives the
    part that is still due, so the budget is met exactly.

    Prefix sums are distributed: leading hex digits of the keys cut each source into ranges of about RANGE_ROWS
    rows, few or many alike, whose sums are scanned per source; then each range is scanned on its own. A source
    with a third of all rows is thus spread over all tasks. Rows with equal keys (repeated rows) are told apart by
    size; wholly equal rows are interchangeable. Null sources are a source of their own; null ids hash like an
    empty string; empty tables give empty results. Reruns agree. ``sized`` is read three times: pass a
    materialised table.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    targets = source_targets(totals.select("source", "source_size"), weights, share, most)
    per = totals.select(F.col("source").alias("s"), "source_rows").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    digits = F.lit(1)
    for k in range(1, 6):
        digits = digits + F.when(F.col("source_rows") > RANGE_ROWS * 16**k, 1).otherwise(0)
    per = per.withColumn("digits", digits).withColumnsRenamed({"source": "s"}).drop("source_rows")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = sized.withColumn("mix_key", key).join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("mix_range", F.expr("substring(mix_key, 1, digits)"))
    ranges = rows.groupBy("source", "mix_range").agg(F.sum("size").alias("range_size"))
    scan = Window.partitionBy("source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("mix_range").alias("g"), F.coalesce(F.sum("range_size").over(scan), F.lit(0)).alias("range_start"))
    within = Window.partitionBy("source", "mix_range").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("mix_range") == F.col("g"))).drop("s", "g")
    start = F.col("range_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("passes", passes).withColumn("part", F.greatest(F.lit(0).cast("long"), F.least("size", budget - F.col("passes") * F.col("source_size") - start)))
    return rows.withColumn("taken", F.col("passes") * F.col("size") + F.col("part")).drop("digits", "mix_range", "range_start", "part", "passes", "mix_key")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken`` of every document.

    Null and empty texts have size 0, very long ones count whole; null ids and sources, ties, repeated rows and empty tables
    are as in ``mix``; other columns are ignored.
    """
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sized")
    return mix(sized, **how)


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its source's budget takes it, and the row that a budget ends in
    with the words that are still due. Columns stay, whatever their names and types.

    Documents without words (null, empty) are not taken; null ids and sources are as in ``mix``; very long texts are rows like
    others; an empty table gives an empty result. Wholly equal rows are taken each by itself, so that all but
    one of a source's texts are whole: they shrink to one row before it is repeated, COPIES at a time, so no task
    holds a hot row's copies alone.
    """
    rows = seal(docs, "doc_id", "source", "text")
    names = rows.columns
    hashed = rows.withColumn("q_row", row_hash(rows))
    sized = materialize(hashed.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.col("q_row").alias("q_hash")), "sized")
    repeated = materialize(sized.groupBy(F.col("q_hash").alias("q_twin")).agg(F.count("*").alias("n")).where("n > 1").select("q_twin"), "repeated")
    taken = mix(sized, **how).where("taken > 0").groupBy("q_hash", "size", "taken").agg(F.count("*").alias("q_n"))
    taken = taken.withColumn("q_at", F.explode(F.expr(f"sequence(0L, q_n - 1, {COPIES}L)"))).select("q_hash", F.col("size").alias("q_size"), F.col("taken").alias("q_taken"), F.expr(f"cast(least(q_n - q_at, {COPIES}) as int)").alias("q_times"))
    taken = materialize(taken, "taken")
    twin = F.col("q_row") == F.col("q_twin")
    once = hashed.join(repeated, twin, "left_semi").groupBy("q_row").agg(*(F.first(c).alias(c) for c in names))
    alone = hashed.join(taken.join(repeated, F.col("q_hash") == F.col("q_twin"), "left_anti"), F.col("q_row") == F.col("q_hash"))
    got = alone.unionByName(once.join(taken, F.col("q_row") == F.col("q_hash")))
    parts = "flatten(array_repeat(concat(array_repeat(0L, cast(q_taken div q_size as int)), filter(array(q_taken % q_size), x -> x > 0)), q_times))"
    got = got.withColumn("q_part", F.explode(F.expr(parts)))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    part = F.concat_ws(" ", F.slice(words, F.lit(1), F.col("q_part").cast("int")))
    return got.withColumn("text", F.when(F.col("q_part") == 0, F.col("text")).otherwise(part)).select(*names).toDF(*docs.columns)


#: The same in DuckDB SQL; the water level is found by trying each number of full sources.
ORACLE = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents
), totals as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), weighed as (
  select *, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, source_size * 2.0::double as cap from totals
), leveled as (
  select *, ((select sum(source_size) from totals) * 1.5::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as lev from weighed
), targets as (
  select source, source_size, case when cap <= weight * lev then cap else weight * (select max(lev) from leveled where cap > weight * lev) end as target from leveled
), placed as (
  select s.doc_id, s.size, t.source_size, t.target, cast(floor(t.target) as bigint) as budget,
    coalesce(sum(s.size) over (partition by s.source order by md5('mix' || coalesce(cast(s.doc_id as varchar), '')), s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as start
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  cast(case when source_size > 0 then (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - start)) else 0 end as bigint) as taken
from placed
"""

"""Quality rules: base rules, then robust multivariate outliers per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.llm.columns import seal, tidied
from blockloom.llm.textstats import text_stats
from blockloom.scratch import materialize

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Least spread of each transformed statistic: log words, log mean word length, root of symbols a word,
#: root of repeated lines a word, root of the repeated part. It is added to the covariance, which else collapses where most are zero.
FLOORS = (1.0, 0.12, 0.08, 0.12, 0.12)
P = len(FLOORS)
#: Part of a group that the determinant is minimised over, and the factor that makes its covariance consistent for
#: normal data: 0.5 / F(chi-square with 7 degrees, 4.351), 4.351 being the median with 5 degrees.
HALF, CONSISTENT = 0.5, 1.912
#: Chi-square quantile with 5 degrees at 1 - 1e-9: squared distances beyond it are rejected.
CUT = 51.0
#: Rows that an estimate's parent (of a language and source: the language's; of a language: that of all rows) counts for.
PRIOR = 50.0
#: Concentration steps of each start; a group's ends where its log determinant moves by no more than this, or after so many.
EARLY, STILL, STEPS = 2, 0.02, 12
#: Histogram bins for each doubling of the squared distance.
FINE = 32


@tidied
def _add_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        rows = [text_stats(x.as_py()) for x in texts]
        columns = list(zip(*rows)) if rows else [()] * len(STATS)
        arrays = [*batch.columns, *(pa.array(c, pa.int64()) for c in columns)]
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *(f"q_{s}" for s in STATS)])


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``q_<name>`` for each of STATS."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"q_{s}", T.LongType()) for s in STATS)])
    return docs.mapInArrow(_add_stats, schema)


def base_failed() -> Column:
    return (F.col("q_n_words") < 10) | (100 * F.col("q_n_repeat_words") > 20 * F.col("q_n_words"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("q_n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.log(F.greatest(F.col("q_word_chars"), F.lit(1)) / n),
        F.sqrt(F.col("q_n_symbols") / n),
        F.sqrt(F.col("q_n_dup_lines") / n),
        F.sqrt(F.col("q_n_repeat_words") / n),
    ]


def _group() -> Column:
    return F.to_json(F.struct(F.col("lang").cast("string").alias("l"), F.col("source").cast("string").alias("s")))


def _language() -> Column:
    return F.to_json(F.struct(F.col("lang").cast("string").alias("l")))


def _squared_distance(mark: str = "") -> Column:
    x = [F.col(f"{mark}x{i}") - F.col(f"{mark}center")[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(P):
            total = total + x[i] * x[j] * F.col(f"{mark}inverse")[i * P + j]
    return total


def _matrix(upper) -> np.ndarray:
    full = np.zeros((P, P))
    full[np.triu_indices(P)] = upper
    return full + np.triu(full, 1).T


def _moments(x: str) -> list[Column]:
    sums = F.array(*(F.sum(f"{x}{i}") for i in range(P))).alias(f"{x}_sums")
    products = F.array(*(F.sum(F.col(f"{x}{i}") * F.col(f"{x}{j}")) for i in range(P) for j in range(i, P))).alias(f"{x}_products")
    return [sums, products]


def _estimate(pool: str, start: int, center: np.ndarray, cov: np.ndarray, old: float = np.inf) -> tuple:
    cov = cov + np.diag(np.square(FLOORS))
    return pool, start, center.tolist(), cov.ravel().tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1]), old


FITTED = "pool long, start int, center array<double>, cov array<double>, inverse array<double>, logdet double, old double"
_FITTED = [x.split()[0] for x in FITTED.split(", ")]


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Moments of each group's nearest part -> center, regularised covariance, its inverse and log determinant."""
    for got in batches:
        rows = []
        for r in got.itertuples(index=False):
            mean = np.array(r.x_sums) / r.n
            rows.append(_estimate(r.pool, r.start, mean, CONSISTENT * (_matrix(np.array(r.x_products) / r.n) - np.outer(mean, mean)), r.old))
        yield pd.DataFrame(rows, columns=_FITTED)


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three starts of each group: medians with quartile spreads, mean and covariance of all rows, and medians with the
    correlation of rows after their distance from the median was squashed."""
    for got in batches:
        rows = []
        for r in got.itertuples(index=False):
            middle, spread = np.array(r.middle), np.array(r.spread)
            rows.append(_estimate(r.pool, 0, middle, np.diag(np.square(spread))))
            mean = np.array(r.x_sums) / r.n
            rows.append(_estimate(r.pool, 1, mean, _matrix(np.array(r.x_products) / r.n) - np.outer(mean, mean)))
            tame = np.array(r.t_sums) / r.n
            squashed = _matrix(np.array(r.t_products) / r.n) - np.outer(tame, tame)
            scale = np.sqrt(np.maximum(np.diag(squashed), 1e-9))
            rows.append(_estimate(r.pool, 2, middle, squashed / np.outer(scale, scale) * np.outer(spread, spread)))
        yield pd.DataFrame(rows, columns=_FITTED)


def _first_estimates(rows: DataFrame) -> DataFrame:
    """``_starts`` of each pool. Medians and quartiles come from histograms of 1/100 steps: a bounded number of bins."""
    bins = rows.select("pool", F.posexplode(F.array(*(F.round(F.col(f"x{i}") * 100).cast("long") for i in range(P)))).alias("k", "bin")).groupBy("pool", "k", "bin").agg(F.count("*").alias("n"))
    up = Window.partitionBy("pool", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("seen", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("pool", "k")))
    quartile = [F.min(F.when(F.col("seen") >= q * F.col("all"), F.col("bin"))) / 100 for q in (0.25, 0.5, 0.75)]
    q = bins.groupBy("pool", "k").agg(quartile[1].alias("middle"), ((quartile[2] - quartile[0]) / 1.349).alias("spread"))
    q = q.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct("k", "middle", "spread"))).alias("f"))
    q = materialize(q.select("pool", F.transform("f", lambda x: x["middle"]).alias("middle"), F.transform("f", lambda x: x["spread"]).alias("spread")), "quartiles")
    tame = [F.tanh((F.col(f"x{i}") - F.col("middle")[i]) / (F.col("spread")[i] + FLOORS[i])).alias(f"t{i}") for i in range(P)]
    sums = rows.join(q, "pool").select("pool", *(f"x{i}" for i in range(P)), *tame).groupBy("pool").agg(F.count("*").alias("n"), *_moments("x"), *_moments("t"))
    return sums.join(q, "pool").mapInPandas(_starts, FITTED)


def _concentrate(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """One step: the estimates of the half of each pool that is nearest by ``fitted(pool, start, ...)``."""
    far = rows.join(fitted, "pool").withColumn("bin", F.floor(F.log2(_squared_distance() + 1e-6) * FINE).cast("int"))
    up = Window.partitionBy("pool", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = far.groupBy("pool", "start", "bin").agg(F.count("*").alias("n"))
    bins = bins.withColumn("seen", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("pool", "start")))
    cut = materialize(bins.where(F.col("seen") >= HALF * F.col("all")).groupBy("pool", "start").agg(F.min("bin").alias("cut")), "cut")
    near = far.join(cut, ["pool", "start"]).where("bin <= cut")
    return materialize(near.groupBy("pool", "start").agg(F.count("*").alias("n"), F.first("logdet").alias("old"), *_moments("x")).mapInPandas(_solve, FITTED), "fit")


def _best(fitted: DataFrame) -> DataFrame:
    names = [c for c in _FITTED if c != "pool"]
    best = fitted.groupBy("pool").agg(F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("b"))
    return materialize(best.select("pool", *(F.col(f"b.{c}").alias(c) for c in names)), "best")


def determinants(rows: DataFrame) -> DataFrame:
    """``pool, n, center, cov`` of materialised ``rows(pool, x0, x1, ...)``: each pool's minimum-covariance-determinant estimate.

    Concentration steps keep the half of a pool that is nearest and estimate anew. Each of three starts takes EARLY steps; the
    one of the least determinant goes on until the determinant stays, for each pool by itself. The nearest half is found from
    a fine histogram of log distances and its moments are sums, so every step is a pre-aggregated pass over all rows of
    the pools that still move, and nothing of a pool meets in one task but its bins.
    """
    fitted = materialize(_first_estimates(rows), "fit")
    for _ in range(EARLY):
        fitted = _concentrate(rows, fitted)
    moving = _best(fitted)
    done = []
    for _ in range(STEPS):
        moving = _concentrate(rows, moving)
        still = F.abs(F.col("logdet") - F.col("old")) <= STILL
        done.append(moving.where(still))
        moving = moving.where(~still)
        if moving.isEmpty():
            break
    for more in done:
        moving = moving.union(more)
    return rows.groupBy("pool").agg(F.count("*").cast("double").alias("n")).join(moving, "pool").select("pool", "n", "center", "cov")


def _blend(center: str, cov: str, n: str, above: str, above_cov: str) -> list[Column]:
    weight = F.col(n) / (F.col(n) + PRIOR)
    mixed = lambda a, b: F.zip_with(a, b, lambda x, y: x * weight + y * (1 - weight))
    return [mixed(center, above), mixed(cov, above_cov)]


def _inverted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for got in batches:
        inverse = [np.linalg.inv(np.array(c).reshape(P, P)).ravel().tolist() for c in got["cov"]]
        yield pd.DataFrame({"grp": got["grp"], "center": got["center"], "inverse": inverse})


def fit_outliers(stats: DataFrame) -> DataFrame:
    """Robust estimates of each language and source in ``stats(lang, source, q_...)``: ``grp, center, inverse``.

    Minimum-covariance-determinant estimates of each group, each language and all rows (``determinants``) are blended:
    a language's with those of all rows, a group's with its language's, each by n / (n + PRIOR). So large groups go by
    themselves, small ones lean on their language, and no size changes the rule.

    Rows that fail the base rules aren't used; null languages and sources are groups of their own; repeated rows and ties
    count as rows; an empty table gives an empty result; other columns are ignored. Pass a materialised table.
    """
    rows = stats.where(~base_failed()).select(_group().alias("grp"), _language().alias("lng"), *(x.alias(f"x{i}") for i, x in enumerate(_vector())))
    groups = rows.select("grp", "lng").distinct()
    names = F.lit("all"), F.concat(F.lit("l"), "lng"), F.concat(F.lit("g"), "grp")
    pools = F.explode(F.array(*map(F.xxhash64, names))).alias("pool")
    found = materialize(determinants(materialize(rows.select(pools, *(f"x{i}" for i in range(P))), "vectors")), "params")
    named = lambda k: found.select(F.col("pool").alias(f"p{k}"), F.col("n").alias(f"n{k}"), F.col("center").alias(f"c{k}"), F.col("cov").alias(f"v{k}"))
    got = groups
    for k in range(3):
        got = got.join(named(k), F.col(f"p{k}") == F.xxhash64(names[k]))
    center, cov = _blend("c1", "v1", "n1", "c0", "v0")
    got = got.withColumns({"c1": center, "v1": cov})
    center, cov = _blend("c2", "v2", "n2", "c1", "v1")
    return materialize(got.select("grp", center.alias("center"), cov.alias("cov")).mapInPandas(_inverted, "grp string, center array<double>, inverse array<double>"), "params")


def judge(stats: DataFrame, fitted: DataFrame) -> DataFrame:
    """Adds ``q_base_failed, q_kept`` to rows with statistics, which must hold no other names that start with ``q_``.

    A row without estimates (its whole group fails the base rules) is kept unless it fails them too; nulls, ties and
    repeated rows are judged by their statistics; an empty table gives an empty result.
    """
    names = stats.columns
    rows = stats.withColumn("q_group", _group()).withColumns({f"q_x{i}": x for i, x in enumerate(_vector())})
    params = fitted.select(F.col("grp").alias("q_grp"), F.col("center").alias("q_center"), F.col("inverse").alias("q_inverse"))
    rows = rows.join(params, F.col("q_group") == F.col("q_grp"), "left").withColumn("q_base_failed", base_failed())
    outlier = F.coalesce(_squared_distance("q_") > CUT, F.lit(False))
    return rows.withColumn("q_kept", ~F.col("q_base_failed") & ~outlier).select(*names, "q_base_failed", "q_kept")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id``, the five statistics, ``base_failed`` and ``kept`` of every row of ``docs(doc_id, text, lang, source)``.

    Null and empty texts have no words and fail the base rules; null languages and sources make groups of their own;
    repeated rows and ties are judged alike; other columns are ignored; an empty table gives an empty result.
    """
    stats = materialize(with_stats(docs.select("doc_id", "text", "lang", "source")).drop("text"), "stats")
    got = judge(stats, fit_outliers(stats))
    return got.select("doc_id", *(F.col(f"q_{s}").alias(s) for s in STATS), F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged. Texts are never shuffled: they are measured twice instead.

    Null and empty texts fail the base rules and go; very long ones are measured whole; null languages and sources make
    groups of their own; ties and repeated rows are judged alike; other columns stay whatever their names and types; an
    empty table gives an empty result.
    """
    rows = seal(docs, "text", "lang", "source")
    fitted = fit_outliers(materialize(with_stats(rows.select("text", "lang", "source")).drop("text"), "stats"))
    return judge(with_stats(rows), fitted).where("q_kept").select(*rows.columns).toDF(*docs.columns)

"""URL filters: rules by host and path, and a tree of path templates for what no rule decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.scratch import materialize

#: (rule, verdict); a rule is a host and a path that starts with its first slash.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: A segment without labelled pages that has less than this part of its node's pages is variable and becomes a wildcard.
PART = 0.05
#: A segment whose blocked part of labelled pages is within so many standard errors of its node's is merged with its like.
SIMILAR = 1.96
#: Pseudo-pages with the parent's purity that smooth a node's, and the purity that rejects a template.
SMOOTHING, PURE = 2.0, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(q_url, instr(q_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct ``(rule, verdict)`` of the longest rule that fits the host or a parent domain and starts the path; else null."""
    best = None
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
        best = found if best is None else F.coalesce(found, best)
    return best if best is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def segments(path: Column) -> Column:
    """All path segments, with numbers, dates, long hexadecimal strings and identifiers as wildcards of their kind."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")

    def general(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>")
        x = F.regexp_replace(x, r"\b\d{4}-\d{2}-\d{2}\b", "<date>")
        x = F.regexp_replace(x, r"\b(?=[a-f]*[0-9])[0-9a-f]{12,}\b", "<hex>")
        return F.regexp_replace(x, r"[0-9]+", "<n>")

    return F.transform(parts, general)


def template_verdicts(pages: DataFrame) -> DataFrame:
    """``q_host, q_segments`` -> ``template, purity, rejected`` from ``q_host, q_segments, blocked`` (1, 0 or null) of all pages.

    Pages are first counted by host and general segments, then each host's tree grows level by level. Of a node's branches,
    those with labelled pages whose blocked part can't be told from the node's become its wildcard branch, and with them
    rare ones without labels; others stay literal. A path that no other shares a node with is done, so there
    are as many rounds as paths of one host have in common, not as the longest has segments.

    Purity is the blocked part of a node's labelled pages, smoothed towards its parent's: a host's towards that of all
    pages, a branch's towards that of the node above. A branch without labels thus has its parent's, down
    from its host's. A host without any labelled page rejects nothing.

    Null hosts or segments count as empty ones, ties don't matter, repeated rows count as rows, other columns are
    ignored and an empty table gives an empty result.
    """
    host, path = F.coalesce("q_host", F.lit("")).alias("q_host"), F.coalesce("q_segments", F.array().cast("array<string>")).alias("q_segments")
    counts = pages.select(host, path, "blocked").groupBy("q_host", "q_segments").agg(F.count("*").alias("n"), F.sum(F.coalesce("blocked", F.lit(0))).alias("bad"), F.count("blocked").alias("known"))
    counts = materialize(counts, "paths")
    seen = counts.agg(F.sum("bad").alias("bad"), F.sum("known").alias("known")).first()
    overall = seen.bad / seen.known if seen.known else 0.0
    node = counts.groupBy("q_host").agg(F.sum("n").alias("pn"), F.sum("bad").alias("pb"), F.sum("known").alias("pk"), F.count("*").alias("paths"))
    node = node.withColumn("purity", _smoothed(F.col("pb"), F.col("pk"), F.lit(overall))).withColumn("labelled", F.col("pk") > 0)
    tree = materialize(counts.join(node, "q_host").withColumn("template", F.lit("")), "tree")
    finished, k = [], 0
    while True:
        done = (F.size("q_segments") <= k) | (F.col("paths") == 1)
        tail = F.when(F.size("q_segments") > k, F.concat(F.lit("/"), F.array_join(F.slice("q_segments", k + 1, F.greatest(F.size("q_segments") - k, F.lit(1))), "/"))).otherwise("")
        finished.append(tree.where(done).select("q_host", "q_segments", F.concat("template", tail).alias("template"), "purity", "labelled"))
        open_ = tree.where(~done)
        if open_.isEmpty():
            break
        open_ = open_.withColumn("seg", F.element_at("q_segments", k + 1))
        branch = open_.groupBy("q_host", "template", "seg").agg(F.sum("n").alias("bn"), F.sum("bad").alias("bb"), F.sum("known").alias("bk"), *(F.first(c).alias(c) for c in ("pn", "pb", "pk", "purity")))
        rate = F.col("pb") / F.col("pk")
        error = F.sqrt((F.col("pb") + 1) * (F.col("pk") - F.col("pb") + 1) / F.pow(F.col("pk") + 2, 2) / F.col("bk"))
        alike = (F.col("bk") > 0) & (F.abs(F.col("bb") / F.col("bk") - rate) <= SIMILAR * error)
        rare = (F.col("bk") == 0) & (F.col("bn") < PART * F.col("pn"))
        branch = branch.withColumn("step", F.when(alike | rare, "/*").otherwise(F.concat(F.lit("/"), "seg"))).select("q_host", "template", "seg", "step")
        moved = open_.join(branch, ["q_host", "template", "seg"]).withColumn("template", F.concat("template", "step"))
        moved = moved.select("q_host", "q_segments", "n", "bad", "known", "template", "labelled", F.col("purity").alias("above"))
        below = moved.groupBy("q_host", "template").agg(F.sum("n").alias("pn"), F.sum("bad").alias("pb"), F.sum("known").alias("pk"), F.count("*").alias("paths"), F.first("above").alias("above"))
        below = below.withColumn("purity", _smoothed(F.col("pb"), F.col("pk"), F.col("above"))).drop("above")
        k += 1
        tree = materialize(moved.drop("above").join(below, ["q_host", "template"]), f"tree{k}")
    found = finished[0]
    for more in finished[1:]:
        found = found.union(more)
    return found.select("q_host", "q_segments", "template", "purity", (F.col("labelled") & (F.col("purity") >= PURE)).alias("rejected"))


def _smoothed(bad: Column, known: Column, above: Column) -> Column:
    return (bad + SMOOTHING * above) / (known + SMOOTHING)


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template`` of every row of ``pages(page_id, url)``.

    A page that a rule fits gets the longest rule's verdict; such pages are the labels by which the others' path templates
    are judged. Null urls and urls without ``://`` have an empty host and path and are allowed unless their
    template is rejected; null ids, repeated rows and ties are rows like others; other columns are ignored; an empty
    table gives an empty result.
    """
    url = F.col("q_url")
    host, path = host_and_path(url)
    rows = pages.select("page_id", F.col("url").alias("q_url")).select("page_id", host.alias("q_host"), path.alias("path"))
    rows = rows.withColumn("r", rule_for(F.col("q_host"), F.col("path"), rules)).withColumn("q_segments", segments(F.col("path")))
    rows = rows.withColumn("blocked", F.when(F.col("r.verdict") == "block", 1).when(F.col("r.verdict") == "allow", 0))
    rows = materialize(rows, "urls")
    found = materialize(template_verdicts(rows), "templates")
    got = rows.join(found, ["q_host", "q_segments"], "left")
    other = F.when(F.col("rejected"), "block").otherwise("allow")
    return got.select("page_id", F.col("q_host").alias("host"), "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", other).alias("verdict"), "template")

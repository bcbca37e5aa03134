import math
import random

from blockloom.llm import url_filter as U
from blockloom.llm.url_filter import judge_urls, template_verdicts


def judged(spark, urls):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return [(r.host, r.path, r.rule, r.verdict) for r in judge_urls(df).orderBy("page_id").collect()]


def test_hosts_paths_and_rules(spark):
    got = judged(spark, ["http://A.Example.NET/en/x?q#f", "https://b.net/", "https://b.net", "x://example.com/de/1", "x://a.org/fr/2#t", "nothing", None, "http://notexample.com/de/", "http://example.com/de/?x", "http://inet/", "HTTP://É.com?a://b.net/"])
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("b.net", "/", "net/", "block"),
        ("b.net", "", None, "allow"),
        ("example.com", "/de/1", "example.com/de/", "block"),
        ("a.org", "/fr/2", "org/fr/", "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("notexample.com", "/de/", None, "allow"),
        ("example.com", "/de/", "example.com/de/", "block"),
        ("inet", "/", None, "allow"),
        ("É.com", "", None, "allow"),
    ]


def test_templates_reject_by_purity(spark):
    rules = (("example.com/ads/click/1", "block"), ("example.com/news/a", "allow"))
    urls = [f"http://example.com/ads/click/1{i}" for i in range(30)] + [f"http://example.com/ads/click/2{i}" for i in range(3)] + [f"http://example.com/news/a{i}" for i in range(30)] + ["http://example.com/news/zzz"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in judge_urls(df, rules).collect()}
    for k in (30, 31, 32):  # no rule, but the template of pages that one blocks
        assert rows[k].rule is None and rows[k].verdict == "block"
    assert rows[63].rule is None and rows[63].verdict == "allow"
    assert judge_urls(df.limit(0), rules).count() == 0


def brute(pages):
    """host, segments, label of each page -> (template, purity, rejected), by recursion over each host's tree."""
    known = [p[2] for p in pages if p[2] is not None]
    overall = sum(known) / len(known) if known else 0.0
    out = {}

    def rates(rows):
        labels = [r[2] for r in rows if r[2] is not None]
        return sum(labels), len(labels)

    def smooth(rows, above):
        bad, n = rates(rows)
        return (bad + U.SMOOTHING * above) / (n + U.SMOOTHING)

    def grow(host, rows, k, template, purity, labelled):
        paths = {r[1] for r in rows}
        if len(paths) == 1 or all(len(p) <= k for p in paths):
            for r in rows:
                rest = "".join("/" + x for x in r[1][k:])
                out[host, r[1]] = (template + rest, round(purity, 9), labelled and purity >= U.PURE)
            return
        ended = [r for r in rows if len(r[1]) <= k]
        for r in ended:
            out[host, r[1]] = (template, round(purity, 9), labelled and purity >= U.PURE)
        rows = [r for r in rows if len(r[1]) > k]
        total, (pb, pk) = len(rows) + len(ended), rates(rows + ended)
        steps = {}
        for seg in {r[1][k] for r in rows}:
            mine = [r for r in rows if r[1][k] == seg]
            bb, bk = rates(mine)
            if bk:
                error = math.sqrt((pb + 1) * (pk - pb + 1) / (pk + 2) ** 2 / bk)
                wild = abs(bb / bk - pb / pk) <= U.SIMILAR * error
            else:
                wild = len(mine) < U.PART * total
            steps.setdefault("/*" if wild else "/" + seg, []).extend(mine)
        for step, mine in steps.items():
            grow(host, mine, k + 1, template + step, smooth(mine, purity), labelled)

    for host in {p[0] for p in pages}:
        rows = [p for p in pages if p[0] == host]
        grow(host, rows, 0, "", smooth(rows, overall), rates(rows)[1] > 0)
    return out


def test_tree_against_brute_force(spark):
    rng = random.Random(8)
    pages = []
    for _ in range(1500):
        host = rng.choice(["a", "a", "a", "b", "c", ""])
        path = tuple(rng.choice(["x", "y", "z", f"s{rng.randrange(60)}"]) for _ in range(rng.randrange(5)))
        odds = 0.95 if path[:1] == ("x",) or host == "b" else 0.1
        pages.append((host, path, None if host == "c" or path[-1:] == ("z",) or rng.random() < 0.4 else int(rng.random() < odds)))
    df = spark.createDataFrame([(h, list(p), b, "t") for h, p, b in pages], "q_host string, q_segments array<string>, blocked int, template string")
    got = {(r.q_host, tuple(r.q_segments)): (r.template, round(r.purity, 9), r.rejected) for r in template_verdicts(df).collect()}
    want = brute(pages)
    assert got == want
    assert {x[2] for x in want.values()} == {True, False} and any("/*" in x[0] for x in want.values())


def test_odd_pages(spark):
    long = "http://a.com/" + "/".join(f"s{k}" for k in range(3000))
    rows = [(None, "http://a.com/x", 1), (None, "http://a.com/x", 1), (7, long, 2), (8, None, 3), (8, "http://b.net/y", 3)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, q_segments int")).collect()
    assert sorted(str(r.page_id) for r in got) == ["7", "8", "8", "None", "None"]
    assert {r.verdict for r in got} == {"allow", "block"}


def test_templates_without_labels_reject_nothing(spark):
    got = judged(spark, [f"http://spam.net/{k}" for k in range(40)] + ["http://clean.com/a", "http://clean.com/b", "nothing", None])
    assert [v for *_, v in got] == ["block"] * 40 + ["allow"] * 4


def test_templates_differ_below_the_sixth_segment(spark):
    rules = (("example.com/a/b/c/d/e/f/bad/x", "block"), ("example.com/a/b/c/d/e/f/good/x", "allow"))
    urls = [f"http://example.com/a/b/c/d/e/f/{kind}/{x}" for kind in ("bad", "good") for x in ["x"] * 40 + ["y"]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in judge_urls(df, rules).collect()}
    assert rows[0].template != rows[41].template and rows[0].template.startswith("/") and "rest" not in rows[0].template

import random
import re

import numpy as np

from blockloom.llm import quality as Q
from blockloom.llm.quality import CUT, determinants, fit_outliers, keep_good, quality_verdicts, with_stats
from blockloom.llm.textstats import text_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    hit = {k + j for k, w in enumerate(windows) if w in twice for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_statistics():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "é à", "a b c d e a b c d e", "a b c d e f a b c d e f g", "x\nx\n x\nx \n\n", "a b c d", "# * $%&|<>"]
    texts += ["".join(rng.choice(["a ", "b ", "c", "\n", "#", "é", "\x0b"]) for _ in range(rng.randrange(120))) for _ in range(300)]
    for t in texts:
        assert text_stats(None if t is None else t.encode()) == brute_stats(t)


def documents():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(3000)]
    good = [" ".join(rng.choice(words, rng.integers(30, 400))) for _ in range(300)]
    rows = [(k, t, "en" if k % 3 else None, "s") for k, t in enumerate(good)]
    rows += [(1000 + k, " ".join(w + "%%%" for w in rng.choice(words, 60)), "en", "s") for k in range(20)]
    rows += [(2000, "same five words again here " * 30, "en", "s"), (2001, "too short", "en", "s"), (2002, None, None, None), (2003, "", "en", "s"), (3, good[3], None, "s")]
    rows += [(3000, " ".join(rng.choice(words, 30000)), "en", "rare")]
    return rows


def test_verdicts(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, center double").repartition(3)
    got = quality_verdicts(df).collect()
    texts = dict((r[0], r[1]) for r in rows)
    for r in got:
        want = brute_stats(texts[r.doc_id]) if r.doc_id != 3000 else tuple(r)[1:6]
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    kept = {r.doc_id for r in got if r.kept}
    assert len(got) == len(rows) and kept == {*range(300), 3000}
    good = keep_good(df)
    assert sorted(r.doc_id for r in good.collect()) == sorted([*range(300), 3, 3000]) and good.columns == df.columns
    assert quality_verdicts(df.limit(0)).count() == 0


def test_estimates_resist_outliers(spark):
    """A third of a group being junk doesn't move the estimate: distances agree with those from the clean part alone."""
    rows = documents()[:300]
    junk = [(5000 + k, " ".join(["aaa%%%%"] * 3 + [str(k + j) + "%%%%" for j in range(40)]), "en", "s") for k in range(90)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_verdicts(df).collect() if r.kept}
    assert kept == set(range(300)) and CUT > 40


def test_odd_columns_stay(spark):
    rows = [(*r[:4], 1, "g", 0.5, {"k": 1}) for r in documents()[:60]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, q_n_words int, q_group string, q_x0 double, m map<string,int>")
    out = keep_good(df)
    assert out.schema == df.schema and sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))


def test_windows_are_compared_by_words(monkeypatch):
    import builtins

    monkeypatch.setattr("blockloom.llm.textstats.hash", lambda w: 7, raising=False)
    for t in ("a b c d e f g h", "a b c d e a b c d e", "a b c d e f a b c d e g"):
        assert text_stats(t.encode()) == brute_stats(t)
    assert builtins.hash("a") != 7


def exact_mcd(x, rng):
    """Least log determinant over many random starts, each concentrated to the end on exact halves."""
    floor, half, best = np.diag(np.square(Q.FLOORS)), -(-len(x) // 2), (np.inf, None)
    for _ in range(200):
        at = rng.choice(len(x), 7, replace=False)
        for _ in range(30):
            part = x[at]
            cov = Q.CONSISTENT * np.cov(part.T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - part.mean(0), np.linalg.inv(cov), x - part.mean(0))
            new = np.argsort(d, kind="stable")[:half]
            if set(new) == set(at):
                break
            at = new
        best = min(best, (np.linalg.slogdet(cov)[1], tuple(part.mean(0))))
    return best


def test_against_an_independent_search(spark):
    """Small groups with a third of outliers, not along an axis: determinant and center of an exhaustive search."""
    rng = np.random.default_rng(5)
    groups = {}
    for k in range(5):
        shape = rng.normal(size=(5, 5))
        clean = rng.normal(size=(44, 5)) @ shape + 5
        groups[k] = np.vstack([clean, rng.normal(size=(20, 5)) * 3 @ shape + clean.mean(0) + 9 * shape[0]])
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    got = {r.pool: r for r in determinants(spark.createDataFrame(rows, "pool long, x0 double, x1 double, x2 double, x3 double, x4 double")).collect()}
    for g, x in groups.items():
        logdet, center = exact_mcd(x, rng)
        mine = np.linalg.slogdet(np.array(got[g].cov).reshape(5, 5))[1]
        assert got[g].n == 64 and mine <= logdet + 0.6
        scale = np.sqrt(np.diag(np.array(got[g].cov).reshape(5, 5)))
        assert (np.abs(np.array(got[g].center) - center) / scale).max() < 0.5


def test_small_groups_lean_on_their_language(spark):
    rows = documents()[:300] + [(7000 + k, " ".join(reversed(t.split())), "en", f"rare{k}") for k, (_, t, *_) in enumerate(documents()[:3])]
    stats = with_stats(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = {r.grp: r for r in fit_outliers(stats).collect()}
    large, small = got['{"l":"en","s":"s"}'], got['{"l":"en","s":"rare1"}']
    assert len(got) == 5 and not np.allclose(large.center, small.center) and np.abs(np.array(large.center) - small.center).max() < 0.3

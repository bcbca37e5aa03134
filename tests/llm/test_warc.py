import base64
import gzip
import hashlib

from blockloom.llm.warc import _Records, archive_pages, gzip_member, read_copies, record, register


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b and j is not None]
        top = max(same, default=None) if len(b) >= least else i
        revisit = top is not None and i != top
        out.append((i, len(b), digest(b), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def test_pages_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y%41", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "http://b", "x" * 300000), (6, "w", "only"), (7, "z", "WARC/1.1\r\n\r\n"), (None, "n", "only"), (6, "w", "only"), (-5, "v", "neg")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    for least in (0, 5):
        assert sorted((tuple(r) for r in archive_pages(df, least).collect()), key=repr) == brute(rows, least)
    assert archive_pages(df.limit(0)).count() == 0


def test_predicates_and_skipping(spark, tmp_path):
    register(spark)
    records = [record("response", f"urn:page:{k}", f"http://h/{k}", digest(b"%d" % k * 40000), b"%d" % k * 40000, 40000 * len(str(k))) for k in range(12)]
    records.insert(3, record("revisit", "urn:page:99", "http://h/99", digest(b"0" * 40000), None, 40000, "urn:page:0"))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip_member, records)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc").write_bytes(b"".join(records))
    df = spark.read.format("warc").option("target", "1").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3 and df.count() == 39
    assert {(r.record_id, r.refers_to, r.payload, r.http_length) for r in df.where("record_type = 'revisit'").collect()} == {("urn:page:99", "urn:page:0", None, 40000)}
    assert [bytes(r.payload) for r in df.where("target_uri = 'http://h/11'").collect()] == [b"11" * 40000] * 3
    assert df.where("record_type = 'response' and record_id in ('urn:page:1', 'urn:page:2')").count() == 6
    heads = spark.read.format("warc").option("payload", "false").load(str(tmp_path)).where("record_type = 'response'").collect()
    assert len(heads) == 36 and all(r.payload is None and r.http_length for r in heads)
    assert len(list(_Records(str(tmp_path / "a.warc.gz"), {"record_type": {"revisit"}}, True))) == 1
    heads = spark.read.format("warc").option("payload", "false").load(str(tmp_path / "a.warc.gz")).where("record_type = 'revisit'")
    assert "PushedFilters" in heads._jdf.queryExecution().toString() or heads.count() == 1


def rows_of(path, wanted=None, payload=True):
    return [(r[0], r[8], r[9]) for r in _Records(str(path), wanted or {}, payload)]


def response(k, body, length=None):
    got = record("response", f"urn:page:{k}", f"http://h/a%20b{k}", digest(body), body, len(body))
    return got if length is None else got.replace(b"Content-Length: %d\r\n\r\nHTTP" % (got.index(b"\r\n\r\n", got.index(b"HTTP")) + 4 - got.index(b"HTTP") + len(body)), b"Content-Length: %d\r\n\r\nHTTP" % length)


def test_damaged_archives_lose_nothing_silently(tmp_path):
    a, b, c = (response(k, b"%d" % k * 3000) for k in (1, 2, 3))
    bodies = {f"urn:page:{k}": b"%d" % k * 3000 for k in (1, 2, 3)}
    cut = gzip_member(b)[:200]
    for k, squeeze in enumerate((gzip_member, gzip.compress)):
        path = tmp_path / f"cut{k}.warc.gz"
        path.write_bytes(squeeze(a) + squeeze(b)[:60] + squeeze(c))
        got = rows_of(path)
        assert [x for x in got if x[2] is None] == [(i, bodies[i], None) for i in ("urn:page:1", "urn:page:3")]
        assert any(x[2] for x in got)
        assert {x[0] for x in _Records(str(path), {"record_id": {"urn:page:3"}}, True)} == {"urn:page:3"}
    two = tmp_path / "two.warc.gz"
    two.write_bytes(gzip.compress(a + b) + gzip_member(c) + gzip_member(b + a))
    assert rows_of(two) == [(f"urn:page:{k}", bodies[f"urn:page:{k}"], None) for k in (1, 2, 3, 2, 1)]
    assert [x[0] for x in rows_of(two, {"record_id": {"urn:page:1"}}, False)] == ["urn:page:1"] * 2
    (tmp_path / "junk.warc.gz").write_bytes(gzip_member(a) + b"junk" * 10 + gzip_member(b))
    assert [x[0] for x in rows_of(tmp_path / "junk.warc.gz")] == ["urn:page:1", None, "urn:page:2"]
    short = response(2, b"2" * 3000, 9000)
    for name, data in (("short.warc", a + short + c), ("short.warc.gz", gzip.compress(a + short + c))):
        (tmp_path / name).write_bytes(data)
        got = rows_of(tmp_path / name)
        assert [(x[0], x[1]) for x in got] == list(bodies.items()) and [bool(x[2]) for x in got] == [False, True, False]
        assert [x[0] for x in rows_of(tmp_path / name, {"record_id": {"urn:page:3"}})] == ["urn:page:3"]
    (tmp_path / "end.warc").write_bytes(a + b[:-500])
    assert [(x[0], bool(x[2])) for x in rows_of(tmp_path / "end.warc")] == [("urn:page:1", False), ("urn:page:2", True)]
    (tmp_path / "empty.warc").write_bytes(b"")
    assert rows_of(tmp_path / "empty.warc") == [] and len(cut) == 200


def test_urls_stay_as_they_are(spark, tmp_path):
    register(spark)
    (tmp_path / "a.warc").write_bytes(response(1, b"x"))
    df = spark.read.format("warc").load(str(tmp_path))
    assert df.first().target_uri == "http://h/a%20b1" and df.where("target_uri = 'http://h/a%20b1'").count() == 1


def test_revisits_have_their_responses_digest(spark, tmp_path):
    register(spark)
    revisit = record("revisit", "urn:page:2", "u", "WRONG", None, 77, "urn:page:1")
    (tmp_path / "a.warc.gz").write_bytes(gzip_member(response(1, b"x" * 50)) + gzip_member(revisit))
    got = {r.record_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in read_copies(spark, str(tmp_path)).collect()}
    assert got == {"urn:page:1": (50, digest(b"x" * 50), "response"), "urn:page:2": (50, digest(b"x" * 50), "revisit")}

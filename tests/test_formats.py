import gzip

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.functions import codecs as K
from blockloom.functions import packets as P
from blockloom.functions import parsing as G
from blockloom.sources import config
from blockloom.sources.formats import log_record, register

H32 = bytes(range(32))
CASES = {
    "ReadAt": dict(offset=1 << 40, length=77),
    "WriteAt": dict(offset=5, data=b"xyz"),
    "WriteAtHash": dict(place=1, offset=9, length=4096, hash=H32),
    "WriteAtYouAlreadyHave": dict(block_size=4096, blocks=[1, 7, 9]),
    "WriteAtWithMap": dict(offset=1, map=[dict(id=1 << 63, slot=2)], data=b"d"),
    "NeedAt": dict(offset=1, length=2),
    "DontNeedAt": dict(offset=1, length=2),
    "DirtyList": dict(block_size=4096, blocks=[3]),
    "DevInfo": dict(size=1 << 40, block_size=4096, name="dé", schema="device {}"),
    "DeviceGroupInfo": dict(devices=[dict(index=3, info=P.encode("DevInfo", size=1, block_size=2, name="n", schema=""))]),
    "Event": dict(event=5, payload=b"\x07custom"),
    "Hashes": dict(hashes=[dict(block=4, hash=H32)]),
    "RemoveDev": {},
    "RemoveFromMap": dict(ids=[1, 1 << 62]),
    "AlternateSources": dict(sources=[dict(offset=1, length=2, hash=H32, location="endpoint bucket device")]),
    "ReadByHash": dict(hash=H32),
    "ReadAtResponse": dict(bytes=3, data=b"abc"),
    "WriteAtResponse": dict(bytes=3),
    "EventResponse": {},
    "ReadByHashResponse": dict(data=b"abc"),
    "ReadByHashResponseErr": dict(error="no such block"),
}


@pytest.mark.parametrize("kind", CASES)
def test_packets_round_trip_and_truncate(kind):
    packet = P.encode(kind, **CASES[kind])
    assert P.decode(packet) == (kind, CASES[kind])
    whole = [k for k, t in P.LAYOUTS[kind] if t == "rest"]
    if not whole and len(packet) > 1 and not any(n.startswith("*") for n, _ in P.LAYOUTS[kind]):
        with pytest.raises(P.InvalidPacket):
            P.decode(packet[:-1])


def test_known_bytes():
    assert P.encode("ReadAt", offset=258, length=3).hex() == "010201000000000000" + "03000000"
    assert K.encode_rle(0, b"\0\0\0\0\0").hex() == "0202" + "00" * 8 + "0b00"
    assert K.encode_rle(0, b"aaaab").hex() == "0202" + "00" * 8 + "0961" + "0262"
    assert K.encode_rle(0, b"baaaa").hex() == "0202" + "00" * 8 + "0a6261616161"
    assert K.encode_zeroes(0, bytes(13) + b"ab" + bytes(12) + b"c").hex() == "0205" + "00" * 8 + "1c" + "00" * 7 + "1a046162" + "360263"


data = st.lists(st.one_of(st.binary(max_size=20), st.integers(1, 40).map(bytes), st.integers(1, 20).map(lambda n: b"a" * n)), max_size=12).map(b"".join)


@settings(max_examples=200, deadline=None)
@given(data, st.sampled_from(sorted(K.ENCODERS)))
def test_codecs_round_trip(x, codec):
    assert K.decode_compressed(K.ENCODERS[codec](7, x)) == (7, x)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=30, max_size=30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 255)), max_size=10), st.integers(0, 6))
def test_changed_runs_rebuild(old, edits, allowance):
    new = bytearray(old)
    for at, value in edits:
        new[at] = value
    out = bytearray(old)
    runs = K.changed_runs(old, bytes(new), allowance)
    for at, part in runs:
        out[at : at + len(part)] = part
        assert old[at] != new[at] and old[at + len(part) - 1] != new[at + len(part) - 1]
    assert out == new


def test_frames_and_decode_rows(spark):
    packets = [P.encode(k, **v) for k, v in CASES.items()]
    stream = b"".join(P.frame(3, k, p) for k, p in enumerate(packets))
    assert list(P.frames(stream)) == [(3, k, p) for k, p in enumerate(packets)]
    rows = P.decode_packets(spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate([*packets, b"", b"\x63"])], "dev long, payload binary")).collect()
    assert [r.kind for r in rows] == [*CASES, None, None] and rows[-1].error
    names = spark.createDataFrame([(1,), (129,), (99,)], "c int").select(P.command_name(F.col("c")), P.is_response(F.col("c"))).collect()
    assert [tuple(r) for r in names] == [("ReadAt", False), ("ReadAtResponse", True), ("unknown", False)]


def test_sources(spark, tmp_path):
    register(spark)
    raw = bytes(range(256)) * 20
    (tmp_path / "raw").write_bytes(raw)
    df = spark.read.format("device_raw").option("block", 1000).option("split", 2000).load(str(tmp_path / "raw"))
    assert b"".join(bytes(r.data) for r in df.orderBy("block_no").collect()) == raw and df.rdd.getNumPartitions() == 3
    assert [r.block_no for r in df.where("block_no >= 2 and block_no < 4").orderBy("block_no").collect()] == [2, 3]
    lean = spark.read.format("device_raw").option("payload", "false").option("block", 1000).load(str(tmp_path / "raw"))
    assert lean.where("data is not null").count() == 0
    (tmp_path / "hashes").write_bytes(H32 + bytes(32))
    assert [r.hash for r in spark.read.format("block_hashes").load(str(tmp_path / "hashes")).orderBy("block_no").collect()] == [H32.hex(), "0" * 64]
    (tmp_path / "state").write_bytes(b"\x05\0\0\0\x07\0\0\0")
    assert sorted(r.block_no for r in spark.read.format("block_state").load(str(tmp_path / "state")).collect()) == [5, 7]
    rows = [dict(dt_ns=0, op="W", offset=8, data=b"abc"), dict(dt_ns=10, op="R", offset=1, length=9, data=None)]
    (tmp_path / "log.gz").write_bytes(gzip.compress(b"".join(map(log_record, rows))))
    got = spark.read.format("device_log").load(str(tmp_path / "log.gz")).orderBy("seq").collect()
    assert [(r.dt_ns, r.op, r.offset, r.length) for r in got] == [(0, "W", 8, 3), (10, "R", 1, 9)]
    (tmp_path / "objects").mkdir()
    for k in (0, 2):
        (tmp_path / "objects" / f"dev-{k * 4096}").write_bytes(b"z" * 4096)
    assert sorted(r.block_no for r in spark.read.format("object_blocks").option("prefix", "dev").load(str(tmp_path / "objects")).collect()) == [0, 2]


CONFIG = """
# two devices
device "disk" {
  size = "1G"
  system = "memory"
  blocksize = "64k"
  source "base" {
    size = "1G"
    system = "file"
    location = "base.img"
  }
}
device "mem" {
  size = "1234567"
  system = "sparsefile"
}
"""


def test_config(spark):
    blocks = config.read_config(CONFIG)
    assert config.read_config(config.write_config(blocks)) == blocks
    rows = {r.device: r for r in config.devices(spark, CONFIG).collect()}
    assert rows["disk"].num_blocks == 16384 and rows["disk"].parent == "disk/source" and rows["mem"].num_blocks == 302
    with pytest.raises(ValueError):
        config.devices(spark, 'device "s" { system = "s3" }')
    nested = config.nest_overlays(blocks[1], ["m-2.overlay", "m-1.overlay", "x.overlay", "m-1.state"], "m-")
    assert nested.attributes["location"] == "m-2.overlay" and nested.blocks[0].label == "m-2.state"
    assert nested.blocks[0].attributes["location"] == "m-1.overlay" and nested.blocks[0].blocks[0].attributes["size"] == "1234567"


def test_scalars(spark):
    sizes = spark.createDataFrame([("1G",), ("2M",), ("100M",), ("1234567",), ("",), ("5B",)], "t string")
    assert [r[0] for r in sizes.select(G.parse_bytes(F.col("t"))).collect()] == [1073741824, 2097152, 104857600, 1234567, 0, 5]
    for bad, parse in (("1T", G.parse_bytes), ("5 minutes", G.parse_duration)):
        with pytest.raises(Exception, match="not a"):
            spark.createDataFrame([(bad,)], "t string").select(parse(F.col("t"))).collect()
    times = spark.createDataFrame([("100ms",), ("10s",), ("1h2m3.5s",), ("-1.5us",), ("0",)], "t string")
    assert [r[0] for r in times.select(G.parse_duration(F.col("t"))).collect()] == [10**8, 10**10, 3723500000000, -1500, 0]
    shown = spark.createDataFrame([(999,), (1500000,), (2500000000,)], "n long").select(G.format_duration(F.col("n"))).collect()
    assert [r[0] for r in shown] == ["999ns", "1ms", "2.500s"]
    line = "ffffffffff600000-ffffffffff601000 --xp 00000000 00:00 0                  [vsyscall]"
    r = G.parse_maps(spark.createDataFrame([(line,)], "line string")).first()
    assert int(r.addr_start) == 0xFFFFFFFFFF600000 and r.perm_exec and not r.perm_read and r.pathname == "[vsyscall]"
    smaps = spark.createDataFrame([("a", "Rss:   12 kB"), ("a", "Rss: 3 kB"), ("a", "VmFlags: rd")], "pathname string, line string")
    assert [tuple(x) for x in G.parse_smaps(smaps).collect()] == [("a", "Rss", 15360)]
    assert [x.child for x in G.children(spark.createDataFrame([("12 13 ",)], "children string")).collect()] == [12, 13]


def test_offsets_of_every_byte_survive(spark, tmp_path):
    from blockloom.plans import registry

    numbers = [0, 1, -1, 1 << 40, -(1 << 63), *(k * 4096 for k in range(300)), *(k << 8 | 0xE2 for k in range(256))]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", P.int64_bytes(F.col("n")).alias("raw")).collect()
    assert {r.n: bytes(r.raw) for r in rows} == {n: n.to_bytes(8, "little", signed=True) for n in numbers}
    # 20 blocks: the offset of block 14 has the byte E0, which as UTF-8 would begin three bytes.
    spark.createDataFrame([(1, "x" * 4096 * 20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["packet_decode"](spark, str(tmp_path)).collect()
    assert sorted(r.offset for r in got) == [4096 * k for k in range(20)]

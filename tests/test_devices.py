import hashlib
import struct

from blockloom.__main__ import main
from blockloom.plans.devices import open_device
from blockloom.sources.config import read_config


def content(df):
    return b"".join(bytes(r.data) for r in df.orderBy("block_no").collect())


def test_layers_from_configuration(spark, tmp_path):
    base = bytes(range(256)) * 20
    (tmp_path / "base.img").write_bytes(base)
    (tmp_path / "o1").write_bytes(struct.pack("<Q", 2) + b"A" * 1024 + struct.pack("<Q", 2) + b"B" * 1024 + struct.pack("<Q", 0) + b"C" * 1024)
    (tmp_path / "o1.state").write_bytes(struct.pack("<I", 2))
    text = """device "d" { size = "5120" system = "sparsefile" blocksize = "1k" location = "o1"
      source "o1.state" { size = "5120" system = "file" blocksize = "1k" location = "base.img" } }"""
    device = read_config(text)[0]
    want = bytearray(base)
    want[2048:3072] = b"B" * 1024
    assert content(open_device(spark, device, str(tmp_path))) == want
    (tmp_path / "o1.state").unlink()
    want[:1024] = b"C" * 1024
    assert content(open_device(spark, device, str(tmp_path))) == want
    empty = read_config('device "m" { size = "5000" system = "memory" }')[0]
    assert content(open_device(spark, empty)) == bytes(5000)


def test_commands(spark, tmp_path, capsys):
    raw = b"x" * 1000 + bytes(2000) + b"tail"
    (tmp_path / "raw").write_bytes(raw)
    main(["checkdev", "-i", str(tmp_path / "raw"), "-o", str(tmp_path / "h"), "-b", "1000"])
    assert capsys.readouterr().out.strip() == "0 3"
    (hashes,) = (tmp_path / "h").glob("*.bin")
    assert hashes.read_bytes() == hashlib.sha256(raw[:1000]).digest() + bytes(64) + hashlib.sha256(b"tail").digest()
    main(["createbinlog", "-i", str(tmp_path / "raw"), "-o", str(tmp_path / "l"), "-b", "1000"])
    got = spark.read.format("device_log").load(str(tmp_path / "l")).orderBy("seq").collect()
    assert [(r.op, r.offset, bytes(r.data)) for r in got] == [("W", 0, raw[:1000]), ("W", 3000, b"tail")]

"""From a configured device to the DataFrame a reader of it sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.files import list_files
from blockloom.operators.modules import fill_zeroes
from blockloom.operators.overlay import nonzero_blocks, resolve
from blockloom.sources.config import Block, size_of
from blockloom.sources.formats import register

DEFAULT_BLOCK = 4096


def _exists(path: str) -> bool:
    try:
        return bool(list_files(path))
    except FileNotFoundError:
        return False


def open_device(spark: SparkSession, device: Block, folder: str = "") -> DataFrame:
    """``block_no, data`` of a device: its own blocks over its source's, missing ones as zeroes.

    Systems: ``memory`` (zeroes), ``file`` (raw) and ``sparsefile`` (the last record of a block counts). A source is read-only: blocks that
    its state file names, or all that the device's own store has, come from the device. With ``sourcehashes`` a source block
    whose hash is all zero is not read.
    """
    register(spark)
    get = lambda k, d="": str(device.attributes.get(k, d))
    size, block = size_of(get("size")), size_of(get("blocksize")) or DEFAULT_BLOCK
    place = lambda name: f"{folder}/{name}" if folder and not name.startswith("/") and "://" not in name else name
    system = get("system")
    numbers = spark.range(-(-size // block)).withColumnRenamed("id", "block_no")
    own = None
    if system in ("file", "sparsefile") and _exists(place(get("location"))):
        name = "device_raw" if system == "file" else "device_sparse"
        own = spark.read.format(name).option("block", block).load(place(get("location")))
        if system == "sparsefile":
            length = F.least(F.lit(block), F.lit(size) - F.col("block_no") * block)
            own = own.groupBy("block_no").agg(F.max_by("data", "pos").alias("data")).withColumn("data", F.substring("data", F.lit(1), length.cast("int")))
        own = own.select("block_no", "data")
    elif system not in ("memory", "file", "sparsefile"):
        raise ValueError(f"system {system} is not supported")
    source = device.child("source")
    if source is None:
        nothing = numbers.where("false").withColumn("data", F.lit(b""))
        return fill_zeroes(own if own is not None else nothing, numbers, size, block)
    base = open_device(spark, source, folder)
    if own is None:
        return base
    if source.label and _exists(place(source.label)):
        state = spark.read.format("block_state").load(place(source.label)).select("block_no").distinct()
        own = own.join(state, "block_no", "left_semi")
    known = None
    if get("sourcehashes") and _exists(place(get("sourcehashes"))):
        known = nonzero_blocks(spark.read.format("block_hashes").load(place(get("sourcehashes"))))
    return resolve(base, own, known).select("block_no", "data")

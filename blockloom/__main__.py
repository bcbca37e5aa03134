"""Commands: ``checkdev`` (hash file and map of a device) and ``createbinlog`` (a device as a log that rebuilds it)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from blockloom.operators.blocks import is_zero
from blockloom.operators.hashing import zero_marked_hashes
from blockloom.operators.modules import device_log
from blockloom.operators.sets import short_text
from blockloom.sources.config import size_of
from blockloom.sources.formats import register


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="blockloom", description=__doc__)
    parser.add_argument("command", choices=("checkdev", "createbinlog"))
    parser.add_argument("-i", "--input", required=True, help="raw device")
    parser.add_argument("-o", "--output", required=True, help="folder to write")
    parser.add_argument("-b", "--block", default="64k")
    got = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    register(spark)
    block = size_of(got.block)
    blocks = spark.read.format("device_raw").option("block", block).load(got.input).withColumn("device", F.lit(0))
    if got.command == "checkdev":
        # The file's records are numbered by their place: one sorted writer.
        hashes = zero_marked_hashes(blocks, block).withColumn("path", F.lit("")).coalesce(1).sortWithinPartitions("block_no").select("path", "block_no", "hash")
        hashes.write.format("block_hashes").mode("append").save(got.output)
        for row in short_text(blocks.where(~is_zero(F.col("data"))).select("block_no")).collect():
            print(row.text)
    else:
        log = device_log(blocks, block).coalesce(1).sortWithinPartitions("seq")
        log.selectExpr("'' as path", "seq", "0L as dt_ns", "op", "offset", "cast(length as bigint) as length", "data").write.format("device_log").mode("append").save(got.output)


if __name__ == "__main__":
    main()

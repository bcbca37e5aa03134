"""Queries over codecs, packets, formats and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.functions import codecs as K
from blockloom.functions import packets as P
from blockloom.functions import parsing as G
from blockloom.plans import bind
from blockloom.plans.bind import BLOCK, twin
from blockloom.plans.registry import query
from blockloom.scratch import fresh_path
from blockloom.sources.formats import register

_SAME = twin("select device, block_no, sha256(data) as hash from v_blocks", "v_blocks")


def _round_trip(spark, d, codec):
    packed = bind.blocks(spark, d).withColumn("packet", K.encoder(codec)(F.col("block_no") * BLOCK, F.col("data")))
    return packed.select("device", "block_no", F.sha2(K.decoded()("packet"), 256).alias("hash"))


@query(_SAME)
def codec_rle(spark, d):
    return _round_trip(spark, d, "rle")


@query(_SAME)
def codec_zeroes(spark, d):
    return _round_trip(spark, d, "zeroes")


@query(_SAME)
def codec_gzip(spark, d):
    return _round_trip(spark, d, "gzip")


@query(twin(f"""select device as dev, 'WriteAt' as kind, block_no * {BLOCK} as "offset", sha256(data) as hash from v_blocks""", "v_blocks"))
def packet_decode(spark, d):
    rows = bind.blocks(spark, d).withColumn("at", P.int64_bytes(F.col("block_no") * BLOCK))
    packets = rows.select(F.col("device").alias("dev"), F.concat(F.unhex(F.lit("0200")), "at", "data").alias("payload"))
    return P.decode_packets(packets).select("dev", "kind", "offset", F.sha2("data", 256).alias("hash"))


@query(twin("""select device as dev, 'WriteAt' as kind, count(*) as n_packets, cast(sum(octet_length(data) + 22) as bigint) as n_bytes from v_blocks group by device""", "v_blocks"))
def protocol_counters(spark, d):
    packets = bind.blocks(spark, d).select(F.col("device").alias("dev"), F.concat(F.unhex(F.lit("02000000000000000000")), "data").alias("payload"))
    return P.protocol_counters(P.decode_packets(packets))


@query(twin("""select b.block_no, o.data is null or b.data <> o.data as changed from v_base b left join v_overlay o on o.block_no = b.block_no""", "v_base", "v_overlay"))
def redundant_runs(spark, d):
    old = bind.overlay(spark, d).select("block_no", F.col("data").alias("old"))
    rows = bind.base(spark, d).join(old, "block_no", "left").withColumn("runs", K.redundant_filter(2)("old", "data"))
    return rows.select("block_no", (F.size("runs") > 0).alias("changed"))


@query(_SAME)
def sparse_roundtrip(spark, d):
    register(spark)
    path = fresh_path(spark, "sparse")
    numbered = bind.blocks(spark, d).select((F.col("device") * 65536 + F.col("block_no")).alias("block_no"), F.lit(0).cast("long").alias("pos"), "data", F.lit("").alias("path"))
    numbered.select("path", "block_no", "pos", "data").write.format("device_sparse").option("block", BLOCK).mode("append").save(path)
    got = spark.read.format("device_sparse").option("block", BLOCK).load(path).groupBy("block_no").agg(F.max_by("data", "pos").alias("data"))
    sizes = bind.blocks(spark, d).select((F.col("device") * 65536 + F.col("block_no")).alias("block_no"), F.octet_length("data").alias("n"))
    rows = got.join(sizes, "block_no").withColumn("data", F.expr("substring(data, 1, n)"))
    return rows.select(F.expr("block_no div 65536").alias("device"), (F.col("block_no") % 65536).alias("block_no"), F.sha2("data", 256).alias("hash"))


@query(twin("""select op, count(*) as n, cast(sum("offset") as bigint) as offsets, cast(sum(length) as bigint) as lengths from v_oplog where op in ('R', 'W') group by op""", "v_oplog"))
def binlog_roundtrip(spark, d):
    register(spark)
    path = fresh_path(spark, "log")
    ops = bind.oplog(spark, d).where("op in ('R', 'W')").selectExpr("'' as path", "seq", "seq * 1000 as dt_ns", "op", "offset", "cast(length as bigint) as length", "case when op = 'W' then cast(repeat('x', cast(length as int)) as binary) end as data")
    ops.write.format("device_log").mode("append").save(path)
    return spark.read.format("device_log").load(path).groupBy("op").agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"), F.sum("length").alias("lengths"))


@query("select p_partkey, case p_size % 4 when 0 then p_size else p_size * (1024 ** (p_size % 4))::bigint end as bytes from (select p_partkey, p_size::bigint as p_size from part)")
def parse_bytes(spark, d):
    parts = bind.table(spark, d, "part").selectExpr("p_partkey", "concat(p_size, element_at(array('', 'k', 'M', 'g'), cast(p_size % 4 as int) + 1)) as t")
    return parts.select("p_partkey", G.parse_bytes(F.col("t")).alias("bytes"))


@query("select p_partkey, p_size::bigint * 60000000000 + 1500000000 + p_size::bigint * 1000000 as nanos from part")
def parse_durations(spark, d):
    parts = bind.table(spark, d, "part").selectExpr("p_partkey", "concat(p_size, 'm1.5s', p_size, 'ms') as t")
    return parts.select("p_partkey", G.parse_duration(F.col("t")).alias("nanos"))


@query("select s_suppkey, (s_suppkey * 4096)::decimal(20,0) as addr_start, ((s_suppkey + 2) * 4096)::decimal(20,0) as addr_end, s_nationkey % 2 = 0 as perm_write, 'dev' || s_nationkey as pathname from supplier")
def parse_maps(spark, d):
    lines = bind.table(spark, d, "supplier").selectExpr("s_suppkey", "concat(lower(hex(s_suppkey * 4096)), '-', lower(hex((s_suppkey + 2) * 4096)), ' r', if(s_nationkey % 2 = 0, 'w', '-'), '-p 00001000 08:01 77      dev', s_nationkey) as line")
    return G.parse_maps(lines).select("s_suppkey", "addr_start", "addr_end", "perm_write", "pathname")

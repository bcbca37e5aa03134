"""Queries over blocks, sets, overlays and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.operators import blocks as B
from blockloom.operators import hashing as H
from blockloom.operators import overlay as O
from blockloom.operators import sets as S
from blockloom.plans import bind
from blockloom.plans.bind import BLOCK, BLOCKS, SIZE, twin
from blockloom.plans.registry import query


@query(twin(f"""select device, seq, op, block_no, greatest("offset", block_no * {BLOCK}) - block_no * {BLOCK} as rel_offset,
  least("offset" + length, {SIZE}, (block_no + 1) * {BLOCK}) - greatest("offset", block_no * {BLOCK}) as part_len,
  "offset" <= block_no * {BLOCK} and least("offset" + length, {SIZE}) >= (block_no + 1) * {BLOCK} as complete from v_touch""", "v_touch"))
def touches(spark, d):
    return B.touches(bind.oplog(spark, d), SIZE, BLOCK).select("device", "seq", "op", "block_no", "rel_offset", "part_len", "complete")


@query(twin(f"""select device, seq, unnest(range("offset" // {BLOCK}, ("offset" + length - 1) // {BLOCK} + 1)) as block_no, "offset" % {BLOCK} = 0 and ("offset" + length) % {BLOCK} = 0 as complete
  from v_oplog where length > 0""", "v_oplog"))
def map_over_blocks(spark, d):
    return B.map_over_blocks(bind.oplog(spark, d), BLOCK).select("device", "seq", "block_no", "complete")


@query(twin(f"""select device, seq, block_no, greatest("offset", block_no * 512) - "offset" as part_from, least("offset" + length, {SIZE}, (block_no + 1) * 512) - greatest("offset", block_no * 512) as part_len
  from (select *, unnest(range("offset" // 512, (least("offset" + length, {SIZE}) - 1) // 512 + 1)) as block_no from v_oplog where op = 'W' and "offset" < {SIZE})""", "v_oplog"))
def split_ops(spark, d):
    return B.touches(bind.oplog(spark, d).where("op = 'W'"), SIZE, 512).select("device", "seq", "block_no", "part_from", "part_len")


@query(twin("select block_no, ltrim(hex(data), '0') = '' as zero from v_base", "v_base"))
def zero_blocks(spark, d):
    return bind.base(spark, d).select("block_no", B.is_zero(F.col("data")).alias("zero"))


@query(twin(f"""select device, block_no, max(seq) as seq from v_touch where op = 'W' and "offset" <= block_no * {BLOCK} and least("offset" + length, {SIZE}) >= (block_no + 1) * {BLOCK} group by all""", "v_touch"))
def write_fold_last(spark, d):
    return B.last_writes(B.touches(bind.oplog(spark, d), SIZE, BLOCK))


@query(twin(f"""select device, block_no, seq, count(*) as bytes from (select device, block_no, byte, max(seq) as seq from (select device, block_no, seq,
  unnest(range(greatest("offset", block_no * {BLOCK}), least("offset" + length, {SIZE}, (block_no + 1) * {BLOCK}))) as byte from v_touch where op = 'W') group by all) group by all""", "v_touch"))
def write_fold_bytes(spark, d):
    return B.write_fold_bytes(B.touches(bind.oplog(spark, d), SIZE, BLOCK))


@query(twin(f"""select device, block_no, count(*) as bytes from (select distinct device, block_no, unnest(range(greatest("offset", block_no * {BLOCK}), least("offset" + length, {SIZE}, (block_no + 1) * {BLOCK}))) as byte
  from v_touch where op = 'W') group by all""", "v_touch"))
def write_extent(spark, d):
    return B.write_extent(B.touches(bind.oplog(spark, d), SIZE, BLOCK)).select("device", "block_no", F.col("bytes").cast("long").alias("bytes"))


@query(twin("select shard, count(*) as n_blocks, min(block_no) as low, max(block_no) as high from (select distinct block_no, block_no // 16 as shard from v_touch) group by all", "v_touch"))
def shard_ranges(spark, d):
    rows = B.shard(B.touches(bind.oplog(spark, d), SIZE, BLOCK).select("block_no").distinct(), 16)
    return rows.groupBy("shard").agg(F.count("*").alias("n_blocks"), F.min("block_no").alias("low"), F.max("block_no").alias("high"))


@query(twin("""select block_no, case when a is null then 'only b' when b is null then 'only a' else 'corrupt' end as state
  from (select coalesce(x.block_no, y.block_no) as block_no, x.data as a, y.data as b from v_base x full join v_overlay y on x.block_no = y.block_no) where a is distinct from b""", "v_base", "v_overlay"))
def mirror_check(spark, d):
    return B.mirrors(bind.base(spark, d), bind.overlay(spark, d))


@query(twin("select device, block_no, sha256(data) as hash, octet_length(data) as length from v_blocks", "v_blocks"))
def block_hash(spark, d):
    return H.block_hashes(bind.blocks(spark, d)).select("device", "block_no", "hash", F.col("length").cast("long").alias("length"))


@query("select doc_id as device, sha256(text) as hash from documents where length(text) > 0")
def device_hash(spark, d):
    return H.device_hashes(bind.blocks(spark, d))


@query(twin("select hash, count(*) as n_locations, min(device) as first_device, arg_min(block_no, struct_pack(d := device, b := block_no)) as first_block from (select *, sha256(data) as hash from v_blocks) group by hash", "v_blocks"))
def hash_index(spark, d):
    return H.hash_index(H.block_hashes(bind.blocks(spark, d)))


@query(twin("select count(distinct sha256(data)) as n_hashes, count(*) as n_locations from v_blocks", "v_blocks"))
def hash_index_metrics(spark, d):
    return H.index_metrics(H.block_hashes(bind.blocks(spark, d)))


@query(twin("""select r.hash, f.device, f.block_no, octet_length(f.data) as length from (select distinct sha256(data) as hash from v_blocks union select repeat('0', 64)) r
  left join (select *, sha256(data) as hash, row_number() over (partition by sha256(data) order by device, block_no) as k from v_blocks) f on f.hash = r.hash and f.k = 1""", "v_blocks"))
def read_by_hash(spark, d):
    blocks = bind.blocks(spark, d)
    hashes = H.block_hashes(blocks)
    asked = hashes.select("hash").union(spark.createDataFrame([("0" * 64,)], "hash string")).distinct()
    return H.read_by_hash(asked, hashes, blocks).select("hash", "device", "block_no", F.octet_length("data").cast("long").alias("length"))


_EXPECTED = "(select device, block_no, case when device % 5 = 1 and block_no = 0 then 'stale' else sha256(data) end as hash from v_blocks where not (device % 7 = 2 and block_no = 1))"


@query(twin(f"""select b.device, count(*) filter (e.hash is null) as n_missing, bool_and(coalesce(sha256(b.data) = e.hash, true)) as ok
  from v_blocks b left join {_EXPECTED} e on b.device = e.device and b.block_no = e.block_no group by b.device""", "v_blocks"))
def integrity_check(spark, d):
    blocks = bind.blocks(spark, d)
    expected = H.block_hashes(blocks).where("not (device % 7 = 2 and block_no = 1)").withColumn("hash", F.when(F.expr("device % 5 = 1 and block_no = 0"), "stale").otherwise(F.col("hash")))
    return H.check(blocks, expected)


_MERGED = "(select b.block_no, coalesce(o.data, b.data) as data from v_base b left join v_overlay o on o.block_no = b.block_no)"
_BYTES = "list_sum(list_transform(range(0, 16), lambda i: cast(substr(hex(b.data), 2 * i + 1, 2) <> substr(hex(m.data), 2 * i + 1, 2) as int)))"


@query(twin(f"select bool_and(b.data = m.data) as equal from v_base b join {_MERGED} m on m.block_no = b.block_no", "v_base", "v_overlay"))
def equals(spark, d):
    base = bind.base(spark, d)
    return O.equals(base, O.resolve(base, bind.overlay(spark, d)).select("block_no", "data"))


@query(twin(f"select count(*) as n_blocks, cast(coalesce(sum({_BYTES}), 0) as bigint) as n_bytes from v_base b join {_MERGED} m on m.block_no = b.block_no where b.data <> m.data", "v_base", "v_overlay"))
def difference(spark, d):
    base = bind.base(spark, d)
    return O.count_differences(base, O.resolve(base, bind.overlay(spark, d)))


@query(twin(f"select b.block_no, cast({_BYTES} as bigint) as n_bytes from v_base b join v_overlay m on m.block_no = b.block_no where b.data <> m.data", "v_base", "v_overlay"))
def cow_difference(spark, d):
    return O.block_differences(bind.overlay(spark, d), bind.base(spark, d)).select("block_no", F.col("n_bytes").cast("long").alias("n_bytes"))


_NONZERO = "(select block_no from v_base where ltrim(hex(data), '0') <> '')"


@query(twin(f"""select b.block_no, lower(hex(case when o.data is not null then o.data when n.block_no is not null then b.data else unhex(repeat('00', 16)) end)) as data,
  case when o.data is not null then 'overlay' when n.block_no is not null then 'base' else 'zero' end as origin
  from v_base b left join v_overlay o on o.block_no = b.block_no left join {_NONZERO} n on n.block_no = b.block_no""", "v_base", "v_overlay"))
def cow_resolve(spark, d):
    base = bind.base(spark, d)
    hashes = H.zero_marked_hashes(base.withColumn("device", F.lit(0)), 16)
    return O.resolve(base, bind.overlay(spark, d), O.nonzero_blocks(hashes)).select("block_no", F.lower(F.hex("data")).alias("data"), "origin")


@query(twin("""select block_no, max(depth) as depth, lower(hex(arg_max(data, depth))) as data from (select * from v_layers union all select 0, block_no, data from v_base) group by block_no""", "v_layers", "v_base"))
def cow_multilayer(spark, d):
    return O.resolve_layers(bind.layers(spark, d), bind.base(spark, d)).select("block_no", "depth", F.lower(F.hex("data")).alias("data"))


@query(twin("select block_no from v_base where block_no not in (select block_no from v_overlay) and block_no not in (select block_no from v_layers where depth = 3)", "v_base", "v_overlay", "v_layers"))
def cow_unrequired(spark, d):
    return O.unrequired(bind.base(spark, d), bind.overlay(spark, d), bind.layers(spark, d).where("depth = 3"))


@query(twin(f"select 16 * (select count(*) from v_base) as size, 16 * (select count(*) from v_overlay) as overlay_size, 16 * (select count(*) from {_NONZERO}) as nonzero_size", "v_base", "v_overlay"))
def cow_metrics(spark, d):
    base = bind.base(spark, d)
    return O.overlay_metrics(base, bind.overlay(spark, d), base.where(~B.is_zero(F.col("data"))), 16)


@query(twin("""select b.block_no, lower(hex(coalesce(o.data, b.data))[1:8] || hex('wx'::blob) || hex(coalesce(o.data, b.data))[13:32]) as data from v_base b left join v_overlay o on o.block_no = b.block_no where b.block_no % 3 = 0
  union all select block_no, lower(hex(data)) from v_overlay where block_no % 3 <> 0""", "v_base", "v_overlay"))
def cow_write(spark, d):
    base = bind.base(spark, d)
    hits = base.where("block_no % 3 = 0")
    parts = [hits.select("block_no", F.lit(k).alias("seq"), F.lit(4 + (k > 1)).alias("rel_offset"), F.lit(x).cast("binary").alias("part")) for k, x in ((1, "wy"), (2, "x"))]
    return O.write_through(base, bind.overlay(spark, d), parts[0].union(parts[1])).select("block_no", F.lower(F.hex("data")).alias("data"))


@query(twin("""select b.block_no, lower(hex(coalesce(o.data, b.data))[1:8] || hex('wx'::blob) || hex(coalesce(o.data, b.data))[13:32]) as data from v_base b left join v_overlay o on o.block_no = b.block_no""", "v_base", "v_overlay"))
def cow_write_all(spark, d):
    """``cow_write`` to all blocks."""
    base = bind.base(spark, d)
    parts = [base.select("block_no", F.lit(k).alias("seq"), F.lit(4 + (k > 1)).alias("rel_offset"), F.lit(x).cast("binary").alias("part")) for k, x in ((1, "wy"), (2, "x"))]
    return O.write_through(base, bind.overlay(spark, d), parts[0].union(parts[1])).select("block_no", F.lower(F.hex("data")).alias("data"))


_WRITES = f"(select device, block_no * {BLOCK} as o, octet_length(data) as length, sha256(data) as hash, block_no from v_blocks)"


@query(twin(f"""select device, o as "offset", length, hash, case when length = {BLOCK} and device % 3 = 0 then 'HASH' else 'DATA' end as sent from {_WRITES}""", "v_blocks"))
def alt_source_match(spark, d):
    writes = H.block_hashes(bind.blocks(spark, d)).select("device", (F.col("block_no") * BLOCK).alias("offset"), F.col("length").cast("long").alias("length"), "hash")
    sources = writes.where(f"device % 3 = 0 and length = {BLOCK}").union(writes.where("device % 3 = 1").withColumn("hash", F.lit("other")))
    return H.match_sources(writes, sources).select("device", "offset", "length", "hash", "sent")


@query(twin(f"""select device, o as "offset", length, hash from {_WRITES}""", "v_blocks"))
def send_no_data(spark, d):
    rows = bind.blocks(spark, d).withColumn("offset", F.col("block_no") * BLOCK)
    return H.without_data(rows).withColumn("length", F.col("length").cast("long"))


@query(twin(f"""select device, block_no * {BLOCK} as "offset", least({BLOCK}, size - block_no * {BLOCK}) as length, hash, 'store ' || device as location
  from (select v.device, v.block_no, sha256(v.data) as hash, octet_length(encode(t.text)) as size from v_blocks v join documents t on t.doc_id = v.device) where (device + block_no) % 4 <> 0""", "v_blocks"))
def safe_blocks(spark, d):
    hashes = H.block_hashes(bind.blocks(spark, d))
    status = hashes.select("device", "block_no", F.lit(True).alias("is_set"), F.lit(2).alias("updating_id"), F.when(F.expr("(device + block_no) % 4 = 0"), 1).otherwise(2).alias("current_id"), F.col("hash").alias("current_hash"))
    sizes = bind.table(spark, d, "documents").select(F.col("doc_id").alias("device"), F.octet_length("text").alias("size"))
    safe = H.safe_blocks(status).join(sizes, "device")
    return H.alternate_sources(safe, F.col("size"), BLOCK, "store").withColumn("length", F.col("length").cast("long"))


@query(twin(f"select device || '/' || block_no as location, sha256(data) = case when device % 11 = 3 then 'bad' else sha256(data) end as verified, octet_length(data) as length from v_blocks", "v_blocks"))
def alt_source_pull(spark, d):
    blocks = bind.blocks(spark, d).withColumn("location", F.concat_ws("/", "device", "block_no"))
    sources = blocks.select("location", F.when(F.expr("device % 11 = 3"), "bad").otherwise(F.sha2("data", 256)).alias("hash"))
    return H.pull_sources(sources, blocks.select("location", "data")).select("location", "verified", F.octet_length("data").cast("long").alias("length"))


_W = "(select distinct block_no from v_touch where op = 'W')"
_R = "(select distinct block_no from v_touch where op = 'R')"


@query(twin(f"""select 'set_bits' as what, count(*) as n, cast(sum(block_no) as bigint) as total from (select block_no from {_W} union select unnest(range(100, 180)))
  union all select 'clear_bits', count(*), cast(sum(block_no) as bigint) from {_W} where not (block_no >= 100 and block_no < 180)
  union all select 'set_bits_if', count(*), cast(sum(block_no) as bigint) from (select block_no from {_W} union select block_no from {_R} where block_no >= 90 and block_no < 200)
  union all select 'clear_bits_if', count(*), cast(sum(block_no) as bigint) from (select block_no from {_W} except select block_no from {_R} where block_no >= 90 and block_no < 200)
  union all select 'zeroes', count(*), cast(sum(block_no) as bigint) from (select unnest(range(0, {BLOCKS + 40})) as block_no except select block_no from {_W})
  union all select 'difference', count(*), cast(sum(block_no) as bigint) from ((select block_no from {_W} except select block_no from {_R}) union (select block_no from {_R} except select block_no from {_W}))""", "v_touch"))
def bitfield_ops(spark, d):
    t = B.touches(bind.oplog(spark, d), SIZE, BLOCK)
    w, r = (t.where(F.col("op") == op).select("block_no").distinct() for op in "WR")
    sets = {"set_bits": S.set_bits(w, 100, 180), "clear_bits": S.clear_bits(w, 100, 180), "set_bits_if": S.set_bits_if(w, r, 90, 200), "clear_bits_if": S.clear_bits_if(w, r, 90, 200), "zeroes": S.zeroes(w, BLOCKS + 40), "difference": S.difference(w, r)}
    out = None
    for name, rows in sets.items():
        one = rows.agg(F.count("*").alias("n"), F.sum("block_no").alias("total")).select(F.lit(name).alias("what"), "n", "total")
        out = one if out is None else out.union(one)
    return out


@query(twin("""select device, count(distinct block_no) as n from v_touch where op = 'W' group by device""", "v_touch"))
def bitfield_packed(spark, d):
    t = B.touches(bind.oplog(spark, d).where("op = 'W'"), SIZE, BLOCK)
    return S.pack(t, "device").groupBy("device").agg(F.sum(F.bitmap_count("bits")).alias("n"))


@query(twin(f"""select coalesce(min(block_no), 0) as first, coalesce(max(block_no) + 1, 0) as stop from (select unnest(range(0, {BLOCKS})) as block_no except select block_no from v_touch where op = 'W' and device = 1 and block_no % 2 = 0)""", "v_touch"))
def zero_extents(spark, d):
    t = B.touches(bind.oplog(spark, d), SIZE, BLOCK)
    return S.zero_extent(t.where("op = 'W' and device = 1 and block_no % 2 = 0").select("block_no").distinct(), 0, BLOCKS)


@query(twin("""select device, string_agg(case when low = high then low::varchar else low || '-' || high end, ' ' order by low) as text from (select device, min(block_no) as low, max(block_no) as high from
  (select device, block_no, block_no - row_number() over (partition by device order by block_no) as g from (select distinct device, block_no from v_touch where op = 'W' and seq % 7 = 0)) group by device, g) group by device""", "v_touch"))
def short_text(spark, d):
    t = B.touches(bind.oplog(spark, d).where("op = 'W' and seq % 7 = 0"), SIZE, BLOCK)
    return S.short_text(t.select("device", "block_no").distinct(), "device")


@query(twin("""select device, string_agg(case when low = high then low::varchar else low || '-' || high end, ' ' order by low) as text from (select device, min(block_no) as low, max(block_no) as high from
  (select device, block_no, block_no - row_number() over (partition by device order by block_no) as g from (select distinct device, block_no from v_touch where op = 'W')) group by device, g) group by device""", "v_touch"))
def short_text_all(spark, d):
    """``short_text`` of all writes."""
    t = B.touches(bind.oplog(spark, d).where("op = 'W'"), SIZE, BLOCK)
    return S.short_text(t.select("device", "block_no").distinct(), "device")


@query(twin(f"""select d.device, coalesce(min(c.block_no), 0) as first, coalesce(max(c.block_no) + 1, 0) as stop from (select distinct device from v_oplog) d
  left join (select device, unnest(range(0, {BLOCKS})) as block_no from (select distinct device from v_oplog) except select device, block_no from v_touch where op = 'W') c on c.device = d.device group by d.device""", "v_touch"))
def zero_extents_all(spark, d):
    """``zero_extents`` of all devices' whole write sets."""
    ops = bind.oplog(spark, d)
    return S.zero_extents(B.touches(ops.where("op = 'W'"), SIZE, BLOCK), ops, 0, BLOCKS, "device")

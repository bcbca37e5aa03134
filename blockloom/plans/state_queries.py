"""Queries over writers, dirty state, volatility, ranges, synchronisation and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.operators import blocks as B
from blockloom.operators import combine as C
from blockloom.operators import hashing as H
from blockloom.operators import metrics as M
from blockloom.operators import modules as D
from blockloom.operators import overlay as O
from blockloom.operators import ranges as R
from blockloom.operators import sets as S
from blockloom.operators import sync as Y
from blockloom.operators import track as T
from blockloom.operators import volatility as V
from blockloom.plans import bind
from blockloom.plans.bind import BLOCK, BLOCKS, SIZE, twin
from blockloom.plans.registry import query

DAY = 86400
EXPIRY = 30 * DAY


def _touched(spark, d):
    return B.touches(bind.oplog(spark, d), SIZE, BLOCK)


def _as_of(spark, d):
    """Microseconds of the last event: one row from the file's statistics."""
    return F.lit(bind.table(spark, d, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0])


_PRIO = "select *, coalesce(max(priority) over (partition by block_no order by seq rows between unbounded preceding and 1 preceding), -1) as existing from v_prio"


@query(twin(f"select block_no, seq, priority, existing, priority >= existing as allowed, priority = existing as duplicate from ({_PRIO})", "v_prio"))
def combinator_flags(spark, d):
    return C.combine_flags(bind.prio_writes(spark, d))


@query(twin(f"select priority, count(*) filter (priority >= existing) as n_allowed, count(*) filter (priority < existing) as n_blocked, count(*) filter (priority = existing) as n_duplicate from ({_PRIO}) group by priority", "v_prio"))
def combinator_metrics(spark, d):
    return C.combine_metrics(C.combine_flags(bind.prio_writes(spark, d)))


@query(twin("select block_no, arg_max(priority, priority * 1000 + seq) as priority, arg_max(seq, priority * 1000 + seq) as seq from v_prio group by block_no", "v_prio"))
def combinator_final(spark, d):
    return C.combine_final(bind.prio_writes(spark, d))


_BUFFERED = f"""(select device, block_no, cast(sum(least("offset" + length, {SIZE}, (block_no + 1) * {BLOCK}) - greatest("offset", block_no * {BLOCK})) as bigint) as bytes from v_touch where op = 'W' group by all)"""


@query(twin(f"""select device, block_no, bytes, "left" from (select *, cast(sum(bytes) over (partition by device) - sum(bytes) over (partition by device order by bytes desc, block_no rows between unbounded preceding and current row) as bigint) as "left",
  row_number() over (partition by device order by bytes desc, block_no) as k from {_BUFFERED}) where "left" + bytes >= 20000 or k = 1""", "v_touch"))
def write_cache_flush_order(spark, d):
    buffered = _touched(spark, d).where("op = 'W'").groupBy("device", "block_no").agg(F.sum("part_len").alias("bytes"))
    return C.flush_order(buffered, 20000)


@query(twin(f"""with w as (select device, block_no, seq, greatest("offset", block_no * {BLOCK}) as a, least("offset" + length, {SIZE}, (block_no + 1) * {BLOCK}) as b from v_touch where op = 'W')
select device, block_no, seq from w x where exists (select 1 from w y where y.device = x.device and y.block_no = x.block_no and y.seq > x.seq and y.a <= x.a and y.b >= x.b)""", "v_touch").replace("\nwith w as", ", w as", 1))
def write_cache_discarded(spark, d):
    return C.discarded_writes(_touched(spark, d))


_LOG = """, v_log as (select device, block_no, seq, op, ts from v_touch where op <> 'SYNC' union all
  select o.device, b.block_no, o.seq, o.op, o.ts from v_oplog o join (select distinct device, block_no from v_touch where op <> 'SYNC') b on b.device = o.device where o.op = 'SYNC'),
v_state as (select device, block_no, list_reduce(list_prepend({'t': 0, 'n': 0, 'op': '', 'ts': null::timestamp}, list({'t': 0, 'n': 0, 'op': op, 'ts': ts} order by seq)),
  lambda a, x: {'t': case when x.op in ('R', 'TRACK') then greatest(a.t, 1) when x.op = 'W' and a.t > 0 then 2 when x.op = 'SYNC' and a.t = 2 then 0 else a.t end,
    'n': a.n + cast(x.op = 'SYNC' and a.t = 2 as int), 'op': '', 'ts': case when x.op = 'W' and a.t > 0 then x.ts else a.ts end}) as s from v_log group by device, block_no)
"""


def _state(spark, d):
    return T.dirty_fold(bind.oplog(spark, d), SIZE, BLOCK, 1024)


def _with_state(body: str) -> str:
    return twin("", "v_touch").rstrip() + _LOG + body


@query(_with_state("select device, block_no, s.t >= 1 as tracked, s.t = 2 as dirty, cast(s.n as bigint) as n_emitted from v_state"))
def dirty_sync_fold(spark, d):
    return _state(spark, d).select("device", "block_no", "tracked", "dirty", "n_emitted")


@query(_with_state("select device, count(*) filter (s.t >= 1) as n_tracked, count(*) filter (s.t = 2) as n_dirty, cast(coalesce(floor((epoch_us((select max(ts) from events)) - min(epoch_us(s.ts)) filter (s.t = 2)) / 1000000), 0) as bigint) as max_age from v_state group by device"))
def dirty_metrics(spark, d):
    return T.dirty_metrics(_state(spark, d), _as_of(spark, d))


@query(_with_state(f"""select device, grp, n_dirty, expired from (select device, block_no >> 2 as grp, count(*) as n_dirty, max(cast((epoch_us((select max(ts) from events)) - epoch_us(s.ts)) / 1000000 > {DAY} as int)) as expired
  from v_state where s.t = 2 group by all) where expired = 1 or n_dirty >= 2 order by expired desc, n_dirty desc, device, grp limit 20"""))
def dirty_topk(spark, d):
    return T.dirty_groups(_state(spark, d), _as_of(spark, d), DAY, 20, 2, 2)


@query(_with_state(f"""select device, grp, n_dirty, expired from (select device, block_no >> 2 as grp, count(*) as n_dirty, max(cast((epoch_us((select max(ts) from events)) - epoch_us(s.ts)) / 1000000 > {DAY} as int)) as expired
  from v_state where s.t = 2 group by all) where expired = 1 or n_dirty >= 2 order by expired desc, n_dirty desc, device, grp limit 20""").replace("where o.op = 'SYNC'", "where false", 1))
def dirty_topk_unsynced(spark, d):
    """``dirty_topk`` of a tracker that nothing has emptied: all reads, writes and tracking requests, no sync."""
    state = T.dirty_fold(bind.oplog(spark, d).where("op <> 'SYNC'"), SIZE, BLOCK, 1024)
    return T.dirty_groups(state, _as_of(spark, d), DAY, 20, 2, 2)


_COUNTS = f"""(select b.device, b.block_no, coalesce(n, 0) as n from (select device, unnest(range(0, {BLOCKS})) as block_no from (select distinct device from v_oplog)) b
  left join (select device, block_no, count(*) as n from v_touch where op = 'W' and ts >= (select max(ts) from events) - interval {EXPIRY} second group by all) c on c.device = b.device and c.block_no = b.block_no)"""


def _counts(spark, d):
    devices = bind.oplog(spark, d).select("device").distinct()
    blocks = devices.withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    return V.volatility(_touched(spark, d), blocks, _as_of(spark, d), EXPIRY)


@query(twin(f"select * from {_COUNTS}", "v_touch"))
def volatility(spark, d):
    return _counts(spark, d)


@query(twin(f"select device, count(*) as total from v_touch where op = 'W' and ts >= (select max(ts) from events) - interval {EXPIRY} second group by device", "v_touch"))
def volatility_total(spark, d):
    return V.total_volatility(_touched(spark, d), _as_of(spark, d), EXPIRY)


@query(twin(f"select device, block_no, seq, count(*) over (partition by device, block_no order by epoch_us(ts) range between {EXPIRY * 1000000} preceding and current row) as n from v_touch where op = 'W'", "v_touch"))
def volatility_running(spark, d):
    return V.running_volatility(_touched(spark, d), EXPIRY).select("device", "block_no", "seq", "n")


@query(twin("select device, block_no, row_number() over (partition by device order by block_no) as rank from (select distinct device, block_no from v_touch where op = 'W')", "v_touch"))
def order_any(spark, d):
    return V.order_any(_touched(spark, d).where("op = 'W'").select("device", "block_no").distinct()).withColumn("rank", F.col("rank").cast("long"))


@query(twin("""select b.device, b.block_no, case when asked is null then 'standard' else 'priority' end as kind, row_number() over (partition by b.device order by asked is null, asked, b.block_no) as rank
  from (select distinct device, block_no from v_touch where op = 'W') b left join (select device, block_no, min(seq) as asked from v_touch where op = 'TRACK' group by all) r on r.device = b.device and r.block_no = b.block_no""", "v_touch"))
def order_priority(spark, d):
    t = _touched(spark, d)
    return V.order_priority(t.where("op = 'W'").select("device", "block_no").distinct(), t.where("op = 'TRACK'")).withColumn("rank", F.col("rank").cast("long"))


@query(twin(f"select *, row_number() over (partition by device order by n, case when n = 0 then block_no else -block_no end) as rank from {_COUNTS}", "v_touch"))
def order_volatility(spark, d):
    return V.order_volatility(_counts(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(twin(f"select device, cast(block_no * 64 // {BLOCKS} as int) as part, cast(sum(n) as bigint) as n from {_COUNTS} group by all", "v_touch"))
def heatmap(spark, d):
    return V.heatmap(_counts(spark, d), BLOCKS)


@query(twin(f"""select part, p as n_p2p, a as n_alt, u as n_dup, cast(case when u > 0 then 2 * {BLOCKS // 64} + u when a > 0 then 4 * {BLOCKS // 64} + a else p end as bigint) as value from (select cast(block_no * 64 // {BLOCKS} as int) as part,
  count(*) filter (op = 'R') as p, count(*) filter (op = 'TRACK') as a, count(*) filter (op = 'W' and seq % 50 = 0) as u from v_touch where op in ('R', 'TRACK') or op = 'W' and seq % 50 = 0 group by all)""", "v_touch"))
def heatmap_p2p(spark, d):
    marks = _touched(spark, d).selectExpr("block_no", "case when op = 'R' then 'p2p' when op = 'TRACK' then 'alt' when op = 'W' and seq % 50 = 0 then 'dup' end as kind").where("kind is not null")
    return V.transfer_heatmap(marks, BLOCKS)


@query(twin(f"""select part, p as n_p2p, a as n_alt, u as n_dup, cast(case when u > 0 then 2 * {BLOCKS // 64} + u when a > 0 then 4 * {BLOCKS // 64} + a else p end as bigint) as value from (select cast(block_no * 64 // {BLOCKS} as int) as part,
  count(*) filter (op = 'R') as p, count(*) filter (op = 'TRACK') as a, count(*) filter (op = 'W') as u from v_touch where op in ('R', 'TRACK', 'W') group by all)""", "v_touch"))
def heatmap_p2p_all(spark, d):
    """``heatmap_p2p`` with every write as a duplicate."""
    marks = _touched(spark, d).selectExpr("block_no", "case op when 'R' then 'p2p' when 'TRACK' then 'alt' when 'W' then 'dup' end as kind").where("kind is not null")
    return V.transfer_heatmap(marks, BLOCKS)


_RUNS = "(select *, page - row_number() over (order by page) as g from v_pages where dirty and (present or swapped))"


@query(twin(f"select min(page_addr) as start, max(page_addr) + {BLOCK} as stop, count(*) filter (swapped) * {BLOCK} as swapped_bytes from {_RUNS} group by g", "v_pages"))
def page_runs(spark, d):
    return R.page_runs(R.flags(bind.page_flags(spark, d)))


@query(twin(f"select min(page_addr) as start, max(page_addr) + {BLOCK} as stop, count(*) filter (swapped) * {BLOCK} as swapped_bytes from (select *, (row_number() over (partition by g order by page) - 1) // 3 as c from {_RUNS}) group by g, c", "v_pages"))
def page_runs_chunked(spark, d):
    return R.page_runs(R.flags(bind.page_flags(spark, d)), BLOCK, 3 * BLOCK)


@query(twin("select addr_start + 5000 * k as start, least(addr_start + 5000 * (k + 1), addr_end) as stop from (select *, unnest(range(0, (addr_end - addr_start + 4999) // 5000)) as k from v_maps)", "v_maps"))
def copy_chunks(spark, d):
    return R.chunks(bind.maps(spark, d).selectExpr("addr_start as start", "addr_end as stop"), 5000)


@query(twin(f"""select min(id) as start, count(*) * {BLOCK} as length from (select id, g, (row_number() over (partition by g order by id) - 1) // 6 as c from
  (select id, id // {BLOCK} - row_number() over (partition by id % {BLOCK} order by id) as g from v_addr)) group by g, c""", "v_addr"))
def regions(spark, d):
    return R.regions(bind.addresses(spark, d), BLOCK, 6 * BLOCK - 100)


_MAPPED = f"(select id, row_number() over (order by id) * 2 - 1 as slot from v_addr where id % {3 * BLOCK} = 0)"


def _mapped(spark, d):
    ids = bind.addresses(spark, d).where(f"id % {3 * BLOCK} = 0")
    return ids.selectExpr("id", "cast(row_number() over (order by id) * 2 - 1 as bigint) as slot")


@query(twin(f"""select id, slot from {_MAPPED} union all select n.id, f.slot from (select id, row_number() over (order by id) as k from v_addr where id % {3 * BLOCK} <> 0) n
  left join (select s as slot, row_number() over (order by s) as k from (select unnest(range(0, 1200)) as s) where s not in (select slot from {_MAPPED})) f on f.k = n.k""", "v_addr"))
def id_map_alloc(spark, d):
    return R.allocate(_mapped(spark, d), bind.addresses(spark, d), 1200)


@query(twin(f"""select id, slot from {_MAPPED} union all select n.id, f.slot from (select id, row_number() over (order by id) as k from v_addr where id % {3 * BLOCK} <> 0) n
  left join (select s as slot, row_number() over (order by s) as k from (select unnest(range(0, (select 2 * count(*) from v_addr))) as s) where s not in (select slot from {_MAPPED})) f on f.k = n.k""", "v_addr"))
def id_map_alloc_all(spark, d):
    """``id_map_alloc`` with as many slots as the table needs."""
    mapped, ids = _mapped(spark, d), bind.addresses(spark, d)
    return R.allocate(mapped, ids, R.slots_for(mapped, ids))


@query(twin(f"select id, slot, row_number() over (order by id) - 1 as new_slot from {_MAPPED}", "v_addr"))
def defrag(spark, d):
    return R.defragment(_mapped(spark, d))


@query(twin(f"select count(*) * {BLOCK} as size, (max(slot) + 1) * {BLOCK} as used_size from {_MAPPED}", "v_addr"))
def id_map_stats(spark, d):
    return R.map_stats(_mapped(spark, d), BLOCK)


_SUB = """(select b.* from v_maps b where snapshot = 'b' and not exists (select 1 from v_maps a where a.snapshot = 'a' and a.addr_start = b.addr_start and a.addr_end = b.addr_end and a.pathname = b.pathname
  and (select count(*) from v_maps c where c.snapshot = 'a' and c.addr_start = b.addr_start and c.addr_end = b.addr_end) = 1))"""


def _snapshots(spark, d):
    m = bind.maps(spark, d)
    return (m.where(F.col("snapshot") == s).drop("snapshot") for s in "ab")


@query(twin(f"select addr_start, addr_end, pathname from {_SUB}", "v_maps"))
def maps_sub(spark, d):
    a, b = _snapshots(spark, d)
    return R.subtract_maps(b, a)


@query(twin(f"""select page from (select unnest(range(addr_start, addr_end, {BLOCK})) as page from {_SUB}) p
  where not exists (select 1 from v_maps a where a.snapshot = 'a' and p.page >= a.addr_start and p.page + {BLOCK} <= a.addr_end)""", "v_maps"))
def maps_added_pages(spark, d):
    a, b = _snapshots(spark, d)
    return R.added_pages(b, a)


@query(twin("select snapshot, cast(sum(addr_end - addr_start) as bigint) as size from v_maps group by snapshot", "v_maps"))
def maps_size(spark, d):
    return bind.maps(spark, d).groupBy("snapshot").agg(F.sum(F.col("addr_end") - F.col("addr_start")).alias("size"))


@query(twin("""select page, start_pg, case when start_pg is null then 'base' else 'overlay' end as source from (select page from v_pages) left join (select s_suppkey * 40 as start_pg, s_suppkey * 40 + s_nationkey as end_pg from supplier) on page between start_pg and end_pg""", "v_pages"))
def segment_resolve(spark, d):
    pages = bind.page_flags(spark, d).selectExpr(f"page_addr div {BLOCK} as page")
    return R.resolve_segments(pages, bind.table(spark, d, "supplier").selectExpr("s_suppkey * 40 as start_pg", "s_suppkey * 40 + s_nationkey as end_pg"))


@query(twin("""select page_addr, addr_start, pathname from v_pages join v_maps on snapshot = 'a' and page_addr >= addr_start and page_addr < addr_end""", "v_pages", "v_maps"))
def memory_range_lookup(spark, d):
    a, _ = _snapshots(spark, d)
    return R.range_lookup(bind.page_flags(spark, d).select("page_addr"), a, "page_addr", "addr_start", "addr_end").select("page_addr", "addr_start", "pathname")


@query(twin("""select count(*) filter (present) as n_present, count(*) filter (swapped) as n_swapped, count(*) filter (dirty) as n_soft_dirty from v_pages""", "v_pages"))
def page_flag_counts(spark, d):
    return R.flags(bind.page_flags(spark, d)).agg(F.count_if("present").alias("n_present"), F.count_if("swapped").alias("n_swapped"), F.count_if("soft_dirty").alias("n_soft_dirty"))


_OK = "seq % 17 <> 0"
_TIMED = f"(select *, {_OK} as ok, (seq * 31) % 1000 as micros from v_oplog)"


def _timed(spark, d):
    return bind.oplog(spark, d).selectExpr("*", f"{_OK} as ok", "(seq * 31) % 1000 as micros")


@query(twin(f"select device, op, count(*) as n_ops, cast(sum(length) as bigint) as n_bytes, count(*) filter (not ok) as n_errors, cast(sum(case when ok or op = 'SYNC' then micros else 0 end) as bigint) as micros from {_TIMED} group by all", "v_oplog"))
def op_metrics(spark, d):
    return M.op_metrics(_timed(spark, d))


@query(twin(f"""select device, op, case when n - e > 0 then m // (n - e) else 0 end as mean_micros from (select device, op, count(*) as n, count(*) filter (not ok) as e, cast(sum(case when ok or op = 'SYNC' then micros else 0 end) as bigint) as m from {_TIMED} group by all)""", "v_oplog"))
def op_latency(spark, d):
    return M.average_latency(M.op_metrics(_timed(spark, d))).select("device", "op", "mean_micros")


@query(twin("""select f.device, f.op, cast(f.le as int) as le, count(o.seq) as n from (select distinct device, op, unnest([4096 << k for k in range(0, 9)]) as le from v_oplog) f
  left join (select *, length * 7 as l from v_oplog) o on o.device = f.device and o.op = f.op and o.l <= f.le and (f.le = 4096 or o.l > f.le // 2) group by all""", "v_oplog"))
def op_size_hist(spark, d):
    return M.size_histogram(bind.oplog(spark, d).withColumn("length", F.col("length") * 7))


_FLOW = "(select device, seq, seq * 10 as start, seq * 10 + length as stop from v_oplog)"


@query(twin(f"""select device, count(*) as n_started, cast(sum(flying) as bigint) as in_flight_sum from (select device, d, sum(d) over (partition by device order by t, d, seq rows between unbounded preceding and current row) as flying
  from (select device, start as t, 1 as d, seq from {_FLOW} union all select device, stop, -1, seq from {_FLOW})) where d = 1 group by device""", "v_oplog"))
def op_concurrency(spark, d):
    return M.concurrency(bind.oplog(spark, d).selectExpr("device", "seq", "seq * 10 as start", "seq * 10 + length as stop"), 1000)


@query(twin("""select device, seq, length from (select *, coalesce(lag(length) over (partition by device order by seq), 0) as p from (select device, seq, length // 512 as length from v_oplog)) where length is distinct from p""", "v_oplog"))
def changed_only(spark, d):
    rows = bind.oplog(spark, d).selectExpr("device", "seq", "cast(length div 512 as int) as length")
    return M.changed_only(rows, ["device"], ["seq"], "length")


_STEPS = "(select *, case when p is null then 0 when value >= p then value - p else value end as step from (select *, lag(value) over (partition by device order by ts, event_id) as p from v_samples))"


@query(twin(f"select device, day, cast(sum(step) as bigint) as increase from {_STEPS} group by all", "v_samples"))
def counter_rate(spark, d):
    samples = bind.samples(spark, d).withColumn("day", F.col("day").cast("timestamp_ntz"))
    return M.increase(samples, ["device"], ["ts", "event_id"], ["day"]).select("device", "day", F.col("increase").cast("long").alias("increase"))


@query(twin(f"""select day, cast(case when o > 0 then floor(t / o) end as bigint) as ratio from (select day, sum(step) filter (device = 'view') as t, sum(step) filter (device = 'click') as o from {_STEPS} group by day)""", "v_samples"))
def latency_ratio(spark, d):
    samples = bind.samples(spark, d).withColumn("day", F.col("day").cast("timestamp_ntz"))
    grown = M.increase(samples, ["device"], ["ts", "event_id"], ["day"])
    both = grown.groupBy("day").agg(F.sum(F.when(F.col("device") == "view", F.col("increase"))).alias("t"), F.sum(F.when(F.col("device") == "click", F.col("increase"))).alias("o"))
    return both.select("day", M.ratio(F.col("t"), F.col("o")).alias("ratio"))


@query(twin(f"select device, seq, count(*) over w as n_in, cast(sum(length) over w as bigint) as sum_in from v_oplog window w as (partition by device order by epoch_us(ts) range between {DAY * 1000000 - 1} preceding and current row)", "v_oplog"))
def running_avg(spark, d):
    return M.running_average(bind.oplog(spark, d), ["device"], V.micros(F.col("ts")), DAY, "length").select("device", "seq", "n_in", "sum_in")


@query(twin("""select device, seq, bytes_1s, case when span > 0 then bytes_1s * 1000000 // span else bytes_1s end as bytes_per_s from (select device, seq, cast(sum(length) over w as bigint) as bytes_1s, epoch_us(ts) - min(epoch_us(ts)) over w as span
  from v_oplog window w as (partition by device order by epoch_us(ts) range between 1000000 preceding and current row))""", "v_oplog"))
def bandwidth(spark, d):
    return M.bandwidth(bind.oplog(spark, d), V.micros(F.col("ts"))).select("device", "seq", "bytes_1s", "bytes_per_s")


@query("""select p_partkey as device, 1 + greatest(500, count(*) over ()) * 0 + (greatest(500, count(*) over ()) - count(*) over ()) * p_size // cast(sum(p_size) over () as bigint) as share from part""")
def concurrency_share(spark, d):
    parts = bind.table(spark, d, "part").selectExpr("p_partkey as device", "cast(p_size as bigint) as size")
    return M.concurrency_shares(parts, 500).select("device", "share")


@query(twin("""select device, seq from (with recursive r as (
    select device, min(epoch_us(ts)) as t from v_oplog group by device
    union all
    select r.device, min(epoch_us(o.ts)) as t from r join v_oplog o on o.device = r.device and epoch_us(o.ts) >= r.t + 3600000000 group by r.device)
  select r.device, min(o.seq) as seq from r join v_oplog o on o.device = r.device and epoch_us(o.ts) = r.t group by r.device, r.t
  union select device, seq from (select device, seq, row_number() over (partition by device order by epoch_us(ts) desc, seq desc) as l from v_oplog) where l = 1)""", "v_oplog"))
def progress_reports(spark, d):
    return M.rate_limited(bind.oplog(spark, d).select("device", "seq", "ts"), ["device"], V.micros(F.col("ts")), 3600000, "seq").select("device", "seq")


@query(twin(f"""select device, {BLOCKS}::bigint as total, count(*) filter (m) as n_migrated, count(*) filter (m and not w) as n_ready, count(*) filter (m) * 1000000 // {BLOCKS} as migrated_ppm from
  (select b.device, b.block_no, bool_or(coalesce(t.op = 'R', false)) as m, bool_or(coalesce(t.op = 'W' and t.seq % 3 = 0, false)) as w from (select device, unnest(range(0, {BLOCKS})) as block_no from (select distinct device from v_oplog)) b
  left join v_touch t on t.device = b.device and t.block_no = b.block_no group by all) group by device""", "v_touch"))
def progress(spark, d):
    t = _touched(spark, d)
    blocks = t.select("device").distinct().withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    return Y.progress(blocks, t.where("op = 'R'"), t.where("op = 'W' and seq % 3 = 0"))


@query(twin(f"""select device, {BLOCKS}::bigint as total, count(*) filter (m) as n_migrated, count(*) filter (m and not w) as n_ready, count(*) filter (m) * 1000000 // {BLOCKS} as migrated_ppm from
  (select b.device, b.block_no, bool_or(coalesce(t.op = 'R', false)) as m, bool_or(coalesce(t.op = 'W', false)) as w from (select device, unnest(range(0, {BLOCKS})) as block_no from (select distinct device from v_oplog)) b
  left join v_touch t on t.device = b.device and t.block_no = b.block_no group by all) group by device""", "v_touch"))
def progress_all(spark, d):
    """``progress`` with every written block as dirty."""
    t = _touched(spark, d)
    blocks = t.select("device").distinct().withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    return Y.progress(blocks, t.where("op = 'R'"), t.where("op = 'W'"))


@query(twin("""select device, block_no, max(case when ok then seq end) is not null as is_set, max(seq) as updating_id, max(case when ok then seq end) as current_id, 'h' || max(case when ok then seq end) as current_hash
  from (select *, seq % 17 <> 0 as ok from v_touch where op = 'W') group by all""", "v_touch"))
def sync_status(spark, d):
    w = _touched(spark, d).where("op = 'W'").selectExpr("device", "block_no", "seq as id", "concat('h', seq) as hash", "seq % 17 <> 0 as ok")
    empty = spark.createDataFrame([], "device long, block_no long, is_set boolean, updating_id long, current_id long, current_hash string")
    first = Y.upsert_status(empty, w.where("id % 2 = 0"))
    return Y.upsert_status(first, w.where("id % 2 = 1"))


@query(twin(f"""select device, block_no from (select device, unnest(range(0, {BLOCKS})) as block_no from (select distinct device from v_oplog)) except select device, block_no from v_touch where op = 'R' except select device, block_no from v_touch where op = 'TRACK'""", "v_touch"))
def migrate_remaining(spark, d):
    t = _touched(spark, d)
    blocks = t.select("device").distinct().withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    return Y.remaining(blocks, t.where("op = 'R'").select("device", "block_no"), t.where("op = 'TRACK'").select("device", "block_no"))


@query(twin(f"""select b.device, count(*) filter (a is not null and (w is null or a > w)) as n_available, count(*) as total from (select device, unnest(range(0, {BLOCKS})) as block_no from (select distinct device from v_oplog)) b
  left join (select device, block_no, max(seq) filter (op = 'R') as a, max(seq) filter (op = 'W') as w from v_touch group by all) t on t.device = b.device and t.block_no = b.block_no group by b.device""", "v_touch"))
def availability(spark, d):
    t = _touched(spark, d)
    blocks = t.select("device").distinct().withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    return Y.availability(blocks, t.where("op = 'R'"), t.where("op = 'W'"))


@query(twin("""select device, block_no, r as seq, w as waited_for from (select device, block_no, min(seq) filter (op = 'R') as r, min(seq) filter (op = 'W') as w from v_touch group by all) where r is not null and (w is null or r < w)""", "v_touch"))
def need_events(spark, d):
    t = _touched(spark, d)
    return Y.needed(t.where("op = 'R'"), t.where("op = 'W'"))


@query(twin("""select b.block_no, lower(hex(coalesce(o.data, b.data))) as data, o.data is not null as kept_local from v_base b left join v_overlay o on o.block_no = b.block_no""", "v_base", "v_overlay"))
def remote_merge(spark, d):
    tag = lambda df: df.withColumn("device", F.lit(0))
    return Y.merge_remote(tag(bind.base(spark, d)), tag(bind.overlay(spark, d))).select("block_no", F.lower(F.hex("data")).alias("data"), "kept_local")


_LOCKS = "(select device, seq, seq % 40 < 20 as locked from v_oplog where op = 'SYNC')"


@query(twin(f"""select o.device, o.seq, o.op, case when o.op = 'W' and coalesce((select arg_max(l.locked, l.seq) from {_LOCKS} l where l.device = o.device and l.seq <= o.seq), false)
  then (select min(l.seq) from {_LOCKS} l where l.device = o.device and l.seq > o.seq and not l.locked) else o.seq end as passed_at from v_oplog o""", "v_oplog"))
def read_only_gate(spark, d):
    ops = bind.oplog(spark, d)
    return D.gate(ops, ops.where("op = 'SYNC'").selectExpr("device", "seq", "seq % 40 < 20 as locked"))


@query(twin("select device, seq, case op when 'R' then 10 + 2 * length when 'W' then 20 + 3 * length else 0 end as delay from v_oplog", "v_oplog"))
def artificial_latency(spark, d):
    return D.artificial_latency(bind.oplog(spark, d), 10, 2, 20, 3).select("device", "seq", "delay")


@query(twin(f"""select side, device, block_no, seq from (select device, block_no, seq, greatest("offset", block_no * 1024) as a, least("offset" + length, {SIZE} - 100, (block_no + 1) * 1024) as b from
  (select *, unnest(range("offset" // 1024, (least("offset" + length, {SIZE} - 100) - 1) // 1024 + 1)) as block_no from v_oplog where op = 'W' and "offset" < {SIZE} - 100)), (values ('local'), ('remote')) s(side)
  where a = block_no * 1024 and (b - a = 1024 or side = 'remote' and b = {SIZE} - 100)""", "v_oplog"))
def available_parts(spark, d):
    t = B.touches(bind.oplog(spark, d), SIZE - 100, 1024)
    parts = [D.available_parts(t, SIZE - 100, 1024, remote).select(F.lit(side).alias("side"), "device", "block_no", "seq") for side, remote in (("local", False), ("remote", True))]
    return parts[0].union(parts[1])


@query(twin(f"""select device, 0::bigint as seq, 'TRACK' as op, block_no * {BLOCK} as "offset" from (select device, unnest(range(0, {BLOCKS})) as block_no from (select distinct device from v_oplog) except select device, block_no from v_touch where op = 'W')""", "v_touch"))
def track_unrequired(spark, d):
    t = _touched(spark, d)
    blocks = t.select("device").distinct().withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    free = blocks.join(t.where("op = 'W'").select("device", "block_no").distinct(), ["device", "block_no"], "left_anti")
    return D.track_rows(free, BLOCK, 0).select("device", "seq", "op", "offset")


@query(twin("select 7 as device, 3::bigint as seq, 'TRACK' as op, b.block_no * 16 as \"offset\" from v_base b anti join v_overlay o on o.block_no = b.block_no", "v_base", "v_overlay"))
def track_unrequired_base(spark, d):
    """Tracking requests for the base's blocks that the overlay doesn't have, as device 7."""
    free = O.unrequired(bind.base(spark, d), bind.overlay(spark, d))
    return D.track_rows(free.withColumn("device", F.lit(7)), 16, 3).select("device", "seq", "op", "offset")


@query(twin(f"""select a.id, m.slot, m.slot is not null as found, lower(hex(b.data)) as data from v_addr a left join {_MAPPED} m on m.id = a.id left join v_base b on b.block_no = m.slot""", "v_addr", "v_base"))
def read_by_id(spark, d):
    got = D.read_ids(bind.addresses(spark, d), _mapped(spark, d), bind.base(spark, d))
    return got.select("id", "slot", "found", F.lower(F.hex("data")).alias("data"))


@query(twin(f"select id, slot from {_MAPPED} where slot * {BLOCK} < 100000 and (slot + 1) * {BLOCK} > 20000 union all select -1, 5", "v_addr"))
def id_map_range(spark, d):
    added = spark.createDataFrame([(-1, 5)], "id long, slot long")
    return D.map_for_range(D.merge_map(_mapped(spark, d), added), 20000, 80000, BLOCK)


@query(twin(f"select snapshot, addr_start, addr_end, pathname, 'path' as how from v_maps where pathname = 'dev1' union all select *, 'range' from v_maps where addr_start = {4 * BLOCK} and addr_end = {6 * BLOCK} union all select *, 'page' from v_maps where addr_start <= {8 * BLOCK} and addr_end >= {9 * BLOCK}", "v_maps"))
def maps_find(spark, d):
    m = bind.maps(spark, d)
    found = {"path": D.find_path(m, "dev1"), "range": D.find_range(m, 4 * BLOCK, 6 * BLOCK), "page": D.find_page(m, 8 * BLOCK)}
    return found["path"].withColumn("how", F.lit("path")).union(found["range"].withColumn("how", F.lit("range"))).union(found["page"].withColumn("how", F.lit("page")))


@query(twin(f"""select page_addr from v_pages where present and page % 5 = 1""", "v_pages"))
def frame_dirty(spark, d):
    pages = R.flags(bind.page_flags(spark, d)).withColumn("pfn", F.expr(f"page_addr div {BLOCK}"))
    frames = pages.selectExpr("pfn", "if(pfn % 5 = 1, 16L, 32L) as kflags")
    return D.dirty_by_frame(pages, frames).select("page_addr")


@query(twin("""select b.block_no, lower(hex(coalesce(o.data, unhex(repeat('00', 16))))) as data from v_base b left join v_overlay o on o.block_no = b.block_no""", "v_base", "v_overlay"))
def object_store_read(spark, d):
    base = bind.base(spark, d)
    return D.fill_zeroes(bind.overlay(spark, d), base.select("block_no"), 1 << 60, 16).select("block_no", F.lower(F.hex("data")).alias("data"))


@query(twin("""select block_no as seq, 'W' as op, block_no * 16 as "offset", sha256(data) as hash from v_base where ltrim(hex(data), '0') <> ''""", "v_base"))
def device_to_log(spark, d):
    log = D.device_log(bind.base(spark, d).withColumn("device", F.lit(0)), 16)
    return log.select("seq", "op", "offset", F.sha2("data", 256).alias("hash"))


@query(twin("select block_no, case when ltrim(hex(data), '0') = '' then repeat('0', 64) else sha256(data) end as hash from v_base", "v_base"))
def check_device(spark, d):
    return H.zero_marked_hashes(bind.base(spark, d).withColumn("device", F.lit(0)), 16).select("block_no", "hash")


@query(twin("""select string_agg(case when low = high then low::varchar else low || '-' || high end, ' ' order by low) as text from (select min(block_no) as low, max(block_no) as high from
  (select block_no, block_no - row_number() over (order by block_no) as g from v_base where ltrim(hex(data), '0') <> '') group by g)""", "v_base"))
def check_device_map(spark, d):
    return S.short_text(bind.base(spark, d).where(~B.is_zero(F.col("data"))).select("block_no"))


@query(twin("select device, seq, (epoch_us(ts) - min(epoch_us(ts)) over (partition by device)) * 1000 as dt_ns from v_oplog", "v_oplog"))
def log_times(spark, d):
    return D.timed(bind.oplog(spark, d)).select("device", "seq", "dt_ns")


@query(twin(f"""select device, op, 'metrics' as subsystem, metric, value from (unpivot (select device, op, count(*) as n_ops, cast(sum(length) as bigint) as n_bytes, count(*) filter (not ok) as n_errors,
  cast(sum(case when ok or op = 'SYNC' then micros else 0 end) as bigint) as micros from {_TIMED} group by all) on n_ops, n_bytes, n_errors, micros into name metric value value)""", "v_oplog"))
def metric_samples(spark, d):
    return D.to_samples(M.op_metrics(_timed(spark, d)), ["device", "op"], "metrics")


@query(twin("select device, arg_max(value, event_id) as value from v_samples where (device, ts) in (select device, max(ts) from v_samples group by device) group by device", "v_samples"))
def instant_values(spark, d):
    return D.instant(bind.samples(spark, d), ["device"], ["ts", "event_id"]).withColumn("value", F.col("value").cast("long"))


@query(twin("select distinct device from v_samples", "v_samples"))
def label_values(spark, d):
    return bind.samples(spark, d).select("device").distinct()

"""Binding views: the driver's tables read as devices, blocks and operation logs, with DuckDB twins.

Each view has a function (Spark) and an entry in ``SQL`` (a DuckDB common table expression of the same rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, BLOCK = 1 << 20, 4096
BLOCKS = SIZE // BLOCK


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads, writes, tracking requests and syncs of four devices of SIZE bytes."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id % 4 as device",
        "event_id as seq",
        "ts",
        "case event_type when 'view' then 'R' when 'click' then 'W' when 'purchase' then 'W' when 'signup' then 'TRACK' else 'SYNC' end as op",
        f"(event_id * 7919) % {SIZE} as offset",
        "cast(get_json_object(props, '$.k') as int) * 64 + 1 as length",
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's UTF-8 text as a device of 4096-byte blocks; the last may be short."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").selectExpr("doc_id as device", "cast(text as binary) as raw")
    cut = docs.selectExpr("device", "raw", f"explode(sequence(0, (octet_length(raw) - 1) div {BLOCK})) as block_no")
    return cut.selectExpr("device", "cast(block_no as bigint) as block_no", f"substring(raw, cast(block_no as int) * {BLOCK} + 1, {BLOCK}) as data")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base device of 16-byte blocks, some all zero."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as block_no", "case when o_orderpriority like '1%' then unhex(repeat('00', 16)) else unhex(md5(cast(o_orderkey as string))) end as data")


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written over ``base``: the finished orders' blocks."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey as block_no", "case when o_orderpriority like '5%' then unhex(md5(cast(o_orderkey as string))) else unhex(md5(concat('w', o_orderkey))) end as data")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlays; a greater depth is nearer to the reader."""
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderstatus <> 'P'").selectExpr("case o_orderstatus when 'F' then 1 else 2 end as depth", "o_orderkey as block_no", "unhex(md5(concat(o_orderstatus, o_orderkey))) as data").union(
        orders.where("o_orderpriority like '2%'").selectExpr("3 as depth", "o_orderkey as block_no", "unhex(md5(concat('top', o_orderkey))) as data")
    )


def prio_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of two sources to the blocks of orders, numbered within each block."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as block_no",
        "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as bigint) as seq",
        "cast(1 + l_suppkey % 2 as int) as priority",
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size % 5 <> 0").selectExpr(f"p_partkey * {BLOCK} as id")


def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page map words: present (63), swapped (62), soft-dirty (55)."""
    return table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey * {BLOCK} as page_addr",
        "(case when o_orderstatus <> 'O' then shiftleft(1L, 63) else 0L end) | (case when o_orderpriority like '3%' then shiftleft(1L, 62) else 0L end) | (case when o_orderpriority not like '1%' then shiftleft(1L, 55) else 0L end) as pagemap",
    )


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of a process's memory map, ``a`` from suppliers and ``b`` from customers."""
    a = table(spark, sf_dir, "supplier").selectExpr("'a' as snapshot", f"s_suppkey * {4 * BLOCK} as addr_start", f"(s_suppkey * 4 + 1 + s_nationkey % 4) * {BLOCK} as addr_end", "concat('dev', s_nationkey % 3) as pathname")
    b = table(spark, sf_dir, "customer").selectExpr("'b' as snapshot", f"c_custkey * {2 * BLOCK} as addr_start", f"(c_custkey * 2 + 1 + c_nationkey % 4) * {BLOCK} as addr_end", "concat('dev', c_nationkey % 3) as pathname")
    return a.union(b)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter per event type: cumulative events, reset each day; integral so that both engines agree."""
    return table(spark, sf_dir, "events").selectExpr("ts", "event_id", "event_type as device", "date_trunc('day', ts) as day", "row_number() over (partition by event_type, date_trunc('day', ts) order by ts, event_id) as value")


#: DuckDB twins, by view name.
SQL = {
    "v_oplog": f"""v_oplog as (select user_id % 4 as device, event_id as seq, ts,
  case event_type when 'view' then 'R' when 'click' then 'W' when 'purchase' then 'W' when 'signup' then 'TRACK' else 'SYNC' end as op,
  (event_id * 7919) % {SIZE} as "offset", cast(json_extract_string(props, '$.k') as int) * 64 + 1 as length from events)""",
    "v_touch": f"""v_touch as (select device, seq, ts, op, "offset", length, unnest(range("offset" // {BLOCK}, (least("offset" + length, {SIZE}) - 1) // {BLOCK} + 1)) as block_no
  from v_oplog where length > 0 and "offset" < {SIZE})""",
    "v_blocks": f"""v_blocks as (select device, block_no, array_slice(raw, block_no * {BLOCK} + 1, block_no * {BLOCK} + {BLOCK}) as data
  from (select doc_id as device, encode(text) as raw, unnest(range(0, (octet_length(encode(text)) - 1) // {BLOCK} + 1)) as block_no from documents where length(text) > 0))""",
    "v_base": "v_base as (select o_orderkey as block_no, case when o_orderpriority like '1%' then unhex(repeat('00', 16)) else unhex(md5(cast(o_orderkey as varchar))) end as data from orders)",
    "v_overlay": "v_overlay as (select o_orderkey as block_no, case when o_orderpriority like '5%' then unhex(md5(cast(o_orderkey as varchar))) else unhex(md5('w' || o_orderkey)) end as data from orders where o_orderstatus = 'F')",
    "v_layers": """v_layers as (select case o_orderstatus when 'F' then 1 else 2 end as depth, o_orderkey as block_no, unhex(md5(o_orderstatus || o_orderkey)) as data from orders where o_orderstatus <> 'P'
  union all select 3, o_orderkey, unhex(md5('top' || o_orderkey)) from orders where o_orderpriority like '2%')""",
    "v_prio": "v_prio as (select l_orderkey as block_no, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as seq, cast(1 + l_suppkey % 2 as int) as priority from lineitem)",
    "v_addr": f"v_addr as (select p_partkey * {BLOCK} as id from part where p_size % 5 <> 0)",
    "v_pages": f"v_pages as (select o_orderkey as page, o_orderstatus <> 'O' as present, o_orderpriority like '3%' as swapped, o_orderpriority not like '1%' as dirty, o_orderkey * {BLOCK} as page_addr from orders)",
    "v_maps": f"""v_maps as (select 'a' as snapshot, s_suppkey * {4 * BLOCK} as addr_start, (s_suppkey * 4 + 1 + s_nationkey % 4) * {BLOCK} as addr_end, 'dev' || (s_nationkey % 3) as pathname from supplier
  union all select 'b', c_custkey * {2 * BLOCK}, (c_custkey * 2 + 1 + c_nationkey % 4) * {BLOCK}, 'dev' || (c_nationkey % 3) from customer)""",
    "v_samples": "v_samples as (select ts, event_id, event_type as device, date_trunc('day', ts) as day, row_number() over (partition by event_type, date_trunc('day', ts) order by ts, event_id) as value from events)",
}
NEEDS = {"v_touch": ["v_oplog"]}


def twin(body: str, *views: str) -> str:
    """DuckDB SQL of ``body`` over the named views."""
    names: list[str] = []
    for v in views:
        names += [x for x in [*NEEDS.get(v, []), v] if x not in names]
    return f"with {', '.join(SQL[n] for n in names)}\n{body}" if names else body

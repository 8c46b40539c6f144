"""The queries over the reference tables, one for each operator, and their SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.boundaries import IdGrid, TimeGrid, check_name_length, format_suffix, initial_ids, initial_times, truncate
from .functions.intervals import Interval, add
from .operators.manager import PartitionManager, duplicates
from .operators.routing import as_time, century_start, child_start, grid_index, route, route_by_bounds, suffix_column
from .plans import planner as P
from .sources.store import work_dir

NOW = datetime(2024, 1, 15, 12)
DAY = TimeGrid(Interval.parse("1 day"), datetime(2024, 1, 1))
MONTH = TimeGrid(Interval.parse("1 month"), datetime(1995, 1, 1))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _children(spark: SparkSession, table: str, grid: TimeGrid | IdGrid, starts: list, pattern: str = "YYYYMMDD") -> DataFrame:
    rows = [(grid.index(x), check_name_length(table, format_suffix(x, pattern) if isinstance(x, datetime) else str(x), True)) for x in starts]
    return spark.createDataFrame(rows, "cell bigint, name string")


def _name(table: str, suffix: Column) -> Column:
    return F.concat(F.lit(f"{table}_p"), suffix)


def _manager(spark: SparkSession, now: datetime = NOW) -> PartitionManager:
    """A manager on a fresh folder, shared on a cluster."""
    return PartitionManager(spark, f"{work_dir(spark)}/sets-{uuid.uuid4().hex}", lambda: now)


# --- routing ---------------------------------------------------------------------


def route_time_daily(spark, sf_dir):
    """Daily children around NOW; other rows go to the default."""
    starts, pattern = initial_times(Interval.parse("1 day"), NOW, 4, datetime(2024, 1, 3), None)
    grid = TimeGrid(Interval.parse("1 day"), starts[0])
    routed = route(_table(spark, sf_dir, "events"), "ts", grid, _children(spark, "events", grid, starts, pattern), "events_default", len(starts))
    return routed.groupBy(F.col("child").alias("partition_tablename")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def route_time_weekly_join(spark, sf_dir):
    """Bounds that needn't fit a grid: a range join."""
    starts = [add(datetime(2024, 1, 1), Interval.parse("1 week"), n) for n in range(4)]
    rows = [(x, add(x, Interval.parse("1 week")), f"events_p{format_suffix(x, 'YYYYMMDD')}") for x in starts]
    bounds = spark.createDataFrame(rows, "lo timestamp_ntz, hi timestamp_ntz, name string")
    routed = route_by_bounds(_table(spark, sf_dir, "events"), F.col("ts"), bounds, "events_default")
    return routed.groupBy(F.col("child").alias("partition_tablename")).agg(F.count(F.lit(1)).alias("n_rows"))


def route_time_30sec(spark, sf_dir):
    start = child_start(F.col("ts"), TimeGrid(Interval.parse("30 seconds"), datetime(2024, 1, 1)))
    return _table(spark, sf_dir, "events").groupBy(start.alias("child_start_time")).agg(F.count(F.lit(1)).alias("n_rows"))


def route_time_century(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(century_start(F.col("o_orderdate")).alias("child_start_time")).groupBy("child_start_time").agg(F.count(F.lit(1)).alias("n_rows"))


def route_time_monthly(spark, sf_dir):
    start = child_start(F.col("l_shipdate"), MONTH)
    named = _table(spark, sf_dir, "lineitem").select(_name("lineitem", suffix_column(start, "YYYYMMDD")).alias("partition_tablename"), "l_quantity")
    return named.groupBy("partition_tablename").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_quantity"))


def route_id_range(spark, sf_dir):
    start = child_start(F.col("o_orderkey"), IdGrid(1000))
    return _table(spark, sf_dir, "orders").groupBy(_name("orders", start.cast("string")).alias("partition_tablename")).agg(F.count(F.lit(1)).alias("n_rows"))


def route_id_list(spark, sf_dir):
    start = child_start(F.col("l_linenumber"), IdGrid(1))
    return _table(spark, sf_dir, "lineitem").groupBy(_name("lineitem", start.cast("string")).alias("partition_tablename")).agg(F.count(F.lit(1)).alias("n_rows"))


def route_numeric(spark, sf_dir):
    """The documented formula v - v % interval on a decimal cut towards zero."""
    v = F.col("c_acctbal").cast("decimal(12,2)").cast("bigint")
    return _table(spark, sf_dir, "customer").groupBy((v - v % 1000).alias("suffix_id")).agg(F.count(F.lit(1)).alias("n_rows"))


def route_epoch_ms(spark, sf_dir):
    ms = _table(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return ms.groupBy(child_start(F.col("ms"), DAY, "milliseconds").alias("child_start_time")).agg(F.count(F.lit(1)).alias("n_rows"))


def route_subpartition(spark, sf_dir):
    year = suffix_column(child_start(F.col("o_orderdate"), TimeGrid(Interval.parse("1 year"), datetime(1995, 1, 1))), "YYYYMMDD")
    key = child_start(F.col("o_orderkey"), IdGrid(5000)).cast("string")
    return _table(spark, sf_dir, "orders").groupBy(F.concat(_name("orders", year), F.lit("_p"), key).alias("partition_tablename")).agg(F.count(F.lit(1)).alias("n_rows"))


# --- creation, maintenance, retention ----------------------------------------------


def premake_time(spark, sf_dir):
    starts, _ = initial_times(Interval.parse("1 day"), NOW, 4, None, None)
    return spark.createDataFrame([(x, add(x, Interval.parse("1 day"))) for x in starts], "child_start_time timestamp_ntz, child_end_time timestamp_ntz")


def premake_id(spark, sf_dir):
    top = _table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).head()[0]
    return spark.createDataFrame([(x, x + 1000) for x in initial_ids(1000, top, 4, None)], "child_start_id bigint, child_end_id bigint")


def _monthly(spark, df: DataFrame, **options) -> PartitionManager:
    """orders by month from the first on."""
    m = _manager(spark)
    lo, hi = df.agg(F.min("o_orderdate").cast("timestamp_ntz"), F.max("o_orderdate").cast("timestamp_ntz")).head()
    m.now = lambda: hi
    m.create_parent("t.orders", "o_orderdate", "1 month", df.schema, start_partition=truncate(lo, "month"), premake=1, df=df, **options)
    return m


def _thousands(spark, df: DataFrame) -> PartitionManager:
    """orders by ids of 1,000; children are made for the rows that the default got."""
    m = _manager(spark)
    m.create_parent("t.orders", "o_orderkey", "1000", df.schema, start_partition=0, premake=1, df=df)
    m.partition_data_proc("t.orders")
    return m


def _starts(spark, m: PartitionManager, tables: list[str]) -> DataFrame:
    found = [m.show_partition_info(t) for t in tables]
    kind, name = ("timestamp_ntz", "child_start_time") if m.state.sets["t.orders"].kind == "time" else ("bigint", "child_start_id")
    return spark.createDataFrame([(i[name],) for i in found], f"{name} {kind}")


def retention_time(spark, sf_dir):
    """Children with rows that a run of retention three years before August 2001 takes."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    m = _monthly(spark, orders)
    held = {c.table for c in m.state.sets["t.orders"].children.values() if c.data}
    info = {t: m.show_partition_info(t)["child_start_time"] for t in m.children("t.orders")}
    m.drop_partition_time("t.orders", "3 years", reference_timestamp=datetime(2001, 8, 1))
    left = set(m.children("t.orders"))
    return spark.createDataFrame([(x,) for t, x in info.items() if t in held and t not in left], "child_start_time timestamp_ntz")


def retention_id(spark, sf_dir):
    m = _thousands(spark, _table(spark, sf_dir, "orders").select("o_orderkey"))
    info = {t: m.show_partition_info(t)["child_start_id"] for t in m.children("t.orders")}
    held = {c.table for c in m.state.sets["t.orders"].children.values() if c.data}
    m.drop_partition_id("t.orders", 5000)
    left = set(m.children("t.orders"))
    return spark.createDataFrame([(x,) for t, x in info.items() if t in held and t not in left], "child_start_id bigint")


def gap_fill_time(spark, sf_dir):
    """Children that are made between those that the data asked for."""
    kept = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").filter(F.month("o_orderdate") % 4 != 0)
    m = _manager(spark)
    first = kept.agg(F.min("o_orderdate").cast("timestamp_ntz")).head()[0]
    m.now = lambda: first
    m.create_parent("t.orders", "o_orderdate", "1 month", kept.schema, start_partition=truncate(first, "month"), premake=1, df=kept)
    return _filled(spark, m)


def gap_fill_id(spark, sf_dir):
    kept = _table(spark, sf_dir, "orders").select("o_orderkey").filter((F.floor(F.col("o_orderkey") / 1000) % 5) != 3)
    m = _manager(spark)
    m.create_parent("t.orders", "o_orderkey", "1000", kept.schema, start_partition=0, premake=1, df=kept)
    return _filled(spark, m)


def _filled(spark, m: PartitionManager) -> DataFrame:
    m.partition_data_proc("t.orders")
    # Children that were made beforehand and got no rows are gaps like others.
    s = m.state.sets["t.orders"]
    empty = {c.table for c in P.children(s) if not c.data}
    held = [c.lo for c in P.children(s) if c.data]
    before = set(m.children("t.orders"))
    m.partition_gap_fill("t.orders")
    made = [t for t in m.children("t.orders") if t not in before or t in empty]
    found = _starts(spark, m, made)
    name = found.columns[0]
    return found.filter(F.col(name).between(F.lit(min(held)), F.lit(max(held))))


def apply_constraints(spark, sf_dir):
    """Least and greatest order key that each monthly child's constraint holds."""
    m = _monthly(spark, _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), constraint_cols=["o_orderkey"])
    for t in m.children("t.orders"):
        m.apply_constraints("t.orders", t)
    rows = [(c.lo, *c.constraints["o_orderkey"][:2]) for c in P.children(m.state.sets["t.orders"]) if c.constraints]
    return spark.createDataFrame(rows, "child_start_time timestamp_ntz, min_value bigint, max_value bigint")


def insert_odd_name(spark, sf_dir):
    """Rows of a set whose name has characters that file systems and Spark write otherwise."""
    m = _manager(spark)
    df = _table(spark, sf_dir, "events").select("event_id", "ts")
    m.create_parent("t.my#ev:en%ts", "ts", "1 day", df.schema, start_partition=datetime(2024, 1, 3), premake=4, df=df)
    rows = m.route("t.my#ev:en%ts", m.scan("t.my#ev:en%ts"))
    return rows.groupBy(F.col("__child").alias("child")).agg(F.count(F.lit(1)).alias("n_rows"))


def constraint_pruned_scan(spark, sf_dir):
    """Rows of a managed set; children whose constraints contradict the filter are not read."""
    m = _manager(spark)
    src = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    m.create_parent("t.lineitem", "l_orderkey", "50000", src.schema, start_partition=0, premake=20, constraint_cols=["l_shipdate"], df=src)
    m.reapply_constraints_proc("t.lineitem", drop=True, apply=True)
    got = m.scan("t.lineitem", lo=5000, hi=40000, where={"l_shipdate": (datetime(1996, 1, 1), datetime(1996, 12, 31))})
    return got.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_quantity"))


def check_unique(spark, sf_dir):
    return duplicates(_table(spark, sf_dir, "events"), ["user_id", "event_type"]).withColumnRenamed("count", "n_rows")


def check_default(spark, sf_dir):
    m = _events_set(spark, sf_dir)
    return m.check_default().withColumnRenamed("count", "n_rows")


def _events_set(spark, sf_dir) -> PartitionManager:
    """events by day from 2024-01-03 to 2024-01-18; the rest is in the default."""
    m = _manager(spark)
    df = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    m.create_parent("t.events", "ts", "1 day", df.schema, start_partition=datetime(2024, 1, 3), premake=4, df=df)
    return m


def show_partitions(spark, sf_dir):
    m = _manager(spark)
    m.create_parent("t.events", "ts", "1 day", _table(spark, sf_dir, "events").schema, start_partition=datetime(2024, 1, 3), premake=4)
    return m.show_partitions("t.events", include_default=True)


def show_partition_info(spark, sf_dir):
    m = _manager(spark)
    m.create_parent("t.events", "ts", "1 day", _table(spark, sf_dir, "events").schema, start_partition=datetime(2024, 1, 3), premake=4)
    rows = [(t, *(i[k] for k in ("child_start_time", "child_end_time", "suffix"))) for t in m.children("t.events") for i in [m.show_partition_info(t)]]
    return spark.createDataFrame(rows, "child string, child_start_time timestamp_ntz, child_end_time timestamp_ntz, suffix string")


def show_partition_name(spark, sf_dir):
    """The child of each day that occurs, and whether it exists."""
    m = _manager(spark)
    events = _table(spark, sf_dir, "events")
    m.create_parent("t.events", "ts", "1 day", events.schema, start_partition=datetime(2024, 1, 3), premake=4)
    days = events.groupBy(F.date_trunc("day", "ts")).agg(F.max("ts").cast("timestamp_ntz")).collect()
    found = [m.show_partition_name("t.events", r[1]) for r in days]
    return spark.createDataFrame([(f["partition_table"], f["table_exists"]) for f in found], "partition_table string, table_exists boolean")


def partition_data_batches(spark, sf_dir, order="ASC"):
    """The batches by which a source table moves to a set, and the rows that each child then has."""
    m = _manager(spark)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    m.create_parent("t.orders", "o_orderkey", "1000", orders.schema, start_partition=0, premake=1)
    m.register_table("t.source", orders)
    spans = m.plan_batches("t.orders", 1_000_000, order=order, source_table="t.source")
    m.partition_data_proc("t.orders", order=order, source_table="t.source")
    counts = m.route("t.orders", m.scan("t.orders")).groupBy("__child").agg(F.count(F.lit(1)).alias("n_rows"))
    planned = spark.createDataFrame([(i + 1, lo, hi, f"t.orders_p{lo}") for i, (lo, hi) in enumerate(spans)], "batch_no bigint, lo bigint, hi bigint, child string")
    return planned.join(counts, F.col("child") == F.col("__child")).select("batch_no", "lo", "hi", "n_rows")


def partition_data_batches_desc(spark, sf_dir):
    return partition_data_batches(spark, sf_dir, "DESC")


def undo_batches(spark, sf_dir):
    """Windows of 300 from each child's least value on."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", child_start(F.col("o_orderkey"), IdGrid(1000)).alias("child_start_id"))
    least = rows.groupBy("child_start_id").agg(F.min("o_orderkey").alias("least"))
    batch = F.floor((F.col("o_orderkey") - F.col("least")) / 300).cast("bigint")
    return rows.join(least, "child_start_id").groupBy("child_start_id", batch.alias("batch_no")).agg(F.count(F.lit(1)).alias("n_rows"))


def current_cell(spark, sf_dir):
    """What maintenance counts from, and how many children are ahead of it."""
    m = _events_set(spark, sf_dir)
    s = m.state.sets["t.events"]
    current, last = m.current_cell("t.events"), P.children(s, "DESC")[0].lo
    return spark.createDataFrame([(current, last, P.premade_count(s, last, current))], "current_start timestamp_ntz, last_start timestamp_ntz, premade bigint")


def run_maintenance(spark, sf_dir):
    """Children after a run with premake 6."""
    m = _events_set(spark, sf_dir)
    m.update_config("t.events", premake=6)
    m.run_maintenance("t.events")
    return m.show_partitions("t.events")


def default_replay(spark, sf_dir):
    """Rows of the default moved to children that are made for them."""
    m = _events_set(spark, sf_dir)
    m.partition_data_proc("t.events")
    counts = m.route("t.events", m.scan("t.events")).groupBy(F.col("__child").alias("child")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts


def undo_partition(spark, sf_dir):
    """All rows back in one table, as before."""
    m = _events_set(spark, sf_dir)
    m.undo_partition_proc("t.events", "t.events_back")
    return m.read_child("t.events_back").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("user_id").alias("sum_user"))


GRANTS = [("parent", "ann", "INSERT"), ("parent", "ann", "SELECT"), ("parent", "bob", "SELECT"), ("child", "ann", "SELECT"), ("child", "bob", "SELECT"), ("child", "eve", "SELECT")]


def privilege_diff(spark, sf_dir):
    """Grants that a child lacks or has beyond its parent's, and whether they are the same once applied."""
    m = _manager(spark)
    m.create_parent("t.events", "ts", "1 day", _table(spark, sf_dir, "events").schema)
    child = m.children("t.events")[0]
    for where, who, what in GRANTS:
        m.grant("t.events" if where == "parent" else child, who, [what])
    before = m.table_privs().filter(F.concat_ws(".", "table_schema", "table_name").isin("t.events", child))
    diff = (
        before.groupBy("grantee", "privilege_type")
        .agg(F.bool_or(F.col("table_name") == "events").alias("wanted"), F.bool_or(F.col("table_name") != "events").alias("has"))
        .groupBy("grantee")
        .agg(*(F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("privilege_type")))), ",").alias(n) for n, c in (("to_grant", F.col("wanted") & ~F.col("has")), ("to_revoke", ~F.col("wanted") & F.col("has")))))
        .filter("to_grant <> '' or to_revoke <> ''")
    )
    told = {r.grantee for r in m.apply_privileges("t.events", child).collect()}
    return diff.filter(F.col("grantee").isin(sorted(told)))


SUBS = [("t.a_p0", "1 day", 4), ("t.a_p1000", "1 day", 4), ("t.a_p2000", "7 days", 4)]


def subpart_sameconfig(spark, sf_dir):
    """Distinct settings of the sets beside one another."""
    m = _manager(spark)
    m.create_parent("t.a", "o_orderkey", "1000", _table(spark, sf_dir, "orders").schema, start_partition=0, premake=2)
    m.create_sub_parent("t.a", "o_orderdate", "1 month", declarative_check="yes")
    for child, (_, interval, premake) in zip(m.children("t.a"), SUBS, strict=True):
        m.create_sub_parent(child, "o_orderdate", interval, premake=premake, declarative_check="yes")
    return m.check_subpart_sameconfig(m.children("t.a")[0]).select("sub_partition_interval", F.col("sub_premake").cast("int").alias("sub_premake"))


def stream_route_daily(spark, sf_dir):
    """events as a stream of files, routed by the same expressions into a set's children."""
    from .streaming.ingest import ingest_files

    m = _manager(spark)
    schema = _table(spark, sf_dir, "events").schema
    m.create_parent("t.events", "ts", "1 day", schema, start_partition=datetime(2024, 1, 3), premake=4)
    ingest_files(m, "t.events", sf_dir, "events.parquet", schema)
    rows = m.scan("t.events")
    return m.route("t.events", rows).groupBy(F.col("__child").alias("child")).agg(F.count(F.lit(1)).alias("n_rows"))


def stream_tumbling_window(spark, sf_dir):
    """A child's range as a tumbling window, with late rows kept by a watermark."""
    from .streaming.ingest import windowed_counts

    return windowed_counts(spark, sf_dir, "events.parquet", _table(spark, sf_dir, "events").schema)


ALL = [
    route_time_daily, route_time_weekly_join, route_time_30sec, route_time_century, route_time_monthly, route_id_range, route_id_list, route_numeric, route_epoch_ms, route_subpartition,
    premake_time, premake_id, retention_time, retention_id, gap_fill_time, gap_fill_id, apply_constraints, insert_odd_name, constraint_pruned_scan, check_unique, check_default, show_partitions, show_partition_info,
    show_partition_name, partition_data_batches, partition_data_batches_desc, undo_batches, current_cell, run_maintenance, default_replay, undo_partition, privilege_diff, subpart_sameconfig,
    stream_route_daily, stream_tumbling_window,
]


def queries() -> dict:
    return {f.__name__: f for f in ALL}


_BOUNDS = "ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-20'"
_DAILY = f"case when {_BOUNDS} then 'events_p'||strftime(ts,'%Y%m%d') else 'events_default' end"
_KIDS = "select unnest(generate_series(timestamp '2024-01-03', timestamp '2024-01-19', interval 1 day)) x"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def oracle_sql() -> dict[str, str]:
    batches = "select row_number() over (order by c {0}) batch_no, c lo, c + 1000 hi, n n_rows from (select o_orderkey - o_orderkey % 1000 c, count(*) n from orders group by 1)"
    names = "select 't' partition_schemaname, 'events_p'||strftime(x,'%Y%m%d') partition_tablename from ({0})"
    return {
        "route_time_daily": f"select {_DAILY} partition_tablename, count(*) n_rows, min(ts) min_ts, max(ts) max_ts from events group by 1",
        "route_time_weekly_join": "with b as (select x lo, x + interval 1 week hi from generate_series(timestamp '2024-01-01', timestamp '2024-01-22', interval 1 week) t(x)) select coalesce('events_p'||strftime(lo,'%Y%m%d'),'events_default') partition_tablename, count(*) n_rows from events left join b on ts >= lo and ts < hi group by 1",
        "route_time_30sec": "select time_bucket(interval 30 second, ts) child_start_time, count(*) n_rows from events group by 1",
        "route_time_century": "select make_timestamp((year(o_orderdate)-1)//100*100+1,1,1,0,0,0) child_start_time, count(*) n_rows from orders group by 1",
        "route_time_monthly": "select 'lineitem_p'||strftime(date_trunc('month',l_shipdate),'%Y%m%d') partition_tablename, count(*) n_rows, sum(l_quantity) sum_quantity from lineitem group by 1",
        "route_id_range": "select 'orders_p'||(o_orderkey - o_orderkey % 1000)::varchar partition_tablename, count(*) n_rows from orders group by 1",
        "route_id_list": "select 'lineitem_p'||l_linenumber::varchar partition_tablename, count(*) n_rows from lineitem group by 1",
        "route_numeric": "select x - x%1000 suffix_id, count(*) n_rows from (select trunc(c_acctbal::decimal(12,2))::bigint x from customer) group by 1",
        "route_epoch_ms": "select date_trunc('day', make_timestamp((epoch_ms(ts)//1000)*1000000))::timestamp child_start_time, count(*) n_rows from events group by 1",
        "route_subpartition": "select 'orders_p'||strftime(date_trunc('year',o_orderdate),'%Y%m%d')||'_p'||(o_orderkey-o_orderkey%5000)::varchar partition_tablename, count(*) n_rows from orders group by 1",
        "premake_time": "select x child_start_time, x + interval 1 day child_end_time from generate_series(timestamp '2024-01-11', timestamp '2024-01-19', interval 1 day) t(x)",
        "premake_id": "with m as (select max(o_orderkey)-max(o_orderkey)%1000 st from orders) select b child_start_id, b+1000 child_end_id from (select unnest(generate_series(st-4000, st+4000, 1000)) b, st from m) where b >= st or b > 0",
        "retention_time": "select b child_start_time from (select distinct date_trunc('month',o_orderdate)::timestamp b from orders) where b + interval 1 month < timestamp '2001-08-01' - interval 3 years",
        "retention_id": "select b child_start_id from (select distinct o_orderkey-o_orderkey%1000 b from orders), (select max(o_orderkey) m from orders) where 5000 <= m - (b + 1000)",
        "gap_fill_time": "with k as (select distinct date_trunc('month',o_orderdate)::timestamp c from orders where month(o_orderdate)%4 <> 0), b as (select min(c) a, max(c) z from k) select x::timestamp child_start_time from b, generate_series(a, z, interval 1 month) t(x) where x not in (select c from k)",
        "gap_fill_id": "with k as (select distinct o_orderkey-o_orderkey%1000 c from orders where (o_orderkey//1000)%5 <> 3), b as (select min(c) a, max(c) z from k) select x child_start_id from (select unnest(generate_series(a, z, 1000)) x from b) where x not in (select c from k)",
        "apply_constraints": "select date_trunc('month',o_orderdate)::timestamp child_start_time, min(o_orderkey) min_value, max(o_orderkey) max_value from orders group by 1",
        "insert_odd_name": f"select case when {_BOUNDS} then 't.my#ev:en%ts_p'||strftime(ts,'%Y%m%d') else 't.my#ev:en%ts_default' end child, count(*) n_rows from events group by 1",
        "constraint_pruned_scan": "select count(*) n_rows, sum(l_quantity) sum_quantity from lineitem where l_orderkey >= 5000 and l_orderkey < 40000 and l_shipdate between timestamp '1996-01-01' and timestamp '1996-12-31'",
        "check_unique": "select user_id, event_type, count(*) n_rows from events group by 1,2 having count(*) > 1",
        "check_default": f"select 't.events_default' default_table, count(*) n_rows from events where not ({_BOUNDS}) having count(*) > 0",
        "show_partitions": f"select 't' partition_schemaname, 'events_default' partition_tablename union all {names.format(_KIDS)}",
        "show_partition_info": f"select 't.events_p'||strftime(x,'%Y%m%d') child, x child_start_time, x + interval 1 day child_end_time, strftime(x,'%Y%m%d') suffix from ({_KIDS})",
        "show_partition_name": f"select distinct 'events_p'||strftime(ts,'%Y%m%d') partition_table, ({_BOUNDS}) table_exists from events",
        "partition_data_batches": batches.format("asc"),
        "partition_data_batches_desc": batches.format("desc"),
        "undo_batches": "with r as (select o_orderkey k, o_orderkey - o_orderkey % 1000 c from orders), m as (select c, min(k) l from r group by 1) select c child_start_id, (k - l) // 300 batch_no, count(*) n_rows from r join m using (c) group by 1, 2",
        "current_cell": f"select date_trunc('day', max(ts))::timestamp current_start, timestamp '2024-01-19' last_start, date_diff('day', date_trunc('day', max(ts)), timestamp '2024-01-19') premade from events where {_BOUNDS}",
        "run_maintenance": names.format(f"with c as (select date_trunc('day', max(ts)) + interval 6 day z from events where {_BOUNDS}) select x from c, generate_series(timestamp '2024-01-03', greatest(z, timestamp '2024-01-19'), interval 1 day) t(x)"),
        "default_replay": "select 't.events_p'||strftime(ts,'%Y%m%d') child, count(*) n_rows from events group by 1",
        "undo_partition": "select event_type, count(*) n_rows, sum(user_id)::bigint sum_user from events group by 1",
        "privilege_diff": f"with g(tbl, grantee, privilege) as (values {_values(GRANTS)}), k as (select grantee, privilege, bool_or(tbl='parent') p, bool_or(tbl='child') c from g group by 1,2) select grantee, coalesce(string_agg(privilege, ',' order by privilege) filter (where p and not c), '') to_grant, coalesce(string_agg(privilege, ',' order by privilege) filter (where c and not p), '') to_revoke from k group by 1 having bool_or(p <> c)",
        "subpart_sameconfig": f"with s(sub_parent, sub_partition_interval, sub_premake) as (values {_values(SUBS)}) select distinct sub_partition_interval, sub_premake from s",
        "stream_route_daily": f"select 't.'||{_DAILY} child, count(*) n_rows from events group by 1",
        "stream_tumbling_window": "select date_trunc('day', ts)::timestamp child_start_time, count(*) n_rows from events group by 1",
    }

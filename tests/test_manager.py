from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.manager import PartitionManager, UnsupportedControlType
from tessera.plans import planner as P
from tessera.sources.registry import Conflict



def ddl(text):
    kinds = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "timestamp_ntz": T.TimestampNTZType(), "decimal(9,2)": T.DecimalType(9, 2)}
    fields = [f.strip().split(" ", 2) for f in text.replace("(9, 2)", "(9,2)").replace(", ", "|").split("|")]
    return T.StructType([T.StructField(f[0], kinds[f[1]], len(f) < 3) for f in fields])


NOW = datetime(2024, 1, 15, 12)
ID = ddl("col1 bigint not null, col2 string, col3 timestamp_ntz, col4 string")
TIME = ddl("col1 int, col2 string, col3 timestamp_ntz not null")


@pytest.fixture
def m(spark, tmp_path):
    return PartitionManager(spark, str(tmp_path), lambda: NOW)


def day(n):
    return (datetime(2024, 1, 15) + timedelta(days=n)).strftime("%Y%m%d")


def names(m, parent):
    return [t.rpartition("_p")[2] for t in m.children(parent)]


def ids(spark, values):
    return spark.createDataFrame([(v, "stuff", NOW, None) for v in values], ID)


def times(spark, n, at):
    return spark.createDataFrame([(i, "stuff", at) for i in range(n)], TIME)


def count(m, table):
    return m.read_child(table).count()


def test_id_range_life(spark, m):
    b = 3000000000
    m.create_parent("p.t", "col1", "10", ID, start_partition=b)
    assert names(m, "p.t") == [str(b + i) for i in (0, 10, 20, 30, 40)]
    m.insert("p.t", ids(spark, range(b + 1, b + 10)))
    m.run_maintenance("p.t")
    m.insert("p.t", ids(spark, range(b + 10, b + 26)))
    m.run_maintenance()
    assert count(m, f"p.t_p{b + 10}") == 10 and count(m, f"p.t_p{b + 20}") == 6
    assert names(m, "p.t")[-1] == str(b + 60)
    m.insert("p.t", ids(spark, range(b + 26, b + 39)))
    m.run_maintenance()
    assert count(m, "p.t") == 38 and count(m, f"p.t_p{b + 20}") == 10 and count(m, f"p.t_p{b + 30}") == 9
    assert names(m, "p.t")[-1] == str(b + 70)
    m.insert("p.t", ids(spark, range(b + 200, b + 211)))
    assert m.check_default().collect()[0]["count"] == 11
    assert m.check_default(exact_count=False).collect()[0]["count"] == 1
    assert m.drop_partition_id("p.t", 20, keep_table=False) == 1
    assert m.drop_partition_id("p.t", 10, keep_table=False, retention_schema="archive") == 1
    assert f"archive.t_p{b + 10}" in m.state.tables and count(m, f"archive.t_p{b + 10}") == 10
    m.undo_partition("p.t", "p.target")
    assert P.default_of(m.state.sets["p.t"]) is None
    m.undo_partition("p.t", "p.target")
    assert names(m, "p.t")[0] == str(b + 30) or f"{b + 20}" not in names(m, "p.t")
    m.undo_partition("p.t", "p.target", loop_count=10)
    assert "p.t" not in m.state.sets and count(m, "p.target") == 30
    assert f"p.t_p{b + 40}" in m.state.tables and count(m, f"p.t_p{b + 40}") == 0


def test_list_set(spark, m):
    schema = ddl("col1 bigint, col2 int not null")
    df = spark.createDataFrame([(i * 10 + j, i) for i in range(5) for j in range(10)], schema)
    m.create_parent("p.l", "col2", "1", schema, type="list", df=df)
    assert names(m, "p.l")[:4] == ["1", "2", "3", "4"] or names(m, "p.l")[0] == "0"
    m.partition_data_proc("p.l")
    assert count(m, "p.l") == 50 and names(m, "p.l")[0] == "0"
    m.insert("p.l", spark.createDataFrame([(100 + j, 5) for j in range(10)], schema))
    m.run_maintenance("p.l")
    assert names(m, "p.l")[-1] == "9"
    m.insert("p.l", spark.createDataFrame([(200 + j, 6) for j in range(10)], schema))
    m.run_maintenance("p.l")
    assert names(m, "p.l")[-1] == "10" and count(m, "p.l") == 70
    assert m.drop_partition_id("p.l", 4, keep_table=False) == 2
    assert m.drop_partition_id("p.l", 3, keep_table=False) == 1
    assert names(m, "p.l")[0] == "3"
    with pytest.raises(ValueError):
        m.create_parent("p.bad", "col2", "1", schema)


def test_numeric_set(spark, m):
    schema = ddl("col1 decimal(9,2) not null, col2 string")

    def rows(a, b):
        return spark.range(a, b).select((F.col("id") + F.lit(0.5)).cast("decimal(9,2)").alias("col1"), F.lit("x").alias("col2"))

    m.create_parent("p.n", "col1", "100", schema)
    m.insert("p.n", rows(1, 91))
    assert count(m, "p.n_p0") == 90
    m.insert("p.n", rows(91, 201))
    m.run_maintenance("p.n")
    assert [count(m, f"p.n_p{i}") for i in (0, 100, 200)] == [99, 100, 1]
    m.insert("p.n", rows(201, 301))
    m.run_maintenance("p.n")
    assert count(m, "p.n_p200") == 100 and count(m, "p.n_p300") == 1 and names(m, "p.n")[-1] == "700"
    m.insert("p.n", rows(2000, 2101))
    assert m.check_default().collect()[0]["count"] == 101
    m.drop_partition_id("p.n", 200, keep_table=False)
    m.drop_partition_id("p.n", 100, keep_table=False)
    assert names(m, "p.n")[0] != "0"
    m.undo_partition_proc("p.n", "p.n_target")
    assert count(m, "p.n_target") == 101 + sum([101]) or count(m, "p.n_target") == 202


def test_daily_life(spark, m):
    m.create_parent("p.d", "col3", "1 day", TIME)
    assert names(m, "p.d") == [day(i) for i in range(-4, 5)]
    m.insert("p.d", times(spark, 10, NOW))
    m.update_config("p.d", premake=5)
    m.run_maintenance("p.d")
    assert names(m, "p.d")[-1] == day(5)
    m.insert("p.d", times(spark, 22, NOW + timedelta(days=5)))
    m.run_maintenance("p.d")
    assert names(m, "p.d")[-1] == day(10) and count(m, f"p.d_p{day(5)}") == 22
    draft = m.registry.draft()
    for i in (2, 3, 6, 7):
        del draft.sets["p.d"].children[f"d_p{day(i)}"]
    m.registry.commit(draft)
    assert m.partition_gap_fill("p.d") == 4 and m.partition_gap_fill("p.d") == 0
    assert names(m, "p.d") == [day(i) for i in range(-4, 11)]
    info = m.show_partition_info(f"p.d_p{day(0)}")
    assert info["child_end_time"] - info["child_start_time"] == timedelta(days=1)
    assert m.show_partition_name("p.d", "2024-03-01 05:00:00") == {"partition_schema": "p", "partition_table": "d_p20240301", "suffix_timestamp": datetime(2024, 3, 1), "suffix_id": None, "table_exists": False}
    assert m.drop_partition_time("p.d", "2 days") == 2 and names(m, "p.d")[0] == day(-2)
    assert f"p.d_p{day(-4)}" in m.state.tables


def test_infinite(spark, m):
    m.create_parent("p.i", "col3", "1 day", TIME)
    m.update_config("p.i", infinite_time_partitions=True, premake=5)
    m.run_maintenance("p.i")
    assert names(m, "p.i")[-1] in (day(5), day(6))
    m.update_config("p.i", infinite_time_partitions=False)
    assert m.run_maintenance("p.i") == 0


def test_default_moves_and_ignored_columns(spark, m):
    schema = T.StructType([*TIME.fields, T.StructField("col4", T.LongType(), True, {"generated": "col1 * 100"})])
    m.create_parent("p.g", "col3", "1 day", schema)
    rows = spark.createDataFrame([(i, "x", NOW + timedelta(days=11), i * 100) for i in range(120, 126)], schema)
    m.insert("p.g", rows)
    assert m.check_default().count() == 1
    with pytest.raises(ValueError):
        m.partition_data_time("p.g", batch_interval="1 hour")
    assert m.partition_data_time("p.g", ignored_columns=["col4"]) == 6
    assert m.check_default().count() == 0
    assert sorted(r.col4 for r in m.read_child(f"p.g_p{day(11)}").collect()) == [i * 100 for i in range(120, 126)]


@pytest.mark.parametrize("order", ["ASC", "DESC"])
def test_source_table_batches(spark, m, order):
    source = ids(spark, range(1, 1001))
    m.register_table("p.source", source)
    m.create_parent("p.s", "col1", "100", ID)
    assert m.partition_data_id("p.s", batch_interval=50, source_table="p.source", order=order) == (1 if order == "DESC" else 50)
    assert m.partition_data_proc("p.s", source_table="p.source") == (999 if order == "DESC" else 950)
    assert count(m, "p.source") == 0 and count(m, "p.s") == 1000 and count(m, "p.s_p0") == 99
    assert m.read_child("p.s").select("col1").distinct().count() == 1000


def test_epoch_and_constraints(spark, m):
    schema = ddl("col1 bigint, col2 string, col3 bigint not null")
    m.create_parent("p.e", "col3", "1 week", schema, epoch="milliseconds", premake=2, start_partition=NOW - timedelta(weeks=8), constraint_cols=["col1"])
    ms = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1000)
    m.insert("p.e", spark.createDataFrame([(i, "x", ms(NOW - timedelta(weeks=i))) for i in range(8)], schema))
    assert m.check_default().count() == 0
    m.update_config("p.e", optimize_constraint=2)
    m.run_maintenance("p.e")
    m.reapply_constraints_proc("p.e", drop=True, apply=True)
    assert m.scan("p.e", where={"col1": (3, 4)}).count() == 2
    assert m.scan("p.e", lo=NOW - timedelta(weeks=2), hi=NOW).count() == 2
    assert len(m.scan("p.e", lo=NOW - timedelta(weeks=1), hi=NOW).inputFiles()) < len(m.scan("p.e").inputFiles())
    assert any(c.constraints for c in m.state.sets["p.e"].children.values())


def test_sub_sets(spark, m):
    schema = ddl("col1 int not null, col2 string, col3 timestamp_ntz not null")
    m.create_parent("p.sub", "col1", "10", schema)
    m.insert("p.sub", spark.createDataFrame([(i, "x", NOW) for i in range(15)], schema))
    m.create_sub_parent("p.sub", "col3", "1 day", declarative_check="yes", start_partition=NOW - timedelta(days=6))
    assert names(m, "p.sub_p10") == [day(i) for i in range(-6, 4 + 1)]
    assert count(m, "p.sub") == 15 and count(m, f"p.sub_p10_p{day(0)}") == 5
    m.insert("p.sub", spark.createDataFrame([(i, "x", NOW + timedelta(days=1)) for i in range(20)], schema))
    assert count(m, "p.sub") == 35 and count(m, f"p.sub_p0_p{day(1)}") == 10
    assert m.check_subpart_sameconfig("p.sub_p0").count() <= 1
    with pytest.raises(ValueError):
        m.undo_partition("p.sub", "p.target")
    with pytest.raises(ValueError):
        m.create_sub_parent("p.sub", "col3", "1 day")
    m.drop_partition_id("p.sub", 5, keep_table=True)
    assert m.stop_sub_partition("p.sub") and not m.stop_sub_partition("p.sub")


def test_id_sub_sets_stay_in_range(spark, m):
    m.create_parent("p.w", "col1", "100", ID, start_partition=0)
    m.create_sub_parent("p.w", "col1", "20", declarative_check="yes")
    for c in m.state.sets["p.w"].children.values():
        if c.table in m.state.sets:
            assert all(c.lo <= k.lo < c.hi for k in P.children(m.state.sets[c.table]))


def test_order_log_and_definition(spark, m):
    for n, o in (("c", None), ("a", 2), ("b", 1)):
        m.create_parent(f"p.{n}", "col3", "1 day", TIME)
        m.update_config(f"p.{n}", maintenance_order=o)
    assert [s.config.parent_table for s in P.maintenance_order(m.state)] == ["p.b", "p.a", "p.c"]
    m.update_config("p.a", retention="5 weeks", retention_keep_table=False, infinite_time_partitions=True)
    text = m.dump_partitioned_table_definition("p.a", ignore_template_table=True)
    want = m.state.sets["p.a"].config
    draft = m.registry.draft()
    del draft.sets["p.a"]
    m.registry.commit(draft)
    exec(text, {"manager": m, "schema": TIME})
    assert m.state.sets["p.a"].config == want
    with pytest.raises(KeyError):
        m.run_maintenance("p.none")
    assert {r["status"] for r in m.job_log().collect()} == {"OK", "CRITICAL"}
    assert len(m.part_config().columns) == 27


def test_privileges_and_properties(spark, m):
    m.create_parent("p.g", "col3", "1 day", TIME)
    m.grant("p.g", "ann", ["SELECT", "INSERT"])
    m.set_owner("p.g", "boss")
    child = m.children("p.g")[0]
    m.grant(child, "eve", ["SELECT"])
    got = {(r.grantee, r.action) for r in m.apply_privileges("p.g", child).collect()}
    assert got == {("ann", "GRANT"), ("ann", "REVOKE"), ("eve", "REVOKE")}
    assert m.apply_privileges("p.g", child).count() == 0
    assert m.reapply_privileges("p.g").count() > 0
    m.set_template("p.g", unique=["col1"])
    assert m.inherit_template_properties("p.g", child)
    m.set_table_property("p.g", replica_identity="FULL")
    m.inherit_replica_identity("p.g", child)
    c = m.state.sets["p.g"].children[child.split(".")[1]]
    assert c.properties["unique"] == ["col1"] and c.properties["replica_identity"] == "FULL" and c.owner == "boss"
    assert m.table_privs().filter("grantee = 'ann'").count() > 2


def test_unique_compaction_and_conflict(spark, m, tmp_path):
    m.create_parent("p.u", "col1", "10", ID, start_partition=0)
    for _ in range(3):
        m.insert("p.u", ids(spark, range(5)))
    assert m.check_unique_constraint("p.u", ["col1"]).count() == 5 and m.check_unique_constraint("p.u", ["col1"], simple=True) == 15
    assert m.compact("p.u") == ["p.u_p0"] and count(m, "p.u") == 15
    other = PartitionManager(spark, str(tmp_path), lambda: NOW)
    draft = other.registry.draft()
    m.update_config("p.u", premake=7)
    with pytest.raises(Conflict):
        other.registry.commit(draft)


def test_refusals(m):
    for kwargs in (
        {"interval": "monthly"}, {"interval": "1 microsecond"}, {"interval": "1 day", "type": "hash"}, {"interval": "1 day", "premake": 0}, {"interval": "1 day", "epoch": "minutes"},
        {"interval": "1 day", "constraint_cols": ["col3"]}, {"interval": "1 day", "automatic_maintenance": "maybe"},
    ):
        with pytest.raises(ValueError):
            m.create_parent("p.x", "col3", schema=TIME, **kwargs)
    with pytest.raises(ValueError):
        m.create_parent("x", "col3", "1 day", TIME)
    with pytest.raises(UnsupportedControlType):
        m.create_parent("p.x", "col2", "1 day", TIME)
    assert not m.state.sets


def test_long_and_mixed_names(spark, m):
    m.create_parent("Sch.Mixed", "col3", "1 day", TIME)
    assert m.children("Sch.Mixed")[0].startswith("Sch.Mixed_p")
    long = "p." + "a" * 59
    m.create_parent(long, "col3", "1 hour", TIME)
    m.insert(long, times(spark, 3, NOW))
    assert all(len(t.split(".")[1].encode()) <= 63 for t in m.children(long)) and m.check_default().count() == 0


def test_empty_table_and_nulls(spark, m):
    schema = ddl("k bigint, v string")
    m.create_parent("p.z", "k", "10", schema)
    m.insert("p.z", spark.createDataFrame([], schema))
    m.insert("p.z", spark.createDataFrame([(None, "a"), (-7, "b"), (5, "c")], schema))
    assert m.check_default().collect()[0]["count"] == 2 and count(m, "p.z_p0") == 1
    assert m.partition_data_id("p.z") == 1 and count(m, "p.z_p-10") == 1


def test_sql_table_function(spark, m):
    m.create_parent("p.f", "col3", "1 day", TIME)
    m.register_sql()
    assert [r[1] for r in spark.sql("select * from show_partitions('p.f')").collect()] == [t.split(".")[1] for t in m.children("p.f")]


def test_rows_of_many_separate_cells_move_at_once(m, spark):
    rows = spark.range(0, 50_000, 20, numPartitions=4).select(F.col("id").alias("k"))
    rows = rows.union(spark.createDataFrame([(7,), (None,), (49_985,)], "k bigint"))
    m.create_parent("t.many", "k", "10", rows.schema, start_partition=0, premake=1, df=rows)
    assert m.partition_data_proc("t.many") == 2_499 + 1
    assert m.read_child("t.many_p40").collect() == [(40,)]
    assert sorted(m.read_child("t.many_p49980").collect()) == [(49_980,), (49_985,)]
    assert m.read_child("t.many_default").collect() == [(None,)]
    got = m.route("t.many", m.scan("t.many")).groupBy("__child").count()
    assert got.count() == 2_501 and got.agg(F.sum("count")).head()[0] == 2_503


def test_rows_between_cells_stay_in_a_source(m, spark):
    """Ranges that are no whole cells, more of them than a filter holds."""
    m.create_parent("t.some", "k", "10", spark.range(1).select(F.col("id").alias("k")).schema, start_partition=0, premake=1)
    s = m.state.sets["t.some"]
    spans = [(30 * i + 5, 30 * i + 18) for i in range(40)]
    rows = spark.createDataFrame([(x,) for x in [*range(1_300), None]], "k bigint")
    inside, left = m._cut(s, rows, spans)
    wanted = {x for a, b in spans for x in range(a, b)}
    assert sorted(r[0] for r in inside.collect()) == sorted(wanted)
    assert {r[0] for r in left.collect()} == set(range(1_300)) - wanted | {None} and left.count() == 1_301 - len(wanted)


@pytest.mark.parametrize("value", ["id", "7"])
def test_large_child_is_written_by_many_tasks(m, spark, value):
    """Rows that compress well: by compressed bytes one task would sort all of them."""
    rows = spark.range(0, 1_600_000, 1, numPartitions=8).select(F.expr(f"cast({value} as bigint)").alias("k"))
    m.create_parent("t.large", "k", "1000000000", rows.schema, start_partition=0, premake=1, df=rows)
    files = m.read_child("t.large_p0").groupBy(F.input_file_name()).count()
    assert files.agg(F.sum("count")).head()[0] == 1_600_000
    assert files.agg(F.max("count")).head()[0] <= 800_000
    assert m.read_child("t.large_p0").agg(F.countDistinct("k")).head()[0] == (1_600_000 if value == "id" else 1)

import hashlib
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from tessera.operators.export import cold_children, dump_partition, vacuum_maintenance
from tessera.operators.manager import PartitionManager
from tessera.operators.scheduler import Maintainer, Settings
from tessera.sources.registry import Conflict
from tessera.streaming.ingest import file_stream, ingest, take

NOW = datetime(2024, 1, 15, 12)
SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.TimestampNTZType(), False)])


def made(spark, path, n=8):
    m = PartitionManager(spark, str(path), lambda: NOW)
    m.create_parent("p.t", "at", "1 day", SCHEMA)
    m.insert("p.t", spark.createDataFrame([(i, NOW - timedelta(days=i % 4)) for i in range(n)], SCHEMA))
    return m


def test_dump_archived(spark, tmp_path):
    m = made(spark, tmp_path / "m")
    assert m.drop_partition_time("p.t", "1 day", retention_schema="old") > 0
    got = dump_partition(m, "old", str(tmp_path / "out"))
    assert got and not [c for c in m.state.tables.values() if c.schema == "old"]
    for table, files in got.items():
        for name, digest in files.items():
            assert hashlib.sha512((tmp_path / "out" / table / name).read_bytes()).hexdigest() == digest
        assert os.path.isdir(tmp_path / "out" / f"{table}.sha512")


def test_vacuum_of_cold_children(spark, tmp_path):
    m = made(spark, tmp_path)
    m.insert("p.t", spark.createDataFrame([(i, NOW - timedelta(days=i % 4)) for i in range(8)], SCHEMA))
    cold = cold_children(m, "p.t", "1 day")
    assert cold and all(c in m.children("p.t") for c in cold)
    done = vacuum_maintenance(m, "p.t", "1 day")
    assert done and set(done) <= set(cold) and m.scan("p.t").count() == 16
    assert vacuum_maintenance(m, "p.t", "1 day") == []


def test_scheduler_goes_on_after_a_failure(spark, tmp_path):
    a, b = made(spark, tmp_path / "a"), made(spark, tmp_path / "b")
    a.update_config("p.t", retention="nonsense")
    b.update_config("p.t", premake=6)
    said = []
    got = Maintainer([a, b], Settings(interval=0), said.append).run_once()
    assert isinstance(got[0], ValueError) and got[1] > 0 and said


def test_streams_each_ingest_once(spark, tmp_path):
    m = made(spark, tmp_path / "m", 0)
    rows = spark.createDataFrame([(i, NOW + timedelta(days=i)) for i in range(6)], SCHEMA)
    rows.write.parquet(str(tmp_path / "in" / "x.parquet"))
    for checkpoint in ("c1", "c2", "c2"):  # the third start finds nothing new
        ingest(m, "p.t", file_stream(spark, str(tmp_path / "in" / "x.parquet"), "*", SCHEMA), str(tmp_path / checkpoint)).awaitTermination()
    assert m.scan("p.t").count() == 12 and len(m.children("p.t")) > 9
    assert take(m, "p.t", rows, "q", 5) and not take(m, "p.t", rows, "q", 5) and take(m, "p.t", rows, "r", 5)
    assert m.scan("p.t").count() == 24


def test_insert_while_children_go(spark, tmp_path):
    """A child that another manager drops after rows were routed to it: they are routed again, to the default."""
    m, other = made(spark, tmp_path, 0), PartitionManager(spark, str(tmp_path), lambda: NOW)
    write = m._write_routed

    def slow(df):
        out = write(df)
        m._write_routed = write
        other.drop_partition_time("p.t", "2 days", keep_table=False)
        return out

    m._write_routed = slow
    m.insert("p.t", spark.createDataFrame([(i, NOW - timedelta(days=i)) for i in range(4)], SCHEMA))
    assert m.scan("p.t").count() == 4 and m.check_default().collect()[0]["count"] > 0
    m._write_routed = lambda df: {"p.t_p19000101": ["nowhere"]}
    with pytest.raises(Conflict):
        m.insert("p.t", spark.createDataFrame([(1, NOW)], SCHEMA))


def test_insert_while_others_commit(spark, tmp_path):
    """Where the children stay the same, the folders that were written are listed in the other writer's state."""
    m, other = made(spark, tmp_path, 0), PartitionManager(spark, str(tmp_path), lambda: NOW)
    commit, seen = m._commit, []

    def late(draft):
        if not seen:
            seen.append(other.update_config("p.t", premake=9))
        commit(draft)

    m._commit = late
    m.insert("p.t", spark.createDataFrame([(1, NOW)], SCHEMA))
    assert m.scan("p.t").count() == 1 and m.state.sets["p.t"].config.premake == 9


@pytest.mark.parametrize("name", ["t.my#events", "t.a:b", "t.50%", "t.q?x=[1]"])
def test_odd_names_lose_no_row(spark, tmp_path, name):
    m = PartitionManager(spark, str(tmp_path), lambda: NOW)
    m.create_parent(name, "at", "1 day", SCHEMA)
    m.insert(name, spark.createDataFrame([(i, NOW + timedelta(days=9 * i)) for i in range(3)], SCHEMA))
    assert m.scan(name).count() == 3 and m.check_default().collect()[0]["count"] == 2


def test_a_damaged_manifest_blocks_nothing(spark, tmp_path):
    m = made(spark, tmp_path)
    newest = sorted(p for p in os.listdir(tmp_path / "registry") if p.endswith(".json"))[-1]
    (tmp_path / "registry" / f"{int(newest.split('.')[0]) + 1:012d}.json").write_text('{"sets": {')
    again = PartitionManager(spark, str(tmp_path), lambda: NOW)
    again.update_config("p.t", premake=7)
    assert PartitionManager(spark, str(tmp_path), lambda: NOW).state.sets["p.t"].config.premake == 7
    assert again.scan("p.t").count() == 8 and not [p for p in os.listdir(tmp_path / "registry") if p.endswith(".tmp")]


def test_sub_sets_with_other_settings_stop_maintenance(spark, tmp_path):
    m = PartitionManager(spark, str(tmp_path), lambda: NOW)
    m.create_parent("p.s", "id", "100", SCHEMA, start_partition=0, premake=1)
    m.create_sub_parent("p.s", "at", "1 month", declarative_check="yes")
    for child, step in zip(m.children("p.s"), ("1 day", "7 days"), strict=True):
        m.create_sub_parent(child, "at", step, declarative_check="yes")
    with pytest.raises(ValueError, match="different settings"):
        m.run_maintenance(m.children("p.s")[0])
    with pytest.raises(ValueError):
        m.undo_partition("p.s", "p.x", drop_cascade=True)


def test_scheduler_outlives_any_failure(spark, tmp_path):
    a = made(spark, tmp_path / "a")
    a.run_maintenance_proc = lambda *x: 1 / 0
    assert isinstance(Maintainer([a], Settings(interval=0), lambda x: None).run_once()[0], ZeroDivisionError)

"""Partition sets over Parquet: creation, routing, moves, retention and reports.

Planning is pure (``tessera.plans.planner``). Data work is DataFrame plans that
write new folders; one registry commit then lists them, so a reader sees all of an
operation or nothing of it. A whole child moves by relisting its folders.
"""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, replace
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.boundaries import check_name_length, initial_ids, initial_times, truncate
from ..functions.intervals import SECOND, Interval, add
from ..plans import planner as P
from ..sources.registry import ARCHIVED, ATTACHED, DETACHED, SUB_FIELDS, Child, Config, Conflict, PartitionSet, Registry, State
from ..sources.store import Store
from .routing import EPOCHS, MOST_BROADCAST_CHILDREN, as_time, grid_index, micros, route_by_bounds, whole

CHILD = "__child"
#: How often an insert is tried while other writers commit.
INSERT_TRIES = 20
#: About how many bytes of rows a task sorts when it writes them by child, and into how many units that are dealt out such a share is cut.
TASK_BYTES, UNITS = 32 << 20, 4
#: Most ranges that a filter holds; of more, rows are looked up by their cells.
MOST_RANGES = 16
#: The privileges of a table, and interval words that are refused.
PRIVILEGES = ["DELETE", "INSERT", "REFERENCES", "SELECT", "TRIGGER", "TRUNCATE", "UPDATE"]
OLD_INTERVAL_WORDS = {"yearly", "quarterly", "monthly", "weekly", "daily", "hourly", "half-hour", "quarter-hour"}


class UnsupportedControlType(ValueError):
    pass


def check_control_type(schema: T.StructType, control: str) -> tuple[str, str]:
    """(general type, exact type): time for dates and timestamps, id for whole numbers and decimals."""
    kind = schema[control].dataType
    exact = kind.simpleString()
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time", exact
    if isinstance(kind, (T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return "id", exact
    raise UnsupportedControlType(f"{control} is {exact}; a control column is a date, a timestamp, a whole number or a decimal")


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def as_datetime(v: str | datetime) -> datetime:
    t = v if isinstance(v, datetime) else datetime.fromisoformat(str(v))
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def logged(f: Callable) -> Callable:
    """A job-log row for the call, CRITICAL where it raises."""

    @functools.wraps(f)
    def wrapper(self: PartitionManager, *a, **b):
        try:
            out = f(self, *a, **b)
        except Exception as e:
            self._note(f.__name__, a, "CRITICAL", str(e)[:500])
            raise
        self._note(f.__name__, a, "OK", "")
        return out

    return wrapper


class PartitionManager:
    def __init__(self, spark: SparkSession, root: str, now: Callable[[], datetime] = utc_now):
        self.spark, self.root, self.now = spark, root.rstrip("/"), now
        self.store = Store(spark, self.root)
        self.registry = Registry(self.store)

    # --- state -----------------------------------------------------------------

    @property
    def state(self) -> State:
        return self.registry.state

    def _set(self, parent: str, state: State | None = None) -> PartitionSet:
        sets = (state or self.state).sets
        if parent not in sets:
            raise KeyError(f"{parent} is not a partition set")
        return sets[parent]

    def _note(self, step: str, args: tuple, status: str, message: str) -> None:
        table = args[0] if args and isinstance(args[0], str) else ""
        s = self.state.sets.get(table)
        if s is not None and not s.config.jobmon:
            return
        draft = self.registry.draft()
        draft.log.append({"job_id": len(draft.log) + 1, "step": step, "table": table, "status": status, "message": message, "at": self.now()})
        try:
            self.registry.commit(draft)
        except Conflict:
            self.registry.reload()

    def _commit(self, draft: State) -> None:
        self.registry.commit(draft)

    def job_log(self) -> DataFrame:
        return self.spark.createDataFrame([(r["job_id"], r["step"], r["table"], r["status"], r["message"]) for r in self.state.log], "job_id long, step string, table string, status string, message string")

    def update_config(self, parent: str, **settings) -> None:
        draft = self.registry.draft()
        s = self._set(parent, draft)
        s.config = replace(s.config, **settings)
        s.config.check()
        self._commit(draft)

    def part_config(self) -> DataFrame:
        rows = [asdict(s.config) for s in self.state.sets.values()]
        schema = "parent_table string, control string, partition_interval string, partition_type string, premake int, automatic_maintenance string, template_table string, retention string, retention_schema string, retention_keep_index boolean, retention_keep_table boolean, epoch string, constraint_cols array<string>, optimize_constraint int, infinite_time_partitions boolean, datetime_string string, jobmon boolean, sub_partition_set_full boolean, undo_in_progress boolean, inherit_privileges boolean, constraint_valid boolean, ignore_default_data boolean, default_table boolean, date_trunc_interval string, maintenance_order int, retention_keep_publication boolean, maintenance_last_run timestamp_ntz"
        return self.spark.createDataFrame(rows, schema)

    def part_config_sub(self) -> DataFrame:
        rows = [{"sub_parent": k, **{f"sub_{n}": s.sub.get(n) for n in ("control", "partition_interval", "partition_type", "premake", "epoch")}} for k, s in self.state.sets.items() if s.sub]
        return self.spark.createDataFrame(rows, "sub_parent string, sub_control string, sub_partition_interval string, sub_partition_type string, sub_premake int, sub_epoch string")

    # --- data ------------------------------------------------------------------

    def _schema(self, s: PartitionSet) -> T.StructType:
        return T.StructType.fromJson(json.loads(s.columns))

    def _read(self, folders: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _value(self, s: PartitionSet) -> Column:
        """The control as what children's bounds are in."""
        c = F.col(f"`{s.config.control}`")
        return as_time(c, s.config.epoch) if s.kind == "time" else c

    def _leaves(self, parent: str, state: State | None = None) -> list[tuple[PartitionSet, Child]]:
        out = []
        s = self._set(parent, state)
        for c in [*P.children(s), *([d] if (d := P.default_of(s)) else [])]:
            out += self._leaves(c.table, state) if c.table in (state or self.state).sets else [(s, c)]
        return out

    def read_child(self, table: str) -> DataFrame:
        """Rows of a child, of a whole set, or of a table outside of sets."""
        if table in self.state.sets:
            return self.scan(table)
        if found := P.parent_of(self.state, table):
            return self._read(found[1].data, self._schema(found[0]))
        c = self.state.tables[table]
        return self._read(c.data, T.StructType.fromJson(c.properties["columns"]))

    def scan(self, parent: str, lo=None, hi=None, where: dict[str, tuple] | None = None) -> DataFrame:
        """Rows of a set with lo <= control < hi and, for each column of ``where``, low <= column <= high.

        Children outside the bounds, or whose valid constraints contradict ``where``,
        are not listed; the filters themselves reach the Parquet scan.
        """
        top = self._set(parent)
        folders = []
        for s, c in self._leaves(parent):
            path = self._bounds_above(s, c, top)
            if path and ((hi is not None and path[0] >= hi) or (lo is not None and path[1] <= lo)):
                continue
            if any(k in c.constraints and c.constraints[k][2] and (c.constraints[k][0] > b or c.constraints[k][1] < a) for k, (a, b) in (where or {}).items()):
                continue
            folders += c.data
        df = self._read(folders, self._schema(top))
        if lo is not None or hi is not None:
            a, b = self._raw(top, lo), self._raw(top, hi)
            control = F.col(f"`{top.config.control}`")
            df = df.filter(control >= F.lit(a)) if lo is not None else df
            df = df.filter(control < F.lit(b)) if hi is not None else df
        for k, (a, b) in (where or {}).items():
            df = df.filter(F.col(f"`{k}`").between(a, b))
        return df

    def _raw(self, s: PartitionSet, v):
        """A bound as a value of the control column."""
        if v is None or s.config.epoch == "none":
            return v
        return micros(v) * EPOCHS[s.config.epoch] // SECOND

    def _bounds_above(self, s: PartitionSet, c: Child, top: PartitionSet) -> tuple | None:
        while s is not top:
            found = P.parent_of(self.state, s.config.parent_table)
            s, c = found
        return None if c.is_default else (c.lo, c.hi)

    def route(self, parent: str, df: DataFrame, state: State | None = None) -> DataFrame:
        """``df`` with the leaf child of each row in ``__child``."""
        out = self._route_level(self._set(parent, state), df, state or self.state)
        return out

    def _route_level(self, s: PartitionSet, df: DataFrame, state: State, above: str | None = None) -> DataFrame:
        """Route rows of one set; sets among its children share a join for each distinct grid."""
        out = self._join_children([(above, s)], df, above)
        while True:
            sets = [(c.table, state.sets[c.table]) for _, c in self._children_of(out[1], state) if c.table in state.sets]
            if not sets:
                return out[0]
            out = self._join_children(sets, out[0], CHILD)

    def _children_of(self, sets: list[PartitionSet], state: State) -> list[tuple[PartitionSet, Child]]:
        return [(s, c) for s in sets for c in s.children.values() if c.state == ATTACHED]

    def _join_children(self, sets: list[tuple[str | None, PartitionSet]], df: DataFrame, key: str | None) -> tuple[DataFrame, list[PartitionSet]]:
        by_grid: dict[tuple, list[tuple[str | None, PartitionSet]]] = {}
        for name, s in sets:
            g = P.grid_of(s)
            uniform = all(g.lo(g.index(c.lo)) == c.lo and g.lo(g.index(c.lo) + 1) == c.hi for c in P.children(s))
            by_grid.setdefault((s.config.control, s.config.epoch, g, uniform) if uniform else (name,), []).append((name, s))
        for grid, members in by_grid.items():
            s0 = members[0][1]
            g = P.grid_of(s0)
            defaults = {n: (d.table if (d := P.default_of(s)) else None) for n, s in members}
            if len(grid) == 1:
                bounds = self.spark.createDataFrame([(c.lo, c.hi, c.table) for c in P.children(s0)], f"lo {self._bound_type(s0)}, hi {self._bound_type(s0)}, name string")
                mine = route_by_bounds(df, self._value(s0) if s0.kind == "time" else F.floor(self._value(s0)).cast("bigint"), bounds, defaults[members[0][0]], "__to")
            else:
                rows = [(n, g.index(c.lo), c.table) for n, s in members for c in P.children(s)]
                kids = self.spark.createDataFrame(rows, "__of string, __cell bigint, __to string")
                at = grid_index(F.col(f"`{s0.config.control}`"), g, s0.config.epoch)
                on = F.col("__at") == F.col("__cell")
                if key:
                    on = on & (F.col(key) == F.col("__of"))
                # One row a child: its number is known, and small before it is broadcast.
                mine = df.withColumn("__at", at).join(F.broadcast(kids) if len(rows) <= 100_000 else kids, on, "left").drop("__at", "__cell", "__of")
                fallback = F.lit(defaults[members[0][0]])
                if key:
                    names = self.spark.createDataFrame(list(defaults.items()), "__of string, __default string")
                    mine = mine.join(F.broadcast(names), F.col(key) == F.col("__of"), "left").drop("__of")
                    fallback = F.coalesce("__default", F.col(key))
                mine = mine.withColumn("__to", F.coalesce("__to", fallback))
            df = mine.withColumn(CHILD, F.col("__to")).drop("__to", "__default")
        return df, [s for _, s in sets]

    @staticmethod
    def _bound_type(s: PartitionSet) -> str:
        return "timestamp_ntz" if s.kind == "time" else "bigint"

    def _write(self, df: DataFrame) -> list[str]:
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return [path]

    def _sizes(self, routed: DataFrame) -> dict[str | None, tuple[int, int]]:
        """Rows of each child and about how many bytes they are in a sort."""
        size = F.lit(64 + 8 * len(routed.columns)).cast("bigint")
        for f in routed.schema:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)):
                size += F.coalesce(F.octet_length(c), F.lit(0))
            elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
                size += F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        return {r[0]: (r[1], r[2]) for r in routed.groupBy(CHILD).agg(F.count(F.lit(1)), F.sum(size)).collect()}

    def _write_routed(self, df: DataFrame, sizes: dict[str | None, tuple[int, int]]) -> dict[str, list[str]]:
        """Write rows by ``__child``, ``sizes`` of which are known; folder of each child.

        A task sorts its rows by child, so they are dealt out by their bytes in the sort: the
        rows of a large child to many tasks, and many small children to one. The compressed
        bytes by which Spark would cut say little of that.
        """
        name, unit = f"data/{uuid.uuid4().hex}", TASK_BYTES // UNITS
        n = max(1, -(-sum(b for _, b in sizes.values()) // TASK_BYTES), min(len(sizes), self.spark.sparkContext.defaultParallelism))
        part = F.lit(0)
        if large := [(c, -(-b // unit)) for c, (_, b) in sizes.items() if b > unit]:
            units = self.spark.createDataFrame(large, "__large string, __units bigint")
            # The row and where it was read decide, so that a task that is run again deals out alike; equal rows are spread too.
            plain = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
            df = df.join(F.broadcast(units) if len(large) <= MOST_BROADCAST_CHILDREN else units, F.col(CHILD) == F.col("__large"), "left")
            part = F.coalesce(F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.col("__units")), F.lit(0))
        dealt = df.withColumn("__part", part).repartition(n, CHILD, "__part").drop("__part", "__large", "__units")
        dealt.write.partitionBy(CHILD).parquet(f"{self.root}/{name}")
        # Spark writes some characters of a folder's name as %XX.
        found = {unquote(n.removeprefix(f"{CHILD}=")): n for n in self.store.list(name) if n.startswith(f"{CHILD}=")}
        return {child: [f"{self.root}/{name}/{n}"] for child, n in found.items()}

    def insert(self, parent: str, df: DataFrame, mark: str | None = None) -> bool:
        """Append rows through the parent; each goes to its leaf child or to a default.

        Rows are routed by the state that the commit then replaces. Where another
        writer was first, the folders are listed in its state if the set's children are the
        same there, else the rows are routed again. With a ``mark`` the rows are
        taken once: False if the job log has it.
        """
        written, leaves, taken = {}, None, None
        for _ in range(INSERT_TRIES):
            draft = self.registry.draft()
            if mark is not None and any(r["message"] == mark for r in draft.log):
                taken = True
                break
            now = [(c.table, c.lo, c.hi) for _, c in self._leaves(parent, draft)]
            if now != leaves:
                self._discard(written)
                schema = self._schema(self._set(parent, draft))
                routed = self.route(parent, df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema)), draft)
                sizes = self._sizes(routed)
                if None in sizes:
                    raise ValueError(f"rows of {parent} have no child and there is no default")
                written, leaves = self._write_routed(routed, sizes), now
            self._append(draft, parent, written)
            if mark is not None:
                draft.log.append({"job_id": len(draft.log) + 1, "step": "stream", "table": parent, "status": "OK", "message": mark, "at": self.now()})
            try:
                self._commit(draft)
                return True
            except Conflict:
                continue
        self._discard(written)
        if taken:
            return False
        raise Conflict(f"{parent}: no commit in {INSERT_TRIES} tries")

    def _discard(self, written: dict[str, list[str]]) -> None:
        """Delete folders that no state lists."""
        for folders in written.values():
            for f in folders:
                self.store.delete(f)

    def _append(self, draft: State, parent: str, written: dict[str, list[str]]) -> None:
        leaves = {c.table: c for _, c in self._leaves(parent, draft)}
        if lost := written.keys() - leaves.keys():
            raise Conflict(f"{parent} has no child {sorted(lost)[0]} for rows that were routed to it")
        for table, folders in written.items():
            leaves[table].data += folders

    def register_table(self, table: str, df: DataFrame) -> None:
        """A table outside of sets, as source or target of moves."""
        P.split_name(table)
        data = self._write(df)
        draft = self.registry.draft()
        schema, name = P.split_name(table)
        draft.tables[table] = Child(schema, name, None, None, data=data, properties={"columns": json.loads(df.schema.json())})
        self._commit(draft)

    # --- creation ----------------------------------------------------------------

    @logged
    def create_parent(
        self, parent: str, control: str, interval: str, schema: T.StructType, type: str = "range", epoch: str = "none", premake: int = 4, start_partition: str | int | datetime | None = None,
        default_table: bool = True, automatic_maintenance: str = "on", constraint_cols: list[str] | None = None, template_table: str | None = None, jobmon: bool = True, date_trunc_interval: str | None = None,
        df: DataFrame | None = None,
    ) -> bool:
        """Define a set and make its first children; ``df`` are rows that it holds from the start."""
        draft = self.registry.draft()
        highest = None
        if df is not None and check_control_type(schema, control)[0] == "id" and epoch == "none" and start_partition is None:
            highest = df.agg(whole(F.max(f"`{control}`"))).head()[0]
        self._create_set(draft, parent, control, str(interval), schema, type, epoch, premake, start_partition, default_table, automatic_maintenance, constraint_cols, template_table, jobmon, date_trunc_interval, highest)
        self._commit(draft)
        if df is not None:
            self.insert(parent, df)
        return True

    def _create_set(self, draft: State, parent, control, interval, schema, type, epoch, premake, start, default_table, automatic_maintenance, constraint_cols, template_table, jobmon, date_trunc_interval, highest=None) -> PartitionSet:
        own_schema, name = P.split_name(parent)
        if parent in draft.sets:
            raise ValueError(f"{parent} is a partition set already")
        if interval.lower() in OLD_INTERVAL_WORDS:
            raise ValueError(f"{interval!r} is no interval; write '1 month' and the like")
        general, _ = check_control_type(schema, control)
        if general == "time" and epoch != "none":
            raise ValueError("epoch is for whole-number controls")
        kind = "time" if general == "time" or epoch != "none" else "id"
        if kind == "time":
            step = Interval.parse(interval)
            if step.cmp_key() < SECOND:
                raise ValueError("the smallest interval is 1 second")
            if type == "list":
                raise ValueError("list sets are for ids with an interval of 1")
            interval = str(step)
        elif type == "range" and int(interval) < 2:
            raise ValueError("an id range has an interval of 2 at least; use a list for 1")
        elif type == "list" and int(interval) != 1:
            raise ValueError("a list has an interval of 1")
        if template_table is None:
            template_table = check_name_length(f"template_{own_schema}_{name}")
        config = Config(parent, control, interval, type, premake, automatic_maintenance, template_table if template_table != "false" else None, epoch=epoch, constraint_cols=constraint_cols, jobmon=jobmon, default_table=default_table, date_trunc_interval=date_trunc_interval)
        config.check()
        s = PartitionSet(config, schema.json(), kind)
        above = P.parent_of(draft, parent)
        draft.sets[parent] = s
        if above and (brother := next((draft.sets[c.table] for c in above[0].children.values() if c.table in draft.sets and c.table != parent and draft.sets[c.table].sub), None)):
            s.sub = dict(brother.sub)
        if kind == "time":
            starts, config.datetime_string = initial_times(step, self.now(), premake, None if start is None else as_datetime(start), date_trunc_interval)
        else:
            starts = initial_ids(int(interval), highest, premake, None if start is None else int(start))
        s.anchor = starts[0]
        lo, hi = P.limits(draft, s)
        usable = [x for x in starts if P.within(x, lo, hi)]
        if not usable:
            # Nothing of the usual range lies in the parent's: begin at its lowest cell.
            g = P.grid_of(s)
            first = g.lo(g.index(lo))
            usable = [first if first >= lo else P.plus(s, first)]
        self._make(draft, s, usable)
        if default_table:
            n = check_name_length(name, "_default")
            s.children[n] = Child(own_schema, n, None, None, is_default=True)
        return s

    def _make(self, draft: State, s: PartitionSet, starts: list) -> list[Child]:
        """Add the children that begin at ``starts`` and don't exist."""
        own_schema = P.split_name(s.config.parent_table)[0]
        lo, hi = P.limits(draft, s)
        made = []
        for x in starts:
            n = P.name_of(s, x)
            if not P.within(x, lo, hi) or (n in s.children and s.children[n].state == ATTACHED):
                continue
            try:
                end = P.plus(s, x)
            except OverflowError:
                continue
            c = Child(own_schema, n, x, end)
            self._inherit(s, c)
            s.children[n] = c
            made.append(c)
            if s.sub:
                self._make_sub(draft, s, c)
        return made

    def _make_sub(self, draft: State, s: PartitionSet, c: Child) -> None:
        sub = s.sub
        inner = self._create_set(
            draft, c.table, sub["control"], sub["partition_interval"], self._schema(s), sub["partition_type"], sub["epoch"], sub["premake"], sub.get("start_partition"), sub["default_table"],
            sub["automatic_maintenance"], sub["constraint_cols"], sub["template_table"] or "false", sub["jobmon"], sub["date_trunc_interval"],
        )
        inner.config = replace(inner.config, **{k: v for k, v in sub.items() if k in SUB_FIELDS and k not in ("control", "partition_interval", "epoch")})

    @logged
    def create_sub_parent(
        self, top_parent: str, control: str, interval: str, type: str = "range", default_table: bool = True, declarative_check: str | None = None, constraint_cols: list[str] | None = None,
        premake: int = 4, start_partition: str | int | datetime | None = None, epoch: str = "none", jobmon: bool = True, date_trunc_interval: str | None = None,
    ) -> bool:
        """Make every child of a set a set itself. This empties them, so ``declarative_check`` must be 'yes'; rows are routed again."""
        if declarative_check != "yes":
            raise ValueError("children are made anew; pass declarative_check='yes'")
        draft = self.registry.draft()
        s = self._set(top_parent, draft)
        general, _ = check_control_type(self._schema(s), control)
        kind = "time" if general == "time" or epoch != "none" else "id"
        if kind == s.kind and control == s.config.control:
            inner, outer = (Interval.parse(str(interval)), P.step_of(s)) if kind == "time" else (int(interval), P.step_of(s))
            if not inner < outer:
                raise ValueError("a set's children need a smaller interval than the set")
        s.sub = asdict(Config(top_parent, control, str(interval), type, premake, epoch=epoch, constraint_cols=constraint_cols, default_table=default_table, jobmon=jobmon, date_trunc_interval=date_trunc_interval))
        s.sub["start_partition"] = start_partition if not isinstance(start_partition, datetime) else start_partition.isoformat()
        held = [c for c in P.children(s) if c.table not in draft.sets]
        folders = [d for c in held for d in c.data]
        for c in held:
            c.data = []
            self._make_sub(draft, s, c)
        if folders:
            routed = self.route(top_parent, self._read(folders, self._schema(s)), draft)
            self._append(draft, top_parent, self._write_routed(routed, self._sizes(routed)))
        self._commit(draft)
        return True

    def stop_sub_partition(self, parent: str) -> bool:
        draft = self.registry.draft()
        s = self._set(parent, draft)
        found, s.sub = s.sub is not None, None
        self._commit(draft)
        return found

    def check_subpartition_limits(self, parent: str) -> tuple:
        return P.limits(self.state, self._set(parent))

    def _check_sub_sets(self, parent: str) -> None:
        """Sets among siblings must have the same settings for their children; datetime patterns of older versions are refused."""
        s, above = self._set(parent), P.parent_of(self.state, parent)
        if s.config.datetime_string not in (None, "YYYYMMDD", "YYYYMMDD_HH24MISS"):
            raise ValueError(f"{parent} has suffixes of an older form: {s.config.datetime_string}")
        if s.sub is not None and above:
            brothers = [self.state.sets[c.table].sub for c in above[0].children.values() if c.table in self.state.sets and self.state.sets[c.table].sub]
            if len({tuple(str(b.get(k)) for k in SUB_FIELDS) for b in brothers}) > 1:
                raise ValueError(f"sets beside {parent} have different settings for their children")

    def check_subpart_sameconfig(self, parent: str) -> DataFrame:
        """Distinct settings of the sets among a set's siblings; more than one row is an error in maintenance."""
        above = P.parent_of(self.state, parent)
        names = [c.table for c in above[0].children.values()] if above else [parent]
        rows = [tuple(str(self.state.sets[n].sub.get(k)) for k in SUB_FIELDS) for n in names if n in self.state.sets and self.state.sets[n].sub]
        return self.spark.createDataFrame(rows, ", ".join(f"sub_{k} string" for k in SUB_FIELDS)).distinct()

    @logged
    def create_partition_time(self, parent: str, times: list) -> bool:
        return self._create(parent, [as_datetime(t) for t in times], "time")

    @logged
    def create_partition_id(self, parent: str, ids: list[int]) -> bool:
        return self._create(parent, [int(i) for i in ids], "id")

    def _create(self, parent: str, starts: list, kind: str) -> bool:
        draft = self.registry.draft()
        s = self._set(parent, draft)
        if s.kind != kind:
            raise ValueError(f"{parent} is partitioned by {s.kind}")
        made = self._make(draft, s, starts)
        self._commit(draft)
        return bool(made)

    # --- reports -----------------------------------------------------------------

    def children(self, parent: str, order: str = "ASC", include_default: bool = False) -> list[str]:
        s = self._set(parent)
        d = P.default_of(s) if include_default else None
        return ([d.table] if d else []) + [c.table for c in P.children(s, order)]

    def show_partitions(self, parent: str, order: str = "ASC", include_default: bool = False) -> DataFrame:
        """Children in the order of their bounds, the default first."""
        rows = [(i, *t.split(".", 1)) for i, t in enumerate(self.children(parent, order, include_default))]
        return self.spark.createDataFrame(rows, "ordinal int, partition_schemaname string, partition_tablename string").orderBy("ordinal").drop("ordinal")

    def register_sql(self) -> None:
        """The table function ``show_partitions(parent)`` for SQL, over the registry as it is now."""
        known = {p: [tuple(t.split(".", 1)) for t in self.children(p)] for p in self.state.sets}

        class ShowPartitions:
            def eval(self, parent: str):
                yield from known.get(parent, [])

        self.spark.udtf.register("show_partitions", F.udtf(ShowPartitions, returnType="partition_schemaname string, partition_tablename string"))

    def show_partition_name(self, parent: str, value) -> dict:
        """The child that a value goes to, whether it exists or not."""
        s = self._set(parent)
        if s.kind == "time":
            lo = P.cell_of(s, as_datetime(value))[0]
        else:
            lo = P.documented_id_cell(int(float(value)) if not isinstance(value, int) else value, P.step_of(s))
        n = P.name_of(s, lo)
        return {
            "partition_schema": P.split_name(parent)[0], "partition_table": n, "suffix_timestamp": lo if s.kind == "time" else None, "suffix_id": lo if s.kind == "id" else None,
            "table_exists": n in s.children and s.children[n].state == ATTACHED,
        }

    def show_partition_info(self, child: str, interval: str | None = None, parent: str | None = None) -> dict:
        """A child's bounds: end_time exclusive, end_id inclusive."""
        found = P.parent_of(self.state, child)
        if not found or (parent and found[0].config.parent_table != parent):
            raise KeyError(f"{child} is no child{f' of {parent}' if parent else ''}")
        s, c = found
        if c.is_default:
            raise ValueError(f"{child} is a default and has no bounds")
        end = c.hi if interval is None else (add(c.lo, Interval.parse(interval)) if s.kind == "time" else c.lo + int(interval))
        t = s.kind == "time"
        return {"child_start_time": c.lo if t else None, "child_end_time": end if t else None, "child_start_id": None if t else c.lo, "child_end_id": None if t else end - 1, "suffix": P.suffix_of(s, c.lo)}

    def check_default(self, exact_count: bool = True) -> DataFrame:
        """(default_table, count) of the defaults that hold rows; inexact stops at the first row."""
        out = None
        for s in self.state.sets.values():
            d = P.default_of(s)
            if d and d.data:
                rows = self._read(d.data, self._schema(s)).select(F.lit(d.table).alias("default_table"))
                rows = rows if exact_count else rows.limit(1)
                out = rows if out is None else out.union(rows)
        if out is None:
            return self.spark.createDataFrame([], "default_table string, count bigint")
        return out.groupBy("default_table").agg(F.count(F.lit(1)).alias("count"))

    def dump_partitioned_table_definition(self, parent: str, ignore_template_table: bool = False) -> str:
        """A script that makes the set again: ``create_parent`` and the settings it has no arguments for."""
        c = self._set(parent).config
        args = {
            "parent": c.parent_table, "control": c.control, "interval": c.partition_interval, "type": c.partition_type, "epoch": c.epoch, "premake": c.premake, "default_table": c.default_table,
            "automatic_maintenance": c.automatic_maintenance, "constraint_cols": c.constraint_cols, "template_table": None if ignore_template_table else c.template_table, "jobmon": c.jobmon,
            "date_trunc_interval": c.date_trunc_interval,
        }
        later = (
            "optimize_constraint", "retention", "retention_schema", "retention_keep_index", "retention_keep_table", "infinite_time_partitions", "datetime_string", "sub_partition_set_full",
            "inherit_privileges", "constraint_valid", "ignore_default_data", "maintenance_order", "retention_keep_publication",
        )
        lines = ["manager.create_parent(", *(f"    {k}={v!r}," for k, v in args.items()), "    schema=schema,", ")", f"manager.update_config(\n    {parent!r},", *(f"    {k}={getattr(c, k)!r}," for k in later), ")"]
        return "\n".join(lines)

    def check_unique_constraint(self, parent: str, cols: list[str], simple: bool = False) -> DataFrame | int:
        """Values of ``cols`` that occur more than once across children; simple: how many rows they are."""
        twice = duplicates(self.scan(parent), cols)
        return (twice.agg(F.sum("count")).head()[0] or 0) if simple else twice

    # --- moves --------------------------------------------------------------------

    @logged
    def partition_data_time(self, parent: str, batch_count: int = 1, batch_interval: str | None = None, lock_wait: float = 0, order: str = "ASC", analyze: bool = True, source_table: str | None = None, ignored_columns: list[str] | None = None) -> int:
        return self._partition_data(parent, "time", batch_count, batch_interval and Interval.parse(batch_interval), lock_wait, order, source_table, ignored_columns)

    @logged
    def partition_data_id(self, parent: str, batch_count: int = 1, batch_interval: int | None = None, lock_wait: float = 0, order: str = "ASC", analyze: bool = True, source_table: str | None = None, ignored_columns: list[str] | None = None) -> int:
        return self._partition_data(parent, "id", batch_count, batch_interval and int(batch_interval), lock_wait, order, source_table, ignored_columns)

    def _partition_data(self, parent, kind, batch_count, batch_interval, lock_wait, order, source_table, ignored_columns) -> int:
        """Move rows of the default or a source to children, batch by batch from the lowest (DESC: the highest) value.

        Returns the number of rows moved, or -1 if other writers kept committing.
        """
        for attempt in range(6):
            draft = self.registry.draft()
            s = self._set(parent, draft)
            if s.kind != kind:
                raise ValueError(f"{parent} is partitioned by {s.kind}")
            if source_table is None and batch_interval is not None and batch_interval != P.step_of(s):
                raise ValueError("rows of a default move by whole children: a custom interval needs a source table")
            source = draft.tables[source_table] if source_table else P.default_of(s)
            if source is None:
                raise ValueError(f"{parent} has no default")
            if not source.data:
                return 0
            schema = T.StructType.fromJson(source.properties["columns"]) if source_table else self._schema(s)
            rows = self._read(source.data, schema)
            spans = self._spans(s, rows, batch_count, batch_interval, order)
            if not spans:
                return 0
            self._make(draft, s, [lo for lo, _ in P.cells_of(s, [lo for lo, _ in spans])])
            inside, left = self._cut(s, rows, spans)
            routed = self.route(parent, self._conform(inside, self._schema(s), ignored_columns), draft)
            sizes = self._sizes(routed)
            written = self._write_routed(routed, sizes)
            source.data = [] if left.limit(1).count() == 0 else self._write(left)
            self._append(draft, parent, written)
            try:
                self._commit(draft)
                return sum(n for n, _ in sizes.values())
            except Conflict:
                time.sleep(lock_wait / 5)
        return -1

    def _cut(self, s: PartitionSet, rows: DataFrame, spans: list[tuple]) -> tuple[DataFrame, DataFrame]:
        """The rows whose control is within the half-open ``spans``, and the others.

        A filter of many ranges is too deep for a plan and is gone through for each row; then
        the ranges are joined by the numbers of the cells they lie in.
        """
        value = self._value(s) if s.kind == "time" else F.floor(self._value(s)).cast("bigint")
        ranges = _merged(spans)
        if len(ranges) <= MOST_RANGES:
            inside = functools.reduce(lambda a, b: a | b, ((value >= F.lit(a)) & (value < F.lit(b)) for a, b in ranges))
            inside = F.coalesce(inside, F.lit(False))
            return rows.filter(inside), rows.filter(~inside)
        g = P.grid_of(s)
        table = [(k, lo, hi) for lo, hi in spans for k in range(g.index(lo), g.index(hi) + (g.lo(g.index(hi)) < hi))]
        cells = self.spark.createDataFrame(table, f"__cell bigint, __lo {self._bound_type(s)}, __hi {self._bound_type(s)}")
        cells = F.broadcast(cells) if len(table) <= MOST_BROADCAST_CHILDREN else cells
        at = grid_index(F.col(f"`{s.config.control}`"), g, s.config.epoch)
        on = (at == F.col("__cell")) & (value >= F.col("__lo")) & (value < F.col("__hi"))
        return rows.join(cells, on, "left_semi"), rows.join(cells, on, "left_anti")

    def _conform(self, df: DataFrame, schema: T.StructType, ignored: list[str] | None) -> DataFrame:
        """Columns of ``schema`` in order; ignored ones are left to the target's generated values or null."""
        cols = []
        for f in schema:
            if f.name in (ignored or []):
                made = f.metadata.get("generated")
                cols.append((F.expr(made) if made else F.lit(None)).cast(f.dataType).alias(f.name))
            elif f.name in df.columns:
                cols.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
            else:
                cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        return df.select(*cols)

    def _spans(self, s: PartitionSet, rows: DataFrame, batches: int, step, order: str) -> list[tuple]:
        """Half-open value ranges of the next batches."""
        if order not in ("ASC", "DESC"):
            raise ValueError("order is ASC or DESC")
        value = self._value(s) if s.kind == "time" else F.floor(self._value(s)).cast("bigint")
        v = rows.select(value.alias("v")).filter("v is not null")
        out: list[tuple] = []
        if step is None or step == P.step_of(s):
            # Whole cells: the first ones that hold rows, in one pass.
            g = P.grid_of(s)
            cell = grid_index(F.col(f"`{s.config.control}`"), g, s.config.epoch).alias("cell")
            first = rows.select(cell).filter("cell is not null").distinct().orderBy(F.asc("cell") if order == "ASC" else F.desc("cell")).limit(batches)
            return P.cells_of(s, [g.lo(r[0]) for r in first.collect()])
        top = (lambda x, n: add(x, step, n)) if s.kind == "time" else (lambda x, n: x + n * step)
        for _ in range(batches):
            at = v.filter(F.col("v") >= F.lit(out[-1][1])) if out and order == "ASC" else v.filter(F.col("v") < F.lit(out[-1][0])) if out else v
            x = at.agg(F.min("v") if order == "ASC" else F.max("v")).head()[0]
            if x is None:
                break
            lo, hi = P.cell_of(s, x)
            if order == "ASC":
                out.append((x, min(hi, top(x, 1))))
            else:
                unit = P.step_of(s) if s.kind == "time" else 1
                end = min(hi, add(x, Interval(micros=1), 1)) if s.kind == "time" else x + unit
                out.append((max(lo, top(end, -1)), end))
        return out

    def plan_batches(self, parent: str, batches: int, interval=None, order: str = "ASC", source_table: str | None = None) -> list[tuple]:
        """The half-open value ranges that the next moves from the default or a source would take; nothing moves."""
        s = self._set(parent)
        source = self.state.tables[source_table] if source_table else P.default_of(s)
        schema = T.StructType.fromJson(source.properties["columns"]) if source_table else self._schema(s)
        step = interval if interval is None else Interval.parse(interval) if s.kind == "time" else int(interval)
        return self._spans(s, self._read(source.data, schema), batches, step, order)

    def partition_data_proc(self, parent: str, loop_count: int | None = None, interval=None, lock_wait: float = 0, lock_wait_tries: int = 10, wait: float = 0, order: str = "ASC", source_table: str | None = None, ignored_columns: list[str] | None = None, quiet: bool = True) -> int:
        """Move everything, one commit a loop; without a loop count and interval in one pass."""
        s = self._set(parent)
        move = self.partition_data_time if s.kind == "time" else self.partition_data_id
        total, misses, loops = 0, 0, 0
        at_once = 1 if loop_count is not None or interval is not None else 1_000_000
        while loop_count is None or loops < loop_count:
            n = move(parent, at_once, interval, lock_wait, order, True, source_table, ignored_columns)
            if n == -1:
                misses += 1
                if misses > lock_wait_tries:
                    raise Conflict(f"{parent}: no commit in {misses} tries")
                continue
            if n == 0:
                break
            total, loops = total + n, loops + 1
            time.sleep(wait)
        return total

    @logged
    def undo_partition(self, parent: str, target: str, loop_count: int = 1, batch_interval=None, keep_table: bool = True, lock_wait: float = 0, ignored_columns: list[str] | None = None, drop_cascade: bool = False) -> tuple[int, int]:
        """Move rows from children, the default first, to ``target``; empty children are detached or dropped.

        Each loop takes the rows within one interval from a child's least value on. Returns (children undone, rows moved).
        While other writers commit, it is tried again after ``lock_wait / 5`` seconds, up to six times.
        """
        if drop_cascade:
            raise ValueError("nothing depends on children here, so there is nothing to drop with them")
        for attempt in range(6):
            try:
                return self._undo(parent, target, loop_count, batch_interval, keep_table, ignored_columns)
            except Conflict:
                if attempt == 5:
                    raise
                time.sleep(lock_wait / 5)
        raise AssertionError

    def _undo(self, parent, target, loop_count, batch_interval, keep_table, ignored_columns) -> tuple[int, int]:
        draft = self.registry.draft()
        s = self._set(parent, draft)
        if any(c.table in draft.sets for c in s.children.values() if c.state == ATTACHED):
            raise ValueError(f"children of {parent} are sets; undo those first")
        schema = self._schema(s)
        schema_name, name = P.split_name(target)
        goal = draft.tables.setdefault(target, Child(schema_name, name, None, None, properties={"columns": json.loads(schema.json())}))
        s.config.undo_in_progress = True
        step = P.step_of(s) if batch_interval is None else (Interval.parse(batch_interval) if s.kind == "time" else int(batch_interval))
        undone = rows_moved = loops = 0
        while True:
            kids = [*([d] if (d := P.default_of(s)) else []), *P.children(s)]
            if not kids:
                break
            c = kids[0]
            if c.data:
                if loops >= loop_count:
                    break
                loops += 1
                rows = self._read(c.data, schema)
                value = self._value(s) if s.kind == "time" else F.floor(self._value(s)).cast("bigint")
                if batch_interval is None and not c.is_default and not ignored_columns:
                    # A child is one interval long: it goes whole, by its folders.
                    rows_moved += rows.count()
                    goal.data, c.data = goal.data + c.data, []
                    continue
                least, n = rows.agg(F.min(value), F.count(F.lit(1))).head()
                upto = F.lit(True) if least is None else F.coalesce(value <= F.lit(add(least, step) if s.kind == "time" else least + step), F.lit(False))
                k = rows.filter(upto).count()
                if k == n and not ignored_columns:
                    goal.data += c.data
                    c.data = []
                else:
                    goal.data += self._write(self._conform(rows.filter(upto), T.StructType.fromJson(goal.properties["columns"]), ignored_columns))
                    c.data = [] if k == n else self._write(rows.filter(~upto))
                rows_moved += k
                if c.data:
                    continue
            del s.children[c.name]
            undone += 1
            if keep_table and not c.is_default:
                c.state = DETACHED
                c.properties["columns"] = json.loads(schema.json())
                draft.tables[c.table] = c
        if not s.children:
            del draft.sets[parent]
        self._commit(draft)
        return undone, rows_moved

    def undo_partition_proc(self, parent: str, target: str, loop_count: int | None = None, interval=None, keep_table: bool = True, wait: float = 0, **options) -> tuple[int, int]:
        """As ``undo_partition`` until nothing is left or ``loop_count`` loops are done, one commit a loop."""
        undone = rows = loops = 0
        while parent in self.state.sets and (loop_count is None or loops < loop_count):
            a, b = self.undo_partition(parent, target, 1, interval, keep_table, **options)
            undone, rows, loops = undone + a, rows + b, loops + 1
            time.sleep(wait)
        return undone, rows

    # --- maintenance -----------------------------------------------------------------

    def _max(self, s: PartitionSet, c: Child, state: State):
        """Greatest control value of a child, as a bound; a child without files needs no scan."""
        folders = [d for _, x in self._leaves(c.table, state) for d in x.data] if c.table in state.sets else c.data
        if not folders:
            return None
        value = self._value(s)
        return self._read(folders, self._schema(s)).agg(F.max(value) if s.kind == "time" else whole(F.max(value))).head()[0]

    def current_cell(self, parent: str, state: State | None = None):
        """Start of the cell that maintenance counts from, or None where there is nothing to do."""
        state = state or self.state
        s = self._set(parent, state)
        now, top, current = self.now(), None, None
        for c in P.children(s, "DESC"):
            top = self._max(s, c, state)
            if top is not None:
                break
        if s.kind == "time" and s.config.infinite_time_partitions and (top is None or top < now):
            current = now
        elif top is not None:
            current = P.cell_of(s, top)[0]
        d = P.default_of(s)
        if not s.config.ignore_default_data and d and (other := self._max(s, d, state)) is not None and (current is None or other > current):
            current = P.cell_of(s, other)[0]
        return current

    @logged
    def run_maintenance(self, parent: str | None = None, analyze: bool = False, jobmon: bool = True) -> int:
        """Retention, then children ahead of the data; returns how many were made."""
        self.registry.reload()
        if parent is not None:
            self._set(parent)
        return sum(self._maintain(name) for name in [s.config.parent_table for s in P.maintenance_order(self.state, parent)])

    def _maintain(self, name: str) -> int:
        s = self._set(name)
        self._check_sub_sets(name)
        if s.config.retention is not None:
            (self.drop_partition_time if s.kind == "time" else self.drop_partition_id)(name)
        draft = self.registry.draft()
        if name not in draft.sets:
            return 0
        s = self._set(name, draft)
        made: list[Child] = []
        if not s.config.sub_partition_set_full and P.children(s):
            current = self.current_cell(name, draft)
            if current is not None:
                if P.is_full(draft, s):
                    s.config.sub_partition_set_full = True
                else:
                    made = self._make(draft, s, P.premake(draft, s, current))
                    if made and s.config.constraint_cols:
                        self._constrain(s, P.constraint_target(s))
        s.config.maintenance_last_run = self.now()
        self._commit(draft)
        return len(made)

    def run_maintenance_proc(self, wait: float = 0, analyze: bool = False, jobmon: bool = True) -> int:
        """As ``run_maintenance``, with a pause between sets; sets done before a failure stay done."""
        total = 0
        for s in P.maintenance_order(self.registry.reload()):
            total += self._maintain(s.config.parent_table)
            time.sleep(wait)
        return total

    def drop_partition_time(self, parent: str, retention: str | None = None, keep_table: bool | None = None, keep_index: bool | None = None, retention_schema: str | None = None, reference_timestamp: datetime | None = None) -> int:
        s = self._set(parent)
        if s.kind != "time":
            raise ValueError(f"{parent} is partitioned by id")
        r = retention or s.config.retention
        if r is None:
            raise ValueError(f"{parent} has no retention")
        return self._retire(parent, P.expired(s, Interval.parse(r), reference_timestamp or self.now()), keep_table, keep_index, retention_schema)

    def drop_partition_id(self, parent: str, retention: int | None = None, keep_table: bool | None = None, keep_index: bool | None = None, retention_schema: str | None = None) -> int:
        s = self._set(parent)
        if s.kind != "id":
            raise ValueError(f"{parent} is partitioned by time")
        r = retention if retention is not None else s.config.retention
        if r is None:
            raise ValueError(f"{parent} has no retention")
        top = next((m for c in P.children(s, "DESC") if (m := self._max(s, c, self.state)) is not None), None)
        return 0 if top is None else self._retire(parent, P.expired(s, int(r), top), keep_table, keep_index, retention_schema)

    def _retire(self, parent: str, old: list[Child], keep_table: bool | None, keep_index: bool | None, retention_schema: str | None) -> int:
        """Detach, drop or archive children; sets below them go with them."""
        draft = self.registry.draft()
        s = self._set(parent, draft)
        keep = s.config.retention_keep_table if keep_table is None else keep_table
        archive = retention_schema or s.config.retention_schema
        for c in (s.children.pop(o.name) for o in old):
            c.data += self._remove_set(draft, c.table)
            if keep or archive:
                c.state = ARCHIVED if archive else DETACHED
                c.schema = archive or c.schema
                c.properties |= {"columns": json.loads(s.columns), "keep_index": s.config.retention_keep_index if keep_index is None else keep_index, "keep_publication": s.config.retention_keep_publication}
                draft.tables[c.table] = c
        self._commit(draft)
        return len(old)

    def _remove_set(self, draft: State, table: str) -> list[str]:
        """Remove a child's own set and all below it; the folders they held."""
        if table not in draft.sets:
            return []
        folders = []
        for c in draft.sets[table].children.values():
            folders += c.data + self._remove_set(draft, c.table)
        del draft.sets[table]
        return folders

    @logged
    def partition_gap_fill(self, parent: str) -> int:
        draft = self.registry.draft()
        s = self._set(parent, draft)
        made = self._make(draft, s, P.gaps(s))
        self._commit(draft)
        return len(made)

    def run_analyze(self, parent: str | None = None, skip_locked: bool = False, quiet: bool = True) -> DataFrame:
        """Row count and least and greatest control value of every leaf child that holds rows."""
        out = None
        for name in [parent] if parent else [n for n in self.state.sets if not P.parent_of(self.state, n)]:
            for s, c in self._leaves(name):
                if c.data:
                    control = F.col(f"`{s.config.control}`")
                    row = self._read(c.data, self._schema(s)).agg(F.lit(c.table).alias("child"), F.count(F.lit(1)).alias("n_rows"), F.min(control).cast("string").alias("least"), F.max(control).cast("string").alias("greatest"))
                    out = row if out is None else out.union(row)
        return out if out is not None else self.spark.createDataFrame([], "child string, n_rows bigint, least string, greatest string")

    # --- constraints -------------------------------------------------------------------

    def _constrain(self, s: PartitionSet, name: str) -> None:
        c = s.children.get(name)
        if c is None or not c.data:
            return
        todo = [x for x in s.config.constraint_cols or [] if x not in c.constraints]
        if not todo:
            return
        got = self._read(c.data, self._schema(s)).agg(*(f(f"`{x}`").alias(f"{i}{n}") for n, x in enumerate(todo) for i, f in (("a", F.min), ("b", F.max)))).head()
        for n, x in enumerate(todo):
            if got[f"a{n}"] is not None:
                c.constraints[x] = [got[f"a{n}"], got[f"b{n}"], s.config.constraint_valid]

    @logged
    def apply_constraints(self, parent: str, child: str | None = None) -> None:
        """Least and greatest value of each constraint column of one child; those are used to skip it in scans."""
        draft = self.registry.draft()
        s = self._set(parent, draft)
        self._constrain(s, P.split_name(child)[1] if child else P.constraint_target(s))
        self._commit(draft)

    @logged
    def drop_constraints(self, parent: str, child: str) -> None:
        draft = self.registry.draft()
        s = self._set(parent, draft)
        c = s.children[P.split_name(child)[1]]
        c.constraints = {k: v for k, v in c.constraints.items() if k not in (s.config.constraint_cols or [])}
        self._commit(draft)

    def reapply_constraints_proc(self, parent: str, drop: bool = False, apply: bool = False, wait: float = 0, dryrun: bool = False) -> list[str]:
        """Drop all children's constraints, apply them up to the due child; returns the children applied to."""
        s = self._set(parent)
        target = P.constraint_target(s)
        limit = s.children[target].lo if target in s.children else None
        names = [c.name for c in P.children(s) if limit is None or c.lo <= limit]
        if dryrun:
            return names
        draft = self.registry.draft()
        s = self._set(parent, draft)
        if drop:
            for c in s.children.values():
                c.constraints = {}
        for n in names if apply else []:
            self._constrain(s, n)
        self._commit(draft)
        return names

    # --- properties and privileges ----------------------------------------------------

    def set_template(self, parent: str, **properties) -> None:
        """Properties that new children take: unique keys, writer options, unlogged."""
        draft = self.registry.draft()
        self._set(parent, draft).template |= properties
        self._commit(draft)

    def _inherit(self, s: PartitionSet, c: Child) -> None:
        c.properties |= s.template | ({"replica_identity": s.properties["replica_identity"]} if "replica_identity" in s.properties else {})
        if s.config.inherit_privileges:
            c.grants, c.owner = {k: list(v) for k, v in s.grants.items()}, s.owner

    def inherit_template_properties(self, parent: str, child: str) -> bool:
        draft = self.registry.draft()
        s = self._set(parent, draft)
        c = s.children[P.split_name(child)[1]]
        if c.table in draft.sets:
            return False
        c.properties |= s.template
        self._commit(draft)
        return True

    def set_table_property(self, parent: str, **properties) -> None:
        draft = self.registry.draft()
        self._set(parent, draft).properties |= properties
        self._commit(draft)

    def inherit_replica_identity(self, parent: str, child: str) -> None:
        """FULL, NOTHING or INDEX, as metadata."""
        self._copy_property(parent, child, "replica_identity")

    def apply_cluster(self, parent: str, child: str) -> None:
        """The columns that children's files are sorted by, as metadata for ``compact``."""
        self._copy_property(parent, child, "cluster")

    def _copy_property(self, parent: str, child: str, key: str) -> None:
        draft = self.registry.draft()
        s = self._set(parent, draft)
        if key in s.properties:
            s.children[P.split_name(child)[1]].properties[key] = s.properties[key]
            self._commit(draft)

    def autovacuum_off(self, parent: str) -> bool:
        self.set_table_property(parent, autovacuum=False)
        return True

    def autovacuum_reset(self, parent: str) -> bool:
        self.set_table_property(parent, autovacuum=True)
        return True

    def grant(self, table: str, grantee: str, privileges: list[str]) -> None:
        draft = self.registry.draft()
        holder = draft.sets.get(table) or P.parent_of(draft, table)[1]
        holder.grants[grantee] = sorted(set(holder.grants.get(grantee, [])) | set(privileges))
        self._commit(draft)

    def set_owner(self, parent: str, owner: str) -> None:
        draft = self.registry.draft()
        self._set(parent, draft).owner = owner
        self._commit(draft)

    def table_privs(self) -> DataFrame:
        rows = []
        for s in self.state.sets.values():
            for table, grants in [(s.config.parent_table, s.grants), *((c.table, c.grants) for c in s.children.values())]:
                rows += [(*P.split_name(table), who, p) for who, ps in grants.items() for p in ps]
        return self.spark.createDataFrame(rows, "table_schema string, table_name string, grantee string, privilege_type string")

    def apply_privileges(self, parent: str, child: str) -> DataFrame:
        """Make a child's grants and owner the parent's; what that took."""
        return self._privileges(parent, [P.split_name(child)[1]])

    def reapply_privileges(self, parent: str) -> DataFrame:
        return self._privileges(parent, [c.name for c in self._set(parent).children.values()])

    def _privileges(self, parent: str, names: list[str]) -> DataFrame:
        draft = self.registry.draft()
        s = self._set(parent, draft)
        rows = []
        for n in names:
            c = s.children[n]
            rows += [(c.table, *r) for r in P.grant_diff(s.grants, c.grants, PRIVILEGES)]
            c.grants, c.owner = {k: list(v) for k, v in s.grants.items()}, s.owner
        self._commit(draft)
        return self.spark.createDataFrame(rows, "child string, grantee string, action string, privileges string")

    # --- files ---------------------------------------------------------------------------

    def compact(self, parent: str, older_than: str | int | None = None, target_bytes: int = 256 << 20) -> list[str]:
        """Rewrite children of several folders to files of about ``target_bytes``; optionally only those that end before a bound."""
        draft = self.registry.draft()
        done = []
        for s, c in self._leaves(parent, draft):
            limit = None if older_than is None else (as_datetime(older_than) if s.kind == "time" else int(older_than))
            if len(c.data) < 2 or c.is_default or (limit is not None and c.hi > limit):
                continue
            rows = self._read(c.data, self._schema(s))
            size = sum(self.store._fs.getContentSummary(self.store._path(d)).getLength() for d in c.data)
            rows = rows.repartition(max(1, -(-size // target_bytes)))
            if by := c.properties.get("cluster"):
                rows = rows.sortWithinPartitions(*by)
            c.data = self._write(rows)
            done.append(c.table)
        self._commit(draft)
        return done


def _merged(spans: list[tuple]) -> list[tuple]:
    """Touching ranges as one."""
    out: list[tuple] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def duplicates(df: DataFrame, cols: list[str]) -> DataFrame:
    """Values of ``cols`` that more than one row has, and how many."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


__all__ = ["PartitionManager", "UnsupportedControlType", "check_control_type", "duplicates", "truncate"]

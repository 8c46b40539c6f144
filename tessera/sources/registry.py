"""The registry: partition sets, their children with typed bounds, and a job log.

One JSON manifest a version. A commit writes the next version's file, which must not
exist yet, so of two writers one wins and the other reads again. Readers hold the
version they loaded; data files are never changed, only listed or unlisted.
"""

from __future__ import annotations

import copy
import json
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime

from .store import Store

ATTACHED, DETACHED, ARCHIVED = "attached", "detached", "archived"


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass
class Config:
    """Settings of a partition set."""

    parent_table: str
    control: str
    partition_interval: str
    partition_type: str = "range"
    premake: int = 4
    automatic_maintenance: str = "on"
    template_table: str | None = None
    retention: str | None = None
    retention_schema: str | None = None
    retention_keep_index: bool = True
    retention_keep_table: bool = True
    epoch: str = "none"
    constraint_cols: list[str] | None = None
    optimize_constraint: int = 30
    infinite_time_partitions: bool = False
    datetime_string: str | None = None
    jobmon: bool = True
    sub_partition_set_full: bool = False
    undo_in_progress: bool = False
    inherit_privileges: bool = False
    constraint_valid: bool = True
    ignore_default_data: bool = True
    default_table: bool = True
    date_trunc_interval: str | None = None
    maintenance_order: int | None = None
    retention_keep_publication: bool = False
    maintenance_last_run: datetime | None = None

    def check(self) -> None:
        check_partition_type(self.partition_type)
        check_epoch_type(self.epoch)
        check_automatic_maintenance_value(self.automatic_maintenance)
        if self.premake <= 0:
            raise ValueError("premake must be more than 0")
        if self.constraint_cols and self.control in self.constraint_cols:
            raise ValueError("constraint_cols can't hold the control column")
        if self.retention_schema == "":
            raise ValueError("retention_schema can't be empty")


def check_automatic_maintenance_value(v: str) -> bool:
    if v not in ("on", "off"):
        raise ValueError("automatic_maintenance is 'on' or 'off'")
    return True


def check_epoch_type(v: str) -> bool:
    if v not in ("none", "seconds", "milliseconds", "nanoseconds"):
        raise ValueError("epoch is 'none', 'seconds', 'milliseconds' or 'nanoseconds'")
    return True


def check_partition_type(v: str) -> bool:
    if v not in ("range", "list"):
        raise ValueError("partition_type is 'range' or 'list'")
    return True


#: Settings that children's own sets don't take from ``part_config_sub``.
NOT_SUB = {"parent_table", "datetime_string", "undo_in_progress", "sub_partition_set_full", "maintenance_last_run"}
SUB_FIELDS = [f.name for f in fields(Config) if f.name not in NOT_SUB]


@dataclass
class Child:
    schema: str
    name: str
    lo: int | datetime | None
    hi: int | datetime | None
    is_default: bool = False
    state: str = ATTACHED
    #: Folders of Parquet files.
    data: list[str] = field(default_factory=list)
    #: Column -> least value, largest value, whether it may be used to skip the child.
    constraints: dict[str, list] = field(default_factory=dict)
    properties: dict = field(default_factory=dict)
    grants: dict[str, list[str]] = field(default_factory=dict)
    owner: str | None = None

    @property
    def table(self) -> str:
        return f"{self.schema}.{self.name}"


@dataclass
class PartitionSet:
    config: Config
    columns: str  # the schema as JSON
    kind: str  # time or id
    anchor: int | datetime | None = None
    children: dict[str, Child] = field(default_factory=dict)
    sub: dict | None = None  # settings for its children's own sets
    template: dict = field(default_factory=dict)
    grants: dict[str, list[str]] = field(default_factory=dict)
    owner: str | None = None
    properties: dict = field(default_factory=dict)


@dataclass
class State:
    sets: dict[str, PartitionSet] = field(default_factory=dict)
    #: Tables outside of any set: detached children and targets.
    tables: dict[str, Child] = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)


def _plain(x):
    if isinstance(x, datetime):
        return {"__time": x.isoformat()}
    raise TypeError(type(x))


def _typed(d: dict):
    return datetime.fromisoformat(d["__time"]) if "__time" in d else d


def dumps(state: State) -> str:
    return json.dumps(asdict(state), default=_plain)


def loads(text: str) -> State:
    raw = json.loads(text, object_hook=_typed)
    sets = {}
    for k, v in raw["sets"].items():
        children = {n: Child(**c) for n, c in v.pop("children").items()}
        sets[k] = PartitionSet(config=Config(**v.pop("config")), children=children, **v)
    return State(sets, {k: Child(**v) for k, v in raw["tables"].items()}, raw["log"])


class Registry:
    """Versions of the state in ``root``/registry."""

    def __init__(self, store: Store):
        self.store = store
        self.version, self.state = self._latest()

    def _latest(self) -> tuple[int, State]:
        """The newest number and the newest state that can be read.

        Files are made whole (``Store.create``), so one that can't be read was
        damaged: the state before it holds, and the next commit takes the number past it.
        """
        names = [n for n in self.store.list("registry") if n.endswith(".json")]
        newest = int(names[-1].removesuffix(".json")) if names else 0
        for name in reversed(names):
            try:
                return newest, loads(self.store.read(f"registry/{name}"))
            except (json.JSONDecodeError, KeyError, TypeError):
                continue
        return newest, State()

    def reload(self) -> State:
        self.version, self.state = self._latest()
        return self.state

    def draft(self) -> State:
        """A copy to change and commit."""
        self.reload()
        return copy.deepcopy(self.state)

    def commit(self, state: State) -> int:
        if not self.store.create(f"registry/{self.version + 1:012d}.json", dumps(state)):
            raise Conflict(f"version {self.version + 1} exists")
        self.version, self.state = self.version + 1, copy.deepcopy(state)
        return self.version

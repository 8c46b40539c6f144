"""Export of archived children with digests, and selection of cold children."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions.intervals import Interval, add
from ..plans import planner as P
from .manager import PartitionManager


def dump_partition(manager: PartitionManager, schema: str, output: str, drop: bool = True, format: str = "csv") -> dict[str, dict[str, str]]:
    """Export every table of an archive schema, write the SHA-512 of each of its files beside them, and drop it.

    Digests are taken where the files are read; the driver gets a name and a digest a file.
    """
    out = {}
    for table in sorted(t for t, c in manager.state.tables.items() if c.schema == schema):
        path = f"{output.rstrip('/')}/{table}"
        manager.read_child(table).write.format(format).option("header", True).mode("overwrite").save(path)
        files = manager.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
        digests = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 512).alias("sha512"))
        out[table] = {r.file: r.sha512 for r in digests.collect()}
        (digests.select(F.concat_ws("  ", "sha512", "file").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}.sha512"))
        if drop:
            draft = manager.registry.draft()
            del draft.tables[table]
            manager.registry.commit(draft)
    return out


def sha512(data: bytes) -> str:
    return hashlib.sha512(data).hexdigest()


def cold_children(manager: PartitionManager, parent: str, interval: str | int | None = None) -> list[str]:
    """Children that lie wholly before now (ids: before the highest value) less ``interval``: those that rewriting won't disturb."""
    s = manager.state.sets[parent]
    kids = P.children(s)
    if interval is None:
        return [c.table for c in kids]
    if s.kind == "time":
        limit = add(manager.now(), Interval.parse(str(interval)), -1)
    else:
        limit = (manager.current_cell(parent) or 0) - int(interval)
    return [c.table for c in kids if c.lo < limit and c.hi <= limit]


def vacuum_maintenance(manager: PartitionManager, parent: str, interval: str | int | None = None, target_bytes: int = 256 << 20) -> list[str]:
    """Rewrite the small files of cold children; returns the children that were rewritten."""
    cold = set(cold_children(manager, parent, interval))
    s = manager.state.sets[parent]
    bound = max((c.hi for c in P.children(s) if c.table in cold), default=None)
    return [] if bound is None else manager.compact(parent, bound, target_bytes)

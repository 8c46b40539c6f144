"""N-gram Jaccard join by PartEnum signatures, and its connected components.

A document is the set of its word shingles, as 64-bit hashes. Set sizes fall into
bands; a set carries the tag of its band and, where it can link to a set of the
band below, that band's tag too. Two linked sets share a tag, and differ in at
most ``k = (den - num) * r // num`` shingles, r the largest size of the tag's band.
For each tag the shingle domain is cut by hash into n1 parts, so that some part
holds at most K2 of the differences, and each part into N2 smaller ones; a
signature is the hash of the set's shingles in N2 - K2 of those. Sets with at
most k differences therefore share a signature: no link is lost.

Signatures that hold no shingle would be shared by unrelated sets. Each tag has
some parts more than needed, its slack, so that at least 1 + slack parts hold at
most K2 differences; a set with no more than slack parts that have an empty signature
leaves these out, and a linked set still shares one that isn't empty. The slack grows
with the band, as the expected number of such parts does (``slack_of``).

Sets that are equal are one class, which the class's key (a 64-bit hash of the
set) names. A chunk of a partition keeps one entry for each signature and sends
the others' links to that one, packed in binary values by bucket; a bucket does
the same over all chunks. So a signature has at most one entry a chunk, and a
group of m classes makes m - 1 candidate pairs, not all. Candidates are verified
on the whole texts. Where a group's classes are then not in one component, the group
gets another hub, the class that shares the most with others, as the smallest one may
lie at the group's edge; this is done again while it finds links, HUB_ROUNDS times at most.
All pairs of a group that are then still across components are verified too, each
once and not once a signature, which makes the join exact whatever the hubs were.

Defined results: a text without words has an empty set and no link; with fewer
words than a shingle, the whole sequence is the one shingle; repeated rows and equal texts
are one class; documents with null doc_id link like others and count as the
largest id; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, parts_for, stash, text_bytes
from .components import components
from .packed import bounds, squeeze, widen
from .seekable import batches_of

K2, N2, SLACK = 1, 3, 2
BAND_GROWTH = 1.5
SKETCH = 16
CHUNK_CHARS = 2_000_000
BUCKET_BYTES = 48 << 20
#: Most classes (three numbers each) that are broadcast to fetch their texts; of more, the texts are shuffled.
MOST_BROADCAST = 500_000
#: Rounds of central hubs before the pairs that are left are looked at, and signatures by which a class tells where its pairs are met first.
HUB_ROUNDS, LOWEST = 3, 6
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(salt * MIX[0] & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sets:
    """Distinct shingles of some texts: ``hashes`` sorted within each document ``of``."""

    def __init__(self, texts: list[str | None], width: int):
        ids: dict[bytes, int] = {}
        flat: list[int] = []
        lengths = []
        for t in texts:
            words = (t or "").encode().lower().split()
            lengths.append(len(words))
            flat.extend([ids.setdefault(w, len(ids)) for w in words])
        h = hashlib.blake2b
        keys = np.frombuffer(b"".join(h(w, digest_size=8).digest() for w in ids), "<u8")
        words = keys[np.array(flat, np.int64)] if flat else np.zeros(0, np.uint64)
        n = np.array(lengths, np.int64)
        # A window starts at each word but the last width - 1; a short text is one window.
        windows = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        of = np.repeat(np.arange(len(n)), windows)
        starts = np.cumsum(n) - n
        at = starts[of] + np.arange(len(of)) - (np.cumsum(windows) - windows)[of]
        left = np.minimum(n, width)[of]
        x = _mix(left.astype(np.uint64), 7)
        for i in range(width):
            use = left > i
            x[use] = _mix(x[use] + words[at[use] + i] * np.uint64(MIX[1]), i + 1)
        order = np.lexsort((x, of))
        x, of = x[order], of[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
        self.hashes, self.of = x[new], of[new]
        self.sizes = np.bincount(self.of, minlength=len(n))
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        total = np.zeros(len(n), np.uint64)
        np.add.at(total, self.of, _mix(self.hashes, 11))
        #: Names the set; 0 where it is empty.
        self.keys = np.where(self.sizes > 0, _mix(total + self.sizes.astype(np.uint64), 13) | np.uint64(1), np.uint64(0)).view(np.int64)

    def sketches(self) -> np.ndarray:
        """SKETCH longs a set: the parities of its shingles' numbers in 64 * SKETCH cells.

        Two sets differ in at least as many shingles as their sketches in bits.
        """
        x = _mix(self.hashes, 37) >> np.uint64(8)
        bit = (x % np.uint64(64)).astype(np.uint64)
        word = ((x // np.uint64(64)) % np.uint64(SKETCH)).astype(np.int64)
        out = np.zeros(len(self.sizes) * SKETCH, np.uint64)
        np.bitwise_xor.at(out, self.of * SKETCH + word, np.uint64(1) << bit)
        return out.view(np.int64)

    def fine(self, i: int) -> bytes:
        """A longer sketch of one set: about eight cells for each shingle, a power of two of them."""
        n = self.sizes[i]
        cells = 1 << max(10, int(8 * n - 1).bit_length())
        parity = np.zeros(cells, np.uint8)
        np.bitwise_xor.at(parity, (_mix(self.set(i), 41) >> np.uint64(5)).astype(np.int64) % cells, np.uint8(1))
        return np.packbits(parity, bitorder="little").tobytes()

    def set(self, i: int) -> np.ndarray:
        return self.hashes[self.starts[i] : self.starts[i] + self.sizes[i]]


def _bands(most: int) -> list[tuple[int, int]]:
    out, low = [], 1
    while low <= most:
        high = max(low, int(low * BAND_GROWTH))
        out.append((low, high))
        low = high + 1
    return out


@functools.cache
def slack_of(low: int, k: int) -> int:
    """Parts a tag has beyond k // (K2 + 1) + 1, so that most of its sets, the smallest of size ``low``, can leave out empty signatures."""
    for slack in range(SLACK, SLACK + k // 4 + 1):
        parts = k // (K2 + 1) + 1 + slack
        gaps = parts * N2 * math.exp(-low * (N2 - K2) / (N2 * parts))
        if gaps + math.sqrt(gaps) <= slack:
            return slack
    return SLACK + k // 6


def signatures(sets: Sets, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, class key) of the sets that can link to other sets."""
    first, last = [], []
    bands = _bands(int(sets.sizes.max(initial=0)))
    highs = np.array([h for _, h in bands], np.int64)
    slacks = np.array([slack_of(low, (den - num) * h // num) for low, h in bands], np.int64)
    band = np.searchsorted(highs, sets.sizes)
    for step in (0, 1):
        tag = band - step
        ok = (sets.sizes > 0) & (tag >= 0)
        high, slack = (x[np.where(ok, tag, 0)] if len(bands) else np.zeros(len(tag), np.int64) for x in (highs, slacks))
        if step:
            ok &= num * sets.sizes <= den * high
        k = (den - num) * high // num
        # Without differences the sets are equal, and so one class.
        ok &= k > 0
        parts = np.where(ok, k // (K2 + 1) + 1 + slack, 0)
        slots = parts * N2
        base = np.cumsum(slots) - slots
        use = ok[sets.of]
        of, x = sets.of[use], sets.hashes[use]
        part = (_mix(x, 17) >> np.uint64(11)).astype(np.int64) % np.maximum(parts[of], 1)
        small = (_mix(x, 19) >> np.uint64(11)).astype(np.int64) % N2
        slot = base[of] + part * N2 + small
        sums = np.zeros(int(slots.sum()), np.uint64)
        np.add.at(sums, slot, _mix(x, 23))
        held = np.bincount(slot, minlength=len(sums)).reshape(-1, N2)
        sums = sums.reshape(-1, N2)
        doc = np.repeat(np.arange(len(parts)), parts)
        place = np.arange(len(doc)) - (np.cumsum(parts) - parts)[doc]
        left_out = range(N2)  # K2 is 1: each signature leaves out one of the smaller parts
        empty = np.stack([held.sum(axis=1) - held[:, j] == 0 for j in left_out], axis=1)
        gaps = np.bincount(doc, weights=empty.any(axis=1), minlength=len(parts))
        skip = (gaps <= slack)[doc]
        where = _mix(place.astype(np.uint64) * np.uint64(N2) + tag[doc].astype(np.uint64) * np.uint64(MIX[2]), 29)
        whole = sums.sum(axis=1, dtype=np.uint64)
        for j in left_out:
            keep = ~(empty[:, j] & skip)
            first.append(_mix((whole - sums[:, j])[keep] + where[keep], 31 + j))
            last.append(sets.keys[doc[keep]])
    return np.concatenate(first), np.concatenate(last)


def star(sigs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each signature the smallest key; and (signature, smallest key, other key) of the rest."""
    order = np.lexsort((keys, sigs))
    s, k = sigs[order], keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    hub = k[np.flatnonzero(new)][np.cumsum(new) - 1] if len(s) else k
    other = ~new & (k != hub)
    other[1:] &= (k[1:] != k[:-1]) | new[1:]
    return s[new], k[new], (s[other], hub[other], k[other])


def _cut(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that their text columns hold about CHUNK_CHARS bytes."""
    for b in batches:
        sizes = [sum(x) for x in zip(*(pc.fill_null(pc.binary_length(b.column(c)), 0).to_pylist() for c in columns), strict=True)]
        for start, stop in batches_of(sizes, CHUNK_CHARS):
            yield b.slice(start, stop - start)


def _lists(sketches: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(sketches) + 1, SKETCH), pa.int32()), pa.array(sketches))


def possible(num: int, den: int, names: tuple[str, str, str, str] = ("na", "nb", "sa", "sb")) -> Column:
    """Whether sets of (na, sa) and (nb, sb), sizes and sketches, can link: never false for those that do."""
    na, nb, sa, sb = (F.col(x) for x in names)
    bits = functools.reduce(lambda a, b: a + b, (F.bit_count(sa[i].bitwiseXOR(sb[i])) for i in range(SKETCH)))
    sizes = (den * na >= num * nb) & (den * nb >= num * na)
    return sizes & (bits * (den + num) <= (na + nb) * (den - num))


def classes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, h, n_shingles, key, sketch) of every document; h is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches, 2):
            s = Sets(b.column(2).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s.sizes, pa.int64()), pa.array(s.keys, pa.int64(), mask=s.sizes == 0), _lists(s.sketches())], names=["doc_id", "h", "n_shingles", "key", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "h", "text").mapInArrow(run, f"doc_id {kind}, h long, n_shingles long, key long, sketch array<long>")


def groups(docs: DataFrame, width: int, num: int, den: int, n_bytes: int) -> DataFrame:
    """(sig, hub, other): classes that share a signature, each with the smallest of its chunk or bucket."""
    # About 0.1 signatures a byte at 0.9, in 8 bytes each.
    buckets = parts_for(int(n_bytes * 8 * (den - num) / num), BUCKET_BYTES)
    schema = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("hubs", pa.binary()), ("others", pa.binary())])
    linked = pa.schema([("sig", pa.int64()), ("hub", pa.int64()), ("other", pa.int64())])

    def chunk(texts: list[str | None]) -> pa.RecordBatch:
        sigs, keys, (s, hub, other) = star(*signatures(Sets(texts, width), num, den))
        at = bounds(sigs, buckets)
        out = []
        for k in np.flatnonzero(np.diff(at)).tolist():
            part = slice(at[k], at[k + 1])
            names, which = np.unique(keys[part], return_inverse=True)
            out.append((k, squeeze(np.diff(sigs[part], prepend=np.uint64(0))), names.tobytes(), squeeze(which)))
        # Links within the chunk need no meeting: any task may pass them on.
        for lot in range(0, len(s), 500_000):
            part = slice(lot, lot + 500_000)
            out.append((-1 - int(s[lot] % np.uint64(buckets)), s[part].tobytes(), hub[part].tobytes(), other[part].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str | None] = []
        size = 0
        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(t)
                size += len(t or "")
                if size >= CHUNK_CHARS:
                    yield chunk(held)
                    held, size = [], 0
        if held:
            yield chunk(held)

    def meet(t: pa.Table) -> pa.Table:
        if t.column("bucket")[0].as_py() < 0:
            cols = [np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in t.column(c)]) for c in ("sigs", "hubs", "others")]
        else:
            sigs = np.concatenate([np.cumsum(widen(x.as_py()), dtype=np.uint64) for x in t.column("sigs")])
            keys = np.concatenate([np.frombuffer(n.as_py(), "<i8")[widen(w.as_py()).astype(np.int64)] for n, w in zip(t.column("hubs"), t.column("others"), strict=True)])
            cols = [x.view(np.int64) for x in star(sigs, keys)[2]]
        return pa.Table.from_arrays([pa.array(x) for x in cols], schema=linked)

    sent = docs.select("text").mapInArrow(send, "bucket int, sigs binary, hubs binary, others binary")
    return sent.groupBy("bucket").applyInArrow(meet, "sig long, hub long, other long")


def least_difference(a: bytes, b: bytes) -> int:
    """In how many shingles two sets differ at least, from their fine sketches; the longer one is folded."""
    x, y = (np.frombuffer(s, np.uint8) for s in sorted((a, b), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def verify(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts (key, n, fine, text) link.

    The fine sketches, a sixth of the texts, are compared first; only pairs that
    they leave are held against each other in full.
    """

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).to_numpy() + b.column(3).to_numpy()
            least = np.array([least_difference(x.as_py(), y.as_py()) for x, y in zip(b.column(4), b.column(5), strict=True)], np.int64)
            ok = pa.array(least * (den + num) <= sizes * (den - num))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    def side(k: str) -> DataFrame:
        return texts.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("fine").alias(f"fine_{k}"))

    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "fine_a", "fine_b")
    pairs = stash(near.mapInArrow(coarse, "a long, b long"), "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches, 2, 3):
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # The first text of many pairs is the same: each run's is cut up once.
            run_of = np.concatenate([[0], np.cumsum(a[1:] != a[:-1])]) if len(a) else a
            heads = np.unique(run_of, return_index=True)[1]
            left = Sets(batch.column(2).take(pa.array(heads)).to_pylist(), width)
            right = Sets(batch.column(3).to_pylist(), width)
            ok = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = left.set(run_of[i]), right.set(i)
                if min(len(x), len(y)) * den >= num * max(len(x), len(y)):
                    both = np.intersect1d(x, y, assume_unique=True).size
                    ok[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a long, b long")


def _verified(rows: DataFrame, first: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The linked ones of ``pairs``, written; the texts that were fetched for them are deleted again."""
    texts = _texts(rows, first, pairs, width)
    links = stash(verify(pairs, texts, width, num, den), "links")
    drop_stash(texts)
    return links


def linked(docs: DataFrame, width: int, num: int, den: int, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(doc_id, h, n_shingles, least) of every document; least is the (doc_id, h) of its component's first, null for empty sets."""
    rows = docs.select(F.col(f"`{key_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("h", F.xxhash64("text"))
    n_bytes = text_bytes(rows)
    members = stash(classes(rows, width), "classes")
    found = stash(groups(rows, width, num, den, n_bytes), "groups")
    # Null ids last.
    one = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))
    first = members.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min(one).alias("first"))
    nodes = stash(members.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min_by(F.struct("n_shingles", "sketch"), "h").alias("set")).select("key", "set.n_shingles", "set.sketch"), "nodes")
    a = nodes.select(F.col("key").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    b = nodes.select(F.col("key").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    can = possible(num, den)
    ends = stash(found.select(F.col("hub").alias("a"), F.col("other").alias("b")).distinct(), "ends")
    pairs = ends.join(a, "a")
    pairs = stash(pairs.join(b, (pairs["b"] == b["b"]) & can).select("a", b["b"]), "pairs")
    links = _verified(rows, first, pairs, width, num, den)
    labels = components(links)
    inside = _inside(found, ends, labels)
    for done in (found, ends):
        drop_stash(done)
    ranks = stash(_ranks(inside), "ranks")
    hubs = None
    for _ in range(HUB_ROUNDS):
        chosen = _hubs(inside, ranks, labels, hubs)
        hubs = chosen.select("hub") if hubs is None else hubs.union(chosen.select("hub"))
        near = _to_hubs(inside, chosen, labels, a, b, can).join(pairs, ["a", "b"], "left_anti")
        near = stash(near, "pairs")
        more = _verified(rows, first, near, width, num, den)
        pairs = pairs.union(near)
        if more.isEmpty():
            break
        labels = components(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))
    split = _split(inside, ranks, labels, a)
    rest = stash(_across(split, num, den).join(pairs, ["a", "b"], "left_anti"), "pairs")
    for done in (nodes, inside, ranks, split, pairs):
        drop_stash(done)
    if not rest.isEmpty():
        more = _verified(rows, first, rest, width, num, den)
        if not more.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))
    named = first.join(labels, first["key"] == labels["node"], "left").select("key", "first", F.coalesce("comp", "key").alias("comp"))
    least = named.groupBy("comp").agg(F.min("first").alias("least"))
    of_class = named.join(least, "comp").select(F.col("key").alias("__key"), "least")
    return members.join(of_class, F.col("key") == F.col("__key"), "left").select("doc_id", "h", "n_shingles", "least")


def join(docs: DataFrame, width: int, num: int, den: int, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; sets link when den * intersection >= num * union."""
    return linked(docs, width, num, den, text_col, key_col).select("doc_id", "n_shingles", F.coalesce("least.doc_id", "doc_id").alias("component_id"))


def _comps(labels: DataFrame, node: str, comp: str) -> DataFrame:
    return labels.select(F.col("node").alias(node), F.col("comp").alias(comp))


def _inside(found: DataFrame, ends: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, a): the classes of each signature whose classes are in different components, written.

    The links (hub, other) of a signature connect all its classes, so one of them
    crosses components where these differ. The links are few, ``ends``; only the
    signatures of those that cross are looked at. Of signatures with the same
    classes one is enough.
    """
    crossing = ends
    for c in ("a", "b"):
        crossing = crossing.join(_comps(labels, c, f"{c}_comp"), c, "left").withColumn(f"{c}_comp", F.coalesce(f"{c}_comp", c))
    crossing = stash(crossing.filter("a_comp <> b_comp").select(F.col("a").alias("hub"), F.col("b").alias("other")), "crossing")
    few = crossing.count() <= MOST_BROADCAST
    sigs = found.join(F.broadcast(crossing) if few else crossing, ["hub", "other"], "left_semi").select("sig").distinct()
    every = stash(found.join(sigs, "sig", "left_semi").select("sig", F.explode(F.array("hub", "other")).alias("a")).distinct(), "every")
    drop_stash(crossing)
    who = every.groupBy("sig").agg(F.bit_xor(F.xxhash64("a")).alias("who"), F.bit_xor(F.xxhash64("a", F.lit(1))).alias("too"), F.count(F.lit(1)).alias("n"))
    one = who.groupBy("who", "too", "n").agg(F.min("sig").alias("sig")).select("sig")
    inside = stash(every.join(one, "sig", "left_semi"), "inside")
    drop_stash(every)
    return inside


def _ranks(inside: DataFrame) -> DataFrame:
    """(a, weight, lowest): how many classes share signatures with a class, each counted as often as it does, and its LOWEST smallest signatures."""
    n = inside.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    lowest = F.slice(F.array_sort(F.collect_list("sig")), 1, LOWEST)
    return inside.join(n, "sig").groupBy("a").agg(F.sum("n").alias("weight"), lowest.alias("lowest"))


def _hubs(inside: DataFrame, ranks: DataFrame, labels: DataFrame, before: DataFrame | None) -> DataFrame:
    """(sig, hub, hub_comp) of the signatures whose classes are in different components, written.

    A hub is the class of most weight, of a component that had no hub ``before`` if there is one.
    """
    who = ranks.join(_comps(labels, "a", "comp"), "a", "left").select("a", "weight", F.coalesce("comp", "a").alias("comp"), F.lit(True).alias("fresh"))
    if before is not None:
        had = who.join(before, F.col("a") == F.col("hub"), "left_semi").select("comp", F.lit(True).alias("had")).distinct()
        who = who.join(had, "comp", "left").select("a", "weight", "comp", F.col("had").isNull().alias("fresh"))
    most = F.max_by(F.struct("a", "comp"), F.struct("fresh", "weight", "a")).alias("hub")
    chosen = inside.join(who, "a").groupBy("sig").agg(most, F.min("comp").alias("low"), F.max("comp").alias("high"))
    return stash(chosen.filter("low <> high").select("sig", F.col("hub.a").alias("hub"), F.col("hub.comp").alias("hub_comp")), "hubs")


def _to_hubs(inside: DataFrame, hubs: DataFrame, labels: DataFrame, left: DataFrame, right: DataFrame, can: Column) -> DataFrame:
    """(a, b): the classes of a signature that are in another component than its hub and can link to it, with the hub; written."""
    ends = inside.join(hubs, "sig").select("a", "hub", "hub_comp").distinct()
    ends = ends.join(_comps(labels, "a", "comp"), "a", "left").filter(F.coalesce("comp", "a") != F.col("hub_comp"))
    ends = ends.select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b")).distinct()
    both = ends.join(left, "a")
    return stash(both.join(right, (both["b"] == right["b"]) & can).select("a", right["b"]), "to_hubs")


def _split(inside: DataFrame, ranks: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sig, a, comp, na, sa, lowest): the classes of the signatures whose classes still are in different components, written."""
    who = ranks.join(_comps(labels, "a", "comp"), "a", "left").select("a", F.coalesce("comp", "a").alias("comp"), "lowest")
    apart = inside.join(who.select("a", "comp"), "a").groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("sig")
    return stash(inside.join(apart, "sig", "left_semi").join(who.join(nodes, "a"), "a").select("sig", "a", "comp", "na", "sa", "lowest"), "split")


def _met(split: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), seldom twice: classes that share a signature, are in different components and can link.

    Sketches are compared inside the join, so that only pairs that can link leave it;
    and these leave it only where no smaller signature is known to hold both. The
    smallest one that holds both is never passed over, so no pair is lost. Both sides
    are the same rows, shuffled once and merged: to broadcast them would leave a large group to few tasks.
    """
    can = possible(num, den, ("l.na", "r.na", "l.sa", "r.sa"))
    least = F.coalesce(F.array_min(F.array_intersect("l.lowest", "r.lowest")) >= F.col("l.sig"), F.lit(True))
    apart = (F.col("l.a") < F.col("r.a")) & (F.col("l.comp") != F.col("r.comp"))
    joined = split.alias("l").join(split.alias("r").hint("merge"), (F.col("l.sig") == F.col("r.sig")) & apart & can & least)
    return joined.select(F.col("l.a").alias("a"), F.col("r.a").alias("b"))


def _across(split: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes that share a signature, are in different components and can link."""
    return _met(split, num, den).distinct()


def _texts(rows: DataFrame, first: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(key, n, fine, text) of the classes in ``pairs``: one document of each is fetched by doc_id and known again by its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches, 1):
            sets = Sets(b.column(1).to_pylist(), width)
            same = np.flatnonzero(sets.keys == b.column(0).to_numpy())
            at = pa.array(same)
            fine = pa.array([sets.fine(i) for i in same], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(sets.sizes[same], pa.int64()), fine, b.column(1).take(at)], names=["key", "n", "fine", "text"])

    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    # Written, so that it can be counted before the join with the texts is planned.
    wanted = stash(first.join(keys, "key").select("key", F.col("first.doc_id").alias("__doc"), F.col("first.h").alias("__h")), "wanted")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("h") == F.col("__h"))
    few = wanted.count() <= MOST_BROADCAST
    found = rows.join(F.broadcast(wanted) if few else wanted, same).select("key", "text").mapInArrow(run, "key long, n long, fine binary, text string")
    # Repeated rows give a class twice; links found twice are the same links. Written, as it is read for sketches and for texts.
    return stash(found, "texts")


def keep_one(docs: DataFrame, width: int, num: int, den: int, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """One document of each component, and all without words, with the columns of ``docs`` only.

    Of rows that equal the first in id and text any one stays; only these are shuffled.
    """
    l = linked(docs, width, num, den, text_col, key_col)  # noqa: E741
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("h") == F.col("least.h"))
    counted = l.filter("least is not null").groupBy("doc_id", "h").agg(F.bool_and(first).alias("__first"), F.count(F.lit(1)).alias("n"))
    marked = stash(counted.filter("not __first or n > 1").select(F.col("doc_id").alias("__gone"), F.col("h").alias("__h"), "__first"), "gone")
    doc, h = F.col(f"`{key_col}`"), F.xxhash64(f"`{text_col}`")
    same = doc.eqNullSafe(F.col("__gone")) & (h == F.col("__h"))
    kept = docs.join(marked, same, "left_anti")
    again = marked.filter("__first")
    if again.isEmpty():
        return kept
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    copies = docs.join(again, same, "left_semi").select(row, doc.alias("__doc"), h.alias("__text"))
    return kept.unionAll(copies.dropDuplicates(["__doc", "__text"]).select("__row.*"))

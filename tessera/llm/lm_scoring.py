"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed bigram model over words, estimated from all training
rows. Its automaton has a state for each history word and a root; an arc
``(state, word)`` carries log10 of

    p(w | h) = (1 - u(h)) * c(h w) / c(h) + u(h) * p(w),

the failure arc of state h carries log10 u(h) and leads to the root, whose arcs
carry log10 p(w), the add-one unigram. ``u(h) = (c(h) + 1) ** -b``; b is solved so
that the mass of all failure arcs, weighted by c(h), equals the number of bigrams
seen once (the Good-Turing estimate of unseen mass). Each p(. | h) sums to one. A
text is scored in one left-to-right traversal that starts in the state of the end
token and carries the state; a word without an arc takes the failure arc.

The model is never in one place. Documents are dealt to blocks of bounded bytes.
A block asks for the counts of its own distinct words and bigrams: it sends their
64-bit keys (sorted, packed in one binary value for each of the count buckets)
with the counts of its training rows; a bucket adds up the counts of all blocks
and answers each block in the order asked. A block then builds the part of the
automaton that its texts can reach. A key has at most one entry a block, so a
frequent word or bigram makes no hot bucket.

Defined results: null and empty texts are one end token; null doc_ids count as
training rows (no remainder) and are not held out; repeated rows are each counted
and scored; extra columns are ignored; without training rows p is uniform over
one unknown word; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_for, stash, text_bytes
from .packed import bounds, squeeze, widen

BLOCK_BYTES = 8 << 20
#: Bytes of keys, over all blocks, that one bucket adds up.
BUCKET_BYTES = 12 << 20
END = b"\n"
#: Exponents at which the mass of all failure arcs is added up.
GRID = np.linspace(0.0, 1.0, 65)
#: Odd constants that mix the two words' hashes into the key of a bigram.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _word_keys(words: list[bytes]) -> np.ndarray:
    h = hashlib.blake2b
    return np.frombuffer(b"".join(h(w, digest_size=8).digest() for w in words), "<u8")


def _bigram_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(MIX[0]) + (b ^ (b >> np.uint64(29))) * np.uint64(MIX[1])
    x ^= x >> np.uint64(32)
    return x * np.uint64(MIX[0])


class Block:
    """The words and bigrams of some documents, in an order that depends on the texts alone."""

    def __init__(self, texts: list[str | None]):
        ids: dict[bytes, int] = {END: 0}
        flat, lengths = [], []
        for t in texts:
            words = (t or "").encode().lower().split()
            lengths.append(len(words) + 1)
            flat.extend([ids.setdefault(w, len(ids)) for w in words])
            flat.append(0)
        self.tokens = np.array(flat, np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.keys = _word_keys(list(ids))
        self.order = np.argsort(self.keys, kind="stable")
        # Each document starts in the state of the end token, which is also its last token.
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[:1] = 0
        self.width = len(ids)
        self.arcs, self.arc_of = np.unique(before * self.width + self.tokens, return_inverse=True)
        self.arc_keys = _bigram_keys(self.keys[self.arcs // self.width], self.keys[self.arcs % self.width])
        self.arc_order = np.argsort(self.arc_keys, kind="stable")

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of words and of bigrams."""
        return self.keys[self.order], self.arc_keys[self.arc_order]

    def counts(self, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in the training documents, in the order of ``asked``."""
        used = np.repeat(training, self.lengths)
        words = np.bincount(self.tokens[used], minlength=self.width)
        arcs = np.bincount(self.arc_of[used], minlength=len(self.arcs))
        return words[self.order], arcs[self.arc_order]

    def answered(self, words: np.ndarray, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts in the order of ``asked`` by word and by arc."""
        w, a = np.empty(self.width, np.int64), np.empty(len(self.arcs), np.int64)
        w[self.order], a[self.arc_order] = words, arcs
        return w, a


class Automaton:
    """The part of the backoff automaton that a block's texts can reach."""

    def __init__(self, block: Block, words: np.ndarray, arcs: np.ndarray, n: int, v: int, b: float):
        p = (words + 1) / (n + v + 1)
        u = (words + 1.0) ** -b
        u[words == 0] = 1.0
        self.width = block.width
        self.root = np.log10(p).tolist()
        self.fail = np.log10(u).tolist()
        seen = np.flatnonzero(arcs)
        h, w = block.arcs[seen] // block.width, block.arcs[seen] % block.width
        weight = np.log10((1 - u[h]) * arcs[seen] / words[h] + u[h] * p[w])
        self.arcs = dict(zip(block.arcs[seen].tolist(), weight.tolist(), strict=True))

    def score(self, tokens: list[int]) -> float:
        """One traversal from the state of the end token."""
        arcs, fail, root, width = self.arcs.get, self.fail, self.root, self.width
        state, total = 0, 0.0
        for w in tokens:
            weight = arcs(state * width + w)
            total += fail[state] + root[w] if weight is None else weight
            state = w
        return total


def held_out_by_id(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; null ids are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _solve(singles: int, masses: list[float]) -> float:
    """The exponent at which the failure mass equals ``singles``."""
    return float(np.interp(-singles, -np.array(masses), GRID)) if masses and masses[0] else 1.0


def score(docs: DataFrame, held_out: Column, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """Model and base scores of every document; rows that are not ``held_out`` train the model."""
    kind = docs.schema[key_col].dataType.simpleString()
    rows = docs.select(F.col(key_col).alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    n_bytes = text_bytes(rows)
    blocks = parts_for(n_bytes, BLOCK_BYTES)
    # About one distinct bigram for every 12 bytes of text, in 5 bytes.
    buckets = parts_for(n_bytes // 2, BUCKET_BYTES)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def ask(t: pa.Table) -> pa.Table:
        block = Block(t.column("text").to_pylist())
        number = t.column("block")[0].as_py()
        training = ~t.column("held_out").to_numpy()
        out = []
        for kind_, keys, counts in zip("wb", block.asked(), block.counts(training), strict=True):
            at = bounds(keys, buckets)
            for k in np.flatnonzero(np.diff(at)).tolist():
                part = slice(at[k], at[k + 1])
                out.append((k, number, kind_, squeeze(np.diff(keys[part], prepend=np.uint64(0))), squeeze(counts[part])))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), asked, strict=True)], schema=asked)

    asked = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.string()), ("keys", pa.binary()), ("counts", pa.binary())])

    def answer(t: pa.Table) -> pa.Table:
        """Add up one bucket; the first row of the answer also carries the bucket's sums."""
        kind_ = t.column("kind")[0].as_py()
        asked_keys = [np.cumsum(widen(x.as_py()), dtype=np.uint64) for x in t.column("keys")]
        keys, which = np.unique(np.concatenate(asked_keys), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate([widen(x.as_py()) for x in t.column("counts")]).astype(np.float64), minlength=len(keys)).astype(np.int64)
        ends = np.cumsum([len(k) for k in asked_keys])
        replies = [squeeze(total[which[e - len(k) : e]]) for k, e in zip(asked_keys, ends, strict=True)]
        n = len(replies)
        seen = total[total > 0]
        sums = [int(seen.sum()), len(seen), int((seen == 1).sum())]
        mass = [float((seen * (seen + 1.0) ** -b).sum()) for b in GRID] if kind_ == "w" else None
        return pa.Table.from_pydict(
            {
                "bucket": t.column("bucket"),
                "block": t.column("block"),
                "kind": t.column("kind"),
                "reply": replies,
                "n": [sums[0]] + [0] * (n - 1),
                "v": [sums[1]] + [0] * (n - 1),
                "singles": [sums[2]] + [0] * (n - 1),
                "mass": [mass] + [None] * (n - 1),
            },
            schema=replied,
        )

    replied = pa.schema(
        [("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.string()), ("reply", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("singles", pa.int64()), ("mass", pa.list_(pa.float64()))]
    )
    asks = rows.groupBy("block").applyInArrow(ask, "bucket int, block int, kind string, keys binary, counts binary")
    answers = stash(
        asks.groupBy("bucket", "kind").applyInArrow(answer, "bucket int, block int, kind string, reply binary, n long, v long, singles long, mass array<double>"), "lm"
    )
    # A few numbers for the whole corpus.
    sums = {r["kind"]: r for r in answers.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("singles").alias("singles"), *(F.sum(F.col("mass")[i]).alias(f"m{i}") for i in range(len(GRID)))).collect()}
    n, v = (sums["w"]["n"], sums["w"]["v"]) if sums else (0, 0)
    exponent = _solve(sums["b"]["singles"], [sums["w"][f"m{i}"] for i in range(len(GRID))]) if n else 1.0

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        """Build the block's automaton from the answers and traverse its texts."""
        if not left.num_rows:
            return scored.empty_table()
        right = right.sort_by("bucket")
        texts = left.column("text").to_pylist()
        block = Block(texts)
        kinds = right.column("kind").to_pylist()
        replies = [widen(x.as_py()) for x in right.column("reply")]
        words, arcs = (np.concatenate([r for r, k in zip(replies, kinds, strict=True) if k == want]).astype(np.int64) for want in "wb")
        words, arcs = block.answered(words, arcs)
        automaton = Automaton(block, words, arcs, n, v, exponent)
        ends = np.cumsum(block.lengths)
        starts = ends - block.lengths
        base = np.add.reduceat(np.array(automaton.root)[block.tokens], starts)
        known = np.add.reduceat((words > 0)[block.tokens].astype(np.int64), starts)
        scores = [automaton.score(block.tokens[a:b].tolist()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.Table.from_arrays(
            [left.column("doc_id"), left.column("held_out"), pa.array(block.lengths), pa.array(known), pa.array(np.full(len(texts), n)), pa.array(base), pa.array(scores, pa.float64())], schema=scored
        )

    id_type = {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())
    scored = pa.schema([("doc_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    replies = answers.select("bucket", "block", "kind", "reply")
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(judge, out)

"""Unigram token counts with a trie that shares forward scores.

A byte-level rank file gives the pieces; a piece of rank r has the Zipf
log-probability ``-ln(r + 1) - ln(H)`` with H the sum of ``1 / (r + 1)``, held in
whole millionths so that ties are exact. The token count of a pre-token is that
of its segmentation with the highest sum, of several such the fewest tokens.
Distinct pre-tokens of a chunk go into a trie; a node's forward score (best sum
and fewest tokens for the bytes from the root) is computed once for all
pre-tokens that share the prefix; terminal counts are stored, and those of units of
text (from one space to the next) are kept in a bounded cache. A document's count is
the sum over its units.

Defined results: null and empty texts count 0; every byte is a piece, so any text
has a count; special tokens' strings are ordinary text; rows are independent, so
repeated rows, ties and extra columns change nothing; an empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import UnitCache, cut, pieces_of_units, read_vocabulary, run_sums

UNIT = 1_000_000
#: Pre-tokens of more bytes are scored on their own, without nodes in the trie.
TRIE_BYTES = 64
#: A forward score is ``sum * TOKENS - tokens``: one whole number that orders by sum, then by fewer tokens.
TOKENS = 1 << 32
NO_PIECE = -(1 << 120)


class UnigramTrie:
    def __init__(self, data: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        h = math.log(sum(1 / (r + 1) for r in ranks.values()))
        self.pieces = {p: round(UNIT * (-math.log(r + 1) - h)) for p, r in ranks.items()}
        # The pieces read backwards: a node maps a byte to the next node, and -1 to the score of the piece that ends here.
        self.root: dict = {-1: NO_PIECE}
        for p, s in self.pieces.items():
            node = self.root
            for c in reversed(p):
                node = node.setdefault(c, {-1: NO_PIECE})
            node[-1] = s * TOKENS - 1

    def _forward(self, word: bytes, end: int, best: list[int]) -> int:
        """Forward score of word[:end] from those of all shorter prefixes."""
        node, top = self.root, NO_PIECE
        for start in range(end - 1, -1, -1):
            node = node.get(word[start])
            if node is None:
                break
            here = best[start] + node[-1]
            if here > top:
                top = here
        return top

    def counts(self, words: list[str]) -> list[int]:
        """Token counts; the trie lives for this call."""
        child: dict[int, int] = {}
        scores = [0]
        out = []
        for w in words:
            b = w.encode()
            best = [0]
            node = 0
            for end, c in enumerate(b[:TRIE_BYTES], 1):
                key = node << 8 | c
                node = child.get(key)
                if node is None:
                    node = child[key] = len(scores)
                    scores.append(self._forward(b, end, best))
                best.append(scores[node])
            for end in range(TRIE_BYTES + 1, len(b) + 1):
                best.append(self._forward(b, end, best))
            out.append(-best[-1] % TOKENS)
        return out


class CountCache(UnitCache):
    """Numbers of pre-tokens and tokens of units."""

    def __init__(self, trie: UnigramTrie):
        self.trie, self.known = trie, {}
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.pretokens, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, units: list[str]) -> None:
        pieces, counts = pieces_of_units(units)
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > self.entries:
            self.known = {}
        missing = [p for p in names if p not in self.known]
        self.known.update(zip(missing, self.trie.counts(missing), strict=True))
        tokens = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        self.pretokens = np.concatenate([self.pretokens, counts])
        self.tokens = np.concatenate([self.tokens, run_sums(tokens[coded.indices.to_numpy()] if len(names) else tokens, counts)])

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        which, n = self.units(texts)
        return run_sums(self.pretokens[which], n), run_sums(self.tokens[which], n)


@functools.lru_cache(maxsize=2)
def _cache(data: bytes) -> CountCache:
    return CountCache(UnigramTrie(data))


def token_counts(docs: DataFrame, ranks_path: str, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every document; no shuffle."""
    data = read_vocabulary(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1):
            n_pretokens, n_tokens = _cache(data).counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_pretokens), pa.array(n_tokens)], names=["doc_id", "n_pretokens", "n_tokens"])

    kind = docs.schema[key_col].dataType.simpleString()
    return docs.select(F.col(f"`{key_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")

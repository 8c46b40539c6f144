"""Pre-tokens of byte-level vocabularies, and the tables of a vocabulary file.

The file's content travels from the driver in the task's closure (its size is
checked against a bound), so executors need no copy of it.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the pattern that the byte-level vocabularies were built with.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same for texts of Latin-1 letters only, with its letters, numbers and spaces spelled out; it runs faster.
LATIN = re.compile(
    r""" ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+""".replace("{L}", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff").replace("{N}", "0-9\xb2\xb3\xb9\xbc-\xbe").replace("{S}", " \\t-\\r\x85\xa0")
)
#: Largest vocabulary file that is sent with a task.
MOST_VOCABULARY_BYTES = 64 << 20
#: Bytes of text that are cut up at once, and entries of a worker's cache.
CHUNK_BYTES = 6_000_000
CACHE_ENTRIES = 600_000
#: A space between white space or after it at the end.
SPACE_IN_SPACES = re.compile(r"\s (?:\s|\Z)")
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes")
    return data


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies (fixed values).

    Printable Latin-1 letters stand for themselves; the other bytes take the
    code points from 256 on, in order.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, data: bytes):
        j = json.loads(data)
        model = j["model"]
        to_byte = {c: b for b, c in byte_letters().items()}
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.token_bytes = [b""] * (1 + max(max(self.ids.values()), *self.special.values(), 0))
        for token, i in self.ids.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = [self.ids[c] for _, c in sorted(byte_letters().items())]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: By rank: left id, right id, id of the two together.
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None


@functools.lru_cache(maxsize=2)
def vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(data)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``values`` one after another, and the length of each."""
    n = lengths[which]
    ends = np.cumsum(n)
    at = np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
    return values[at], n


def run_sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``x`` of the given lengths, which may be 0."""
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Runs:
    """Runs of ids, one for each place."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.values, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.values = np.concatenate([self.values, values.astype(np.uint32)])

    def get(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these places, one after another, and how many each has."""
        return gather(self.values, self.starts, self.lengths, which)


def _bytes(*values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*range(9, 14), *range(28, 33), *values]] = True
    return out


#: Last and first bytes of white space in UTF-8, those that letters have too among them.
LAST_OF_SPACE, FIRST_OF_SPACE = _bytes(0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F), _bytes(0xC2, 0xE1, 0xE2, 0xE3)


def spaces_in_spaces(texts: pa.Array) -> np.ndarray:
    """Which texts match SPACE_IN_SPACES: bytes are looked at first, then the texts that are left."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if len(texts) else 0
    raw = raw[first : first + (ends[-1] if len(ends) else 0)]
    at = np.flatnonzero(raw == 32)
    closing = np.zeros(len(raw) + 1, bool)
    closing[ends] = True
    after = np.append(raw, np.uint8(0))[at + 1]
    hit = at[(FIRST_OF_SPACE[after] | closing[at + 1]) & LAST_OF_SPACE[raw[at - 1]]]
    out = np.zeros(len(texts), bool)
    for i in np.unique(np.searchsorted(ends, hit, side="right")).tolist():
        out[i] = SPACE_IN_SPACES.search(texts[i].as_py()) is not None
    return out


class UnitCache:
    """Cuts texts at spaces and keeps what ``learn`` finds for each distinct unit, up to a bound.

    A unit begins at a space that has a non-space beside it. No pre-token reaches
    over such a place, so a text's pre-tokens are those of its units in order. Texts
    are split and units numbered by Arrow; only units that aren't known yet are
    looked at one by one. Where a space stands between white space, the text is cut
    only where a non-space comes before the space.
    """

    def __init__(self, special: Iterable[str] = (), entries: int = CACHE_ENTRIES):
        self.entries, self.place = entries, {}
        self.whole = any(" " in s for s in special)
        self.forget()

    def forget(self) -> None:
        self.place = {}

    def learn(self, units: list[str]) -> None:
        raise NotImplementedError

    def _numbers(self, units: list[str]) -> np.ndarray:
        """The place of each unit; new ones are learnt."""
        get = self.place.get
        found = np.fromiter((get(u, -1) for u in units), np.int64, len(units))
        new = np.flatnonzero(found < 0).tolist()
        missing = list(dict.fromkeys([units[i] for i in new]))
        if missing and len(self.place) + len(missing) > self.entries and self.place:
            self.forget()
            return self._numbers(units)
        if missing:
            self.learn(missing)
            self.place.update(zip(missing, range(len(self.place), len(self.place) + len(missing)), strict=True))
            found[new] = [self.place[units[i]] for i in new]
        return found

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of each unit of the texts, and how many units each text has."""
        texts = pc.fill_null(texts, "")
        odd = np.ones(len(texts), bool) if self.whole else spaces_in_spaces(texts)
        parts = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        coded = parts.flatten().dictionary_encode()
        ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        counts = np.diff(ends)
        names = coded.dictionary.to_pylist()
        firsts = parts.flatten().take(pa.array(ends[:-1])).to_pylist()
        rest = [[t] if self.whole else BEFORE_SPACE.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        number = self._numbers([*(" " + w for w in names), *firsts, *chain.from_iterable(rest)])
        which = number[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
        which[ends[:-1]] = number[len(names) : len(names) + len(firsts)]
        if rest:
            of = np.repeat(np.arange(len(counts)), counts)
            more = np.array([len(r) for r in rest])
            use = ~odd[of]
            of = np.concatenate([of[use], np.repeat(np.flatnonzero(odd), more)])
            which = np.concatenate([which[use], number[len(names) + len(firsts) :]])[np.argsort(of, kind="stable")]
            counts[odd] = more
        return which, counts


class IdCache(UnitCache):
    """Token ids of texts. ``make`` gives the ids of distinct pre-tokens, one after another, and how many each has."""

    def __init__(self, v: Vocabulary, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], entries: int = CACHE_ENTRIES):
        self.v, self.make = v, make
        self.pieces = Runs()
        super().__init__(v.special, entries)

    def forget(self) -> None:
        super().forget()
        self.found = Runs()

    def learn(self, units: list[str]) -> None:
        pieces, counts = pieces_of_units(units, self.v)
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.pieces.place) > self.entries:
            self.pieces = Runs()
        place = self.pieces.place
        missing = [p for p in names if p not in place]
        if missing:
            place.update(zip(missing, range(len(place), len(place) + len(missing)), strict=True))
            self.pieces.add(*self.make(missing))
        which = np.fromiter(map(place.__getitem__, names), np.int64, len(names))
        ids, sizes = self.pieces.get(which[coded.indices.to_numpy()] if len(names) else which)
        self.found.add(ids, run_sums(sizes, counts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after another, and how many each text has."""
        which, counts = self.units(texts)
        ids, sizes = self.found.get(which)
        return ids, run_sums(sizes, counts)


def cut(batches: Iterable[pa.RecordBatch], column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the text column of each holds about ``most`` bytes."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype(np.int64)
        part = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
        for start, stop in zip(edges, edges[1:], strict=False):
            if stop > start:
                yield b.slice(start, stop - start)


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def find_pieces(text: str) -> list[str]:
    """Pre-tokens in order."""
    return (LATIN if _latin(text) else PATTERN).findall(text)


def pieces_of(text: str, v: Vocabulary) -> list[str]:
    """Pre-tokens in order; special tokens are pieces of their own."""
    if v.split is None or not v.split.search(text):
        return find_pieces(text)
    return list(chain.from_iterable([p] if p in v.special else find_pieces(p) for p in v.split.split(text) if p))


def pieces_of_units(units: list[str], v: Vocabulary | None = None) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of all units, one after another, and how many each unit has.

    Units that begin with a space and end with a non-space are cut up together:
    where one ends no pre-token goes on.
    """
    plain = [u[:1] == " " and not u[-1].isspace() for u in units]
    joined = "".join([u for u, p in zip(units, plain, strict=True) if p])
    if not _latin(joined):
        plain = [p and _latin(u) for u, p in zip(units, plain, strict=True)]
        joined = "".join([u for u, p in zip(units, plain, strict=True) if p])
    if v is not None and v.split is not None and v.split.search(joined):
        plain, joined = [False] * len(units), ""
    flags = np.array(plain, bool)
    pieces = find_pieces(joined)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    unit_ends = np.cumsum(np.fromiter((len(u) for u, p in zip(units, plain, strict=True) if p), np.int64, int(flags.sum())))
    counts = np.zeros(len(units), np.int64)
    counts[flags] = np.diff(np.searchsorted(ends, unit_ends, side="right"), prepend=0)
    if flags.all():
        return pieces, counts
    rest = [pieces_of(u, v) if v is not None else find_pieces(u) for u, p in zip(units, plain, strict=True) if not p]
    counts[~flags] = [len(ps) for ps in rest]
    of = np.concatenate([np.repeat(np.flatnonzero(flags), counts[flags]), np.repeat(np.flatnonzero(~flags), counts[~flags])])
    every = [*pieces, *chain.from_iterable(rest)]
    return [every[i] for i in np.argsort(of, kind="stable").tolist()], counts

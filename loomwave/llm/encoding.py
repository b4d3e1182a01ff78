"""Encoding of a whole corpus by a byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern. Within a piece, a segment tree over the ranks of
adjacent pairs holds at its root the leftmost pair of lowest rank; merging it changes three leaves and
their paths, so a piece of n bytes takes O(n log n). Pieces of a batch that have not been seen yet are
merged together, one tree per row of a matrix; each worker keeps the pieces it has seen in a bounded table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NONE = np.iinfo(np.int64).max
#: Pieces kept per worker, and characters of text taken together.
MAX_PIECES = 1_000_000
CHUNK_CHARS = 2_000_000
#: A tree per matrix row needs this many pieces of one size to be worth it; fewer are merged one by one.
MIN_ROWS = 12


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """Ids of the 256 bytes, and of each mergeable pair (left * 2**20 + right, ascending) its rank and id."""

    pattern: str
    bytes_: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        model = json.load(open(path, encoding="utf-8"))["model"]
        ids = model["vocab"]
        halves = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([ids[a] << 20 | ids[b] for a, b in halves], np.int64)
        merged = np.array([ids[a + b] for a, b in halves], np.int64)
        order = np.argsort(pairs)
        return cls(pattern, np.array([ids[c] for c in byte_letters()], np.int64), pairs[order], np.arange(len(pairs))[order], merged[order])


@dataclass
class Merger:
    """Merges pieces by a vocabulary."""

    v: Vocabulary
    _scalar: dict[int, tuple[int, int]] | None = None

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the vocabulary, -1 where it can't be merged."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.v.pairs, key), len(self.v.pairs) - 1)
        return np.where(self.v.pairs[at] == key, at, -1)

    def merge_rows(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Merge each row of a matrix of byte ids (beyond its length: anything); merged-away places become -1."""
        rows, width = tokens.shape
        leaves = 1 << max(1, (width - 1).bit_length())
        tokens = np.where(np.arange(width) < lengths[:, None], tokens, -1)
        following = np.tile(np.arange(1, width + 1), (rows, 1))
        leading = np.tile(np.arange(-1, width - 1), (rows, 1))
        place = np.full((rows, leaves), -1, np.int64)  # of each leaf's pair in the vocabulary
        tree = np.full((rows, 2 * leaves), _NONE)  # rank * leaves + place of the leaf

        def leaf_values(r: np.ndarray, p: np.ndarray) -> np.ndarray:
            known = place[r, p]
            return np.where(known >= 0, self.v.ranks[known] * leaves + p, _NONE)

        r, p = np.nonzero((tokens[:, :-1] >= 0) & (tokens[:, 1:] >= 0))
        place[r, p] = self._look(tokens[r, p], tokens[r, p + 1])
        tree[r, leaves + p] = leaf_values(r, p)
        span = leaves
        while span > 1:
            half = span // 2
            tree[:, half:span] = np.minimum(tree[:, span : 2 * span : 2], tree[:, span + 1 : 2 * span : 2])
            span = half

        def update(r: np.ndarray, p: np.ndarray) -> None:
            node = leaves + p
            while node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        active = np.nonzero(tree[:, 1] != _NONE)[0]
        while len(active):
            p = tree[active, 1] % leaves
            right = following[active, p]
            tokens[active, p] = self.v.merged[place[active, p]]
            tokens[active, right] = -1
            after = following[active, right]
            following[active, p] = after
            has_after = after < lengths[active]
            leading[active[has_after], after[has_after]] = p[has_after]
            place[active, right] = -1
            tree[active, leaves + right] = _NONE
            update(active, right)
            place[active, p] = -1
            a, q, n = active[has_after], p[has_after], after[has_after]
            place[a, q] = self._look(tokens[a, q], tokens[a, n])
            tree[active, leaves + p] = leaf_values(active, p)
            update(active, p)
            before = leading[active, p]
            a, q, b = active[before >= 0], p[before >= 0], before[before >= 0]
            if len(a):
                place[a, b] = self._look(tokens[a, b], tokens[a, q])
                tree[a, leaves + b] = leaf_values(a, b)
                update(a, b)
            active = active[tree[active, 1] != _NONE]
        return tokens

    def merge_one(self, piece: bytes) -> list[int]:
        """The same for one piece, without matrices."""
        if self._scalar is None:
            self._scalar = dict(zip(self.v.pairs.tolist(), zip(self.v.ranks.tolist(), self.v.merged.tolist())))
        pairs, n = self._scalar, len(piece)
        tokens = self.v.bytes_[np.frombuffer(piece, np.uint8)].tolist()
        leaves = 1 << max(1, (n - 1).bit_length())
        following, leading = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [_NONE] * (2 * leaves)
        for i in range(n - 1):
            if known := pairs.get(tokens[i] << 20 | tokens[i + 1]):
                tree[leaves + i] = known[0] * leaves + i
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = leaves + i
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] != _NONE:
            i = tree[1] % leaves
            right = following[i]
            tokens[i] = pairs[tokens[i] << 20 | tokens[right]][1]
            tokens[right] = -1
            after = following[i] = following[right]
            put(right, _NONE)
            known = None
            if after < n:
                leading[after] = i
                known = pairs.get(tokens[i] << 20 | tokens[after])
            put(i, known[0] * leaves + i if known else _NONE)
            if (b := leading[i]) >= 0:
                known = pairs.get(tokens[b] << 20 | tokens[i])
                put(b, known[0] * leaves + b if known else _NONE)
        return [t for t in tokens if t >= 0]

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        classes = np.array([max(1, (n - 1).bit_length()) for n in lengths.tolist()])
        for c in np.unique(classes):
            at = np.nonzero(classes == c)[0]
            if len(at) < MIN_ROWS:
                for i in at:
                    out[i] = self.merge_one(pieces[i])
                continue
            width = int(lengths[at].max())
            for part in np.array_split(at, -(-len(at) * width // 2_000_000)):
                raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
                tokens = self.merge_rows(self.v.bytes_[raw], lengths[part])
                kept = tokens >= 0
                ends = np.cumsum(kept.sum(1))[:-1]
                for i, ids in zip(part, np.split(tokens[kept], ends)):
                    out[i] = ids.tolist()
        return out


@dataclass
class Encoder:
    """Encodes texts, keeping the pieces it has met in a bounded table."""

    v: Vocabulary
    known: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.merger, self.cut = Merger(self.v), regex.compile(self.v.pattern).findall
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        merged = self.merger.merge([p.encode() for p in pieces])
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.ids = np.concatenate([self.ids, *(np.array(m, np.int32) for m in merged)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(m) for m in merged])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        cuts = [self.cut(t) for t in texts]
        counts = np.array([len(c) for c in cuts])
        pieces = [p for c in cuts for p in c]
        known = self.known
        new = list({p for p in pieces if p not in known})
        if len(known) + len(new) > MAX_PIECES:
            known.clear()
            self.ids, self.starts = self.ids[:0], self.starts[:1]
            new = list(set(pieces))
        if new:
            self._learn(new)
        at = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        begin, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        total = int(size.sum())
        flat = np.arange(total) + np.repeat(begin - np.cumsum(size) + size, size)
        ends = np.concatenate([[0], np.cumsum(size)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[flat], np.diff(ends[edges])


def encode_corpus(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """df with `out`: the token ids of `text`, without special tokens; whole texts, one narrow pass, no shuffle.

    Null and empty texts give an empty list; blank texts are encoded like any other, and strings that look like
    special tokens are ordinary text. Other columns pass through; an existing column named `out` is replaced.
    The vocabulary (its size is fixed by its file) is broadcast, so workers need no file.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    source = df.drop(out) if out != text else df
    kept = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch[text].to_pylist()]
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= CHUNK_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                ids, counts = encoder.encode(texts[start:stop])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=[*kept, out])
                start = stop

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(ids: list[int], path: str) -> str:
    """The text of token ids, the inverse of the encoding."""
    names = {i: t for t, i in json.load(open(path, encoding="utf-8"))["model"]["vocab"].items()}
    of = {c: b for b, c in enumerate(byte_letters())}
    return bytes(of[c] for i in ids for c in names[i]).decode("utf-8", errors="replace")


def token_report(encoded: DataFrame, by: str, out: str = "ids") -> DataFrame:
    """Documents, tokens and characters a token, per value of `by`."""
    n = F.size(out)
    return encoded.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.max(n).alias("longest"))

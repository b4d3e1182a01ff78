"""Passages of evaluation items inside the pages of a corpus.

Latent semantic retrieval finds candidates: passages of pages and of items become TF-IDF vectors over the
items' words, a randomised SVD of all page passages gives the latent space, and a cosine search there names
for each page passage the items it may quote. The longest common subsequence of words and a check for the answer of
the item's question then tell quotations and paraphrases from pages that are merely near; a quotation must also
carry a run of consecutive item words, where misread letters, broken words and lines of other columns or adverts
in between are allowed for.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwave.llm.pages import BREAKS, LONG_WORD, deletions, page_words, pieces, reading_orders, shares_letters, split_lines, tolerance
from loomwave.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Settings:
    """Parameters of the search; all hold for every page alike."""

    run: int = 12  # consecutive item words that make a leak
    passage: int = 48  # words of a page passage
    stride: int = 24
    window: int = 16  # words of an item passage
    window_stride: int = 4
    least_weight: float = 0.1  # of a word, however common
    rank: int = 128  # dimensions of the latent space
    oversample: int = 16
    seed: int = 7
    cosine: float = 0.4
    mass: float = 0.2  # squared latent length that a page passage needs, as a share of the item passage's
    captured: float = 0.2  # share of an item passage's squared length that the latent space must hold
    overlap: float = 0.5  # distinct words that a page passage must share with an item passage beyond that, as a share
    subsequence: float = 2 / 3  # common subsequence that a candidate needs, as a share of a run (broken words don't count in it)
    paraphrase: float = 0.6  # the same of a paraphrase, as a share of the item's passage
    answer: float = 0.6  # weight of the answer's words that a paraphrase must carry, as a share
    skip_lines: int = 12  # foreign lines that may stand between two lines of a passage
    block_chars: int = 4_000_000  # characters of evaluation items searched for together
    most_chars: int = 40_000_000  # characters of evaluation items in all


#: Entries of a block of passages that become one matrix: fewer where words are many, as the matrix is wider there.
_ENTRIES, _LEAST_ENTRIES, _CELLS = 20_000, 2_048, 6_000_000
#: Words of one piece of a matrix on its way through a shuffle.
_PIECE = 1024
#: Words whose matches a task remembers.
_KNOWN = 300_000
_QUESTION = re.compile(r"question\s*:", re.IGNORECASE)


def split_question(text: str) -> tuple[str, str]:
    """Passage and question of an item: what follows the last `Question:`, else a last sentence that ends with a question mark, else none."""
    marks = list(_QUESTION.finditer(text))
    if marks:
        return text[: marks[-1].start()], text[marks[-1].end() :]
    bare = text.rstrip()
    if not bare.endswith("?"):
        return text, ""
    at = max(bare.rfind(mark, 0, -1) for mark in ".!?")
    return bare[: at + 1], bare[at + 1 :]


class Words:
    """The words of all evaluation items, each with a number, and the page words that may be misreadings of them."""

    def __init__(self, texts: Iterator[str]):
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in page_words(t)))}
        self.known: dict[bytes, np.ndarray] = {}
        self.near: dict[bytes, set[int]] | None = None

    def __getstate__(self) -> dict:
        return {"number": self.number, "known": {}, "near": None}

    def _prepare(self) -> None:
        self.near, self.long, self.spelling = defaultdict(set), defaultdict(set), list(self.number)
        for w, i in self.number.items():
            if len(w) < LONG_WORD + 2:
                for x in deletions(w, tolerance(w)):
                    self.near[x].add(i)
            if len(w) >= LONG_WORD - 2:
                for key in pieces(w):
                    self.long[len(w), *key].add(i)
        self.long_lengths = {k[0] for k in self.long}

    def matches(self, word: bytes) -> np.ndarray:
        """Numbers of the words that a page word may be a misreading of, whatever its length."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > _KNOWN:
                self.known.clear()
            if self.near is None:
                self._prepare()
            most, exact = tolerance(word), self.number.get(word)
            if exact is not None and len(word) < 4:
                near = {exact}
            elif len(word) < LONG_WORD:
                near = {i for x in deletions(word, most) for i in self.near.get(x, ()) if abs(len(self.spelling[i]) - len(word)) <= max(1, most)}
            else:
                near = set()
                for n in self.long_lengths.intersection(range(len(word) - most, len(word) + most + 1)):
                    for key in pieces(word, n, most):
                        near.update(i for i in self.long.get((n, *key), ()) if i not in near and shares_letters(word, self.spelling[i], most))
            found = self.known[word] = np.array(sorted(near), np.int64)
        return found


class Item:
    """One evaluation item: its words as numbers, and which of them answer its question."""

    def __init__(self, item_id: int, text: str, words: Words, weights: np.ndarray):
        passage, question = split_question(text)
        number = words.number
        self.item_id, self.words = item_id, np.array([number[w] for w in page_words(text)], np.int64)
        self.n_passage = len(page_words(passage))
        asked = {number[w] for w in page_words(question) if w in number}
        sentences = [{number[w] for w in page_words(s) if w in number} for s in re.split(r"(?<=[.!?])\s+", passage)]
        related = [sum(weights[w] for w in s & asked) for s in sentences]
        self.answer = sentences[int(np.argmax(related))] - asked if asked and max(related) > 0 else set()


def _passages(ids: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Passage numbers and word numbers of a page's known words; each word stands in up to passage/stride passages."""
    at = np.nonzero(ids >= 0)[0]
    last = at // settings.stride
    parts = settings.passage // settings.stride
    number = np.concatenate([last - k for k in range(parts)])
    word = np.tile(ids[at], parts)
    keep = number >= 0 if len(ids) > settings.passage else number == 0
    return number[keep], word[keep]


def _reordered(text: str, order: np.ndarray) -> str:
    lines = split_lines(text)
    return "\n".join(lines[i] for i in order) if len(lines) == len(order) else text


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    """Page number in the batch and text in reading order of pages with a text."""
    _, offsets, local, crossed = reading_orders(batch["xs"], batch["ys"])
    for i, text in enumerate(batch["text"].to_pylist()):
        if text:
            yield i, _reordered(text, local[offsets[i] : offsets[i + 1]]) if crossed[i] else text


def _blocks(rows: np.ndarray, words: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Names of rows, word numbers, and their TF-IDF matrix, for blocks of whole rows (rows ascend)."""
    most = max(_LEAST_ENTRIES, min(_ENTRIES, _CELLS // max(len(weights), 1)))
    at = 0
    while at < len(rows):
        end = int(np.searchsorted(rows, rows[min(at + most, len(rows)) - 1], "right"))
        names, r = np.unique(rows[at:end], return_inverse=True)
        used, w = np.unique(words[at:end], return_inverse=True)
        count = np.bincount(r * len(used) + w, minlength=len(names) * len(used)).reshape(len(names), len(used)).astype(float)
        yield names, used, np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0) * weights[used]
        at = end


_SUMS = "rows binary, words binary, piece int, slot int, sums binary"


def _row(rows: bytes | None = None, words: bytes | None = None, piece: int | None = None, slot: int | None = None, sums: bytes | None = None) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((rows, words, piece, slot, sums), kinds)], names=["rows", "words", "piece", "slot", "sums"])


def _pieces_of(matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's matrix as binary rows of a bounded size; slot spreads the tasks over the first step of the sum."""
    slot = int(TaskContext.get().partitionId() ** 0.5)
    for i in range(0, len(matrix), _PIECE):
        yield _row(piece=i // _PIECE, slot=slot, sums=np.ascontiguousarray(matrix[i : i + _PIECE], np.float64).tobytes())


def _summed(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum over the tasks of their matrices, added as binaries in two steps; one matrix of words x rank reaches the driver."""

    def add(keep_slot: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for piece, slot, sums in zip(batch["piece"].to_pylist(), batch["slot"].to_pylist(), batch["sums"].to_pylist()):
                    key, part = (piece, slot if keep_slot else 0), np.frombuffer(sums, np.float64)
                    if key in total:
                        total[key] += part
                    else:
                        total[key] = part.copy()
            for (piece, slot), sums in total.items():
                yield _row(piece=piece, slot=slot, sums=sums.tobytes())

        return run

    parts = df.where("sums is not null").repartition("piece", "slot").mapInArrow(add(True), _SUMS).repartition("piece").mapInArrow(add(False), _SUMS)
    out = np.zeros(shape[0] * shape[1])
    for r in parts.select("piece", "sums").toLocalIterator():
        part = np.frombuffer(r["sums"], np.float64)
        at = r["piece"] * _PIECE * shape[1]
        out[at : at + len(part)] = part
    return out.reshape(shape)


def _index(pages: DataFrame, words: Words, settings: Settings) -> DataFrame:
    """The passages of all pages as numbers (`rows`, `words`: int32), and per task each word's number of pages (`sums`, the last is all pages)."""
    shared = pages.sparkSession.sparkContext.broadcast((words.number, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, settings = shared.value
        look = number.get
        pages_of = np.zeros((len(number) + 1, 1))
        for batch in batches:
            rows, words, base = [], [], 0
            for _, text in _read(batch):
                ids = np.fromiter(map(look, page_words(text), repeat(-1)), np.int64)
                known = np.unique(ids[ids >= 0])
                pages_of[known] += 1
                pages_of[-1] += 1
                if len(known):
                    r, w = _passages(ids, settings)
                    rows.append(r + base)
                    words.append(w)
                    base += int(r.max(initial=0)) + 1
            r, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, words))
            order = np.argsort(r, kind="stable")
            yield _row(r[order].astype(np.int32).tobytes(), w[order].astype(np.int32).tobytes())
        yield from _pieces_of(pages_of)

    ensure_checkpoint_dir(pages.sparkSession)
    return pages.mapInArrow(run, _SUMS).checkpoint()


def _gram_times(index: DataFrame, weights: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """A'A times a probe matrix, A being the TF-IDF rows of all passages; each task adds to one matrix of words x rank."""
    shared = index.sparkSession.sparkContext.broadcast((weights, probe))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, probe = shared.value
        total = np.zeros_like(probe)
        for batch in batches:
            for rows, words in zip(batch["rows"].to_pylist(), batch["words"].to_pylist()):
                if rows is not None:
                    for _, used, a in _blocks(np.frombuffer(rows, np.int32).astype(np.int64), np.frombuffer(words, np.int32).astype(np.int64), weights):
                        total[used] += a.T @ (a @ probe[used])
        yield from _pieces_of(total)

    return _summed(index.where("rows is not null").mapInArrow(run, _SUMS), probe.shape)


def latent_basis(index: DataFrame, weights: np.ndarray, settings: Settings) -> np.ndarray:
    """Right singular vectors of the passages' TF-IDF matrix by a randomised SVD with one power iteration."""
    width = min(len(weights), settings.rank + settings.oversample)
    probe = np.random.default_rng(settings.seed).standard_normal((len(weights), width))
    q, _ = np.linalg.qr(_gram_times(index, weights, probe))
    inner = q.T @ _gram_times(index, weights, q)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return q @ vectors[:, np.argsort(-values)[: settings.rank]]


class Laid:
    """Some items laid end to end with a place between them, and where each word stands in them."""

    def __init__(self, items: list[Item]):
        self.words = np.concatenate([np.append(i.words, -1) for i in items])
        ends = np.cumsum([len(i.words) + 1 for i in items])
        self.starts = np.append(0, ends[:-1])
        order = np.argsort(self.words, kind="stable")
        names, cuts = np.unique(self.words[order], return_index=True)
        self.at = dict(zip(names.tolist(), np.split(order, cuts[1:])))
        self.gap = sum(1 << int(e - 1) for e in ends)
        self.first = sum(1 << int(a) for a in self.starts)
        self.ends = ends
        self.bits: dict[int, int] = {}

    def places(self, found: np.ndarray) -> np.ndarray:
        at = [self.at[w] for w in found.tolist() if w in self.at]
        return at[0] if len(at) == 1 else np.concatenate(at) if at else np.zeros(0, np.int64)

    def mask(self, found: np.ndarray) -> int:
        """The places of words as bits of a number."""
        out = 0
        for w in found.tolist():
            if w in self.at:
                if w not in self.bits:
                    row = np.zeros(len(self.words), np.uint8)
                    row[self.at[w]] = 1
                    self.bits[w] = int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")
                out |= self.bits[w]
        return out

    def common(self, masks: list[int]) -> list[int]:
        """For each item the length of its longest common subsequence with a row of words, given as masks.

        One bit per place of all items; the place between two items takes up the borrow of the one before.
        """
        state, inside = 0, ((1 << len(self.words)) - 1) & ~self.gap
        for mask in masks:
            if mask:
                seen = state | mask | self.gap
                state = seen & ~(seen - ((state << 1) & inside | self.first)) & inside
        return [(state >> int(a) & ((1 << int(b - a)) - 1)).bit_count() for a, b in zip(self.starts, self.ends)]


class Searcher:
    """Candidate items of page passages in the latent space, and what the pages carry of them."""

    def __init__(self, words: Words, items: list[tuple[int, str]], weights: np.ndarray, basis: np.ndarray, settings: Settings):
        self.words, self.weights, self.basis, self.settings = words, weights, basis, settings
        self.items = [Item(i, t, words, weights) for i, t in items]
        rows, numbers, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for k, item in enumerate(self.items):
            for start in range(0, max(1, len(item.words) - settings.window + settings.window_stride), settings.window_stride):
                part = item.words[start : start + settings.window]
                if len(part) >= settings.run:
                    rows.append(np.full(len(part), len(owner)))
                    numbers.append(part)
                    owner.append(k)
        owner = np.array(owner, np.int64)
        latent, whole, names = [np.zeros((0, basis.shape[1]))], [np.zeros(0)], [np.zeros(0, np.int64)]
        for n, used, a in _blocks(np.concatenate(rows), np.concatenate(numbers), weights):
            latent.append(a @ basis[used])
            whole.append((a**2).sum(1))
            names.append(n)
        latent, whole, owner = np.concatenate(latent), np.concatenate(whole), owner[np.concatenate(names)]
        energy = (latent**2).sum(1)
        held = energy >= settings.captured * whole
        held_at = np.nonzero(held)[0]
        order = held_at[np.argsort(energy[held_at], kind="stable")]
        self.energy = energy[order]
        self.windows = (latent[order] / np.sqrt(np.maximum(self.energy, 1e-300))[:, None]).astype(np.float32)
        self.owners = owner[order]
        beyond = np.nonzero(~held)[0]
        self.beyond = [(int(owner[b]), np.unique(numbers[b + 1])) for b in beyond]

    def candidates(self, rows: np.ndarray, numbers: np.ndarray) -> dict[int, set[int]]:
        """For each passage row the items with a passage that is near in the latent space.

        Item passages that the latent space hardly holds are compared by the distinct words that they share instead.
        """
        out: dict[int, set[int]] = defaultdict(set)
        if not len(self.windows) and not self.beyond:
            return out
        least = self.energy.min() if len(self.energy) else np.inf
        for names, used, a in _blocks(rows, numbers, self.weights):
            latent = a @ self.basis[used]
            energy = (latent**2).sum(1)
            heavy = np.nonzero((energy > 0) & (energy >= self.settings.mass * least))[0]
            heavy = heavy[np.argsort(energy[heavy], kind="stable")]
            for part in np.array_split(heavy, -(-len(heavy) // 128) or 1):
                if not len(part):
                    continue
                # item passages by rising length: those that a block of passages is too short for are left out
                k = int(np.searchsorted(self.energy, energy[part[-1]] / self.settings.mass, "right"))
                z = (latent[part] / np.sqrt(energy[part, None])).astype(np.float32)
                passage, window = np.nonzero((z @ self.windows[:k].T >= self.settings.cosine) & (energy[part, None] >= self.settings.mass * self.energy[:k]))
                for i, owner in zip(names[part[passage]].tolist(), self.owners[window].tolist()):
                    out[i].add(owner)
            for owner, window in self.beyond:
                at = np.searchsorted(used, window)
                at = at[(at < len(used)) & (used[np.minimum(at, len(used) - 1)] == window)]
                if len(at) >= self.settings.overlap * len(window):
                    for i in np.nonzero((a[:, at] > 0).sum(1) >= self.settings.overlap * len(window))[0]:
                        out[int(names[i])].add(owner)
        return out

    def longest_runs(self, lines: list[str], words: list[list[bytes]], laid: Laid) -> np.ndarray:
        """For each place of the items laid end to end the longest run of words that the lines carry up to it."""
        best, zero = np.zeros(len(laid.words), np.int32), np.zeros(len(laid.words), np.int32)
        places: dict[bytes, np.ndarray] = {}

        def step(before: np.ndarray, word: bytes) -> np.ndarray:
            at = places.get(word)
            if at is None:
                at = places[word] = laid.places(self.words.matches(word))
            if not len(at):
                return zero
            after = np.zeros_like(before)
            after[at] = before[at - 1] + 1
            np.maximum(best, after, out=best)
            return after

        ends: deque[np.ndarray] = deque(maxlen=self.settings.skip_lines)
        broken: deque[tuple[bytes, np.ndarray]] = deque(maxlen=self.settings.skip_lines)
        for line, line_words in zip(lines, words):
            if not line_words:
                continue
            now = zero
            for e in ends:
                if e is not zero:
                    now = e if now is zero else np.maximum(now, e)
            breaks = line.rstrip()[-1:] in BREAKS
            pending = (b"", zero)
            for k, word in enumerate(line_words):
                if breaks and k == len(line_words) - 1:
                    pending = (word, now)
                after = step(now, word)
                if k == 0:
                    for part, before in broken:
                        if before is not zero:
                            after = np.maximum(after, step(before, part + word))
                now = after
            ends.append(now)
            broken.append(pending)
        return best

    def judge(self, text: str, hot: dict[int, set[int]]) -> list[tuple[int, int, int, bool, bool]]:
        """(item, run, common words, answered, quoted) of a page's candidates that quote or paraphrase."""
        s = self.settings
        lines = split_lines(text)
        words = [page_words(line) for line in lines]
        upto = np.cumsum([len(w) - (line.rstrip()[-1:] in BREAKS) for w, line in zip(words, lines)])
        a = max(0, int(np.searchsorted(upto, min(hot) * s.stride, "left")) - s.skip_lines)
        b = int(np.searchsorted(upto, max(hot) * s.stride + s.passage, "right")) + s.skip_lines
        near = [self.items[k] for k in sorted(set().union(*hot.values()))]
        laid, page = Laid(near), page_words("\n".join(lines[a:b]))
        masks = {w: laid.mask(self.words.matches(w)) for w in set(page)}
        common = laid.common([masks[w] for w in page])
        kept = [(item, n) for item, n in zip(near, common) if n >= s.subsequence * s.run]
        if not kept:
            return []
        laid = Laid([item for item, _ in kept])
        runs = np.maximum.reduceat(self.longest_runs(lines[a:b], words[a:b], laid), laid.starts).tolist()
        out, here = [], None
        for (item, n), run in zip(kept, runs):
            if run < s.run and n < s.paraphrase * max(item.n_passage, s.run):
                continue
            if here is None:
                here = {w for word in masks for w in self.words.matches(word).tolist()}
            answered = bool(item.answer) and sum(self.weights[w] for w in item.answer & here) >= s.answer * sum(self.weights[w] for w in item.answer)
            if run >= s.run or answered:
                out.append((item.item_id, run, n, answered, run >= s.run))
        return out


def _evaluation_items(items: DataFrame, settings: Settings) -> list[tuple[int, str]]:
    """The items with an id and a text, one row each; their size is checked, as they are broadcast."""
    kept = items.select("item_id", "text").where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    out, chars = [], 0
    for r in kept.orderBy("item_id").toLocalIterator():
        out.append((r["item_id"], r["text"]))
        chars += len(r["text"])
        if chars > settings.most_chars:
            raise ValueError(f"the evaluation items hold over {settings.most_chars} characters (most_chars); search for them in parts")
    return out


_LEAK = "doc_id long, item_id long, n_words int, n_common int, answered boolean, quoted boolean"


def find_leaks(documents: DataFrame, items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Pages that quote or paraphrase an item: doc_id, item_id, n_words (longest run), n_common (longest common
    subsequence), answered (the page carries the sentence that answers the item's question), quoted.

    quoted: at least `run` consecutive words of the item's text. The other rows are paraphrases: they keep the order of
    most of the passage's words and carry the answer, without such a run. documents: doc_id, text, ocr_lines (array of
    struct with x and y; null or of another length than the lines: the stored order is the order of reading). Pages
    pass through narrow scans only; what is gathered is one matrix of the items' words x rank, however many pages. All
    items share one vocabulary and one latent space; blocks of items bound what one scan holds and change no result.
    Words in many or all pages keep a weight, and item passages that the latent space hardly holds are searched for by
    their words, so no item is lost by what the pages have in common. Null, empty and blank texts and items of fewer
    words than a run give no row; of an item with several texts the least counts; a repeated page gives a row
    for each of its doc_ids, a repeated row one.
    """
    settings = settings or Settings()
    spark = documents.sparkSession
    pages = documents.select("doc_id", "text", F.coalesce(F.col("ocr_lines.x"), F.array().cast("array<int>")).alias("xs"), F.coalesce(F.col("ocr_lines.y"), F.array().cast("array<int>")).alias("ys"))
    found = spark.createDataFrame([], _LEAK)
    wanted = _evaluation_items(items, settings)
    words = Words(t for _, t in wanted)
    if words.number:
        index = _index(pages.drop("doc_id"), words, settings)
        seen = _summed(index, (len(words.number) + 1, 1))[:, 0]
        weights = np.maximum(np.log((1 + seen[-1]) / (1 + seen[:-1])), settings.least_weight)
        basis = latent_basis(index, weights, settings)
        block, chars = [], 0
        for n, item in enumerate(wanted):
            block.append(item)
            chars += len(item[1])
            if chars >= settings.block_chars or n == len(wanted) - 1:
                found = found.unionByName(_search(pages, words, block, weights, basis, settings))
                block, chars = [], 0
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("n_words", "n_common", "answered", "quoted")))


def _search(pages: DataFrame, words: Words, items: list[tuple[int, str]], weights: np.ndarray, basis: np.ndarray, settings: Settings) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast((words, items, weights, basis, settings))
    names = [f.strip().split(" ")[0] for f in _LEAK.split(",")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, items, weights, basis, settings = shared.value
        searcher, look = Searcher(words, items, weights, basis, settings), words.number.get
        for batch in batches:
            doc_ids, out = batch["doc_id"].to_pylist(), []
            texts, rows, numbers, of, base = {}, [], [], [], 0
            for i, text in _read(batch):
                ids = np.fromiter(map(look, page_words(text), repeat(-1)), np.int64)
                if not (ids >= 0).any():
                    continue
                texts[i] = text
                r, w = _passages(ids, settings)
                n = int(r.max(initial=0)) + 1
                rows.append(r + base)
                numbers.append(w)
                of += [(i, k) for k in range(n)]
                base += n
            if rows:
                r, w = np.concatenate(rows), np.concatenate(numbers)
                order = np.argsort(r, kind="stable")
                hot: dict[int, dict[int, set[int]]] = defaultdict(dict)
                for row, near in searcher.candidates(r[order], w[order]).items():
                    page, passage = of[row]
                    hot[page][passage] = near
                for page, passages in hot.items():
                    out += [(doc_ids[page], *leak) for leak in searcher.judge(texts[page], passages)]
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return pages.mapInArrow(run, _LEAK)


def item_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Each item with its kind, the pages that quote it, the longest run of its words and the pages that paraphrase it."""
    n = lambda c, out: F.sum(c.cast("long")).alias(out)
    per = leaks.groupBy("item_id").agg(n(F.col("quoted"), "n_pages"), F.max(F.when(F.col("quoted"), F.col("n_words"))).alias("longest"), n(~F.col("quoted"), "n_paraphrases"))
    return items.select("item_id", "item_kind").distinct().join(per, "item_id", "left").fillna(0, ["n_pages", "longest", "n_paraphrases"])

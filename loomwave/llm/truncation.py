"""Pages whose stored text was cut at a length limit or in transfer.

Near-copies are found by min-hash banding over shingles of five words and verified by alignment: the copy whose
alignment ends before the other's text does was cut short. Every page is also scored by the terminality of its
closing words: how much more often than chance a word stands at that distance from the end of a page. Pages
end soundly with a finished sentence, or with words that close pages again and again (adverts, imprints,
notes of continuation), whatever they say.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwave.functions.keys import strip_blanks
from loomwave.llm.pages import page_words, reading_orders, split_lines
from loomwave.session import materialised


@dataclass(frozen=True)
class Settings:
    """Parameters; all hold for every page alike."""

    shingle: int = 5
    bands: int = 32
    rows: int = 3
    similarity: float = 0.8  # share of the shorter page's shingles that a near-copy carries
    likely: float = 0.5  # the same as estimated from signatures, below which a pair is not aligned
    part: int = 10_000  # texts of a band that one task compares
    closing: int = 7  # words from the end whose terminality is looked at
    lift: float = 30.0  # times chance that pages must end alike
    beside: float = 4.0  # the same, one word further from the end than a distance that has the lift
    beside_evidence: float = 2.5  # and its log-likelihood ratio against chance
    last_share: float = 0.85  # of the pages that end with a word, those that earlier words must close already before it counts as a last word
    last_bound: float = 0.6  # lower bound of that share with 95 % confidence
    last_letters: int = 5  # letters that such a word must have, as cuts leave shorter pieces again and again
    limit_evidence: float = 0.0  # log-likelihood ratio of such a pile against the source's usual ones, beyond the logarithm of their number
    limit_share: float = 0.03  # of a source's pages that must have the same length to show a limit
    abbreviation: float = 0.1  # a dotted word that ends pages less often than this share of the usual is an abbreviation
    short: float = 3.0  # letters that a line's text may fall behind its box
    counted: int = 300_000  # distinct words counted before a task hands its counts on
    marks: int = 1 << 23  # bits that mark texts as likely repeated


#: Abbreviations that end no sentence (fixed values).
ABBREVIATIONS = frozenset("d mr mrs dr st rev messrs esq hon capt col sergt ald no nr m mm mme mlle hr".split())
#: Shillings and pence, which are dotted within sentences; shown as the abbreviation d.
_MONEY = re.compile(r"[0-9]\s*[sd]\.$")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NO_SHINGLE = np.uint32(2**32 - 1)
_PAGE = "doc_id long, copy_key long, source string, n_chars int, n_bytes int, n_words int, closing array<string>, final boolean, dotted string, broken_off boolean, stored_final boolean, signature binary, word string, n long, n_dotted long, repeated string"
_NAMES = [f.strip().split(" ")[0] for f in _PAGE.split(",")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
_KINDS = {f.strip().split(" ")[0]: _ARROW[f.strip().split(" ")[1]] for f in _PAGE.split(",")}


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words (of all words, if there are fewer)."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation min-hash: the least hash of each bin; an empty bin takes the next filled one's."""
    out = np.full(bins, _NO_SHINGLE)
    if not len(hashes):
        return out
    np.minimum.at(out, (hashes % np.uint64(bins)).astype(np.int64), ((hashes >> np.uint64(32)).astype(np.uint32)) >> np.uint32(1))
    filled = np.nonzero(out != _NO_SHINGLE)[0]
    return out[filled[np.searchsorted(filled, np.arange(bins)) % len(filled)]]


def sentence_final(text: str) -> tuple[bool, str | None]:
    """Whether a text ends with a sentence mark, and the word before a single final dot."""
    bare = text.rstrip().rstrip("\"'”’»)]")
    if bare[-1:] not in (".", "!", "?"):
        return False, None
    if bare[-1] != "." or bare[-2:-1] == ".":
        return True, None
    if _MONEY.search(bare[-12:]):
        return True, "d"
    tail = page_words(bare[-120:])
    return True, tail[-1].decode() if tail else None


def _count(read: str, words: list[bytes], counts: Counter[bytes], dotted: Counter[bytes]) -> None:
    counts.update(words)
    dotted.update(w for t in read.split() if t[-1] == "." and t[-2:-1] != "." for w in page_words(t)[-1:])


def _counted(counts: Counter[bytes], dotted: Counter[bytes]) -> pa.RecordBatch:
    columns = {"word": pa.array([w.decode() for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64()), "n_dotted": pa.array([dotted.get(w, 0) for w in counts], pa.int64())}
    return _batch(columns, len(counts))


def _repeated_words(settings: Settings):
    """The word counts of texts given once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        dotted: Counter[bytes] = Counter()
        for batch in batches:
            for read in batch["read"].to_pylist():
                _count(read, page_words(read), counts, dotted)
            if len(counts) > settings.counted:
                yield _counted(counts, dotted)
                counts.clear()
                dotted.clear()
        yield _counted(counts, dotted)

    return run


def _repeat_marks(pages: DataFrame, settings: Settings) -> np.ndarray:
    """Bits at the copy keys, modulo their number, of texts that stand in several rows. At most settings.marks / 64 rows reach the driver."""
    bit = F.pmod("copy_key", F.lit(settings.marks))
    several = pages.groupBy("copy_key").agg(F.count("*").alias("n")).where("n > 1").select(bit.alias("bit"))
    cells = several.groupBy(F.expr("bit div 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))
    marks = np.zeros(settings.marks // 64, np.int64)
    found = cells.toPandas()
    marks[found["cell"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64)
    return marks


def _features(settings: Settings, marks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        dotted: Counter[bytes] = Counter()
        handed: set[int] = set()
        for batch in batches:
            _, offsets, local, crossed = reading_orders(batch["xs"], batch["ys"])
            widths = batch["ws"].flatten().to_numpy(zero_copy_only=False)
            keys, sources = batch["copy_key"].to_pylist(), batch["source"].to_pylist()
            bits = batch["copy_key"].to_numpy(zero_copy_only=False) % settings.marks
            marked = (marks[bits // 64] >> (bits % 64)) & 1
            rows, repeated = [], []
            for i, (doc_id, text) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())):
                if not text or not text.strip():
                    continue
                off, read, stored = False, text, None
                if crossed[i]:
                    lines = split_lines(text)
                    order = local[offsets[i] : offsets[i + 1]]
                    if len(lines) == len(order):
                        read = "\n".join(lines[k] for k in order)
                        stored = sentence_final(text)[0]
                        off = _broken_off(lines, widths[offsets[i] : offsets[i + 1]], settings.short)
                words = page_words(read)
                if not marked[i]:
                    _count(read, words, counts, dotted)
                elif keys[i] not in handed:
                    handed.add(keys[i])
                    repeated.append((keys[i], read))
                final, word = sentence_final(read)
                sig = signature(shingle_hashes(words, settings.shingle), settings.bands * settings.rows)
                rows.append((doc_id, keys[i], sources[i], len(text), len(text.encode()), len(words), [w.decode() for w in words[: -settings.closing - 1 : -1]], final, word, off, final if stored is None else stored, sig.tobytes()))
            if rows:
                cols = list(zip(*rows))
                yield _batch({n: pa.array(c, _KINDS[n]) for n, c in zip(_NAMES, cols)}, len(rows))
            if repeated:
                yield _batch({n: pa.array(c, _KINDS[n]) for n, c in zip(("copy_key", "repeated"), zip(*repeated))}, len(repeated))
            if len(counts) > settings.counted:
                yield _counted(counts, dotted)
                counts.clear()
                dotted.clear()
        yield _counted(counts, dotted)

    return run


def _batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, _KINDS[c])) for c in _NAMES], names=_NAMES)


def _broken_off(lines: list[str], widths: np.ndarray, short: float) -> bool:
    """Whether the last stored line falls behind its box and ends no sentence."""
    lengths = np.array([len(line) for line in lines])
    some = lengths > 0
    if not some.any() or sentence_final(lines[-1])[0]:
        return False
    return bool(widths[-1] / np.median(widths[some] / lengths[some]) - lengths[-1] >= short)


def page_features(documents: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Per page with a text its closing, signature and copy key; per word its counts over distinct texts. A narrow scan, written once, after one that marks repeated texts.

    Words of marked texts are counted apart, once a text: each task hands on one reading of each, and the least is taken.
    """
    boxes = lambda c: F.coalesce(F.col(f"ocr_lines.{c}"), F.array().cast("array<int>")).alias(f"{c}s")
    pages = documents.select("doc_id", "text", "source", F.xxhash64("text", F.length("text")).alias("copy_key"), boxes("x"), boxes("y"), boxes("w"))
    keys = documents.select(F.xxhash64("text", F.length("text")).alias("copy_key")).where("copy_key is not null")
    rows = materialised(pages.mapInArrow(_features(settings, _repeat_marks(keys, settings)), _PAGE))
    once = rows.where("repeated is not null").groupBy("copy_key").agg(F.min("repeated").alias("read")).select("read")
    counts = rows.where("word is not null").select("word", "n", "n_dotted").unionByName(once.mapInArrow(_repeated_words(settings), _PAGE).select("word", "n", "n_dotted"))
    words = materialised(counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_dotted").alias("n_dotted")))
    return rows.where("doc_id is not null").drop("word", "n", "n_dotted", "repeated"), words


def near_classes(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """copy_key, class of the texts that have a likely near-copy: one class per connected group of `pairs`.

    Least labels spread along the pairs and are looked up again, until none moves.
    """
    edges = materialised(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialised(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        beside = edges.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("least"))
        up = labels.select(F.col("doc_id").alias("label"), F.col("label").alias("up"))
        spread = labels.join(beside, "doc_id").join(up, "label").select("doc_id", F.least("label", "least", "up").alias("new"), "label")
        spread = materialised(spread)
        labels = spread.select("doc_id", F.col("new").alias("label"))
        if spread.where("new <> label").isEmpty():
            break
    return pages.select("doc_id", "copy_key").join(labels, "doc_id").groupBy("copy_key").agg(F.xxhash64(F.min("label")).alias("class"))


def evidence(seen: Column, expected: Column) -> Column:
    """Log-likelihood ratio of a count against what chance lets expect (Poisson). Beyond the logarithm of the number of
    counts looked at, fewer than about one of all of them is so far from chance by itself, in tables of any size."""
    return F.coalesce(seen * F.log(F.nullif(seen, F.lit(0)) / expected), F.lit(0.0)) - (seen - expected)


def lower_bound(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of the 95 % interval of a share (Wilson)."""
    share = hits / n
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def closing_scores(pages: DataFrame, words: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, copy_key, source, `sound` and `open`: pages that end neither with a finished sentence nor with words that close pages.

    The terminality of a word at a distance is its share of occurrences there, over that of all words. As a cut
    leaves pieces of words at the very end, a last word counts only if earlier words close most pages that end
    with it. A page that has a length at which its source's pages pile up is open too if its last stored line ends no
    sentence, whatever its closing. A class of near-copies counts once among the pages that end alike or are as long:
    copies cut at the same place show no closing. Unsound pages are counted by class too, words over distinct texts. Only aggregated counts are joined; totals are one row.
    """
    usual = pages.where("dotted is not null").groupBy("copy_key").agg(F.min("dotted").alias("word")).groupBy("word").agg(F.count("*").alias("ends"))
    dots = usual.join(words, "word").select("word", "ends", "n_dotted")
    overall = dots.agg(F.sum("ends").alias("e"), F.sum("n_dotted").alias("d"), F.count("*").alias("k"))
    usual_ends = F.col("n_dotted") * F.col("e") / F.col("d")
    rare = dots.join(F.broadcast(overall)).where((F.col("ends") < settings.abbreviation * usual_ends) & (evidence(F.col("ends"), usual_ends) >= F.log("k"))).select(F.col("word").alias("dotted"), F.lit(True).alias("rare"))
    known = F.col("dotted").isin(*ABBREVIATIONS)
    ended = pages.join(rare, "dotted", "left").join(classes, "copy_key", "left")
    ended = materialised(ended.select("doc_id", "copy_key", F.coalesce("class", "copy_key").alias("class"), "source", "n_chars", "n_bytes", "stored_final", "closing", "broken_off", (F.col("final") & ~F.coalesce(known | F.col("rare"), F.lit(False))).alias("sound")))
    last = ended.where("not sound").select("doc_id", "class", F.posexplode("closing").alias("k", "word"))
    at_end = last.groupBy("word", "k", "class").agg(F.lit(1).alias("one")).groupBy("word", "k").agg(F.count("*").alias("ends")).where("ends > 1")
    totals = words.agg(F.sum("n").alias("all_words"), (F.count("*") * settings.closing).alias("tests")).join(F.broadcast(ended.where("not sound").select("class").distinct().agg(F.count("*").alias("unsound"))))
    chance = F.col("n") * F.greatest(F.col("unsound"), F.lit(1)) / F.col("all_words")
    found = evidence(F.col("ends"), chance)
    lifted = at_end.join(words, "word").join(F.broadcast(totals)).select("word", "k", (F.col("ends") / chance).alias("lift"), found.alias("evidence"), (found >= F.log("tests")).alias("sure"))
    by = Window.partitionBy("word").orderBy("k")
    high = F.col("sure") & (F.col("lift") >= settings.lift)
    next_to = (F.lag("k").over(by) == F.col("k") - 1) & F.lag(high).over(by) & (F.col("lift") >= settings.beside) & (F.col("evidence") >= settings.beside_evidence)
    strong = lifted.where("k > 0").withColumn("strong", high | next_to).where("strong").select("word", "k")
    closed = materialised(last.join(strong, ["word", "k"], "left_semi").select("doc_id").distinct().withColumn("closes", F.lit(True)))
    finals = last.where("k = 0").join(closed, "doc_id", "left").groupBy("word", "class").agg(F.max(F.coalesce("closes", F.lit(False)).cast("int")).alias("c"))
    shares = finals.groupBy("word").agg(F.count("*").alias("ends"), F.sum("c").alias("c")).where((F.col("c") >= settings.last_share * F.col("ends")) & (lower_bound(F.col("c"), F.col("ends")) >= settings.last_bound))
    last_words = shares.join(lifted.where((F.col("k") == 0) & high & (F.length("word") >= settings.last_letters)), "word", "left_semi")
    also = last.where("k = 0").join(last_words, "word", "left_semi").select("doc_id", F.lit(True).alias("closes"))
    closed = materialised(closed.unionByName(also).distinct())
    judged = ended.join(closed, "doc_id", "left").join(_limits(ended, settings), ["source", "n_chars", "n_bytes"], "left")
    unsound = ~F.col("sound") & F.col("closes").isNull()
    open_ = unsound | F.col("broken_off") | (F.coalesce("at_limit", F.lit(False)) & ~F.col("stored_final"))
    return judged.select("doc_id", "copy_key", "source", open_.alias("open"), "sound")


def _limits(pages: DataFrame, settings: Settings) -> DataFrame:
    """source, n_chars, n_bytes of pages whose length in characters or bytes is one at which their source's pages pile up."""
    texts = pages.select("source", "n_chars", "n_bytes", "class").distinct()
    sizes = texts.groupBy("source", "n_chars", "n_bytes").agg(F.count("*").alias("n"))
    both = sizes
    for unit in ("n_chars", "n_bytes"):
        lengths = sizes.groupBy("source", unit).agg(F.sum("n").alias("pile"))
        of_source = lengths.groupBy("source").agg(F.sum("pile").alias("pages"), F.count("*").alias("k"))
        chance = F.col("pages") / F.col("k")
        piles = lengths.join(of_source, "source").where((F.col("pile") > chance) & (evidence(F.col("pile"), chance) >= F.log("k") + settings.limit_evidence) & (F.col("pile") >= settings.limit_share * F.col("pages")))
        both = both.join(piles.select("source", unit, F.lit(True).alias(f"limit_{unit}")), ["source", unit], "left")
    at = F.coalesce("limit_n_chars", "limit_n_bytes")
    return both.where(at.isNotNull()).select("source", "n_chars", "n_bytes", F.lit(True).alias("at_limit"))


def _pair_estimate(settings: Settings):
    """Of candidate pairs the estimated share of the shorter page's shingles in the longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bins = batch.num_rows, settings.bands * settings.rows
            if not n:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint32).reshape(n, bins) for c in ("sig_a", "sig_b"))
            x, y = (np.maximum(batch[c].to_numpy(zero_copy_only=False) - settings.shingle + 1, 1) for c in ("n_a", "n_b"))
            j = (a == b).mean(1)
            keep = np.nonzero(j * (x + y) / ((1 + j) * np.minimum(x, y)) >= settings.likely)[0]
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(keep)), batch["b"].take(pa.array(keep))], names=["a", "b"])

    return run


def _aligned_ends(x: list[bytes], y: list[bytes], size: int) -> tuple[int, int, int]:
    """Length of the longest common subsequence of two texts' shingles, and the places in both where it first is complete.

    One bit per shingle of y; rows of x in order, so repeated phrases are matched in the order in which they stand.
    """
    at: dict[tuple, int] = {}
    for j in range(len(y) - size + 1):
        key = tuple(y[j : j + size])
        at[key] = at.get(key, 0) | 1 << j
    state, full, most, end = 0, (1 << max(len(y) - size + 1, 0)) - 1, 0, -1
    for i in range(len(x) - size + 1):
        bits = at.get(tuple(x[i : i + size]))
        if bits:
            seen = state | bits
            state = seen & ~(seen - (state << 1 | 1)) & full
            n = state.bit_count()
            if n > most:
                most, end = n, i
    return most, end, state.bit_length() - 1


def compare_ends(a: str, b: str, settings: Settings) -> str | None:
    """How the text a, aligned with b, ends: `early` or `inside` (b goes on, inside: within a sentence of b), `late` (a
    goes on), `same`, `apart` (both go on, differently); None if they are no near-copies.

    The alignment is the longest common subsequence of their shingles. Misread letters near the end make no
    difference: what stands behind the alignment is compared by its letters.
    """
    x, y = page_words(a), page_words(b)
    size = max(1, min(settings.shingle, len(x), len(y)))
    shorter = min(len(x), len(y)) - size + 1
    if shorter < 1:
        return None
    n, i, j = _aligned_ends(x, y, size)
    if n < settings.similarity * shorter:
        return None
    rest_x, rest_y = x[i + size :], y[j + size :]
    letters_x, letters_y = b"".join(rest_x), b"".join(rest_y)
    ahead = len(letters_y) - len(letters_x)
    goes_on = ahead >= 2 or (ahead == 1 and letters_y.startswith(letters_x))
    if min(len(rest_x), len(rest_y)) > 2 * size:
        return "apart"
    if goes_on:
        return "inside" if _within_sentence(b, len(rest_y) - len(rest_x)) else "early"
    return "late" if -ahead >= 2 or (ahead == -1 and letters_x.startswith(letters_y)) else "same"


def _within_sentence(text: str, words: int) -> bool:
    """Whether the last `words` words of a text begin within a sentence."""
    tokens = [t for t in text.split() if page_words(t)]
    at = len(tokens) - words
    return 0 < at < len(tokens) and tokens[at][:1].islower() and not sentence_final(tokens[at - 1])[0]


def verified_ends(texts: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """a, b, ends of the pairs that are near-copies by their alignment; texts: doc_id, text."""
    both = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["a", "b"]].assign(ends=[compare_ends(a, b, settings) for a, b in zip(pdf["text_a"], pdf["text_b"])])
            yield out[out["ends"].notna()]

    return both.mapInPandas(run, "a long, b long, ends string")


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last byte of each hash of the signatures: a quarter of their size, and alike by chance once in 256."""
    for batch in batches:
        if batch.num_rows:
            marks = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([m.tobytes() for m in marks], pa.binary())], names=["doc_id", "coarse"])


def _leaders(settings: Settings):
    """Of rows sorted by cell and falling length, each with every leader of its cell that it is like; a row that is like none leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, leaders, n = None, [], 0
        marks, words = np.zeros((0, settings.bands * settings.rows), np.uint8), np.zeros(0)
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            rows = zip(zip(batch["key"].to_pylist(), batch["salt"].to_pylist()), batch["doc_id"].to_pylist(), batch["n_words"].to_pylist(), batch["coarse"].to_pylist())
            for key, doc_id, n_words, coarse in rows:
                if key != cell:
                    cell, leaders, n = key, [], 0
                mark, size = np.frombuffer(coarse, np.uint8), max(n_words - settings.shingle + 1, 1)
                j = np.maximum(((marks[:n] == mark).mean(1) - 1 / 256) * (256 / 255), 0)
                like = np.nonzero(j * (words[:n] + size) / ((1 + j) * np.minimum(words[:n], size)) >= settings.likely)[0]
                if len(like):
                    out += [(leaders[i], doc_id, n_words) for i in like.tolist()]
                else:
                    if n == len(marks):
                        marks = np.concatenate([marks, np.zeros((max(n, 8), marks.shape[1]), np.uint8)])
                        words = np.concatenate([words, np.zeros(max(n, 8))])
                    marks[n], words[n] = mark, size
                    leaders.append(doc_id)
                    n += 1
                    out.append((doc_id, doc_id, n_words))
            a, b, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32())], names=["leader", "doc_id", "n_words"])

    return run


def near_groups(texts: DataFrame, settings: Settings) -> DataFrame:
    """leader, doc_id, n_words: texts that share a band with a longer one that they are likely near-copies of, under each such leader.

    A band's texts pass in one sorted stream and are compared with the leaders of the band only, so texts that share
    a band by chance cost a look and no row. A band of many texts is cut into parts; the leaders of its parts then
    meet in one more stream.
    """
    width = settings.rows * 4
    cells = F.transform(F.sequence(F.lit(0), F.lit(settings.bands - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * width + 1, F.lit(width))))
    bands = texts.where("n_words > 0").select("doc_id", "n_words", F.explode(cells).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / settings.part).alias("parts"))
    members = materialised(bands.join(shared, "key").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("parts"))))
    coarse = texts.select("doc_id", "signature").mapInArrow(_coarse, "doc_id long, coarse binary")

    def led(df: DataFrame) -> DataFrame:
        placed = df.select("key", "salt", "doc_id", "n_words").join(coarse, "doc_id").repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("n_words"), "doc_id")
        return placed.select("key", "salt", "doc_id", "n_words", "coarse").mapInArrow(_leaders(settings), "leader long, doc_id long, n_words int").distinct()

    groups = materialised(led(members))
    cut = members.where("parts > 1")
    heads = cut.join(groups.where("leader = doc_id").select("doc_id"), "doc_id", "left_semi").withColumn("salt", F.lit(0).cast("long"))
    above = materialised(led(heads).where("leader <> doc_id").select("leader", F.col("doc_id").alias("head")))
    joined = groups.withColumnRenamed("leader", "head").join(above, "head").select("leader", "doc_id", "n_words")
    every = groups.unionByName(joined).distinct()
    return every.join(every.where("leader <> doc_id").select("leader").distinct(), "leader", "left_semi")


def near_links(documents: DataFrame, pages: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Likely pairs a, b of distinct texts (b leads), and the pairs that are near-copies by their alignment, with how a ends beside b.

    Exact copies are first folded into one text by their key, so a large group of copies is one row per task before any
    shuffle. Each text of a group of near_groups meets the group's longest, its leader. Texts that find no near-copy
    that reaches as far then meet others of their groups in a random order, twice as many each round, until they do or
    have met all; so no text is left out because the longest of a group is a poor copy, the rounds are as many
    as the logarithm of the largest group, and texts that find their copy early cost no more.
    """
    texts = materialised(pages.groupBy("copy_key", "n_words").agg(F.min(F.struct("doc_id", "signature")).alias("t")).select("t.*", "n_words"))
    groups = near_groups(texts, settings)
    sized = groups.join(groups.groupBy("leader").agg(F.count("*").alias("size")), "leader")
    drawn = F.pmod(F.xxhash64("doc_id", "leader"), F.lit(1 << 40)).cast("double") / (1 << 40) * F.col("size")  # a random place in the group
    members = materialised(sized.select("leader", "doc_id", "n_words", F.when(F.col("doc_id") == F.col("leader"), 0).otherwise(F.ceil(F.log2(F.greatest(drawn, F.lit(1.0)))) + 1).cast("int").alias("round")))
    rounds = members.agg(F.max("round")).first()[0]
    grouped = members.select("doc_id").distinct()
    sides = materialised(texts.join(grouped, "doc_id", "left_semi"))
    read = materialised(documents.select("doc_id", "text").join(grouped, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    side = lambda c: sides.select(F.col("doc_id").alias(c), F.col("signature").alias(f"sig_{c}"), F.col("n_words").alias(f"n_{c}"))
    place = F.struct("n_words", F.negative("doc_id"))
    links, settled = [], None
    for n in range(-1 if rounds is None else rounds + 1):
        shorter = members.where("doc_id <> leader").select("leader", F.col("doc_id").alias("a"), place.alias("place_a"))
        shorter = shorter if settled is None else shorter.join(settled, "a", "left_anti")
        met = shorter.join(members.where(F.col("round") == n).select("leader", F.col("doc_id").alias("b"), place.alias("place_b")), "leader").where("place_a < place_b")
        likely = materialised(met.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(_pair_estimate(settings), "a long, b long"))
        if likely.isEmpty():
            continue
        found = materialised(verified_ends(read, likely, settings))
        if found.isEmpty():
            continue
        links.append(found)
        done = found.where(F.col("ends").isin("early", "inside", "same")).select("a")
        settled = materialised((done if settled is None else done.unionByName(settled)).distinct())
    none = documents.sparkSession.createDataFrame([], "a long, b long, ends string")
    return members.where("doc_id <> leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).distinct(), reduce(DataFrame.unionByName, links, none)


def early_texts(pages: DataFrame, links: DataFrame) -> DataFrame:
    """copy_key, inside: texts that end before a near-copy does (inside: within one of its sentences).

    What a text ends together with ends as early; texts that end alike are joined into groups along their links.
    """
    early = links.where("ends in ('early', 'inside')").select(F.col("a").alias("doc_id"), (F.col("ends") == "inside").alias("inside"))
    early = early.unionByName(links.where("ends = 'late'").select(F.col("b").alias("doc_id"), F.lit(False).alias("inside")))
    early = materialised(early.join(pages.select("doc_id", "copy_key"), "doc_id").groupBy("copy_key").agg(F.max("inside").alias("inside")))
    alike = links.where("ends = 'same'").select("a", "b")
    if early.isEmpty() or alike.isEmpty():
        return early
    groups = materialised(near_classes(pages, alike))
    ahead = groups.join(early, "copy_key").groupBy("class").agg(F.max("inside").alias("inside"))
    return early.unionByName(groups.join(ahead, "class").select("copy_key", "inside")).groupBy("copy_key").agg(F.max("inside").alias("inside"))


def find_truncated(documents: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, source, reason of pages that stop inside a word or sentence because they were cut.

    documents: doc_id, text, source, ocr_lines (array of struct with x, y, w; null or of another length than the
    lines: the stored order is the order of reading). Reasons: near_copy_goes_on (a near-copy goes on beyond the end,
    and the page ends no sentence or ends within one of the copy's), open_ending. Exact copies share their verdict. Null, empty and blank texts are
    no case; a repeated row gives one; whole texts are read. With few pages no closing words stand out, so
    a page without a final sentence mark counts as cut.
    """
    settings = settings or Settings()
    pages, words = page_features(documents, settings)
    likely, links = near_links(documents, pages, settings)
    scores = closing_scores(pages, words, near_classes(pages, likely), settings)
    judged = scores.join(early_texts(pages, links).withColumn("early", F.lit(True)), "copy_key", "left")
    early = F.coalesce("early", F.lit(False)) & (~F.col("sound") | F.coalesce("inside", F.lit(False)))
    reason = F.when(early, "near_copy_goes_on").otherwise("open_ending")
    return judged.where(F.col("open") | early).groupBy("doc_id").agg(F.min("source").alias("source"), F.min(reason).alias("reason"))


def truncation_report(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Per source its pages with a text, its cut pages and their share."""
    pages = documents.where(strip_blanks(F.col("text")) != "").select("doc_id", "source").distinct()
    cut = found.groupBy("source").agg(F.count("*").alias("n_cut"))
    joined = pages.groupBy("source").agg(F.count("*").alias("n_pages")).join(cut, "source", "left").fillna(0, ["n_cut"])
    return joined.withColumn("share", F.round(F.col("n_cut") / F.col("n_pages"), 6))

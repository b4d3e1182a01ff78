"""Layout and wording of scanned pages: lines in reading order, broken words joined, letters in one form."""

from __future__ import annotations

import codecs
import re
import unicodedata

import numpy as np
import pyarrow as pa

#: Marks that a line may end with where a word is broken.
BREAKS = "-­‐‑=¬"
#: Lines of one column start within so many pixels of each other.
COLUMN_GAP = 40

_LINE_END = re.compile(r"\r\n|\n|\r")


def split_lines(text: str) -> list[str]:
    """The lines of a page's text."""
    return text.split("\n") if "\r" not in text else _LINE_END.split(text)


def columns_of(xs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of an array of lists of line starts: each line's column (0 leftmost within its page), and the pages' offsets."""
    counts = np.asarray([len(v) if v is not None else 0 for v in xs.to_pylist()]) if xs.null_count else np.diff(xs.offsets.to_numpy())
    offsets = np.concatenate([[0], np.cumsum(counts)])
    x = xs.flatten().to_numpy(zero_copy_only=False)
    page = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((x, page))
    sx, sp = x[order], page[order]
    step = np.zeros(len(x), np.int64)
    step[1:] = (sp[1:] == sp[:-1]) & (sx[1:] - sx[:-1] > COLUMN_GAP)
    cum = np.cumsum(step)
    first = np.zeros(len(counts), np.int64)
    has = counts > 0
    first[has] = cum[offsets[:-1][has]]
    columns = np.empty(len(x), np.int64)
    columns[order] = cum - first[sp]
    return columns, offsets


def reading_orders(xs: pa.Array, ys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Columns, offsets, the reading order of each page's lines, and whether a page is stored in another order."""
    columns, offsets = columns_of(xs)
    y = ys.flatten().to_numpy(zero_copy_only=False)
    counts = np.diff(offsets)
    page = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((y, columns, page))
    local = order - offsets[:-1][page]
    back = np.zeros(len(y), bool)
    back[1:] = (page[1:] == page[:-1]) & (columns[1:] < columns[:-1])
    crossed = np.zeros(len(counts), bool)
    np.logical_or.at(crossed, page[back], True)
    return columns, offsets, local, crossed


#: Letters that scanning takes for others, brought to one form on both sides of any comparison.
_ALIKE = {"0": "o", "1": "l", "5": "s", "8": "s", "6": "b", "9": "g", "|": "l", "ſ": "s", "þ": "p", "ß": "b"}
_ALIKE_GROUPS = [(b"ri", b"n"), (b"rn", b"m"), (b"vv", b"w"), (b"ii", b"u"), (b"cl", b"d"), (b"ol", b"d"), (b"li", b"h")]


def _fold(c: str) -> str:
    """The plain lower-case letter or digit of a character, a blank for a blank, else nothing."""
    if c.isspace():
        return " "
    base = unicodedata.normalize("NFKD", _ALIKE.get(c, c).lower())[:1]
    base = _ALIKE.get(base, base)
    return base if base.isascii() and base.isalnum() else ""


#: One byte for each character of Latin-1; zero for those that are left out.
_TABLE = bytes(ord(_fold(chr(i)) or "\0") if _fold(chr(i)) else 0 for i in range(256))
_LEFT_OUT = bytes(i for i in range(256) if not _TABLE[i])


def _other(error: UnicodeError) -> tuple[str, int]:
    """Characters beyond Latin-1: breaks as hyphens, others by _fold."""
    text = error.object[error.start : error.end]
    return "".join("-" if c in BREAKS else "'" if not _fold(c) else _fold(c) for c in text), error.end


codecs.register_error("loomwave_fold", _other)


def page_words(text: str) -> list[bytes]:
    """Canonical words of a text; words broken at line ends are joined first."""
    raw = text.encode("latin-1", "loomwave_fold")
    if b"\r" in raw:
        raw = raw.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    for mark in (b"-\n", b"\xad\n", b"=\n", b"\xac\n"):
        raw = raw.replace(mark, b"")
    raw = raw.translate(_TABLE, _LEFT_OUT)
    for a, b in _ALIKE_GROUPS:
        raw = raw.replace(a, b)
    return raw.split()


def deletions(word: bytes, most: int) -> set[bytes]:
    """The word and what is left of it when up to `most` letters are deleted."""
    out, layer = {word}, {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out |= layer
    return out


def tolerance(word: bytes) -> int:
    """Letters of a word that may be misread."""
    return 0 if len(word) < 2 else 1 if len(word) < 7 else 2


#: Letters from which a word is compared by its pieces, as its deletions become too many.
LONG_WORD = 25
_PIECES = 5


def pieces(word: bytes, length: int | None = None, shift: int = 0) -> set[tuple[int, bytes]]:
    """Number and letters of a long word's pieces; with a length, what may be the pieces of a word of that length.

    Two words that agree but for two letters on each side have at least one of five pieces in common, moved by two at most.
    """
    n = len(word) if length is None else length
    cuts = [n * i // _PIECES for i in range(_PIECES + 1)]
    return {(i, word[max(0, a + d) : max(0, b + d)]) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) for d in range(-shift, shift + 1)}


def common_letters(a: bytes, b: bytes) -> int:
    """Length of the longest common subsequence of letters."""
    at: dict[int, int] = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    state, full = 0, (1 << len(b)) - 1
    for x in a:
        seen = state | at.get(x, 0)
        state = seen & ~(seen - (state << 1 | 1)) & full
    return state.bit_count()


def shares_letters(a: bytes, b: bytes, most: int) -> bool:
    """Whether two words agree when up to `most` letters of each are left out."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    return common_letters(x, y) >= max(len(x), len(y)) - most

"""Delimited lines that cannot be read as rows of their file, kept apart with the reason."""

from __future__ import annotations

import difflib
import functools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sound quoting of a whole line: every field is free of quotes, or wholly enclosed with inner ones doubled.
_FIELD = r'(?:[^"\t]*|"(?:[^"]|"")*")'
_SOUND = rf"(?s)\A{_FIELD}(?:\t{_FIELD})*\z"
NUMBER = r"\A\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z"
#: Characters that end a line for the CSV reader, and the escapes that stand for them while it reads.
_ESCAPES = {"\ue000": "\ue0000", "\r": "\ue0001", "\n": "\ue0002"}
_HEADER = "file_id long, layout string, changes array<struct<field_path:string,change_kind:string>>"
_REASON = "line_id long, file_id long, line_no int, reason string"


@dataclass(frozen=True)
class Layout:
    """The columns of a file, where each base column stands (-1: nowhere), and the columns that stand for none."""

    columns: tuple[str, ...]
    at: tuple[int, ...]
    extra: tuple[int, ...]

    @staticmethod
    @functools.cache
    def read(text: str) -> Layout:
        return Layout(*(tuple(x) for x in json.loads(text)))

    def text(self) -> str:
        return json.dumps([self.columns, self.at, self.extra], ensure_ascii=False)


def split_sound(line: str) -> list[str]:
    """Fields of a line whose quoting is sound."""
    return [x[1:-1].replace('""', '"') if x[:1] == '"' else x for x in re.findall(rf"(?:\A|\t)({_FIELD})(?=\t|\Z)", line)]


def pair_renamed(absent: list[str], unknown: list[str]) -> dict[str, str]:
    """For each absent name the unknown one that stands in for it, by likeness of the names, each at most once."""
    plain = lambda x: re.sub(r"[^a-z0-9]", "", x.rpartition(".")[2].lower())

    def likeness(a: str, u: str) -> float:
        x, y = plain(a), plain(u)
        initials = "".join(w[0] for w in re.findall(r"[A-Za-z0-9]+", a.rpartition(".")[2])).lower()
        return max(difflib.SequenceMatcher(None, x, y).ratio(), 0.9 * (y == initials), 0.8 * (bool(x and y) and (x in y or y in x)))

    pairs, left = {}, set(unknown)
    for _, a, u in sorted((-likeness(a, u), i, a, j, u)[::2] for i, a in enumerate(absent) for j, u in enumerate(unknown)):
        if a not in pairs and u in left:
            pairs[a] = u
            left.discard(u)
    return pairs


@functools.lru_cache(10_000)
def _layout(line: str, base: tuple[str, ...]) -> tuple[str, list[dict[str, str]]]:
    """The layout that a header gives, as text, and its changes against the base columns."""
    names = split_sound(line) if re.match(_SOUND.replace(r"\z", r"\Z"), line) else line.split("\t")
    unknown = [n for n in dict.fromkeys(names) if n not in base]
    absent = [b for b in base if b not in names]
    renamed = pair_renamed(absent, unknown)
    stands = {b: b for b in base} | renamed
    at = [names.index(stands[b]) if stands[b] in names else -1 for b in base]
    added = [n for n in unknown if n not in renamed.values()]
    changes = [{"field_path": b, "change_kind": "renamed" if unknown else "removed"} for b in absent]
    changes += [{"field_path": n, "change_kind": "added"} for n in added]
    return Layout(tuple(names), tuple(at), tuple(names.index(n) for n in added)).text(), changes


def headers(lines: DataFrame, base: list[str]) -> DataFrame:
    """One row per file with a header: its layout as text, and what its columns change. Each distinct header is read once a task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_layout((line or "").removesuffix("\r"), tuple(base)) for line in pdf["raw_line"]]
            yield pd.DataFrame({"file_id": pdf["file_id"], "layout": [x for x, _ in found], "changes": [c for _, c in found]})

    first = lines.where("line_no = 1").groupBy("file_id").agg(F.min("raw_line").alias("raw_line"))
    return first.mapInPandas(read, _HEADER)


def _escaped(lines: pa.ChunkedArray) -> pa.ChunkedArray:
    for raw, escape in _ESCAPES.items():
        lines = pc.replace_substring(lines, raw, escape)
    return lines


def _restored(values: pa.Array) -> pa.Array:
    for raw, escape in reversed(_ESCAPES.items()):
        values = pc.replace_substring(values, escape, raw)
    return values


def _read_structural(lines: pa.Array, width: int) -> tuple[pa.Table, set[int]]:
    """Lines of sound quoting as string columns (the first is each line's place), and the places of a wrong width."""
    wrong: set[int] = set()

    def reject(row: pacsv.InvalidRow) -> str:
        wrong.add(int(row.text.split("\t", 1)[0]))
        return "skip"

    places = pc.cast(pa.array(np.arange(len(lines))), pa.string())
    text = "\n".join(pc.binary_join_element_wise(places, _escaped(lines), "\t").to_pylist()).encode() + b"\n"
    names = [str(i) for i in range(width + 1)]
    read = pacsv.read_csv(
        pa.BufferReader(text),
        read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=min(2**31 - 1, max(1 << 20, len(text) + 1))),
        parse_options=pacsv.ParseOptions(delimiter="\t", quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=reject),
        convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False, quoted_strings_can_be_null=False),
    )
    return read.rename_columns(names), wrong


def _cell_kinds(column: pa.Array) -> pa.Array:
    """0 for empty and n/a, 1 for a number, 2 for other text."""
    bare = pc.utf8_trim_whitespace(column)
    nothing = pc.is_in(bare, pa.array(["", "n/a"]))
    return pc.cast(pc.if_else(nothing, 0, pc.if_else(pc.match_substring_regex(column, NUMBER), 1, 2)), pa.int8())


def as_double(column: pa.Array, kinds: pa.Array) -> pa.Array:
    """Numbers of the cells that are numbers, null for the others; beyond a double's range infinite."""
    bare = pc.if_else(pc.equal(kinds, 1), pc.utf8_ltrim(pc.utf8_trim_whitespace(column), "+"), pa.scalar(None, pa.string()))
    try:
        return pc.cast(bare, pa.float64())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else float(x) for x in bare.to_pylist()], pa.float64())


def rows_of_lists(columns: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """Columns of one length as one list per row."""
    n, width = len(columns[0]), len(columns)
    values = pa.concat_arrays([pc.cast(c, kind) for c in columns])
    order = (np.arange(width)[None, :] * n + np.arange(n)[:, None]).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), values.take(pa.array(order)))


@dataclass
class Rows:
    """Lines of one layout that are sound in structure: their places in the batch, cells, and kinds of cells (each column's read when asked for)."""

    places: pa.Array
    layout: Layout
    cells: list[pa.Array]
    reason: pa.Array

    @functools.cached_property
    def kinds(self) -> list[pa.Array]:
        return [_cell_kinds(c) for c in self.cells]


def _checked(batch: pa.RecordBatch, onset: int, response: int) -> Iterator[tuple[pa.Array, pa.Array, Rows | None]]:
    """Places and reasons of the lines of a batch, all in vectors; with the cells of those whose structure is sound."""
    text = pc.replace_substring_regex(batch["raw_line"], r"\r\z", "")
    sound = pc.match_substring_regex(text, _SOUND).to_numpy(zero_copy_only=False).astype(bool)
    coded = batch["layout"].dictionary_encode()
    codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    for places, reason in ((np.nonzero(codes < 0)[0], "no_header"), (np.nonzero((codes >= 0) & ~sound)[0], "broken_quoting")):
        if len(places):
            yield pa.array(places), pa.array([reason] * len(places), pa.string()), None
    for code, name in enumerate(coded.dictionary.to_pylist()):
        places = np.nonzero((codes == code) & sound)[0]
        if not len(places):
            continue
        layout = Layout.read(name)
        read, wrong = _read_structural(text.take(pa.array(places)), len(layout.columns))
        if wrong:
            yield pa.array(places[sorted(wrong)]), pa.array(["wrong_field_count"] * len(wrong), pa.string()), None
        if not read.num_rows:
            continue
        at = pa.array(places[np.array(pc.cast(read["0"], pa.int64()))])
        cells = [_restored(read[str(i + 1)].combine_chunks()) for i in range(len(layout.columns))]
        o, r = layout.at[onset], layout.at[response]
        no_onset = pc.not_equal(_cell_kinds(cells[o]), 1) if o >= 0 else pa.array(np.ones(len(at), bool))
        bad_response = pc.equal(_cell_kinds(cells[r]), 2) if r >= 0 else pa.array(np.zeros(len(at), bool))
        reason = pc.case_when(pc.make_struct(no_onset, bad_response), "bad_onset", "bad_response_time")
        yield at, reason, Rows(at, layout, cells, reason)


def check_lines(lines: DataFrame, base: list[str], schema: str, columns: Callable[[Rows | None, int], list[pa.Array]], found: DataFrame | None = None) -> DataFrame:
    """line_id, file_id, line_no, reason of every line but the headers, and further columns of `schema` that `columns` makes of checked rows (None: rejects, and their number).

    found: the headers, if they are at hand. Headers meet the lines in a join on file_id, which AQE splits for a file
    that holds much of the table.
    """
    body = lines.where("line_no > 1").select("line_id", "file_id", "line_no", F.coalesce("raw_line", F.lit("")).alias("raw_line"))
    joined = body.join((headers(lines, base) if found is None else found).select("file_id", "layout"), "file_id", "left")
    onset, response = base.index("onset"), base.index("response_time")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in fields]
        for batch in batches:
            for places, reason, rows in _checked(batch, onset, response):
                yield pa.RecordBatch.from_arrays([*(batch[c].take(places) for c in ("line_id", "file_id", "line_no")), reason, *columns(rows, len(places))], names=names)

    out = ", ".join(x for x in (_REASON, schema) if x)
    fields = T._parse_datatype_string(out).fields
    return joined.select("line_id", "file_id", "line_no", "raw_line", "layout").mapInArrow(check, out)


def line_reasons(lines: DataFrame, base: list[str]) -> DataFrame:
    """line_id, file_id, line_no, reason; a repeated line gives a row each time."""
    return check_lines(lines, base, "", lambda rows, n: [])


def parse_lines(lines: DataFrame, base: list[str]) -> DataFrame:
    """Every line but the headers, typed, with the reason where it is no sound row of its file.

    lines: line_id, file_id, line_no, raw_line. base: the expected column names. Reasons: no_header (the file
    has none), broken_quoting, wrong_field_count, bad_onset, bad_response_time; sound rows have null. fields holds
    the cell texts, kinds their kinds (0 empty or n/a, 1 number, 2 other); both null for structural rejects.
    A null raw_line counts as an empty line. Repeated lines give one row. Extra columns are dropped.
    """
    onset, response = base.index("onset"), base.index("response_time")

    def columns(rows: Rows | None, n: int) -> list[pa.Array]:
        if rows is None:
            return [pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int8())), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())]
        double = lambda at: as_double(rows.cells[at], rows.kinds[at]) if at >= 0 else pa.nulls(n, pa.float64())
        return [rows_of_lists(rows.cells, pa.string()), rows_of_lists(rows.kinds, pa.int8()), double(rows.layout.at[onset]), double(rows.layout.at[response])]

    return check_lines(lines, base, "fields array<string>, kinds array<tinyint>, onset double, response_time double", columns).dropDuplicates(["line_id"])

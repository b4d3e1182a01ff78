"""Schemas that drift between files: one consistent table, a rescue column, and a list of every change."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwave.operators.rejects import Rows, as_double, check_lines, headers, pair_renamed, rows_of_lists
from loomwave.session import materialised

_SPARK_TYPES = {"string": "string", "number": "double", "boolean": "boolean"}


def json_type(value: object) -> str | None:
    """string, number, boolean, object, array; None for JSON null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    return {str: "string", int: "number", float: "number", dict: "object", list: "array"}[type(value)]


def compare_levels(record: dict, base: dict[str, str], value: Callable[[dict, str], object] = dict.__getitem__) -> tuple[list[tuple[str, str]], dict[str, object], dict[str, object]]:
    """Changes of a JSON object against the base paths, the values that fit by base path, and the others by own path.

    value tells what is kept of a field (its value, unless given). A renamed field's value fits under its base path. Values of another type, of unknown fields, and under
    a retyped field are rescued whole.
    """
    children: dict[str, list[str]] = {}
    for path in base:
        parent = next((p for p in sorted(base, key=len, reverse=True) if path.startswith(p + ".")), "")
        children.setdefault(parent, []).append(path)
    changes, fits, rescued = [], {}, {}

    def level(obj: dict, path: str, own: str, listed: bool) -> None:
        names = {(p[len(path) + 1 :] if path else p): p for p in children.get(path, [])}
        kinds = {k: json_type(v) for k, v in obj.items()}
        absent = [n for n in names if n not in obj]
        unknown = [k for k in obj if k not in names]
        stands: dict[str, str] = {}
        for t in dict.fromkeys(base[names[n]] for n in absent):
            stands |= pair_renamed([n for n in absent if base[names[n]] == t], [u for u in unknown if kinds[u] == t])
        if not listed:
            for n in absent:
                fitting = any(kinds[u] == base[names[n]] for u in unknown)
                changes.append((names[n], "renamed" if fitting else "removed"))
        for k in unknown:
            where = f"{own}.{k}" if own else k
            if k in stands.values():
                continue
            rescued[where] = value(obj, k)
            if kinds[k] is not None and not listed:
                changes.append((f"{path}.{k}" if path else k, "added"))
        for n, p in names.items():
            k = n if n in obj else stands.get(n)
            if k is None or kinds[k] is None:
                continue
            where = f"{own}.{k}" if own else k
            if kinds[k] != base[p]:
                rescued[where] = value(obj, k)
                if not listed:
                    changes.append((p, "retyped"))
            elif base[p] == "object":
                level(obj[k], p, where, listed or n not in obj)
            else:
                fits[p] = value(obj, k)

    level(record, "", "", False)
    return changes, fits, rescued


def base_schema(schema: DataFrame, kind: str) -> dict[str, str]:
    """The base paths and types of one kind of file; the schema table is a fixed list of fields."""
    rows = schema.where(F.col("file_kind") == kind).select("field_path", "json_type").distinct().orderBy("field_path").collect()
    return {r["field_path"]: r["json_type"] for r in rows}


def typed_name(path: str) -> str:
    """A column name for a path: its levels joined by two underscores, other characters by one."""
    return "__".join("".join(c if c.isalnum() else "_" for c in level) for level in path.split("."))


def shape_of(value: object) -> object:
    """The keys and types of a JSON value, in order: files of one shape change the schema alike."""
    return tuple((k, shape_of(v)) for k, v in value.items()) if isinstance(value, dict) else json_type(value)


def _blank(shape: object) -> object:
    blanks = {"string": "", "number": 0, "boolean": False, "array": [], None: None}
    return {k: _blank(v) for k, v in shape} if isinstance(shape, tuple) else blanks[shape]


class Levels:
    """compare_levels of each shape of record, worked out once: its changes, and where its fitting and rescued values stand."""

    def __init__(self, base: dict[str, str]):
        self.base = base
        self.known: dict[object, tuple] = {}

    def plan(self, record: dict) -> tuple[list, list[tuple[str, list[str]]], list[tuple[str, list[str]]]]:
        shape = shape_of(record)
        found = self.known.get(shape)
        if found is None:
            if len(self.known) > 10_000:
                self.known.clear()
            marked, places = _blank(shape), {}

            def mark(obj: dict, path: list[str]) -> None:
                for k, v in obj.items():
                    if isinstance(v, dict):
                        mark(v, [*path, k])
                    places[id(obj), k] = [*path, k]

            mark(marked, [])
            changes, fits, rescued = compare_levels(marked, self.base, lambda obj, k: places[id(obj), k])
            found = self.known[shape] = ([{"field_path": p, "change_kind": k} for p, k in dict.fromkeys(changes)], list(fits.items()), list(rescued.items()))
        return found


def _at(record: dict, path: list[str]) -> object:
    for key in path:
        record = record[key]
    return record


def ingest_json(files: DataFrame, base: dict[str, str], approved: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per file: file_id, a typed column per scalar base path, `_rescued` (JSON) and `_changes`.

    files: file_id, body. approved promotes fields: it maps an own path to (column, type), and their values
    leave `_rescued`. A null body gives null columns and no change; a body that is no JSON object is rescued whole
    under `_corrupt`. Repeated rows of a file give one row (bodies that differ give a row each). Levels are compared
    once for each shape of file that a task meets.
    """
    scalars = {p: _SPARK_TYPES[t] for p, t in base.items() if t in _SPARK_TYPES}
    approved = approved or {}
    columns = {typed_name(p): t for p, t in scalars.items()} | {c: _SPARK_TYPES[t] for c, t in approved.values()}
    fields = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    out = f"file_id long, {fields}, _rescued string, _changes array<struct<field_path:string,change_kind:string>>"
    kinds = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    change = pa.list_(pa.struct([("field_path", pa.string()), ("change_kind", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(base)
        for batch in batches:
            values: dict[str, list] = {c: [None] * batch.num_rows for c in columns}
            rescue, changes = [None] * batch.num_rows, [[]] * batch.num_rows
            for i, body in enumerate(batch["body"].to_pylist()):
                if body is None:
                    continue
                try:
                    record = json.loads(body)
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    rescue[i] = json.dumps({"_corrupt": body})
                    continue
                changes[i], fits, rescued = levels.plan(record)
                for path, at in fits:
                    value = _at(record, at)
                    values[typed_name(path)][i] = float(value) if scalars[path] == "double" else value
                kept = {p: _at(record, at) for p, at in rescued}
                for path, (column, kind) in approved.items():
                    if path in kept and json_type(kept[path]) == kind:
                        value = kept.pop(path)
                        values[column][i] = float(value) if kind == "number" else value
                rescue[i] = json.dumps(kept, sort_keys=True, ensure_ascii=False) if kept else None
            arrays = [batch["file_id"], *(pa.array(values[c], kinds[t]) for c, t in columns.items()), pa.array(rescue, pa.string()), pa.array(changes, change)]
            yield pa.RecordBatch.from_arrays(arrays, names=["file_id", *columns, "_rescued", "_changes"])

    return files.select(F.col("file_id").cast("long"), "body").distinct().mapInArrow(read, out)


def replay_rescued(ingested: DataFrame, promote: dict[str, tuple[str, str]]) -> DataFrame:
    """Move values of approved own paths from `_rescued` into typed columns: {path: (column, string|number|boolean)}.

    A value that does not cast stays rescued and leaves null; rows without `_rescued` are unchanged.
    """
    rescued = F.from_json("_rescued", "map<string,string>")
    df = ingested.withColumn("_r", rescued)
    moved: Column = F.array().cast("array<string>")
    for path, (column, kind) in promote.items():
        value = F.try_element_at("_r", F.lit(path)).try_cast(_SPARK_TYPES[kind])
        df = df.withColumn(column, F.coalesce(F.col(column), value) if column in ingested.columns else value)
        moved = F.when(value.isNotNull(), F.array_append(moved, F.lit(path))).otherwise(moved)
    left = F.map_filter("_r", lambda k, v: ~F.array_contains(F.col("_moved"), k))
    return df.withColumn("_moved", moved).withColumn("_rescued", F.when(F.size(left) > 0, F.to_json(left))).drop("_r", "_moved")


def json_changes(ingested: DataFrame) -> DataFrame:
    """file_id, field_path, change_kind of ingested JSON files."""
    return ingested.select("file_id", F.explode("_changes").alias("c")).select("file_id", "c.*").distinct()


def _quoted(cells: pa.Array) -> pa.Array:
    """Texts as JSON strings."""
    if pc.any(pc.match_substring_regex(cells, r"[\x00-\x08\x0b\x0c\x0e-\x1f]")).as_py():
        return pa.array([json.dumps(x, ensure_ascii=False) for x in cells.to_pylist()], pa.string())
    for raw, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        cells = pc.replace_substring(cells, raw, escape)
    return pc.binary_join_element_wise('"', cells, '"', "")


def ingest_lines(lines: DataFrame, base: dict[str, str], found: DataFrame | None = None) -> DataFrame:
    """Lines of delimited files under the base columns (renamed ones included): line_id, file_id, line_no, reason, a
    typed column per base column, `_rescued` (JSON: unknown columns by their own name, uncastable cells by the
    base name) and `_kinds` (of each base column's cell: 0 nothing, 1 number, 2 other).

    Rejected lines (see rejects.parse_lines) have a reason and nothing else. found: the headers, if they are at hand. A
    repeated line gives a row each time. Cells are cast, judged and rescued in vectors, one group of lines per layout.
    """
    names = list(base)
    schema = ", ".join(f"`{n}` {_SPARK_TYPES[t]}" for n, t in base.items()) + ", _rescued string, _kinds array<tinyint>"

    def columns(rows: Rows | None, n: int) -> list[pa.Array]:
        typed, kinds = {"number": pa.float64(), "string": pa.string()}, pa.list_(pa.int8())
        if rows is None:
            return [*(pa.nulls(n, typed[t]) for t in base.values()), pa.nulls(n, pa.string()), pa.nulls(n, kinds)]
        sound, out = pc.is_null(rows.reason), []
        rescue = [pc.binary_join_element_wise(f"{json.dumps(rows.layout.columns[i], ensure_ascii=False)}: ", _quoted(rows.cells[i]), ", ", "") for i in rows.layout.extra]
        of_base = [rows.kinds[at] if at >= 0 else pa.array(np.zeros(n, np.int8)) for at in rows.layout.at]
        for name, at, kind in zip(names, rows.layout.at, of_base):
            if at < 0:
                out.append(pa.nulls(n, typed[base[name]]))
            elif base[name] == "number":
                out.append(pc.if_else(sound, as_double(rows.cells[at], kind), pa.scalar(None, pa.float64())))
                wrong = pc.equal(kind, 2)
                if pc.any(wrong).as_py():
                    rescue.append(pc.if_else(wrong, pc.binary_join_element_wise(f"{json.dumps(name)}: ", _quoted(rows.cells[at]), ", ", ""), ""))
            else:
                out.append(pc.if_else(pc.and_(sound, pc.greater(kind, 0)), rows.cells[at], pa.scalar(None, pa.string())))
        joined = pc.binary_join_element_wise(*rescue, "") if rescue else pa.array([""] * n)
        some = pc.and_(sound, pc.greater(pc.binary_length(joined), 0))
        kept = pc.if_else(some, pc.binary_join_element_wise("{", pc.utf8_slice_codeunits(joined, 0, -2), "}", ""), pa.scalar(None, pa.string()))
        return [*out, kept, rows_of_lists(of_base, pa.int8())]

    return check_lines(lines, names, schema, columns, found)


def header_changes(lines: DataFrame, base: dict[str, str]) -> DataFrame:
    """file_id, field_path, change_kind of delimited files: of their headers, and of the types of their columns.

    A column's type is read from the ingested cells of sound rows only; a task hands on one small row per file.
    """
    found = materialised(headers(lines, list(base)))
    ingested = ingest_lines(lines, base, found).where("reason is null")
    kinds = ingested.groupBy("file_id").agg(*(F.max(F.col("_kinds")[i]).alias(f"k{i}") for i in range(len(base))))
    other = [F.when(F.col(f"k{i}") == (2 if t == "number" else 1), F.struct(F.lit(n).alias("field_path"), F.lit("retyped").alias("change_kind"))) for i, (n, t) in enumerate(base.items())]
    retyped = kinds.select("file_id", F.explode(F.array_compact(F.array(*other))).alias("c"))
    return found.select("file_id", F.explode("changes").alias("c")).unionByName(retyped).select("file_id", "c.*").distinct()


def events_table(lines: DataFrame, base: dict[str, str]) -> DataFrame:
    """Sound rows under the base columns, unknown and uncastable cells in `_rescued` as JSON; repeated lines give one row."""
    return ingest_lines(lines, base).where("reason is null").dropDuplicates(["line_id"]).select("line_id", "file_id", *base, "_rescued")

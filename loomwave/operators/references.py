"""References to records that do not exist when the referring row is loaded."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwave.functions.clock import wall_clock, wall_micros
from loomwave.functions.keys import reference_key
from loomwave.operators.sorted_scan import LOWEST, carried_running_max, range_sorted
from loomwave.session import materialised


@dataclass(frozen=True)
class Reference:
    """A field of a referring table and the parent field it names."""

    table: str
    field: str
    row_id: str
    loaded: str
    parent: str
    parent_field: str
    added: str
    removed: str


def orphan_references(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """One row per reference without a parent in force: ref_table, ref_field, row_id, loaded_at, status.

    A parent row is in force from `added` until just before `removed` (null: for ever). Status is missing (the key
    never has a parent), late (its first parent comes afterwards), deleted (parents ended before) or undated
    (the referring row has no loading time). Referring rows and parents are sorted together by key and time
    and merged in one linear pass; a hot key is spread over several partitions. Null, empty and n/a keys
    refer to nothing; a parent without `added` is never in force; repeated rows give one case.
    """
    parents = {(r.parent, r.parent_field, r.added, r.removed): None for r in references}
    kinds = {p: i for i, p in enumerate(parents)}
    parts = []
    for (name, field, added, removed), kind in kinds.items():
        p = tables[name].select(reference_key(F.col(field)).alias("key"), wall_micros(F.col(added)).alias("ts"), F.coalesce(wall_micros(F.col(removed)), F.lit(2**63 - 1)).alias("ends")).dropna()
        row = lambda ts, typ, ends, first, kind=kind: [F.lit(kind).alias("kind"), "key", ts.alias("ts"), F.lit(typ).alias("typ"), ends.alias("ends"), first.alias("first"), F.lit(None).cast("int").alias("ref"), F.lit(None).cast("long").alias("row_id")]
        parts.append(p.distinct().select(*row(F.col("ts"), 1, F.col("ends"), F.lit(None).cast("long"))))
        parts.append(p.groupBy("key").agg(F.min("ts").alias("first")).select(*row(F.lit(LOWEST + 1), 0, F.lit(None).cast("long"), F.col("first"))))
    for i, r in enumerate(references):
        kind = kinds[(r.parent, r.parent_field, r.added, r.removed)]
        d = tables[r.table].select(reference_key(F.col(r.field)).alias("key"), F.coalesce(wall_micros(F.col(r.loaded)), F.lit(LOWEST)).alias("ts"), F.col(r.row_id).cast("long").alias("row_id")).where("key is not null")
        parts.append(d.select(F.lit(kind).alias("kind"), "key", "ts", F.lit(2).alias("typ"), F.lit(None).cast("long").alias("ends"), F.lit(None).cast("long").alias("first"), F.lit(i).alias("ref"), "row_id"))
    rows = materialised(reduce(DataFrame.unionByName, parts))  # range sampling would make every key twice
    merged = carried_running_max(range_sorted(rows, ["kind", "key"], ["ts", "typ", "ref", "row_id"]), ["kind", "key"], ["ends", "first"])
    status = F.when(F.col("ts") == LOWEST, "undated").when(F.col("run_first") == LOWEST, "missing").when(F.col("run_ends") == LOWEST, "late").otherwise("deleted")
    names = F.array(*(F.struct(F.lit(r.table).alias("t"), F.lit(r.field).alias("f")) for r in references))
    cases = merged.where((F.col("typ") == 2) & ((F.col("run_ends") <= F.col("ts")) | (F.col("ts") == LOWEST))).groupBy("ref", "row_id").agg(F.min("ts").alias("ts"), F.min(status).alias("status"))
    named = cases.withColumn("name", names[F.col("ref")])
    return named.select(F.col("name.t").alias("ref_table"), F.col("name.f").alias("ref_field"), "row_id", F.when(F.col("ts") != LOWEST, wall_clock(F.col("ts"))).alias("loaded_at"), "status")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Cases per referring table, field, month of loading and status."""
    month = F.date_format("loaded_at", "yyyy-MM").alias("month")
    return orphans.groupBy("ref_table", "ref_field", month, "status").agg(F.count("*").alias("n_cases"))


#: The references of the recording tables.
RECORDING_REFERENCES = [
    Reference("scans", "participant_id", "scan_id", "loaded_at", "participants", "participant_id", "added_at", "removed_at"),
    Reference("task_events", "scan_file", "event_id", "loaded_at", "scans", "filename", "loaded_at", "removed_at"),
    Reference("task_events", "stim_file", "event_id", "loaded_at", "stimuli", "stim_file", "added_at", "removed_at"),
    Reference("sidecars", "scan_file", "file_id", "loaded_at", "scans", "filename", "loaded_at", "removed_at"),
]

"""Linear scans over a globally range-sorted table, with state carried across partitions.

The rows are range-partitioned by key and position, so a hot key is cut into several partitions instead
of landing in one task. One JVM aggregation summarises each partition (its last key with that key's
running maxima); the summaries, one row per partition, are combined in order on the driver; a second,
partition-local pass continues each partition from the state it inherits. Nothing is grouped per key.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwave.session import ensure_checkpoint_dir, shuffle_partitions

LOWEST = -(2**63)


def range_sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df sorted by keys and order over all partitions and written once, so that two scans see the same cuts.

    `_part` numbers the cuts: a task's own number would change where the result becomes part of a union.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    by = [*keys, *order]
    return df.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).checkpoint()


def _carried(sorted_df: DataFrame, keys: list[str], values: list[str], island: tuple[str, str] | None) -> dict[int, tuple]:
    """For each partition the key it may continue, that key's running maxima and island start so far."""
    key = F.struct(*keys)
    aggs = [F.min(key).alias("first"), F.max(key).alias("last")]
    aggs += [F.max(F.struct(*keys, F.coalesce(F.col(v), F.lit(LOWEST)).alias("_v")))["_v"].alias(f"_{i}") for i, v in enumerate(values)]
    rows = sorted_df.groupBy(F.col("_part").alias("_pid")).agg(*aggs).collect()  # one row per partition
    starts = {}
    if island:
        starts = {r["_pid"]: r["_start"] for r in _local_islands(sorted_df, keys, *island).collect()}  # one row per partition
    carried: dict[int, tuple] = {}
    state: tuple | None = None
    for r in sorted(rows, key=lambda r: r["_pid"]):
        if state:
            carried[r["_pid"]] = state
        first, last = tuple(r["first"]), tuple(r["last"])
        maxima = [r[f"_{i}"] for i in range(len(values))]
        start = starts.get(r["_pid"], LOWEST)
        if state and state[0] == first == last:
            if island and start <= state[1][values.index(island[1])]:
                start = state[2]
            maxima = [max(a, b) for a, b in zip(maxima, state[1])]
        state = (last, maxima, start)
    return carried


def _same(a: object, b: object) -> bool:
    return bool(pd.isna(a) and pd.isna(b)) or a == b


def _segments(batch: pa.RecordBatch, keys: list[str], before: tuple | None) -> tuple[np.ndarray, tuple]:
    """A number per row that grows where the key changes (0: the key is still `before`), and the last key; nulls are one key."""
    new = np.zeros(batch.num_rows, bool)
    for i, k in enumerate(keys):
        v = batch[k].to_numpy(zero_copy_only=False)
        new[1:] |= ~((v[1:] == v[:-1]) | (pd.isna(v[1:]) & pd.isna(v[:-1])))
        new[0] |= before is None or not _same(v[0], before[i])
    return np.cumsum(new), tuple(batch[k][-1].as_py() for k in keys)


def _longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch[column].to_numpy(zero_copy_only=False)


def _local_islands(sorted_df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per partition the start of the last island of its last key, seen without any inherited state."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, top, opened, part = None, LOWEST, LOWEST, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch["_part"][0].as_py()
            seg, last = _segments(batch, keys, key)
            ends, starts = _longs(batch, end), _longs(batch, start)
            before = _exclusive(pd.Series(ends).groupby(seg).cummax().to_numpy(), seg, top)
            tail = seg == seg[-1]
            opens = starts[tail & (before < starts)]
            opened = int(opens[-1]) if len(opens) else opened
            top = max(int(ends[tail].max()), top if seg[-1] == 0 else LOWEST)
            key = last
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([opened], pa.int64())], names=["_pid", "_start"])

    return sorted_df.select("_part", *keys, start, end).mapInArrow(scan, "_pid int, _start long")


def _exclusive(run: np.ndarray, seg: np.ndarray, inherited: int) -> np.ndarray:
    """Running maximum before each row of its segment; segment 0 continues from `inherited`."""
    before = np.empty_like(run)
    before[1:], before[0] = run[:-1], LOWEST
    before[1:][seg[1:] != seg[:-1]] = LOWEST
    if len(seg) and seg[0] == 0:
        before[seg == 0] = np.maximum(before[seg == 0], inherited)
    return before


def carried_running_max(sorted_df: DataFrame, keys: list[str], values: list[str], island: tuple[str, str] | None = None) -> DataFrame:
    """Add, for each value column v, run_v (maximum up to and with the row) and prev_v (before the row) within its key.

    sorted_df comes from range_sorted. Keys must not be null; a null value counts as, and comes out as, the lowest bigint. island=(start, end)
    names two of the columns (end one of values) and adds island_start: the start of the run of overlapping
    or touching intervals that the row belongs to. Ties keep the sorted order; an empty table gives an empty one.
    """
    sorted_df = sorted_df.withColumns({v: F.coalesce(F.col(v).cast("long"), F.lit(LOWEST)) for v in values})
    carried = sorted_df.sparkSession.sparkContext.broadcast(_carried(sorted_df, keys, values, island))
    added = [*(f"run_{v}" for v in values), *(f"prev_{v}" for v in values), *(["island_start"] if island else [])]
    schema = T.StructType([*sorted_df.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                state = key, maxima, opened = carried.value.get(batch["_part"][0].as_py(), (None, [LOWEST] * len(values), LOWEST))
            seg, last = _segments(batch, keys, key)
            out = {}
            for i, v in enumerate(values):
                run = pd.Series(_longs(batch, v)).groupby(seg).cummax().to_numpy().copy()
                if seg[0] == 0:
                    run[seg == 0] = np.maximum(run[seg == 0], maxima[i])
                out[f"run_{v}"], out[f"prev_{v}"] = run, _exclusive(run, seg, maxima[i])
            if island:
                starts = _longs(batch, island[0])
                opens = pd.Series(np.where(out[f"prev_{island[1]}"] < starts, starts, LOWEST)).groupby(seg).cummax().to_numpy().copy()
                if seg[0] == 0:
                    opens[seg == 0] = np.maximum(opens[seg == 0], opened)
                out["island_start"], opened = opens, int(opens[-1])
            key, maxima = last, [int(out[f"run_{v}"][-1]) for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[c], pa.int64()) for c in added)], names=[*batch.schema.names, *added])

    return sorted_df.mapInArrow(scan, schema).drop("_part")


class _State:
    """What a scan carries from row to row of a key: running sums, last values, the row before, and running minima."""

    def __init__(self, sums: list[str], lasts: list[str], previous: list[str], least: list[str]):
        self.names = sums, lasts, previous, least
        self.key: tuple | None = None
        self.first: tuple | None = None
        self.reset()

    def reset(self) -> None:
        sums, lasts, previous, least = self.names
        self.sums, self.lasts, self.previous, self.least = [0] * len(sums), [None] * len(lasts), [None] * len(previous), [np.inf] * len(least)

    def step(self, batch: pa.RecordBatch, keys: list[str]) -> list[pa.Array]:
        """The batch's columns of results; the state moves on to its last row."""
        seg, last = _segments(batch, keys, self.key)
        n, at = batch.num_rows, np.arange(batch.num_rows)
        starts = np.maximum.accumulate(np.where(np.concatenate([[True], seg[1:] != seg[:-1]]), at, 0))
        if self.first is None:
            self.first = tuple(batch[k][0].as_py() for k in keys)
        if seg[0]:
            self.reset()
        out = []
        for i, name in enumerate(self.names[0]):
            v = pd.Series(batch[name].to_numpy(zero_copy_only=False)).fillna(0)
            run = v.groupby(seg).cumsum().to_numpy().copy()
            run[seg == seg[0]] += self.sums[i]
            out.append(pa.array(run, pa.float64() if pa.types.is_floating(batch.schema.field(name).type) else pa.int64()))
            self.sums[i] = run[-1].item()
        for i, name in enumerate(self.names[1]):
            column = batch[name]
            found = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), at, -1))
            place = np.where(found >= starts, found + 1, np.where(seg == seg[0], 0, -1))
            both = pa.concat_arrays([pa.array([self.lasts[i]], column.type), column])
            out.append(both.take(pa.array(place, mask=place < 0)))
            self.lasts[i] = out[-1][-1].as_py()
        for i, name in enumerate(self.names[2]):
            column = batch[name]
            place = np.where(at > starts, at, np.where((at == 0) & (seg == seg[0]), 0, -1))
            both = pa.concat_arrays([pa.array([self.previous[i]], column.type), column])
            out.append(both.take(pa.array(place, mask=place < 0)))
            self.previous[i] = column[n - 1].as_py()
        for i, name in enumerate(self.names[3]):
            run = pd.Series(batch[name].to_numpy(zero_copy_only=False).astype(float)).fillna(np.inf).groupby(seg).cummin().to_numpy().copy()
            run[seg == seg[0]] = np.minimum(run[seg == seg[0]], self.least[i])
            out.append(pa.array(run, pa.float64(), mask=np.isinf(run)))
            self.least[i] = run[-1].item()
        self.key = last
        return out

    def after(self, before: _State) -> _State:
        """This partition's end state, continued from the one before it where both are of one key throughout."""
        if before.key is not None and all(map(_same, before.key, self.key)) and all(map(_same, self.first, self.key)):
            self.sums = [a + b for a, b in zip(before.sums, self.sums)]
            self.lasts = [a if b is None else b for a, b in zip(before.lasts, self.lasts)]
            self.least = [min(a, b) for a, b in zip(before.least, self.least)]
        return self


def carried(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, previous: dict[str, str] | None = None, least: dict[str, str] | None = None) -> DataFrame:
    """df with, for each {out: column} and within each key in order: running sums (up to and with the row; nulls add
    nothing), last values that are not null (up to and with the row), the previous row's values, and running minima
    (finite doubles; null before the first).

    The table is range-sorted over all partitions, so a hot key is cut into several; one pass tells each partition's end
    state, one row per partition reaches the driver, and a second pass continues from it. Null keys are one key.
    """
    sums, lasts, previous, least = sums or {}, lasts or {}, previous or {}, least or {}
    names = [list(x.values()) for x in (sums, lasts, previous, least)]
    placed = range_sorted(df, keys, order)
    kinds = {f.name: f.dataType for f in placed.schema.fields}

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part = _State(*names), 0
        for batch in batches:
            if batch.num_rows:
                part = batch["_part"][0].as_py()
                state.step(batch, keys)
        if state.first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(state)], pa.binary())], names=["pid", "state"])

    needed = list(dict.fromkeys(["_part", *keys, *names[0], *names[1], *names[2], *names[3]]))
    starts, now = {}, _State(*names)
    for r in placed.select(*needed).mapInArrow(ends, "pid int, state binary").orderBy("pid").collect():  # one row per partition
        starts[r["pid"]] = pickle.dumps(now)
        now = pickle.loads(r["state"]).after(now)
    shared = placed.sparkSession.sparkContext.broadcast(starts)
    number = lambda c: T.DoubleType() if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else T.LongType()
    added = [*(T.StructField(o, number(c)) for o, c in sums.items()), *(T.StructField(o, kinds[c]) for o, c in (*lasts.items(), *previous.items())), *(T.StructField(o, T.DoubleType()) for o in least)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                if state is None:  # a copy, as tasks of one worker share the broadcast
                    state = pickle.loads(shared.value[batch["_part"][0].as_py()])
                out = state.step(batch, keys)
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *(f.name for f in added)])

    return placed.mapInArrow(scan, T.StructType([*placed.schema.fields, *added])).drop("_part")


def global_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with its place (from 0) in a global order, without sorting in one task.

    Rows are range-sorted over the partitions; only the partitions' sizes reach the driver. Ties are placed as they come.
    """
    placed = range_sorted(df, [], order)
    sizes = {r["pid"]: r["count"] for r in placed.groupBy(F.col("_part").alias("pid")).count().collect()}
    first, total = {}, 0
    for pid in sorted(sizes):
        first[pid], total = total, total + sizes[pid]
    shared = placed.sparkSession.sparkContext.broadcast(first)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = shared.value[batch["_part"][0].as_py()] if at is None else at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows), pa.int64())], names=[*batch.schema.names, out])
            at += batch.num_rows

    return placed.mapInArrow(scan, T.StructType([*placed.schema.fields, T.StructField(out, T.LongType())])).drop("_part")

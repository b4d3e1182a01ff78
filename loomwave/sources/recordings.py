"""Readers and writers of recordings and their sidecars."""

from __future__ import annotations

import fnmatch
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Volts a unit of a binary recording (fixed values).
SCALE = {"V": 1.0, "mV": 1e-3, "uV": 1e-6, "nV": 1e-9}


def catalog(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths with their entities (subject, session, task, run, description), suffix and extension."""
    name = F.element_at(F.split(path, "/"), -1)
    entity = lambda key: F.nullif(F.regexp_extract(name, rf"(?:^|_){key}-([A-Za-z0-9]+)", 1), F.lit(""))
    return paths.select(
        "*", *(entity(k).alias(n) for k, n in (("sub", "subject"), ("ses", "session"), ("task", "task"), ("run", "run"), ("desc", "description"))),
        F.nullif(F.regexp_extract(name, r"_([A-Za-z0-9]+)\.[A-Za-z0-9.]+$", 1), F.lit("")).alias("suffix"), F.regexp_extract(name, r"(\.[A-Za-z0-9.]+)$", 1).alias("extension"),
    )


def find_one(files: DataFrame, path: str = "path", **entities: str) -> DataFrame:
    """The one catalog row with these entities; fails unless there is exactly one."""
    match = files
    for key, value in entities.items():
        match = match.where(F.col(key) == value)
    n = match.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} file with {entities}")
    return match


def latest_match(paths: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """The last path by name that matches a pattern; one row, null if none does."""
    return paths.where(F.col(path).rlike(pattern)).agg(F.max(path).alias(path))


def read_interleaved(spark: SparkSession, path: str, channels: list[str], sfreq: float, unit: str = "uV") -> DataFrame:
    """Packed rows (path, channel, sfreq, t0, values in volts) of float32 files with interleaved channels.

    The channel named Trigger is left out. A file is read by one task, so recordings should come in files of bounded size.
    """
    keep = [i for i, c in enumerate(channels) if c.lower() != "trigger"]
    scale = SCALE[unit]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                data = np.frombuffer(content, "<f4", count=len(content) // 4 // len(channels) * len(channels)).reshape(-1, len(channels))
                yield pd.DataFrame({"path": p, "channel": [channels[i] for i in keep], "sfreq": sfreq, "t0": 0.0, "values": [(data[:, i].astype(float) * scale).tolist() for i in keep]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, channel string, sfreq double, t0 double, values array<double>")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Rows of tab-separated events files, n/a as null."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="n/a", schema="onset double, duration double, trial_type string, response_time double, stim_file string")


def bad_channel_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of the channels whose status is bad."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="n/a").where("status = 'bad'").select("name")


def read_volume_labels(spark: SparkSession, path: str) -> DataFrame:
    """channel and ranked (array of label, pct) of a headless CSV: name, count, then label and share in turn."""
    fields = F.split(F.col("value"), ",")
    pairs = F.transform(F.sequence(F.lit(2), F.greatest(F.size(fields) - 2, F.lit(2)), F.lit(2)), lambda i: F.struct(F.trim(F.get(fields, i)).alias("label"), F.get(fields, i + 1).try_cast("double").alias("pct")))
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim(fields[0]).alias("channel"), F.filter(pairs, lambda x: x["pct"].isNotNull()).alias("ranked"))


def read_electrodes(spark: SparkSession, path: str) -> DataFrame:
    """name (the first two tokens), x, y, z in metres and side of a blank-separated list in millimetres."""
    t = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(F.concat(t[0], t[1]).alias("name"), *((t[i + 2].cast("double") / 1000).alias(a) for i, a in enumerate("xyz")), F.get(t, F.lit(5)).alias("side"))


def fill_down(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Blank cells of a short lookup sheet take the last value above (merged cells); one ordered pass."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(F.nullif(F.trim(c), F.lit("")), ignorenulls=True).over(w) for c in columns})


def parse_abbreviation(c: Column) -> tuple[Column, Column]:
    """Head and tail of "abbr, long name"."""
    parts = F.split(c, ",")
    return F.trim(parts[0]), F.trim(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), ","))


def save_derivative(df: DataFrame, path: str, partition: list[str]) -> None:
    """Write a derivative partitioned by its entities, replacing the partitions that it holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, s3, gs and others that pyarrow knows) and the path within it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The files that a path names: itself, those of a folder, or those whose names match its last part with * and ?."""
    system, inner = _file_system(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    folder, _, name = inner.rpartition("/")
    if any(c in name for c in "*?"):
        found = [f for f in system.get_file_info(fs.FileSelector(folder or ".")) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, name)]
    elif system.get_file_info(inner).type == fs.FileType.Directory:
        found = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File]
    else:
        return [path]
    return sorted(prefix + f.path for f in found)


def _open(path: str):
    system, inner = _file_system(path)
    return system.open_input_file(inner)


class OpenRecording(DataSource):
    """Continuous recordings of blocks: a 1024-byte text header, then records of a timestamp, a count, 1024 big-endian
    samples and a marker. Read with format("open_recording") after registering; one partition per `blocks` records of a
    file. path is a file, a folder or a pattern, local or on any file system that pyarrow opens.
    """

    HEADER, RECORD, SAMPLES = 1024, 8 + 2 + 2 + 2 * 1024 + 10, 1024

    @classmethod
    def name(cls) -> str:
        return "open_recording"

    def schema(self) -> str:
        return "channel string, sfreq double, block long, timestamp long, values array<double>, path string"

    def reader(self, schema) -> DataSourceReader:
        return _OpenReader(self.options)


def _text_header(content: bytes):
    """A lookup of the fields of a text header."""
    fields = dict(x.strip().split("=", 1) for x in content.decode("latin-1").replace("header.", "").split(";") if "=" in x)
    return lambda k, default: fields.get(f"{k} ", fields.get(k, default)).strip().strip("'")


class _OpenReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.blocks = options["path"], int(options.get("blocks", 1000))

    def partitions(self):
        parts = []
        for path in _files(self.path):
            with _open(path) as f:
                n = (f.size() - OpenRecording.HEADER) // OpenRecording.RECORD
            parts += [InputPartition((path, a, min(a + self.blocks, n))) for a in range(0, n, self.blocks)]
        return parts

    def read(self, partition):
        path, a, b = partition.value
        with _open(path) as f:
            field = _text_header(f.read(OpenRecording.HEADER))
            volts, sfreq, channel = float(field("bitVolts", "1")), float(field("sampleRate", "1")), field("channel", "")
            f.seek(OpenRecording.HEADER + a * OpenRecording.RECORD)
            for i in range(a, b):
                record = f.read(OpenRecording.RECORD)
                stamp, count = struct.unpack("<qH", record[:10])
                yield channel, sfreq, i, stamp, (np.frombuffer(record, ">i2", count, 12) * volts).tolist(), path


def read_open_events(spark: SparkSession, path: str) -> DataFrame:
    """path, timestamp, position, kind, node, event, channel, recording of event files: a 1024-byte text header, then records
    of 16 bytes. A file is read by one task; events are few against samples.
    """
    record = np.dtype([("timestamp", "<i8"), ("position", "<i2"), ("kind", "u1"), ("node", "u1"), ("event", "u1"), ("channel", "u1"), ("recording", "<u2")])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                body = content[OpenRecording.HEADER :]
                rows = np.frombuffer(body, record, len(body) // record.itemsize)
                yield pd.DataFrame({"path": p, **{n: rows[n].astype(np.int64) for n in record.names}})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, timestamp long, position long, kind long, node long, event long, channel long, recording long")


def load_conditions(spark: SparkSession, path: str, value_type: str, conditions: list[str], average: bool = False) -> DataFrame:
    """Derivatives of one kind (zscore, power, significance or pval) under path/<kind>, partitioned by subject and condition.

    Only the wanted partitions are read; what is missing is absent. power is divided by the deviation of all its
    values. average takes the mean over trials (columns subject, condition, event, channel, t, v).
    """
    df = spark.read.option("mergeSchema", "false").parquet(f"{path}/{value_type}").where(F.col("condition").isin(*conditions))
    df = df.withColumn("event", F.element_at(F.split("event", "/"), -1))
    if value_type == "power":
        spread = df.agg(F.stddev_pop("v").alias("_s"))
        df = df.join(F.broadcast(spread)).withColumn("v", F.col("v") / F.nullif("_s", F.lit(0.0))).drop("_s")
    return df.groupBy("subject", "condition", "event", "channel", "t").agg(F.avg("v").alias("v")) if average else df


class RhdRecording(DataSource):
    """Signals of RHD2000 files (format version 1 and up, 60 or 128 samples a block): channel, sfreq, block, timestamp
    (of the first sample, in samples), values and path. One partition per `blocks` blocks of a file; path as in OpenRecording.

    Option `signals`: amplifier (microvolts), auxiliary (volts, a quarter of the rate), adc (volts, by the board's mode)
    or digital (0 and 1; trigger lines).
    """

    @classmethod
    def name(cls) -> str:
        return "rhd_recording"

    def schema(self) -> str:
        return "channel string, sfreq double, block long, timestamp long, values array<double>, path string"

    def reader(self, schema) -> DataSourceReader:
        return _RhdReader(self.options)


class _RhdReader(DataSourceReader):
    MAGIC = 0xC6912702
    #: Kind of channel of each option, and volts a unit and offset of the board's inputs by mode (fixed values).
    KINDS = {"amplifier": 0, "auxiliary": 1, "adc": 3, "digital": 4}
    BOARD = {0: (0.000050354, 0), 1: (0.00015259, 32768), 13: (0.0003125, 32768)}

    def __init__(self, options):
        self.path, self.blocks, self.signals = options["path"], int(options.get("blocks", 500)), options.get("signals", "amplifier")
        if self.signals not in self.KINDS:
            raise ValueError(f"signals must be one of {', '.join(self.KINDS)}")

    def _header(self, f) -> dict:
        take = lambda fmt: struct.unpack("<" + fmt, f.read(struct.calcsize("<" + fmt)))

        def text() -> str:
            (n,) = take("I")
            return "" if n == 0xFFFFFFFF else f.read(n).decode("utf-16-le")

        magic, major, minor = take("Ihh")
        if magic != self.MAGIC:
            raise ValueError("no RHD file")
        (rate,) = take("f")
        take("h6f")  # filters that were on, and their corners
        take("h2f")  # notch mode, impedance frequencies
        for _ in range(3):
            text()
        version = (major, minor)
        sensors = take("h")[0] if version >= (1, 1) else 0
        board = take("h")[0] if version >= (1, 3) else 0
        if version >= (2, 0):
            text()
        kinds: dict[int, list[tuple[str, int]]] = {k: [] for k in range(6)}
        for _ in range(take("h")[0]):
            text(), text()
            on, channels, _ = take("hhh")
            for _ in range(channels):
                name, _ = text(), text()
                order, _, kind, enabled, _, _ = take("hhhhhh")
                take("4h2f")  # trigger settings and impedance
                if on and enabled:
                    kinds[kind].append((name, order))
        samples = 128 if major >= 2 else 60
        n = {k: len(v) for k, v in kinds.items()}
        sizes = [samples * 4, samples * 2 * n[0], samples // 4 * 2 * n[1], 2 * n[2], 2 * sensors, samples * 2 * n[3], samples * 2 * bool(n[4]), samples * 2 * bool(n[5])]
        starts = dict(zip(("amplifier", "auxiliary", "supply", "sensors", "adc", "digital"), np.cumsum(sizes).tolist()))
        signed = version >= (1, 2)
        return {"channels": kinds[self.KINDS[self.signals]], "rate": rate, "samples": samples, "size": sum(sizes), "at": starts[self.signals], "start": f.tell(), "signed": signed, "board": board}

    def _open(self, path: str):
        f = _open(path)
        try:
            return f, self._header(f)
        except (ValueError, struct.error):
            raise ValueError(f"{path} is no RHD file") from None

    def partitions(self):
        parts = []
        for path in _files(self.path):
            f, h = self._open(path)
            with f:
                n = (f.size() - h["start"]) // h["size"]
            parts += [InputPartition((path, a, min(a + self.blocks, n))) for a in range(0, n, self.blocks)]
        return parts

    def _values(self, h: dict, block: bytes) -> np.ndarray:
        """Channels x samples of a block."""
        channels, samples = h["channels"], h["samples"] // 4 if self.signals == "auxiliary" else h["samples"]
        if self.signals == "digital":
            word = np.frombuffer(block, "<u2", samples, h["at"])
            return np.array([(word >> order) & 1 for _, order in channels], float)
        raw = np.frombuffer(block, "<u2", samples * len(channels), h["at"]).reshape(len(channels), samples).astype(float)
        if self.signals == "amplifier":
            return (raw - 32768) * 0.195
        step, middle = (0.0000374, 0) if self.signals == "auxiliary" else self.BOARD.get(h["board"], self.BOARD[0])
        return (raw - middle) * step

    def read(self, partition):
        path, a, b = partition.value
        f, h = self._open(path)
        rate = float(h["rate"]) / (4 if self.signals == "auxiliary" else 1)
        with f:
            f.seek(h["start"] + a * h["size"])
            for i in range(a, b):
                block = f.read(h["size"])
                (stamp,) = struct.unpack("<i" if h["signed"] else "<I", block[:4])
                for (name, _), row in zip(h["channels"], self._values(h, block)):
                    yield name, rate, i, stamp, row.tolist(), path

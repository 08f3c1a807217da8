"""Recordings as a Spark data source: `recordings` reads column-major files by blocks and writes row-major ones that appear together or not at all.

Reading: a partition is one block of one file; sessions, files and channels that are asked for are options, so others are not read. They are no pushed filters,
because Spark 4.1 plans a Python source once for a DataFrame: a filter of one query on it would hold for the next one too.
Writing: each task streams its files into a folder of its own beside the target; the commit moves what succeeded into place, an abort removes it.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from voltaloom import constants as C
from voltaloom.functions import names
from voltaloom.sources import recordings as R

NAME = "recordings"
_STAGING = ".staging-"
#: What the writer takes: SIGNALS with the file's name below the folder and its number of samples.
WRITTEN = f"{R.SIGNALS}, name string, samples long"


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(folder.rstrip("/") if ":/" in folder else "file:" + os.path.abspath(folder), safe=":/"))


@dataclass
class Block(InputPartition):
    """One block of a file: what _rows and _ranges of recordings need, and the places of the channels that are wanted."""

    row: dict
    wanted: list[int]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.seconds, self.asked = options["path"], float(options.get("seconds", 4.0)), {k: set(v) for k, v in json.loads(options.get("asked", "{}")).items()}

    def partitions(self) -> list[Block]:
        """From the metadata files and the lengths of the others alone. A file without metadata, or with unknown units, is an error."""
        from pyarrow import fs

        store, root = _store(self.folder)
        found = {f.path: f.size for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and _STAGING not in f.path}
        out = []
        for path, size in sorted(found.items()):
            if not path.endswith(R.COLUMN_MAJOR) or not size:
                continue
            stem, session, file_idx = path[: -len(R.COLUMN_MAJOR)], os.path.dirname(path), names.file_index(path)
            if session not in self.asked.get("session", {session}) or file_idx not in self.asked.get("file_idx", {file_idx}):
                continue
            if stem + R.METADATA not in found:
                raise ValueError(f"{path} has no metadata")
            with store.open_input_stream(stem + R.METADATA) as f:
                lines = list(csv.DictReader(io.StringIO(f.read().decode("utf-8"))))
            if not lines or lines[0]["Units"] not in C.UNITS:
                raise ValueError(f"{stem}{R.METADATA} has no rows or no known units")
            channels = [x["ProbeInfo"] for x in lines]
            rate, kind = float(lines[0]["SampleRate"]), np.dtype(lines[0]["Precision"])
            wanted = [k for k, c in enumerate(channels) if c in self.asked.get("channel", {c})]
            samples, step = size // (len(channels) * kind.itemsize), max(round(rate * self.seconds), 1)
            row = {"path": path, "session": session, "file_idx": file_idx, "channels": [channels[k] for k in wanted], "f_s": rate, "precision": kind.str, "to_uv": C.UNITS[lines[0]["Units"]], "samples": samples, "step": step}
            out += [Block(row | {"block": b, "start": lo}, wanted) for b, lo in enumerate(range(0, samples, step)) if wanted]
        return out or [Block({}, [])]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if not partition.wanted:
            return
        row, kind = partition.row, np.dtype(partition.row["precision"])
        n = min(row["step"], row["samples"] - row["start"])
        with _store(self.folder)[0].open_input_file(row["path"]) as f:
            got = [np.frombuffer(f.read_at(n * kind.itemsize, (c * row["samples"] + row["start"]) * kind.itemsize), kind) for c in partition.wanted]
        yield R._rows(row, row["block"], row["start"], np.stack(got) * row["to_uv"])


@dataclass
class Done(WriterCommitMessage):
    """Files that a task has finished: (staged path, name below the folder)."""

    files: list[tuple[str, str]]


class _File:
    """One row-major file and its metadata as they are written, block by block."""

    def __init__(self, store, target: str):
        self.store, self.target, self.channels = store, target, []
        self.raw = store.open_output_stream(target + R.ROW_MAJOR, compression=None)
        self.stream = gzip.GzipFile(fileobj=self.raw, mode="wb", mtime=0)

    def add(self, block: list[dict]) -> None:
        """The rows of one block's channels."""
        if not self.channels:
            self.channels = [r["channel"] for r in block]
            np.lib.format.write_array_header_1_0(self.stream, {"descr": "<f4", "fortran_order": False, "shape": (block[0]["samples"], len(block))})
            lines = ["Entity,BinColumn,Label,ProbeInfo,SampleRate,Units,Precision,LastEdit", *(f"1,{i},C-{i},{c},{block[0]['f_s']:g},µV,float32," for i, c in enumerate(self.channels))]
            with self.store.open_output_stream(self.target + R.METADATA) as f:
                f.write(("\n".join(lines) + "\n").encode("utf-8"))
        self.stream.write(np.ascontiguousarray(np.stack([np.asarray(r["signal"], "<f4") for r in block], axis=1)).tobytes())

    def close(self) -> None:
        self.stream.close()
        self.raw.close()


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.run = options["path"], options["run"]

    def _staging(self) -> tuple:
        store, root = _store(self.folder)
        return store, root, f"{root}/{_STAGING}{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        """Rows come by file, block and channel; what is held is one block's channels."""
        store, _, staging = self._staging()
        mine, done = f"{staging}/{uuid.uuid4().hex}", []
        rows = (row for batch in iterator for row in batch.to_pylist())
        for name, of_file in groupby(rows, itemgetter("name")):
            store.create_dir(mine)
            target = f"{mine}/{len(done)}"
            done += [(target + end, name + end) for end in (R.ROW_MAJOR, R.METADATA)]
            file = _File(store, target)
            for _, block in groupby(of_file, itemgetter("block")):
                file.add(list(block))
            file.close()
        return Done(done)

    def commit(self, messages: list[Done | None]) -> None:
        store, root, staging = self._staging()
        for staged, name in (f for m in messages if m for f in m.files):
            store.create_dir(os.path.dirname(f"{root}/{name}"))
            store.move(staged, f"{root}/{name}")
        store.delete_dir(staging) if store.get_file_info(staging).type.name == "Directory" else None

    def abort(self, messages: list[Done | None]) -> None:
        store, _, staging = self._staging()
        if store.get_file_info(staging).type.name == "Directory":
            store.delete_dir(staging)


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return R.SIGNALS

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to the session."""
    spark.dataSource.register(RecordingSource)
    return spark


def read_blocks(spark: SparkSession, folder: str, seconds: float = 4.0, session: list[str] | None = None, file_idx: list[int] | None = None, channel: list[str] | None = None) -> DataFrame:
    """SIGNALS of the column-major files below folder, or of the sessions, file numbers and channels asked for."""
    asked = {k: list(v) for k, v in (("session", session), ("file_idx", file_idx), ("channel", channel)) if v is not None}
    return register(spark).read.format(NAME).option("seconds", str(seconds)).option("asked", json.dumps(asked)).load(folder)


def written_names(folder: str) -> list[str]:
    """Names, below folder, of the recordings that are there whole."""
    from pyarrow import fs

    store, root = _store(folder)
    there = {f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file and _STAGING not in f.path}
    return sorted(p[len(root) + 1 : -len(R.ROW_MAJOR)] for p in there if p.endswith(R.ROW_MAJOR) and p[: -len(R.ROW_MAJOR)] + R.METADATA in there)


def transcode(signals: DataFrame, folder: str, overwrite: bool = False) -> list[str]:
    """Write SIGNALS as row-major files, named by session folder and file number, and give the names that were written; those that are there already are left out unless overwrite.

    A file is one task's work, a block at a time. Sessions whose folders have one name, and files of which a block lacks a channel, are an error.
    """
    spark = register(signals.sparkSession)
    base = F.regexp_extract("session", "([^/]+)/?$", 1)
    named = signals.withColumn("name", F.concat(base, F.lit("/"), base, F.lit("-"), F.col("file_idx").cast("string")))
    each = named.groupBy("name", "block").agg(F.count("*").alias("c"), F.max(F.col("start") + F.size("signal")).alias("end"), F.count_distinct("session").alias("s"), F.count_distinct(F.size("signal")).alias("l"))
    files = each.groupBy("name").agg(F.max("end").cast("long").alias("samples"), F.max("s").alias("s"), F.count_distinct("c").alias("cs"), F.max("l").alias("ls")).collect()  # a row a file
    if odd := sorted(r.name for r in files if r.s > 1 or r.cs > 1 or r.ls > 1):
        raise ValueError(f"files of several sessions or with incomplete blocks: {odd}")
    there = set() if overwrite else set(written_names(folder))
    wanted = [(r.name, r.samples) for r in files if r.name not in there]
    if not wanted:
        return []
    rows = named.join(spark.createDataFrame(wanted, "name string, samples long"), "name").select(*(c.split()[0] for c in WRITTEN.split(", ")))
    placed = rows.repartition(len(wanted), "name").sortWithinPartitions("name", "block", "channel")
    placed.write.format(NAME).mode("append").option("path", folder).option("run", uuid.uuid4().hex).save()
    return sorted(n for n, _ in wanted)

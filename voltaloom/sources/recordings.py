"""Recordings in folders: metadata tables, binary files by channel or by sample, other formats by a callable, and session folders.

A plan of blocks is made from file lengths alone; each task then reads the byte ranges of its blocks, so no file is held whole and a
long file is read by many tasks. Compressed files cannot be entered midway: one task reads such a file as a stream, block by block.
"""

from __future__ import annotations

import gzip
import os
import re
from collections.abc import Callable
from glob import escape, glob
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltaloom.functions import names

# Markers at the end of a recording's files.
COLUMN_MAJOR, ROW_MAJOR, METADATA = "_ColMajor.bin", "_RowMajor.npy.gz", "_Meta.csv"

SIGNALS = "session string, file_idx int, block long, start long, f_s double, channel string, signal array<float>"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of recordings below folder: path, session (their folder), stem, kind, file_idx, length, modified.

    Column-major files without a byte go, with all files of their stem. Contents are not read.
    """
    from pyarrow import fs

    uri = folder.rstrip("/") if ":/" in folder else "file:" + os.path.abspath(folder)
    store, root = fs.FileSystem.from_uri(quote(uri, safe=":/"))
    prefix = re.sub("^file:/*$", "file:", uri[: -len(root)])
    listed = [(prefix + f.path, f.size, f.mtime) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]  # Spark's own listing has no empty files
    found = spark.createDataFrame(listed, "path string, length long, modified timestamp")
    path, kind = F.col("path"), F.regexp_extract("path", r"_(ColMajor\.bin|RowMajor\.npy\.gz|Meta\.csv)$", 1)
    got = found.withColumn("kind", kind).where("kind <> ''").select(
        "path", F.regexp_replace(path, "/[^/]*$", "").alias("session"), F.regexp_replace(path, r"_(ColMajor\.bin|RowMajor\.npy\.gz|Meta\.csv)$", "").alias("stem"),
        F.substring_index("kind", ".", 1).alias("kind"), names.file_index_col(path).alias("file_idx"), "length", "modified",
    )
    return got.join(got.where("kind = 'ColMajor' and length = 0").select("stem"), "stem", "left_anti")


def read_metadata(spark: SparkSession, files: DataFrame) -> DataFrame:
    """A row for each metadata file: stem, session, file_idx, channels, n_channels, f_s, units, to_uv, precision, ended, constant.

    Channels stand in the order of the file's rows. constant: f_s, units and precision each have one value, else the first counts.
    A file without rows is a ValueError, and so is a folder without metadata.
    """
    listed = [r.asDict() for r in files.where("kind = 'Meta'").select("path", "stem", "session", "file_idx").collect()]  # a row for each file, not for its content
    if not listed:
        raise ValueError("no metadata file")
    rows = spark.read.csv([r["path"] for r in listed], header=True)
    for absent in {"LastEdit"} - set(rows.columns):
        rows = rows.withColumn(absent, F.lit(None).cast("string"))
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at")).withColumn("_stem", F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace("_file", r"\+", "%2B")), "^file:/+", "file:/"), r"_Meta\.csv$", ""))
    one = [("SampleRate", "f_s"), ("Units", "units"), ("Precision", "precision"), ("LastEdit", "ended")]
    meta = rows.groupBy(F.col("_stem").alias("stem")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "ProbeInfo"))), lambda x: x.ProbeInfo).alias("channels"),
        *(F.min_by(c, "_at").alias(n) for c, n in one),
        F.greatest(*(F.count_distinct(c) for c, _ in one[:3])).alias("_most"),
    )
    meta = files.where("kind = 'Meta'").select("stem", "session", "file_idx").join(meta, "stem", "left")
    empty = [r.stem for r in meta.where("channels is null").select("stem").collect()]
    if empty:
        raise ValueError(f"metadata without rows: {empty}")
    return meta.select(
        "stem", "session", "file_idx", "channels", F.size("channels").alias("n_channels"), F.col("f_s").cast("double").alias("f_s"), "units",
        names.unit_scale(F.col("units")).alias("to_uv"), "precision", F.try_to_timestamp("ended").cast("timestamp_ntz").alias("ended"), (F.col("_most") <= 1).alias("constant"),
    )


#: A recording's metadata as JSON: what read_metadata gives, without the file it came from.
META_JSON = "channels array<string>, n_channels int, f_s double, units string, to_uv double, precision string, ended timestamp_ntz, constant boolean"


def metadata_to_json(meta: DataFrame) -> DataFrame:
    """stem, session, file_idx, json of metadata as of read_metadata; what is missing is null in it."""
    fields = [c.split()[0] for c in META_JSON.split(", ")]
    return meta.select("stem", "session", "file_idx", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def metadata_from_json(rows: DataFrame) -> DataFrame:
    """What metadata_to_json wrote; text that is no such JSON is an error."""
    read = F.from_json("json", META_JSON, {"mode": "FAILFAST"})
    return rows.select("stem", "session", "file_idx", read.alias("_m")).select("stem", "session", "file_idx", "_m.*")


def metadata_of(spark: SparkSession, stem: str, channels: list[str], f_s: float, units: str = "µV", precision: str = "float32", session: str = "", file_idx: int = 0, ended=None) -> DataFrame:
    """One recording's metadata from its parameters, as read_metadata would give it. Units that are not known are a ValueError."""
    if units not in names.C.UNITS:
        raise ValueError(f"unknown units {units!r}")
    row = (stem, session, file_idx, list(channels), len(channels), float(f_s), units, names.C.UNITS[units], precision, ended, True)
    return spark.createDataFrame([row], f"stem string, session string, file_idx int, {META_JSON}")


def check_consistent(meta: DataFrame) -> None:
    """ValueError unless all files of a session agree in channels, units and precision; sample rates may differ."""
    mixed = meta.groupBy("session").agg(F.count_distinct(F.struct("n_channels", "channels", "units", "precision")).alias("n")).where("n > 1")
    wrong = [r.session for r in mixed.select("session").limit(5).collect()]
    if wrong:
        raise ValueError(f"files that differ in channels, units or precision: {wrong}")


def first_files(n: int | bool) -> int:
    """How many files or folders to keep; True is 10, False and 0 are all."""
    if not isinstance(n, int):
        raise ValueError(f"neither a number nor a truth value: {n!r}")
    return 10 if n is True else int(n)


def truncated(df: DataFrame, n: int | bool, session: str = "session", order: str = "file_idx") -> DataFrame:
    """The first n files of each session."""
    most = first_files(n)
    if not most:
        return df
    return df.withColumn("_at", F.dense_rank().over(Window.partitionBy(session).orderBy(order))).where(F.col("_at") <= most).drop("_at")


def item_bytes(precision: Column) -> Column:
    """Bytes of a sample by the name of its type, such as float32."""
    return (F.regexp_extract(precision, r"(\d+)$", 1).try_cast("int") / 8).cast("int")


def file_durations(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Of each column-major file its samples, duration and the session's duration up to its end (cum), in seconds."""
    sized = files.where("kind = 'ColMajor'").select("stem", "path", "length").join(meta, "stem")
    n = sized.withColumn("samples", F.floor(F.col("length") / (F.col("n_channels") * item_bytes(F.col("precision")))).cast("long"))
    d = n.withColumn("duration", F.col("samples") / F.col("f_s"))
    return d.withColumn("cum", F.sum("duration").over(Window.partitionBy("session").orderBy("file_idx").rowsBetween(Window.unboundedPreceding, 0)))


def _rows(row: dict, block: int, start: int, x: np.ndarray) -> pa.RecordBatch:
    """x: channels by samples, in microvolts."""
    n = x.shape[0]
    values = pa.array(np.ascontiguousarray(x, np.float32).reshape(-1))
    signal = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), values)
    same = [pa.array([row["session"]] * n, pa.string()), pa.array([row["file_idx"]] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array([start] * n, pa.int64()), pa.array([row["f_s"]] * n, pa.float64())]
    return pa.RecordBatch.from_arrays([*same, pa.array(row["channels"], pa.string()), signal], ["session", "file_idx", "block", "start", "f_s", "channel", "signal"])


def _ranges(batches):
    from pyarrow import fs

    for batch in batches:
        for row in batch.to_pylist():
            store, path = fs.FileSystem.from_uri(quote(row["path"], safe=":/"))
            kind, lo = np.dtype(row["precision"]), row["start"]
            n = min(row["step"], row["samples"] - lo)
            with store.open_input_file(path) as f:
                got = [np.frombuffer(f.read_at(n * kind.itemsize, (c * row["samples"] + lo) * kind.itemsize), kind) for c in range(row["n_channels"])]
            yield _rows(row, row["block"], lo, np.stack(got) * row["to_uv"])


def read_column_major(files: DataFrame, meta: DataFrame, seconds: float) -> DataFrame:
    """Blocks of `seconds` of each file as SIGNALS, in microvolts; a file's last block may be shorter."""
    plan = file_durations(files, meta).where("samples > 0").withColumn("step", F.greatest(F.round(F.col("f_s") * seconds).cast("long"), F.lit(1)))
    blocks = plan.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("samples") - 1) / F.col("step")).cast("long"))))
    wanted = blocks.select("session", "file_idx", "path", "channels", "n_channels", "f_s", "precision", "to_uv", "samples", "step", "block", (F.col("block") * F.col("step")).alias("start"))
    return wanted.repartition("path", "block").mapInArrow(_ranges, SIGNALS)


def _streams(seconds: float):
    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(quote(row["path"], safe=":/"))
                step, block = max(round(row["f_s"] * seconds), 1), 0
                with store.open_input_stream(path, compression=None) as raw, gzip.open(raw) as f:
                    major = np.lib.format.read_magic(f)[0]
                    (n, c), by_column, kind = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(f)
                    if by_column or c != row["n_channels"]:
                        raise ValueError(f"{row['path']}: not row by row, or not of {row['n_channels']} channels")
                    for lo in range(0, n, step):
                        x = np.frombuffer(f.read(min(step, n - lo) * c * kind.itemsize), kind).reshape(-1, c)
                        yield _rows(row, block, lo, x.T * row["to_uv"])
                        block += 1

    return run


def read_row_major(files: DataFrame, meta: DataFrame, seconds: float) -> DataFrame:
    """As read_column_major, of compressed arrays of samples by channels."""
    wanted = files.where("kind = 'RowMajor'").select("stem", "path").join(meta.select("stem", "session", "file_idx", "channels", "n_channels", "f_s", "to_uv"), "stem")
    return wanted.repartition("path").mapInArrow(_streams(seconds), SIGNALS)


def read_extracted(spark: SparkSession, paths: list[str], extract: Callable[[str], tuple[np.ndarray, float, list[str]]], seconds: float, session: str = "") -> DataFrame:
    """Blocks of files in any format; extract gives samples by channels in microvolts, the sample rate and the channels' names."""
    if not paths:
        raise ValueError("no file to read")
    rows = spark.createDataFrame([(session, i, p) for i, p in enumerate(sorted(paths))], "session string, file_idx int, path string")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, rate, channels = extract(row["path"])
                step = max(round(rate * seconds), 1)
                for block, lo in enumerate(range(0, len(x), step)):
                    yield _rows(row | {"f_s": float(rate), "channels": list(channels)}, block, lo, np.asarray(x[lo : lo + step]).T)

    return rows.repartition(len(paths)).mapInArrow(run, SIGNALS)


def load_recording(spark: SparkSession, folder: str, mode: str = "bin", seconds: float = 4.0, truncate: int | bool = False, extract=None, pattern: str = "*") -> DataFrame:
    """Blocks of a folder's recording. bin: column-major files; row: compressed row-major files; extract: by the callable, over files of pattern."""
    if mode == "extract":
        if extract is None:
            raise ValueError("mode extract needs a callable")
        paths = sorted(glob(os.path.join(escape(folder), pattern)))
        return read_extracted(spark, paths[: first_files(truncate) or None], extract, seconds, folder)
    if mode not in ("bin", "row"):
        raise ValueError(f"unknown mode {mode!r}")
    files = truncated(list_files(spark, folder), truncate)
    meta = read_metadata(spark, files)
    check_consistent(meta)
    return (read_column_major if mode == "bin" else read_row_major)(files, meta, seconds)


def session_folders(root: str, animal: str, mode: str = "concat", skip: list[str] = (), truncate: int | bool = False) -> list[str]:
    """Folders of an animal's sessions, sorted; nest: one level deeper; base: root itself; noday: exactly one. None at all is a ValueError."""
    if mode not in ("nest", "concat", "noday", "base"):
        raise ValueError(f"unknown mode {mode!r}")
    parts = {"nest": [f"*{escape(animal)}*", "*"], "base": []}.get(mode, [f"*{escape(animal)}*"])
    found = sorted(p for p in glob(os.path.join(escape(root), *parts)) if os.path.isdir(p))
    found = [p for p in found[: first_files(truncate) or None] if not any(s in p for s in skip)]
    if not found:
        raise ValueError(f"no folder of {animal!r} in {root!r}")
    if mode == "noday" and len(found) > 1:
        raise ValueError(f"{animal!r} is not unique: {found}")
    return found


def use_cache(cache: str, sources: list[str], policy: str = "auto") -> bool:
    """Whether to read the cache. auto: it is there and no source that exists is newer; always: it is there; force_regenerate and never: no; error: it must be there."""
    there = os.path.exists(cache)
    if policy == "error" and not there:
        raise FileNotFoundError(cache)
    if policy in ("always", "error"):
        return there
    if policy in ("force_regenerate", "never"):
        return False
    if policy != "auto":
        raise ValueError(f"unknown policy {policy!r}")
    return there and all(os.path.getmtime(s) <= os.path.getmtime(cache) for s in sources if os.path.exists(s))

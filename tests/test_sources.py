from __future__ import annotations

import gzip
import os

import numpy as np
import pytest

from voltaloom.sources import recordings as R
from voltaloom.sources import tables

HEAD = "Entity,BinColumn,Label,ProbeInfo,SampleRate,Units,Precision,LastEdit\n"


def _write(folder, stem, x, units="mV", rows=("LMot", "RMot", "LBar")):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{stem}_ColMajor.bin").write_bytes(x.astype("<f4").tobytes(order="F"))
    with gzip.open(folder / f"{stem}_RowMajor.npy.gz", "wb") as f:
        np.save(f, np.ascontiguousarray(x.astype("<f4")))
    (folder / f"{stem}_Meta.csv").write_text(HEAD + "".join(f"1,{i},C-{i},{c},100,{units},float32,2023-12-13T11:17:32\n" for i, c in enumerate(rows)), encoding="utf-8")


def _joined(df, channel, idx):
    rows = df.where(f"channel = '{channel}' and file_idx = {idx}").orderBy("block").collect()
    assert [r.start for r in rows] == [int(r.block) * 100 for r in rows]
    return np.concatenate([np.array(r.signal) for r in rows])


def test_both_layouts_give_the_samples(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(250, 3)), rng.normal(size=(100, 3))
    _write(tmp_path / "s", "Cage 2 A10-0", a)
    _write(tmp_path / "s", "Cage 2 A10-1", b)
    _write(tmp_path / "s", "Cage 2 A10-2", np.empty((0, 3)))
    for mode in ("bin", "row"):
        got = R.load_recording(spark, str(tmp_path), mode, seconds=1.0).cache()
        assert got.count() == 3 * (3 + 1)
        for i, x in enumerate((a, b)):
            for c, name in enumerate(("LMot", "RMot", "LBar")):
                np.testing.assert_allclose(_joined(got, name, i), 1e3 * x[:, c].astype("f4"), rtol=1e-5)
    files = R.list_files(spark, str(tmp_path))
    assert files.count() == 6
    d = R.file_durations(files, R.read_metadata(spark, files)).orderBy("file_idx").collect()
    assert [(r.samples, r.duration, r.cum) for r in d] == [(250, 2.5, 2.5), (100, 1.0, 3.5)]
    assert R.load_recording(spark, str(tmp_path), "bin", 1.0, truncate=1).select("file_idx").distinct().collect()[0][0] == 0


def test_metadata_errors(spark, tmp_path):
    x = np.zeros((10, 3))
    _write(tmp_path / "mixed", "a-0", x)
    _write(tmp_path / "mixed", "a-1", x, units="V")
    with pytest.raises(ValueError, match="differ"):
        R.load_recording(spark, str(tmp_path / "mixed"))
    _write(tmp_path / "void", "a-0", x, rows=())
    with pytest.raises(ValueError, match="without rows"):
        R.load_recording(spark, str(tmp_path / "void"))
    with pytest.raises(ValueError, match="mode"):
        R.load_recording(spark, str(tmp_path), "none")


def test_callable_source(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(30.0).reshape(15, 2))
    got = R.load_recording(spark, str(tmp_path), "extract", 1.0, extract=lambda p: (np.load(p), 10.0, ["L", "R"]), pattern="*.npy")
    assert [(r.block, r.start, list(r.signal)) for r in got.where("channel = 'R'").orderBy("block").collect()] == [(0, 0, list(range(1, 21, 2))), (1, 10, list(range(21, 31, 2)))]


def test_session_folders_and_cache(tmp_path):
    for d in ("WT_A1_2023-01-01", "WT_A1_2023-01-02", "nest_A1_data/WT_2023-01-01"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "A1.edf").write_text("")
    root = str(tmp_path)
    assert len(R.session_folders(root, "A1")) == 3
    assert [os.path.basename(p) for p in R.session_folders(root, "A1", "nest")] == ["WT_2023-01-01"]
    assert [os.path.basename(p) for p in R.session_folders(root, "WT_A1", skip=["01-02"])] == ["WT_A1_2023-01-01"]
    for args in (("A1", "noday"), ("A9",), ("A1", "else")):
        with pytest.raises(ValueError):
            R.session_folders(root, *args)
    source, cache = tmp_path / "A1.edf", tmp_path / "c"
    assert not R.use_cache(str(cache), [str(source)]) and not R.use_cache(str(cache), [], "always")
    with pytest.raises(FileNotFoundError):
        R.use_cache(str(cache), [], "error")
    cache.write_text("")
    os.utime(source, (1, 1))
    assert R.use_cache(str(cache), [str(source), root + "/absent"]) and not R.use_cache(str(cache), [], "never")
    os.utime(cache, (0, 0))
    assert not R.use_cache(str(cache), [str(source)]) and R.use_cache(str(cache), [str(source)], "always")


def test_window_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "animalday string, rms double")
    tables.save_windows(df, f"{tmp_path}/w", {"animal": "A1"})
    back, info = tables.load_windows(spark, f"{tmp_path}/w")
    assert sorted((r.animalday, r.rms) for r in back.collect()) == [("a", 1.0), ("b", 2.0)] and info == {"animal": "A1"}

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_sources import _write
from voltaloom.sources import datasource as DS
from voltaloom.sources import recordings as R


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, root = np.random.default_rng(3), tmp_path_factory.mktemp("raw")
    for s in ("one", "two"):
        for i, n in enumerate((250, 100)):
            _write(root / s, f"x-{i}", rng.normal(size=(n, 3)))
            os.remove(root / s / f"x-{i}_RowMajor.npy.gz")
    _write(root / "two", "x-7", np.empty((0, 3)))
    return str(root)


def rows(df):
    return sorted((os.path.basename(r.session), r.file_idx, r.block, r.start, r.f_s, r.channel, tuple(r.signal)) for r in df.collect())


def test_blocks_are_those_of_the_plan(spark, folder):
    assert rows(DS.read_blocks(spark, folder, 1.0)) == rows(R.load_recording(spark, folder, "bin", 1.0))


def test_only_what_is_asked_for_is_read(spark, folder):
    df = DS.read_blocks(spark, folder, 1.0)
    some = DS.read_blocks(spark, folder, 1.0, file_idx=[0, 5], channel=["RMot"])
    assert rows(some) == [r for r in rows(df) if r[5] == "RMot" and r[1] == 0] and (some.rdd.getNumPartitions(), df.rdd.getNumPartitions()) == (6, 8)
    one = sorted({r.session for r in df.select("session").collect()})[0]
    assert rows(DS.read_blocks(spark, folder, 1.0, session=[one])) == rows(df.where(F.col("session") == one))
    assert DS.read_blocks(spark, folder, channel=["none"]).count() == 0
    assert df.where("file_idx = 1").count() == 6 and df.count() == 24  # one query's filter is not the next one's


def test_round_trip_and_skipping(spark, folder, tmp_path):
    out, signals = str(tmp_path / "row"), DS.read_blocks(spark, folder, 1.0)
    assert DS.transcode(signals, out) == DS.written_names(out) == ["one/one-0", "one/one-1", "two/two-0", "two/two-1"]
    again = R.load_recording(spark, out, "row", 1.0)
    order = {c: k for k, c in enumerate(sorted(("LMot", "RMot", "LBar")))}
    assert [r[:6] for r in rows(again)] == [r[:6] for r in rows(signals)] and len(order) == 3
    for a, b in zip(rows(again), rows(signals), strict=True):
        np.testing.assert_allclose(a[6], b[6], rtol=1e-6)
    before = os.stat(f"{out}/one/one-0_RowMajor.npy.gz").st_mtime_ns
    assert DS.transcode(signals, out) == [] and os.stat(f"{out}/one/one-0_RowMajor.npy.gz").st_mtime_ns == before
    os.remove(f"{out}/two/two-1_RowMajor.npy.gz")
    assert DS.transcode(signals, out) == ["two/two-1"]
    assert len(DS.transcode(signals, out, overwrite=True)) == 4 and os.stat(f"{out}/one/one-0_RowMajor.npy.gz").st_mtime_ns != before


def test_a_writer_that_fails_leaves_nothing_visible(spark, folder, tmp_path):
    out = str(tmp_path / "row")
    signals = DS.read_blocks(spark, folder, 1.0)
    late = F.when((F.col("file_idx") == 1) & (F.col("channel") == "RMot"), F.raise_error(F.lit("killed")).cast("array<float>")).otherwise(F.col("signal"))
    broken = signals.withColumn("n", F.size("signal")).withColumn("_s", F.col("signal"))
    broken = broken.withColumn("signal", F.when(F.rand(1) < 2, late)).drop("n", "_s")
    with pytest.raises(Exception, match="killed"):
        DS.transcode(broken, out)
    assert DS.written_names(out) == [] and not [f for _, _, fs in os.walk(out) for f in fs]
    assert DS.transcode(signals, out) == ["one/one-0", "one/one-1", "two/two-0", "two/two-1"]


def test_errors(spark, folder, tmp_path):
    signals = DS.read_blocks(spark, folder, 1.0)
    with pytest.raises(ValueError, match="incomplete"):
        DS.transcode(signals.where("channel <> 'RMot' or block <> 0"), str(tmp_path / "a"))
    with pytest.raises(ValueError, match="several sessions"):
        DS.transcode(signals.withColumn("session", F.concat(F.lit("/"), F.substring("session", -3, 3), F.lit("/same"))), str(tmp_path / "b"))
    os.makedirs(tmp_path / "bare")
    np.zeros(30, "<f4").tofile(tmp_path / "bare" / "x-0_ColMajor.bin")
    with pytest.raises(Exception, match="no metadata"):
        DS.read_blocks(spark, str(tmp_path / "bare")).count()

"""Recordings made ready for spike sorters, by blocks: notch, common reference, scale, whitening, Bessel filter.

Filters carry their states from block to block; the reference and whitening take all channels of one block together, and a session's covariance is the sum of its blocks'.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaloom.functions import kernels as K
from voltaloom.operators.blocked_spikes import KEYS, LEAST_SAMPLES, rechunk, zero_phase_blocks
from voltaloom.staging import written

_SHAPE = "animalday string, channel string, block long, start long, total long, last long, x array<double>"


def _together(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows by channel and their samples (channels by samples); channels of one block that differ in length are an error."""
    pdf = pdf.sort_values("channel")
    lengths = pdf.x.map(len)
    if lengths.nunique() > 1:
        raise ValueError(f"channels of {pdf.animalday.iloc[0]} differ in length: {dict(zip(pdf.channel, lengths, strict=True))}")
    return pdf, np.stack([np.asarray(v) for v in pdf.x])


def common_reference(blocks: DataFrame, scale: float = 1.0) -> DataFrame:
    """Blocks less the median over a session's channels at each sample, times scale. A task holds one block of a session's channels."""

    def less(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x = _together(pdf)
        return pdf.assign(x=list((x - np.median(x, axis=0)) * scale))

    return blocks.groupBy("animalday", "block").applyInPandas(less, _SHAPE)


def covariances(blocks: DataFrame) -> DataFrame:
    """animalday, a, b, cov: mean product of each pair of a session's channels, from sums over blocks; samples have no mean after a filter."""

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x = _together(pdf)
        names, p = pdf.channel.to_numpy(), x @ x.T
        i, j = np.indices(p.shape).reshape(2, -1)
        return pd.DataFrame({"animalday": pdf.animalday.iloc[0], "a": names[i], "b": names[j], "s": p.ravel(), "n": x.shape[1]})

    sums = blocks.groupBy("animalday", "block").applyInPandas(products, "animalday string, a string, b string, s double, n long")
    return sums.groupBy("animalday", "a", "b").agg((F.sum("s") / F.sum("n")).alias("cov"))


def whitening(cov: DataFrame, least: float = 1e-8) -> DataFrame:
    """animalday, channels, matrix (row by row): the symmetric root of the inverse covariance of a session, tens of channels; `least` of the greatest eigenvalue bounds the others from below."""

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a", columns="b", values="cov").sort_index().sort_index(axis=1)
        values, vectors = np.linalg.eigh(m.to_numpy())
        w = vectors / np.sqrt(np.maximum(values, least * max(values.max(), 1e-300))) @ vectors.T
        return pd.DataFrame({"animalday": [pdf.animalday.iloc[0]], "channels": [list(m.index)], "matrix": [w.ravel()]})

    return cov.groupBy("animalday").applyInPandas(invert, "animalday string, channels array<string>, matrix array<double>")


def whitened(blocks: DataFrame) -> DataFrame:
    """Blocks whose channels are uncorrelated, of unit power over the session; channels that are combinations of others have less."""

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x = _together(pdf)
        return pdf.drop(columns=["channels", "matrix"]).assign(x=list(np.asarray(pdf.matrix.iloc[0]).reshape(len(x), len(x)) @ x))

    return blocks.join(whitening(covariances(blocks)), "animalday").groupBy("animalday", "block").applyInPandas(turn, _SHAPE)


def prepare(
    signals: DataFrame, fs: float, step: int = 60_000, notch_hz: float | None = None, common_ref: bool = True, scale: float | None = None, whiten: bool = True,
    freq_min: float | None = None, freq_max: float | None = None, order: int = 5,
) -> DataFrame:
    """Blocks (animalday, channel, block, start, total, last, x) of pieces (animalday, channel, start, signal), after the steps asked for, in the order of the arguments.

    freq_min alone is a high-pass; freq_max alone a band-pass from 0.1 Hz. Channels of fewer than LEAST_SAMPLES samples are left out.
    """
    blocks = written(rechunk(signals, step).where(F.col("total") >= LEAST_SAMPLES), "sorting-blocks")
    if notch_hz:
        blocks = zero_phase_blocks(blocks, *K.notch_sections(fs, notch_hz, 100.0))
    if common_ref:
        blocks = common_reference(blocks, scale or 1.0)
    elif scale:
        blocks = blocks.withColumn("x", F.transform("x", lambda v: v * F.lit(float(scale))))
    blocks = written(blocks, "referenced")
    if whiten:
        blocks = written(whitened(blocks), "whitened")
    if freq_min or freq_max:
        blocks = zero_phase_blocks(blocks, *K.bessel_sections(order, fs, freq_min or 0.1, freq_max))
    return blocks.select(*KEYS, "block", "start", "total", "last", "x")

"""Spike detection on recordings of any length, a block a task: the same spikes as detection on whole channels.

Filters run over blocks from rest; a cascade's state moves over a block of silence by a fixed matrix, so the states between blocks come from a scan over one short
row a block, and a second pass puts them in, forward and then backward. Thresholds are exact order statistics, found by four rounds of counting
16 bits of the values at a time. Windows that reach over a block's ends get the samples beside it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaloom.functions import kernels as K
from voltaloom.operators import spikes as S
from voltaloom.staging import written

KEYS = ["animalday", "channel"]
BLOCK = [*KEYS, "block"]
_ID = "animalday string, channel string, block long"
#: Channels of fewer samples have no spikes.
LEAST_SAMPLES = 101
#: Blocks that a worker holds at once beside the Arrow batch they came in (64 MB by default), whatever the number of blocks.
AT_ONCE = 8


def _few(run):
    """run over AT_ONCE rows at a time: what it makes of blocks is some times their size, so it is not made for whole batches."""

    def sliced(batches):
        yield from run(pdf.iloc[lo : lo + AT_ONCE] for pdf in batches for lo in range(0, len(pdf), AT_ONCE))

    return sliced


def _end(block: Column, last: Column, total: Column, step: int) -> Column:
    return F.when(block >= last, total).otherwise((block + 1) * step)


def rechunk(signals: DataFrame, step: int) -> DataFrame:
    """(animalday, channel, block, start, total, last, x): blocks of step samples from pieces (animalday, channel, start, signal) of any lengths.

    Pieces of a channel follow one another without gaps. The last block takes up what would be shorter than a block, so it has up to twice as many samples.
    """
    n = F.size("signal")
    pieces = signals.where(n > 0).select(F.col("animalday").cast("string").alias("animalday"), F.col("channel").cast("string").alias("channel"), F.col("start").cast("long").alias("start"), F.col("signal").cast("array<double>").alias("signal"))
    totals = pieces.groupBy(*KEYS).agg(F.max(F.col("start") + n).alias("total"), F.sum(n).alias("_given"))
    totals = totals.withColumn("total", F.when(F.col("total") == F.col("_given"), F.col("total")).otherwise(F.raise_error(F.lit("pieces of a channel overlap or leave gaps")).cast("long"))).drop("_given")
    p = pieces.join(totals, KEYS).withColumn("last", F.greatest(F.floor(F.col("total") / step) - 1, F.lit(0)))
    at = lambda place: F.least(F.floor(place / step), F.col("last"))
    p = p.withColumn("block", F.explode(F.sequence(at(F.col("start")), at(F.col("start") + n - 1))))
    lo = F.greatest(F.col("block") * step, F.col("start"))
    hi = F.least(_end(F.col("block"), F.col("last"), F.col("total"), step), F.col("start") + n)
    part = F.struct(lo.alias("at"), F.slice("signal", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("x"))
    grouped = p.groupBy(*BLOCK).agg(F.first("total").alias("total"), F.first("last").alias("last"), F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select(*BLOCK, (F.col("block") * step).alias("start"), "total", "last", F.flatten(F.transform("parts", lambda q: q["x"])).alias("x"))


def with_halo(blocks: DataFrame, step: int, halo: int) -> DataFrame:
    """blocks whose x begins up to halo samples earlier, at lo, and ends as much later; n is the number of their own samples."""
    n = F.size("x")
    at = lambda place: F.greatest(F.least(F.floor(place / step), F.col("last")), F.lit(0))
    p = blocks.withColumn("to", F.explode(F.sequence(at(F.col("start") - halo), at(F.col("start") + n - 1 + halo))))
    lo = F.greatest(F.col("to") * step - halo, F.col("start"))
    hi = F.least(_end(F.col("to"), F.col("last"), F.col("total"), step) + halo, F.col("start") + n)
    p = p.withColumn("part", F.struct(lo.alias("at"), F.slice("x", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("x"))).where(hi > lo)
    grouped = p.groupBy(*KEYS, F.col("to").alias("block")).agg(F.first("total").alias("total"), F.first("last").alias("last"), F.array_sort(F.collect_list("part")).alias("parts"))
    start = F.col("block") * step
    return grouped.select(*BLOCK, start.alias("start"), (_end(F.col("block"), F.col("last"), F.col("total"), step) - start).alias("n"), "total", "last", F.get("parts", F.lit(0))["at"].alias("lo"), F.flatten(F.transform("parts", lambda q: q["x"])).alias("x"))


def _carried(states: DataFrame, sections: np.ndarray, backward: bool) -> DataFrame:
    """(block keys, init): the state that each block begins with, from rows (block keys, n, r) of what a block leaves when it begins at rest.

    The block at the beginning knows its own first state and leaves its true last one.
    """

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ascending=not backward)
        moves: dict[int, np.ndarray] = {}
        state, out = None, []
        for n, r in zip(pdf.n, pdf.r, strict=True):
            out.append(state)
            if state is None:
                state = np.asarray(r)
            else:
                if n not in moves:
                    moves[n] = K.cascade_move(sections, int(n))
                state = moves[n] @ state + np.asarray(r)
        return pdf[BLOCK].assign(init=out)

    return states.groupBy(*KEYS).applyInPandas(scan, f"{_ID}, init array<double>")


def zero_phase_blocks(blocks: DataFrame, sections: np.ndarray, pad: int) -> DataFrame:
    """Blocks filtered forward and backward, with odd extension of pad samples at both ends of a channel; a block has more than pad samples."""
    rest = np.zeros((len(sections), 2))

    def forward_start(x: np.ndarray) -> np.ndarray:
        ext = 2 * x[0] - x[pad:0:-1]
        return K.run_cascade(sections, ext, K.cascade_steady(sections, ext[0]))[1]

    def leave(batches):
        for pdf in batches:
            r = [K.run_cascade(sections, x, forward_start(x) if b == 0 else rest)[1].ravel() for b, x in zip(pdf.block, map(np.asarray, pdf.x), strict=True)]
            yield pdf[BLOCK].assign(n=pdf.x.map(len), r=r)

    def forward(batches):
        for pdf in batches:
            ys, rs, begins = [], [], []
            for b, last, x, init in zip(pdf.block, pdf["last"], map(np.asarray, pdf.x), pdf.init, strict=True):
                y, end = K.run_cascade(sections, x, forward_start(x) if b == 0 else np.asarray(init).reshape(-1, 2))
                begin = None
                if b == last:
                    tail, _ = K.run_cascade(sections, 2 * x[-1] - x[-2 : -pad - 2 : -1], end)
                    begin = K.run_cascade(sections, tail[::-1], K.cascade_steady(sections, tail[-1]))[1]
                ys.append(y)
                rs.append(K.run_cascade(sections, y[::-1], rest if begin is None else begin)[1].ravel())
                begins.append(None if begin is None else begin.ravel())
            yield pdf.drop(columns=["init"]).assign(x=ys, r=rs, begin=begins)

    def backward(batches):
        for pdf in batches:
            out = [K.run_cascade(sections, x[::-1], np.asarray(begin if begin is not None else init).reshape(-1, 2))[0][::-1] for x, begin, init in zip(map(np.asarray, pdf.x), pdf.begin, pdf.init, strict=True)]
            yield pdf.drop(columns=["r", "begin", "init"]).assign(x=out)

    shape = f"{_ID}, start long, total long, last long, x array<double>"
    left = blocks.mapInPandas(_few(leave), f"{_ID}, n long, r array<double>")
    onward = blocks.join(_carried(left, sections, False), BLOCK).mapInPandas(_few(forward), f"{shape}, r array<double>, begin array<double>")
    onward = written(onward, "filter-forward")
    back = _carried(onward.select(*BLOCK, F.size("x").cast("long").alias("n"), "r"), sections, True)
    return written(onward.join(back, BLOCK).mapInPandas(_few(backward), shape), "filter-backward")


def _sortable(x: np.ndarray) -> np.ndarray:
    """Bits of doubles as unsigned numbers in the order of the doubles."""
    bits = np.ascontiguousarray(x, np.float64).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _double(bits: np.ndarray) -> np.ndarray:
    return np.where(bits >> np.uint64(63), bits & np.uint64((1 << 63) - 1), ~bits).astype(np.uint64).view(np.float64)


def order_statistics(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(animalday, channel, value array): for each of wanted's (animalday, channel, line array, rank array) the exact value of that rank, from 0, among all of
    the channel's values in that line of blocks' e (array of lines).

    Four rounds count the values' bits, 16 at a time, within what is still possible; only counts are shuffled, 65,536 rows a rank at most.
    """
    state = wanted.select(*KEYS, "line", F.col("rank").alias("left"), F.transform("rank", lambda r: F.lit(0).cast("long")).alias("prefix"))
    for turn in range(4):

        def count(batches, turn=turn):
            for pdf in batches:
                out = []
                for day, channel, e, line, prefix in zip(*(pdf[c] for c in (*KEYS, "e", "line", "prefix")), strict=True):
                    lines = [_sortable(np.asarray(x)) for x in e]
                    for j, (i, p) in enumerate(zip(line, prefix, strict=True)):
                        u = lines[i]
                        if turn:
                            u = u[u >> np.uint64(64 - 16 * turn) == np.uint64(int(p) & (1 << 64) - 1)]
                        digit, n = np.unique((u >> np.uint64(48 - 16 * turn)) & np.uint64(0xFFFF), return_counts=True)
                        out.append(pd.DataFrame({"animalday": day, "channel": channel, "j": j, "digit": digit.astype(np.int64), "n": n}))
                yield pd.concat(out) if out else pd.DataFrame({"animalday": [], "channel": [], "j": [], "digit": [], "n": []})

        counts = blocks.select(*KEYS, "e").join(state, KEYS).mapInPandas(_few(count), "animalday string, channel string, j int, digit long, n long")
        w = Window.partitionBy(*KEYS, "j").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        below = counts.groupBy(*KEYS, "j", "digit").agg(F.sum("n").alias("n")).withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
        each = below.join(state, KEYS).withColumn("at", F.get("left", F.col("j"))).where("below <= at and at < below + n")
        pick = F.struct("j", (F.col("at") - F.col("below")).alias("left"), F.shiftleft(F.get("prefix", F.col("j")), 16).bitwiseOR(F.col("digit")).alias("prefix"))
        after = each.groupBy(*KEYS).agg(F.first("line").alias("line"), F.array_sort(F.collect_list(pick)).alias("p"))
        state = written(after.select(*KEYS, "line", F.transform("p", lambda x: x["left"]).alias("left"), F.transform("p", lambda x: x["prefix"]).alias("prefix")), "order-statistics")

    def decode(batches):
        for pdf in batches:
            yield pdf[KEYS].assign(value=[_double(np.asarray(p, np.int64).view(np.uint64)) for p in pdf.prefix])

    return state.mapInPandas(decode, "animalday string, channel string, value array<double>")


def _energies(x: np.ndarray, lo: int, start: int, n: int, total: int, fs: float, hz: list[float], segment_s: float) -> list[np.ndarray]:
    """Smoothed energies of a block's inner samples, as sneo(stft_power(...)) gives them for the whole channel, from x that begins at sample lo."""
    size = int(round(fs * segment_s))
    step, half = size - size // 2, size // 2
    segments = -(-(total + 2 * half - size) // step) + 1
    a, b = max(0, start - 4), min(total, start + n + 4)
    first, last = a // step, min(segments - 1, -(-b // step))
    begin, end = first * step - half, last * step - half + size
    have = np.zeros(end - begin)
    lo_, hi_ = max(begin, lo), min(end, lo + len(x))
    have[lo_ - begin : hi_ - begin] = x[lo_ - lo : hi_ - lo]
    w = K.hann(size)
    s = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(have, size)[::step] * w, axis=-1) / w.sum()) ** 2
    f, at = np.fft.rfftfreq(size, 1 / fs), np.arange(first, last + 1) * step
    out = []
    for h in hz:
        p = np.interp(np.arange(a, b), at, s[:, np.argmin(np.abs(f - h))])
        e = p[1:-1] ** 2 - p[2:] * p[:-2]  # of samples a + 1 to b - 2
        if total - 2 >= 5:
            e = np.convolve(np.pad(e, 2), np.bartlett(5), "valid")
        begin, end = max(1, start), min(total - 1, start + n)
        out.append(e[begin - a - 1 : end - a - 1])
    return out


def _smooth(x: np.ndarray, lo: int, left: int, right: int, a: int, b: int, k: int) -> np.ndarray:
    """Means of k neighbours of samples a to b - 1 within [left, right), whose outer samples stand for those beyond; x begins at sample lo."""
    p, q = max(left, a - k // 2), min(right, b + k // 2)
    part = np.pad(x[p - lo : q - lo], (k // 2 - (a - p), k // 2 - (q - b)), mode="edge")
    return np.convolve(part, np.ones(k) / k, "valid")


def filtered_blocks(signals: DataFrame, fs: float, step: int, band: tuple[float, float] = (3.0, 40.0)) -> DataFrame:
    """Band-passed and notched blocks of channels of LEAST_SAMPLES samples or more."""
    blocks = written(rechunk(signals, step).where(F.col("total") >= LEAST_SAMPLES), "blocks")
    for sections, pad in (K.band_sections(fs, *band, order=4), K.notch_sections(fs)):
        blocks = zero_phase_blocks(blocks, sections, pad)
    return blocks


def detect(
    signals: DataFrame, fs: float, step: int = 60_000, band=(3.0, 40.0), hz=(10.0, 20.0), percentile: float = 99.99, vote: int = 2, search_ms: float = 160,
    baseline_ms: float = 500, k_mad: float = 3.0, min_gap_ms: float = 200, cluster_ms: float = 60, segment_s: float = 0.125,
) -> DataFrame:
    """Spikes (animalday, channel, sample_idx, t_s) of pieces (animalday, channel, start, signal) of channels, found as kernels.detect_spikes finds them.

    step: samples of a block, more than the filters' extension (LEAST_SAMPLES is enough). Channels of fewer than LEAST_SAMPLES samples have no spikes; pieces that
    overlap or leave gaps are an error. An empty table gives no rows.
    """
    if step < LEAST_SAMPLES:
        raise ValueError(f"blocks of {step} samples; at least {LEAST_SAMPLES} are needed")
    hz, half, base = list(hz), int(search_ms * fs / 2000), int(baseline_ms * fs / 2000)
    gap, wide = int(min_gap_ms * fs / 1000), int(cluster_ms * fs / 2000)
    halo = max(2 * int(round(fs * segment_s)) + 8, half + base + 8)
    y = with_halo(filtered_blocks(signals, fs, step, band), step, halo)

    def energies(batches):
        for pdf in batches:
            yield pdf.assign(e=[_energies(np.asarray(r.x), r.lo, r.start, r.n, r.total, fs, hz, segment_s) for r in pdf.itertuples()])

    kept = f"{_ID}, start long, n long, total long, last long, lo long, x array<double>"
    y = written(y.mapInPandas(_few(energies), f"{kept}, e array<array<double>>"), "energies")
    inner = F.first("total") - 3  # the greatest rank of the inner samples
    place = inner * F.lit(percentile / 100)
    ranks = y.groupBy(*KEYS).agg(place.alias("place"), inner.alias("most"))
    lines = F.lit([i for i in range(len(hz)) for _ in (0, 1)])
    two = F.array(F.floor("place"), F.least(F.floor("place") + 1, F.col("most")))
    asked = ranks.select(*KEYS, "place", lines.alias("line"), F.flatten(F.array_repeat(two, len(hz))).alias("rank"))
    limits = order_statistics(y, asked.drop("place")).join(asked.select(*KEYS, "place"), KEYS)

    def refine(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x, v, g = np.asarray(r.x), np.asarray(r.value), r.place - np.floor(r.place)
                low, high = v[::2], v[1::2]
                limit = high - (high - low) * (1 - g) if g >= 0.5 else low + (high - low) * g
                votes = sum((np.asarray(e) > t).astype(int) for e, t in zip(r.e, limit, strict=True))
                found = set()
                for c in np.nonzero(votes >= min(vote, len(hz)))[0] + max(1, r.start):
                    left, right = max(0, c - half), min(r.total, c + half + 1)
                    at = left + int(np.argmin(_smooth(x, r.lo, left, right, left, right, 7)))
                    y_ = lambda p, q: x[p - r.lo : q - r.lo]
                    around = np.concatenate([y_(max(0, at - base), max(left, at - base, 0)), y_(right, max(right, min(r.total, at + base + 1)))])
                    if len(around) < 10:
                        continue
                    mid = np.median(around)
                    slope = np.sign(np.diff(y_(max(0, at - 3), min(r.total, at + 4))))
                    turns = np.any((slope[:-1] < 0) & (slope[1:] >= 0))
                    if x[at - r.lo] <= mid - k_mad * 1.4826 * (np.median(np.abs(around - mid)) + 1e-12) and turns:
                        found.add(at)
                out += [(r.animalday, r.channel, int(at), r.total, r.last) for at in found]
            yield pd.DataFrame(out, columns=[*KEYS, "at", "total", "last"]).astype({"at": "int64", "total": "int64", "last": "int64"})

    found = y.join(limits, KEYS).mapInPandas(_few(refine), "animalday string, channel string, at long, total long, last long").distinct()
    groups = S.clusters(found, KEYS, "at", gap).groupBy(*KEYS, "cluster").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.first("total").alias("all"), F.first("last").alias("end"))
    groups = groups.select(*KEYS, "cluster", F.greatest(F.col("a") - wide, F.lit(0)).alias("left"), F.least(F.col("b") + wide + 1, "all").alias("right"), "end")
    at = lambda p: F.least(F.floor(p / step), F.col("end"))
    parts = groups.withColumn("block", F.explode(F.sequence(at(F.col("left")), at(F.col("right") - 1)))).drop("end")

    def lowest(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a, b = max(r.left, r.start), min(r.right, r.start + r.n)
                s = _smooth(np.asarray(r.x), r.lo, r.left, r.right, a, b, 5)
                out.append((r.animalday, r.channel, r.cluster, float(s.min()), a + int(np.argmin(s))))
            yield pd.DataFrame(out, columns=[*KEYS, "cluster", "low", "at"]).astype({"cluster": "int64", "low": "float64", "at": "int64"})

    best = y.drop("e").join(parts, BLOCK).mapInPandas(_few(lowest), "animalday string, channel string, cluster long, low double, at long")
    spikes = best.groupBy(*KEYS, "cluster").agg(F.min(F.struct("low", "at"))["at"].alias("sample_idx"))
    return spikes.select(*KEYS, "sample_idx", (F.col("sample_idx") / F.lit(float(fs))).alias("t_s"))


def averages(spikes: DataFrame, signals: DataFrame, half: int, step: int = 60_000) -> DataFrame:
    """animalday, channel, lag, mean, n: mean of the n samples that stand lag samples from a spike (animalday, channel, sample_idx), up to half before and after.

    signals are pieces as in detect. Each spike meets the one block that holds it, with the samples beside it; a slice of the block's array gives its lags, and
    lags are averaged in a partial aggregate. Lags beyond a channel's ends have no sample.
    """
    blocks = with_halo(written(rechunk(signals, step), "blocks"), step, half)
    last = blocks.select(*KEYS, "last").distinct()
    at = spikes.select(*(F.col(k).cast("string").alias(k) for k in KEYS), F.col("sample_idx").alias("at")).join(last, KEYS)
    at = at.withColumn("block", F.least(F.floor(F.col("at") / step), F.col("last"))).drop("last")
    first = F.greatest(F.col("at") - half, F.col("lo"))
    near = at.join(blocks, BLOCK).where("at >= start and at < start + n")
    piece = F.slice("x", (first - F.col("lo") + 1).cast("int"), (F.col("at") + half + 1 - first).cast("int"))
    lags = near.select(*KEYS, (first - F.col("at")).alias("from"), F.posexplode(piece).alias("place", "value"))
    return lags.groupBy(*KEYS, (F.col("from") + F.col("place")).cast("int").alias("lag")).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))

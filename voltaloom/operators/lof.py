"""Local outlier factor of a session's channels, thresholds and their evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaloom.functions import kernels
from voltaloom.operators import neighbours
from voltaloom.staging import written


def distances(traces: DataFrame, decimation: int = 10, block: int = 100_000, half_precision: bool = False) -> DataFrame:
    """animalday, a, b, d: distance of each pair (and of each channel with itself, 0) of a session's channels (animalday, channel, signal array), from sums of squares over blocks of samples.

    Signals are cut into blocks first, so a task holds one block of a session's channels, never whole signals of all of them. The channels
    of a session are decimated alike, block by block: beyond block * decimation samples the filter starts anew. half_precision rounds samples to 16 bits first, which
    makes those beyond 65,504 infinite. Channels of a session that differ in length are an error.
    """
    step = block * max(1, decimation)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("signal") / step).cast("int") - 1)), lambda k: F.struct(k.alias("k"), F.slice("signal", k * step + 1, step).alias("x")))
    blocks = traces.where("signal is not null").select("animalday", "channel", F.explode(cut).alias("s")).select("animalday", "channel", "s.k", "s.x")

    def run(pdf):
        names = pdf.channel.to_numpy()
        lengths = pdf.x.map(len)
        if lengths.nunique() > 1:
            raise ValueError(f"channels of {pdf.animalday.iloc[0]} differ in length: {dict(zip(names, lengths, strict=True))} samples of a block")
        x = np.stack(pdf.x.to_numpy()).astype(float)
        x = x.astype(np.float16).astype(float) if half_precision else x
        x = kernels.decimate(x, decimation) if decimation > 1 and x.shape[1] > 100 else x
        i, j = np.triu_indices(len(names))
        ss = np.concatenate([((x[a] - x[a:]) ** 2).sum(1) for a in range(len(names))])
        return type(pdf)({"animalday": pdf.animalday.iloc[0], "a": names[i], "b": names[j], "ss": ss})

    sums = blocks.groupBy("animalday", "k").applyInPandas(run, "animalday string, a string, b string, ss double")
    return sums.groupBy("animalday", "a", "b").agg(F.sqrt(F.sum("ss")).alias("d"))


def channel_scores(traces: DataFrame, decimation: int = 10, block: int = 100_000, half_precision: bool = False) -> DataFrame:
    """lof of each channel (animalday, channel, signal array) among its session's; k by natural neighbours. A session has tens of channels."""

    def run(pdf):
        names = sorted(set(pdf.a) | set(pdf.b))
        at = {c: k for k, c in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        i, j = pdf.a.map(at).to_numpy(), pdf.b.map(at).to_numpy()
        d[i, j] = d[j, i] = pdf.d.to_numpy()
        k = kernels.natural_neighbours(d)
        return type(pdf)({"animalday": [pdf.animalday.iloc[0]] * len(names), "channel": names, "lof": kernels.local_outlier_factor(d, k), "k": k})

    return distances(traces, decimation, block, half_precision).groupBy("animalday").applyInPandas(run, "animalday string, channel string, lof double, k long")


def scores_sql(vectors: DataFrame, group: str, item: str, vector: str, k: int) -> DataFrame:
    """lof of vectors within groups for a fixed k; ties of distance go to the smaller item. Groups can be of any size."""
    near = written(neighbours.nearest(vectors, group, item, vector, k), "near").select(group, F.col(item).alias("a"), F.col("neighbour").alias("b"), "d")
    kd = near.groupBy(group, F.col("a").alias("b")).agg(F.max("d").alias("kd"))
    lrd = near.join(kd, [group, "b"]).groupBy(group, "a").agg((1 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("lrd"))
    around = near.join(lrd.select(group, F.col("a").alias("b"), F.col("lrd").alias("lrd_b")), [group, "b"]).groupBy(group, "a").agg(F.avg("lrd_b").alias("m"))
    return around.join(lrd, [group, "a"]).select(group, F.col("a").alias(item), (F.col("m") / F.col("lrd")).alias("lof"))


def bad(score: Column, threshold: float) -> Column:
    """Bad unless below the threshold: equal, missing and non-finite scores are bad."""
    return ~F.coalesce((score < threshold) & ~F.isnan(score), F.lit(False))


def evaluate(scores: DataFrame, truth: DataFrame | None, threshold: float, abbreviations: dict[str, str] | None = None, bad: DataFrame | None = None) -> DataFrame:
    """animalday, channel, lof, predicted (lof > threshold, NaN included; false without a score) and truth of each scored channel.

    truth lists bad channels (animalday, channel), by name or abbreviation; where it is not given, `bad` does. A listed session that has no scores is an error.
    """
    listed = (bad if truth is None else truth).select("animalday", "channel").distinct()
    known = scores.select("animalday").distinct().withColumn("_known", F.lit(True))
    checked = listed.join(known, "animalday", "left").withColumn("channel", F.when(F.col("_known"), F.col("channel")).otherwise(F.raise_error(F.lit("a listed session has no scores"))))
    short = F.col("channel") if not abbreviations else F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in sorted(abbreviations.items()) for x in p)), F.col("channel")), F.col("channel"))
    marked = checked.select("animalday", short.alias("_name")).distinct().withColumn("_bad", F.lit(True))
    named = scores.select("animalday", "channel", "lof", short.alias("_name")).join(marked, ["animalday", "_name"], "left")
    return named.select("animalday", "channel", "lof", F.coalesce(F.col("lof") > threshold, F.lit(False)).alias("predicted"), F.col("_bad").isNotNull().alias("truth"))


def score_lists(scores: DataFrame) -> DataFrame:
    """animalday, channels, lofs: a session's scores in order of its channels' names, tens of them; a missing score is null in the list."""
    each = F.array_sort(F.collect_list(F.struct("channel", "lof")))
    return scores.groupBy("animalday").agg(each.alias("_e")).select("animalday", F.transform("_e", lambda x: x["channel"]).alias("channels"), F.transform("_e", lambda x: x["lof"]).alias("lofs"))


def compare_manual(manual: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """animalday, channel, manual, scored, kind (both, manual, scored, neither): bad channels marked by hand against those whose score is bad; a marked channel without score counts by hand only."""
    by_hand = manual.select("animalday", "channel").distinct().withColumn("_m", F.lit(True))
    both = scores.select("animalday", "channel", bad(F.col("lof"), threshold).alias("scored")).join(by_hand, ["animalday", "channel"], "full")
    m, s = F.coalesce("_m", F.lit(False)), F.coalesce("scored", F.lit(False))
    kind = F.when(m & s, "both").when(m, "manual").when(s, "scored").otherwise("neither")
    return both.select("animalday", "channel", m.alias("manual"), s.alias("scored"), kind.alias("kind"))


def mean_scores(scores: DataFrame, animal: str, channel: str = "channel", lof: str = "lof") -> DataFrame:
    """Mean score and days of each animal's channel."""
    return scores.groupBy(animal, channel).agg(F.avg(lof).alias("mean_lof"), F.count(lof).alias("days"))


def sweep(df: DataFrame, score: str, truth: str, thresholds: list[float], order: str | None = None) -> DataFrame:
    """Confusion counts, precision, recall and f1 (prediction: score > threshold) of each threshold; the thresholds are a fixed short list.

    With an order of the rows, a threshold at which all predictions are equal has 1.0 for each metric if they equal the first row's truth, else 0.0.
    """
    t = df.select(score, truth).withColumn("threshold", F.explode(F.array(*(F.lit(float(x)) for x in thresholds))))
    p, y = F.col(score) > F.col("threshold"), F.col(truth) == 1
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    s = t.groupBy("threshold").agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"), n(~p & ~y).alias("tn"))
    s = s.withColumn("precision", F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)))
    s = s.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    if order is None:
        return s
    first = df.agg(F.min_by(y, F.col(order)).alias("_first"))  # one row
    one = (F.col("tp") + F.col("fp") == 0) | (F.col("fn") + F.col("tn") == 0)
    value = (F.col("_first") == (F.col("tp") + F.col("fp") > 0)).cast("double")
    return s.join(F.broadcast(first)).withColumns({m: F.when(one, value).otherwise(F.col(m)) for m in ("precision", "recall", "f1")}).drop("_first")


def best_threshold(swept: DataFrame) -> DataFrame:
    """The first threshold with the largest f1."""
    return swept.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))

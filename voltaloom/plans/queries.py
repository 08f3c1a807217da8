"""Queries over the driver's tables, each with its SQL.

events stand for a signal: animal = user_id, channel = event_type, one window a day; lineitem for windows with a duration (l_quantity) and a
feature (l_extendedprice); embeddings for one channel of 64 samples each, with label as the session.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltaloom import constants as C
from voltaloom.deploy import ship
from voltaloom.functions import kernels as K
from voltaloom.functions import names as N
from voltaloom.operators import aggregate as A
from voltaloom.operators import channels as CH
from voltaloom.operators import features as FE
from voltaloom.operators import lof as L
from voltaloom.operators import masks as M
from voltaloom.operators import reshape as R
from voltaloom.operators import spikes as S
from voltaloom.operators import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Vectors that are compared with as many others at once where all pairs are made.
PAIR_BLOCK = 512
#: Parts of a label, the least number of shares of the blocks, and about the most vectors of a share; each two shares are a task.
PAIR_PARTS, PAIR_SHARE = 8, 1 << 15


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


def daily(spark: SparkSession, d: str) -> DataFrame:
    """One window for each animal, day and channel: rms, ampvar, n, timestamp; partial aggregates, one shuffle."""
    e = table(spark, d, "events").select("user_id", "ts", "event_type", "value")
    return e.groupBy(F.col("user_id").alias("animal"), F.to_date("ts").alias("day"), F.col("event_type").alias("channel")).agg(
        F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.var_pop("value").alias("ampvar"), F.count("*").alias("n"), F.min("ts").alias("timestamp")
    )


DAILY = "daily AS (SELECT user_id AS animal, CAST(ts AS DATE) AS day, event_type AS channel, sqrt(avg(value * value)) AS rms, var_pop(value) AS ampvar, count(*) AS n, min(ts) AS timestamp FROM events GROUP BY ALL)"


@query(f"WITH {DAILY} SELECT animal, day, channel, round(rms, 6) AS rms, round(ampvar, 6) AS ampvar, round(ln(1 + rms), 6) AS logrms, round(ln(1 + ampvar), 6) AS logampvar FROM daily")
def q01_window_linear(spark, d):
    return daily(spark, d).select("animal", "day", "channel", r6("rms").alias("rms"), r6("ampvar").alias("ampvar"), r6(F.log1p("rms")).alias("logrms"), r6(F.log1p("ampvar")).alias("logampvar"))


@query("SELECT event_type AS channel, hour(ts) BETWEEN 6 AND 17 AS isday, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def q02_isday(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("channel"), W.is_day(F.col("ts")).alias("isday")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


ZT = "zt AS (SELECT user_id % 2 AS genotype, CAST(60 * (CAST(round_even((hour(ts) * 60 + minute(ts)) / 60.0::DOUBLE, 0) AS BIGINT) % 24) AS BIGINT) AS total_minutes, avg(value) AS mean FROM events GROUP BY ALL)"


def _zeitgeber(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 2).alias("genotype"), W.zeitgeber_minutes(F.col("ts")).alias("total_minutes")).agg(F.avg("value").alias("mean"))


@query(f"WITH {ZT} SELECT genotype, total_minutes, round(mean, 6) AS mean FROM zt")
def q03_zeitgeber(spark, d):
    return _zeitgeber(spark, d).withColumn("mean", r6("mean"))


@query(f"WITH {ZT}, s AS (SELECT genotype, (total_minutes - 360 + 1440) % 1440 AS total_minutes, mean FROM zt), b AS (SELECT *, mean - avg(CASE WHEN total_minutes <= 720 THEN mean END) OVER (PARTITION BY genotype) AS v FROM s) SELECT genotype, total_minutes, round(v, 6) AS v FROM b UNION ALL SELECT genotype, total_minutes + 1440, round(v, 6) FROM b")
def q04_zeitgeber_baseline(spark, d):
    z = W.zeitgeber_two_days(_zeitgeber(spark, d))
    base = F.avg(F.when(F.pmod("total_minutes", F.lit(1440)) <= 720, F.col("mean"))).over(Window.partitionBy("genotype"))
    return z.select("genotype", "total_minutes", r6(F.col("mean") - base).alias("v"))


@query("SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS minute, event_type, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def q05_time_of_day_map(spark, d):
    return W.time_of_day_map(table(spark, d, "events"), "ts", "value", ["event_type"]).withColumn("mean", r6("mean"))


ZKEEP = "coalesce(abs((ln(nullif(rms, 0)) - avg(ln(nullif(rms, 0))) OVER w) / nullif(stddev_pop(ln(nullif(rms, 0))) OVER w, 0)) <= 2.0, true)"


@query(f"WITH {DAILY} SELECT animal, day, channel, {ZKEEP} AS keep FROM daily WINDOW w AS (PARTITION BY animal, channel)")
def q06_mask_logrms_z(spark, d):
    return daily(spark, d).select("animal", "day", "channel", M.logrms_range(["animal", "channel"], z_range=2.0).alias("keep"))


@query(f"WITH {DAILY}, k AS (SELECT *, coalesce(rms <= 100, true) AND coalesce(rms >= 10, true) AS k FROM daily) SELECT animal, day, channel, k AND sum(CAST(k AS INT)) OVER (PARTITION BY animal, day) >= 2 AS keep FROM k")
def q07_mask_rms_min_channels(spark, d):
    k = daily(spark, d).withColumn("k", M.high_rms(most=100.0) & M.low_rms(least=10.0))
    return k.select("animal", "day", "channel", M.min_valid_channels(["animal", "day"], F.col("k"), 2).alias("keep"))


@query(f"WITH {DAILY}, s AS (SELECT *, rms / nullif(sum(rms) OVER (PARTITION BY animal, day), 0) AS share FROM daily) SELECT animal, day, channel, NOT coalesce(bool_or(channel = 'click' AND share > 0.4) OVER (PARTITION BY animal, day), false) AS keep FROM s")
def q08_mask_high_beta_any(spark, d):
    w = Window.partitionBy("animal", "day")
    s = daily(spark, d).withColumn("share", F.when(F.col("channel") == "click", F.try_divide(F.col("rms"), F.sum("rms").over(w))))
    return s.select("animal", "day", "channel", M.high_beta(["animal", "day"], F.col("share"), 0.4).alias("keep"))


@query(f"WITH {DAILY} SELECT animal, day, channel, round(CASE WHEN channel NOT IN ('error', 'view') THEN rms END, 6) AS rms FROM daily")
def q09_reject_channels(spark, d):
    return M.apply_mask(daily(spark, d), ["rms"], M.reject_channels(["error", "view"])).select("animal", "day", "channel", r6("rms").alias("rms"))


@query(f"WITH {DAILY}, bad AS (SELECT DISTINCT animal, channel FROM daily WHERE rms > 200) SELECT d.animal, d.day, d.channel, b.animal IS NULL AS keep FROM daily d LEFT JOIN bad b ON d.animal = b.animal AND d.channel = b.channel")
def q10_reject_by_session(spark, d):
    t = daily(spark, d).withColumnRenamed("animal", "animalday")
    return M.reject_by_session(t, t.where("rms > 200")).select(F.col("animalday").alias("animal"), "day", "channel", "keep")


def _morphology(k: int) -> str:
    """The SQL of opening then closing by k rows."""
    er, di = f"ROWS BETWEEN {k // 2} PRECEDING AND {k - 1 - k // 2} FOLLOWING", f"ROWS BETWEEN {k - 1 - k // 2} PRECEDING AND {k // 2} FOLLOWING"
    w = "PARTITION BY animal, channel ORDER BY day"
    e = lambda a, b, src: f"{b} AS (SELECT animal, day, channel, min({a}) OVER ({w} {er}) AND count(*) OVER ({w} {er}) = {k} AS k FROM {src})"
    g = lambda b, src: f"{b} AS (SELECT animal, day, channel, max(k) OVER ({w} {di}) AS k FROM {src})"
    return f"WITH {DAILY}, k0 AS (SELECT animal, day, channel, rms <= 60 AS k FROM daily), {e('k', 'k1', 'k0')}, {g('k2', 'k1')}, {g('k3', 'k2')}, {e('k', 'k4', 'k3')} SELECT animal, day, channel, k AS keep FROM k4"


@query(_morphology(3))
def q11_morphology(spark, d):
    k = daily(spark, d).withColumn("keep", F.col("rms") <= 60)
    return M.open_close(k, "keep", ["animal", "channel"], ["day"], 3).select("animal", "day", "channel", "keep")


@query(f"WITH {DAILY}, k AS (SELECT *, {ZKEEP.replace('2.0', '3.0')} AND rms <= 500 AND rms >= 5 AS k FROM daily WINDOW w AS (PARTITION BY animal, channel)), m AS (SELECT *, k AND sum(CAST(k AS INT)) OVER (PARTITION BY animal, day) >= 1 AS keep FROM k) SELECT animal, day, channel, round(CASE WHEN keep THEN rms END, 6) AS rms, round(CASE WHEN keep THEN ampvar END, 6) AS ampvar FROM m")
def q12_apply_filters(spark, d):
    config = {"logrms_range": {}, "high_rms": {}, "low_rms": {"least": 5.0}, "min_valid_channels": {"n": 1}}
    f = M.apply_filters(daily(spark, d), config, window=("animal", "day"))
    return M.apply_mask(f, ["rms", "ampvar"], F.col("keep")).select("animal", "day", "channel", r6("rms").alias("rms"), r6("ampvar").alias("ampvar"))


@query("SELECT l_returnflag, l_linestatus, round(sum(v * l_quantity) / nullif(sum(CASE WHEN v IS NOT NULL THEN l_quantity END), 0), 4) AS mean FROM (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice END AS v FROM lineitem) GROUP BY ALL")
def q13_nanaverage(spark, d):
    t = table(spark, d, "lineitem").withColumn("v", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice")))
    return A.group_average(t, ["l_returnflag", "l_linestatus"], ["v"], "l_quantity").select("l_returnflag", "l_linestatus", F.round("v", 4).alias("mean"))


@query(f"WITH {DAILY} SELECT animal, hour(timestamp) BETWEEN 6 AND 17 AS isday, CAST(sum(n) AS BIGINT) AS duration, min(timestamp) AS timestamp, round(sum(rms * n) / sum(n), 6) AS rms FROM daily GROUP BY ALL")
def q14_aggregate_windows(spark, d):
    t = daily(spark, d).withColumn("isday", W.is_day(F.col("timestamp")))
    return A.aggregate_windows(t, ["animal", "isday"], ["rms"], "n").select("animal", "isday", F.col("n").alias("duration"), "timestamp", r6("rms").alias("rms"))


@query("SELECT o_orderpriority AS genotype, l_returnflag AS channel, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def q15_group_average(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("o_orderpriority").alias("genotype"), F.col("l_returnflag").alias("channel")).agg(r6(A.weighted_mean(F.col("l_discount"), F.col("l_quantity"))).alias("mean"), F.count("*").alias("n"))


FILES = "files AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS cum, l_shipdate AS end_ts FROM lineitem)"


def _files(spark, d):
    return W.running(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", "cum").select("l_orderkey", "l_linenumber", "cum", F.col("l_shipdate").alias("end_ts"))


def _every(spark, d, step):
    """at: each multiple of step within an order's own length."""
    total = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("total"))
    each = total.select("l_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total"), F.lit(step).cast("long"))).alias("at"))
    return each.withColumn("at", F.col("at").cast("double"))


@query(f"WITH {FILES}, frag AS (SELECT l_orderkey, unnest(range(0, CAST(sum(l_quantity) AS BIGINT) + 1, 10)) AS t FROM lineitem GROUP BY l_orderkey), h AS (SELECT frag.l_orderkey, t, coalesce(min(cum) FILTER (cum >= t), max(cum)) AS cum FROM frag JOIN files ON frag.l_orderkey = files.l_orderkey GROUP BY ALL) SELECT h.l_orderkey, CAST(t AS DOUBLE) AS t, min(end_ts) + to_seconds(CAST(t - h.cum AS BIGINT)) AS timestamp FROM h JOIN files f ON h.l_orderkey = f.l_orderkey AND h.cum = f.cum GROUP BY h.l_orderkey, t, h.cum")
def q16_asof_timestamp(spark, d):
    f = _files(spark, d)
    frag = _every(spark, d, 10).select("l_orderkey", F.col("at").alias("t"))
    return W.asof_timestamps(frag, f.select("l_orderkey", "cum", "end_ts"), "l_orderkey").select("l_orderkey", "t", "timestamp")


@query(f"WITH {FILES}, w AS (SELECT l_orderkey, unnest(range(0, CAST(sum(l_quantity) AS BIGINT) + 1, 25)) AS start FROM lineitem GROUP BY l_orderkey) SELECT w.l_orderkey, CAST(start AS DOUBLE) AS start, CAST(min(cum) FILTER (cum >= start AND cum < start + 25) - start AS DOUBLE) AS endfile FROM w JOIN files ON w.l_orderkey = files.l_orderkey GROUP BY w.l_orderkey, start")
def q17_endfile(spark, d):
    w = _every(spark, d, 25).select("l_orderkey", F.col("at").alias("start")).withColumn("stop", F.col("start") + 25)
    return W.end_in_window(w, _files(spark, d), "l_orderkey").select("l_orderkey", "start", "endfile")


@query("WITH w AS (SELECT DISTINCT user_id, unnest(range(0, 30)) AS frag FROM events), s AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS frag, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL) SELECT w.user_id, CAST(w.frag AS BIGINT) AS frag, coalesce(n, 0) AS nspike FROM w LEFT JOIN s ON w.user_id = s.user_id AND w.frag = s.frag")
def q18_spike_bins(spark, d):
    e = table(spark, d, "events")
    w = e.select("user_id").distinct().withColumn("frag", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("start", F.col("frag") * 86400.0).withColumn("stop", F.col("start") + 86400.0)
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))) / 1e6
    s = e.where("event_type = 'error'").select("user_id", t.alias("t"))
    return S.count_in_windows(w, s, ["user_id"]).select("user_id", F.col("frag").cast("long").alias("frag"), "nspike")


@query("WITH g AS (SELECT user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events) SELECT user_id, event_id, round(gap, 3) AS gap_s, coalesce(gap > 86400 OR gap < 0, false) AS is_gap FROM g")
def q19_gap_check(spark, d):
    return W.gaps(table(spark, d, "events"), ["user_id"], "ts", ["ts", "event_id"], 86400.0).select("user_id", "event_id", F.round("gap_s", 3).alias("gap_s"), "is_gap")


@query("WITH t AS (SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS t FROM events), n AS (SELECT *, CASE WHEN t - lag(t) OVER w > 43200 THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM n) SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, arg_min(event_id, struct_pack(v := value, i := event_id)) AS best FROM c GROUP BY user_id, cluster")
def q20_spike_clusters(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    c = S.clusters(e, ["user_id"], "t", 43200)
    return c.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min_by("event_id", F.struct("value", "event_id")).alias("best"))


SNEO = "e AS (SELECT user_id, event_id, value * value - lead(value) OVER w * lag(value) OVER w AS psi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def _sneo(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", S.sneo("value", w).alias("psi"))


@query(f"WITH {SNEO}, q AS (SELECT user_id, quantile_cont(psi, 0.9) AS q FROM e GROUP BY user_id) SELECT e.user_id, event_id, round(psi, 4) AS psi FROM e JOIN q ON e.user_id = q.user_id WHERE psi > q")
def q21_sneo(spark, d):
    e = _sneo(spark, d)
    q = e.groupBy("user_id").agg(F.percentile("psi", F.lit(0.9)).alias("q"))
    return e.join(q, "user_id").where("psi > q").select("user_id", "event_id", F.round("psi", 4).alias("psi"))


@query(f"WITH {SNEO} SELECT user_id, event_id, CAST(CAST(coalesce(psi > 1000, false) AS INT) + CAST(coalesce(psi > 2000, false) AS INT) + CAST(coalesce(psi > 3000, false) AS INT) AS INT) AS votes FROM e WHERE CAST(coalesce(psi > 1000, false) AS INT) + CAST(coalesce(psi > 2000, false) AS INT) + CAST(coalesce(psi > 3000, false) AS INT) >= 2")
def q22_consensus_vote(spark, d):
    e = _sneo(spark, d).withColumns({f"f{k}": F.col("psi") > 1000.0 * k for k in (1, 2, 3)})
    return S.consensus(e, ["user_id"], ["f1", "f2", "f3"], 2).select("user_id", "event_id", "votes")


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM events")
def q23_smoothing(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", r6(S.smooth("value", w, 7)).alias("smooth"))


@query("SELECT user_id, round(median(epoch_us(ts) / 1e6), 3) AS median_s FROM events GROUP BY ALL")
def q24_session_order(spark, d):
    return W.session_order(table(spark, d, "events"), "user_id", "ts").select("user_id", F.round("median_s", 3).alias("median_s"))


EMB = "x AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"
#: Numbers of vectors that a session spans; about a tenth of them have its label, as many as a recording has channels.
SESSION_SPAN = 320
CORR = f"WITH x AS (SELECT vec_id, label, vec_id // {SESSION_SPAN} AS block, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT a.label, a.block, a.vec_id AS c1, b.vec_id AS c2, corr(a.v, b.v) AS r FROM x a JOIN x b ON a.label = b.label AND a.block = b.block AND a.i = b.i AND b.vec_id < a.vec_id GROUP BY ALL)"


def _pairs(spark, d):
    """Correlations of all pairs of a session's vectors; a session is a label's vectors within SESSION_SPAN numbers, so pairs grow with the rows."""
    x = table(spark, d, "embeddings").withColumn("block", F.expr(f"vec_id div {SESSION_SPAN}"))
    return CH.pair_correlations(x, ["label", "block"], "vec_id", "embedding", "c1", "c2")


@query(f"{CORR} SELECT label, c1, c2, round(r, 6) AS r FROM p")
def q25_pcorr_pairs(spark, d):
    return _pairs(spark, d).select("label", "c1", "c2", r6("r").alias("r"))


@query(f"{CORR} SELECT label, c1, c2, round(atanh(greatest(least(r, 1 - 1e-6), -1 + 1e-6)), 6) AS z FROM p")
def q26_zpcorr(spark, d):
    return _pairs(spark, d).select("label", "c1", "c2", r6(CH.fisher_z(F.col("r"))).alias("z"))


@query(f"{CORR} SELECT label, block, round(avg(r), 6) AS r FROM p GROUP BY ALL")
def q27_matrix_collapse(spark, d):
    return A.collapse_matrix(_pairs(spark, d), ["label", "block"], "r", "c1", "c2").withColumn("r", r6("r"))


def _all_pairs(spark, d):
    """Correlations of all pairs of vectors within a label, as corr gives them for the numbers at the same places: blocks of a label's vectors against each other.

    The pairs are as many as the vectors squared, what is written for them is each vector once: a task reads two shares of the blocks, and holds these and the pairs of two blocks.
    A block meets the blocks of its own part of the label and of later parts.
    """
    x = table(spark, d, "embeddings").where("label is not null and vec_id is not null and size(embedding) > 0")
    single = x.schema["embedding"].dataType.elementType.simpleString() == "float"  # as they are: half the size of doubles
    x = x.select("label", "vec_id", F.col("embedding").alias("v") if single else F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    block, rows = PAIR_BLOCK, F.collect_list(F.struct("vec_id", "v")).alias("rows")
    sizes, several = x.groupBy("label").count(), F.col("count") > block
    most, n = sizes.agg(F.max("count"), F.sum(F.when(several, F.col("count")))).first()
    if not n:
        met = x.groupBy("label").agg(rows).select("label", "rows", F.when(F.lit(False), F.col("rows")).alias("rows2"))
    else:
        parts = min(PAIR_PARTS, -(-most // block))
        large = F.broadcast(sizes.where(several))  # at most a row for every PAIR_BLOCK vectors
        small = x.join(large, "label", "left_anti").groupBy("label").agg(rows).select("label", "rows", F.when(F.lit(False), F.col("rows")).alias("rows2"))
        cut = x.join(large, "label").withColumn("block", F.expr(f"pmod(xxhash64(vec_id), ceil(count / {block}))")).withColumn("part", F.pmod("block", F.lit(parts)).cast("int"))
        shares = max(parts, -(-n // PAIR_SHARE))
        cut = cut.select("label", "part", "block", "vec_id", "v").repartition(shares, "label", "part", "block")
        blocks = cut.groupBy("label", "part", "block").agg(rows).coalesce(shares)  # no more even where a session raises what a shuffle makes: tasks are its square
        left = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where("other >= part")
        right = blocks.select("label", F.col("part").alias("other"), F.col("block").alias("block2"), F.col("rows").alias("rows2"))
        cells = left.join(right.hint("shuffle_replicate_nl"), ["label", "other"]).where("other > part or block <= block2")
        met = small.union(cells.select("label", "rows", F.when(F.col("block") != F.col("block2"), F.col("rows2")).alias("rows2")))

    def side(found):
        return found.field("vec_id").to_numpy(), list(found.field("v").to_numpy(zero_copy_only=False))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, one, two in (row for batch in batches for row in zip(*batch.columns)):
            ids, v = side(one.values)
            ids2, v2 = side(two.values) if two.is_valid else (ids, v)
            r = K.pairwise_corr(v, v2)
            a, b = (np.broadcast_to(n, r.shape) for n in (ids[:, None], ids2[None]))
            ok = a != b if two.is_valid else a > b
            a, b, r = a[ok].astype("int64"), b[ok].astype("int64"), r[ok]
            yield pa.RecordBatch.from_arrays([pa.repeat(label, len(r)), pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(r)], ["label", "c1", "c2", "r"])

    found = met.mapInArrow(pairs, f"label {x.schema['label'].dataType.simpleString()}, c1 long, c2 long, r double")
    return found.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


@query()
def q63_pcorr_pairs_all(spark, d):
    return _all_pairs(spark, d).withColumn("r", r6("r"))


@query()
def q64_zpcorr_all(spark, d):
    z = F.when(F.col("r").isNotNull(), F.atanh(F.greatest(F.least(F.col("r"), F.lit(1 - 1e-6)), F.lit(-1 + 1e-6))))  # greatest and least pass over NULL
    return _all_pairs(spark, d).select("label", "c1", "c2", r6(z).alias("z"))


@query()
def q65_matrix_collapse_all(spark, d):
    return A.collapse_matrix(_all_pairs(spark, d), ["label"], "r", "c1", "c2").withColumn("r", r6("r"))


DFT = f"{EMB}, k AS (SELECT unnest(range(0, 33)) AS k), psd AS (SELECT vec_id, k, (pow(sum(v * cos(2 * pi() * k * (i - 1) / 64)), 2) + pow(sum(v * sin(2 * pi() * k * (i - 1) / 64)), 2)) / 64 AS p FROM x, k GROUP BY vec_id, k)"


def _psd(spark, d):
    """Periodogram of each vector in one pass over its array: no join, no shuffle."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    part = lambda f, k: F.aggregate(F.transform("x", lambda v, i: v * f(2 * math.pi * k * i / 64)), F.lit(0.0), lambda s, v: s + v)
    k = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(32))))
    return k.select("vec_id", F.col("k").cast("long").alias("k"), ((part(F.cos, F.col("k")) ** 2 + part(F.sin, F.col("k")) ** 2) / 64).alias("p"))


@query(f"WITH {DFT} SELECT vec_id, k, round(p, 6) AS p FROM psd")
def q28_periodogram(spark, d):
    return _psd(spark, d).withColumn("p", r6("p"))


_BANDS = ", ".join(f"('{b}', {lo}, {hi})" for b, (lo, hi) in C.BANDS.items())
_FRAC = f"WITH {DFT}, b(band, lo, hi) AS (VALUES {_BANDS}), t AS (SELECT vec_id, k, p, lead(p) OVER (PARTITION BY vec_id ORDER BY k) AS q FROM psd), a AS (SELECT vec_id, band, sum((p + q) / 2) AS area FROM t JOIN b ON k >= lo AND k + 1 <= least(hi, 32) GROUP BY ALL)"


def _bands(spark, d):
    p = _psd(spark, d).withColumn("q", F.lead("p").over(Window.partitionBy("vec_id").orderBy("k")))
    area = [F.sum(F.when((F.col("k") >= lo) & (F.col("k") + 1 <= min(hi, 32)), (F.col("p") + F.col("q")) / 2)).alias(b) for b, (lo, hi) in C.BANDS.items()]
    return R.melt(p.groupBy("vec_id").agg(*area), ["vec_id"], list(C.BANDS), "band", "area")


@query(f"{_FRAC} SELECT vec_id, band, round(area, 6) AS area FROM a")
def q29_psdband(spark, d):
    return _bands(spark, d).withColumn("area", r6("area"))


@query(f"{_FRAC} SELECT vec_id, band, round(area / nullif(sum(area) OVER (PARTITION BY vec_id), 0), 6) AS frac FROM a")
def q30_psdfrac(spark, d):
    return _bands(spark, d).select("vec_id", "band", r6(F.try_divide(F.col("area"), F.sum("area").over(Window.partitionBy("vec_id")))).alias("frac"))


@query(f"WITH {DFT}, t AS (SELECT vec_id, k, p, lead(p) OVER (PARTITION BY vec_id ORDER BY k) AS q FROM psd) SELECT vec_id, round(sum((p + q) / 2), 6) AS psdtotal FROM t WHERE k >= 1 AND k < 32 GROUP BY vec_id")
def q31_psdtotal(spark, d):
    p = _psd(spark, d).withColumn("q", F.lead("p").over(Window.partitionBy("vec_id").orderBy("k")))
    return p.where("k >= 1 and k < 32").groupBy("vec_id").agg(r6(F.sum((F.col("p") + F.col("q")) / 2)).alias("psdtotal"))


@query(f"WITH {DFT} SELECT vec_id, round(regr_slope(log10(p), log10(k)), 5) AS slope, round(regr_intercept(log10(p), log10(k)), 5) AS intercept FROM psd WHERE k >= 1 AND p > 1e-12 GROUP BY vec_id")
def q32_psdslope(spark, d):
    u, v = F.log10(F.col("k").cast("double")), F.log10("p")
    return _psd(spark, d).where("k >= 1 and p > 1e-12").groupBy("vec_id").agg(F.round(F.regr_slope(v, u), 5).alias("slope"), F.round(F.regr_intercept(v, u), 5).alias("intercept"))


@query(f"WITH {EMB} SELECT vec_id, round(sqrt(avg(v * v)), 6) AS rms, round(var_pop(v), 6) AS ampvar, round(ln(1 + sqrt(avg(v * v))), 6) AS logrms FROM x GROUP BY vec_id")
def q33_vector_linear(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    e = table(spark, d, "embeddings").select("vec_id", (total(x) / 64).alias("m"), (total(F.transform(x, lambda v: v * v)) / 64).alias("m2"))
    return e.select("vec_id", r6(F.sqrt("m2")).alias("rms"), r6(F.col("m2") - F.col("m") * F.col("m")).alias("ampvar"), r6(F.log1p(F.sqrt("m2"))).alias("logrms"))


@query(f"WITH {DAILY}, k AS (SELECT DISTINCT animal, day FROM daily), t(channel) AS (VALUES ('view'), ('click'), ('none')) SELECT k.animal, k.day, t.channel, round(rms, 6) AS rms FROM k CROSS JOIN t LEFT JOIN daily d ON d.animal = k.animal AND d.day = k.day AND d.channel = t.channel")
def q34_reorder_pad(spark, d):
    return R.pad_channels(daily(spark, d), ["animal", "day"], "channel", ["view", "click", "none"]).select("animal", "day", "channel", r6("rms").alias("rms"))


_LOF = "dist AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, a ORDER BY d, b) AS r FROM dist) WHERE r <= 5), kd AS (SELECT label, a, max(d) AS kd FROM near GROUP BY ALL), lrd AS (SELECT n.label, n.a, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM near n JOIN kd ON kd.label = n.label AND kd.a = n.b GROUP BY ALL), lof AS (SELECT n.label, n.a AS vec_id, avg(l.lrd) / any_value(o.lrd) AS lof FROM near n JOIN lrd l ON l.label = n.label AND l.a = n.b JOIN lrd o ON o.label = n.label AND o.a = n.a GROUP BY ALL)"


def _lof(spark, d):
    return L.scores_sql(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 5)


@query(f"WITH {_LOF} SELECT label, vec_id, round(lof, 6) AS lof FROM lof")
def q35_lof_scores(spark, d):
    return _lof(spark, d).withColumn("lof", r6("lof"))


@query(f"WITH {_LOF} SELECT label, vec_id FROM lof WHERE NOT coalesce(lof < 1.01, false)")
def q36_lof_threshold(spark, d):
    return _lof(spark, d).where(L.bad(F.col("lof"), 1.01)).select("label", "vec_id")


_SWEEP = "t(threshold) AS (SELECT unnest([0.0, 50.0, 100.0, 150.0, 200.0])), y AS (SELECT value AS s, CAST(event_type = 'purchase' AS INT) AS y FROM events), c AS (SELECT threshold, sum(CASE WHEN s > threshold AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN s > threshold AND y <> 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT s > threshold AND y = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN NOT s > threshold AND y <> 1 THEN 1 ELSE 0 END) AS tn FROM y, t GROUP BY threshold), f AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c), g AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM f)"


def _swept(spark, d):
    e = table(spark, d, "events").withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return L.sweep(e, "value", "y", [0, 50, 100, 150, 200])


@query(f"WITH {_SWEEP} SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM g")
def q37_threshold_sweep(spark, d):
    s = _swept(spark, d)
    return s.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(f"WITH {_SWEEP} SELECT CAST(threshold AS DOUBLE) AS threshold, round(f1, 6) AS f1 FROM g ORDER BY f1 DESC, threshold LIMIT 1")
def q38_best_threshold(spark, d):
    return L.best_threshold(_swept(spark, d)).withColumn("f1", r6("f1"))


@query(f"WITH {DAILY} SELECT animal, day, channel, feature, round(value, 6) AS value FROM (UNPIVOT (SELECT animal, day, channel, rms, ampvar FROM daily) ON rms, ampvar INTO NAME feature VALUE value)")
def q39_melt(spark, d):
    return R.melt(daily(spark, d).select("animal", "day", "channel", "rms", "ampvar"), ["animal", "day", "channel"], ["rms", "ampvar"]).withColumn("value", r6("value"))


@query(f"WITH {DAILY} SELECT animal, day, channel AS band, round(rms, 6) AS value FROM daily")
def q40_band_explode(spark, d):
    bands = daily(spark, d).groupBy("animal", "day").agg(F.map_from_entries(F.collect_list(F.struct("channel", "rms"))).alias("psdband"))
    return R.explode_bands(bands, "psdband").withColumn("value", r6("value"))


@query("SELECT user_id, round(avg(CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN value END), 6) AS day, round(avg(CASE WHEN NOT hour(ts) BETWEEN 6 AND 17 THEN value END), 6) AS night FROM events GROUP BY user_id")
def q41_pivot_isday(spark, d):
    e = table(spark, d, "events").withColumn("part", F.when(W.is_day(F.col("ts")), "day").otherwise("night"))
    p = R.pivot(e, ["user_id"], "part", ["day", "night"], "value")
    return p.select("user_id", r6("day").alias("day"), r6("night").alias("night"))


_BASE = "WITH b AS (SELECT l_linestatus, avg(l_discount) AS m FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)"


@query(f"{_BASE} SELECT l_orderkey, l_linenumber, round(l_discount - m, 6) AS v FROM lineitem LEFT JOIN b USING (l_linestatus)")
def q42_baseline_subtract(spark, d):
    return A.normalize_baseline(table(spark, d, "lineitem"), "l_discount", ["l_linestatus"], {"l_returnflag": "N"}).select("l_orderkey", "l_linenumber", r6("l_discount").alias("v"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / (SELECT avg(l_quantity) FROM lineitem WHERE l_returnflag = 'N'), 6) AS v FROM lineitem WHERE l_returnflag <> 'N'")
def q43_baseline_divide_global(spark, d):
    return A.normalize_baseline(table(spark, d, "lineitem"), "l_quantity", [], {"l_returnflag": "N"}, "divide", drop=True).select("l_orderkey", "l_linenumber", r6("l_quantity").alias("v"))


@query("SELECT event_id, round(1.0 / count(*) OVER (PARTITION BY user_id), 9) AS w FROM events")
def q44_animal_weights(spark, d):
    return table(spark, d, "events").withColumn("w", A.animal_weights(None, "user_id")).select("event_id", F.round("w", 9).alias("w"))


@query("WITH w AS (SELECT value, 1.0::DOUBLE / count(*) OVER (PARTITION BY user_id) AS w FROM events), b AS (SELECT least(CAST(floor(value / 25.0) AS BIGINT), 9) AS bin, sum(w) AS w FROM w WHERE value BETWEEN 0 AND 250 GROUP BY ALL) SELECT bin, round(w / (sum(w) OVER () * 25), 9) AS density FROM b")
def q45_weighted_histogram(spark, d):
    e = table(spark, d, "events").withColumn("w", A.animal_weights(None, "user_id"))
    return A.weighted_histogram(e, "value", "w", 0.0, 250.0, 10).withColumn("density", F.round("density", 9))


@query("WITH s AS (SELECT l_linestatus, avg(l_discount) FILTER (l_returnflag = 'A') AS ma, avg(l_discount) FILTER (l_returnflag = 'R') AS mb, stddev_samp(l_discount) FILTER (l_returnflag = 'A') AS sa, stddev_samp(l_discount) FILTER (l_returnflag = 'R') AS sb, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nb FROM lineitem GROUP BY l_linestatus) SELECT l_linestatus, na AS n_a, nb AS n_b, round(ma - mb, 9) AS diff, round((ma - mb) / nullif(sqrt(((na - 1) * sa * sa + (nb - 1) * sb * sb) / nullif(na + nb - 2, 0)), 0), 6) AS cohens_d FROM s WHERE na > 1 AND nb > 1")
def q46_cohens_d(spark, d):
    t = table(spark, d, "lineitem").where("l_returnflag in ('A', 'R')")
    e = A.effect_size(t, "l_discount", "l_returnflag", "A", "R", ["l_linestatus"]).where("n_a > 1 and n_b > 1")
    return e.select("l_linestatus", "n_a", "n_b", F.round("diff", 9).alias("diff"), r6("cohens_d").alias("cohens_d"))


@query("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_discount), 6) AS r, round(sqrt(avg(pow(l_quantity - l_discount, 2))), 6) AS rmse FROM lineitem GROUP BY ALL")
def q47_agreement(spark, d):
    a = A.agreement(table(spark, d, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"])
    return a.withColumn("r", r6("r")).withColumn("rmse", r6("rmse"))


@query("SELECT l_linestatus, round(log2(greatest(avg(l_tax), 1e-10) / greatest(avg(l_discount), 1e-10)), 6) AS log2fc FROM lineitem GROUP BY ALL")
def q48_log2_fold(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.avg("l_tax").alias("a"), F.avg("l_discount").alias("b"))
    return g.select("l_linestatus", r6(A.log2_fold(F.col("a"), F.col("b"))).alias("log2fc"))


@query("WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY ALL), a AS (SELECT event_id, e.event_type, value - m AS d FROM events e JOIN m ON e.event_type = m.event_type), k AS (SELECT event_type, median(abs(d)) AS k FROM a GROUP BY ALL) SELECT event_id, round(0.6745 * d / nullif(k, 0), 6) AS modified_z FROM a JOIN k ON a.event_type = k.event_type")
def q49_modified_z(spark, d):
    return A.modified_z(table(spark, d, "events"), "value", ["event_type"]).select("event_id", r6("modified_z").alias("modified_z"))


@query("SELECT event_id, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 6) AS z, round(value - avg(value) OVER w, 6) AS center FROM events WINDOW w AS (PARTITION BY event_type)")
def q50_z_modes(spark, d):
    w = Window.partitionBy("event_type")
    return table(spark, d, "events").select("event_id", r6(M.zscore(F.col("value"), ["event_type"])).alias("z"), r6(F.col("value") - F.avg("value").over(w)).alias("center"))


@query("WITH p AS (SELECT event_type, user_id % 2 AS g, value, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS rk FROM events) SELECT event_type, round(sum(rk) FILTER (g = 0) - count(*) FILTER (g = 0) * (count(*) FILTER (g = 0) + 1) / 2.0::DOUBLE, 3) AS u FROM p GROUP BY event_type")
def q52_mann_whitney_u(spark, d):
    from voltaloom.functions.stats import mann_whitney

    return mann_whitney(table(spark, d, "events").withColumn("g", F.col("user_id") % 2), "value", "g", 0, ["event_type"]).select("event_type", F.round("u", 3).alias("u"))


@query("WITH m AS (SELECT event_type, count(*)::DOUBLE AS n, avg(value) AS a FROM events GROUP BY ALL), c AS (SELECT e.event_type, any_value(n) AS n, avg(pow(value - a, 2)) AS m2, avg(pow(value - a, 3)) AS m3, avg(pow(value - a, 4)) AS m4 FROM events e JOIN m ON e.event_type = m.event_type GROUP BY ALL), g AS (SELECT event_type, n, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) AS b2 FROM c), s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b, 3 * (n - 1) / (n + 1) AS e, 24 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5)) AS v, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sk FROM g), t AS (SELECT *, -1 + sqrt(2 * (b - 1)) AS w2, (b2 - e) / sqrt(v) AS x, 6 + 8 / sk * (2 / sk + sqrt(1 + 4 / (sk * sk))) AS a FROM s), z AS (SELECT event_type, 1 / sqrt(0.5 * ln(w2)) * asinh(y / sqrt(2 / (w2 - 1))) AS zs, (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * cbrt((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS zk FROM t) SELECT event_type, round(zs * zs + zk * zk, 3) AS k2 FROM z")
def q51_normaltest(spark, d):
    from voltaloom.functions.stats import normality

    return normality(table(spark, d, "events"), "value", ["event_type"]).select("event_type", F.round("k2", 3).alias("k2"))


@query("WITH s AS (SELECT event_type, count(*) OVER (PARTITION BY event_type)::DOUBLE AS n, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, least(value / 500.0::DOUBLE, 1) AS u FROM events) SELECT event_type, round(max(greatest(i / n - u, u - (i - 1) / n)), 6) AS ks FROM s GROUP BY event_type")
def q53_ks_uniform(spark, d):
    from voltaloom.functions.stats import ks_statistic

    uniform = lambda v: F.least(v / 500.0, F.lit(1.0))
    return ks_statistic(table(spark, d, "events"), "value", uniform, ["event_type"]).withColumn("ks", r6("ks"))


@query("SELECT n_nationkey, n_name, CASE WHEN contains(n_name, 'UNITED') THEN 'united' WHEN contains(n_name, 'AN') THEN 'an' WHEN contains(n_name, 'A') THEN 'a' END AS k FROM nation")
def q54_alias(spark, d):
    aliases = {"united": ["UNITED"], "an": ["AN"], "a": ["A"]}
    return table(spark, d, "nation").select("n_nationkey", "n_name", N.alias_col(F.col("n_name"), aliases).alias("k"))


@query("SELECT DISTINCT user_id, CAST(user_id AS VARCHAR) || ' ' || CASE WHEN user_id % 2 = 0 THEN 'WT' ELSE 'KO' END || ' ' || strftime(ts, '%b-%d-%Y') AS animalday FROM events")
def q55_animalday(spark, d):
    genotype = F.when(F.col("user_id") % 2 == 0, "WT").otherwise("KO")
    return table(spark, d, "events").select("user_id", N.animalday(F.col("user_id").cast("string"), genotype, F.col("ts")).alias("animalday")).distinct()


@query(r"SELECT p_partkey, CAST(list_last(regexp_extract_all(p_brand, '(\d+)')) AS INT) AS idx FROM part")
def q56_file_index(spark, d):
    return table(spark, d, "part").select("p_partkey", N.file_index_col(F.col("p_brand")).alias("idx"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * CASE l_returnflag WHEN 'A' THEN 1000.0 WHEN 'R' THEN 1000000.0 ELSE 1.0 END AS uv FROM lineitem")
def q57_unit_scale(spark, d):
    unit = F.when(F.col("l_returnflag") == "A", "mV").when(F.col("l_returnflag") == "R", "V").otherwise("µV")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * N.unit_scale(unit)).alias("uv"))


@query("SELECT c_custkey FROM customer c WHERE c_mktsegment <> 'MACHINERY' AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')")
def q59_quality_filter(spark, d):
    bad = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'").join(bad, "c_custkey", "left_anti").select("c_custkey")


def _signals(spark, d, number="vec_id"):
    """Sessions of one channel: each embedding repeated to 512 samples at 512 Hz."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("animalday"), (F.col(number) if isinstance(number, str) else number).cast("long").alias("frag_idx"), F.array_repeat(F.transform("embedding", lambda v: v.cast("double")), 8).alias("x"))
    return e.select("animalday", "frag_idx", F.array(F.flatten("x")).alias("signal"))


@query()
def q60_welch_features(spark, d):
    return FE.long_features(_signals(spark, d), 512.0, ["rms", "psdband", "psdtotal", "psdslope", "psdfrac"])


@query()
def q61_coherency(spark, d):
    """Recordings of two vectors that follow each other by vec_id within a label; a label's last odd one is a recording of one channel, with its diagonal only."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    s = _signals(spark, d, rank)
    pair = s.select("animalday", F.floor(F.col("frag_idx") / 2).alias("frag_idx"), (F.col("frag_idx") % 2).alias("c"), F.col("signal")[0].alias("x")).groupBy("animalday", "frag_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda p: p["x"]).alias("signal"))
    return FE.long_features(pair, 512.0, ["cohere", "zcohere", "imcoh", "pcorr"])


@query()
def q62_spike_detector(spark, d):
    s = _signals(spark, d).select("animalday", F.col("frag_idx").cast("string").alias("channel"), F.col("signal")[0].alias("signal"))
    return S.detect(s, 512.0, percentile=99.0, vote=1)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Windows, filters, masks and duration-weighted averages by session half: built-in expressions only."""
    f = M.apply_filters(daily(spark, d), {"logrms_range": {}, "high_rms": {}, "low_rms": {"least": 5.0}}, window=("animal", "day"))
    m = M.apply_mask(f, ["rms", "ampvar"], F.col("keep")).withColumn("isday", W.is_day(F.col("timestamp")))
    return A.aggregate_windows(m, ["animal", "isday"], ["rms", "ampvar"], "n")

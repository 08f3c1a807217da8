"""Tables behind figures and exports over the driver's tables, each with its SQL.

events stand for windows of one feature: animal = user_id, channel = event_type, value; embeddings for densities: freq = place, channel = label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from voltaloom import constants as C
from voltaloom.operators import blocked_spikes as BS
from voltaloom.operators import channels as CH
from voltaloom.operators import lof as L
from voltaloom.operators import masks as M
from voltaloom.operators import plots as P
from voltaloom.operators import reshape as R
from voltaloom.operators import spikes as S
from voltaloom.operators import windows as W
from voltaloom.plans.queries import DAILY, SESSION_SPAN, daily, query, r6, table
from voltaloom.plans.session_queries import spike_pieces
from voltaloom.sources import spike_results as SR
from voltaloom.staging import shared_folder, staged


def _long(spark, d):
    """rms of each animal, day and channel in long form, with the genotype and whether the first window lies in the day."""
    x = daily(spark, d).select(F.when(F.col("animal") % 3 == 0, "WT").otherwise("KO").alias("genotype"), "animal", "day", "channel", "timestamp", W.is_day(F.col("timestamp")).alias("isday"), "rms", "ampvar")
    return R.melt(x, ["genotype", "animal", "day", "channel", "timestamp", "isday"], ["rms", "ampvar"])


_ISDAY = "hour(timestamp) BETWEEN 6 AND 17"


@query(f"WITH {DAILY} SELECT CASE WHEN animal % 3 = 0 THEN 'WT' ELSE 'KO' END AS genotype, {_ISDAY} AS isday, channel, round(avg(rms), 6) AS value FROM daily WHERE channel IN ('view', 'click') GROUP BY ALL")
def q107_timeseries_channels(spark, d):
    return R.timeseries(_long(spark, d), "rms", ["genotype", "isday"], channels=["view", "click"], average=True).withColumn("value", r6("value"))


@query(f"WITH {DAILY}, c AS (SELECT animal, day, timestamp, {_ISDAY} AS isday, avg(ampvar) AS value FROM daily GROUP BY ALL) SELECT animal, isday, 'average' AS channel, round(avg(value), 4) AS value FROM c GROUP BY ALL")
def q108_timeseries_collapsed(spark, d):
    return R.timeseries(_long(spark, d), "ampvar", ["animal", "isday"], collapse=True, average=True).withColumn("value", F.round("value", 4))


@query(f"WITH {DAILY}, k AS (SELECT DISTINCT animal, day FROM daily), t(channel) AS (VALUES ('view'), ('none'), ('click')) SELECT k.animal, k.day, t.channel, round(rms, 6) AS value FROM k CROSS JOIN t LEFT JOIN daily d ON d.animal = k.animal AND d.day = k.day AND d.channel = t.channel")
def q109_reordered_arrays(spark, d):
    target = ["view", "none", "click"]
    x = daily(spark, d).groupBy("animal", "day").agg(F.collect_list(F.struct("channel", "rms")).alias("s")).select("animal", "day", F.col("s.channel").alias("names"), F.col("s.rms").alias("rms"))
    x = x.withColumn("rms", R.reorder_channels(F.col("rms"), F.col("names"), target)).withColumn("channels", F.array(*(F.lit(t) for t in target)))
    return R.explode_channels(x, "rms").select("animal", "day", "channel", r6("value").alias("value"))


@query("SELECT c_custkey, CASE left(c_mktsegment, 1) WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' END AS sex, substr(c_mktsegment, 2) AS gene FROM customer")
def q110_sex_and_gene(spark, d):
    sex, gene = R.sex_and_gene(F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", sex.alias("sex"), gene.alias("gene"))


@query("WITH f AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS cum, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(cum AS BIGINT)) AS from_start, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(cum - total AS BIGINT)) AS to_end FROM f JOIN orders ON l_orderkey = o_orderkey")
def q111_manual_timestamps(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp_ntz").alias("anchor"))
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    spread = lambda start: W.spread_seconds("l_orderkey", "l_linenumber", "q", start)
    f = f.select("l_orderkey", "l_linenumber", spread(True).alias("after"), spread(False).alias("before")).join(o, "l_orderkey")
    at = lambda seconds, name: W.shifted(F.col("anchor"), F.col(seconds)).alias(name)
    return f.select("l_orderkey", "l_linenumber", at("after", "from_start"), at("before", "to_end"))


@query("SELECT user_id, CAST(floor((epoch_us(ts) / 1e6 - 1704067200) / 3600) AS BIGINT) AS frag_idx, count(*) AS nspike FROM events GROUP BY ALL")
def q112_uniform_counts(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    return S.count_in_uniform_windows(table(spark, d, "events").select("user_id", t.alias("t")), ["user_id"], 3600.0)


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_partkey / 250) AS BIGINT) AS frag_idx FROM lineitem")
def q113_fragment_index(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", W.fragment_index(F.col("l_partkey"), 250).alias("frag_idx"))


_SAMPLES = "s AS (SELECT CAST(l_linenumber AS VARCHAR) AS channel, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) - 1 AS i, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem)"


@query(f"WITH {_SAMPLES}, k AS (SELECT channel, i FROM s WHERE v > 90000), g AS (SELECT channel, i, unnest(range(-20, 21)) AS lag FROM k) SELECT g.channel, CAST(lag AS INT) AS lag, round(avg(v), 4) AS mean, count(*) AS n FROM g JOIN s ON s.channel = g.channel AND s.i = g.i + lag GROUP BY ALL")
def q114_spike_averages(spark, d):
    pieces = spike_pieces(spark, d)
    spikes = pieces.select("animalday", "channel", "start", F.posexplode("signal").alias("p", "v")).where("v > 90000").select("animalday", "channel", (F.col("start") + F.col("p")).alias("sample_idx"))
    return BS.averages(spikes, pieces, 20, 700).select("channel", "lag", F.round("mean", 4).alias("mean"), "n")


_MATRIX = f"x AS (SELECT vec_id, label, vec_id // {SESSION_SPAN} AS block, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT a.label, a.block, a.vec_id % 5 AS channel, b.vec_id % 5 AS channel2, corr(a.v, b.v) AS r FROM x a JOIN x b ON a.label = b.label AND a.block = b.block AND a.i = b.i AND b.vec_id < a.vec_id GROUP BY a.label, a.block, a.vec_id, b.vec_id), m AS (SELECT label, channel, channel2, avg(r) AS value FROM p GROUP BY ALL)"


def _matrices(spark, d):
    x = table(spark, d, "embeddings").withColumn("block", F.expr(f"vec_id div {SESSION_SPAN}"))
    p = CH.pair_correlations(x, ["label", "block"], "vec_id", "embedding")
    long = p.select("label", F.lit("pcorr").alias("feature"), (F.col("channel") % 5).alias("channel"), (F.col("channel2") % 5).alias("channel2"), F.col("r").alias("value"))
    return P.matrix_average(long, "pcorr", ["label"])


@query(f"WITH {_MATRIX} SELECT label, channel, channel2, round(value, 6) AS value FROM m")
def q115_matrix_average(spark, d):
    return _matrices(spark, d).withColumn("value", r6("value"))


@query(f"WITH {_MATRIX} SELECT m.label, m.channel, m.channel2, round(m.value - b.value, 6) AS value FROM m LEFT JOIN (SELECT * FROM m WHERE label = 0) b ON m.channel = b.channel AND m.channel2 = b.channel2 WHERE m.label <> 0")
def q116_matrix_difference(spark, d):
    return P.matrix_difference(_matrices(spark, d), {"label": 0}, []).withColumn("value", r6("value"))


_LINES = f"{DAILY}, l AS (SELECT animal, day, channel, timestamp, (rms - avg(rms) OVER w) / nullif(stddev_pop(rms) OVER w, 0) AS z, (rms - avg(rms) OVER (PARTITION BY animal)) AS c FROM daily WINDOW w AS (PARTITION BY animal, channel))"


@query(f"WITH {_LINES} SELECT animal, timestamp, channel, round(z, 5) AS value FROM l")
def q117_temporal_lines(spark, d):
    return P.temporal_lines(_long(spark, d), "rms", ["animal"], "timestamp").withColumn("value", F.round("value", 5))


@query(f"WITH {_LINES}, v AS (SELECT animal, timestamp, avg(z) AS z FROM l GROUP BY ALL) SELECT animal, CAST(timestamp AS DATE) AS day, CAST(floor((hour(timestamp) * 3600 + minute(timestamp) * 60 + second(timestamp)) / 1800) AS BIGINT) AS bin, round(avg(z), 5) AS value FROM v GROUP BY ALL")
def q118_temporal_heatmap(spark, d):
    return P.temporal_heatmap(_long(spark, d), "rms", ["animal"], minutes=30).drop("hour").withColumn("value", F.round("value", 5))


@query("WITH w AS (SELECT user_id AS animal, CAST(user_id AS VARCHAR) || strftime(ts, ' %d') AS animalday, ts AS timestamp, event_type, event_id FROM events), m AS (SELECT *, lag(animalday) OVER (PARTITION BY animal ORDER BY timestamp, animalday) AS before FROM w) SELECT animal, timestamp, kind, count(*) AS n FROM (SELECT animal, timestamp, 'endfile' AS kind FROM m WHERE event_type = 'error' UNION ALL SELECT animal, timestamp, 'session' FROM m WHERE before <> animalday) GROUP BY ALL")
def q119_boundaries(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("animal"), F.concat(F.col("user_id").cast("string"), F.date_format("ts", " dd")).alias("animalday"), F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "error", 1.0).alias("endfile"))
    return P.boundaries(e).groupBy("animal", "timestamp", "kind").agg(F.count("*").alias("n"))


_PSD = "d AS (SELECT vec_id, label, unnest(range(0, 64)) AS freq, exp(unnest(embedding)::DOUBLE) AS value, 1.0 + vec_id % 3 AS duration FROM embeddings)"


def _densities(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("channel"), (1.0 + F.col("vec_id") % 3).alias("duration"), F.posexplode("embedding").alias("freq", "value"))
    return e.withColumn("value", F.exp(F.col("value").cast("double")))


@query(f"WITH {_PSD}, g AS (SELECT vec_id % 2 AS grp, label AS channel, freq, sum(value * duration) / sum(duration) AS value FROM d GROUP BY ALL), f AS (SELECT grp, channel, regr_slope(log10(value), log10(freq)) AS slope, regr_intercept(log10(value), log10(freq)) AS intercept FROM g WHERE freq BETWEEN 1 AND 40 GROUP BY ALL) SELECT g.grp, g.channel, CAST(freq AS INT) AS freq, round(value, 6) AS value, round(slope, 6) AS slope, round(CASE WHEN freq > 0 THEN pow(10, intercept + slope * log10(greatest(freq, 1))) END, 6) AS fit FROM g JOIN f ON g.grp = f.grp AND g.channel = f.channel")
def q120_psd_lines(spark, d):
    p = P.psd_lines(_densities(spark, d).withColumn("grp", F.col("vec_id") % 2), ["grp"])
    return p.select("grp", "channel", "freq", r6("value").alias("value"), r6("slope").alias("slope"), r6("fit").alias("fit"))


@query(f"WITH {_PSD}, w AS (SELECT label, vec_id // 3 AS frag, freq, log10(median(value)) AS v FROM d WHERE freq BETWEEN 1 AND 50 GROUP BY ALL) SELECT label, frag, CAST(freq AS INT) AS freq, round((v - avg(v) OVER x) / nullif(stddev_pop(v) OVER x, 0), 5) AS value FROM w WINDOW x AS (PARTITION BY label, freq)")
def q121_spectrogram(spark, d):
    psd = _densities(spark, d).withColumn("frag", F.expr("vec_id div 3")).withColumnRenamed("channel", "label")
    return P.spectrogram(psd, ["label"], "frag", centre="median").withColumn("value", F.round("value", 5))


@query(f"WITH {DAILY} SELECT animal, day, 'rms_' || channel AS name, round(rms, 6) AS value FROM daily UNION ALL SELECT animal, day, 'ampvar_' || channel, round(ampvar, 6) FROM daily")
def q122_flat_features(spark, d):
    return P.flat_features(_long(spark, d), ["animal", "day"]).withColumn("value", r6("value"))


@query(f"WITH {DAILY} SELECT animal, day, channel, round(CASE WHEN coalesce(rms <= 100, true) THEN rms END, 6) AS rms FROM daily WHERE animal % 20 <> 3")
def q125_staged_filter(spark, d):
    """Cohorts of animals as stages; the first run computes all but one, the second one takes them from the manifest."""
    days = daily(spark, d).withColumn("cohort", (F.col("animal") % 20).cast("string"))
    files = table(spark, d, "events").groupBy((F.col("user_id") % 20).cast("string").alias("cohort")).agg(F.count("*").alias("n"), F.max("ts").alias("last")).where("cohort <> '3'")
    folder = f"{shared_folder(spark)}/stages/{spark.sql('select uuid()').first()[0]}"
    compute = lambda keys: M.filter_by(days.join(keys, "cohort", "left_semi"), "high_rms", ["rms"], most=100.0).select("cohort", "animal", "day", "channel", "rms")
    staged(folder, files.where("cohort <> '4'"), "cohort", ["n", "last"], compute, {"most": 100})
    return staged(folder, files, "cohort", ["n", "last"], compute, {"most": 100}).select("animal", "day", "channel", r6("rms").alias("rms"))


@query("WITH c AS (SELECT user_id, event_type, max(event_id) + 1 AS samples FROM events GROUP BY ALL), s AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 150 GROUP BY ALL) SELECT CAST(c.user_id AS VARCHAR) AS animalday, c.event_type AS channel, coalesce(n, 0) AS nspike, CAST(coalesce(sum(n) OVER (PARTITION BY c.user_id), 0) AS BIGINT) AS total, round(coalesce(n, 0) / (samples / 512.0::DOUBLE), 6) AS rate FROM c LEFT JOIN s ON c.user_id = s.user_id AND c.event_type = s.event_type")
def q126_spike_results(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("animalday"), F.col("event_type").alias("channel"), F.col("event_id").alias("sample_idx"), "value")
    channels = e.groupBy("animalday", "channel").agg((F.max("sample_idx") + 1).alias("samples")).withColumn("f_s", F.lit(512.0))
    spikes = e.where("value > 150").select("animalday", "channel", "sample_idx", (F.col("sample_idx") / 512.0).alias("t_s"))
    folder = f"{shared_folder(spark)}/spikes/{spark.sql('select uuid()').first()[0]}"
    SR.save_spikes(spikes, channels, folder, {"least": 150})
    found, looked_at, _ = SR.load_spikes(spark, folder)
    return SR.counts(found, looked_at).withColumn("rate", r6("rate"))


@query("WITH x AS (SELECT label, vec_id % 4 AS channel, ['delta', 'theta', 'alpha', 'beta', 'gamma'][unnest(range(1, 6))] AS band, unnest(embedding[1:5])::DOUBLE AS v FROM embeddings) SELECT label, channel, round(avg(v) FILTER (band = 'delta'), 6) AS cohere_delta, round(avg(v) FILTER (band = 'theta'), 6) AS cohere_theta, round(avg(v) FILTER (band = 'alpha'), 6) AS cohere_alpha, round(avg(v) FILTER (band = 'beta'), 6) AS cohere_beta, round(avg(v) FILTER (band = 'gamma'), 6) AS cohere_gamma FROM x GROUP BY ALL")
def q127_band_columns(spark, d):
    bands = F.array(*(F.lit(b) for b in C.BANDS))
    long = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 4).alias("channel"), F.lit("cohere").alias("feature"), F.posexplode(F.slice("embedding", 1, 5)).alias("k", "value"))
    long = long.withColumn("band", F.get(bands, F.col("k"))).withColumn("value", F.col("value").cast("double"))
    wide = R.band_columns(long, "cohere", ["label", "channel"])
    return wide.select("label", "channel", *(r6(c).alias(c) for c in wide.columns if c.startswith("cohere")))


@query("WITH s AS (SELECT user_id AS animalday, event_type AS channel, max(value) / 150 AS lof FROM events GROUP BY ALL), m AS (SELECT DISTINCT user_id AS animalday, event_type AS channel FROM events WHERE event_id % 17 = 0), j AS (SELECT coalesce(s.animalday, m.animalday) AS animalday, coalesce(s.channel, m.channel) AS channel, m.animalday IS NOT NULL AS manual, s.animalday IS NOT NULL AND NOT coalesce(lof < 1.5, false) AS scored FROM s FULL JOIN m ON s.animalday = m.animalday AND s.channel = m.channel) SELECT *, CASE WHEN manual AND scored THEN 'both' WHEN manual THEN 'manual' WHEN scored THEN 'scored' ELSE 'neither' END AS kind FROM j")
def q128_manual_and_scores(spark, d):
    e = table(spark, d, "events")
    scores = e.groupBy(F.col("user_id").alias("animalday"), F.col("event_type").alias("channel")).agg((F.max("value") / 150).alias("lof"))
    manual = e.where("event_id % 17 = 0").select(F.col("user_id").alias("animalday"), F.col("event_type").alias("channel"))
    return L.compare_manual(manual, scores, 1.5)


@query("SELECT user_id AS animalday, array_to_string(list(event_type ORDER BY event_type), ',') AS channels, round(list_sum(list(m ORDER BY event_type)), 4) AS total FROM (SELECT user_id, event_type, max(value) AS m FROM events GROUP BY ALL) GROUP BY user_id")
def q129_score_lists(spark, d):
    scores = table(spark, d, "events").groupBy(F.col("user_id").alias("animalday"), F.col("event_type").alias("channel")).agg(F.max("value").alias("lof"))
    lists = L.score_lists(scores)
    return lists.select("animalday", F.array_join("channels", ",").alias("channels"), F.round(F.aggregate("lofs", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))

"""Queries on sessions, filters, evaluation and checks, each with its SQL; the tables stand for recordings as in `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltaloom.functions import stats as ST
from voltaloom.operators import lof as L
from voltaloom.operators import aggregate as A
from voltaloom.operators import blocked_spikes as BS
from voltaloom.operators import masks as M
from voltaloom.operators import ranks as RK
from voltaloom.operators import sessions as SE
from voltaloom.operators import spikes as S
from voltaloom.operators import windows as W
from voltaloom.plans.queries import DAILY, daily, query, r6, table


@query("WITH f AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(i AS BIGINT) AS frag_idx, i * 4.0::DOUBLE AS start_s, (i + 1) * 4.0::DOUBLE AS stop_s FROM f WHERE i < n - 1")
def q66_window_bounds(spark, d):
    f = SE.number_windows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"], drop_last=True)
    return SE.window_bounds(f, 4.0)


_FILES = "f AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders)"


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CAST('2024-01-01' AS TIMESTAMP) END, CAST(o_orderdate AS TIMESTAMP)) AS timestamp FROM orders")
def q67_finalise_timestamps(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("manual_ts"), F.col("o_orderdate").cast("timestamp_ntz").alias("csv_ts"))
    return SE.finalise_timestamps(o).select("o_orderkey", "timestamp")


@query(f"WITH {_FILES} SELECT o_custkey, o_orderkey, CAST('2024-01-01' AS TIMESTAMP) + to_hours(CAST(position AS INT)) AS end_ts FROM f")
def q68_listed_timestamps(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    given = SE.number_windows(o, ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("frag_idx").alias("position"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(frag_idx), 0, 0)").alias("ts"))
    return SE.listed_timestamps(o, "o_custkey", "o_orderkey", given).select("o_custkey", "o_orderkey", "end_ts")


_GAPS = "g AS (SELECT user_id, value, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events), m AS (SELECT user_id, median(value) AS median_s FROM events GROUP BY user_id)"


@query(f"WITH {_GAPS}, s AS (SELECT g.user_id, any_value(median_s) AS median_s, count(gap) AS intervals, CAST(coalesce(sum(CASE WHEN gap < median_s THEN 1 ELSE 0 END), 0) AS BIGINT) AS short FROM g JOIN m ON g.user_id = m.user_id GROUP BY g.user_id) SELECT user_id, round(median_s, 6) AS median_s, intervals, short, round(coalesce(100.0::DOUBLE * short / nullif(intervals, 0), 0), 6) AS percent FROM s")
def q69_short_intervals(spark, d):
    s = SE.short_intervals(table(spark, d, "events"), ["user_id"], "ts", "value", ["event_id"])
    return s.select("user_id", r6("median_s").alias("median_s"), "intervals", "short", r6("percent").alias("percent"))


@query("WITH s AS (SELECT o_custkey, o_orderpriority, CAST(count(*) AS BIGINT) AS seconds FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority, CAST(sum(seconds) OVER w - seconds AS BIGINT) AS begin_s, CAST(sum(seconds) OVER w AS BIGINT) AS end_s FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def q70_global_timeline(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("seconds"))
    return SE.global_timeline(s, "o_custkey", "o_orderpriority", "seconds").drop("seconds")


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS folders, count(DISTINCT o_orderstatus) AS n_folders FROM orders GROUP BY o_custkey")
def q71_group_folders(spark, d):
    return SE.group_folders(table(spark, d, "orders"), "o_custkey", "o_orderstatus").withColumn("folders", F.array_join("folders", ","))


@query("SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - l_quantity AS DOUBLE) AS offset_s FROM lineitem")
def q72_merge_recordings(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("n"), F.lit(1000).alias("fs"), F.lit("a,b").alias("channels"))
    return SE.merge_recordings(r, "l_orderkey", "l_linenumber", "n", ["fs", "channels"]).select("l_orderkey", "l_linenumber", F.col("offset").alias("offset_s"))


@query("WITH x AS (SELECT *, sum(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - l_quantity AS before FROM lineitem) SELECT l_orderkey, l_linenumber, before + l_quantity / 2 AS division_s FROM x WHERE l_linenumber % 2 = 0")
def q73_file_divisions(spark, d):
    q = F.col("l_quantity").cast("double")
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("n"), F.when(F.col("l_linenumber") % 2 == 0, q / 2).alias("endfile"))
    return SE.file_divisions(f, "l_orderkey", "l_linenumber", "n", "endfile").select("l_orderkey", "l_linenumber", "division_s")


_KEEP = "coalesce(abs((ln(nullif(rms, 0)) - avg(ln(nullif(rms, 0))) OVER r) / nullif(stddev_pop(ln(nullif(rms, 0))) OVER r, 0)) <= 3, true) AND coalesce(rms <= 500, true) AND coalesce(rms >= {least}, true) AND NOT coalesce(bool_or(share > 0.4) OVER w, false)"
_SHARE = f"{DAILY}, s AS (SELECT *, CASE WHEN channel = 'click' THEN rms / nullif(sum(rms) OVER (PARTITION BY animal, day), 0) END AS share FROM daily)"
_WINDOWS = "WINDOW r AS (PARTITION BY animal, channel), w AS (PARTITION BY animal, day)"
_BAD = "SELECT DISTINCT user_id AS animal, event_type AS channel FROM events WHERE user_id % 10 = 3 AND event_type IN ('view', 'error')"


def _shares(spark, d):
    w = SE.Window.partitionBy("animal", "day")
    return daily(spark, d).withColumn("beta_share", F.when(F.col("channel") == "click", F.try_divide(F.col("rms"), F.sum("rms").over(w)))).withColumn("animalday", F.col("animal"))


def _bad(spark, d):
    return table(spark, d, "events").where((F.col("user_id") % 10 == 3) & F.col("event_type").isin("view", "error")).select(F.col("user_id").alias("animalday"), F.col("event_type").alias("channel")).distinct()


@query(f"WITH {_SHARE}, bad AS ({_BAD}), k AS (SELECT animal, day, channel, {_KEEP.format(least=30)} AND channel <> 'error' AS k FROM s {_WINDOWS}) SELECT k.animal, k.day, k.channel, k.k AND bad.animal IS NULL AS keep FROM k LEFT JOIN bad ON k.animal = bad.animal AND k.channel = bad.channel")
def q74_filter_all(spark, d):
    return M.filter_all(_shares(spark, d), ["error"], _bad(spark, d), window=("animal", "day")).select("animal", "day", "channel", "keep")


@query(f"WITH {_SHARE}, bad AS ({_BAD}), k AS (SELECT animal, day, channel, {_KEEP.format(least=50)} AS k FROM s {_WINDOWS}) SELECT k.animal, k.day, k.channel, k.k AND bad.animal IS NULL AS keep FROM k LEFT JOIN bad ON k.animal = bad.animal AND k.channel = bad.channel")
def q75_default_filters(spark, d):
    return M.apply_filters(_shares(spark, d), bad=_bad(spark, d), window=("animal", "day")).select("animal", "day", "channel", "keep")


@query(f"WITH bad AS ({_BAD}), n AS (SELECT DISTINCT user_id AS animal, 'cart' AS channel FROM events WHERE user_id % 7 = 0) SELECT * FROM bad UNION SELECT * FROM n")
def q76_bad_channel_union(spark, d):
    new = table(spark, d, "events").where("user_id % 7 = 0").select(F.col("user_id").alias("animalday"), F.lit("cart").alias("channel"))
    return M.merge_bad(_bad(spark, d), new).withColumnRenamed("animalday", "animal")


@query(f"WITH {DAILY}, p AS (SELECT a.animal, a.day, a.channel, b.channel AS channel2, a.rms + b.rms AS value FROM daily a JOIN daily b ON a.animal = b.animal AND a.day = b.day), k AS (SELECT animal, day, channel, rms <= 100 AS keep FROM daily) SELECT p.animal, p.day, p.channel, p.channel2, round(CASE WHEN x.keep AND y.keep THEN value END, 6) AS value FROM p JOIN k x ON p.animal = x.animal AND p.day = x.day AND p.channel = x.channel JOIN k y ON p.animal = y.animal AND p.day = y.day AND p.channel2 = y.channel")
def q77_matrix_mask(spark, d):
    x = daily(spark, d).select("animal", "day", "channel", "rms")
    pairs = x.join(x.select("animal", "day", F.col("channel").alias("channel2"), F.col("rms").alias("rms2")), ["animal", "day"]).withColumn("value", F.col("rms") + F.col("rms2"))
    kept = x.withColumn("keep", F.col("rms") <= 100)
    return M.apply_pair_mask(pairs, kept, ["value"], ["animal", "day"]).select("animal", "day", "channel", "channel2", r6("value").alias("value"))


@query(f"WITH {DAILY} SELECT animal, day, channel, round(CASE WHEN n > 1 THEN rms END, 6) AS value FROM daily")
def q78_band_mask(spark, d):
    m = daily(spark, d).withColumn("bands", F.create_map("channel", "rms"))
    return M.apply_band_mask(m, ["bands"], F.col("n") > 1).select("animal", "day", "channel", r6(F.col("bands")[F.col("channel")]).alias("value"))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' AND o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderkey < 3)")
def q79_session_quality(spark, d):
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "Unknown").otherwise(F.col("c_mktsegment"))
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), segment.alias("genotype")), "o_custkey").withColumnRenamed("o_orderpriority", "folder")
    return M.session_quality(o, o.where("o_orderkey < 3")).select("o_orderkey")


_SCORES = "s AS (SELECT user_id AS animalday, event_type AS channel, avg(value) AS lof FROM events GROUP BY ALL)"


@query(f"WITH {_SCORES} SELECT animalday, channel, round(lof, 6) AS lof, lof > 60 AS predicted, animalday % 10 = 3 AND channel IN ('view', 'error') AS truth FROM s")
def q80_lof_evaluation(spark, d):
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("animalday"), F.col("event_type").alias("channel")).agg(A.exact_mean("value").alias("lof"))
    truth = s.where((F.col("animalday") % 10 == 3) & F.col("channel").isin("view", "error")).select("animalday", F.when(F.col("channel") == "view", "vw").otherwise(F.col("channel")).alias("channel"))
    judged = L.evaluate(s, truth, 60.0, {"view": "vw"})
    return judged.withColumns({"predicted": F.when(F.col("lof").isNotNull(), F.col("predicted")), "lof": r6("lof")})  # SQL knows no verdict without a score


@query(f"WITH {DAILY} SELECT animal, channel, round(avg(rms), 6) AS mean_lof, count(rms) AS days FROM daily GROUP BY ALL")
def q81_mean_scores(spark, d):
    return L.mean_scores(daily(spark, d), "animal", lof="rms").withColumn("mean_lof", r6("mean_lof"))


@query("WITH t(threshold) AS (SELECT unnest([-1.0, 100.0, 1000000000.0])), y AS (SELECT event_id, value AS s, CAST(event_type = 'purchase' AS INT) AS y FROM events), f AS (SELECT arg_min(y, event_id) AS first FROM y), c AS (SELECT threshold, sum(CASE WHEN s > threshold AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN s > threshold AND y = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT s > threshold AND y = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN NOT s > threshold AND y = 0 THEN 1 ELSE 0 END) AS tn FROM y, t GROUP BY threshold), p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 WHEN fn + tn = 0 THEN 1 END AS one, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c) SELECT CAST(threshold AS DOUBLE) AS threshold, round(CASE WHEN one IS NULL THEN p WHEN one = first THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS precision, round(CASE WHEN one IS NULL THEN r WHEN one = first THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS recall, round(CASE WHEN one IS NULL THEN coalesce(2 * p * r / nullif(p + r, 0), 0) WHEN one = first THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS f1 FROM p, f")
def q82_degenerate_sweep(spark, d):
    e = table(spark, d, "events").withColumn("y", (F.col("event_type") == "purchase").cast("int")).select("value", "y", "event_id")
    return L.sweep(e, "value", "y", [-1, 100, 1e9], "event_id").select("threshold", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {DAILY} SELECT animal, day, channel, round(rms, 6) AS rms, CAST(NULL AS DOUBLE) AS psdtotal FROM daily")
def q83_project_features(spark, d):
    x = SE.project_features(daily(spark, d), ["animal", "day", "channel"], ["rms", "psdtotal"], allow_missing=True)
    return SE.project_rows(x, ["animal", "day", "channel"], ["rms", "psdtotal", "animal"]).withColumn("rms", r6("rms"))


@query(f"WITH {DAILY} SELECT animal, count(*) AS n_windows, CAST(sum(n) AS BIGINT) AS seconds, count(DISTINCT day) AS n_sessions, count(DISTINCT channel) AS n_channels FROM daily GROUP BY animal")
def q84_info(spark, d):
    return SE.info(daily(spark, d), "animal", "day", "n", "channel")


@query("WITH a AS (SELECT user_id AS animal, event_id, value, NULL::VARCHAR AS kind FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id, NULL::DOUBLE, event_type FROM events WHERE event_type = 'error'), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT u.*, animal IN (SELECT user_id FROM events WHERE event_type = 'view') AND animal IN (SELECT user_id FROM events WHERE event_type = 'error') AS repeated FROM u")
def q85_union_sessions(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'view'").select(F.col("user_id").alias("animal"), "event_id", "value")
    b = e.where("event_type = 'error'").select(F.col("user_id").alias("animal"), "event_id", F.col("event_type").alias("kind"))
    return SE.union_sessions([a, b], "animal")


@query("SELECT DISTINCT 'o_orderstatus' AS \"column\", o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F') UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def q86_order_violations(spark, d):
    return SE.order_violations(table(spark, d, "orders"), {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]})


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS place FROM orders")
def q58_plot_order(spark, d):
    return table(spark, d, "orders").select("o_orderkey", SE.plot_order(F.col("o_orderstatus"), ["O", "F"]).cast("int").alias("place"))


@query(f"WITH {DAILY}, p AS (SELECT animal, day, max(ln(1 + rms)) FILTER (channel = 'view') AS a, max(ln(1 + rms)) FILTER (channel = 'click') AS b FROM daily GROUP BY ALL) SELECT animal, day, round(a / nullif(b, 0), 6) AS alphadelta FROM p")
def q87_alpha_delta(spark, d):
    b = daily(spark, d).groupBy("animal", "day").agg(F.map_from_entries(F.collect_list(F.struct("channel", F.log1p("rms")))).alias("bands"))
    return SE.band_ratio(b, "bands", "view", "click").select("animal", "day", r6("alphadelta").alias("alphadelta"))


@query("SELECT c_mktsegment, c_nationkey, count(DISTINCT c_custkey) AS n FROM customer GROUP BY ALL")
def q88_distinct_counts(spark, d):
    return SE.distinct_counts(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey")


@query("WITH a AS (SELECT DISTINCT o_custkey FROM orders), j AS (SELECT coalesce(o_custkey, c_custkey) AS k, o_custkey, c_custkey FROM a FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey) SELECT k, CASE WHEN o_custkey IS NULL THEN 'second' WHEN c_custkey IS NULL THEN 'first' ELSE 'both' END AS side FROM j")
def q89_key_difference(spark, d):
    return SE.key_difference(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("SELECT DISTINCT a.user_id, a.event_type AS a, b.event_type AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type < b.event_type")
def q90_key_pairs(spark, d):
    return SE.key_pairs(table(spark, d, "events"), ["user_id"], "event_type")


@query(f"WITH {DAILY} SELECT animal, day, channel, round(rms / nullif(sum(rms) OVER (PARTITION BY animal, day), 0), 6) AS normpsd FROM daily")
def q91_normalised_psd(spark, d):
    x = daily(spark, d)
    total = x.groupBy("animal", "day").agg(F.sum("rms").alias("psdtotal"))
    return SE.normalised_psd(x, total, ["animal", "day"], "rms").select("animal", "day", "channel", r6("normpsd").alias("normpsd"))


@query("SELECT o_orderkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'Unknown') AS genotype FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def q92_genotype_lookup(spark, d):
    known = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("animal"), F.col("c_mktsegment").alias("genotype"))
    return SE.with_genotype(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("animal")), known).select("o_orderkey", "genotype")


@query(f"WITH {DAILY} SELECT a.animal, a.day, round(a.rms, 6) AS first, round(b.rms, 6) AS second, round(b.rms - a.rms, 6) AS difference FROM daily a JOIN daily b ON a.animal = b.animal AND a.day = b.day WHERE a.channel = 'view' AND b.channel = 'click'")
def q93_compare_runs(spark, d):
    x = daily(spark, d)
    c = SE.compare_runs(x.where("channel = 'view'"), x.where("channel = 'click'"), ["animal", "day"], "rms")
    return c.select("animal", "day", *(r6(k).alias(k) for k in ("first", "second", "difference")))


@query(f"WITH {DAILY}, l AS (SELECT *, ln(CASE WHEN rms > 0 THEN rms END) AS x FROM daily) SELECT animal, day, channel, round((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 6) AS gz FROM l WINDOW w AS (PARTITION BY animal, channel)")
def q94_geometric_z(spark, d):
    return daily(spark, d).select("animal", "day", "channel", r6(ST.geometric_z("rms", ["animal", "channel"])).alias("gz"))


@query("WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings) SELECT label, CAST(place AS INT) AS place, round(avg(v::DOUBLE), 6) AS mean FROM x GROUP BY ALL")
def q95_mean_arrays(spark, d):
    return SE.mean_arrays(table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), ["label"], "embedding").withColumn("mean", r6("mean"))


_RANKS = "p AS (SELECT DISTINCT a.event_type, a.user_id % 3 AS a, b.user_id % 3 AS b FROM events a JOIN (SELECT DISTINCT event_type, user_id FROM events) b ON a.event_type = b.event_type WHERE a.user_id % 3 < b.user_id % 3), x AS (SELECT p.*, user_id % 3 AS g, value AS v FROM p JOIN events e ON p.event_type = e.event_type AND (user_id % 3 = a OR user_id % 3 = b)), k AS (SELECT *, rank() OVER (PARTITION BY event_type, a, b ORDER BY v) + (count(*) OVER (PARTITION BY event_type, a, b, v) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY event_type, a, b, v) AS t FROM x), s AS (SELECT event_type, a, b, sum(CASE WHEN g = a THEN rk END) AS r, sum(CASE WHEN g = a THEN 1 ELSE 0 END)::DOUBLE AS n1, count(*)::DOUBLE AS n, sum(t::DOUBLE * t - 1) AS ties FROM k GROUP BY ALL), u AS (SELECT *, n - n1 AS n2, r - n1 * (n1 + 1) / 2 AS u FROM s)"


@query(f"WITH {_RANKS} SELECT event_type, a, b, round(u, 3) AS u, round((u - n1 * n2 / 2 - 0.5 * sign(u - n1 * n2 / 2)) / nullif(sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 0), 5) AS z FROM u")
def q96_mann_whitney_pairs(spark, d):
    e = table(spark, d, "events").withColumn("g", F.col("user_id") % 3)
    return ST.mann_whitney_pairs(e.drop("g").withColumn("grp", F.col("user_id") % 3), "value", "grp", ["event_type"]).select("event_type", "a", "b", F.round("u", 3).alias("u"), F.round("z", 5).alias("z"))


@query("SELECT user_id, event_id, round((row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY user_id), 6) AS position FROM events WHERE value IS NOT NULL")
def q97_qq_points(spark, d):
    return ST.qq_points(table(spark, d, "events"), "value", ["user_id"], ["event_id"]).select("user_id", "event_id", r6("position").alias("position"))


_POLY = lambda ks: "(" * (len(ks) - 1) + repr(ks[0]) + "".join(f" * a + {k!r})" for k in ks[1:])
_PHI = f"exp(-a * a / 2) * CASE WHEN a < 7.07106781186547 THEN {_POLY([3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376])} / {_POLY([8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752])} ELSE 1 / ((a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65::DOUBLE))))) * 2.506628274631) END"


@query(f"WITH z AS (SELECT event_type, event_id, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY event_type)), r AS (SELECT event_type, z, abs(z) AS a, count(*) OVER (PARTITION BY event_type)::DOUBLE AS n, row_number() OVER (PARTITION BY event_type ORDER BY z, event_id) AS i FROM z), u AS (SELECT *, CASE WHEN z > 0 THEN 1 - {_PHI} ELSE {_PHI} END AS u FROM r) SELECT event_type, round(max(greatest(i / n - u, u - (i - 1) / n)), 6) AS ks FROM u GROUP BY event_type")
def q102_ks_normal(spark, d):
    e = table(spark, d, "events")
    m = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = e.join(m, "event_type").select("event_type", ((F.col("value") - F.col("m")) / F.col("s")).alias("z"))
    return ST.ks_statistic(z, "z", ST.normal_cdf, ["event_type"]).withColumn("ks", r6("ks"))


@query("SELECT l_returnflag, l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_partkey, l_extendedprice, l_linenumber) AS place, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem")
def q103_row_numbers(spark, d):
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_extendedprice", "l_linenumber"]
    rows = table(spark, d, "lineitem").select("l_returnflag", *order)
    return RK.row_numbers(rows, ["l_returnflag"], order, "place", "n").drop("l_shipdate", "l_linenumber")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY ALL")
def q104_exact_quantiles(spark, d):
    q = RK.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "median": 0.5, "p99": 0.99})
    return q.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("q1", "median", "p99")))


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events), w AS (SELECT *, (hi - lo) / (log2(n) + 1) AS s FROM e), b AS (SELECT *, CAST(ceil((hi - lo) / least(2 * iqr * pow(n, -1.0 / 3), s)) AS BIGINT) AS bins FROM w), c AS (SELECT least(CAST(floor((value - lo) / ((hi - lo) / bins)) AS BIGINT), bins - 1) AS bin, lo, hi, bins FROM events, b) SELECT bin, round(count(*) / (sum(count(*)) OVER () * any_value((hi - lo) / bins)), 6) AS density FROM c GROUP BY bin")
def q105_auto_histogram(spark, d):
    e = table(spark, d, "events").withColumn("w", F.lit(1.0))
    return A.weighted_histogram(e, "value", "w", *A.auto_bins(e, "value")).withColumn("density", r6("density"))


def _spikes(spark, d):
    return table(spark, d, "events").where("value > 150").select(F.col("user_id").alias("animalday"), F.col("event_type").alias("channel"), F.col("event_id").alias("sample_idx"))


@query("WITH c AS (SELECT DISTINCT user_id, event_type FROM events), s AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 150 AND event_id < 5000 GROUP BY ALL) SELECT c.user_id AS animalday, c.event_type AS channel, coalesce(n, 0) AS nspike, CAST(coalesce(sum(n) OVER (PARTITION BY c.user_id), 0) AS BIGINT) AS total FROM c LEFT JOIN s ON c.user_id = s.user_id AND c.event_type = s.event_type")
def q98_spike_counts(spark, d):
    channels = table(spark, d, "events").select(F.col("user_id").alias("animalday"), F.col("event_type").alias("channel"))
    return S.channel_counts(S.truncate(_spikes(spark, d), 5000), channels)


@query("SELECT user_id AS animalday, event_id AS sample_idx, (event_id + 1) / 1000.0::DOUBLE AS onset, 'Spike_Ch' || CASE event_type WHEN 'view' THEN '0' WHEN 'click' THEN '1' ELSE '-1' END AS description FROM events WHERE value > 150")
def q99_annotations(spark, d):
    return S.annotations(_spikes(spark, d), 1000.0, ["view", "click"]).select("animalday", "sample_idx", "onset", "description")


@query("SELECT o_custkey, min(o_orderstatus) AS status FROM (SELECT o_custkey, 'x' AS o_orderstatus FROM orders) GROUP BY o_custkey")
def q100_constant_columns(spark, d):
    return SE.constant_columns(table(spark, d, "orders").select("o_custkey", F.lit("x").alias("status")), ["o_custkey"], ["status"])


@query("SELECT l_orderkey, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts, CAST(sum(l_quantity) AS DOUBLE) AS seconds, count(*) AS n_files FROM lineitem GROUP BY l_orderkey")
def q101_timeline(spark, d):
    return W.timeline(table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("double")), "l_orderkey", "l_shipdate", "l_shipdate", "q")


def spike_pieces(spark, d):
    """Prices of a line number in order of their orders as a channel of one long recording, in pieces of 1000 samples."""
    rows = table(spark, d, "lineitem").select(F.lit("prices").alias("animalday"), F.col("l_linenumber").cast("string").alias("channel"), "l_orderkey", "l_partkey", "l_extendedprice")
    at = RK.row_numbers(rows, ["animalday", "channel"], ["l_orderkey", "l_partkey", "l_extendedprice"], "at").withColumn("at", F.col("at") - 1)
    start = F.floor(F.col("at") / 1000) * 1000
    pieces = at.groupBy("animalday", "channel", start.alias("start")).agg(F.array_sort(F.collect_list(F.struct("at", F.col("l_extendedprice").cast("double").alias("v")))).alias("s"))
    return pieces.select("animalday", "channel", "start", F.transform("s", lambda x: x["v"]).alias("signal"))


@query()
def q106_spikes_by_blocks(spark, d):
    return BS.detect(spike_pieces(spark, d), 512.0, step=16_384, percentile=99.0, vote=1)

"""Queries of the signal operators over the event and line-item tables, with their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.functions import numeric as N
from sonoframe.kernels import raster
from sonoframe.operators import gating, series
from sonoframe.streaming import levels

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, each: int) -> DataFrame:
    """Rows of a small file that cost much each, dealt over tasks of at most about `each` rows: a file alone would make one task."""
    n = rows.count()
    return rows.repartition(max(1, min(n, rows.sparkSession.sparkContext.defaultParallelism), -(-n // each)))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.sampled(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, w, rms): root mean square of a user's values in each hour that has any."""
    e = _t(spark, sf_dir, "events")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).alias("w")
    return e.groupBy(F.col("user_id").alias("key"), hour).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


S = "s AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS v FROM events)"
SN = S + ", n AS (SELECT *, max(i) OVER (PARTITION BY key) + 1 AS n FROM s)"
H = "h AS (SELECT user_id AS key, epoch_us(ts) // 3600000000 AS w, sqrt(avg(value * value)) AS rms FROM events GROUP BY ALL)"
LUFS = "CASE WHEN {0} > 0 THEN -0.691 + 10 * log10({0}) ELSE '-inf'::DOUBLE END"
P = f"""{SN}, b AS (SELECT DISTINCT key, n, unnest(range(0, (n - 4) + 1)) AS b FROM n WHERE n >= 4),
p AS (SELECT b.key, b.b, sum(v * v) / 4 AS power FROM b JOIN s ON s.key = b.key AND s.i >= b.b AND s.i < b.b + 4 GROUP BY ALL)"""


@query(f"WITH {H}, q AS (SELECT *, w - row_number() OVER (PARTITION BY key ORDER BY w) AS g FROM h WHERE rms < 20) SELECT key, min(w) AS start, max(w) + 1 AS stop FROM q GROUP BY key, g HAVING max(w) + 1 - min(w) >= 2")
def silence_regions(spark, sf_dir):
    return gating.silence_regions(hourly(spark, sf_dir), 20.0, 2)


@query(f"""WITH {H}, q AS (SELECT *, w - row_number() OVER (PARTITION BY key ORDER BY w) AS g FROM h WHERE rms < 40),
r AS (SELECT key, min(w) AS a, max(w) + 1 AS b FROM q GROUP BY key, g HAVING max(w) + 1 - min(w) >= 3),
e AS (SELECT key, min(w) AS a, max(w) + 1 AS b FROM h GROUP BY key),
c AS (SELECT key, a + 1 AS f, b - 1 AS t FROM r WHERE b - 1 > a + 1 UNION ALL SELECT key, a, a FROM e UNION ALL SELECT key, b, b FROM e),
l AS (SELECT key, t AS start, lead(f) OVER (PARTITION BY key ORDER BY f, t) AS stop FROM c)
SELECT key, start, stop FROM l WHERE stop > start""")
def keep_regions(spark, sf_dir):
    e = hourly(spark, sf_dir)
    return gating.keep_regions(e, gating.silence_regions(e, 40.0, 3), 1)


@query(f"WITH {S}, e AS (SELECT key, i // 8 AS w, sqrt(avg(v * v)) AS rms FROM s GROUP BY ALL) SELECT key, w, round(CASE WHEN rms > 0 THEN greatest(-80, 20 * log10(rms)) ELSE -80 END, 6) AS db FROM e")
def rms_envelope_db(spark, sf_dir):
    return series.envelope(samples(spark, sf_dir), 8).select("key", "w", F.round("db", 6).alias("db"))


@query(f"WITH {P} SELECT key, b, round({LUFS.format('power')}, 6) AS lufs FROM p")
def momentary_blocks(spark, sf_dir):
    return gating.block_powers(samples(spark, sf_dir), 4, 1).select("key", "b", F.round(N.power_lufs(F.col("power")), 6).alias("lufs"))


@query(f"""WITH {P}, o AS (SELECT *, avg(power) OVER (PARTITION BY key) AS u FROM p WHERE {LUFS.format('power')} > 10),
k AS (SELECT *, {LUFS.format('power')} > {LUFS.format('u')} - 2 AS inn FROM o)
SELECT key, count(*) FILTER (inn) AS gated, round({LUFS.format('coalesce(avg(power) FILTER (inn), any_value(u))')}, 6) AS loudness FROM k GROUP BY key
UNION ALL SELECT DISTINCT key, 0, NULL::DOUBLE FROM p WHERE key NOT IN (SELECT key FROM o)""")
def gated_energy(spark, sf_dir):
    return gating.gated_loudness(gating.block_powers(samples(spark, sf_dir), 4, 1), 10.0, -2.0).select("key", "gated", F.round("loudness", 6).alias("loudness"))


@query(f"""WITH {P}, l AS (SELECT key, {LUFS.format('power')} AS lv FROM p), a AS (SELECT *, 10 * log10(avg(pow(10, lv / 10)) OVER (PARTITION BY key)) - 20 AS g FROM l WHERE lv > -70),
k AS (SELECT key, list(lv ORDER BY lv) AS x FROM a WHERE lv > g GROUP BY key)
SELECT key, round(coalesce(x[floor(.95 * (len(x) - 1) + .5)::INT + 1] - x[floor(.1 * (len(x) - 1) + .5)::INT + 1], 0), 6) AS range FROM (SELECT DISTINCT key FROM p) LEFT JOIN k USING (key)""")
def loudness_range_nearest_rank(spark, sf_dir):
    return gating.loudness_range(gating.block_powers(samples(spark, sf_dir), 4, 1)).select("key", F.round("range", 6).alias("range"))


@query("SELECT l_returnflag, l_linestatus, max(abs(l_quantity)) AS peak, round(sqrt(avg(l_quantity * l_quantity)), 6) AS rms FROM lineitem GROUP BY ALL")
def peak_rms_by_key(spark, sf_dir):
    return series.levels(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("rms", F.round("rms", 6))


@query(f"WITH {SN} SELECT key, least(15, i // greatest(1, n // 16)) AS col, least(0, min(v)) AS min, greatest(0, max(v)) AS max, round(sqrt(avg(v * v)), 6) AS rms FROM n GROUP BY ALL")
def waveform_columns(spark, sf_dir):
    return series.waveform_columns(samples(spark, sf_dir), 16).withColumn("rms", F.round("rms", 6))


@query("SELECT l_returnflag, round(CASE WHEN sum(l_quantity * l_quantity) * sum(l_extendedprice * l_extendedprice) > 0 THEN sum(l_quantity * l_extendedprice) / sqrt(sum(l_quantity * l_quantity) * sum(l_extendedprice * l_extendedprice)) ELSE 1 END, 6) AS correlation FROM lineitem GROUP BY ALL")
def uncentred_correlation(spark, sf_dir):
    return series.correlation_about_zero(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("correlation", F.round("correlation", 6))


@query(f"WITH {H}, r AS (SELECT key, w, greatest(0, rms - lag(rms, 1, 0) OVER (PARTITION BY key ORDER BY w)) AS rise FROM h) SELECT key, w, round(rise, 6) AS rise, round(greatest(0, rise - avg(rise) OVER (PARTITION BY key)), 6) AS onset FROM r")
def onset_envelope(spark, sf_dir):
    return series.onset_envelope(hourly(spark, sf_dir)).select("key", "w", F.round("rise", 6).alias("rise"), F.round("onset", 6).alias("onset"))


@query(f"""WITH {H}, x AS (SELECT *, lag(rms, 2) OVER o AS a, lag(rms) OVER o AS b, lead(rms) OVER o AS d, lead(rms, 2) OVER o AS e FROM h WINDOW o AS (PARTITION BY key ORDER BY w))
SELECT key, w, round((coalesce(a, 0) + 2 * coalesce(b, 0) + 3 * rms + 2 * coalesce(d, 0) + coalesce(e, 0)) / (3 + CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 2 END + CASE WHEN d IS NULL THEN 0 ELSE 2 END + CASE WHEN e IS NULL THEN 0 ELSE 1 END), 6) AS smooth FROM x""")
def kernel_smoothing(spark, sf_dir):
    return series.smooth(hourly(spark, sf_dir), (1.0, 2.0, 3.0, 2.0, 1.0), "key", "w", "rms").select("key", "w", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {S} SELECT a.key, b.i - a.i AS lag, round(avg(a.v * b.v), 4) AS acf FROM s a JOIN s b ON a.key = b.key AND b.i - a.i BETWEEN 1 AND 8 GROUP BY ALL")
def autocorr_lags(spark, sf_dir):
    return series.autocorrelation(samples(spark, sf_dir), 8, "key", "i", "v").select("key", "lag", F.round("acf", 4).alias("acf"))


@query(f"WITH {SN} SELECT key, i, round(CASE WHEN max(abs(v)) OVER (PARTITION BY key) > 0 THEN v * pow(10, -1 / 20.0) / max(abs(v)) OVER (PARTITION BY key) ELSE v END, 6) AS v FROM n")
def normalize_peak(spark, sf_dir):
    return series.normalize_peak(samples(spark, sf_dir)).select("key", "i", F.round("v", 6).alias("v"))


@query(f"WITH {S} SELECT key, i, round(greatest(-100, least(100, v * pow(10, 6 / 20.0))), 6) AS v FROM s")
def gain_clip(spark, sf_dir):
    return series.gain(samples(spark, sf_dir), 6.0, 100.0).select("key", "i", F.round("v", 6).alias("v"))


@query(f"""WITH {SN}, f AS (SELECT *, least(10, n) AS a, least(20, n - least(10, n)) AS b FROM n)
SELECT key, i, round(v * CASE WHEN i < a THEN pow(i / a, 2) * (3 - 2 * i / a) ELSE 1 END * CASE WHEN n - 1 - i < b THEN pow((n - 1 - i) / b, 2) * (3 - 2 * (n - 1 - i) / b) ELSE 1 END, 6) AS v FROM f""")
def fade_curve(spark, sf_dir):
    return series.fade(samples(spark, sf_dir), 10, 20, "scurve").select("key", "i", F.round("v", 6).alias("v"))


@query(f"WITH {SN} SELECT key, n - 1 - i AS i, v FROM n")
def reverse_index(spark, sf_dir):
    return series.reverse(samples(spark, sf_dir))


@query(f"WITH {SN}, c AS (SELECT *, least(5, n) AS a, least(25, n) AS b FROM n) SELECT key, i - a AS i, v FROM c WHERE i >= a AND i < b UNION ALL SELECT DISTINCT key, 0, 0 FROM c WHERE a >= b")
def slice_range(spark, sf_dir):
    return series.slice_samples(samples(spark, sf_dir), F.lit(5), F.lit(25))


@query(f"WITH {S} SELECT key, CASE WHEN i >= 20 THEN i - 10 ELSE i END AS i, v FROM s WHERE i < 10 OR i >= 20")
def cut_out(spark, sf_dir):
    return series.cut_out(samples(spark, sf_dir), 10, 20)


@query(f"WITH {S}, t AS (SELECT *, min(i) FILTER (abs(v) > pow(10, 1.5)) OVER (PARTITION BY key) AS a, max(i) FILTER (abs(v) > pow(10, 1.5)) OVER (PARTITION BY key) AS b FROM s) SELECT key, i - coalesce(a, 0) AS i, v FROM t WHERE i >= coalesce(a, 0) AND i <= coalesce(b, 0)")
def trim_ends(spark, sf_dir):
    return series.trim_ends(samples(spark, sf_dir), 30.0)


@query(f"WITH {SN}, e AS (SELECT DISTINCT key, n FROM n) SELECT key, i + 3 AS i, v FROM s UNION ALL SELECT key, unnest(range(3)), 0 FROM e UNION ALL SELECT key, unnest(range(n + 3, n + 5)), 0 FROM e")
def pad_silence(spark, sf_dir):
    return series.pad_silence(samples(spark, sf_dir), 3, 2)


@query(f"WITH {SN}, e AS (SELECT DISTINCT key, n FROM n) SELECT key, k * (n + 2) + i AS i, v FROM n, range(3) t(k) UNION ALL SELECT key, k * (n + 2) + n + g, 0 FROM e, range(2) t(k), range(2) u(g)")
def loop_repeat(spark, sf_dir):
    return series.loop(samples(spark, sf_dir), 3, 2)


def _lengths(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("key").agg((F.max("i") + 1).alias("n"))


@query(f"WITH {S}, e AS (SELECT key, max(i) + 1 AS n FROM s GROUP BY key) SELECT key, p AS part, floor(n * p / 7 + .5)::BIGINT AS start, floor(n * (p + 1) / 7 + .5)::BIGINT AS stop FROM e, range(7) t(p)")
def split_equal(spark, sf_dir):
    return series.split_equal(_lengths(spark, sf_dir), 7)


@query(f"WITH {S}, e AS (SELECT key, max(i) + 1 AS n FROM s GROUP BY key), c AS (SELECT *, greatest(1, ceil((n - 3) / 12))::BIGINT AS m FROM e), k AS (SELECT *, unnest(range(m)) AS p FROM c) SELECT key, p AS part, p * 12 AS start, CASE WHEN p = m - 1 THEN n ELSE (p + 1) * 12 END AS stop FROM k")
def split_length(spark, sf_dir):
    return series.split_length(_lengths(spark, sf_dir), 12, 3)


@query(f"WITH {S} SELECT key, i, v FROM s WHERE i % 7 = 0")
def stride_sample(spark, sf_dir):
    return series.stride_sample(samples(spark, sf_dir), 7)


@query(f"WITH {S}, e AS (SELECT key, max(i) + 1 AS n, least(8, max(i) + 1) AS z FROM s GROUP BY key) SELECT DISTINCT key, greatest(0, least(n - z, floor(n * c - z / 2 + .5)))::BIGINT AS start, greatest(0, least(n - z, floor(n * c - z / 2 + .5)))::BIGINT + z AS stop FROM e, (VALUES (0.2::DOUBLE), (0.5), (0.8)) t(c)")
def probe_sample(spark, sf_dir):
    return series.probe_ranges(_lengths(spark, sf_dir), 8)


@query("""WITH d AS (SELECT source, doc_id, n_chars, row_number() OVER o AS r, lag(n_chars, 1, 0) OVER o AS p FROM documents WINDOW o AS (PARTITION BY source ORDER BY doc_id)),
k AS (SELECT *, CASE WHEN r = 1 THEN 0 ELSE least(500, n_chars, p) END AS sh FROM d)
SELECT source, doc_id, (sum(n_chars - sh) OVER (PARTITION BY source ORDER BY doc_id) - n_chars)::BIGINT AS start FROM k""")
def concat_offsets(spark, sf_dir):
    return series.concat_offsets(_t(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 500, block=64).select("source", "doc_id", "start")


@query(f"WITH {S}, k AS (SELECT key, list(v ORDER BY v) AS x FROM s GROUP BY key) SELECT key, x[floor(.95 * (len(x) - 1) + .5)::INT + 1] AS p95, x[floor(.1 * (len(x) - 1) + .5)::INT + 1] AS p10 FROM k")
def nearest_rank_levels(spark, sf_dir):
    return N.nearest_rank(samples(spark, sf_dir), ["key"], "v", {"p95": 0.95, "p10": 0.1})


@query("SELECT l_linestatus, round(sqrt(avg(pow((l_quantity + l_discount * 100) / 2, 2))), 6) AS mid, round(sqrt(avg(pow((l_quantity - l_discount * 100) / 2, 2))), 6) AS side, round(max(abs((l_quantity + l_discount * 100) / 2) + abs((l_quantity - l_discount * 100) / 2) * 1.5), 6) AS peak FROM lineitem GROUP BY ALL")
def mid_side_levels(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").withColumn("r", F.col("l_discount") * 100)
    return series.mid_side(l, ["l_linestatus"], "l_quantity", "r", 1.5).select("l_linestatus", *[F.round(c, 6).alias(c) for c in ("mid", "side", "peak")])


@query("SELECT l_linestatus, round(20 * log10(sqrt(avg(pow(l_extendedprice, 2))) / sqrt(avg(pow(l_quantity, 2)))), 6) AS reduction_db FROM lineitem GROUP BY ALL")
def noise_reduction_db(spark, sf_dir):
    return series.reduction_db(_t(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice", "l_quantity").withColumn("reduction_db", F.round("reduction_db", 6))


@query(f"WITH {H}, m AS (SELECT *, w // 12 AS g, avg(rms) OVER (PARTITION BY key, w // 12) AS a FROM h), q AS (SELECT key, g, count(*) FILTER (rms < a / 2) / count(*) AS share FROM m GROUP BY key, g) SELECT key, round(avg(share), 6) AS gaps FROM q GROUP BY key")
def gap_share(spark, sf_dir):
    return gating.gap_share(hourly(spark, sf_dir), 12).withColumn("gaps", F.round("gaps", 6))


@query("""WITH a AS (SELECT l_orderkey AS key, l_linenumber AS i, l_quantity / 50 AS v, l_linenumber % 2 AS c FROM lineitem),
s AS (SELECT l_orderkey AS key, 0 AS channel, l_linenumber AS i, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, 1, l_linenumber, l_discount FROM lineitem UNION ALL SELECT l_orderkey, 2, l_linenumber, l_tax FROM lineitem UNION ALL SELECT l_orderkey, 3, l_linenumber, l_quantity / 2 FROM lineitem)
SELECT key, channel % 2 AS channel, i, round(sum(v * .5), 6) AS v FROM s GROUP BY ALL""")
def channel_fold(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    parts = F.array(*[F.struct(F.lit(k).alias("channel"), v.cast("double").alias("v")) for k, v in enumerate((F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 2))])
    s = l.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("i"), F.explode(parts).alias("p")).select("key", "i", "p.channel", "p.v")
    return series.fold_to_stereo(s, 4).select("key", "channel", "i", F.round("v", 6).alias("v"))


@query(f"""WITH {H}, q AS (SELECT *, w - row_number() OVER (PARTITION BY key ORDER BY w) AS g FROM h WHERE rms < 40),
r AS (SELECT key, min(w) AS a, max(w) + 1 AS b FROM q GROUP BY key, g HAVING max(w) + 1 - min(w) >= 1), e AS (SELECT key, min(w) AS o, (max(w) + 1 - min(w))::DOUBLE AS sec FROM h GROUP BY key),
c AS (SELECT key, sec, k, sec * k / 4 AS nom FROM e, range(1, 4) t(k)),
m AS (SELECT c.key, sec, k, nom, arg_min((a + b) / 2 - o, (-(b - a), a)) FILTER (abs((a + b) / 2 - o - nom) <= least(sec / 4 * .08, 45)) AS best FROM c JOIN e USING (key, sec) LEFT JOIN r ON r.key = c.key GROUP BY c.key, sec, k, nom),
f AS (SELECT key, sec, max(nom) FILTER (k = 1) AS n1, max(best) FILTER (k = 1) AS b1, max(nom) FILTER (k = 2) AS n2, max(best) FILTER (k = 2) AS b2, max(nom) FILTER (k = 3) AS n3, max(best) FILTER (k = 3) AS b3 FROM m GROUP BY key, sec),
g AS (SELECT *, CASE WHEN b1 > .5 THEN b1 ELSE n1 END AS p1, CASE WHEN b1 > .5 THEN 1 ELSE 0 END AS s1 FROM f), h2 AS (SELECT *, CASE WHEN b2 > p1 + .5 THEN b2 ELSE n2 END AS p2, CASE WHEN b2 > p1 + .5 THEN 1 ELSE 0 END AS s2 FROM g)
SELECT key, p1, p2, CASE WHEN b3 > p2 + .5 THEN b3 ELSE n3 END AS p3, s1 + s2 + CASE WHEN b3 > p2 + .5 THEN 1 ELSE 0 END AS snapped FROM h2""")
def snap_cuts(spark, sf_dir):
    e = hourly(spark, sf_dir)
    extent = e.groupBy("key").agg(F.min("w").alias("o"), (F.max("w") + 1 - F.min("w")).cast("double").alias("seconds"))
    quiet = gating.silence_regions(e, 40.0, 1).join(extent, "key").select("key", (F.col("start") - F.col("o")).alias("start"), (F.col("stop") - F.col("o")).alias("stop"))
    out = gating.snap_cuts(extent.select("key", "seconds"), quiet, 4)
    return out.select("key", *[F.element_at("points", k + 1).alias(f"p{k}") for k in (1, 2, 3)], "snapped")


@query("""WITH e AS (SELECT user_id AS key, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t) < 7200000000 THEN 0 ELSE 1 END AS f FROM e), s AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY t) AS k FROM g)
SELECT key, min(t) AS start, max(t) + 7200000000 AS stop, count(*) AS n FROM s GROUP BY key, k""")
def quiet_sessions(spark, sf_dir):
    found = levels.quiet_sessions(_t(spark, sf_dir, "events"), gap="2 hours")
    return found.select("key", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n")


@query("SELECT user_id AS key, epoch_us(date_trunc('hour', ts)) AS start, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY ALL")
def event_levels(spark, sf_dir):
    return levels.event_levels(_t(spark, sf_dir, "events")).select("key", F.unix_micros("start").alias("start"), F.round("rms", 6).alias("rms"))


ST = "s AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS l, value * (event_id % 7 - 3) / 3 AS r FROM events), n AS (SELECT key, max(i) + 1 AS n FROM s GROUP BY key)"


def stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, i, l, r): a user's values, and the same at a gain and side that changes from event to event."""
    e = _t(spark, sf_dir, "events").withColumn("both", F.struct(F.col("value").alias("l"), (F.col("value") * (F.col("event_id") % 7 - 3) / 3).alias("r")))
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("key"), i.cast("long").alias("i"), "both.l", "both.r")


def _spread(size: int, most: int) -> str:
    """SQL of evenly spread blocks: (key, b, start)."""
    return f"""b AS (SELECT key, n, least({most}, greatest(1, n // {size})) AS blocks FROM n WHERE n >= {size}),
p AS (SELECT key, k AS b, least(n - {size}, k * (n - {size}) // greatest(1, blocks - 1)) AS start FROM (SELECT *, unnest(range(blocks)) AS k FROM b))"""


@query(f"""WITH {ST}, {_spread(5, 6)}, c AS (SELECT p.key, b, sum(l * r) AS lr, sum(l * l) AS ll, sum(r * r) AS rr FROM p JOIN s ON s.key = p.key AND i >= start AND i < start + 5 GROUP BY ALL),
v AS (SELECT key, CASE WHEN sqrt(ll * rr) > 1e-12 THEN lr / sqrt(ll * rr) ELSE 0 END AS c, ll + rr AS e FROM c)
SELECT key, count(*) AS blocks, round(CASE WHEN sum(e) > 0 THEN sum(c * e) / sum(e) ELSE 0 END, 6) AS overall, round(min(c), 6) AS least FROM v GROUP BY key""")
def block_correlation(spark, sf_dir):
    c = series.overall_correlation(series.block_correlation(stereo(spark, sf_dir), 5, 6))
    return c.select("key", "blocks", F.round("overall", 6).alias("overall"), F.round("least", 6).alias("least"))


@query(f"""WITH {ST}, {_spread(16, 3)}, f AS (SELECT p.key, p.b, i - start AS q, (l + r) / 2 * (.5 - .5 * cos(2 * pi() * (i - start) / 16)) AS m, (l - r) / 2 * (.5 - .5 * cos(2 * pi() * (i - start) / 16)) AS d FROM p JOIN s ON s.key = p.key AND i >= start AND i < start + 16),
z AS (SELECT key, b, k, pow(sum(m * cos(2 * pi() * k * q / 16)), 2) + pow(sum(m * sin(2 * pi() * k * q / 16)), 2) AS mid, pow(sum(d * cos(2 * pi() * k * q / 16)), 2) + pow(sum(d * sin(2 * pi() * k * q / 16)), 2) AS side FROM f, range(8) t(k) GROUP BY ALL),
e AS (SELECT key, k, sum(mid) AS mid, sum(side) AS side FROM z GROUP BY ALL), o AS (SELECT unnest([63, 125, 250, 500, 1000, 2000, 4000, 8000, 16000]) AS hz),
g AS (SELECT key, hz, coalesce(sum(mid) FILTER (k BETWEEN greatest(1, floor(hz / sqrt(2) / 125)) AND least(7, ceil(hz * sqrt(2) / 125))), 0) AS mid, coalesce(sum(side) FILTER (k BETWEEN greatest(1, floor(hz / sqrt(2) / 125)) AND least(7, ceil(hz * sqrt(2) / 125))), 0) AS side FROM e, o GROUP BY key, hz),
t AS (SELECT key, max(mid + side) AS top FROM g GROUP BY key), w AS (SELECT key, sum(side) / sum(mid + side) AS lost FROM e WHERE k >= 1 GROUP BY key)
SELECT g.key, hz, round(CASE WHEN mid + side > 0 AND mid + side >= top / 10000 THEN side / (mid + side) END, 6) AS share, round(lost, 6) AS lost FROM g JOIN t USING (key) JOIN w USING (key)""")
def side_shares(spark, sf_dir):
    found = series.side_shares(stereo(spark, sf_dir), 2000, 16, 3)
    return found.select("key", "hz", F.round("share", 6).alias("share"), F.round("lost", 6).alias("lost"))


@query(f"""WITH {S}, n AS (SELECT key, max(i) + 1 AS n FROM s GROUP BY key), w AS (SELECT key, i // 3 AS w, max(abs(v)) AS peak FROM s GROUP BY ALL),
k AS (SELECT key, peak, row_number() OVER (PARTITION BY key ORDER BY peak) - 1 AS r, count(*) OVER (PARTITION BY key) AS m FROM w JOIN n USING (key) WHERE (w + 1) * 3 <= n AND peak > 1e-5)
SELECT n.key, round(coalesce(20 * log10(max(peak) FILTER (r = least(m - 1, floor(m * .95)))), -60), 6) AS level FROM n LEFT JOIN k ON k.key = n.key GROUP BY n.key""")
def typical_level(spark, sf_dir):
    return series.typical_level(samples(spark, sf_dir), 3).select("key", F.round("level", 6).alias("level"))


@query(f"""WITH {ST}, t AS (SELECT key, n, floor(n / least(20, n)) + 1 AS stride FROM n)
SELECT s.key, (i // stride)::BIGINT AS k, l, round(r, 6) AS r FROM s JOIN t ON t.key = s.key WHERE i % stride = 0 AND i + 1 < n AND i // stride < floor(n / stride)""")
def strided_pairs(spark, sf_dir):
    s = stereo(spark, sf_dir)
    return series.strided_pairs(s, s.groupBy("key").agg((F.max("i") + 1).alias("n")), 20).select("key", "k", "l", F.round("r", 6).alias("r"))


@query(f"""WITH {S}, c AS (SELECT key, i // 4 AS col, min(v / 100 - .5) AS low, max(v / 100 - .5) AS high, sqrt(avg(pow(v / 100 - .5, 2))) AS rms FROM s GROUP BY ALL),
y AS (SELECT key, col // 8 AS tile, col, floor((1 - least(1, greatest(-1, high))) / 2 * 31 + .5) AS top, floor((1 - least(1, greatest(-1, low))) / 2 * 31 + .5) AS bottom, floor((1 - least(1, rms)) / 2 * 31 + .5) AS inner_top, floor((1 + least(1, rms)) / 2 * 31 + .5) AS inner_bottom FROM c)
SELECT key, tile, count(*)::INTEGER AS columns, sum(bottom - top + 1)::BIGINT AS lit, sum(greatest(0, least(bottom, inner_bottom) - greatest(top, inner_top) + 1))::BIGINT AS bright FROM y GROUP BY key, tile""")
def waveform_tiles(spark, sf_dir):
    """Pictures of users' values, eight columns of four each: lit and bright pixels, counted in the files that were drawn."""
    s = samples(spark, sf_dir).withColumn("v", F.col("v") / 100 - 0.5)
    columns = s.groupBy("key", F.floor(F.col("i") / 4).alias("col")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))

    def counted(batches):
        for batch in batches:
            greys = [raster.pixels(x) for x in batch.column("png").to_pylist()]
            counts = [pa.array([int((g >= level).sum()) for g in greys], pa.int64()) for level in (raster.REACH, raster.BODY)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tile"), batch.column("columns"), *counts], ["key", "tile", "columns", "lit", "bright"])

    tiles = series.waveform_tiles(columns, 8, 32)
    return tiles.mapInArrow(counted, f"key {tiles.schema['key'].dataType.simpleString()}, tile long, columns int, lit long, bright long")

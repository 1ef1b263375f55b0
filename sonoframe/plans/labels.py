"""Queries of labels, names, error classes, small planning rules and axis steps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.functions import delivery, text as T
from sonoframe.operators import catalog, series
from sonoframe.plans.signal import _t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT p_partkey AS key, CASE WHEN r = floor(r) THEN floor(r)::BIGINT || ' kHz' ELSE printf('%.1f', r) || ' kHz' END AS rate, CASE p_size % 4 WHEN 1 THEN 'Mono' WHEN 2 THEN 'Stereo' ELSE p_size % 4 || ' channels' END AS channels,
CASE WHEN d > 0 THEN '+' WHEN d < 0 THEN '−' ELSE '' END || printf('%.1f', abs(d)) || ' dB' AS db FROM (SELECT *, (p_size * 500 + 8000) / 1000::DOUBLE AS r, (p_size - 25) / 2::DOUBLE AS d FROM part)""")
def unit_labels(spark, sf_dir):
    z = F.col("p_size")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), T.rate_label(z * 500 + 8000).alias("rate"), T.channel_label(z % 4).alias("channels"), T.db_label((z - 25) / 2).alias("db"))


@query("""WITH d AS (SELECT p_partkey AS key, replace(p_name, ' ', '_') AS n, p_size FROM part) SELECT key, upper(substr(replace(n, '_', ' '), 1, 1)) || substr(replace(n, '_', ' '), 2) AS title,
n || CASE WHEN lower(n) LIKE '%-cut' THEN '' ELSE '-cut' END || '.mp3' AS output, n || '-part-' || lpad((p_size % 9 + 1)::VARCHAR, length((p_size + 9)::VARCHAR)::INTEGER, '0') || '-of-' || (p_size + 9) AS part FROM d""")
def export_names(spark, sf_dir):
    n = F.regexp_replace("p_name", " ", "_")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), T.title(n).alias("title"), T.output_name(F.concat(n, F.lit(".wav")), "cut", "mp3").alias("output"), T.part_name(n, F.col("p_size") % 9 + 1, F.col("p_size") + 9).alias("part"))


_SAID = {0: "Error: Array buffer allocation failed", 1: "TypeError: Failed to fetch dynamically imported module: blob:http://x/y", 2: "EncodingError: Unable to decode audio data", 3: "AbortError: stopped", 4: "could not open my song.mp3 today", 5: "plain   words\tonly"}


@query(f"""WITH m AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{v}')" for k, v in _SAID.items())}) t(k, s)), e AS (SELECT event_id, s, regexp_replace(s, '(?i)\\b(?:blob|data|file):[^\\s)"'']+', '<url>', 'g') AS c FROM events JOIN m ON event_id % 6 = k)
SELECT event_id, CASE WHEN regexp_extract(s, '^([A-Za-z]*Error|[A-Za-z]*Exception)\\b', 1) = '' THEN 'string' ELSE regexp_extract(s, '^([A-Za-z]*Error|[A-Za-z]*Exception)\\b', 1) END AS name,
CASE WHEN c LIKE '%.mp3%' THEN '<redacted: possible filename>' ELSE trim(regexp_replace(c, '\\s+', ' ', 'g')) END AS message,
CASE event_id % 6 WHEN 0 THEN 'out-of-memory' WHEN 1 THEN 'model-load-failed' WHEN 2 THEN 'decode-failed' WHEN 3 THEN 'cancelled' ELSE 'unknown-error' END AS code FROM e""")
def error_classes(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(v) for v in _SAID.values()]), (F.col("event_id") % 6).cast("int") + 1)
    return _t(spark, sf_dir, "events").select("event_id", said.alias("s")).select("event_id", T.error_name(F.col("s")).alias("name"), T.error_message(F.col("s")).alias("message"), T.error_code(F.col("s")).alias("code"))


_KINDS = ["song.mp3", "notes.txt", "film.MKV", "noext", "x.pdf"]


@query(f"SELECT p_partkey AS key, CASE WHEN p_size % 3 = 0 THEN true ELSE {_KINDS!r}[p_partkey % 5 + 1] IN ('song.mp3', 'film.MKV') END AS media FROM part")
def media_sniff(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (F.col("p_partkey") % 5).cast("int") + 1)
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), T.is_media(name, F.when(F.col("p_size") % 3 == 0, "audio/x").otherwise(F.lit(None))).alias("media"))


@query("""WITH d AS (SELECT o_orderkey AS key, o_totalprice AS b, o_totalprice * (.5 + (o_orderkey % 100) / 100::DOUBLE) AS a FROM orders), p AS (SELECT *, floor((a - b) / b * 100 + .5)::BIGINT AS d FROM d)
SELECT key, CASE WHEN abs(d) < 3 THEN 'about the same' WHEN d > 0 THEN d || '% larger' ELSE abs(d) || '% smaller' END AS change FROM p""")
def size_changes(spark, sf_dir):
    b = F.col("o_totalprice")
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), delivery.size_change(b, b * (0.5 + (F.col("o_orderkey") % 100) / 100)).alias("change"))


@query("SELECT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN 48000 ELSE 8000 + p_size * 700 END::BIGINT AS rate FROM part")
def output_rates(spark, sf_dir):
    fmt = F.when(F.col("p_size") % 2 == 0, "opus").otherwise("wav")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), delivery.output_rate(fmt, F.lit(128), (8000 + F.col("p_size") * 700), F.lit(2)).alias("rate"))


@query("""WITH d AS (SELECT l_orderkey AS key, l_linenumber AS i, l_quantity / 40 AS l, l_discount * 10 AS r FROM lineitem), m AS (SELECT *, (l + r) / 2 AS mid, (l - r) / 2 * 1.5 AS side FROM d)
SELECT key, i, round(greatest(-1, least(1, mid + side)), 6) + 0 AS l, round(greatest(-1, least(1, mid - side)), 6) + 0 AS r FROM m""")
def stereo_width(spark, sf_dir):
    s = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("i"), (F.col("l_quantity") / 40).alias("l"), (F.col("l_discount") * 10).alias("r"))
    return series.stereo_width(s, "l", "r", 1.5).select("key", "i", (F.round("l", 6) + 0.0).alias("l"), (F.round("r", 6) + 0.0).alias("r"))


@query(f"SELECT p_partkey AS key, f AS format, CASE t WHEN 0 THEN 'frames' WHEN 1 THEN 'blocks' ELSE CASE WHEN p_size % 7 = 0 AND f IN ('m4a', 'm4r', 'aac') THEN 'platform' ELSE 'core' END END AS engine FROM part JOIN (VALUES {', '.join(f'({k}, {n!r}, {v[1]})' for k, (n, v) in enumerate(delivery.FORMATS.items()))}) x(k, f, t) ON p_partkey % {len(delivery.FORMATS)} = k")
def export_engines(spark, sf_dir):
    fmt = F.element_at(F.array(*[F.lit(x) for x in delivery.FORMATS]), (F.col("p_partkey") % len(delivery.FORMATS)).cast("int") + 1)
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), fmt.alias("format"), delivery.export_engine(fmt, F.col("p_size") % 7 == 0).alias("engine"))


@query("""SELECT '{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '","keywords":' || to_json(list_slice(string_split(p_name, ' '), 1, 12))::VARCHAR || '}' AS json FROM part WHERE p_size % 5 <> 0""")
def machine_catalog(spark, sf_dir):
    entries = _t(spark, sf_dir, "part").withColumns({"secondary": F.col("p_size") % 5 == 0, "keywords": F.split("p_name", " ")})
    return catalog.machine_readable(entries, ["p_partkey", "p_brand", "keywords"])


@query("""WITH e AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_size % 5 <> 0 AND p_partkey % 3 <> 0) SELECT p_partkey AS key, p_brand AS name, s_suppkey AS action FROM e LEFT JOIN supplier ON s_suppkey = p_partkey""")
def action_catalog(spark, sf_dir):
    entries = _t(spark, sf_dir, "part").withColumn("secondary", F.col("p_size") % 5 == 0).where("p_partkey % 3 != 0")
    return catalog.with_actions(entries, _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_suppkey").alias("action")), "p_partkey").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("name"), "action")


@query("""WITH d AS (SELECT o_orderkey AS key, o_totalprice / 1000 AS span FROM orders), p AS (SELECT *, pow(10, floor(log10(span / 8))) AS b FROM d)
SELECT key, round(CASE WHEN span / 8 <= b THEN b WHEN span / 8 <= 2 * b THEN 2 * b WHEN span / 8 <= 5 * b THEN 5 * b ELSE 10 * b END, 6) AS step FROM p""")
def nice_steps(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.round(T.nice_step(F.col("o_totalprice") / 1000, 8), 6).alias("step"))


@query("""WITH d AS (SELECT o_orderkey AS key, o_totalprice / 1000 AS s FROM orders) SELECT key, (SELECT min(x) FROM (SELECT unnest([.1, .2, .5, 1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 1800, 3600]::DOUBLE[]) AS x) WHERE x >= s / 10 OR x = 3600) AS step FROM d""")
def time_steps(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), T.time_step(F.col("o_totalprice") / 1000, 10).alias("step"))


@query("""WITH s AS (SELECT p_partkey % 50 AS key, p_partkey AS scan, p_size % 20 AS a, p_size % 20 + p_size AS b, p_retailprice AS step FROM part), c AS (SELECT DISTINCT key, unnest(range(0, 40, 4)) AS pos FROM s)
SELECT c.key, c.pos AS "at", arg_min(scan, (step, scan)) AS scan FROM c JOIN s ON s.key = c.key AND a <= pos AND b >= pos + 4 GROUP BY c.key, c.pos""")
def finest_covering(spark, sf_dir):
    s = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("key"), F.col("p_partkey").alias("scan"), (F.col("p_size") % 20).alias("start"), (F.col("p_size") % 20 + F.col("p_size")).alias("stop"), F.col("p_retailprice").alias("step"))
    return series.finest_covering(s, [(k, k + 4) for k in range(0, 40, 4)])

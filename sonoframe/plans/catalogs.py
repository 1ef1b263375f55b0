"""Queries of catalog, transcript and text operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.functions import text as X
from sonoframe.operators import catalog, transcript
from sonoframe.sources import integrity

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


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing') AND lang = 'en'")
def token_search(spark, sf_dir):
    return catalog.search(_t(spark, sf_dir, "documents"), F.col("text"), "The  ING", "en", "lang").select("doc_id", "source")


@query("SELECT source, count(*) AS n FROM documents WHERE contains(lower(text), 'que') GROUP BY source")
def category_counts(spark, sf_dir):
    return catalog.categories(catalog.search(_t(spark, sf_dir, "documents"), F.col("text"), "que"), "source")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def registry_missing(spark, sf_dir):
    return catalog.missing(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def registry_orphans(spark, sf_dir):
    used = _t(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return catalog.missing(_t(spark, sf_dir, "supplier"), used, "s_suppkey").select("s_suppkey")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def registry_duplicates(spark, sf_dir):
    return catalog.duplicates(_t(spark, sf_dir, "part"), "p_name")


@query("""WITH e AS (SELECT p_partkey, p, r FROM part, LATERAL (SELECT unnest([0, 1, 2]) AS p, unnest([p_partkey + 1, p_partkey * 2, p_partkey + 1000000]) AS r))
SELECT p_partkey, p::INTEGER AS position, r AS related FROM e WHERE r IN (SELECT p_partkey FROM part)""")
def related_edges(spark, sf_dir):
    k = F.col("p_partkey")
    return catalog.related(_t(spark, sf_dir, "part").select("p_partkey", F.array(k + 1, k * 2, k + 1000000).alias("links")), "p_partkey", "links")


@query("""SELECT doc_id, (SELECT arg_min(o, (abs(n_chars - o), i)) FROM (VALUES (0, 3000.0::DOUBLE), (1, 500.0), (2, 1000.0), (3, 2000.0)) t(i, o)) AS option FROM documents""")
def nearest_option(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", catalog.nearest_option(F.col("n_chars"), (3000, 500, 1000, 2000)).alias("option"))


def _chunks(spark, sf_dir) -> DataFrame:
    """Turns as chunks: 3 seconds each on a clock of 5 seconds, some times missing or reversed."""
    t = F.col("turn")
    start = F.when((t * 7 + F.col("conv_id")) % 5 == 0, F.lit(None)).otherwise(t * 5.0)
    stop = F.when((t + F.col("conv_id")) % 4 == 0, F.lit(None)).when(t % 6 == 5, t * 5.0 - 1).otherwise(t * 5.0 + 3 + F.col("conv_id") % 2)
    c = _t(spark, sf_dir, "conversations")
    text = F.concat(F.lit(" "), "text")
    clip = c.groupBy("conv_id").agg(F.max(t * 5.0 + 4).alias("total"))
    return c.join(clip, "conv_id").select(F.col("conv_id").alias("clip"), t.alias("idx"), start.alias("start"), stop.alias("stop"), text.alias("text"), "total")


_CHUNKS = """k AS (SELECT conv_id AS clip, turn AS idx, CASE WHEN (turn * 7 + conv_id) % 5 = 0 THEN NULL ELSE turn * 5.0::DOUBLE END AS start, CASE WHEN (turn + conv_id) % 4 = 0 THEN NULL WHEN turn % 6 = 5 THEN turn * 5.0::DOUBLE - 1 ELSE turn * 5.0::DOUBLE + 3 + conv_id % 2 END AS stop,
 trim(' ' || text, ' ') AS text, max(turn * 5.0::DOUBLE + 4) OVER (PARTITION BY conv_id) AS total FROM conversations),
l AS (SELECT *, lead(start) OVER (PARTITION BY clip ORDER BY idx) AS nx FROM k), m AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY idx) AS r FROM l WHERE text <> ''),
g AS (SELECT clip, idx, r, text, total, coalesce(start, 0) AS start, CASE WHEN coalesce(stop, nx, total) <= coalesce(start, 0) THEN least(total, coalesce(start, 0) + 1.2::DOUBLE) ELSE coalesce(stop, nx, total) END AS stop FROM m WHERE r = 1
 UNION ALL SELECT m.clip, m.idx, m.r, m.text, m.total, coalesce(m.start, g.stop), CASE WHEN coalesce(m.stop, m.nx, m.total) <= coalesce(m.start, g.stop) THEN least(m.total, coalesce(m.start, g.stop) + 1.2::DOUBLE) ELSE coalesce(m.stop, m.nx, m.total) END FROM g JOIN m ON m.clip = g.clip AND m.r = g.r + 1)"""


@query(f"WITH RECURSIVE {_CHUNKS} SELECT clip, idx::INTEGER AS idx, round(start, 6) AS start, round(stop, 6) AS stop, text FROM g")
def segment_repair(spark, sf_dir):
    return transcript.repair(_chunks(spark, sf_dir)).select("clip", "idx", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"), "text")


@query(f"""WITH RECURSIVE {_CHUNKS}, b AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY clip ORDER BY idx) > 1.5 THEN 1 ELSE 0 END AS br FROM g),
p AS (SELECT *, sum(br) OVER (PARTITION BY clip ORDER BY idx) AS paragraph FROM b) SELECT clip, paragraph::BIGINT AS paragraph, string_agg(text, ' ' ORDER BY idx) AS text FROM p GROUP BY ALL""")
def paragraphs(spark, sf_dir):
    return transcript.paragraphs(transcript.repair(_chunks(spark, sf_dir)), 1.5)


@query(f"WITH RECURSIVE {_CHUNKS} SELECT clip, idx::INTEGER AS idx, round(length(text) / greatest(.001, stop - start), 4) AS cps, length(text) / greatest(.001, stop - start) > 22 AS fast FROM g")
def cue_speed(spark, sf_dir):
    return transcript.fast_cues(transcript.repair(_chunks(spark, sf_dir))).select("clip", "idx", F.round("cps", 4).alias("cps"), "fast")


_TIME = "lpad((floor(floor({0} * 1000 + .5) / 3600000))::INT::VARCHAR, 2, '0') || ':' || lpad((floor(floor({0} * 1000 + .5) % 3600000 / 60000))::INT::VARCHAR, 2, '0') || ':' || lpad((floor(floor({0} * 1000 + .5) % 60000 / 1000))::INT::VARCHAR, 2, '0') || '{1}' || lpad((floor({0} * 1000 + .5) % 1000)::INT::VARCHAR, 3, '0')"


@query(f"""WITH RECURSIVE {_CHUNKS} SELECT clip, string_agg(r || chr(10) || {_TIME.format('start', ',')} || ' --> ' || {_TIME.format('stop', ',')} || chr(10) || text, chr(10) || chr(10) ORDER BY idx) || chr(10) AS content FROM g GROUP BY clip""")
def srt_lines(spark, sf_dir):
    return transcript.to_srt(transcript.repair(_chunks(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_CHUNKS} SELECT clip, 'WEBVTT' || chr(10) || chr(10) || string_agg({_TIME.format('start', '.')} || ' --> ' || {_TIME.format('stop', '.')} || chr(10) || text, chr(10) || chr(10) ORDER BY idx) || chr(10) AS content FROM g GROUP BY clip""")
def vtt_lines(spark, sf_dir):
    return transcript.to_vtt(transcript.repair(_chunks(spark, sf_dir)))


@query("""WITH t AS (SELECT doc_id, n_chars * 1.0::DOUBLE / 7 AS s FROM documents), c AS (SELECT *, floor(s * 100 + .5)::BIGINT AS c, floor(s + .5)::BIGINT AS d FROM t)
SELECT doc_id, CASE WHEN c >= 360000 THEN (c // 360000) || ':' || lpad((c % 360000 // 6000)::VARCHAR, 2, '0') ELSE (c // 6000)::VARCHAR END || ':' || lpad((c % 6000 // 100)::VARCHAR, 2, '0') || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS timecode,
CASE WHEN d >= 3600 THEN (d // 3600) || ':' || lpad((d % 3600 // 60)::VARCHAR, 2, '0') ELSE (d // 60)::VARCHAR END || ':' || lpad((d % 60)::VARCHAR, 2, '0') AS duration,
CASE WHEN s <= 0 THEN 'unknown' WHEN s < 30 THEN 'under 30s' WHEN s < 120 THEN '30s to 2m' WHEN s < 600 THEN '2m to 10m' WHEN s < 3600 THEN '10m to 1h' ELSE 'over 1h' END AS bucket FROM c""")
def timecode_fmt(spark, sf_dir):
    s = F.col("n_chars") * 1.0 / 7
    return _t(spark, sf_dir, "documents").select("doc_id", X.timecode(s).alias("timecode"), X.duration(s).alias("duration"), X.duration_bucket(s).alias("bucket"))


@query("""WITH t AS (SELECT doc_id, n_chars * n_chars * 3 AS b FROM documents) SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN CASE WHEN b / 1024 < 10 THEN printf('%.1f', b / 1024) ELSE floor(b / 1024 + .5)::BIGINT::VARCHAR END || ' KB'
WHEN b < 1073741824 THEN CASE WHEN b / 1048576 < 10 THEN printf('%.1f', b / 1048576) ELSE floor(b / 1048576 + .5)::BIGINT::VARCHAR END || ' MB' ELSE CASE WHEN b / 1073741824 < 10 THEN printf('%.1f', b / 1073741824) ELSE floor(b / 1073741824 + .5)::BIGINT::VARCHAR END || ' GB' END AS size FROM t""")
def filesize_fmt(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", X.file_size(F.col("n_chars") * F.col("n_chars") * 3).alias("size"))


@query("""WITH n AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) || CASE page_id % 3 WHEN 0 THEN '.Tar.GZ' WHEN 1 THEN '' ELSE '.mp3' END AS f FROM pages)
SELECT page_id, CASE WHEN strpos(substr(f, 2), '.') > 0 THEN regexp_extract(f, '^(.+)\\.[^.]*$', 1) ELSE f END AS base, lower(regexp_extract(f, '^.+\\.([^.]*)$', 1)) AS ext FROM n""")
def basename_ext(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    path = F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, ".Tar.GZ").when(F.col("page_id") % 3 == 1, "").otherwise(".mp3"))
    return p.select("page_id", X.base_name(path).alias("base"), X.extension(path).alias("ext"))


@query("""WITH a AS (SELECT event_id, ['Mozilla iPhone CriOS', 'iPad Version', 'Android Chrome', 'Android SamsungBrowser Chrome', 'X11 Firefox/99', 'Windows Chrome/9 Edg/9', 'Macintosh Safari/6', 'curl'][event_id % 8 + 1] AS ua FROM events)
SELECT event_id, CASE WHEN regexp_matches(ua, 'iPhone|iPad|iPod') THEN CASE WHEN contains(ua, 'CriOS') THEN 'ios-chrome' ELSE 'ios-safari' END WHEN contains(ua, 'Android') THEN CASE WHEN contains(ua, 'SamsungBrowser') THEN 'android-samsung' ELSE 'android-chrome' END
WHEN contains(ua, 'Edg/') THEN 'desktop-edge' WHEN contains(ua, 'Firefox/') THEN 'desktop-firefox' WHEN contains(ua, 'Chrome/') THEN 'desktop-chrome' WHEN contains(ua, 'Safari/') THEN 'desktop-safari' ELSE 'other' END AS browser FROM a""")
def browser_class(spark, sf_dir):
    agents = F.array(*map(F.lit, ("Mozilla iPhone CriOS", "iPad Version", "Android Chrome", "Android SamsungBrowser Chrome", "X11 Firefox/99", "Windows Chrome/9 Edg/9", "Macintosh Safari/6", "curl")))
    return _t(spark, sf_dir, "events").select("event_id", X.browser_class(F.element_at(agents, (F.col("event_id") % 8 + 1).cast("int"))).alias("browser"))


_MESSAGES = ("RuntimeError: out of memory", "Unable to decode blob:http://x/1", "failed to start", "AbortError: stop", "Voice Memo 3.m4a is broken", "see file:///tmp/a now", "TypeError: x")
_ITEMS = "[" + ", ".join(f"'{m}'" for m in _MESSAGES) + "]"


@query(f"""WITH a AS (SELECT event_id, {_ITEMS}[event_id % 7 + 1] AS m FROM events), c AS (SELECT *, regexp_replace(m, '(?i)\\b(?:blob|data|file):[^\\s)"'']+', '<url>', 'g') AS s FROM a)
SELECT event_id, CASE WHEN regexp_matches(s, '(?i)\\.(?:m4a)\\b') THEN '<redacted: possible filename>' ELSE s END AS scrubbed, CASE WHEN m LIKE 'AbortError%' THEN 'cancelled' WHEN m LIKE '%memory%' THEN 'out-of-memory' WHEN m LIKE '%Unable to decode%' THEN 'decode-failed' WHEN m LIKE '%failed to start%' THEN 'model-load-failed' ELSE 'unknown-error' END AS code,
CASE WHEN regexp_extract(m, '^([A-Za-z]*Error|[A-Za-z]*Exception)\\b', 1) = '' THEN 'string' ELSE regexp_extract(m, '^([A-Za-z]*Error|[A-Za-z]*Exception)\\b', 1) END AS name FROM c""")
def scrub_text(spark, sf_dir):
    m = F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % 7 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", X.scrub(m).alias("scrubbed"), X.error_code(m).alias("code"), X.error_name(m).alias("name"))


@query("SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN n_chars % 90 * 60 + n_chars % 60 WHEN n_chars % 3 = 1 THEN n_chars % 60 + .5 END::DOUBLE AS seconds FROM documents")
def parse_timecode(spark, sf_dir):
    n = F.col("n_chars")
    text = F.when(n % 3 == 0, F.concat((n % 90).cast("string"), F.lit(":"), (n % 60).cast("string"))).when(n % 3 == 1, F.concat((n % 60).cast("string"), F.lit(".5 "))).otherwise("1:2:3:4")
    return _t(spark, sf_dir, "documents").select("doc_id", X.parse_timecode(text).alias("seconds"))


@query("SELECT event_type, CASE WHEN value < 30 THEN 'under 30s' WHEN value < 120 THEN '30s to 2m' WHEN value < 600 THEN '2m to 10m' ELSE '10m to 1h' END AS bucket, count(*) AS n FROM events WHERE value > 0 GROUP BY ALL")
def telemetry_buckets(spark, sf_dir):
    return _t(spark, sf_dir, "events").where("value > 0").groupBy("event_type", X.duration_bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


_RANGES = "SELECT 'd' || doc_id AS path, k AS part, strlen(substr(coalesce(text, ''), k * 500 + 1, 500))::BIGINT AS bytes, sha256(substr(coalesce(text, ''), k * 500 + 1, 500)) AS sha256 FROM (SELECT *, unnest(range(greatest(1, ceil(length(coalesce(text, '')) / 500::DOUBLE))::BIGINT)) AS k FROM documents)"


@query(f"""WITH have AS (SELECT * FROM ({_RANGES}) WHERE substr(path, 2)::BIGINT % 13 <> 1), want AS (
  SELECT path, part, bytes - CASE WHEN part = 0 AND substr(path, 2)::BIGINT % 11 = 2 THEN 1 ELSE 0 END AS bytes, CASE WHEN part = 1 AND substr(path, 2)::BIGINT % 7 = 3 THEN sha256('') ELSE sha256 END AS sha256
  FROM ({_RANGES}) WHERE substr(path, 2)::BIGINT % 17 <> 4),
b AS (SELECT coalesce(w.path, h.path) AS path, coalesce(w.part, h.part) AS part, w.bytes AS wb, h.bytes AS hb, w.bytes IS NOT DISTINCT FROM h.bytes AND w.sha256 IS NOT DISTINCT FROM h.sha256 AS same FROM want w FULL JOIN have h ON w.path = h.path AND w.part = h.part)
SELECT path, CASE WHEN sum(hb) IS NULL THEN 'missing' WHEN sum(wb) IS NULL THEN 'unknown' WHEN sum(hb) <> sum(wb) THEN 'size' WHEN count(*) FILTER (NOT same) > 0 THEN 'changed' ELSE 'intact' END AS verdict,
  count(*) FILTER (NOT same) AS bad, coalesce(min(part) FILTER (NOT same), -1) AS first_bad FROM b GROUP BY path""")
def integrity_verdicts(spark, sf_dir):
    """Texts as files in ranges of 500 characters, against a manifest with other sizes, other digests, and files left out on either side."""
    text = F.coalesce("text", F.lit(""))
    parts = F.greatest(F.lit(1), F.ceil(F.length(text) / 500)).cast("long")
    ranges = _t(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    piece = F.substr("text", (F.col("part") * 500 + 1).cast("int"), F.lit(500))
    rows = ranges.select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), "part", F.octet_length(piece).cast("long").alias("bytes"), F.sha2(piece, 256).alias("sha256"))
    have = rows.where("doc_id % 13 != 1").drop("doc_id")
    want = rows.where("doc_id % 17 != 4").withColumn("bytes", F.col("bytes") - F.when((F.col("part") == 0) & (F.col("doc_id") % 11 == 2), 1).otherwise(0))
    want = want.withColumn("sha256", F.when((F.col("part") == 1) & (F.col("doc_id") % 7 == 3), F.sha2(F.lit(""), 256)).otherwise(F.col("sha256"))).drop("doc_id")
    return integrity.verdicts(have, want).select("path", "verdict", F.size("bad").cast("long").alias("bad"), F.coalesce(F.try_element_at("bad", F.lit(1)), F.lit(-1)).alias("first_bad"))

"""Queries of the delivery planner and of format arithmetic, with their SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.functions import delivery as D
from sonoframe.operators import planner

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def grid(spark: SparkSession, schema: str, *axes) -> DataFrame:
    return spark.createDataFrame(list(product(*axes)), schema)


_RATES, _KBPS, _WIDTHS = (8000, 11025, 16000, 22050, 24000, 32000, 44100, 48000, 96000), (32, 64, 96, 128, 160, 192, 256, 320), (1, 2, 6)
_GRID = "g AS (SELECT rate, kbps, ch FROM (VALUES " + ", ".join(f"({r})" for r in _RATES) + ") a(rate), (VALUES " + ", ".join(f"({k})" for k in _KBPS) + ") b(kbps), (VALUES (1), (2), (6)) c(ch))"
_LOW = ", ".join(f"({k}, {v})" for k, v in D.MP3_LOWPASS)
_CARRY = ", ".join(f"({k}, {v})" for k, v in D.MP3_CARRIES)
_BANDS = ", ".join(str(b) for b in D.VORBIS)
_MPEG = ", ".join(f"({v}, {k})" for v, t in ((1, D.MPEG_1), (2, D.MPEG_2), (3, D.MPEG_25)) for k in t)


@query(f"""WITH {_GRID}, lp(k, f) AS (VALUES {_LOW}), ca(top, r) AS (VALUES {_CARRY}), mp(v, k) AS (VALUES {_MPEG}),
i AS (SELECT *, least(rate, 48000) AS src, least(ch, 2) AS w FROM g),
l AS (SELECT i.*, least((SELECT arg_min(f, (abs(k - kbps), -k)) FROM lp) * CASE WHEN w = 1 THEN 1.5 ELSE 1 END, src / 2) AS cut FROM i),
r AS (SELECT l.*, least(src, coalesce((SELECT arg_min(ca.r, top) FROM ca WHERE top >= cut), src)) AS out_rate FROM l)
SELECT rate, kbps, ch, out_rate, (SELECT arg_min(mp.k, (abs(mp.k - r.kbps), mp.k)) FROM mp WHERE v = CASE WHEN out_rate >= 32000 THEN 1 WHEN out_rate >= 16000 THEN 2 ELSE 3 END) AS out_kbps FROM r""")
def mp3_output(spark, sf_dir):
    rate, kbps = D.mp3_output(F.col("rate"), F.col("kbps"), F.least(F.lit(2), F.col("ch")))
    return grid(spark, "rate int, kbps int, ch int", _RATES, _KBPS, _WIDTHS).select("rate", "kbps", "ch", rate.alias("out_rate"), kbps.alias("out_kbps"))


@query(f"""WITH {_GRID}, v(b, lo, hi, slo, shi, ab, be) AS (VALUES {_BANDS}), x AS (SELECT g.*, CASE WHEN rate > 50000 THEN 48000 WHEN rate < 8000 THEN 8000 ELSE rate END AS r FROM g),
j AS (SELECT * FROM x JOIN v ON b <= r QUALIFY row_number() OVER (PARTITION BY rate, kbps, ch ORDER BY b DESC) = 1),
k AS (SELECT *, CASE WHEN ch = 2 THEN slo WHEN ch = 6 AND b = 40000 THEN 84 ELSE lo * ch END AS low, CASE WHEN ch = 2 THEN shi ELSE hi * ch END AS high FROM j)
SELECT rate, kbps, ch, low, high, least(high, greatest(low, kbps)) AS asked, round(CASE WHEN least(high, greatest(low, kbps)) / ch > 24 THEN ab ELSE be END, 4)::DOUBLE AS over FROM k""")
def vorbis_range(spark, sf_dir):
    low, high = D.vorbis_range(F.col("rate"), F.col("ch"))
    c = (F.col("kbps"), F.col("rate"), F.col("ch"))
    return grid(spark, "rate int, kbps int, ch int", _RATES, _KBPS, _WIDTHS).select("rate", "kbps", "ch", low.alias("low"), high.alias("high"), D.vorbis_kbps(*c).alias("asked"), D.vorbis_overshoot(*c).cast("double").alias("over"))


_SIZES = """e AS (SELECT doc_id, n_chars / 10.0::DOUBLE AS sec, f, 44100 AS rate, 2 AS ch FROM documents, (VALUES ('wav'), ('aiff'), ('flac'), ('opus'), ('m4a'), ('wma'), ('mp3')) t(f))"""


@query(f"""WITH {_SIZES}, k AS (SELECT *, floor(sec * rate + .5)::BIGINT AS fr FROM e)
SELECT doc_id, f AS format, (CASE f WHEN 'wav' THEN 44 + fr * 4 WHEN 'aiff' THEN 54 + fr * 4 WHEN 'flac' THEN floor((44 + fr * 4) * .55::DOUBLE + .5) WHEN 'mp3' THEN floor(128 * 1000 * sec / 8 + .5) + 512
WHEN 'opus' THEN floor(128 * 1.03::DOUBLE * 1000 * sec / 8 + .5) + 2048 ELSE floor(128 * 1.08::DOUBLE * 1000 * sec / 8 + .5) + 2048 END)::BIGINT AS bytes FROM k""")
def size_estimate(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("n_chars") / F.lit(10.0)).alias("sec"), F.explode(F.array(*map(F.lit, ("wav", "aiff", "flac", "opus", "m4a", "wma", "mp3")))).alias("format"))
    return d.select("doc_id", "format", D.estimated_bytes(F.col("format"), F.col("sec"), F.lit(128), F.lit(44100), F.lit(2)).alias("bytes"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clips: their length in characters as seconds."""
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    dest = pick("whatsapp", "discord", "email")
    ceiling = F.when(dest == "whatsapp", "media").when(dest == "email", pick("gmail", "outlook", "work", "work", "gmail")).otherwise(pick("free", "boost2", "basic", "boost3", "nitro"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("id"), (F.col("n_chars") * 1.0).alias("seconds"), (F.col("n_chars") * 4000).alias("source_bytes"), pick("mp3", "wav", "amr", "xyz").alias("source_ext"), dest.alias("destination"), ceiling.alias("ceiling"),
        F.when(F.col("lang") == "en", "speech").otherwise("music").alias("kind"), F.lit(44100).alias("sample_rate"), F.lit(2).alias("channels"),
    )


_FACTS = """f AS (SELECT doc_id AS id, n_chars * 1.0::DOUBLE AS sec, n_chars * 4000 AS sb, ['mp3', 'wav', 'amr', 'xyz'][doc_id % 4 + 1] AS ext, ['whatsapp', 'discord', 'email'][doc_id % 3 + 1] AS dest, lang = 'en' AS sp, doc_id % 5 AS m FROM documents),
b AS (SELECT *, floor(CASE dest WHEN 'whatsapp' THEN 16 WHEN 'discord' THEN [10, 50, 50, 100, 500][m + 1] ELSE [25, 20, 10, 10, 25][m + 1] END * 1048576.0::DOUBLE / CASE dest WHEN 'email' THEN 1.37::DOUBLE ELSE 1 END * .95::DOUBLE)::BIGINT AS budget FROM f),
c(dest, k, format, instant) AS (VALUES ('whatsapp', 0, 'opus', false), ('whatsapp', 1, 'mp3', true), ('discord', 0, 'opus', false), ('discord', 1, 'mp3', true), ('email', 0, 'm4a', false), ('email', 1, 'mp3', true)),
x AS (SELECT b.*, k, format, instant, CASE format WHEN 'opus' THEN CASE WHEN sp THEN 48 ELSE 128 END WHEN 'm4a' THEN CASE WHEN sp THEN 96 ELSE 128 END ELSE CASE WHEN sp THEN 96 ELSE 160 END END AS comf,
 CASE format WHEN 'opus' THEN CASE WHEN sp THEN 32 ELSE 96 END WHEN 'm4a' THEN CASE WHEN sp THEN 64 ELSE 96 END ELSE CASE WHEN sp THEN 64 ELSE 128 END END AS flo FROM b JOIN c USING (dest)),
l(format, kbps) AS (SELECT 'opus', unnest([32, 48, 64, 96, 128, 160, 192]) UNION ALL SELECT 'm4a', unnest([64, 96, 128, 160, 192, 256]) UNION ALL SELECT 'mp3', unnest([64, 96, 128, 160, 192, 256, 320])),
co AS (SELECT x.*, kbps, floor(CASE format WHEN 'opus' THEN kbps * 1.03::DOUBLE WHEN 'm4a' THEN least(kbps * 1.08::DOUBLE, CASE WHEN sp THEN 44100 * 4.4::DOUBLE / 1000 + 6 ELSE (44100 * 4.4::DOUBLE / 1000 + 6) * .9::DOUBLE * 2 END) ELSE kbps END * 1000 * sec / 8 + .5)::BIGINT + 2048 AS bytes,
 (SELECT count(*) FROM l l2 WHERE l2.format = x.format AND l2.kbps >= comf AND l2.kbps < l.kbps) AS ov FROM x JOIN l USING (format)),
s AS (SELECT id, k * 2 + 1 AS ordinal, 'single' AS route, format, max(kbps) AS bitrate, any_value(sp) AS mono, 1 AS parts, max(bytes) AS total_bytes, max(bytes) AS part_bytes, any_value(instant) AS instant, CASE WHEN max(kbps) >= any_value(comf) THEN 2 WHEN max(kbps) >= any_value(flo) THEN 1 ELSE 0 END AS quality, any_value(budget) AS budget FROM co WHERE ov <= 1 AND bytes <= budget GROUP BY id, k, format),
p AS (SELECT id, k * 2 + 2, 'parts', format, comf, sp, ceil(bytes / budget)::BIGINT, bytes, ceil(bytes / ceil(bytes / budget))::BIGINT, instant, 2, budget FROM co WHERE kbps = comf AND bytes > budget),
a AS (SELECT id, 0, 'asis', ext, 0, false, 1, sb, sb, true, 2, budget FROM b WHERE sb <= budget AND (ext IN ('mp3', 'wav') OR ext = 'amr' AND dest = 'whatsapp')),
e AS (SELECT id, 99, 'escape', ext, 0, false, 1, sb, sb, true, 2, budget FROM b WHERE dest = 'whatsapp' AND sb <= 2147483648),
r AS (SELECT * FROM s UNION ALL SELECT * FROM p UNION ALL SELECT * FROM a UNION ALL SELECT * FROM e)"""
_BEST = "w AS (SELECT * FROM r WHERE route = 'asis' OR (route <> 'escape' AND quality > 0) QUALIFY row_number() OVER (PARTITION BY id ORDER BY route <> 'asis', parts, instant DESC, quality DESC, ordinal) = 1)"


@query(f"WITH {_FACTS} SELECT * FROM r")
def fit_routes(spark, sf_dir):
    return planner.routes(_facts(spark, sf_dir))


@query(f"WITH {_FACTS}, {_BEST} SELECT * FROM w")
def fit_pick(spark, sf_dir):
    return planner.recommend(planner.routes(_facts(spark, sf_dir)))


@query(f"""WITH {_FACTS}, {_BEST}, y AS (SELECT r.*, min(total_bytes) FILTER (route IN ('single', 'parts') AND parts = 1 AND quality > 0 AND instant) OVER (PARTITION BY id) AS rd FROM r)
SELECT y.id, y.ordinal, CASE WHEN route = 'asis' THEN 'small_enough' WHEN route = 'escape' THEN 'untouched_as_a_file' WHEN route = 'parts' AND y.ordinal = q.o THEN 'nothing_fits_in_one' WHEN quality = 0 THEN 'rough'
WHEN parts = 1 AND instant THEN 'one_file_no_download' WHEN parts = 1 AND rd IS NULL THEN 'only_way_in_one_file' WHEN parts = 1 AND total_bytes < rd * .9 THEN 'smaller_after_download' WHEN parts = 1 THEN 'better_after_download'
WHEN instant THEN 'several_files_no_download' ELSE 'better_in_several_files' END AS reason FROM y LEFT JOIN (SELECT id, ordinal AS o FROM w) q USING (id)""")
def fit_reasons(spark, sf_dir):
    return planner.explain(planner.routes(_facts(spark, sf_dir))).select("id", "ordinal", "reason")


@query(f"WITH {_FACTS} SELECT route, count(*) AS n, count(*) FILTER (part_bytes > budget) AS over FROM r WHERE route <> 'escape' GROUP BY route")
def fit_invariant(spark, sf_dir):
    return planner.routes(_facts(spark, sf_dir)).where("route != 'escape'").groupBy("route").agg(F.count("*").alias("n"), F.count_if(F.col("part_bytes") > F.col("budget")).alias("over"))


@query("""WITH k AS (SELECT doc_id, ['mp3', 'wav', 'flac', 'opus'][doc_id % 4 + 1] AS ext, ['mp3', 'wav', 'flac'][doc_id % 3 + 1] AS fmt, 128 AS tk, floor(n_chars * 8 / (n_chars / 16.0::DOUBLE) / 1000 * (doc_id % 7 + 1) * 500 + .5)::BIGINT AS sk FROM documents),
x AS (SELECT *, ext IN ('mp3', 'opus') AS sl, fmt = 'mp3' AS tl, CASE WHEN sk <= 512 THEN sk END AS kb FROM k)
SELECT doc_id, CASE WHEN NOT sl AND NOT tl AND doc_id % 2 = 1 THEN 'lossless_16_bit' WHEN NOT sl AND NOT tl THEN 'lossless' WHEN NOT sl THEN 'first_lossy' WHEN NOT tl THEN 'no_gain' WHEN kb IS NOT NULL AND tk > kb * 1.15 THEN 'bitrate_above_source' ELSE 'second_lossy' END AS verdict FROM x""")
def conversion_verdict(spark, sf_dir):
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kbps = D.source_kbps(F.col("n_chars") * (F.col("doc_id") % 7 + 1) * 500, F.col("n_chars") / F.lit(16.0))
    fmt = pick("mp3", "wav", "flac")
    return d.select("doc_id", D.conversion_verdict(D.is_lossy_source(pick("mp3", "wav", "flac", "opus"), F.lit(None).cast("string")), kbps, fmt == "mp3", F.lit(128), F.col("doc_id") % 2 == 1).alias("verdict"))


#: An encoder that makes files larger than planned by a table of inflations: 1 + (key % 7) / 20.
_PLANS = "SELECT doc_id AS key, n_chars / 4::DOUBLE AS seconds, (1 + doc_id % 3) * 2000000::BIGINT AS budget, 1 + (doc_id % 7) / 20::DOUBLE AS swells FROM documents"


@query(f"""WITH RECURSIVE p AS ({_PLANS}),
w AS (SELECT *, 1::DOUBLE AS inflation, greatest(1, ceil((floor(64 * 1.03 * 1000 * seconds / 8 + .5) + 2048) / budget))::BIGINT AS wanted, floor(64 * 1.03 * 1000 * seconds / 8 + .5) + 2048 AS whole FROM p),
t AS (
  SELECT key, seconds, budget, swells, whole, inflation, wanted, 0 AS attempt, 0::BIGINT AS parts, 0::BIGINT AS largest, false AS fits FROM w
  UNION ALL
  SELECT key, seconds, budget, swells, whole, inflation, greatest(parts + 1, ceil(whole * inflation / budget))::BIGINT AS wanted, attempt + 1, parts, largest, fits FROM (
    SELECT key, seconds, budget, swells, whole, attempt, parts, largest, largest <= budget AS fits,
      CASE WHEN largest <= budget THEN inflation ELSE greatest(inflation, largest / est) * 1.02 END AS inflation
    FROM (
      SELECT *, floor(est * swells)::BIGINT AS largest FROM (
        SELECT *, floor(64 * 1.03 * 1000 * (seconds / parts) / 8 + .5) + 2048 AS est FROM (
          SELECT *, CASE WHEN wanted = 1 AND whole * inflation <= budget THEN 1 ELSE coalesce(
            list_min([n FOR n IN range(greatest(2, wanted), greatest(2, wanted) + 8) IF (floor(64 * 1.03 * 1000 * (seconds / n) / 8 + .5) + 2048) * inflation <= budget]), greatest(2, wanted) + 8) END AS parts
          FROM (SELECT * EXCLUDE (parts, largest, fits) FROM t WHERE NOT fits AND attempt < 4)
        )
      )
    )
  )
)
SELECT key, arg_max(attempt, attempt)::BIGINT AS attempts, arg_max(parts, attempt)::BIGINT AS parts, bool_or(fits) AS fits, arg_max(largest, attempt)::BIGINT AS largest FROM t WHERE attempt > 0 GROUP BY key""")
def replanned(spark, sf_dir):
    """Documents as clips of speech, encoded by an encoder that overshoots: cut anew until all parts fit, four times at most."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plans = d.select(F.col("doc_id").alias("key"), (F.col("n_chars") / 4).alias("seconds"), ((1 + F.col("doc_id") % 3) * 2_000_000).alias("budget"))
    estimate = lambda s: D.lossy_bytes(s, F.lit(64 * 1.03))
    swells = 1 + (F.col("key") % 7) / 20
    encode = lambda parts: parts.select("key", "part", F.floor(estimate(F.col("stop") - F.col("start")) * swells).alias("bytes"))
    silences = spark.createDataFrame([], "key long, start double, stop double")
    found = planner.encoded_plans(plans, silences, encode, estimate)
    return found.select("key", F.col("attempts").cast("long").alias("attempts"), F.col("parts").cast("long").alias("parts"), "fits", F.col("largest").cast("long").alias("largest"))


@query("""WITH c AS (SELECT doc_id AS key, unnest([16, 24, 32, 48, 64, 96, 128, 192, 256, 320]) AS bitrate, n_chars AS s FROM documents),
b AS (SELECT *, (floor(bitrate * 1000 * s / 8 + .5) + 2048)::BIGINT AS bytes FROM c), r AS (SELECT key, min(bytes) AS low, max(bytes) AS top FROM b GROUP BY key),
l(destination, ceiling, fits) AS (VALUES ('discord', 'free', floor(10 * 1048576 * .95)::BIGINT), ('email', 'work', floor(10 * 1048576 / 1.37 * .95)::BIGINT), ('email', 'gmail', floor(25 * 1048576 / 1.37 * .95)::BIGINT))
SELECT r.key, destination, ceiling, fits, max(bitrate) AS bitrate, round(any_value((fits - low) / (top - low)::DOUBLE), 6) AS share FROM r JOIN l ON fits >= low AND fits < top JOIN b ON b.key = r.key AND b.bytes <= fits GROUP BY r.key, destination, ceiling, fits""")
def limit_lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("s"))
    curves = d.withColumn("bitrate", F.explode(F.array(*map(F.lit, (16, 24, 32, 48, 64, 96, 128, 192, 256, 320))))).select("key", "bitrate", D.lossy_bytes(F.col("s"), F.col("bitrate")).cast("long").alias("bytes"))
    return planner.limit_lines(curves).withColumn("share", F.round("share", 6))

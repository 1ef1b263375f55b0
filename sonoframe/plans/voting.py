"""The vote query over features derived from documents, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.operators import votes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_FEATURES = {"on_notes": (7, 14.0), "syllables": (11, 1.6), "voiced": (13, 20.0), "held": (17, 30.0), "consonants": (19, 13.0), "gaps": (23, 90.0), "beat": (29, 40.0), "bass": (31, 60.0), "correlation": (37, 37.0)}


def vote_classify(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    features = [F.when(F.col("n_chars") % 41 == k, F.lit(None)).otherwise((F.col("n_chars") % m) / s).cast("double").alias(n) for k, (n, (m, s)) in enumerate(_FEATURES.items())]
    found = votes.classify(d.select(F.col("doc_id").alias("clip_id"), (F.col("n_chars") % 90).alias("voiced_frames"), *features))
    return found.select("clip_id", "kind", "confident", F.round("total", 6).alias("total"), F.array_join("reasons", "; ").alias("reasons"))


def _vote_sql() -> str:
    cols = ", ".join(f"CASE WHEN n_chars % 41 = {k} THEN NULL ELSE (n_chars % {m}) / {s}::DOUBLE END AS {n}" for k, (n, (m, s)) in enumerate(_FEATURES.items()))
    rows = []
    for k, (name, weight, shape, low, high, sign, pitched, speech, music) in enumerate(votes.VOTES):
        t = f"(({name} - {low}::DOUBLE) / ({high}::DOUBLE - {low}::DOUBLE))"
        e = f"greatest(-1, least(1, {t} * 2 - 1))" if shape == "ramp" else f"greatest(0, least(1, {t}))"
        guard = " AND vf >= 40" if pitched else ""
        rows.append(f"SELECT clip_id, {k} AS k, {weight}::DOUBLE AS w, CASE WHEN {name} IS NOT NULL{guard} THEN {e} * {sign} * {weight}::DOUBLE ELSE 0 END AS v, {repr(speech) if speech else 'NULL::VARCHAR'} AS sp, {repr(music) if music else 'NULL::VARCHAR'} AS mu FROM f")
    return f"""WITH d AS (SELECT doc_id AS clip_id, n_chars % 90 AS vf, {cols} FROM documents), f AS (SELECT *, .97::DOUBLE - correlation AS width FROM d), v AS ({' UNION ALL '.join(rows)}),
t AS (SELECT clip_id, -2 + sum(v ORDER BY k) AS total FROM v GROUP BY clip_id),
r AS (SELECT v.clip_id, CASE WHEN total >= 2.5 THEN sp ELSE mu END AS reason, row_number() OVER (PARTITION BY v.clip_id ORDER BY -v * CASE WHEN total >= 2.5 THEN 1 ELSE -1 END, k) AS n FROM v JOIN t USING (clip_id)
  WHERE v * CASE WHEN total >= 2.5 THEN 1 ELSE -1 END >= w * .5 AND CASE WHEN total >= 2.5 THEN sp ELSE mu END IS NOT NULL),
g AS (SELECT clip_id, string_agg(reason, '; ' ORDER BY n) AS reasons FROM r WHERE n <= 3 GROUP BY clip_id)
SELECT t.clip_id, CASE WHEN total >= 2.5 AND reasons IS NOT NULL THEN 'speech' ELSE 'music' END AS kind, NOT (total < 2.5 AND total > -1.5 OR reasons IS NULL) AS confident, round(total, 6) AS total,
CASE WHEN total < 2.5 AND total > -1.5 OR reasons IS NULL THEN 'unsure' ELSE reasons END AS reasons FROM t LEFT JOIN g USING (clip_id)"""


QUERIES["vote_classify"] = vote_classify
ORACLES["vote_classify"] = _vote_sql()

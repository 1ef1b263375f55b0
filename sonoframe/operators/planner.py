"""Delivery plans: every honest way to get a clip under a destination's limit, ranked.

Facts meet a fixed set of destinations and codecs, so routes are one explode of literal arrays and a window over a fact's few routes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe import storage
from sonoframe.functions import delivery as D
from sonoframe.operators.gating import snap_cuts

MB = 1024 * 1024
# Destination, limits in MB by name, codecs in order of preference, encoding overhead, limit in MB of the way round.
DESTINATIONS = {
    "whatsapp": ({"media": 16}, ("opus", "mp3"), 1.0, 2048),
    "discord": ({"free": 10, "boost2": 50, "basic": 50, "boost3": 100, "nitro": 500}, ("opus", "mp3"), 1.0, None),
    "email": ({"gmail": 25, "outlook": 20, "work": 10}, ("m4a", "mp3"), 1.37, None),
}
PLAYS = ("mp3", "m4a", "aac", "ogg", "oga", "opus", "wav", "flac")
PLAYS_MORE = {"whatsapp": ("amr", "wma")}
# The bitrate under which a codec is rough, and the one at which it is clean, for speech and music.
FLOOR = {"opus": (32, 96), "m4a": (64, 96), "mp3": (64, 128)}
COMFORTABLE = {"opus": (48, 128), "m4a": (96, 128), "mp3": (96, 160)}
QUALITY = ("rough", "fine", "clean")


def _pick(column: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(column == k, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def limit(destination: Column, ceiling: Column) -> Column:
    """Bytes over which nothing arrives."""
    size = _pick(F.concat_ws("/", destination, ceiling), {f"{d}/{c}": float(mb * MB) for d, (cs, *_) in DESTINATIONS.items() for c, mb in cs.items()})
    return size / _pick(destination, {d: x[2] for d, x in DESTINATIONS.items()})


def budget(destination: Column, ceiling: Column) -> Column:
    """Bytes that one file is planned to: the limit less five percent."""
    return F.floor(limit(destination, ceiling) * 0.95).cast("long")


def routes(facts: DataFrame) -> DataFrame:
    """All routes of (id, seconds, source_bytes, source_ext, destination, ceiling, kind, sample_rate, channels).

    Columns: id, ordinal, route, format, bitrate, mono, parts, total_bytes, part_bytes, instant, quality (0 rough to 2 clean), budget.
    """
    speech = F.col("kind") == "speech"
    base = facts.select("*", budget(F.col("destination"), F.col("ceiling")).alias("budget"), speech.alias("mono")).withColumn("width", F.when(speech, 1).otherwise(F.col("channels")))
    ext = F.lower("source_ext")
    plays = ext.isin(*PLAYS) | F.coalesce(_pick(F.col("destination"), {d: ext.isin(*more) for d, more in PLAYS_MORE.items()}), F.lit(False))

    def whole(kind: str, ordinal: int) -> list[Column]:
        size = F.col("source_bytes").cast("long")
        return [F.lit(ordinal).alias("ordinal"), F.lit(kind).alias("route"), F.col("source_ext").alias("format"), F.lit(0).alias("bitrate"), F.lit(False).alias("mono"), F.lit(1).cast("long").alias("parts"), size.alias("total_bytes"), size.alias("part_bytes"), F.lit(True).alias("instant"), F.lit(2).alias("quality"), F.col("budget")]

    as_is = base.where((F.col("source_bytes") <= F.col("budget")) & plays).select("id", *whole("asis", 0))
    way_round = _pick(F.col("destination"), {d: float(x[3] * MB) for d, x in DESTINATIONS.items() if x[3]})
    escape = base.where(F.col("source_bytes") <= way_round).select("id", *whole("escape", 99))

    options = {d: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("format")) for k, c in enumerate(x[1])]) for d, x in DESTINATIONS.items()}
    coded = base.withColumn("o", F.explode(_pick(F.col("destination"), options))).select("*", "o.k", "o.format").drop("o")
    by_kind = lambda table: _pick(F.col("format"), {f: F.when(speech, v[0]).otherwise(v[1]) for f, v in table.items()})
    coded = coded.withColumn("comfortable", by_kind(COMFORTABLE)).withColumn("floor", by_kind(FLOOR)).withColumn("instant", _pick(F.col("format"), {f: x[1] < 2 for f, x in D.FORMATS.items()}))
    coded = coded.withColumn("ladder", _pick(F.col("format"), {f: F.array(*map(F.lit, D.FORMATS[f][2])) for f in COMFORTABLE}))
    cost = lambda kbps: D.bytes_for(F.col("format"), F.col("seconds"), kbps, F.col("sample_rate"), F.col("width"))

    # One step above comfortable is the top; the best rung that fits is the highest.
    rungs = coded.withColumn("kbps", F.explode("ladder")).withColumn("over", F.size(F.filter("ladder", lambda x: (x >= F.col("comfortable")) & (x < F.col("kbps"))))).where("over <= 1")
    fitting = rungs.withColumn("bytes", cost(F.col("kbps"))).where("bytes <= budget").groupBy("id", "k", "format", "mono", "instant", "comfortable", "floor", "budget").agg(F.max("kbps").alias("kbps"), F.max_by("bytes", "kbps").alias("bytes"))
    quality = F.when(F.col("kbps") >= F.col("comfortable"), 2).when(F.col("kbps") >= F.col("floor"), 1).otherwise(0)
    single = fitting.select("id", (F.col("k") * 2 + 1).alias("ordinal"), F.lit("single").alias("route"), "format", F.col("kbps").alias("bitrate"), "mono", F.lit(1).cast("long").alias("parts"), F.col("bytes").alias("total_bytes"), F.col("bytes").alias("part_bytes"), "instant", quality.alias("quality"), "budget")
    split = coded.withColumn("bytes", cost(F.col("comfortable"))).withColumn("parts", F.ceil(F.col("bytes") / F.col("budget")).cast("long")).where("parts > 1")
    parts = split.select("id", (F.col("k") * 2 + 2).alias("ordinal"), F.lit("parts").alias("route"), "format", F.col("comfortable").alias("bitrate"), "mono", "parts", F.col("bytes").alias("total_bytes"), F.ceil(F.col("bytes") / F.col("parts")).cast("long").alias("part_bytes"), "instant", F.lit(2).alias("quality"), "budget")
    return as_is.unionByName(single).unionByName(parts).unionByName(escape)


def recommend(all_routes: DataFrame) -> DataFrame:
    """One route for each id: as it is; else the fewest parts, no download, best quality, first come. Ids with rough routes alone get none."""
    fit = all_routes.where((F.col("route") == "asis") | (F.col("route").isin("single", "parts") & (F.col("quality") > 0)))
    order = Window.partitionBy("id").orderBy((F.col("route") != "asis").cast("int"), "parts", F.col("instant").cast("int").desc(), F.col("quality").desc(), "ordinal")
    return fit.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def explain(all_routes: DataFrame) -> DataFrame:
    """Adds why each route is there, which depends on the routes beside it."""
    w = Window.partitionBy("id")
    single = F.col("route").isin("single", "parts") & (F.col("parts") == 1) & (F.col("quality") > 0)
    best = recommend(all_routes).select("id", F.col("ordinal").alias("_best"))
    r = all_routes.withColumn("_ready", F.min(F.when(single & F.col("instant"), F.col("total_bytes"))).over(w)).join(best, "id", "left")
    reason = (
        F.when(F.col("route") == "asis", "small_enough").when(F.col("route") == "escape", "untouched_as_a_file")
        .when((F.col("route") == "parts") & (F.col("ordinal") == F.col("_best")), "nothing_fits_in_one")
        .when(F.col("quality") == 0, "rough")
        .when((F.col("parts") == 1) & F.col("instant"), "one_file_no_download").when((F.col("parts") == 1) & F.col("_ready").isNull(), "only_way_in_one_file")
        .when((F.col("parts") == 1) & (F.col("total_bytes") < F.col("_ready") * 0.9), "smaller_after_download").when(F.col("parts") == 1, "better_after_download")
        .when(F.col("instant"), "several_files_no_download").otherwise("better_in_several_files")
    )
    return r.select(*all_routes.columns, reason.alias("reason"), (F.col("ordinal") == F.col("_best")).alias("recommended"))


#: Passes of encoding before a plan is given up, numbers of parts that are tried in one pass, and what is added to a measured inflation.
PASSES, COUNTS, MARGIN = 4, 8, 1.02


def fitting_cuts(plans: DataFrame, silences: DataFrame, cost: Callable[[Column], Column]) -> DataFrame:
    """Adds (parts, points) to plans (key, seconds, wanted, budget, ...): cuts near pauses whose parts all cost at most the budget.

    Numbers of parts from `wanted` on are worked out side by side and the least that passes is taken; if none of COUNTS passes, cuts are
    even at the number after them. cost: bytes of a plan's seconds, an expression over the plan's columns.
    """
    counts = plans.withColumn("parts", F.explode(F.sequence(F.greatest(F.lit(1), F.col("wanted").cast("int")), F.greatest(F.lit(1), F.col("wanted").cast("int")) + COUNTS)))
    snapped = snap_cuts(counts.select("key", "seconds", "parts"), silences, None).select("key", "parts", "points")
    tried = counts.join(snapped, ["key", "parts"])
    lengths = F.transform(F.slice("points", 2, F.col("parts")), lambda p, k: p - F.col("points")[k])
    last = F.col("parts") == F.greatest(F.lit(1), F.col("wanted").cast("int")) + COUNTS
    even = F.transform(F.sequence(F.lit(0), F.col("parts")), lambda k: F.col("seconds") * k / F.col("parts"))
    passing = tried.where(last | F.forall(lengths, lambda s: cost(s) <= F.col("budget"))).withColumn("points", F.when(last, even).otherwise(F.col("points")))
    return plans.join(passing.groupBy("key").agg(F.min(F.struct("parts", "points")).alias("c")).select("key", "c.*"), "key")


def encoded_plans(plans: DataFrame, silences: DataFrame, encode: Callable[[DataFrame], DataFrame], estimate: Callable[[Column], Column], passes: int = PASSES) -> DataFrame:
    """(key, attempts, parts, largest, inflation, fits): plans (key, seconds, budget, ...) cut, encoded, measured, and planned anew where a part is over the budget.

    encode(parts) gets rows (key, part, start, stop, ...) and gives (key, part, bytes); any encoder fits in. estimate(seconds) is what a
    plan counts with. A plan that does not fit is cut again at the inflation that its worst part showed and a little more, into more
    parts than before; only such plans go into the next pass. After the last pass they are given as not fitting.
    """
    state = plans.withColumns({"inflation": F.lit(1.0), "wanted": F.greatest(F.lit(1), F.ceil(estimate(F.col("seconds")) / F.col("budget"))).cast("long")})
    done = None
    for attempt in range(1, passes + 1):
        cost = lambda s: estimate(s) * F.col("inflation")
        least = F.when((F.col("wanted") > 1) | (cost(F.col("seconds")) > F.col("budget")), F.greatest(F.lit(2).cast("long"), F.col("wanted"))).otherwise(F.lit(1).cast("long"))
        one = state.withColumn("wanted", least)
        whole = F.array(F.lit(0.0), F.col("seconds").cast("double"))
        planned = one.where("wanted = 1").withColumns({"parts": F.lit(1), "points": whole}).unionByName(fitting_cuts(one.where("wanted > 1"), silences, cost))
        pieces = planned.select("*", F.posexplode(F.slice("points", 2, F.col("parts"))).alias("part", "stop")).withColumn("start", F.col("points")[F.col("part")])
        weighed = pieces.select("key", "part", estimate(F.col("stop") - F.col("start")).alias("expected")).join(encode(pieces.drop("points")), ["key", "part"])
        seen = weighed.groupBy("key").agg(F.max("bytes").alias("largest"), F.max(F.col("bytes") / F.col("expected")).alias("worst"))
        judged = storage.cut(planned.drop("points").join(seen, "key").withColumn("fits", F.col("largest") <= F.col("budget")))
        over = ~F.col("fits") if attempt < passes else F.lit(False)
        out = judged.where(~over).select("key", F.lit(attempt).alias("attempts"), "parts", "largest", F.round("inflation", 6).alias("inflation"), "fits")
        done = out if done is None else done.unionByName(out)
        if attempt == passes or judged.where(over).isEmpty():
            return done
        state = judged.where(over).withColumn("inflation", F.greatest("inflation", "worst") * MARGIN)
        state = state.withColumn("wanted", F.greatest(F.col("parts") + 1, F.ceil(estimate(F.col("seconds")) * F.col("inflation") / F.col("budget"))).cast("long"))
        state = state.drop("parts", "largest", "worst", "fits")


# Destination and ceiling of the limits that are drawn into a size curve.
LIMIT_LINES = (("discord", "free"), ("email", "work"), ("email", "gmail"))


def limit_lines(curves: DataFrame) -> DataFrame:
    """(key, destination, ceiling, fits, bitrate, share) for size curves (key, bitrate, bytes): the limits that fall into a curve's range.

    A line stands at what a file is planned to, and is left out where no point of the curve is over it or all are. bitrate is the
    highest that stays under it, share how far up the curve's range it stands. A curve has a point for each rung of a ladder.
    """
    lines = F.array(*[F.struct(F.lit(d).alias("destination"), F.lit(c).alias("ceiling"), budget(F.lit(d), F.lit(c)).alias("fits")) for d, c in LIMIT_LINES])
    ranges = curves.groupBy("key").agg(F.min("bytes").alias("low"), F.max("bytes").alias("top"), F.collect_list(F.struct("bitrate", "bytes")).alias("points"))
    each = ranges.withColumn("line", F.explode(lines)).where((F.col("line.fits") >= F.col("low")) & (F.col("line.fits") < F.col("top")))
    under = F.transform(F.filter("points", lambda p: p["bytes"] <= F.col("line.fits")), lambda p: p["bitrate"])
    return each.select("key", "line.*", F.array_max(under).alias("bitrate"), ((F.col("line.fits") - F.col("low")) / (F.col("top") - F.col("low"))).alias("share"))

"""Gated loudness over block powers, and regions of silence: windows, two gates, ranks, gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.functions import numeric as N


def block_powers(s: DataFrame, block: int, hop: int) -> DataFrame:
    """(key, b, power) of sliding blocks of `block` samples every `hop`; only whole blocks.

    Each sample is summed once into its cell (the stretch between neighbouring block edges); blocks are sums of cells.
    """
    edge = F.greatest(F.floor(F.col("i") / hop) * hop, F.floor((F.col("i") - block) / hop) * hop + block)
    cells = s.groupBy("key", edge.alias("cell")).agg(F.sum(F.col("v") * F.col("v")).alias("energy"), F.max("i").alias("last"))
    n = cells.withColumn("n", F.max("last").over(Window.partitionBy("key")) + 1)
    first = F.greatest(F.lit(0), F.floor((F.col("cell") - block) / hop) + 1).cast("long")
    at = n.withColumn("b", F.explode(F.sequence(first, F.floor(F.col("cell") / hop).cast("long")))).where(F.col("b") * hop + block <= F.col("n"))
    return at.groupBy("key", "b").agg((F.sum("energy") / block).alias("power"))


def gated_loudness(powers: DataFrame, absolute: float = -70.0, relative: float = -10.0) -> DataFrame:
    """(key, gated, loudness): blocks over the absolute gate, then over their own mean power's loudness + relative.

    A key with no block over the first gate has a null loudness; if the second gate leaves none, the first one's stand.
    """
    over = powers.where(N.power_lufs(F.col("power")) > absolute)
    mean = F.avg("power").over(Window.partitionBy("key"))
    kept = over.withColumn("ungated", mean).withColumn("in", N.power_lufs(F.col("power")) > N.power_lufs(F.col("ungated")) + relative)
    out = kept.groupBy("key").agg(F.count_if("in").alias("gated"), F.avg(F.when(F.col("in"), F.col("power"))).alias("p"), F.first("ungated").alias("u"))
    return powers.select("key").distinct().join(out, "key", "left").select("key", F.coalesce("gated", F.lit(0)).alias("gated"), N.power_lufs(F.coalesce("p", "u")).alias("_l"), "u").select("key", "gated", F.when(F.col("u").isNotNull(), F.col("_l")).alias("loudness"))


def loudness_range(powers: DataFrame, absolute: float = -70.0, relative: float = -20.0, low: float = 0.1, high: float = 0.95) -> DataFrame:
    """(key, range): the spread between two nearest ranks of gated block loudness; 0 with fewer than two blocks left."""
    leveled = powers.withColumn("level", N.power_lufs(F.col("power"))).where(F.col("level") > absolute)
    gate = 10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("level") / 10)).over(Window.partitionBy("key"))) + relative
    kept = leveled.withColumn("gate", gate).where("level > gate")
    ranks = N.nearest_rank(kept, ["key"], "level", {"lo": low, "hi": high})
    return powers.select("key").distinct().join(ranks, "key", "left").select("key", F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0)).alias("range"))


#: Seconds of a block and of a step between blocks, for momentary loudness and for the loudness range (fixed values).
MOMENTARY, RANGED = (0.4, 0.1), (3.0, 1.0)


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def cell_loudness(cells: DataFrame) -> DataFrame:
    """(key, integrated, range, peak in dB, momentary) of cells (key, rate, start, stop, energy, peak), whatever wrote them: a batch or a stream so far. Cells with a true_peak give that too.

    A cell lies between neighbouring edges of blocks, so a block's energy is the sum of its cells'; a cell cut in two is two
    cells. Each cell goes to the blocks it lies in, all of a key's blocks come together as one list of powers (ten a second), and the gates
    are expressions over that list. A clip shorter than a momentary block is measured as a whole; silence is minus infinity.
    """
    silence = F.lit(float("-inf"))
    tops = [c for c in ("peak", "true_peak") if c in cells.columns]

    def kinds(kind: int, seconds: tuple[float, float]) -> Column:
        block, hop = (N.round_half_up(F.lit(s) * F.col("rate")).cast("long") for s in seconds)
        first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("start") - block) / hop) + 1)
        last = F.floor(F.col("start") / hop)
        return F.transform(F.sequence(first, F.greatest(first, last)), lambda b: F.when((b * hop <= F.col("start")) & (F.col("start") < b * hop + block), F.struct(F.lit(kind).alias("kind"), b.alias("b"), (b * hop + block).alias("stop"), block.alias("block"))))

    blocks = F.array_compact(F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("stop"), F.lit(1).cast("long").alias("block"))), kinds(1, MOMENTARY), kinds(2, RANGED)))
    sums = cells.select("key", "rate", "stop", "energy", *tops, F.explode(blocks).alias("at")).groupBy("key", "at").agg(F.sum("energy").alias("energy"), F.max("stop").alias("n"), F.first("rate").alias("rate"), *[F.max(c).alias(c) for c in tops])
    one = lambda kind: F.col("at.kind") == kind
    listed = lambda kind: F.array_sort(F.collect_list(F.when(one(kind), F.struct(F.col("at.b").alias("b"), F.col("at.stop").alias("stop"), (F.col("energy") / F.col("at.block")).alias("power")))))
    whole = sums.groupBy("key").agg(
        F.max("n").alias("n"), F.first("rate").alias("rate"), F.sum(F.when(one(0), F.col("energy"))).alias("energy"), *[F.max(c).alias(c) for c in tops], listed(1).alias("momentary"), listed(2).alias("ranged")
    )
    complete = lambda c: F.transform(F.filter(c, lambda x: x["stop"] <= F.col("n")), lambda x: x["power"])
    lufs = lambda p: F.when(p > 0, N.power_lufs(p)).otherwise(silence)
    powers = whole.select("key", "n", "rate", "energy", *tops, complete("momentary").alias("m"), complete("ranged").alias("r"))
    over = powers.withColumns({"over": F.filter("m", lambda p: lufs(p) > -70.0), "levels": F.filter(F.transform("r", lufs), lambda v: v > -70.0)})
    gate, floor = lufs(_mean(F.col("over"))) - 10.0, 10 * F.log10(_mean(F.transform("levels", lambda v: F.pow(F.lit(10.0), v / 10)))) - 20.0
    # a gate is bound by a lambda, so that it is worked out once and not for every block
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    kept = over.withColumns({"kept": bound(gate, lambda g: F.filter("over", lambda p: lufs(p) > g)), "spread": bound(floor, lambda g: F.array_sort(F.filter("levels", lambda v: v > g)))})
    place = lambda share: F.element_at("spread", (F.floor((F.size("spread") - 1) * share + 0.5) + 1).cast("int"))
    short = F.col("n") < N.round_half_up(F.lit(MOMENTARY[0]) * F.col("rate"))
    all_power = F.col("energy") / F.greatest(F.lit(1), F.col("n"))
    gated_mean = F.when(F.size("over") == 0, silence).otherwise(lufs(F.coalesce(_mean(F.col("kept")), _mean(F.col("over")))))
    return kept.select(
        "key",
        F.when(short, lufs(all_power)).otherwise(gated_mean).alias("integrated"),
        F.when(~short & (F.size("spread") > 1), place(0.95) - place(0.1)).otherwise(0.0).alias("range"),
        *[F.when(F.col(c) > 0, 20 * F.log10(c)).otherwise(silence).alias(c) for c in tops],
        F.when(short, F.when(F.col("n") > 0, F.array(lufs(all_power))).otherwise(F.array().cast("array<double>"))).otherwise(F.transform("m", lufs)).alias("momentary"),
    )


def silence_regions(e: DataFrame, threshold: float, least: int, key: str = "key", index: str = "w", value: str = "rms") -> DataFrame:
    """(key, start, stop): runs of at least `least` neighbouring windows under the threshold; stop is past the last."""
    quiet = e.where(F.col(value) < threshold)
    island = F.col(index) - F.row_number().over(Window.partitionBy(key).orderBy(index))
    runs = quiet.withColumn("_g", island).groupBy(key, "_g").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("stop"))
    return runs.where(F.col("stop") - F.col("start") >= least).drop("_g")


def keep_regions(e: DataFrame, silent: DataFrame, pad: int, key: str = "key", index: str = "w") -> DataFrame:
    """(key, start, stop): what is left when silent regions, each shorter by `pad` at both ends, are cut from a key's extent."""
    extent = e.groupBy(key).agg(F.min(index).alias("a"), (F.max(index) + 1).alias("b"))
    cuts = silent.select(key, (F.col("start") + pad).alias("from"), (F.col("stop") - pad).alias("to")).where("to > from")
    edges = extent.select(key, F.col("a").alias("to"), F.col("a").alias("from")).unionByName(cuts.select(key, "to", "from")).unionByName(extent.select(key, F.col("b").alias("to"), F.col("b").alias("from")))
    after = Window.partitionBy(key).orderBy("from", "to")
    return edges.withColumn("stop", F.lead("from").over(after)).where("stop > to").select(key, F.col("to").alias("start"), "stop")


def gap_share(s: DataFrame, per_group: int, key: str = "key", index: str = "w", value: str = "rms") -> DataFrame:
    """(key, gaps): the mean over stretches of `per_group` windows of the share that is under half the stretch's mean."""
    g = F.floor(F.col(index) / per_group)
    marked = s.withColumn("_g", g).withColumn("_m", F.avg(value).over(Window.partitionBy(key, "_g")))
    shares = marked.groupBy(key, "_g").agg((F.count_if(F.col(value) < F.col("_m") / 2) / F.count("*")).alias("share"))
    return shares.groupBy(key).agg(F.avg("share").alias("gaps"))


def snap_cuts(spans: DataFrame, silences: DataFrame, parts: int | None, reach_share: float = 0.08, reach_most: float = 45.0) -> DataFrame:
    """(key, points, snapped) for (key, seconds) and (key, start, stop) of silences; with parts=None a column `parts` of the spans says how many, and is kept.

    Each even cut moves to the middle of the longest silence within reach, if that is over half a second past the cut before. The
    candidates are found by a join that groups by (key, parts, cut); the order matters only in the fold over a key's few cuts.
    """
    sized = spans if parts is None else spans.withColumn("parts", F.lit(parts))
    reach = F.least(F.col("seconds") / F.col("parts") * reach_share, F.lit(reach_most))
    several = sized.where("parts > 1").withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("parts") - 1).cast("int"))))
    cuts = several.withColumn("nominal", F.col("seconds") * F.col("k") / F.col("parts")).withColumn("reach", reach)
    mids = silences.select("key", ((F.col("start") + F.col("stop")) / 2).alias("mid"), (F.col("stop") - F.col("start")).alias("len"), "start").where("len > 0")
    near = cuts.join(mids, "key").where(F.abs(F.col("mid") - F.col("nominal")) <= F.col("reach"))
    best = near.groupBy("key", "parts", "k").agg(F.min_by("mid", F.struct(-F.col("len"), F.col("start"))).alias("best"))
    listed = cuts.join(best, ["key", "parts", "k"], "left").groupBy("key", "parts").agg(F.array_sort(F.collect_list(F.struct("k", "nominal", "best"))).alias("cuts"))
    listed = sized.join(listed, ["key", "parts"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<k:int,nominal:double,best:double>>")))
    start = F.struct(F.array(F.lit(0.0)).alias("points"), F.lit(0).alias("snapped"))

    def step(acc, c):
        ok = F.coalesce(c["best"] > F.element_at(acc["points"], -1) + 0.5, F.lit(False))
        return F.struct(F.concat(acc["points"], F.array(F.when(ok, c["best"]).otherwise(c["nominal"]))).alias("points"), (acc["snapped"] + ok.cast("int")).alias("snapped"))

    folded = listed.withColumn("f", F.aggregate("cuts", start, step))
    named = ["key"] if parts is not None else ["key", "parts"]
    return folded.select(*named, F.concat("f.points", F.array(F.col("seconds").cast("double"))).alias("points"), F.col("f.snapped").alias("snapped"))

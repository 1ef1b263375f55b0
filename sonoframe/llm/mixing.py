"""Temperature mixing of sources to target weights.

A source's share of the tokens is raised to an exponent in 0 to 1 and the shares are normalised to weights: exponent 1
keeps the corpus's own shares, 0 makes sources alike. Bisection finds the largest exponent whose weights have the target
entropy (as a share of the most possible) while no source is repeated more than `max_repeats` times within the
budget; where no exponent gives both, the repetition limit comes first. A bisection runs over the table of sources as
`FAN` exponents an aggregate, so any number of sources will do and none is collected.

A source's budget is its weight times the token budget. It is realised from block permutations: each epoch runs through
the source's blocks in an order of its own, and through each block's documents in an order of its own. Whole epochs take
all documents; the last, partial epoch takes blocks, then documents, while the budget lasts (the document that reaches it
is in). Blocks hold a bounded number of documents, so that no window spans a source.

Defined cases: a null source is a source of its own, named ''; a null or empty text has 0 tokens, and goes along in whole
epochs; a source without tokens is kept once; repeated rows count each and share their copies alike, rounded up; an empty
table gives no rows; other columns are kept by `mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import materialize, table

#: Target entropy as a share of the logarithm of the number of sources, most epochs of a source, documents in a block.
TARGET_ENTROPY, MAX_REPEATS, BLOCK_DOCS = 0.97, 4.0, 2000
#: Exponents that one aggregate tries, and aggregates: FAN ** -ROUNDS is the exponent's error.
FAN, ROUNDS = 32, 5


def n_tokens(text: Column) -> Column:
    """Tokens are the runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def _tried(sources: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float]]:
    """For each exponent, the entropy of its weights and the most repeats of a source."""
    # With weights w = p**a / z, the entropy is ln z - sum(p**a ln p**a) / z, and repeats are p**a / z * budget / tokens.
    # One group for each exponent: as many aggregates in one row would outgrow a compiled method.
    grid = sources.select("p", "tokens", F.posexplode(F.array(*map(F.lit, exponents))).alias("k", "a")).withColumn("power", F.pow("p", "a"))
    rows = grid.groupBy("k").agg(F.sum("power").alias("z"), F.sum(F.col("power") * F.col("a") * F.ln("p")).alias("s"), F.max(F.col("power") / F.col("tokens")).alias("r")).collect()
    found = {r.k: (math.log(r.z) - r.s / r.z, r.r / r.z * budget) for r in rows}
    return [found[k] for k in range(len(exponents))]


def exponent(sources: DataFrame, budget: float, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent for sources (tokens, p): found twice by bisection, for the entropy and for the limit.

    Entropy falls and, for the rarest source, repeats fall as the exponent grows.
    """
    n, total = sources.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return 1.0
    goal = target_entropy * math.log(n) if n > 1 else 0.0

    def largest(good) -> float:
        """The largest exponent in 0 to 1 that is good, if goodness goes from true to false as the exponent grows."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / FAN for k in range(1, FAN)] + ([1.0] if high == 1.0 else [])
            for a, found in zip(grid, _tried(sources, grid, budget)):
                if good(found):
                    low = a
                else:
                    high = a
                    break
            else:
                if high == 1.0:
                    return 1.0
        return low

    wanted = largest(lambda f: f[0] >= goal - 1e-12)
    limit = max(max_repeats, budget / total)  # no exponent repeats less than all sources alike
    if _tried(sources, [wanted], budget)[0][1] <= limit:
        return wanted
    # The least exponent that keeps the limit: bisect from the other side.
    low, high = wanted, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / FAN for k in range(1, FAN + 1)]
        for a, found in zip(grid, _tried(sources, grid, budget)):
            if found[1] <= limit * (1 + 1e-12):
                high = a
                break
            low = a
    return high


def weights(counted: DataFrame, budget: float | None = None, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(src, docs, tokens, weight, repeats) of documents (src, tokens)."""
    sources = materialize(counted.groupBy("src").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")), "sources")
    some = sources.where("tokens > 0")
    total = some.agg(F.sum("tokens")).first()[0] or 0
    budget = float(budget or total)
    some = some.withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    a = exponent(some, budget, target_entropy, max_repeats)
    z = some.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    p = F.col("tokens") / F.lit(float(max(total, 1)))
    weight = F.when(F.col("tokens") > 0, F.pow(p, F.lit(a)) / F.lit(z)).otherwise(0.0)
    return sources.withColumn("weight", weight).withColumn("repeats", F.when(F.col("tokens") > 0, F.col("weight") * F.lit(budget) / F.col("tokens")).otherwise(1.0))


def _unit(*columns: Column) -> Column:
    """A hash as an order."""
    return F.xxhash64(*columns)


def copies(docs: DataFrame, block_docs: int = BLOCK_DOCS, **options) -> DataFrame:
    """(id, t, src, tokens, weight, repeats, copies, block, rank): how often each document is taken.

    `copies` is the whole epochs and, if the last, partial epoch reaches the document, one more. `block` and `rank` place the
    document in the permutation of that epoch.
    """
    text = F.col("text").cast("string")
    counted = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), n_tokens(text).alias("tokens"))
    counted = materialize(counted, "mix-counted")
    mixed = materialize(weights(counted, **options), "mix-weights")
    placed = counted.join(mixed.select("src", "docs", "weight", "repeats", F.col("tokens").alias("source_tokens")), "src")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(block_docs)))
    placed = placed.withColumn("epoch", F.floor(F.col("repeats") + 1e-12)).withColumn("block", F.pmod(_unit(F.lit(1), "id", "t"), blocks))
    # The partial epoch's order: blocks by a hash with the epoch in it, then documents by another.
    placed = placed.withColumn("need", F.col("repeats") * F.col("source_tokens") - F.col("epoch") * F.col("source_tokens"))
    sums = placed.groupBy("src", "block", "epoch").agg(F.sum("tokens").alias("block_tokens"))
    before = Window.partitionBy("src").orderBy(_unit(F.lit(2), "src", "block", "epoch"), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "block", F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("src", "block").orderBy(_unit(F.lit(3), "id", "t", "epoch"), "id", "t")
    earlier = F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("earlier", earlier).withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["src", "block"])
    taken = (F.col("start") + F.col("earlier") < F.col("need") - 0.5) & (F.col("tokens") > 0)
    return ranked.select("id", "t", "src", "tokens", "weight", "repeats", (F.col("epoch") + taken.cast("int")).cast("long").alias("copies"), "block", F.col("rank").cast("long").alias("rank"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents, all their columns, each as often as the mixture takes it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    taken = materialize(copies(docs, **options).groupBy("id", "t", "src").agg(F.sum("copies").alias("total"), F.count("*").alias("rows")), "mix-copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("i"), F.xxhash64(text).alias("h"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s"))
    joined = rows.join(taken, F.col("i").eqNullSafe(F.col("id")) & (F.col("h") == F.col("t")) & (F.col("s") == F.col("src")))
    share = F.ceil(F.col("total") / F.col("rows")).cast("int")  # repeated rows share their copies alike, rounded up
    return joined.withColumn("times", share).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), "times")).alias("k")).select("row.*")


def op6_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = copies(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("src").alias("source"), F.col("tokens").alias("n_tokens"), "weight", "repeats", "copies", "block", "rank")

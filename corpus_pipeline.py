"""A corpus pipeline of five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet to the shared folder and reads
again as the next stage's documents. All but the last return the columns of documents.

Defined cases, stage by stage as its operator states them: a null text has nothing toxic and no lines, is equal to an empty
one among near-duplicates, and is packed as the closing id alone; a null id comes before all others; rows that repeat id and
text are judged alike, and one of them stays at near-duplicates; of equals the one with the least id stays; documents of any
length are taken whole; other columns go along until the packing; an empty table gives no pieces. Without labels of both
kinds nothing is called toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonoframe.llm import lines, mixing, neardup, packing, toxicity
from sonoframe.llm.common import materialize, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar does not call toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in them, or in earlier documents. n_chars follows the text."""
    from pyspark.sql import functions as F

    return lines.deduplicate(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: No SQL: tokenizers, learned patterns and signatures have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs

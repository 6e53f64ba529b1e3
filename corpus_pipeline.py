"""From raw documents to shards: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's ``docs``. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborist.llm.common import table
from arborist.llm.decontaminate import drop_contaminated
from arborist.llm.mixing import mix_sources
from arborist.llm.neardup import drop_duplicates
from arborist.llm.quality import keep_good
from arborist.llm.sharding import extendible_shards
from arborist.storage import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return drop_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights draws them."""
    return mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that they go to; a result column whose name the documents have already is called ``shard_<name>``."""
    out = extendible_shards(docs)
    own = {"shard": "id", "shard_depth": "depth", "shard_page": "page", "n_bytes": "n_bytes", "shard_bytes": "shard_bytes"}
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    taken = set(docs.columns)
    for name, field in own.items():
        while name in taken:
            name = f"shard_{name}"
        taken.add(name)
        columns.append(F.col(f"shard.{field}").alias(name))
    return out.select(*columns)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: The classifier and the hashing of shingles and seeds have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs

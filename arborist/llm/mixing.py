"""Operator 9: mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's target over its
source's size. The expected copies are summed up along the source's documents, one random offset
per source is added, and a document is emitted once for each integer that the sum crosses at it.
Documents are laid out by length class, so that the sample is spread evenly over lengths and the
words taken come near the target.

The prefix sum has two levels: ranks within blocks (source, length class, salt by the hash of id and text) and
the blocks' offsets from their counts. A source with a third of all rows is many blocks. Within a block rows are ranked by size,
id, the text's hash, and then the hash of all other columns, so reruns draw the same rows.

Cases: null text has size 0; a null source is a source of its own, the last; documents of size 0 are
sampled like others and take no words; repeated rows are separate documents, and equal in all that is returned; texts of
any length are counted whole; an empty table gives no rows; a source of size 0 has target 0 and no copies; columns of any name
are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, hash_bits, materialise, table

BLOCK_ROWS = 10_000
#: Relative weights of the sources, by code point, repeating.
WEIGHTS = (1, 2, 3)
CAP = 3.0


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(no_source, source_key, source_size) to the same with ``target``.

    Water filling: with sources in order of cap * size / weight, those before the first that lies above
    the level which the rest would share get cap * size; the rest share what is left by weight.
    """
    w = Window.orderBy("no_source", "source_key")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(w) - 1, F.lit(n)) + 1)
    out = sizes.withColumn("weight", weight).withColumn("full", F.lit(float(cap)) * F.col("source_size"))
    out = out.withColumn("filled_at", F.col("full") / F.col("weight"))
    up = Window.orderBy("filled_at", "no_source", "source_key")
    below = F.coalesce(F.sum("full").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("level", (F.sum("source_size").over(everything) - below) / rest)
    level = F.min(F.when(F.col("filled_at") >= F.col("level"), F.struct("filled_at", "no_source", "source_key", "level"))).over(everything)
    out = out.withColumn("final", level["level"])
    return out.select("no_source", "source_key", "source_size", F.when(F.col("filled_at") < F.col("final"), F.col("full")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def systematic_copies(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """Two struct columns: ``row``, the columns of ``docs`` (those in ``keep``), and ``mix``: size, source_size, target, copies."""
    salts = max(1, math.ceil(docs.count() / BLOCK_ROWS))
    others = [f.name for f in docs.schema.fields if f.name not in (text, doc_id) and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    none = F.lit("~")
    # user columns travel in one struct, so no name of theirs can meet one of these
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("id"), word_count(text).alias("size"), F.coalesce(F.col(source), F.lit("")).alias("key"),
        F.col(source).isNull().alias("none"), F.coalesce(F.md5(F.col(text)), none).alias("digest"), F.xxhash64(F.lit(9), *[F.col(f"`{c}`") for c in others]).alias("rest"),
    )
    salt = hash_bits(F.concat(F.coalesce(F.col("id").cast("string"), none), F.lit("|"), F.col("digest")), 12)
    sized = sized.withColumns({"salt": F.pmod(salt, F.lit(salts)).cast("int"), "class": F.length(F.bin("size"))})
    where = ["none", "key", "class", "salt"]
    blocks = materialise(sized.groupBy(where).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    sums = blocks.groupBy(F.col("none").alias("no_source"), F.col("key").alias("source_key")).agg(F.sum("words").alias("source_size"))
    goal = targets(sums, weights, cap).select(F.col("no_source").alias("none"), F.col("source_key").alias("key"), "source_size", "target")
    earlier = Window.partitionBy("none", "key").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(goal, ["none", "key"])
    blocks = materialise(blocks.select(*where, "before", "source_size", "target"))
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy(where).orderBy("size", "id", "digest", "rest"))).join(blocks, where)
    offset = hash_bits(F.concat(F.lit(seed + ":"), "key", F.col("none").cast("string")), 8) / F.lit(2.0**32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("before") + F.col("rank")
    copies = F.least(F.floor(offset + rate * rank) - F.floor(offset + rate * (rank - 1)), F.lit(math.ceil(cap)))
    return ranked.select("row", F.struct("size", "source_size", "target", copies.cast("long").alias("copies")).alias("mix"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it was drawn, with the columns of ``docs``."""
    out = systematic_copies(docs, **options).where("mix.copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int")))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = systematic_copies(docs, keep=["doc_id"])
    return out.select("row.doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def _oracle(docs: str) -> str:
    return f"""
sized AS (SELECT doc_id, COALESCE(source, '') AS k, source IS NULL AS nos,
  CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
  COALESCE(md5(text), '~') AS digest, CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '~') || '|' || COALESCE(md5(text), '~')), 1, 12) AS BIGINT)
    % (SELECT GREATEST(1, CAST(CEIL(COUNT(*) / {BLOCK_ROWS}.0) AS BIGINT)) FROM {docs}) AS salt FROM {docs}),
src AS (SELECT nos, k, CAST(SUM(size) AS BIGINT) AS source_size, ROW_NUMBER() OVER (ORDER BY nos, k) AS rn FROM sized GROUP BY nos, k),
wt AS (SELECT *, CAST((rn - 1) % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS f FROM src),
lv AS (SELECT *, f / w AS fill, ((SELECT SUM(source_size) FROM src) - COALESCE(SUM(f) OVER (ORDER BY f / w, nos, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / SUM(w) OVER (ORDER BY f / w, nos, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM wt),
fin AS (SELECT lev AS l FROM lv WHERE fill >= lev ORDER BY fill, nos, k LIMIT 1),
tg AS (SELECT nos, k, source_size, CASE WHEN fill < l THEN f ELSE l * w END AS target,
  CAST(CAST('0x' || substr(md5('mix:' || k || CAST(nos AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM lv, fin),
rk AS (SELECT doc_id, size, nos, k, ROW_NUMBER() OVER (PARTITION BY nos, k ORDER BY length(bin(size)), salt, size, doc_id NULLS FIRST, digest) AS r FROM sized),
mixed AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, u, r FROM rk JOIN tg USING (nos, k)),
taken AS (SELECT *, CAST(LEAST(FLOOR(u + rate * r) - FLOOR(u + rate * (r - 1)), 3) AS BIGINT) AS copies FROM mixed)"""


ORACLE = "WITH " + _oracle("documents") + "\nSELECT doc_id, size, source_size, target, size * copies AS taken FROM taken"

"""Operator 10: sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by the leading bits of a row's hash. It starts with one bucket; a bucket whose
rows exceed the byte limit is split on its next bit, and only such a bucket is. A row's shard is the
prefix at which its bucket fits.

The rows are summed once into cells of a few bits more than the expected depth. Whether a bucket of any
depth is oversized follows from the cells alone, so the directory is built without reading rows
again. Cells that are still too large go on to deeper cells, and only their rows are summed again.

Cases: null text has 0 bytes; null doc_ids hash as one value, with their text; an empty table gives no
rows. A single text above the limit can't fit: it ends in a shard of its own with ``fits`` false. Rows
that are equal in doc_id and text share all bits: where together they exceed the limit, their bucket
gets overflow pages, numbered in ``page``, each within the limit. Texts of any length go whole; columns of any name are kept
as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_bits, materialise, table

BITS = 48
LIMIT_BYTES = 16 << 20
#: Bits of a first cell beyond the depth that even buckets would need, and bits added for cells that are still too large.
SLACK, STEP = 4, 11


def shard_key(doc_id: str, text: str) -> F.Column:
    none = F.lit("~")
    return hash_bits(F.concat(F.coalesce(F.col(doc_id).cast("string"), none), F.lit("|"), F.coalesce(F.md5(F.col(text)), none)), 12)


def _depths(cells: DataFrame, first: int, bits: int, limit: int) -> DataFrame:
    """For each cell of ``bits`` bits the depth at which its bucket fits, from depth ``first`` on; null if the cell is too large."""
    up = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(first), F.lit(bits))).alias("depth"))
    up = up.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    sums = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"))
    at = up.drop("bytes").join(sums.where(F.col("bytes") <= limit), ["depth", "prefix"], "left")
    return at.groupBy("cell").agg(F.min(F.when(F.col("bytes").isNotNull(), F.struct("depth", "prefix", "bytes"))).alias("leaf"))


def extendible_shards(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Two struct columns: ``row``, the columns of ``docs`` (those in ``keep``), and ``shard``: id, depth, page, n_bytes, shard_bytes, fits."""
    # user columns travel in one struct, so no name of theirs can meet one of these
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), shard_key(doc_id, text).alias("shard_hash"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("shard_n"))
    slim = materialise(keyed.groupBy("shard_hash").agg(F.sum("shard_n").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    bits = min(BITS, max(1, math.ceil(math.log2(max(1.0, total / limit_bytes))) + SLACK))
    first, rest, leaves = 0, slim, None
    while True:
        cells = rest.groupBy(F.shiftright("shard_hash", BITS - bits).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        found = materialise(_depths(cells, first, bits, limit_bytes))
        if bits == BITS:  # equal rows or one long text: nothing is left to split on
            found = materialise(found.select("cell", F.coalesce("leaf", F.struct(F.lit(BITS).alias("depth"), F.col("cell").alias("prefix"), F.lit(None).cast("long").alias("bytes"))).alias("leaf")))
        rest = rest.withColumn("cell", F.shiftright("shard_hash", BITS - bits))
        done = rest.join(found.where("leaf IS NOT NULL"), "cell").select("shard_hash", F.col("leaf.depth").alias("depth"), F.col("leaf.prefix").alias("prefix"), F.coalesce("leaf.bytes", "bytes").alias("shard_bytes"), F.col("leaf.bytes").isNull().alias("over"), "rows")
        leaves = done if leaves is None else leaves.unionByName(done)
        large = found.where("leaf IS NULL").select("cell")
        if bits == BITS or large.isEmpty():
            break
        rest = materialise(rest.join(large, "cell", "left_semi").drop("cell"))
        first, bits = bits + 1, min(BITS, bits + STEP)
    leaves = materialise(leaves.select("shard_hash", F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), "shard_bytes", F.col("over").alias("shard_over"), F.col("rows").alias("shard_rows")))
    out = keyed.join(leaves, "shard_hash")
    many = (F.col("shard_over")) & (F.col("shard_rows") > 1)
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest(F.lit(1), F.col("shard_n"))))
    page = F.row_number().over(Window.partitionBy("shard_hash").orderBy("shard_n"))
    # equal rows only: the window never meets other rows
    paged = out.where(many).withColumn("shard_page", F.floor((page - 1) / per_page))
    paged = paged.withColumn("shard_bytes", F.least(per_page, F.col("shard_rows") - F.col("shard_page") * per_page) * F.col("shard_n"))
    out = out.where(~many).withColumn("shard_page", F.lit(0).cast("long")).unionByName(paged.select(*out.columns, "shard_page"))
    bits_text = F.when(F.col("shard_depth") > 0, F.lpad(F.bin("shard_prefix"), F.col("shard_depth"), F.lit("0"))).otherwise("")
    shard = F.struct(
        F.concat(F.lit("s"), bits_text).alias("id"), F.col("shard_depth").alias("depth"), F.col("shard_page").cast("long").alias("page"),
        F.col("shard_n").alias("n_bytes"), F.col("shard_bytes").cast("long").alias("shard_bytes"), (F.col("shard_bytes") <= limit_bytes).alias("fits"),
    )
    return out.select("row", shard.alias("shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return extendible_shards(docs, keep=["doc_id"]).select("row.doc_id", F.col("shard.id").alias("shard"), "shard.depth", "shard.page", "shard.n_bytes", "shard.shard_bytes")


def _oracle(limit: int) -> str:
    """Every bucket of every depth at once; rows equal in doc_id and text beyond the limit are left to the tests."""
    return f"""
WITH h AS (SELECT doc_id, CAST(COALESCE(strlen(text), 0) AS BIGINT) AS n_bytes,
  CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '~') || '|' || COALESCE(md5(text), '~')), 1, 12) AS BIGINT) AS h FROM documents),
lv AS (SELECT h, n_bytes, d, h >> ({BITS} - d) AS p FROM h, (SELECT UNNEST(range({BITS + 1})) AS d)),
tot AS (SELECT d, p, SUM(n_bytes) AS b FROM lv GROUP BY d, p),
leaf AS (SELECT h, CAST(MIN(d) AS INTEGER) AS depth FROM (SELECT DISTINCT h, d, p FROM lv) JOIN tot USING (d, p) WHERE b <= {limit} OR d = {BITS} GROUP BY h)
SELECT doc_id, 's' || CASE WHEN depth > 0 THEN lpad(bin(h >> ({BITS} - depth)), depth, '0') ELSE '' END AS shard, depth, CAST(0 AS BIGINT) AS page, n_bytes, CAST(b AS BIGINT) AS shard_bytes
FROM h JOIN leaf USING (h) JOIN tot ON tot.d = depth AND tot.p = h >> ({BITS} - depth)"""


ORACLE = _oracle(LIMIT_BYTES)

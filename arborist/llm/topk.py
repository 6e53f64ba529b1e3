"""Operator 1: exact top-k search by inner product on a bit-sliced index.

Vectors are quantised to integers and held in blocks as bit slices: one bitmap over the block's rows for
each dimension and bit. For a query the slices are added up with bitmap arithmetic (full adders on
64 rows a word) into the slices of the scores. The best k rows are then selected from the most significant
slice downward: rows that have the bit, while there are fewer than k of them, are in for certain,
and the rest stay tied; the rows tied at the boundary are resolved exactly, by the smaller id.

Scores are read from the slices and exact, so each block's best k hold the overall best k, and a window over k rows a
block and query ends the search. Rows are dealt to blocks by their id's hash, and a block's slices are built once and written
as one row of the index. Each group of ``GROUP_QUERIES`` queries then meets each block: a task holds one block's slices and one
group. Queries against blocks are the stated query set, in blocks; what is copied for it are slices, not vectors.

Cases: vectors that are null, empty or hold null or non-finite components, and rows without id, take no
part; vectors meet only vectors of the same length; a query never meets rows of its own id; repeated
rows, and rows of one id, are candidates each, in any order among equals; a repeated query id is asked once, with its smallest vector; scores must
fit in 62 bits, else the operator raises an error; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, materialise, table

SCALE = 256.0
BLOCK_ROWS, GROUP_QUERIES = 1 << 16, 256
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """(id, v): whole vectors as integers."""
    x = F.col(embedding)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    ints = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(scale)).cast("long"))
    return vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select(F.col(vec_id).cast("long").alias("id"), ints.alias("v"))


def build_slices(values: np.ndarray, bits: int) -> np.ndarray:
    """values (rows, dims), not negative, to bitmaps (dims, bits, words)."""
    rows, dims = values.shape
    out = np.zeros((dims, bits, -(-rows // 64)), np.uint64)
    padded = np.zeros(out.shape[2] * 64, bool)
    for d in range(dims):
        for b in range(bits):
            padded[:rows] = (values[:, d] >> b) & 1
            out[d, b] = np.packbits(padded, bitorder="little").view(np.uint64)
    return out


def add_slices(total: list[np.ndarray], addend: np.ndarray, shift: int) -> None:
    """total += addend << shift, on bit slices."""
    carry = None
    i = shift
    for x in addend:
        while len(total) <= i:
            total.append(np.zeros_like(x))
        a = total[i]
        half = a ^ x
        if carry is None:
            total[i], carry = half, a & x
        else:
            total[i], carry = half ^ carry, (a & x) | (carry & half)
        i += 1
    while carry is not None and carry.any():
        if i == len(total):
            total.append(carry)
            break
        a = total[i]
        total[i], carry = a ^ carry, a & carry
        i += 1


def score_slices(slices: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices of the sum of |q| * v over the dimensions where q > 0, and of |q| * (top - v) where q < 0."""
    total: list[np.ndarray] = []
    size = np.abs(query)
    for d in np.flatnonzero(size).tolist():
        x = slices[d] if query[d] > 0 else ~slices[d]
        n, j = int(size[d]), 0
        while n >> j:
            if n >> j & 1:
                add_slices(total, x, j)
            j += 1
    return total or [np.zeros(slices.shape[2], np.uint64)]


def select_top(total: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k largest sums among ``valid``; of equal ones the smaller row numbers."""
    sure, tied, n_sure = np.zeros_like(valid), valid, 0
    for x in reversed(total):
        one = tied & x
        n = int(np.bitwise_count(one).sum())
        if n_sure + n <= k:
            sure, n_sure, tied = sure | one, n_sure + n, tied & ~x
        else:
            tied = one
        if n_sure == k:
            break
    flat = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    return np.concatenate([flat(sure), flat(tied)[: k - n_sure]])


def sums_at(total: list[np.ndarray], rows: np.ndarray) -> list[int]:
    """The sums of some rows, put together from their bits."""
    out = [0] * len(rows)
    word, shift = rows // 64, (rows % 64).astype(np.uint64)
    for i, x in enumerate(total):
        for at in np.flatnonzero((x[word] >> shift) & np.uint64(1)).tolist():
            out[at] += 1 << i
    return out


INDEX = "block int, dims int, low long, bits int, ids binary, slices binary"


def _index(key, rows: pd.DataFrame) -> pd.DataFrame:
    """A block's vectors of one length to one row: ids in order and the slices of the components less the smallest."""
    rows = rows.sort_values("id", kind="stable")
    values = np.stack(rows["v"].to_list()).astype(np.int64)
    low = int(values.min())
    bits = max(1, (int(values.max()) - low).bit_length())
    slices = build_slices(values - low, bits)
    return pd.DataFrame([(key[0], key[1], low, bits, rows["id"].to_numpy(np.int64).tobytes(), slices.tobytes())], columns=["block", "dims", "low", "bits", "ids", "slices"])


def _search(k: int):
    def block(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        for dims, low, bits, ids, slices in zip(*(index[c] for c in ("dims", "low", "bits", "ids", "slices"))) if len(queries) else ():
            ids = np.frombuffer(ids, np.int64)
            slices = np.frombuffer(slices, np.uint64).reshape(dims, bits, -1)
            valid = np.packbits(np.arange(slices.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
            for own, v in zip(queries["id"].tolist(), queries["v"].to_list()):
                q = np.asarray(v, np.int64)
                mine = valid.copy()
                for r in range(*np.searchsorted(ids, [own, own + 1]).tolist()):
                    mine[r // 64] &= ALL ^ np.uint64(1 << (r % 64))
                total = score_slices(slices, q)
                best = select_top(total, mine, k)
                # what the slices leave out: the smallest component, and the complement of the negative parts
                rest = low * int(q.sum()) + ((1 << bits) - 1) * int(q[q < 0].sum())
                found += [(own, int(ids[r]), x + rest) for r, x in zip(best.tolist(), sums_at(total, best))]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return block


def build_index(rows: DataFrame, n_blocks: int) -> DataFrame:
    """One row a block and vector length, of quantised rows (id, v)."""
    dealt = rows.withColumn("block", bucket_of(F.col("id"), n_blocks)).withColumn("dims", F.size("v"))
    return materialise(dealt.groupBy("block", "dims").applyInPandas(_index, INDEX))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = SCALE) -> DataFrame:
    """Each query's k rows of the highest integer inner products: query_id, rank, vec_id, score."""
    rows = quantised(vectors, vec_id, embedding, scale)
    asked = quantised(queries, vec_id, embedding, scale).groupBy("id").agg(F.min("v").alias("v"))
    size = rows.agg(F.count(F.lit(1)), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))), F.max(F.size("v"))).first()
    if size[0] and math.log2(max(1, size[1])) * 2 + math.log2(size[2]) > 61:
        raise ValueError(f"components up to {size[1]} in {size[2]} dimensions don't fit in 62-bit scores")
    n_blocks = max(1, math.ceil(size[0] / BLOCK_ROWS))
    index = build_index(rows, n_blocks)
    n_groups = max(1, math.ceil(asked.count() / GROUP_QUERIES))
    keys = ["block", "group", "dims"]
    index = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_groups)).cast("int")).withColumn("dims", F.size("v"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    found = index.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(FLOOR(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
e AS (SELECT vec_id, UNNEST(v) AS x, UNNEST(range(len(v))) AS d FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(SUM(q.x * c.x) AS BIGINT) AS score FROM e q JOIN e c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""

"""Operator 8: quality classifier, hashed word n-gram logistic regression trained by FTRL-proximal.

Tokens are runs of letters and digits and runs of other signs, as written; a token equal to the one before
is replaced by a repeat mark. Single tokens and pairs are hashed into ``FEATURES`` weights; a feature's
value is the square root of its share of the text's features, so a text is a vector of length 1. A score
is one sparse dot product with the weights, which are a broadcast of fixed size.

Training rows are a sample of at most ``SAMPLE_ROWS`` labelled documents (all, if fewer), those with the
smallest hash of their id, and of these, in that order, as many as have ``SAMPLE_FEATURES`` features in all. Their features
are made on all executors; follow-the-regularised-leader is an online method, so one task runs it over the sample's feature
lists, which take 8 bytes a feature.

Cases: null or empty text has the bias alone; documents without label are scored like others; a document
with several labels learns the largest, null labels are left out; rows that share an id are scored each, and the one with the
smallest text is learned from; texts of any length have at most ``FEATURES`` features; without any training row every score is 0.5; an empty table gives no rows; a null doc_id counts as held out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_bits, table
from .textbytes import SPACE, chunks, gram_hash, mix, prefix_hash, runs, span_hash

FEATURES = 1 << 20
SAMPLE_ROWS, SAMPLE_FEATURES = 20_000, 30_000_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1
#: Updates that training makes in all, in at least MIN_EPOCHS rounds over the sample and at most MAX_EPOCHS.
UPDATES, MIN_EPOCHS, MAX_EPOCHS = 60_000, 3, 40
THRESHOLD = 0.3

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
REPEAT = np.uint64(0x5851F42D4C957F2D)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature numbers and values of each text, flat, and each text's first; number 0 is the bias."""
    prefix = prefix_hash(buf)
    starts, ends, _ = runs(LETTER[buf], offs)
    sign_starts, sign_ends, _ = runs(~LETTER[buf] & ~SPACE[buf], offs)
    starts, ends = np.concatenate([starts, sign_starts]), np.concatenate([ends, sign_ends])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    tokens, first = span_hash(prefix, starts, ends), np.searchsorted(starts, offs)
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.uint64), np.diff(first))
    seconds = tokens.copy()
    if len(tokens) > 1:
        seconds[1:][(tokens[1:] == tokens[:-1]) & (doc[1:] == doc[:-1])] = REPEAT
    pairs = gram_hash(seconds, 2)
    inside = doc[1:] == doc[:-1]
    high, size = np.uint64(32), np.uint64(FEATURES - 1)
    keys = np.concatenate([(doc << high) | (mix(seconds) % size + np.uint64(1)), ((doc[1:] << high) | (pairs % size + np.uint64(1)))[inside], np.arange(len(offs) - 1, dtype=np.uint64) << high])
    keys, counts = np.unique(keys, return_counts=True)
    start = np.searchsorted(keys, np.arange(len(offs), dtype=np.uint64) << high)
    total = np.add.reduceat(counts, start[:-1]) if len(start) > 1 else counts
    number, value = (keys & np.uint64(0xFFFFFFFF)).astype(np.int32), np.sqrt(counts / np.repeat(total, np.diff(start)))
    value[number == 0] = 1.0
    return number, value.astype(np.float32), start


def _scores(buf: np.ndarray, offs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    number, value, first = features(buf, offs)
    sums = np.concatenate([[0.0], np.cumsum(weights[number] * value, dtype=np.float64)])
    return 1.0 / (1.0 + np.exp(-np.clip(sums[first[1:]] - sums[first[:-1]], -35, 35)))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for _, _, buf, offs in chunks(batch["text"]):
            number, value, first = features(buf, offs)
            found += [(number[a:b].tobytes(), value[a:b].tobytes()) for a, b in zip(first[:-1], first[1:])]
        columns = [pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch["order"], batch["label"], *columns], ["order", "label", "numbers", "values"])


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights after rounds of FTRL-proximal over (label, distinct features, values)."""
    epochs = min(MAX_EPOCHS, max(MIN_EPOCHS, UPDATES // max(1, len(rows))))
    z, n, w = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    for _ in range(epochs):
        for label, x, value in rows:
            g = (1.0 / (1.0 + np.exp(-np.clip(w[x] @ value, -35, 35))) - label) * value
            old, now = n[x], n[x] + g * g
            root = np.sqrt(now)
            zx = z[x] + g - (root - np.sqrt(old)) / ALPHA * w[x]
            z[x], n[x] = zx, now
            w[x] = np.where(np.abs(zx) > L1, (np.sign(zx) * L1 - zx) / ((BETA + root) / ALPHA + L2), 0.0)
    return w


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample in order to weights; what comes after SAMPLE_FEATURES is not kept."""
    rows, n = [], 0
    for batch in batches:
        for y, x, v in zip(*(batch[c].to_pylist() for c in ("label", "numbers", "values"))):
            n += len(x) // 4
            if n > SAMPLE_FEATURES and rows:
                break
            rows.append((y, np.frombuffer(x, np.int32), np.frombuffer(v, np.float32)))
        if n > SAMPLE_FEATURES:
            break
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([ftrl(rows).astype(np.float32).tobytes()], pa.binary())], ["weights"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learned from ``labels`` (doc_id, label) of documents (doc_id, text)."""
    asked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = hash_bits(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")), 12)
    sample = asked.withColumn("order", order).orderBy("order", "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("order", "doc_id", "label").agg(F.min("text").alias("text"))
    rows = rows.select("order", "label", "text").mapInArrow(_feature_rows, "order long, label int, numbers binary, values binary")
    found = rows.repartition(1).sortWithinPartitions("order", "label", "numbers", "values").mapInArrow(_train, "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros(FEATURES, np.float32)


def _scorer(weights) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_scores(buf, offs, weights.value) for _, _, buf, offs in chunks(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(found) if found else np.zeros(0))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row of documents (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(shared), "doc_id long, score double")


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows aren't read."""
    weights = fit(docs, labels.where(~held_out()))
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, whole rows; labels decide nothing here."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(~held_out())))

    @F.pandas_udf("double")
    def quality(text: pd.Series) -> pd.Series:
        found = [_scores(buf, offs, shared.value) for _, _, buf, offs in chunks(pa.array(text, pa.string(), from_pandas=True))]
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    return docs.where(quality("text") >= THRESHOLD)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))

"""Operator 5: language identification with language-bitmask n-gram filters.

Texts are lower-cased, signs and digits become spaces, and every 4-byte string with no two spaces in a row
is an n-gram. Learning counts the n-grams of each language over all training texts; a language contains those that make
up at least ``SHARE`` of its n-grams, so that a foreign word here and there teaches it nothing. They are entered into one Bloom
filter a language, and the filters are stored bit-sliced: row by row, one bit a language. A look-up ANDs the rows that an
n-gram hashes to and gets the bitmask of all languages that contain it. A text's language is the one with the most hits
(popcount of its bit over the text's n-grams), after the hits that its filter's false-positive rate explains are taken off.

The filters are a broadcast of ``ROWS`` bits a language; a language has at most 1 / ``SHARE`` n-grams. Their words are put
together by a grouping, so no language's n-grams go through one task.

Cases: null text, and text without a letter, is ``und`` with score 0; a text with letters but no n-gram, and
ties, get the language that more training n-grams have, then the smaller name; null languages are not learned;
repeated rows are answered each; without any training row everything is ``und``; an empty table
gives no rows; a null doc_id is never learned from and counts as held out; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textbytes import LOWER, chunks, mix

ROWS_LOG, HASHES = 20, 3
ROWS = 1 << ROWS_LOG
SHARE = 1e-5

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte n-grams of each text, flat, and each text's first."""
    n = len(offs) - 1
    low = np.where(LETTER[buf], LOWER[buf], np.uint8(32))
    latin = (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97) & (low[:-1] == 0xC3)
    low[1:][latin] += 32
    wide = np.full(len(buf) + 2 * n + 2, 32, np.uint8)
    wide[np.arange(len(buf)) + np.repeat(2 * np.arange(n) + 1, np.diff(offs))] = low
    # two spaces stand between texts, so that no n-gram crosses
    x = wide.astype(np.uint32)
    key = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    gap = (wide[:-1] == 32) & (wide[1:] == 32)
    at = np.flatnonzero(~(gap[:-2] | gap[1:-1] | gap[2:]))
    return key[at], np.searchsorted(at, offs + 2 * np.arange(n + 1))


def _count(langs: list[str]) -> Callable:
    names = pa.array(langs, pa.string())

    def squeeze(keys: list, counts: list) -> tuple[list, list]:
        both, where = np.unique(np.concatenate(keys), return_inverse=True)
        return [both], [np.bincount(where, np.concatenate(counts), len(both)).astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            code = pc.index_in(batch["lang"], value_set=names).to_numpy(zero_copy_only=False)
            for a, b, buf, offs in chunks(batch["text"]):
                flat, first = grams(buf, offs)
                of = np.repeat(code[a:b].astype(np.int64), np.diff(first))
                for lang in np.unique(of):
                    k, c = np.unique(flat[of == lang], return_counts=True)
                    keys.append(k.astype(np.int64) | int(lang) << 32)
                    counts.append(c)
            if len(keys) > 64:
                keys, counts = squeeze(keys, counts)
        if keys:
            (key,), (count,) = squeeze(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array(key & 0xFFFFFFFF), pa.array(count)], ["lang", "gram", "n"])

    return run


def _places(gram: np.ndarray) -> list[np.ndarray]:
    h = mix(gram.astype(np.uint64) + np.uint64(1))
    return [((h >> np.uint64(ROWS_LOG * i)) & np.uint64(ROWS - 1)).astype(np.int64) for i in range(HASHES)]


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter rows of n-grams: language, word of 64 rows, bit in it."""
    for batch in batches:
        for place in _places(batch["gram"].to_numpy()):
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array((place >> 6).astype(np.int32)), pa.array((place & 63).astype(np.int32))], ["lang", "word", "bit"])


class Filters:
    """Bit-sliced filters: ``slices[w][row]`` has one bit for each of the languages 64 * w to 64 * w + 63."""

    def __init__(self, found: list[tuple[str, np.ndarray]]):
        """Of each language its name and its filter, a word of 64 rows each."""
        self.langs, self.fill = [name for name, _ in found], np.zeros(len(found))
        self.slices = np.zeros((-(-len(found) // 64), ROWS), np.uint64)
        for i, (_, words) in enumerate(found):
            rows = np.unpackbits(words.view(np.uint8), bitorder="little")
            self.fill[i] = rows.mean() ** HASHES
            self.slices[i // 64] |= rows.astype(np.uint64) << np.uint64(i % 64)

    def hits(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each text's corrected hits for each language."""
        out = np.zeros((len(first) - 1, len(self.langs)))
        places, n = _places(flat), np.diff(first)
        for w, rows in enumerate(self.slices):
            mask = rows[places[0]]
            for place in places[1:]:
                mask &= rows[place]
            for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                sums = np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
                fp = self.fill[i]
                out[:, i] = np.clip((sums[first[1:]] - sums[first[:-1]] - n * fp) / max(1e-9, 1 - fp), 0, None)
        return out


def learn(docs: DataFrame) -> Filters | None:
    """Filters from all documents (text, lang) with a language."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    langs = sorted(r[0] for r in docs.select("lang").distinct().collect())  # names of languages: a few hundred at most
    counts = docs.mapInArrow(_count(langs), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}  # one row a language
    if not totals:
        return None
    least = F.create_map(*[F.lit(x) for lang, total in totals.items() for x in (lang, SHARE * total)])
    kept = counts.where(F.col("n") >= least[F.col("lang")]).select("lang", "gram")
    words = kept.mapInArrow(_bits, "lang int, word int, bit int").groupBy("lang", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()  # ROWS / 64 a language
    lang, word, bits = (words[c].to_numpy() for c in ("lang", "word", "bits"))
    found = []
    for i in sorted(totals, key=lambda i: (-totals[i], langs[i])):
        own = np.zeros(ROWS // 64, np.uint64)
        own[word[lang == i]] = bits[lang == i].view(np.uint64)
        found.append((langs[i], own))
    return Filters(found)


def _answer(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text, langs, scores = batch["text"], [], []
            for a, b, buf, offs in chunks(text):
                sums = np.concatenate([[0], np.cumsum(ASCII_LETTER[buf])])
                letters = sums[offs[1:]] > sums[offs[:-1]]
                for i in np.flatnonzero(~letters).tolist():
                    letters[i] = any(map(str.isalpha, text[a + i].as_py() or ""))
                if model is None:
                    langs += ["und"] * (b - a)
                    scores.append(np.zeros(b - a))
                    continue
                flat, first = grams(buf, offs)
                hits = model.hits(flat, first)
                best = hits.argmax(axis=1)
                langs += [model.langs[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist())]
                scores.append(np.where(letters, np.clip(hits.max(axis=1) / np.maximum(1, np.diff(first)), 0, 1), 0.0))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Filters | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of documents (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_answer(shared), "doc_id long, lang_pred string, score double")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    return identify(docs, learn(docs.where(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")

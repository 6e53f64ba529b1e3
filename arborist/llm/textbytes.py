"""Vectorised helpers over the UTF-8 bytes of a batch of texts.

All of them work inside a Spark task on one Arrow batch. A batch is cut into chunks of
about ``CHUNK_BYTES`` of text, so that temporaries stay small whatever the batch holds; a
longer text is a chunk of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Word separators of the contracts: space and bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the rolling-hash base and of its inverse modulo 2**64."""
    for key, base in (("up", _BASE), ("down", _INVERSE)):
        have = _POWERS[key]
        while len(have) <= n:
            have = np.concatenate([have, have * (have[-1:] * np.array([base]))])
        _POWERS[key] = have
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive whole texts, about ``size`` bytes each."""
    buf, offs = column_bytes(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that don't cross texts: starts, ends, and each text's first run."""
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    edges = offs[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; see ``span_hash``."""
    up, _ = _powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal bytes wherever they stand."""
    _, down = _powers(len(prefix))
    raw = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """``span_hash`` of all spans of ``width`` bytes, by their starts."""
    n = max(0, len(prefix) - width)
    _, down = _powers(len(prefix))
    raw = prefix[width : width + n] - prefix[:n]
    raw *= down[:n]
    raw += np.uint64(width * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    return mix(raw)


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and each text's first word."""
    starts, ends, first = runs(~SPACE[buf], offs)
    return span_hash(prefix_hash(LOWER[buf] if lower else buf), starts, ends), first


def gram_hash(tokens: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive tokens of one flat array."""
    m = len(tokens) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, seed + n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD1342543DE82EF95) + tokens[k : k + m]
        h ^= h >> np.uint64(29)
    return mix(h)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles.

    A text with fewer words has its whole word sequence as one shingle; one without words has none.
    """
    tokens, first = words(buf, offs)
    grams = gram_hash(tokens, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(gram_hash(tokens[a:b], b - a, seed=77))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)

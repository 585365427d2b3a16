"""Hashes of words and shingles of whole texts, vectorised over chunks of an Arrow batch.

A word's hash is a polynomial over random 64-bit values of its bytes, modulo 2^64, mixed; words
of a chunk are hashed together from one prefix sum.  Nothing here depends on the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
CHUNK_BYTES = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) | U64(1)
_P = 0x9E3779B97F4A7C15 | 1
_Q = U64(0xD6E8FEB86659FD93)
_P_INV = U64(pow(_P, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("p", U64(_P)), ("i", _P_INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; a longer text is a range of its own."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of a mask whose last value is False."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask)).view(np.int8)))
    return edge[0::2], edge[1::2]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes."""
    power, inverse = _pow(len(buf) + 1)
    run = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=run[1:])
    return mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, first word of each text with the total at the end).

    A-Z count as a-z; words are runs of anything but ASCII white space.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts, ends = runs(~_SPACE[buf])
    h = hashes(_LOWER[buf], starts, ends)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return h, np.searchsorted(starts, at)


def shingles(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text its distinct `width`-word shingles as sorted 64-bit hashes.

    A text of fewer words has one, its whole sequence; a text without words has none.
    """
    h, first = words(texts)
    n = len(h)
    if n >= width:
        s = np.zeros(n - width + 1, dtype=np.uint64)
        for k in range(width):
            s = s * _Q + h[k : n - width + 1 + k]
        s = mix(s)
    else:
        s = np.zeros(0, dtype=np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            x = U64(b - a)
            with np.errstate(over="ignore"):
                for w in h[a:b]:
                    x = x * _Q + w
            out.append(mix(np.array([x], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def batch_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"").to_pylist()

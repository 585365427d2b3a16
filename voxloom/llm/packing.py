"""Best-fit packing with a swap-based local search.

Texts are tokenised where they are read; from there on only (id, piece, length, checksum) rows move.
Pieces are dealt at random into groups of bounded size and each group is packed by itself: best fit
in decreasing length, then exchanges between underfull bins that raise the sum of squared fills
(move one piece, swap one for one, two for one) until a round changes nothing; bins that have become
empty are gone.  Bins are indexed by the sizes they offer, so every underfull bin is searched.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import read_table, settle, trim_memory
from voxloom.llm.textnum import U64, hashes, runs

GROUP_PIECES = 50_000
CAPACITY = 2048
COUNTED_BYTES = 1 << 20  # from which the words of the texts so far are looked up
KNOWN_WORDS = 1 << 20  # whose numbers of tokens a process keeps, 16 bytes each; beyond them it begins anew
SPACED = U64(0x9E3779B97F4A7C15)  # tells a word after a space from the same one without

#: Texts of these characters only are split alike by both libraries; others go to `tokenizers` itself.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e¡-¬®-ſ‘-”–—€]*")


class ByteBpe:
    """Ids of the byte-level BPE vocabulary as `tokenizers` gives them.

    The same vocabulary's rank file is several times faster and is used for texts of plain characters
    without the opening of a special token; every other text goes to `tokenizers`.
    """

    def __init__(self, json_path: str, rank_path: str | None = None, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.fast = None
        self.known = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        if rank_path:
            import base64

            import tiktoken

            with open(rank_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            self.sizes[list(ranks.values())] = [len(x) for x in ranks]

    def plain(self, text: str) -> bool:
        return self.fast is not None and "<|" not in text and _PLAIN.fullmatch(text) is not None

    def ids(self, text: str) -> list[int]:
        if self.plain(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids

    def counts(self, texts: Iterable[str | None]) -> np.ndarray:
        """How many ids() each text has, none without a text.

        No id crosses the end of a word, a run of anything but white space with the one space before it, so
        a word of plain texts has the same number wherever it is and is encoded once; words are told apart
        by 64-bit hashes.  White space besides is encoded as the pattern cuts it: a run up to its last
        character where a word follows, and that character, where it is not a space.
        """
        out: list[int] = []
        held: list[tuple[int, bytes]] = []

        def look_up() -> None:
            for (i, _), n in zip(held, self._plain_counts([t for _, t in held]).tolist(), strict=True):
                out[i] = n
            held.clear()

        size = 0
        for text in texts:
            plain = bool(text) and self.plain(text)
            if plain:
                held.append((len(out), text.encode()))
                size += len(text)
            out.append(0 if plain or not text else len(self.ids(text)))
            if size >= COUNTED_BYTES:
                look_up()
                size = 0
        if held:
            look_up()
        return np.array(out, dtype=np.int64)

    def _plain_counts(self, texts: list[bytes]) -> np.ndarray:
        buf = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", dtype=np.uint8)  # a plain text has no 0
        first = np.cumsum([1, *(len(t) + 1 for t in texts)])
        starts, ends = runs((buf > 32) | (buf < 9) & (buf > 0))
        before = buf[starts - 1]
        spaced = before == 32
        key = hashes(buf, starts, ends) ^ np.where(spaced, SPACED, U64(0))
        found, one, which = np.unique(key, return_index=True, return_inverse=True)
        n = self._word_counts(buf, found, starts[one], ends[one], spaced[one])[which] + (~spaced & (before > 0))
        total = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(starts, first)]
        out = np.diff(total)
        space = (buf >= 9) & (buf <= 32)
        a, b = runs(np.concatenate((space[:-1] & (space[1:] | (buf[1:] == 0)), [False])))
        seen: dict[bytes, int] = {}
        for i, x, y in zip((np.searchsorted(first, a, "right") - 1).tolist(), a.tolist(), b.tolist(), strict=True):
            run = buf[x:y].tobytes()
            if run not in seen:
                seen[run] = len(self.fast.encode_ordinary(run.decode()))
            out[i] += seen[run]
        return out

    def _word_counts(self, buf: np.ndarray, key: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        """Numbers of distinct words; those that are new are encoded in one text, each after a space or a line's end."""
        keys, counts = self.known
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        new = np.flatnonzero(keys[at] != key) if len(keys) else np.arange(len(key))
        out = counts[at] if len(keys) else np.zeros(len(key), dtype=np.int64)
        if len(new):
            size = ends[new] - starts[new] + 1
            end = np.cumsum(size)
            text = buf[np.repeat(starts[new] - 1 - (end - size), size) + np.arange(end[-1])]
            text[end - size] = np.where(spaced[new], 32, 10)
            done = np.cumsum(self.sizes[self.fast.encode_ordinary(text.tobytes().decode())])
            out[new] = np.diff(np.searchsorted(done, end, "right"), prepend=0) - ~spaced[new]
            if len(keys) + len(new) > KNOWN_WORDS:
                keys, counts = keys[:0], counts[:0]
            keys, counts = np.concatenate((keys, key[new])), np.concatenate((counts, out[new]))
            order = np.argsort(keys, kind="stable")
            self.known = keys[order], counts[order]
        return out


_loaded: dict[tuple, ByteBpe] = {}


def default_paths() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def token_count(text: Column, paths: tuple[str, str, str]) -> Column:
    """Tokens of a text without the end; a null text has none."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        if paths not in _loaded:
            _loaded[paths] = ByteBpe(*paths)
        bpe = _loaded[paths]
        n = pa.array(bpe.counts(t.as_py() for t in texts), type=pa.int64())
        trim_memory()
        return n

    return count(text.cast("string"))


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of each piece; the first takes the remainder, all others are full."""
    n = len(ids)
    end = n - (-(-n // capacity) - 1) * capacity
    start = 0
    while start < n:
        yield start, ids[start:end]
        start, end = end, end + capacity


def pieces(df: DataFrame, paths: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row; a null text is empty: one token, the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _loaded:
            _loaded[paths] = ByteBpe(*paths)
        bpe = _loaded[paths]
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                doc, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids = np.array([*bpe.ids(text or ""), end_id], dtype="<u4")
                rows += [(doc, k, start, len(p), zlib.crc32(p.tobytes())) for k, (start, p) in enumerate(cut(ids, capacity))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: each piece, longest first, into the fullest bin that has room."""
    by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, []
            bins.append(b)
        b.append(i)
        room -= n
        by_room[room].append(b)
        mask |= 1 << room
    return bins


class Offers:
    """For each size, the emptiest bin that offers it.

    Bins change while the index stands; what it says of a bin is checked against `fill` and `sets` (the
    sizes a bin offers) when it is read, so a changed bin only has to be put in again.
    """

    def __init__(self, capacity: int, fill: list[int], sets: list):
        self.fill, self.sets = fill, sets
        self.heaps: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.least = np.full(capacity + 1, capacity + 1)  # no bin that offers a size is emptier

    def put(self, b: int) -> None:
        at = self.fill[b]
        for s in self.sets[b]:
            heappush(self.heaps[s], at * len(self.fill) + b)
            if at < self.least[s]:
                self.least[s] = at

    def donor(self, s: int, b: int, limit: int) -> int | None:
        """The emptiest bin other than b that offers s, if its fill is below the limit."""
        heap, n, own = self.heaps[s], len(self.fill), None
        while heap:
            at, a = divmod(heap[0], n)
            if self.fill[a] == at and s in self.sets[a]:
                if a != b:
                    break
                own = heap[0]
            heappop(heap)
        found = heap[0] if heap else None
        if own is not None:
            heappush(heap, own)
        self.least[s] = heap[0] // n if heap else len(self.least)
        return found % n if found is not None and found // n < limit else None

    def largest(self, low: int, high: int, b: int, j: int) -> tuple[int, int] | None:
        """(size, donor) of the largest size above low and up to high that b can get for j."""
        left = self.fill[b] - j
        able = np.flatnonzero(self.least[low + 1 : high + 1] < np.arange(left + low + 1, left + high + 1))
        for s in (able[::-1] + low + 1).tolist():
            if (a := self.donor(s, b, left + s)) is not None:  # the squares grow if b ends fuller than a was
                return s, a
        return None


def pair_sums(held: dict[int, list[int]]) -> set[int]:
    """Sums of two pieces of a bin."""
    sizes = list(held)
    return {s + t for k, s in enumerate(sizes) for t in sizes[:k]} | {2 * s for s in sizes if len(held[s]) > 1}


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Improve the underfull bins: every accepted exchange raises the sum of squared fills.

    Each round takes the underfull bins from the emptiest and fills each from all others: by the one move
    (a piece), swap (one for one) or double swap (two for one) that fills it most, until none raises the
    sum; a bin that has lost all its pieces is dropped.  Rounds end when nothing changes.
    Equal lengths in a bin are alike, so a bin has at most sqrt(2 * capacity) pieces to try.
    """
    fills = [int(lengths[b].sum()) for b in bins]
    full = [b for b, n in zip(bins, fills, strict=True) if n == capacity]
    open_ = [b for b, n in zip(bins, fills, strict=True) if n < capacity]
    fill = [n for n in fills if n < capacity]
    held: list[dict[int, list[int]]] = []  # pieces of each bin by length
    for b in open_:
        held.append({})
        for i in b:
            held[-1].setdefault(int(lengths[i]), []).append(i)
    sums = [pair_sums(h) for h in held]

    def give(a: int, b: int, s: int) -> None:
        held[b].setdefault(s, []).append(held[a][s].pop())
        if not held[a][s]:
            del held[a][s]
        fill[a] -= s
        fill[b] += s

    def best(b: int) -> tuple[int, list[int], int] | None:
        """(donor, sizes to get, size to give or 0) that fills b most."""
        room, gain, plan = capacity - fill[b], 0, None
        for offers in (ones, twos):
            for j in ([0, *held[b]] if offers is ones else held[b]):
                if gain < room and (got := offers.largest(j + gain, min(j + room, capacity), b, j)):
                    gain, plan = got[0] - j, (offers, *got, j)
        if plan is None:
            return None
        offers, s, a, j = plan
        first = s if offers is ones else next(x for x in held[a] if len(held[a].get(s - x, ())) > (2 * x == s))
        return a, [first] if first == s else [first, s - first], j

    changed = True
    while changed:
        changed = False
        ones, twos = Offers(capacity, fill, held), Offers(capacity, fill, sums)
        order = sorted((b for b in range(len(open_)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        for b in order:
            ones.put(b)
            twos.put(b)
        for b in order:
            gained = False
            while held[b] and fill[b] < capacity and (plan := best(b)):
                a, get, j = plan
                for s in get:
                    give(a, b, s)
                if j:
                    give(b, a, j)
                sums[a] = pair_sums(held[a])
                ones.put(a)
                twos.put(a)
                gained = True
            if gained:
                sums[b] = pair_sums(held[b])
                ones.put(b)
                twos.put(b)
                changed = True
    return full + [[i for same in h.values() for i in same] for h in held if h]


def pack_group(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each piece of one group."""
    bins = local_search(best_fit(length, capacity), length, capacity)
    which, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            which[i], offset[i] = k, at
            at += int(length[i])
    return which, offset


def pack(found: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces() with sequence_id and offset.  Pieces are computed once and kept; groups are dealt by
    row number in what was kept, so repeated rows and null ids spread like all others."""
    kept = settle(found.withColumn("__n", F.monotonically_increasing_id()))
    groups = max(1, -(-kept.count() // group_pieces))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n", ignore_index=True)
        which, offset = pack_group(pdf["length"].to_numpy(), capacity)
        out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = which + (pdf["__group"].to_numpy(dtype=np.int64) << 32)
        out["offset"] = offset
        return out

    dealt = kept.withColumn("__group", F.pmod(F.xxhash64("__n"), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(pieces(read_table(spark, sf_dir, "documents"), default_paths()))

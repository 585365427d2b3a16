"""Conversation structure repair by signature deduplication.

A conversation is a sequence of roles whose initials have to read (s?(ua)+)?.  Rows are blank, duplicates,
truncated or sound.  Rows become a string of one character each, in pieces of at most SEGMENT rows; each
distinct piece is solved once, for all ways to enter and leave it, by recursion over its halves with a
memo; the solutions are joined back, chained over each conversation, and the edits replayed on its rows.

Rows are narrow (digests instead of texts) until the replay, and are dealt by pages of turns, so one very
long conversation is read, marked and solved by many tasks.  The chain over its pieces and the replay pass
it by in order in one task, a batch at a time, with its audit in memory: a row of the result holds that audit, and a
digest of the repaired whole can only be computed in order.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import WORD, hot_join, read_table, settle

SEGMENT = 64  # rows of a piece
PAGE = 64  # turns of a page
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States: nothing yet, after s, after u, after a.  What each role's initial leads to.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEPS = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
GONE = "x"  # the character of a row that must be deleted; truncated rows are in capitals

Way = tuple[int, str] | None  # cost and audit of the cheapest way, ties to the least audit
Matrix = tuple[tuple[Way, ...], ...]  # by state before and after


def fill_in(state: int) -> dict[int, Way]:
    """States that inserts alone lead to."""
    out, here, n = {state: (0, "")}, state, 0
    while n < 2:
        here, n = (AFTER_A if here == AFTER_U else AFTER_U), n + 1
        out.setdefault(here, (INSERT * n, "I" * n))
    return out


def chain(left: Matrix, right: Matrix) -> Matrix:
    """Cheapest ways through both.  Equal costs never have audits of which one begins the other, as the rest
    would be inserts, so the least whole is made of least parts."""
    return tuple(
        tuple(min(((a[0] + b[0], a[1] + b[1]) for m in range(4) if (a := left[s][m]) and (b := right[m][t])), default=None) for t in range(4)) for s in range(4)
    )


@functools.lru_cache(maxsize=100_000)
def solve(signature: str) -> Matrix:
    """Cheapest ways through a piece, inserts before its rows included."""
    if len(signature) > 1:
        half = len(signature) // 2
        return chain(solve(signature[:half]), solve(signature[half:]))
    if not signature:
        return tuple(tuple((0, "") if s == t else None for t in range(4)) for s in range(4))
    rows, kind, extra = [], signature.lower(), TRUNCATED if signature.isupper() else 0
    for s in range(4):
        ways: list[list[tuple[int, str]]] = [[], [], [], []]
        for m, (cost, audit) in fill_in(s).items():
            ways[m].append((cost + DELETE, audit + "D"))
            if signature != GONE:
                if (to := STEPS.get(kind, {}).get(m)) is not None:
                    ways[to].append((cost + extra, audit + "K"))
                for role in "ua":
                    if (to := STEPS[role].get(m)) is not None:
                        ways[to].append((cost + REROLE + extra, audit + "R"))
        rows.append(tuple(min(w, default=None) for w in ways))
    return tuple(rows)


def closed(ways: list[Way]) -> tuple[int, str]:
    """The cheapest way that ends as a conversation may."""
    ends = []
    for s, way in enumerate(ways):
        if way:
            ends += [(way[0] + cost, way[1] + audit) for to, (cost, audit) in fill_in(s).items() if to in (START, AFTER_A)]
    return min(ends)


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, t, r, x, d): null roles and texts become one space; d is the text's digest."""
    blank = F.lit(" ")
    named = df.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role).cast("string"), blank).alias("r"), F.coalesce(F.col(text).cast("string"), blank).alias("x"))
    return named.withColumn("d", F.unhex(F.sha2("x", 256)))


def narrow(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(c, t, r, d, kind, n, first): equal rows of a turn as one with their number, and whether the first of
    them is the first of its role and text in the conversation.  kind: 0 sound, 1 blank, 2 truncated.
    A conversation of `ids` (c) without rows has one with n = 0.  No key is hot: sums fold before they
    are sent, and rows meet first turns by conversation, text and turn, which are unique on both sides."""
    last = F.substring(F.regexp_replace("x", r"[\x20\x09-\x0D]+$", ""), -1, 1)
    kind = F.when(~F.col("x").rlike(WORD), 1).when(~last.isin(".", "!", "?"), 2).otherwise(0).cast("int")
    marks = ids.select("c", *(F.lit(None).cast(t).alias(n) for n, t in (("t", "long"), ("r", "string"), ("d", "binary"), ("kind", "int"))), F.lit(0).alias("one"))
    every = rows.select("c", "t", "r", "d", kind.alias("kind"), F.lit(1).alias("one")).unionByName(marks)
    some = every.groupBy("c", "t", "r", "d", "kind").agg(F.sum("one").alias("n"))
    firsts = some.groupBy(F.col("c").alias("c1"), F.col("r").alias("r1"), F.col("d").alias("d1")).agg(F.bool_or(F.col("t").isNull()).alias("none"), F.min("t").alias("m"))
    firsts = firsts.select("c1", "r1", "d1", F.expr("IF(none, NULL, m)").alias("t1"), F.lit(True).alias("first"))
    on = functools.reduce(lambda p, q: p & q, (some[x].eqNullSafe(firsts[f"{x}1"]) for x in ("c", "r", "d", "t")))
    return some.join(firsts, on, "left").select("c", "t", "r", "d", "kind", "n", F.coalesce("first", F.lit(False)).alias("first"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_PIECE = ", ".join(("page long, seq long, sig string, head string, tail string, lo long, hi long", *(f"{n} long" for n in _COUNTS)))


class Piece:
    """What a piece of a conversation adds up to."""

    def __init__(self) -> None:
        self.sig: list[str] = []
        self.head = self.tail = None
        self.lo = self.hi = None
        self.n = dict.fromkeys(_COUNTS, 0)

    def add(self, turn: int | None, initial: str, kind: int, first: bool) -> None:
        if kind == 1:
            self.n["blank"] += 1
        elif not first:
            self.n["duplicate"] += 1
        elif kind == 2:
            self.n["truncated"] += 1
        role = initial if initial in STEPS else "o"
        self.sig.append(GONE if kind == 1 or not first else role.upper() if kind == 2 else role)
        if self.tail is None:
            self.head = role
        elif not legal(self.tail, role):
            self.n["illegal"] += 1
        self.tail = role
        if turn is not None and turn != self.hi:
            self.n["turns"] += 1
            self.lo, self.hi = turn if self.lo is None else self.lo, turn

    def row(self) -> tuple:
        return "".join(self.sig), self.head, self.tail, self.lo, self.hi, *self.n.values()


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 1 + sum(len(x) for x in row if isinstance(x, str)) // 4096
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def _named(conv: T.DataType, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("c", conv), *T.StructType.fromDDL(ddl).fields])


def pieces(found: DataFrame) -> DataFrame:
    """Rows of `narrow` -> pieces (c, page, seq, sig, ...): a page holds the conversation's turns of one range, in
    order of turn (nulls first), role and digest."""
    schema = _named(found.schema["c"].dataType, _PIECE)
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, seq, piece = (), 0, Piece()
            for batch in batches:
                for c, page, t, initial, kind, n, first in zip(*(batch.column(x).to_pylist() for x in ("c", "page", "t", "initial", "kind", "n", "first")), strict=True):
                    if (c, page) != at:
                        if at:
                            yield (*at, seq, *piece.row())
                        at, seq, piece = (c, page), 0, Piece()
                    for i in range(n):
                        if len(piece.sig) == SEGMENT:
                            yield (*at, seq, *piece.row())
                            seq, piece = seq + 1, Piece()
                        piece.add(t, initial, kind, first and not i)
            if at:
                yield (*at, seq, *piece.row())

        return _batches(rows(), arrow)

    paged = found.select("c", F.floor(F.col("t") / PAGE).cast("long").alias("page"), "t", "r", F.substring("r", 1, 1).alias("initial"), "d", "kind", "n", "first")
    dealt = paged.repartition("c", "page").sortWithinPartitions("c", "page", "t", "r", "d")
    return dealt.select("c", "page", "t", "initial", "kind", "n", "first").mapInArrow(run, schema)


def solutions(cut: DataFrame) -> DataFrame:
    """(sig, costs, audits) of the distinct pieces: 16 ways each, by state before and after."""
    schema = "sig string, costs array<int>, audits array<string>"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for sig in batch.column("sig").to_pylist():
                    ways = [w for row in solve(sig) for w in row]
                    yield sig, [w and w[0] for w in ways], [w and w[1] for w in ways]

        return _batches(rows(), arrow, 500)

    return cut.select("sig").distinct().mapInArrow(run, schema)


_AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def chained(solved: DataFrame) -> DataFrame:
    """Pieces with their solutions -> one row a conversation (c, gaps, ..., cost, audit)."""
    schema = _named(solved.schema["c"].dataType, _AUDIT)
    arrow = _arrow(schema)
    names = ("c", "sig", "head", "tail", "lo", "hi", *_COUNTS, "costs", "audits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(c, whole: Piece, ways):
            gaps = min(whole.hi - whole.lo + 1 - whole.n["turns"], 2**63 - 1) if whole.lo is not None else 0
            return c, gaps, *(whole.n[x] for x in ("blank", "duplicate", "truncated", "illegal")), *closed(ways)

        def rows():
            c, whole, ways = None, None, []
            for batch in batches:
                for now, _, head, tail, lo, hi, *counts, costs, audits in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                    if whole is None or now != c:
                        if whole is not None:
                            yield result(c, whole, ways)
                        c, whole, ways = now, Piece(), [(0, ""), None, None, None]
                    for name, n in zip(_COUNTS, counts, strict=True):
                        whole.n[name] += n
                    if head is not None:
                        whole.n["illegal"] += whole.tail is not None and not legal(whole.tail, head)
                        whole.tail = tail
                    if lo is not None:
                        whole.n["turns"] -= lo == whole.hi
                        whole.lo, whole.hi = lo if whole.lo is None else whole.lo, hi
                    ways = [min(((w[0] + costs[4 * s + t], w[1] + audits[4 * s + t]) for s, w in enumerate(ways) if w and costs[4 * s + t] is not None), default=None) for t in range(4)]
            if whole is not None:
                yield result(c, whole, ways)

        return _batches(rows(), arrow)

    return solved.repartition("c").sortWithinPartitions("c", "page", "seq").select(*names).mapInArrow(run, schema)


def audits(rows: DataFrame, ids: DataFrame) -> DataFrame:
    cut = settle(pieces(narrow(rows, ids)))
    return chained(hot_join(cut, settle(solutions(cut)), "sig"))


_EDIT = "pos long, edit string, role string, text string"


def replayed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(c, pos, edit, role, text): every row of a conversation with its edit, and the inserted ones, in order;
    role is null for deleted rows.  A conversation's rows are next to each other in one partition."""
    schema = _named(rows.schema["c"].dataType, _EDIT)
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_out():
            c, edits, at, kept, shift = None, "", 0, 0, 0

            def placed(edit: str, role: str, text: str):
                nonlocal kept, shift
                if edit == "K" and not kept and role[:1] == "s":
                    shift = 1  # the users and assistants come one place later
                if edit != "K":
                    role = "assistant" if (kept - shift) % 2 else "user"
                kept += 1
                return role, text

            def inserted():
                nonlocal at
                while at < len(edits) and edits[at] == "I":
                    at += 1
                    yield c, at - 1, "I", *placed("I", "", "")

            for batch in batches:
                for now, kind, role, text in zip(*(batch.column(x).to_pylist() for x in ("c", "kind", "r", "x")), strict=True):
                    if kind == 0:
                        yield from inserted()
                        c, edits, at, kept, shift = now, text, 0, 0, 0
                        continue
                    yield from inserted()
                    edit, at = edits[at], at + 1
                    yield c, at - 1, edit, *((None, text) if edit == "D" else placed(edit, role, text))
            yield from inserted()

        return _batches(rows_out(), arrow)

    heads = found.select("c", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("string").alias("r"), F.col("audit").alias("x"), F.lit(None).cast("binary").alias("d"))
    every = heads.unionByName(rows.select("c", F.lit(1).alias("kind"), "t", "r", "x", "d"))
    return every.repartition("c").sortWithinPartitions("c", "kind", "t", "r", "d").select("c", "kind", "r", "x").mapInArrow(run, schema)


def repair(df: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(audits, edits) of conversations.

    audits: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, one row for each conversation of df and
    of `ids` (a table with the column conv), those without rows with zeros and an empty audit.  edits:
    conv, pos, edit, role, text: the repaired rows in order, deleted ones with a null role.

    Rows are in order of turn, nulls first; rows of one turn by role, then by the SHA-256 of their text (equal
    ones are next to each other).  A null id is a conversation of its own.  Null roles and texts are one
    space.  An empty role has no initial and is never kept.  Roles count by their first character.  Repeated
    rows are duplicates.  Audits and texts are whole at any length.  An empty table gives empty tables.  Other columns
    are ignored.
    """
    rows = _rows(df, conv, turn, role, text)
    every = (ids if ids is not None else df).select(F.col(conv).alias("c"))
    found = settle(audits(rows, every if ids is None else every.unionByName(df.select(F.col(conv).alias("c")))))
    return found.withColumnRenamed("c", conv), replayed(rows, found).withColumnRenamed("c", conv)


def hashed(edits: DataFrame, conv: str) -> DataFrame:
    """(conv, repaired_sha256) of conversations with repaired rows, as they pass by."""
    schema = T.StructType([T.StructField(conv, edits.schema[conv].dataType), T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            c, h = None, None
            for batch in batches:
                for now, role, text in zip(*(batch.column(x).to_pylist() for x in (conv, "role", "text")), strict=True):
                    if role is None:
                        continue
                    if h is None or now != c:
                        if h is not None:
                            yield c, h.hexdigest()
                        c, h = now, hashlib.sha256()
                    else:
                        h.update(b"\n")
                    h.update(f"{role}:{text}".encode())
            if h is not None:
                yield c, h.hexdigest()

        return _batches(rows(), arrow)

    return edits.select(conv, "role", "text").mapInArrow(run, schema)


def damaged(df: DataFrame) -> DataFrame:
    """conversations with the faults that crc32(conv_id:turn) % 20 gives each row: 0 drops it, 1 empties its text,
    2 takes its marks of ends, 3 repeats it, 4 makes its role user."""

    def or_space(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cost, audit and digest of the repair of every conversation, after the damage of its contract."""
    given = read_table(spark, sf_dir, "conversations")
    found, edits = repair(damaged(given), given)
    digests = hashed(edits, "conv_id").withColumnRenamed("conv_id", "c")
    none = hashlib.sha256(b"").hexdigest()
    return found.join(digests, found["conv_id"].eqNullSafe(digests["c"]), "left").drop("c").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(none)))


#: crc32 by bits; the edits of a conversation as a fold of its rows over the cheapest ways into four states.
OP12_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS x0,
    string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS k FROM conversations
), marked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(k, lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 20 AS hit FROM given
), harmed AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE r0 END AS r,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x0, '[.!?]', '', 'g') ELSE x0 END AS x,
    unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM marked WHERE hit <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(x), copy) AS rn,
    row_number() OVER (PARTITION BY conv_id, r, x ORDER BY turn NULLS FIRST, copy) AS seen FROM harmed
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(x, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2
      WHEN NOT regexp_matches(x, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
    left(r, 1) AS ini, lag(left(r, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS before FROM placed
), summed AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal,
    list([ini, CASE WHEN fault IN (1, 2) THEN 'y' ELSE 'n' END, CASE WHEN fault = 3 THEN '5' ELSE '0' END] ORDER BY rn) AS l FROM faults GROUP BY conv_id
), filled AS (
  SELECT conv_id, list_reduce(list_prepend(['00000000', NULL, NULL, NULL], l), lambda a, e: [
    printf('%08d', left(a[1], 8)::INT + 2) || substr(a[1], 9) || 'D',
    least(printf('%08d', left(a[2], 8)::INT + 2) || substr(a[2], 9) || 'D',
      CASE WHEN e[2] = 'n' AND e[1] = 's' THEN printf('%08d', left(a[1], 8)::INT + e[3]::INT) || substr(a[1], 9) || 'K' END),
    least(printf('%08d', left(a[3], 8)::INT + 2) || substr(a[3], 9) || 'D',
      printf('%08d', left(least(a[1], a[2], a[4]), 8)::INT + 7) || substr(least(a[1], a[2], a[4]), 9) || 'ID',
      CASE WHEN e[2] = 'n' THEN printf('%08d', left(least(a[1], a[2], a[4]), 8)::INT + e[3]::INT + CASE WHEN e[1] = 'u' THEN 0 ELSE 1 END)
        || substr(least(a[1], a[2], a[4]), 9) || CASE WHEN e[1] = 'u' THEN 'K' ELSE 'R' END END,
      CASE WHEN e[2] = 'n' THEN printf('%08d', left(a[3], 8)::INT + 5 + e[3]::INT + CASE WHEN e[1] = 'u' THEN 0 ELSE 1 END)
        || substr(a[3], 9) || CASE WHEN e[1] = 'u' THEN 'IK' ELSE 'IR' END END),
    least(printf('%08d', left(a[4], 8)::INT + 2) || substr(a[4], 9) || 'D',
      printf('%08d', left(a[3], 8)::INT + 7) || substr(a[3], 9) || 'ID',
      printf('%08d', left(least(a[1], a[2]), 8)::INT + 12) || substr(least(a[1], a[2]), 9) || 'IID',
      CASE WHEN e[2] = 'n' THEN printf('%08d', left(a[3], 8)::INT + e[3]::INT + CASE WHEN e[1] = 'a' THEN 0 ELSE 1 END)
        || substr(a[3], 9) || CASE WHEN e[1] = 'a' THEN 'K' ELSE 'R' END END,
      CASE WHEN e[2] = 'n' THEN printf('%08d', left(least(a[1], a[2], a[4]), 8)::INT + 5 + e[3]::INT + CASE WHEN e[1] = 'a' THEN 0 ELSE 1 END)
        || substr(least(a[1], a[2], a[4]), 9) || CASE WHEN e[1] = 'a' THEN 'IK' ELSE 'IR' END END)]) AS w FROM summed
), best AS (
  SELECT conv_id, least(w[1], w[4], printf('%08d', left(w[3], 8)::INT + 5) || substr(w[3], 9) || 'I',
    printf('%08d', left(w[2], 8)::INT + 10) || substr(w[2], 9) || 'II') AS b FROM filled
), letters AS (
  SELECT conv_id, unnest(string_split(substr(b, 9), '')) AS e, unnest(range(1, length(b) - 7)) AS i FROM best WHERE length(b) > 8
), edits AS (
  SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER w AS rn, sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER w AS pos FROM letters
  WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), joined AS (
  SELECT t.conv_id, t.e, t.i, t.pos, f.r, f.x,
    max(CASE WHEN t.pos = 1 AND t.e = 'K' AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY t.conv_id) AS shift
  FROM edits t LEFT JOIN faults f ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.rn = f.rn AND t.e <> 'I'
), hashes AS (
  SELECT conv_id, sha256(string_agg(CASE e WHEN 'K' THEN r WHEN 'D' THEN NULL ELSE CASE WHEN (pos - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END END
    || ':' || coalesce(x, ''), chr(10) ORDER BY i)) AS h FROM joined WHERE e <> 'D' GROUP BY conv_id
)
SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
  coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, coalesce(left(b.b, 8)::BIGINT, 0) AS cost,
  coalesce(substr(b.b, 9), '') AS audit, coalesce(h.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN summed s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN hashes h ON c.conv_id IS NOT DISTINCT FROM h.conv_id
"""

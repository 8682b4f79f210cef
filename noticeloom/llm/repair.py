r"""Repair of conversations at the least cost, by the auction algorithm for shortest paths.

The turns of a conversation and the grammar ``(s?(ua)+)?`` of role initials span a lattice: a node is a number of turns
passed and what was said last. Its arcs are edits: ``K`` keeps a turn (0), ``R`` gives it the role that fits (3), ``D`` deletes
it (4; blank and repeated turns can't be treated otherwise), ``I`` inserts an empty turn of the role that fits (3); a
truncated turn that isn't deleted costs 3 more. Every node has a price, at most the cost of the cheapest way to the end.
The algorithm holds one path from the start: where the price of its last node is below the best arc's cost plus the price of
its end, the price rises to that and the path contracts by a node, otherwise it extends by that arc. When it reaches the end,
the prices along it are the costs to go, and every cheapest way consists of tight arcs (price = cost + price of its end);
these are traced by least letter, so that of all cheapest edits the ASCII-least are found.

A long conversation is taken in windows of ``WINDOW`` turns from its end; the converged prices between two windows are the
terminal prices of the one before. Prices so rise by the cost of a window and not of a conversation.

As Spark jobs: turns are dealt into ranges by conversation, turn, role and the first characters of the text, sorted and
numbered, and written; first occurrences come from a partial aggregation; each conversation's turns then pass through one
task twice, first as a byte a turn for the auction, then with their texts for the repaired turns. A task holds the bytes and
the edits of one conversation, never its texts, so that a conversation of any length works; its turns have an order, which its digest needs,
and this is why one conversation is one task's in these two passes.

Defined results: null roles and texts are one space, so a null text is blank; null turns come first; turns that tie are
ordered by role and text; rows of a null ``conv_id`` are one conversation; an empty role, or one of another initial than s, u
and a, can't be kept; repeated rows are duplicates; a conversation without turns is repaired as it is; an empty table gives an
empty result; very long texts pass whole; gaps are counted modulo 2**64; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import Scratch, table, utf8

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns of a conversation that the auction takes at once.
WINDOW = 16
#: Characters that count as white space, and the first characters of a text that deal out its range.
BLANK, RANGE_CHARS = " \t\n\x0b\f\r", 64

#: What was said last: nothing, a system, a user or an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The role that fits next, unless it is a system turn's.
NEXT = (USER, USER, ASSISTANT, USER)
#: Initials as numbers (s, u, a, others 3), and where a turn that is kept leads from what was said last (-1: nowhere).
KEPT = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
#: Cost and edits that end a conversation after its last turn.
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
#: A turn as a byte: initial + 4 * fault.
FINE, BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT = range(4)
#: A row that was dropped; it only says that there is such a conversation.
DROPPED = 255


def _arcs(symbol: int, said: int) -> list[tuple[str, int, int, int]]:
    """Edits before and of a turn, in ASCII order: letter, turns passed, what was said last then, cost."""
    initial, fault = symbol & 3, symbol >> 2
    arcs = [("D", 1, said, DELETE), ("I", 0, NEXT[said], INSERT)]
    if fault in (FINE, TRUNCATED_FAULT):
        more = TRUNCATED if fault == TRUNCATED_FAULT else 0
        if KEPT[said][initial] >= 0:
            arcs.append(("K", 1, KEPT[said][initial], KEEP + more))
        arcs.append(("R", 1, NEXT[said], REROLE + more))
    return arcs


ARCS = [[_arcs(symbol, said) for said in range(4)] for symbol in range(16)]


def auction(turns: bytes, said: int, prices: list[int]) -> int:
    """The cost from the start of the turns to their end; ``prices`` (by 4 * turns passed + what was said last) rise to it."""
    end, path = 4 * len(turns), [said]
    while path[-1] < end:
        node = path[-1]
        at, base, best, to = turns[node >> 2], node & ~3, None, node
        for _, passed, then, cost in ARCS[at][node & 3]:
            there = base + 4 * passed + then
            total = cost + prices[there]
            if best is None or total < best:
                best, to = total, there
        if prices[node] < best:  # contract: no arc is tight yet
            prices[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return prices[said]


def _fresh(turns: bytes, terminal: tuple[int, ...]) -> list[int]:
    """Prices that no arc undercuts: the least of the end everywhere."""
    return [min(terminal)] * (4 * len(turns)) + list(terminal)


def traced(turns: bytes, said: int, prices: list[int]) -> tuple[str, int]:
    """The least letters along tight arcs of converged prices, and what was said last."""
    node, end, letters = said, 4 * len(turns), []
    while node < end:
        letter, node = next(
            (letter, there)
            for letter, passed, then, cost in ARCS[turns[node >> 2]][node & 3]
            if cost + prices[there := (node & ~3) + 4 * passed + then] == prices[node]
        )
        letters.append(letter)
    return "".join(letters), node - end


def cheapest_edits(turns: bytes, window: int = WINDOW) -> tuple[int, str]:
    """Cost and letters of the cheapest edits, ASCII-least. ``turns``: a byte a turn."""
    starts = range(0, len(turns), window)
    terminals = [tuple(cost for cost, _ in CLOSING)]
    for start in reversed(starts[1:]):
        part = turns[start : start + window]
        prices = _fresh(part, terminals[-1])
        terminals.append(tuple(auction(part, said, prices) for said in range(4)))
    cost, said, letters = None, NOTHING, []
    for start in starts:
        part, terminal = turns[start : start + window], terminals.pop()
        prices = _fresh(part, terminal)
        total = auction(part, said, prices)
        cost = total if cost is None else cost
        found, said = traced(part, said, prices)
        letters.append(found)
    letters.append(CLOSING[said][1])
    return cost or 0, "".join(letters)


@lru_cache(200_000)
def _remembered(turns: bytes) -> tuple[int, str]:
    return cheapest_edits(turns)


class _Audit:
    """What is counted of one conversation while its turns pass."""

    def __init__(self):
        self.turns, self.least, self.last, self.distinct, self.illegal = bytearray(), None, None, 0, 0

    def add(self, turn: int | None, symbol: int) -> None:
        if symbol == DROPPED:
            return
        if turn is not None:
            if self.least is None:
                self.least = turn
            if turn != self.last:
                self.distinct, self.last = self.distinct + 1, turn
        if self.turns and (self.turns[-1] & 3, symbol & 3) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.turns.append(symbol)

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.distinct
        turns = bytes(self.turns)
        cost, letters = (_remembered if len(turns) <= WINDOW else cheapest_edits)(turns)
        faults = [sum(turns.count(initial + 4 * fault) for initial in range(4)) for fault in (BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT)]
        return ((gaps + 2**63) % 2**64 - 2**63, *faults, self.illegal, cost, letters)


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LONGS = pa.int64()


def _flushed(ids: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, _LONGS) for c in columns[:6]), pa.array(columns[6], pa.string())], ["conv_id", *_NAMES, "audit"])


def _auditor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of a task (``conv_id, turn, symbol``) to a row a conversation."""
    now, audit, ids, rows, kind = None, None, [], [], _LONGS
    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, turn, symbol in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "symbol")), strict=True):
            if audit is None or conv != now:
                if audit is not None:
                    ids.append(now)
                    rows.append(audit.row())
                    if len(rows) >= 2000 or len(rows[-1][-1]) > 100_000:
                        yield _flushed(ids, rows, kind)
                        ids, rows = [], []
                now, audit = conv, _Audit()
            audit.add(turn, symbol)
    if audit is not None:
        yield _flushed([*ids, now], [*rows, audit.row()], kind)


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a task, of each conversation its audit and then its turns in order, to ``(START, id, audit)``, ``(TURN, role, text)`` of each repaired turn, and ``(END,)``."""
    fits, letters, at, said, odd = (b"user", b"assistant"), None, 0, 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, said
        while at < len(letters) and letters[at] == "I":
            yield TURN, fits[(said + odd) % 2], b""
            at, said = at + 1, said + 1

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", *_NAMES, "audit", "role", "text")]
        for conv, *audit, role, text in zip(*columns, strict=True):
            if audit[-1] is not None:
                if letters is not None:
                    yield from inserted()
                    yield (END,)
                letters, at, said = audit[-1], 0, 0
                odd = (len(letters) - letters.count("D")) % 2  # then a system turn is first
                yield START, conv, audit
                continue
            yield from inserted()
            letter, at = letters[at], at + 1
            if letter != "D":
                yield TURN, role if letter == "K" else fits[(said + odd) % 2], text
                said += 1
    if letters is not None:
        yield from inserted()
        yield (END,)


START, TURN, END = range(3)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = iter(batches)
    ids, rows, hashes, hashed, first, kind = [], [], [], None, True, _LONGS

    def watched() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.column("conv_id").type
            yield batch

    def flushed() -> pa.RecordBatch:
        batch = _flushed(ids, rows, kind)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())], [*batch.schema.names, "repaired_sha256"])

    for event in _events(watched()):
        if event[0] == START:
            ids.append(event[1])
            rows.append(tuple(event[2]))
            hashed, first = hashlib.sha256(), True
        elif event[0] == TURN:
            if not first:
                hashed.update(b"\n")
            first = False
            for piece in (event[1], b":", event[2]):
                hashed.update(piece)
        else:
            hashes.append(hashed.hexdigest())
            if len(hashes) >= 2000 or len(rows[-1][-1]) > 100_000:
                yield flushed()
                ids, rows, hashes = [], [], []
    if hashes:
        yield flushed()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, position, out, size, kind = None, 0, [], 0, _LONGS

    def flushed() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, _LONGS, pa.binary(), pa.binary()), strict=True)], ["conv_id", "position", "role", "text"])

    def watched() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.column("conv_id").type
            yield batch

    for event in _events(watched()):
        if event[0] == START:
            conv, position = event[1], 0
        elif event[0] == TURN:
            out.append((conv, position, event[1], event[2]))
            position, size = position + 1, size + len(event[2])
            if len(out) >= 2000 or size > 8 << 20:
                yield flushed()
                out, size = [], 0
    if out:
        yield flushed()


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with what the CRC-32 of ``conv_id:turn``, modulo 20, does to each row; ``dropped`` rows stay as marks of their conversation."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text, fate = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.crc32(utf8(key)) % 20
    told = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate"))
    return told.select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fate") == 0).alias("dropped"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _symbol(text: Column, role: Column, repeated: Column) -> Column:
    body = F.rtrim(text, F.lit(BLANK))
    fault = (
        F.when(body == "", BLANK_FAULT)
        .when(repeated, DUPLICATE_FAULT)
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED_FAULT)
        .otherwise(FINE)
    )
    initial = F.substring(role, 1, 1)
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + 4 * fault


def audited(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, turn, role, text, dropped`` to what :func:`repaired_turns` and :func:`digests` take: of each conversation its audit, then its turns in order, in one task."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "dropped")
    ranges = plain.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("conv_id", "turn", "role", "text")
    said = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("conv_id").isNull().cast("string"), F.length("role"), "role", "text")
    ordered = ranges.select(
        "*", F.monotonically_increasing_id().alias("pos"), F.unhex(F.sha2(utf8(said), 256)).alias("said"), _symbol(F.col("text"), F.col("role"), F.lit(False)).alias("symbol")
    )
    turns = scratch.written(ordered, "turns")
    first = turns.where("not dropped").groupBy("said").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = scratch.written(first.select("said", "first"), "first")  # both sides of the join are plain shuffles then, which Spark can split
    narrow = turns.select("conv_id", "pos", "turn", "said", "symbol", "dropped").join(first, "said", "left")
    repeated = F.coalesce(F.col("pos") > F.col("first"), F.lit(False)) & (F.shiftright("symbol", 2) != BLANK_FAULT)
    symbol = F.when(F.col("dropped"), DROPPED).when(repeated, F.col("symbol").bitwiseAND(3) + 4 * DUPLICATE_FAULT).otherwise(F.col("symbol"))
    sorted_ = narrow.select("conv_id", "pos", F.col("turn").cast("long").alias("turn"), symbol.alias("symbol")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    audits = sorted_.mapInArrow(_auditor, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {AUDIT}").withColumn("pos", F.lit(-1).cast("long"))
    texts = turns.where("not dropped").select("conv_id", "pos", utf8(F.col("role")).alias("role"), utf8(F.col("text")).alias("text"))
    return audits.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def digests(audited_rows: DataFrame) -> DataFrame:
    """``conv_id``, what was counted, ``cost, audit`` and ``repaired_sha256``: a row for each conversation."""
    return audited_rows.mapInArrow(_digests, f"conv_id {audited_rows.schema['conv_id'].dataType.simpleString()}, {AUDIT}, repaired_sha256 string")


def repaired_turns(audited_rows: DataFrame) -> DataFrame:
    """``conv_id, position, role, text``: the turns of each repaired conversation."""
    turns = audited_rows.mapInArrow(_turns, f"conv_id {audited_rows.schema['conv_id'].dataType.simpleString()}, position long, role binary, text binary")
    return turns.select("conv_id", "position", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(audited(damaged(table(spark, sf_dir, "conversations")), Scratch(spark, "repair")))


#: The same cheapest edits by dynamic programming over turns: for each turn and what was said last, the least (cost, letters).
#: More than two inserts in one place never pay.
SQL = r"""
WITH RECURSIVE b AS (SELECT unnest(range(256))::BIGINT AS n),
t(n, c, k) AS (SELECT n, n, 0 FROM b UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS l FROM t WHERE k = 8),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
fates AS (
  SELECT given.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(name)), lambda i: ascii(substr(name, (i + 1)::BIGINT, 1))::BIGINT)),
    lambda c, y: xor(c >> 8, crc.l[(xor(c, y) & 255) + 1]))) % 20 AS fate
  FROM given, crc),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fates, (SELECT unnest([0, 1]) AS copy) c WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_replace(text, '[ 	-
]+$', '') AS body
  FROM rows_),
turns AS (
  SELECT *, left(role, 1) AS c,
    CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(i) AS n,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
-- what was said last: n(othing), s, u, a; k inserts lead there from there
inserts(q, k, r, letters) AS (VALUES ('n', 0, 'n', ''), ('s', 0, 's', ''), ('u', 0, 'u', ''), ('a', 0, 'a', ''), ('n', 1, 'u', 'I'), ('s', 1, 'u', 'I'), ('u', 1, 'a', 'I'), ('a', 1, 'u', 'I'),
  ('n', 2, 'a', 'II'), ('s', 2, 'a', 'II'), ('u', 2, 'u', 'II'), ('a', 2, 'a', 'II')),
keeps(r, c, q) AS (VALUES ('n', 's', 's'), ('n', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
edits AS (
  SELECT r, c, 'K' AS letter, q, 0 AS cost FROM keeps UNION ALL
  SELECT r, NULL, 'D', r, 4 FROM (VALUES ('n'), ('s'), ('u'), ('a')) x(r) UNION ALL
  SELECT q, NULL, 'R', r, 3 FROM inserts WHERE k = 1),
moves AS (SELECT inserts.q AS was, e.c, e.q, e.letter, letters || e.letter AS letters, 3 * k + e.cost AS cost FROM inserts JOIN edits e USING (r)),
ways AS (
  SELECT conv_id, i, m.was, m.q, m.letters, m.cost + CASE WHEN fault = 'truncated' AND m.letter <> 'D' THEN 3 ELSE 0 END AS cost
  FROM turns JOIN moves m ON (m.c IS NULL OR m.c = turns.c) AND (m.letter = 'D' OR fault IN ('fine', 'truncated'))),
best(conv_id, i, q, way) AS (
  SELECT conv_id, 0::BIGINT, 'n', {'cost': 0::BIGINT, 'letters': ''} FROM counts
  UNION ALL
  SELECT b.conv_id, w.i, w.q, min({'cost': b.way.cost + w.cost, 'letters': b.way.letters || w.letters})
  FROM best b JOIN ways w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i + 1 AND w.was = b.q GROUP BY ALL),
ended AS (
  SELECT b.conv_id, min({'cost': b.way.cost + 3 * k, 'letters': b.way.letters || inserts.letters}) AS way
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i JOIN inserts ON inserts.q = b.q AND inserts.r IN ('n', 'a') GROUP BY b.conv_id),
letters AS (
  SELECT conv_id, unnest(string_split(way.letters, '')) AS letter, generate_subscripts(string_split(way.letters, ''), 1) AS place,
    length(replace(way.letters, 'D', '')) % 2 AS odd
  FROM ended WHERE way.letters <> ''),
steps AS (
  SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w - 1 AS said
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
written AS (
  SELECT s.conv_id, string_agg(CASE WHEN letter = 'K' THEN t.role WHEN (said + odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY place) AS text
  FROM steps s LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i WHERE letter <> 'D' GROUP BY s.conv_id),
convs AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.way.cost, 0)::BIGINT AS cost, coalesce(e.way.letters, '') AS audit, sha256(coalesce(w.text, '')) AS repaired_sha256
FROM convs v LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM v.conv_id
"""

"""Conversation structure repair: the cheapest edits that give a legal sequence of roles.

Method: generalised LR repair (``role_grammar``). A conversation's rows are read in order of their
turns; a graph-structured stack keeps the cheapest (cost, audit) for every stack top while rows are
kept, given another role, deleted or inserted.

Plan: rows are repartitioned by conversation once. Faults are DataFrame expressions; a row seen
before is found by a window over (conversation, role, text), which needs no further shuffle. Then
three sorts inside the partitions: rows stream in turn order through the stack, which gives a header
row with the audit after the last row of a conversation; sorted again, the header comes first; the
rows stream by a second time and the edits are applied. No conversation's texts are held: a task
holds the batch at hand, and about twenty bytes a row of its conversation for the way back. The
result itself has the audit (a letter a row) and a digest over all rows in order, which one task has
to make; so one conversation is one task's stream, and its texts spill, not pile up.

Defined cases. A null role or text counts as one space, in the damage's key also a null id or turn;
rows with a null turn come first; rows with a null id are one conversation. Equal turns are in order
of role, then text. A role whose first character is not s, u or a, or that is empty, cannot be kept.
Very long texts are never copied. Extra columns are not read. An empty table gives an empty result.
Gaps beyond 64 bits count as the largest 64-bit number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlegauge.llm.common import let_workers_import, text_steps
from titlegauge.llm.fill_middle import _Rows
from titlegauge.llm.role_grammar import Costs, LRTable, Repair, Replay

WHITE_SPACE = " \t\n\x0b\x0c\r"
#: The roles that a row can be given, by their symbol.
FREE_ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
LARGEST = (1 << 63) - 1


def as_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): null roles and texts as one space; nothing is dropped."""
    let_workers_import(conversations.sparkSession)
    c = conversations
    return c.select(
        c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"),
        F.coalesce(c["role"], F.lit(" ")).alias("role"), F.coalesce(c["text"], F.lit(" ")).alias("text"),
        F.lit(False).alias("dropped"),
    )


def damaged(rows: DataFrame, kinds: int = 20) -> DataFrame:
    """Rows with the damage that a checksum of conversation and turn names: 0 drops a row (which stays
    as a mark), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's."""
    named = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), F.lit(" ")),
    )
    marked = rows.withColumn("_damage", F.crc32(named) % kinds)
    kind = F.col("_damage")
    return marked.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("dropped") | (kind == 0)).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _in_order(by: list[Column | str]) -> list[Column | str]:
    return ["conv_id", "dropped", F.col("turn").asc_nulls_first(), *by]


def faulty_rows(rows: DataFrame) -> DataFrame:
    """Rows in order within conversations, each with its first fault: blank, duplicate, truncated."""
    stripped = F.rtrim("text", F.lit(WHITE_SPACE))
    seen = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.col("turn").asc_nulls_first())
    checked = (
        rows.repartition("conv_id")
        .withColumn("_again", F.row_number().over(seen) > 1)
        .withColumn("_end", F.right(stripped, F.lit(1)))
    )
    fault = (
        F.when(F.col("dropped"), "dropped").when(F.col("_end") == "", "blank").when(F.col("_again"), "duplicate")
        .when(~F.col("_end").isin(".", "!", "?"), "truncated").otherwise("")
    )
    return checked.select("conv_id", "turn", "role", "text", "dropped", fault.alias("fault")).sortWithinPartitions(
        *_in_order(["role", "text"])
    )


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PLACED = f"conv_id long, place long, role string, text string, fault string, {FACTS}"
N_FACTS = 7


class _Conversation:
    """What is known of a conversation while its rows stream by."""

    def __init__(self, table: LRTable, costs: Costs):
        self.repair = Repair(table, costs, tuple(FREE_ROLES))
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.n_turns = 0
        self.first = self.turn = self.initial = None

    def row(self, turn: int | None, role: str, fault: str) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn = turn
            self.n_turns += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if fault:
            self.count[fault] += 1
        self.repair.row(initial, fault in ("blank", "duplicate"), fault == "truncated")

    def facts(self) -> tuple:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.n_turns
        cost, audit = self.repair.finish()
        return (min(gaps, LARGEST), *self.count.values(), self.illegal, cost, audit)


def audited(faulty: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The rows again, numbered, behind a header (place 0) with the facts and audit of their
    conversation; rows that were dropped end here."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, table = _Rows(PLACED), LRTable()
        empty = (None,) * N_FACTS
        now: tuple = ()
        talk, place = None, 0
        for batch in text_steps(batches):
            for conv, turn, role, text, dropped, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    if now:
                        out.add(200 + place, *now, 0, None, None, None, *talk.facts())
                    now, talk, place = (conv,), _Conversation(table, costs), 0
                if not dropped:
                    place += 1
                    talk.row(turn, role, fault)
                    out.add(len(text), conv, place, role, text, fault, *empty)
                yield from out.full()
        if now:
            out.add(200 + place, *now, 0, None, None, None, *talk.facts())
        yield from out.rest()

    return faulty.mapInArrow(stream, PLACED).sortWithinPartitions("conv_id", "place")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """('start', header), then ('row', (letter, role, text)) for each repaired or deleted row, ('end', header)."""
    table, header, replay = LRTable(), None, None

    def inserts() -> Iterator[tuple]:
        for role in replay.inserted():
            yield "row", ("I", role, "")

    for batch in text_steps(batches):
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = dict(zip(names, values, strict=True))
            if row["place"] == 0:
                if header is not None:
                    yield from inserts()
                    yield "end", header
                header, replay = row, Replay(table, row["audit"], FREE_ROLES)
                yield "start", header
            else:
                yield from inserts()
                letter, role = replay.row(row["role"])
                yield "row", (letter, role, row["text"])
    if header is not None:
        yield from inserts()
        yield "end", header


REPAIRED = "conv_id long, position long, edit string, role string, text string"


def repaired_rows(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired conversations, row by row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, position = _Rows(REPAIRED), None, 0
        for event, value in _replayed(batches):
            if event == "start":
                conv, position = value["conv_id"], 0
            elif event == "row" and value[0] != "D":
                position += 1
                out.add(len(value[2]), conv, position, *value)
                yield from out.full()
        yield from out.rest()

    return audited(faulty_rows(as_rows(conversations)), costs).mapInArrow(rows, REPAIRED)


REPORT = f"conv_id long, {FACTS}, repaired_sha256 string"


def reports(placed: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost, audit and the digest of the repaired rows."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sha, n = _Rows(REPORT), None, 0
        facts = [field.split()[0] for field in FACTS.split(", ")]
        for event, value in _replayed(batches):
            if event == "start":
                sha, n = hashlib.sha256(), 0
            elif event == "end":
                out.add(200 + len(value["audit"]), value["conv_id"], *(value[f] for f in facts), sha.hexdigest())
                yield from out.full()
            elif value[0] != "D":
                sha.update(f"{chr(10) if n else ''}{value[1]}:".encode())
                sha.update(value[2].encode())
                n += 1
        yield from out.rest()

    return placed.mapInArrow(digest, REPORT)


def contract_reports(conversations: DataFrame) -> DataFrame:
    return reports(audited(faulty_rows(damaged(as_rows(conversations)))))


# The same edits over a four-state automaton of the grammar: e nothing yet, S after a system row, U
# after a user, A after an assistant. Ways to insert before a row: from, to, how many.
_INSERTS = "('e','e',0),('e','U',1),('e','A',2),('S','S',0),('S','U',1),('S','A',2),('U','U',0),('U','A',1),('A','A',0),('A','U',1)"
_SHIFTS = "('e','s','S'),('e','u','U'),('S','u','U'),('U','a','A'),('A','u','U')"
_SPACE = r"[\x20\x09-\x0D]"

ORACLE = rf"""
WITH RECURSIVE t AS (SELECT [list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) FOR i IN range(256)] AS crc),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
d AS (SELECT *, xor(list_reduce(list_prepend(4294967295, [CAST(ord(c) AS BIGINT) FOR c IN string_split(name, '')]),
  lambda x, b: xor(crc[(xor(x, b) & 255) + 1], x >> 8)), 4294967295) % 20 AS kind FROM k, t),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE kind <> 0),
o AS (SELECT *, substr(role, 1, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  right(regexp_replace(text, '{_SPACE}+$', ''), 1) AS last FROM r),
f AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN again THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair FROM o),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ins(x, y, n) AS (VALUES {_INSERTS}), sh(x, ini, y) AS (VALUES {_SHIFTS}),
step AS (
  SELECT x, y, '*' AS ini, repeat('I', n) || 'D' AS letters, 3 * n + 4 AS cost, false AS stays FROM ins
  UNION ALL SELECT ins.x, sh.y, sh.ini, repeat('I', n) || 'K', 3 * n, true FROM ins JOIN sh ON ins.y = sh.x
  UNION ALL SELECT ins.x, sh.y, '*', repeat('I', n) || 'R', 3 * n + 3, true FROM ins JOIN sh ON ins.y = sh.x AND sh.ini <> 's'),
ways AS (
  SELECT conv_id, 0::BIGINT AS pos, 'e' AS state, 0 AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, state, best.c, best.a FROM (
    SELECT w.conv_id, f.pos, s.y AS state, min({{'c': w.cost + s.cost + CASE WHEN s.stays AND f.fault = 't' THEN 3 ELSE 0 END, 'a': w.audit || s.letters}}) AS best
    FROM ways w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1
    JOIN step s ON s.x = w.state AND s.ini IN ('*', f.ini) AND NOT (s.stays AND f.fault IN ('b', 'd'))
    GROUP BY w.conv_id, f.pos, s.y)),
done AS (SELECT w.conv_id, min({{'c': w.cost + 3 * i.n, 'a': w.audit || repeat('I', i.n)}}) AS best
  FROM ways w JOIN ins i ON i.x = w.state AND i.y IN ('e', 'A') JOIN (SELECT conv_id, max(pos) AS pos FROM ways GROUP BY conv_id) e
  ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.pos = w.pos GROUP BY w.conv_id),
letters AS (SELECT conv_id, best.a AS a, unnest(string_split(best.a, '')) AS l, generate_subscripts(string_split(best.a, ''), 1) AS i FROM done),
edits AS (SELECT *, sum((l <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM letters WHERE l <> ''),
kept AS (SELECT e.conv_id, e.i, e.l, f.role, f.text, bool_or(e.l = 'K' AND f.ini = 's') OVER (PARTITION BY e.conv_id) AS opened,
  row_number() OVER (PARTITION BY e.conv_id ORDER BY e.i) AS nth FROM edits e LEFT JOIN f ON e.l <> 'I' AND f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.pos WHERE e.l <> 'D'),
fixed AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (nth - opened::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS body FROM kept GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM done LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM done.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM done.conv_id
"""

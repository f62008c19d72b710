"""Repair of conversation structure: the cheapest edits that make the roles of a conversation (s?(ua)+)?.

Rows are dealt by a hash of the conversation, sorted within it, and taken in batches. In each batch one recursive query of
DuckDB goes through all conversations at once, a turn per recursion, and keeps for each state of the grammar the least
cost and, of equal costs, the edits that come first as text. Every turn adds I*K, I*R or I*D, and none of these begins
another, so the least of two equal-cost prefixes stays the least whatever follows.

A batch has at most `batch_rows` rows and `run_rows` of one conversation. A longer conversation goes on in the next batch
from what it has for each state: cost, edits and the digest of the repaired text so far. So memory doesn't grow with a
conversation, but for its edits; its turns are one sequence and stay in one task.

Rows: null role or text counts as one space; a row with neither only names its conversation. A conversation is all rows of a conv_id, null too, by turn (null first),
then role, then text; repeated rows stand side by side. Conversations that have lost all rows come out with zeros. An empty table
gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship

BLANKS = " \t\n\v\f\r"
#: Costs of edits.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: The grammar: from a state by a role's initial to the next; a conversation may end in START or after an answer.
START, SYSTEM, ASKED, ANSWERED = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
ENDS = (START, ANSWERED)
#: Faults of rows.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: The initial that stands for a conversation's end.
END = "$"


def _spoken(state: int) -> str:
    """What an inserted or re-roled turn is in a state: there is one way on with user or assistant."""
    return "u" if (state, "u") in STEPS else "a"


def edges() -> list[tuple[int, str | None, str, int, int, bool]]:
    """(state, initial asked for or None for any, edits, cost, next state, whether the row stays) of every way past a row, and past the end."""
    out: list[tuple[int, str | None, str, int, int, bool]] = []
    for state in range(4):
        at, inserts, seen = state, 0, set()
        while at not in seen:  # more insertions only come back to a state
            seen.add(at)
            before, cost = "I" * inserts, INSERT * inserts
            out += [(state, i, before + "K", cost, to, True) for (s, i), to in STEPS.items() if s == at]
            out += [(state, None, before + "R", cost + REROLE, STEPS[at, _spoken(at)], True), (state, None, before + "D", cost + DELETE, at, False)]
            if at in ENDS:
                out.append((state, END, before, cost, at, False))
            at, inserts = STEPS[at, _spoken(at)], inserts + 1
    return out


_RECURSION = f"""
WITH RECURSIVE walk AS (
    SELECT c, 0 AS i, state, state AS origin, rank, cost, '' AS edits FROM carried
    UNION ALL
    SELECT c, i, state, best.origin, best.rank, best.cost, best.edits FROM (
        SELECT w.c, w.i + 1 AS i, e.next AS state,
               min({{'cost': w.cost + e.cost + if(e.stays AND r.fault = {TRUNCATED}, {CUT_OFF}, 0), 'rank': w.rank, 'edits': w.edits || e.edits, 'origin': w.origin}}) AS best
        FROM walk w JOIN turns r ON r.c = w.c AND r.i = w.i + 1
        JOIN edges e ON e.state = w.state AND (e.initial = r.initial OR e.initial IS NULL AND r.initial <> '{END}')
        WHERE NOT (e.stays AND r.fault IN ({BLANK}, {DUPLICATE}))
        GROUP BY w.c, w.i, e.next))
SELECT w.c, w.state, w.origin, w.cost, w.edits FROM walk w JOIN (SELECT c, max(i) AS i FROM turns GROUP BY c) USING (c, i)
"""


class Solver:
    """best(carried, turns) for a batch of conversations: for each state they can be in then, the best way."""

    def __init__(self) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1})
        self.db.execute("CREATE TABLE edges (state INT, initial VARCHAR, edits VARCHAR, cost BIGINT, next INT, stays BOOLEAN)")
        self.db.executemany("INSERT INTO edges VALUES (?, ?, ?, ?, ?, ?)", edges())

    def best(self, carried: list[tuple[int, int, int, int]], turns: list[tuple[int, int, str, int]]) -> list[tuple[int, int, int, int, str]]:
        """carried: (c, state, rank, cost); turns: (c, i from 1, initial, fault). Gives (c, state, origin, cost, edits)."""
        table = lambda rows, kinds: pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
        self.db.register("carried", table(carried, {"c": pa.int32(), "state": pa.int32(), "rank": pa.int32(), "cost": pa.int64()}))
        self.db.register("turns", table(turns, {"c": pa.int32(), "i": pa.int32(), "initial": pa.string(), "fault": pa.int32()}))
        return self.db.execute(_RECURSION).fetchall()


class _Way:
    """The best way so far to a state: cost, edits and the digest of the repaired text."""

    __slots__ = ("cost", "edits", "digest", "any")

    def __init__(self, cost: int = 0, edits: tuple[str, ...] = (), digest=None, some: bool = False):
        self.cost, self.edits, self.digest, self.any = cost, edits, digest or hashlib.sha256(), some

    def then(self, cost: int, state: int, edits: str, rows: list[tuple[str, str]]) -> _Way:
        """After edits that begin in a state, over rows of (role, text)."""
        out = _Way(cost, (*self.edits, edits), self.digest.copy(), self.any)
        at = 0
        for edit in edits:
            role, text = ("", "") if edit == "I" else rows[at]
            at += edit != "I"
            if edit == "D":
                continue
            initial = role[:1] if edit == "K" else _spoken(state)
            state = STEPS[state, initial]
            if edit != "K":
                role = "user" if initial == "u" else "assistant"
            out.digest.update((("\n" if out.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            out.any = True
        return out


class _Conversation:
    """What is known of a conversation between batches."""

    def __init__(self, conv: object):
        self.conv = conv
        self.sums = [0] * 4  # blank, duplicate, truncated, illegal
        self.low = self.high = None
        self.turns = 0
        self.last = object()
        self.before = None
        self.ways = {START: _Way()}
        self.rows: list[tuple[str, str]] = []
        self.faults: list[int] = []

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if fault:
            self.sums[fault - 1] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.sums[3] += 1
        self.before = role[:1]
        if turn is not None:
            self.turns += turn != self.last  # rows come by turn
            self.last = turn
            self.low, self.high = turn if self.low is None else self.low, turn
        self.rows.append((role, text))
        self.faults.append(fault)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        (best,) = self.ways.values()
        return (self.conv, gaps, *self.sums, best.cost, "".join(best.edits), best.digest.hexdigest())


def _solve(solver: Solver, batch: list[tuple[_Conversation, bool]]) -> None:
    """Takes the rows at hand of each conversation into its ways; True: it ends with them."""
    carried, turns = [], []
    for c, (conv, ends) in enumerate(batch):
        for rank, (state, way) in enumerate(sorted(conv.ways.items(), key=lambda x: "".join(x[1].edits) if len(conv.ways) > 1 else "")):
            carried.append((c, state, rank, way.cost))
        turns += [(c, i, role[:1], fault) for i, ((role, _), fault) in enumerate(zip(conv.rows, conv.faults, strict=True), 1)]
        if ends:
            turns.append((c, len(conv.rows) + 1, END, NONE))
    found: dict[int, list] = {}
    for c, *way in solver.best(carried, turns):
        found.setdefault(c, []).append(way)
    for c, (conv, ends) in enumerate(batch):
        ways = found[c]
        if ends:  # of the two states in which it may end, the better
            rank = {state: "".join(way.edits) for state, way in conv.ways.items()}
            ways = [min(ways, key=lambda w: (w[2], rank[w[1]] + w[3]))]
        conv.ways = {state: conv.ways[origin].then(cost, origin, edits, conv.rows) for state, origin, cost, edits in ways}
        conv.rows, conv.faults = [], []


def _repair(batches: Iterator[pa.RecordBatch], kind: pa.DataType, batch_rows: int, run_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows that come conversation by conversation, to a row a conversation."""
    solver = Solver()
    waiting: list[tuple[_Conversation, bool]] = []
    held, conv = 0, None
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def out(convs: list[_Conversation]) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*(c.result() for c in convs), strict=True), kinds, strict=True)], names)

    for batch in batches:
        for conv_id, turn, role, text, fault in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "fault")), strict=True):
            if conv is None or conv.conv != conv_id:
                if conv is not None:
                    waiting.append((conv, True))
                if held >= batch_rows:
                    _solve(solver, waiting)
                    yield out([c for c, _ in waiting])
                    waiting, held = [], 0
                conv = _Conversation(conv_id)
            if fault is None:  # a row that is dropped names its conversation
                continue
            if len(conv.rows) == run_rows:
                _solve(solver, [*waiting, (conv, False)])
                if waiting:
                    yield out([c for c, _ in waiting])
                waiting, held = [], 0
            conv.add(turn, role, text, fault)
            held += 1
    if conv is not None:
        waiting.append((conv, True))
        _solve(solver, waiting)
        yield out([c for c, _ in waiting])


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with role and text damaged by crc32(conv_id:turn) % 20; a dropped row stays with null role and text."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    rows = conversations.select("conv_id", "turn", F.when(kind != 0, role).alias("role"), F.when(kind != 0, text).alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def _fault(seen: Column) -> Column:
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    return F.when(F.col("text").isNull(), None).when(last == "", BLANK).when(seen > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(NONE)


def repair(rows: DataFrame, batch_rows: int = 16_384, run_rows: int = 1024) -> DataFrame:
    """Per conv_id of (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    ship(rows.sparkSession)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    names_only = F.col("role").isNull() & F.col("text").isNull()
    spaced = [F.when(~names_only, F.coalesce(F.col(c).cast("string"), F.lit(" "))).alias(c) for c in ("role", "text")]
    parted = rows.select("conv_id", "turn", *spaced).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    # of equal rows the first by that count comes first
    sorted_rows = parted.withColumn("nth", seen).withColumn("fault", _fault(F.col("nth"))).sortWithinPartitions("conv_id", *order, "nth")
    conv = rows.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(conv)
    return sorted_rows.mapInArrow(lambda batches: _repair(batches, kind, batch_rows, run_rows), f"conv_id {conv.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(list_concat([n], range(8)), lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)) ORDER BY n) AS t FROM range(256) AS r(n)),
kinds AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM conversations, crc_table),
rows AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM kinds, range(2) AS twice(k) WHERE kind <> 0 AND (k = 0 OR kind = 3)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
           right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM rows),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
faulty AS (
    SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM counted),
way(state, initial, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(state, n, next, lines) AS (VALUES (0, 0, 0, ''), (0, 1, 2, chr(10) || 'user:'), (0, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
    (1, 0, 1, ''), (1, 1, 2, chr(10) || 'user:'), (1, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
    (2, 0, 2, ''), (2, 1, 3, chr(10) || 'assistant:'), (3, 0, 3, ''), (3, 1, 2, chr(10) || 'user:')),
edits(state, initial, edits, cost, next, role, kept, lines) AS (
    SELECT s.state, w.initial, repeat('I', s.n) || 'K', 5 * s.n, w.next, NULL, true, s.lines FROM inserts s JOIN way w ON w.state = s.next
    UNION ALL SELECT s.state, NULL, repeat('I', s.n) || 'R', 5 * s.n + 1, w.next, if(w.initial = 'u', 'user', 'assistant'), true, s.lines FROM inserts s JOIN way w ON w.state = s.next AND w.initial <> 's'
    UNION ALL SELECT s.state, NULL, repeat('I', s.n) || 'D', 5 * s.n + 2, s.next, NULL, false, s.lines FROM inserts s),
walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'text': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT w.conv_id, r.i, e.next, min({'cost': w.best.cost + e.cost + if(e.kept AND r.fault = 'truncated', 5, 0), 'audit': w.best.audit || e.edits,
        'text': w.best.text || e.lines || if(e.kept, chr(10) || coalesce(e.role, r.role) || ':' || r.text, '')})
    FROM walk w JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
    JOIN edits e ON e.state = w.state AND (e.initial IS NULL OR e.initial = left(r.role, 1))
    WHERE NOT (e.kept AND r.fault IN ('blank', 'duplicate')) GROUP BY w.conv_id, r.i, e.next),
ends AS (
    SELECT w.conv_id, w.i, min({'cost': w.best.cost + 5 * s.n, 'audit': w.best.audit || repeat('I', s.n), 'text': w.best.text || s.lines}) AS best
    FROM walk w JOIN inserts s ON s.state = w.state AND s.next IN (0, 3) GROUP BY w.conv_id, w.i),
sums AS (
    SELECT c.conv_id, count(r.i) AS n, coalesce(max(r.turn) - min(r.turn) + 1 - count(DISTINCT r.turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id)
SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, e.best.cost AS cost, e.best.audit AS audit, sha256(substr(e.best.text, 2)) AS repaired_sha256
FROM sums s JOIN ends e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.i = s.n
"""

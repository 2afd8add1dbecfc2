"""Repair of the turn structure of conversations by alignment to an alternating grammar.

A sound conversation has the role initials ``(s?(ua)+)?``. Turns are kept, given another role, deleted or inserted at least cost. For that
they are aligned (Wagner-Fischer) to the grammar's string of each feasible length. Strings with one last letter share their ends, so one
table of costs to go serves all their lengths. A first repair gives the incumbent cost, and cells too far off the diagonal to
stay within it are left out (Ukkonen). Of the cheapest alignments the edits that come first in ASCII order are taken, read forward through the table.

A conversation of any length is cut into blocks of bounded size, each aligned from every state of the grammar to every state, in parallel;
a conversation then only joins the states of its blocks. Only the digest of the repaired text reads a conversation in one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave.llm.common import bounded, settle, table
from procweave.llm.resample import CRC, CRC_TABLE

#: Costs of the edits; a kept or re-roled turn that is cut off costs CUT_OFF more.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Turns in a block.
BLOCK = 64
#: States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = {USER: "u", ASSISTANT: "a"}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
BLANKS = "\t\n\x0b\x0c\r "
FAR = 1 << 60


# Alignment ------------------------------------------------------------------------------------------
# A turn is one letter: x if it has to go, else its role's initial (o for any but s, u and a), upper case if it is cut off.


def other(letter: str) -> str:
    return "a" if letter == "u" else "u"


def price(turn: str, letter: str) -> int:
    """Cost of a turn that stands for ``letter``."""
    return (0 if turn.lower() == letter else REROLE) + (CUT_OFF if turn.isupper() else 0)


def first_repair(turns: str, begin: int, end: int) -> int:
    """Cost of one way from ``begin`` to ``end``: what has to go goes, other turns take the expected role, the end is filled up."""
    cost, state = 0, begin
    for turn in turns:
        if turn == "x":
            cost += DELETE
        elif state == START and turn in "sS":
            cost, state = cost + price(turn, "s"), SYSTEM
        else:
            state = ASSISTANT if state == USER else USER
            cost += price(turn, LETTERS[state])
    missing = (end == ASSISTANT and state == USER) or (end == USER and state != USER)
    return cost + (INSERT if missing else 2 * INSERT if state < USER else 0)


class Alignment:
    """Costs to go from before turn ``i`` with ``m`` letters left of an alternating string that ends in ``last``."""

    def __init__(self, turns: str, last: str, incumbent: int) -> None:
        self.turns, self.last = turns, last
        cut_off = sum(t.isupper() for t in turns)
        spare = incumbent - DELETE * turns.count("x") - CUT_OFF * cut_off
        # Beyond what every way pays, an insertion costs INSERT, a deletion DELETE, or the difference for a turn that is cut off.
        cheap = min(cut_off, spare // (DELETE - CUT_OFF))
        below, above = cheap + max(0, spare - cheap * (DELETE - CUT_OFF)) // DELETE, spare // INSERT
        left = 0
        self.rows = [{m: INSERT * m for m in range(above + 1)}]
        for turn in reversed(turns):
            left += turn != "x"
            under, row = self.rows[-1], {}
            for m in range(max(0, left - below), left + above + 1):
                best = min(under.get(m, FAR) + DELETE, row.get(m - 1, FAR) + INSERT)
                if m and turn != "x":
                    best = min(best, under.get(m - 1, FAR) + price(turn, self.letter(m)))
                if best < FAR:
                    row[m] = best
            self.rows.append(row)
        self.rows.reverse()

    def letter(self, m: int) -> str:
        return self.last if m % 2 else other(self.last)

    def lengths(self, i: int, first: str) -> list[int]:
        """Feasible lengths from turn ``i`` on whose string begins with ``first`` (or is empty, for what follows ``last``)."""
        return [m for m in self.rows[i] if (self.letter(m) == first if m else other(self.last) == first)]

    def audit(self, i: int, m: int) -> str:
        """The cheapest edits from turn ``i`` with ``m`` letters left that come first in ASCII order (D, I, K, R)."""
        out = []
        while i < len(self.turns) or m:
            cost, turn = self.rows[i][m], self.turns[i] if i < len(self.turns) else None
            if turn and self.rows[i + 1].get(m, FAR) + DELETE == cost:
                out.append("D")
                i += 1
            elif m and self.rows[i].get(m - 1, FAR) + INSERT == cost:
                out.append("I")
                m -= 1
            else:
                out.append("K" if turn.lower() == self.letter(m) else "R")
                i, m = i + 1, m - 1
        return "".join(out)


@lru_cache(maxsize=1 << 15)
def ways(turns: str, whole: bool) -> tuple[tuple[int, int, int, str], ...]:
    """The cheapest edits ``(begin, end, cost, audit)`` between states; for a ``whole`` conversation only from the start to a sound end."""
    n, found = len(turns), {}

    def offer(begin, end, cost, audit):
        if (begin, end) not in found or (cost, audit) < found[begin, end]:
            found[begin, end] = cost, audit

    for state in (START, SYSTEM):
        offer(state, state, DELETE * n, "D" * n)
    heads = [(i, DELETE * i + price(t, "s")) for i, t in enumerate(turns) if t in "sS"]
    for i, cost in heads:
        offer(START, SYSTEM, cost + DELETE * (n - 1 - i), "D" * i + "K" + "D" * (n - 1 - i))
    begins = (START,) if whole else (START, SYSTEM, USER, ASSISTANT)
    for end in (ASSISTANT,) if whole else (USER, ASSISTANT):
        # From a state that is not the start, the system turn is re-roled or deleted like any other.
        grid = Alignment(turns, LETTERS[end], max(first_repair(turns, b, end) for b in begins))
        for begin in begins:
            first = "a" if begin == USER else "u"
            least = 1 if begin < USER else 0
            options = [(grid.rows[0][m], 0, m, "") for m in grid.lengths(0, first) if m >= least]
            if begin == START:
                options += [(cost + grid.rows[i + 1][m], i + 1, m, "D" * i + "K") for i, cost in heads for m in grid.lengths(i + 1, first) if m]
            if options:
                cheapest = min(o[0] for o in options)
                offer(begin, end, cheapest, min(head + grid.audit(i, m) for cost, i, m, head in options if cost == cheapest))
    return tuple((b, e, cost, audit) for (b, e), (cost, audit) in found.items() if not whole or (b == START and e in (START, ASSISTANT)))


# Turns ----------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Test damage: ``conv, turn, role, text, n`` (copies of the row). The CRC of ``conv:turn`` drops, empties, cuts, repeats or re-roles
    a row in five of twenty cases. A null in any of the four counts as one space; ``conv`` and ``turn`` themselves stay null."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.pmod(F.crc32(F.concat(told(conv_col), F.lit(":"), told(turn_col)).cast("binary")), F.lit(20))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"), case.alias("case"))
    return rows.filter(F.col("case") != 0).select(
        "conv", "turn",
        F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("case") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def as_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The same columns of a table that is repaired as it is; null roles and texts count as empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"), F.lit(1).cast("long").alias("n"))


def _digest() -> Column:
    """Digest of role and text; it tells rows of one turn apart and puts them in order."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def coded(turns: DataFrame) -> DataFrame:
    """Distinct rows ``conv, turn, digest, letter, fault, n``: role initial (o for any but s, u, a) and fault of the first of the ``n`` copies.

    ``fault``: b blank, d seen earlier in the conversation, t cut off, else a hyphen. Copies after the first are d, unless blank.
    """
    shown = F.rtrim("text", F.lit(BLANKS))
    letter = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    fault = F.when(shown == "", "b").when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "t").otherwise("-")
    rows = turns.select("conv", "turn", _digest().alias("digest"), letter.alias("letter"), fault.alias("fault"), "n")
    rows = settle(rows.groupBy("conv", "turn", "digest", "letter", "fault").agg(F.sum("n").alias("n")))
    # A struct orders null turns first.
    firsts = rows.groupBy("conv", "digest").agg(F.count("*").alias("c"), F.min(F.struct("turn")).alias("first")).filter("c > 1")
    firsts = firsts.select(F.col("conv").alias("conv_"), F.col("digest").alias("digest_"), "first")
    seen = rows.join(firsts, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("digest") == F.col("digest_")), "left")
    late = F.col("first").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("first"))
    return seen.select("conv", "turn", "digest", "letter", F.when(late & (F.col("fault") != "b"), "d").otherwise(F.col("fault")).alias("fault"), "n")


# Blocks ---------------------------------------------------------------------------------------------

WAYS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")


def _rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _blocks(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Blocks of the rows of one conversation: turns as letters, and counts, first and last initial and turn, least and largest turn."""
    letters, initials, stats, seen = [], [], dict.fromkeys(COUNTS, 0), []

    def done():
        text = "".join(initials)
        stats["n"] = len(text)
        stats["illegal"] = sum(text[i : i + 2] not in LEGAL for i in range(len(text) - 1))
        told = [t for t in seen if t is not None]
        facts = {"first": text[0], "last": text[-1], "first_turn": seen[0], "last_turn": seen[-1], "least": min(told, default=None), "most": max(told, default=None)}
        return "".join(letters), stats | facts

    for turn, letter, fault, n in rows:
        for copy in range(n):
            now = fault if not copy or fault == "b" else "d"
            letters.append("x" if now in "bd" else letter.upper() if now == "t" else letter)
            initials.append(letter)
            for name, mark in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
                stats[name] += now == mark
            if turn is not None and (not seen or seen[-1] != turn):
                stats["turns"] += 1
            if not seen or seen[-1] != turn:
                seen.append(turn)
            if len(letters) == BLOCK:
                yield done()
                letters, initials, stats, seen = [], [], dict.fromkeys(COUNTS, 0), []
    if letters:
        yield done()


NUMBERS = ("at", *COUNTS, "first_turn", "last_turn", "least", "most")
BLOCK_FIELDS = ", ".join(f"{c} long" for c in NUMBERS) + ", first string, last string, ways array<struct<begin:int,end:int,cost:long,audit:string>>"


def _labelled(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Conversation, block, and whether the block is a whole conversation: it is if it is the only one and the range goes on before and behind."""
    held, inner = None, False
    for conv, group in groupby(rows, key=lambda r: r[0]):
        if held:
            yield held
        single = inner
        blocks = _blocks(r[1:] for r in group)
        block = next(blocks)
        for following in blocks:
            yield conv, block, False
            block, single = following, False
        held, inner = (conv, block, single), True
    if held:
        yield *held[:2], False


def aligned(rows: DataFrame) -> DataFrame:
    """Blocks of conversations with the cheapest edits between states; ``at`` puts the blocks of a conversation in order."""
    kind = rows.schema["conv"].dataType.simpleString()
    order = ["conv", "turn", "digest"]

    def work(batches):
        number, out = TaskContext.get().partitionId() << 33, []
        ids = None

        def typed():
            nonlocal ids
            for batch in batches:
                ids = batch.schema.field("conv").type
                yield batch

        def cut():
            numbers = [pa.array([r[1][c] for r in out], pa.int64()) for c in NUMBERS]
            edges = [pa.array([r[1][c] for r in out], pa.string()) for c in ("first", "last")]
            found = pa.array([[dict(zip(("begin", "end", "cost", "audit"), w)) for w in r[2]] for r in out], WAYS)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], ids), *numbers, *edges, found], names=["conv", *NUMBERS, "first", "last", "ways"])

        for conv, (turns, facts), whole in _labelled(_rows(typed(), ("conv", "turn", "letter", "fault", "n"))):
            out.append((conv, facts | {"at": number}, ways(turns, whole)))
            number += 1
            if len(out) == 1000:
                yield cut()
                out = []
        if out:
            yield cut()

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, f"conv {kind}, {BLOCK_FIELDS}")


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _join_blocks(blocks: Iterator[dict]) -> tuple[dict, str]:
    """Report and audit of one conversation from its blocks in order."""
    total, before = dict.fromkeys((*COUNTS, "least", "most"), 0), None
    least, most, states = None, None, {START: (0, "")}
    for b in blocks:
        for c in COUNTS:
            total[c] += b[c]
        if before:
            total["illegal"] += before["last"] + b["first"] not in LEGAL
            # A turn on both sides of the cut counts once.
            total["turns"] -= b["first_turn"] is not None and b["first_turn"] == before["last_turn"]
        before = b
        least = min((v for v in (least, b["least"]) if v is not None), default=None)
        most = max((v for v in (most, b["most"]) if v is not None), default=None)
        reached = {}
        for w in b["ways"]:
            if w["begin"] in states:
                cost, audit = states[w["begin"]]
                option = cost + w["cost"], audit + w["audit"]
                if w["end"] not in reached or option < reached[w["end"]]:
                    reached[w["end"]] = option
        states = reached
    cost, audit = min(states[s] for s in (START, ASSISTANT) if s in states)
    return total | {"cost": cost, "gaps": 0 if least is None else most - least + 1 - total["turns"]}, audit


def audits(blocks: DataFrame) -> DataFrame:
    """One row a conversation: ``conv``, the counts of REPORT and the audit. A conversation's blocks are read in order, none is kept."""
    kind = blocks.schema["conv"].dataType.simpleString()
    columns = ("conv", *NUMBERS, "first", "last", "ways")

    def work(batches):
        ids, out = None, []

        def typed():
            nonlocal ids
            for batch in batches:
                ids = batch.schema.field("conv").type
                yield batch

        def cut():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], ids), *(pa.array([r[1][c] for r in out], pa.int64()) for c in REPORT), pa.array([r[2] for r in out], pa.string())], names=["conv", *REPORT, "audit"]
            )

        size = 0
        for conv, group in groupby(_rows(typed(), columns), key=lambda r: r[0]):
            out.append((conv, *_join_blocks(dict(zip(columns, r)) for r in group)))
            size += len(out[-1][2])
            if len(out) == 1000 or size > 1 << 22:
                yield cut()
                out, size = [], 0
        if out:
            yield cut()

    fields = ", ".join(f"{c} long" for c in REPORT)
    return blocks.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(work, f"conv {kind}, {fields}, audit string")


# Repaired text --------------------------------------------------------------------------------------


def _edited(audit: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Edit, role and text of each turn that is left, from the rows (role, text, n) of a conversation in order."""
    state, at = START, 0

    def emit(role=None, text=""):
        nonlocal state
        if state == START and role and role[:1] == "s":
            state = SYSTEM
            return role, text
        state = ASSISTANT if state == USER else USER
        return role if role is not None else NAMES[LETTERS[state]], text

    for role, text, n in rows:
        for _ in range(n):
            while audit[at] == "I":
                at += 1
                yield "I", *emit()
            edit = audit[at]
            at += 1
            if edit != "D":
                yield edit, *emit(role if edit == "K" else None, text)
    for _ in audit[at:]:
        yield "I", *emit()


def _by_conversation(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The audit of each conversation, then its rows in order; all of a conversation in one task, which reads them as a stream."""
    kind = turns.schema["conv"].dataType
    rows = turns.select("conv", F.lit(1).alias("kind"), "turn", _digest().alias("digest"), "role", "text", "n")
    null = lambda t: F.lit(None).cast(t)
    told = found.select(F.col("conv").cast(kind), F.lit(0).alias("kind"), null("long"), null("binary"), null("string"), F.col("audit"), null("long"))
    order = ["conv", "kind", "turn", "digest"]
    return told.union(rows).toDF(*rows.columns).repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text", "n")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversation and its edited turns."""
    for conv, group in groupby(_rows(bounded(batches), ("conv", "kind", "role", "text", "n")), key=lambda r: r[0]):
        audit = next(group)[3]
        yield conv, _edited(audit, (r[2:] for r in group))


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """SHA-256 of the repaired conversations: ``conv, repaired_sha256``."""
    kind = turns.schema["conv"].dataType

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        out = ([], [])

        def cut():
            return pa.RecordBatch.from_arrays([pa.array(out[0], to_arrow_type(kind)), pa.array(out[1], pa.string())], names=["conv", "repaired_sha256"])

        for conv, edited in _stream(batches):
            sha, first = hashlib.sha256(), True
            for _, role, text in edited:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            out[0].append(conv)
            out[1].append(sha.hexdigest())
            if len(out[0]) == 1000:
                yield cut()
                out[0].clear(), out[1].clear()
        if out[0]:
            yield cut()

    return _by_conversation(turns, found).mapInArrow(work, f"conv {kind.simpleString()}, repaired_sha256 string")


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv``, position from 1, the edit that made the turn (K, R or I), ``role`` and ``text``."""
    kind = turns.schema["conv"].dataType
    found = audits(aligned(coded(turns)))

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        out, size = [], 0

        def cut():
            columns = list(zip(*out))
            types = (to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv", "position", "edit", "role", "text"])

        for conv, edited in _stream(batches):
            for position, (edit, role, text) in enumerate(edited, 1):
                out.append((conv, position, edit, role, text))
                size += len(text)
                if len(out) == 1000 or size > 1 << 22:
                    yield cut()
                    out, size = [], 0
        if out:
            yield cut()

    return _by_conversation(turns, found).mapInArrow(work, f"conv {kind.simpleString()}, position long, edit string, role string, text string")


def report(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation of ``ids`` (conv): ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``turns``: see ``damaged`` and ``as_turns``. Rows are taken by turn, null turns first; rows of one turn in the order of the digest of
    role and text, so copies are neighbours. Rows without a conversation id form one conversation of their own. A conversation without
    rows has zeros, an empty audit and the digest of an empty text, as has one from which all is deleted. Very long conversations are
    aligned in blocks; a text is read whole, one at a time. An empty table gives no rows.
    """
    found = settle(audits(aligned(coded(turns))))
    shown = digests(turns, found).withColumnRenamed("conv", "conv_d")
    ids = ids.select("conv").distinct()
    facts = found.withColumnRenamed("conv", "conv_f")
    rows = ids.join(facts, F.col("conv").eqNullSafe(F.col("conv_f")), "left").join(shown, F.col("conv").eqNullSafe(F.col("conv_d")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in REPORT]
    return rows.select("conv", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return report(damaged(rows), rows.select(F.col("conv_id").alias("conv"))).withColumnRenamed("conv", "conv_id")


SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h
  FROM conversations
),
damage AS (SELECT conv_id, turn, role, text, {CRC} % 20 AS k FROM told, crc),
turns AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM damage, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS r(copy) WHERE k <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS letter, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS shown
  FROM turns
),
fact AS (
  SELECT conv_id, turn, i, role, text, letter, CASE WHEN shown = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault
  FROM placed
),
size AS (SELECT conv_id, max(i) AS n FROM fact GROUP BY conv_id),
-- States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
gap(a, b, c, w) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (3, 2, 3, 'I'), (2, 3, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II'), (2, 2, 6, 'II'), (3, 3, 6, 'II')),
edit(a, b, l, w) AS (VALUES (0, 1, 's', 'K'), (0, 2, 'u', 'K'), (1, 2, 'u', 'K'), (3, 2, 'u', 'K'), (2, 3, 'a', 'K'), (0, 2, '', 'R'), (1, 2, '', 'R'), (3, 2, '', 'R'), (2, 3, '', 'R'), (0, 0, '', 'D'), (1, 1, '', 'D'), (2, 2, '', 'D'), (3, 3, '', 'D')),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS st, struct_pack(cost := 0::BIGINT, audit := '') AS best FROM size
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.b, min(struct_pack(
    cost := w.best.cost + g.c + CASE e.w WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.w <> 'D' AND f.fault = 't' THEN 3 ELSE 0 END,
    audit := w.best.audit || g.w || e.w))
  FROM walk w JOIN gap g ON g.a = w.st JOIN edit e ON e.a = g.b JOIN fact f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
  WHERE (e.l = '' OR e.l = f.letter) AND (e.w = 'D' OR f.fault NOT IN ('b', 'd'))
  GROUP BY w.conv_id, w.i, e.b
),
final AS (
  SELECT conv_id, min(struct_pack(cost := best.cost + g.c, audit := best.audit || g.w)) AS best
  FROM walk JOIN size USING (conv_id) JOIN gap g ON g.a = st WHERE i = n AND g.b IN (0, 3) GROUP BY conv_id
),
step AS (
  SELECT conv_id, p, best.audit[p] AS w, p - (length(best.audit[1:p]) - length(replace(best.audit[1:p], 'I', ''))) AS i,
    p - (length(best.audit[1:p]) - length(replace(best.audit[1:p], 'D', ''))) AS e
  FROM final, unnest(range(1, length(best.audit) + 1)) AS r(p)
),
kept AS (SELECT step.*, role, text, max(CASE WHEN e = 1 AND w = 'K' AND letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM step LEFT JOIN fact USING (conv_id, i) WHERE w <> 'D'),
line AS (
  SELECT conv_id, p, CASE WHEN w = 'K' THEN role WHEN (e - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN w = 'I' THEN '' ELSE text END AS line FROM kept
),
shape AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS shape FROM line GROUP BY conv_id),
pair AS (SELECT conv_id, letter || lead(letter) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM fact),
bad AS (SELECT conv_id, count(*) FILTER (p NOT IN ('su', 'ua', 'au')) AS illegal FROM pair WHERE p IS NOT NULL GROUP BY conv_id),
fault AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated
  FROM fact GROUP BY conv_id
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(shape, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN fault USING (conv_id) LEFT JOIN bad USING (conv_id) LEFT JOIN final USING (conv_id) LEFT JOIN shape USING (conv_id)
"""

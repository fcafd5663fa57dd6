"""Conversation structure repair by error-correcting Earley parsing over a weighted role grammar.

A conversation's rows, in order of turn, are the input; GRAMMAR says which
sequences of roles are legal. Beside a terminal's own production (the row keeps
its role, cost 0) there are error productions: the row's role is changed to it
(REROLE), it stands for a row that isn't there (INSERT), or a row is no part of
the structure (DELETE). Chart items are dotted productions with their origin;
each keeps its least (cost, audit), the audit being the edits' initials in
order, so ties go to the ASCII-least audit. A column's items are settled
cheapest first, as inserts lead from item to item within it. The least completed
start item after the last row is the repair.

A row with a fault (blank, a duplicate of an earlier row, truncated) is marked by
the engine before parsing; blank rows and duplicates have to be deleted, and a
truncated row that stays costs TRUNCATED more.

The grammar is left-recursive and its terminals stand in the productions, so every
item has its origin in column 0, and a column depends on the one before alone: the
chart keeps that one, column 0's waiting items and no more. Audits of live items
share nearly all of their edits; what they share is settled, and its rows are
given out at once. So a conversation is parsed in one go without being held: only
rows whose edits are open stay in memory, however long it is.

Odd input: a null role or text counts as one space (no legal role, blank); null
turns come first; rows of one turn are ordered by role and text; a null
conversation is one of its own; repeated rows are duplicates; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import let_go, small_batches

#: Productions of the role grammar, by head; u, a, s are rows of user, assistant, system.
GRAMMAR = [("S", ""), ("S", "D"), ("D", "ua"), ("D", "sua"), ("D", "Dua")]
START = "S"
#: What rows can be changed to or put in as.
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits, and of a truncated row that stays.
REROLE, INSERT, DELETE, TRUNCATED = 2, 2, 3, 1
#: What an item of GRAMMAR has to pay at most to follow any other item's further course: an insert to come to the same role (two after a system row, to end), and a delete for a system row, which only the beginning takes. An item that costs more than this above the cheapest is on no cheapest repair.
SLACK = INSERT + DELETE

#: Characters that don't count as text.
SPACE = " \t\n\x0b\x0c\r"


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> conv_id, turn, role, text, fault (blank, duplicate, truncated or null), the first that holds; the rows of a conversation in one partition, in order."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    own = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    body = F.rtrim("text", F.lit(SPACE))
    fault = F.when(body == "", "blank").when(at > 1, "duplicate").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated")
    dealt = own.repartition("conv_id")  # the window takes this partitioning, too
    return dealt.withColumn("fault", fault).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


class Earley:
    """The chart of one conversation, fed row by row. An item is (production, dot, origin); its value (cost, audit). Another grammar has another slack, or none that is known: then no item goes."""

    def __init__(self, grammar: list[tuple[str, str]] = GRAMMAR, start: str = START, slack: float = SLACK):
        self.grammar, self.start, self.slack, self.heads = grammar, start, slack, {h for h, _ in grammar}
        self.column, self.waiting = 0, {}
        self.settled = ""
        self.items = self._close([((0, ""), (p, 0, 0)) for p, (h, _) in enumerate(grammar) if h == start])

    def _next(self, item) -> str:
        return self.grammar[item[0]][1][item[1] : item[1] + 1]

    def _close(self, seeds: list) -> dict:
        """Predictions, completions and inserts of a column, the least (cost, audit) first."""
        heapq.heapify(seeds)
        done: dict = {}
        while seeds:
            value, item = heapq.heappop(seeds)
            if item in done:
                continue
            done[item] = value
            production, dot, origin = item
            symbol = self._next(item)
            if symbol in self.heads:
                self.waiting.setdefault(self.column, {}).setdefault(symbol, []).append((value, item))
                for p, (h, _) in enumerate(self.grammar):
                    if h == symbol:
                        heapq.heappush(seeds, ((0, ""), (p, 0, self.column)))
            elif symbol in ROLES:
                heapq.heappush(seeds, ((value[0] + INSERT, value[1] + "I"), (production, dot + 1, origin)))
            elif not symbol:
                for (cost, audit), (p, d, o) in self.waiting.get(origin, {}).get(self.grammar[production][0], []):
                    heapq.heappush(seeds, ((cost + value[0], audit + value[1]), (p, d + 1, o)))
        return done

    def feed(self, initial: str, has_to_go: bool, truncated: bool) -> str:
        """One more row: the edits that are settled by now."""
        seeds = []
        for item, (cost, audit) in self.items.items():
            production, dot, origin = item
            symbol = self._next(item)
            if symbol in self.heads:
                continue
            if symbol or self.grammar[production][0] == self.start:
                seeds.append(((cost + DELETE, audit + "D"), item))
            if symbol and not has_to_go:
                onward = (production, dot + 1, origin)
                if symbol == initial:
                    seeds.append(((cost + truncated, audit + "K"), onward))
                if symbol in ROLES:
                    seeds.append(((cost + REROLE + truncated, audit + "R"), onward))
        self.column += 1
        items = self._close(seeds)
        most = min(cost for cost, _ in items.values()) + self.slack
        self.items = {item: value for item, value in items.items() if value[0] <= most}
        live = {origin for _, _, origin in self.items}
        self.waiting = {c: w for c, w in self.waiting.items() if c in live}
        if any(value[1] for by in self.waiting.values() for some in by.values() for value, _ in some):
            return ""  # a parent's edits would come before a shared beginning
        shared = os.path.commonprefix([audit for _, audit in self.items.values()])
        self.items = {item: (cost, audit[len(shared) :]) for item, (cost, audit) in self.items.items()}
        return shared

    def end(self) -> tuple[int, str]:
        """The least cost and its edits that weren't settled yet."""
        return min(v for (p, dot, origin), v in self.items.items() if self.grammar[p][0] == self.start and not origin and dot == len(self.grammar[p][1]))


class Repair:
    """A conversation under repair: rows come in, edited rows go out as soon as their edits are settled."""

    def __init__(self):
        self.chart, self.open, self.turn = Earley(), [], "u"

    def edited(self, edits: str) -> Iterator[tuple]:
        """(edit, role, text, turn, said, fault): role and text as they are after the repair, null for deleted rows; turn, said (the role before) and fault of the row, null for inserted ones."""
        for e in edits:
            turn, said, text, fault = (None, None, "", None) if e == "I" else self.open.pop(0)
            if e == "D":
                yield e, None, None, turn, said, fault
                continue
            role = said if e == "K" else ROLES[self.turn]
            if role[:1] in ROLES:
                self.turn = "a" if role[:1] == "u" else "u"
            yield e, role, text, turn, said, fault

    def feed(self, turn, role: str, text: str, fault: str | None) -> Iterator[tuple]:
        self.open.append((turn, role, text, fault))
        yield from self.edited(self.chart.feed(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))

    def end(self) -> tuple[int, Iterator[tuple]]:
        cost, edits = self.chart.end()
        return cost, self.edited(edits)


_FIELDS = [("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("turn", pa.int64()), ("said", pa.string()), ("fault", pa.string()), ("cost", pa.int64())]


def repaired(rows: DataFrame, most: int = 1 << 20) -> DataFrame:
    """rows (conv_id, turn, role, text) -> a row an edit, those of a conversation together and in order: conv_id, edit (K, R, D, I), role and text after it (null: deleted), turn, said (the role) and fault of the row before it (null: inserted), cost. After the edits of a conversation comes a row of its conv_id and the cost of the whole repair, null in all else.

    Batches of about `most` bytes of text go out.
    """
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        current, work, out, held, id_type = None, None, [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*out, strict=True))
            done = pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], _FIELDS, strict=True))], names=["conv_id", *(n for n, _ in _FIELDS)])
            out.clear()
            held = 0
            return done

        def finish() -> None:
            nonlocal held
            cost, last = work.end()
            rest = [(current, *e, None) for e in last]
            held += sum(len(e[3] or "") + 64 for e in rest)
            out.extend(rest)
            out.append((current, None, None, None, None, None, None, cost))  # the end of a conversation

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")), strict=True):
                if work is None or conv != current:
                    if work is not None:
                        finish()
                    current, work = conv, Repair()
                for e in work.feed(*row):
                    out.append((current, *e, None))
                    held += len(e[2] or "") + 64
                if held > most:
                    yield flush()
        if work is not None:
            finish()
        if out:
            yield flush()

    return small_batches(with_faults(rows)).mapInArrow(run, f"conv_id {kind}, edit string, role string, text string, turn long, said string, fault string, cost long")


#: Initials of roles that may follow one another.
LEGAL = frozenset(["su", "ua", "au"])


class Report:
    """What is said of one conversation, gathered as its edits come."""

    def __init__(self):
        self.turns: list = []  # least, greatest, last, distinct
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before, self.audit, self.sha, self.any = 0, None, [], hashlib.sha256(), False

    def add(self, edit: str, role, text, turn, said, fault) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.sha.update(f"{'\n' if self.any else ''}{role}:{text}".encode())
            self.any = True
        if edit == "I":
            return
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + said[:1] not in LEGAL:
            self.illegal += 1
        self.before = said[:1]
        if turn is not None:  # turns come in order
            self.turns = [turn, turn, 1] if not self.turns else [self.turns[0], turn, self.turns[2] + (turn != self.turns[1])]

    def row(self, cost: int) -> tuple:
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.sha.hexdigest()


def report(edits: DataFrame) -> DataFrame:
    """What `repaired` gives, its rows as they came -> a row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind = dict(edits.dtypes)["conv_id"]
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Report()
        for batch in batches:
            done = []
            for conv, edit, role, text, turn, said, fault, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if edit is None:
                    done.append((conv, *of.row(cost)))
                    of = Report()
                else:
                    of.add(edit, role, text, turn, said, fault)
            if done:
                columns = list(zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("conv_id").type), *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in columns[1:])], names=["conv_id", *names])

    return edits.select("conv_id", "edit", "role", "text", "turn", "said", "fault", "cost").mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults planted by crc32(`conv_id:turn`) mod 20: 0 drops a row, 1 empties its text, 2 takes its `[.!?]`, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by: Column = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    own = rows.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), by.alias("_by")).where("_by <> 0")
    text = F.when(F.col("_by") == 1, "").when(F.col("_by") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("_by") == 3, 2).otherwise(1))
    return own.select("conv_id", "turn", F.when(F.col("_by") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def structure(rows: DataFrame, of: DataFrame) -> DataFrame:
    """The report of rows for every conv_id of `of`; one without rows has zeros, no edits and the hash of nothing."""
    found = report(repaired(rows)).withColumnRenamed("conv_id", "_conv")
    every = of.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return out.select("conv_id", *[F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in found.columns if c != "_conv"])

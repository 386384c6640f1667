"""Conversation structure repair: the cheapest edits that make a conversation's roles read (s?(ua)+)?.

Iterative-deepening A*: depth-first search in ASCII order of the edits' initials (D, I, K, R) under a rising cost
bound; the first accepting path is the cheapest, and the ASCII-least of the cheapest. States that failed keep the
least cost they turned out to need, so no later visit repeats them. A row that must go costs 4, a truncated row 3 at
least, and every two neighbours that cannot stand together need an edit of their own: that is the search's estimate.

A conversation is streamed through one task in order of its turns, ``BLOCK`` rows at a time: each block is searched
from every state it can be entered in to every state it can be left in, and the best way into each state is kept.
Two edit strings of equal cost on the same rows are never prefixes of each other, so this is exact. What a task
holds is a block, and for each of four states the edits so far and a hash of the repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 256
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})  # by state: what a role's initial leads to
ACCEPTING = frozenset((START, ASSISTANT))
LEGAL = frozenset(("su", "ua", "au"))
NEVER = 1 << 60
ROLES = ("user", "user", "assistant", "user")  # by state: the only role that an edit can put next
LEADS = (USER, USER, ASSISTANT, USER)
SPACES = r"\x20\x09-\x0D"


class Estimate:
    """Least cost still needed at row i in a state, never too high."""

    def __init__(self, rows: list[tuple[str, int]], goals: frozenset):
        n = len(rows)
        self.goals, self.content, self.survivor = goals, [0] * (n + 1), [0] * (n + 1)
        self.early = goals in ({START}, {SYSTEM})  # out of reach once passed
        kept = [(initial, fault) for initial, fault in rows if fault not in (BLANK, DUPLICATE)]
        self.kept, m = kept, len(kept)
        j = m
        self.survivor[n] = m
        for i in range(n - 1, -1, -1):
            initial, fault = rows[i]
            if fault in (BLANK, DUPLICATE):
                cost = 4
            else:
                j -= 1
                cost = (4 if fault else 3) if initial not in ("s", "u", "a") else 3 if fault else 0
            self.content[i] = self.content[i + 1] + cost
            self.survivor[i] = j
        self.last_system = max((k for k in range(m) if kept[k][0] == "s"), default=-1)
        links = [0] * (m + 1)
        for i in range(m - 1):
            if kept[i][0] + kept[i + 1][0] not in LEGAL:
                links[i] = min(self.price(kept[i]), self.price(kept[i + 1]))
        ends = {("", "s", "u", "a")[g] for g in goals}
        if m and kept[-1][0] not in ends:
            links[m - 1] = self.price(kept[-1])
        self.apart = [0] * (m + 2)
        for i in range(m - 1, -1, -1):
            self.apart[i] = max(self.apart[i + 1], links[i] + self.apart[i + 2])

    @staticmethod
    def price(row: tuple[str, int]) -> int:
        """What changing a row costs beyond what it costs anyway."""
        return 0 if row[0] not in ("s", "u", "a") else 1 if row[1] else 3

    def __call__(self, i: int, state: int) -> int:
        j = self.survivor[i]
        if self.early and state not in self.goals and (state != START or self.last_system < j):
            return NEVER
        if j == len(self.kept):
            more = 0 if state in self.goals else 3
        else:
            row = self.kept[j]
            more = self.apart[j] if row[0] in STEP[state] else max(self.apart[j], self.price(row) + self.apart[j + 1])
        return self.content[i] + more


def moves(rows: list[tuple[str, int]], i: int, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, next row, next state) in ASCII order."""
    out = []
    if i < len(rows):
        initial, fault = rows[i]
        out.append(("D", 4, i + 1, state))
        out.append(("I", 3, i, LEADS[state]))
        if fault not in (BLANK, DUPLICATE):
            extra = 3 if fault else 0
            if initial in STEP[state]:
                out.append(("K", extra, i + 1, STEP[state][initial]))
            out.append(("R", 3 + extra, i + 1, LEADS[state]))
    else:
        out.append(("I", 3, i, LEADS[state]))
    return out


def search(rows: list[tuple[str, int]], start: int, goals: frozenset) -> tuple[int, str, int] | None:
    """(cost, edits, end state) of the cheapest, then ASCII-least, edits of ``rows`` (role initial, fault) from
    state ``start`` to a state of ``goals``; None where no edits lead there."""
    estimate, failed, n = Estimate(rows, goals), {}, len(rows)
    bound = estimate(0, start)
    while bound < NEVER:
        stack, path = [[0, start, 0, iter(moves(rows, 0, start)), NEVER, 0]], []
        if not n and start in goals:
            return 0, "", start
        while stack:
            frame = stack[-1]
            i, state, cost, options = frame[0], frame[1], frame[2], frame[3]
            for edit, price, to, into in options:
                if to == n and into in goals and cost + price <= bound:
                    return cost + price, "".join(path) + edit, into
                need = failed.get((to, into))
                if need is None:
                    need = estimate(to, into)
                if cost + price + need > bound:
                    frame[4] = min(frame[4], price + need)
                else:
                    stack.append([to, into, cost + price, iter(moves(rows, to, into)), NEVER, price])
                    path.append(edit)
                    break
            else:
                stack.pop()
                failed[(i, state)] = max(frame[4], failed.get((i, state), 0))
                if stack:
                    path.pop()
                    stack[-1][4] = min(stack[-1][4], frame[5] + failed[(i, state)])
        bound = failed[(0, start)]
    return None


def applied(edits: str, rows: list[tuple[str, str]], state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each row that the edits leave or insert."""
    at = iter(rows)
    for edit in edits:
        if edit == "I":
            yield edit, ROLES[state], ""
            state = LEADS[state]
            continue
        role, text = next(at)
        if edit == "K":
            yield edit, role, text
            state = STEP[state][role[:1]]
        elif edit == "R":
            yield edit, ROLES[state], text
            state = LEADS[state]


class Fold:
    """One conversation, as its rows arrive."""

    def __init__(self):
        self.rows, self.ways = [], {START: (0, "", hashlib.sha256(), False)}
        self.turns = [None, None, 0]  # least, greatest, distinct
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if len(self.rows) == BLOCK:
            self.close(None)
        self.rows.append((role, text, fault))
        self.faults[fault] += 1
        if self.last is not None and self.last + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = role[:1]
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]

    def close(self, goals: frozenset | None) -> None:
        """Search what has been gathered; to each state apart while the conversation goes on."""
        seen, texts = [(role[:1], fault) for role, _, fault in self.rows], [row[:2] for row in self.rows]
        best = {}
        for start, (cost, audit, digest, begun) in self.ways.items():
            for wanted in [goals] if goals else [frozenset((s,)) for s in range(4)]:
                found = search(seen, start, wanted)
                if found:
                    way = (cost + found[0], audit + found[1])
                    if found[2] not in best or way < best[found[2]][0]:
                        best[found[2]] = (way, start, found[1])
        after = {}
        for end, (way, start, edits) in best.items():
            _, _, digest, begun = self.ways[start]
            digest = digest.copy()
            for _, role, text in applied(edits, texts, start):
                digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True
            after[end] = (*way, digest, begun)
        self.ways, self.rows = after, []

    def result(self) -> tuple:
        self.close(ACCEPTING)
        cost, audit, digest, _ = min((w for s, w in self.ways.items() if s in ACCEPTING), key=lambda w: w[:2])
        low, high, distinct = self.turns
        gaps = 0 if low is None else high - low + 1 - distinct
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, cost, audit, digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: (conv_id, turn, role, text, gone). Rows that are dropped stay, marked, without text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("_code"))
    code = F.col("_code")
    text = F.when(code == 0, "").when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(code == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (code == 0).alias("gone"), copies.alias("_copy"))
    return rows.drop("_copy")


def faulted(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) with each one's first fault, dealt by conversation and in its order:
    by turn (null first), then role, then text. One shuffle: equal rows are told apart within it."""
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "gone", "_same").orderBy(F.col("turn").asc_nulls_first())) > 1
    blank = ~F.col("text").rlike(f"[^{SPACES}]")
    fault = F.when(F.col("gone"), 0).when(blank, BLANK).when(earlier, DUPLICATE).when(~F.col("text").rlike(rf"[.!?][{SPACES}]*\z"), TRUNCATED).otherwise(0)
    dealt = rows.withColumn("_same", same).repartition("conv_id").withColumn("fault", fault.cast("int")).drop("_same")
    return dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE)


def arrow(rows: list[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    if rows:
        columns = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows, strict=True), schema.fields, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)


FIELDS = ["gaps long", "blank long", "duplicate long", "truncated long", "illegal long", "cost long", "audit string", "repaired_sha256 string"]


def audits(rows: DataFrame) -> DataFrame:
    """Per conv_id of ``rows`` (as ``damaged`` gives them): its gaps, faults, illegal neighbours, least cost, edits
    (``audit``) and the SHA-256 of its repaired text. A null conv_id is a conversation of its own. Null texts and
    roles read as one space; so a null row is blank. Equal turns are ordered by role, then text. An empty table gives
    no rows; columns other than the five are ignored."""
    rows = rows.select("conv_id", "turn", "role", "text", "gone")
    schema = T.StructType([rows.schema["conv_id"], *[T.StructField(f.split()[0], T.LongType() if f.endswith("long") else T.StringType()) for f in FIELDS]])

    def run(batches):
        fold, at = None, None
        for batch in batches:
            out = []
            for conv, turn, role, text, gone, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if fold is None or conv != at:
                    if fold is not None:
                        out.append((at, *fold.result()))
                    fold, at = Fold(), conv
                if not gone:
                    fold.add(turn, role, text, fault)
            yield from arrow(out, schema)
        if fold is not None:
            yield from arrow([(at, *fold.result())], schema)

    return faulted(rows).mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, position (from 1), edit, role, text. Each conversation's edits
    (from ``audits``) arrive as a row before its own, and are applied as these stream by."""
    planned = audits(rows).select("conv_id", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("fault"))
    own = faulted(rows.select("conv_id", "turn", "role", "text", "gone")).where("not gone").select("conv_id", F.lit(1).alias("_kind"), F.col("turn").cast("long").alias("turn"), "role", "text", "fault")
    both = planned.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "_kind", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE)
    schema = T.StructType([rows.schema["conv_id"], T.StructField("position", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("edit", "role", "text")]])

    def run(batches):
        conv, edits, state, position = None, iter(()), START, 0
        for batch in batches:
            out = []

            def put(rows, until):
                """Apply edits up to the one of the row at hand, or to the end."""
                nonlocal state, position
                for edit in edits:
                    for _, role, text in applied(edit, rows, state):
                        position += 1
                        out.append((conv, position, edit, role, text))
                        state = STEP[state][role[:1]] if edit == "K" else LEADS[state]
                    if edit != "I" and until:
                        return

            for own, kind, role, text in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "_kind", "role", "text")], strict=True):
                if kind:
                    put([(role, text)], True)
                else:
                    put([], False)
                    conv, edits, state, position = own, iter(text), START, 0
            yield from arrow(out, schema)
        out = []
        put([], False)
        yield from arrow(out, schema)

    return both.mapInArrow(run, schema)

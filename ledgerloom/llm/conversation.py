"""Least-cost repair of damaged conversations by secondary-sorted streaming.

Rows are repartitioned by conversation once and sorted inside the partitions, twice: backwards by turn for the dynamic
program, forwards for its walk. Both passes are mapInPandas over Arrow batches and carry four numbers or one state from
batch to batch, so a conversation of any length takes no more memory than a batch. What the walk needs of the program is one
byte a row (the best edit in each of four states, two bits each); the byte travels with its row through Spark's external sort,
which spills the back-pointers of giant conversations to disk like any other rows.

States: nothing kept yet, after a system row, after a user row, after an assistant row. Edits: Keep (0), Rerole to user or
assistant (3), Delete (4, the only edit of blank and duplicate rows), Insert an empty row of user or assistant (3); a
truncated row that stays adds 3. Which role an edit gives follows from the state. The program runs from the last row to the
first, hence the first row that is walked knows what every choice costs to the end, and among equal costs the letter that
comes first in ASCII gives the least string of edits.

Rows: conv_id (any type), turn, role, text, and `gone` for rows of which only the conversation counts. Nulls in role and text
count as one space; null conv_ids are one conversation; null turns come first. Rows of one turn are ordered by role, then text.
A row without text or of blanks alone is blank. A conversation without rows has zeros, an empty audit and the hash
of the empty string. An empty table gives an empty result; other columns are not read. Equal rows of a giant conversation
meet in its one partition: the order of its rows is one sequence.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

LETTERS = "DIKR"  # in ASCII order: the code of an edit
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)  # the state after an inserted or rerolled row
ROLES = ("user", "user", "assistant", "user")  # the role of such a row
BLANKS = " \t\n\x0b\x0c\r"
AT_END = (0, 6, 3, 0)  # cost of the rows that are missing at the end
DELETE, REROLE, INSERT, CUT = 4, 3, 3, 3


def kept_state(initial: str, state: int) -> int | None:
    """The state after a kept row, or None where its role cannot stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def step_back(costs: tuple, initial: str, fault: int) -> tuple[tuple, int]:
    """(costs to the end before a row, its byte of best edits) from the costs after it; costs are relative to their least.
    fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    base, letter = [], []
    for state in range(4):
        ways = [(DELETE + costs[state], 0)]
        if fault in (0, 3):
            more = CUT if fault else 0
            if (after := kept_state(initial, state)) is not None:
                ways.append((more + costs[after], 2))
            ways.append((REROLE + more + costs[FOLLOWS[state]], 3))
        cost, code = min(ways)
        base.append(cost)
        letter.append(code)
    user, assistant = min(base[USER], INSERT + base[ASSISTANT]), min(base[ASSISTANT], INSERT + base[USER])
    ahead = (user, user, assistant, user)  # one insertion leads here
    best = [min(b, INSERT + a) for b, a in zip(base, ahead)]
    back = 0
    for state in range(4):
        codes = [letter[state]] if base[state] == best[state] else []
        codes += [1] if INSERT + ahead[state] == best[state] else []
        back |= min(codes) << 2 * state
    low = min(best)
    return tuple(x - low for x in best), back


def backwards(frames):
    """Adds `back` to rows that come conversation by conversation, last row first."""
    conv, costs, known = None, AT_END, {}
    for frame in frames:
        out = []
        for c, gone, initial, fault in zip(frame["conv"], frame["gone"], frame["initial"], frame["fault"]):
            if c != conv:
                conv, costs = c, AT_END
            byte = 0
            if not gone:
                case = costs, initial if initial in ("s", "u", "a") else "", fault
                if case not in known:
                    known[case] = step_back(*case)
                costs, byte = known[case]
            out.append(byte)
        frame["back"] = out
        yield frame


class Digest:
    """One conversation's counts, audit and hash, row by row."""

    columns = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    fields = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def __init__(self, conv):
        self.conv, self.faults, self.illegal, self.cost, self.rows, self.audit = conv, [0, 0, 0, 0], 0, 0, 0, bytearray()
        self.first = self.last = None
        self.turns, self.before, self.hash = 0, None, hashlib.sha256()

    def seen(self, turn, initial, fault):
        """A damaged row, in order."""
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn:
            turn = int(turn)
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn

    def edit(self, code, role, text, cost):
        self.audit.append(ord(LETTERS[code]))
        self.cost += cost
        if code:
            self.hash.update(("\n" * (self.rows > 0) + f"{role}:{text}").encode())
            self.rows += 1

    def done(self, out):
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        out.append((self.conv, gaps, *self.faults[1:], self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest()))


class Repair(Digest):
    """The edits themselves: a row for each, in order."""

    columns = ["conv", "position", "edit", "role", "text"]
    fields = "conv string, position long, edit string, role string, text string"

    def __init__(self, conv):
        self.conv, self.position, self.out = conv, 0, None

    def seen(self, turn, initial, fault):
        pass

    def edit(self, code, role, text, cost):
        self.out.append((self.conv, self.position, LETTERS[code], role, text))
        self.position += 1

    def done(self, out):
        pass


def forwards(kind, frames):
    """The walk: rows in order, each with its byte. Yields frames of what `kind` makes of them."""
    import pandas as pd

    out, conv, state, at = [], None, START, None

    def close():
        nonlocal state
        while state in (SYSTEM, USER):
            at.edit(1, ROLES[state], "", INSERT)
            state = FOLLOWS[state]
        at.done(out)

    for frame in frames:
        for c, turn, gone, initial, fault, role, text, back in zip(*(frame[x] for x in ("conv", "turn", "gone", "initial", "fault", "role", "text", "back"))):
            if at is None or c != conv:
                if at is not None:
                    at.out = out
                    close()
                conv, state, at = c, START, kind(c)
            at.out = out
            if gone:
                continue
            at.seen(turn, initial, fault)
            while True:
                code = back >> 2 * state & 3
                if code == 0:
                    at.edit(code, role, text, DELETE)
                elif code == 1:
                    at.edit(code, ROLES[state], "", INSERT)
                    state = FOLLOWS[state]
                    continue
                elif code == 2:
                    at.edit(code, role, text, CUT * (fault == 3))
                    state = kept_state(initial, state)
                else:
                    at.edit(code, ROLES[state], text, REROLE + CUT * (fault == 3))
                    state = FOLLOWS[state]
                break
        if out:
            yield pd.DataFrame(out, columns=kind.columns)
            out = []
    if at is not None:
        at.out = out
        close()
        if out:
            yield pd.DataFrame(out, columns=kind.columns)


def damaged(rows: DataFrame) -> DataFrame:
    """Faults for testing repairs, by crc32 of 'conv_id:turn' modulo 20: 0 drops the row (`gone`), 1 empties its text, 2 takes
    its sentence ends, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    role = F.when(kind == 4, "user").otherwise(shown("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copy"))
    return out.select("conv_id", "turn", "role", "text", "gone", F.explode("copy").alias("copy")).drop("copy")


def ordered(turn: Column, forward: bool) -> list[Column]:
    names = [turn, F.col("role"), F.col("text"), F.col("again")]
    return [F.asc_nulls_first(c) if forward else F.desc_nulls_last(c) for c in names]


def streamed(rows: DataFrame, kind) -> DataFrame:
    conv_type = rows.schema["conv_id"].dataType
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    narrow = rows.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), gone.alias("gone"))
    same = W.partitionBy("conv", "gone", "role", F.sha2("text", 256)).orderBy(F.asc_nulls_first("turn"))
    marked = narrow.repartition("conv").withColumn("again", F.row_number().over(same) > 1)
    inked = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(inked == "", 1).when(F.col("again"), 2).when(~F.right(inked, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    marked = marked.withColumns({"initial": F.left("role", F.lit(1)), "fault": fault})
    turn = F.col("turn")
    marked = marked.withColumns({"turn": F.coalesce(turn.cast("string"), F.lit("")), "at": turn})  # pandas would turn longs with nulls into doubles
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.drop("at").schema)
    back = marked.sortWithinPartitions(F.col("conv"), *ordered(F.col("at"), False)).drop("at").mapInPandas(backwards, f"{fields}, back int")
    walked = back.sortWithinPartitions(F.col("conv"), *ordered(F.nullif("turn", F.lit("")).cast("long"), True)).mapInPandas(functools.partial(forwards, kind), kind.fields)
    conv = F.when(F.col("conv") != "", F.substr("conv", F.lit(2)))
    return walked.select(conv.cast(conv_type).alias("conv_id"), *(F.col(c) for c in kind.columns[1:]))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the cheapest edits of each conversation in order; deleted rows are those with edit
    D, the repaired conversation is the rest."""
    return streamed(rows, Repair)


def digests(rows: DataFrame) -> DataFrame:
    """One row a conversation: turn gaps, faults, pairs of roles that cannot follow each other, cost, edits and hash of the repair."""
    return streamed(rows, Digest)

"""op13 against a search over all edits, for every small conversation, and across Arrow batches."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from ledgerloom.llm import conversation

INK = re.compile(r"[^\x20\x09-\x0D]")


def faults_of(rows):
    out, seen = [], set()
    for role, text in rows:
        ink = INK.findall(text)
        out.append(1 if not ink else 2 if (role, text) in seen else 3 if ink[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, repaired rows): the least over all edits, found by going through all of them forwards."""
    faults = faults_of(rows)
    ok = re.compile(r"(s?(ua)+)?")

    @functools.cache
    def best(i, held, inserted=0):  # held: role initials so far, as far as they matter
        ways = [(0, "", ())] if i == len(rows) and ok.fullmatch(held) else []
        if i < len(rows):
            role, text = rows[i]
            more = 3 * (faults[i] == 3)
            c, a, t = best(i + 1, held)
            ways.append((4 + c, "D" + a, t))
            if faults[i] not in (1, 2):
                ways += [(more + c, "K" + a, ((role, text), *t)) for c, a, t in after(i + 1, held, role[:1])]
                ways += [(3 + more + c, "R" + a, ((new, text), *t)) for new in ("user", "assistant") for c, a, t in after(i + 1, held, new[0])]
        if inserted < 3:  # no more insertions in a row are ever useful
            ways += [(3 + c, "I" + a, ((new, ""), *t)) for new in ("user", "assistant") for c, a, t in after(i, held, new[0], inserted + 1)]
        return min(ways, default=(10**9, "", ()))

    def after(i, held, initial, inserted=0):
        if initial and re.fullmatch(r"s?(ua)*u?", held + initial):
            return [best(i, "s" if held + initial == "s" else "su" if initial == "u" else "sua", inserted)]
        return []

    cost, audit, kept = best(0, "")
    return cost, audit, kept


def plain(rows):
    """Digest rows of (conv_id, turn, role, text) after damage, by conversation."""
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, [])
        c_, t_ = (" " if x is None else str(x) for x in (c, turn))
        kind = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[c] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, held in groups.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in held if t is not None]
        rows = [r[1:] for r in held]
        faults = faults_of(rows)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, kept = plain_repair(rows)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digests(spark, rows):
    df = spark.createDataFrame([(*r, True, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, gone boolean, conv string, fault int")
    got = conversation.digests(conversation.damaged(df))
    assert got.columns == ["conv_id", *conversation.Digest.columns[1:]]
    return sorted((tuple(r) for r in got.collect()), key=str)


def walk(rows):
    """The two passes on their own, in frames of two rows."""
    import pandas as pd

    marked = [{"conv": "=1", "turn": str(i), "gone": False, "initial": r[:1], "fault": f, "role": r, "text": t} for i, ((r, t), f) in enumerate(zip(rows, faults_of(rows)))]
    back = [f for f in conversation.backwards(pd.DataFrame(marked[::-1][i : i + 2]) for i in range(0, len(marked), 2))]
    rows = [r for f in back for r in f.to_dict("records")][::-1]
    got = [f for f in conversation.forwards(conversation.Digest, (pd.DataFrame(rows[i : i + 2]) for i in range(0, len(rows), 2)))]
    return got[-1].iloc[-1]


def test_every_small_conversation():
    kinds = [("system", "a."), ("user", "b."), ("assistant", "c"), ("user", " "), ("tool", "d!")]
    for n in range(1, 6):
        for rows in itertools.product(kinds, repeat=n):
            cost, audit, kept = plain_repair(rows)
            got = walk(list(rows))
            want = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
            assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, want), rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_search_over_all_edits(spark, seed):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "User"], ["Yes.", "no", "What?", "", " \n", None, "Go on!  ", "a\nb.", "é…"]
    rows = [(rng.choice([*range(40), None]), rng.choice([*range(8), None, -3]), rng.choice(roles[: 3 + 4 * (rng.random() < 0.2)]), rng.choice(texts)) for _ in range(300)]
    rows += rows[:20] + [(2**53 + 1, 2**53 + i, "user", "x.") for i in range(3)]
    assert digests(spark, rows) == plain(rows)


def test_conversations_of_which_nothing_is_left(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert digests(spark, [(gone, 1, "user", "a.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert digests(spark, []) == []


def test_a_giant_conversation_crosses_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        rng = random.Random(7)
        rows = [(i % 3 == 0 and 5 or 6 + i % 2, i, rng.choice(["user", "assistant", "assistant"]), rng.choice(["a.", "b", "c?", ""]) + str(rng.randint(0, 300))) for i in range(900)]
        assert digests(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edits_as_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "user", " "), (1, 3, "user", "u"), (2, 0, "user", "q?"), (2, 1, "assistant", "r!")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = conversation.repaired(df).orderBy("conv_id", "position")
    assert dict(got.dtypes)["conv_id"] == "int"
    edits = [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in got.collect()]
    assert edits[4:] == [] or [e for e in edits if e[0] == 2] == [(2, "K", "user", "q?"), (2, "K", "assistant", "r!")]
    cost, audit, kept = plain_repair([r[2:] for r in rows[:4]])
    assert "".join(e for c, e, _, _ in edits if c == 1) == audit
    assert tuple((r, t) for c, e, r, t in edits if c == 1 and e != "D") == kept

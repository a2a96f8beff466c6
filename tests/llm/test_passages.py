"""op12: the difference cover, and removal against a plain comparison of all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import substring


def plain(rows):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - 49) if i is not None else ():
            s = tuple(w[k : k + 50])
            least[s] = min(i, least.get(s, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 49) if i is not None else ():
            if least[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def removed(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "extra", 1) for i, t in rows], "doc_id long, text string, kept string, n_words long")
    return sorted((tuple(r) for r in substring.remove_passages(df, **options).select("doc_id", "n_words", "n_removed", "kept", "kept_sha256").collect()), key=str)


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(n)]


def test_every_difference_has_a_pair():
    cover = substring.COVER
    assert {(a - b) % substring.PERIOD for a in cover for b in cover} == set(range(substring.PERIOD))
    for x in range(31):
        for y in range(31):  # starts of equal windows: an anchor of both begins at most 30 words later
            assert any((x + k) % 31 in cover and (y + k) % 31 in cover for k in range(substring.WINDOW - substring.ANCHOR + 1))


@pytest.mark.parametrize("seed", range(4))
def test_equals_comparison_of_all_windows(spark, seed):
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (49, 50, 51, 64, 80, 120, 200)]
    rows = []
    for i in range(60):
        w = words(rng, rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:  # a near copy
                p[rng.randrange(len(p))] = "edited"
            a = rng.randint(0, len(p) - 1)
            at = rng.randint(0, len(w))
            w[at:at] = p[a:] if rng.random() < 0.3 else p
        text = "".join(x + rng.choice([" ", "\n", "\t ", "\x0b", " \r\n"]) for x in w)
        rows.append((rng.randint(-5, 40), text))
    rows += rows[:5] + [(100 + i, rows[7][1]) for i in range(6)]
    want = plain(rows)
    assert sum(r[2] for r in want) > 500
    assert removed(spark, rows, chunk_bytes=4000, bucket_bytes=3000) == want
    assert removed(spark, rows) == want


def test_nulls_empty_long_and_clashing(spark):
    rng = random.Random(9)
    p = " ".join(words(rng, 60))
    long = "w" * 3000 + " " + "é ü" * 400 + " " + " ".join(words(rng, 30000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, p), (5, f"a {p} b"), (None, p), (None, None), (6, long), (7, long + " end"), (7, p), (-(2**63), p.upper()), (2**63 - 1, p.upper())]
    assert removed(spark, rows, chunk_bytes=2000) == plain(rows)
    assert removed(spark, []) == []


def test_one_text_and_one_word_everywhere(spark):
    rows = [(i, "same " * 70) for i in range(40)] + [(100 + i, f"{i} " + "tail of all " * 40) for i in range(40)]
    assert removed(spark, rows, chunk_bytes=1000, bucket_bytes=1000) == plain(rows)


def test_word_codes_tell_words_apart():
    text = ["a b aa ab ba " + "x" * 300 + " " + "x" * 301 + " abcdefgh abcdefgi abcdefghi", "a"]
    w = substring.Words(pa.table({"doc_id": [1, 2], "text": text}))
    codes = [w.codes(k) for k in (0, 1)]
    assert all(len(np.unique(c)) == 10 for c in codes) and codes[0][0] == codes[0][-1]
    assert w.count.tolist() == [10, 1] and w.left.tolist() == [*range(10, 0, -1), 1]

"""Suffix, Jaccard and cap-filter dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest

from ledgerloom.llm import capfilter, jaccard, suffix
from ledgerloom.llm.common import connected_components, spanning

DOCS = "doc_id long, text string"


def passages(rng, n):
    words = ["ab", "the", "cd e", "fgh", "ij", "klmno", "p", "é", "ñandu", "of"]
    return " ".join(words[i] for i in rng.integers(0, len(words), n))


def sample_texts():
    rng = np.random.default_rng(3)
    base = [passages(rng, 60) for _ in range(6)]
    docs = [(i, passages(rng, 20) + base[i % 6][: 40 + 9 * (i % 14)] + passages(rng, 15)) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "a" * 300), (53, "a" * 80), (54, "ab" * 90), (55, base[0]), (56, base[0]), (57, "\0" * 90), (58, "\0" * 55), (59, " \n "), (60, "short")]
    return docs


def brute_repeats(docs, n=50):
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first.setdefault(b[k : k + n], i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                gone[k : k + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) if b else b""
        out[i] = (len(b), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if b else 0, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_equals_brute_force(spark):
    docs = sample_texts()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], f"{DOCS}, kept string, n_bytes int").repartition(5)
    got = suffix.remove_repeats(df, chunk_bytes=1500, bucket_bytes=1500, batch=50)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == brute_repeats(docs)


def test_suffix_of_one_long_text_and_an_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [(1, long), (2, "x" + long[100_000:100_400])]
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in suffix.remove_repeats(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {1: (0, long), 2: (400, "x")}
    assert suffix.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute_components(docs, width, num, den):
    sets = {i: shingle_set(t, width) for i, t in docs}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and sets[b]]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}, len(links)


@pytest.mark.parametrize("width,num,den,block", [(3, 90, 100, 1000), (5, 80, 100, 1000), (3, 90, 100, 3)])
def test_jaccard_equals_brute_force(spark, width, num, den, block):
    rng = np.random.default_rng(5)
    docs = []
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(0, 300, int(rng.choice([4, 11, 14, 40, 150])))]
        for _ in range(6):
            edited = list(words)
            for _ in range(int(rng.integers(0, 4))):
                edited[int(rng.integers(len(edited)))] = f"n{int(rng.integers(99))}"
            docs.append((len(docs), " ".join(edited)))
    docs += [(900, None), (901, ""), (902, " \t "), (903, "One two"), (904, "one  TWO"), (905, "É é"), (906, "é é"), (907, docs[0][1].upper()), (908, docs[0][1])]
    want, links = brute_components(docs, width, num, den)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], f"{DOCS}, n long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(df, width, num, den, block).collect()}
    assert links > 20 and got == want
    assert jaccard.components(spark.createDataFrame([], DOCS)).count() == 0


def test_linked_sets_share_a_point():
    rng = np.random.default_rng(11)
    for num, den in ((90, 100), (80, 100)):
        points = jaccard.Points(num, den)
        for _ in range(400):
            x = set(rng.integers(0, 2**63, int(rng.integers(4, 200))).tolist())
            y = set(x)
            while True:
                z = set(y)
                z.discard(next(iter(z))) if rng.random() < 0.5 else z.add(int(rng.integers(0, 2**63)))
                if not z or den * len(x & z) < num * len(x | z):
                    break
                y = z
            if x != y:
                a, b = (points.of(np.array(sorted(s), np.uint64)) for s in (x, y))
                assert len(np.intersect1d(a, b))


def vectors(rng):
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(40):
            c = rng.standard_normal(64)
            for _ in range(int(rng.integers(1, 5))):
                rows.append((n, (c + rng.standard_normal(64) * rng.choice([0.0, 0.1, 0.3])).astype(np.float32).tolist(), label))
                n += 1
    one = rows[0][1]
    rows += [(n, one, 0), (n + 1, one, 0), (n + 2, one, None), (n + 3, None, 0), (n + 4, [0.0] * 64, 0), (n + 5, [float("nan")] * 64, 0), (n + 6, one[:32], 0), (n + 7, [2 * x for x in one], 0), (n + 8, [1.0] + [None] * 63, 0), (n + 9, [float("inf")] * 64, 0)]
    return rows


@pytest.mark.parametrize("block", [1200, 4])
def test_cap_filters_against_brute_force(spark, block):
    rows = vectors(np.random.default_rng(2))
    fine = [(i, np.array(v, float), y) for i, v, y in rows if v is not None and y is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows}
    for i, v, y in fine:
        for j, w, z in fine:
            if i != j and y == z and len(v) == len(w) and v @ w >= 0.93 * np.linalg.norm(v) * np.linalg.norm(w):
                links[i].add(j)
    want = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        want[i] = (len(links[i]), min(seen))
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in capfilter.near_duplicates(df, block=block).collect()}
    total = sum(n for n, _ in want.values())
    found = sum(got[i][0] for i in want)
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)
    assert total > 50 and found >= 0.98 * total
    assert capfilter.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}


def test_spanning_forest_keeps_components():
    i, j = spanning(np.array([(0, 1), (1, 2), (4, 3)]), 6)
    assert sorted(zip(i.tolist(), j.tolist())) == [(1, 0), (2, 0), (4, 3)]


def test_filters_compare_a_share_of_the_pairs_that_falls_as_they_grow():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((300, 64))
    z -= (z * x[:300]).sum(1, keepdims=True) * x[:300]
    unit = np.concatenate([x, 0.931 * x[:300] + np.sqrt(1 - 0.931**2) * z / np.linalg.norm(z, axis=1, keepdims=True)])
    every, shares = len(unit) * (len(unit) - 1) // 2, []
    for code in (64, 256):
        lists = capfilter.list_decode(unit, code, 32, 24)
        size = np.array([len(x) for x in lists])
        row = np.repeat(np.arange(len(unit)), size)
        at = np.argsort(np.concatenate(lists), kind="stable")
        row, filter_ = row[at], np.concatenate(lists)[at]
        padded = -3 - np.arange(len(unit))[:, None] * np.ones(size.max(), np.int64)
        padded[np.arange(size.max()) < size[:, None]] = np.concatenate(lists)
        group = np.cumsum(np.diff(filter_, prepend=filter_[:1]) != 0)
        pairs, taken = capfilter.meeting(unit[row], padded[row], group, filter_, np.zeros(len(row), int), 0.93)
        pairs = row[pairs]
        assert len(np.unique(pairs, axis=0)) == len(pairs)  # each link once
        assert {(i, i + 1500) for i in range(300)}.issuperset(map(tuple, np.sort(pairs, 1))) and len(pairs) >= 0.97 * 300
        shares.append(taken / every)
    assert shares[1] < shares[0] / 3 and shares[1] < 0.03


def test_cap_filters_take_any_labels_and_double_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.1], "a"), (2, [1.0, 0.0, 0.11], "a"), (3, [1.0, 0.0, 0.1], "b"), (4, [1.0, 0.0, 0.1], "a"), (5, [], "a"), (4, [0.0, 1.0, 0.0], "a")]
    got = capfilter.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (4, 2, 1, False), (5, 0, 5, True)]


def test_hamming_blocks_meet_all_within_the_radius_and_few_others(spark):
    from pyspark.sql import functions as F

    from ledgerloom.llm import decontaminate as D

    rng = np.random.default_rng(6)
    signed = lambda x: int(x) - (1 << 64 if int(x) >> 63 else 0)
    items = rng.integers(0, 1 << 64, (20, 2), np.uint64)
    rows = []
    for i in range(600):
        fp = items[i % 20].copy() if i < 300 else rng.integers(0, 1 << 64, 2, np.uint64)
        for bit in rng.choice(128, int(rng.integers(0, 45)), replace=False):
            fp[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        rows.append((i, 40 + i % 2, signed(fp[0]), signed(fp[1])))
    known = [(j, 40 + j % 2, signed(a), signed(b)) for j, (a, b) in enumerate(items)]
    apart = lambda x, y: bin((x[2] ^ y[2]) & (1 << 64) - 1).count("1") + bin((x[3] ^ y[3]) & (1 << 64) - 1).count("1")
    want = {(x[0], y[0]): apart(x, y) for x in rows for y in known if x[1] == y[1] and apart(x, y) <= D.RADIUS}
    windows, benchmark = spark.createDataFrame(rows, "id long, m int, f0 long, f1 long"), spark.createDataFrame(known, "item_id long, m int, f0 long, f1 long")
    found = D.near_prints(windows, benchmark, ["id", "m"])
    got = found.collect()
    assert len(want) > 150 and {(r["id"], r["item_id"]): r["hamming"] for r in got} == want and len(got) == len(want)
    unrelated = D.near_prints(windows.where("id >= 300"), benchmark, ["id", "m"], radius=128).agg(F.count(F.lit(1))).first()[0]
    assert unrelated < 0.1 * 300 * 10


def test_windows_at_the_threshold_are_within_the_radius(spark):
    from pyspark.sql import functions as F

    from ledgerloom.llm import decontaminate as D

    rng = np.random.default_rng(7)
    rows = []
    for i in range(2000):
        n = int(rng.integers(9, 60))
        both = -(-8 * 2 * n // 18)  # shingles in common for a similarity of 0.8 just reached
        a = rng.integers(-(1 << 62), 1 << 62, n).tolist()
        rows.append((i, a, a[:both] + rng.integers(-(1 << 62), 1 << 62, n - both).tolist()))
    df = spark.createDataFrame(rows, "id long, a array<long>, b array<long>")
    one, two = (D.simhash(df.select("id", F.col(c).alias("sh")), ["id"]) for c in "ab")
    apart = one.join(two.select("id", F.col("f0").alias("g0"), F.col("f1").alias("g1")), "id")
    far = apart.where(F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("g1"))) > D.RADIUS).count()
    assert far <= 0.005 * 2000


def test_jaccard_of_null_ids_and_of_texts_that_share_an_id(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near, other = base + " x", " ".join(f"v{i}" for i in range(60))
    rows = [(None, near), (7, base), (7, other), (7, other), (3, near), (9, other + " y"), (None, base), (None, None), (5, "lone words here")]
    got = jaccard.components(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str)
    assert found == sorted([(None, 59, 3), (7, 58, 3), (7, 58, 3), (7, 58, 3), (3, 59, 3), (9, 59, 3), (None, 58, 3), (None, 0, None), (5, 1, 5)], key=str)


def test_repeated_ids_of_unlike_vectors_keep_their_own_links(spark):
    """Two vectors of id 5, each with one near vector, and rows without an id."""
    near = lambda v: [x + 0.01 for x in v]
    a, b, c = [1.0, 0.0, 0.0, 0.2], [0.0, 1.0, -0.3, 0.0], [-1.0, 0.1, 0.5, -1.0]
    rows = [(5, a, 1), (5, b, 1), (6, near(a), 1), (7, near(b), 1), (None, c, 1), (None, near(c), 1), (9, [0.9, -0.9, 0.1, 0.0], 1), (None, near([0.9, -0.9, 0.1, 0.0]), 1), (5, a, 2), (8, None, 1)]
    got = capfilter.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    show = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got.collect())
    assert show == sorted([("5", 1, "5", True)] * 2 + [("6", 1, "5", False), ("7", 1, "5", False), ("5", 0, "5", True), ("8", 0, "8", True), ("9", 1, "9", True), ("None", 1, "9", False)] + [("None", 1, "None", True)] * 2)

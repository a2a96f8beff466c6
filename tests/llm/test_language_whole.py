"""The language model against context trees of dictionaries: no context and no byte is left out."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import langid


def counted(texts):
    seen = defaultdict(Counter)
    for t in texts:
        b = b"\xff\xff\xff" + t.lower().encode()
        for i in range(3, len(b)):
            for k in range(4):
                seen[b[i - k : i]][b[i]] += 1
    return seen


def bits(seen, context, byte):
    count, n, d = seen[context][byte], sum(seen[context].values()), len(seen[context])
    if count:
        return -np.log2(count / (n + d))
    return (-np.log2(d / (n + d)) if n else 0.0) + (bits(seen, context[1:], byte) if context else 8.0)


def length(seen, text):
    b = b"\xff\xff\xff" + text.lower().encode()
    return sum(bits(seen, b[i - 3 : i], b[i]) for i in range(3, len(b)))


@pytest.mark.parametrize("many", [2, 3, 20, 200, 300])
def test_code_lengths_equal_brute_force(spark, many):
    rng = np.random.default_rng(4)
    letters = [list(map(chr, range(a, a + 26))) for a in (97, 0x430, 0x3B1, 0x5D0, 0xE0)]
    taught = {f"l{i:03d}": ["".join(rng.choice(letters[(i + j) % 5], 40)) + f" 4{i} ".join("日本語") for j in range(5 if many < 5 else 2)] for i in range(many)}
    rows = [(lang, t) for lang, texts in taught.items() for t in texts] + [("l000", "a"), (None, "x"), ("zz", None)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    texts = ["", "a", "ab", "abcd efg", "日本語 x", "Привет мир", "αβγ ñ \x01\x02", None, *taught["l001"]]
    got, size = langid.code_lengths(model, pa.array(texts, pa.string()))
    assert model["langs"] == sorted(taught) and size.tolist() == [len((t or "").lower().encode()) for t in texts]
    some = sorted(taught)[:: max(1, many // 6)]
    seen = {x: counted(taught[x] + ["a"] * (x == "l000")) for x in some}  # short texts teach, too
    for x in some:
        want = [length(seen[x], t or "") for t in texts]
        assert got[:, model["langs"].index(x)] == pytest.approx(want, rel=1e-5, abs=1e-4)
    rare = taught[sorted(taught)[-1]][0]
    assert langid.code_lengths(model, pa.array([rare]))[0].argmin() == many - 1

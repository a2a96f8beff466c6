"""Repair of excerpts: the count filter loses nothing and leaves a tenth of the comparisons."""

import random
from difflib import SequenceMatcher

import pytest

from ledgerloom.operators import evidence


def plain(excerpt, text, least):
    key = lambda x: " ".join(x.split()).casefold()
    lines = [x.strip(" ") for x in text.split("\n") if x.strip()]
    n = max(1, len([x for x in excerpt.split("\n") if x.strip()]))
    best, found, all_ = 0.0, None, 0
    for size in range(max(1, n - 1), min(len(lines), n + 1) + 1):
        for at in range(len(lines) - size + 1):
            all_ += 1
            window = "\n".join(lines[at : at + size])
            r = SequenceMatcher(None, key(excerpt), key(window), autojunk=False).ratio()
            if r > best:
                best, found = r, window
    return (found if best >= least else None), best, all_


def edited(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", "x", "xy"]) + text[at + rng.randint(0, 2) :]
    return text


@pytest.mark.parametrize("least", [0.97, 0.9, 0.6])
def test_filter_loses_nothing_and_spares_comparisons(least):
    rng = random.Random(3)
    words = ["limite", "de", "garantia", "agregado", "da", "apólice", "exclusão", "por", "dano", "ambiental", "segurado"]
    compared = every = hits = 0
    for _ in range(150):
        lines = [" ".join(rng.choices(words, k=rng.randint(2, 14))) + rng.choice(["", "  ", "\t", "."]) for _ in range(rng.randint(1, 14))]
        at, n = rng.randrange(len(lines)), rng.randint(1, 3)
        excerpt = edited(rng, "\n".join(lines[at : at + n]), rng.choice([0, 1, 1, 2, 3, 8])).upper()
        want, ratio, all_ = plain(excerpt, "\n".join(lines), least)
        got, similarity, n_compared = evidence.nearest(excerpt, "\n".join(lines), least)
        assert got == want and (want is None or similarity == ratio)
        compared, every, hits = compared + n_compared, every + all_, hits + (want is not None)
    assert hits > 20
    assert compared * {0.97: 10, 0.9: 6, 0.6: 1}[least] <= every, (compared, every)


def test_repaired_rows(spark):
    text = "Primeira linha do texto aqui\n\n  O limite máximo de garantia é\teste  \nUltima linha, sem nada"
    claims = [(1, 1, 10, "o limite maximo de garantia é este"), (1, 1, 11, "O LIMITE MÁXIMO DE GARANTIA É  ESTE"), (1, 1, 12, "curto demais"), (2, 1, 13, "o limite máximo de garantia é este"), (1, 2, 14, "o limite máximo de garantia é este"), (1, 1, 15, None)]
    got = evidence.repaired(spark.createDataFrame(claims, "document_id int, chunk_id int, claim_id int, excerpt string"), spark.createDataFrame([(1, 1, text), (1, 2, None), (1, 3, "")], "document_id int, chunk_id int, text string"))
    assert sorted((r["claim_id"], r["window"], round(r["similarity"], 3)) for r in got.collect()) == [(10, "O limite máximo de garantia é\teste", 0.971), (11, "O limite máximo de garantia é\teste", 1.0)]

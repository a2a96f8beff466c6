"""The dictionary automaton against plain string rules, for one and for several automata."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import automaton, evidence, routing, scoring


def plain_key(text):
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def texts(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("ab", k=rng.randint(1, 3)))
    line = lambda: rng.choice(["", "1 ", "2.1. ", "3 4 "]) + " ".join(word() for _ in range(rng.randint(0, 6))) + rng.choice(["", ".", ": X", "--"])
    return [(i, "\n".join(line() for _ in range(rng.randint(0, 5)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "\n\n--\n")]


TERMS = ["a", "ab", "a b", "b a", "ab ab", "a b a", "bb", "1 a", "2 1", "b", "aab aab"]


@pytest.mark.parametrize("letters", [automaton.LETTERS, 5])
def test_occurrences(spark, letters):
    rows = texts(1)
    chunks = scoring.folded(spark.createDataFrame(rows, "chunk_id int, text string"))
    terms = spark.createDataFrame([(t, f"p{i % 2}") for i, t in enumerate(TERMS + ["", None, "a"])], "term string, profile string")
    got = automaton.occurrences(chunks, terms, top=7, letters=letters)
    assert got.columns == ["chunk_id", "term", "profile", "n", "whole", "first", "near"]
    want = []
    for i, text in rows:
        key = plain_key(text or "")
        for k, t in enumerate(TERMS + ["a"]):
            if t in key:
                whole = lambda x: len(re.findall(rf"(?<![a-z0-9]){t}(?![a-z0-9])", x))  # noqa: E731, B023
                want.append((i, t, f"p{(k if k < len(TERMS) else k + 2) % 2}", key.count(t), whole(key), key.index(t), whole(key[:7]) > 0))
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("letters", [automaton.LETTERS, 5])
def test_lines(spark, letters):
    rows = texts(2, 60)
    chunks = spark.createDataFrame(rows, "chunk_id int, text string")
    kinds = {"risk": ["b: x", "ab"], "clause": ["aa"]}
    terms = [(t, m, p) for t, p in [("a", "a"), ("ab", "ab:"), ("a b", "a b"), ("bb", "bb."), ("1 a", "1 a")] for m in ("definition", "clause", "risk")]
    got = automaton.line_occurrences(scoring.lines_of(chunks), spark.createDataFrame(terms, "term string, mode string, plain string"), kinds, letters=letters)
    want = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keys = [plain_key(x) for x in lines]
        norm = " ".join(filter(None, keys))
        for t, m, p in terms:
            if t not in norm:
                continue
            rank = lambda k: max([r for r, x in ((320, rf"(\d+ )+{t}"), (270, rf"(\d+ )+{t} .*"), (220, t), (160, f"{t} .*")) if re.fullmatch(x, k)], default=0)  # noqa: E731, B023
            heads = [(rank(k), n) for n, k in enumerate(keys)]
            first = next(((r, n) for r, n in heads if r), (None, None))
            upper = None if first[1] is None else bool((h := lines[first[1]].split(":")[0].strip(" ")) and h == h.upper())
            near = next((n for n, x in enumerate(lines) if m in kinds and p in x.lower() and any(w in x.lower() for w in kinds[m])), None)
            want.append((i, t, m, p, max(heads)[0], first[1], first[0], upper, near))
    columns = ["chunk_id", "term", "mode", "plain", "head", "head_at", "head_rank", "head_upper", "kind_at"]
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want))


def test_alias_scores_are_the_same_at_every_size(spark):
    """A clause that names the alias in the middle of a line keeps its bonus beside 20,000 other terms and in many automata."""
    chunks = routing.folded(spark.createDataFrame([(1, "Nos termos da cláusula de alocação aplicável\nnada"), (2, "2.1 Alocação\nx"), (3, "a cobertura de multas\n")], "chunk_id int, text string"))
    mine = [("i", "clause", "alocacao", None), ("m", "risk", "multas", "multas")]
    many = mine + [(f"x{i}", "risk", f"termo {i}", f"termo {i}") for i in range(20000)]
    schema = "item string, mode string, term string, plain string"
    want = {(1, "i"): 8 + 1 + 12 + 100, (2, "i"): 8 + 1 + 12 + 180 + 320, (3, "m"): 8 + 1 + 12 + 90}
    for terms, letters in ((mine, automaton.LETTERS), (many, automaton.LETTERS), (many, 30000), (mine, 1)):
        got = routing.alias_scores(chunks, spark.createDataFrame(terms, schema), letters=letters)
        assert {(r["chunk_id"], r["item"]): r["score"] for r in got.collect()} == want


def test_windows_are_intervals_of_lines(spark):
    rows = texts(3, 60)
    units = spark.createDataFrame([(i, t) for i, t in rows], "document_id int, text string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    want = {}
    for i, text in rows:
        lines = [x.strip(" ") for x in (text or "").split("\n") if x.strip(" ")]
        for t in TERMS:
            fit = [(z, s) for z in (1, 2, 3) for s in range(len(lines) - z + 1) if t in plain_key("\n".join(lines[s : s + z]))]
            if fit:
                want[i, t] = (min(fit)[0], min(fit)[1] + 1, "\n".join(lines[min(fit)[1] :][: min(fit)[0]]))
    got = evidence.window_support(units, terms)
    assert {(r["document_id"], r["term"]): (r["size"], r["start"], r["window"]) for r in got.collect()} == want


def test_claims_meet_their_own_document_alone(spark):
    """Every join of find_support() holds document_id, and terms of other documents are not looked for."""
    pages = spark.createDataFrame([(d, p, f"pagina {p}\n{p}. alocacao do caso {d}\nfim da linha") for d in (1, 2, 3) for p in (1, 2)], "document_id int, page_number int, raw_text string")
    chunks = pages.select("document_id", "page_number", F.lit(0).alias("chunk_index"), F.concat(F.lit("c"), "page_number").alias("chunk_id"), F.col("raw_text").alias("text"))
    wanted = spark.createDataFrame([(10, 1, 2, ["alocação do caso 1"]), (20, 2, None, ["alocacao do caso 1", "fim  da LINHA"]), (30, 9, 1, ["alocacao"]), (40, 3, 5, None)], "claim_id int, document_id int, preferred_page int, terms array<string>")
    for heading in (False, True):
        got = evidence.find_support(wanted, chunks, pages, heading)
        assert {(r["claim_id"], r["page_number"], r["chunk_id"], r["term"]) for r in got.collect()} == {(10, 2, "c2", "alocacao do caso 1"), (20, 1, "c1", "fim da linha")}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.split("\n") if re.search(r"\bJoin (Inner|LeftOuter|FullOuter|LeftSemi)", x)]
        assert joins and all("document_id" in x for x in joins), joins


def test_large_packs_of_terms_are_dealt(spark):
    units = evidence.keyed(spark.createDataFrame([(1, 7, "um texto sobre termo 55 e termo 99")], "document_id int, unit int, text string"))
    terms = spark.createDataFrame([(1, f"termo {i}") for i in range(100)] + [(2, "texto"), (None, "texto"), (1, "")], "document_id int, term string")
    got = automaton.supported_within(units, terms, together=7).where("size = 1").collect()
    assert {(r["unit"], r["term"]) for r in got} == {(7, "termo 5"), (7, "termo 9"), (7, "termo 55"), (7, "termo 99")}


def test_folding_by_hand(spark):
    assert spark.range(1).select(X.fold(F.lit("Ação: 1ª")).alias("k")).first()["k"].startswith("acao 1")

"""Row scores with the boosts of labels, field ids, sides and statuses against the rule in plain Python."""

import re
import unicodedata

from ledgerloom.operators import retrieve

ROWS = [("r1", "Limite de garantia", "limit", "EQUAL", "Limite de garantia R$ 5"), ("r2", "Side A", "side_a", "DIFFERENT", "Cobertura A"), ("r3", "Franquia", "deductible", "NEEDS_REVIEW", "valor"), ("r4", "", "x_y", "ONLY_IN_SOME", "parcial"), ("r5", None, None, None, None), ("r6", "Moeda", "currency", "ALL_MISSING", "moeda")]
ASKED = ["Qual o limite de garantia?", "side a e side b", "Quais itens exigem revisão?", "o que é igual em todas", "apenas em algumas: x y", "compare as franquias", "", "moeda"]


def norm(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)).casefold()
    return re.sub(r"[^a-z0-9]+", " ", t).strip()


def expected(q, row, stop):
    _, label, field, status, text = row
    asked = norm(q)
    score = 5 * len({t for t in asked.split() if len(t) >= 2 and t not in stop} & set(norm(text).split()))
    score += 25 * bool(norm(label) and norm(label) in asked) + 18 * bool(norm(field) and norm(field) in asked)
    score += sum(50 for s in "abc" if f"side {s}" in asked and field == f"side_{s}")
    for name, boost, marks in (("NEEDS_REVIEW", 30, "revis ambigu conflit"), ("EQUAL", 16, "igual comum todas todos"), ("DIFFERENT", 12, "difer compar")):
        score += boost * (status == name and any(m in asked for m in marks.split()))
    return score + 16 * (status == "ONLY_IN_SOME" and any(m in asked for m in ("algumas", "apenas", "parcial", "so em")))


def test_boosts(spark):
    stop = ["de", "que", "em"]
    rows = spark.createDataFrame([(p, *r) for p in (1, 2) for r in ROWS[: 6 if p == 1 else 1]], "portfolio_id int, row_id string, label string, field_id string, status string, search_text string")
    asked = spark.createDataFrame([(1, i, q) for i, q in enumerate(ASKED)], "portfolio_id int, question_id int, question string")
    got = {(r["question_id"], r["row_id"]): r["score"] for r in retrieve.boosted(asked, rows, stop=stop).collect()}
    want = {(i, r[0]): s for i, q in enumerate(ASKED) for r in ROWS if (s := expected(q, r, stop)) > 0}
    assert got == want and want[1, "r2"] >= 87

"""Steps whose work grew faster than their input."""

from pyspark.sql import functions as F

from ledgerloom.operators import compare, evidence, nested, retrieve, taxonomy


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_matrix_is_counted_without_its_cells(spark):
    """1,500 members x 1,500 fields: the plan has no join that makes cells; repeated members count as often as they are listed."""
    cells = spark.range(1500).select(F.lit(1).alias("portfolio_id"), F.col("id").alias("entity_id"), F.lit("s").alias("section"), F.col("id").alias("field_id"), F.when(F.col("id") % 2 == 0, "FOUND").otherwise("AMBIGUOUS").alias("state"), F.lit("k").alias("key"), F.lit("l").alias("label"))
    members = spark.range(1501).select(F.lit(1).alias("portfolio_id"), F.col("id").alias("entity_id"), F.col("id").alias("position"))
    members = members.union(members.where("entity_id = 4"))
    got = compare.matrix_counts(cells, members)
    m = compare.matrix(cells, members)
    found = F.count_if(F.col("state") == "FOUND")
    want = m.groupBy("portfolio_id", "entity_id").agg(F.count(F.lit(1)), found, F.count(F.lit(1)) - found)
    assert rows(got) == rows(want)
    assert got.where("entity_id = 4").first()["found"] == 2


def test_terms_of_long_texts_are_folded_once(spark):
    """The least length was folded anew for every line: 4,000 lines took minutes."""
    import time

    lines = [f"Linha número {i:05d}" for i in range(4000)]
    df = spark.createDataFrame([(lines,)], "ls array<string>")
    began = time.time()
    (got,) = df.select(F.size(taxonomy.recovery_terms(F.lit("um"), F.col("ls"), F.lit("dois")))).first()
    assert got == 4000 and time.time() - began < 20


def test_items_come_with_their_limits(spark):
    """Limits inside the items give what a join with financials gives."""
    items = spark.createDataFrame([(1, 1, "coverages", "a", 0.5, 0.9, "A", None), (1, 2, "exclusions", None, 0.0, 0.9, "B", "c"), (2, 1, "extensions", "b", 0.1, 0.2, "C", None)], "d int, pos int, section string, canonical_id string, normalization_confidence double, given_confidence double, name string, category string")
    money = spark.createDataFrame([(1, 1, 1, None, "other", 5), (1, 1, 0, "x", "y", 7), (2, 1, 0, "z", "y", 9)], "d int, pos int, inner_pos int, canonical_id string, field_id string, amount int")
    limit = F.struct("inner_pos", F.coalesce("canonical_id", "field_id").alias("canonical_id"), "amount")
    held = items.join(money.groupBy("d", "pos").agg(F.array_sort(F.collect_list(limit)).alias("limits")), ["d", "pos"], "left")
    want = nested.item_sections(items, money, "d", "pos")
    assert rows(nested.item_sections(held, None, "d", "pos")) == rows(want)
    got = nested.items_of_sections(want, "d", ["coverages", "extensions"])
    assert [(r.d, r.section, r.x.name) for r in got.orderBy("d").collect()] == [(1, "coverages", "A"), (2, "extensions", "C")]


def test_repair_queries_change_one_compared_letter(spark, tmp_path):
    """A line of 45 letters that ends in ß: its SQL says one letter of 46 is changed."""
    from ledgerloom.plans import evidence_queries as E

    line = "Abcdefghij klmnopqrst uvwxyzabcd efghijklm qß"
    spark.createDataFrame([(1, line + "\nshort", "de", "s", 45)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(E.evidence_repair(spark, str(tmp_path))) == [(1, True)]
    (got,) = E.repair_windows(spark, str(tmp_path)).collect()
    assert got.similarity == round(1 - 1 / len(line.replace("ß", "ss")), 6)


def test_evidence_opens_first_documents_only(spark):
    """Rows share documents: a question's first documents, by brute force; rows bring hundreds of documents."""
    held = [(r, d) for r in range(1, 9) for d in range(500) if (d * 7 + r) % (r + 1) == 0 or d < r % 3]
    scores = [(q, r, 5 * ((q * r) % 4 + 1)) for q in range(30) for r in range(1, 9) if (q + r) % 3]
    s, h = spark.createDataFrame(scores, "question_id long, row_id long, score long"), spark.createDataFrame(held, "row_id long, document_id long")
    for limit in (1, 3, 12):
        want = []
        for q in range(30):
            best = {}
            for qq, r, x in scores:
                for rr, d in held if qq == q else ():
                    if rr == r:
                        best[d] = min(best.get(d, (1, 0)), (-x, r))
            want += [(q, d, f"E{n}") for n, d in enumerate(sorted(best, key=lambda d: (best[d], d))[:limit], 1)]
        assert rows(retrieve.evidence_of_rows(s, h, limit).select("question_id", "document_id", "evidence_id")) == sorted(want)


def test_excerpts_are_found_without_tokens(spark):
    """Excerpts meet texts as they are: cut words, repeats, sources that share an id, texts without blanks."""
    claims = spark.createDataFrame([(1, "b  c"), (2, " x\ny z "), (3, ""), (4, None), (5, "b c")], "claim_id int, excerpt string")
    texts = spark.createDataFrame([(1, "ab cd"), (1, "bb\tcc"), (2, "xx y zz"), (3, None), (4, "abcd")], "document_id int, text string")
    assert rows(evidence.containing(claims, texts)) == [(1, 1), (1, 1), (2, 2), (5, 1), (5, 1)]


def test_rows_that_score_alike_are_met_once(spark):
    """Of 300 rows with the same texts and status the first three stay, with the row that a question names."""
    from ledgerloom.operators import questions as Q

    r = spark.range(300).select(F.lit(1).alias("portfolio_id"), F.col("id").alias("row_id"), F.col("id").alias("row_order"), F.lit("s").alias("section"), F.concat(F.lit("part-"), F.col("id").cast("string")).alias("field_id"), F.lit("red wheel").alias("label"), F.lit("EQUAL").alias("status"), F.lit("red wheel").alias("search_text"))
    q = spark.createDataFrame([(1, 1, "red wheel, part-250?")], "question_id long, portfolio_id int, question string")
    assert {x for (x,) in Q.telling_rows(q, r, 3).select("row_id").collect()} == {0, 1, 2, 25, 250}
    assert [x.row_id for x in Q.best_rows(q, r, 3).orderBy("rank").collect()] == [2, 25, 250]

import datetime

from pyspark.sql import functions as F

from ledgerloom.functions import text as X


def values(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_fold_drops_marks_case_and_punctuation(spark):
    assert values(spark, X.fold, "  São PAULO—Straße!! ", None, "", "É-È") == ["sao paulo strasse", None, "", "e e"]
    assert values(spark, X.fold_marks, "Ção\nX.") == ["cao\nx."]
    assert values(spark, X.squeeze, " A \t\n b ") == ["A b"]


def test_clean_text(spark):
    assert values(spark, X.clean_text, "  A   B  \r\n\r\n  C\tD  \n\n\nE ", "a\0b", None) == ["A B\n\nC D\n\nE", "ab", None]


def test_decimal_key_keeps_zeros_before_the_point(spark):
    df = spark.sql("SELECT stack(5, '100', '1.50', '0', '0.000001', null) AS t")
    got = [r["v"] for r in df.select(X.decimal_key(F.col("t")).alias("v")).collect()]
    assert got == ["100", "1.5", "0", "0.000001", ""]


def test_rules_apply_in_order(spark):
    rules = [(["claims", "notification"], "CLAIMS_WITH_NOTIFICATION"), (["claims"], "CLAIMS")]
    assert values(spark, lambda c: X.canonical(c, rules), "Claims made, with NOTIFICATION", "claims made", "Other kind", None) == ["CLAIMS_WITH_NOTIFICATION", "CLAIMS", "OTHER_KIND", None]


def test_versions_dates_and_durations(spark):
    assert values(spark, X.version, "2025-12", "Março/2024", "marco / 2024", "2025-13", " v2 ") == ["2025-12", "2024-03", "2024-03", "2025-13", "v2"]
    assert values(spark, X.date_or_null, "2024-02-29", "2023-02-29", "x") == [datetime.date(2024, 2, 29), None, None]
    got = values(spark, X.duration, "12,5 meses", "3 anos", "sem prazo")
    assert [(str(x["number"]) if x["number"] is not None else None, x["unit"]) for x in got] == [("12.500", "months"), ("3.000", "years"), (None, None)]


def test_terms_count_whole_words_only(spark):
    assert values(spark, lambda c: X.term_count(X.fold(c), F.lit("segurado")), "segurado seguradora o Segurado", "x") == [2, 0]
    assert values(spark, lambda c: X.substring_count(c, F.lit("aa")), "aaaa a", "") == [2, 0]
    assert values(spark, lambda c: X.tokens(c, ["de"]), "A de Casa, casa da Lua") == [["casa", "da", "lua"]]


def test_heading_scores(spark):
    assert values(spark, lambda c: X.heading_score(c, F.lit("limite")), "3.1 Limite", "3 LIMITE de garantia", "Limite", "limite x", "o limite") == [320, 270, 220, 160, 0]


def test_display_helpers(spark):
    assert values(spark, lambda c: X.shortened(c, 5), "abcdef", "abc") == ["abcd…", "abc"]
    assert values(spark, X.escaped, "a|b\n c") == ["a\\|b c"]
    assert values(spark, X.without_rule_references, "Ok (regra 3), veja [rules 1 and 2] isto.", "conforme regra 9 vale") == ["Ok, veja isto.", "vale"]
    assert values(spark, lambda c: X.first_mention_marked(c, F.lit("Acme"), "*"), "Acme and Acme", "Acme* twice Acme", "none") == ["Acme* and Acme", "Acme* twice Acme", "none"]
    assert values(spark, X.slug, "Minha Apólice 1", "!!") == ["minha-ap-lice-1", "document"]

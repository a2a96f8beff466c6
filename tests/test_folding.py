"""Folding over every code point that has a decomposition, and of texts as PDF producers write them."""

import re
import unicodedata

from pyspark.sql import functions as F

from ledgerloom.functions import text as X


def plain_marks(text):
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.casefold()


def plain(text):
    return re.sub("[^a-z0-9]+", " ", plain_marks(text)).strip()


def folded(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.fold_marks(F.col("t")).alias("m"), X.fold(F.col("t")).alias("k")).collect()
    return [(r["m"], r["k"]) for r in sorted(rows)]


def test_texts(spark):
    texts = ["cafés e aﬁns", "cafés e afins", "Ａ０", "x² ½ Ⅷ", "Straße ẞ", "İı", "Ấp dụng", "Σίσυφος", "Kªº", "ạ̈b", "㎥ ™", "plain ASCII", "", None, "Й 가", "힣"]
    got = folded(spark, texts)
    assert got[0] == got[1] == ("cafes e afins", "cafes e afins")
    assert got[13] == (None, None)
    for text, (marks, key) in zip(texts, got):
        if text is not None:
            assert key == plain(text), text
            if not any(0xAC00 <= ord(c) < 0xD7A4 for c in text):
                assert marks == plain_marks(text), text


def test_every_letter_that_decomposes(spark):
    letters = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000 and (unicodedata.decomposition(chr(x)) or unicodedata.combining(chr(x)) or chr(x).casefold() != chr(x))]
    letters = [c for c in letters if not 0xAC00 <= ord(c) < 0xD7A4]
    assert len(letters) > 7000
    for c, (marks, key) in zip(letters, folded(spark, [f"Ab{c}cD" for c in letters])):
        assert key == plain(f"Ab{c}cD"), hex(ord(c))
        assert marks == plain_marks(f"Ab{c}cD"), hex(ord(c))

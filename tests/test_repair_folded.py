"""Repair by edit distance of folded texts."""

import time

from pyspark.sql import functions as F

from ledgerloom.operators import evidence


def test_windows_of_long_texts_stay_places(spark):
    """8,000 lines: each window brought the text's lines along. The window of two lines, with an empty key between, wins over other lines."""
    lines = [f"Linha número {i:05d} de um texto muito comprido {'x' * (i % 60)}" for i in range(8000)]
    lines[5000:5003] = ["A cobertura é válida em todo o território", "---", "nacional, salvo exclusões expressas aqui"]
    claims = spark.createDataFrame([(1, 1, 7, "A cobertura é válida em todo o território\n---\nnacional, salvo exclusões expressas aqvi"), (1, 1, 8, "-" * 30), (1, 1, 9, "nothing of the kind stands anywhere here")], "document_id int, chunk_id int, claim_id int, excerpt string")
    chunks = spark.createDataFrame([(1, 1, "\n".join(lines))], "document_id int, chunk_id int, text string")
    began = time.time()
    (got,) = evidence.repaired_folded(claims, chunks).collect()
    assert time.time() - began < 30
    assert (got.claim_id, got.window) == (7, "\n".join(lines[5000:5003]))
    assert got.similarity == 1 - 1 / 81

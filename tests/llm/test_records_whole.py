"""Ids of whole texts equal the tokenizer's own, for every tokenizer file; odd ids and rows come back as they were."""

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import records

DATA = "/root/testdata/sf0.01"
ODD = ["", " ", "a\tb", "It's  THE <|endoftext|> end", "naïve é ̈x", "  nb sp em", "x\r\ny\n\n", "İstanbul ǅ ß...", "12,3%!? #a$", "日本 語", "'s's 're", "\0 a\0b"]


def files():
    import public_tokenizers

    folder = os.path.dirname(records.tokenizer_path())
    assert public_tokenizers
    return sorted(f"{folder}/{x}" for x in os.listdir(folder) if x.endswith(".json"))


@pytest.mark.parametrize("path", files())
def test_encoder_equals_the_library(spark, path):
    from tokenizers import Tokenizer

    texts = ODD + [None] + [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    width = records.id_width(path, 1)
    flat, at = records.encoder(path, width)(pa.array(texts, pa.string()))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_only_a_known_form_is_cut_at_blanks():
    known = [x for x in files() if records.cuts_at_blanks(json.load(open(x, encoding="utf-8")))]
    assert known == [records.tokenizer_path()]
    spec = json.load(open(known[0], encoding="utf-8"))
    for change in ({"truncation": {"max_length": 3}}, {"normalizer": None}, {"pre_tokenizer": None}, {"model": {"type": "WordLevel"}}, {"added_tokens": [{"content": "a b", "lstrip": False, "rstrip": False, "single_word": False}]}):
        assert not records.cuts_at_blanks(spec | change)


def test_wide_ids_null_ids_and_repeats(spark):
    from tokenizers import Tokenizer

    docs = [(5, "b a", 1), (None, "x", 2), (5, "a", 3), (-3, None, 4), (None, None, 5)]
    path = records.tokenizer_path()
    manifest = records.write_records(spark.createDataFrame(docs, "doc_id long, text string, n_ids long"), path, end_id=70_000, parts=2)
    assert {r["width"] for r in manifest.collect()} == {4}
    encode = Tokenizer.from_file(path).encode
    want, start = [], 0
    for i, t, _ in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = encode(t or "", add_special_tokens=False).ids + [70_000]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = records.read_records(manifest).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    with pytest.raises(Exception, match="least long"):
        records.write_records(spark.createDataFrame([(records.NO_ID, "a")], "doc_id long, text string"), path).count()


def test_query_equals_the_library_on_all_documents(spark):
    from tokenizers import Tokenizer

    from ledgerloom.llm import queries

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    encoded = Tokenizer.from_file(records.tokenizer_path()).encode_batch([t or "" for _, t in docs], add_special_tokens=False)
    want, start = [], 0
    for (i, _), e in zip(docs, encoded):
        want.append((i, start, len(e.ids) + 1, zlib.crc32(np.array([*e.ids, 1], "<u4").tobytes())))
        start += len(e.ids) + 1
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in queries.op5_records(spark, DATA).collect()) == want

"""The chunker cuts a few pages at a time, whatever the size of a batch."""

import pyarrow as pa

from ledgerloom.operators import pages as P


def test_large_batches_are_cut_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1, "x")], "document_id long, page_number int, clean_text string")
    held = []
    kept = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: held.append(f) or kept(self, f, schema))
    P.chunks(df, size=20, overlap=5, back=5)
    texts = [None if i % 50 == 0 else " ".join(f"w{i}" for _ in range(i % 9)) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([1] * 1000, pa.int32()), pa.array(texts)], ["document_id", "page_number", "clean_text"])
    out = list(held[0](iter([batch])))
    (one,) = held[0](iter([batch.slice(0, 200)]))
    assert len(out) == 4 and max(len(set(b.column(0).to_pylist())) for b in out) <= 256
    every = pa.Table.from_batches(out)
    assert every.slice(0, one.num_rows).to_pylist() == one.to_pylist()
    assert all(r["text"] == texts[r["document_id"]][r["char_start"] : r["char_end"]] for r in every.to_pylist())

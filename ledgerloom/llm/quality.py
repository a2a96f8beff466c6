"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is a row of a term matrix: byte-class bigrams of the whole text plus shape terms (how many words, and the
bounds that the share of distinct words is below). A term counts as its log frequency times a weight learned from the
labelled rows: how far apart the classes' means of the term lie, over its variance inside the classes (with one class
all weights are 1). A truncated singular value decomposition of the weighted labelled rows gives the latent space. The
labelled vectors (at most `max_labelled` a class, a
bound of the broadcast) go to every task, which takes exact cosines of its documents with all of them in blocks of
matrix products. The `neighbours` nearest vote with weights exp(cosine / temperature), and each class's votes are
scaled by the share of it that was taken, so the vote estimates the true class odds.

Nulls and empty texts have only shape terms and get a score like any text. Repeated rows are scored alike. With
no labelled rows the score is 0.5, with one class it is that class. Null doc_ids are never labelled. Extra columns are
kept, score and predicted are overwritten.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import blocks, utf8_view

CLASSES, BANDS, SHARES = 32, 16, 12
TERMS = CLASSES * CLASSES + BANDS + SHARES


def byte_classes() -> np.ndarray:
    """Class of each byte: a-z each their own, then upper case, digit, white space, sentence mark, symbol, non-ASCII."""
    table = np.full(256, 30, np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(26)
    table[ord("A") : ord("Z") + 1] = 26
    table[ord("0") : ord("9") + 1] = 27
    table[[9, 10, 11, 12, 13, 32]] = 28
    table[[ord(c) for c in ".,;:?'\"-()"]] = 29
    table[128:] = 31
    return table


def term_rows(column) -> np.ndarray:
    """Raw term frequencies (rows x TERMS, float32) of an Arrow string column: bigram shares and shape terms."""
    data, offsets = utf8_view(column)
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if len(data) > 1:
        kind = byte_classes()[data].astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(offsets))
        code = row[:-1] * (CLASSES * CLASSES) + kind[:-1] * CLASSES + kind[1:]
        out[:, : CLASSES * CLASSES] = np.bincount(code[row[:-1] == row[1:]], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    out[:, : CLASSES * CLASSES] *= 1000 / np.maximum(np.diff(offsets), 1)[:, None]
    raw = data.tobytes()
    for i in range(n):
        words = raw[offsets[i] : offsets[i + 1]].split()
        share = len(set(words)) / len(words) if words else 0.0
        out[i, CLASSES * CLASSES + min(BANDS - 1, len(words).bit_length())] = 1
        out[i, CLASSES * CLASSES + BANDS + min(SHARES - 1, int(share * SHARES)) :] = 1  # one term for each bound that the share is below
    return out


def fit(rows: np.ndarray, labels: np.ndarray, taken: tuple[float, float], latent: int = 64) -> dict:
    """Model from labelled term rows. taken: per class, how many labelled rows each taken row stands for."""
    x = np.log1p(rows.astype(np.float64))
    weight = term_weights(x, labels)
    _, vectors = np.linalg.eigh((x * weight).T @ (x * weight))
    base = weight[:, None] * vectors[:, ::-1][:, :latent]
    return {"base": base, "points": unit(x @ base), "labels": labels.astype(np.float32), "taken": taken}


def term_weights(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """What a term says about the class: distance of the class means over the mean variance inside the classes."""
    good, bad = x[labels > 0], x[labels <= 0]
    if not len(good) or not len(bad):
        return np.ones(x.shape[1])
    return np.abs(good.mean(0) - bad.mean(0)) / ((good.var(0) + bad.var(0)) / 2 + 1e-3)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vote(model: dict, rows: np.ndarray, neighbours: int, temperature: float) -> np.ndarray:
    cosines = unit(np.log1p(rows.astype(np.float64)) @ model["base"]) @ model["points"].T
    k = min(neighbours, cosines.shape[1])
    near = np.argpartition(cosines, -k, axis=1)[:, -k:] if k < cosines.shape[1] else np.tile(np.arange(k), (len(rows), 1))
    y = model["labels"][near]
    weight = np.exp((np.take_along_axis(cosines, near, 1) - 1) / temperature) * np.where(y > 0, model["taken"][1], model["taken"][0])
    return (weight * y).sum(1, dtype=np.float64) / np.maximum(weight.sum(1, dtype=np.float64), 1e-300)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 2048, latent: int = 64):
    """Model from (doc_id, text) and (doc_id, quality); None without labelled rows. Sample: least hashes of doc_id."""
    labels = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    first = [labels.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled) for c in (0, 1)]
    taken = first[0].unionByName(first[1])
    counts = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}

    def rows(batches):
        for batch in batches:
            x = term_rows(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["quality", "row"])

    # at most 2 * max_labelled ids: a proven bound
    found = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("quality", "text")
    got = found.mapInArrow(rows, "quality int, row binary").toArrow()
    if not got.num_rows:
        return None
    y = got.column("quality").to_numpy()
    x = np.frombuffer(b"".join(got.column("row").to_pylist()), np.float32).reshape(len(y), TERMS)
    order = np.lexsort((*x.T[:8], y))
    return fit(x[order], y[order], tuple(counts.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)), latent)


def score_quality(docs: DataFrame, labels: DataFrame, neighbours: int = 31, temperature: float = 0.02, max_labelled: int = 2048) -> DataFrame:
    """docs with `score` (0 to 1, higher: quality 1 likelier) and `predicted`; learns from `labels` (doc_id, quality)."""
    model = train(docs, labels, max_labelled)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            text = batch.column(at)
            _, offsets = utf8_view(text)
            score = np.full(batch.num_rows, 0.5)
            if sent.value is not None:
                for a, b in (x for a, b in blocks(offsets, 1 << 20) for x in ((i, min(b, i + 512)) for i in range(a, b, 512))):
                    score[a:b] = vote(sent.value, term_rows(text.slice(a, b - a)), neighbours, temperature)
            score = np.clip(score, 0, 1)
            columns = [*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted"])

    plain = docs.drop("score", "predicted")
    names = plain.columns
    at = names.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(scored, f"{fields}, score double, predicted int")

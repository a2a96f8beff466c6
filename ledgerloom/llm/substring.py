"""Removal of repeated passages of words by difference-cover anchors.

A word goes when one of the 50-word windows that cover it also starts in a document with a smaller doc_id. Anchors are windows
of 20 words that begin at positions whose remainder modulo 31 lies in a perfect difference set: six remainders of which some
pair has each possible difference. Two equal windows of 50 words, wherever they start, therefore hold a common anchor whose
beginnings are cover positions in both documents (at most 30 words from the windows' starts, and 30 + 20 = 50). Only
anchors (19 % of the positions) are hashed and exchanged to find out which of them another place holds, too; around those alone
a match is extended: by every window of 50 words that holds the anchor, compared by 128-bit hashes.

Exchange is by blocks, as in suffix.py: chunks of documents send each bucket one compressed block of their distinct anchors,
then of their distinct extended windows with the least doc_id of each, and a bucket answers each chunk with a block of
bits. A passage in a third of all documents reaches its bucket once a chunk; nothing grows with a group of copies. At very
large sizes a block holds one key, never less, so the number of blocks stays below the number of anchors.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text, unchanged. Null and empty texts have no words. Rows that share a doc_id are one
document in no order: neither removes from the other. A null doc_id is not smaller or larger than any: such rows lose and
remove nothing. Windows never cross documents; documents of fewer than 50 words lose nothing. An empty table gives an empty
result. Other columns are not read. One document is held whole by a task.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import utf8_view, written
from ledgerloom.llm.suffix import by_bucket, key_answers, mixed

WINDOW, PERIOD = 50, 31
COVER = (1, 5, 11, 24, 25, 27)  # fixed values: a perfect difference set modulo 31
ANCHOR = WINDOW + 1 - PERIOD
LONG_WORD = 256  # bytes; longer words are few and hashed one by one
MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
BASE = [(b, pow(b, -1, 1 << 64)) for b in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Words:
    """The words of a chunk's documents: byte ranges, documents' first words, and words left in the document from each on."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("doc_id").to_numpy()
        self.data, self.offsets = data, offsets = utf8_view(rows.column("text"))
        inked = ~((data == 32) | ((data >= 9) & (data <= 13)))
        filled = np.diff(offsets) > 0
        begin, end = inked.copy(), inked.copy()
        begin[1:] &= ~inked[:-1]
        end[:-1] &= ~inked[1:]
        first, last = offsets[:-1][filled], offsets[1:][filled] - 1
        begin[first], end[last] = inked[first], inked[last]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.left = self.first[1:][self.row] - np.arange(len(self.row))

    def codes(self, which: int) -> np.ndarray:
        """A 64-bit hash of every word, by its bytes eight at a time; which: 0 or 1, two independent ones."""
        size = self.end - self.start
        filled = np.concatenate([self.data, np.zeros(16, np.uint8)])
        eight = np.ndarray(len(filled) - 8, "<u8", filled, strides=(1,))
        out = mixed((size.astype(np.uint64) + np.uint64(1)) * MUL[which])
        at = np.arange(len(size))
        for k in range(0, LONG_WORD, 8):
            at = at[(size[at] > k) & (size[at] <= LONG_WORD)]
            if not len(at):
                break
            part = np.minimum(size[at] - k, 8).astype(np.uint64)
            mask = ~np.uint64(0) >> (np.uint64(64) - part * np.uint64(8))
            out[at] = mixed((out[at] ^ (eight[self.start[at] + k] & mask)) * MUL[which] + MUL[1 - which])
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
        return out

    def rolling(self, which: int, width: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the `width` words from each place of `at` on."""
        base, inverse = (np.full(len(self.start) + 1, np.uint64(b)) for b in BASE[which])
        base[:1] = inverse[:1] = 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.codes(which) * np.cumprod(base)[:-1], dtype=np.uint64)])
        return mixed(mixed((total[at + width] - total[at]) * np.cumprod(inverse)[at]) * MUL[which])

    def anchors(self) -> np.ndarray:
        """Cover positions with an anchor, in documents that have a window."""
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        place = np.arange(len(self.row)) - self.first[:-1][self.row]
        return np.flatnonzero(cover[place % PERIOD] & (self.left >= ANCHOR) & (self.count[self.row] >= WINDOW))

    def extended(self, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the anchors `shared`."""
        edge = np.zeros(len(self.row) + 1, np.int32)
        np.add.at(edge, np.maximum(shared - (WINDOW - ANCHOR), self.first[:-1][self.row[shared]]), 1)
        np.add.at(edge, shared + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= WINDOW))


def cuts_of(to: np.ndarray):
    """(begin, end) of runs of equal values."""
    cuts = np.concatenate([np.flatnonzero(np.diff(to, prepend=-1)), [len(to)]])
    return zip(cuts[:-1], cuts[1:])


def anchor_blocks(key, rows: pa.Table, buckets: int, schema: pa.Schema) -> pa.Table:
    """A chunk's distinct anchors, one block a bucket."""
    words = Words(rows)
    keys, _, _, to = by_bucket(words.rolling(0, ANCHOR, words.anchors()), buckets)
    pack, out = zstandard.ZstdCompressor(level=1), {"bucket": [], "chunk": [], "block": []}
    for a, b in cuts_of(to):
        step = np.diff(keys[a:b].astype("<u4"), prepend=np.uint32(0))
        out["bucket"].append(int(to[a]))
        out["chunk"].append(key[0].as_py())
        out["block"].append(pack.compress(step.view(np.uint8).reshape(-1, 4).T.tobytes()))
    return pa.Table.from_pydict(out, schema=schema)


def candidates(rows: pa.Table, replies: pa.Table, buckets: int):
    """The words of a chunk, the starts of windows around shared anchors, and their distinct ones: which each is, its hashes,
    least doc_id and bucket, ordered by bucket and doc_id."""
    words = Words(rows)
    anchors = words.anchors()
    _, which, count, to = by_bucket(words.rolling(0, ANCHOR, anchors), buckets)
    shared = count > 1
    replies = replies.filter(pa.compute.equal(replies.column("kind"), 0))
    for bucket, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
        a, b = np.searchsorted(to, [bucket, bucket + 1])
        shared[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    starts = words.extended(anchors[shared[which]])
    low, high, doc = words.rolling(0, WINDOW, starts), words.rolling(1, WINDOW, starts), words.ids[words.row[starts]]
    order = np.lexsort((doc, high, low))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
    one = order[fresh]
    to = (low[one] % np.uint64(buckets)).astype(np.int64)
    sent = np.lexsort((doc[one], to))
    place = np.empty(len(one), np.int64)
    place[sent] = np.arange(len(one))
    of = np.empty(len(order), np.int64)
    of[order] = place[np.cumsum(fresh) - 1]
    one = one[sent]
    return words, starts, doc, of, low[one], high[one], doc[one], to[sent]


def window_blocks(rows: pa.Table, replies: pa.Table, buckets: int, schema: pa.Schema) -> pa.Table:
    """A chunk's distinct extended windows, one block a bucket."""
    _, _, _, _, low, high, least, to = candidates(rows, replies, buckets)
    pack, out = zstandard.ZstdCompressor(level=1), {"bucket": [], "chunk": [], "block": []}
    for a, b in cuts_of(to):
        out["bucket"].append(int(to[a]))
        out["chunk"].append(rows.column("chunk")[0].as_py())
        out["block"].append(pack.compress(b"".join(x[a:b].astype(kind).tobytes() for x, kind in ((low, "<u8"), (high, "<u8"), (least, "<i8")))))
    return pa.Table.from_pydict(out, schema=schema)


def window_answers(key, rows: pa.Table, schema: pa.Schema) -> pa.Table:
    """For each chunk a bit for every window it sent: a smaller doc_id of another chunk has it, too."""
    unpack = zstandard.ZstdDecompressor()
    sent = [np.frombuffer(unpack.decompress(x), "<u8").reshape(3, -1) for x in rows.column("block").to_pylist()]
    low, high, least = np.concatenate(sent, axis=1)
    least = least.view(np.int64)
    order = np.lexsort((least, high, low))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
    smaller = np.empty(len(order), bool)
    smaller[order] = least[order][fresh][np.cumsum(fresh) - 1] < least[order]
    ends = np.cumsum([x.shape[1] for x in sent])
    bits = [np.packbits(smaller[e - x.shape[1] : e]).tobytes() for e, x in zip(ends, sent)]
    return pa.Table.from_pydict({"chunk": rows.column("chunk").to_pylist(), "bucket": [int(key[0].as_py())] * len(bits), "kind": [1] * len(bits), "bits": bits}, schema=schema)


def removed(rows: pa.Table, replies: pa.Table, buckets: int, keep_text: bool, schema: pa.Schema) -> pa.Table:
    """A chunk's documents without their repeated words, from the buckets' answers."""
    words, starts, doc, of, _, _, least, to = candidates(rows, replies, buckets)
    hit = np.zeros(len(to), bool)
    replies = replies.filter(pa.compute.equal(replies.column("kind"), 1))
    for bucket, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
        a, b = np.searchsorted(to, [bucket, bucket + 1])
        hit[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    repeats = starts[hit[of] | (doc > least[of])]
    edge = np.zeros(len(words.row) + 1, np.int32)
    np.add.at(edge, repeats, 1)
    np.add.at(edge, repeats + WINDOW, -1)
    keep = np.cumsum(edge[:-1]) == 0
    out = {"doc_id": words.ids, "n_words": words.count, "n_removed": [], "kept": [] if keep_text else None, "kept_sha256": []}
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
        mine = keep[a:b]
        kept = b" ".join(compress(words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split(), mine))  # bytes split at the same six blanks
        out["n_removed"].append(int(b - a - mine.sum()))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        if keep_text:
            out["kept"].append(kept.decode("utf-8", "replace"))
    return pa.Table.from_pydict({k: v for k, v in out.items() if v is not None}, schema=schema)


def remove_passages(docs: DataFrame, keep_text: bool = True, chunk_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, the kept words joined by one space, and their sha256) of docs (doc_id, text)."""
    nameless, docs = docs.where("doc_id is null"), docs.where("doc_id is not null")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, total // chunk_bytes), max(1, total // bucket_bytes)
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text").repartition("chunk")
    send = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("block", pa.binary())])
    reply = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("bits", pa.binary())])
    final = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), *([("kept", pa.string())] if keep_text else []), ("kept_sha256", pa.string())])
    sent, replied = "bucket long, chunk long, block binary", "chunk long, bucket long, kind int, bits binary"
    by_chunk = rows.groupBy("chunk")
    keys = by_chunk.applyInArrow(lambda key, t: anchor_blocks(key, t, buckets, send), sent)
    keys = written(keys.groupBy("bucket").applyInArrow(lambda key, t: key_answers(key, t, reply), replied), "anchors")
    blocks = by_chunk.cogroup(keys.groupBy("chunk")).applyInArrow(lambda left, right: window_blocks(left, right, buckets, send), sent)
    bits = blocks.groupBy("bucket").applyInArrow(lambda key, t: window_answers(key, t, reply), replied).union(keys)
    fields = "doc_id long, n_words long, n_removed long, " + ("kept string, " if keep_text else "") + "kept_sha256 string"
    got = by_chunk.cogroup(bits.groupBy("chunk")).applyInArrow(lambda left, right: removed(left, right, buckets, keep_text, final), fields)
    text = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0), " ")
    count = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)).cast("long")
    whole = {"doc_id": F.lit(None).cast("long"), "n_words": count, "n_removed": F.lit(0).cast("long"), "kept": text, "kept_sha256": F.sha2(text, 256)}
    return got.unionByName(nameless.select(*(whole[c].alias(c) for c in got.columns)))

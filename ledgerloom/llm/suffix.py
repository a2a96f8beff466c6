"""Removal of repeated substrings by column-wise construction of a collection's suffix order.

A byte is removed when a 50-byte string that covers it also starts in a document with a smaller doc_id. Equal strings
have equal minimizers (the least hash of their 12-byte substrings, leftmost) at equal places, so each document is cut
into stretches of consecutive strings with one minimizer; a stretch goes to the bucket of that minimizer. Inside a
bucket the stretches, aligned at their minimizers, are a collection of short documents, and its suffix order is built
column by column from the right: each round inserts one symbol of every document in front of its suffix, which a stable
counting sort of the round's symbols in the order so far does (the symbols in that order are the round's column of
the collection's Burrows-Wheeler transform), and updates the common prefixes: a suffix shares with the one before it one symbol
more than the least common prefix between their places in the round before, if the symbols agree, else nothing. Strings
with a common prefix of 50 symbols are then neighbours, and the least doc_id of such a run decides.

Before that, chunks of documents and buckets of keys find out which stretches share their minimizer with 19 bytes before
or after it with any other stretch: strings of the other stretches occur once, and only the rest is sent and sorted.
The sequential external files are shuffle blocks: each chunk of documents sends a bucket one compressed block of its
distinct stretches (with the least doc_id of each), and a bucket answers a chunk with one block of bits. A passage that
a third of all documents holds thus reaches its bucket once a chunk, not once a document, and nothing grows with a group.

Null text is empty. Documents shorter than 50 bytes lose nothing. Rows with equal doc_id are one document in no order:
neither removes from the other. A null doc_id is not smaller or larger than any: such documents lose and remove nothing.
Matches never cross documents. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import utf8_view, written

WINDOW, GRAM = 50, 12
SPAN = WINDOW - GRAM  # a minimizer's distance from either end of a stretch's strings is at most this
SLICE = 1 << 17
SIDE = SPAN // 2  # a string holds its minimizer and this many bytes at least before it, or after it


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(27)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """40-bit hashes of the 12-byte substrings, in the high bits."""
    mul = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    two = data[:-1].astype(np.uint64) << np.uint64(8) | data[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    return (eight[:-4] * mul[0] + four[8:] * mul[1]) & ~np.uint64((1 << 24) - 1)  # multiply-shift: the high bits depend on all


def stretches(data: np.ndarray, offsets: np.ndarray):
    """Arrays (start, strings, lead, hash) of all stretches: first byte, number of strings, distance from the first
    string's start to the minimizer, and its hash. Slices of the text bound the memory."""
    out = []
    for lo in range(0, max(0, len(data) - WINDOW + 1), SLICE):
        hi = min(lo + SLICE, len(data) - WINDOW + 1)  # strings that start in [lo, hi)
        h = gram_hashes(data[lo : hi + WINDOW - 1])
        least = h | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: hi - lo], least[SPAN + 1 - width :][: hi - lo])
        new = np.ones(hi - lo, bool)
        new[1:] = least[1:] != least[:-1]
        fine = np.ones(hi - lo + 1, bool)  # strings inside one document
        a, b = np.searchsorted(offsets, [lo + 1, hi + WINDOW - 1])
        for k in offsets[a:b] - lo:
            fine[max(0, k - WINDOW + 1) : min(k, hi - lo)] = False
            if 0 < k < hi - lo:
                new[k] = True
        start = np.flatnonzero((new | np.concatenate([[True], ~fine[:-2]])) & fine[:-1])
        stop = np.flatnonzero((np.concatenate([new[1:], [True]]) | ~fine[1:]) & fine[:-1]) + 1
        place = (least[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
        out.append((start + lo, stop - start, place - start, least[start] >> np.uint64(24)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, zeros beyond the end, without copying eight times."""
    filled = np.concatenate([data, np.zeros(WINDOW + SPAN + 16, np.uint8)])
    return np.ndarray(len(filled) - 8, "<u8", filled, strides=(1,))


def pieces(words: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Byte strings as columns of eight bytes each, zero filled."""
    for k in range(0, WINDOW + SPAN, 8):
        left = np.clip(size - k, 0, 8).astype(np.uint64)
        mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (np.minimum(left, 7) * np.uint64(8))) - np.uint64(1))
        yield words[start + k] & mask


def distinct(data: np.ndarray, found: list, doc: np.ndarray, draws: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(representatives, number of the representative of each stretch, least doc of each representative): stretches of
    equal bytes and lead are one. They are told apart by a hash, which is checked byte by byte and drawn anew if it fails,
    and after `draws` of them by sorting the bytes."""
    start, strings, lead, _ = found
    size, words = strings + WINDOW - 1, words_at(data)
    shape = lead.astype(np.uint64) * np.uint64(128) + strings.astype(np.uint64)
    for seed in range(1, draws + 1):
        code = mixed((shape + np.uint64(seed << 32)) * np.uint64(0xC2B2AE3D27D4EB4F))  # so that no bytes can undo a shape
        for piece in pieces(words, start, size):
            code = mixed((code ^ piece) * np.uint64(0x9E3779B97F4A7C15))
        _, one, which = np.unique(code, return_index=True, return_inverse=True)
        copy = np.flatnonzero(one[which] != np.arange(len(which)))
        other = one[which[copy]]
        if (shape[copy] == shape[other]).all() and all((x == y).all() for x, y in zip(pieces(words, start[copy], size[copy]), pieces(words, start[other], size[other]))):
            break
    else:  # sorted by the bytes themselves
        columns = [shape, *pieces(words, start, size)]
        order = np.lexsort(columns[::-1])
        fresh = np.any([np.diff(c[order], prepend=~c[order[:1]]) != 0 for c in columns], axis=0)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(fresh) - 1
        one = order[fresh]
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    return one, which, least


def chunk_view(rows: pa.Table):
    """(doc_ids, row order, bytes, offsets) of a chunk's documents by ascending doc_id."""
    ids = rows.column("doc_id").to_numpy()
    data, offsets = utf8_view(rows.column("text"))
    size = np.diff(offsets)
    order = np.lexsort((size, ids))
    at = np.concatenate([[0], np.cumsum(size[order])])
    out = np.empty(len(data), np.uint8)
    for to, i in enumerate(order):
        out[at[to] : at[to + 1]] = data[offsets[i] : offsets[i + 1]]
    return ids[order], out, at


def side_keys(data: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit keys, stretch of each): the minimizer with SIDE bytes before it, and with SIDE bytes after it, where a
    stretch has them. Two stretches that share a string share one of these, so a stretch without a shared key is done."""
    start, strings, lead, _ = found
    words, out, whose = words_at(data), [], []
    for side, at in ((1, np.flatnonzero(lead >= SIDE)), (2, np.flatnonzero(strings + WINDOW - 1 - lead >= GRAM + SIDE))):
        first = start[at] + lead[at] - (SIDE if side == 1 else 0)
        code = np.full(len(at), side, np.uint64)
        for k in (0, 8, 16, GRAM + SIDE - 8):
            code = mixed((code ^ words[first + k]) * np.uint64(0x9E3779B97F4A7C15))
        out.append(code * np.uint64(0xC2B2AE3D27D4EB4F))
        whose.append(at)
    return np.concatenate(out), np.concatenate(whose)


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys by bucket, inverse, count of each, buckets of the distinct ones)."""
    to = keys % np.uint64(buckets) << np.uint64(32) | keys >> np.uint64(32)
    to, which, count = np.unique(to, return_inverse=True, return_counts=True)
    return to & np.uint64(0xFFFFFFFF), which, count, (to >> np.uint64(32)).astype(np.int64)


def chunk_stretches(rows: pa.Table):
    ids, data, offsets = chunk_view(rows)
    found = stretches(data, offsets)
    return ids, data, offsets, found


def key_blocks(key, rows: pa.Table, buckets: int, schema: pa.Schema) -> pa.Table:
    """A chunk's distinct side keys, one block a bucket."""
    _, data, _, found = chunk_stretches(rows)
    keys, _, _, to = by_bucket(side_keys(data, found)[0], buckets)
    cuts = np.concatenate([np.flatnonzero(np.diff(to, prepend=-1)), [len(to)]])
    pack = zstandard.ZstdCompressor(level=1)
    blocks = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        step = np.diff(keys[a:b].astype("<u4"), prepend=np.uint32(0))
        blocks.append(pack.compress(step.view(np.uint8).reshape(-1, 4).T.tobytes()))
    n = len(blocks)
    return pa.Table.from_pydict({"bucket": to[cuts[:-1]].tolist() if n else [], "chunk": [int(key[0].as_py())] * n, "block": blocks}, schema=schema)


def key_answers(key, rows: pa.Table, schema: pa.Schema) -> pa.Table:
    """For each chunk a bit for every key it sent: another chunk sent it, too."""
    unpack = zstandard.ZstdDecompressor()
    sent = []
    for block in rows.column("block").to_pylist():
        planes = np.frombuffer(unpack.decompress(block), np.uint8).reshape(4, -1)
        sent.append(np.cumsum(np.ascontiguousarray(planes.T).view("<u4")[:, 0], dtype=np.uint32))
    _, which, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    shared = count[which] > 1
    ends = np.cumsum([len(x) for x in sent])
    bits = [np.packbits(shared[e - len(x) : e]).tobytes() for e, x in zip(ends, sent)]
    return pa.Table.from_pydict({"chunk": rows.column("chunk").to_pylist(), "bucket": [int(key[0].as_py())] * len(bits), "kind": [0] * len(bits), "bits": bits}, schema=schema)


def surviving(rows: pa.Table, replies: pa.Table, buckets: int):
    """The chunk's stretches that share a side key with another one, and their distinct ones by bucket."""
    ids, data, offsets, found = chunk_stretches(rows)
    keys, whose = side_keys(data, found)
    _, which, count, to = by_bucket(keys, buckets)
    shared = count > 1
    replies = replies.filter(pa.compute.equal(replies.column("kind"), 0))
    for bucket, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
        a, b = np.searchsorted(to, [bucket, bucket + 1])
        shared[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    keep = np.zeros(len(found[0]), bool)
    keep[whose[shared[which]]] = True
    found = [x[keep] for x in found]
    doc = ids[np.searchsorted(offsets, found[0], "right") - 1] if len(ids) else np.zeros(0, np.int64)
    one, which, least = distinct(data, found, doc)
    to = (found[3][one] % np.uint64(buckets)).astype(np.int64)
    return ids, data, offsets, found, doc, one, which, least, to, np.argsort(to, kind="stable")


def sent_blocks(rows: pa.Table, replies: pa.Table, buckets: int, schema: pa.Schema) -> pa.Table:
    """A chunk's distinct stretches, one compressed block a bucket."""
    _, data, _, (start, strings, lead, _), _, one, _, least, to, order = surviving(rows, replies, buckets)
    one, least, to = one[order], least[order], to[order]
    out = {"bucket": [], "chunk": [], "block": []}
    cuts = np.concatenate([np.flatnonzero(np.diff(to, prepend=-1)), [len(to)]])
    pack = zstandard.ZstdCompressor(level=1)
    for a, b in zip(cuts[:-1], cuts[1:]):
        mine = one[a:b]
        size = strings[mine] + WINDOW - 1
        index = np.repeat(start[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        head = np.array([b - a], "<i8").tobytes() + strings[mine].astype(np.uint8).tobytes() + lead[mine].astype(np.uint8).tobytes() + least[a:b].astype("<i8").tobytes()
        out["bucket"].append(int(to[a]))
        out["chunk"].append(rows.column("chunk")[0].as_py())
        out["block"].append(pack.compress(head + data[index].tobytes()))
    return pa.Table.from_pydict(out, schema=schema)


def columns_round(common: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inserts one symbol in front of every suffix. column: the symbols in suffix order, the round's part of the
    transform; common: common prefix of each suffix with the one before it. Returns the places in the new order and the
    new common prefixes."""
    by = np.argsort(column, kind="stable")
    levels = [common]
    width = 1
    while width * 2 <= len(common):
        levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
        width *= 2
    same = np.flatnonzero(column[by[1:]] == column[by[:-1]])
    lo, hi = by[same] + 1, by[same + 1]  # least common prefix over the places lo..hi of the round before
    level = np.frexp((hi - lo + 1).astype(np.float32))[1] - 1
    least = np.empty(len(lo), np.uint8)
    for k in range(len(levels)):
        at = np.flatnonzero(level == k)
        if len(at):
            least[at] = np.minimum(levels[k][lo[at]], levels[k][hi[at] - (1 << k) + 1])
    fresh = np.zeros(len(common), np.uint8)
    fresh[same + 1] = np.minimum(least, 254) + 1
    return by, fresh


def without(order: np.ndarray, common: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order without some documents: a common prefix is the least over the gap."""
    at = np.flatnonzero(keep)
    if not len(at):
        return order[:0], common[:0]
    begins = np.concatenate([[0], at[:-1] + 1])
    return order[at], np.minimum.reduceat(common[: at[-1] + 1], begins)


def repeated(text: np.ndarray, at: np.ndarray, strings: np.ndarray, lead: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bits [document, string]: a string of a stretch also occurs for a smaller doc. text holds the stretches' bytes,
    each from `at` on. String i of a stretch starts lead - i bytes before the minimizer."""
    n = len(at)
    out = np.zeros((n, SPAN + 1), bool)
    end = strings + WINDOW - 1
    order, common = np.arange(n), np.zeros(n, np.uint8)
    top, last = np.iinfo(np.int64).max, max(0, len(text) - 1)
    for place in range(WINDOW - 1, -SPAN - 1, -1):  # distance from the minimizer's start
        if place < 0:
            # a common prefix grows by one a round: documents that cannot reach the length before their first string go
            most = common.copy()
            most[:-1] = np.maximum(most[:-1], common[1:])
            keep = most.astype(np.int64) + (lead + place + 1)[order] >= WINDOW
            if not keep.all():
                order, common = without(order, common, keep)
            if not len(order):
                break
        where = (lead + place)[order]
        column = np.where((where >= 0) & (where < end[order]), text[np.minimum(at[order] + np.maximum(where, 0), last)], 0).astype(np.uint8)
        by, common = columns_round(common, column)
        order, where = order[by], where[by]
        if place <= 0:
            run = np.flatnonzero(np.concatenate([[True], common[1:] < WINDOW]))
            if len(run) == len(order):
                continue
            mine = np.where((where >= 0) & (where < strings[order]), doc[order], top)
            least = np.repeat(np.minimum.reduceat(mine, run), np.diff(np.append(run, len(order))))
            hit = (least < mine) & (mine < top)
            out[order[hit], where[hit]] = True
    return out


def answers(key, rows: pa.Table, batch: int, schema: pa.Schema) -> pa.Table:
    """A bucket's answer to each chunk: a bit for every string of the stretches it sent, in their order."""
    unpack = zstandard.ZstdDecompressor()
    strings, lead, doc, text, counts = [], [], [], [], []
    for block in rows.column("block").to_pylist():
        raw = unpack.decompress(block)
        n = int.from_bytes(raw[:8], "little")
        counts.append(n)
        strings.append(np.frombuffer(raw, np.uint8, n, 8))
        lead.append(np.frombuffer(raw, np.uint8, n, 8 + n))
        doc.append(np.frombuffer(raw, "<i8", n, 8 + 2 * n))
        text.append(np.frombuffer(raw, np.uint8, -1, 8 + 10 * n))
    strings, lead, doc, text = np.concatenate(strings).astype(np.int64), np.concatenate(lead).astype(np.int64), np.concatenate(doc), np.concatenate(text)
    size = strings + WINDOW - 1
    at = np.cumsum(size) - size
    words = words_at(text)
    code = mixed(mixed(words[at + lead] * np.uint64(0x9E3779B97F4A7C15)) ^ words[at + lead + GRAM - 8])
    groups = max(1, len(at) // batch)
    group = (code % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(groups + 1))
    bits = np.zeros((len(at), SPAN + 1), bool)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            mine = order[a:b]
            bits[mine] = repeated(text, at[mine], strings[mine], lead[mine], doc[mine])
    packed = np.packbits(bits, axis=1)
    ends = np.cumsum(counts)
    pack = zstandard.ZstdCompressor(level=1)
    blocks = [pack.compress(packed[e - n : e].tobytes()) for e, n in zip(ends, counts)]
    return pa.Table.from_pydict({"chunk": rows.column("chunk").to_pylist(), "bucket": [int(key[0].as_py())] * len(counts), "kind": [1] * len(counts), "bits": blocks}, schema=schema)


def removed(left: pa.Table, right: pa.Table, buckets: int, keep_text: bool, schema: pa.Schema) -> pa.Table:
    """A chunk's documents without their repeated bytes, from the buckets' answers."""
    ids, data, offsets, (start, strings, _, _), doc, one, which, least, to, order = surviving(left, right, buckets)
    bits = np.zeros((len(one), SPAN + 1), bool)
    unpack = zstandard.ZstdDecompressor()
    right = right.filter(pa.compute.equal(right.column("kind"), 1))
    for bucket, block in zip(right.column("bucket").to_pylist(), right.column("bits").to_pylist()):
        a, b = np.searchsorted(to[order], [bucket, bucket + 1])
        got = np.frombuffer(unpack.decompress(block), np.uint8).reshape(b - a, -1)
        bits[order[a:b]] = np.unpackbits(got, axis=1, count=SPAN + 1).astype(bool)
    hit = bits[which] | (doc > least[which])[:, None]
    hit &= np.arange(SPAN + 1) < strings[:, None]
    row, i = np.nonzero(hit)
    cover = np.zeros(len(data) + 1, np.int32)
    first = start[row] + i
    np.add.at(cover, first, 1)
    np.add.at(cover, np.minimum(first + WINDOW, len(data)), -1)
    gone = np.cumsum(cover[:-1]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    begins[inner] = gone[inner]
    out = {"doc_id": ids, "n_bytes": np.diff(offsets), "n_removed": [], "n_spans": [], "kept": [] if keep_text else None, "kept_sha256": [], "text_sha256": [] if "text_sha256" in schema.names else None}
    for a, b in zip(offsets[:-1], offsets[1:]):
        kept = data[a:b][~gone[a:b]].tobytes()
        out["n_removed"].append(b - a - len(kept))
        out["n_spans"].append(int(begins[a:b].sum()))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        if out["text_sha256"] is not None:
            out["text_sha256"].append(hashlib.sha256(data[a:b].tobytes()).hexdigest())
        if keep_text:
            out["kept"].append(kept.decode("utf-8", "ignore"))
    return pa.Table.from_pydict({k: v for k, v in out.items() if v is not None}, schema=schema)


def remove_repeats(docs: DataFrame, keep_text: bool = True, chunk_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20, batch: int = 1 << 15, text_hash: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the remaining text `kept` and the text_sha256 of the
    whole text, which tells rows of one doc_id apart) of docs (doc_id, text).

    Remaining bytes that are no whole UTF-8 character (a removed run can end inside one) count in kept_sha256 but not in `kept`.
    """
    nameless, docs = docs.where("doc_id is null"), docs.where("doc_id is not null")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, total // chunk_bytes), max(1, total // bucket_bytes)
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text").repartition("chunk")
    send = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("block", pa.binary())])
    reply = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("bits", pa.binary())])
    final = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), *([("kept", pa.string())] if keep_text else []), ("kept_sha256", pa.string()), *([("text_sha256", pa.string())] if text_hash else [])])
    sent, replied = "bucket long, chunk long, block binary", "chunk long, bucket long, kind int, bits binary"
    by_chunk = rows.groupBy("chunk")
    keys = by_chunk.applyInArrow(lambda key, t: key_blocks(key, t, buckets, send), sent)
    keys = written(keys.groupBy("bucket").applyInArrow(lambda key, t: key_answers(key, t, reply), replied), "keys")
    blocks = by_chunk.cogroup(keys.groupBy("chunk")).applyInArrow(lambda left, right: sent_blocks(left, right, buckets, send), sent)
    bits = blocks.groupBy("bucket").applyInArrow(lambda key, t: answers(key, t, batch, reply), replied).union(keys)
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept string, " if keep_text else "") + "kept_sha256 string" + (", text_sha256 string" if text_hash else "")
    got = by_chunk.cogroup(bits.groupBy("chunk")).applyInArrow(lambda left, right: removed(left, right, buckets, keep_text, final), fields)
    text = F.coalesce("text", F.lit(""))
    whole = {"doc_id": F.lit(None).cast("long"), "n_bytes": F.octet_length(text).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept": text, "kept_sha256": F.sha2(text, 256), "text_sha256": F.sha2(text, 256)}
    return got.unionByName(nameless.select(*(whole[c].alias(c) for c in got.columns)))

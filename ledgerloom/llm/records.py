"""Token-id output as length-delimited binary records, with a separate offset index for shuffled reads.

A record file is a sequence of frames: payload length (unsigned 64 bit, little endian), masked CRC-32C of those eight
bytes, payload, masked CRC-32C of the payload. A payload is the document id (signed 64 bit) and its token ids, two bytes
each while the vocabulary is below 65,536, else four. Beside `x.rec` lies `x.idx`: a header (magic, bytes of an id,
number of records) and for each record (doc_id, offset of its frame, number of ids), so that a reader can fetch
any record or any permutation of them with one seek each.

Files are in ascending order of doc_id: range partitions, sorted, one file a partition. Each task attempt writes files
with a name of its own and reports them in a manifest row, so a lost executor or a speculative attempt leaves at most
an orphan that no manifest names. Paths go through the Arrow file system of the URI: local, HDFS or object store.

Texts are encoded whole by the tokenizers library. Only where the tokenizer's own file proves that it cuts at every blank
(`cuts_at_blanks`) are words encoded once and remembered.

Null text is empty: only the end id. Repeated doc_ids stay as records of their own, next to each other. A null doc_id
comes first, is stored as the least long and read as null (a doc_id of that value is refused). An empty table gives an
empty manifest. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ledgerloom.llm.common import blocks, shared_dir, utf8_view, written

MASK_DELTA, MAGIC, BLOCK = 0xA282EAD8, 0x314C5452, 64  # the mask constant of the public record format
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("n_ids", "<i8")])
MANIFEST = "part int, path string, width int, n_records long, n_ids long"


def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """(slicing tables [8, 256], advance tables [40, 4, 256]: a CRC moved over 2**k zero bytes)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0x82F63B78), one >> 1)
    slices = [one]
    for _ in range(7):
        slices.append(slices[-1] >> 8 ^ one[slices[-1] & 255])
    step = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    step = step >> 8 ^ one[step & 255]
    moves = [step]
    for _ in range(39):
        moves.append(advance(moves[-1], moves[-1]))
    return np.stack(slices), np.stack(moves)


def advance(crc: np.ndarray, move: np.ndarray) -> np.ndarray:
    return move[0][crc & 255] ^ move[1][crc >> 8 & 255] ^ move[2][crc >> 16 & 255] ^ move[3][crc >> 24]


def crc32c(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of many byte ranges at once. Each range, filled with zeros in front to whole blocks, is cut into blocks;
    block checksums are folded in pairs, which vectorises over ranges of any lengths."""
    slices, moves = crc_tables()
    n = -(-sizes // BLOCK)
    first = np.cumsum(n) - n
    grid = np.zeros(int(n.sum()) * BLOCK, np.uint8)
    to = first * BLOCK + n * BLOCK - sizes
    index = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grid[np.repeat(to, sizes) + index] = data[np.repeat(starts, sizes) + index]
    words = grid.view("<u4").reshape(-1, BLOCK // 4)
    crc = np.zeros(len(words), np.uint32)
    for k in range(0, BLOCK // 4, 2):
        a, b = words[:, k] ^ crc, words[:, k + 1]
        crc = slices[7][a & 255] ^ slices[6][a >> 8 & 255] ^ slices[5][a >> 16 & 255] ^ slices[4][a >> 24]
        crc ^= slices[3][b & 255] ^ slices[2][b >> 8 & 255] ^ slices[1][b >> 16 & 255] ^ slices[0][b >> 24]
    level = BLOCK.bit_length() - 1
    while len(n) and n.max() > 1:
        half = -(-n // 2)
        top = np.cumsum(half) - half
        j = np.arange(int(half.sum())) - np.repeat(top, half)
        right = np.repeat(first, half) + 2 * j + 1 - np.repeat(n % 2, half)
        left = np.where((j == 0) & np.repeat(n % 2 == 1, half), 0, crc[np.maximum(right - 1, 0)]).astype(np.uint32)
        crc = advance(left, moves[level]) ^ crc[right]
        n, first, level = half, top, level + 1
    out = np.zeros(len(sizes), np.uint32)
    out[n > 0] = crc[first[n > 0]]
    init = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for k in range(40):
        if not (sizes >> k).any():
            break
        init = np.where(sizes >> k & 1, advance(init, moves[k]), init)
    return out ^ init ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15 | crc << np.uint32(17)) + np.uint32(MASK_DELTA)).astype(np.uint32)


def frames(doc_ids: np.ndarray, ids: list[bytes]) -> tuple[bytes, np.ndarray]:
    """(frames of the records, frame sizes)."""
    payloads = [int(d).to_bytes(8, "little", signed=True) + x for d, x in zip(doc_ids, ids)]
    sizes = np.array([len(p) for p in payloads], np.int64)
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    sums = masked(crc32c(joined, np.cumsum(sizes) - sizes, sizes)).astype("<u4")
    heads = sizes.astype("<u8").view(np.uint8)
    head_sums = masked(crc32c(heads, np.arange(len(sizes)) * 8, np.full(len(sizes), 8))).astype("<u4")
    out = []
    for p, size, h, s in zip(payloads, sizes.astype("<u8"), head_sums, sums):
        out += [size.tobytes(), h.tobytes(), p, s.tobytes()]
    return b"".join(out), sizes + 16


def parsed(data: bytes, width: int) -> tuple[np.ndarray, list[np.ndarray], int]:
    """(doc_ids, id arrays, bytes used) of the whole frames at the front of data; a wrong checksum is an error."""
    at, starts, sizes = 0, [], []
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        if at + size + 16 > len(data):
            break
        starts.append(at)
        sizes.append(size)
        at += size + 16
    view = np.frombuffer(data, np.uint8)
    starts, sizes = np.array(starts, np.int64), np.array(sizes, np.int64)
    word = lambda p: np.array([int.from_bytes(data[x : x + 4], "little") for x in p], np.uint32)
    if len(starts) and ((masked(crc32c(view, starts, np.full(len(starts), 8))) != word(starts + 8)).any() or (masked(crc32c(view, starts + 12, sizes)) != word(starts + 12 + sizes)).any()):
        raise ValueError("a record's checksum is wrong")
    ids = [np.frombuffer(data, f"<u{width}", (n - 8) // width, s + 20) for s, n in zip(starts, sizes)]
    return np.array([int.from_bytes(data[s + 12 : s + 20], "little", signed=True) for s in starts], np.int64), ids, at


#: fixed value: the words of a tokenizer that is known to cut at blanks, between letters and marks, and at each digit
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NO_ID = -(1 << 63)


def cuts_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer's file says that a text's ids are those of its words in turn: white space is dropped, no word
    holds any, and nothing else looks across words. Anything not known here is taken for no."""
    steps = spec.get("normalizer") or {}
    plain = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    cut = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    parts = [{k: v for k, v in x.items() if k != "trim_offsets"} for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    model = spec.get("model") or {}
    return (
        steps.get("normalizers") == plain
        and parts == [cut, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
        and not (spec.get("truncation") or spec.get("padding") or model.get("dropout"))
        and model.get("type") == "BPE"
        and not any(set(t["content"]) & set(" \n\t") or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    )


def id_width(path: str, end_id: int) -> int:
    """Bytes of an id: two while all ids fit, else four."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 and end_id < 1 << 16 else 4


#: fixed values: marks that such a tokenizer always cuts from a letter beside them (an apostrophe is none of them)
MARKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?*%$&#", np.uint8))
LETTERS = np.isin(np.arange(256) | 32, np.arange(ord("a"), ord("z") + 1)) & (np.arange(256) < 128)
SAME = np.where(np.arange(256) == 10, 32, np.arange(256)).astype(np.uint8)
LOWER = np.where(LETTERS, np.arange(256) | 32, SAME).astype(np.uint8)


def cut_words(column) -> tuple[pa.Array, np.ndarray]:
    """(words with the blank after them, offsets of the rows in the words) of an Arrow string column: cut after blanks and
    line ends and between letters and MARKS. ASCII letters are lower-cased, as the tokenizer does, but for batches in which
    that could make the name of a special token."""
    data, offsets = utf8_view(column)
    letter, mark = LETTERS[data], MARKS[data]
    joint = np.zeros(len(data) + 1, bool)  # a blank goes before these bytes
    joint[1:-1] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    joint[offsets] = True  # ... and after each text, so that its last word looks like any
    joint[0] = False
    moved = np.arange(len(data)) + np.cumsum(joint[:-1])
    out = np.full(len(data) + int(joint.sum()), 32, np.uint8)
    out[moved] = (SAME if b"<|" in data.tobytes() else LOWER)[data]
    begins = np.ones(len(out) + 1, bool)
    begins[1:] = out == 32
    starts = np.flatnonzero(begins)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(out)])
    return words, np.searchsorted(starts, offsets + np.cumsum(joint)[offsets])


def encoder(path: str, width: int, most: int = 1_000_000):
    """Function from an Arrow string column to (ids of all rows in one array, offsets of the rows). Where the tokenizer cuts
    at blanks (it drops white space, and no pre-token holds any), so do we; Arrow numbers the
    different words of a batch. Words are encoded once and remembered while the worker process lives, up to `most`; then
    the memory starts anew. Other tokenizers get the texts whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    state = sys.modules.setdefault("ledgerloom_worker_state", types.ModuleType("ledgerloom_worker_state")).__dict__
    if (path, width) not in state:
        with open(path, encoding="utf-8") as f:
            state[path, width] = Tokenizer.from_file(path), {}, cuts_at_blanks(json.load(f))
    tokenizer, words, by_word = state[path, width]

    def whole(column) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in tokenizer.encode_batch_fast(column.fill_null("").to_pylist(), add_special_tokens=False)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)])
        return np.fromiter((i for x in got for i in x), f"<u{width}", int(at[-1])), at

    if not by_word:
        return whole

    def encoded(column) -> tuple[np.ndarray, np.ndarray]:
        cut, rows = cut_words(column)
        numbered = cut.dictionary_encode()
        word, seen = numbered.indices.to_numpy(), numbered.dictionary.cast(pa.large_string()).to_pylist()
        fresh = [w for w in seen if w not in words]
        if len(words) + len(fresh) > most:
            words.clear()
            fresh = seen
        for a in range(0, len(fresh), 20_000):
            for w, e in zip(fresh[a : a + 20_000], tokenizer.encode_batch_fast(fresh[a : a + 20_000], add_special_tokens=False)):
                words[w] = np.array(e.ids, f"<u{width}").tobytes()
        codes = [words[w] for w in seen]
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // width
        table = np.frombuffer(b"".join(codes), f"<u{width}")
        at = np.concatenate([[0], np.cumsum(size[word])])
        index = np.repeat((np.cumsum(size) - size)[word] - at[:-1], size[word]) + np.arange(at[-1])
        return table[index], at[rows]

    return encoded


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 1, width: int | None = None, parts: int | None = None) -> DataFrame:
    """Writes all texts of docs (doc_id, text) as record files and returns the manifest, one row a file, in order."""
    to = shared_dir(docs.sparkSession, "records")
    width = width or id_width(tokenizer, end_id)
    end = np.array([end_id], f"<u{width}").tobytes()

    def store(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(to)
        system.create_dir(base, recursive=True)
        part, encoded = TaskContext.get().partitionId(), encoder(tokenizer, width)
        name = f"{base}/ids-{part:06d}-{uuid.uuid4().hex}"
        index, at, n_ids = [], 0, 0
        with system.open_output_stream(f"{name}.rec") as out:
            for batch in batches:
                for a, b in blocks(utf8_view(batch.column(1))[1], 8 << 20):
                    rows = batch.slice(a, b - a)
                    doc_ids = rows.column(0)
                    if pc.any(pc.equal(doc_ids, NO_ID)).as_py():
                        raise ValueError("the least long stands for a null doc_id")
                    doc_ids = doc_ids.fill_null(NO_ID).to_numpy()
                    flat, at_row = encoded(rows.column(1))
                    ids = [flat[x:y].tobytes() + end for x, y in zip(at_row[:-1], at_row[1:])]
                    data, sizes = frames(doc_ids, ids)
                    out.write(data)
                    index.append(np.zeros(len(ids), INDEX))
                    index[-1]["doc_id"], index[-1]["offset"], index[-1]["n_ids"] = doc_ids, at + np.cumsum(sizes) - sizes, (sizes - 24) // width
                    at, n_ids = at + len(data), n_ids + int(index[-1]["n_ids"].sum())
        index = np.concatenate(index) if index else np.zeros(0, INDEX)
        with system.open_output_stream(f"{name}.idx") as out:
            out.write(np.array([MAGIC, width, len(index)], "<u8").tobytes() + index.tobytes())
        if len(index):
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{name}.rec", "width": width, "n_records": len(index), "n_ids": n_ids}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_records", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(parts, "doc_id") if parts else rows.repartitionByRange("doc_id")
    manifest = rows.sortWithinPartitions("doc_id", "text").mapInArrow(store, MANIFEST)
    scheme = to.split(":", 1)[0] + "://" if "://" in to else ""
    return written(manifest.withColumn("path", F.concat(F.lit(scheme), "path")), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the manifest's files, which are streamed in pieces.

    start: ids of all records before it; ids_crc32: of the ids as little-endian unsigned 32-bit integers.
    """
    # the manifest has one row a file; only its running sum needs an order
    start = F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    def load(batches):
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(row["path"])
                rest, at, seen = b"", row["start"], 0
                with system.open_input_stream(path) as f:
                    while piece := f.read(8 << 20):
                        doc_ids, ids, used = parsed(rest + piece, row["width"])
                        rest = (rest + piece)[used:]
                        n = np.array([len(x) for x in ids], np.int64)
                        crc = np.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], np.int64)
                        seen += len(n)
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(at + np.cumsum(n) - n), pa.array(n), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        at += int(n.sum())
                if rest or seen != row["n_records"]:
                    raise ValueError(f"{path} is cut short")

    rows = manifest.withColumn("start", start).repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "part")
    return rows.select("path", "width", "n_records", "start").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(path: str, rows: list[int]) -> list[tuple[int, np.ndarray]]:
    """Records of one file by row number, in any order, through its index: a seek for each."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(path)
    with system.open_input_file(path.removesuffix(".rec") + ".idx") as f:
        _, width, n = (int(x) for x in np.frombuffer(f.read(24), "<u8"))
        index = np.frombuffer(f.read(n * INDEX.itemsize), INDEX)
    out = []
    with system.open_input_file(path) as f:
        for r in rows:
            f.seek(int(index[r]["offset"]))
            doc_ids, ids, _ = parsed(f.read(int(index[r]["n_ids"]) * width + 24), width)
            out.append((int(doc_ids[0]), ids[0]))
    return out

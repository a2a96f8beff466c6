"""Language identification by prediction by partial matching.

Training counts every (three-byte context, byte) of the lower-cased UTF-8 text of each language over all training
rows. Each language gets one variable-order byte context tree of order 3, 2, 1, 0 and -1 with method-C escapes: in a
context seen n times with d distinct next bytes, byte b costs -log2(count / (n + d)), and a byte not seen there costs
the escape, -log2(d / (n + d)), plus its cost one order lower; a context never seen passes on for free; order -1 is
uniform over 256 bytes. The begin of a text is part of the contexts of its first three bytes. The statistics are frozen, so the costs of every (context, byte) that some language has seen are
laid out once, one row of all languages each, and broadcast; a byte not seen in a context costs that context's row of
escapes and is looked up one order lower. A text's exact code length under a language is the sum, and the shortest code
wins. Ties go to the language first by name.

Nothing is pruned: all contexts and bytes of all languages count. The driver holds one row for each (language, four
bytes) that occurs; the broadcast holds 4 bytes for each language and each (context, byte) that occurs, and for each
context its escapes, a bit for each byte and where its costs begin.

Null text, or text without a letter: `und`, score 0. Without training rows everything is `und`. Rows with null
language teach nothing. Repeated rows count as often as they occur. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import blocks, utf8_view

SYMBOLS, START = 128, 255
ONE = np.uint64(1)


def begun(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the texts' bytes with three bytes START, which UTF-8 never has, before each; places of the texts' own bytes)."""
    at = np.arange(len(data)) + 3 * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    out = np.full(len(data) + 3 * (len(offsets) - 1), START, np.uint8)
    out[at] = data
    return out, at


def gram_counts(batches):
    """(lang, text) batches -> (lang, gram, n): gram packs four bytes, the last one lowest; the first bytes of a text
    follow START."""
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            text = pc.utf8_lower(batch.column("text").filter(pc.equal(batch.column("lang"), lang)))
            data, offsets = utf8_view(text)
            for a, b in blocks(offsets, 4 << 20):
                if offsets[a] == offsets[b]:
                    continue
                x, at = begun(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                x = x.astype(np.uint32)
                gram, n = np.unique(x[at - 3] << 24 | x[at - 2] << 16 | x[at - 1] << 8 | x[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def train(docs: DataFrame) -> dict | None:
    """Model from (lang, text) rows; counts are summed on Spark."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    names = counts.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    place = np.array([langs.index(x) for x in names.dictionary.to_pylist()])
    return trees(langs, place[names.indices.to_numpy()], counts.column("gram").to_numpy(), counts.column("n").to_numpy())


def trees(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> dict:
    """Context trees of all languages from counts n of (lang, gram). Contexts are numbered by order, 0 is the empty one:
    `pick` maps three symbols to the longest context seen, `lower` a context to its suffix, `escape` [context, language]
    has the cost of going there, `bits` [context, word] the symbols seen in it, `first` the cell of each word's first
    symbol and `cost` [cell, language] the costs."""
    wide = len(langs)
    known = np.zeros(256, bool)
    for k in range(4):
        known[gram >> 8 * k & 255] = True
    width = int(known.sum()) + 1  # the last symbol stands for each byte that was never seen
    symbol = np.where(known, np.cumsum(known) - 1, width - 1).astype(np.int32)
    key = np.zeros(len(gram), np.int64)
    for k in range(3, -1, -1):
        key = key * width + symbol[gram >> 8 * k & 255]

    def summed(at: np.ndarray, size: int, weights=None) -> np.ndarray:
        return np.bincount(at, weights, size * wide).reshape(size, wide)

    def coded(count, total, distinct, lower):
        with np.errstate(divide="ignore", invalid="ignore"):
            own, escape = -np.log2(count / (total + distinct)), -np.log2(distinct / (total + distinct))
        return np.where(count > 0, own, np.where(total > 0, escape, 0.0) + lower)

    count = summed(key % width * wide + lang, width, n)
    cost = [coded(count, count.sum(0), (count > 0).sum(0), 8.0).astype(np.float32)]
    pick = np.zeros((width, width, width), np.int32)
    words = (width + 63) // 64
    full = np.full(words, np.iinfo(np.uint64).max)
    escape, lower, bits, first = [np.zeros((1, wide), np.float32)], [np.zeros(1, np.int32)], [full[None]], [np.arange(words)[None] * 64]
    below, below_at, below_id, ids, cells = np.arange(width), cost[0], np.zeros(1, np.int64), 1, width
    for order in (1, 2, 3):
        pair, at = np.unique(key % width ** (order + 1) * wide + lang, return_inverse=True)
        each, own, tongue = np.bincount(at, n), pair // wide, pair % wide
        keys, cell = np.unique(own, return_inverse=True)
        contexts, start, context = np.unique(keys // width, return_index=True, return_inverse=True)
        total, distinct = (summed(context[cell] * wide + tongue, len(contexts), w) for w in (each, None))
        down = np.searchsorted(below, keys % width**order)  # seen there too: counts of all orders are of the same bytes
        mine, edge = np.empty((len(keys), wide), np.float32), np.searchsorted(cell, np.arange(0, len(keys) + 65536, 65536))
        for i, a in enumerate(range(0, len(keys), 65536)):
            b, lo, hi = min(a + 65536, len(keys)), edge[i], edge[i + 1]
            count = summed((cell[lo:hi] - a) * wide + tongue[lo:hi], b - a, each[lo:hi])
            mine[a:b] = coded(count, total[context[a:b]], distinct[context[a:b]], below_at[down[a:b]])
        with np.errstate(divide="ignore", invalid="ignore"):
            escape.append(np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0).astype(np.float32))
        here, shorter = np.zeros((len(contexts), words), np.uint64), contexts % width ** (order - 1)
        np.bitwise_or.at(here, (context, keys % width // 64), np.uint64(1) << (keys % width % 64).astype(np.uint64))
        seen = np.bitwise_count(here).astype(np.int64)
        first.append(cells + start[:, None] + np.cumsum(seen, 1) - seen)
        lower.append((below_id[0] + np.searchsorted(below_id[1:], shorter) if order > 1 else shorter).astype(np.int32))
        bits.append(here)
        cost.append(mine)
        digits = tuple(contexts // width**i % width for i in range(order - 1, -1, -1))
        pick[(slice(None),) * (3 - order) + digits] = ids + np.arange(len(contexts), dtype=np.int32)
        below, below_at, below_id = keys, mine, np.concatenate([[ids], contexts])
        ids, cells = ids + len(contexts), cells + len(keys)
    return {"langs": langs, "symbol": symbol, "width": width, "pick": pick.reshape(-1), "words": words, "escape": np.concatenate(escape), "lower": np.concatenate(lower), "bits": np.concatenate(bits).reshape(-1), "first": np.concatenate(first).reshape(-1).astype(np.int32 if cells < 2**31 else np.int64), "cost": np.concatenate(cost)}


def layout(langs: list[str], symbol: np.ndarray, got: list) -> dict:
    """Costs of counted contexts in full, [context, symbol, language], and the map from three symbols to the longest
    context; `trees` holds the same costs for the symbols that were seen. For small alphabets, where all can be read off."""
    number = {lang: i for i, lang in enumerate(langs)}
    width = int(np.bincount(symbol, minlength=SYMBOLS)[SYMBOLS - 1])
    uniform = np.full((SYMBOLS, len(langs)), 8.0)
    uniform[-1] = 8.0 - np.log2(max(1, width))  # the shared symbol stands for `width` bytes

    def coded(count: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """count, lower: [context, symbol, language]."""
        n, d = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = -np.log2(count / (n + d))
            escape = -np.log2(d / (n + d))
        return np.where(n == 0, lower, np.where(count > 0, own, escape + lower))

    frames = {order: (keys, f) for order, keys, f in got}
    keys1, one = frames[1]
    lang1 = one["lang"].map(number).to_numpy()
    count = np.zeros((1, SYMBOLS, len(langs)))
    np.add.at(count, (0, one["s0"].to_numpy(), lang1), one["n"].to_numpy())
    costs = [coded(count, uniform[None]).astype(np.float32)]
    pick = np.zeros(SYMBOLS**3, np.int32).reshape((SYMBOLS,) * 3)
    base = 1
    for order in (1, 2, 3):
        keys, f = frames[order]
        code = np.zeros(len(f), np.int64)
        for k in keys:
            code = code * SYMBOLS + f[k].to_numpy()
        contexts, where = np.unique(code, return_inverse=True)
        digits = [contexts // SYMBOLS**i % SYMBOLS for i in range(order - 1, -1, -1)]
        shorter = np.zeros(len(contexts), np.int64) if order == 1 else pick[(0,) * (4 - order) + tuple(digits[1:])] if order == 3 else pick[0, 0, digits[1]]
        rest = np.concatenate(costs)
        order_of = np.argsort(where, kind="stable")
        cells = (where[order_of], f["s0"].to_numpy()[order_of], f["lang"].map(number).to_numpy()[order_of], f["n"].to_numpy()[order_of])
        for a in range(0, len(contexts), 1024):
            b = min(a + 1024, len(contexts))
            lo, hi = np.searchsorted(cells[0], [a, b])
            count = np.zeros((b - a, SYMBOLS, len(langs)))
            count[cells[0][lo:hi] - a, cells[1][lo:hi], cells[2][lo:hi]] = cells[3][lo:hi]
            costs.append(coded(count, rest[shorter[a:b]]).astype(np.float32))
        here = (base + np.arange(len(contexts))).astype(np.int32)
        if order == 1:
            pick[:, :, digits[0]] = here
        elif order == 2:
            pick[:, digits[0], digits[1]] = here
        else:
            pick[digits[0], digits[1], digits[2]] = here
        base += len(contexts)
    return {"langs": langs, "symbol": symbol, "pick": pick.reshape(-1), "cost": np.concatenate(costs).reshape(-1, len(langs))}


def priced(model: dict, context: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Costs [position, language] of symbols in contexts."""

    def found(context, s):
        at = context * model["words"] + (s >> 6)
        word, bit = model["bits"][at], (s & 63).astype(np.uint64)
        return model["first"][at] + np.bitwise_count(word & ((ONE << bit) - ONE)), (word >> bit & ONE) == 0

    cell, missed = found(context, s)
    todo = np.flatnonzero(missed)
    left, at = [], context[todo]
    while len(todo):
        left.append((todo, model["escape"][at]))
        at = model["lower"][at]
        cell[todo], missed = found(at, s[todo])
        todo, at = todo[missed], at[missed]
    cost = model["cost"][cell]
    for places, escape in left:
        cost[places] += escape
    return cost


def code_lengths(model: dict, text) -> tuple[np.ndarray, np.ndarray]:
    """(bits [row, language], bytes of each row) of an Arrow string column."""
    data, offsets = utf8_view(pc.utf8_lower(text))
    n = len(offsets) - 1
    bits, width = np.zeros((n, len(model["langs"]))), model["width"]
    for a, b in blocks(offsets, 1 << 20):
        lo, hi = offsets[a], offsets[b]
        if lo == hi:
            continue
        x, at = begun(data[lo:hi], offsets[a : b + 1] - lo)
        s = model["symbol"][x]
        context = model["pick"][(s[at - 3] * width + s[at - 2]) * width + s[at - 1]]
        cost = priced(model, context, s[at])
        full = np.flatnonzero(np.diff(offsets[a : b + 1]) > 0)
        bits[a + full] = np.add.reduceat(cost, offsets[a:b][full] - lo, axis=0, dtype=np.float64)
    return bits, np.diff(offsets)


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with `lang_pred` and `score`, the share of the chosen language among the likelihoods of 64 bytes at most, at the mean cost of a byte."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop("lang_pred", "score", "__letter").withColumn("__letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    names = plain.columns[:-1]
    at = names.index("text")

    def predicted(batches):
        for batch in batches:
            letter = batch.column(len(names)).to_numpy(zero_copy_only=False)
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if sent.value is not None and batch.num_rows:
                bits, size = code_lengths(sent.value, batch.column(at))
                best = bits.argmin(1)
                odds = np.exp2(np.maximum((bits.min(1, keepdims=True) - bits) / np.maximum(size, 1)[:, None] * np.minimum(size, 64)[:, None], -1000.0))
                lang = np.where(letter, np.array(sent.value["langs"], object)[best], "und")
                score = np.where(letter, 1 / odds.sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return plain.mapInArrow(predicted, f"{fields}, lang_pred string, score double")

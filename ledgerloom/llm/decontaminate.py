"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, weighted-shingle check.

Words are runs of letters and digits of the lower-cased text; shingles are five words (64-bit hashes). For an item of
m words the windows of a document are its m-word substrings (the whole text, if shorter), and their similarity is the
weighted Jaccard similarity of the shingles, weights being counts: sum of least counts / sum of greatest counts.

1. A window without a shingle of an item has similarity 0. Moving a window right past a first shingle that no item
   has never lowers its similarity, so the windows that start at a shared shingle, and the last one of a text, hold
   the maximum. One pass explodes shingles, probes those of the benchmark and cuts the windows at the hits. This chooses
   windows, not pairs.
2. Each window and each item gets a SimHash of 128 bits: the majority of its shingles' hash bits, by their counts.
3. Candidates come from the fingerprints alone. They are cut into eight blocks of 16 bits. Two fingerprints within the
   radius of 31 differ by three bits at most in one block at least, so an item is filed under every value within three
   bits of each of its blocks (697 a block), and an equi-join of the windows' blocks on (m, block, value) meets every pair within the
   radius, once: at the first such block. The Hamming distance then decides. An unrelated pair meets with probability
   0.08. At similarity 0.8 the distance is 19.4 on average with a deviation of 4.1, so the radius is three deviations out.
4. The exact similarity of what the search found decides.

Only DataFrame functions run on this path. The benchmark's shingles are broadcast while there are at most
`most_broadcast`, beyond that joins shuffle. Null or empty texts and items, and items under five words, match nothing.
Repeated rows and
different texts of one doc_id give one result row a (doc_id, item_id). Null ids match nothing. Of several rows of one item_id the least
text counts. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import written

WORDS = 5
BLOCKS, BITS, INSIDE = 8, 16, 3  # of the fingerprint; bits that an item's block is filed apart at most
RADIUS = BLOCKS * (INSIDE + 1) - 1  # beyond it every block could differ by more


def words(text):
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def zipped(array):
    """Array of structs of WORDS neighbours (the last WORDS - 1 are incomplete)."""
    return F.arrays_zip(*(F.slice(array, k + 1, F.greatest(F.size(array) - k, F.lit(0))).alias(f"w{k}") for k in range(WORDS)))


def shingle_hashes(array):
    """Hashes of the complete shingles of a short array."""
    count = F.greatest(F.size(array) - (WORDS - 1), F.lit(0))
    return F.transform(F.slice(zipped(array), F.lit(1), count), lambda z: F.xxhash64(*(z[f"w{k}"] for k in range(WORDS))))


def simhash(windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f0, f1) of rows with an array `sh`. Counts of two bit places share a sum: one in each half of a long."""
    pair = (1 << 32) | 1
    one = windows.select(*keys, F.explode("sh").alias("h0")).withColumn("h1", F.xxhash64("h0"))
    sums = [F.sum(F.shiftrightunsigned(f"h{w}", j).bitwiseAND(F.lit(pair))).alias(f"s{w}_{j}") for w in (0, 1) for j in range(32)]
    got = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)

    def word(w: int):
        fp = F.lit(0).cast("long")
        for j in range(32):
            low = F.col(f"s{w}_{j}").bitwiseAND(F.lit((1 << 32) - 1))
            fp = fp.bitwiseOR(F.when(low * 2 > F.col("n"), F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
            high = F.shiftrightunsigned(F.col(f"s{w}_{j}"), 32)
            top = (1 << (j + 32)) - (1 << 64 if j == 31 else 0)
            fp = fp.bitwiseOR(F.when(high * 2 > F.col("n"), F.lit(top)).otherwise(F.lit(0)).cast("long"))
        return fp

    return got.select(*keys, word(0).alias("f0"), word(1).alias("f1"))


def block_of(k: int, f0, f1):
    """Bits of block k."""
    return F.shiftrightunsigned(f0 if k < BLOCKS // 2 else f1, BITS * (k % (BLOCKS // 2))).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def near_prints(windows: DataFrame, items: DataFrame, keys: list[str], radius: int = RADIUS) -> DataFrame:
    """(keys, item_id, hamming) of all pairs of windows (keys with m, f0, f1) and items (item_id, m, f0, f1) of one m whose
    fingerprints are within the radius: all of them up to RADIUS, beyond it only those that meet."""
    inside = F.array(*(F.lit(x) for x in range(1 << BITS) if x.bit_count() <= INSIDE))
    filed = items.select("item_id", "m", F.col("f0").alias("g0"), F.col("f1").alias("g1"))
    filed = filed.select("*", F.posexplode(F.array(*(block_of(k, F.col("g0"), F.col("g1")) for k in range(BLOCKS)))).alias("block", "bits"))
    filed = filed.withColumn("apart", F.explode(inside)).select("item_id", "m", "g0", "g1", "block", F.col("bits").bitwiseXOR(F.col("apart")).alias("bits"))
    asked = windows.select(*keys, "f0", "f1", F.posexplode(F.array(*(block_of(k, F.col("f0"), F.col("f1")) for k in range(BLOCKS)))).alias("block", "bits"))
    a, b = F.col("f0").bitwiseXOR(F.col("g0")), F.col("f1").bitwiseXOR(F.col("g1"))
    hamming = F.bit_count(a) + F.bit_count(b)
    before = [F.bit_count(block_of(k, a, b)) <= INSIDE for k in range(BLOCKS)]
    first = F.coalesce(*(F.when(met, F.lit(k)) for k, met in enumerate(before)))
    # 5,576 rows an item are no table to broadcast
    met = asked.join(filed.hint("merge"), ["m", "block", "bits"]).where(F.col("block") == first)
    return met.select(*keys, "item_id", hamming.alias("hamming")).where(F.col("hamming") <= radius)


def touched(text: DataFrame, sizes: DataFrame, window: list[str], ride: bool) -> DataFrame:
    """(window..., w): the windows of texts (doc_id, row, w) that begin at a shingle of the benchmark (sizes: key, ms), for each of its items'
    lengths. A benchmark that may ride along is broadcast and texts stay where they are; else shingles move alone, without
    their text, and the places that are found come back to it, once a text."""
    grams = text.select("doc_id", "row", "w", F.size("w").alias("n"), F.posexplode(zipped(F.col("w"))).alias("pos", "z"))
    grams = grams.select("doc_id", "row", "w", "n", "pos", F.xxhash64(*(F.col("z")[f"w{k}"] for k in range(WORDS))).alias("key")).where(F.col("pos") <= F.col("n") - WORDS)
    start = F.greatest(F.least("pos", F.col("n") - F.col("m")), F.lit(0)).alias("start")
    if ride:
        hits = grams.join(F.broadcast(sizes), "key").select("doc_id", "row", "w", "n", "pos", F.explode("ms").alias("m")).select("doc_id", "row", "m", start, "w")
    else:
        places = grams.drop("w").join(sizes, "key").select("doc_id", "row", "n", "pos", F.explode("ms").alias("m")).select("doc_id", "row", F.struct("m", start).alias("place"))
        places = places.groupBy("doc_id", "row").agg(F.collect_set("place").alias("places"))
        hits = text.join(places, ["doc_id", "row"]).select("doc_id", "row", F.explode("places").alias("place"), "w").select("doc_id", "row", "place.m", "place.start", "w")
    return hits.select(*window, F.slice("w", F.col("start") + 1, F.col("m")).alias("w")).dropDuplicates(window)


def contaminated(docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100, most_broadcast: int = 500_000) -> DataFrame:
    """(doc_id, item_id, start, n_words, hamming, similarity): each document's best window for each item it holds."""
    items = benchmark.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text")).select("item_id", words("text").alias("w"))
    items = items.select("item_id", F.size("w").alias("m"), shingle_hashes(F.col("w")).alias("sh")).where("size(sh) > 0")
    items = written(items, "items")
    size = items.agg(F.coalesce(F.sum(F.size("sh")), F.lit(0))).first()[0]
    small = F.broadcast if size <= most_broadcast else (lambda df: df)

    sizes = items.select("m", F.explode("sh").alias("key")).groupBy("key").agg(F.collect_set("m").alias("ms"))
    text = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), words("text").alias("w"))
    window = ["doc_id", "row", "m", "start"]
    windows = touched(text, sizes, window, size <= most_broadcast)
    windows = written(windows.select(*window, F.size("w").alias("n_words"), shingle_hashes(F.col("w")).alias("sh")), "windows")

    near = near_prints(simhash(windows, window), simhash(items, ["item_id", "m"]), window)
    counted = windows.join(near, window).select(*window, "n_words", "item_id", "hamming", F.size("sh").alias("nw"), F.explode("sh").alias("key"))
    counted = counted.groupBy(*window, "n_words", "item_id", "hamming", "nw", "key").agg(F.count(F.lit(1)).alias("cw"))
    wanted = items.select("item_id", F.size("sh").alias("ni"), F.explode("sh").alias("key")).groupBy("item_id", "ni", "key").agg(F.count(F.lit(1)).alias("ci"))
    found = counted.join(small(wanted), ["item_id", "key"]).groupBy(*window, "item_id", "n_words", "hamming", "nw", "ni").agg(F.sum(F.least("cw", "ci")).alias("both"))
    found = found.where(F.col("both") * (num + den) >= num * (F.col("nw") + F.col("ni")))
    similarity = F.col("both") / (F.col("nw") + F.col("ni") - F.col("both"))
    best = F.min_by(F.struct("start", "n_words", "hamming", similarity.alias("similarity")), F.struct(-similarity, "start"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")

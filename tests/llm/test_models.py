"""Classifiers, tokens, sharding, packing, HTML and decontamination."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, html_text, langid, packing, quality, queries, records, sharding
from ledgerloom.llm.common import ranked, word_counts

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "1234 !!"), (904, "x" * 50_000), (905, "same"), (905, "same"), (906, "É")]


def test_language_model_by_hand():
    """Two languages, order 1 visible by hand: method C with escapes."""
    import pandas as pd

    symbol = np.full(256, langid.SYMBOLS - 1, np.uint8)
    symbol[ord("a")], symbol[ord("b")] = 0, 1
    one = pd.DataFrame({"lang": ["x"] * 3, "s1": [0, 0, 1], "s0": [0, 1, 0], "n": [2, 1, 1]})
    wide = one.assign(s2=0, s3=0).iloc[:0]
    model = langid.layout(["x"], symbol, [(3, ["s3", "s2", "s1"], wide), (2, ["s2", "s1"], wide), (1, ["s1"], one)])
    cost = model["cost"].reshape(-1, langid.SYMBOLS)
    at = model["pick"][0]  # after 'a' (symbols 0, 0, 0 have only an order-1 context)
    assert cost[at, 0] == pytest.approx(-np.log2(2 / 5)) and cost[at, 1] == pytest.approx(-np.log2(1 / 5))
    order0 = cost[0]
    assert order0[0] == pytest.approx(-np.log2(3 / 6)) and order0[5] == pytest.approx(-np.log2(2 / 6) + 8)


def test_language_query(spark):
    got = queries.op3_language(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    share = got.join(docs, "doc_id").groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    assert len(share) == 2 and all(r["right"] >= 0.98 and 0 <= r["lo"] and r["hi"] <= 1 for r in share)
    model = langid.train(docs.limit(0).withColumn("text", F.lit("x")))
    odd = spark.createDataFrame([(*r, "old") for r in ODD], f"{DOCS}, lang_pred string")
    assert {r["lang_pred"] for r in langid.identify(odd, model).collect()} == {"und"}
    trained = langid.train(spark.createDataFrame([("en", "the and the of"), ("de", "der und die ß"), (None, "x"), ("fr", None)], "lang string, text string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, trained).collect()}
    assert len(got) == 7 and all(got[k] == ("und", 0.0) for k in (900, 901, 902, 903)) and got[905][0] in ("en", "de")


def test_quality_query(spark):
    got = queries.op8_quality(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


def test_quality_of_odd_texts(spark):
    docs = spark.createDataFrame([(*r, 9.0) for r in ODD], f"{DOCS}, score double")
    labels = spark.createDataFrame([(903, 0), (905, 1), (None, 1), (906, None)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.score_quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_records_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(records.tokenizer_path())
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(60).collect()]
    texts += [None, "", "it's ABC's don't x", "a'S, 3.5% foo12, É́te ẞ İ! <|endoftext|>, x<|startoftext|>.", "b\x1cc\x85d ΑΣ. ΑΣ!! ﬁ ½"]
    rows = [(3 * i - 5, t) for i, t in enumerate(texts)]
    manifest = records.write_records(spark.createDataFrame(rows, DOCS).repartition(4), records.tokenizer_path(), parts=3)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in records.read_records(manifest).collect()}
    start, want, ids_of = 0, {}, {}
    for i, t in rows:
        ids_of[i] = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] = (start, len(ids_of[i]), zlib.crc32(np.array(ids_of[i], "<u4").tobytes()))
        start += len(ids_of[i])
    assert got == want
    first = manifest.orderBy("part").first()
    picked = records.fetch(first["path"], [2, 0])
    assert [d for d, _ in picked] == [1, -5] and picked[1][1].tolist() == ids_of[-5]
    empty = records.write_records(spark.createDataFrame([], DOCS), records.tokenizer_path())
    assert records.read_records(empty).count() == 0


def test_crc32c_known_values_and_damage():
    texts = [b"123456789", b"", b"a" * 1000, bytes(32)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    got = records.crc32c(data, np.cumsum(sizes) - sizes, sizes)
    assert got[0] == 0xE3069283 and got[1] == 0 and got[3] == 0x8A9136AA  # published check values
    raw, _ = records.frames(np.array([7]), [b"\1\0\2\0"])
    assert [x.tolist() for x in records.parsed(raw, 2)[1]] == [[1, 2]]
    with pytest.raises(ValueError):
        records.parsed(raw[:-5] + b"\7" + raw[-4:], 2)


def brute_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in bins if b >= s]
        if fit:
            bins[bins.index(min(fit))] -= s
        else:
            bins.append(max(capacity, s) - s)
    return sorted(bins)


def test_best_fit_decreasing_equals_the_plain_one():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = rng.integers(1, 40, int(rng.integers(1, 80))).tolist()
        runs, n = sharding.best_fit(list(Counter(sizes).items()), 50)
        load = Counter()
        for s, _, k, b in runs:
            load[b] += s * k
        assert n == len(load) and sorted(50 - x for x in load.values()) == brute_best_fit(sizes, 50)
        ranks = Counter((s, r) for s, a, k, _ in runs for r in range(a, a + k))
        assert max(ranks.values()) == 1 and sum(ranks.values()) == len(sizes)


def test_shards(spark):
    rows = spark.createDataFrame([(i, f"k{i // 3}" if i % 7 else None, 8 + i * i % 900) for i in range(600)], "doc_id long, key string, size long").withColumn("shard", F.lit("old"))
    got = sharding.pack_shards(rows, "key", "size", shards=24).toPandas()
    assert len(got) == 600 and got.groupby("key")["shard"].nunique().max() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    load = got.groupby("shard")["size"].sum()
    hot = got[got["key"].isna()]["shard"].iloc[0]  # the null group is larger than an even share
    assert load.drop(hot).max() - load.drop(hot).min() <= 0.02 * load.drop(hot).mean() and len(load) == 24
    few = sharding.pack_shards(rows, "key", "size", capacity=40_000).toPandas()
    assert few.groupby("shard")["size"].sum().max() <= max(40_000, load[hot])
    assert sharding.pack_shards(rows.limit(0), "key", "size", shards=24).count() == 0


def test_sharding_query_keeps_equal_texts_together(spark):
    got = queries.op2_sharding(spark, DATA)
    load = got.groupBy("shard").agg(F.sum("size").alias("b")).toPandas()["b"]
    assert len(load) == 24 and load.max() - load.min() < 0.001 * load.mean()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert got.join(docs, "doc_id").groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    rows = got.join(docs, "doc_id").limit(50).collect()
    assert all(r["size"] == len(r["text"].encode()) + 8 and r["text_crc32"] == zlib.crc32(r["text"].encode()) for r in rows)


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(6)
    for _ in range(30):
        lengths = np.sort(rng.integers(0, 60, int(rng.integers(1, 40))))
        values, rows = np.unique(lengths, return_counts=True)
        k = int(rng.integers(1, 5))
        pad = lambda ends: sum(min(e for e in ends if e >= x) - x for x in lengths)
        best = min(pad((*c, values[-1])) for c in combinations(values[:-1].tolist(), min(k, len(values)) - 1))
        got = packing.boundaries(values, rows, values * rows, k)
        assert got[-1] == values[-1] and len(got) <= k and pad(got) == best


def test_packing(spark):
    docs = spark.createDataFrame([(i, "w " * (i * 37 % 300), "b") for i in range(500)] + [(*r, "x") for r in ODD], f"{DOCS}, bucket string")
    got = packing.pack(packing.with_words(docs), buckets=4, budget=1000).toPandas()
    assert len(got) == 508 and (got["n_tokens"] <= got["bucket_len"]).all() and got["bucket"].nunique() == 4
    for (_, end), g in got.groupby(["bucket", "bucket_len"]):
        fit = max(1, 1000 // max(1, end))
        sizes = g.groupby("batch").size().sort_index()
        assert (sizes[:-1] == fit).all() and sizes.iloc[-1] <= fit and list(sizes.index) == list(range(len(sizes)))
    assert packing.pack(packing.with_words(docs.limit(0))).count() == 0
    assert word_counts(pa.array(["a b", None, "", " x\ny\t", "é"])).tolist() == [2, 0, 0, 2, 1]


def test_ranks_are_gapless(spark):
    df = spark.range(100).withColumn("g", F.when(F.col("id") < 70, 1).when(F.col("id") < 90, 2))
    got = ranked(df, "g", ["id"], "r", parts=3).toPandas()
    for _, rows in got.groupby("g", dropna=False):
        assert sorted(rows["r"]) == list(range(len(rows)))


PAGE = '<title>T&amp;C</title><body>a<p>b<p>c<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul><table><tr><td>1<td>long cell<tr><td colspan=2>z<td>w</table><pre>  k\n\n  j</pre>tail <span hidden>no</span><i style="display: none">no</i><!-- no --> &lt;x&amp; a < b <b'


def test_html_layout():
    title, text = html_text.page_text(PAGE)
    assert title == "T&C"
    assert text == "a\n\nb\n\nc\n\n- x\n- y\n  3. q\n  4. r\n\n1  long cell\nz             w\n\n  k\n\n  j\n\ntail <x& a < b <b"
    assert html_text.page_text(None) == ("", "") and html_text.page_text("plain  text") == ("", "plain text")
    assert html_text.page_text("<div>" * 3000 + "deep" + "</div>" * 10) == ("", "deep")
    assert html_text.page_text("<script>var a='</p>'</script>x<br>y</z><img>z<style>p{}")[1] == "x\ny z"


def test_html_query_keeps_every_visible_word(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op6_html(spark, DATA).collect()
    assert len(got) == len(pages)
    import html

    for r in got[:80]:
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<script.*?</script>|<style.*?</style>", " ", pages[r["page_id"]])
        words = html.unescape(re.sub(r"<[a-zA-Z/!][^>]*>", " ", body)).split()
        assert [w for w in re.sub(r"(?m)^\s*- ", "", r["text"]).split()] == words


def brute_leaks(docs, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    out = {}
    for i, t in docs:
        w = words(t)
        for j, u in items:
            item, m = Counter(grams(words(u))), len(words(u))
            for a in range(max(1, len(w) - m + 1)):
                c = Counter(grams(w[a : a + m]))
                both = sum((c & item).values())
                s = both / max(1, sum(c.values()) + sum(item.values()) - both)
                if item and s >= 0.8:
                    out[i, j] = max(out.get((i, j), 0), round(s, 9))
    return out


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    items = [(j, text(int(rng.integers(20, 70)))) for j in range(8)] + [(90, []), (91, ["a", "b", "c"]), (92, ["r", "s"] * 20)]
    docs = []
    for i in range(60):
        body, inner = text(120), list(items[i % 8][1])
        for _ in range(i % 4):
            inner[int(rng.integers(len(inner)))] = "edited"
        at = int(rng.integers(len(body)))
        docs.append((i, " ".join(body[:at] + inner + body[at:]) if i % 3 else " ".join(inner).upper().replace(" ", ", ")))
    docs += [(100, None), (101, ""), (102, " ".join(items[0][1][:-1])), (103, "r s " * 60), (104, "!!")]
    plain = [(j, " ".join(w)) for j, w in items] + [(93, None)]
    df = spark.createDataFrame([(*d, "x") for d in docs], f"{DOCS}, fp string")
    bench = spark.createDataFrame(plain, "item_id long, text string")
    want = brute_leaks(docs, plain)
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.contaminated(df, bench).collect()}
    assert len(want) > 20 and got == want
    assert decontaminate.contaminated(df, bench, most_broadcast=0).count() == len(want)
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_runs_no_python(spark):
    plan = decontaminate.contaminated(spark.createDataFrame([(1, "a b c d e f")], DOCS), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, seen, DATA)
        assert out.schema.names == docs.schema.names, name
        kept = out.count()
        assert 0.7 * seen.count() < kept <= seen.count(), name
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/pipe-{name}-{np.random.default_rng().integers(1 << 60)}"
        out.write.parquet(path)
        seen = spark.read.parquet(path)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert seen.join(labels, "doc_id").where("quality = 0").count() <= 2
    assert P.STAGES[-1][1](spark, seen, DATA).count() == seen.count()

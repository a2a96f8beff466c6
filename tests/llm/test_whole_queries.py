"""op2, op4 and op6 over their whole tables against plain versions written for the tests."""

import re
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np

from ledgerloom.llm import queries

DATA = "/root/testdata/sf0.01"


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, b in enumerate(bins) if b + s <= capacity]
        if fit:
            bins[max(fit, key=lambda i: bins[i])] += s
        else:
            bins.append(s)
    return sorted(bins)


def test_sharding_equals_plain_best_fit_decreasing(spark):
    docs = documents(spark)
    rows = queries.op2_sharding(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    shards, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        shards[r["shard"]].append(r)
        groups[docs[r["doc_id"]]].add(r["shard"])
    assert sorted(shards) == list(range(24)) and all(len(s) == 1 for s in groups.values())
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in shards.values())
    size = defaultdict(int)
    for r in rows:
        size[docs[r["doc_id"]]] += r["size"]
    sizes = list(size.values())
    load = sorted(sum(r["size"] for r in rs) for rs in shards.values())
    assert max(sizes) * 24 <= sum(sizes)  # no text fills a shard alone here
    lo, hi = -(-sum(sizes) // 24), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if len(plain_best_fit(sizes, mid)) <= 24 else (mid + 1, hi)
    assert load[-1] <= lo + max(1, sum(sizes) >> 20) and sum(load) == sum(sizes)


def test_packing_has_the_least_padding(spark):
    docs = documents(spark)
    rows = queries.op4_packing(spark, DATA).collect()
    length = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == length
    values, n = np.unique(list(length.values()), return_counts=True)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(values * n)])
    best = [0.0] + [np.inf] * len(values)
    for _ in range(16):
        best = [0.0] + [min(best[j], min(best[i] + values[j - 1] * (count[j] - count[i]) - (total[j] - total[i]) for i in range(j))) for j in range(1, len(values) + 1)]
    padding = sum(r["bucket_len"] - r["n_tokens"] for r in rows)
    exact = values.max() < 2048  # above, classes of lengths are chosen from
    assert padding == best[-1] if exact else best[-1] <= padding <= best[-1] * 1.01
    slots = defaultdict(list)
    for r in rows:
        slots[r["bucket"], r["bucket_len"], r["batch"]].append(r["slot"])
    last = {b: max(k[2] for k in slots if k[0] == b) for b, _, _ in slots}
    for (b, end, batch), s in slots.items():
        fit = max(1, 65536 // max(1, end))
        assert sorted(s) == list(range(len(s))) and (len(s) == fit or batch == last[b] and len(s) <= fit)


class Words(HTMLParser):
    """Words outside of what is not rendered, in order; elements are a word's end where the page has blocks, breaks and cells."""

    INLINE = frozenset("a b i em strong span code small sup sub u s mark abbr cite q kbd var samp time font big tt del ins label".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.off, self.text = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "template", "title"):
            self.off.append(tag)
        if tag not in self.INLINE:
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in self.off:
            del self.off[self.off.index(tag) :]
        if tag not in self.INLINE:
            self.text.append(" ")

    def handle_data(self, data):
        if not self.off:
            self.text.append(data)


def test_pages_show_every_visible_word_in_order(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op6_html(spark, DATA).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    marks = re.compile(r"(?m)^\s*(?:- |-$|\d+\. |---$)")
    for r in got:
        words = Words()
        words.feed(pages[r["page_id"]] or "")
        words.close()
        want = "".join(words.text).split()
        assert [w for w in marks.sub(" ", r["text"]).split()] == [w for w in marks.sub(" ", "\n".join(want)).split()]

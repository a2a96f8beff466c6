"""Where the terms of a dictionary occur: one automaton over all terms, run once over each text.

The terms are built into Aho-Corasick automata of at most `letters` letters, and every text runs through each of them once, inside
Arrow batches: its time depends on its length and on its hits, not on the number of terms, and only hits move on. There is
one rule at every size: a dictionary of more letters has several automata, whose hits are written one after the other, so the
driver holds the terms of one automaton at a time and never the dictionary. Texts are not shuffled.

Texts are folded keys (letters, digits, single blanks); a term counts inside longer words, or whole, between blanks. Null texts
and empty or null terms have no hits. Repeated terms have hits of their own, and all columns of a term come with its hits.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ledgerloom.sources.shared import stored

LETTERS = 2_000_000
ROWS = 256  # texts looked at together


def automaton(words: list[str | None]):
    """Automaton that yields (last letter, (numbers of the equal words, length)), or None without words."""
    import ahocorasick

    known: dict[str, list[int]] = {}
    for k, word in enumerate(words):
        if word:
            known.setdefault(word, []).append(k)
    found = ahocorasick.Automaton()
    for word, numbers in known.items():
        found.add_word(word, (numbers, len(word)))
    if known:
        found.make_automaton()
    return found if known else None


def dictionaries(terms: DataFrame, letters: int) -> list[DataFrame]:
    """The terms (term, ...) in parts of about `letters` letters, by a hash."""
    parts = -(-(terms.agg(F.sum(F.length("term"))).first()[0] or 0) // letters) or 1
    return [terms] if parts == 1 else [terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k) for k in range(parts)]


def scanned(texts: DataFrame, key: list[str], terms: DataFrame, found: T.StructType, scan: Callable[[pa.Table], Callable], letters: int) -> DataFrame:
    """Rows (key..., the columns of a term, found...) of texts. `scan(terms)` is called once a task and gives a function from a
    text's other columns to tuples (number of the term, found...)."""
    fields = T.StructType([*(texts.schema[c] for c in key), *terms.schema.fields, *found.fields])
    rest = [c for c in texts.columns if c not in key]
    parts = dictionaries(terms, letters)
    if len(parts) > 1:
        texts = stored(texts, "texts")  # folded once, not for each automaton
    kinds = [pa.int64(), *map({"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}.get, (f.dataType.simpleString() for f in found.fields))]

    def through(part: DataFrame) -> DataFrame:
        table = part.toArrow().combine_chunks()

        def run(batches):
            look = scan(table)
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS):
                    rows = batch.slice(a, ROWS)
                    at, hits = [], []
                    for i, values in enumerate(zip(*(rows.column(c).to_pylist() for c in rest))):
                        mine = look(*values)
                        at += [i] * len(mine)
                        hits += mine
                    columns = [pa.array(x, kind) for x, kind in zip(zip(*hits), kinds)] if hits else [pa.array([], kind) for kind in kinds]
                    keys = [rows.column(c).take(pa.array(at, pa.int64())) for c in key]
                    named = table.take(columns[0])
                    yield pa.RecordBatch.from_arrays([*keys, *(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in named.columns), *columns[1:]], fields.names)

        return texts.select(*key, *rest).mapInArrow(run, fields)

    if len(parts) == 1:
        return through(terms)
    every = None
    for part in parts:
        got = stored(through(part), "hits")
        every = got if every is None else every.union(got)
    return every


class Hits:
    """Occurrences of one term in a text, from left to right."""

    __slots__ = ("n", "last", "whole", "last_whole", "first", "near")

    def __init__(self, first):
        self.n, self.last, self.whole, self.last_whole, self.first, self.near = 0, -1, 0, -1, first, False

    def add(self, norm, start, end, top):
        """An occurrence of the letters start..end; those that overlap the one before do not count."""
        if start > self.last:
            self.n, self.last = self.n + 1, end
        if start == 0 or norm[start - 1] == " ":
            bound = end + 1 == len(norm) or norm[end + 1] == " "
            if bound and start > self.last_whole:
                self.whole, self.last_whole = self.whole + 1, end
            self.near |= end < top and (bound or end + 1 == top)  # a text cut at `top` ends its last word there


OCCURRENCES = T.StructType([T.StructField("n", T.LongType()), T.StructField("whole", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("near", T.BooleanType())])


def occurrences(chunks: DataFrame, terms: DataFrame, top: int = 1200, letters: int = LETTERS) -> DataFrame:
    """(chunk_id, the columns of terms, n, whole, first, near) of folded chunks (chunk_id, norm) and folded terms (term, ...):
    occurrences that do not overlap, inside words too and whole; the place of the first one; whether a whole one stands in the
    first `top` letters."""

    def scan(table):
        known = automaton(table.column("term").to_pylist())

        def look(norm):
            found: dict[int, tuple[list[int], Hits]] = {}
            for end, (numbers, size) in known.iter(norm) if known and norm else ():
                if numbers[0] not in found:
                    found[numbers[0]] = numbers, Hits(end + 1 - size)
                found[numbers[0]][1].add(norm, end + 1 - size, end, top)
            return [(k, h.n, h.whole, h.first, h.near) for numbers, h in found.values() for k in numbers]

        return look

    return scanned(chunks.select("chunk_id", "norm"), ["chunk_id"], terms, OCCURRENCES, scan, letters)


BEGIN = 4  # letters by which texts and terms of a large dictionary meet first


def contained(texts: DataFrame, terms: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(chunk_id, term): which distinct folded terms (term) the folded texts (chunk_id, norm) contain, inside words too. A dictionary of at most `letters` letters
    is one automaton. A larger one, which grows with the data, never comes to the driver: places of a text where a term could begin are found by the first BEGIN letters,
    and there the text is cut to the lengths that such terms have and meets them by an equi-join."""
    terms = stored(terms.select("term").where("term <> ''").distinct(), "terms")
    if (terms.agg(F.sum(F.length("term"))).first()[0] or 0) <= letters:
        return occurrences(texts, terms, letters=letters).select("chunk_id", "term")
    texts = stored(texts.select("chunk_id", "norm").where("norm <> ''"), "texts")
    sizes = terms.groupBy(F.substring("term", 1, BEGIN).alias("begin")).agg(F.collect_set(F.length("term")).alias("sizes"))
    begins = F.explode(F.array_distinct(F.array(*(F.substr("norm", F.col("at") + 1, F.lit(k)) for k in range(1, BEGIN + 1))))).alias("begin")
    places = texts.select("chunk_id", F.explode(F.sequence(F.lit(0), F.length("norm") - 1)).alias("at"), "norm")
    met = places.select("chunk_id", "at", begins).join(sizes, "begin").select("chunk_id", "at", F.explode("sizes").alias("size"))
    cut = met.join(texts, "chunk_id").where(F.col("at") + F.col("size") <= F.length("norm"))
    cut = cut.select("chunk_id", F.substr("norm", F.col("at") + 1, F.col("size")).alias("term")).distinct()
    return cut.join(terms, "term").select("chunk_id", "term")


LINES = T.StructType([*OCCURRENCES.fields, T.StructField("head", T.IntegerType()), T.StructField("head_at", T.IntegerType()), T.StructField("head_rank", T.IntegerType()), T.StructField("head_upper", T.BooleanType()), T.StructField("kind_at", T.IntegerType())])
NUMBERS, NUMBERED = re.compile(r"\d+ "), re.compile(r"(?:\d+ )*")


def line_occurrences(chunks: DataFrame, terms: DataFrame, kinds: dict[str, list[str]] = {}, top: int = 1200, letters: int = LETTERS, key: list[str] = ["chunk_id"]) -> DataFrame:
    """As occurrences(), of chunks (chunk_id, keys, marks, upper) given as lines: folded, without marks, and whether in
    capitals. More columns: `head`, the best rank of a line that begins with the term (alone 220, before others 160, behind section
    numbers 320 and 270; else 0), the place, rank and capitals of the first such line, and `kind_at`, the first line that holds
    `plain` (the term with its punctuation) beside a word of the term's mode in `kinds`. Terms have columns mode and plain if
    kinds are given. `key`: columns of the chunks that come with each hit."""

    def scan(table):
        known = automaton(table.column("term").to_pylist())
        modes = table.column("mode").to_pylist() if kinds else []
        plains = automaton([p if m in kinds else None for p, m in zip(table.column("plain").to_pylist(), modes)]) if kinds else None

        def look(keys, marks, upper):
            keys = [k or "" for k in keys or ()]
            places, size = {}, 0
            for line, key in enumerate(keys):  # keys stand in the text with one blank between them
                if not key:
                    continue
                end, at = size + len(key), 0
                while True:
                    places[size + at] = line, end, at > 0
                    number = NUMBERS.match(key, at)
                    if not number:
                        break
                    at = number.end()
                size = end + 1
            norm = " ".join(filter(None, keys))
            found: dict[int, list] = {}
            for end, (numbers, length) in known.iter(norm) if known and norm else ():
                start = end + 1 - length
                if numbers[0] not in found:
                    found[numbers[0]] = [numbers, Hits(start), 0, None, None, None]
                mine = found[numbers[0]]
                mine[1].add(norm, start, end, top)
                if start in places:
                    line, stop, numbered = places[start]
                    if end + 1 == stop or end + 1 < stop and norm[end + 1] == " ":
                        rank = (320 if numbered else 220) if end + 1 == stop else 270 if numbered else 160
                        if mine[3] is None:
                            mine[3:] = line, rank, bool(upper[line])
                        elif line == mine[3]:
                            mine[4] = max(mine[4], rank)
                        mine[2] = max(mine[2], rank)
            named: dict[int, int] = {}
            if plains and marks and found:
                text, starts, seen = "\n".join(m or "" for m in marks), [], 0
                for m in marks:
                    starts.append(seen)
                    seen += len(m or "") + 1
                told: dict[tuple, bool] = {}
                for end, (numbers, length) in plains.iter(text):
                    line = bisect_right(starts, end) - 1
                    if end + 1 - length < starts[line]:
                        continue
                    for k in numbers:
                        if k not in named:
                            case = line, modes[k]
                            if case not in told:
                                told[case] = any(w in marks[line] for w in kinds[modes[k]])
                            if told[case]:
                                named[k] = line
            return [(k, h.n, h.whole, h.first, h.near, *rest, named.get(k)) for numbers, h, *rest in found.values() for k in numbers]

        return look

    return scanned(chunks.select(*key, "keys", "marks", "upper"), key, terms, LINES, scan, letters)


SUPPORT = T.StructType([T.StructField(c, T.IntegerType()) for c in ("size", "start", "score", "pos")])


def supports(known, keys: list[str], widest: int = 3, most: int = 6) -> list[tuple]:
    """(numbers, size, start, score, pos) of the terms of an automaton in a text's lines, given folded: the smallest, then
    first window of at most `widest` lines, and the best, then first heading (alone 220, with at most `most` more words 170, behind section
    numbers 300 and 250). Lines are counted from 0. A match is an interval of lines: the lines of its first and last letter."""
    lines = [k for k, key in enumerate(keys) if key]
    held = [keys[k] for k in lines]
    begins, at = [], 0
    for key in held:
        begins.append(at)
        at += len(key) + 1
    norm, found = " ".join(held), {}
    for end, (numbers, length) in known.iter(norm) if known and norm else ():
        start = end + 1 - length
        a, b = bisect_right(begins, start) - 1, bisect_right(begins, end) - 1
        mine = found.setdefault(numbers[0], [numbers, None, None])
        window = lines[b] - lines[a] + 1, lines[a]
        if window[0] <= widest and (mine[1] is None or window < mine[1]):
            mine[1] = window
        head = held[a]
        place = start - begins[a]
        if a == b and NUMBERED.fullmatch(head, 0, place):
            rest = head[place + length :]
            if not rest or rest[0] == " " and rest.count(" ") <= most:
                score = (300 if place else 220) if not rest else 250 if place else 170
                if mine[2] is None or (-score, lines[a]) < mine[2]:
                    mine[2] = -score, lines[a]
    return [(numbers, *(window or (None, None)), *((-head[0], head[1]) if head else (None, None))) for numbers, window, head in found.values() if window or head]


def supported(texts: DataFrame, terms: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(document_id, the columns of terms, size, start, score, pos) of texts (document_id, keys: folded lines that are not empty)
    for the terms of a dictionary, see supports()."""

    def scan(table):
        known = automaton(table.column("term").to_pylist())
        return lambda keys: [(k, *rest) for numbers, *rest in supports(known, keys or []) for k in numbers]

    return scanned(texts.select("document_id", "keys"), ["document_id"], terms, SUPPORT, scan, letters)


def supported_within(units: DataFrame, terms: DataFrame, together: int = 2000) -> DataFrame:
    """(document_id, unit, term, size, start, score, pos) of units (document_id, unit, keys) for the terms (document_id, term) of
    their own document. A document's terms travel in packs of about `together`, its units meet them by an equi-join on
    document_id (of which Spark splits large keys), and a pack's automaton is built when the document changes."""
    terms = terms.where("term <> ''").select("document_id", "term").distinct()
    packs = F.greatest(F.ceil(F.count(F.lit(1)) / together), F.lit(1))
    counts = terms.groupBy("document_id").agg(packs.alias("packs"))
    dealt = terms.join(counts, "document_id").withColumn("pack", F.pmod(F.xxhash64("term"), F.col("packs")))
    packed = dealt.groupBy("document_id", "pack").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    met = units.select("document_id", "unit", "keys").join(packed, "document_id")
    fields = T.StructType([*(met.schema[c] for c in ("document_id", "unit")), T.StructField("term", T.StringType()), *SUPPORT.fields])

    def run(batches):
        last, words, known = None, [], None
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                rows = batch.slice(a, ROWS)
                at, out = [], []
                for i, (document, pack, keys) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("document_id", "pack", "keys")))):
                    if (document, pack) != last:
                        words = rows.column("terms")[i].as_py()
                        last, known = (document, pack), automaton(words)
                    for numbers, *rest in supports(known, keys or []):
                        at.append(i)
                        out.append((words[numbers[0]], *rest))
                columns = list(zip(*out)) if out else [()] * 5
                kinds = [pa.string(), *[pa.int32()] * 4]
                keep = [rows.column(c).take(pa.array(at, pa.int64())) for c in ("document_id", "unit")]
                yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x, k) for x, k in zip(columns, kinds))], fields.names)

    return met.mapInArrow(run, fields)

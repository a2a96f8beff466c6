"""Pages of text: status, repeated margins, chunks with exact offsets, statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import clean_text, strip

PAGE = ["document_id", "page_number"]


def pages_of(documents: DataFrame, lines_a_page: int) -> DataFrame:
    """Single-text documents cut into pages of a number of lines."""
    lines = F.split("text", "\n")
    one = lambda p: F.array_join(F.slice(lines, (p - 1) * lines_a_page + 1, lines_a_page), "\n")
    pages = F.transform(F.sequence(F.lit(1), F.ceil(F.size(lines) / lines_a_page).cast("int")), one)
    rows = documents.where("text is not null").select("document_id", F.posexplode(pages).alias("pos", "raw_text"))
    return rows.select("document_id", (F.col("pos") + 1).alias("page_number"), "raw_text")


def page_status(text: Column, threshold: int = 80) -> Column:
    n = F.length(strip(text))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "EMPTY").when(n < threshold, "LOW_TEXT").otherwise("NATIVE_TEXT")


#: fixed value: a line that is only a page number
PAGE_NUMBER = r"(?i)^(?:p[aá]g(?:ina)?\.?\s*)?\d+(?:\s*/\s*\d+)?$"


def margin_key(line: Column) -> Column:
    """What a margin line counts as: page numbers are all one."""
    return F.when(line.rlike(PAGE_NUMBER), "<PAGE_NUMBER>").otherwise(F.lower(line))


def page_lines(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Non-empty lines with their place counted from the top and from the bottom."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line")))
    held = pages.select(*PAGE, F.filter(lines, lambda x: x["line"] != "").alias("__lines"))
    rows = held.select(*PAGE, F.size("__lines").alias("__n"), F.posexplode("__lines").alias("__i", "__line"))
    return rows.select(*PAGE, "__line.pos", "__line.line", (F.col("__i") + 1).alias("top"), (F.col("__n") - F.col("__i")).alias("bottom"))


def repeated_margins(lines: DataFrame, pages: DataFrame, window: int = 3, longest: int = 140, ratio: float = 0.6, least: int = 3) -> DataFrame:
    """Margin lines that occur on enough pages of a document."""
    near = lines.where((F.col("top") <= window) | (F.col("bottom") <= window)).where(F.length("line") <= longest)
    seen = near.select(*PAGE, margin_key(F.col("line")).alias("key")).distinct().groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("pages"))
    filled = pages.where(page_status(F.col("raw_text")) != "EMPTY").groupBy("document_id").agg(F.count(F.lit(1)).alias("filled"))
    need = F.greatest(F.lit(least), F.floor(F.col("filled") * ratio + 0.999999))
    return seen.join(filled, "document_id").where(F.col("pages") >= need)


def without_margins(lines: DataFrame, margins: DataFrame, window: int = 3) -> DataFrame:
    """Pages again, their repeated margin lines apart."""
    keys = margins.select("document_id", "key", F.lit(True).alias("repeated"))
    marked = lines.withColumn("key", margin_key(F.col("line"))).join(keys, ["document_id", "key"], "left")
    gone = F.coalesce("repeated", F.lit(False)) & ((F.col("top") <= window) | (F.col("bottom") <= window))
    row = F.struct("pos", "line")
    got = marked.groupBy(*PAGE).agg(F.collect_list(F.when(~gone, row)).alias("kept"), F.collect_list(F.when(gone, row)).alias("gone"))
    texts = lambda c: F.transform(F.array_sort(c), lambda x: x["line"])
    return got.select(*PAGE, clean_text(F.array_join(texts("kept"), "\n")).alias("clean_text"), texts("gone").alias("removed_lines"))


#: fixed values: what a chunk may end after, the best first
BREAKS = ["\n\n", "\n", ". ", "; ", ", ", " "]
BLANK = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)


class Ruler:
    """Places of a page where chunks may begin and end, measured once from all of its characters."""

    def __init__(self, text: str):
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        blank = np.isin(letters, BLANK)
        flips = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        self.words, self.ends = np.flatnonzero(flips < 0), np.flatnonzero(flips > 0)  # first letter of each word, place after its last
        self.size = len(letters)
        self.breaks = []
        for mark in BREAKS:
            hit = letters == ord(mark[-1])
            if len(mark) == 2:
                hit = hit & np.concatenate([[False], letters[:-1] == ord(mark[0])])
            self.breaks.append(np.flatnonzero(hit) + 1)  # places after the mark
        self.blanks = np.flatnonzero(blank)

    def stop(self, wanted: int, slack: int) -> int:
        """The last place after the best kind of mark that lies whole in the `slack` characters up to `wanted`."""
        for mark, places in zip(BREAKS, self.breaks):
            k = int(places.searchsorted(wanted, "right"))
            if k and places[k - 1] - len(mark) >= wanted - slack:
                return int(places[k - 1])
        return wanted

    def resume(self, wanted: int, most: int) -> int:
        """The first place from `wanted` on that follows white space."""
        k = int(self.blanks.searchsorted(wanted - 1))
        return min(int(self.blanks[k]) + 1, most) if k < len(self.blanks) else most

    def inked(self, lo: int, hi: int) -> tuple[int, int]:
        """[lo, hi) without white space at either side; empty if there is nothing else."""
        i, j = int(self.ends.searchsorted(lo, "right")), int(self.words.searchsorted(hi)) - 1
        return (max(lo, int(self.words[i])), min(hi, int(self.ends[j]))) if i <= j else (lo, lo)


def cut(text: str, size: int, overlap: int, back: int) -> list[tuple[int, int]]:
    """Offsets of the chunks of one page: each ends after a mark where one is near, and the next one goes back by the
    overlap, to the word that follows."""
    ruler, out, at = Ruler(text), [], 0
    if not len(ruler.words):
        return out
    while at + size < ruler.size:
        end = ruler.stop(at + size, min(back, size - 1))
        out.append(ruler.inked(at, end))
        at = ruler.resume(max(end - overlap, at + 1), end)
    out.append(ruler.inked(at, ruler.size))
    return [(a, b) for a, b in out if a < b]


ROWS = 256  # pages cut together: their text, places and pieces are all that Python holds beside the batch


def chunks(pages: DataFrame, text: str = "clean_text", size: int = 3000, overlap: int = 250, back: int = 500) -> DataFrame:
    """Chunks of at most `size` characters with exact offsets. Greedy inside a page, parallel over pages, Arrow batches.
    A page of one chunk needs no places, only its white space taken off."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than a chunk")

    def spans(t: str) -> list[tuple[int, int]]:
        if len(t) > size:
            return cut(t, size, overlap, back)
        lead = len(t) - len(t.lstrip())
        return [(lead, len(t.rstrip()))] if lead < len(t) else []

    def split(batches):
        for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            texts = batch.column(2).to_pylist()
            found = [spans(t) if t else [] for t in texts]
            n = np.array([len(x) for x in found], np.int64)
            row = np.repeat(np.arange(len(n)), n)
            place = np.array([s for x in found for s in x], np.int32).reshape(-1, 2)
            index = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            pieces = pa.array([t[a:b] for t, x in zip(texts, found) for a, b in x], pa.string())
            head = batch.select(["document_id", "page_number"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*head.columns, pa.array(index.astype(np.int32)), pa.array(place[:, 0].copy()), pa.array(place[:, 1].copy()), pieces], ["document_id", "page_number", "chunk_index", "char_start", "char_end", "text"])

    kind = pages.schema["document_id"].dataType.simpleString()
    out = pages.select("document_id", F.col("page_number").cast("int"), text).mapInArrow(split, f"document_id {kind}, page_number int, chunk_index int, char_start int, char_end int, text string")
    number = lambda c, n: F.lpad(F.col(c).cast("string"), F.greatest(F.lit(n), F.length(F.col(c).cast("string"))), F.lit("0"))  # noqa: E731  # padded, never cut
    name = F.concat(F.col("document_id").cast("string"), F.lit(":p"), number("page_number", 4), F.lit(":c"), number("chunk_index", 3))
    return out.select(name.alias("chunk_id"), "*")


def stats(pages: DataFrame) -> DataFrame:
    status = page_status(F.col("raw_text"))
    return pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        *(F.count_if(status == s).alias(n) for s, n in (("NATIVE_TEXT", "native_pages"), ("LOW_TEXT", "low_pages"), ("EMPTY", "empty_pages"))),
        F.sum(F.length("raw_text")).alias("raw_chars"),
    )


def second_reading(pages: DataFrame, readings: DataFrame) -> DataFrame:
    """Poor pages take a non-empty second reading (document_id, page_number, reading); others keep their text."""
    out = pages.join(readings, PAGE, "left")
    poor = page_status(F.col("raw_text")).isin("LOW_TEXT", "EMPTY") & (F.trim("reading") != "")
    taken = F.coalesce(poor, F.lit(False))
    return out.withColumn("text_origin", F.when(taken, "SECOND_READING").otherwise("NATIVE")).withColumn("raw_text", F.when(taken, F.col("reading")).otherwise(F.col("raw_text"))).drop("reading")


def unusable(pages: DataFrame) -> DataFrame:
    """Documents without any text."""
    return pages.groupBy("document_id").agg(F.sum(F.length(F.coalesce(clean_text(F.col("raw_text")), F.lit("")))).alias("chars")).where("chars <= 0").select("document_id")

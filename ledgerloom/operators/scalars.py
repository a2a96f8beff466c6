"""Values that a fixed pattern finds in the raw pages of a document, with the page and line they stand on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import strip, version

#: fixed values: a registry number, and a document's version as a month's name and year or as year and month
PROCESS = r"\d{5}\.\d{6}/\d{4}-\d{2}"
MONTH = r"(?:janeiro|fevereiro|mar(?:ç|c)o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)"
VERSION = rf"{MONTH}\s*/\s*\d{{4}}|\d{{4}}-\d{{2}}"


@dataclass(frozen=True)
class Scalar:
    """A value to look for: its pattern, what stands before it (a pattern), the section that its evidence names, and how far to look."""

    name: str
    pattern: str
    before: str = ""
    section: str = ""
    last_page: int | None = None
    canonical: bool = False  # months by name become year and month


FOUND = [Scalar("susep_process", PROCESS, r"(?:Processo\s+SUSEP\s*(?:n[ºo°.]*)?\s*[:-]?\s*)?", "Processo SUSEP"), Scalar("document_version", VERSION, r"Vers[ãa]o\s+", "Versão do documento", 8, True)]


def hit(text: Column, scalar: Scalar, group: int) -> Column:
    """The first hit of a text: its line or lines whole (0) or the value (1). Anchored at the lines' begins, so that a line without a hit is
    read once for each place where the pattern could begin, not once for each pair of places."""
    return F.regexp_extract(text, rf"(?Uimd)^[^\n]*?{scalar.before}({scalar.pattern})[^\n]*", group)


def found_scalars(pages: DataFrame, scalars: list[Scalar] = FOUND, text: str = "raw_text") -> DataFrame:
    """(document_id, name, value, raw_value, page_number, section, excerpt): each scalar's hit on the first page of a document that has one. All scalars in one
    pass and one exchange of first hits; margins are read, too, so raw pages are asked for. Pages without text or number have no hits; of two
    pages of one number the smaller text counts."""
    one = lambda s: F.struct(F.lit(s.name).alias("name"), F.lit(s.section).alias("section"), F.lit(s.canonical).alias("canonical"), hit(F.col(text), s, 1).alias("raw_value"), strip(hit(F.col(text), s, 0)).alias("excerpt"))
    asked = [F.when(F.col("page_number") <= s.last_page, one(s)) if s.last_page else one(s) for s in scalars]
    hits = pages.where(F.col("page_number").isNotNull()).select("document_id", "page_number", F.explode(F.array(*asked)).alias("hit")).where("hit.raw_value <> ''")
    first = hits.groupBy("document_id", "hit.name").agg(F.min(F.struct("page_number", "hit")).alias("first"))
    rows = first.select("document_id", "name", "first.page_number", "first.hit.section", "first.hit.canonical", strip(F.col("first.hit.raw_value")).alias("raw_value"), "first.hit.excerpt")
    value = F.when(F.col("canonical"), version(F.col("raw_value"))).otherwise(F.col("raw_value"))
    return rows.select("document_id", "name", value.alias("value"), "raw_value", "page_number", "section", F.coalesce(F.nullif("excerpt", F.lit("")), F.col("raw_value")).alias("excerpt"))

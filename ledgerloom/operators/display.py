"""Display text of values and names of records, by the kind of value.

Values are JSON texts, as comparison cells carry them: a string, a number, an object (money, period, item with its value inside) or a list. Text that is not
JSON, and null, are values without content.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.text import fold, shortened, squeeze

#: fixed values: words of the display forms
NOTHING, STRUCTURED, OCCURRENCES, CONDITIONS, EXCEPTIONS, DOCUMENT, RECORD = "Não identificado", "Dados estruturados disponíveis", "ocorrência(s)", "Condições: ", "Exceções: ", "Documento", "Apólice"
#: fixed values: what of a normalized value is shown where it has no text of its own
SHOWN_KEYS = ["kind", "numeric_value", "currency", "unit"]


def kind_of(value: Column) -> Column:
    """object, list, text, plain (number or boolean) or none (null, empty or no JSON)."""
    head = F.left(F.ltrim(value), F.lit(1))
    return (
        F.when(value.isNull() | (F.trim(value) == "") | (F.trim(value) == "null"), "none")
        .when(F.try_parse_json(value).isNull(), "none")
        .when(head == "{", "object")
        .when(head == "[", "list")
        .when(head == '"', "text")
        .otherwise("plain")
    )


def get(value: Column, *path: str) -> Column:
    """A field's text, null where it is missing, null or empty."""
    return F.nullif(F.get_json_object(value, "$." + ".".join(path)), F.lit(""))


def plain_text(value: Column) -> Column:
    """A JSON string without its quotes; other JSON as it is."""
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"), value)


def texts(value: Column) -> Column:
    """The entries of a JSON list as texts."""
    return F.from_json(value, "array<string>")


def day(text: Column) -> Column:
    """dd/MM/yyyy of a text that begins with an ISO date; another text as it is."""
    parsed = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    return F.coalesce(F.date_format(parsed, "dd/MM/yyyy"), text)


def between(start: Column, end: Column, word: str) -> Column:
    """Both ends of a period with `word` between, ? for one that is missing; null without any."""
    some = start.isNotNull() | end.isNotNull()
    return F.when(some, F.concat(F.coalesce(start, F.lit("?")), F.lit(word), F.coalesce(end, F.lit("?"))))


def structured(value: Column, nested: bool = True) -> Column:
    """What a reader of the matrix sees of a value: a period by its days, an item by the value inside it, money by the text it was read from, else by
    its normalized text, else by its parts; a list by its length."""
    period = between(day(get(value, "start")), day(get(value, "end")), " a ")
    inner = F.when(get(value, "value").startswith("{"), structured(get(value, "value"), nested=False)) if nested else F.lit(None).cast("string")
    parts = F.array_join(F.array_compact(F.array(*(get(value, k) for k in SHOWN_KEYS))), " · ")
    of_object = F.coalesce(period, inner, get(value, "raw_text"), get(value, "normalized_text"), F.nullif(parts, F.lit("")), F.lit(STRUCTURED))
    return by_kind(value, of_object)


def by_kind(value: Column, of_object: Column, of_list: Column | None = None) -> Column:
    kind = kind_of(value)
    listed = F.concat(F.json_array_length(value).cast("string"), F.lit(f" {OCCURRENCES}")) if of_list is None else of_list
    return F.when(kind == "none", NOTHING).when(kind == "object", of_object).when(kind == "list", listed).otherwise(plain_text(value))


def cell_text(present: Column, status: Column, name: Column, value: Column, statuses: dict[str, str] = {}) -> Column:
    """A cell of the matrix: what is absent shows its status, in the words of `statuses` or its own; a value with a form of its own (money, period, item with
    value) shows that; anything else shows the name it has in the source, else its structured text."""
    own = F.coalesce(*(get(value, k) for k in ("value", "raw_text", "normalized_text", "start", "end")))
    known = F.lit(None).cast("string")
    for key, words in statuses.items():
        known = F.when(status == key, words).otherwise(known)
    absent = F.coalesce(known, F.initcap(F.replace(status, F.lit("_"), F.lit(" "))), F.lit(NOTHING))
    named = F.when((kind_of(value) == "object") & own.isNotNull(), structured(value)).otherwise(F.coalesce(F.nullif(name, F.lit("")), structured(value)))
    return F.when(F.coalesce(present, F.lit(False)), named).otherwise(absent)


def report_text(present: Column, status: Column, name: Column, value: Column, pages: Column, longest: int = 140) -> Column:
    """A cell of the written report: one line of `longest` characters at most and the pages it is on. Absent cells show their status. Objects without text of
    their own stand as JSON."""
    of_object = F.coalesce(F.get_json_object(value, "$.raw_text"), between(get(value, "start"), get(value, "end"), " → "), value)
    base = F.coalesce(F.nullif(name, F.lit("")), by_kind(value, of_object))
    sheets = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(pages, F.array().cast("array<int>")))))
    where = F.when(F.size(sheets) > 0, F.concat(F.lit(" [p."), F.array_join(sheets, ","), F.lit("]"))).otherwise("")
    absent = F.concat(F.lit("— ("), F.coalesce(status, F.lit("NOT_FOUND")), F.lit(")"))
    return F.when(F.coalesce(present, F.lit(False)), F.concat(shortened(squeeze(base), longest), where)).otherwise(absent)


def answer_text(value: Column, nested: bool = True, longest: int = 1200, longest_json: int = 700) -> Column:
    """A value as answers quote it: money by its text, a period by its ends, an item by the value inside it, else by its description and the first three
    conditions and exceptions; a list by its first eight entries."""
    inner = F.when(get(value, "value").startswith("{"), answer_text(get(value, "value"), nested=False)) if nested else F.lit(None).cast("string")
    first = lambda key, word: F.when(F.json_array_length(get(value, key)) > 0, F.concat(F.lit(word), F.array_join(F.slice(texts(get(value, key)), 1, 3), "; ")))
    described = F.concat_ws(" | ", get(value, "description"), first("conditions", CONDITIONS), first("exceptions", EXCEPTIONS))
    item = F.when(get(value, "description").isNotNull(), F.left(described, F.lit(longest)))
    of_object = F.coalesce(get(value, "raw_text"), get(value, "normalized_text"), between(get(value, "start"), get(value, "end"), " a "), inner, item, F.left(value, F.lit(longest_json)))
    return by_kind(value, of_object, F.array_join(F.slice(texts(value), 1, 8), "; "))


def record_label(insurer_status: Column, insurer: Column, product_status: Column, product: Column, record_id: Column) -> Column:
    """Insurer and product, as far as both are found; else the record's id."""
    found = lambda status, value: F.when(status == "FOUND", F.nullif(value, F.lit("")))
    both = F.concat_ws(" — ", found(insurer_status, insurer), found(product_status, product))
    return F.coalesce(F.nullif(both, F.lit("")), record_id)


def known_name(text: Column, known: dict[str, str]) -> Column:
    """The short name of the first key of `known` (folded text) that a text holds; null if it holds none."""
    key, out = fold(text), F.lit(None).cast("string")
    for needle, short in reversed(known.items()):
        out = F.when(F.contains(key, F.lit(needle)), short).otherwise(out)
    return out


def short_label(label: Column, known: dict[str, str], longest: int = 80) -> Column:
    """A label's known short name, else its part before the dash."""
    return F.coalesce(known_name(label, known), F.left(F.split_part(F.coalesce(label, F.lit("")), F.lit(" — "), F.lit(1)), F.lit(longest)))


def column_label(insurer: Column, product: Column, known: dict[str, str], longest: int = 32) -> Column:
    """The head of a matrix column: the insurer by its known short name or cut, else the product."""
    name = lambda c: F.nullif(F.trim(c), F.lit(""))
    own = F.when(name(insurer) != NOTHING, F.left(name(insurer), F.lit(longest)))
    return F.coalesce(known_name(insurer, known), own, F.left(name(product), F.lit(longest)), F.lit(RECORD))


def file_label(path: Column, prefix: str = "") -> Column:
    """A file's stem as words, each with a capital, without a common prefix (a pattern)."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    if prefix:
        stem = F.regexp_replace(stem, f"(?i)^{prefix}", "")
    words = squeeze(F.translate(stem, "_-", "  "))
    return F.when(words == "", DOCUMENT).otherwise(F.initcap(words))

"""Scalar text and value rules as column functions; all stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

BLANKS = r"[\s\x{00a0}\x{2007}\x{202f}\x{3000}]+"


def ranges(letters: list[int]) -> str:
    """A pattern's character class of code points in ascending order."""
    out, begin = [], 0
    for i, x in enumerate(letters):
        if i + 1 == len(letters) or letters[i + 1] != x + 1:
            out.append(rf"\x{{{letters[begin]:x}}}-\x{{{x:x}}}")
            begin = i + 1
    return f"[{''.join(out)}]"


def folded_letter(letter: str) -> str:
    """What a letter is compared as: case folded, without the marks of its compatibility decomposition."""
    return "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c)).casefold()


def folding() -> tuple[str, str, str, str]:
    """By that rule, over the planes that have letters with a decomposition: letters that fold to one and what they fold to, marks (which fold to
    nothing) last; the pattern of letters that fold to several (ligatures, fractions, squared words), and these letters each
    with what it folds to. Texts are in lower case before. Syllables of Hangul stay whole."""
    lower = [chr(x) for x in range(0x80, 0x30000) if not 0xD800 <= x < 0xE000 and not 0xAC00 <= x < 0xD7A4 and chr(x).lower() == chr(x)]
    changed = {c: to for c in lower if (to := folded_letter(c)) != c}
    one = {c: to for c, to in changed.items() if len(to) == 1}
    many = {c: to for c, to in changed.items() if len(to) > 1 and c not in COMMON}
    # blocks first: a class of hundreds of ranges is slow to leave
    blocks = ranges([x for block in sorted({ord(c) >> 8 for c in many}) for x in range(block << 8, block + 1 << 8) if x > 0x7F])
    return "".join([*one, *(c for c, to in changed.items() if not to)]), "".join(one.values()), f"(?={blocks}){ranges([*map(ord, many)])}", "\1".join(c + to for c, to in many.items())


COMMON = "ßﬀﬁﬂﬃﬄ…"  # letters that fold to several in ordinary text
LETTERS, PLAIN, LIGATURE, LIGATURES = folding()


def fold_marks(text: Column) -> Column:
    """Case folded without marks, of the compatibility decomposition; punctuation and line breaks stay. Texts of ASCII alone are only put in
    lower case; the several hundred rare letters that fold to more than one are looked for where there is any."""
    low = F.lower(text)
    for letter in COMMON:
        low = F.replace(low, F.lit(letter), F.lit(folded_letter(letter)))
    each = F.aggregate(F.split(F.lit(LIGATURES), "\1"), low, lambda t, x: F.replace(t, F.left(x, F.lit(1)), F.substr(x, F.lit(2))))
    plain = F.translate(F.when(F.rlike(low, F.lit(LIGATURE)), each).otherwise(low), LETTERS, PLAIN)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(plain)


def fold(text: Column) -> Column:
    """Comparison key: case folded, no marks, every run of other characters one blank."""
    return F.trim(F.regexp_replace(fold_marks(text), "[^a-z0-9]+", " "))


def squeeze(text: Column) -> Column:
    """Case kept, every run of white space one blank."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def fold_squeeze(text: Column) -> Column:
    return squeeze(fold_marks(text))


def clean_text(text: Column) -> Column:
    """Page text: no NUL, line feeds only, lines stripped and squeezed, at most one empty line between others."""
    text = F.replace(text, F.lit("\0"), F.lit(""))
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t\x{00a0}]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def decimal_key(value: Column) -> Column:
    """Plain notation of a decimal without trailing zeros; null gives ''."""
    text = value.cast("decimal(38,6)").cast("string")
    return F.coalesce(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""), F.lit(""))


def snake(text: Column) -> Column:
    return snake_of(fold(text))


def snake_of(key: Column) -> Column:
    return F.upper(F.replace(key, F.lit(" "), F.lit("_")))


def canonical(text: Column, rules: list[tuple[list[str], str]]) -> Column:
    """Code of the first rule (all of its needles contained in the folded text), else the text in upper snake case."""
    key, out = fold(text), snake(text)
    for needles, code in reversed(rules):
        test = F.lit(True)
        for needle in needles:
            test = test & F.contains(key, F.lit(needle))
        out = F.when(test, F.lit(code)).otherwise(out)
    return F.when(text.isNotNull(), out)


def date_or_null(text: Column) -> Column:
    return F.try_to_date(F.trim(text), "yyyy-MM-dd")


def duration(text: Column) -> Column:
    """(number, unit) of a text such as '12,5 meses'; units are never converted."""
    number = F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)", 1)
    key = fold(text)
    unit = F.when(F.contains(key, F.lit("mes")), "months").when(F.contains(key, F.lit("ano")), "years").when(F.contains(key, F.lit("dia")), "days")
    return F.struct(F.replace(number, F.lit(","), F.lit(".")).try_cast("decimal(18,3)").alias("number"), unit.alias("unit"))


#: fixed values: month names as dictionaries write them, folded
MONTHS = "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro".split()


def version(text: Column) -> Column:
    """Document version: 'YYYY-MM' kept, '<month name>/YYYY' turned into it, anything else trimmed."""
    key = fold_marks(F.trim(text))
    months = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02d}")))
    month = F.try_element_at(months, F.regexp_extract(key, r"^([a-z]+)\s*/\s*\d{4}$", 1))
    plain = F.when(F.trim(text).rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.trim(text))
    named = F.when(month.isNotNull(), F.concat(F.regexp_extract(key, r"(\d{4})$", 1), F.lit("-"), month))
    return F.coalesce(plain, named, F.trim(text))


def in_domain(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(F.lit(default))


def term_count(folded: Column, term: Column) -> Column:
    """Whole occurrences of a folded term (letters, digits, blanks) in a folded text."""
    return F.regexp_count(folded, F.concat(F.lit("(?<![a-z0-9])"), term, F.lit("(?![a-z0-9])"))).cast("long")


def whole_count(folded: Column, term: Column) -> Column:
    """As term_count(), by replacing instead of a pattern for each row: words and terms stand between blanks of their own."""
    apart = lambda c: F.concat(F.lit(" "), F.replace(c, F.lit(" "), F.lit("  ")), F.lit(" "))
    return substring_count(apart(folded), apart(term))


def substring_count(text: Column, needle: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")


def tokens(text: Column, stop: list[str] = []) -> Column:
    """Distinct folded tokens of two characters or more that are no stop words, in order of appearance."""
    words = F.array_distinct(F.filter(F.split(fold(text), " "), lambda t: F.length(t) >= 2))
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def heading_score(line: Column, term: Column) -> Column:
    """How much a line looks like the heading of a folded term: numbered 320 / 270 with a remainder, plain 220 / 160."""
    key = fold(line)
    plain, numbered = F.concat(F.lit("^"), term), F.concat(F.lit(r"^(?:\d+ )+"), term)
    exact, more = F.lit("$"), F.lit(" ")
    return F.when(F.rlike(key, F.concat(numbered, exact)), 320).when(F.rlike(key, F.concat(numbered, more)), 270).when(F.rlike(key, F.concat(plain, exact)), 220).when(F.rlike(key, F.concat(plain, more)), 160).otherwise(0)


def line_around(text: Column, pattern: str) -> Column:
    """The whole line that holds the first match of a pattern, or ''."""
    return F.trim(F.regexp_extract(text, rf"(?i)[^\n]*(?:{pattern})[^\n]*", 0))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def escaped(text: Column) -> Column:
    """Safe inside a table cell: bars escaped, line breaks blank."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit(r"\|")), r"\s*\n\s*", " ")


def without_rule_references(text: Column) -> Column:
    """Bracketed, parenthesised or plain mentions of internal rule numbers go, with the spacing around them repaired."""
    number = r"(?:regras?|rules?)\s+\d+(?:\s*(?:,|e|and)\s*\d+)*"
    for pattern, to in ((rf"(?i)\s*[\[(]\s*{number}\s*[\])]", ""), (rf"(?i)\s*\b(?:conforme|segundo|per|by)\s+(?:a\s+|as\s+)?{number}", ""), (rf"(?i)\b{number}\s*", ""), (r"[ \t]{2,}", " "), (r"\s+([.,;:!?])", "$1")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def first_mention_marked(text: Column, name: Column, mark: str) -> Column:
    """The first mention of a name gets a mark, unless the text already has one."""
    at = F.instr(text, name)
    put = F.concat(F.substring(text, F.lit(1), at + F.length(name) - 1), F.lit(mark), F.substring(text, at + F.length(name), F.length(text)))
    return F.when((at > 0) & ~F.contains(text, F.concat(name, F.lit(mark))), put).otherwise(text)


def slug(text: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(key == "", "document").otherwise(key)


def document_id(name: Column, content: Column) -> Column:
    """Slug of the file's stem and ten hex digits of its content's hash."""
    stem = F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"\.[^.]*$", "")
    return F.concat(slug(stem), F.lit("-"), F.substring(F.sha2(content, 256), 1, 10))

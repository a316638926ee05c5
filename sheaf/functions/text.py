"""Scalar text functions as Column expressions.

White space is what a JavaScript trim takes: the class below, spelled out since Spark's
trim and Java's \\s know fewer characters. Word borders are ASCII ones, by look-around,
since Java takes accented letters for word characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space.
SPACES = r"\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS = f"[{SPACES}]"
#: The same characters as a text, for native trims.
SPACE_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

#: Section types and the headings that open them.
SECTION_ALIASES = {
    "summary": ["summary", "profile", "professional summary"],
    "employment": ["employment", "experience", "work experience", "professional experience", "work history", "professional history"],
    "education": ["education"],
    "projects": ["projects", "personal projects", "selected projects"],
    "achievements": ["achievements", "awards", "additional experience and awards", "additional experience", "honors and awards"],
    "skills": ["skills", "technical skills", "technologies", "languages, technologies and tools", "languages and technologies"],
    "certifications": ["certifications", "licenses and certifications"],
}

_DATE = rf"(?:[A-Za-z]+{WS}+)?[0-9]{{4}}"
_END = rf"(?:[A-Za-z]+{WS}+)?(?:[0-9]{{4}}|present|current|now)"
#: Fixed pattern: a range of years, each with a word before it or not, the end also open.
DATE_RANGE = rf"({_DATE}){WS}*(?:-|–|—|to){WS}*({_END})"
LONE_DATE = rf"^(?:[A-Za-z]+{WS}+)?[0-9]{{4}}\z"
#: A bullet is one of these marks, white space, and a rest on one line.
MARKS = "-*•●"
MARKDOWN_HEADING = rf"^#{{2,4}}{WS}+([^\n\r\x{{2028}}\x{{2029}}]+)\z"
PAGE_MARK = rf"(?i)^--{WS}*[0-9]+{WS}+of{WS}+[0-9]+{WS}*--\z"
EDUCATION = rf"(?i){BEFORE}(?:(?:degree|education|educational|bachelor|bs|computer science){AFTER}|b\.s\.(?=[A-Za-z0-9_]))"
CLOSING = rf"(?i)(?:^|\n){WS}*(?:regards|sincerely|best regards|kind regards),?{WS}*(?:\n|\z)"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_js(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACE_CHARS))


def has_text(x: Column) -> Column:
    return F.coalesce(F.length(trim_js(x)) > 0, F.lit(False))


def strip_heading(line: Column) -> Column:
    return trim_js(F.ltrim(line, F.lit("#")))


def normalize_heading(line: Column) -> Column:
    bare = strip_heading(line)
    return F.lower(F.when(bare.endswith(":"), F.left(bare, F.length(bare) - 1)).otherwise(bare))


def section_type(line: Column) -> Column:
    """The type of section that a heading line opens, or null. A literal map: no join."""
    pairs = [F.lit(x) for kind, names in SECTION_ALIASES.items() for name in names for x in (name, kind)]
    # Small letters are no fewer than the letters they come from: longer lines need no look.
    longest = max(len(name) for names in SECTION_ALIASES.values() for name in names) + 1
    return F.when(F.length(strip_heading(line)) <= longest, F.try_element_at(F.create_map(*pairs), normalize_heading(line)))


def has_year(line: Column) -> Column:
    """Cheap, and true of every line with a date: most lines need no look at the longer patterns."""
    return line.rlike("[0-9]{4}")


def date_before(line: Column) -> Column:
    """What comes before the first date range; null without one."""
    return F.when(has_year(line) & line.rlike(f"(?i){DATE_RANGE}"), F.regexp_extract(line, rf"(?i)^([\s\S]*?){DATE_RANGE}", 1))


def date_range(line: Column) -> Column:
    """struct(start, end) if the first date range ends within two characters of the line's end, else null."""
    whole = F.regexp_extract(line, rf"(?i)^([\s\S]*?{DATE_RANGE})", 1)
    near = F.length(whole) >= F.length(line) - 2
    parts = F.struct(trim_js(F.regexp_extract(line, f"(?i){DATE_RANGE}", 1)).alias("start"), trim_js(F.regexp_extract(line, f"(?i){DATE_RANGE}", 2)).alias("end"))
    return F.when(has_year(line) & line.rlike(f"(?i){DATE_RANGE}") & near, parts)


def dated(line: Column) -> Column:
    """struct(before, start, end, near) of the first date range of a text without line breaks, by one look at it; null without one. ``near``: as in ``date_range``."""
    cut = F.split(F.regexp_replace(line, rf"(?i)^([^\n]*?){DATE_RANGE}([^\n]*)\z", "$1\n$2\n$3\n$4"), "\n")
    found = lambda c: F.when(F.size(c) == 4, F.struct(trim_js(F.get(c, F.lit(0))).alias("before"), trim_js(F.get(c, F.lit(1))).alias("start"), trim_js(F.get(c, F.lit(2))).alias("end"), (F.length(F.get(c, F.lit(3))) <= 2).alias("near")))
    return F.when(has_year(line), F.get(F.transform(F.array(cut), found), F.lit(0)))


def lone_date(line: Column) -> Column:
    return has_year(line) & (line.rlike(f"(?i){DATE_RANGE}") | line.rlike(LONE_DATE))


def bullet_body(line: Column) -> Column:
    """What follows the mark, trimmed; null where the line is no bullet. White space alone is a bullet of its last character."""
    rest = F.substring(line, 2, 2**31 - 1)
    body = F.ltrim(rest, F.lit(SPACE_CHARS))
    broken = lambda x: x.contains("\n") | x.contains("\r") | x.contains("\u2028") | x.contains("\u2029")
    is_bullet = F.left(line, F.lit(1)).isin(*MARKS) & F.left(rest, F.lit(1)).isin(*SPACE_CHARS)
    empty = F.when((F.length(rest) > 1) & ~broken(F.right(rest, F.lit(1))), "")
    return F.when(is_bullet, F.when(body == "", empty).when(~broken(body), F.rtrim(body, F.lit(SPACE_CHARS))))


def parts_of(x: Column, pattern: str) -> Column:
    """Trimmed parts that are not empty."""
    return F.filter(F.transform(F.split(x, pattern), trim_js), lambda p: p != "")


def role_company(heading: Column) -> Column:
    """struct(role, company) of a markdown heading: the first comma-separated part and the rest."""
    parts = parts_of(heading, ",")
    many = F.size(parts) >= 2
    return F.struct(F.when(many, F.get(parts, F.lit(0))).otherwise(heading).alias("role"), F.when(many, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), ", ")).alias("company"))


def normalize_for_match(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def same_meaning(a: Column, b: Column) -> Column:
    """Either holds the other, both normalised by ``normalize_for_match``. Symmetric, not transitive; the empty text is in all."""
    return F.contains(a, b) | F.contains(b, a)


def match_score(a: Column, b: Column, weight: int) -> Column:
    full = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(F.coalesce(full & same_meaning(normalize_for_match(a), normalize_for_match(b)), F.lit(False)), weight).otherwise(0)


def mentions_education(x: Column) -> Column:
    return F.coalesce(x.rlike(EDUCATION), F.lit(False))


def technology_spacing(x: Column) -> Column:
    x = F.regexp_replace(x, rf"(?i){BEFORE}(Node|React|Next|Vue|Express|Angular)\.{WS}+js{AFTER}", "$1.js")
    return F.regexp_replace(x, rf"(?i){BEFORE}Postgre{WS}+SQL{AFTER}", "PostgreSQL")


def sentences(x: Column) -> Column:
    """Runs up to closing marks and what quotes or brackets follow, and a last one without; the whole text where there is none."""
    found = F.regexp_extract_all(x, F.lit(r"""[^.!?]+[.!?]+(?:["')\]]+)?|[^.!?]+\z"""), F.lit(0))
    return F.when(F.size(found) > 0, F.filter(F.transform(found, trim_js), lambda s: s != "")).otherwise(F.array(trim_js(x)))


def has_closing(x: Column) -> Column:
    return x.rlike(CLOSING)


def sanitize_path(x: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(trim_js(x), "[^a-zA-Z0-9]+", "_"), r"^_+|_+\z", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("candidate"))

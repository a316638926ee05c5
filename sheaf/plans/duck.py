"""DuckDB expressions and tables that say in SQL what the operators say in Spark."""

from __future__ import annotations

from sheaf.functions.text import SECTION_ALIASES, SPACES
from sheaf.plans.corpora import RESUMES_SQL, quoted

WS = f"[{SPACES.replace(chr(92) + 'x0B', chr(92) + 'x0b')}]"
DATE = rf"((?:[A-Za-z]+{WS}+)?[0-9]{{4}}){WS}*(?:-|–|—|to){WS}*((?:[A-Za-z]+{WS}+)?(?:[0-9]{{4}}|present|current|now))"
MARKDOWN = rf"^#{{2,4}}{WS}+([^\n\r]+)$"
BULLET = rf"^(?:[-*•●]{WS}+)([^\n\r]+)$"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def strip_heading(x: str) -> str:
    return trim(f"regexp_replace({x}, '^#+{WS}*', '')")


def normalize_heading(x: str) -> str:
    return f"lower(regexp_replace({strip_heading(x)}, ':$', ''))"


def section_type(x: str) -> str:
    whens = " ".join(f"when {quoted(name)} then {quoted(kind)}" for kind, names in SECTION_ALIASES.items() for name in names)
    return f"case {normalize_heading(x)} {whens} end"


def has_range(x: str) -> str:
    """The first date range ends within two characters of the end."""
    return f"(regexp_matches({x}, '{DATE}', 'i') and length(regexp_extract({x}, '^([\\s\\S]*?(?:{DATE}))', 1, 'i')) >= length({x}) - 2)"


def range_part(x: str, k: int) -> str:
    return trim(f"regexp_extract({x}, '{DATE}', {k}, 'i')")


def before_range(x: str) -> str:
    return trim(f"regexp_extract({x}, '^([\\s\\S]*?)(?:{DATE})', 1, 'i')")


def parts(x: str, pattern: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{pattern}'), lambda p: {trim('p')}), lambda p: p <> '')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def same(a: str, b: str) -> str:
    return f"(contains({a}, {b}) or contains({b}, {a}))"


def score(a: str, b: str, w: int) -> str:
    return f"(case when coalesce({a}, '') <> '' and coalesce({b}, '') <> '' and {same(norm(a), norm(b))} then {w} else 0 end)"


EDUCATION = r"\b(degree|education|educational|bachelor|b\.s\.|bs|computer science)\b"


def mentions_education(x: str) -> str:
    return f"regexp_matches({x}, '{EDUCATION}', 'i')"


def spacing(x: str) -> str:
    x = f"regexp_replace({x}, '\\b(Node|React|Next|Vue|Express|Angular)\\.{WS}+js\\b', '\\1.js', 'gi')"
    return f"regexp_replace({x}, '\\bPostgre{WS}+SQL\\b', 'PostgreSQL', 'gi')"


def sentences(x: str) -> str:
    found = f"regexp_extract_all({x}, '[^.!?]+[.!?]+(?:[\"'')\\]]+)?|[^.!?]+$')"
    return f"(case when len({found}) > 0 then list_filter(list_transform({found}, lambda s: {trim('s')}), lambda s: s <> '') else [{trim(x)}] end)"


def closing(x: str) -> str:
    return f"regexp_matches({x}, '(?:^|\\n){WS}*(regards|sincerely|best regards|kind regards),?{WS}*(?:\\n|$)', 'i')"


def sanitize(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace({trim(x)}, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'candidate')"


def parse_ctes(docs_sql: str = RESUMES_SQL) -> str:
    """lines, marked and parsed as the operators have them."""
    md = f"regexp_matches(line, '{MARKDOWN}')"
    title = trim(f"regexp_extract(line, '{MARKDOWN}', 1)")
    plain_parts = parts(before_range("line"), f"\\t+|{WS}{{2,}}|{WS}+\\|{WS}+")
    return f"""with docs as materialized ({docs_sql}),
 split0 as (select doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) raw, generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) k from docs),
 lines as materialized (select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int pos, line from (select doc_id, k, {trim('raw')} line from split0) where line <> '' and not regexp_matches(line, '^--{WS}*[0-9]+{WS}+of{WS}+[0-9]+{WS}*--$', 'i')),
 m1 as (select *, {section_type('line')} opens, lead(line) over (partition by doc_id order by pos) nl from lines),
 m2 as (select *, count(opens) over w section_id, last_value(opens ignore nulls) over w section_type, {has_range("coalesce(nl, '')")} nd, {md} md from m1 window w as (partition by doc_id order by pos rows unbounded preceding)),
 m3 as (select *, coalesce(opens is null and section_type = 'employment' and md and nd, false) candidate from m2),
 m4 as (select *, last_value(case when not candidate then pos end ignore nulls) over (partition by doc_id order by pos rows unbounded preceding) rs from m3),
 m5 as (select *, candidate and (pos - coalesce(rs, -1)) % 2 = 1 accepted from m4),
 m6 as (select *, coalesce(lag(accepted) over (partition by doc_id order by pos), false) is_date, {title} title, {plain_parts} pp from m5),
 m7 as (select *, {parts('title', ',')} tp, not accepted and not md and not is_date and coalesce(opens is null and section_type = 'employment', false) and {has_range('line')} and len(pp) >= 2 plain from m6),
 marked as (select *, accepted or plain is_head from m7),
 i1 as (select *, (count(case when is_head then 1 end) over (partition by doc_id, section_id order by pos rows unbounded preceding))::int item_id from marked),
 i2 as (select *, opens is null and item_id > 0 and not is_head and not is_date inside from i1),
 i3 as (select *, case when inside and regexp_matches(line, '{BULLET}') then {trim(f"regexp_extract(line, '{BULLET}', 1)")} end body from i2),
 i4 as (select *, (count(body) over (partition by doc_id, section_id, item_id order by pos rows unbounded preceding))::int bullet_id from i3),
 parsed as materialized (select *, case when body is not null then body when inside and bullet_id > 0 and not (regexp_matches(line, '{DATE}', 'i') or regexp_matches(line, '^(?:[A-Za-z]+{WS}+)?[0-9]{{4}}$')) then line end piece from i4)
"""


ITEMS = f"""select doc_id, section_id, item_id, case when accepted then title else {before_range('line')} end heading,
 case when accepted then case when len(tp) >= 2 then tp[1] else title end else pp[1] end as role,
 case when accepted then case when len(tp) >= 2 then array_to_string(tp[2:], ', ') end else pp[2] end company,
 case when accepted then null else pp[3] end as location,
 case when accepted then {range_part('nl', 1)} else {range_part('line', 1)} end start_date,
 case when accepted then {range_part('nl', 2)} else {range_part('line', 2)} end end_date
 from parsed where is_head"""
BULLETS = f"select doc_id, section_id, item_id, bullet_id, {trim('b')} bullet from (select doc_id, section_id, item_id, bullet_id, string_agg(piece, ' ' order by pos) b from parsed where piece is not null group by 1, 2, 3, 4)"
SECTIONS = f"select doc_id, section_id, max(opens) as type, {strip_heading('max(case when opens is not null then line end)')} heading, coalesce(string_agg(case when opens is null and (item_id = 0 or is_head) then line end, '|' order by pos), '') content from parsed where section_id > 0 group by 1, 2"

"""Queries of the parsing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.operators import parsing as P
from sheaf.plans import duck as D
from sheaf.plans.corpora import HEADING_COLUMNS, RESUMES_SQL, literal, resumes, values_sql, with_table, with_table_sql

HEADINGS = [(1, "## Experience"), (2, "EXPERIENCE:"), (3, "Skills :"), (4, "#Profile"), (5, "Languages, Technologies and Tools:"), (6, "Summary::"), (7, "the education"), (8, "Licenses and Certifications"), (9, "# # Awards"), (10, "####   honors and awards:")]
DATES = [(1, "2021-2025"), (2, "Jan 2020 – Present"), (3, "2018 to 2020"), (4, "2018 - 2020)"), (5, "2018 - 2020 abc"), (6, "05/2018 - 06/2020"), (7, "Jan. 2018 - Feb. 2020"), (8, "x 2018—now"), (9, "no date"), (10, "1999-2000 and 2001-2002"), (11, "May 2018 - CURRENT"), (12, "12345-67890"), (13, "2010-2011"), (14, "Engineer\tAcme\t2018 - 2020")]


def prs1_lines(spark, sf_dir):
    return P.lines(resumes(spark, sf_dir)).drop("doc_key")


def prs2_strip_heading(spark, sf_dir):
    rows = with_table(spark, sf_dir, HEADINGS, "id long, line string", "part", HEADING_COLUMNS)
    return rows.select("id", T.strip_heading(F.col("line")).alias("stripped"), T.normalize_heading(F.col("line")).alias("normalized"))


def prs4_section_type(spark, sf_dir):
    return P.lines(resumes(spark, sf_dir)).select("doc_id", "pos", T.section_type(F.col("line")).alias("section_type")).where("section_type is not null").unionByName(literal(spark, HEADINGS, "id int, line string").select(F.col("id").cast("long").alias("doc_id"), F.lit(-1).alias("pos"), T.section_type(F.col("line")).alias("section_type")))


def prs6_date_range(spark, sf_dir):
    r = T.date_range(F.col("line"))
    own = literal(spark, DATES, "id int, line string").select(F.col("id").cast("long").alias("doc_id"), F.lit(-1).alias("pos"), "line")
    return P.lines(resumes(spark, sf_dir)).drop("doc_key").unionByName(own).select("doc_id", "pos", r["start"].alias("start_date"), r["end"].alias("end_date"), T.lone_date(F.col("line")).alias("lone")).where("start_date is not null or lone")


_ROLES = [(1, "Lead, Acme"), (2, "Lead"), (3, "Lead, Acme, Oslo"), (4, ", Lead ,"), (5, ",,"), (6, "a,b,,c")]
_ROLE_COLUMNS = ["p_partkey + 100 as id", "case p_partkey % 5 when 0 then p_type || ', ' || p_brand when 1 then p_name when 2 then p_type || ',' || p_name || ', ' || p_brand when 3 then ' ,' || p_name || ' , ' else ',,' end as heading"]


def prs7_role_company(spark, sf_dir):
    named = T.role_company(F.col("heading"))
    return with_table(spark, sf_dir, _ROLES, "id long, heading string", "part", _ROLE_COLUMNS).select("id", named["role"].alias("role"), named["company"].alias("company"))


def _heads(spark, sf_dir):
    return P.marked(P.lines(resumes(spark, sf_dir))).where("head is not null").withColumn("markdown", F.col("line").rlike(T.MARKDOWN_HEADING))


def prs8_markdown_heading(spark, sf_dir):
    return _heads(spark, sf_dir).where("markdown").select("doc_id", "pos", "head.*")


def prs9_plain_heading(spark, sf_dir):
    return _heads(spark, sf_dir).where("not markdown").select("doc_id", "pos", "head.*")


def prs10_bullet_lines(spark, sf_dir):
    return P.lines(resumes(spark, sf_dir)).select("doc_id", "pos", T.bullet_body(F.col("line")).alias("body")).where("body is not null")


def prs12_items(spark, sf_dir):
    """Flagship: one row for each document, item and bullet."""
    parsed = P.parse(resumes(spark, sf_dir))
    return P.items_with_bullets(parsed).select("doc_id", "section_id", "item_id", "heading", "role", "company", "location", "start_date", "end_date", F.posexplode_outer("bullets").alias("bullet_pos", "bullet"))


def prs12_bullets(spark, sf_dir):
    return P.bullets(P.parse(resumes(spark, sf_dir)))


def prs13_sections(spark, sf_dir):
    return P.sections(P.parse(resumes(spark, sf_dir))).select("doc_id", "section_id", "type", "heading", F.array_join("content", "|").alias("content"))


def prs13_header(spark, sf_dir):
    return P.headers(P.parse(resumes(spark, sf_dir)))


def prs13_semantic(spark, sf_dir):
    """The nested record, measured: lines of the header, sections, items, bullets."""
    rec = P.semantic(resumes(spark, sf_dir))
    n_items = F.aggregate("sections", F.lit(0), lambda a, s: a + F.size(s["items"]))
    n_bullets = F.aggregate("sections", F.lit(0), lambda a, s: a + F.aggregate(s["items"], F.lit(0), lambda b, i: b + F.size(i["bullets"])))
    return rec.select("doc_id", F.size("header").alias("n_header"), F.size("sections").alias("n_sections"), n_items.alias("n_items"), n_bullets.alias("n_bullets"))


QUERIES = {f.__name__: f for f in (prs1_lines, prs2_strip_heading, prs4_section_type, prs6_date_range, prs7_role_company, prs8_markdown_heading, prs9_plain_heading, prs10_bullet_lines, prs12_items, prs12_bullets, prs13_sections, prs13_header, prs13_semantic)}

_P = D.parse_ctes()
_LONE = f"(regexp_matches(line, '{D.DATE}', 'i') or regexp_matches(line, '^(?:[A-Za-z]+{D.WS}+)?[0-9]{{4}}$'))"
_HEAD_COLUMNS = "doc_id, pos, heading, role, company, location, start_date, end_date"
_ITEMS_POS = D.ITEMS.replace("select doc_id, section_id, item_id,", "select doc_id, section_id, item_id, pos, accepted,", 1)
ORACLES = {
    "prs1_lines": _P + "select doc_id, pos, line from lines",
    "prs2_strip_heading": f"select id, {D.strip_heading('line')} stripped, {D.normalize_heading('line')} normalized from ({with_table_sql(HEADINGS, ['id', 'line'], 'part', HEADING_COLUMNS)})",
    "prs4_section_type": _P + f"select doc_id, pos, opens section_type from m1 where opens is not null union all select id, -1, {D.section_type('line')} from ({values_sql(HEADINGS, ['id', 'line'])})",
    "prs6_date_range": _P + f"select doc_id, pos, case when {D.has_range('line')} then {D.range_part('line', 1)} end start_date, case when {D.has_range('line')} then {D.range_part('line', 2)} end end_date, {_LONE} lone from (select doc_id, pos, line from lines union all select id, -1, line from ({values_sql(DATES, ['id', 'line'])})) where {_LONE}",
    "prs7_role_company": f"select id, case when len(p) >= 2 then p[1] else heading end as role, case when len(p) >= 2 then array_to_string(p[2:], ', ') end company from (select *, {D.parts('heading', ',')} p from ({with_table_sql(_ROLES, ['id', 'heading'], 'part', _ROLE_COLUMNS)}))",
    "prs8_markdown_heading": _P + f"select {_HEAD_COLUMNS} from ({_ITEMS_POS}) where accepted",
    "prs9_plain_heading": _P + f"select {_HEAD_COLUMNS} from ({_ITEMS_POS}) where not accepted",
    "prs10_bullet_lines": _P + f"select doc_id, pos, {D.trim(f'''regexp_extract(line, '{D.BULLET}', 1)''')} body from lines where regexp_matches(line, '{D.BULLET}')",
    "prs12_items": _P + f", it as ({D.ITEMS}), bu as ({D.BULLETS}) select it.*, (bullet_id - 1)::int bullet_pos, bullet from it left join bu using (doc_id, section_id, item_id)",
    "prs12_bullets": _P + D.BULLETS,
    "prs13_sections": _P + D.SECTIONS,
    "prs13_header": _P + "select doc_id, pos, line from parsed where section_id = 0",
    "prs13_semantic": _P + f", bu as ({D.BULLETS}) select docs.doc_id, coalesce(h, 0)::int n_header, coalesce(s, 0)::int n_sections, coalesce(i, 0)::int n_items, coalesce(b, 0)::int n_bullets from docs left join (select doc_id, count(case when section_id = 0 then 1 end) h, count(opens) s, count(case when is_head then 1 end) i from parsed group by 1) using (doc_id) left join (select doc_id, count(*) b from bu group by 1) using (doc_id)",
}

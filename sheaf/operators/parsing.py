"""Texts to lines, sections, dated items and bullets, with window functions.

Sections, items and bullets are gaps and islands: running counts of the lines that open
one, over the lines of a document in order. Every window is partitioned by document, and
all of them share one exchange, that of whole texts before they become lines. A document is a doc_id
with one text: rows that share an id, or have none, and differ in their texts are documents of their own
(``doc_key`` tells them apart), and rows that repeat both are one. A document's lines are its own, so partitions are even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import text as T


DOC = ("doc_id", "doc_key")


def _doc():
    return Window.partitionBy(*DOC).orderBy("pos")


def _so_far():
    return _doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def normalized_lines(text: Column) -> Column:
    """Trimmed lines without blank ones and page marks."""
    lines = F.split(F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text), "\n")
    # Most lines begin and end with printed ASCII characters.
    printed = lambda x: F.ascii(x).between(33, 126)
    trimmed = F.transform(lines, lambda x: F.when(printed(x) & printed(F.right(x, F.lit(1))), x).otherwise(T.trim_js(x)))
    return F.filter(trimmed, lambda x: (x != "") & ~(x.startswith("--") & x.rlike(T.PAGE_MARK)))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, pos (from 0, after the filter), line."""
    return once(docs).select(*DOC, F.posexplode(normalized_lines(F.col("text"))).alias("pos", "line"))


def once(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, text: each document once."""
    return docs.groupBy("doc_id", F.xxhash64("text").alias("doc_key")).agg(F.any_value("text").alias("text"))


def marked(rows: DataFrame) -> DataFrame:
    """Adds section_id (0 before the first), section_type, heading (struct or null) and is_date (taken by the heading before).

    A markdown heading counts with a date range in the next line, which it takes. Of a run of
    such headings where each is the date line of the one before, every second counts.
    """
    line, doc, so_far = F.col("line"), _doc(), _so_far()
    # Dates are read once for each line, below the windows, which pass them on.
    out = rows.withColumn("opens", T.section_type(line)).withColumn("dated", T.dated(line)).withColumn("dates", F.when(F.col("dated.near"), F.col("dated"))).withColumn("next_date", F.lead("dates").over(doc))
    out = out.withColumn("section_id", F.count("opens").over(so_far)).withColumn("section_type", F.last("opens", ignorenulls=True).over(so_far))
    employed = F.col("opens").isNull() & (F.col("section_type") == "employment")
    is_markdown = line.rlike(T.MARKDOWN_HEADING)
    out = out.withColumn("candidate", F.coalesce(employed & is_markdown & F.col("next_date").isNotNull(), F.lit(False)))
    out = out.withColumn("run_start", F.last(F.when(~F.col("candidate"), F.col("pos")), ignorenulls=True).over(so_far))
    out = out.withColumn("accepted", F.col("candidate") & ((F.col("pos") - F.coalesce("run_start", F.lit(-1))) % 2 == 1))
    out = out.withColumn("is_date", F.coalesce(F.lag("accepted").over(doc), F.lit(False)))

    # Titles and parts are columns of their own, made once and only for the lines that need them. A line has no line break, which so marks the cuts.
    cut = rf"\t+|{T.WS}{{2,}}|{T.WS}+\|{T.WS}+"
    is_plain = employed & ~is_markdown & ~F.col("is_date") & F.col("dates").isNotNull()
    out = out.withColumn("title", F.when(F.col("accepted"), T.trim_js(F.regexp_extract(line, T.MARKDOWN_HEADING, 1))).when(is_plain, F.col("dates.before")))
    out = out.withColumn("parts", F.when(F.col("title").isNotNull() & ~F.col("accepted"), T.parts_of(F.regexp_replace("title", cut, "\n"), "\n")))
    title, parts, dates = F.col("title"), F.col("parts"), F.col("dates")
    named = F.when(F.col("accepted"), T.role_company(title))
    out = out.withColumn("named", named)
    markdown = F.struct(title.alias("heading"), F.col("named.role").alias("role"), F.col("named.company").alias("company"), F.lit(None).cast("string").alias("location"), F.col("next_date.start").alias("start_date"), F.col("next_date.end").alias("end_date"))
    plain = F.struct(title.alias("heading"), F.get(parts, F.lit(0)).alias("role"), F.get(parts, F.lit(1)).alias("company"), F.get(parts, F.lit(2)).alias("location"), dates["start"].alias("start_date"), dates["end"].alias("end_date"))
    is_plain = parts.isNotNull() & (F.size(parts) >= 2)
    return out.withColumn("head", F.when(F.col("accepted"), markdown).when(F.coalesce(is_plain, F.lit(False)), plain)).select(*DOC, "pos", "line", "opens", "section_id", "section_type", "head", "is_date")


def with_items(rows: DataFrame) -> DataFrame:
    """Adds item_id within the section, and bullet_id within the item for lines that make bullets."""
    # Running counts of the document less those at the line that opened the section or item: the one order of lines serves all.
    so_far, none = _so_far(), F.lit(0).cast("long")
    since = lambda n, opened: (F.col(n) - F.coalesce(F.last(F.when(opened, F.col(n)), ignorenulls=True).over(so_far), none)).cast("int")
    opens, heads = F.col("opens").isNotNull(), F.col("head").isNotNull()
    out = rows.withColumn("heads", F.count("head").over(so_far)).withColumn("item_id", since("heads", opens))
    inside = ~opens & (F.col("item_id") > 0) & ~heads & ~F.col("is_date")
    out = out.withColumn("body", F.when(inside, T.bullet_body(F.col("line")))).withColumn("bodies", F.count("body").over(so_far))
    out = out.withColumn("bullet_id", since("bodies", opens | heads)).drop("heads", "bodies")
    goes_on = inside & F.col("body").isNull() & (F.col("bullet_id") > 0) & ~T.lone_date(F.col("line"))
    return out.withColumn("piece", F.when(F.col("body").isNotNull(), F.col("body")).when(goes_on, F.col("line")))


def parse(docs: DataFrame) -> DataFrame:
    """Every line with its section, item and bullet."""
    return with_items(marked(lines(docs)))


def headers(parsed: DataFrame) -> DataFrame:
    """doc_id, pos, line of the lines before the first section."""
    return parsed.where("section_id = 0").select("doc_id", "pos", "line")


def sections(parsed: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, section_id, type, heading, content: all lines of the section but those that items take after their heading."""
    own = F.col("opens").isNull() & ((F.col("item_id") == 0) | F.col("head").isNotNull())
    kept = F.sort_array(F.collect_list(F.when(own, F.struct("pos", "line"))))
    out = parsed.where("section_id > 0").groupBy(*DOC, "section_id").agg(F.max("opens").alias("type"), F.max(F.when(F.col("opens").isNotNull(), F.col("line"))).alias("opened"), kept.alias("kept"))
    return out.select(*(DOC if keyed else DOC[:1]), "section_id", "type", T.strip_heading(F.col("opened")).alias("heading"), F.transform("kept", lambda x: x["line"]).alias("content"))


def items(parsed: DataFrame) -> DataFrame:
    """doc_id, section_id, item_id, heading, role, company, location, start_date, end_date."""
    return parsed.where("head is not null").select("doc_id", "section_id", "item_id", "head.*")


def bullets(parsed: DataFrame) -> DataFrame:
    """doc_id, section_id, item_id, bullet_id, bullet: a bullet line with the lines that continue it."""
    pieces = F.sort_array(F.collect_list(F.struct("pos", "piece")))
    out = parsed.where("piece is not null").groupBy(*DOC, "section_id", "item_id", "bullet_id").agg(pieces.alias("p"))
    return out.withColumn("bullet", T.trim_js(F.array_join(F.transform("p", lambda x: x["piece"]), " "))).drop("p", "doc_key")


def items_with_bullets(parsed: DataFrame, keyed: bool = False) -> DataFrame:
    """One row for each item, its bullets as an array in order. One grouping of the parsed lines."""
    out = parsed.where("item_id > 0").groupBy(*DOC, "section_id", "item_id").agg(F.max("head").alias("head"), _pieces())
    return out.select(*(DOC if keyed else DOC[:1]), "section_id", "item_id", "head.*", _bullets("p").alias("bullets"))


def _pieces() -> Column:
    """Pieces in order; a line break before one opens a bullet, as no line has any."""
    opened = F.when(F.col("body").isNotNull(), "\n").otherwise(" ")
    return F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", F.concat(opened, "piece").alias("piece"))))).alias("p")


def _bullets(pieces: str) -> Column:
    whole = F.array_join(F.transform(pieces, lambda x: x["piece"]), "")
    return F.when(F.size(pieces) > 0, F.transform(F.split(F.substring(whole, 2, 2**31 - 1), "\n"), T.trim_js)).otherwise(F.array().cast("array<string>"))


def semantic(docs: DataFrame) -> DataFrame:
    """doc_id and the nested record: header lines, and sections with content and items. One row for each document.

    Lines are read once: items are grouped, then sections, then documents, all of them where the document is."""
    opens = F.col("opens").isNotNull()
    own = ~opens & ((F.col("item_id") == 0) | F.col("head").isNotNull())
    kept = F.sort_array(F.collect_list(F.when(own, F.struct("pos", "line")))).alias("kept")
    heading = F.max(F.when(opens, F.struct("opens", "line"))).alias("o")
    per_item = parse(docs).groupBy(*DOC, "section_id", "item_id").agg(F.max("head").alias("head"), _pieces(), kept, heading)
    item = F.struct(*[F.col(f"head.{k}").alias(k) for k in ("heading", "role", "company", "location")], F.col("head.start_date").alias("startDate"), F.col("head.end_date").alias("endDate"), _bullets("p").alias("bullets"))
    per_item = per_item.select(*DOC, "section_id", F.struct("item_id", F.transform("kept", lambda x: x["line"]).alias("kept"), F.when(F.col("item_id") > 0, item).alias("item")).alias("i"), "o")
    # The lines of a section before its first item, then the heading of each item.
    parts = per_item.groupBy(*DOC, "section_id").agg(F.sort_array(F.collect_list("i")).alias("i"), F.max("o").alias("o"))
    listed = F.transform(F.filter("i", lambda x: x["item_id"] > 0), lambda x: x["item"])
    section = F.struct("section_id", F.struct(F.col("o.opens").alias("type"), T.strip_heading(F.col("o.line")).alias("heading"), F.flatten(F.transform("i", lambda x: x["kept"])).alias("content"), listed.alias("items")).alias("s"))
    nested = parts.groupBy(*DOC).agg(F.sort_array(F.collect_list(section)).alias("s"))
    header = F.coalesce(F.get(F.filter("s", lambda x: x["section_id"] == 0), F.lit(0))["s"]["content"], F.array().cast("array<string>"))
    full = nested.select("doc_id", header.alias("header"), F.transform(F.filter("s", lambda x: x["section_id"] > 0), lambda x: x["s"]).alias("sections"))
    # A document without any line has an empty record all the same. Most begin with what tells that they have one.
    text = T.trim_js(F.coalesce("text", F.lit("")))
    no_line = (text == "") | (text.startswith("-") & (F.size(normalized_lines(text)) == 0))
    none = once(docs).where(no_line).select("doc_id", F.array().cast("array<string>").alias("header"), F.array().cast(full.schema["sections"].dataType).alias("sections"))
    return full.unionByName(none)

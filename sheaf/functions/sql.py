"""The scalar text functions for SQL: ``register(spark)`` makes each a temporary SQL function, ``sheaf_<name>``.

The bodies are printed from the Column functions, so there is one definition of each, and Spark inlines
them like any expression: no Python worker, and filters are pushed down as usual.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.operators import json_text, timeline
from sheaf.operators.rendering import bullet_list, cover_letter, short_message

#: Name: function of columns, its parameters, and what it returns.
FUNCTIONS = {
    "trim_text": (T.trim_js, "x STRING", "STRING"),
    "has_text": (T.has_text, "x STRING", "BOOLEAN"),
    "normalize_heading": (T.normalize_heading, "line STRING", "STRING"),
    "section_type": (T.section_type, "line STRING", "STRING"),
    "date_range": (T.date_range, "line STRING", "STRUCT<start: STRING, end: STRING>"),
    "lone_date": (T.lone_date, "line STRING", "BOOLEAN"),
    "bullet_body": (T.bullet_body, "line STRING", "STRING"),
    "role_company": (T.role_company, "heading STRING", "STRUCT<role: STRING, company: STRING>"),
    "normalize_for_match": (T.normalize_for_match, "x STRING", "STRING"),
    "same_meaning": (lambda a, b: T.same_meaning(T.normalize_for_match(a), T.normalize_for_match(b)), "a STRING, b STRING", "BOOLEAN"),
    "mentions_education": (T.mentions_education, "x STRING", "BOOLEAN"),
    "technology_spacing": (T.technology_spacing, "x STRING", "STRING"),
    "sentences": (T.sentences, "x STRING", "ARRAY<STRING>"),
    "has_closing": (T.has_closing, "x STRING", "BOOLEAN"),
    "sanitize_path": (T.sanitize_path, "x STRING", "STRING"),
    "json_candidates": (json_text.candidates, "answer STRING", "ARRAY<STRING>"),
    "bullet_list": (bullet_list, "items ARRAY<STRING>", "STRING"),
    "short_message": (short_message, "message STRING", "STRING"),
    "cover_letter": (cover_letter, "letter STRING, name STRING", "STRING"),
    "month_of_start": (lambda x, at: timeline.month_of(x, False, at), "x STRING, as_of DATE", "INT"),
    "month_of_end": (lambda x, at: timeline.month_of(x, True, at), "x STRING, as_of DATE", "INT"),
}

_LITERAL = re.compile(r"'(?:[^'\\]|\\.)*'", re.S)
#: Operators are printed as functions are: their names need quotes to be read again.
_OPERATOR = re.compile(r"(?<![\w`])(and|or|not|[-+*/%<>=!&|^~]+)(?=\()")


def printed(column: Column) -> str:
    """A column as SQL that Spark reads."""
    text, out, at = column._jc.node().sql(), [], 0
    for m in [*_LITERAL.finditer(text), None]:
        end = m.start() if m else len(text)
        out.append(_OPERATOR.sub(lambda o: f"`{o[1]}`", text[at:end]))
        if m:
            out.append(m[0])
            at = m.end()
    return "".join(out)


def register(spark: SparkSession, prefix: str = "sheaf_") -> list[str]:
    """Makes the functions known to ``spark.sql``; returns their names."""
    for name, (function, parameters, returned) in FUNCTIONS.items():
        body = printed(function(*[F.col(p.split()[0]) for p in parameters.split(", ")]))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {returned} RETURN {body}")
    return [f"{prefix}{name}" for name in FUNCTIONS]

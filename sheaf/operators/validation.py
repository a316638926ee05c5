"""Records against fixed schemas: checked, trimmed and coerced as the data model says.

Each kind of value is two things: a Python check of a parsed JSON value, which says what is
wrong, and expressions over a VARIANT, which say whether it is right and what is stored. ``validate`` takes the
expressions for a first candidate that they find right, so usual answers never leave the JVM, and the Python
check in Arrow batches for the rest. The two agree where the expressions say yes: missing, null and
wrong type are told apart, text behind the JSON and doubled keys are refused (VARIANT takes the one and not the other), and lists of texts that hold
objects, whose keys VARIANT sorts, are left to Python, as are numbers beyond a thousand million.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import let, trim_js
from sheaf.operators import json_text

#: What a trim takes.
BLANKS = "\t\n\x0b\x0c\r \xa0                　﻿"
MISSING = object()


class Invalid(ValueError):
    pass


@dataclass(frozen=True)
class Kind:
    """``check`` maps (value or MISSING, path) to the stored value; MISSING is left out. ``right`` and ``stored`` are the same of a
    VARIANT column, null where the value is missing; None where only Python can tell."""

    check: Callable
    ddl: str
    right: Callable[[Column], Column] | None = None
    stored: Callable[[Column], Column] | None = None


def _is(v: Column, *kinds: str) -> Column:
    kind = F.schema_of_variant(v)
    return F.coalesce(F.lit(False) if not kinds else functools.reduce(lambda a, b: a | b, [kind.startswith(k) for k in kinds]), F.lit(False))


def _string(v: Column) -> Column:
    return trim_js(F.try_variant_get(v, "$", "string"))


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _right_number(low: float | None, high: float | None, whole: bool, optional: bool) -> Callable[[Column], Column]:
    def right(v: Column) -> Column:
        n = F.try_variant_get(v, "$", "double")
        ok = _is(v, "BIGINT", "DECIMAL", "DOUBLE") & (F.abs(n) <= 1e9)
        ok = ok & (n == F.floor(n)) if whole else ok
        ok = ok & (n >= low) if low is not None else ok
        ok = ok & (n <= high) if high is not None else ok
        return F.coalesce(v.isNull() | ok if optional else ok, F.lit(False))

    return right


def _number_kind(ddl: str, **limits) -> Kind:
    right = _right_number(limits.get("low"), limits.get("high"), limits.get("whole", False), limits.get("optional", False))
    return Kind(_number(**limits), ddl, right, lambda v: F.try_variant_get(v, "$", ddl.lower()))


def _text(v, path):
    if not isinstance(v, str):
        raise Invalid(f"{path}: {'Required' if v is MISSING else 'Expected string'}")
    v = v.strip(BLANKS)
    if not v:
        raise Invalid(f"{path}: String must contain at least 1 character(s)")
    return v


def _optional_text(v, path):
    if v is MISSING or (isinstance(v, str) and not v.strip(BLANKS)):
        return MISSING
    return _text(v, path)


def number_text(n: float | int) -> str:
    """A number as JavaScript prints it, for usual sizes."""
    if isinstance(n, float) and n.is_integer() and abs(n) < 1e21:
        return str(int(n))
    return repr(n)


def _array_item(v) -> str | None:
    if isinstance(v, str):
        return v.strip(BLANKS) or None
    if not isinstance(v, dict):
        return None
    found = [(x if isinstance(x, str) else number_text(x)).strip(BLANKS) for x in v.values() if isinstance(x, str) or (isinstance(x, (int, float)) and not isinstance(x, bool))]
    return ": ".join(x for x in found if x) or None


def _text_array(v, path):
    if v is MISSING:
        return []
    if not isinstance(v, list):
        raise Invalid(f"{path}: Expected array")
    return [x for x in map(_array_item, v) if x]


def _number(low: float | None = None, high: float | None = None, whole: bool = False, optional: bool = False):
    def check(v, path):
        if v is MISSING and optional:
            return MISSING
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise Invalid(f"{path}: {'Required' if v is MISSING else 'Expected number'}")
        if isinstance(v, float) and not math.isfinite(v) or whole and v != int(v):
            raise Invalid(f"{path}: Expected integer")
        if low is not None and v < low:
            raise Invalid(f"{path}: Number must be greater than or equal to {low}")
        if high is not None and v > high:
            raise Invalid(f"{path}: Number must be less than or equal to {high}")
        return int(v) if whole else v

    return check


def _boolean(v, path):
    if not isinstance(v, bool):
        raise Invalid(f"{path}: {'Required' if v is MISSING else 'Expected boolean'}")
    return v


TEXT = Kind(_text, "STRING", lambda v: _is(v, "STRING") & (F.length(_string(v)) > 0), _string)
OPTIONAL = Kind(_optional_text, "STRING", lambda v: v.isNull() | _is(v, "STRING"), lambda v: F.nullif(_string(v), F.lit("")))
TEXTS = Kind(
    _text_array, "ARRAY<STRING>",
    lambda v: v.isNull() | (_is(v, "ARRAY") & ~F.coalesce(F.exists(_elements(v), lambda x: _is(x, "OBJECT")), F.lit(False))),
    lambda v: F.when(v.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(_elements(v), lambda x: F.when(_is(x, "STRING"), _string(x))), lambda x: F.length(x) > 0)),
)
BOOLEAN = Kind(_boolean, "BOOLEAN", lambda v: _is(v, "BOOLEAN"), lambda v: F.try_variant_get(v, "$", "boolean"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _told(fields: dict[str, Kind]) -> bool:
    return all(k.right for k in fields.values())


def record(fields: dict[str, Kind], optional: bool = False) -> Kind:
    """An object; unknown keys are left out."""

    def check(v, path):
        if v is MISSING and optional:
            return MISSING
        if not isinstance(v, dict):
            raise Invalid(f"{path}: {'Required' if v is MISSING else 'Expected object'}")
        found = {k: kind.check(v.get(k, MISSING), f"{path}.{k}" if path else k) for k, kind in fields.items()}
        return {k: x for k, x in found.items() if x is not MISSING}

    ddl = f"STRUCT<{', '.join(f'{k}: {x.ddl}' for k, x in fields.items())}>"
    if not _told(fields):
        return Kind(check, ddl)

    def right(v: Column) -> Column:
        ok = _is(v, "OBJECT")
        for k, kind in fields.items():
            ok = ok & let(_field(v, k), kind.right)
        return v.isNull() | ok if optional else ok

    return Kind(check, ddl, right, lambda v: F.when(v.isNotNull(), F.struct(*[kind.stored(_field(v, k)).alias(k) for k, kind in fields.items()])))


def records(fields: dict[str, Kind]) -> Kind:
    """An array of objects, empty where missing; one bad element fails the whole."""
    one = record(fields)

    def check(v, path):
        if v is MISSING:
            return []
        if not isinstance(v, list):
            raise Invalid(f"{path}: Expected array")
        return [one.check(x, f"{path}[{i}]") for i, x in enumerate(v)]

    if one.right is None:
        return Kind(check, f"ARRAY<{one.ddl}>")
    return Kind(
        check, f"ARRAY<{one.ddl}>",
        lambda v: v.isNull() | (_is(v, "ARRAY") & F.coalesce(F.forall(_elements(v), lambda x: F.coalesce(one.right(x), F.lit(False))), F.lit(False))),
        lambda v: F.when(v.isNull(), F.array().cast(f"array<{one.ddl}>")).otherwise(F.transform(_elements(v), one.stored)),
    )


#: The fields of the records.
PROFILE = record({
    "name": OPTIONAL, "currentTitle": OPTIONAL, "location": OPTIONAL, "yearsOfExperience": _number_kind("DOUBLE", low=0, optional=True), "summary": TEXT,
    "education": records({"degree": OPTIONAL, "institution": OPTIONAL, "field": OPTIONAL, "graduationYear": _number_kind("INT", whole=True, optional=True), "notes": OPTIONAL}),
    "skills": TEXTS, "industries": TEXTS, "companies": TEXTS,
    "workExperience": records({"company": OPTIONAL, "role": OPTIONAL, "location": OPTIONAL, "startDate": OPTIONAL, "endDate": OPTIONAL, "responsibilities": TEXTS, "technologies": TEXTS, "achievements": TEXTS}),
    "projects": records({"name": TEXT, "description": TEXT, "technologies": TEXTS, "impact": OPTIONAL}),
    "achievements": TEXTS,
})
JOB = record({"roleTitle": TEXT, "company": OPTIONAL, "location": OPTIONAL, "seniority": OPTIONAL, "requiredSkills": TEXTS, "niceToHaveSkills": TEXTS, "educationRequirements": TEXTS, "responsibilities": TEXTS, "domain": OPTIONAL, "keywords": TEXTS})
MATCH = record({"matchScore": _number_kind("DOUBLE", low=0, high=100), "summary": TEXT, "strongMatches": TEXTS, "partialMatches": TEXTS, "gaps": TEXTS, "risks": TEXTS, "suggestedPositioning": TEXT, "keywordSuggestions": TEXTS})
ASSETS = record({
    "cvImprovements": record({"improvedBullets": TEXTS, "skillsToEmphasize": TEXTS, "experienceToRewrite": TEXTS, "missingKeywords": TEXTS}),
    "linkedinMessage": TEXT, "coverLetter": TEXT,
    "interviewPrep": record({"likelyInterviewTopics": TEXTS, "technicalQuestions": TEXTS, "behavioralQuestions": TEXTS, "suggestedTalkingPoints": TEXTS}),
})
PREFERENCES = record({"linkedinTone": OPTIONAL, "coverLetterLength": OPTIONAL, "preferredRoles": TEXTS, "avoidPhrases": TEXTS})
REVIEW = record({"passed": BOOLEAN, "issues": TEXTS, "suggestedFixes": TEXTS})
SEMANTIC = record({"header": TEXTS, "sections": records({"type": TEXT, "heading": TEXT, "content": TEXTS, "items": records({"heading": TEXT, "role": OPTIONAL, "company": OPTIONAL, "location": OPTIONAL, "startDate": OPTIONAL, "endDate": OPTIONAL, "bullets": TEXTS})})})
RUN = record({"provider": TEXT, "generatedAt": TEXT, "semanticCv": Kind(lambda v, p: MISSING if v is MISSING else SEMANTIC.check(v, p), SEMANTIC.ddl), "cvProfile": PROFILE, "jobRequirements": JOB, "matchAnalysis": MATCH, "applicationAssets": ASSETS, "review": Kind(lambda v, p: MISSING if v is MISSING else REVIEW.check(v, p), REVIEW.ddl)})
SCHEMAS = {"CV profile": PROFILE, "job requirements": JOB, "match analysis": MATCH, "application assets": ASSETS, "output review": REVIEW, "preferences": PREFERENCES, "semantic CV": SEMANTIC, "raw analysis": RUN}


def _strict(text: str):
    def refuse(name):
        raise ValueError(f"{name} is no JSON")

    return json.loads(text, parse_constant=refuse)


def first_valid(texts: list[str], kind: Kind, label: str) -> tuple[dict | None, str | None]:
    """The first candidate that is JSON and valid, or the message with the last error."""
    error = "unknown error"
    for t in texts:
        try:
            return kind.check(_strict(t), ""), None
        except (ValueError, RecursionError) as e:
            error = str(e)
    return None, f"Could not parse valid {label} JSON from the model response. Last validation error: {error}"


def printed(data: dict) -> str:
    """JSON; halves of characters, which no column can hold, become U+FFFD."""
    return re.sub("[\ud800-\udfff]", "\ufffd", json.dumps(data, ensure_ascii=False))


def _parsed(text: Column) -> Column:
    """A VARIANT of a text that is one JSON value and nothing else, or null. The parser stops at a last bracket, whatever
    follows it: a number that the text cannot know, its own hash, comes behind the value and must be found there."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text).cast("string"), F.lit("]"))), "$", "array<variant>")
    alone = lambda x: (F.size(x["l"]) == 2) & (F.try_variant_get(F.get(x["l"], F.lit(1)), "$", "long") == F.xxhash64(x["t"]))
    # Escaped halves of characters are kept by Python and not by VARIANT.
    return let(F.struct(text.alias("t"), listed.alias("l")), lambda x: F.when(alone(x) & ~F.contains(x["t"], F.lit("\\ud")) & ~F.contains(x["t"], F.lit("\\uD")), F.get(x["l"], F.lit(0))))


def _right(v: Column, kind: Kind) -> Column:
    """JSON of the checked record of a VARIANT that the expressions find right, else null."""
    if kind.right is None:
        return F.lit(None).cast("string")
    return F.when(F.coalesce(kind.right(v), F.lit(False)), F.to_json(kind.stored(v)))


def right_data(candidates: Column, label: str) -> Column:
    """JSON of the checked record if expressions alone find the first candidate right, else null."""
    if SCHEMAS[label].right is None:
        return F.lit(None).cast("string")
    # In a lambda the text is parsed once, however often the expressions name it.
    return let(let(F.get(candidates, F.lit(0)), _parsed), lambda v: _right(v, SCHEMAS[label]))


def _asked(known: Column, candidates: Column) -> Column:
    """One array: what is known, or null and the candidates."""
    return F.when(known.isNull(), F.concat(F.array(F.lit(None).cast("string")), candidates)).otherwise(F.array(known))


def _checked(asked: Column, label: str) -> Column:
    """struct(data, error): what is known, or the first valid candidate by Python."""

    @F.pandas_udf("data string, error string")
    def run(rows: pd.Series) -> pd.DataFrame:
        from sheaf.operators import validation as here  # by name in the worker: what is missing is told by identity

        kind, first_valid = here.SCHEMAS[label], here.first_valid
        out = [(t[0], None) if t is not None and t[0] is not None else first_valid([] if t is None else list(t[1:]), kind, label) for t in rows]
        return pd.DataFrame({"data": [d if d is None or isinstance(d, str) else here.printed(d) for d, _ in out], "error": [e for _, e in out]})

    # A filter by the error must not run the check a second time, as one below the columns would.
    return run.asNondeterministic()(asked)


def validate(candidates: Column, label: str) -> Column:
    """struct(data: JSON of the checked record, error) of an array of candidates; from_json with ``SCHEMAS[label].ddl`` types it."""
    return _checked(let(F.struct(right_data(candidates, label).alias("known"), candidates.alias("c")), lambda x: _asked(x["known"], x["c"])), label)


def validate_answer(text: Column, label: str) -> Column:
    """``validate`` of ``json_text.candidates(text)``, each of which is looked for only where it is needed: the whole text comes
    first, and if it is one JSON object and nothing else, it is its own balanced object. So is the body of a fence that is one object, where no
    brace comes before it."""
    parsed = let(trim_js(text), lambda w: F.struct(w.alias("w"), json_text.fenced(w).alias("f"), _parsed(w).alias("v")))
    known = let(parsed, lambda x: F.struct(x["w"].alias("w"), x["f"].alias("f"), _is(x["v"], "OBJECT").alias("own"), _right(x["v"], SCHEMAS[label]).alias("known")))
    opens = lambda x: x["f"].startswith("{") & (F.instr(x["w"], "{") > F.instr(x["w"], "```"))
    balanced = lambda x: F.when(x["own"], x["w"]).when(F.when(opens(x), _is(_parsed(x["f"]), "OBJECT")), x["f"]).otherwise(json_text.balanced_object(x["w"]))
    return _checked(let(known, lambda x: _asked(x["known"], json_text.of_trimmed(x["w"], x["f"], balanced(x)))), label)


def typed(data: Column, label: str) -> Column:
    return F.from_json(data, SCHEMAS[label].ddl)

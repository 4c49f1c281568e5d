"""Text expressions: keywords, classifiers, keys and JSON out of model answers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered keyword classes; the first class with a keyword in the text wins, else the last name.
WEATHER = (("rain", ("rain",)), ("fog", ("fog",)), ("snow", ("snow",)), ("night", ("night", "dark")), ("clear", ()))
TIME_OF_DAY = (("night", ("night", "dark")), ("dawn", ("dawn", "sunrise")), ("dusk", ("dusk", "sunset")), ("day", ()))
ROAD_TYPE = (
    ("highway", ("highway", "motorway", "freeway")),
    ("intersection", ("intersection", "crossing", "junction")),
    ("parking", ("parking", "lot")),
    ("urban", ()),
)


def _hit(text: Column, keyword: str, whole_words: bool) -> Column:
    if whole_words:
        return text.rlike(r"\b\Q" + keyword.lower() + r"\E\b")
    return text.contains(keyword.lower())


def keyword_any(text: Column, keywords: Sequence[str], whole_words: bool = False) -> Column:
    """Whether the lower-cased text has any keyword; a null text has none."""
    low = F.lower(text)
    return F.coalesce(reduce(or_, (_hit(low, k, whole_words) for k in keywords), F.lit(False)), F.lit(False))


def first_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """The first keyword, in the order given, that the lower-cased text has; else the empty string."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(k.lower()), F.lit(k)) for k in keywords], F.lit(""))


def classify(text: Column, classes, whole_words: bool = False) -> Column:
    """The first class with a keyword in the lower-cased text; a null text gets the last."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tests = [F.when(keyword_any(low, words, whole_words), F.lit(name)) for name, words in classes if words]
    return F.coalesce(*tests, F.lit(classes[-1][0]))


def zfill(text: Column, width: int) -> Column:
    """Zeros in front up to a width; longer texts stay whole."""
    bare = F.trim(text)
    return F.when(F.length(bare) < width, F.lpad(bare, width, "0")).otherwise(bare)


def first_truthy(*columns: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def safe_name(text: Column) -> Column:
    """Everything but word characters and hyphens as an underscore."""
    return F.regexp_replace(text, r"(?U)[^\w\-]", "_")


def with_scheme(path: Column) -> Column:
    """file:// in front of a path without a scheme."""
    return F.when(path.rlike(r"^(file|https?)://"), path).otherwise(F.concat(F.lit("file://"), path))


def json_object(text: Column, fenced_first: bool = True) -> Column:
    """The JSON object in a model's answer, as JSON text; null if there is none.

    Looks into a code fence, at the whole text, and from the first to the last brace; ``fenced_first=False`` looks at the whole
    text before the fence.
    """

    def parsed(candidate: Column) -> Column:
        value = F.try_parse_json(F.nullif(candidate, F.lit("")))
        return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.to_json(value))

    fence = parsed(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1))
    whole, braces = parsed(F.trim(text)), parsed(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    return F.coalesce(fence, whole, braces) if fenced_first else F.coalesce(whole, fence, braces)


def served_json(text: Column) -> Column:
    """The JSON of any type in an answer as served: the whole text, else a code fence, else from the first to the last brace, else a record of the failure."""
    valid = lambda c: F.when(F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull(), F.to_json(F.try_parse_json(F.nullif(c, F.lit("")))))
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.+?)\s*```", 1)
    failure = F.to_json(F.struct(text.alias("parse_failure"), F.array().cast("array<string>").alias("hazards")))
    return F.coalesce(valid(F.trim(text)), valid(fence), valid(F.regexp_extract(text, r"(?s)\{.*\}", 0)), failure)


def judged_score(text: Column) -> Column:
    """The score in a judge's answer: the JSON field, else the first ``"score": n`` with n from 1 to 5, else 1."""
    field = F.try_variant_get(F.try_parse_json(json_object(text)), "$.score", "int")
    return F.coalesce(field, F.nullif(F.regexp_extract(text, r'"score"\s*:\s*([1-5])', 1), F.lit("")).cast("int"), F.lit(1))

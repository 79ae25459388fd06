"""Functions of filters and bindings on terms: languages, datatypes, numbers, parts of strings and of dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v

NUMERIC = [v.XSD + x for x in (
    "integer", "decimal", "float", "double", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte", "nonNegativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte",
    "positiveInteger",
)]


def datatype(kind: Column, dt: Column, lang: Column) -> Column:
    """The datatype of a literal: its own, that of texts with a language, or string; null for other terms."""
    return F.when(kind == "literal", F.when(lang != "", v.RDF + "langString").when(dt != "", dt).otherwise(v.XSD + "string"))


def lang_matches(lang: Column, wanted: str) -> Column:
    """Whether a language tag is in a range (``en`` has ``en-GB``); ``*`` has every tag but the empty one."""
    if wanted == "*":
        return lang != ""
    low = F.lower(lang)
    return (low == wanted.lower()) | low.startswith(wanted.lower() + "-")


def number(o: Column, kind: Column, dt: Column) -> Column:
    """The value of a numeric literal, null for any other term and for malformed numbers."""
    return F.when((kind == "literal") & dt.isin(NUMERIC), o.try_cast("double"))


def round_up(x: Column) -> Column:
    """To the nearest integer, halves towards positive infinity."""
    return F.floor(x + F.lit(0.5))


def before(text: Column, mark: str) -> Column:
    """The part before the first ``mark``; empty where there is none and for an empty mark."""
    return F.when(text.isNull(), None).when(F.lit(mark) == "", "").when(text.contains(mark), F.split_part(text, F.lit(mark or " "), F.lit(1))).otherwise("")


def after(text: Column, mark: str) -> Column:
    """The part after the first ``mark``; empty where there is none, the whole text for an empty mark."""
    if not mark:
        return text
    return F.when(text.isNull(), None).when(text.contains(mark), F.substr(text, F.locate(mark, text) + F.lit(len(mark)))).otherwise("")


def encode_for_uri(text: Column) -> Column:
    """All but letters, digits, ``-._~`` as percent codes of the UTF-8 bytes."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def date_part(o: Column, part: str) -> Column:
    """``year``, ``month``, ``day``, ``hours``, ``minutes`` or ``seconds`` as they are written in a date or a date and time, null for other forms."""
    form = r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(?:Z|[+-]\d\d:\d\d)?$"
    found = F.regexp_extract(o, form, ["year", "month", "day", "hours", "minutes", "seconds"].index(part) + 1)
    return F.when(found != "", found.try_cast("decimal(18,6)" if part == "seconds" else "int"))


def same_term(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether two terms ``(value, kind, datatype, language)`` are one: languages without regard to case."""
    (ao, ak, ad, al), (bo, bk, bd, bl) = a, b
    return (ao == bo) & (ak == bk) & ((ak != "literal") | ((ad == bd) & (F.lower(al) == F.lower(bl))))

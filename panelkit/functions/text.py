"""Text normalisers: trimming, padding, dates, identifiers of works."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.operators.lineage import bound_batches

#: strptime directives and their date-pattern letters. Fixed values.
DATE_DIRECTIVES = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s"}
DATE_OUTPUTS = ("year", "year_month", "iso_date")


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def zero_pad(c: Column, width: int) -> Column:
    """Zeros in front, behind a leading sign; longer texts stay whole."""
    sign = F.when(c.rlike("^[+-]"), F.substring(c, 1, 1)).otherwise(F.lit(""))
    rest = F.when(c.rlike("^[+-]"), F.substring(c, F.lit(2), F.length(c))).otherwise(c)
    return F.when(F.length(c) >= width, c).otherwise(F.concat(sign, F.repeat(F.lit("0"), F.lit(width) - F.length(c)), rest))


KEY_RULES = {"trim": strip, "lower_case": F.lower, "upper_case": F.upper}


def normalize_key(c: Column, rules: list[str], width: int | None = None) -> Column:
    """The rules in their order."""
    for rule in rules:
        c = zero_pad(c, width) if rule == "zero_pad" else KEY_RULES[rule](c)
    return c


def date_pattern(directives: str) -> str:
    """A strptime format as a date pattern; literal letters are quoted."""
    out, i = "", 0
    while i < len(directives):
        if directives[i] == "%":
            out += DATE_DIRECTIVES[directives[i : i + 2]]
            i += 2
        else:
            out += f"'{directives[i]}'" if directives[i].isalpha() else directives[i]
            i += 1
    return out


def parsed_date(c: Column, in_format: str) -> Column:
    return F.try_to_timestamp(c.cast("string"), F.lit(date_pattern(in_format)))


def date_output(t: Column, out: str) -> Column:
    return {"year": F.year(t), "year_month": F.date_format(t, "yyyy-MM"), "iso_date": F.date_format(t, "yyyy-MM-dd")}[out]


@F.pandas_udf(T.StringType())
def nfkc(texts):
    """Unicode NFKC, which no built-in function gives."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normal_text(c: Column, compose: bool = True) -> Column:
    """NFKC, single spaces, trimmed; missing is empty. ASCII needs no composing and doesn't go to Python; the rest goes in bounded batches."""
    c = F.coalesce(c, F.lit(""))
    if compose:
        bound_batches(SparkSession.active())
        plain = F.octet_length(c) == F.length(c)
        c = F.when(plain, c).otherwise(nfkc(F.when(~plain, c)))
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def title_key(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def canonical_doi(c: Column) -> Column:
    """The bare lower-case DOI, or NULL if it is none: never guessed."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^https?://(?:dx\.)?doi\.org/", ""), r"(?i)^doi:\s*", "")
    return F.when(bare.rlike(r"(?i)^10\.\d{4,9}/\S+$"), F.lower(bare))


def doi_reason(c: Column) -> Column:
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "missing").when(canonical_doi(c).isNull(), "malformed")


def family_key(families: Column) -> Column:
    """Lower-case family names in author order, joined by a bar."""
    return F.array_join(F.transform(families, F.lower), "|")


def record_id(source: Column, source_id: Column, title: Column) -> Column:
    parts = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (source, source_id, title)])
    return F.concat(F.lit("rec_"), F.substring(F.sha2(parts, 256), 1, 12))


def date_parts(year: Column, month: Column | None = None, day: Column | None = None, semantics: str = "single") -> Column:
    """struct(year, month, day, semantics): issued (by date parts), single (by fields), year (a bare one), unknown.

    A bare year is text or a number; what is no number, or 0, is missing.
    """
    number = F.nullif(year.try_cast("double").cast("int"), F.lit(0)) if semantics == "year" else year.cast("int")
    part = lambda c: c.cast("int") if c is not None else F.lit(None).cast("int")
    told = F.when(year.isNull() & F.lit(month is None and day is None), "unknown").otherwise(semantics)
    return F.struct(number.alias("year"), part(month).alias("month"), part(day).alias("day"), told.alias("semantics"))

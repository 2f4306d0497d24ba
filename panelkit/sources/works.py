"""Sources of works: response classes, item mappers over nested JSON, replay of captures."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that a query keeps. Fixed value.
_PLAIN = "!~*'()"
#: Item schemas of the two services. Fixed values.
CROSSREF_ITEM = "DOI string, title array<string>, author array<struct<given string, family string>>, issued struct<`date-parts`: array<array<int>>>, `container-title` array<string>, type string, URL string"
OPENALEX_ITEM = "id string, display_name string, authorships array<struct<author: struct<given_name: string, display_name: string>>>, publication_year int, primary_location struct<source: struct<display_name: string>>, doi string, type string"


def classify_response(status: int | None, ok: bool) -> tuple[str, str | None]:
    """(status, error category) of a response: unavailable without one, malformed if it isn't ok."""
    return ("success", None) if ok else ("source_unavailable", "transport") if status is None else ("malformed_response", f"http_{status}")


def search(source: str, url: str, items_at: tuple[str, ...], fetcher: Callable[[str], tuple[int | None, str]]) -> dict:
    """One request through an injected fetcher, as a status and raw items."""
    try:
        status, body = fetcher(url)
    except OSError:
        status, body = None, ""
    told, error = classify_response(status, status is not None and 200 <= status < 300)
    out = {"source": source, "status": told, "error_category": error, "request_identity": url, "result_count": 0, "items": []}
    if error:
        return out
    try:
        found = json.loads(body)
    except ValueError:
        return out | {"status": "malformed_response", "error_category": "invalid_json"}
    for k in items_at:
        found = found.get(k) if isinstance(found, dict) else None
    items = found or []
    return out | {"items": items, "result_count": len(items), "status": "success" if items else "success_zero_records"}


def search_crossref(query: str, fetcher, max_results: int = 5) -> dict:
    return search("crossref", f"https://api.crossref.org/works?query={quote(query, safe=_PLAIN)}&rows={int(max_results)}&select=DOI,title,author,issued,container-title,type,URL", ("message", "items"), fetcher)


def search_openalex(query: str, fetcher, max_results: int = 5) -> dict:
    return search("openalex", f"https://api.openalex.org/works?search={quote(query, safe=_PLAIN)}&per-page={int(max_results)}", ("results",), fetcher)


def map_crossref(items: DataFrame) -> DataFrame:
    """Rows of CROSSREF_ITEM to (title, doi, authors, year, month, day, source, source_id, venue, url, type)."""
    return items.select(
        F.get("title", F.lit(0)).alias("title"), F.col("DOI").alias("doi"),
        F.transform(F.coalesce("author", F.array().cast("array<struct<given:string,family:string>>")), lambda a: F.struct(F.trim(a["given"]).alias("given"), F.trim(a["family"]).alias("family"))).alias("authors"),
        *[F.get(F.get(F.col("issued")["date-parts"], F.lit(0)), F.lit(i)).alias(part) for i, part in enumerate(("year", "month", "day"))], F.lit("crossref").alias("source"), F.col("DOI").alias("source_id"), F.get(F.col("`container-title`"), F.lit(0)).alias("venue"), F.col("URL").alias("url"), "type",
    )


def map_openalex(items: DataFrame) -> DataFrame:
    """Rows of OPENALEX_ITEM to the same columns; the family name is the display name."""
    return items.select(
        F.col("display_name").alias("title"), F.col("doi"),
        F.transform(F.coalesce("authorships", F.array().cast("array<struct<author:struct<given_name:string,display_name:string>>>")), lambda a: F.struct(F.trim(a["author"]["given_name"]).alias("given"), F.trim(a["author"]["display_name"]).alias("family"))).alias("authors"),
        F.col("publication_year").alias("year"), F.lit(None).cast("int").alias("month"), F.lit(None).cast("int").alias("day"), F.lit("openalex").alias("source"), F.col("id").alias("source_id"), F.col("primary_location.source.display_name").alias("venue"), F.col("doi").alias("url"), "type",
    )

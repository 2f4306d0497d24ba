"""Bibliographic record linkage: edges by identity keys, components, decisions, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.text import canonical_doi, family_key, normal_text, record_id, title_key

from .lineage import attach, settled, written


def normalize_records(df: DataFrame, compose: bool = True) -> DataFrame:
    """title, doi, authors (array of struct<given, family>), year, source, source_id to records."""
    title = normal_text(F.col("title"), compose)
    return df.select(
        record_id(F.col("source"), F.col("source_id"), title).alias("record_id"), title.alias("display_title"), title_key(title).alias("title_key"),
        canonical_doi(F.col("doi")).alias("canonical_doi"), F.col("doi").alias("doi_original"), canonical_doi(F.col("doi")).isNotNull().alias("doi_valid"),
        "authors", family_key(F.transform("authors", lambda a: F.trim(F.coalesce(a["family"], F.lit(""))))).alias("author_family_key"), F.col("year").cast("int").alias("year"), "source", "source_id",
    )


def identity_key(title: Column, year: Column, families: Column) -> Column:
    """Title key, year and sorted families; NULL if all are empty (such records aren't one work)."""
    names = _sorted_families(families)
    empty = (F.coalesce(title, F.lit("")) == "") & year.isNull() & (names == "")
    return F.when(~empty, F.concat_ws("\x01", F.coalesce(title, F.lit("")), F.coalesce(year.cast("string"), F.lit("")), names))


def short_key(c: Column) -> Column:
    """A long key as its hash, so that shuffles carry no whole texts. No title key holds a #."""
    return F.when(F.length(c) > 64, F.concat(F.lit("#"), F.sha2(F.encode(c, "UTF-8"), 256))).otherwise(c)


def edges(records: DataFrame) -> DataFrame:
    """(u, v): each record to the first holder, in record_id order, of one of its keys."""

    def to_first(key: Column, conflict: bool = False) -> DataFrame:
        keyed = records.select("record_id", "canonical_doi", key.alias("k")).where("k is not null")
        first = keyed.groupBy("k").agg(F.min(F.struct("record_id", "canonical_doi")).alias("f"))
        # A key that most records share meets its first holder salted.
        out = attach(keyed, first, "k", ["record_id"]).where(F.col("record_id") != F.col("f.record_id"))
        if conflict:
            out = out.where(F.col("canonical_doi").isNull() | F.col("f.canonical_doi").isNull() | (F.col("canonical_doi") == F.col("f.canonical_doi")))
        return out.select(F.col("record_id").alias("u"), F.col("f.record_id").alias("v"))

    own = F.when(F.col("source_id").isNotNull(), F.concat_ws("::", "source", F.lower("source_id")))
    found = to_first(F.col("canonical_doi")).unionByName(to_first(own))
    return found.unionByName(to_first(identity_key(F.col("title_key"), F.col("year"), F.col("author_family_key")), True)).distinct()


def components(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(record_id, label): the smallest record reachable. Min-label rounds with pointer jumps.

    A hub's edges and a label's members meet their labels salted.
    """
    both = written(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    alone = nodes.select("record_id").distinct()
    labels = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("record_id"), F.least("u", "v").alias("label")))
    for _ in range(rounds):
        near = attach(both, labels.withColumnRenamed("record_id", "v"), "v", ["u"]).groupBy(F.col("u").alias("record_id")).agg(F.min("label").alias("near"))
        step = written(labels.join(near, "record_id").select("record_id", "label", F.least("label", "near").alias("new")))
        if step.where("label <> new").isEmpty():
            return alone.join(labels, "record_id", "left").select("record_id", F.coalesce("label", "record_id").alias("label"))
        jump = attach(step.select("record_id", "new"), labels.select(F.col("record_id").alias("new"), F.col("label").alias("further")), "new", ["record_id"])
        labels = written(jump.select("record_id", F.least("new", "further").alias("label")))
    raise RuntimeError("components did not settle")


def _kinds(c: Column) -> Column:
    return F.size(F.collect_set(F.when(c.cast("string") != "", c.cast("string"))))


def _filled(c: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(c != "", c)))


def _sorted_families(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\|"), lambda x: x != "")), "|")


def groups(records: DataFrame) -> DataFrame:
    """One row a group: members, decision and rule, and what ``verified`` needs. A member is a row, whatever its id.

    One DOI with titles, years and families (as sets) that don't differ is the same work; where only families
    differ, an author conflict; then several DOIs, then titles or years are conflicts; what is left is
    the same by a source's id or by its normalized identity.
    """
    # Read again and again: the keys alone are settled, without the display texts.
    keys = ("record_id", "canonical_doi", "author_family_key", "year", "source", "source_id")
    records = settled(records.select(*keys, short_key(F.col("title_key")).alias("title_key")))
    labelled = attach(records, components(records, edges(records)), "record_id", ["source"])
    # Lists of a group are as long as its members: a work's copies in a result set, not a corpus.
    found = labelled.groupBy("label").agg(
        F.array_sort(F.collect_list("record_id")).alias("record_ids"), F.count(F.lit(1)).alias("member_count"),
        _kinds(F.col("canonical_doi")).alias("dois"), _kinds(F.col("title_key")).alias("titles"), _kinds(F.col("year")).alias("years"), _kinds(_sorted_families(F.col("author_family_key"))).alias("families"),
        _filled(F.col("canonical_doi")).alias("doi_list"), _filled(F.col("source")).alias("source_list"),
    )
    core = (F.col("dois") == 1) & (F.col("titles") <= 1) & (F.col("years") <= 1)
    rule = F.when(F.col("member_count") == 1, "single").when(core & (F.col("families") <= 1), "canonical_doi").when(core, "author_conflict").when(F.col("dois") > 1, "doi_conflict")
    found = found.withColumn("rule", rule.when((F.col("titles") > 1) | (F.col("years") > 1), "identity_conflict").otherwise("source_id_or_normalized"))
    return found.withColumn("decision", F.when(F.col("rule") == "single", "distinct").when(F.col("rule").endswith("conflict"), "conflict").otherwise("dedupe_same"))


#: Verification's branches in their order: state, reason codes (fixed values), note.
_BRANCHES = (
    ("verified", ("authoritative_doi", "core_fields_compatible"), "a registry confirms the DOI and the works agree"),
    ("conflicting", ("multiple_dois",), "the works share a DOI but differ in title, year or authors"),
    ("conflicting", ("doi_identity_conflict",), "the works share a DOI but differ in title, year or authors"),
    ("verified", ("multi_source_agreement", "no_doi"), "without a DOI, but several sources agree on one work"),
    ("partially_verified", ("single_source_or_incomplete", "no_doi"), "one source, or several that leave fields open, and nothing speaks against it"),
    ("unresolved", ("insufficient_evidence", "no_doi"), "too little is known to tell the work"),
)


def verified(found: DataFrame) -> DataFrame:
    """``groups`` with state, reason_codes and evidence by DOI, core fields and sources.

    Evidence's doi is given where one DOI is confirmed, its dois where there is a conflict.
    """
    dois, sources = F.size("doi_list"), F.size("source_list")
    strong = (F.col("titles") <= 1) & (F.col("years") <= 1) & (F.col("families") <= 1)
    tests = ((dois == 1) & strong, dois > 1, dois == 1, (sources >= 2) & strong, (sources == 1) | ((F.col("titles") == 1) & (F.col("years") == 1)), F.lit(True))

    def made(test: Column, state: str, codes: tuple[str, ...], note: str) -> tuple[Column, Column]:
        one = F.col("doi_list")[0] if "authoritative_doi" in codes else F.lit(None).cast("string")
        many = F.col("doi_list") if state == "conflicting" else F.lit(None).cast("array<string>")
        evidence = F.struct(one.alias("doi"), many.alias("dois"), F.col("source_list").alias("sources"), F.lit(note).alias("note"))
        return test, F.struct(F.lit(state).alias("state"), F.array(*map(F.lit, codes)).alias("reason_codes"), evidence.alias("evidence"))

    picked = F.coalesce(*[F.when(*made(t, *b)) for t, b in zip(tests, _BRANCHES)])
    return found.withColumn("_v", picked).select("*", "_v.*").drop("_v")


def numbered(found: DataFrame) -> DataFrame:
    """G0, G1, ... by the groups' sorted record ids: ranks within ranges, shifted by the ranges before."""
    key = F.array_join("record_ids", ",")
    dealt = found.withColumn("_k", key).repartitionByRange("_k").withColumn("_p", F.spark_partition_id())
    dealt = settled(dealt)
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    below = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_k")) - 1
    return dealt.withColumn("_r", rank).join(F.broadcast(below), "_p").withColumn("group_id", F.concat(F.lit("G"), (F.col("_below") + F.col("_r")).cast("string"))).select(*found.columns, "group_id")


#: What a source's request can come to. Fixed values.
SUCCESS, EMPTY = "success", "success_zero_records"
FAILED = ("source_unavailable", "malformed_response", "unsupported_source")


def workflow_status(statuses: DataFrame, by: list[str] = ()) -> DataFrame:
    """Roll sources' statuses up: completed, completed_degraded, completed_zero_results or source_unavailable."""
    bad = F.col("status").isin(*FAILED)
    some, none, any_bad = F.bool_or(F.col("status") == SUCCESS), F.bool_or(F.col("status") == EMPTY), F.bool_or(bad)
    told = F.when(F.bool_and(bad), "source_unavailable").when((some | none) & any_bad, "completed_degraded").when(some, "completed").when(none, "completed_zero_results").otherwise("source_unavailable")
    return statuses.groupBy(*by).agg(F.coalesce(told, F.lit("source_unavailable")).alias("workflow_status"))

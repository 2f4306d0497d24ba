"""Sources, sinks, estimators' side results and control documents on the driver's tables, each with its DuckDB twin."""

from __future__ import annotations


import os
import uuid

from pyspark.sql import functions as F

from panelkit.engine_queries import _WITHIN, _t, supplier_year
from panelkit.functions import text
from panelkit.operators import bundle, stats
from panelkit.operators.harmonize import harmonize
from panelkit.operators.lineage import checkpoint_folder
from panelkit.queries import query
from panelkit.sources import tables, works


def _folder(spark) -> str:
    """A fresh folder where the executors' intermediate data lies."""
    checkpoint_folder(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"query-{uuid.uuid4().hex}")


# ---- sources and sinks ------------------------------------------------------------------


@query("s_csv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, 'a \"q\", b' AS odd FROM customer")
def s_csv_round_trip(spark, sf):
    folder = _folder(spark)
    made = _t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("NA").alias("name"), F.lit('a "q", b').alias("odd"))
    tables.write_table(made, folder, ["c_custkey"], "csv", single_file=True)
    [file] = [r["f"] for r in spark.read.format("binaryFile").load(f"{folder}/*.csv").select(F.col("path").alias("f")).collect()]
    return tables.read_csv(spark, file, tables.sha256_of(spark, file))


@query("s_key_values", "SELECT r_name AS k, 'v=' || r_regionkey AS v FROM region")
def s_key_values(spark, sf):
    folder = _folder(spark)
    _t(spark, sf, "region").select(F.concat("r_name", F.lit(" = v="), F.col("r_regionkey").cast("string")).alias("value")).write.text(folder)
    return spark.createDataFrame(list(tables.read_key_values(spark, folder, ["ASIA"]).items()), "k string, v string")


@query("s_map_crossref", "SELECT s_name AS title, '10.1234/' || s_suppkey AS doi, 'F' || s_nationkey AS family, 1990 + s_nationkey AS year, CASE WHEN s_suppkey % 2 = 0 THEN 5 END AS month, 'crossref' AS source, '10.1234/' || s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN 'V' END AS venue FROM supplier")
def s_map_crossref(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    doi = F.concat(F.lit("10.1234/"), k.cast("string"))
    dates = F.struct(F.array(F.array_compact(F.array((n + 1990).cast("int"), F.when(k % 2 == 0, 5)))).alias("date-parts"))
    people = F.array(F.struct(F.lit(" G ").alias("given"), F.concat(F.lit(" F"), n.cast("string")).alias("family")))
    item = F.struct(doi.alias("DOI"), F.array("s_name").alias("title"), people.alias("author"), dates.alias("issued"), F.when(k % 3 == 0, F.array(F.lit("V"))).alias("container-title"))
    items = _t(spark, sf, "supplier").select(F.from_json(F.to_json(item), works.CROSSREF_ITEM).alias("i")).select("i.*")
    return works.map_crossref(items).select("title", "doi", F.col("authors")[0]["family"].alias("family"), "year", "month", "source", "source_id", "venue")


@query("s_map_openalex", "SELECT s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN '10.1234/' || s_suppkey END AS doi, 'F' || s_nationkey AS family, 1990 + s_nationkey AS year, 'openalex' AS source, 'W' || s_suppkey AS source_id, 'V' AS venue FROM supplier")
def s_map_openalex(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    people = F.array(F.struct(F.struct(F.concat(F.lit("F"), n.cast("string"), F.lit(" ")).alias("display_name")).alias("author")))
    place = F.struct(F.struct(F.lit("V").alias("display_name")).alias("source"))
    item = F.struct(F.concat(F.lit("W"), k.cast("string")).alias("id"), F.col("s_name").alias("display_name"), people.alias("authorships"), (n + 1990).alias("publication_year"), place.alias("primary_location"), F.when(k % 2 == 0, F.concat(F.lit("10.1234/"), k.cast("string"))).alias("doi"))
    items = _t(spark, sf, "supplier").select(F.from_json(F.to_json(item), works.OPENALEX_ITEM).alias("i")).select("i.*")
    return works.map_openalex(items).select("title", "doi", F.col("authors")[0]["family"].alias("family"), "year", "source", "source_id", "venue")


# ---- text -------------------------------------------------------------------------------


@query("l_normal_text", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents")
def l_normal_text(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.normal_text(F.col("text")).alias("t"))


@query("l_family_key", "SELECT doc_id, lower(lang) || '|' || lower(source) AS k FROM documents")
def l_family_key(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.family_key(F.array("lang", "source")).alias("k"))


# ---- plans and estimates ----------------------------------------------------------------


@query("j_unmatched", """
WITH j AS (SELECT o_orderkey, c_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 4 <> 0)
SELECT count(*) AS rows_before, count(*) AS rows_after, count(c_custkey) AS matched, count(*) - count(c_custkey) AS unmatched FROM j""")
def j_unmatched(spark, sf):
    right = _t(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    op = {"kind": "merge", "right": "r", "right_keys": ["o_custkey"], "how": "left", "cardinality": "m:1", "unmatched": "warn"}
    _, log = harmonize({"inputs": [{"input_id": "l"}, {"input_id": "r"}], "operations": [op]}, {"l": _t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "r": right})
    names = ("rows_before", "rows_after", "matched", "unmatched")
    return spark.createDataFrame([tuple(log[0][n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("panel_fe_iid_se", f"""WITH {_WITHIN}, f AS (SELECT sum(y*y) AS yy, count(DISTINCT supplier) AS g, count(DISTINCT year) AS t, count(*) AS n FROM d)
SELECT 'qty' AS term, round(sqrt((yy - b1*ay - b2*b_y) / (f.n - 2 - (f.g + f.t - 1)) * bb / (aa*bb - ab*ab)), 5) AS std_error FROM s, f UNION ALL
SELECT 'discount', round(sqrt((yy - b1*ay - b2*b_y) / (f.n - 2 - (f.g + f.t - 1)) * aa / (aa*bb - ab*ab)), 1) FROM s, f""")
def panel_fe_iid_se(spark, sf):
    e = stats.panel_fe(supplier_year(spark, sf), "revenue", ["qty", "discount"], "supplier", "year", covariance="iid")
    return spark.createDataFrame([(n, round(float(s), p)) for n, s, p in zip(e.names, e.se, (5, 1))], "term string, std_error double")


@query("iv_first_stage", "SELECT round(r * r / (1 - r * r) * (n - 2), 2) AS f FROM (SELECT corr(l_quantity, l_tax + l_quantity / 500) AS r, count(*) AS n FROM lineitem)")
def iv_first_stage(spark, sf):
    df = _t(spark, sf, "lineitem").select((F.col("l_tax") + F.col("l_quantity") / 500).alias("z"), "l_extendedprice", "l_quantity")
    facts = stats.iv_2sls(df, "l_extendedprice", [], "l_quantity", ["z"]).facts
    return spark.createDataFrame([(round(float(facts["cragg_donald_f"]), 2),)], "f double")


@query("tolerance_compare", "SELECT l_orderkey, l_linenumber, abs(l_tax - l_discount) <= greatest(1e-12, 1e-9 * greatest(abs(l_tax), abs(l_discount))) AS same FROM lineitem")
def tolerance_compare(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", stats.close(F.col("l_tax"), F.col("l_discount")).alias("same"))


# ---- artifacts and rendering ------------------------------------------------------------


@query("i_family_problems", """
WITH m AS (SELECT r_regionkey AS f, n_nationkey AS e FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0), c AS (SELECT n_regionkey AS f, n_nationkey AS e FROM nation WHERE n_nationkey % 5 <> 1)
SELECT 'estimate_not_a_member' AS check, 'f' || f AS item, 'e' || e AS detail FROM c WHERE e % 4 = 0 UNION ALL
SELECT 'unknown_member', 'f' || f, 'e' || e FROM m WHERE e % 6 = 5 UNION ALL
SELECT 'not_adjusted', 'f' || f, 'e' || e FROM (SELECT * FROM m UNION SELECT * FROM c WHERE e % 6 <> 5) WHERE e % 4 = 0 OR e % 3 = 1""")
def i_family_problems(spark, sf):
    n = _t(spark, sf, "nation").select(F.expr("concat('f', n_regionkey)").alias("family_id"), F.expr("concat('e', n_nationkey)").alias("estimate_id"), "n_nationkey")
    adjusted = F.collect_list(F.when(F.col("n_nationkey") % 3 != 1, F.struct("estimate_id", F.lit(0.5).alias("p_adjusted"))))
    families = n.where("n_nationkey % 4 <> 0").groupBy("family_id").agg(F.collect_list("estimate_id").alias("member_estimate_ids"), adjusted.alias("adjusted_results"))
    claimed = F.when(F.col("n_nationkey") % 5 != 1, F.array("family_id"))
    estimates = n.where("n_nationkey % 6 <> 5").select("estimate_id", F.lit("m").alias("model_id"), F.lit("t").alias("term"), *[F.lit(v).alias(c) for c, v in (("estimate", 1.0), ("std_error", 1.0), ("ci_lower", 0.0), ("ci_upper", 2.0), ("p_value", 0.5), ("n", 1.0))], claimed.alias("multiple_testing_family_ids"))
    return bundle.item_problems(bundle.Bundle(spark, items={"multiple_testing": families, "estimates": estimates})).select("check", "item", "detail")


# ---- control ----------------------------------------------------------------------------

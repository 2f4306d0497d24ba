"""The engine's operators applied to the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.functions import text
from panelkit.functions.nulls import compare
from panelkit.operators import artifacts, bundle, linkage, literature, stats
from panelkit.operators.construct import predicate, shifted
from panelkit.operators.guards import duplicate_rows
from panelkit.operators.harmonize import coerced, merge, unknown_codes
from panelkit.operators.validate import validate
from panelkit.plans.staged import run_staged
from panelkit.queries import query


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _run(plan_ops, df, **frames):
    """A harmonize plan over a frame."""
    inputs = [{"input_id": "main"}, *({"input_id": k} for k in frames)]
    return run_staged({"inputs": inputs, "operations": plan_ops}, {"main": df, **frames})[0]


def _made(ops, df, panel=None, **more):
    plan = {"operations": ops, **({"panel_by": panel[0], "time_by": panel[1]} if panel else {}), **more}
    return run_staged(plan, df)[0]


# ---- flagship ---------------------------------------------------------------------------

_PANEL = [
    {"kind": "log", "source": "revenue", "target": "log_revenue"},
    {"kind": "ratio", "numerator": "revenue", "denominator": "qty", "target": "price"},
    {"kind": "lag", "source": "qty", "target": "lag_qty"},
    {"kind": "difference", "source": "qty", "target": "d_qty"},
    {"kind": "growth_rate", "source": "qty", "target": "g_qty"},
    {"kind": "interaction", "terms": ["qty", "n_lines"], "target": "qty_lines"},
    {"kind": "indicator", "target": "large", "predicate": {"op": "and", "args": [{"op": "gt", "left": "qty", "right": 2000}, {"op": "neq", "left": "year", "right": 1995}]}},
]


def supplier_year(spark, sf):
    """The balanced supplier-year panel: one shuffle on its keys."""
    return _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count(F.lit(1)).cast("double").alias("n_lines"), F.round(F.avg("l_discount"), 9).alias("discount"))


_SUPPLIER_YEAR = "SELECT l_suppkey AS supplier, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS revenue, CAST(count(*) AS DOUBLE) AS n_lines, round(avg(l_discount), 9) AS discount FROM lineitem GROUP BY 1, 2"


@query("flagship_supplier_panel", f"""
WITH p AS ({_SUPPLIER_YEAR}), s AS (SELECT p.*, s_name AS name, s_nationkey AS nation FROM p LEFT JOIN supplier ON supplier = s_suppkey),
w AS (SELECT *, lag(qty) OVER (PARTITION BY supplier ORDER BY year) AS l FROM s)
SELECT supplier, year, qty, revenue, n_lines, discount, name, nation, round(ln(revenue), 6) AS log_revenue, round(revenue / qty, 6) AS price,
  l AS lag_qty, qty - l AS d_qty, round((qty - l) / l, 6) AS g_qty, qty * n_lines AS qty_lines, CAST(qty > 2000 AND year <> 1995 AS INTEGER) AS large FROM w""")
def flagship(spark, sf):
    right = _t(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    op = {"kind": "merge", "right": "supplier", "left_keys": ["supplier"], "right_keys": ["s_suppkey"], "how": "left", "cardinality": "m:1", "unmatched": "fail"}
    out = _made(_PANEL, _run([op], supplier_year(spark, sf), supplier=right).drop("s_suppkey"), ("supplier", "year"))
    return out.withColumns({c: F.round(c, 6) for c in ("log_revenue", "price", "g_qty")})


# ---- harmonize --------------------------------------------------------------------------


@query("h_rename_coerce", "SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_orderkey AS VARCHAR) AS label, o_custkey AS cust FROM orders")
def h_rename_coerce(spark, sf):
    df = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.format_string(" %s ", F.col("o_totalprice").cast("string")).alias("o_totalprice"), F.col("o_orderkey").alias("label"), F.col("o_custkey").cast("string").alias("o_custkey"))
    ops = [{"kind": "rename", "mapping": {"o_orderkey": "id", "o_totalprice": "price", "o_custkey": "cust"}}, {"kind": "coerce", "column": "id", "to": "integer"}, {"kind": "coerce", "column": "price", "to": "numeric"}, {"kind": "coerce", "column": "label", "to": "string"}, {"kind": "coerce", "column": "cust", "to": "integer"}]
    return _run(ops, df)


@query("h_coerce_bool", "SELECT o_orderkey, o_orderkey % 2 = 0 AS flag FROM orders")
def h_coerce_bool(spark, sf):
    words = F.element_at(F.array(*map(F.lit, ("TRUE", "no", " 1", "False", "yes ", "0"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return _run([{"kind": "coerce", "column": "flag", "to": "boolean"}], _t(spark, sf, "orders").select("o_orderkey", words.alias("flag")))


@query("h_coerce_violations", "SELECT count(*) AS rows, CAST(count_if(o_orderkey % 7 = 0) AS BIGINT) AS violations FROM orders")
def h_coerce_violations(spark, sf):
    cell = F.when(F.col("o_orderkey") % 7 == 0, "abc").when(F.col("o_orderkey") % 7 != 1, F.col("o_orderkey").cast("string"))
    _, violated = coerced(F.col("c"), "numeric")
    return _t(spark, sf, "orders").select(cell.alias("c")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(violated).alias("violations"))


@query("h_normalize_key", "SELECT c_custkey, upper(trim(c_name)) AS k, CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 8 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS code FROM customer")
def h_normalize_key(spark, sf):
    df = _t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("\t "), "c_name", F.lit("  ")).alias("k"), F.concat(F.col("c_custkey").cast("string"), F.lit(" ")).alias("code"))
    return _run([{"kind": "normalize_key", "column": "k", "rules": ["trim", "upper_case"]}, {"kind": "normalize_key", "column": "code", "rules": ["trim", "zero_pad"], "width": 8}], df)


@query("h_key_collisions", "SELECT count(*) AS collisions FROM (SELECT lower(p_brand) AS n FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_brand END AS p_brand FROM part) GROUP BY 1 HAVING count(*) > 1)")
def h_key_collisions(spark, sf):
    raw = _t(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("o"))
    return raw.select("o", text.normalize_key(F.col("o"), ["lower_case"]).alias("n")).distinct().groupBy("n").count().where("count > 1").agg(F.count(F.lit(1)).alias("collisions"))


@query("h_map_code", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS o_orderstatus FROM orders")
def h_map_code(spark, sf):
    return _run([{"kind": "map_code", "column": "o_orderstatus", "mapping": {"F": "filled", "O": "open", "P": "partial"}, "unknown": "fail"}], _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"))


for _out, _sql in {"year": "CAST(year(o_orderdate) AS INTEGER)", "year_month": "strftime(o_orderdate, '%Y-%m')", "iso_date": "strftime(o_orderdate, '%Y-%m-%d')"}.items():

    @query(f"h_normalize_date_{_out}", f"SELECT o_orderkey, {_sql} AS d FROM orders")
    def _dates(spark, sf, out=_out):
        df = _t(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "d/M/yyyy").alias("d"))
        return _run([{"kind": "normalize_date", "column": "d", "in_format": "%d/%m/%Y", "out": out}], df)


@query("h_convert_unit", "SELECT o_orderkey, o_totalprice, round(o_totalprice * 0.92, 4) AS eur, round(o_totalprice / 1000.0, 6) AS k FROM orders")
def h_convert_unit(spark, sf):
    unit = {"kind": "convert_unit", "source_column": "o_totalprice", "source_unit": "usd"}
    out = _run([unit | {"target_column": "eur", "target_unit": "eur", "factor": 0.92, "factor_mode": "multiply"}, unit | {"target_column": "k", "target_unit": "kusd", "factor": 1000, "factor_mode": "divide"}], _t(spark, sf, "orders").select("o_orderkey", "o_totalprice"))
    return out.withColumns({"eur": F.round("eur", 4), "k": F.round("k", 6)})


def _merge(left, right, lk, rk, how, cardinality, unmatched="warn"):
    return _run([{"kind": "merge", "right": "r", "left_keys": lk, "right_keys": rk, "how": how, "cardinality": cardinality, "unmatched": unmatched}], left, r=right)


@query("h_merge_left_m1", "SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_name, CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_nationkey AS DOUBLE) AS c_name_r FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def h_merge_left_m1(spark, sf):
    nation = _t(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("double").alias("n_nationkey"), "n_name", F.col("n_nationkey").cast("double").alias("c_name"))
    return _merge(_t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("c_nationkey"), "c_name"), nation, ["c_nationkey"], ["n_nationkey"], "left", "m:1")


@query("h_merge_inner_m1", "SELECT l_orderkey, l_linenumber, l_partkey, p_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10")
def h_merge_inner_m1(spark, sf):
    return _merge(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), _t(spark, sf, "part").where("p_size < 10").select("p_partkey", "p_brand"), ["l_partkey"], ["p_partkey"], "inner", "m:1")


@query("h_merge_1m", "SELECT n_nationkey, n_name, c_custkey FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey")
def h_merge_1m(spark, sf):
    right = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return _merge(_t(spark, sf, "nation").select("n_nationkey", "n_name"), right, ["n_nationkey"], ["n_nationkey"], "left", "1:m")


@query("h_merge_null_keys", "WITH a AS (SELECT c_custkey, CAST(nullif(c_nationkey, 3) AS DOUBLE) AS k FROM customer), b AS (SELECT CAST(nullif(n_nationkey, 3) AS DOUBLE) AS k2, n_name FROM nation) SELECT c_custkey, k, k2, n_name FROM a LEFT JOIN b ON k IS NOT DISTINCT FROM k2")
def h_merge_null_keys(spark, sf):
    null3 = lambda c: F.when(F.col(c) != 3, F.col(c)).cast("double")
    left = _t(spark, sf, "customer").select("c_custkey", null3("c_nationkey").alias("k"))
    return merge(left, _t(spark, sf, "nation").select(null3("n_nationkey").alias("k2"), "n_name"), ["k"], ["k2"], "left").drop("_matched")


# ---- construct --------------------------------------------------------------------------

for _op, _sign in {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}.items():

    @query(f"c_arithmetic_{_op}", f"SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, round(l_extendedprice {_sign} l_quantity, {9 if _op == 'divide' else 4}) AS v FROM lineitem")
    def _arith(spark, sf, op=_op):
        df = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
        return _made([{"kind": "arithmetic", "operator": op, "left": "l_extendedprice", "right": "l_quantity", "target": "v"}], df).withColumn("v", F.round("v", 9 if op == "divide" else 4))


for _base, _fn in {"natural": "ln", "10": "log10"}.items():

    @query(f"c_log_{_base}", f"SELECT p_partkey, p_retailprice, round({_fn}(p_retailprice), 8) AS v FROM part")
    def _log(spark, sf, base=_base):
        return _made([{"kind": "log", "source": "p_retailprice", "target": "v", "base": base}], _t(spark, sf, "part").select("p_partkey", "p_retailprice")).withColumn("v", F.round("v", 8))


@query("c_ratio", "SELECT l_orderkey, l_linenumber, l_tax, l_quantity, round(l_tax / l_quantity, 9) AS v FROM lineitem")
def c_ratio(spark, sf):
    df = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_quantity")
    return _made([{"kind": "ratio", "numerator": "l_tax", "denominator": "l_quantity", "target": "v"}], df).withColumn("v", F.round("v", 9))


@query("c_interaction", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_discount, round(l_quantity * l_tax * l_discount, 9) AS v FROM lineitem")
def c_interaction(spark, sf):
    df = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")
    return _made([{"kind": "interaction", "terms": ["l_quantity", "l_tax", "l_discount"], "target": "v"}], df).withColumn("v", F.round("v", 9))


def _events(spark, sf):
    return _t(spark, sf, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"))


_E = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events)"
_E0 = f"(SELECT event_id, user_id, ts, nullif(x, 0) AS x FROM {_E})"
for _k in (1, 3):
    for _kind, _expr in {"lag": f"lag(x, {_k}) OVER w", "lead": f"lead(x, {_k}) OVER w", "difference": f"x - lag(x, {_k}) OVER w", "growth_rate": f"(x - lag(x, {_k}) OVER w) / lag(x, {_k}) OVER w"}.items():

        @query(f"c_{_kind}_{_k}", f"SELECT event_id, user_id, ts, x, round({_expr}, 6) AS v FROM {_E0 if _kind == 'growth_rate' else _E} WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
        def _shift(spark, sf, kind=_kind, k=_k):
            # Growth from zero fails a plan; where values may be 0, they are made missing beforehand.
            events = _events(spark, sf).withColumn("x", F.nullif("x", F.lit(0.0))) if kind == "growth_rate" else _events(spark, sf)
            return _made([{"kind": kind, "source": "x", "target": "v", "periods": k}], events, ("user_id", "ts")).withColumn("v", F.round("v", 6))


@query("c_lag_null_panel", "SELECT event_id, CASE WHEN u IS NOT NULL THEN lag(value) OVER (PARTITION BY u ORDER BY ts, event_id) END AS v FROM (SELECT *, nullif(user_id, 1) AS u FROM events)")
def c_lag_null_panel(spark, sf):
    df = _t(spark, sf, "events").select("event_id", "ts", "value", F.when(F.col("user_id") != 1, F.col("user_id")).alias("u"))
    return df.withColumn("o", F.struct("ts", "event_id")).select("event_id", shifted("value", 1, "u", "o").alias("v"))


@query("c_missing_counts", f"""
WITH w AS (SELECT x, lag(x, 3) OVER p AS v, row_number() OVER p - 1 AS pos FROM {_E} WINDOW p AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT CAST(count_if(pos < 3) AS BIGINT) AS structural, CAST(count_if(v IS NULL) AS BIGINT) AS missing FROM w)
SELECT structural, missing, greatest(missing - structural, 0) AS propagated FROM c""")
def c_missing_counts(spark, sf):
    plan = {"operations": [{"kind": "lag", "source": "x", "target": "v", "periods": 3}], "panel_by": "user_id", "time_by": "ts"}
    log = run_staged(plan, _events(spark, sf))[1][0]
    return spark.createDataFrame([(log["structural_missing"], log["missing"], log["propagated_missing"])], "structural long, missing long, propagated long")


_X, _Y = "CASE WHEN l_linenumber <> 2 THEN l_quantity END", "CASE WHEN l_linenumber <> 3 THEN CAST(l_suppkey AS DOUBLE) END"
for _p, _s in {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=", "neq": "<>"}.items():

    @query(f"c_indicator_{_p}", f"SELECT l_orderkey, l_linenumber, x, y, CAST(coalesce(x {_s} y, {_p == 'neq'}) AS INTEGER) AS v FROM (SELECT l_orderkey, l_linenumber, {_X} AS x, {_Y} AS y FROM lineitem)")
    def _indicator(spark, sf, p=_p):
        return _made([{"kind": "indicator", "target": "v", "predicate": {"op": p, "left": "x", "right": "y"}}], _gaps(spark, sf))


def _gaps(spark, sf):
    n = F.col("l_linenumber")
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(n != 2, F.col("l_quantity")).alias("x"), F.when(n != 3, F.col("l_suppkey").cast("double")).alias("y"))


for _p, _s in {"and": "AND", "or": "OR"}.items():

    @query(f"c_indicator_{_p}", f"SELECT l_orderkey, l_linenumber, x, y, CAST(coalesce(x > 25, false) {_s} coalesce(y <> 7, true) AS INTEGER) AS v FROM (SELECT l_orderkey, l_linenumber, {_X} AS x, {_Y} AS y FROM lineitem)")
    def _logic(spark, sf, p=_p):
        tree = {"op": p, "args": [{"op": "gt", "left": "x", "right": 25}, {"op": "neq", "left": "y", "right": 7}]}
        return _made([{"kind": "indicator", "target": "v", "predicate": tree}], _gaps(spark, sf))


@query("guard_report", "SELECT CAST(count_if(l_tax = 0) AS BIGINT) AS zero_divisor, CAST(count_if(l_discount <= 0) AS BIGINT) AS log_domain, CAST(count_if(l_quantity > 45) AS BIGINT) AS large, (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem) AS repeated FROM lineitem")
def guard_report(spark, sf):
    df = _t(spark, sf, "lineitem")
    counts = [F.count_if(compare("eq", F.col("l_tax"), F.lit(0))), F.count_if(F.col("l_discount") <= 0), F.count_if(predicate({"op": "gt", "left": "l_quantity", "right": 45}))]
    return df.agg(*[c.alias(n) for c, n in zip(counts, ("zero_divisor", "log_domain", "large"))]).withColumn("repeated", F.lit(duplicate_rows(df, ["l_orderkey", "l_linenumber"])).cast("long"))


# ---- validation -------------------------------------------------------------------------


@query("v_report", """
WITH n AS (SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS u, count_if(l_quantity % 1 <> 0) AS f, count_if(CASE WHEN l_linenumber <> 2 THEN l_tax END IS NULL) AS m FROM lineitem)
SELECT 'DV_ROWCOUNT' AS check_id, CASE WHEN n = (SELECT 4 * count(*) FROM orders) THEN 'pass' ELSE 'fail' END AS status FROM n UNION ALL SELECT 'DV_VAR_PRESENT', 'fail' UNION ALL
SELECT 'DV_VAR_TYPE', CASE WHEN f = 0 THEN 'pass' ELSE 'fail' END FROM n UNION ALL SELECT 'DV_KEY_UNIQUE', CASE WHEN u = n THEN 'pass' ELSE 'fail' END FROM n UNION ALL
SELECT 'DV_MISSINGNESS', CASE WHEN m = 0 THEN 'pass' ELSE 'fail' END FROM n UNION ALL SELECT 'DV_SAMPLE_FLOW', CASE WHEN (SELECT count_if(o_orderkey % 2 = 0) + count_if(o_orderkey % 2 = 1) FROM orders) * 4 = (SELECT 4 * count(*) FROM orders) THEN 'pass' ELSE 'fail' END UNION ALL
SELECT 'DV_MERGE_CARDINALITY', CASE WHEN (SELECT count(*) = count(DISTINCT c_nationkey) FROM customer) THEN 'fail' ELSE 'pass' END""")
def v_report(spark, sf):
    df = _t(spark, sf, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") != 2, F.col("l_tax")))
    orders = _t(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 2 == 1).alias("odd")).first()
    n, odd = 4 * orders["n"], 4 * orders["odd"]  # four lines an order are expected; odd orders' lines are taken out in two steps
    rules = {
        "unit_key": ["l_orderkey", "l_linenumber"], "expected_n": n, "variables": [{"name": "l_quantity", "type": "integer"}, {"name": "l_tax", "type": "float"}, {"name": "gone", "type": "float"}],
        "sample_flow_steps": [{"n_before": n + 2 * odd, "n_removed": odd, "n_after": n + odd}, {"n_before": n + odd, "n_removed": odd, "n_after": n}], "merge_spec": {"left_key": "c_nationkey", "right_key": "n_nationkey", "expected_relationship": "m:1"},
    }
    report = validate(df, rules, (_t(spark, sf, "customer"), _t(spark, sf, "nation")))
    return spark.createDataFrame([(c["check_id"], c["status"]) for c in report["checks"]], "check_id string, status string")


@query("v_missingness", "SELECT CAST(count_if(x IS NULL) AS BIGINT) AS nulls, round(count_if(x IS NULL) / count(*), 6) AS rate FROM (SELECT CASE WHEN l_linenumber <> 2 THEN l_tax END AS x FROM lineitem)")
def v_missingness(spark, sf):
    x = F.when(F.col("l_linenumber") != 2, F.col("l_tax"))
    return _t(spark, sf, "lineitem").agg(F.count_if(x.isNull()).alias("nulls"), F.round(F.count_if(x.isNull()) / F.count(F.lit(1)), 6).alias("rate"))


@query("v_key_unique", "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS n_unique, CAST(floor(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / 2) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def v_key_unique(spark, sf):
    from panelkit.operators.validate import key_facts

    f = key_facts(_t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return spark.createDataFrame([(f["rows"], f["n_unique"], f["duplicates"])], "rows long, n_unique long, duplicates long")


# ---- statistics -------------------------------------------------------------------------

_WITHIN = f"""p AS ({_SUPPLIER_YEAR}), d AS (SELECT supplier, year, """ + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY supplier) - avg({c}) OVER (PARTITION BY year) + avg({c}) OVER () AS {a}" for c, a in (("revenue", "y"), ("qty", "a"), ("discount", "b"))) + """ FROM p),
m AS (SELECT sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*y) AS ay, sum(b*y) AS b_y, count(*) AS n, count(DISTINCT supplier) AS g, count(DISTINCT year) AS t FROM d),
s AS (SELECT *, (bb*ay - ab*b_y) / (aa*bb - ab*ab) AS b1, (aa*b_y - ab*ay) / (aa*bb - ab*ab) AS b2 FROM m),
c AS (SELECT supplier, sum(a * (y - b1*a - b2*b)) AS sa, sum(b * (y - b1*a - b2*b)) AS sb FROM d, s GROUP BY supplier),
q AS (SELECT sum(sa*sa) AS paa, sum(sa*sb) AS pab, sum(sb*sb) AS pbb FROM c),
v AS (SELECT b1, b2, g / (g - 1) * (n - 1) / (n - (2 + t)) AS k, (aa*bb - ab*ab) AS det, aa, ab, bb, paa, pab, pbb FROM s, q)"""


@query("panel_fe_cluster_se", f"""WITH {_WITHIN}
SELECT 'qty' AS term, round(b1, 5) AS estimate, round(sqrt(k * (bb*bb*paa - 2*bb*ab*pab + ab*ab*pbb)) / det, 5) AS std_error FROM v UNION ALL
SELECT 'discount', round(b2, 1), round(sqrt(k * (ab*ab*paa - 2*ab*aa*pab + aa*aa*pbb)) / det, 1) FROM v""")
def panel_fe_cluster_se(spark, sf):
    e = stats.panel_fe(supplier_year(spark, sf), "revenue", ["qty", "discount"], "supplier", "year")
    rows = [(n, float(b), float(s), p) for n, b, s, p in zip(e.names, e.beta, e.se, (5, 1))]
    df = spark.createDataFrame(rows, "term string, b double, s double, p int")
    five = F.col("p") == 5
    return df.select("term", F.when(five, F.round("b", 5)).otherwise(F.round("b", 1)).alias("estimate"), F.when(five, F.round("s", 5)).otherwise(F.round("s", 1)).alias("std_error"))


@query("iv_2sls", "SELECT round(covar_pop(l_tax, l_extendedprice) / covar_pop(l_tax, l_quantity), 2) AS beta FROM (SELECT l_tax + l_quantity / 50 AS l_tax, l_extendedprice, l_quantity FROM lineitem)")
def iv_2sls(spark, sf):
    df = _t(spark, sf, "lineitem").select((F.col("l_tax") + F.col("l_quantity") / 50).alias("z"), "l_extendedprice", "l_quantity")
    e = stats.iv_2sls(df, "l_extendedprice", [], "l_quantity", ["z"])
    return spark.createDataFrame([(float(e.beta[-1]),)], "beta double").select(F.round("beta", 2).alias("beta"))


_P = "(SELECT p_partkey, p_brand, ((p_partkey * 7919) % 10007) / 10007.0 AS p FROM part)"


@query("holm_bh", f"""
WITH r AS (SELECT p_partkey, p_brand, CAST(p AS DOUBLE) AS p, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS m FROM {_P})
SELECT p_partkey, p_brand, round(p, 9) AS p, round(least(1.0, max((m - i + 1) * p) OVER (PARTITION BY p_brand ORDER BY i)), 9) AS holm,
  round(least(1.0, min(p * m / i) OVER (PARTITION BY p_brand ORDER BY i DESC)), 9) AS bh FROM r""")
def holm_bh(spark, sf):
    df = _t(spark, sf, "part").select("p_partkey", "p_brand", ((F.col("p_partkey") * 7919) % 10007 / 10007.0).cast("double").alias("p"))
    return stats.adjust(df, "p", ["p_brand"], ["p_partkey"]).withColumns({c: F.round(c, 9) for c in ("p", "holm", "bh")})


@query("a_condition_share", "SELECT round(count_if(event_type = 'purchase') / count(*), 9) AS share, CAST(count_if(event_type = 'purchase') AS BIGINT) AS count FROM events")
def a_condition_share(spark, sf):
    return _t(spark, sf, "events").agg(*artifacts.share(F.col("event_type") == "purchase")).withColumn("share", F.round("share", 9))


@query("engine_compare", """
WITH s AS (SELECT l_suppkey AS k, sum(l_quantity) AS a FROM lineitem GROUP BY 1), t AS (SELECT k, a, CASE WHEN k % 7 = 0 THEN a * 1.5 ELSE a END AS b FROM s)
SELECT k, round(abs(a - b) / b, 9) AS relative_error, CASE WHEN k % 5 = 0 THEN 'UNRESOLVED' WHEN k % 7 = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM t""")
def engine_compare(spark, sf):
    mine = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    theirs = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg((F.avg("l_quantity") * F.count("l_quantity")).alias("v"))
    theirs = theirs.select("k", F.when(F.col("k") % 7 == 0, F.col("v") * 1.5).otherwise(F.col("v")).alias("v"))
    return stats.compare_engines(mine, theirs, ["k"], "v", F.col("k") % 5 != 0).withColumn("relative_error", F.round("relative_error", 9))


@query("adjusted_compare", """
WITH r AS (SELECT n_nationkey AS k, n_nationkey / 25.0 AS p FROM nation), s AS (SELECT k, p, CASE WHEN k % 6 = 1 THEN p / 2 ELSE p * 1.01 END AS holm FROM r)
SELECT k, 'raw_p_cross_engine' AS check, 'PASS' AS verdict FROM s UNION ALL SELECT k, 'holm_cross_engine', CASE WHEN k % 4 = 2 THEN 'FAIL' ELSE 'PASS' END FROM s UNION ALL
SELECT k, 'holm_not_below_raw', CASE WHEN holm < p - 1e-14 THEN 'FAIL' ELSE 'PASS' END FROM s""")
def adjusted_compare(spark, sf):
    p = F.col("n_nationkey") / 25.0
    raw = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), p.cast("double").alias("p"))
    mine = raw.withColumn("holm", F.when(F.col("k") % 6 == 1, F.col("p") / 2).otherwise(F.col("p") * 1.01))
    theirs = mine.withColumn("holm", F.when(F.col("k") % 4 == 2, F.col("holm") + 0.001).otherwise(F.col("holm")))
    return stats.adjusted_problems(raw, mine, theirs, ["k"], ("holm",))


# ---- linkage ----------------------------------------------------------------------------


def _records(spark, sf):
    """Documents as records: their whole texts as titles, DOIs on some."""
    d = _t(spark, sf, "documents")
    doi = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("https://doi.org/10.1234/ABC"), (F.col("doc_id") % 50).cast("string"))).when(F.col("doc_id") % 5 == 1, F.lit("10.66/no"))
    people = F.array(F.struct(F.lit("A").alias("given"), F.col("lang").alias("family")))
    return d.select(F.col("text").alias("title"), doi.alias("doi"), people.alias("authors"), F.lit(2000).alias("year"), "source", F.col("doc_id").cast("string").alias("source_id"))


@query("l_title_key", r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS k FROM documents")
def l_title_key(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.title_key(F.col("text")).alias("k"))


@query("l_doi", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN lower('10.1234/ABC' || (doc_id % 50)) END AS doi, CASE WHEN doc_id % 5 = 1 THEN 'malformed' WHEN doc_id % 5 <> 0 THEN 'missing' END AS reason FROM documents")
def l_doi(spark, sf):
    df = _records(spark, sf)
    return df.select(F.col("source_id").cast("long").alias("doc_id"), text.canonical_doi(F.col("doi")).alias("doi"), text.doi_reason(F.col("doi")).alias("reason"))


@query("l_record_id", "SELECT doc_id, 'rec_' || substr(sha256(source || '|' || doc_id || '|' || lang), 1, 12) AS rid FROM documents")
def l_record_id(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.record_id(F.col("source"), F.col("doc_id").cast("string"), F.col("lang")).alias("rid"))


@query("l_dedupe_components", """
WITH RECURSIVE t AS (SELECT doc_id, md5(text) AS k FROM documents),
e AS (SELECT doc_id AS u, min(doc_id) OVER (PARTITION BY k) AS v FROM t UNION SELECT doc_id, doc_id - doc_id % 50 FROM t WHERE doc_id % 50 = 7),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
c AS (SELECT doc_id AS id, doc_id AS label FROM t UNION SELECT b.v, c.label FROM c JOIN b ON c.id = b.u)
SELECT lpad(CAST(id AS VARCHAR), 12, '0') AS record_id, lpad(CAST(min(label) AS VARCHAR), 12, '0') AS label FROM c GROUP BY id""")
def l_dedupe_components(spark, sf):
    d = _t(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("record_id"), "doc_id", F.md5(F.encode("text", "UTF-8")).alias("k"))
    first = d.groupBy("k").agg(F.min("record_id").alias("v"))
    same = d.join(first, "k").select(F.col("record_id").alias("u"), "v")
    more = d.where("doc_id % 50 = 7").select(F.col("record_id").alias("u"), F.lpad((F.col("doc_id") - F.col("doc_id") % 50).cast("string"), 12, "0").alias("v"))
    return linkage.components(d.select("record_id"), same.unionByName(more).where("u <> v"))


@query("l_groups", r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, lower(coalesce(lang, '')) AS fam, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS title, CASE WHEN doc_id % 5 = 0 THEN '10.1234/abc' || (doc_id % 50) END AS doi FROM documents
), r AS (
  SELECT 'rec_' || substr(sha256(coalesce(source, '') || '|' || doc_id || '|' || title), 1, 12) AS rid, source, doc_id, fam, doi, trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')) AS k FROM t
), h AS (
  SELECT *, min(rid) OVER (PARTITION BY doi) AS by_doi, min(rid) OVER (PARTITION BY source, doc_id) AS by_id, first_value(rid) OVER w AS by_key, first_value(doi) OVER w AS key_doi FROM r WINDOW w AS (PARTITION BY k, fam ORDER BY rid)
), e AS (
  SELECT rid AS u, by_doi AS v FROM h WHERE doi IS NOT NULL UNION SELECT rid, by_id FROM h UNION SELECT rid, by_key FROM h WHERE doi IS NULL OR key_doi IS NULL OR doi = key_doi
), b AS (
  SELECT u, v FROM e UNION SELECT v, u FROM e
), c AS (
  SELECT rid AS id, rid AS label FROM r UNION SELECT b.v, c.label FROM c JOIN b ON c.id = b.u
), l AS (
  SELECT id, min(label) AS label FROM c GROUP BY id
), g AS (
  SELECT label, list_sort(list(rid)) AS ids, count(*) AS n, count(DISTINCT doi) AS dois, count(DISTINCT nullif(k, '')) AS titles, count(DISTINCT nullif(fam, '')) AS fams,
    list_sort(list(DISTINCT doi) FILTER (doi IS NOT NULL)) AS dl, list_sort(list(DISTINCT source) FILTER (source <> '')) AS sl FROM r JOIN l ON r.rid = l.id GROUP BY label
), d AS (
  SELECT *, CASE WHEN n = 1 THEN 'single' WHEN dois = 1 AND titles <= 1 AND fams <= 1 THEN 'canonical_doi' WHEN dois = 1 AND titles <= 1 THEN 'author_conflict' WHEN dois > 1 THEN 'doi_conflict' WHEN titles > 1 THEN 'identity_conflict' ELSE 'source_id_or_normalized' END AS rule,
    CASE WHEN dois = 1 AND titles <= 1 AND fams <= 1 THEN 1 WHEN dois > 1 THEN 2 WHEN dois = 1 THEN 3 WHEN len(sl) >= 2 AND titles <= 1 AND fams <= 1 THEN 4 WHEN len(sl) = 1 OR titles = 1 THEN 5 ELSE 6 END AS branch FROM g
)
SELECT array_to_string(ids, ',') AS record_ids, n AS member_count, rule, CASE WHEN rule = 'single' THEN 'distinct' WHEN rule LIKE '%conflict' THEN 'conflict' ELSE 'dedupe_same' END AS decision,
  ['verified', 'conflicting', 'conflicting', 'verified', 'partially_verified', 'unresolved'][branch] AS state,
  ['authoritative_doi,core_fields_compatible', 'multiple_dois', 'doi_identity_conflict', 'multi_source_agreement,no_doi', 'single_source_or_incomplete,no_doi', 'insufficient_evidence,no_doi'][branch] AS reason_codes,
  CASE WHEN branch = 1 THEN dl[1] END AS doi, CASE WHEN branch IN (2, 3) THEN array_to_string(dl, ',') END AS dois, array_to_string(sl, ',') AS sources FROM d""")
def l_groups(spark, sf):
    found = linkage.verified(linkage.groups(linkage.normalize_records(_records(spark, sf))))
    lists = {"record_ids": "record_ids", "reason_codes": "reason_codes", "dois": "evidence.dois", "sources": "evidence.sources"}
    return found.select("member_count", "rule", "decision", "state", F.col("evidence.doi").alias("doi"), *[F.array_join(c, ",").alias(n) for n, c in lists.items()])


_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'success_zero_records' WHEN 1 THEN 'source_unavailable' WHEN 2 THEN 'malformed_response' ELSE 'success' END"


@query("l_workflow_status", f"""
WITH s AS (SELECT o_custkey, {_STATUS} AS s FROM orders), t AS (SELECT o_custkey, count_if(s = 'success') AS ok, count_if(s = 'success_zero_records') AS none, count_if(s IN ('source_unavailable', 'malformed_response')) AS bad FROM s GROUP BY 1)
SELECT o_custkey, CASE WHEN ok + none = 0 THEN 'source_unavailable' WHEN bad > 0 THEN 'completed_degraded' WHEN ok > 0 THEN 'completed' ELSE 'completed_zero_results' END AS workflow_status FROM t""")
def l_workflow_status(spark, sf):
    return linkage.workflow_status(_t(spark, sf, "orders").select("o_custkey", F.expr(_STATUS).alias("status")), ["o_custkey"])


# ---- artifacts --------------------------------------------------------------------------


@query("i_fk_orphans", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def i_fk_orphans(spark, sf):
    return artifacts.orphans(_t(spark, sf, "labels"), _t(spark, sf, "documents").where("doc_id % 3 <> 0"), "doc_id", "doc_id").select("doc_id", "quality", "toxic")


@query("i_duplicate_ids", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def i_duplicate_ids(spark, sf):
    return artifacts.duplicate_ids(_t(spark, sf, "lineitem"), "l_orderkey")


@query("i_numeric_sanity", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.06 THEN 'p_out_of_range' WHEN l_discount > 0.05 THEN 'outside_interval' END AS problem FROM lineitem")
def i_numeric_sanity(spark, sf):
    e, d, t = F.lit(1.0), F.col("l_discount"), F.col("l_tax")
    found = artifacts.numeric_problems(e, F.when(d > 0.05, 2.0).otherwise(0.0), F.lit(2.0), F.when(t > 0.06, 1.5).otherwise(t))
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", found.alias("problem"))


@query("i_broken_flow", "SELECT event_id FROM (SELECT event_id, event_id % 10 AS b, lag(CASE WHEN event_id % 10 = 4 THEN 0 ELSE event_id % 10 + 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS p, event_id % 10 = 4 AS bad FROM events) WHERE bad OR p <> b")
def i_broken_flow(spark, sf):
    e = F.col("event_id") % 10
    steps = _t(spark, sf, "events").select("event_id", "user_id", "ts", e.alias("n_before"), F.lit(-1).alias("n_removed"), F.when(e == 4, 0).otherwise(e + 1).alias("n_after"))
    return artifacts.broken_flow(steps, "ts", "user_id").select("event_id")


@query("i_stamp", "SELECT CAST(c_custkey AS VARCHAR) AS model_id, coalesce(list_sort(list(DISTINCT CAST(o_orderkey AS VARCHAR)) FILTER (o_orderkey IS NOT NULL)), []) AS estimate_ids FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def i_stamp(spark, sf):
    models = _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("model_id"))
    estimates = _t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("model_id"), F.col("o_orderkey").cast("string").alias("estimate_id"))
    return artifacts.stamp(models, estimates, "model_id", "estimate_id")


@query("r_ordered_lookup", "SELECT CAST(pos AS INTEGER) AS pos, n_nationkey, n_name FROM (SELECT unnest([7, 3, 99, 3]) AS n_nationkey, unnest([0, 1, 2, 3]) AS pos) LEFT JOIN nation USING (n_nationkey)")
def r_ordered_lookup(spark, sf):
    ids = spark.createDataFrame([([7, 3, 99, 3],)], "ids array<int>")
    return artifacts.ordered_lookup(ids, _t(spark, sf, "nation").select("n_nationkey", "n_name"), "ids", "n_nationkey").select("pos", "n_nationkey", "n_name")


@query("a_status_rollup", "SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END) WHEN 2 THEN 'blocked' WHEN 1 THEN 'needs_decision' ELSE 'ready' END AS status FROM orders GROUP BY 1")
def a_status_rollup(spark, sf):
    s = F.when(F.col("o_orderstatus") == "F", "blocked").when(F.col("o_orderstatus") == "P", "needs_decision").otherwise("ready")
    return _t(spark, sf, "orders").groupBy("o_custkey").agg(artifacts.worst(s).alias("status"))


_MODELS = "(SELECT 'm' || c_custkey AS model_id, CAST(c_custkey % 7 AS DOUBLE) AS n FROM customer WHERE c_custkey % 11 <> 0)"
_ESTIMATES = """(SELECT 'e' || o_orderkey AS estimate_id, 'm' || o_custkey AS model_id, CASE WHEN o_orderkey % 13 = 0 THEN 0.5 ELSE 2.0 END AS high, CASE WHEN o_orderkey % 17 = 0 THEN 1.5 ELSE 0.5 END AS p,
  CAST(o_custkey % 7 + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS n, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 't' END AS term FROM orders)"""


@query("i_bundle_problems", f"""
WITH m AS {_MODELS}, e AS {_ESTIMATES}, k AS (SELECT e.*, m.model_id AS known, m.n AS model_n FROM e LEFT JOIN m USING (model_id))
SELECT 'missing_field' AS check, 'estimates' AS artifact, estimate_id AS item, 'term' AS detail FROM e WHERE term IS NULL UNION ALL
SELECT 'unknown_model', 'estimates', estimate_id, model_id FROM k WHERE known IS NULL UNION ALL
SELECT 'sample_size', 'estimates', estimate_id, CAST(n AS VARCHAR) || ' <> ' || CAST(model_n AS VARCHAR) FROM k WHERE known IS NOT NULL AND n <> model_n UNION ALL
SELECT 'number', 'estimates', estimate_id, CASE WHEN p > 1 THEN 'p_out_of_range' ELSE 'outside_interval' END FROM e WHERE p > 1 OR high < 1 UNION ALL
SELECT 'repeated_id', 'model_registry', 'm1', '2'""")
def i_bundle_problems(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    text_fields = ("capability_id", "implementation_id", "runtime", "sample_id", "outcome", "code_ref", "result_ref")
    models = c.where("c_custkey % 11 <> 0").select(F.expr("concat('m', c_custkey)").alias("model_id"), *[F.lit("x").alias(f) for f in text_fields], F.expr("double(c_custkey % 7)").alias("n"))
    models = models.unionByName(models.where("model_id = 'm1'"))
    estimates = o.select(
        F.expr("concat('e', o_orderkey)").alias("estimate_id"), F.expr("concat('m', o_custkey)").alias("model_id"), F.when(F.col("o_orderkey") % 23 != 0, "t").alias("term"), F.lit(1.0).alias("estimate"), F.lit(1.0).alias("std_error"),
        F.lit(0.0).alias("ci_lower"), F.when(F.col("o_orderkey") % 13 == 0, 0.5).otherwise(2.0).alias("ci_upper"), F.when(F.col("o_orderkey") % 17 == 0, 1.5).otherwise(0.5).alias("p_value"),
        F.expr("double(o_custkey % 7 + if(o_orderkey % 19 = 0, 1, 0))").alias("n"),
    )
    return bundle.item_problems(bundle.Bundle(spark, items={"model_registry": models, "estimates": estimates}))


@query("i_stale_views", """
WITH r AS (SELECT p_partkey, p_partkey % 5 AS a, p_partkey % 3 AS h FROM part)
SELECT 'view_unknown_artifact' AS check, 'presentation_manifest' AS artifact, 'v' || p_partkey AS item, 'a' || a AS detail FROM r WHERE a = 4 UNION ALL
SELECT 'view_stale', 'presentation_manifest', 'v' || p_partkey, 'a' || a FROM r WHERE a <> 4 AND h = 1 UNION ALL
SELECT 'view_unknown_item', 'presentation_manifest', 'v' || p_partkey, CAST(p_partkey AS VARCHAR) FROM r WHERE a = 0 AND p_partkey % 2 = 1""")
def i_stale_views(spark, sf):
    part = _t(spark, sf, "part").select("p_partkey", F.expr("concat('a', p_partkey % 5)").alias("a"))
    digest = F.when(F.col("p_partkey") % 3 == 1, "old").otherwise("now")
    items = F.when(F.col("a") == "a0", F.array(F.col("p_partkey").cast("string")))
    ref = F.struct(F.col("a").alias("artifact_id"), items.alias("item_ids"), digest.alias("source_hash"), F.lit(bundle.CANONICAL).alias("source_hash_mode"))
    views = part.select(F.expr("concat('v', p_partkey)").alias("view_id"), F.lit("table").alias("view_type"), F.lit("o").alias("output_ref"), F.array(ref).alias("source_refs"))
    facts = _t(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("fact_id"))
    names = ("descriptive_facts", "data_manifest", "estimates", "diagnostics")
    b = bundle.Bundle(spark, {n: {"artifact_id": f"a{i}"} for i, n in enumerate(names)}, {"presentation_manifest": views, "descriptive_facts": facts}, dict.fromkeys(names, "now"))
    return bundle.view_problems(b)


@query("u_union_records", "SELECT 'crossref' AS source, CAST(s_suppkey AS VARCHAR) AS source_id, s_name AS title, s_nationkey AS year FROM supplier UNION ALL SELECT 'openalex', CAST(c_custkey AS VARCHAR), c_name, NULL FROM customer")
def u_union_records(spark, sf):
    a = _t(spark, sf, "supplier").select(F.lit("crossref").alias("source"), F.col("s_suppkey").cast("string").alias("source_id"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("year"))
    b = _t(spark, sf, "customer").select(F.col("c_name").alias("title"), F.col("c_custkey").cast("string").alias("source_id"), F.lit("openalex").alias("source"))
    return literature.union_records([a, b])


@query("h_unknown_codes", "SELECT DISTINCT c_mktsegment AS code FROM customer WHERE c_mktsegment <> 'BUILDING'")
def h_unknown_codes(spark, sf):
    return unknown_codes(_t(spark, sf, "customer"), "c_mktsegment", {"BUILDING": "b"})


@query("a_state_counts", f"SELECT {_STATUS} AS state, count(*) AS n FROM orders GROUP BY 1")
def a_state_counts(spark, sf):
    return literature.state_counts(_t(spark, sf, "orders").select(F.expr(_STATUS).alias("state")))


@query("l_date_parts", "SELECT o_orderkey, CAST(nullif(o_orderkey % 3, 0) AS INTEGER) AS year, CAST(o_orderkey % 12 AS INTEGER) AS month FROM orders")
def l_date_parts(spark, sf):
    o = _t(spark, sf, "orders")
    bare, full = text.date_parts((F.col("o_orderkey") % 3).cast("string"), semantics="year"), text.date_parts(F.lit(2000), F.col("o_orderkey") % 12)
    return o.select("o_orderkey", bare["year"].alias("year"), full["month"].alias("month"))


@query("l_numbered", "SELECT 'G' || (row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1) AS group_id, CAST(c_custkey AS VARCHAR) AS record_ids FROM customer")
def l_numbered(spark, sf):
    found = _t(spark, sf, "customer").select(F.array(F.col("c_custkey").cast("string")).alias("record_ids"))
    return linkage.numbered(found).select("group_id", F.array_join("record_ids", ",").alias("record_ids"))

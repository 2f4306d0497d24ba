"""Estimators: aggregates of fixed size on the executors, k x k algebra on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled


def demean_two_way(df: DataFrame, unit: str, period: str, columns: list[str]) -> DataFrame:
    """y - unit mean - period mean + grand mean: exact for balanced panels."""
    overall = df.agg(*[F.avg(c).alias(f"_all_{c}") for c in columns])
    units = df.groupBy(unit).agg(*[F.avg(c).alias(f"_u_{c}") for c in columns])
    periods = df.groupBy(period).agg(*[F.avg(c).alias(f"_p_{c}") for c in columns])
    grand = overall.first()
    joined = df.join(units, unit).join(periods, period)
    return joined.select(unit, period, *[(F.col(c) - F.col(f"_u_{c}") - F.col(f"_p_{c}") + F.lit(grand[f"_all_{c}"])).alias(c) for c in columns])


def is_balanced(df: DataFrame, unit: str, period: str) -> bool:
    """One row for every unit in every period."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(unit).alias("u"), F.countDistinct(period).alias("p"), F.countDistinct(unit, period).alias("c")).first()
    return r["n"] == r["c"] == r["u"] * r["p"]


#: Periods up to which absorption solves their system at once; conjugate gradients beyond.
DENSE = 512


def absorb_two_way(df: DataFrame, unit: str, period: str, columns: list[str], dense: int | None = None) -> DataFrame:
    """The residuals of columns on unit and period effects: exact for panels with gaps.

    Units are eliminated, which leaves a system as large as there are periods: row counts of the periods less what the
    units' means share. It is summed over units, each a pair of its periods at a time, and solved on the driver; with
    more than ``dense`` periods it is never formed, but applied in turns (``_conjugate``). Where the panel falls
    apart, the effects are not unique but the residuals are. The rows are written once and joined to unit means twice.
    """
    data = settled(df.select(unit, period, *columns))
    mean = lambda of: of.groupBy(F.col(unit).alias("_u")).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])

    def within(of: DataFrame) -> DataFrame:
        means = mean(of)
        return of.join(means, of[unit] == means["_u"]).select(unit, period, *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns])

    sums = within(data).groupBy(period).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in columns]).orderBy(period).collect()
    at = {r[period]: i for i, r in enumerate(sums)}
    right = np.array([[r[c] for c in columns] for r in sums], float).reshape(len(sums), len(columns))
    n = np.array([r["_n"] for r in sums], float)
    cells = data.groupBy(unit, period).agg(F.count(F.lit(1)).alias("_n"))
    if len(sums) <= (DENSE if dense is None else dense):
        lists = cells.groupBy(unit).agg(F.collect_list(F.struct(F.col(period).alias("t"), F.col("_n").alias("n"))).alias("_v"), F.sum("_n").alias("_m"))
        pairs = lists.select("_v", "_m", F.explode("_v").alias("_a")).select("_m", "_a", F.explode("_v").alias("_b")).where("_a.t <= _b.t")
        system = np.diag(n)
        for r in pairs.groupBy(F.col("_a.t").alias("a"), F.col("_b.t").alias("b")).agg(F.sum(F.col("_a.n") * F.col("_b.n") / F.col("_m")).alias("s")).collect():
            system[at[r["a"]], at[r["b"]]] -= r["s"]
            if r["a"] != r["b"]:
                system[at[r["b"]], at[r["a"]]] -= r["s"]
        effects = np.linalg.lstsq(system, right, rcond=1e-12)[0]
    else:
        effects = _conjugate(settled(cells), unit, period, list(at), n, right)
    table = df.sparkSession.createDataFrame([(t, *map(float, effects[i])) for t, i in at.items()], [period, *[f"_e_{c}" for c in columns]]) if at else None
    if table is None:
        return data
    table = table.select(F.col(period).cast(data.schema[period].dataType).alias("_t"), *[f"_e_{c}" for c in columns])
    return within(data.join(table, data[period] == table["_t"]).select(unit, period, *[(F.col(c) - F.col(f"_e_{c}")).alias(c) for c in columns]))


def _conjugate(cells: DataFrame, unit: str, period: str, periods: list, n: np.ndarray, right: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Conjugate gradients on the periods' system, scaled by its diagonal; a product is two aggregations of the cells.

    Vectors are as long as there are periods, and on the driver. Raises RuntimeError without convergence.
    """
    spark, k = cells.sparkSession, right.shape[1]
    kind = cells.schema[period].dataType

    def applied(v: np.ndarray) -> np.ndarray:
        held = spark.createDataFrame([(t, *map(float, v[i])) for i, t in enumerate(periods)], [period, *[f"_v{j}" for j in range(k)]])
        held = held.select(F.col(period).cast(kind).alias("_t"), *[f"_v{j}" for j in range(k)])
        known = cells.join(held, cells[period] == held["_t"])
        shares = known.groupBy(F.col(unit).alias("_u")).agg(*[(F.sum(F.col("_n") * F.col(f"_v{j}")) / F.sum("_n")).alias(f"_s{j}") for j in range(k)])
        back = cells.join(shares, cells[unit] == shares["_u"]).groupBy(period).agg(*[F.sum(F.col("_n") * F.col(f"_s{j}")).alias(f"_s{j}") for j in range(k)]).collect()
        place = {t: i for i, t in enumerate(periods)}
        out = n[:, None] * v
        for r in back:
            out[place[r[period]]] -= [r[f"_s{j}"] for j in range(k)]
        return out

    x, r = np.zeros_like(right), right.copy()
    z = r / n[:, None]
    p, rz = z.copy(), (r * z).sum(0)
    goal = 1e-26 * np.maximum(rz, 1e-300)
    for _ in range(rounds):
        if (rz <= goal).all():
            return x
        q = applied(p)
        down = (p * q).sum(0)
        a = np.where((down > 0) & (rz > goal), rz / np.where(down > 0, down, 1), 0)
        x, r = x + a * p, r - a * q
        z = r / n[:, None]
        new = (r * z).sum(0)
        p = z + np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0) * p
        rz = new
    raise RuntimeError("conjugate gradients did not settle")


def cross_products(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """Sums of products, in one pass."""
    row = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"_{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right)]).first()
    return np.array(row, float).reshape(len(left), len(right))


@dataclass
class Estimate:
    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    n: int
    df_resid: int
    facts: dict = field(default_factory=dict)


#: Other definitions of the clustered covariance's scale, which some packages use: whether all absorbed effects
#: count as parameters, regressors do, and clusters are few. None is the canonical one. Fixed values.
VARIANTS = {
    "A": {"count_effects": True, "debiased": True, "group_debias": False},
    "B": {"count_effects": True, "debiased": True, "group_debias": False},
    "C": {"count_effects": False, "debiased": True, "group_debias": False},
    "D": {"count_effects": True, "debiased": False, "group_debias": False},
    "E": {"count_effects": True, "debiased": True, "group_debias": True},
    "F": {"count_effects": False, "debiased": True, "group_debias": True},
}


def cluster_factor(n: int, regressors: int, units: int, periods: int, variant: str | None = None) -> float:
    """What a clustered covariance is scaled by. Canonical: G/(G-1) * (N-1)/(N-K), K = regressors + periods."""
    few = units / (units - 1) * (n - 1)
    if variant is None:
        return few / (n - regressors - periods)
    v = VARIANTS[variant]
    scale = n / (n - (regressors if v["debiased"] else 0) - (units + periods - 1 if v["count_effects"] else 0))
    return scale * (few / n if v["group_debias"] else 1.0)


def panel_fe(df: DataFrame, y: str, x: list[str], unit: str, period: str, covariance: str = "cluster", variant: str | None = None) -> Estimate:
    """Two-way fixed effects with standard errors clustered by unit, or iid ones.

    Unit effects are nested in the cluster; degrees of freedom G - 1. ``variant``: see VARIANTS.
    """
    data = df.select(F.col(unit).alias("_unit"), F.col(period).alias("_period"), *[F.col(c).cast("double").alias(c) for c in (y, *x)]).dropna()
    shape = data.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_unit").alias("u"), F.countDistinct("_period").alias("p")).first()
    n, p = shape["n"], len(x)
    take_off = demean_two_way if is_balanced(data, "_unit", "_period") else absorb_two_way
    within = take_off(data, "_unit", "_period", [y, *x]).persist()
    try:
        xx, xy = cross_products(within, x, x), cross_products(within, x, [y])[:, 0]
        beta = np.linalg.solve(xx, xy)
        resid = F.col(y) - sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, x)), F.lit(0.0))
        scored = within.withColumn("_e", resid)
        inv = np.linalg.inv(xx)
        if covariance == "iid":
            dof = n - p - (shape["u"] + shape["p"] - 1)
            sigma = scored.agg(F.sum(F.col("_e") * F.col("_e"))).first()[0] / dof
            cov, facts = sigma * inv, {"sigma2": sigma}
        else:
            sums = scored.groupBy("_unit").agg(*[F.sum(F.col(c) * F.col("_e")).alias(c) for c in x])
            g, k = shape["u"], p + shape["p"]
            factor = cluster_factor(n, p, g, shape["p"], variant)
            cov, dof, facts = factor * inv @ cross_products(sums, x, x) @ inv, g - 1, {"clusters": g, "k": k, "factor": factor}
    finally:
        within.unpersist()
    return Estimate(list(x), beta, np.sqrt(np.diag(cov)), n, dof, facts)


def iv_2sls(df: DataFrame, y: str, exogenous: list[str], endogenous: str, instruments: list[str]) -> Estimate:
    """2SLS with an intercept, homoskedastic, with the weak-instrument diagnostics.

    One pass of centred cross-products; inference is normal. Over-identification is not applicable
    when there are as many instruments as endogenous variables.
    """
    names = list(dict.fromkeys([*exogenous, *instruments, endogenous, y]))
    data = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    # Centred products, merged without cancellation however far the means lie from zero; the intercept is absorbed.
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = data.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    n, at = row["n"], {c: i for i, c in enumerate(names)}
    m = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] * n for j in range(len(names))] for i in range(len(names))], float)
    mean = np.array([row[f"m{i}"] for i in range(len(names))], float)
    pick = lambda a, b: m[np.ix_([at[c] for c in a], [at[c] for c in b])]
    w, xs, z = list(exogenous), [*exogenous, endogenous], [*exogenous, *instruments]
    k, q = len(z) + 1, len(instruments)
    zx, zz, zy = pick(z, xs), pick(z, z), pick(z, [y])
    proj = np.linalg.solve(zz, zx)
    a = zx.T @ proj
    beta = np.linalg.solve(a, proj.T @ zy)[:, 0]
    sigma = (m[at[y], at[y]] - 2 * beta @ pick(xs, [y])[:, 0] + beta @ pick(xs, xs) @ beta) / n
    cov, centre = sigma * np.linalg.inv(a), mean[[at[c] for c in xs]]
    intercept, spread = mean[at[y]] - beta @ centre, sigma / n + centre @ cov @ centre

    def ssr(target: str, on: list[str]) -> float:
        if not on:
            return float(m[at[target], at[target]])
        b = np.linalg.solve(pick(on, on), pick(on, [target]))[:, 0]
        return float(m[at[target], at[target]] - b @ pick(on, [target])[:, 0])

    def f_of(target: str) -> float:
        full = ssr(target, z)
        return ((ssr(target, w) - full) / q) / (full / (n - k))

    first, reduced = f_of(endogenous), f_of(y)
    facts = {
        "cragg_donald_f": first, "anderson_lm": n * q * first / (q * first + n - k), "anderson_rubin_f": reduced,
        "stock_wright_s": n * q * reduced / (q * reduced + n - k), "sargan": "not_applicable",
    }
    if q > 1:  # over-identified: residuals on all instruments, over sigma squared
        ze = zy[:, 0] - zx @ beta
        facts["sargan"] = float(ze @ np.linalg.solve(zz, ze) / sigma)
        facts["sargan_df"] = q - 1
    return Estimate(["_one", *xs], np.array([intercept, *beta]), np.sqrt(np.array([spread, *np.diag(cov)])), n, n, facts)


def _beta_cf(a: float, b: float, x: float) -> float:
    """The incomplete beta's continued fraction, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for i in range(1, 500):
        for step in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def t_pvalue(t: float, df: float) -> float:
    """Two-sided, by the tail itself: it doesn't cancel."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """By bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while t_pvalue(hi, df) / 2 > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_pvalue(mid, df) / 2 > 1 - p else (lo, mid)
    return (lo + hi) / 2


def confidence_interval(b: float, se: float, df: float, level: float = 0.95) -> tuple[float, float]:
    q = t_quantile(1 - (1 - level) / 2, df)
    return b - q * se, b + q * se


def normal_pvalue(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def adjust(df: DataFrame, p: str, family: list[str], order: list[str] = ()) -> DataFrame:
    """``df`` with the columns holm and bh, adjusted within each family of tests."""
    up = Window.partitionBy(*family).orderBy(F.col(p).asc(), *order)
    m, i = F.count(F.lit(1)).over(Window.partitionBy(*family)), F.row_number().over(up)
    raw = df.withColumns({"_h": (m - i + 1) * F.col(p), "_b": F.col(p) * m / i, "_i": i})
    rise = Window.partitionBy(*family).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    fall = Window.partitionBy(*family).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumns({"holm": F.least(F.lit(1.0), F.max("_h").over(rise)), "bh": F.least(F.lit(1.0), F.min("_b").over(fall))}).drop("_h", "_b", "_i")


def adjusted_problems(raw: DataFrame, mine: DataFrame, theirs: DataFrame, keys: list[str], methods: tuple[str, ...] = ("holm", "bh"), family: list[str] | None = None) -> DataFrame:
    """(keys, check, verdict) of adjusted p-values of two engines, p the raw value: E14.

    Raw values agree; adjusted ones agree, lie in [0, 1] and are no smaller than the raw one. With ``family``, the columns
    that tell families of tests apart, adjusted values must also rise with the raw ones.
    """
    a = mine.select(*keys, "p", *methods)
    b = theirs.select(*keys, F.col("p").alias("_p"), *[F.col(m).alias(f"_{m}") for m in methods])
    both = raw.select(*keys, F.col("p").alias("_raw")).join(a, keys, "left").join(b, keys, "left")
    unit = lambda c: F.col(c).between(0, 1)
    checks = {"raw_p_cross_engine": close(F.col("p"), F.col("_p")) & close(F.col("p"), F.col("_raw"))}
    for m in methods:
        checks[f"{m}_cross_engine"] = close(F.col(m), F.col(f"_{m}")) & unit(m) & unit(f"_{m}")
        checks[f"{m}_not_below_raw"] = F.col(m) >= F.col("_raw") - 1e-14
        if family is not None:
            both = both.withColumn(f"_before_{m}", F.lag(m).over(Window.partitionBy(*family).orderBy("_raw", m)))
            checks[f"{m}_monotone"] = F.col(f"_before_{m}").isNull() | (F.col(m) >= F.col(f"_before_{m}") - 1e-14)
    told = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("verdict")) for n, ok in checks.items()]))
    return both.select(*keys, told.alias("c")).select(*keys, "c.*")


def close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))


def compare_engines(mine: DataFrame, theirs: DataFrame, keys: list[str], value: str, same_definition: Column, tolerance: float = 1e-9) -> DataFrame:
    """PASS, FAIL, or UNRESOLVED where the two sides don't claim the same definition."""
    other = theirs.withColumnRenamed(value, "_other")
    joined = mine.join(other, keys, "full_outer")
    error = F.abs(F.col(value) - F.col("_other")) / F.greatest(F.abs("_other"), F.lit(1e-300))
    verdict = F.when(~same_definition, "UNRESOLVED").when(F.coalesce(error <= tolerance, F.lit(False)), "PASS").otherwise("FAIL")
    return joined.select(*keys, error.alias("relative_error"), verdict.alias("verdict"))


def overall_verdict(compared: DataFrame, engine: str, coefficients_agree: Column | None = None) -> DataFrame:
    """engine, alignment, verdict: what comparisons with a reference engine come to, a row an engine and one (engine null) over all.

    compared: rows (engine, verdict) of every engine but the reference. An engine is aligned if all of its rows pass, fails if
    one fails, and is unresolved otherwise. Over all: FAIL if an engine fails or coefficients disagree; PASS if
    there is an engine besides the reference and all are aligned; UNRESOLVED otherwise.
    """
    fine = F.coalesce(coefficients_agree, F.lit(False)) if coefficients_agree is not None else F.lit(True)
    tally = compared.groupBy(engine).agg(F.count_if(F.col("verdict") == "FAIL").alias("f"), F.count_if(F.col("verdict") == "UNRESOLVED").alias("u"), F.bool_and(fine).alias("c"))
    told = tally.select(engine, F.when(F.col("f") > 0, "FAIL").when(F.col("u") > 0, "UNRESOLVED").otherwise("ALIGNED").alias("alignment"), "c")
    of = lambda x: F.count_if(F.col("alignment") == x)
    whole = told.agg(of("FAIL").alias("f"), of("UNRESOLVED").alias("u"), of("ALIGNED").alias("a"), F.coalesce(F.bool_and("c"), F.lit(True)).alias("c"))
    verdict = F.when((F.col("f") > 0) | ~F.col("c"), "FAIL").when((F.col("u") == 0) & (F.col("a") > 0), "PASS").otherwise("UNRESOLVED")
    kind = compared.schema[engine].dataType
    return told.select(engine, "alignment", F.lit(None).cast("string").alias("verdict")).unionByName(whole.select(F.lit(None).cast(kind).alias(engine), F.lit(None).cast("string").alias("alignment"), verdict.alias("verdict")))

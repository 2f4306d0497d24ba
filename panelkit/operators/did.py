"""Staggered difference-in-differences: group-time effects, their aggregates and clustered inference.

A unit's rows meet once, in one exchange by unit: its outcomes by period become differences (base, period), which are
summed into cells (cohort, base, period) before they are shuffled. Everything else is arithmetic on the cells, of which there
are as many as cohorts times pairs of periods, whatever the number of units. An aggregate's influence function is
linear in a unit's differences, so its coefficients are a table of that size too, and a unit's (a cluster's) influence
is one sum over its differences; covariances are sums of products of these.

Conventions: ``cohort`` is the period from which a unit is treated, missing if it never is. Controls are units that
are not treated by the later of the two periods (plus the anticipated ones), or never treated ones. The base is the
last period before treatment (and anticipation); before that, the period before the one in question. Units
treated from the first period on have no base and take no part. Missing outcomes are passed over: a difference needs
both. Raises ValueError where a unit repeats a period, changes its cohort or its cluster, or where a key is missing.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Periods that a panel may have: cells grow with their square, times cohorts.
MOST_PERIODS = 512
AGGREGATES = ("simple", "dynamic", "group", "calendar")


class Staggered:
    """One panel's differences and cells."""

    def __init__(self, df: DataFrame, unit: str, period: str, cohort: str, y: str, control: str = "not_yet_treated", anticipation: int = 0, cluster: str | None = None):
        if control not in ("not_yet_treated", "never_treated"):
            raise ValueError(f"control {control!r} is not_yet_treated or never_treated")
        self.control, self.anticipation = control, anticipation
        data = df.select(
            F.col(unit).alias("_unit"), F.col(period).cast("long").alias("_t"), F.col(cohort).cast("long").alias("_g"),
            F.col(cluster or unit).cast("string").alias("_cluster"), F.col(y).cast("double").alias("_y"),
        )
        # A unit has a row a period at most: its map is as long as the panel.
        self.units = data.groupBy("_unit").agg(
            F.min("_g").alias("_g"), F.min("_cluster").alias("_cluster"), F.map_from_entries(F.collect_list(F.when(F.col("_y").isNotNull() & ~F.isnan("_y"), F.struct("_t", "_y")))).alias("_ys"),
            F.count(F.lit(1)).alias("_rows"), F.size(F.collect_set("_t")).alias("_periods"),
            (F.count_distinct(F.coalesce(F.col("_g"), F.lit(-(2**62)))) > 1).alias("_moves"), (F.count_distinct("_cluster") > 1).alias("_splits"),
        )
        self.periods = sorted(r["_t"] for r in data.select("_t").where("_t IS NOT NULL").distinct().limit(MOST_PERIODS + 1).collect())
        if len(self.periods) > MOST_PERIODS:
            raise ValueError(f"more than {MOST_PERIODS} periods")
        bad = data.agg(F.count_if(F.col("_unit").isNull() | F.col("_t").isNull() | F.col("_cluster").isNull()).alias("n")).first()["n"]
        if bad:
            raise ValueError(f"missing unit, period or cluster ({bad} rows)")
        # Cohorts and the units in each; those without a base take no part.
        sizes = self.units.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("_rows") > F.col("_periods")) | F.col("_moves") | F.col("_splits")).alias("bad")).collect()
        if wrong := sum(r["bad"] for r in sizes):
            raise ValueError(f"{wrong} units repeat a period or change their cohort or cluster")
        first = self.periods[0] if self.periods else 0
        # A cohort beyond the last period is never treated as far as the panel tells.
        self.sizes = {r["_g"]: r["n"] for r in sizes if r["_g"] is None or r["_g"] - anticipation > first}
        self.n = sum(self.sizes.values())
        treated = sorted(g for g in self.sizes if g is not None and self.periods and g <= self.periods[-1])
        self.wanted = [(g, t, b) for g in treated for t in self.periods[1:] if (b := self._base(g, t)) is not None]

    def _base(self, g: int, t: int) -> int | None:
        before = bisect_left(self.periods, min(t, g - self.anticipation) if t < g else g - self.anticipation)
        return self.periods[before - 1] if before else None

    def _controls(self, t: int, b: int, g: int) -> list[int | None]:
        return [c for c in self.sizes if c is None or (self.control == "not_yet_treated" and c != g and c > max(t, b) + self.anticipation)]

    def differences(self) -> DataFrame:
        """unit, cluster, cohort, base, period, d: what the wanted effects compare."""
        spark = self.units.sparkSession
        pairs = spark.createDataFrame(sorted({(b, t) for _, t, b in self.wanted}), "_b long, _t long")
        kept = self.units.where(F.col("_g").isNull() | F.col("_g").isin([g for g in self.sizes if g is not None]))
        rows = kept.select("_unit", "_cluster", "_g", "_ys", F.explode("_ys").alias("_t", "_y")).join(F.broadcast(pairs), "_t")  # at most MOST_PERIODS squared
        return rows.withColumn("_d", F.col("_y") - F.try_element_at("_ys", F.col("_b"))).where("_d IS NOT NULL").select("_unit", "_cluster", "_g", "_b", "_t", "_d")

    def cells(self) -> dict[tuple, tuple[int, float, float]]:
        """(cohort, base, period) -> (units, mean, sum of squares about it)."""
        found = self.differences().groupBy("_g", "_b", "_t").agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("m"), F.var_pop("_d").alias("v"))
        return {(r["_g"], r["_b"], r["_t"]): (r["n"], r["m"], r["v"] * r["n"]) for r in found.collect()}

    def effects(self) -> list[dict]:
        """cohort, period, base, n_treated, n_control, att, se of each group-time effect that the data tell."""
        cells, out = self.cells(), []
        for g, t, b in self.wanted:
            own = cells.get((g, b, t))
            others = [cells[c, b, t] for c in self._controls(t, b, g) if (c, b, t) in cells]
            if not own or not others:
                continue
            n = sum(x[0] for x in others)
            mean = sum(x[0] * x[1] for x in others) / n
            spread = sum(x[2] + x[0] * (x[1] - mean) ** 2 for x in others)
            out.append({"cohort": g, "period": t, "base": b, "n_treated": own[0], "n_control": n, "att": own[1] - mean, "se": (own[2] / own[0] ** 2 + spread / n**2) ** 0.5, "own_mean": own[1], "control_mean": mean})
        return out

    def att_gt(self) -> DataFrame:
        """The group-time effects as a frame. Standard errors are by unit."""
        rows = [tuple(e[k] for k in ("cohort", "period", "base", "n_treated", "n_control", "att", "se")) for e in self.effects()]
        return self.units.sparkSession.createDataFrame(rows, "cohort long, period long, base long, n_treated long, n_control long, att double, se double")

    def _weights(self, how: str, effects: list[dict]) -> dict[int, list[tuple[int, float, float]]]:
        """Target -> [(effect's place, weight, the cohort's share; 0 where weights don't depend on shares)]."""
        if how not in AGGREGATES:
            raise ValueError(f"aggregate {how!r} is one of {AGGREGATES}")
        target = {"simple": lambda e: 0, "dynamic": lambda e: e["period"] - e["cohort"], "group": lambda e: e["cohort"], "calendar": lambda e: e["period"]}[how]
        groups: dict[int, list[int]] = {}
        for i, e in enumerate(effects):
            if how == "dynamic" or e["period"] >= e["cohort"]:
                groups.setdefault(target(e), []).append(i)
        out = {}
        for k, members in sorted(groups.items()):
            if how == "group":
                out[k] = [(i, 1 / len(members), 0.0) for i in members]
            else:
                share = [self.sizes[effects[i]["cohort"]] / self.n for i in members]
                out[k] = [(i, p / sum(share), p) for i, p in zip(members, share)]
        return out

    def aggregate(self, how: str = "simple") -> tuple[DataFrame, list[int], list[list[float]]]:
        """(target, att, se; the targets; their covariance). target: event time, cohort or period; 0 for ``simple``.

        Standard errors are clustered by ``cluster`` and allow for the estimated weights.
        """
        spark, effects = self.units.sparkSession, self.effects()
        weights = self._weights(how, effects)
        targets = list(weights)
        # What a difference of a cohort adds to each target's influence: slope times it, and a constant.
        slope: dict[tuple, list[float]] = {}
        level: dict[tuple, list[float]] = {}
        offset = {c: [0.0] * len(targets) for c in self.sizes}
        att = []
        for j, k in enumerate(targets):
            att.append(sum(w * effects[i]["att"] for i, w, _ in weights[k]))
            total = sum(p for _, _, p in weights[k])
            for i, w, p in weights[k]:
                e = effects[i]
                g, t, b = e["cohort"], e["period"], e["base"]
                parts = [(g, w * self.n / e["n_treated"], e["own_mean"])] + [(c, -w * self.n / e["n_control"], e["control_mean"]) for c in self._controls(t, b, g)]
                for c, a, mean in parts:
                    slope.setdefault((c, b, t), [0.0] * len(targets))[j] += a
                    level.setdefault((c, b, t), [0.0] * len(targets))[j] -= a * mean
                if total:  # the weights are estimated from shares
                    for c in self.sizes:
                        offset[c][j] += ((c == g) - p) * (e["att"] - att[j]) / total
        if not targets:
            return spark.createDataFrame([], "target long, att double, se double"), [], []
        rows = [(c, b, t, slope[c, b, t], level[c, b, t]) for c, b, t in slope]
        parts = spark.createDataFrame(rows, "_g long, _b long, _t long, _slope array<double>, _level array<double>")
        known = self.differences()
        same = known["_g"].eqNullSafe(parts["_g"]) & (known["_b"] == parts["_b"]) & (known["_t"] == parts["_t"])
        size = range(len(targets))
        told = known.join(F.broadcast(parts), same).select("_cluster", *[(F.col("_slope")[j] * F.col("_d") + F.col("_level")[j]).alias(f"_{j}") for j in size])
        shares = spark.createDataFrame([(c, x) for c, x in offset.items()], "_g long, _offset array<double>")
        base = self.units.join(F.broadcast(shares), self.units["_g"].eqNullSafe(shares["_g"])).select("_cluster", *[F.col("_offset")[j].alias(f"_{j}") for j in size])
        influence = told.unionByName(base).groupBy("_cluster").agg(*[F.sum(f"_{j}").alias(f"_{j}") for j in size])
        sums = influence.agg(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"s{i}_{j}") for i in size for j in size if i <= j]).first()
        covariance = [[sums[f"s{min(i, j)}_{max(i, j)}"] / self.n**2 for j in size] for i in size]
        found = [(k, a, covariance[j][j] ** 0.5) for j, (k, a) in enumerate(zip(targets, att))]
        return spark.createDataFrame(found, "target long, att double, se double"), targets, covariance

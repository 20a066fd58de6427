"""Statistics as SQL expressions and small DataFrame folds; no Python runs per row."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shrunk_mean(total: str, n: str, prior: str, weight: float) -> str:
    """(sum + w * prior) / (n + w)."""
    return f"((({total}) + {weight} * ({prior})) / (({n}) + {weight}))"


def shrunk_rate(successes: str, total: str, prior: str, weight: str | float) -> str:
    """Shrunk share; no evidence at all answers the prior, impossible inputs answer null."""
    ok = f"({successes}) >= 0 AND ({successes}) <= ({total}) AND ({prior}) BETWEEN 0 AND 1"
    return (f"(CASE WHEN NOT ({ok}) THEN NULL WHEN ({total}) + {weight} = 0 THEN ({prior})"
            f" ELSE (({successes}) + {weight} * ({prior})) / (({total}) + {weight}) END)")


def z_score(x: str, mean: str, sd: str) -> str:
    return f"(({x}) - ({mean})) / nullif({sd}, 0)"


def welch_t(x: str, is_a: str, is_b: str) -> str:
    """Unequal-variance t between two sides of one group; each side needs two values."""
    a, b = f"CASE WHEN {is_a} THEN {x} END", f"CASE WHEN {is_b} THEN {x} END"
    err = f"sqrt(var_samp({a}) / count({a}) + var_samp({b}) / count({b}))"
    return f"(CASE WHEN count({a}) >= 2 AND count({b}) >= 2 THEN (avg({a}) - avg({b})) / nullif({err}, 0) END)"


def t_of_mean(x: str, at_least: int = 8) -> str:
    return (f"(CASE WHEN count({x}) >= {at_least} AND var_samp({x}) > 0"
            f" THEN avg({x}) / sqrt(var_samp({x}) / count({x})) END)")


def pearson(x: str, y: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    flat = f"min({x}) = max({x}) OR min({y}) = max({y})"
    return f"(CASE WHEN count_if({both}) < 3 OR {flat} THEN NULL ELSE corr({x}, {y}) END)"


def slope(x: str, y: str) -> str:
    return f"(CASE WHEN count({x}) < 3 OR min({x}) = max({x}) THEN NULL ELSE regr_slope({y}, {x}) END)"


def student_p(t: str, df: str) -> str:
    """Two-sided Student-t p for whole degrees of freedom, by the finite cosine series."""
    theta = f"atan(({t}) / sqrt(double({df})))"
    even_m, odd_m = f"(int({df}) DIV 2)", f"((int({df}) - 1) DIV 2)"

    def series(m: str, first: str, num: str, den: str) -> str:
        ks = f"slice(sequence(0, {m}), 2, greatest({m} - 1, 0))"
        step = f"a.term * cos(theta) * cos(theta) * ({num}) / ({den})"
        fold = (f"aggregate({ks}, struct({first} AS term, {first} AS total), (a, k) -> struct("
                f"{step} AS term, a.total + {step} AS total)).total")
        return f"(CASE WHEN {m} < 1 THEN 0D ELSE {fold} END)"

    even = f"sin(theta) * {series(even_m, '1D', '2 * k - 1', '2 * k')}"
    odd = f"(theta + sin(theta) * {series(odd_m, 'cos(theta)', '2 * k', '2 * k + 1')}) * 2 / pi()"
    body = f"CASE WHEN int({df}) % 2 = 0 THEN {even} ELSE {odd} END".replace("theta", f"abs({theta})")
    return f"(CASE WHEN {t} IS NULL OR {df} < 1 THEN NULL ELSE greatest(0D, 1 - ({body})) END)"


def binomial_p(k: str, n: str) -> str:
    """Exact two-sided p against a fair coin: both tails no likelier than what was seen."""
    m = f"least(int({k}), int({n}) - int({k}))"
    step = f"a.logp + ln(double({n} - j + 1) / j)"
    tail = (f"aggregate(slice(sequence(0, {m}), 2, {m}), struct(-{n} * ln(2D) AS logp, exp(-{n} * ln(2D)) AS total),"
            f" (a, j) -> struct({step} AS logp, a.total + exp({step}) AS total)).total")
    return f"(CASE WHEN {n} < 1 THEN NULL WHEN 2 * {m} = {n} THEN 1D ELSE least(1D, 2 * {tail}) END)"


def multiple_testing_threshold(trials: int, alpha: float = 0.05) -> float:
    """Two-sided Bonferroni bound on |t|; one number, so it is computed where the plan is built."""
    if trials < 1:
        raise ValueError("at least one trial")
    return round(NormalDist().inv_cdf(1 - alpha / trials / 2), 3)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str, digits: int | None = None) -> DataFrame:
    """Pearson on average ranks, null under three pairs or without spread."""
    from pitlens.operators.ranks import average_rank

    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = average_rank(average_rank(d, keys, x, "_rx", "_nx"), keys, y, "_ry", "_ny")
    # flat groups must not divide by zero, even where the engine works the quotient out before it is asked for
    rho = pearson("_rx", "_ry").replace("corr(_rx, _ry)", "covar_pop(_rx, _ry) / nullif(stddev_pop(_rx) * stddev_pop(_ry), 0D)")
    rho = f"round({rho}, {digits})" if digits is not None else rho
    return d.groupBy(*keys).agg(F.expr(f"{rho} AS {out}"), F.count(F.lit(1)).alias("n"))


def newey_west(series: DataFrame, keys: Sequence[str], order: str, x: str, lags: int) -> DataFrame:
    """Bartlett-weighted t of the mean of each ordered series (one value per period)."""
    w = Window.partitionBy(*keys)
    d = series.withColumn("_e", F.col(x) - F.avg(x).over(w))
    ordered = w.orderBy(order)
    shifted = d.select(*keys, x, "_e", *[F.lag("_e", l).over(ordered).alias(f"_l{l}") for l in range(1, lags + 1)])
    g = shifted.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg(F.col("_e") * F.col("_e")).alias("_g0"),
        *[(F.coalesce(F.sum(F.col("_e") * F.col(f"_l{l}")), F.lit(0.0)) / F.count(x)).alias(f"_g{l}") for l in range(1, lags + 1)])
    var = F.col("_g0")
    for l in range(1, lags + 1):
        var = var + F.col(f"_g{l}") * 2.0 * (1 - l / (lags + 1.0))
    g = g.withColumn("_var", var)
    t = F.when((F.col("n") >= 3) & (F.col("_var") > 0), F.col("mean") / F.sqrt(F.col("_var") / F.col("n")))
    return g.withColumn("t", t).select(*keys, "n", "mean", "t", F.expr(student_p("t", "n - 1")).alias("p"))


def benjamini_hochberg(df: DataFrame, family: Sequence[str], p: str, key: str, out: str = "p_adjusted") -> DataFrame:
    """Step-up adjusted p inside a family of named tests; a null p stays out of the count."""
    tested = df.filter(F.col(p).isNotNull())
    w = Window.partitionBy(*family)
    up = w.orderBy(p, key)
    scaled = tested.withColumn("_s", F.col(p) * F.count(F.lit(1)).over(w) / F.row_number().over(up))
    down = w.orderBy(F.col(p).desc(), F.col(key).desc())
    adjusted = scaled.withColumn(out, F.least(F.lit(1.0), F.min("_s").over(down))).select(*family, key, out)
    return df.join(adjusted, [*family, key], "left")


def block_bootstrap(series: DataFrame, keys: Sequence[str], order: str, x: str, resamples: int,
                    block: int = 5, confidence: float = 0.95, seed: int = 7) -> DataFrame:
    """Stationary bootstrap interval of the mean.

    Resamples are rows, so they spread over tasks; each walks its own seeded chain of
    geometric blocks over the packed series (one value per period, calendar-bounded).
    """
    packed = series.groupBy(*keys).agg(F.expr(f"sort_array(collect_list(struct({order} AS o, {x} AS x)))").alias("_s"))
    packed = packed.selectExpr(*keys, "transform(_s, r -> r.x) AS _x")
    label = ", ".join([*keys, "r"])
    draws = packed.selectExpr(*keys, "_x", f"explode(sequence(1, {resamples})) AS r").repartition(*keys, "r")
    unit = lambda what: f"(pmod(xxhash64({label}, i, '{what}', {seed}), 1000003) / 1000003D)"
    fresh = "int(floor(%s * size(_x)))" % unit("start")
    step = (f"CASE WHEN i = 0 OR {unit('jump')} <= {1.0 / block} THEN {fresh} ELSE (a.at + 1) % size(_x) END")
    walk = (f"aggregate(sequence(0, size(_x) - 1), struct(0 AS at, 0D AS total), (a, i) -> struct("
            f"{step} AS at, a.total + get(_x, {step}) AS total)).total / size(_x)")
    lo, hi = (1 - confidence) / 2, (1 + confidence) / 2
    point = "aggregate(_x, 0D, (a, v) -> a + v) / size(_x)"
    got = draws.selectExpr(*keys, f"{point} AS point", f"CASE WHEN size(_x) >= 3 THEN {walk} END AS draw")
    return got.groupBy(*keys).agg(F.first("point").alias("point"), F.percentile("draw", F.lit(lo)).alias("low"),
                                  F.percentile("draw", F.lit(hi)).alias("high"), F.count("draw").alias("draws"))


def block_error(series: DataFrame, keys: Sequence[str], order: str, x: str, block: int = 5, out: str = "se") -> DataFrame:
    """keys, standard error that the mean has over the resamples of resample_statistics, exactly.

    Two places `i` apart stay together where no block begins between them, and series run round their end; errors for
    independent rows would be too wide for returns of one-off prices, which fall back, and too narrow for trends.
    """
    packed = series.groupBy(*keys).agg(F.expr(f"transform(array_sort(collect_list(struct({order} AS o, {x} AS x))), r -> double(r.x))").alias("_x"))
    centred = packed.selectExpr(*keys, "transform(_x, v -> v - aggregate(_x, 0D, (a, r) -> a + r) / size(_x)) AS _e", "size(_x) AS n")
    lagged = "aggregate(sequence(0, n - 1 - i), 0D, (a, j) -> a + get(_e, j) * get(_e, j + i)) / n"
    stay = 1 - 1 / block
    together = f"((1 - i / n) * power({stay}D, i) + i / n * power({stay}D, n - i))"
    variance = f"aggregate(sequence(0, n - 1), 0D, (b, i) -> b + CASE WHEN i = 0 THEN 1D ELSE 2D * {together} END * ({lagged}))"
    return centred.selectExpr(*keys, f"sqrt(greatest({variance}, 0D) / n) AS {out}")


def sign_flip(df: DataFrame, keys: Sequence[str], row: str, x: str, flips: int, seed: int = 11, lanes: int = 250) -> DataFrame:
    """Share of random sign flips whose |mean| reaches the observed one.

    Sums of all flips ride in arrays, `lanes` of them a key, so a value meets its flips where
    it lies and a task passes on one array a key and lane, however many rows a key has.
    """
    each = (flips + lanes - 1) // lanes
    spread = df.selectExpr(*keys, row, x, f"explode(sequence(0, {lanes - 1})) AS _lane")
    sign = lambda r: f"CASE WHEN pmod(xxhash64({', '.join([*keys, row])}, _lane * {each} + {r}, {seed}), 2) = 0 THEN {x} ELSE -{x} END"
    sums = spread.groupBy(*keys, "_lane").agg(*[F.expr(f"sum({sign(r)}) AS _s{r}") for r in range(each)], F.sum(x).alias("_sum"), F.count(x).alias("n"))
    kept = f"slice(array({', '.join(f'_s{r}' for r in range(each))}), 1, greatest(0, least({each}, {flips} - _lane * {each})))"
    reached = f"size(filter({kept}, s -> abs(s / n) >= abs(_sum / n) - 1e-12))"
    got = sums.selectExpr(*keys, "n", "_sum / n AS mean", f"{reached} AS hit")
    return got.groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), (F.sum("hit") / F.lit(float(flips))).alias("p"))


def mean_of(column: str) -> Callable[[str], str]:
    """The mean of a field over an array of rows, for resample_statistics."""
    return lambda rows: f"aggregate({rows}, 0D, (a, r) -> a + r.{column}) / size({rows})"


def median_of(column: str) -> Callable[[str], str]:
    def of(rows: str) -> str:
        return (f"get(transform(array(array_sort(transform({rows}, r -> r.{column}))), v ->"
                " (get(v, int((size(v) - 1) DIV 2)) + get(v, int(size(v) DIV 2))) / 2), 0)")
    return of


def ratio_of(top: str, bottom: str) -> Callable[[str], str]:
    return lambda rows: f"aggregate({rows}, 0D, (a, r) -> a + r.{top}) / nullif(aggregate({rows}, 0D, (a, r) -> a + r.{bottom}), 0D)"


def resample_statistics(series: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], statistics: dict[str, Callable[[str], str]],
                        resamples: int = 10_000, block: int = 5, confidence: float = 0.95, seed: int = 7) -> DataFrame:
    """keys, statistic, n, point, low, high, draws: stationary bootstrap intervals of any statistics of ordered series.

    A statistic is a function from an array of rows, structs of `columns`, to an expression over it; all are taken of
    the same resamples. A resample is a row, so resamples spread over tasks: blocks of geometric length begin at
    random places of the packed series (one row per period, calendar-bounded) and run round its end. The bounds are
    order statistics of the draws that are not null; series of fewer than three rows have a point alone.
    """
    fields = ", ".join(columns)
    packed = series.groupBy(*keys).agg(F.expr(f"transform(array_sort(collect_list(struct({order} AS o, struct({fields}) AS x))), r -> r.x)").alias("_x"))
    unit = lambda what: f"(pmod(xxhash64({', '.join([*keys, 'r'])}, i, '{what}', {seed}), 1000003) / 1000003D)"
    begins = f"filter(sequence(0, size(_x) - 1), i -> i = 0 OR {unit('jump')} <= {1.0 / block})"
    lengths = f"get(transform(array({begins}), b -> transform(b, (i, k) -> struct(i AS i, coalesce(get(b, k + 1), size(_x)) - i AS len))), 0)"
    rows = f"flatten(transform({lengths}, c -> get(transform(array(c.i), i -> transform(sequence(0, c.len - 1), o -> get(_x, int((int(floor({unit('start')} * size(_x))) + o) % size(_x))))), 0)))"
    told = lambda rows: "array(" + ", ".join(f"struct('{name}' AS statistic, double({of(rows)}) AS value)" for name, of in statistics.items()) + ")"
    drawn = packed.filter("size(_x) >= 3").selectExpr(*keys, "_x", f"explode(sequence(1, {resamples})) AS r").repartition(*keys, "r").selectExpr(
        *keys, f"{rows} AS _s").selectExpr(*keys, f"inline({told('_s')})")
    bounds = drawn.groupBy(*keys, "statistic").agg(F.sort_array(F.collect_list("value")).alias("_d")).selectExpr(
        *keys, "statistic", f"get(_d, int({(1 - confidence) / 2} * size(_d))) AS low", f"get(_d, least(size(_d) - 1, int({(1 + confidence) / 2} * size(_d)))) AS high", "size(_d) AS draws")
    points = packed.selectExpr(*keys, "size(_x) AS n", f"inline({told('_x')})").withColumnRenamed("value", "point")
    return points.join(bounds, [*keys, "statistic"], "left").withColumn("draws", F.coalesce("draws", F.lit(0)))


def paired_effect(df: DataFrame, keys: Sequence[str], order: str, x: str, resamples: int = 10_000, seed: int = 11) -> DataFrame:
    """keys, n, estimate, ci_low, ci_high, t, p_t, p_permutation, n_positive, median of paired differences `x`.

    The interval resamples blocks of two; under the null the sign of each difference is exchangeable, which is what the permutation
    asks of `resamples` sign flips. `order` tells the rows of a key apart.
    """
    plain = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("estimate"), F.expr(f"{t_of_mean(x, 2)} AS t"), F.count_if(F.col(x) > 0).alias("n_positive"),
                                  F.median(x).alias("median")).withColumn("p_t", F.expr(student_p("t", "n - 1")))
    bounds = resample_statistics(df, keys, order, [x], {"mean": mean_of(x)}, resamples, 2, seed=seed).select(*keys, F.col("low").alias("ci_low"), F.col("high").alias("ci_high"))
    flips = sign_flip(df, keys, order, x, resamples, seed).select(*keys, F.col("p").alias("p_permutation"))
    return plain.join(bounds, list(keys), "left").join(flips, list(keys), "left").select(
        *keys, "n", "estimate", "ci_low", "ci_high", "t", "p_t", "p_permutation", "n_positive", "median")


def stationary_lags(horizon: int) -> int:
    return max(1, round(horizon / 21))


def annual_factor() -> float:
    return math.sqrt(252)

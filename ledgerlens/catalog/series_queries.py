"""Time-series features of order prices and discounts per retailer."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ledgerlens.catalog.registry import query
from ledgerlens.catalog.views_sql import with_views
from ledgerlens.operators import series as ts
from ledgerlens.operators.skew import measure
from ledgerlens.schemas import KEY
from ledgerlens.sources.adapters import load_views

TS = "ORDER_CREATION_DATE"
ORDER = [TS, "ORDER_ID"]
VALUE = "ORDER_PRICE"


def orders(spark, sf_dir):
    p = load_views(spark, sf_dir)["purchases"].select(KEY, *ORDER, VALUE, "DISCOUNT")
    return p


def neat(df, digits=6):
    """Round every double; NaN counts as unknown."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.nanvl(c, F.lit(None)), digits).alias(c) if kinds[c] == "double" else c for c in df.columns])


def r(expr, name, digits=6):
    return f"round({expr}, {digits}) AS {name}"


S = """s AS (SELECT MAIN_SYSTEM_ID AS k, ORDER_CREATION_DATE AS t, ORDER_PRICE AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY MAIN_SYSTEM_ID) AS n,
avg(ORDER_PRICE) OVER (PARTITION BY MAIN_SYSTEM_ID) AS mu, stddev_pop(ORDER_PRICE) OVER (PARTITION BY MAIN_SYSTEM_ID) AS sd,
min(ORDER_PRICE) OVER (PARTITION BY MAIN_SYSTEM_ID) AS lo, max(ORDER_PRICE) OVER (PARTITION BY MAIN_SYSTEM_ID) AS hi,
lag(ORDER_PRICE) OVER w AS b1, lag(ORDER_PRICE, 2) OVER w AS b2, lag(ORDER_PRICE, 3) OVER w AS b3, lag(ORDER_PRICE, 4) OVER w AS b4, lag(ORDER_PRICE, 5) OVER w AS b5, lag(ORDER_PRICE, 6) OVER w AS b6,
lead(ORDER_PRICE) OVER w AS a1, lead(ORDER_PRICE, 2) OVER w AS a2
FROM purchases WINDOW w AS (PARTITION BY MAIN_SYSTEM_ID ORDER BY ORDER_CREATION_DATE, ORDER_ID))"""
DISCOUNTS = S.replace("ORDER_PRICE", "DISCOUNT")


def sql(select, *ctes, base=S):
    return with_views(select, base, *ctes, names="purchases")


@query(
    "t1f_moments",
    sql(
        "SELECT k AS MAIN_SYSTEM_ID, count(x) AS length, sum(x::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE AS sum_values, "
        + ", ".join(
            [
                r("sum(x * x)", "abs_energy", 4),
                r("avg(x)", "mean"),
                "min(x) AS minimum, max(x) AS maximum, max(abs(x)) AS absolute_maximum",
                r("var_pop(x)", "variance"),
                r("stddev_pop(x)", "standard_deviation"),
                r("sqrt(avg(x * x))", "root_mean_square"),
                r("stddev_pop(x) / nullif(avg(x), 0)", "variation_coefficient"),
                r("CASE WHEN count(x) > 2 AND min(x) < max(x) THEN skewness(x) * (count(x) - 2) / sqrt(count(x) * (count(x) - 1.0)) END", "skewness"),
                r("CASE WHEN count(x) > 2 AND min(x) < max(x) THEN kurtosis_pop(x) END", "kurtosis"),
                r("median(x)", "median"),
            ]
        )
        + " FROM s GROUP BY 1"
    ),
)
def _(spark, sf_dir):
    p = orders(spark, sf_dir)
    out = neat(ts.moments(p, KEY, VALUE, measure(p, KEY, VALUE)).withColumn("abs_energy", F.round("abs_energy", 4)))
    return out


@query(
    "t2f_thresholds",
    sql(
        f"""SELECT k AS MAIN_SYSTEM_ID, count(*) FILTER (WHERE x > 40) AS count_above, count(*) FILTER (WHERE x < 40) AS count_below, count(*) FILTER (WHERE x > mu) AS count_above_mean,
count(*) FILTER (WHERE x < mu) AS count_below_mean, count(*) FILTER (WHERE x >= 10 AND x < 30) AS range_count, count(*) FILTER (WHERE x = 12.5) AS value_count,
{r('avg(CASE WHEN abs(x - mu) > sd THEN 1 ELSE 0 END)', 'ratio_beyond_sigma')}, any_value(sd) > 0.25 * any_value(hi - lo) AS large_standard_deviation,
any_value(sd * sd) > any_value(sd) AS variance_larger_than_std, abs(any_value(mu) - median(x)) < 0.25 * any_value(hi - lo) AS symmetry_looking FROM s GROUP BY 1"""
    ),
)
def _(spark, sf_dir):
    p = orders(spark, sf_dir)
    return neat(ts.thresholds(p, KEY, VALUE, t=40.0, low=10.0, high=30.0, v=12.5, slices=measure(p, KEY, VALUE)))


@query(
    "t3f_repetition",
    sql(
        f"""SELECT k AS MAIN_SYSTEM_ID, max(c) > 1 AS has_duplicate, arg_min(c, x) > 1 AS has_duplicate_min, arg_max(c, x) > 1 AS has_duplicate_max,
{r('count(*) FILTER (WHERE c > 1) / count(*)', 'reoccurring_values_share')}, {r('coalesce(sum(c) FILTER (WHERE c > 1), 0) / sum(c)', 'reoccurring_points_share')},
coalesce(sum(x::VARCHAR::DECIMAL(28,10)) FILTER (WHERE c > 1), 0)::VARCHAR::DOUBLE AS sum_reoccurring_values, coalesce(sum((x * c)::VARCHAR::DECIMAL(28,10)) FILTER (WHERE c > 1), 0)::VARCHAR::DOUBLE AS sum_reoccurring_points,
{r('count(*) / sum(c)', 'distinct_share')}, any_value(m) AS mean_n_absolute_max
FROM (SELECT k, x, count(*) AS c FROM s GROUP BY 1, 2) JOIN (SELECT k, {r('avg(z)', 'm')} FROM (SELECT k, abs(x) AS z FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(x) DESC) <= 3) GROUP BY 1) USING (k) GROUP BY 1""",
        base=DISCOUNTS,
    ),
)
def _(spark, sf_dir):
    return neat(ts.repetition(orders(spark, sf_dir), KEY, "DISCOUNT"))


_BENFORD = " + ".join(f"count(*) FILTER (WHERE d = '{d}') * {math.log10(1 + 1 / d)!r}::DOUBLE" for d in range(1, 10))
_BENFORD_SQ = " + ".join(f"pow(count(*) FILTER (WHERE d = '{d}'), 2)" for d in range(1, 10))
_E = [math.log10(1 + 1 / d) for d in range(1, 10)]


@query(
    "t4f_distribution",
    sql(
        f"""SELECT q.k AS MAIN_SYSTEM_ID, quantile_0_1, quantile_0_9, binned_entropy, benford_correlation, index_mass_quantile
FROM (SELECT k, {r('quantile_cont(x, 0.1)', 'quantile_0_1')}, {r('quantile_cont(x, 0.9)', 'quantile_0_9')} FROM s GROUP BY 1) q
JOIN (SELECT k, {r('-sum(p * ln(p))', 'binned_entropy')} FROM (SELECT k, least(floor((x - lo) / ((hi - lo) / 10)), 9) AS b, count(*) / any_value(n) AS p FROM s WHERE hi > lo GROUP BY 1, 2) GROUP BY 1
  UNION ALL SELECT k, 0 FROM s WHERE hi = lo GROUP BY 1) e ON e.k = q.k
LEFT JOIN (SELECT k, {r(f"(9 * ({_BENFORD}) - count(*) * {sum(_E)!r}) / sqrt((9 * ({_BENFORD_SQ}) - pow(count(*), 2)) * {9 * sum(e * e for e in _E) - sum(_E) ** 2!r})", 'benford_correlation')}
  FROM (SELECT k, regexp_extract(abs(x)::VARCHAR, '[1-9]') AS d FROM s WHERE x <> 0) GROUP BY 1) f ON f.k = q.k
JOIN (SELECT k, {r('min(i) FILTER (WHERE c >= 0.5 * total) / any_value(n)', 'index_mass_quantile')} FROM (SELECT k, i, n, (sum(abs(x)::VARCHAR::DECIMAL(28,10)) OVER (PARTITION BY k ORDER BY i))::VARCHAR::DOUBLE AS c,
  (sum(abs(x)::VARCHAR::DECIMAL(28,10)) OVER (PARTITION BY k))::VARCHAR::DOUBLE AS total FROM s) GROUP BY 1) m ON m.k = q.k"""
    ),
)
def _(spark, sf_dir):
    p = orders(spark, sf_dir)
    return neat(ts.distribution(p, KEY, ORDER, VALUE, slices=measure(p, KEY, TS), value_slices=measure(p, KEY, VALUE)))


@query(
    "t5f_changes",
    sql(
        f"""SELECT k AS MAIN_SYSTEM_ID, {r('avg(x - b1)', 'mean_change')}, {r('avg(abs(x - b1))', 'mean_abs_change')}, {r('coalesce(sum(abs(x - b1)), 0)', 'absolute_sum_of_changes')},
{r('avg((a1 - 2 * x + b1) / 2)', 'mean_second_derivative')}, {r('coalesce(sqrt(sum(pow(x - b1, 2))), 0)', 'cid_ce')},
{r('coalesce(avg(abs(x - b1)) FILTER (WHERE x BETWEEN ql AND qh AND b1 BETWEEN ql AND qh), 0)', 'change_quantiles_mean')},
{r('coalesce(var_pop(abs(x - b1)) FILTER (WHERE x BETWEEN ql AND qh AND b1 BETWEEN ql AND qh), 0)', 'change_quantiles_var')}
FROM s JOIN (SELECT k, quantile_cont(x, 0.1) AS ql, quantile_cont(x, 0.9) AS qh FROM s GROUP BY 1) USING (k) GROUP BY 1"""
    ),
)
def _(spark, sf_dir):
    p = orders(spark, sf_dir)
    return neat(ts.changes(p, KEY, ORDER, VALUE, slices=measure(p, KEY, TS), value_slices=measure(p, KEY, VALUE)))


@query(
    "t6f_positions",
    sql(
        f"""SELECT s.k AS MAIN_SYSTEM_ID, {r('min(i - 1) FILTER (WHERE x = hi) / any_value(n)', 'first_location_of_maximum')}, {r('max(i) FILTER (WHERE x = hi) / any_value(n)', 'last_location_of_maximum')},
{r('min(i - 1) FILTER (WHERE x = lo) / any_value(n)', 'first_location_of_minimum')}, {r('max(i) FILTER (WHERE x = lo) / any_value(n)', 'last_location_of_minimum')},
count(*) FILTER (WHERE (x > 40) <> (b1 > 40)) AS number_crossing, count(*) FILTER (WHERE x > b1 AND x > a1) AS number_peaks,
any_value(up) AS longest_strike_above_mean, any_value(down) AS longest_strike_below_mean
FROM s JOIN (SELECT k, coalesce(max(c) FILTER (WHERE g = 1), 0) AS up, coalesce(max(c) FILTER (WHERE g = -1), 0) AS down FROM (SELECT k, run, any_value(g) AS g, count(*) AS c FROM runs GROUP BY 1, 2) GROUP BY 1) q ON q.k = s.k GROUP BY 1""",
        "sides AS (SELECT k, i, sign(x - mu) AS g, sign(b1 - mu) AS h FROM s)",
        "runs AS (SELECT k, g, sum(CASE WHEN g <> h THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS run FROM sides)",
    ),
)
def _(spark, sf_dir):
    p = orders(spark, sf_dir)
    return neat(ts.positions(p, KEY, ORDER, VALUE, m=40.0, slices=measure(p, KEY, TS)))


def _auto(lag):
    return f"sum((x - mu) * (b{lag} - mu)) / nullif((any_value(n) - {lag}) * any_value(sd * sd), 0)"


@query(
    "t7f_lag_statistics",
    sql(
        f"""SELECT k AS MAIN_SYSTEM_ID, {', '.join(r(f'z{i}', f'autocorrelation_{i}') for i in (1, 2, 3))}, {', '.join(r(f'c{i}', f'c3_{i}', 4) for i in (1, 2, 3))},
{', '.join(r(f'v{i}', f'time_reversal_asymmetry_{i}', 4) for i in (1, 2, 3))}, {r('list_avg(list_filter([z1, z2, z3], lambda z: z IS NOT NULL))', 'autocorrelation_mean')},
{r('list_var_pop(list_filter([z1, z2, z3], lambda z: z IS NOT NULL))', 'autocorrelation_var')}, {r('CASE WHEN n > 1 THEN r1 END', 'partial_autocorrelation_1')},
{r('CASE WHEN n > 2 THEN (r2 - r1 * r1) / nullif(1 - r1 * r1, 0) END', 'partial_autocorrelation_2')}
FROM (SELECT k, any_value(n) AS n, {', '.join(f'{_auto(i)} AS z{i}' for i in (1, 2, 3))},
{', '.join(f'coalesce(sum((x - mu) * (b{i} - mu)), 0) / nullif(any_value(n * sd * sd), 0) AS r{i}' for i in (1, 2))},
{', '.join(f'avg(x * b{i} * b{2 * i}) AS c{i}, avg(x * x * b{i} - b{i} * b{2 * i} * b{2 * i}) AS v{i}' for i in (1, 2, 3))} FROM s GROUP BY 1)"""
    ),
)
def _(spark, sf_dir):
    p = orders(spark, sf_dir)
    out = ts.lag_statistics(p, KEY, ORDER, VALUE, slices=measure(p, KEY, TS))
    out = out.drop(*[f"partial_autocorrelation_{k}" for k in (3, 4, 5)], *[c for c in out.columns if c.startswith("ar_")])
    big = [c for c in out.columns if c.startswith(("c3", "time_rev"))]
    return neat(out.select(*[F.round(c, 4).alias(c) if c in big else c for c in out.columns]))


_LAGS = 5
_AC = ", ".join(f"coalesce(sum((x - mu) * (b{i} - mu)), 0) / nullif(any_value(n * sd * sd), 0) AS r{i}" for i in range(1, _LAGS + 1))


def _recursion(k):
    """SQL of the predictors f{k}_1 .. f{k}_{k} of order k from those of order k - 1; the last is the partial autocorrelation."""
    if k == 1:
        return f"SELECT *, r1 AS f1_1 FROM (SELECT k, any_value(n) AS n, {_AC} FROM s GROUP BY 1)"
    top = "".join(f" - f{k - 1}_{j} * r{k - j}" for j in range(1, k))
    bottom = "".join(f" - f{k - 1}_{j} * r{j}" for j in range(1, k))
    last = f"SELECT *, (r{k}{top}) / nullif(1{bottom}, 0) AS f{k}_{k} FROM ({_recursion(k - 1)})"
    return f"SELECT *, {', '.join(f'f{k - 1}_{j} - f{k}_{k} * f{k - 1}_{k - j} AS f{k}_{j}' for j in range(1, k))} FROM ({last})"


@query(
    "t7f_partial_autocorrelation",
    sql(
        f"""SELECT k AS MAIN_SYSTEM_ID, {', '.join(r(f'CASE WHEN n > {k} THEN f{k}_{k} END', f'partial_autocorrelation_{k}') for k in range(1, _LAGS + 1))},
{', '.join(r(f'CASE WHEN n > {_LAGS} THEN f{_LAGS}_{j} END', f'ar_coefficient_{j}') for j in range(1, _LAGS + 1))} FROM ({_recursion(_LAGS)})"""
    ),
)
def _(spark, sf_dir):
    p = orders(spark, sf_dir)
    out = ts.lag_statistics(p, KEY, ORDER, VALUE, slices=measure(p, KEY, TS))
    return neat(out.select(KEY, *[c for c in out.columns if c.startswith(("partial", "ar_"))]))


@query(
    "t8f_trends",
    sql(
        f"""SELECT a.k AS MAIN_SYSTEM_ID, * EXCLUDE (k) FROM (SELECT k, {r('regr_slope(x, i - 1)', 'linear_trend_slope')}, {r('regr_intercept(x, i - 1)', 'linear_trend_intercept')},
{r('CASE WHEN stddev_pop(x) > 0 AND stddev_pop(i) > 0 THEN corr(x, i - 1) END', 'linear_trend_r')}, {r('regr_slope(x, (epoch_us(t) - epoch_us(t0)) / 1e6 / 3600)', 'linear_trend_hourly_slope')},
{', '.join(r(f'coalesce(sum(x * x) FILTER (WHERE floor((i - 1) * 4 / n) = {j}), 0) / sum(x * x)', f'energy_ratio_{j}') for j in range(4))}
FROM (SELECT *, min(t) OVER (PARTITION BY k) AS t0 FROM s) GROUP BY 1) a
JOIN (SELECT k, {r('CASE WHEN max(c) > min(c) THEN regr_slope(m, c) END', 'chunk_mean_slope')}, {r('CASE WHEN max(c) > min(c) THEN regr_slope(h, c) END', 'chunk_max_slope')} FROM (SELECT k, (i - 1) // 3 AS c, avg(x) AS m, max(x) AS h FROM s GROUP BY 1, 2) GROUP BY 1) b USING (k)"""
    ),
)
def _(spark, sf_dir):
    p = orders(spark, sf_dir)
    return neat(ts.trends(p, KEY, ORDER, VALUE, slices=measure(p, KEY, TS)))


@query(
    "t9f_fourier",
    sql(
        f"""SELECT k AS MAIN_SYSTEM_ID, {', '.join(f"CASE WHEN n >= {2 * j} THEN round(re{j}, 6) END AS fft_real_{j}, CASE WHEN n >= {2 * j} THEN round(im{j}, 6) END AS fft_imag_{j}, CASE WHEN n >= {2 * j} THEN round(sqrt(re{j} * re{j} + im{j} * im{j}), 6) END AS fft_abs_{j}" for j in range(3))}
FROM (SELECT k, any_value(n) AS n, {', '.join(f'sum(x * cos(2 * pi() * (i - 1) / n * {j})) AS re{j}, sum(-x * sin(2 * pi() * (i - 1) / n * {j})) AS im{j}' for j in range(3))} FROM s GROUP BY 1)"""
    ),
)
def _(spark, sf_dir):
    p = orders(spark, sf_dir)
    return neat(ts.fourier_coefficients(p, KEY, ORDER, VALUE, slices=measure(p, KEY, TS)))


@query(
    "t9f_permutation_entropy",
    sql(
        f"""SELECT a.k AS MAIN_SYSTEM_ID, permutation_entropy FROM (SELECT DISTINCT k FROM s) a LEFT JOIN (
SELECT k, {r('greatest(ln(sum(c)) - sum(c * ln(c)) / sum(c), 0)', 'permutation_entropy')} FROM (SELECT k, p, count(*) AS c FROM (SELECT k,
list_sort([{{'v': x, 'i': 0}}, {{'v': a1, 'i': 1}}, {{'v': a2, 'i': 2}}])::VARCHAR AS raw, list_transform(list_sort([{{'v': x, 'i': 0}}, {{'v': a1, 'i': 1}}, {{'v': a2, 'i': 2}}]), lambda e: e.i)::VARCHAR AS p
FROM s WHERE a2 IS NOT NULL) GROUP BY 1, 2) GROUP BY 1) b ON b.k = a.k"""
    ),
)
def _(spark, sf_dir):
    p = orders(spark, sf_dir)
    return neat(ts.permutation_entropy(p, KEY, ORDER, VALUE, slices=measure(p, KEY, TS)))


_SIZE = 8
_HANN = "(0.5 - 0.5 * cos(2 * pi() * j / 8))"
_POWER = ", ".join(
    f"avg(re{f} * re{f} + im{f} * im{f}) * {1 if f in (0, 4) else 2} / {sum((0.5 - 0.5 * math.cos(2 * math.pi * i / 8)) ** 2 for i in range(8))!r} AS power_{f}" for f in range(5)
)
_SUMS = ", ".join(f"sum((x - m) * {_HANN} * cos(2 * pi() * j * {f} / 8)) AS re{f}, sum((x - m) * {_HANN} * sin(2 * pi() * j * {f} / 8)) AS im{f}" for f in range(5))


@query(
    "t9f_power_spectrum",
    sql(
        f"""SELECT a.k AS MAIN_SYSTEM_ID, b.* EXCLUDE (k) FROM (SELECT DISTINCT k FROM s) a LEFT JOIN (SELECT k, {', '.join(r(f'power_{f}', f'power_{f}', 5) for f in range(5))}, {r('c1 / total', 'spectral_centroid', 5)},
{r('c2 / total - (c1 / total) * (c1 / total)', 'spectral_variance', 5)}, {r('(SELECT -sum(p * ln(p)) FROM (SELECT count(*) / 5 AS p FROM (SELECT unnest(cells) AS cell) GROUP BY cell))', 'fourier_entropy')}
FROM (SELECT *, power_0 + power_1 + power_2 + power_3 + power_4 AS total, power_1 + 2 * power_2 + 3 * power_3 + 4 * power_4 AS c1, power_1 + 4 * power_2 + 9 * power_3 + 16 * power_4 AS c2,
list_transform([power_0, power_1, power_2, power_3, power_4], lambda p: least(floor(p / greatest(power_0, power_1, power_2, power_3, power_4) * 10), 9)) AS cells
FROM (SELECT k, {_POWER} FROM (SELECT k, seg, {_SUMS} FROM (SELECT *, avg(x) OVER (PARTITION BY k, seg) AS m FROM (SELECT k, x, g.seg, i - 1 - 4 * g.seg AS j
FROM s JOIN (SELECT unnest(range(100000)) AS seg) g ON g.seg BETWEEN (i - 8) // 4 AND (i - 1) // 4 AND i - 1 - 4 * g.seg BETWEEN 0 AND 7 AND 4 * g.seg + 8 <= n)) GROUP BY 1, 2) GROUP BY 1))) b ON b.k = a.k"""
    ),
)
def _(spark, sf_dir):
    p = orders(spark, sf_dir)
    out = ts.power_spectrum(p, KEY, ORDER, VALUE, _SIZE, slices=measure(p, KEY, TS))
    return neat(out.withColumn("fourier_entropy", F.round("fourier_entropy", 6)).select(*[F.round(c, 5).alias(c) if c.startswith(("power", "spectral")) else c for c in out.columns]))

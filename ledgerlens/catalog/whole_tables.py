"""Reports over all columns of the loans, sales and purchases; the SQL is made from the schemas."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.catalog.registry import query
from ledgerlens.catalog.tables import TABLES, _of_kind
from ledgerlens.catalog.views_sql import with_views
from ledgerlens.operators import profiling, selection
from ledgerlens.sources.adapters import load_views


def _each(name, columns, select, having=""):
    """SQL: one SELECT per column, put together."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {select.format(c=f'\"{c}\"')} FROM {name}{having.format(c=f'\"{c}\"')}" for c in columns)


def _shape(name, columns):
    moments = """round(stddev_samp({c}::DOUBLE), 4) AS std,
round(CASE WHEN min({c}) < max({c}) THEN skewness({c}::DOUBLE) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)) END, 4) AS skewness,
round(CASE WHEN min({c}) < max({c}) THEN kurtosis_pop({c}::DOUBLE) END, 4) AS kurtosis, """
    cuts = ", ".join(f"round(quantile_cont({{c}}::DOUBLE, {p}), 7) AS {n}" for n, p in profiling.QUANTILES.items())
    shown = ["std", "skewness", "kurtosis", *profiling.QUANTILES]

    @query(f"q2_shape_{name}", with_views(_each(name, columns, moments + cuts), names=name))
    def _(spark, sf_dir):
        out = profiling.profile_numeric(load_views(spark, sf_dir)[name].select(*columns))
        moved = lambda c: F.when(F.col("min") < F.col("max"), F.col(c)) if c in ("skewness", "kurtosis") else F.col(c)
        return out.select("column", *[F.round(moved(c), 7 if c in profiling.QUANTILES else 4).alias(c) for c in shown])


def _common(name, columns):
    ranked = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM {name} WHERE {c} IS NOT NULL GROUP BY {c}" for c in columns)
    sql = f"""SELECT * FROM (SELECT "column", value, n, (row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value))::INTEGER AS place FROM ({ranked})) WHERE place <= 10"""

    @query(f"q3_common_{name}", with_views(sql, names=name))
    def _(spark, sf_dir):
        return profiling.most_common(load_views(spark, sf_dir)[name], columns, 10)


def _histograms(name, columns):
    long = "x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", \"{c}\"::DOUBLE AS value FROM {name}" for c in columns) + ")"
    sql = """SELECT "column", least(floor((value - lo) / nullif((hi - lo) / 20, 0)), 19)::INTEGER AS bin, count(*) AS n
FROM x JOIN (SELECT "column", min(value) AS lo, max(value) AS hi FROM x GROUP BY 1) b USING ("column") WHERE hi > lo AND value IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT "column", 0, count(value) FROM x GROUP BY 1 HAVING min(value) = max(value)"""

    @query(f"q4_histograms_{name}", with_views(sql, long, names=name))
    def _(spark, sf_dir):
        return profiling.column_histograms(load_views(spark, sf_dir)[name], columns, 20)


def _alerts(name, columns):
    found = {
        "constant": "count(DISTINCT {c}) = 1",
        "unique": "count(DISTINCT {c}) = count({c}) AND count({c}) > 1",
        "missing": "(count(*) - count({c})) / count(*) >= 0.25",
        "zeros": "count(*) FILTER (WHERE {c} = 0) / count(*) >= 0.25",
    }
    single = " UNION ALL ".join(_each(name, columns, f"'{alert}' AS alert", f" HAVING {rule}") for alert, rule in found.items())
    related = "".join(
        f" UNION ALL SELECT '{b}', 'correlated with {a}' FROM {name} HAVING min(\"{a}\") < max(\"{a}\") AND min(\"{b}\") < max(\"{b}\") AND abs(corr(\"{a}\"::DOUBLE, \"{b}\"::DOUBLE)) >= 0.95"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    )

    @query(f"q6_alerts_{name}", with_views(single + related, names=name))
    def _(spark, sf_dir):
        return profiling.alerts(load_views(spark, sf_dir)[name], columns)


def _signals(name, columns):
    rule = "count(DISTINCT {c}) = 1 OR (count(DISTINCT {c}) = count({c}) AND count({c}) > 0)"
    kind = "CASE WHEN count(DISTINCT {c}) = 1 THEN 'constant' ELSE 'identifier' END AS signal"

    @query(f"s10_signals_{name}", with_views(_each(name, columns, kind, f" HAVING {rule}"), names=name))
    def _(spark, sf_dir):
        return selection.low_signal(load_views(spark, sf_dir)[name], columns)


for _name, _schema in TABLES.items():
    _numbers, _texts = _of_kind(_schema, T.NumericType), _of_kind(_schema, T.StringType)
    _shape(_name, _numbers)
    if _texts:
        _common(_name, _texts)
    _histograms(_name, _numbers)
    _alerts(_name, _numbers)
    _signals(_name, _schema.names)

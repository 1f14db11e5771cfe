"""The whole-history feature frame against the SQL of the families it is made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalog import series_queries  # noqa: F401  registers the SQL that is joined here
from ledgerlens.catalog.registry import ORACLE, query
from ledgerlens.catalog.synthesis import COLS, CUTOFF, TS
from ledgerlens.catalog.views_sql import DENSE
from ledgerlens.plans import feature_frame
from ledgerlens.sources.adapters import load_views

#: Columns of the families by the query that states them, and what the frame calls their table.
FAMILIES = {
    "d2_agg_numeric": ("purchases_", ["count", *[f"{p}_{c}" for c in COLS for p in ("sum", "mean", "min", "max", "std", "variance", "skew", "kurtosis")]]),
    "d2_agg_distinct_median": ("purchases_", [f"{p}_{c}" for c in COLS for p in ("num_unique", "percent_unique", "median")]),
    "d3_agg_categorical": ("sales_", [f"{p}_STATUS" for p in ("mode", "mode_count", "num_unique", "count", "entropy", "common1", "common2", "common3")]),
    "d4_agg_time": ("purchases_", [f"{p}_{TS}" for p in ("first", "last", "span", "avg_gap", "days_since_first", "days_since_last", "n_days", "n_weeks", "n_months")]),
    "t1f_moments": (
        "ts_",
        ["length", "sum_values", "abs_energy", "mean", "minimum", "maximum", "absolute_maximum", "standard_deviation", "root_mean_square", "variation_coefficient"]
        + ["skewness", "kurtosis", "median"],
    ),
    "t7f_partial_autocorrelation": ("ts_", [f"{p}_{k}" for p in ("partial_autocorrelation", "ar_coefficient") for k in range(1, 6)]),
}
_EXACT = ("sum_ORDER", "sum_DISCOUNT", "min", "max", "sum_values", "span", "avg_gap", "absolute_maximum")


def _sql():
    joined = " ".join(f"LEFT JOIN ({ORACLE[name]}) q{i} USING (MAIN_SYSTEM_ID)" for i, name in enumerate(FAMILIES))
    shown = ", ".join(f"q{i}.{c}" for i, (_, names) in enumerate(FAMILIES.values()) for c in names)
    return f"WITH loans AS ({DENSE['loans']}) SELECT LOAN_ID, {shown} FROM loans {joined}"


@query("d15_history_facts", _sql())
def _(spark, sf_dir):
    """Every loan with facts of its retailer's whole history, from the frame that has all families."""
    frame = feature_frame.build_feature_frame(load_views(spark, sf_dir), cutoff=None, with_series=True, at=CUTOFF)[0]
    kinds, outs = dict(frame.dtypes), []
    for prefix, names in FAMILIES.values():
        for c in names:
            x = F.col(prefix + c)
            if kinds[prefix + c] == "double" and not c.startswith(_EXACT):
                x = F.round(F.nanvl(x, F.lit(None)), 4 if c == "abs_energy" else 6)
            outs.append(x.alias(c))
    return frame.select("LOAN_ID", *outs)

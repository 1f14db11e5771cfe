"""The adapter views of ``ledgerlens.sources.adapters`` stated in SQL, as a WITH prefix for the oracle queries."""

from __future__ import annotations


def _loans(ident: str, retailer: str, ts: str, amount: str, source: str, where: str) -> str:
    spent = f"({amount} * ({ident} % 12) / 10.0::DOUBLE)"
    missed = f"({ident} % 25 <= 1 OR {ident} % 20 = 0)"
    balance = f"(CASE WHEN {missed} THEN -{spent} ELSE 0.0::DOUBLE END)"
    repaid = f"(CASE WHEN {ident} % 20 = 0 AND {ident} % 25 > 1 THEN {spent} ELSE 0.0::DOUBLE END)"
    return f"""SELECT {ident} AS "INDEX", {retailer} AS MAIN_SYSTEM_ID, {retailer} + 100000 AS RETAILER_ID, {ident} AS LOAN_ID,
  {ts} AS LOAN_ISSUANCE_DATE, {amount} AS LOAN_AMOUNT, 0.0::DOUBLE AS INITIAL_COST, {amount} AS TOTAL_INITIAL_AMOUNT,
  {ts} + INTERVAL 7 DAY AS INITIAL_DATE, {ts} + INTERVAL 8 DAY AS LOAN_PAYMENT_DATE, {spent} + {balance} AS PAYMENT_AMOUNT,
  CASE WHEN {ident} % 20 = 0 THEN 1 ELSE 0 END AS FIRST_TRAIL_DELAYS, {spent} AS SPENT, {balance} AS FIRST_TRIAL_BALANCE,
  0.0::DOUBLE AS FINAL_COST, {spent} AS TOTAL_FINAL_AMOUNT, {ident} AS REPAYMENT_ID, {repaid} AS REPAYMENT_AMOUNT,
  {ts} + INTERVAL 8 DAY AS REPAYMENT_UPDATED, {balance} + {repaid} AS CUMMULATIVE_OUTSTANDING,
  CASE WHEN {ident} % 25 = 0 THEN 'Unpaid' WHEN {ident} % 25 = 1 THEN 'Partialy paid' ELSE 'Paid' END AS PAYMENT_STATUS
  FROM {source} WHERE {where}"""


DENSE = {
    "loans": _loans("event_id", "user_id", "ts", "value", "events", "event_type = 'signup'"),
    "purchases": """SELECT event_id AS ORDER_ID, user_id AS MAIN_SYSTEM_ID, value AS ORDER_PRICE,
  value * (event_id % 5) / 100.0::DOUBLE AS DISCOUNT, value - value * (event_id % 5) / 100.0::DOUBLE AS ORDER_PRICE_AFTER_DISCOUNT,
  ts AS ORDER_CREATION_DATE FROM events WHERE event_type = 'purchase' AND user_id % 10 <> 9""",
    "sales": """SELECT event_id AS ID, user_id AS MAIN_SYSTEM_ID, ts AS CREATED_AT,
  ts + to_minutes(CAST(event_id % 60 AS INTEGER)) AS UPDATED_AT, value AS AMOUNT, value / 100.0::DOUBLE AS FEES,
  value / 50.0::DOUBLE AS RETAILER_CUT, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESSFUL' END AS STATUS,
  value + value / 100.0::DOUBLE AS TOTAL_AMOUNT_INCLUDING_TAX,
  CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value + value / 100.0::DOUBLE END AS TOTAL_AMOUNT_PAID,
  value * (event_id % 7) AS WALLET_BALANCE_BEFORE_TRANSACTION FROM events WHERE event_type IN ('click', 'view', 'error')""",
    "retailers": "SELECT DISTINCT user_id AS MAIN_SYSTEM_ID FROM events WHERE event_type = 'signup'",
}

SPARSE = {
    "loans": _loans("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "orders", "o_orderkey % 5 = 0"),
    "purchases": """SELECT o_orderkey AS ORDER_ID, o_custkey AS MAIN_SYSTEM_ID, o_totalprice AS ORDER_PRICE,
  o_orderdate AS ORDER_CREATION_DATE FROM orders WHERE o_orderkey % 5 <> 0""",
    "retailers": "SELECT c_custkey AS MAIN_SYSTEM_ID FROM customer",
}


def with_views(body: str, *ctes: str, adapter: dict[str, str] = DENSE, names: str = "loans purchases sales retailers") -> str:
    """``WITH <views>, <ctes> <body>``; only views whose name is in ``names`` and exist in the adapter."""
    parts = [f"{name} AS ({adapter[name]})" for name in names.split() if name in adapter]
    return "WITH " + ",\n".join([*parts, *ctes]) + "\n" + body

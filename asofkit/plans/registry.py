"""Where the queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
TWINS: dict[str, str] = {}

#: The adapters of sources.adapters in SQL.
BARS = """bars AS (
  SELECT ticker, date, CAST(min(k) % 100000000 AS DOUBLE) AS open, max(px) AS high, min(px) AS low, CAST(max(k) % 100000000 AS DOUBLE) AS close, sum(q) AS volume
  FROM (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, floor(100 * l_extendedprice / l_quantity + 0.5) AS px, l_quantity AS q,
               (l_orderkey * 10 + l_linenumber) * 100000000 + CAST(floor(100 * l_extendedprice / l_quantity + 0.5) AS BIGINT) AS k FROM lineitem)
  GROUP BY ticker, date)"""

_SUMS = """CAST(sum(floor(l_extendedprice)) AS DOUBLE) AS revenue, CAST(sum(floor(l_extendedprice * (0.4 + l_discount))) AS DOUBLE) AS cogs,
  CAST(sum(floor(l_extendedprice * (0.2 + l_tax))) AS DOUBLE) AS opex0, CAST(sum(l_linenumber * 100) AS DOUBLE) AS interest, CAST(sum(floor(l_quantity * 300)) AS DOUBLE) AS capex,
  CAST(sum(floor(l_extendedprice * l_discount)) AS DOUBLE) AS receivables, CAST(sum(floor(l_quantity * 500)) AS DOUBLE) AS inventory,
  CAST(sum(floor(l_extendedprice * l_tax)) AS DOUBLE) AS payables, CAST(count(*) AS DOUBLE) AS n_lines"""
_QUARTER = "CAST(date_trunc('quarter', CAST(o_orderdate AS DATE)) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"
_DERIVED = """year(period_end) AS fiscal_year, quarter(period_end) AS fiscal_quarter, CASE WHEN quarter(period_end) = 4 THEN '10-K' ELSE '10-Q' END AS form,
  revenue, cogs, CASE WHEN (ticker + quarter(period_end)) % 7 = 0 THEN NULL ELSE opex0 END AS opex, interest, capex, receivables, inventory, payables, n_lines,
  revenue - cogs - opex0 AS operating_income, revenue - cogs - opex0 - interest AS net_income, revenue - cogs - opex0 + n_lines * 50 AS cfo,
  revenue * 3 + inventory AS assets, revenue * 2 - payables AS equity, revenue + inventory + payables AS debt, n_lines * 1000 AS cash, CAST(1000 + (ticker % 7) * 100 AS DOUBLE) AS shares"""
STATEMENTS = f"""stmts AS (
  SELECT ticker, period_end, {_DERIVED}, period_end + CAST(20 + ticker % 60 AS INTEGER) AS filing_date, period_end + CAST(20 + ticker % 60 AS INTEGER) AS available_date
  FROM (SELECT l_suppkey AS ticker, {_QUARTER} AS period_end, {_SUMS} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2))"""
FILINGS = f"""filings AS (
  SELECT ticker, period_end, {_DERIVED}, version, period_end + CAST(20 * version + ticker % 60 AS INTEGER) AS filing_date, period_end + CAST(20 * version + ticker % 60 AS INTEGER) AS available_date
  FROM (SELECT l_suppkey AS ticker, {_QUARTER} AS period_end, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS version, {_SUMS} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3))"""
EVENTS = """events_m AS (
  SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'O' THEN 'add' ELSE 'remove' END AS action, o_orderkey AS event_id FROM orders WHERE o_orderstatus IN ('O', 'F'))"""


def query(*parts: str, twin: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame; twin is the SQL after the named common tables."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if twin is not None:
            TWINS[f.__name__] = (f"WITH {', '.join(parts)} " if parts else "") + twin.strip()
        return f

    return add

"""Column functions. Missing values are NULL, never NaN, and no function raises on zero or on a bad cast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[Column | str]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_div(n: Column | str, d: Column | str, positive_only: bool = False) -> Column:
    """n / d; null where d is 0, or where d is not above 0 if positive_only."""
    n, d = _c(n), _c(d)
    return F.when(d > 0 if positive_only else d != 0, n / d)


def first_valid(*cols: Column | str) -> Column:
    """The first value of the row that is not null."""
    return F.coalesce(*map(_c, cols))


def first_valid_column(by: Cols, *cols: Column | str) -> Column:
    """The first column that has any value in its group, with that column's nulls."""
    own, out = Window.partitionBy(*by), F.lit(None)
    for c in reversed(cols):
        out = F.when(F.max(_c(c).isNotNull()).over(own), _c(c)).otherwise(out)
    return out


def to_double(col: Column | str) -> Column:
    """A number, or null where the value is none."""
    return F.expr(f"try_cast({col} AS DOUBLE)") if isinstance(col, str) else col.try_cast("double")


def to_date(col: Column | str) -> Column:
    return F.expr(f"try_cast({col} AS DATE)") if isinstance(col, str) else col.try_cast("date")


def decided(predicate: Column, on_null: str = "fail") -> Column:
    """A clause that is true or false: a null comparison fails or passes."""
    return F.coalesce(predicate, F.lit(on_null == "pass"))


def ladder(steps: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in steps:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def size_bucket(cap: Column | str) -> Column:
    """mega from 200e9, large from 10e9, mid from 2e9, small from 300e6, else micro; null is unknown."""
    cap = _c(cap)
    return ladder([(cap.isNull(), "unknown"), (cap >= 200e9, "mega"), (cap >= 10e9, "large"), (cap >= 2e9, "mid"), (cap >= 300e6, "small")], "micro")


def null_sum(*cols: Column | str) -> Column:
    """The sum of what is there; null if nothing is."""
    cols = tuple(map(_c, cols))
    return F.when(F.coalesce(*cols).isNotNull(), reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in cols)))


def combine(priority: Cols = (), parts: Cols = (), total: Column | str | None = None, minus: Column | str | None = None) -> Column:
    """The first given value, else the sum of parts, else total less minus."""
    out = [_c(c) for c in priority]
    if parts:
        out.append(null_sum(*parts))
    if total is not None and minus is not None:
        out.append(_c(total) - _c(minus))
    return F.coalesce(*out)


def larger_of(a: Column | str, b: Column | str, factor: float = 1.0) -> Column:
    """b where it is more than factor times a, or where a is missing."""
    a, b = _c(a), _c(b)
    return F.when(a.isNull() | (b > a * factor), b).otherwise(a)


def reconcile_signed(value: Column | str, rebuilt: Column | str, tolerance: float = 0.15) -> Column:
    """The rebuilt value where there is none, or where the signs differ and the magnitudes are within the tolerance."""
    value, rebuilt = _c(value), _c(rebuilt)
    near = F.abs(F.abs(value) - F.abs(rebuilt)) <= tolerance * F.greatest(F.abs(value), F.abs(rebuilt))
    return F.when(value.isNull() | ((F.signum(value) * F.signum(rebuilt) < 0) & near), rebuilt).otherwise(value)


def balance_identity(assets: str, liabilities: str, equity: str) -> dict[str, Column]:
    """assets = liabilities + equity: fills the one that is missing, and takes the equity's sign from the residual within 5 %."""
    a, li, e = map(F.col, (assets, liabilities, equity))
    flipped = (F.abs(a - li - e) > 0.05 * F.abs(a)) & (F.abs(a - li + e) <= 0.05 * F.abs(a))
    return {assets: F.coalesce(a, li + e), liabilities: F.coalesce(li, a - e), equity: F.when(flipped, -e).otherwise(F.coalesce(e, a - li))}


# dates


def quarter_end(d: Column | str) -> Column:
    return F.last_day(F.add_months(F.trunc(_c(d), "quarter"), 2))


def snap_quarter_end(d: Column | str, days: int = 15) -> Column:
    """The quarter end within so many days, else the date itself."""
    d = _c(d)
    before = F.date_sub(F.trunc(d, "quarter").cast("date"), 1)
    return F.when(F.datediff(d, before) <= days, before).when(F.datediff(quarter_end(d), d) <= days, quarter_end(d)).otherwise(d)


def fiscal_key(year: Column | str, quarter: Column | str) -> Column:
    """year * 4 + quarter: consecutive quarters are consecutive numbers."""
    return _c(year) * 4 + _c(quarter)


def fiscal_label(year: Column | str, quarter: Column | str) -> Column:
    return F.concat(_c(year).cast("int").cast("string"), F.lit("Q"), _c(quarter).cast("int").cast("string"))


def parse_fiscal_label(label: Column | str) -> Column:
    """struct(year, quarter) of a label such as 2024Q3; nulls where it is none."""
    label = _c(label)
    part = lambda k: F.regexp_extract(label, r"^(\d{4})Q([1-4])$", k).try_cast("int")
    return F.struct(part(1).alias("year"), part(2).alias("quarter"))


def next_weekday(d: Column | str) -> Column:
    """The next day from Monday to Friday."""
    d = _c(d)
    return F.date_add(d, ladder([(F.dayofweek(d) == 6, 3), (F.dayofweek(d) == 7, 2)], 1))


def availability(accepted: Column | str, filed: Column | str, period_end: Column | str, form: Column | str) -> dict[str, Column]:
    """available_date and method: accepted, else filed, else 90 days (annual forms, December) or 45 days after the period."""
    accepted, filed, period_end, form = map(_c, (accepted, filed, period_end, form))
    annual = form.startswith("10-K") | (form.isNull() & (F.month(period_end) == 12))
    days = F.when(annual, 90).otherwise(45)
    return {
        "available_date": F.coalesce(F.to_date(accepted), filed, F.date_add(period_end, days)),
        "method": ladder([(accepted.isNotNull(), "accepted"), (filed.isNotNull(), "filed"), (period_end.isNotNull(), F.concat(F.lit("fallback_"), days.cast("string")))]),
    }


def form_flags(form: Column | str) -> dict[str, Column]:
    form = _c(form)
    return {"is_amendment": form.endswith("/A"), "is_nt": form.startswith("NT")}


def punctuality(lag_days: Column | str, expected: Column | str) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - 2 * F.abs(_c(lag_days) - _c(expected))))


# differences between two sources


def pct_diff(left: Column | str, right: Column | str) -> Column:
    """|left - right| / |left|; 0 where both are 0, null where only the base is."""
    left, right = _c(left), _c(right)
    return F.when(left != 0, F.abs(left - right) / F.abs(left)).when(right == 0, 0.0)


def breach(left: Column | str, right: Column | str, kind: Column | str, tolerance: Column | str) -> Column:
    """Whether the difference exceeds an absolute or a relative tolerance."""
    left, right, kind, tolerance = map(_c, (left, right, kind, tolerance))
    return F.when(kind == "absolute", F.abs(left - right) > tolerance).otherwise(F.coalesce(pct_diff(left, right) > tolerance, left != right))


def signed(value: Column | str, rule: Column | str) -> Column:
    """as_is, invert or abs."""
    value, rule = _c(value), _c(rule)
    return F.when(rule == "invert", -value).when(rule == "abs", F.abs(value)).otherwise(value)


def comparison_status(left: Column | str, right: Column | str, misaligned: Column, breached: Column, ambiguous: Column | None = None) -> Column:
    left, right = _c(left), _c(right)
    steps = [(left.isNull() & right.isNull(), "missing_both"), (left.isNull(), "missing_left"), (right.isNull(), "missing_right"), (misaligned, "alignment_issue"), (breached, "breach")]
    if ambiguous is not None:
        steps.append((ambiguous, "matched_with_ambiguity"))
    return ladder(steps, "match")


def codes(conditions: Mapping[str, Column]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))


# strings and keys


def ticker_key(ticker: Column | str) -> Column:
    """Upper case without dots and dashes."""
    return F.translate(F.upper(F.trim(_c(ticker))), ".-", "")


def padded_ticker(ticker: Column | str, width: int = 6) -> Column:
    ticker = _c(ticker).cast("string")
    return F.when(ticker.rlike(r"^\d+$"), F.lpad(ticker, width, "0")).otherwise(ticker)


def name_key(name: Column | str) -> Column:
    """Lower case, letters and digits alone."""
    return F.regexp_replace(F.lower(_c(name)), r"[^\p{L}\p{N}]+", "")


def row_id(*cols: Column | str) -> Column:
    return F.sha1(F.concat_ws("|", *(F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols)))


def common_stock(ticker: Column | str, name: Column | str) -> Column:
    """False for warrants, units, rights, preferred shares, receipts and funds by suffix or by words of the name."""
    odd = _c(ticker).rlike(r"(\.|-)(W|WS|WT|U|UN|R|RT|P[A-Z]?)$|^[A-Z]{4}[WRU]$") | F.lower(_c(name)).rlike(r"\b(warrants?|units?|rights?|preferred|depositary|etf|fund|trust)\b")
    return ~F.coalesce(odd, F.lit(False))


# ratios


def valuation_ratios(price: Column | str) -> dict[str, Column]:
    """Market ratios and values per share of columns named as in the statements; denominators must be above 0. A missing debt or cash counts as 0."""
    price, cap, fcf = _c(price), _c(price) * F.col("shares"), F.col("cfo") - F.col("capex")
    ev = cap + F.coalesce(F.col("debt"), F.lit(0.0)) - F.coalesce(F.col("cash"), F.lit(0.0))
    return {
        "per": safe_div(cap, "net_income", True),
        "pbr": safe_div(cap, "equity", True),
        "psr": safe_div(cap, "revenue", True),
        "pcr": safe_div(cap, "cfo", True),
        "por": safe_div(cap, "operating_income", True),
        "pfcfr": safe_div(cap, fcf, True),
        "ev": ev,
        "ev_ebit": safe_div(ev, "operating_income", True),
        "ev_ebitda": safe_div(ev, "ebitda", True),
        "fcf_yield": safe_div(fcf, cap, True),
        "earnings_yield": safe_div("net_income", cap, True),
        "dividend_yield": safe_div("dividends", cap, True),
        "eps": safe_div("net_income", "shares", True),
        "bps": safe_div("equity", "shares", True),
        "sps": safe_div("revenue", "shares", True),
        "ops": safe_div("operating_income", "shares", True),
        "oofps": safe_div("cfo", "shares", True),
        "fcfps": safe_div(fcf, "shares", True),
    }


def peg(per: Column | str, growth: Column | str) -> Column:
    """Price to earnings over their growth, where they grow."""
    return _c(per) / F.when(_c(growth) > 0, _c(growth))


def quality_ratios() -> dict[str, Column]:
    gross = F.col("revenue") - F.col("cogs")
    return {
        "roe": safe_div("net_income", "equity", True),
        "roa": safe_div("net_income", "assets", True),
        "roic": safe_div(F.col("operating_income") * 0.79, F.col("equity") + F.coalesce(F.col("debt"), F.lit(0.0)), True),
        "gp_a": safe_div(gross, "assets", True),
        "gross_margin": safe_div(gross, "revenue", True),
        "operating_margin": safe_div("operating_income", "revenue", True),
        "net_margin": safe_div("net_income", "revenue", True),
        "accruals": safe_div(F.col("net_income") - F.col("cfo"), "assets", True),
        "leverage": safe_div("debt", "equity", True),
        "ccr": safe_div("cfo", "net_income", True),
    }


def cash_cycle(days: int = 365) -> dict[str, Column]:
    """Days of receivables, inventory and payables, and the operating and cash cycles."""
    dso, dio, dpo = safe_div("receivables", "revenue", True) * days, safe_div("inventory", "cogs", True) * days, safe_div("payables", "cogs", True) * days
    return {"dso": dso, "dio": dio, "dpo": dpo, "operating_cycle": dso + dio, "cash_cycle": dso + dio - dpo}


def available(df: DataFrame, *cols: str) -> DataFrame:
    """The columns that exist, in the order asked for."""
    return df.select(*(c for c in cols if c in df.columns))


# policies and classifications


def mapped(label: Column | str, table: Mapping[str, str], otherwise: str | None = None) -> Column:
    """The code of a normalised label; otherwise the given code, or the label itself."""
    label = F.upper(F.trim(_c(label)))
    codes = F.create_map(*(F.lit(x) for k, v in table.items() for x in (k.upper(), v)))
    return F.coalesce(F.try_element_at(codes, label), F.lit(otherwise) if otherwise else label)


def exchange_and_sector(exchange: Column | str, sic: Column | str, name: Column | str) -> dict[str, Column]:
    """exchange: NYSE, NASDAQ, AMEX or OTHER; is_finance by SIC 6000-6799 or by words of the name."""
    ex, sic, name = F.upper(_c(exchange)), _c(sic).try_cast("int"), F.lower(_c(name))
    finance = sic.between(6000, 6799) | name.rlike(r"\b(bank|bancorp|insurance|financial|capital|trust|reit)\b")
    return {"exchange": ladder([(F.contains(ex, F.lit("NASDAQ")), "NASDAQ"), (F.contains(ex, F.lit("AMERICAN")) | F.contains(ex, F.lit("AMEX")), "AMEX"), (F.contains(ex, F.lit("NYSE")) | F.contains(ex, F.lit("NEW YORK")), "NYSE")], "OTHER"), "is_finance": F.coalesce(finance, F.lit(False))}


def hidden_for(market: Column | str, hide: str, *cols: str) -> dict[str, Column]:
    """Columns that one market does not show."""
    return {c: F.when(_c(market) != hide, F.col(c)) for c in cols}


def multiple(price: Column | str, per_share: Column | str, on_negative: str = "null") -> Column:
    """price / per_share; a base of 0 or less gives null, or the negative multiple where that is allowed."""
    return safe_div(price, per_share, on_negative == "null")


def filled_totals(revenue: str, cogs: str, gross: str, pretax: str, tax: str, net: str) -> dict[str, Column]:
    """revenue = cogs + gross, pretax = net + tax, tax = pretax - net where they lack."""
    pre = F.coalesce(pretax, F.col(net) + F.col(tax))
    return {revenue: F.coalesce(revenue, F.col(cogs) + F.col(gross)), pretax: pre, tax: F.coalesce(F.col(tax), pre - F.col(net))}


def split_by_fit(total: Column | str, first: Column | str, second: Column | str, target: Column | str) -> Column:
    """True where total already holds second: the residual against the target is smaller without adding it."""
    total, first, second, target = map(_c, (total, first, second, target))
    return F.abs(target - (first - total)) <= F.abs(target - (first - total - second))


def normalised_value(metric: Column | str, values: Mapping[str, Column | str]) -> Column:
    """struct(value, source): gross profit, pretax income and intangibles are rebuilt where the reported value lacks."""
    metric, v = _c(metric), {k: _c(c) for k, c in values.items()}
    pair = lambda value, source: F.struct(value.cast("double").alias("value"), F.lit(source).alias("source"))
    rebuilt = {"gross_profit": v["revenue"] - v["cogs"], "pretax_income": v["net_income"] + v["tax"], "intangibles": null_sum(v["intangibles"], v["goodwill"])}
    out = F.when(v["value"].isNotNull(), pair(v["value"], "reported"))
    for name, c in rebuilt.items():
        out = out.when((metric == name) & c.isNotNull(), pair(c, f"rebuilt_{name}"))
    return out.when((metric == "dividends") & v["cash_flow_row"], pair(F.lit(0.0), "no_dividend"))


def execution_price(open_: Column | str, close: Column | str, before: Column | str, kind: str = "open", offset_pct: float = 0.0) -> Column:
    """The open, the close, or the close of the signal day, moved by a percentage."""
    chosen = {"open": _c(open_), "close": _c(close), "previous_close": _c(before)}[kind]
    return chosen * (1 + offset_pct / 100)


def account_sign(name: Column | str, value: Column | str) -> Column:
    """Losses by name are negative, gains positive; other accounts keep their sign."""
    name, value = F.lower(_c(name)), _c(value)
    return F.when(name.rlike(r"\bloss(es)?\b") & ~name.rlike(r"\bgain"), -F.abs(value)).when(name.rlike(r"\bgains?\b") & ~name.rlike(r"\bloss"), F.abs(value)).otherwise(value)


def smaller_change(current: Column | str, raw: Column | str, converted: Column | str) -> Column:
    """The smaller of both differences that is not negative; null if neither is."""
    a, b = _c(current) - _c(raw), _c(current) - _c(converted)
    return F.least(F.when(a >= 0, a), F.when(b >= 0, b))


def current_debt(tag_and_lease: Cols, parts: Cols, base: Column | str) -> Column:
    """The tagged total with its lease, else the sum of the parts, else the base."""
    return F.coalesce(F.when(_c(tag_and_lease[0]).isNotNull(), null_sum(*tag_and_lease)), null_sum(*parts), _c(base))


def capital_expenditure(ppe: Column | str, software: Cols, productive: Cols) -> Column:
    """Plant and the largest of each further group."""
    return null_sum(ppe, F.greatest(*map(_c, software)) if len(software) > 1 else _c(software[0]), F.greatest(*map(_c, productive)) if len(productive) > 1 else _c(productive[0]))


def cost_of_sales(direct: Column | str, gross: Column | str, revenue: Column | str, expenses: Column | str) -> Column:
    """The direct cost; the expenses stand in where cost and gross profit lack, or where the cost is a tenth of revenue or less and expenses exceed 102 % of it."""
    direct, gross, revenue, expenses = map(_c, (direct, gross, revenue, expenses))
    small = (direct <= 0.1 * revenue) & (expenses > 1.02 * revenue)
    return F.when((direct.isNull() & gross.isNull()) | small, expenses).otherwise(F.coalesce(direct, revenue - gross))


def noncurrent_debt(noncurrent: Column | str, bundled: Column | str, total: Column | str, base: Column | str, operating_leases: Column | str, finance_leases: Column | str) -> Column:
    """The first of noncurrent, bundled (with finance leases), total and base; then the leases that it does not hold yet."""
    first = F.coalesce(*map(_c, (noncurrent, bundled, total, base)))
    holds = _c(noncurrent).isNull() & _c(bundled).isNotNull()
    return null_sum(first, operating_leases, F.when(~holds, _c(finance_leases)))


def selling_expenses(direct: Column | str, base: Column | str, selling: Column | str, general: Column | str) -> Column:
    """The tagged amount, the base, or the sum of both halves if both are there."""
    return F.coalesce(_c(direct), _c(base), _c(selling) + _c(general))


def with_operating_income(df: DataFrame, name: str, value: str, revenue: str, total_cost: str, gross: str, opex: str, sga: str, rnd: str, finance: str) -> DataFrame:
    """Operating income against revenue - total cost (unless above 102 % of the gross profit), gross - opex, and gross - SG&A - R&D, in turn; finance issuers only fill what lacks.

    A column per step, so that no step is written out again in the next one.
    """
    whole = F.col(revenue) - F.col(total_cost)
    steps = [F.when(F.coalesce(whole <= 1.02 * F.col(gross), F.lit(True)), whole), F.col(gross) - F.col(opex), F.col(gross) - F.col(sga) - F.coalesce(rnd, F.lit(0.0))]
    out = df.withColumn("__0", F.col(value))
    for k, rebuilt in enumerate(steps):
        now = F.col(f"__{k}")
        # without a rebuilt value the value stays
        out = out.withColumn("__r", rebuilt).withColumn(f"__{k + 1}", F.when(F.col(finance), F.coalesce(now, "__r")).otherwise(F.coalesce(reconcile_signed(now, "__r"), now))).drop("__r")
    return out.withColumn(name, F.col(f"__{len(steps)}")).drop(*(f"__{k}" for k in range(len(steps) + 1)))


def net_income_chain(value: Column | str, pretax: Column | str, tax: Column | str, revenue: Column | str) -> Column:
    """Net income against pretax - tax; where revenue is a million or less, it takes the sign of the pretax income."""
    own = F.coalesce(reconcile_signed(value, _c(pretax) - _c(tax)), _c(value))
    tiny = (_c(revenue) <= 1e6) & (F.signum(_c(pretax)) * F.signum(own) < 0)
    return F.when(tiny, -own).otherwise(own)


def depreciation(base: Column | str, combined: Column | str, with_costs: Column | str) -> Column:
    """The combined tag where it is more than 1.1 times the base, then the tag with cost of goods where it is more than twice that."""
    return larger_of(larger_of(base, combined, 1.1), with_costs, 2.0)


def by_coverage(value: Column | str, annual: Column | str, key: str = "ticker", least: float = 0.4) -> Column:
    """A quarter of the year's value for keys of which less than two fifths of the rows have one."""
    have = F.avg(_c(value).isNotNull().cast("int")).over(Window.partitionBy(key))
    return F.when(have < least, F.coalesce(_c(value), _c(annual) / 4)).otherwise(_c(value))


def both_or_null(a: Column | str, b: Column | str) -> Column:
    """a less b where a missing one counts as 0; null only where both are missing."""
    return F.when(F.coalesce(_c(a), _c(b)).isNotNull(), F.coalesce(_c(a), F.lit(0.0)) - F.coalesce(_c(b), F.lit(0.0)))


def regime(d: Column | str, cut: str, before: str = "before", after: str = "after") -> Column:
    """Which side of a cut-off date a day lies on; the cut itself is after."""
    return F.when(_c(d) < F.lit(cut).cast("date"), before).when(_c(d).isNotNull(), after)


def clipped(c: Column | str, low: float, high: float) -> Column:
    """Between both bounds; null stays null, unlike in least() and greatest()."""
    return F.when(_c(c).isNotNull(), F.least(F.greatest(_c(c), F.lit(low)), F.lit(high)))


def magnitude(c: Column | str) -> Column:
    """floor(log10 |x|), null for 0."""
    return F.floor(F.log10(F.nullif(F.abs(_c(c)), F.lit(0.0)))).cast("int")


def remainder(a: Column | str, b: Column | str) -> Column:
    """a % b with the divisor's sign; null where b is 0."""
    a, b = _c(a), F.nullif(_c(b), F.lit(0.0))
    return a - F.floor(a / b) * b

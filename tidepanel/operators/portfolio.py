"""Portfolios as sets: all rebalances, portfolios and names are rows; nothing loops over dates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.core import clean, sdiv
from tidepanel.operators.contracts import ContractError, valid_portfolio

#: Periods a year by horizon in days.
PERIODS = {1: 252, 5: 52, 20: 12}
NAMES = ["portfolio", "portfolio_kind", "is_diagnostic"]
KINDS = ("quintile_long", "top_k_long", "diagnostic_long_short")


def net_return(gross: Column, turnover: Column, bps: float) -> Column:
    """Gross return less costs; a turnover that is not finite or below zero is an error at run time, costs are checked here."""
    if not (math.isfinite(bps) and bps >= 0):
        raise ContractError(f"costs must be finite and not negative: {bps}")
    turnover = F.when(F.isnan(turnover) | (turnover < 0) | (turnover == float("inf")), F.raise_error("turnover must be finite and not negative").cast("double")).otherwise(turnover)
    return gross - turnover * bps / 10_000.0


def rebalances(panel: DataFrame, h: int, least: int, date: str = "trade_date") -> DataFrame:
    """Every h-th date, with its number of eligible names and, if those are enough, its place among valid ones."""
    ok = clean(F.col("directed_score")).isNotNull() & F.coalesce("tradable_next_open", F.lit(False))
    dates = panel.groupBy(date).agg(F.count_if(ok).alias("n_eligible"))
    order = Window.orderBy(date)
    every = dates.withColumn("_r", F.row_number().over(order)).where((F.col("_r") - 1) % h == 0).drop("_r")
    valid = F.col("n_eligible") >= least
    return every.withColumn("seq", F.when(valid, F.sum(valid.cast("long")).over(order)))


def positions(panel: DataFrame, h: int, top_k: int, q: int, date: str = "trade_date", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``seq, date, portfolio, portfolio_kind, is_diagnostic, security_id, weight`` and label columns.

    Quantiles split the ranked names evenly (the first get one more); the top k are the last k by (score, id);
    ``top_bottom`` holds the top quantile long and the bottom one short.  A side's names are told from the number of names of the
    date, so one sort by date serves all portfolios; only those of ``kinds`` are made.
    """
    label, end = f"label_excess_o2o_{h}d", f"label_end_date_{h}d"
    calendar = rebalances(panel, h, max(top_k, q), date).where("seq is not null")
    rows = panel.where(clean(F.col("directed_score")).isNotNull() & F.coalesce("tradable_next_open", F.lit(False))).join(F.broadcast(calendar), date)
    up, n = Window.partitionBy(date).orderBy("directed_score", F.col("security_id").cast("string")), F.col("n_eligible")
    from_top = n - F.row_number().over(up) + 1
    ranked = rows.select("seq", date, "security_id", "entry_date", F.col(end).alias("label_end_date"), F.col(label).alias("label"), "n_eligible", F.ntile(q).over(up).alias("b"), from_top.alias("t"))
    size = F.floor(n / q) + (F.col("b") <= n % q).cast("long")

    def one(kind: str, name: Column, diagnostic: bool, w: Column, held: Column | None = None) -> Column:
        made = F.struct(name.alias("portfolio"), F.lit(kind).alias("portfolio_kind"), F.lit(diagnostic).alias("is_diagnostic"), w.alias("weight"))
        return made if held is None else F.when(held, made)

    every = {
        "quintile_long": one("quintile_long", F.concat(F.lit("Q"), "b"), False, 1.0 / size),
        "top_k_long": one("top_k_long", F.lit(f"top_{top_k}"), False, F.lit(1.0 / top_k), F.col("t") <= top_k),
        "diagnostic_long_short": one("diagnostic_long_short", F.lit("top_bottom"), True, F.when(F.col("b") == q, 1.0).otherwise(-1.0) / size, F.col("b").isin(1, q)),
    }
    memberships = F.array_compact(F.array(*(every[k] for k in KINDS if k in kinds)))
    columns = ["seq", date, "security_id", "entry_date", "label_end_date", "label"]
    return ranked.select(*columns, F.explode(memberships).alias("m")).select(*columns, "m.*")


def _changes(held: DataFrame, *columns: str) -> DataFrame:
    """Weight changes ``d`` per (seq, portfolio, security) since the last valid rebalance, and whether it is held now (``own``).

    A name is compared with its own rows before and after; a row is added only where a name leaves its portfolio.
    """
    w = Window.partitionBy("security_id", "portfolio").orderBy("seq")
    before = F.when(F.lag("seq").over(w) == F.col("seq") - 1, F.lag("weight").over(w))
    leaves = F.coalesce(F.lead("seq").over(w) != F.col("seq") + 1, F.lit(True))
    rows = held.select("portfolio", "security_id", "seq", "weight", *columns, (F.col("weight") - F.coalesce(before, F.lit(0.0))).alias("_d"), leaves.alias("_leaves"))
    own = F.struct("seq", F.col("_d").alias("d"), F.lit(True).alias("own"), "weight", *columns)
    nothing = (F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("weight", *columns))
    gone = F.struct((F.col("seq") + 1).alias("seq"), (-F.col("weight")).alias("d"), F.lit(False).alias("own"), *nothing)
    return rows.select("portfolio", "security_id", F.explode(F.array_compact(F.array(own, F.when(F.col("_leaves"), gone)))).alias("x")).select("portfolio", "security_id", "x.*")


def turnovers(held: DataFrame) -> DataFrame:
    """``seq, portfolio, turnover``: half the sum of weight changes since the last valid rebalance."""
    return _changes(held).groupBy("seq", "portfolio").agg((0.5 * F.sum(F.abs("d"))).alias("turnover"))


def periods(panel: DataFrame, h: int, top_k: int, q: int, bps: float, date: str = "trade_date", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One row per rebalance date and portfolio (those of ``kinds``): names, returns, turnover and cost.

    A period is evaluable if all labels are finite and all names share entry and end dates.  Dates with too few
    names give placeholder rows that are not evaluable and leave the previous weights as they are.
    """
    valid_portfolio(h, top_k, q, bps)
    names = _changes(positions(panel, h, top_k, q, date, kinds), date, "entry_date", "label_end_date", "label")
    count = F.count_if("own")
    at = lambda c: F.when(F.col("own"), F.col(c))
    one_date = lambda c: (F.count(at(c)) == count) & (F.min(at(c)) == F.max(at(c)))
    finite = F.count(F.when(F.col("own"), clean(F.col("label")))) == count
    made = names.groupBy("seq", "portfolio").agg(
        F.max(date).alias(date),
        count.alias("n_names"),
        F.sum(at("weight") * F.col("label")).alias("_g"),
        F.coalesce(finite & one_date("entry_date") & one_date("label_end_date"), F.lit(False)).alias("is_evaluable"),
        F.when(one_date("label_end_date"), F.max(at("label_end_date"))).alias("nav_date"),
        (0.5 * F.sum(F.abs("d"))).alias("turnover"),
    ).where("n_names > 0")
    spark = panel.sparkSession
    every = [*((f"Q{i}", "quintile_long", False) for i in range(1, q + 1)), (f"top_{top_k}", "top_k_long", False), ("top_bottom", "diagnostic_long_short", True)]
    books = spark.createDataFrame([x for x in every if x[1] in kinds], "portfolio string, portfolio_kind string, is_diagnostic boolean")
    grid = rebalances(panel, h, max(top_k, q), date).select(date).crossJoin(F.broadcast(books))
    rows = grid.join(made.drop("seq"), [date, "portfolio"], "left")
    gross = F.when(F.col("is_evaluable"), F.col("_g"))
    turnover = F.coalesce("turnover", F.lit(0.0))
    return rows.select(
        date, *NAMES, F.lit(h).alias("horizon_days"), "nav_date", F.coalesce("n_names", F.lit(0)).cast("long").alias("n_names"), F.coalesce("is_evaluable", F.lit(False)).alias("is_evaluable"),
        gross.alias("gross_return"), turnover.alias("turnover"), (turnover * bps / 10_000.0).alias("cost"), net_return(gross, turnover, bps).alias("net_return"),
    )


def with_nav(table: DataFrame, date: str = "trade_date") -> DataFrame:
    """``gross_nav, net_nav``: compounded from 1, NULL from the first period that cannot be evaluated on."""
    w = Window.partitionBy("portfolio").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    halted = F.max((~F.col("is_evaluable")).cast("int")).over(w) == 1
    nav = lambda c: F.when(~halted, F.product(1 + F.coalesce(F.col(c), F.lit(0.0))).over(w))
    return table.select("*", nav("gross_return").alias("gross_nav"), nav("net_return").alias("net_nav"))


def summarize(table: DataFrame, h: int, date: str = "trade_date") -> DataFrame:
    """Per portfolio and return type: counts, annualized return, volatility, Sharpe, drawdown, mean turnover."""
    ppy = PERIODS[h]
    pair = lambda k: F.struct(F.lit(k).alias("return_type"), F.col(f"{k}_return").alias("r"), F.col(f"{k}_nav").alias("nav"))
    long = table.select(date, *NAMES, "is_evaluable", "turnover", F.explode(F.array(pair("gross"), pair("net"))).alias("x")).select(date, *NAMES, "is_evaluable", "turnover", "x.*")
    w = Window.partitionBy(*NAMES, "return_type").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumn("dd", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(w)) - 1)
    final = F.max_by("nav", date)
    return long.groupBy(*NAMES, "return_type").agg(
        F.lit(h).alias("horizon_days"), F.count("*").alias("n_periods"), F.count_if("is_evaluable").alias("n_evaluable_periods"),
        F.when(final > 0, F.pow(final, F.lit(float(ppy)) / F.count("*")) - 1).alias("annualized_return"),
        (F.stddev_samp("r") * F.sqrt(F.lit(float(ppy)))).alias("volatility"), (sdiv(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(float(ppy)))).alias("sharpe"),
        F.least(F.lit(0.0), F.min("dd")).alias("max_drawdown"), F.avg("turnover").alias("mean_turnover"),
    )


def active_metrics(table: DataFrame, h: int, scenarios: tuple[float, ...] = (0.0, 10.0, 20.0), date: str = "trade_date") -> DataFrame:
    """Per portfolio and one-way cost, over the full sample (``year`` NULL) and each year, in one pass.

    Period returns are means of labels in excess of the benchmark, so their mean is the excess return and their ratio to
    the deviation the information ratio.  Periods that cannot be evaluated take no part; one period alone has no ratio.
    """
    ppy = float(PERIODS[h])
    for bps in scenarios:
        net_return(F.lit(0.0), F.lit(0.0), bps)
    known = table.where("is_evaluable").withColumn("year", F.year(date)).withColumn("cost_bps", F.explode(F.array(*map(F.lit, scenarios))))
    rows = known.withColumn("_cost", F.col("turnover") * F.col("cost_bps") / 10_000.0).withColumn("_r", F.col("gross_return") - F.col("_cost"))
    by = ["portfolio", "cost_bps"]
    return rows.groupingSets([[*map(F.col, by)], [*map(F.col, by), F.col("year")]], *by, "year").agg(
        F.count("*").alias("n_periods"), (F.avg("_r") * ppy).alias("annualized_excess_return"), (sdiv(F.avg("_r"), F.stddev_samp("_r")) * F.sqrt(F.lit(ppy))).alias("information_ratio"),
        (F.product(1 + F.col("_r")) - 1).alias("compounded_return"), F.sum("_cost").alias("trading_cost"), F.avg("turnover").alias("mean_turnover"),
    )


def simulate(panel: DataFrame, h: int, top_k: int, q: int = 5, bps: float = 10.0, date: str = "trade_date", kinds: tuple[str, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """Periods with NAV, and their summary, of the portfolios of ``kinds``."""
    table = with_nav(periods(panel, h, top_k, q, bps, date, kinds), date)
    return table, summarize(table, h, date)


#: Why an order cannot fill, in order of precedence.
REASONS = ("missing_open_price", "unknown_blocked", "suspended", "limit_up", "limit_down")


def block_reason(side: Column, price: Column) -> Column:
    """Why an order cannot fill, first cause first; NULL if it can.  A row without state, or with an unknown ``unknown_blocked``, is blocked."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    unpriced = price.isNull() | ~(price > 0) | F.isnan(price) | (price == float("inf"))
    unknown = F.col("has_state").isNull() | F.coalesce("unknown_blocked", F.lit(True))
    causes = (unpriced, unknown, flag("suspended"), (side == "buy") & flag("limit_up"), (side == "sell") & flag("limit_down"))
    return F.coalesce(*(F.when(c, r) for c, r in zip(causes, REASONS, strict=True)))


def checked_accounts(targets: DataFrame, accounts: DataFrame, bps: float, keys: list[str]) -> None:
    """Refuse negative cash, a value that is not above 0, negative costs, and target weights that sum above 1."""
    if not (math.isfinite(bps) and bps >= 0):
        raise ContractError(f"costs must be finite and not negative: {bps}")
    poor = F.coalesce((F.col("cash") >= -1e-9) & (F.col("nav") > 0) & ~F.isnan("cash") & ~F.isnan("nav"), F.lit(False))
    if bad := accounts.where(~poor).limit(1).collect():
        raise ContractError(f"cash below 0 or a value not above 0: {bad[0]}")
    heavy = targets.where("weight > 1e-12").groupBy(*keys).agg(F.sum("weight").alias("weight")).where(F.col("weight") > 1 + 1e-10)
    if bad := heavy.limit(1).collect():
        raise ContractError(f"target weights above 1 need borrowing: {bad[0]}")


def rebalance_ledger(holdings: DataFrame, targets: DataFrame, accounts: DataFrame, prices: DataFrame, state: DataFrame, bps: float, date: str | None = None) -> DataFrame:
    """One step for many accounts: sells first, then buys scaled to the cash there is; no borrowing.

    With ``date`` every table has that column too, and each (account, date) is a step of its own.  Accounts and targets that
    ``checked_accounts`` refuses are refused before any order.

    ``holdings(account, code, shares)``, ``targets(account, code, weight)``, ``accounts(account, cash, nav)``,
    ``prices(code, price)``, ``state(code, suspended, limit_up, limit_down, unknown_blocked)`` give
    ``account, code, side, intended_notional, filled_notional, trading_cost, block_reason, shares_after, cash_after``.
    A name that is held and wanted but has no price has a blocked sell and a blocked buy.
    """
    rate = bps / 10_000.0
    on = [date] if date else []
    checked_accounts(targets, accounts, bps, ["account", *on])
    both = holdings.where("shares > 1e-12").join(targets.where("weight > 1e-12"), ["account", *on, "code"], "full").join(accounts, ["account", *on]).join(prices, [*on, "code"], "left").join(state.withColumn("has_state", F.lit(True)), [*on, "code"], "left")
    have, weight = F.coalesce("shares", F.lit(0.0)), F.coalesce("weight", F.lit(0.0))
    priced = (F.col("price") > 0) & (F.col("price") < float("inf")) & ~F.isnan("price")
    want = F.when(priced, weight * F.col("nav") / F.col("price"))
    rows = both.select("account", *on, "code", "cash", F.when(priced, F.col("price")).alias("price"), have.alias("have"), want.alias("want"), "has_state", "suspended", "limit_up", "limit_down", "unknown_blocked", (weight > 0).alias("wanted"))
    gap = F.coalesce(F.col("want"), F.lit(0.0)) - F.col("have")
    order = lambda when, side, amount: F.when(when, F.struct(F.lit(side).alias("side"), amount.alias("gap")))
    unpriced_buy = F.col("want").isNull() & F.col("wanted")
    orders = F.array_compact(F.array(order(gap < -1e-12, "sell", gap), order(F.coalesce(F.when(~unpriced_buy, gap > 1e-12), F.lit(False)), "buy", gap), order(unpriced_buy, "buy", F.lit(0.0))))
    rows = rows.withColumn("o", F.explode(orders)).select("*", "o.*").drop("o")
    rows = rows.withColumn("block_reason", block_reason(F.col("side"), F.col("price"))).withColumn("intended_notional", F.abs("gap") * F.coalesce("price", F.lit(0.0)))
    open_ = F.col("block_reason").isNull()
    account = Window.partitionBy("account", *on)
    proceeds = F.sum(F.when((F.col("side") == "sell") & open_, F.col("intended_notional") * (1 - rate)).otherwise(0.0)).over(account)
    required = F.sum(F.when((F.col("side") == "buy") & open_, F.col("intended_notional") * (1 + rate)).otherwise(0.0)).over(account)
    scale = F.coalesce(F.least(F.lit(1.0), sdiv(F.col("cash") + proceeds, required)), F.lit(0.0))
    filled = F.when(~open_, 0.0).when(F.col("side") == "sell", F.col("intended_notional")).otherwise(F.col("intended_notional") * scale)
    rows = rows.withColumn("filled_notional", filled).withColumn("trading_cost", F.col("filled_notional") * rate)
    signed = F.when(F.col("side") == "sell", F.col("filled_notional")).otherwise(-F.col("filled_notional")) - F.col("trading_cost")
    after = F.greatest(F.lit(0.0), F.col("cash") + F.sum(signed).over(account))
    shares = F.col("have") + F.coalesce(sdiv(F.when(F.col("side") == "buy", F.col("filled_notional")).otherwise(-F.col("filled_notional")), F.col("price")), F.lit(0.0))
    return rows.select("account", *on, "code", "side", "intended_notional", "filled_notional", "trading_cost", "block_reason", shares.alias("shares_after"), after.alias("cash_after"))


def execution_tables(held: DataFrame, daily: DataFrame, states: DataFrame, nav: float, date: str = "trade_date") -> dict[str, DataFrame]:
    """The tables of ``rebalance_ledger`` for every (account, date) of ``held(account, seq, date, security_id, weight)``.

    Orders of a signal date fill at the opens of the next session; a last date without one has no step.  An account
    comes in with ``nav`` as its last valid rebalance invested it at the opens of that one (all cash before the first);
    names without an open then stay in cash, and those without one now count at the earlier price.  ``states`` are
    the rows of a signal date whose state is known: not tradable at the next open is suspended; a session at
    a single price above (below) the signal's close is limit up (down).
    """
    sessions = daily.select(date).distinct().withColumn("_entry", F.lead(date).over(Window.orderBy(date)))
    entered = daily.select(F.col(date).alias("_entry"), F.col("security_id").alias("code"), F.when(F.col("adjusted_open") > 0, F.col("adjusted_open")).alias("price"), (F.col("adjusted_high") == F.col("adjusted_low")).alias("_single"))
    entered = entered.join(F.broadcast(sessions.where("_entry is not null")), "_entry").drop("_entry")
    prices = entered.select(date, "code", "price")
    live = held.join(F.broadcast(sessions.where("_entry is not null").select(date)), date).select("account", "seq", date, F.col("security_id").alias("code"), "weight")
    steps = live.select("account", "seq", date).distinct()
    bought = live.join(prices, [date, "code"]).where("price > 0").select("account", (F.col("seq") + 1).alias("seq"), "code", (F.col("weight") * nav / F.col("price")).alias("shares"), F.col("price").alias("_paid"))
    holdings = bought.join(steps, ["account", "seq"]).join(prices, [date, "code"], "left")
    worth = holdings.groupBy("account", date).agg(F.sum(F.col("shares") * F.col("_paid")).alias("_spent"), F.sum(F.col("shares") * F.coalesce("price", "_paid")).alias("_worth"))
    cash = nav - F.coalesce("_spent", F.lit(0.0))
    accounts = steps.join(worth, ["account", date], "left").select("account", date, F.greatest(cash, F.lit(0.0)).alias("cash"), (cash + F.coalesce("_worth", F.lit(0.0))).alias("nav"))
    known = states.select(date, F.col("security_id").alias("code"), F.col("adjusted_close").alias("_close"), "tradable_next_open").join(entered, [date, "code"], "left")
    state = known.select(
        date, "code", (~F.col("tradable_next_open")).alias("suspended"), (F.col("_single") & (F.col("price") > F.col("_close"))).alias("limit_up"),
        (F.col("_single") & (F.col("price") < F.col("_close"))).alias("limit_down"), F.col("tradable_next_open").isNull().alias("unknown_blocked"),
    )
    return {"holdings": holdings.select("account", date, "code", "shares"), "targets": live.select("account", date, "code", "weight"), "accounts": accounts, "prices": prices, "state": state}

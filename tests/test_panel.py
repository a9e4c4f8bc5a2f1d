"""Literal cases with hand-computed results, on tiny frames."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import catalog, contracts, cross_section, evidence, factors, labels, models, portfolio, rolling
from tidepanel.sources import panel, sinks

DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=k) for k in range(n)]


def closes(spark, series):
    rows = [(d, name, float(v)) for name, values in series.items() for d, v in zip(days(len(values)), values, strict=True)]
    return spark.createDataFrame(rows[::-1], "trade_date date, security_id string, adjusted_close double")


def test_reversal_and_momentum(spark):
    p = closes(spark, {"A": [100 + i for i in range(62)], "B": [200 - 2 * i for i in range(62)]})
    got = {(r.security_id, r.trade_date): r.raw_value for r in factors.compute(p, "REV5").collect()}
    assert got["A", days(62)[5]] == pytest.approx(105 / 100 - 1) and got["A", days(62)[4]] is None
    got = {(r.security_id, r.trade_date): r.raw_value for r in factors.compute(p, "MOM60").collect()}
    assert got["B", days(62)[60]] == pytest.approx(80 / 200 - 1) and got["B", days(62)[59]] is None
    vol = [r.raw_value for r in factors.compute(p, "VOL20").where("security_id = 'A'").orderBy("trade_date").collect()]
    ret = np.diff([100 + i for i in range(62)]) / np.array([100 + i for i in range(61)])
    assert vol[19] is None and vol[20] == pytest.approx(ret[:20].std())


def test_idiosyncratic_volatility_is_the_regression_residual(spark):
    rng = np.random.default_rng(0)
    m, c = rng.normal(0, 0.01, 22), 100 * np.cumprod(1 + rng.normal(0, 0.02, 22))
    rows = [(d, "A", float(x), float(y) if k else None) for k, (d, x, y) in enumerate(zip(days(22), c, m, strict=True))]
    p = spark.createDataFrame(rows, "trade_date date, security_id string, adjusted_close double, market_return double")
    got = [r.raw_value for r in factors.compute(p, "IDIOVOL20").orderBy("trade_date").collect()]
    y, x = (c[1:] / c[:-1] - 1)[:20], np.stack([np.ones(20), m[1:21]], 1)
    rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert got[19] is None and got[20] == pytest.approx(math.sqrt((rest**2).mean()))


def test_unknown_factor_and_columns(spark):
    with pytest.raises(contracts.ContractError):
        factors.compute(closes(spark, {"A": [1.0]}), "NOPE")
    with pytest.raises(contracts.ContractError):
        factors.compute(closes(spark, {"A": [1.0]}), "TURN20")
    assert {r.factor_id: r.sessions for r in factors.lookback(factors.registry(spark)).collect()}["MOM60"] == 60


def test_rolling_families_against_numpy(spark):
    rng = np.random.default_rng(1)
    n = 25
    c = 50 + rng.normal(0, 1, n).cumsum()
    rows = [(d, "A", float(x), float(x + 1), float(x - 1), float(x), float(x), float(v)) for d, x, v in zip(days(n), c, rng.integers(1, 99, n), strict=True)]
    rows[7] = (*rows[7][:3], None, *rows[7][4:])
    p = spark.createDataFrame(rows, "trade_date date, security_id string, adjusted_open double, adjusted_high double, adjusted_low double, adjusted_close double, vwap double, volume double")
    got = rolling.rolling_features(p, ["beta", "rsqr", "rank", "imax", "qtlu", "sump"], (5,)).orderBy("trade_date").collect()
    for i in (0, 3, 12, 24):
        w = c[max(0, i - 4) : i + 1]
        if len(w) > 1:
            slope = np.polyfit(np.arange(len(w)), w, 1)[0]
            assert got[i].beta5 == pytest.approx(slope / c[i])
        else:
            assert got[i].beta5 is None and got[i].rsqr5 is None
        assert got[i].rank5 == pytest.approx(((w < c[i]).sum() + 1) / len(w))
        assert got[i].qtlu5 == pytest.approx(np.quantile(w, 0.8) / c[i])
    assert got[9].imax5 == pytest.approx(3 / 5)  # the missing high is the first extreme of its frame


def test_catalog_describes_every_feature(spark):
    rows = catalog.catalog(spark).orderBy("position").collect()
    assert [r.name.lower() for r in rows] == rolling.feature_names() and [r.position for r in rows] == list(range(1, 159))
    by_name = {r.name: r for r in rows}
    assert by_name["QTLU30"].expression == "Quantile($close, 30, 0.8)/$close" and by_name["QTLU30"].window == 30
    assert (by_name["MIN5"].operator, by_name["LOW0"].operator) == ("LOW", "LOW_PRICE")
    assert by_name["RSV60"].required_inputs == "close,high,low" and by_name["KMID"].economic_interpretation == "intraday body return"
    assert not any("<d>" in x for r in rows for x in r if isinstance(x, str)) and all(x is not None for r in rows for x in r)
    counts = spark.createDataFrame([("roc5", 3), ("other", 1)], "column string, violations long")
    assert {r.column: (r.violations, r.operator) for r in catalog.described(counts).collect()} == {"roc5": (3, "ROC"), "other": (1, None)}


def test_factor_preparation_clips_and_imputes(spark):
    raw = spark.createDataFrame([(DAY, k, v) for k, v in zip("abcd", [1.0, 2.0, 3.0, 100.0], strict=True)] + [(DAY, "e", None)], "trade_date date, security_id string, raw_value double")
    got = {r.security_id: r for r in cross_section.prepare_factor(raw, "negative").collect()}
    assert got["e"].imputed and got["e"].winsorized_value == 2.5 and got["d"].winsorized_value == pytest.approx(2.5 + 5 * 1.4826 * 0.5)
    assert got["a"].directed_score == pytest.approx(-got["a"].zscore_value)
    flat = spark.createDataFrame([(DAY, k, 1.0) for k in "abc"], "trade_date date, security_id string, raw_value double")
    assert all(r.directed_score is None for r in cross_section.prepare_factor(flat, "positive").collect())


def test_labels_need_the_benchmark_dates(spark):
    opens = [(d, "1", 10.0 + k) for k, d in enumerate(days(8))] + [(d, "2", 20.0) for k, d in enumerate(days(8)) if k != 1]
    p = spark.createDataFrame(opens, "trade_date date, security_id string, adjusted_open double")
    b = spark.createDataFrame([(d, 100.0 + k) for k, d in enumerate(days(8))], "trade_date date, adjusted_open double")
    got = {(r.security_id, r.trade_date): r for r in labels.forward_labels(p, b, (1,)).collect()}
    assert got["1", DAY].label_excess_o2o_1d == pytest.approx((12 / 11 - 1) - (102 / 101 - 1))
    assert got["2", DAY].label_excess_o2o_1d is None and not got["2", DAY].basic_eligible
    assert got["1", days(8)[6]].label_excess_o2o_1d is None


def test_quantile_bins_follow_first_ranks(spark):
    p = spark.createDataFrame([(DAY, str(k), float(k), float(k)) for k in range(7)], "trade_date date, security_id string, s double, y double")
    got = {r.quintile: r for r in cross_section.quintiles(p, "s", "y", "trade_date").collect()}
    assert [got[k].n_names for k in range(1, 6)] == [2, 1, 1, 1, 2] and got[6].mean_return == pytest.approx(5.5 - 0.5)


def test_neutral_scores_are_regression_residuals(spark):
    rng = np.random.default_rng(2)
    size, score, ind = rng.uniform(1, 9, 12), rng.normal(size=12), [None if k % 3 == 0 else f"i{k % 3}" for k in range(12)]
    p = spark.createDataFrame([(DAY, str(k), float(a), b, float(c)) for k, (a, b, c) in enumerate(zip(size, ind, score, strict=True))], "trade_date date, security_id string, size double, industry string, score double")
    got = {r.security_id: r.neutral_score for r in cross_section.neutralize(p, "score").collect()}
    x = np.stack([np.log(size), *[np.array([v == g for v in ind], float) for g in (None, "i1", "i2")]], 1)
    rest = score - x @ np.linalg.lstsq(x, score, rcond=None)[0]
    assert [got[str(k)] for k in range(12)] == pytest.approx(list(rest))


def test_mean_test_against_numpy(spark):
    v = np.random.default_rng(3).normal(0.1, 1, 30)
    s = spark.createDataFrame([(d, "x", float(a)) for d, a in zip(days(30), v, strict=True)], "trade_date date, g string, v double")
    r = evidence.mean_test(s, "v", ["g"], "trade_date", 4).first()
    e = v - v.mean()
    lrv = e @ e / 30 + 2 * sum((1 - k / 5) * (e[k:] @ e[:-k]) / 30 for k in range(1, 5))
    assert r.se == pytest.approx(math.sqrt(lrv / 30)) and r.t_stat == pytest.approx(v.mean() / math.sqrt(lrv / 30))


def book(spark, returns):
    rows = [(d, str(k), float(k), r, True, d, d) for d, rs in zip(days(len(returns)), returns, strict=True) for k, r in enumerate(rs)]
    return spark.createDataFrame(rows, "trade_date date, security_id string, directed_score double, label_excess_o2o_1d double, tradable_next_open boolean, entry_date date, label_end_date_1d date")


def test_portfolio_turnover_and_halted_nav(spark):
    p = book(spark, [[0.1, 0.2], [0.1, None], [0.1, 0.2]])
    got = {(r.portfolio, r.trade_date): r for r in portfolio.simulate(p, 1, 1, 2, 10.0)[0].collect()}
    assert got["top_1", DAY].turnover == 0.5 and got["top_1", days(2)[1]].turnover == 0
    assert got["top_1", DAY].net_nav == pytest.approx(1 + 0.2 - 0.5 * 0.001)
    assert got["top_1", days(2)[1]].net_nav is None and got["top_1", days(3)[2]].net_nav is None and got["top_1", days(3)[2]].net_return == pytest.approx(0.2)
    assert got["Q1", days(3)[2]].gross_nav == pytest.approx(1.1**3)
    assert got["top_bottom", DAY].gross_return == pytest.approx(0.1) and got["top_bottom", DAY].turnover == 1.0


def test_active_metrics_by_cost_and_year(spark):
    table = portfolio.simulate(book(spark, [[0.1, 0.2], [0.1, None], [0.1, 0.3]]), 1, 1, 2, 10.0)[0].withColumn("trade_date", F.when(F.col("trade_date") == days(3)[2], dt.date(2025, 1, 1)).otherwise(F.col("trade_date")))
    got = {(r.cost_bps, r.year): r for r in portfolio.active_metrics(table, 1).where("portfolio = 'top_1'").collect()}
    assert set(got) == {(c, y) for c in (0.0, 10.0, 20.0) for y in (None, 2024, 2025)}
    r = np.array([0.2 - 0.5 * 0.002, 0.3])  # the second date cannot be evaluated; the name held does not change
    assert got[20.0, None].n_periods == 2 and got[20.0, None].annualized_excess_return == pytest.approx(r.mean() * 252)
    assert got[20.0, None].information_ratio == pytest.approx(r.mean() / r.std(ddof=1) * math.sqrt(252)) and got[20.0, 2024].information_ratio is None
    assert got[20.0, None].compounded_return == pytest.approx(1.199 * 1.3 - 1) and got[10.0, 2024].trading_cost == pytest.approx(0.0005) and got[0.0, 2025].compounded_return == pytest.approx(0.3)
    with pytest.raises(contracts.ContractError):
        portfolio.active_metrics(table, 1, (-1.0,))


def test_too_few_names_leave_a_placeholder(spark):
    table, summary = portfolio.simulate(book(spark, [[0.1]]), 1, 2, 2, 10.0)
    assert {(r.portfolio, r.n_names, r.is_evaluable, r.turnover) for r in table.collect()} == {(x, 0, False, 0.0) for x in ("Q1", "Q2", "top_2", "top_bottom")}
    assert all(r.annualized_return is None for r in summary.collect())


def test_ledger_sells_first_and_scales_buys(spark):
    got = {r.code: r for r in portfolio.rebalance_ledger(
        spark.createDataFrame([("a", "x", 10.0)], "account string, code string, shares double"), spark.createDataFrame([("a", "y", 1.0), ("a", "z", 0.0)], "account string, code string, weight double"),
        spark.createDataFrame([("a", 0.0, 100.0)], "account string, cash double, nav double"), spark.createDataFrame([("x", 10.0), ("y", 5.0)], "code string, price double"),
        spark.createDataFrame([("x", False, False, False, False), ("y", False, False, False, False)], "code string, suspended boolean, limit_up boolean, limit_down boolean, unknown_blocked boolean"), 10.0,
    ).collect()}
    assert got["x"].filled_notional == 100 and got["y"].filled_notional == pytest.approx(99.9 / 1.001) and got["y"].cash_after == pytest.approx(0, abs=1e-9)


def one_step(shares, cash, weights, opens, states, nav, rate):
    """Ledger rows by code and cash after, a loop over names."""
    reason = lambda c, side: "missing_open_price" if not opens.get(c) else "unknown_blocked" if c not in states else "suspended" if states[c][0] else "limit_up" if side == "buy" and states[c][1] else "limit_down" if side == "sell" and states[c][2] else None
    out, buys = {}, {}
    for c in sorted({*shares, *weights}):
        p = opens.get(c) or 0.0
        gap = (weights.get(c, 0.0) * nav / p if p else 0.0) - shares.get(c, 0.0)
        if gap < -1e-12:
            filled = 0.0 if reason(c, "sell") else -gap * p
            out[c, "sell"] = ("sell", -gap * p, filled, reason(c, "sell"))
            cash += filled * (1 - rate)
        if c in weights and (not p or gap > 1e-12):
            out[c, "buy"] = ("buy", max(gap, 0.0) * p, 0.0, reason(c, "buy"))
            if not out[c, "buy"][3]:
                buys[c] = gap * p
    need = sum(buys.values()) * (1 + rate)
    scale = min(1.0, cash / need) if need else 0.0
    for c, x in buys.items():
        out[c, "buy"] = ("buy", x, x * scale, None)
        cash -= x * scale * (1 + rate)
    return out, max(cash, 0.0)


def test_ledger_blocks_by_fixed_reasons_and_refuses_bad_accounts(spark):
    holdings = spark.createDataFrame([("a", c, 2.0) for c in "pqrs"] + [("a", "both", 3.0)], "account string, code string, shares double")
    targets = spark.createDataFrame([("a", c, 0.1) for c in ("u", "v", "w", "both")], "account string, code string, weight double")
    accounts = spark.createDataFrame([("a", 5.0, 100.0)], "account string, cash double, nav double")
    prices = spark.createDataFrame([("p", 1.0), ("q", 1.0), ("r", 1.0), ("s", float("nan")), ("u", 1.0), ("v", 1.0), ("w", float("inf"))], "code string, price double")
    flags = "code string, suspended boolean, limit_up boolean, limit_down boolean, unknown_blocked boolean"
    state = spark.createDataFrame([("p", True, True, True, False), ("q", None, True, True, False), ("r", False, False, False, None), ("s", True, True, True, True), ("u", False, True, False, False), ("w", False, False, False, False), ("both", False, False, False, False)], flags)
    got = {(r.code, r.side): (r.block_reason, r.intended_notional, r.filled_notional) for r in portfolio.rebalance_ledger(holdings, targets, accounts, prices, state, 10.0).collect()}
    assert got == {
        ("p", "sell"): ("suspended", 2.0, 0.0), ("q", "sell"): ("limit_down", 2.0, 0.0), ("r", "sell"): ("unknown_blocked", 2.0, 0.0), ("s", "sell"): ("missing_open_price", 0.0, 0.0),
        ("u", "buy"): ("limit_up", 10.0, 0.0), ("v", "buy"): ("unknown_blocked", 10.0, 0.0), ("w", "buy"): ("missing_open_price", 0.0, 0.0),
        ("both", "sell"): ("missing_open_price", 0.0, 0.0), ("both", "buy"): ("missing_open_price", 0.0, 0.0),
    }
    money = lambda cash, nav: spark.createDataFrame([("a", 1.0, 1.0), ("b", cash, nav)], "account string, cash double, nav double")
    for bad in (money(-0.1, 5.0), money(0.0, 0.0), money(1.0, -3.0), money(None, 5.0), money(1.0, float("nan"))):
        with pytest.raises(contracts.ContractError, match="cash below 0"):
            portfolio.rebalance_ledger(holdings, targets, bad, prices, state, 10.0)
    for bps in (-1.0, float("nan"), float("inf")):
        with pytest.raises(contracts.ContractError, match="costs"):
            portfolio.rebalance_ledger(holdings, targets, accounts, prices, state, bps)
    with pytest.raises(contracts.ContractError, match="borrowing"):
        portfolio.rebalance_ledger(holdings, targets.withColumn("weight", F.lit(0.3)), accounts, prices, state, 10.0)
    portfolio.checked_accounts(targets.withColumn("weight", F.lit(0.25)), money(-1e-10, 1.0), 0.0, ["account"])


def test_ledger_batch_has_every_account_and_date(spark):
    from tidepanel.plans import registry

    small, got = "/root/testdata/sf0.01", {}
    for r in registry.QUERIES["w7_ledger_batch"](spark, small).collect():
        got.setdefault((r.account, r.trade_date), {})[r.code, r.side] = r
    daily = {(r.trade_date, r.security_id): r for r in registry.P(spark, small).collect()}
    known = {(r.trade_date, r.security_id): r for r in registry.research(spark, small).collect()}
    days = sorted({t for t, _ in daily})
    after = dict(zip(days, days[1:], strict=False))
    rows = registry.scored(spark, small).localCheckpoint()
    want, nav0 = {}, 1_000_000.0
    for h in registry.HORIZONS:
        steps = {}
        for r in portfolio.positions(rows, h, 10, 5).where("not is_diagnostic").collect():
            steps.setdefault((f"{r.portfolio}_{h}d", r.seq), (r.trade_date, {}))[1][r.security_id] = r.weight
        for (account, seq), (day, weights) in steps.items():
            if day not in after:
                continue
            bar = {c: daily.get((after[day], c)) for c in {c for t, c in daily if t == day or t == after[day]}}
            opens = {c: b.adjusted_open for c, b in bar.items() if b}
            states = {c: (not k.tradable_next_open, *((b.adjusted_high == b.adjusted_low and b.adjusted_open > k.adjusted_close, b.adjusted_high == b.adjusted_low and b.adjusted_open < k.adjusted_close) if (b := bar.get(c)) else (False, False))) for (t, c), k in known.items() if t == day}
            before, old = steps.get((account, seq - 1), (None, {}))
            paid = {c: daily[after[before], c].adjusted_open for c in old if (after[before], c) in daily}
            shares = {c: old[c] * nav0 / p for c, p in paid.items()}
            cash = max(0.0, nav0 - sum(shares[c] * paid[c] for c in shares))
            nav = cash + sum(n * opens.get(c, paid[c]) for c, n in shares.items())
            want[account, day] = one_step(shares, cash, weights, opens, states, nav, 0.001)
    assert len({day for _, day in got}) > 10 and {a for a, _ in got} == {a for a, _ in want} and len({a for a, _ in got}) > 6
    assert {x.block_reason for v in got.values() for x in v.values()} >= {None, "missing_open_price", "suspended", "unknown_blocked"}
    assert got.keys() == {k for k, (ledger, _) in want.items() if ledger}
    for key, step in got.items():
        ledger, cash = want[key]
        assert step.keys() == ledger.keys()
        for c, r in step.items():
            assert (r.side, r.block_reason) == (ledger[c][0], ledger[c][3])
            assert (r.intended_notional, r.filled_notional, r.cash_after) == pytest.approx((ledger[c][1], ledger[c][2], cash), rel=1e-6, abs=1e-3)


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.default_rng(4)
    x, y, w = rng.normal(size=(80, 2)), rng.normal(size=80), rng.uniform(0.5, 1.5, 80)
    rows = spark.createDataFrame([("f", float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(x, y, w, strict=True)], "fold string, a double, b double, y double, w double")
    got = {(r.alpha, r.feature): r.coefficient for r in models.ridge(rows, ["a", "b"], "y", "w", (1.0,)).collect()}
    xc, yc = x - (w @ x) / w.sum(), y - (w @ y) / w.sum()
    beta = np.linalg.solve(xc.T @ (xc * w[:, None]) + np.eye(2), xc.T @ (w * yc))
    assert [got[1.0, "a"], got[1.0, "b"]] == pytest.approx(list(beta))


def test_tree_track_searches_all_candidates_and_scores_test_rows_once(spark, small, monkeypatch):
    from tidepanel.operators import models, trees
    from tidepanel.plans import registry, tree_track

    monkeypatch.setattr(tree_track, "ROUNDS", 2)

    names = {f[0] for f in registry.FOLDS}
    found = registry.candidate_search(spark, small).collect()
    assert {(r.fold, r.candidate_id) for r in found} == {(f, k) for f in names for k in range(16)} and len(found) == 64
    assert len({(r.num_leaves, r.learning_rate, r.min_data_in_leaf, r.lambda_l2) for r in found}) == 16
    chosen = {r.fold: r for r in found if r.chosen}
    assert set(chosen) == names
    for r in found:  # min_data 300 leaves a single leaf on so few rows, which has no rank IC
        best = chosen[r.fold]
        assert r.mean_rank_ic is None or (r.mean_rank_ic, r.rank_icir) <= (best.mean_rank_ic, best.rank_icir)
    n = len(tree_track._FITTED)
    scores = registry.chosen_test(spark, small).collect()
    assert len(tree_track._FITTED) == n  # fitted once
    keys = {(r.fold, r.signal_date, r.security_id) for r in scores}
    test = {tuple(r) for r in registry.assigned(spark, small).where("role = 'test'").select("fold", "signal_date", "security_id").collect()}
    assert len(scores) == len(keys) and keys == test
    assert all(r.score is not None and (r.candidate_id, r.best_iteration) == (chosen[r.fold].candidate_id, chosen[r.fold].best_iteration) for r in scores)
    shares = registry.split_counts(spark, small).collect()
    assert len(shares) == 4 * 158 and all((r.split_importance > 0) == (r.gain_importance > 0) for r in shares)
    tied = spark.createDataFrame([("a", 0, 1, 0.1), ("a", 0, 2, 0.3), ("a", 0, 3, 0.3), ("b", 0, 1, None), ("b", 0, 2, None)], "fold string, candidate_id int, iteration int, mean_rank_ic double")
    assert {(r.fold, r.best_iteration) for r in trees.best_rounds(tied).collect()} == {("a", 2), ("b", 2)}
    rows = spark.createDataFrame([("f", "train", "d1"), ("f", "train", "d1"), ("f", "train", "d2"), ("g", "train", "d1"), ("f", "test", "d1")], "fold string, role string, signal_date string")
    assert sorted(map(tuple, tree_track.date_weights(rows).collect())) == [("f", "test", "d1", 1.0), ("f", "train", "d1", 0.75), ("f", "train", "d1", 0.75), ("f", "train", "d2", 1.5), ("g", "train", "d1", 1.0)]
    assert set(models.TRANSFER) <= set(trees.DEFAULTS)


def test_contracts(spark):
    p = closes(spark, {"A": [1.0, 2.0], "B": [-1.0, 3.0]})
    with pytest.raises(contracts.ContractError):
        contracts.require_unique(p.union(p), ["trade_date", "security_id"])
    with pytest.raises(contracts.ContractError):
        contracts.not_positive(p, ["adjusted_close"], fail=True)
    with pytest.raises(contracts.ContractError):
        contracts.one_to_one(p, p.where("security_id = 'A'"), ["trade_date", "security_id"])
    assert contracts.unparsable_dates(spark.createDataFrame([("2024-01-01",), ("x",)], "d string"), "d").first().violations == 1


def test_write_once_and_append_only(spark, tmp_path):
    p = closes(spark, {"A": [1.0, 2.0]})
    sinks.write_stable(p, f"{tmp_path}/t", ["trade_date"])
    sinks.write_stable(p, f"{tmp_path}/t", ["trade_date"])
    with pytest.raises(contracts.ContractError):
        sinks.write_stable(p.limit(1), f"{tmp_path}/t", ["trade_date"])
    run = spark.createDataFrame([("F", "r1")], "factor_id string, run_id string")
    sinks.append_run(run, f"{tmp_path}/s")
    with pytest.raises(contracts.ContractError):
        sinks.append_run(run, f"{tmp_path}/s")
    assert sinks.load_scoreboard(spark, f"{tmp_path}/none", run.schema).count() == 0
    sinks.write_bundle({"a": run}, str(tmp_path), "r1")
    assert spark.read.json(f"{tmp_path}/run_id=r1/manifest").first().artifacts == ["a"]


def test_rows_after_the_end_change_no_score(spark):
    p = closes(spark, {"A": [100 + i for i in range(12)]})
    changed = p.withColumn("adjusted_close", F.when(F.col("trade_date") > days(12)[8], 1.0).otherwise(F.col("adjusted_close")))
    end = str(days(12)[8])
    a, b = (factors.compute(factors.leak_free(x, end), "REV5").orderBy("trade_date").collect() for x in (p, changed))
    assert a == b


def test_stream_appends_each_key_once(spark, tmp_path):
    from tidepanel.streaming import ingest

    rows = spark.createDataFrame([(DAY, "A", 1.0, 1.0), (DAY, "A", 1.0, 1.0)], panel.DAILY)
    rows.write.parquet(f"{tmp_path}/in")
    ingest.append_daily(ingest.daily_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    timed = rows.withColumn("at", F.to_timestamp(F.lit("2024-01-01")))
    timed.write.parquet(f"{tmp_path}/timed")
    stream = ingest.daily_stream(spark, f"{tmp_path}/timed", timed.schema)
    ingest.append_daily(stream, f"{tmp_path}/out2", f"{tmp_path}/ck2", event_time="at").awaitTermination()
    assert [r.at is not None for r in spark.read.parquet(f"{tmp_path}/out2").collect()] == [True]


def test_both_forms_of_preprocessing_agree(spark):
    rng = np.random.default_rng(6)
    names = [f"f{k}" for k in range(30)]
    values = rng.normal(size=(40, 30)) * 10.0 ** rng.integers(-2, 3, 30)
    values[3], values[:20, 4], values[:, 7] = 1e6, np.nan, 5.0
    values[rng.random((40, 30)) < 0.1] = np.nan
    values[0, 1] = np.inf
    rows = [(DAY if k < 20 else days(2)[1], str(k), *(None if np.isnan(x) else float(x) for x in v)) for k, v in enumerate(values)]
    p = spark.createDataFrame(rows, f"trade_date date, security_id string, {', '.join(f'{n} double' for n in names)}")
    wide = {r.security_id: r for r in cross_section.preprocess(p, names).collect()}
    for part in (names[:15], names[15:]):
        for r in cross_section.preprocess(p, part).collect():
            assert [wide[r.security_id][n] for n in part] == pytest.approx([r[n] for n in part], abs=1e-9)
    assert all(wide[str(k)].f4 == 0 for k in range(20))


def test_plans_read_their_input_once(spark):
    p = book(spark, [[0.1, 0.2]]).withColumn("raw_value", F.col("directed_score"))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans(p) == 1
    for df in (
        cross_section.preprocess(p, ["raw_value"]), cross_section.quality(p, ["raw_value"]), cross_section.prepare_factor(p.select("trade_date", "security_id", "raw_value"), "positive"),
        cross_section.quintiles(p, "directed_score", "label_excess_o2o_1d", "trade_date"), cross_section.rank_ic(p, "directed_score", "label_excess_o2o_1d", "trade_date"),
        evidence.mean_test(p, "raw_value", ["security_id"], "trade_date", 3), portfolio.turnovers(p.select(F.lit(1).alias("seq"), F.lit("a").alias("portfolio"), "security_id", F.lit(1.0).alias("weight"))),
    ):
        assert scans(df) == 1


def test_refusals(spark):
    p = book(spark, [[0.1, 0.2]])
    bad = lambda f, *a, **k: pytest.raises(contracts.ContractError, f, *a, **k)
    for h in ((), (1, 1), (0,), (True,)):
        bad(contracts.valid_horizons, h)
    for args in ((1, 0, 5, 10.0), (1, 5, 1, 10.0), (1, 5, 5, -1.0), (1, 5, 5, float("nan"))):
        bad(contracts.valid_portfolio, *args)
    bad(portfolio.net_return, F.lit(0.1), F.lit(0.5), float("inf"))
    bad(cross_section.zscore_label, p.withColumn("y", F.lit(1.0)), "y", "trade_date", fail=True)
    bad(cross_section.neutralize, p.withColumn("size", F.lit(0.0)).withColumn("industry", F.lit("a")), "directed_score", fail=True)
    bad(cross_section.common_predictions, p, p.withColumn("label_excess_o2o_1d", F.lit(9.0)), ["trade_date", "security_id"], ["directed_score"], "label_excess_o2o_1d")
    raw = spark.createDataFrame([("2024-01-01", "A", "1.5"), ("2024-01-02", "A", "x")], "trade_date string, security_id string, n string")
    assert [(str(r.trade_date), r.n) for r in contracts.portfolio_panel(raw, ["n"], []).orderBy("trade_date").collect()] == [("2024-01-01", 1.5), ("2024-01-02", None)]
    bad(contracts.portfolio_panel, raw.union(raw), ["n"], [])
    bad(contracts.portfolio_panel, raw.union(spark.createDataFrame([("soon", "B", "1")], raw.schema)), ["n"], [])
    bad(contracts.portfolio_panel, raw.union(spark.createDataFrame([("2024-01-01", None, "1")], raw.schema)), ["n"], [])
    ids = spark.createDataFrame([("REV5",), ("../x",), (None,), ("a b",), ("_a",), ("a-b_1",)], "id string")
    assert {r.id for r in contracts.unsafe_ids(ids, "id").collect()} == {"../x", None, "a b", "_a"}


def test_decision_and_p_value(spark):
    rows = [(dt.date(2000 + k % 5, 1 + k // 5 % 12, 1 + k // 60), kind, 1, 0.1 + 0.01 * ((k * 7) % 11)) for k in range(600) for kind in ("basic", "tradable")]
    daily = spark.createDataFrame(rows, "trade_date date, eligibility string, horizon_days int, rank_ic double")
    r = evidence.decide(daily, [2000, 2001, 2002, 2003, 2004]).first()
    v = np.array([x[3] for x in rows if x[1] == "basic"])
    t = v.mean() / (v.std() / math.sqrt(len(v)))
    assert r.decision == "Admit" and r.good_years == 5 and r.t_stat == pytest.approx(t) and r.p == pytest.approx(0.5 * math.erfc(t / math.sqrt(2)))
    assert evidence.decide(daily, [2000]).first().decision == "Reject"
    assert evidence.decide(daily.withColumn("rank_ic", F.lit(0.0)), [2000, 2001, 2002, 2003, 2004]).first().decision == "Review"


def test_candidates(spark):
    grid = models.candidate_grid(spark, {"num_leaves": [31, 63], "learning_rate": [0.1, 0.2]})
    assert sorted((r.candidate_id, r.num_leaves, r.learning_rate) for r in grid.collect()) == [(0, 31, 0.1), (1, 31, 0.2), (2, 63, 0.1), (3, 63, 0.2)]
    base = {"fold": "f", "candidate_id": 5, "mean_rank_ic": 0.1, "rank_icir": 0.5, "num_leaves": 31, "min_data_in_leaf": 50, "lambda_l2": 1.0, "learning_rate": 0.1}
    for better in ({"mean_rank_ic": 0.2}, {"rank_icir": 0.6}, {"num_leaves": 15}, {"min_data_in_leaf": 90}, {"lambda_l2": 2.0}, {"learning_rate": 0.2}, {"candidate_id": 1}):
        pair = spark.createDataFrame([base, {**base, "candidate_id": 9, **better}])
        best = models.best_tree_candidates(pair).first()
        assert all(best[k] == v for k, v in better.items())
    ties = spark.createDataFrame([("f", 1.0, 0.1, 0.5), ("f", 10.0, 0.1, 0.5), ("f", 0.1, 0.1, 0.4), ("g", 1.0, 0.2, 0.1)], "fold string, alpha double, mean_rank_ic double, rank_icir double")
    assert {(r.fold, r.alpha) for r in evidence.best_candidates(ties).collect()} == {("f", 10.0), ("g", 1.0)}
    bad = spark.createDataFrame([("f", 1.0, 1.0, 0.0)], "fold string, a double, y double, w double")
    with pytest.raises(contracts.ContractError):
        models.ridge(bad, ["a"], "y", "w")


def test_thin_dates_fold_coverage_and_exact_dates(spark):
    rows = [("d1", f"s{i}", float(i), 0.1) for i in range(6)] + [("d2", f"s{i}", float(i), 0.1) for i in range(4)] + [("d3", f"s{i}", 1.0, 0.1) for i in range(9)] + [("d4", "s", None, 1.0)]
    table = spark.createDataFrame(rows, "trade_date string, security_id string, score double, y double")
    assert {r.trade_date for r in cross_section.quintiles(table, "score", "y", "trade_date").collect()} == {"d1"}
    assert cross_section.quintiles(table.where("trade_date = 'd1'"), "score", "y", "trade_date", fail=True).count() == 6
    for day in ("d2", "d3", "d4"):
        with pytest.raises(contracts.ContractError, match=day):
            cross_section.quintiles(table.where(f"trade_date in ('d1', '{day}')"), "score", "y", "trade_date", fail=True)
    day = lambda y, m: dt.date(y, m, 1)
    kind = "fold string, role string, signal_date date, security_id string"
    good = [("a", "test", day(2001, m), "s") for m in (1, 2)] + [("b", "test", day(2002, m), "s") for m in (1, 2)] + [("a", "train", day(2000, 1), "s")]
    expected = spark.createDataFrame([("a", 2001), ("b", 2002)], "fold string, year int")
    contracts.require_coverage(spark.createDataFrame(good, kind), expected, 2)
    for bad, n in ((good + [("a", "test", day(2002, 1), "s")], None), (good[:2], None), (good, 3), (good + [("b", "test", day(2002, 1), "s")], None)):
        with pytest.raises(contracts.ContractError):
            contracts.require_coverage(spark.createDataFrame(bad, kind), expected, n)
    series = spark.createDataFrame(good[:4] + [("b", "test", day(2002, 2), "s")], kind)
    assert [r.fold for r in contracts.exactly_dates(series, ["fold"], 2).collect()] == ["b"]


def test_quality_of_a_date(spark):
    x = [1.0, 2.0, 3.0, 4.0, 100.0, None, float("inf")]
    table = spark.createDataFrame([("d", v) for v in x] + [("e", None)] * 2 + [("f", 2.0)] * 3, "trade_date string, x double")
    got = {r.trade_date: r for r in cross_section.quality(table, ["x"]).collect()}
    filled = np.array([1, 2, 3, 4, 100, 3, 3.0])
    scale = 1.4826 * np.median(np.abs(filled - 3))
    held = np.clip(filled, 3 - 5 * scale, 3 + 5 * scale)
    d = got["d"]
    assert (d.n_rows, d.finite_before, d.missing_before, d.infinite_before, d.clipped_count, d.finite_after, d.zero_variance, d.all_null) == (7, 5, 2, 1, 1, 7, False, False)
    assert [d.median, d.robust_scale, d.winsor_lower, d.winsor_upper] == pytest.approx([3, scale, 3 - 5 * scale, 3 + 5 * scale])
    assert (d.post_mean, d.post_std) == pytest.approx((0, 1), abs=1e-9) and held.max() < 100
    assert (got["e"].all_null, got["e"].zero_variance, got["e"].median, got["e"].winsor_lower, got["e"].post_mean, got["e"].post_std, got["e"].finite_after) == (True, True, None, None, 0, 0, 2)
    assert (got["f"].zero_variance, got["f"].clipped_count, got["f"].post_std, got["f"].robust_scale) == (True, 0, 0, 0)


def test_small_contracts(spark, tmp_path):
    folds = spark.createDataFrame([("a", [1, 2, 3, 4, 5], 6, 7), ("b", [1, 2, 3, 4, 6], 6, 7)], "fold string, train array<int>, validation int, test int")
    assert {r.fold: r.chronological for r in contracts.chronological(folds).collect()} == {"a": True, "b": False}
    flags = spark.createDataFrame([(True,), (None,)], "ok boolean")
    assert not contracts.all_true(flags, "ok") and contracts.all_true(flags.where("ok"), "ok")
    assert {r.contract: r.violations for r in contracts.violations({"known": F.col("ok").isNotNull()}, flags).collect()} == {"known": 1}
    summary = spark.createDataFrame([(1, "t", "gross", 0.5), (1, "t", "net", 0.6), (5, "t", "gross", 0.5), (5, "t", "net", 0.5)], "horizon_days int, portfolio string, return_type string, mean_turnover double")
    assert [r.horizon_days for r in contracts.same_turnover(summary).collect()] == [1]
    manifest = spark.createDataFrame([("r1", ["a", "b"]), ("r2", ["a", "b"])], "run_id string, artifacts array<string>")
    found = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "a")], "run_id string, artifact string")
    assert [r.run_id for r in contracts.artifacts_complete(manifest, ["a", "b"], found).collect()] == ["r2"]
    runs = spark.createDataFrame([("F", "r1", "formal", 1), ("F", "r2", "formal", 1), ("F", "r3", "experimental", 9)], "factor_id string, run_id string, run_type string, created_at int")
    assert [r.run_id for r in evidence.latest_runs(runs).collect()] == ["r2"]
    sinks.write_json_stable(runs.limit(1), f"{tmp_path}/j")
    sinks.write_json_stable(runs.limit(1), f"{tmp_path}/j")
    with pytest.raises(contracts.ContractError):
        sinks.write_json_stable(runs.where("run_id = 'r3'"), f"{tmp_path}/j")
    runs.coalesce(1).write.csv(f"{tmp_path}/c", header=True)
    assert panel.scan_csv(spark, f"{tmp_path}/c", "factor_id string, run_id string, run_type string, created_at int").count() == 3
    assert panel.scan_summaries(spark, f"{tmp_path}/j", "run_id string").where("run_id is not null and file is not null").count() == 1
    assert all(len(r.sha256) == 64 for r in panel.file_digests(spark, f"{tmp_path}/c").collect())
    runs.withColumn("year", F.lit(2024)).write.partitionBy("year").parquet(f"{tmp_path}/y")
    assert panel.scan(spark, f"{tmp_path}/y").where("year = 2023").count() == 0

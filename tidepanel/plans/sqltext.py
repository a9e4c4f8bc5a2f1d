"""DuckDB twins of the registered queries, written apart from the Spark code they check."""

from __future__ import annotations

import re

WINDOWS = (5, 10, 20, 30, 60)
S = "(PARTITION BY security_id ORDER BY trade_date)"

P = """
r AS (
  SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, l_extendedprice / l_quantity AS unit, l_quantity, l_extendedprice, l_returnflag,
    row_number() OVER (PARTITION BY l_suppkey, date_trunc('month', l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS rf,
    row_number() OVER (PARTITION BY l_suppkey, date_trunc('month', l_shipdate) ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_quantity DESC) AS rl
  FROM lineitem),
p AS (
  SELECT trade_date, l_suppkey AS security_id, max(CASE WHEN rf = 1 THEN unit END) AS adjusted_open, max(unit) AS adjusted_high, min(unit) AS adjusted_low,
    max(CASE WHEN rl = 1 THEN unit END) AS adjusted_close, sum(l_extendedprice) / sum(l_quantity) AS vwap, sum(l_quantity) AS volume, sum(l_extendedprice) AS traded_amount,
    CAST(count(*) AS DOUBLE) AS turnover, sum(l_quantity) >= 60 AS is_member, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) <= 3 AS tradable_next_open
  FROM r GROUP BY trade_date, l_suppkey)"""
B = P + """,
b AS (SELECT trade_date, avg(adjusted_open) AS adjusted_open, avg(adjusted_close) AS adjusted_close FROM p GROUP BY trade_date)"""
RP = B + """,
rp AS (SELECT * EXCLUDE (is_member), true AS basic_eligible FROM p WHERE is_member),
mk AS (SELECT trade_date, adjusted_close / lag(adjusted_close) OVER (ORDER BY trade_date) - 1 AS market_return FROM b),
mp AS (SELECT rp.*, market_return, adjusted_close / lag(adjusted_close) OVER (PARTITION BY security_id ORDER BY rp.trade_date) - 1 AS ret FROM rp LEFT JOIN mk USING (trade_date))"""


def labels(horizons: tuple[int, ...] = (1, 5, 20)) -> str:
    own = ", ".join(f"lead(trade_date, {h + 1}) OVER {S} AS d{h}, lead(adjusted_open, {h + 1}) OVER {S} AS x{h}" for h in horizons)
    mk = ", ".join(f"lead(trade_date, {h + 1}) OVER (ORDER BY trade_date) AS bd{h}, lead(adjusted_open, {h + 1}) OVER (ORDER BY trade_date) AS bx{h}" for h in horizons)
    ok = {h: f"coalesce(e > 0 AND x{h} > 0 AND be > 0 AND bx{h} > 0 AND ed = bed AND d{h} = bd{h}, false)" for h in horizons}
    out = ", ".join(f"d{h} AS label_end_date_{h}d, CASE WHEN {ok[h]} THEN (x{h} / e - 1) - (bx{h} / be - 1) END AS label_excess_o2o_{h}d" for h in horizons)
    return f""",
lo AS (SELECT *, lead(trade_date) OVER {S} AS ed, lead(adjusted_open) OVER {S} AS e, {own} FROM rp),
lb AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS bed, lead(adjusted_open) OVER (ORDER BY trade_date) AS be, {mk} FROM b),
lab AS (SELECT lo.trade_date, security_id, tradable_next_open, basic_eligible AND {ok[horizons[0]]} AS basic_eligible, ed AS entry_date, {out} FROM lo LEFT JOIN lb USING (trade_date))"""


PREP = """,
pm AS (SELECT trade_date, median(raw_value) AS m, count(raw_value) AS n FROM raw GROUP BY trade_date),
px AS (SELECT raw.*, m, n, coalesce(raw_value, m) AS x FROM raw JOIN pm USING (trade_date)),
pd AS (SELECT trade_date, median(abs(x - m)) AS s FROM px GROUP BY trade_date),
pw AS (SELECT px.*, CASE WHEN n >= 2 THEN greatest(m - 5 * 1.4826 * s, least(m + 5 * 1.4826 * s, x)) END AS w FROM px JOIN pd USING (trade_date)),
ps AS (SELECT trade_date, avg(w) AS a, stddev_pop(w) AS d FROM pw GROUP BY trade_date),
prep AS (SELECT trade_date, security_id, raw_value, w AS winsorized_value, CASE WHEN d > 0 THEN (w - a) / d END AS zscore_value, raw_value IS NULL AS imputed FROM pw JOIN ps USING (trade_date))"""
REV5_RAW = f""",
raw AS (SELECT trade_date, security_id, adjusted_close / lag(adjusted_close, 5) OVER {S} - 1 AS raw_value FROM rp)"""
EVAL = RP + labels() + REV5_RAW + PREP + """,
ev AS (SELECT lab.*, -zscore_value AS directed_score FROM lab LEFT JOIN prep USING (trade_date, security_id))"""
IC = EVAL + """,
lg AS (
  SELECT trade_date, directed_score, 'basic' AS eligibility, basic_eligible AS ok, 1 AS horizon_days, label_excess_o2o_1d AS label FROM ev
  UNION ALL SELECT trade_date, directed_score, 'basic', basic_eligible, 5, label_excess_o2o_5d FROM ev
  UNION ALL SELECT trade_date, directed_score, 'basic', basic_eligible, 20, label_excess_o2o_20d FROM ev
  UNION ALL SELECT trade_date, directed_score, 'tradable', basic_eligible AND tradable_next_open, 1, label_excess_o2o_1d FROM ev
  UNION ALL SELECT trade_date, directed_score, 'tradable', basic_eligible AND tradable_next_open, 5, label_excess_o2o_5d FROM ev
  UNION ALL SELECT trade_date, directed_score, 'tradable', basic_eligible AND tradable_next_open, 20, label_excess_o2o_20d FROM ev),
rk AS (
  SELECT *, rank() OVER (PARTITION BY trade_date, eligibility, horizon_days ORDER BY directed_score) + (count(*) OVER (PARTITION BY trade_date, eligibility, horizon_days, directed_score) - 1) / 2.0 AS x,
    rank() OVER (PARTITION BY trade_date, eligibility, horizon_days ORDER BY label) + (count(*) OVER (PARTITION BY trade_date, eligibility, horizon_days, label) - 1) / 2.0 AS y
  FROM lg WHERE ok AND directed_score IS NOT NULL AND label IS NOT NULL),
ii AS (
  SELECT trade_date, eligibility, horizon_days, count(*) AS n,
    CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN covar_pop(directed_score, label) / nullif(stddev_pop(directed_score) * stddev_pop(label), 0) END AS pearson_ic,
    CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END AS rank_ic
  FROM rk GROUP BY ALL),
ic AS (SELECT g.*, pearson_ic, rank_ic, coalesce(n, 0) AS n_names FROM (SELECT DISTINCT trade_date, eligibility, horizon_days FROM lg) g LEFT JOIN ii USING (trade_date, eligibility, horizon_days))"""
HALVES = ", ".join(f"avg({c}_ic) AS mean_{c}_ic, stddev_samp({c}_ic) AS {c}_ic_std, avg({c}_ic) / nullif(stddev_samp({c}_ic), 0) AS {c}_icir, avg(CASE WHEN {c}_ic > 0 THEN 1.0 WHEN {c}_ic IS NOT NULL THEN 0 END) AS positive_{c}_ic_ratio, sum({c}_ic) AS cumulative_{c}_ic" for c in ("pearson", "rank"))
HALF_NAMES = [n for c in ("pearson", "rank") for n in (f"mean_{c}_ic", f"{c}_ic_std", f"{c}_icir", f"positive_{c}_ic_ratio", f"cumulative_{c}_ic")]


def mean_test(source: str, value: str, by: str, lag: str, date: str = "trade_date", unbiased: bool = False) -> str:
    """CTEs ending in ``ht(by, n, mean, se, t_stat)``."""
    divisor = "n - k" if unbiased else "n"
    t = "mean / nullif(se, 0)" if unbiased else "CASE WHEN se = 0 THEN CASE WHEN mean > 0 THEN 'inf'::DOUBLE WHEN mean < 0 THEN '-inf'::DOUBLE END ELSE mean / se END"
    return f""",
h1 AS (SELECT {by}, {value} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {date}) AS rn, count(*) OVER (PARTITION BY {by}) AS n, avg({value}) OVER (PARTITION BY {by}) AS mean, least({lag}, count(*) OVER (PARTITION BY {by}) - 1) AS lg FROM {source} WHERE {value} IS NOT NULL),
h2 AS (SELECT {by}, a.n, a.mean, a.lg, CAST(a.rn - z.rn AS BIGINT) AS k, (a.v - a.mean) * (z.v - z.mean) AS pr FROM h1 a JOIN h1 z USING ({by}) WHERE a.rn - z.rn BETWEEN 0 AND a.lg),
h3 AS (SELECT {by}, n, mean, k, sum(pr) / ({divisor}) * CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / (lg + 1.0)) END AS g FROM h2 GROUP BY {by}, n, mean, k, lg),
h4 AS (SELECT {by}, n, mean, sqrt(greatest(sum(g), 0) / n) AS se FROM h3 GROUP BY {by}, n, mean),
ht AS (SELECT *, {t} AS t_stat FROM h4)"""


def rounded(body: str, final: str, doubles: list[str], digits: int = 6) -> str:
    over = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles)
    return f"WITH {body.lstrip().lstrip(',')}, final AS ({final}) SELECT * REPLACE ({over}) FROM final"


Q = P + f""",
q AS (
  SELECT trade_date, security_id, adjusted_open AS o, adjusted_high AS h, adjusted_low AS l, adjusted_close AS c, CAST(volume AS DOUBLE) AS v, vwap,
    row_number() OVER {S} AS rn, ln(volume + 1) AS lv, adjusted_close / lag(adjusted_close) OVER {S} AS cr, ln(volume / nullif(lag(volume) OVER {S}, 0) + 1) AS vr,
    adjusted_close - lag(adjusted_close) OVER {S} AS dc, CAST(volume - lag(volume) OVER {S} AS DOUBLE) AS dv, abs(adjusted_close / lag(adjusted_close) OVER {S} - 1) * volume AS wv,
    CASE WHEN adjusted_close > lag(adjusted_close) OVER {S} THEN 1.0 ELSE 0.0 END AS up, CASE WHEN adjusted_close < lag(adjusted_close) OVER {S} THEN 1.0 ELSE 0.0 END AS down
  FROM p)"""


def family(name: str, d: int) -> str:
    w = f"OVER (PARTITION BY security_id ORDER BY trade_date ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"
    enough = f"count(c) {w} >= 2"
    corr = lambda x, y: f"covar_pop({x}, {y}) {w} / nullif(stddev_pop({x}) {w} * stddev_pop({y}) {w}, 0)"
    gain = lambda x, s: f"sum(CASE WHEN {x} IS NOT NULL THEN greatest({s}{x}, 0) END) {w}"
    all_ = lambda x: f"(sum(abs({x})) {w} + 1e-12)"
    top, low = f"CAST(list_position(list(h) {w}, max(h) {w}) AS DOUBLE) / {d}", f"CAST(list_position(list(l) {w}, min(l) {w}) AS DOUBLE) / {d}"
    forms = {
        "roc": f"lag(c, {d}) OVER {S} / c", "ma": f"avg(c) {w} / c", "std": f"stddev_samp(c) {w} / c",
        "beta": f"CASE WHEN {enough} THEN regr_slope(c, rn) {w} END / c",
        "rsqr": f"CASE WHEN {enough} AND stddev_samp(c) {w} > 2e-5 THEN regr_r2(c, rn) {w} END",
        "resi": f"CASE WHEN {enough} THEN c - (regr_intercept(c, rn) {w} + regr_slope(c, rn) {w} * rn) END / c",
        "max": f"max(h) {w} / c", "min": f"min(l) {w} / c", "qtlu": f"quantile_cont(c, 0.8) {w} / c", "qtld": f"quantile_cont(c, 0.2) {w} / c",
        "rank": f"list_sum([CASE WHEN x < c THEN 1.0 WHEN x = c THEN 0.5 ELSE 0.0 END FOR x IN list(c) {w}])",
        "rsv": f"(c - min(l) {w}) / (max(h) {w} - min(l) {w} + 1e-12)", "imax": top, "imin": low, "imxd": f"{top} - {low}",
        "corr": corr("c", "lv"), "cord": corr("cr", "vr"), "cntp": f"avg(up) {w}", "cntn": f"avg(down) {w}", "cntd": f"avg(up) {w} - avg(down) {w}",
        "sump": f"{gain('dc', '')} / {all_('dc')}", "sumn": f"{gain('dc', '-')} / {all_('dc')}", "sumd": f"({gain('dc', '')} - {gain('dc', '-')}) / {all_('dc')}",
        "vma": f"avg(v) {w} / (v + 1e-12)", "vstd": f"stddev_samp(v) {w} / (v + 1e-12)", "wvma": f"stddev_samp(wv) {w} / (avg(wv) {w} + 1e-12)",
        "vsump": f"{gain('dv', '')} / {all_('dv')}", "vsumn": f"{gain('dv', '-')} / {all_('dv')}", "vsumd": f"({gain('dv', '')} - {gain('dv', '-')}) / {all_('dv')}",
    }
    return forms[name]


def rolling(name: str) -> str:
    cols = [f"{name}{d}" for d in WINDOWS]
    if name == "rank":  # average rank over the count of the frame
        parts = ", ".join(f"list(c) OVER (PARTITION BY security_id ORDER BY trade_date ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW) AS a{d}" for d in WINDOWS)
        out = ", ".join(f"(len(list_filter(a{d}, lambda x: x < c)) + (len(list_filter(a{d}, lambda x: x = c)) + 1) / 2.0) / len(a{d}) AS rank{d}" for d in WINDOWS)
        return rounded(Q + f", ra AS (SELECT trade_date, security_id, c, {parts} FROM q)", f"SELECT trade_date, security_id, {out} FROM ra", cols)
    out = ", ".join(f"{family(name, d)} AS {name}{d}" for d in WINDOWS)
    return rounded(Q, f"SELECT trade_date, security_id, {out} FROM q", cols)


CANDLES = {
    "kmid": "(c - o) / o", "klen": "(h - l) / o", "kmid2": "(c - o) / (h - l + 1e-12)", "kup": "(h - greatest(o, c)) / o", "kup2": "(h - greatest(o, c)) / (h - l + 1e-12)",
    "klow": "(least(o, c) - l) / o", "klow2": "(least(o, c) - l) / (h - l + 1e-12)", "ksft": "(2 * c - h - l) / o", "ksft2": "(2 * c - h - l) / (h - l + 1e-12)",
    "open0": "o / c", "high0": "h / c", "low0": "l / c", "vwap0": "vwap / c",
}


def _w(d: int) -> str:
    return f"OVER (PARTITION BY security_id ORDER BY trade_date ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


_PAIR = "CASE WHEN ret IS NOT NULL AND market_return IS NOT NULL THEN {} END"
_X, _Y = _PAIR.format("market_return"), _PAIR.format("ret")
_BEFORE = "OVER (PARTITION BY security_id ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_LV = "CASE WHEN volume > 0 AND ret IS NOT NULL THEN ln(volume) END"
_LR = "CASE WHEN volume > 0 THEN ret END"
_ILL = "(abs(ret) / CASE WHEN traded_amount > 0 THEN traded_amount END)"
FACTORS = {
    "REV5": f"adjusted_close / lag(adjusted_close, 5) OVER {S} - 1",
    "MOM20": f"adjusted_close / lag(adjusted_close, 20) OVER {S} - 1",
    "MOM60": f"adjusted_close / lag(adjusted_close, 60) OVER {S} - 1",
    "VOL20": f"CASE WHEN count(ret) {_w(20)} = 20 THEN stddev_pop(ret) {_w(20)} END",
    "IDIOVOL20": f"CASE WHEN count({_X}) {_w(20)} = 20 AND var_pop({_X}) {_w(20)} > 0 THEN sqrt(greatest(var_pop({_Y}) {_w(20)} - covar_pop({_X}, {_Y}) {_w(20)} * covar_pop({_X}, {_Y}) {_w(20)} / nullif(var_pop({_X}) {_w(20)}, 0), 0)) END",
    "TURN20": f"CASE WHEN count(turnover) {_w(20)} = 20 THEN avg(turnover) {_w(20)} END",
    "VOLSURP20": f"CASE WHEN count(volume) {_BEFORE} = 20 AND avg(volume) {_BEFORE} > 0 THEN volume / avg(volume) {_BEFORE} END",
    "AMIHUD20": f"CASE WHEN count({_ILL}) {_w(20)} = 20 THEN avg({_ILL}) {_w(20)} END",
    "PV_CORR20": f"CASE WHEN count({_LV}) {_w(20)} = 20 THEN covar_pop({_LR}, {_LV}) {_w(20)} / nullif(stddev_pop({_LR}) {_w(20)} * stddev_pop({_LV}) {_w(20)}, 0) END",
    "CLOSE_POS5": f"CASE WHEN count(adjusted_high) {_w(5)} = 5 AND max(adjusted_high) {_w(5)} > min(adjusted_low) {_w(5)} THEN (adjusted_close - min(adjusted_low) {_w(5)}) / (max(adjusted_high) {_w(5)} - min(adjusted_low) {_w(5)}) END",
}


def factor_digits(name: str) -> int:
    """Decimals that are compared; values near 1e-6 need more."""
    return 14 if name == "AMIHUD20" else 6


def factor(name: str) -> str:
    return rounded(RP, f"SELECT trade_date, security_id, {FACTORS[name]} AS raw_value FROM mp", ["raw_value"], factor_digits(name))


def portfolios(h: int, k: int, q: int = 5, bps: float = 10.0) -> str:
    """CTEs ending in ``nav``: one row per rebalance date and portfolio."""
    return EVAL + f""",
el AS (SELECT * FROM ev WHERE directed_score IS NOT NULL AND tradable_next_open),
cal AS (SELECT *, CASE WHEN ne >= {max(k, q)} THEN sum(CASE WHEN ne >= {max(k, q)} THEN 1 ELSE 0 END) OVER (ORDER BY trade_date) END AS seq FROM (
  SELECT d.trade_date, coalesce(ne, 0) AS ne FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM ev)) d
  LEFT JOIN (SELECT trade_date, count(*) AS ne FROM el GROUP BY trade_date) n USING (trade_date) WHERE (i - 1) % {h} = 0)),
rnk AS (SELECT el.*, seq, ntile({q}) OVER (PARTITION BY trade_date ORDER BY directed_score, CAST(security_id AS VARCHAR)) AS bk,
  row_number() OVER (PARTITION BY trade_date ORDER BY directed_score DESC, CAST(security_id AS VARCHAR) DESC) AS tp FROM el JOIN cal USING (trade_date) WHERE seq IS NOT NULL),
hl AS (SELECT *, 'Q' || bk AS portfolio, 1.0 / count(*) OVER (PARTITION BY seq, bk) AS w FROM rnk
  UNION ALL SELECT *, 'top_{k}', 1.0 / {k} FROM rnk WHERE tp <= {k}
  UNION ALL SELECT *, 'top_bottom', CASE WHEN bk = {q} THEN 1.0 ELSE -1.0 END / count(*) OVER (PARTITION BY seq, bk) FROM rnk WHERE bk IN (1, {q})),
tv AS (SELECT seq, portfolio, 0.5 * sum(abs(dw)) AS turnover FROM (SELECT seq, portfolio, security_id, sum(dw) AS dw FROM (
  SELECT seq, portfolio, security_id, w AS dw FROM hl UNION ALL SELECT seq + 1, portfolio, security_id, -w FROM hl) GROUP BY ALL) GROUP BY ALL),
pr AS (SELECT trade_date, seq, portfolio, count(*) AS n_names, sum(w * label_excess_o2o_{h}d) AS g, CASE WHEN count(label_end_date_{h}d) = count(*) AND min(label_end_date_{h}d) = max(label_end_date_{h}d) THEN max(label_end_date_{h}d) END AS nav_date,
  count(label_excess_o2o_{h}d) = count(*) AND count(entry_date) = count(*) AND coalesce(min(entry_date) = max(entry_date), false) AND count(label_end_date_{h}d) = count(*) AND coalesce(min(label_end_date_{h}d) = max(label_end_date_{h}d), false) AS ok
  FROM hl GROUP BY ALL),
pt AS (SELECT cal.trade_date, k.portfolio, k.portfolio_kind, k.is_diagnostic, {h} AS horizon_days, nav_date, coalesce(n_names, 0) AS n_names, coalesce(ok, false) AS is_evaluable,
  CASE WHEN ok THEN g END AS gross_return, coalesce(turnover, 0) AS turnover, coalesce(turnover, 0) * {bps} / 10000 AS cost, CASE WHEN ok THEN g - coalesce(turnover, 0) * {bps} / 10000 END AS net_return
  FROM cal CROSS JOIN (SELECT 'Q' || i AS portfolio, 'quintile_long' AS portfolio_kind, false AS is_diagnostic FROM range(1, {q + 1}) t(i) UNION ALL SELECT 'top_{k}', 'top_k_long', false UNION ALL SELECT 'top_bottom', 'diagnostic_long_short', true) k
  LEFT JOIN pr ON pr.trade_date = cal.trade_date AND pr.portfolio = k.portfolio LEFT JOIN tv ON tv.seq = cal.seq AND tv.portfolio = k.portfolio),
nav AS (SELECT *, CASE WHEN NOT bool_or(NOT is_evaluable) OVER wn THEN product(1 + coalesce(gross_return, 0)) OVER wn END AS gross_nav,
  CASE WHEN NOT bool_or(NOT is_evaluable) OVER wn THEN product(1 + coalesce(net_return, 0)) OVER wn END AS net_nav
  FROM pt WINDOW wn AS (PARTITION BY portfolio ORDER BY trade_date ROWS UNBOUNDED PRECEDING))"""


NAV_DOUBLES = ["gross_return", "turnover", "cost", "net_return", "gross_nav", "net_nav"]
SUMMARY_DOUBLES = ["annualized_return", "volatility", "sharpe", "max_drawdown", "mean_turnover"]


def _summary_of(t: str, h: int, ppy: int) -> str:
    return f"""SELECT portfolio, portfolio_kind, is_diagnostic, '{t}' AS return_type, {h} AS horizon_days, count(*) AS n_periods, count(*) FILTER (is_evaluable) AS n_evaluable_periods,
  CASE WHEN arg_max_null(fin, trade_date) > 0 THEN pow(arg_max_null(fin, trade_date), {ppy}.0 / count(*)) - 1 END AS annualized_return, stddev_samp({t}_return) * sqrt({ppy}) AS volatility,
  avg({t}_return) / nullif(stddev_samp({t}_return), 0) * sqrt({ppy}) AS sharpe, least(0, min(dd)) AS max_drawdown, avg(turnover) AS mean_turnover
  FROM (SELECT *, {t}_nav AS fin, {t}_nav / greatest(1, max({t}_nav) OVER (PARTITION BY portfolio ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM nav) GROUP BY portfolio, portfolio_kind, is_diagnostic"""


def portfolio_summary(h: int, k: int, ppy: int) -> str:
    return rounded(portfolios(h, k), f"{_summary_of('gross', h, ppy)} UNION ALL {_summary_of('net', h, ppy)}", SUMMARY_DOUBLES)


def all_features(candles: list[str], families: list[str]) -> str:
    """All features in one select; rank from the lists of its frames."""
    cols = [*candles, *(f"{f}{d}" for f in families for d in WINDOWS)]
    return rounded(features(candles, families), f"SELECT trade_date, security_id, {', '.join(cols)} FROM af", cols)


def features(candles: list[str], families: list[str]) -> str:
    """CTEs ending in ``af``."""
    lists = ", ".join(f"list(c) {_w(d)} AS a{d}" for d in WINDOWS)
    rank = lambda d: f"(len(list_filter(a{d}, lambda x: x < c)) + (len(list_filter(a{d}, lambda x: x = c)) + 1) / 2.0) / len(a{d})"
    made = [f"{CANDLES[n]} AS {n}" for n in candles] + [f"{family(f, d)} AS {f}{d}" for f in families if f != "rank" for d in WINDOWS]
    return Q + f""",
fl AS (SELECT trade_date, security_id, c, {lists} FROM q),
fr AS (SELECT trade_date, security_id, {", ".join(f"{rank(d)} AS rank{d}" for d in WINDOWS)} FROM fl),
fm AS (SELECT trade_date, security_id, {", ".join(made)} FROM q),
af AS (SELECT * FROM fm JOIN fr USING (trade_date, security_id))"""


def _long(names: list[str]) -> str:
    """CTEs ending in ``f8``: every feature of every row, cleaned as the preprocessing does."""
    candles = [n for n in names if n in CANDLES]
    families = list(dict.fromkeys(n.rstrip("0123456789") for n in names if n not in CANDLES))
    return features(candles, families) + f""",
f2 AS (SELECT trade_date, security_id, feature, x FROM (
  SELECT trade_date, security_id, unnest([{", ".join(repr(n) for n in names)}]) AS feature, unnest([{", ".join(f"{n}::DOUBLE" for n in names)}]) AS x FROM af)),
f3 AS (SELECT trade_date, feature, median(x) AS m, count(*) AS n_rows, count(x) AS finite_before FROM f2 GROUP BY ALL),
f4 AS (SELECT f2.trade_date, security_id, f2.feature, m, coalesce(x, m) AS x, n_rows, finite_before FROM f2 JOIN f3 USING (trade_date, feature)),
f5 AS (SELECT trade_date, feature, median(abs(x - m)) AS s FROM f4 GROUP BY ALL),
f6 AS (SELECT f4.*, s, CASE WHEN s * 1.4826 <= 1e-12 THEN x ELSE greatest(m - 5 * 1.4826 * s, least(m + 5 * 1.4826 * s, x)) END AS w FROM f4 JOIN f5 USING (trade_date, feature)),
f7 AS (SELECT trade_date, feature, avg(w) AS a, stddev_pop(w) AS d FROM f6 GROUP BY ALL),
f8 AS (SELECT f6.trade_date, security_id, f6.feature, CASE WHEN d > 1e-12 THEN (w - a) / d ELSE 0 END AS z FROM f6 JOIN f7 USING (trade_date, feature))"""


def preprocessed(names: list[str]) -> str:
    wide = ", ".join(f"max(CASE WHEN feature = '{c}' THEN z END) AS {c}" for c in names)
    return rounded(_long(names), f"SELECT trade_date, security_id, {wide} FROM f8 GROUP BY trade_date, security_id", names)


def quality(names: list[str]) -> str:
    final = """SELECT trade_date, feature, any_value(n_rows) AS n_rows, any_value(finite_before) AS finite_before, any_value(n_rows - finite_before) AS missing_before,
  CAST(0 AS BIGINT) AS infinite_before, any_value(m) AS median, any_value(s) AS mad, any_value(1.4826::DOUBLE * s) + 3e-8 AS robust_scale, any_value(m - 5 * 1.4826::DOUBLE * s) + 3e-8 AS winsor_lower, any_value(m + 5 * 1.4826::DOUBLE * s) + 3e-8 AS winsor_upper,
  count(*) FILTER (s * 1.4826 > 1e-12 AND abs(x - m) > 5 * 1.4826 * s) AS clipped_count, any_value(finite_before) = 0 AS all_null, coalesce(stddev_pop(w), 0) <= 1e-12 AS zero_variance,
  round(avg(z), 6) AS post_mean, stddev_pop(z) AS post_std, count(z) AS finite_after FROM f6 JOIN f8 USING (trade_date, security_id, feature) GROUP BY ALL"""
    return rounded(_long(names), final, ["median", "mad", "robust_scale", "winsor_lower", "winsor_upper", "post_mean", "post_std"])


def decision(first: int, last: int, least: int) -> str:
    """Admission from the t statistic: one-sided p below 0.05 is t above the normal 0.95 quantile."""
    return f"""WITH {IC.lstrip()},
lk AS (SELECT * FROM ic WHERE horizon_days = 1 AND year(trade_date) BETWEEN {first} AND {last}),
ds AS (SELECT eligibility, count(rank_ic) AS n, avg(rank_ic) AS mean, avg(rank_ic) / sqrt(var_pop(rank_ic) / count(rank_ic)) AS t FROM lk GROUP BY eligibility),
gy AS (SELECT count(*) AS good FROM (SELECT avg(rank_ic) AS m FROM lk WHERE eligibility = 'basic' GROUP BY year(trade_date)) WHERE m > 0)
SELECT CASE WHEN n < {least} OR mean < 0 THEN 'Reject' WHEN mean IS NULL OR mean = 0 THEN 'Review'
  WHEN t > 1.6448536269514722 AND good >= 4 AND (SELECT mean FROM ds WHERE eligibility = 'tradable') > 0 THEN 'Admit' ELSE 'Review' END AS decision, round(t, 6) AS t_stat
FROM ds, gy WHERE eligibility = 'basic'"""


def combined() -> str:
    non = "nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eligibility, horizon_days ORDER BY trade_date) AS i FROM ic WHERE horizon_days > 1) WHERE (i - 1) % horizon_days = 0)"
    one = lambda tag, src, year: f"SELECT '{tag}' AS sample, eligibility, horizon_days, {year} AS year, count(rank_ic) AS n_observations, {HALVES} FROM {src} GROUP BY ALL"
    none, of_date = "CAST(NULL AS INTEGER)", "CAST(year(trade_date) AS INTEGER)"
    return rounded(f"{IC}, {non}", " UNION ALL ".join((one("overlapping", "ic", none), one("non_overlapping", "nn", none), one("annual", "ic", of_date))), HALF_NAMES)


def portfolio_tables(h: int, k: int, ppy: int) -> str:
    summary = " UNION ALL ".join(_summary_of(t, h, ppy) for t in ("gross", "net"))
    empty = "CAST(NULL AS DATE) AS trade_date"
    final = f"""SELECT 'summary' AS table_kind, {empty}, portfolio, return_type, n_periods, annualized_return, volatility, max_drawdown, CAST(NULL AS DOUBLE) AS gross_nav, CAST(NULL AS DOUBLE) AS net_nav FROM ({summary})
UNION ALL SELECT 'nav', trade_date, portfolio, NULL, NULL, NULL, NULL, NULL, gross_nav, net_nav FROM nav"""
    return rounded(portfolios(h, k), final, ["annualized_return", "volatility", "max_drawdown", "gross_nav", "net_nav"])


IC_METRICS = ("n_observations", "mean_pearson_ic", "pearson_icir", "mean_rank_ic", "rank_icir", "hac_t_stat")
BOOK_METRICS = ("annualized_return", "volatility", "sharpe", "max_drawdown", "n_periods", "n_evaluable_periods")


def scoreboard(horizons: tuple[int, ...], k: int, ppy: dict[int, int]) -> str:
    names = r"\b(el|cal|rnk|hl|tv|pr|pt|nav|wn)\b"
    books = "".join(re.sub(names, rf"\1_{h}", portfolios(h, k)[len(EVAL) :]) for h in horizons)
    bs = ",\nbs AS (" + " UNION ALL ".join(re.sub(names, rf"\1_{h}", _summary_of(t, h, ppy[h])) for h in horizons for t in ("gross", "net")) + ")"
    sm = f",\nsm AS (SELECT s.*, t_stat AS hac_t_stat FROM (SELECT eligibility, horizon_days, count(rank_ic) AS n_observations, {HALVES} FROM ic GROUP BY ALL) s LEFT JOIN ht USING (eligibility, horizon_days))"
    at = lambda src, where, c, name: f"(SELECT max({c}) FROM {src} WHERE {where}) AS {name}"
    cols = [at("sm", f"eligibility = '{e}' AND horizon_days = {h}", m, f"{p}{m}_{h}d") for h in horizons for e, p in (("basic", ""), ("tradable", "tradable_")) for m in IC_METRICS]
    cols += [at("bs", f"portfolio = 'top_{k}' AND return_type = '{t}' AND horizon_days = {h}", m, f"top_k_{t}_{m}_{h}d") for h in horizons for t in ("gross", "net") for m in BOOK_METRICS]
    cols += [at("bs", f"portfolio = 'top_{k}' AND horizon_days = {h}", "mean_turnover", f"top_k_mean_turnover_{h}d") for h in horizons]
    doubles = [c.rsplit(" AS ", 1)[1] for c in cols if not c.startswith("(SELECT max(n_")]
    return rounded(IC + mean_test("ic", "rank_ic", "eligibility, horizon_days", "horizon_days - 1") + books + bs + sm, "SELECT 'REV5' AS factor_id, 'run' AS run_id, " + ", ".join(cols), doubles)


def ledger_batch(horizons: tuple[int, ...], k: int, nav: float, bps: float) -> str:
    """One rebalance step for every (account, date) of the long portfolios at all horizons."""
    names, rate = r"\b(el|cal|rnk|hl|tv|pr|pt|nav|wn)\b", bps / 10_000
    books = "".join(re.sub(names, rf"\1_{h}", portfolios(h, k)[len(EVAL) :]) for h in horizons)
    held = " UNION ALL ".join(f"SELECT portfolio || '_{h}d' AS account, seq, trade_date, security_id AS code, CAST(w AS DOUBLE) AS weight FROM hl_{h} WHERE portfolio <> 'top_bottom'" for h in horizons)
    body = f""",
sess AS (SELECT * FROM (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS entry FROM (SELECT DISTINCT trade_date FROM p)) WHERE entry IS NOT NULL),
ent AS (SELECT sess.trade_date, security_id AS code, CASE WHEN adjusted_open > 0 THEN adjusted_open END AS price, adjusted_high = adjusted_low AS single FROM p JOIN sess ON p.trade_date = sess.entry),
live AS (SELECT hd.* FROM ({held}) hd JOIN sess USING (trade_date)),
steps AS (SELECT DISTINCT account, seq, trade_date FROM live),
bought AS (SELECT account, seq + 1 AS seq, code, weight * {nav} / price AS shares, price AS paid FROM live JOIN ent USING (trade_date, code) WHERE price > 0),
hold AS (SELECT b.account, s.trade_date, b.code, shares, paid, price FROM bought b JOIN steps s ON s.account = b.account AND s.seq = b.seq LEFT JOIN ent ON ent.trade_date = s.trade_date AND ent.code = b.code),
acc AS (SELECT s.account, s.trade_date, greatest({nav} - coalesce(spent, 0), 0) AS cash, {nav} - coalesce(spent, 0) + coalesce(worth, 0) AS value
  FROM steps s LEFT JOIN (SELECT account, trade_date, sum(shares * paid) AS spent, sum(shares * coalesce(price, paid)) AS worth FROM hold GROUP BY ALL) w ON w.account = s.account AND w.trade_date = s.trade_date),
st AS (SELECT rp.trade_date, security_id AS code, NOT tradable_next_open AS suspended, single AND price > adjusted_close AS up, single AND price < adjusted_close AS down, tradable_next_open IS NULL AS unknown
  FROM rp LEFT JOIN ent ON ent.trade_date = rp.trade_date AND ent.code = rp.security_id),
both_ AS (SELECT coalesce(h.account, t.account) AS account, coalesce(h.trade_date, t.trade_date) AS trade_date, coalesce(h.code, t.code) AS code, coalesce(shares, 0) AS have, coalesce(weight, 0) AS weight
  FROM (SELECT * FROM hold WHERE shares > 1e-12) h FULL JOIN (SELECT * FROM live WHERE weight > 1e-12) t ON t.account = h.account AND t.trade_date = h.trade_date AND t.code = h.code),
pos AS (SELECT b.*, acc.cash, ent.price, weight * acc.value / ent.price AS want, st.code IS NOT NULL AS known, suspended, up, down, unknown
  FROM both_ b JOIN acc ON acc.account = b.account AND acc.trade_date = b.trade_date LEFT JOIN ent ON ent.trade_date = b.trade_date AND ent.code = b.code LEFT JOIN st ON st.trade_date = b.trade_date AND st.code = b.code),
ords AS (SELECT *, 'sell' AS side, coalesce(want, 0) - have AS gap FROM pos WHERE coalesce(want, 0) - have < -1e-12
  UNION ALL SELECT *, 'buy', CASE WHEN want IS NULL THEN 0 ELSE want - have END FROM pos WHERE weight > 0 AND (want IS NULL OR want - have > 1e-12)),
why AS (SELECT *, abs(gap) * coalesce(price, 0) AS intended, CASE WHEN price IS NULL THEN 'missing_open_price' WHEN NOT known OR coalesce(unknown, true) THEN 'unknown_blocked' WHEN suspended THEN 'suspended'
  WHEN side = 'buy' AND up THEN 'limit_up' WHEN side = 'sell' AND down THEN 'limit_down' END AS reason FROM ords),
tot AS (SELECT *, cash + coalesce(sum(CASE WHEN side = 'sell' AND reason IS NULL THEN intended * {1 - rate} END) OVER w, 0) AS money, sum(CASE WHEN side = 'buy' AND reason IS NULL THEN intended * {1 + rate} END) OVER w AS need
  FROM why WINDOW w AS (PARTITION BY account, trade_date)),
fil AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 0 WHEN side = 'sell' THEN intended ELSE intended * least(1, money / need) END AS filled FROM tot)"""
    final = f"""SELECT account, trade_date, code, side, intended AS intended_notional, filled AS filled_notional, filled * {rate} AS trading_cost, reason AS block_reason,
  have + coalesce(CASE WHEN side = 'buy' THEN filled ELSE -filled END / price, 0) AS shares_after,
  greatest(0, money - coalesce(sum(CASE WHEN side = 'buy' THEN filled * {1 + rate} END) OVER (PARTITION BY account, trade_date), 0)) AS cash_after FROM fil"""
    return rounded(EVAL + books + body, final, ["intended_notional", "filled_notional", "trading_cost", "shares_after", "cash_after"], 4)


def not_finite(candles: list[str], families: list[str]) -> str:
    """Missing values of each feature."""
    cols = [*candles, *(f"{f}{d}" for f in families for d in WINDOWS)]
    counts = ", ".join(f"count(*) FILTER ({c} IS NULL OR NOT isfinite({c})) AS {c}" for c in cols)
    return f"WITH {features(candles, families).lstrip().lstrip(',')}, n AS (SELECT {counts} FROM af) UNPIVOT n ON COLUMNS(*) INTO NAME \"column\" VALUE violations"


def described(candles: list[str], families: list[str], lines: str) -> str:
    """Missing values of each feature beside the lines of the catalog, which DuckDB expands over the windows by itself."""
    values = ", ".join(f"({k}, '{line}')" for k, line in enumerate(lines.strip().splitlines()))
    return f"""WITH v AS ({not_finite(candles, families)}),
t AS (SELECT * FROM (VALUES {values}) x(k, line)),
e AS (SELECT k, w, string_split(replace(line, '<d>', w::VARCHAR), ' | ') AS x FROM t, (SELECT unnest({list(WINDOWS)}) AS w) WHERE contains(line, '<d>') OR w = {WINDOWS[0]}),
c AS (SELECT CAST(row_number() OVER (ORDER BY k, w) AS INTEGER) AS position, x[1] AS name, x[2] AS expression, x[3] AS operator, x[4] AS family,
  CAST(x[5] AS INTEGER) AS window, x[6] AS required_inputs, x[7] AS economic_interpretation, 'not_preassigned' AS expected_direction FROM e)
SELECT "column", violations, c.* FROM v LEFT JOIN c ON lower(name) = "column\""""


def base_adjusted(keys: str) -> str:
    """Prices over the first close of the series, and the logarithm of volume times it."""
    first, prices = f"first_value(adjusted_close) OVER {S}", ("open", "high", "low", "close")
    columns = ", ".join(f"adjusted_{c} / {first} AS {c}" for c in prices)
    return rounded(P, f"SELECT {keys}, {columns}, CASE WHEN volume * {first} > 0 THEN ln(volume * {first}) END AS ln_volume FROM p", [*prices, "ln_volume"])

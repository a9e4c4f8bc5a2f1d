"""The registered queries: every operator on the panel of the given tables, with its DuckDB twin where SQL has one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.canonical import canonical_json
from tidepanel.functions.core import rounded, sdiv
from tidepanel.operators import catalog, contracts, cross_section, evidence, factors, labels, models, portfolio, rolling, trees, user_factors, wide
from tidepanel.plans import single_factor, tree_track
from tidepanel.plans import sqltext as sql
from tidepanel.sources import audit, layout, sinks
from tidepanel.sources import panel as sources
from tidepanel.sources.sinks import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
HORIZONS = (1, 5, 20)


def add(name: str, body: Query, oracle: str | None = None, digits: int | None = 6) -> None:
    QUERIES[name] = (lambda s, d: rounded(body(s, d), digits)) if digits is not None else body
    if oracle:
        ORACLES[name] = oracle


P = sources.panel


def base(s: SparkSession, d: str) -> DataFrame:
    """The derived panel as a stored table: lineitem is read once, however often a query needs the panel."""
    return written(P(s, d), "panel")


def research_of(p: DataFrame) -> DataFrame:
    return labels.research_panel(p, sources.membership(p), sources.tradability(p)).drop("is_member")


def research(s: SparkSession, d: str) -> DataFrame:
    return research_of(base(s, d))


def marketed(s: SparkSession, d: str) -> DataFrame:
    p = base(s, d)
    return sources.with_market_return(research_of(p), sources.benchmark(p))


def labelled(s: SparkSession, d: str, horizons: tuple[int, ...] = (1,)) -> DataFrame:
    p = base(s, d)
    return labels.forward_labels(research_of(p), sources.benchmark(p), horizons)


def scored_of(p: DataFrame, factor: str = "REV5") -> DataFrame:
    """Labels, eligibility and a factor's directed score of the research panel: the single-factor run up to its evidence."""
    own = dict.fromkeys([*labels.KEYS, "adjusted_open", *factors.lookup(factor).fields])
    rows = written(labels.research_panel(p.select(*own), sources.membership(p), sources.tradability(p)), "research")
    prepared = cross_section.prepare_factor(factors.compute(factors.leak_free(rows), factor), factors.lookup(factor).direction)
    known = rows.select(*labels.KEYS, "adjusted_open", "tradable_next_open", "basic_eligible")
    return labels.forward_labels(known, sources.benchmark(p), HORIZONS).drop("adjusted_open").join(prepared.select(*labels.KEYS, "directed_score"), labels.KEYS, "left")


def scored(s: SparkSession, d: str, factor: str = "REV5") -> DataFrame:
    return scored_of(base(s, d), factor)


def daily_ic(s: SparkSession, d: str) -> DataFrame:
    return cross_section.evaluate_ic(scored(s, d), HORIZONS)


def simulated(s: SparkSession, d: str, h: int) -> tuple[DataFrame, DataFrame]:
    return portfolio.simulate(written(scored(s, d), "scored"), h, 10)


def on(body: Callable[[DataFrame], DataFrame]) -> Query:
    """A query that uses the stored panel several times."""
    return lambda s, d: body(base(s, d))


def industries(s: SparkSession, d: str) -> DataFrame:
    return sources.with_size_and_industry(P(s, d), sources.scan(s, f"{d}/supplier.parquet"), sources.scan(s, f"{d}/nation.parquet"))


IND = sql.P + """,
ind AS (SELECT p.*, sum(traded_amount) OVER (PARTITION BY security_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS size, CAST(n_regionkey AS VARCHAR) AS industry
  FROM p LEFT JOIN supplier ON s_suppkey = security_id LEFT JOIN nation ON s_nationkey = n_nationkey)"""
KEYS = "trade_date, security_id"
PANEL_DOUBLES = ["adjusted_open", "adjusted_high", "adjusted_low", "adjusted_close", "vwap"]

# Scans
add(
    "s1_daily_panel",
    lambda s, d: P(s, d).select(*labels.KEYS, *PANEL_DOUBLES, "turnover", "is_member", "tradable_next_open"),
    sql.rounded(sql.P, f"SELECT {KEYS}, {', '.join(PANEL_DOUBLES)}, turnover, is_member, tradable_next_open FROM p", PANEL_DOUBLES),
)
add("s2_membership", lambda s, d: sources.membership(P(s, d)), f"WITH {sql.P} SELECT {KEYS} FROM p WHERE is_member")
add("s3_tradability", lambda s, d: sources.tradability(P(s, d)), f"WITH {sql.P} SELECT {KEYS}, tradable_next_open FROM p")
add("s4_benchmark", lambda s, d: sources.benchmark(P(s, d)), sql.rounded(sql.B, "SELECT * FROM b", ["adjusted_open", "adjusted_close"]))
add("s7_session_dates", lambda s, d: P(s, d).select("trade_date").distinct(), f"WITH {sql.P} SELECT DISTINCT trade_date FROM p")

# Contracts
add(
    "v2_duplicate_keys",
    lambda s, d: contracts.duplicate_keys(sources.scan(s, f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"]),
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
add(
    "v3_positive_prices",
    lambda s, d: contracts.not_positive(P(s, d), ["adjusted_open", "adjusted_close", "volume"]),
    f"WITH {sql.P} SELECT 'adjusted_open' AS \"column\", count(*) FILTER (NOT coalesce(adjusted_open > 0, false)) AS violations FROM p UNION ALL SELECT 'adjusted_close', count(*) FILTER (NOT coalesce(adjusted_close > 0, false)) FROM p UNION ALL SELECT 'volume', count(*) FILTER (NOT coalesce(volume > 0, false)) FROM p",
)
add(
    "v4_unparsable_dates",
    lambda s, d: contracts.unparsable_dates(sources.scan(s, f"{d}/orders.parquet"), "o_orderdate"),
    "SELECT count(*) FILTER (TRY_CAST(o_orderdate AS TIMESTAMP) IS NULL) AS violations FROM orders",
)
def missing_values(s: SparkSession, d: str) -> DataFrame:
    return contracts.not_finite(rolling.all_features(P(s, d)), rolling.feature_names())


add("v6_not_finite", missing_values, sql.not_finite([*sql.CANDLES], list(rolling.FAMILIES)))
add(
    "r30_feature_catalog",
    lambda s, d: catalog.described(missing_values(s, d)),
    sql.described([*sql.CANDLES], list(rolling.FAMILIES), catalog.FEATURES),
)
add(
    "v7_all_members",
    lambda s, d: P(s, d).groupBy("trade_date").agg(F.bool_and("is_member").alias("all_members")),
    f"WITH {sql.P} SELECT trade_date, bool_and(is_member) AS all_members FROM p GROUP BY trade_date",
)
add(
    "v8_label_gap",
    on(lambda p: contracts.label_gap(p, p.where("is_member").withColumn("vwap", F.col("adjusted_close")), labels.KEYS, "vwap")),
    sql.rounded(sql.P, "SELECT max(abs(a.vwap - z.adjusted_close)) AS gap, count(*) FILTER (z.trade_date IS NULL) AS one_sided FROM p a LEFT JOIN (SELECT * FROM p WHERE is_member) z USING (trade_date, security_id)", ["gap"]),
)
add(
    "v12_exactly_one",
    lambda s, d: contracts.exactly_one(sources.scan(s, f"{d}/orders.parquet"), ["o_custkey"]),
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) <> 1",
)
add(
    "v13_strict_cells",
    lambda s, d: contracts.strict_cells(sources.scan(s, f"{d}/lineitem.parquet").select(F.col("l_returnflag"), F.col("l_linestatus").cast("string").alias("l_linestatus"), F.col("l_quantity").cast("string").alias("q")), numbers=["q"], choices={"l_returnflag": ["A", "R"], "l_linestatus": ["O"]}),
    "SELECT 'q' AS \"column\", count(*) FILTER (TRY_CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE) IS NULL) AS violations FROM lineitem UNION ALL SELECT 'l_returnflag', count(*) FILTER (NOT coalesce(l_returnflag IN ('A', 'R'), false)) FROM lineitem UNION ALL SELECT 'l_linestatus', count(*) FILTER (NOT coalesce(l_linestatus IN ('O'), false)) FROM lineitem",
)

# Projections and joins
add(
    "p1_date_range",
    lambda s, d: P(s, d).where("trade_date between date'1997-01-01' and date'1998-12-31'").select(*labels.KEYS, "adjusted_close"),
    sql.rounded(sql.P, f"SELECT {KEYS}, adjusted_close FROM p WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'", ["adjusted_close"]),
)
add(
    "p2_leak_free",
    lambda s, d: factors.leak_free(labelled(s, d), "1999-12-31").select(*labels.KEYS, "adjusted_close"),
    sql.rounded(sql.RP, f"SELECT {KEYS}, adjusted_close FROM rp WHERE trade_date <= DATE '1999-12-31'", ["adjusted_close"]),
)
add(
    "p5_history_start",
    lambda s, d: factors.history_start(P(s, d), "1998-01-01", 20),
    f"WITH {sql.P} SELECT min(trade_date) AS trade_date FROM (SELECT DISTINCT trade_date FROM p WHERE trade_date < DATE '1998-01-01' ORDER BY 1 DESC LIMIT 20)",
)
add(
    "p6_label_end",
    lambda s, d: factors.label_end(sources.benchmark(P(s, d)), "1998-01-01", 20),
    f"WITH {sql.B} SELECT max(trade_date) AS trade_date FROM (SELECT trade_date FROM b WHERE trade_date > DATE '1998-01-01' ORDER BY 1 LIMIT 21)",
)
add(
    "p8_every_5th_date",
    lambda s, d: portfolio.rebalances(scored(s, d), 5, 10).select("trade_date"),
    f"WITH {sql.RP} SELECT trade_date FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM rp)) WHERE (i - 1) % 5 = 0",
)
add(
    "p9_melt",
    lambda s, d: rolling.rolling_features(P(s, d), ["ma", "roc"], (5,)).unpivot(labels.KEYS, ["ma5", "roc5"], "model", "score"),
    sql.rounded(sql.Q, f"SELECT {KEYS}, 'ma5' AS model, {sql.family('ma', 5)} AS score FROM q UNION ALL SELECT {KEYS}, 'roc5', {sql.family('roc', 5)} FROM q", ["score"]),
)
add(
    "j1_members",
    on(lambda p: p.join(sources.membership(p), labels.KEYS, "left_semi").select(*labels.KEYS, "turnover")),
    f"WITH {sql.P} SELECT {KEYS}, turnover FROM p WHERE is_member",
)
add(
    "j2_tradable_default",
    on(lambda p: labels.research_panel(p, sources.membership(p), sources.tradability(p).where("tradable_next_open")).select(*labels.KEYS, "tradable_next_open")),
    f"WITH {sql.P} SELECT {KEYS}, tradable_next_open FROM p WHERE is_member",
)
add(
    "j3_benchmark",
    lambda s, d: marketed(s, d).select(*labels.KEYS, "market_return"),
    sql.rounded(sql.RP, f"SELECT {KEYS}, market_return FROM mp", ["market_return"]),
)
add(
    "j4_factor_on_panel",
    lambda s, d: scored(s, d).select(*labels.KEYS, "basic_eligible", "tradable_next_open", "directed_score"),
    sql.rounded(sql.EVAL, f"SELECT {KEYS}, basic_eligible, tradable_next_open, directed_score FROM ev", ["directed_score"]),
)
add(
    "j6_common_predictions",
    on(lambda p: cross_section.common_predictions(rolling.rolling_features(p, ["ma"], (5,)).withColumnRenamed("ma5", "score"), rolling.rolling_features(research_of(p), ["roc"], (5,)).withColumnRenamed("roc5", "score"), labels.KEYS, ["score"])),
    sql.rounded(sql.Q + f", q2 AS (SELECT trade_date, security_id, lag(adjusted_close, 5) OVER {sql.S} / adjusted_close AS z FROM p WHERE is_member)", f"SELECT a.trade_date, a.security_id, {sql.family('ma', 5).replace('security_id', 'a.security_id').replace('trade_date', 'a.trade_date')} AS score_a, z AS score_b, q2.trade_date IS NOT NULL AS complete FROM q a LEFT JOIN q2 ON a.trade_date = q2.trade_date AND a.security_id = q2.security_id", ["score_a", "score_b"]),
)

# Row ratios and rolling features
add(
    "c1_c13_row_ratios",
    lambda s, d: P(s, d).select(*labels.KEYS, *(x.alias(n) for n, x in rolling.candles().items())),
    sql.rounded(sql.Q, f"SELECT {KEYS}, {', '.join(f'{x} AS {n}' for n, x in sql.CANDLES.items())} FROM q", list(sql.CANDLES)),
)
for k, fam in enumerate(rolling.FAMILIES):
    add(f"r{k + 1}_{fam}", lambda s, d, fam=fam: rolling.rolling_features(P(s, d), [fam]), sql.rolling(fam))
add("r_all_158_features", lambda s, d: rolling.all_features(P(s, d)), sql.all_features([*sql.CANDLES], list(rolling.FAMILIES)))


def canonical_nations(s: SparkSession, d: str) -> DataFrame:
    """Canonical JSON of flat and of nested values: maps, lists, nulls, escapes and large numbers."""
    rows = sources.scan(s, f"{d}/nation.parquet")
    flat = F.struct("n_regionkey", "n_nationkey", "n_name")
    key, name, region = (F.col(c) for c in ("n_nationkey", "n_name", "n_regionkey"))
    inner = F.struct(F.concat(name, F.lit("\n")).alias("z"), F.when(key % 2 == 0, True).alias("a"))
    by = F.create_map(name, F.array(key, F.lit(None), region), F.lit("all"), F.array().cast("array<bigint>"))
    nested = F.struct(((key + 1) * 1e7).alias("wide"), (key / 4).alias("share"), inner.alias("key"), by.alias("by"))
    made = rows.select("n_nationkey", flat.alias("flat"), nested.alias("nested"))
    return made.select("n_nationkey", *(canonical_json(F.col(c), made.schema[c].dataType).alias(n) for c, n in (("flat", "j"), ("nested", "nested"))))


add(
    "c19_canonical_json",
    canonical_nations,
    """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS j,
  '{"by":{"' || n_name || '":[' || n_nationkey || ',null,' || n_regionkey || '],"all":[]},"key":{"a":' || CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'null' END
  || ',"z":"' || n_name || '\\n' || '"},"share":' || CAST(n_nationkey / 4.0::DOUBLE AS VARCHAR) || ',"wide":' || (n_nationkey + 1) || '0000000.0}' AS nested FROM nation""",
)
add(
    "c20_year",
    lambda s, d: P(s, d).groupBy(F.year("trade_date").alias("year")).agg(F.count("*").alias("n")),
    f"WITH {sql.P} SELECT CAST(year(trade_date) AS INTEGER) AS year, count(*) AS n FROM p GROUP BY 1",
)

# Factors
for k, name in enumerate(factors.FACTORS):
    add(f"f{k + 1}_{name.lower()}", lambda s, d, name=name: factors.compute(marketed(s, d), name), sql.factor(name), sql.factor_digits(name))


def _reversal(rows):
    close = rows["adjusted_close"]
    return rows.assign(raw_value=close / close.shift(5) - 1)[["trade_date", "security_id", "raw_value"]]


def user_factor(s: SparkSession, d: str) -> DataFrame:
    """A user's function bound to a row of a registry table."""
    table = s.createDataFrame([("MINE", "negative", "adjusted_close", "close[t] / close[t-5] - 1")], user_factors.REGISTRY)
    return user_factors.compute(marketed(s, d), table, "MINE", {"MINE": user_factors.UserFactor(_reversal)})


add("f11_f12_user_factor", user_factor, sql.factor("REV5"))


def year_panel(s: SparkSession, d: str) -> DataFrame:
    """The panel saved by year and security, its last years read back for a rolling mean and the range of each security; the table goes again."""
    table = f"panel_{uuid.uuid4().hex}"
    layout.save_panel(P(s, d), table, 8)
    late = layout.read_panel(s, table, since=1998)
    out = written(rolling.rolling_features(late, ["ma"], (5,)), "late")
    s.sql(f"DROP TABLE {table}")
    return out


add("s5_year_panel", year_panel, sql.rounded(sql.P, "SELECT trade_date, security_id, avg(adjusted_close) OVER (PARTITION BY security_id ORDER BY trade_date ROWS 4 PRECEDING) / adjusted_close AS ma5 FROM p WHERE year(trade_date) >= 1998", ["ma5"]))

AUDITED = {"REV5": (), "MOM20": ("raw",), "VOL20": (), "TURN20": (), "CLOSE_POS5": ()}


def audited_runs(s: SparkSession, d: str) -> DataFrame:
    """Bundles of five factors in one folder: whole, without an artifact, with one more, under a foreign factor, without a manifest; and what the audit finds."""
    root = f"{sinks.shared_dir(s).rstrip('/')}/runs-{uuid.uuid4().hex}"
    rows = written(marketed(s, d), "marketed")
    for k, name in enumerate(AUDITED):
        raw = factors.compute(rows, name)
        tables = {"raw": raw, "quality": raw.agg(F.count("*").alias("n"), F.count("raw_value").alias("known"))}
        tables = {n: t for n, t in tables.items() if n not in AUDITED[name]} | ({"notes": raw.limit(0)} if name == "VOL20" else {})
        row = s.createDataFrame([("REV5" if name == "TURN20" else name, f"r{k}")], "factor_id string, run_id string")
        sinks.write_bundle(tables, f"{root}/factor_id={name}", f"r{k}", row)
        if name == "CLOSE_POS5":
            sinks.remove(s, f"{root}/factor_id={name}/run_id=r{k}/manifest")
    found = audit.run_audit(s, root, ("quality", "raw"))
    sizes = found.join(audit.listing(s, root).where("length > 0").groupBy("factor_id", "run_id").agg(F.countDistinct("artifact").alias("n_artifacts")), ["factor_id", "run_id"], "left")
    text = [F.array_join(c, ",").alias(c) for c in ("missing", "extra")]
    out = written(sizes.select("factor_id", "run_id", "n_manifests", *text, "undeclared", "foreign", "unsafe", "complete", "n_artifacts"), "audit")
    sinks.remove(s, root)
    return out


add(
    "v12a_run_audit",
    audited_runs,
    f"""WITH {sql.P}, told(factor_id, run_id, n_manifests, missing, extra, undeclared, "foreign", complete, n) AS (VALUES
  ('REV5', 'r0', 1, '', '', false, false, true, 2), ('MOM20', 'r1', 1, 'raw', '', true, false, false, 1), ('VOL20', 'r2', 1, '', 'notes', true, false, false, 3),
  ('TURN20', 'r3', 1, '', '', false, true, false, 2), ('CLOSE_POS5', 'r4', 0, 'quality,raw', '', true, true, false, 2))
SELECT factor_id, run_id, n_manifests, missing, extra, undeclared, "foreign", false AS unsafe, complete, CASE WHEN (SELECT count(*) FROM p WHERE is_member) > 0 THEN n ELSE 0 END AS n_artifacts FROM told""",
    None,
)

# Cross sections


def _all_features(s: SparkSession, d: str) -> DataFrame:
    """All 158 features as a stored table."""
    return written(rolling.all_features(P(s, d)), "features")


def feature_quality(s: SparkSession, d: str) -> DataFrame:
    """Quality of all features; products with the scale constant are moved by 3e-8, as many end in a 5 behind the sixth digit, which engines round either way."""
    return cross_section.quality(_all_features(s, d), ALL).withColumns({c: F.col(c) + 3e-8 for c in ("robust_scale", "winsor_lower", "winsor_upper")})


ALL = [*sql.CANDLES, *(f"{f}{w}" for f in rolling.FAMILIES for w in rolling.WINDOWS)]
add("x1_preprocess", lambda s, d: cross_section.preprocess(_all_features(s, d), ALL), sql.preprocessed(ALL))
add(
    "x2_quality",
    feature_quality,
    sql.quality(ALL),
)
add(
    "x3_factor_preparation",
    lambda s, d: cross_section.prepare_factor(factors.compute(research(s, d), "REV5"), "negative").drop("directed_score"),
    sql.rounded(sql.RP + sql.REV5_RAW + sql.PREP, "SELECT * FROM prep", ["raw_value", "winsorized_value", "zscore_value"]),
)
add(
    "x4_label_zscore",
    lambda s, d: cross_section.zscore_label(scored(s, d).select(*labels.KEYS, "label_excess_o2o_1d"), "label_excess_o2o_1d", "trade_date").select(*labels.KEYS, "label_z"),
    sql.rounded(sql.EVAL + ", zs AS (SELECT trade_date, avg(label_excess_o2o_1d) AS a, stddev_pop(label_excess_o2o_1d) AS d FROM ev GROUP BY trade_date)", f"SELECT {KEYS}, CASE WHEN d > 0 THEN (label_excess_o2o_1d - a) / d END AS label_z FROM ev JOIN zs USING (trade_date)", ["label_z"]),
)
add(
    "x5_date_weights",
    lambda s, d: cross_section.equal_date_weights(P(s, d).select(*labels.KEYS), "trade_date"),
    sql.rounded(sql.P, f"SELECT {KEYS}, (SELECT count(*) FROM p) / ((SELECT count(DISTINCT trade_date) FROM p) * count(*) OVER (PARTITION BY trade_date))::DOUBLE AS weight FROM p", ["weight"]),
)
add(
    "n1_neutralize",
    lambda s, d: cross_section.neutralize(industries(s, d).withColumn("score", sdiv(F.col("adjusted_close"), F.col("vwap"))), "score").select(*labels.KEYS, "neutral_score"),
    sql.rounded(IND + """,
n0 AS (SELECT *, adjusted_close / vwap AS score, ln(size) AS z, coalesce(industry, 'Unknown') AS i FROM ind),
n1 AS (SELECT *, score - avg(score) OVER (PARTITION BY trade_date, i) AS ds, z - avg(z) OVER (PARTITION BY trade_date, i) AS dz FROM n0)""", f"SELECT {KEYS}, ds - coalesce(sum(ds * dz) OVER (PARTITION BY trade_date) / nullif(sum(dz * dz) OVER (PARTITION BY trade_date), 0), 0) * dz AS neutral_score FROM n1", ["neutral_score"]),
)
add(
    "x6_rank_ic",
    lambda s, d: cross_section.rank_ic(scored(s, d), "directed_score", "label_excess_o2o_1d", "trade_date"),
    sql.rounded(sql.EVAL + """,
k1 AS (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY directed_score) + (count(*) OVER (PARTITION BY trade_date, directed_score) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY trade_date ORDER BY label_excess_o2o_1d) + (count(*) OVER (PARTITION BY trade_date, label_excess_o2o_1d) - 1) / 2.0 AS y FROM ev WHERE directed_score IS NOT NULL AND label_excess_o2o_1d IS NOT NULL),
k2 AS (SELECT trade_date, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS rank_ic FROM k1 GROUP BY trade_date)""", "SELECT trade_date, count(*) AS cross_section_rows, any_value(rank_ic) AS rank_ic FROM ev LEFT JOIN k2 USING (trade_date) GROUP BY trade_date", ["rank_ic"]),
)
add("x7_daily_ic", daily_ic, sql.rounded(sql.IC, "SELECT * FROM ic", ["pearson_ic", "rank_ic"]))
QUINTILES = sql.EVAL + """,
u0 AS (SELECT trade_date, security_id, directed_score, label_excess_o2o_1d AS y FROM ev WHERE directed_score IS NOT NULL AND label_excess_o2o_1d IS NOT NULL),
u1 AS (SELECT u0.*, n, row_number() OVER (PARTITION BY trade_date ORDER BY directed_score, security_id) AS rn FROM u0 JOIN (SELECT trade_date, count(*) AS n FROM u0 GROUP BY trade_date HAVING count(*) >= 5 AND count(DISTINCT directed_score) >= 5) USING (trade_date)),
u2 AS (SELECT trade_date, CAST(greatest(1, ((rn - 1) * 5 + n - 2) // (n - 1)) AS INTEGER) AS quintile, avg(y) AS mean_return, count(*) AS n_names FROM u1 GROUP BY ALL),
u3 AS (SELECT * FROM u2 UNION ALL SELECT trade_date, 6, max(CASE WHEN quintile = 5 THEN mean_return END) - max(CASE WHEN quintile = 1 THEN mean_return END), max(CASE WHEN quintile = 5 THEN n_names END) + max(CASE WHEN quintile = 1 THEN n_names END) FROM u2 GROUP BY trade_date)"""
add(
    "x8_quintiles",
    lambda s, d: cross_section.quintiles(scored(s, d), "directed_score", "label_excess_o2o_1d", "trade_date"),
    sql.rounded(QUINTILES, "SELECT * FROM u3", ["mean_return"]),
)
add(
    "x9_x11_positions",
    lambda s, d: portfolio.positions(scored(s, d), 5, 10, 5).select("trade_date", "portfolio", "security_id", "weight"),
    sql.rounded(sql.portfolios(5, 10), "SELECT trade_date, portfolio, security_id, CAST(w AS DOUBLE) AS weight FROM hl", ["weight"]),
)

# Labels, portfolios
add(
    "l1_forward_labels",
    lambda s, d: labelled(s, d, HORIZONS).select(*labels.KEYS, "basic_eligible", "entry_date", *(c for h in HORIZONS for c in (f"label_end_date_{h}d", f"label_excess_o2o_{h}d"))),
    sql.rounded(sql.RP + sql.labels(), f"SELECT {KEYS}, basic_eligible, entry_date, " + ", ".join(f"label_end_date_{h}d, label_excess_o2o_{h}d" for h in HORIZONS) + " FROM lab", [f"label_excess_o2o_{h}d" for h in HORIZONS]),
)
add(
    "l3_research_panel",
    lambda s, d: research(s, d).select(*labels.KEYS, "adjusted_open", "tradable_next_open", "basic_eligible"),
    sql.rounded(sql.RP, f"SELECT {KEYS}, adjusted_open, tradable_next_open, basic_eligible FROM rp", ["adjusted_open"]),
)
for h in HORIZONS:
    add(
        f"w1_w3_periods_{h}d",
        lambda s, d, h=h: simulated(s, d, h)[0],
        sql.rounded(sql.portfolios(h, 10), "SELECT * FROM nav", sql.NAV_DOUBLES, 9),
        9,
    )
    add(f"w4_w5_summary_{h}d", lambda s, d, h=h: simulated(s, d, h)[1], sql.portfolio_summary(h, 10, portfolio.PERIODS[h]))
add(
    "j7_turnover",
    lambda s, d: portfolio.turnovers(portfolio.positions(scored(s, d), 5, 10, 5)),
    sql.rounded(sql.portfolios(5, 10), "SELECT CAST(seq AS BIGINT) AS seq, portfolio, CAST(turnover AS DOUBLE) AS turnover FROM tv", ["turnover"]),
)


def _ledger(s: SparkSession, d: str) -> DataFrame:
    last = P(s, d).where("trade_date = date'2001-06-01'")
    keyed = last.withColumn("account", F.col("security_id") % 5)
    holdings = keyed.where("security_id % 3 = 0").select("account", F.col("security_id").alias("code"), (F.col("turnover") * 10).alias("shares"))
    targets = keyed.where("security_id % 2 = 0")
    targets = targets.join(targets.groupBy("account").agg(F.count("*").alias("n")), "account").select("account", F.col("security_id").alias("code"), (1 / F.col("n")).alias("weight"))
    value = keyed.groupBy("account").agg(F.lit(1000.0).alias("cash"), (1000.0 + F.sum(F.when(F.col("security_id") % 3 == 0, F.col("turnover") * 10 * F.col("adjusted_close")).otherwise(0.0))).alias("nav"))
    state = last.where("security_id % 11 <> 0").select(F.col("security_id").alias("code"), (F.col("security_id") % 7 == 0).alias("suspended"), (~F.col("tradable_next_open")).alias("limit_up"), (F.col("security_id") % 5 == 0).alias("limit_down"), F.lit(False).alias("unknown_blocked"))
    return portfolio.rebalance_ledger(holdings, targets, value, last.select(F.col("security_id").alias("code"), F.col("adjusted_close").alias("price")), state, 10.0)


def ledger_batch(s: SparkSession, d: str) -> DataFrame:
    """Every rebalance date of every long portfolio and horizon; the diagnostic one is short and needs borrowing."""
    daily = base(s, d)
    rows = written(scored_of(daily), "scored")
    every = [portfolio.positions(rows, h, 10, 5).where("not is_diagnostic").select(F.concat("portfolio", F.lit(f"_{h}d")).alias("account"), "seq", "trade_date", "security_id", "weight") for h in HORIZONS]
    held = written(every[0].unionByName(every[1]).unionByName(every[2]), "held")
    tables = portfolio.execution_tables(held, daily, written(research_of(daily), "states"), 1_000_000.0)
    return portfolio.rebalance_ledger(**tables, bps=10.0, date="trade_date")


add("w7_ledger_batch", ledger_batch, sql.ledger_batch(HORIZONS, 10, 1_000_000.0, 10.0), 4)
add(
    "w6_w7_rebalance_ledger",
    _ledger,
    sql.rounded(sql.P + """,
g0 AS (SELECT security_id % 5 AS account, security_id AS code, adjusted_close AS price, turnover * 10 AS qty, tradable_next_open FROM p WHERE trade_date = DATE '2001-06-01'),
g1 AS (SELECT account, 1000.0 + sum(CASE WHEN code % 3 = 0 THEN qty * price ELSE 0 END) AS nav, count(*) FILTER (code % 2 = 0) AS n FROM g0 GROUP BY account),
g2 AS (SELECT g0.*, nav, CASE WHEN code % 3 = 0 THEN qty ELSE 0 END AS have, CASE WHEN code % 2 = 0 THEN 1.0 / n ELSE 0 END * nav / price AS want FROM g0 JOIN g1 USING (account) WHERE code % 3 = 0 OR code % 2 = 0),
g3 AS (SELECT *, CASE WHEN want - have < -1e-12 THEN 'sell' ELSE 'buy' END AS side, abs(want - have) * price AS intended FROM g2 WHERE abs(want - have) > 1e-12),
g4 AS (SELECT *, CASE WHEN code % 11 = 0 THEN 'unknown_blocked' WHEN code % 7 = 0 THEN 'suspended' WHEN side = 'buy' AND NOT tradable_next_open THEN 'limit_up' WHEN side = 'sell' AND code % 5 = 0 THEN 'limit_down' END AS reason FROM g3),
g5 AS (SELECT *, 1000.0 + coalesce(sum(CASE WHEN side = 'sell' AND reason IS NULL THEN intended * 0.999 END) OVER (PARTITION BY account), 0) AS money, sum(CASE WHEN side = 'buy' AND reason IS NULL THEN intended * 1.001 END) OVER (PARTITION BY account) AS need FROM g4),
g6 AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 0 WHEN side = 'sell' THEN intended ELSE intended * least(1, money / need) END AS filled FROM g5)""", "SELECT account, code, side, intended AS intended_notional, filled AS filled_notional, filled * 0.001 AS trading_cost, reason AS block_reason, have + CASE WHEN side = 'buy' THEN filled ELSE -filled END / price AS shares_after, greatest(0, money - coalesce(sum(CASE WHEN side = 'buy' THEN filled * 1.001 END) OVER (PARTITION BY account), 0)) AS cash_after FROM g6", ["intended_notional", "filled_notional", "trading_cost", "shares_after", "cash_after"], 4),
    4,
)

# Evidence
add(
    "g1_g2_ic_by_year",
    lambda s, d: evidence.ic_by_year(daily_ic(s, d), "rank_ic", "trade_date", ["eligibility", "horizon_days"]),
    sql.rounded(sql.IC, "SELECT eligibility, horizon_days, CAST(year(trade_date) AS INTEGER) AS year, count(*) AS n, avg(rank_ic) AS mean, stddev_samp(rank_ic) AS std, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0 END) AS positive_ratio, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS icir FROM ic WHERE rank_ic IS NOT NULL GROUP BY GROUPING SETS ((eligibility, horizon_days), (eligibility, horizon_days, year(trade_date)))", ["mean", "std", "positive_ratio", "icir"]),
)
add(
    "g3_quintile_summary",
    lambda s, d: cross_section.quintiles(scored(s, d), "directed_score", "label_excess_o2o_1d", "trade_date").groupBy("quintile").agg(F.count("*").alias("n"), F.avg("mean_return").alias("mean"), F.stddev_samp("mean_return").alias("std")),
    sql.rounded(QUINTILES, "SELECT quintile, count(*) AS n, avg(mean_return) AS mean, stddev_samp(mean_return) AS std FROM u3 GROUP BY quintile", ["mean", "std"]),
)
add(
    "g4_newey_west",
    lambda s, d: evidence.mean_test(daily_ic(s, d), "rank_ic", ["eligibility", "horizon_days"], "trade_date", 4, unbiased=True),
    sql.rounded(sql.IC + sql.mean_test("ic", "rank_ic", "eligibility, horizon_days", "4", unbiased=True), "SELECT * FROM ht", ["mean", "se", "t_stat"]),
)
add(
    "g5_hac",
    lambda s, d: evidence.mean_test(daily_ic(s, d), "rank_ic", ["eligibility", "horizon_days"], "trade_date", F.col("horizon_days") - 1),
    sql.rounded(sql.IC + sql.mean_test("ic", "rank_ic", "eligibility, horizon_days", "horizon_days - 1"), "SELECT * FROM ht", ["mean", "se", "t_stat"]),
)
SUMMARY = ["hac_standard_error", "hac_t_stat", *sql.HALF_NAMES]
_sum = lambda src, lag: f"SELECT s.*, se AS hac_standard_error, t_stat AS hac_t_stat, CAST({lag} AS INTEGER) AS hac_lag FROM (SELECT eligibility, horizon_days, count(rank_ic) AS n_observations, {sql.HALVES} FROM {src} GROUP BY ALL) s LEFT JOIN ht USING (eligibility, horizon_days)"
add(
    "g7_ic_summary",
    lambda s, d: evidence.ic_summary(daily_ic(s, d)),
    sql.rounded(sql.IC + sql.mean_test("ic", "rank_ic", "eligibility, horizon_days", "horizon_days - 1"), _sum("ic", "horizon_days - 1").replace("n, mean", "mean"), SUMMARY),
)
add(
    "g8_ic_yearly",
    lambda s, d: evidence.ic_yearly(daily_ic(s, d)),
    sql.rounded(sql.IC, f"SELECT eligibility, horizon_days, CAST(year(trade_date) AS INTEGER) AS year, count(rank_ic) AS n_observations, {sql.HALVES} FROM ic GROUP BY ALL", sql.HALF_NAMES),
)
NON = sql.IC + ", nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eligibility, horizon_days ORDER BY trade_date) AS i FROM ic WHERE horizon_days > 1) WHERE (i - 1) % horizon_days = 0)"
add(
    "g9_non_overlapping",
    lambda s, d: evidence.ic_summary(evidence.every_hth(daily_ic(s, d)), overlap=False),
    sql.rounded(NON + sql.mean_test("nn", "rank_ic", "eligibility, horizon_days", "0"), _sum("nn", "0"), SUMMARY),
)
add(
    "g11_decision",
    lambda s, d: evidence.decide(daily_ic(s, d), [1996, 1997, 1998, 1999, 2000], least=30).select("n", "mean", "tradable_mean", "good_years"),
    sql.rounded(sql.IC + ", lk AS (SELECT * FROM ic WHERE horizon_days = 1 AND year(trade_date) BETWEEN 1996 AND 2000)", "SELECT (SELECT count(rank_ic) FROM lk WHERE eligibility = 'basic') AS n, (SELECT avg(rank_ic) FROM lk WHERE eligibility = 'basic') AS mean, (SELECT avg(rank_ic) FROM lk WHERE eligibility = 'tradable') AS tradable_mean, (SELECT count(*) FROM (SELECT avg(rank_ic) AS m FROM lk WHERE eligibility = 'basic' GROUP BY year(trade_date)) WHERE m > 0) AS good_years", ["mean", "tradable_mean"]),
)
add(
    "g11_decision_label",
    lambda s, d: evidence.decide(daily_ic(s, d), [1996, 1997, 1998, 1999, 2000], least=30).select("decision", "t_stat"),
    sql.decision(1996, 2000, 30),
)
add(
    "g14_data_quality",
    lambda s, d: evidence.data_quality(research(s, d)),
    f"WITH {sql.RP} SELECT unnest(['rows', 'dates', 'securities', 'missing_open', 'missing_close', 'tradable_rows']) AS metric, unnest([count(*), count(DISTINCT trade_date), count(DISTINCT security_id), count(*) FILTER (adjusted_open IS NULL), count(*) FILTER (adjusted_close IS NULL), count(*) FILTER (tradable_next_open)]) AS value FROM rp",
)


def _two_models(s: SparkSession, d: str) -> DataFrame:
    p = base(s, d)
    y = labels.forward_labels(research_of(p), sources.benchmark(p), (1,)).select(*labels.KEYS, "label_excess_o2o_1d")
    x = rolling.rolling_features(p, ["ma", "rsv"], (5,)).unpivot(labels.KEYS, ["ma5", "rsv5"], "model", "score")
    return cross_section.rank_ic(x.join(y, labels.KEYS), "score", "label_excess_o2o_1d", "trade_date", "model")


PAIRED = sql.RP + sql.labels((1,)) + f""",
q AS (SELECT trade_date, security_id, adjusted_close AS c, adjusted_high AS h, adjusted_low AS l FROM p),
m0 AS (SELECT {KEYS}, {sql.family('ma', 5)} AS ma5, {sql.family('rsv', 5)} AS rsv5 FROM q),
m1 AS (SELECT {KEYS}, 'ma5' AS model, ma5 AS score FROM m0 UNION ALL SELECT {KEYS}, 'rsv5', rsv5 FROM m0),
m2 AS (SELECT trade_date, model, rank() OVER (PARTITION BY trade_date, model ORDER BY score) + (count(*) OVER (PARTITION BY trade_date, model, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY trade_date, model ORDER BY label_excess_o2o_1d) + (count(*) OVER (PARTITION BY trade_date, model, label_excess_o2o_1d) - 1) / 2.0 AS y FROM m1 JOIN lab USING (trade_date, security_id) WHERE score IS NOT NULL AND label_excess_o2o_1d IS NOT NULL),
m3 AS (SELECT trade_date, model, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS rank_ic FROM m2 GROUP BY ALL),
m4 AS (SELECT trade_date, 'ma5-rsv5' AS pair, max(CASE WHEN model = 'ma5' THEN rank_ic END) - max(CASE WHEN model = 'rsv5' THEN rank_ic END) AS difference FROM m3 GROUP BY trade_date)"""
add(
    "j8_g15_paired_difference",
    lambda s, d: evidence.paired_difference(_two_models(s, d), "model", "ma5", "rsv5", "rank_ic", "trade_date"),
    sql.rounded(PAIRED + sql.mean_test("m4", "difference", "pair", "4", unbiased=True), "SELECT * FROM ht", ["mean", "se", "t_stat"]),
)
SAMPLE = ["sample", "eligibility", "horizon_days", "year", "n_observations", *sql.HALF_NAMES]


def _combined(s: SparkSession, d: str) -> DataFrame:
    daily = written(daily_ic(s, d), "ic")
    tables = {"overlapping": evidence.ic_summary(daily), "non_overlapping": evidence.ic_summary(evidence.every_hth(daily), overlap=False), "annual": evidence.ic_yearly(daily)}
    return evidence.tagged_union(tables, "sample").select(*SAMPLE)


def _portfolio_tables(s: SparkSession, d: str) -> DataFrame:
    table, summary = simulated(s, d, 5)
    return evidence.tagged_union({"summary": summary, "nav": table}, "table_kind").select("table_kind", "trade_date", "portfolio", "return_type", "n_periods", "annualized_return", "volatility", "max_drawdown", "gross_nav", "net_nav")


add("g16_combined_summary", _combined, sql.combined())
add("g17_portfolio_tables", _portfolio_tables, sql.portfolio_tables(5, 10, portfolio.PERIODS[5]))
add(
    "g18_cumulative_rank_ic",
    lambda s, d: evidence.cumulative_rank_ic(daily_ic(s, d)),
    sql.rounded(sql.IC, "SELECT trade_date, eligibility, horizon_days, sum(coalesce(rank_ic, 0)) OVER (PARTITION BY eligibility, horizon_days ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS cumulative_rank_ic FROM ic", ["cumulative_rank_ic"]),
)
add(
    "g19_top_k_nav",
    lambda s, d: simulated(s, d, 5)[0].where("portfolio = 'top_10'").select("trade_date", "nav_date", "net_nav"),
    sql.rounded(sql.portfolios(5, 10), "SELECT trade_date, nav_date, net_nav FROM nav WHERE portfolio = 'top_10'", ["net_nav"]),
)


def _board(s: SparkSession, d: str) -> DataFrame:
    run = {"factor_id": F.lit("REV5"), "run_id": F.lit("run")}
    rows = written(scored(s, d), "scored")
    summary = evidence.with_p_value(evidence.ic_summary(cross_section.evaluate_ic(rows, HORIZONS))).withColumns(run)
    books = [portfolio.simulate(rows, h, 10, kinds=("top_k_long",))[1].withColumns(run) for h in HORIZONS]  # a scoreboard row holds no others
    return evidence.scoreboard_row(summary, books[0].unionByName(books[1]).unionByName(books[2]), list(run), HORIZONS)


add(
    "g20_scoreboard_row",
    lambda s, d: (b := _board(s, d)).drop(*(c for c in b.columns if "p_value" in c)),
    sql.scoreboard(HORIZONS, 10, portfolio.PERIODS),
)


def factor_card(s: SparkSession, d: str) -> DataFrame:
    """The card of the latest of three runs; an experimental run and an earlier one are beside it."""
    b = written(_board(s, d).drop("run_id"), "board")
    runs = s.createDataFrame([("r1", "formal", "2024-01-01T00:00:00Z"), ("r2", "formal", "2024-02-01T00:00:00Z"), ("r3", "experimental", "2024-03-01T00:00:00Z")], "run_id string, run_type string, created_at string")
    return evidence.factor_cards(b.crossJoin(F.broadcast(runs))).where("metric not like '%p_value%'")


_NAMES = r"^(top_k_)?(gross_|net_|tradable_)?(.+)_(\d+)d$"
add(
    "g21_factor_card",
    factor_card,
    f"""SELECT factor_id, 'r2' AS run_id, CASE WHEN name LIKE 'top_k_%' THEN 'portfolio' ELSE 'ic' END AS part, CAST(regexp_extract(name, '{_NAMES}', 4) AS INTEGER) AS horizon_days,
  CASE WHEN name LIKE 'top_k_gross_%' THEN 'gross' WHEN name LIKE 'top_k_net_%' THEN 'net' WHEN name LIKE 'top_k_%' THEN 'both' WHEN name LIKE 'tradable_%' THEN 'tradable' ELSE 'basic' END AS kind,
  regexp_extract(name, '{_NAMES}', 3) AS metric, value
FROM (SELECT factor_id, CAST(COLUMNS(* EXCLUDE (factor_id, run_id)) AS DOUBLE) FROM ({sql.scoreboard(HORIZONS, 10, portfolio.PERIODS)})) UNPIVOT INCLUDE NULLS (value FOR name IN (COLUMNS(* EXCLUDE (factor_id))))""",
)


def single_run(s: SparkSession, d: str) -> single_factor.Run:
    """A whole run of REV5 over the derived panel; its dates enclose all of the tables'."""
    p = base(s, d)
    inputs = single_factor.Inputs(p, sources.membership(p), sources.tradability(p), sources.benchmark(p))
    profile = single_factor.Profile("1995-01-01", "2001-12-31", HORIZONS, top_k=10, locked_years=(1996, 1997, 1998, 1999, 2000), least=30)
    return single_factor.single_factor(inputs, "REV5", profile, "run", "2002-01-01T00:00:00Z")


add(
    "g22_g23_run_manifest",
    lambda s, d: single_run(s, d).manifest.select("factor_id", "run_id", "run_type", "decision", "n_daily_rows"),
    f"SELECT 'REV5' AS factor_id, 'run' AS run_id, 'experimental' AS run_type, decision, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, date_trunc('month', l_shipdate) FROM lineitem)) AS n_daily_rows FROM ({sql.decision(1996, 2000, 30)})",
)
add(
    "g14_run_quality",
    lambda s, d: single_run(s, d).tables["data_quality"],
    f"WITH {sql.EVAL} SELECT unnest(['panel_rows', 'signal_dates', 'security_ids', 'basic_eligible_rows', 'tradable_next_open_rows', 'finite_directed_score_rows', 'finite_label_1d_rows', 'finite_label_5d_rows', 'finite_label_20d_rows']) AS metric, unnest([count(*), count(DISTINCT trade_date), count(DISTINCT security_id), count(*) FILTER (basic_eligible), count(*) FILTER (tradable_next_open), count(directed_score), count(label_excess_o2o_1d), count(label_excess_o2o_5d), count(label_excess_o2o_20d)]) AS value FROM ev",
)

# Models
FOLDS = [(f"f{y}", y, y + 1, y + 2, y + 3) for y in range(1995, 1999)]


def folds(s: SparkSession) -> DataFrame:
    return s.createDataFrame(FOLDS, "fold string, train_from int, train_to int, validation int, test int")


def assigned(s: SparkSession, d: str) -> DataFrame:
    rows = labelled(s, d).select(F.col("trade_date").alias("signal_date"), "security_id", F.col("label_end_date_1d").alias("label_end_date"), F.col("label_excess_o2o_1d").alias("y")).where("y is not null")
    return labels.fold_assignments(rows, folds(s))


def fold_features(s: SparkSession, d: str) -> DataFrame:
    """Fold rows with ``w``, the train weights, and all cleaned features: as an array ``x``, and as columns, which cost nothing unless they are used.

    A row's folds go through the features as one list and are told apart at the end: wide rows are stored once, raw, and neither shuffled nor
    copied for folds before they are used.
    """
    p = base(s, d)
    rows = labels.forward_labels(research_of(p), sources.benchmark(p), (1,)).select(F.col("trade_date").alias("signal_date"), "security_id", F.col("label_end_date_1d").alias("label_end_date"), F.col("label_excess_o2o_1d").alias("y")).where("y is not null")
    rows = written(labels.fold_assignments(rows, folds(s)), "assigned")
    own = tree_track.date_weights(rows).groupBy(F.col("signal_date").alias("trade_date"), "security_id").agg(F.first("y").alias("y"), F.collect_list(F.struct("fold", "role", "label_end_date", "w")).alias("folds"))
    raw = written(rolling.all_features(p.join(own, labels.KEYS, "left"), ("y", "folds"), packed=True), "features")
    x = wide.preprocess(raw, ALL, "trade_date", listed=True).withColumnRenamed("trade_date", "signal_date").where("folds is not null")
    rows = x.select("signal_date", "security_id", "y", F.explode("folds").alias("_f"), "x").select("_f.*", "signal_date", "security_id", "y", "x")
    return rows.select("*", *(F.col("x")[k].alias(n) for k, n in enumerate(ALL)))


def _train(rows: DataFrame) -> DataFrame:
    return rows.where("role = 'train'")


def _coefficients(rows: DataFrame) -> DataFrame:
    return models.ridge(_train(rows), ALL, "y", "w")


def _validated(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    scored_rows = models.predict_linear(rows.where("role = 'validation'").select("fold", "signal_date", "y", "x"), coefficients, ALL)
    ics = cross_section.rank_ic(scored_rows, "score", "y", "signal_date", "fold", "alpha")
    return evidence.ic_statistics(ics, "rank_ic", ["fold", "alpha"]).withColumnRenamed("mean", "mean_rank_ic").withColumnRenamed("icir", "rank_icir")


def _wide_rows(s: SparkSession, d: str) -> DataFrame:
    return fold_features(s, d)


def ridge_coefficients(s: SparkSession, d: str) -> DataFrame:
    """Ridge on all features, for every fold and penalty."""
    return _coefficients(_wide_rows(s, d))


def ridge_validation(s: SparkSession, d: str) -> DataFrame:
    rows = _wide_rows(s, d)
    return _validated(rows, _coefficients(rows))


def ridge_test(s: SparkSession, d: str) -> DataFrame:
    """Test rows of each fold scored once, raw and neutralized, by the penalty that validation chose."""
    rows = _wide_rows(s, d)
    coefficients = _coefficients(rows)
    chosen = evidence.best_candidates(_validated(rows, coefficients)).select("fold", "alpha")
    found = models.predict_linear(rows.where("role = 'test'").select("fold", "signal_date", "security_id", "y", "x"), coefficients.join(chosen, ["fold", "alpha"]), ALL)
    sizes = industries(s, d).select(F.col("trade_date").alias("signal_date"), "security_id", "size", "industry")
    found = found.select("fold", "signal_date", "security_id", "alpha", "y", "score").join(sizes, ["signal_date", "security_id"], "left")
    return cross_section.neutralize(found, "score", date="signal_date").select("fold", "signal_date", "security_id", "alpha", "y", "score", "neutral_score")


def _tree_rows(s: SparkSession, d: str, z_labels: bool = False) -> DataFrame:
    """Fold rows with a byte per feature; ``z_labels``: train labels as z-scores of their date."""
    p = base(s, d)
    rows = labels.forward_labels(research_of(p), sources.benchmark(p), (1,)).select(F.col("trade_date").alias("signal_date"), "security_id", F.col("label_end_date_1d").alias("label_end_date"), F.col("label_excess_o2o_1d").alias("y")).where("y is not null")
    rows = labels.fold_assignments(rows, folds(s))
    if z_labels:
        train = cross_section.zscore_label(rows.where("role = 'train'").withColumn("_k", F.struct("fold", "signal_date")), "y", "_k").withColumn("y", F.col("label_z")).drop("_k", "label_z")
        rows = train.where("y is not null").unionByName(rows.where("role <> 'train'"))
    return tree_track.fold_rows(p, rows)


def boosted(s: SparkSession, d: str) -> DataFrame:
    """Validation rank IC of every fold and round, by one candidate on all features."""
    return tree_track.fitted(s, d, _tree_rows(s, d), [tree_track.SINGLE]).rounds.select("fold", "iteration", "mean_rank_ic", "rank_icir", "n")


def _single_scores(rows: DataFrame, found: trees.Fitted) -> DataFrame:
    best = trees.best_rounds(found.rounds)
    scores = tree_track.scored(rows, trees.upto(found.trees, best)).join(F.broadcast(best.select("fold", F.col("best_iteration").alias("iteration"))), "fold")
    return scores.select("fold", "signal_date", "security_id", "iteration", "y", "score")


def boosted_test(s: SparkSession, d: str) -> DataFrame:
    """Test rows of each fold scored once, by the trees of the rounds that validation chose."""
    rows = _tree_rows(s, d)
    return _single_scores(rows, tree_track.fitted(s, d, rows, [tree_track.SINGLE]))


def transfer_test(s: SparkSession, d: str) -> DataFrame:
    """The carried-over parameter set, trained on labels standardised per date; rounds chosen on validation, test rows scored once."""
    rows = _tree_rows(s, d, z_labels=True)
    return _single_scores(rows, tree_track.fitted(s, d, rows, [models.TRANSFER]))


def candidate_search(s: SparkSession, d: str) -> DataFrame:
    """Every candidate of the grid for every fold, and the choice of each fold."""
    return tree_track.candidates(s, d, _tree_rows(s, d))


def chosen_test(s: SparkSession, d: str) -> DataFrame:
    """Test rows scored once by each fold's chosen candidate, raw and neutralized."""
    rows = _tree_rows(s, d)
    picked, nodes = tree_track.chosen_trees(s, d, rows)
    found = tree_track.scored(rows, nodes).join(F.broadcast(picked.select("fold", "candidate_id", "best_iteration")), "fold")
    sizes = industries(s, d).select(F.col("trade_date").alias("signal_date"), "security_id", "size", "industry")
    found = found.join(sizes, ["signal_date", "security_id"], "left").withColumn("day", F.struct("fold", "signal_date"))
    return cross_section.neutralize(found, "score", date="day").select("fold", "signal_date", "security_id", "candidate_id", "best_iteration", "y", "score", "neutral_score")


def split_counts(s: SparkSession, d: str) -> DataFrame:
    """Gain and split importances of each fold's chosen candidate, for all features."""
    return trees.importances(tree_track.chosen_trees(s, d, _tree_rows(s, d))[1], ALL)


_FOLD = sql.RP + sql.labels((1,)) + ",\nfs AS (SELECT 'f' || y AS fold, y AS a, y + 1 AS z, y + 2 AS v, y + 3 AS t FROM range(1995, 1999) t(y)),\nfa AS (SELECT fold, trade_date AS signal_date, security_id, label_end_date_1d AS label_end_date, CASE WHEN year(trade_date) BETWEEN a AND z THEN 'train' WHEN year(trade_date) = v THEN 'validation' WHEN year(trade_date) = t THEN 'test' END AS role, v, t FROM lab JOIN fs ON year(trade_date) BETWEEN a AND t WHERE label_excess_o2o_1d IS NOT NULL),\nfb AS (SELECT * FROM fa WHERE (role = 'train' AND year(label_end_date) < v) OR (role = 'validation' AND year(label_end_date) < t) OR role = 'test')"
add(
    "j5_z7_fold_rows",
    lambda s, d: assigned(s, d).select("fold", "role", "signal_date", "security_id", "label_end_date"),
    f"WITH {_FOLD} SELECT fold, role, signal_date, security_id, label_end_date FROM fb",
)
add(
    "v9_purge_gates",
    lambda s, d: contracts.purge_gaps(assigned(s, d)),
    f"WITH {_FOLD}, gg AS (SELECT fold, max(label_end_date) FILTER (role = 'train') AS train_end, min(signal_date) FILTER (role = 'validation') AS validation_start, max(label_end_date) FILTER (role = 'validation') AS validation_end, min(signal_date) FILTER (role = 'test') AS test_start FROM fb GROUP BY fold) SELECT *, train_end < validation_start AND validation_end < test_start AS purged FROM gg",
)
add(
    "v10_fold_years",
    lambda s, d: contracts.fold_coverage(assigned(s, d), folds(s).select("fold", F.col("test").alias("year"))),
    f"WITH {_FOLD}, tt AS (SELECT * FROM fb WHERE role = 'test'), k AS (SELECT signal_date, security_id FROM tt GROUP BY ALL HAVING count(*) > 1) SELECT fs.fold, fs.t AS year, count(DISTINCT year(tt.signal_date)) AS years, count(DISTINCT tt.signal_date) AS dates, coalesce(bool_and(year(tt.signal_date) = fs.t), false) AS expected, count(k.security_id) AS shared_keys FROM fs LEFT JOIN tt ON tt.fold = fs.fold LEFT JOIN k ON k.signal_date = tt.signal_date AND k.security_id = tt.security_id GROUP BY ALL",
)
add("m3_m7_ridge_coefficients", ridge_coefficients)
add("g12_m1_ridge_validation", ridge_validation)
add("m6_ridge_test_scores", ridge_test)
add("m4_boosted_tree_rounds", boosted)
add("m5_boosted_test_scores", boosted_test)
add("m2_g13_candidate_search", candidate_search)
add("m6_tree_test_scores", chosen_test)
add("m7_tree_importances", split_counts)
add("m8_transfer_test_scores", transfer_test)

# Specified operators
SIG = sql.B + ", ss AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS entry_date FROM b), sg AS (SELECT signal_date, entry_date, lead(entry_date) OVER (ORDER BY signal_date) AS exit_date FROM (SELECT max(trade_date) AS signal_date, arg_max_null(entry_date, trade_date) AS entry_date FROM ss GROUP BY date_trunc('quarter', trade_date)))"


def quarterly(s: SparkSession, d: str) -> DataFrame:
    return labels.signal_calendar(P(s, d), "quarter")


add(
    "z1_interval_members",
    on(lambda p: labels.intervals_members(p, p.where("is_member").groupBy("security_id").agg(F.min("trade_date").alias("since"), F.max("trade_date").alias("until"))).select(*labels.KEYS)),
    f"WITH {sql.P}, sp AS (SELECT security_id, min(trade_date) AS since, max(trade_date) AS until FROM p WHERE is_member GROUP BY security_id) SELECT p.trade_date, p.security_id FROM p JOIN sp USING (security_id) WHERE trade_date >= since AND trade_date < until",
)
add("z2_signal_calendar", quarterly, f"WITH {SIG} SELECT * FROM sg")
add(
    "z3_period_labels",
    on(lambda p: labels.weekly_labels(p, labels.signal_calendar(p, "quarter"), sources.benchmark(p))),
    sql.rounded(SIG, "SELECT signal_date, a.security_id, (z.adjusted_open / a.adjusted_open - 1) - (bz.adjusted_open / ba.adjusted_open - 1) AS target_excess_return FROM sg JOIN p a ON a.trade_date = entry_date JOIN p z ON z.trade_date = exit_date AND z.security_id = a.security_id JOIN b ba ON ba.trade_date = entry_date JOIN b bz ON bz.trade_date = exit_date", ["target_excess_return"]),
)
add(
    "z4_z10_as_of",
    lambda s, d: labels.as_of(research(s, d), quarterly(s, d), "traded_amount", 3),
    sql.rounded(
        SIG + ", nb AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS n FROM (SELECT DISTINCT trade_date FROM p WHERE is_member))",
        """SELECT signal_date, security_id, CAST(min(s.n - r.n) AS INTEGER) AS age, arg_max(r.traded_amount, r.n) AS traded_amount FROM sg JOIN nb s ON s.trade_date = signal_date
  JOIN (SELECT security_id, n, traded_amount FROM p JOIN nb USING (trade_date) WHERE is_member AND traded_amount IS NOT NULL) r ON r.n BETWEEN s.n - 3 AND s.n GROUP BY ALL""",
        ["traded_amount"],
    ),
)
add(
    "z5_enough_history",
    lambda s, d: labels.enough_history(P(s, d)).select(*labels.KEYS),
    f"WITH {sql.P} SELECT {KEYS} FROM (SELECT *, row_number() OVER {sql.S} AS i FROM p) WHERE i >= 61",
)
add(
    "z6_base_adjusted",
    # Adjusted volumes are large, so their logarithm is compared.
    lambda s, d: labels.base_adjusted(P(s, d)).withColumn("ln_volume", F.ln("volume")).drop("volume"),
    sql.base_adjusted(KEYS),
)
add(
    "z9_parity",
    on(lambda p: labels.parity(p, p.where("is_member").withColumn("vwap", F.col("adjusted_close")), labels.KEYS, "vwap")),
    f"WITH {sql.P} SELECT count(*) FILTER (is_member) AS both, count(*) FILTER (NOT is_member) AS left_only, CAST(0 AS BIGINT) AS right_only, count(*) FILTER (is_member AND abs(vwap - adjusted_close) > 1e-6) AS apart FROM p",
)
add(
    "z8_active_exposure",
    lambda s, d: portfolio.positions(scored(s, d), 5, 10, 5).where("portfolio = 'top_10'").join(industries(s, d).select(*labels.KEYS, "size", "industry"), labels.KEYS).groupBy("trade_date", "industry").agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.ln("size")).alias("log_size")),
    sql.rounded(sql.portfolios(5, 10) + IND[len(sql.P):], "SELECT hl.trade_date, industry, CAST(sum(w) AS DOUBLE) AS weight, sum(w * ln(size)) AS log_size FROM hl JOIN ind ON ind.trade_date = hl.trade_date AND ind.security_id = hl.security_id WHERE portfolio = 'top_10' GROUP BY ALL", ["weight", "log_size"]),
)

ACTIVE = ["annualized_excess_return", "information_ratio", "log_compounded_return", "trading_cost", "mean_turnover"]
add(
    "z8_active_metrics",
    lambda s, d: portfolio.active_metrics(simulated(s, d, 1)[0], 1).withColumn("log_compounded_return", F.when(F.col("compounded_return") > -1, F.log1p("compounded_return"))).drop("compounded_return"),
    sql.rounded(
        sql.portfolios(1, 10) + """,
az AS (SELECT portfolio, CAST(year(trade_date) AS INTEGER) AS year, CAST(c AS DOUBLE) AS cost_bps, turnover, turnover * c / 10000.0 AS cost, gross_return - turnover * c / 10000.0 AS r FROM nav, (SELECT unnest([0, 10, 20]) AS c) WHERE is_evaluable)""",
        f"SELECT portfolio, cost_bps, year, count(*) AS n_periods, avg(r) * {portfolio.PERIODS[1]} AS annualized_excess_return, avg(r) / nullif(stddev_samp(r), 0) * sqrt({portfolio.PERIODS[1]}) AS information_ratio, CASE WHEN product(1 + r) > 0 THEN ln(product(1 + r)) END AS log_compounded_return, sum(cost) AS trading_cost, CAST(avg(turnover) AS DOUBLE) AS mean_turnover FROM az GROUP BY GROUPING SETS ((portfolio, cost_bps), (portfolio, cost_bps, year))",
        ACTIVE,
    ),
)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Mean rank IC of 5-session reversal per horizon and eligibility, with its robust test."""
    return QUERIES["g7_ic_summary"](s, d)

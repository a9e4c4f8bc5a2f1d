"""The single-factor run on a small panel: bounds, refusals, publishing and its failures."""

import dataclasses
import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import contracts, cross_section, evidence, factors, labels, portfolio
from tidepanel.plans import single_factor
from tidepanel.sources import audit, panel, sinks

PROFILE = single_factor.Profile("1997-01-01", "1998-12-31", (1, 5), top_k=5, locked_years=(1997, 1998), least=5)
LAST = "1998-12-31"


@pytest.fixture(scope="module")
def inputs(spark, small):
    p = sinks.written(panel.panel(spark, small), "panel")
    return single_factor.Inputs(p, panel.membership(p), panel.tradability(p), panel.benchmark(p))


def test_bounds_change_no_score_and_no_label(inputs):
    got = single_factor.evidence_panel(inputs, "REV5", PROFILE)
    whole = labels.research_panel(inputs.daily, inputs.members, inputs.tradable)
    days = got.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("z")).first()
    assert str(days.a) == "1997-01-01" and str(days.z) == "1998-12-01"
    wide = labels.forward_labels(whole, inputs.bench, (1, 5)).where(F.col("trade_date").between("1997-01-01", LAST))
    columns = [*labels.KEYS, "basic_eligible", "entry_date", "label_excess_o2o_1d", "label_end_date_5d", "tradable_next_open"]
    known = wide.select(*columns)
    assert known.count() == got.count() > 0
    # a security that misses sessions after the end has its label past the bound, where the benchmark's date decides anyway
    assert got.select("trade_date", "security_id", "label_excess_o2o_1d").exceptAll(wide.select("trade_date", "security_id", "label_excess_o2o_1d")).count() == 0
    future = dataclasses.replace(inputs, daily=inputs.daily.withColumn("adjusted_close", F.when(F.col("trade_date") > LAST, 1.0).otherwise(F.col("adjusted_close"))))
    score = ["trade_date", "security_id", "directed_score"]
    assert single_factor.evidence_panel(future, "REV5", PROFILE).select(score).exceptAll(got.select(score)).count() == 0
    start = factors.history_start(inputs.daily, "1997-01-01", 5).first().trade_date
    past = factors.leak_free(whole, LAST).where(F.col("trade_date") >= F.lit(start))
    raw = factors.compute(past, "REV5").where("trade_date >= '1997-01-01'")
    want = cross_section.prepare_factor(raw, factors.lookup("REV5").direction).select(score)
    assert want.where("directed_score is not null").count() > 0
    assert want.select("trade_date", "security_id", F.round("directed_score", 9)).exceptAll(got.select("trade_date", "security_id", F.round("directed_score", 9))).count() == 0


def test_run_is_published_once_and_readable(spark, inputs, tmp_path):
    run = single_factor.single_factor(inputs, "REV5", PROFILE, "r1", "2024-01-01T00:00:00Z", baseline=PROFILE)
    root, board = f"{tmp_path}/runs", f"{tmp_path}/board"
    single_factor.publish(run, root, board)
    row = spark.read.json(f"{root}/factor_id=REV5/run_id=r1/manifest").first()
    assert row.artifacts == sorted(single_factor.ARTIFACTS) and row.run_type == "formal" and row.factor_id == "REV5"
    assert row.registry.direction == factors.lookup("REV5").direction and row.date_range.start == "1997-01-01"
    assert row.n_daily_rows == inputs.daily.count() and set(row.inputs.asDict()) == {"daily", "members", "tradable", "bench"}
    for name, table in run.tables.items():
        assert sinks.read_artifact(spark, f"{root}/factor_id=REV5", "r1", name, table.schema).count() == table.count()
    latest = evidence.latest_runs(spark.read.parquet(board)).first()
    daily = run.tables["ic_daily"].where("eligibility = 'basic' and horizon_days = 5").agg(F.avg("rank_ic")).first()[0]
    assert latest.run_id == "r1" and latest.decision == row.decision and latest.mean_rank_ic_5d == pytest.approx(daily)
    with pytest.raises(contracts.ContractError):
        single_factor.publish(run, root, board)
    with pytest.raises(contracts.ContractError):
        sinks.write_bundle(run.tables, f"{root}/factor_id=REV5", "r1")
    audit.require_complete(spark, root, single_factor.ARTIFACTS)
    assert spark.read.parquet(board).count() == 1


def test_a_failed_attempt_exposes_nothing_and_blocks_nothing(spark, tmp_path):
    good = spark.createDataFrame([("a", 1), ("b\nc", 2)], "x string, y int")
    broken = good.withColumn("x", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_bundle({"a": good, "b": broken}, str(tmp_path), "r")
    with pytest.raises(contracts.ContractError):
        sinks.read_artifact(spark, str(tmp_path), "r", "a", good.schema)
    with pytest.raises(contracts.ContractError):
        sinks.write_bundle({"a": good}, str(tmp_path), "r", required=("a", "b"))
    sinks.write_bundle({"a": good, "b": good.limit(0)}, str(tmp_path), "r", required=("b", "a"))
    assert sinks.read_artifact(spark, str(tmp_path), "r", "a", good.schema).count() == 2
    assert sinks.read_artifact(spark, str(tmp_path), "r", "b", good.schema).count() == 0
    assert len([x for x in os.listdir(f"{tmp_path}/run_id=r") if x.startswith("attempt=")]) == 2


def test_refused_runs(inputs):
    for bad in ({"factor_id": "NOPE"}, {"run_id": "../x"}, {"profile": dataclasses.replace(PROFILE, horizons=(1, 1))}, {"profile": dataclasses.replace(PROFILE, end="1990-01-01")}, {"inputs": dataclasses.replace(inputs, daily=inputs.daily.union(inputs.daily))}, {"profile": dataclasses.replace(PROFILE, cost_bps=-1.0)}):
        given = {"inputs": inputs, "factor_id": "REV5", "profile": PROFILE, "run_id": "r", "created_at": "2024-01-01T00:00:00Z"} | bad
        with pytest.raises(contracts.ContractError):
            single_factor.single_factor(**given)
    assert single_factor.run_type(PROFILE, None) == single_factor.run_type(PROFILE, dataclasses.replace(PROFILE, top_k=6)) == "experimental"


def test_fingerprint_ignores_order_and_sees_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, 3)], "x int, y int")
    b = spark.createDataFrame([(None, 1), (2, 3)], "x int, y int")
    assert panel.fingerprint(a).first() == panel.fingerprint(a.orderBy(F.desc("x")).repartition(3)).first()
    assert panel.fingerprint(a).first() != panel.fingerprint(b).first() and panel.fingerprint(a.limit(0)).first().n == 0


def sorts(df):
    """Keys of the sorts in a physical plan, and the plan's text from the top."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    prepared = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Sort [", 1)[1] for line in prepared.split("== Initial Plan ==")[-1].splitlines() if "Sort [" in line], plan


def odd_panel(spark):
    """Ties, nulls, NaN, an infinity, names that leave and return, and a last date without any usable name."""
    rng = np.random.default_rng(5)
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(6)]
    rows = []
    for k, day in enumerate(days):
        for s in range(23):
            score, y = float(rng.integers(0, 6)), float(rng.integers(0, 5)) / 7
            score = None if s == 3 else float("nan") if s == 4 else float("inf") if s == 5 else score
            rows.append((day, f"{s:02d}", score, None if s == 6 else y, y * y - s, bool(rng.random() < 0.9) and k < 5, bool(rng.random() < 0.6) and k < 5, day, day))
    return spark.createDataFrame(rows, "trade_date date, security_id string, directed_score double, label_excess_o2o_1d double, label_excess_o2o_2d double, basic_eligible boolean, tradable_next_open boolean, entry_date date, label_end_date_1d date")


def test_daily_ic_copies_no_row_before_it_sorts(spark):
    p = odd_panel(spark)
    daily = cross_section.evaluate_ic(p, (1, 2))
    keys, plan = sorts(daily)
    assert len(keys) == 3 and all("eligibility" not in k for k in keys)  # the score, and each label once
    assert plan.index("Generate") < plan.rindex("Window")  # rows are dealt to horizons above the windows
    got = {(r.trade_date, r.eligibility, r.horizon_days): r for r in daily.collect()}
    rows = p.toPandas()
    assert len(got) == 6 * 4
    for (day, kind, h), r in got.items():
        x = rows[(rows.trade_date == day) & rows.basic_eligible & (rows.tradable_next_open | (kind == "basic"))]
        x = x[np.isfinite(x.directed_score) & np.isfinite(x[f"label_excess_o2o_{h}d"])]
        s, y = x.directed_score, x[f"label_excess_o2o_{h}d"]
        assert r.n_names == len(x)
        if len(x) >= 3 and s.nunique() > 1 and y.nunique() > 1:
            assert r.pearson_ic == pytest.approx(s.corr(y)) and r.rank_ic == pytest.approx(s.rank().corr(y.rank()))
        else:
            assert r.pearson_ic is None and r.rank_ic is None


def test_positions_sort_a_date_once_and_turnover_follows_names(spark):
    p = odd_panel(spark)
    held = portfolio.positions(p, 1, 4, 3)
    assert sum("directed_score" in k for k in sorts(held)[0]) == 1 and not any("portfolio" in k for k in sorts(held)[0])
    want = {}
    for seq, (_, x) in enumerate(list(p.toPandas().groupby("trade_date")), 1):
        x = x[np.isfinite(x.directed_score) & x.tradable_next_open].sort_values(["directed_score", "security_id"]).security_id.tolist()
        if len(x) < 4:
            continue
        parts = [list(b) for b in np.array_split(x, 3)]
        books = {f"Q{k + 1}": {s: 1 / len(b) for s in b} for k, b in enumerate(parts)} | {"top_4": {s: 0.25 for s in x[-4:]}}
        want[seq] = books | {"top_bottom": {s: 1 / len(parts[2]) for s in parts[2]} | {s: -1 / len(parts[0]) for s in parts[0]}}
    got = {}
    for r in held.collect():
        got.setdefault(r.seq, {}).setdefault(r.portfolio, {})[r.security_id] = r.weight
    assert got == want and len(want) == 5
    known = {(r.seq, r.portfolio): r.turnover for r in portfolio.turnovers(held).collect()}
    for seq, books in want.items():
        for name, now in books.items():
            before = want[seq - 1][name] if seq > 1 else {}
            assert known[seq, name] == pytest.approx(0.5 * sum(abs(now.get(s, 0) - before.get(s, 0)) for s in now | before))


def test_books_of_one_kind_are_those_of_all(spark):
    p = odd_panel(spark)
    for part in (0, 1):
        whole = portfolio.simulate(p, 1, 4, 3)[part].where("portfolio_kind = 'top_k_long'")
        own = portfolio.simulate(p, 1, 4, 3, kinds=("top_k_long",))[part]
        assert own.count() > 0 and sorted(map(str, own.collect())) == sorted(map(str, whole.collect()))


def test_evidence_carries_no_daily_column(inputs):
    got = single_factor.evidence_panel(inputs, "CLOSE_POS5", PROFILE)
    assert not set(got.columns) & {"adjusted_open", "adjusted_high", "volume", "traded_amount"}
    assert got.where("directed_score is not null").count() > 0


def test_lines_are_sorted_by_supplier(spark, small):
    assert all(k.startswith("security_id") for k in sorts(panel.panel(spark, small))[0])

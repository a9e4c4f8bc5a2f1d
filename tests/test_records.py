"""Stored layouts, claims, audits, user factors, canonical JSON and factor cards."""

import datetime
import json
import threading

import pytest
from pyspark.sql import functions as F

from tidepanel.functions.canonical import canonical_json
from tidepanel.operators import evidence, factors, rolling, user_factors
from tidepanel.operators.contracts import ContractError
from tidepanel.sources import audit, layout, panel, sinks

DAY = datetime.date(2020, 1, 1)


def test_year_folders_are_pruned_and_security_windows_need_no_shuffle(spark, small):
    p = panel.panel(spark, small).withColumn("trade_date", F.when(F.col("security_id") == 3, None).otherwise(F.col("trade_date")))
    spark.sql("DROP TABLE IF EXISTS layout_test")
    layout.save_panel(p, "layout_test", 3)
    late = layout.read_panel(spark, "layout_test", since=1998, until=1999)
    rows = rolling.rolling_features(late, ["ma", "std"], (5, 20))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if x.startswith("PartitionFilters"))
    assert "Exchange" not in plan and "Window" in plan and "year" in scan and "1998" in scan and "1999" in scan
    whole = rolling.rolling_features(p.where("year(trade_date) between 1998 and 1999"), ["ma", "std"], (5, 20))
    assert sorted(map(str, rows.collect())) == sorted(map(str, whole.collect())) and rows.count() > 0
    assert layout.read_panel(spark, "layout_test").count() == p.count()  # rows without a date are kept
    with pytest.raises(Exception, match="already exists"):
        layout.save_panel(p, "layout_test", 3)
    spark.sql("DROP TABLE layout_test")


def test_two_writers_of_one_run(spark, tmp_path):
    row = spark.createDataFrame([("F", "r1", 0.5)], "factor_id string, run_id string, x double")
    other = spark.createDataFrame([("F", "r2", 0.25)], "factor_id string, run_id string, x double")
    board, errors, ready = f"{tmp_path}/board", [], threading.Barrier(4)

    def add(rows):
        ready.wait()
        try:
            sinks.append_run(rows, board)
        except ContractError as e:
            errors.append(str(e))

    writers = [threading.Thread(target=add, args=(x,)) for x in (row, row, row, other)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(r.run_id for r in spark.read.parquet(board).collect()) == ["r1", "r2"] and len(errors) == 2
    with pytest.raises(ContractError):
        sinks.append_run(row, board)
    broken = row.withColumn("run_id", F.lit("r3")).withColumn("x", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sinks.append_run(broken, board)
    sinks.append_run(row.withColumn("run_id", F.lit("r3")), board)  # the claim was given back
    with pytest.raises(ContractError, match="ids are letters"):
        sinks.append_run(row.withColumn("run_id", F.lit("../x")), board)
    assert sinks.claim(spark, f"{tmp_path}/m/x") and not sinks.claim(spark, f"{tmp_path}/m/x")


def test_catalog_mirror_sees_rows_appended_since(spark, tmp_path):
    row = spark.createDataFrame([("F", "r1")], "factor_id string, run_id string")
    sinks.append_run(row, f"{tmp_path}/board")
    spark.sql("DROP TABLE IF EXISTS board_mirror")
    assert sinks.mirror(spark, f"{tmp_path}/board", "board_mirror").count() == 1
    sinks.append_run(row.withColumn("run_id", F.lit("r2")), f"{tmp_path}/board")
    sinks.mirror(spark, f"{tmp_path}/board", "board_mirror")
    assert spark.newSession().sql("SELECT count(*) AS n FROM board_mirror WHERE factor_id = 'F'").first().n == 2
    with pytest.raises(ContractError, match="another table"):
        sinks.mirror(spark, f"{tmp_path}/elsewhere", "board_mirror")
    spark.sql("DROP TABLE board_mirror")
    assert spark.read.parquet(f"{tmp_path}/board").count() == 2  # the rows are not the catalog's


def test_audit_finds_what_is_wrong_with_a_run(spark, tmp_path):
    table, root = spark.createDataFrame([(1, "x")], "a int, b string"), f"{tmp_path}/runs"
    bundle = lambda factor, run, names, says=None: sinks.write_bundle({n: table for n in names}, f"{root}/factor_id={factor}", run, spark.createDataFrame([says or (factor, run)], "factor_id string, run_id string"))
    bundle("A", "good", ["nav", "ic"])
    bundle("A", "lacks", ["nav"])
    bundle("A", "more", ["nav", "ic", "note"])
    bundle("B", "foreign", ["nav", "ic"], ("A", "foreign"))
    bundle("B", "renamed", ["nav", "ic"], ("B", "other"))
    bundle("B", "headless", ["nav", "ic"])
    sinks.remove(spark, f"{root}/factor_id=B/run_id=headless/manifest")
    bundle("B", "stripped", ["nav", "ic"])
    attempt = spark.read.json(f"{root}/factor_id=B/run_id=stripped/manifest").first().attempt
    sinks.remove(spark, f"{root}/factor_id=B/run_id=stripped/attempt={attempt}/ic")
    table.write.csv(f"{root}/factor_id=A/run_id=good/attempt=failed/ic")  # an attempt that no manifest names
    bundle("C", "odd.name", ["nav", "ic"])
    got = {(r.factor_id, r.run_id): r for r in audit.run_audit(spark, root, ("ic", "nav")).collect()}
    assert {k for k, r in got.items() if r.complete} == {("A", "good")} and len(got) == 8
    assert got["A", "lacks"].missing == ["ic"] and got["A", "lacks"].undeclared
    assert got["A", "more"].extra == ["note"] and got["A", "more"].undeclared and not got["A", "more"].missing
    assert got["B", "foreign"].foreign and not got["B", "foreign"].undeclared and got["B", "renamed"].foreign
    assert got["B", "headless"].n_manifests == 0 and got["B", "headless"].missing == ["ic", "nav"]
    assert got["B", "stripped"].missing == ["ic"] and not got["B", "stripped"].undeclared
    assert got["C", "odd.name"].unsafe
    with pytest.raises(ContractError, match="is not complete"):
        audit.require_complete(spark, root, ("ic", "nav"))
    audit.require_complete(spark, f"{root}/factor_id=A/run_id=good", ("ic", "nav"))


def test_user_factor_equals_the_built_in_one(spark, small):
    p = panel.panel(spark, small)
    table = factors.registry(spark).where("factor_id = 'REV5'")
    mine = lambda rows: rows.assign(raw_value=rows["adjusted_close"] / rows["adjusted_close"].shift(5) - 1)
    made = user_factors.compute(p.repartition(7), table, "REV5", {"REV5": user_factors.UserFactor(mine, ("trade_date", "security_id", "adjusted_close", "raw_value"))})
    rounded = lambda df: sorted((str(r[0]), r[1], None if r[2] is None else round(r[2], 9)) for r in df.collect())
    assert made.columns == list(user_factors.OUTPUT) and rounded(made) == rounded(factors.compute(p, "REV5"))
    assert user_factors.compute(p.limit(0), table, "REV5", {"REV5": user_factors.UserFactor(mine)}).count() == 0


def test_user_factors_are_checked_before_they_run(spark):
    p = spark.createDataFrame([(DAY, "a", 1.0), (DAY, None, 2.0), (None, "a", float("nan"))], "trade_date date, security_id string, adjusted_close double")
    table = spark.createDataFrame([("A", "positive", "adjusted_close", "x"), ("B", "up", "adjusted_close", "x"), ("C", "negative", "", "x"), ("C", "negative", "", "x"), ("D", "negative", " volume ; ", "x")], user_factors.REGISTRY)
    same = user_factors.UserFactor(lambda rows: rows.assign(raw_value=rows.iloc[:, -1]))
    ran = []
    lying = user_factors.UserFactor(lambda rows: ran.append(1) or rows)
    lacking = user_factors.UserFactor(lambda rows: rows, ("trade_date", "security_id"))
    assert user_factors.definition(table, "A") == user_factors.Definition("A", "positive", ("adjusted_close",), "x")
    assert sorted(map(str, user_factors.compute(p, table, "A", {"A": same}).collect())) == sorted(["Row(trade_date=None, security_id='a', raw_value=None)", "Row(trade_date=datetime.date(2020, 1, 1), security_id='a', raw_value=1.0)", "Row(trade_date=datetime.date(2020, 1, 1), security_id=None, raw_value=2.0)"])
    for name in ("B", "C", "E"):
        with pytest.raises(ContractError):
            user_factors.compute(p, table, name, {name: same})
    with pytest.raises(ContractError, match="bound"):
        user_factors.compute(p, table, "A", {})
    with pytest.raises(Exception, match="returns no"):  # at analysis: nothing is collected
        user_factors.compute(p, table, "A", {"A": lacking})
    with pytest.raises(Exception, match="needs the columns"):
        user_factors.compute(p, table, "D", {"D": same})
    with pytest.raises(Exception, match="returned no"):
        user_factors.compute(p, table, "A", {"A": lying}).collect()


def test_canonical_json_is_pythons(spark):
    kind = "z int, a struct<n: string, b: array<struct<y: double, x: boolean>>, m: map<string, array<bigint>>>, `é k` double, f array<double>"
    rows = [
        (1, ('q"\\/\n\té😀', [(1.5, True), None, (None, False)], {"b": [1, None], "a": [], "B": None}), 0.1, [0.0, -0.0, 1e7, 123456789.125, 1e15, 1e16, 1.5e300, 1e-4, 0.00025, 1e-5, 1.25e-7, -2.5e20, 100.0, 0.001]),
        (None, None, float("nan"), [float("inf"), float("-inf"), None]),
        (-5, (None, [], {}), None, None),
    ]
    table = spark.createDataFrame(rows, kind)
    whole = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    got = [r[0] for r in table.select(canonical_json(whole, table.select(whole.alias("x")).schema["x"].dataType)).collect()]

    def plain(x):
        if isinstance(x, tuple) and hasattr(x, "asDict"):
            return {k: plain(v) for k, v in x.asDict().items()}
        return [plain(v) for v in x] if isinstance(x, list) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x

    assert got == [json.dumps(plain(r), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in table.collect()]


def test_cards_of_the_latest_formal_runs(spark):
    kind = "factor_id string, run_id string, run_type string, created_at string, mean_rank_ic_5d double, tradable_mean_rank_ic_20d double, n_observations_1d long, top_k_gross_sharpe_5d double, top_k_net_max_drawdown_1d double, top_k_mean_turnover_20d double, note string"
    rows = [("F", "r1", "formal", "2024-01-01T00:00:00Z", *[1.0, 2.0, 3, 4.0, 5.0, 6.0], "x"), ("F", "r2", "formal", "2024-01-02T00:00:00+09:00", *[10.0, None, 30, 40.0, 50.0, 60.0], "x"), ("F", "r9", "experimental", "nonsense", *[0.0] * 2, 0, *[0.0] * 3, "x")]
    board = spark.createDataFrame(rows, kind)
    got = {(r.part, r.horizon_days, r.kind, r.metric): r.value for r in evidence.factor_cards(board).collect()}
    assert got == {
        ("ic", 5, "basic", "mean_rank_ic"): 10.0, ("ic", 20, "tradable", "mean_rank_ic"): None, ("ic", 1, "basic", "n_observations"): 30.0,
        ("portfolio", 5, "gross", "sharpe"): 40.0, ("portfolio", 1, "net", "max_drawdown"): 50.0, ("portfolio", 20, "both", "mean_turnover"): 60.0,
    }
    tied = board.where("run_id <> 'r9'").withColumn("created_at", F.lit("2024-05-05"))
    assert {r.run_id for r in evidence.latest_runs(tied).collect()} == {"r2"}
    for bad in ("soon", None):
        with pytest.raises(ContractError, match="no time of creation"):
            evidence.latest_runs(board.withColumn("created_at", F.lit(bad).cast("string")))

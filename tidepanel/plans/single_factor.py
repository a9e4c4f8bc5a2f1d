"""One factor from the panel to published evidence: bounds, labels, IC, portfolios, decision, manifest, scoreboard."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import contracts, cross_section, evidence, factors, labels, portfolio
from tidepanel.sources import panel as sources
from tidepanel.sources import sinks

RUN = ["factor_id", "run_id"]
#: The tables of a run's bundle.
ARTIFACTS = ("data_quality", "ic_summary", "ic_daily", "portfolio_summary", "nav")


@dataclass(frozen=True)
class Profile:
    """What a run is evaluated by; ``locked_years`` and ``least`` bear on the decision alone."""

    start: str
    end: str
    horizons: tuple[int, ...] = (1, 5, 20)
    top_k: int = 50
    quantiles: int = 5
    cost_bps: float = 10.0
    locked_years: tuple[int, ...] = (2020, 2021, 2022, 2023, 2024)
    least: int = 500


@dataclass(frozen=True)
class Inputs:
    """Daily panel, membership and tradability by (date, security), benchmark by date."""

    daily: DataFrame
    members: DataFrame
    tradable: DataFrame
    bench: DataFrame


@dataclass(frozen=True)
class Run:
    """Tables of the bundle by name, one manifest row, one scoreboard row."""

    tables: dict[str, DataFrame]
    manifest: DataFrame
    board: DataFrame


def run_type(profile: Profile, baseline: Profile | None) -> str:
    """``formal`` for the registered baseline profile alone, else ``experimental``."""
    return "formal" if baseline is not None and profile == baseline else "experimental"


def checked(inputs: Inputs, factor_id: str, profile: Profile) -> None:
    """Refuse parameters and tables that break their contracts, before any work."""
    definition = factors.lookup(factor_id)
    contracts.valid_horizons(profile.horizons)
    for h in profile.horizons:
        contracts.valid_portfolio(h, profile.top_k, profile.quantiles, profile.cost_bps)
    if profile.start > profile.end:
        raise contracts.ContractError(f"the run ends before it starts: {profile.start}, {profile.end}")
    own = [c for c in definition.fields if c != "market_return"]
    contracts.require_columns(inputs.daily, [*labels.KEYS, "adjusted_open", *own])
    for table in (inputs.daily, inputs.members, inputs.tradable):
        contracts.require_unique(table, labels.KEYS)
    contracts.require_unique(inputs.bench, ["trade_date"])


def evidence_panel(inputs: Inputs, factor_id: str, profile: Profile) -> DataFrame:
    """Signal rows from start to end: eligibility, labels and the directed score.

    Rows before the start serve the factor's lookback, rows after the end the labels; both are found on the
    calendars and pushed into the scans as date bounds.  No row after the end reaches the factor.  Of the daily columns, those
    that the labels and the factor read go through the joins, and none of them into the result.
    """
    spark = inputs.daily.sparkSession
    sessions = factors.lookback(factors.registry(spark)).where(F.col("factor_id") == factor_id).first().sessions
    since = factors.history_start(inputs.daily, profile.start, sessions).first().trade_date or profile.start
    until = factors.label_end(inputs.bench, profile.end, max(profile.horizons)).first().trade_date or profile.end
    own = [c for c in factors.lookup(factor_id).fields if c != "market_return"]
    daily = inputs.daily.select(*dict.fromkeys([*labels.KEYS, "adjusted_open", *own]))
    rows = sinks.written(labels.research_panel(daily, inputs.members, inputs.tradable, str(since), str(until)), "research")
    signal = F.col("trade_date").between(F.lit(profile.start).cast("date"), F.lit(profile.end).cast("date"))
    past = sources.with_market_return(factors.leak_free(rows, profile.end), inputs.bench)
    raw = factors.compute(past, factor_id).where(signal)
    score = cross_section.prepare_factor(raw, factors.lookup(factor_id).direction).select(*labels.KEYS, "directed_score")
    known = rows.select(*labels.KEYS, "adjusted_open", "tradable_next_open", "basic_eligible")
    return labels.forward_labels(known, inputs.bench, profile.horizons).drop("adjusted_open").where(signal).join(score, labels.KEYS, "left")


def _horizons(rows: DataFrame, profile: Profile, part: int) -> DataFrame:
    each = [portfolio.simulate(rows, h, profile.top_k, profile.quantiles, profile.cost_bps)[part].withColumn("horizon_days", F.lit(h)) for h in profile.horizons]
    return contracts.union_all(each)


def single_factor(inputs: Inputs, factor_id: str, profile: Profile, run_id: str, created_at: str, baseline: Profile | None = None) -> Run:
    """The whole run.  Its evidence panel and daily ICs are stored once and read by all tables.

    ``created_at`` is the caller's, so that a rerun gives equal rows.
    """
    spark = inputs.daily.sparkSession
    ids = spark.createDataFrame([(factor_id,), (run_id,)], "id string")
    if contracts.unsafe_ids(ids, "id").limit(1).count():
        raise contracts.ContractError(f"ids are letters, digits, underscores and hyphens: {factor_id}, {run_id}")
    checked(inputs, factor_id, profile)
    rows = sinks.written(evidence_panel(inputs, factor_id, profile), "evidence")
    numbers = ["directed_score", *(f"label_excess_o2o_{h}d" for h in profile.horizons)]
    rows = contracts.portfolio_panel(rows, numbers, ["entry_date", *(f"label_end_date_{h}d" for h in profile.horizons)])
    daily = sinks.written(cross_section.evaluate_ic(rows, profile.horizons), "ic")
    summary = evidence.with_p_value(evidence.ic_summary(daily))
    books = sinks.written(_horizons(rows, profile, 1), "books")
    if contracts.same_turnover(books).limit(1).count():
        raise contracts.ContractError("gross and net rows disagree on turnover")
    decision = evidence.decide(daily, list(profile.locked_years), profile.least).first().decision
    kind = run_type(profile, baseline)
    tables = dict(zip(ARTIFACTS, (evidence.run_quality(rows, profile.horizons), summary, daily, books, _horizons(rows, profile, 0)), strict=True))
    of_run = {"factor_id": F.lit(factor_id), "run_id": F.lit(run_id)}
    board = evidence.scoreboard_row(summary.withColumns(of_run), books.withColumns(of_run), RUN, profile.horizons)
    board = board.withColumns({"run_type": F.lit(kind), "decision": F.lit(decision), "created_at": F.lit(created_at).cast("timestamp")})
    return Run(tables, manifest(inputs, factor_id, profile, run_id, created_at, decision, kind), board)


def manifest(inputs: Inputs, factor_id: str, profile: Profile, run_id: str, created_at: str, decision: str, kind: str) -> DataFrame:
    """One row: identity, decision, registered definition, profile, fingerprints of the inputs, artifacts."""
    spark = inputs.daily.sparkSession
    definition = factors.registry(spark).where(F.col("factor_id") == factor_id)
    prints = {name: sources.fingerprint(table).first().asDict() for name, table in vars(inputs).items()}
    marks = F.create_map(*(F.lit(x) for name in sorted(prints) for x in (name, prints[name]["fingerprint"])))
    return definition.select(
        F.lit(1).alias("schema_version"),
        F.lit(run_id).alias("run_id"),
        F.lit(factor_id).alias("factor_id"),
        F.lit(created_at).alias("created_at"),
        F.lit(decision).alias("decision"),
        F.lit(kind).alias("run_type"),
        F.struct(F.lit(profile.start).alias("start"), F.lit(profile.end).alias("end")).alias("date_range"),
        F.struct(*definition.columns).alias("registry"),
        F.lit(json.dumps(asdict(profile), sort_keys=True)).alias("profile"),
        F.lit(prints["daily"]["n"]).alias("n_daily_rows"),
        marks.alias("inputs"),
    )


def publish(run: Run, root: str, scoreboard: str) -> None:
    """Bundle first, verified before its manifest; the scoreboard row last, refused if the run is there already."""
    sinks.refuse_known_runs(run.board, scoreboard, RUN)
    row = run.manifest.first()
    sinks.write_bundle(run.tables, f"{root.rstrip('/')}/factor_id={row.factor_id}", row.run_id, run.manifest, ARTIFACTS)
    sinks.append_run(run.board, scoreboard, tuple(RUN))

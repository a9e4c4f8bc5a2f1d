"""Factors of users: Python functions over one security's series, bound to a registry table and checked before they run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from tidepanel.operators.contracts import ContractError, require_columns

OUTPUT = ("trade_date", "security_id", "raw_value")
REGISTRY = "factor_id string, direction string, required_fields string, formula string"


@dataclass(frozen=True)
class UserFactor:
    """``compute`` takes the rows of one security in order of date and returns rows with the columns ``outputs``."""

    compute: Callable[[pd.DataFrame], pd.DataFrame]
    outputs: tuple[str, ...] = OUTPUT


@dataclass(frozen=True)
class Definition:
    factor_id: str
    direction: str
    fields: tuple[str, ...]
    formula: str


def definition(registry: DataFrame, factor_id: str) -> Definition:
    """The one row of ``registry(factor_id, direction, required_fields, formula)`` with this id; none, several or an unknown direction are refused.

    ``required_fields`` are names between semicolons.
    """
    require_columns(registry, [f.name for f in T._parse_datatype_string(REGISTRY)])
    rows = registry.where(F.col("factor_id") == factor_id).limit(2).collect()
    if len(rows) != 1:
        raise ContractError(f"{factor_id} has {'several rows' if rows else 'no row'} in the registry")
    r = rows[0]
    if r.direction not in ("positive", "negative"):
        raise ContractError(f"{factor_id} has the direction {r.direction!r}")
    return Definition(factor_id, r.direction, tuple(x.strip() for x in (r.required_fields or "").split(";") if x.strip()), r.formula)


def _table_function(of: Definition, factor: UserFactor):
    """A table function over a panel dealt by security and ordered by date; only the needed columns are sent to it."""

    class Series:
        def __init__(self) -> None:
            self.rows: list = []

        @staticmethod
        def analyze(panel: AnalyzeArgument) -> AnalyzeResult:
            kinds = {f.name: f.dataType for f in panel.dataType.fields}
            needed = list(dict.fromkeys([*OUTPUT[:2], *of.fields]))
            if lacking := sorted(set(needed) - set(kinds)):
                raise ValueError(f"{of.factor_id} needs the columns {lacking}")
            if lacking := sorted(set(OUTPUT) - set(factor.outputs)):
                raise ValueError(f"{of.factor_id} returns no {lacking}")
            schema = T.StructType([T.StructField("trade_date", kinds["trade_date"]), T.StructField("security_id", kinds["security_id"]), T.StructField("raw_value", T.DoubleType())])
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn("security_id")], orderBy=[OrderingColumn("trade_date")], select=[SelectedColumn(c) for c in needed])

        def eval(self, row: T.Row) -> None:
            self.rows.append(row.asDict())

        def terminate(self) -> Iterator[tuple]:
            out = factor.compute(pd.DataFrame(self.rows))
            if not isinstance(out, pd.DataFrame) or (lacking := sorted(set(OUTPUT) - set(out.columns))):
                raise ValueError(f"{of.factor_id} returned {type(out).__name__ if not isinstance(out, pd.DataFrame) else f'no {lacking}'}")
            for day, security, value in zip(out["trade_date"], out["security_id"], out["raw_value"], strict=True):
                yield day, security, None if pd.isna(value) or abs(value) == float("inf") else float(value)

    return Series


def compute(panel: DataFrame, registry: DataFrame, factor_id: str, factors: dict[str, UserFactor]) -> DataFrame:
    """``trade_date, security_id, raw_value`` by the user's function that is registered as ``factor_id``.

    Columns of the panel and declared outputs are checked before a row is read, returned tables when they come; NaN and infinities are NULL.
    A security's rows are one task's, ordered by date; an empty panel gives an empty table.
    """
    of = definition(registry, factor_id)
    if factor_id not in factors:
        raise ContractError(f"no function is bound to {factor_id}")
    return F.udtf(_table_function(of, factors[factor_id]))(panel.asTable())

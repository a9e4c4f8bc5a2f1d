"""The table that describes the 158 features: expression, operator, family, window, inputs, meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators.rolling import WINDOWS

# Name | expression | operator | family | window | inputs | interpretation.
# A name that ends in <d> stands for one feature per window d.
FEATURES = """
KMID | ($close-$open)/$open | KMID | candlestick | 1 | open,close | intraday body return
KLEN | ($high-$low)/$open | KLEN | candlestick | 1 | open,high,low | intraday range
KMID2 | ($close-$open)/($high-$low+1e-12) | KMID2 | candlestick | 1 | open,high,low,close | body relative to range
KUP | ($high-Greater($open, $close))/$open | KUP | candlestick | 1 | open,high,close | upper shadow relative to open
KUP2 | ($high-Greater($open, $close))/($high-$low+1e-12) | KUP2 | candlestick | 1 | open,high,low,close | upper shadow relative to range
KLOW | (Less($open, $close)-$low)/$open | KLOW | candlestick | 1 | open,low,close | lower shadow relative to open
KLOW2 | (Less($open, $close)-$low)/($high-$low+1e-12) | KLOW2 | candlestick | 1 | open,high,low,close | lower shadow relative to range
KSFT | (2*$close-$high-$low)/$open | KSFT | candlestick | 1 | open,high,low,close | close displacement from range midpoint
KSFT2 | (2*$close-$high-$low)/($high-$low+1e-12) | KSFT2 | candlestick | 1 | open,high,low,close | normalized close displacement
OPEN0 | $open/$close | OPEN | price_ratio | 0 | open,close | open-to-close ratio
HIGH0 | $high/$close | HIGH | price_ratio | 0 | high,close | high-to-close ratio
LOW0 | $low/$close | LOW_PRICE | price_ratio | 0 | low,close | low-to-close ratio
VWAP0 | $vwap/$close | VWAP | price_ratio | 0 | vwap,close | VWAP-to-close ratio
ROC<d> | Ref($close, <d>)/$close | ROC | trend | <d> | close | past-to-current price ratio
MA<d> | Mean($close, <d>)/$close | MA | trend | <d> | close | moving-average distance
STD<d> | Std($close, <d>)/$close | STD | volatility | <d> | close | normalized price volatility
BETA<d> | Slope($close, <d>)/$close | BETA | trend | <d> | close | normalized linear trend slope
RSQR<d> | Rsquare($close, <d>) | RSQR | trend_quality | <d> | close | linearity of the price trend
RESI<d> | Resi($close, <d>)/$close | RESI | trend_quality | <d> | close | normalized trend residual
MAX<d> | Max($high, <d>)/$close | MAX | price_location | <d> | high,close | distance to rolling high
MIN<d> | Min($low, <d>)/$close | LOW | price_location | <d> | low,close | distance to rolling low
QTLU<d> | Quantile($close, <d>, 0.8)/$close | QTLU | price_location | <d> | close | distance to upper close quantile
QTLD<d> | Quantile($close, <d>, 0.2)/$close | QTLD | price_location | <d> | close | distance to lower close quantile
RANK<d> | Rank($close, <d>) | RANK | price_location | <d> | close | current close percentile in its window
RSV<d> | ($close-Min($low, <d>))/(Max($high, <d>)-Min($low, <d>)+1e-12) | RSV | price_location | <d> | close,high,low | close location within the rolling high-low range
IMAX<d> | IdxMax($high, <d>)/<d> | IMAX | timing | <d> | high | recency of rolling high
IMIN<d> | IdxMin($low, <d>)/<d> | IMIN | timing | <d> | low | recency of rolling low
IMXD<d> | (IdxMax($high, <d>)-IdxMin($low, <d>))/<d> | IMXD | timing | <d> | high,low | relative timing of recent high and low
CORR<d> | Corr($close, Log($volume+1), <d>) | CORR | price_volume | <d> | close,volume | price-level and log-volume correlation
CORD<d> | Corr($close/Ref($close,1), Log($volume/Ref($volume, 1)+1), <d>) | CORD | price_volume | <d> | close,volume | price-ratio and volume-ratio correlation
CNTP<d> | Mean($close>Ref($close, 1), <d>) | CNTP | directional | <d> | close | share of up days
CNTN<d> | Mean($close<Ref($close, 1), <d>) | CNTN | directional | <d> | close | share of down days
CNTD<d> | Mean($close>Ref($close, 1), <d>)-Mean($close<Ref($close, 1), <d>) | CNTD | directional | <d> | close | up-day minus down-day share
SUMP<d> | Sum(Greater($close-Ref($close, 1), 0), <d>)/(Sum(Abs($close-Ref($close, 1)), <d>)+1e-12) | SUMP | momentum | <d> | close | positive price change share
SUMN<d> | Sum(Greater(Ref($close, 1)-$close, 0), <d>)/(Sum(Abs($close-Ref($close, 1)), <d>)+1e-12) | SUMN | momentum | <d> | close | negative price change share
SUMD<d> | (Sum(Greater($close-Ref($close, 1), 0), <d>)-Sum(Greater(Ref($close, 1)-$close, 0), <d>))/(Sum(Abs($close-Ref($close, 1)), <d>)+1e-12) | SUMD | momentum | <d> | close | signed price-change balance
VMA<d> | Mean($volume, <d>)/($volume+1e-12) | VMA | volume | <d> | volume | volume moving-average distance
VSTD<d> | Std($volume, <d>)/($volume+1e-12) | VSTD | volume | <d> | volume | normalized volume volatility
WVMA<d> | Std(Abs($close/Ref($close, 1)-1)*$volume, <d>)/(Mean(Abs($close/Ref($close, 1)-1)*$volume, <d>)+1e-12) | WVMA | price_volume | <d> | close,volume | dispersion of volume-weighted absolute returns
VSUMP<d> | Sum(Greater($volume-Ref($volume, 1), 0), <d>)/(Sum(Abs($volume-Ref($volume, 1)), <d>)+1e-12) | VSUMP | volume | <d> | volume | positive volume-change share
VSUMN<d> | Sum(Greater(Ref($volume, 1)-$volume, 0), <d>)/(Sum(Abs($volume-Ref($volume, 1)), <d>)+1e-12) | VSUMN | volume | <d> | volume | negative volume-change share
VSUMD<d> | (Sum(Greater($volume-Ref($volume, 1), 0), <d>)-Sum(Greater(Ref($volume, 1)-$volume, 0), <d>))/(Sum(Abs($volume-Ref($volume, 1)), <d>)+1e-12) | VSUMD | volume | <d> | volume | signed volume-change balance
"""

SCHEMA = "position int, name string, expression string, operator string, family string, window int, required_inputs string, economic_interpretation string, expected_direction string"


def records() -> list[tuple]:
    """A tuple per feature, in the order of ``rolling.feature_names()``; none has a direction from the start."""
    rows = []
    for line in FEATURES.strip().splitlines():
        for d in WINDOWS if "<d>" in line else (None,):
            name, expression, operator, family, window, inputs, meaning = (x.strip() for x in line.replace("<d>", str(d)).split(" | "))
            rows.append((len(rows) + 1, name, expression, operator, family, int(window), inputs, meaning, "not_preassigned"))
    return rows


def catalog(spark: SparkSession) -> DataFrame:
    """One row per feature."""
    return spark.createDataFrame(records(), SCHEMA)


def described(counts: DataFrame) -> DataFrame:
    """``column, violations`` of features with what the catalog says of them; a column that it lacks is left with nulls."""
    about = F.broadcast(catalog(counts.sparkSession).withColumn("column", F.lower("name")))  # 158 rows
    return counts.join(about, "column", "left")

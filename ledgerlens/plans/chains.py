"""End-to-end compositions (the reference's pipeline stages), all lazy.

* ``engineer_features`` (FEA-15): ratios -> procurement -> temporal (+ WIN-2
  volatility) -> HR -> risk flags -> size risk -> group z-scores and
  percentile ranks -> interactions -> zero fill.
* ``training_table``: CLN-12 and FEA-15 in our order (features on raw
  values, scaling last; ``reference_order=True`` scales first, quirk Q6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlens.operators import clean as CL, features as FE, ordered as OR


def engineer_features(df: DataFrame, base_year: int = 2020, recent_year: int = 2022,
                      percentile_ranks: bool = True) -> DataFrame:
    """FEA-15: the feature chain, schema-conditional at every step."""
    d = FE.financial_ratios(df)
    d = FE.procurement_indicators(d)
    d = FE.temporal_flags(d, base_year, recent_year)
    if "entity_name" in d.columns:
        d = OR.volatility(d)
    d = FE.payroll_features(d)
    d = FE.risk_flags(d)
    d = FE.size_risk(d)
    d = OR.zscore_within_group(d)
    if percentile_ranks:
        d = OR.percentile_ranks(d)
    d = FE.interactions(d)
    return CL.zero_fill(d)


def training_table(df: DataFrame, base_year: int = 2020, recent_year: int = 2022,
                   reference_order: bool = False) -> DataFrame:
    """Preprocess + features.  Default: impute, name features, lags,
    outliers, encode, then features on raw values, then scale and zero
    fill.  ``reference_order`` reproduces preprocess-then-features."""
    if reference_order:
        return engineer_features(CL.preprocess(df), base_year, recent_year)
    d = CL.impute_median(df)
    d = CL.impute_mode(d)
    d = CL.entity_name_features(d)
    if "year" in d.columns and "entity_name" in d.columns:
        d = OR.lag_features(d)
    d = CL.flag_outliers(d, method="iqr")
    d = engineer_features(d, base_year, recent_year)
    d = CL.encode_categoricals(d)
    d = CL.standard_scale(d)
    return CL.zero_fill(d)

"""Registered ingest, cleaning, join and risk-report queries (ING-*, CLN-*, JON-*, MLT-7/8)."""

import uuid

from pyspark.sql import functions as F

from ledgerlens.functions import rules as RL
from ledgerlens.operators import clean as CL, fitted as FT, ingest as IN, joins as JN, risk as RK
from ledgerlens.operators.filters import with_inferred_type
from ledgerlens.plans import sqlgen as S
from ledgerlens.plans.oracle_fixtures import CFG, EY, EYX, LOG, PRED, USR, with_
from ledgerlens.plans.registry import register
from ledgerlens.sources import fixtures as fx, io as IO

r = S.r
KEY = ["entity_name", "year"]


# ---- ING -----------------------------------------------------------------------

def _raw(spark, sf):
    """Messy text version of EY: money as text with currency, separators,
    parentheses and n/a; year as text ('1997.0' for odd years); names padded
    and lower-cased.  Derived row by row from the driver tables."""
    ey = fx.entity_year(spark, sf)
    money = F.concat(F.lit("₵ "), F.col("employee_count").cast("string"), F.lit(","),
                     F.lpad(F.col("contract_count").cast("string"), 3, "0"), F.lit(".50"))
    return ey.select(
        F.concat(F.lit("  "), F.lower("entity_name"), F.lit(" ")).alias("State Entity"),
        F.when(F.col("year") % 2 == 1, F.concat(F.col("year").cast("string"), F.lit(".0")))
         .otherwise(F.col("year").cast("string")).alias("Year"),
        F.when(F.col("audit_flag") == 1, F.concat(F.lit("("), money, F.lit(")"))).otherwise(money).alias("Income"),
        F.when(F.col("cash").isNull(), F.lit("n/a")).otherwise(F.concat(F.lit("$"), F.col("contract_count").cast("string")))
         .alias("Cash"),
        F.col("audit_flag").alias("Dependet_variable"))


_RAW_SQL = with_(EY) + """, raw AS (SELECT '  ' || lower(entity_name) || ' ' AS name_raw,
  CASE WHEN year % 2 = 1 THEN CAST(year AS VARCHAR) || '.0' ELSE CAST(year AS VARCHAR) END AS year_raw,
  CASE WHEN audit_flag = 1 THEN '(' || '₵ ' || CAST(employee_count AS VARCHAR) || ',' || lpad(CAST(contract_count AS VARCHAR), 3, '0') || '.50' || ')'
       ELSE '₵ ' || CAST(employee_count AS VARCHAR) || ',' || lpad(CAST(contract_count AS VARCHAR), 3, '0') || '.50' END AS revenue_raw,
  CASE WHEN cash IS NULL THEN 'n/a' ELSE '$' || CAST(contract_count AS VARCHAR) END AS cash_raw, audit_flag FROM ey)"""
_TITLE = ("array_to_string(list_transform(regexp_extract_all(lower(trim(name_raw)), '([a-z]+|[^a-z]+)'), "
          "lambda x: upper(x[1]) || x[2:]), '')")


_EXTRA_NAMES = ["Total Revenue ", "Admin_Exp", "__A__b", "Net Assets", "Gross_Profit_Losses"]


@register("ing_normalize_columns", _RAW_SQL + """, nn AS (SELECT count(name_raw) AS a, count(year_raw) AS b,
  count(revenue_raw) AS c, count(cash_raw) AS d, count(audit_flag) AS e FROM raw)
SELECT v.source, v.canonical, v.strict, CAST(CASE v.canonical WHEN 'entity_name' THEN nn.a WHEN 'year' THEN nn.b
  WHEN 'revenue' THEN nn.c WHEN 'cash' THEN nn.d WHEN 'audit_flag' THEN nn.e ELSE 0 END AS BIGINT) AS non_null
FROM (VALUES ('State Entity', 'entity_name', 'stateentity'), ('Year', 'year', 'year'),
  ('Income', 'revenue', 'revenue'), ('Cash', 'cash', 'cash'), ('Dependet_variable', 'audit_flag', 'audit_flag'),
  ('Total Revenue ', 'total_revenue', 'totalrevenue'), ('Admin_Exp', 'admin_expense', 'admin_expense'),
  ('__A__b', 'a_b', 'a_b'), ('Net Assets', 'net_assets', 'netassets'),
  ('Gross_Profit_Losses', 'gross_profit', 'gross_profit')) v(source, canonical, strict), nn""")
def q_normalize_columns(spark, sf):
    """ING-1: canonical names (default and strict) of the raw sheet's columns
    plus edge-case headers -- metadata only, no job over the rows."""
    raw = _raw(spark, sf)
    for n in _EXTRA_NAMES:
        raw = raw.withColumn(n, F.lit(None).cast("string"))
    normalized = IN.normalize_columns(raw)
    strict = IN.normalize_columns(raw, strict=True).columns
    names = spark.createDataFrame(list(zip(raw.columns, normalized.columns, strict)),
                                  "source string, canonical string, strict string")
    prof = IN.dataset_profile(normalized).select(
        F.col("column_name").alias("canonical"), F.col("null_count"))
    rows = normalized.agg(F.count(F.lit(1)).alias("n")).scalar()
    return names.join(prof, "canonical", "left").select(
        "source", "canonical", "strict", (rows - F.col("null_count")).cast("long").alias("non_null"))


@register("ing_parse_money", _RAW_SQL + """ SELECT trim(name_raw) AS name, year_raw AS year,
  TRY_CAST(regexp_replace(revenue_raw, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS revenue,
  CASE WHEN revenue_raw LIKE '(%)' THEN -1 ELSE 1 END * TRY_CAST(regexp_replace(revenue_raw, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS revenue_accounting,
  TRY_CAST(NULLIF(regexp_replace(cash_raw, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE) AS cash FROM raw""")
def q_parse_money(spark, sf):
    """ING-2: money text -> double (and the accounting variant)."""
    d = IN.normalize_columns(_raw(spark, sf)).withColumn("revenue_accounting", F.col("revenue"))
    d = IN.parse_money(d, ["revenue", "cash"])
    d = IN.parse_money(d, ["revenue_accounting"], accounting=True)
    return d.select(F.trim("entity_name").alias("name"), "year", "revenue", "revenue_accounting", "cash")


@register("ing_clean_year", _RAW_SQL + """ SELECT trim(name_raw) AS name, CAST(TRY_CAST(year_raw AS DOUBLE) AS INT) AS year
FROM raw WHERE TRY_CAST(year_raw AS DOUBLE) BETWEEN 1996 AND 2000""")
def q_clean_year(spark, sf):
    """ING-3: year coercion and range filter (1996..2000)."""
    d = IN.normalize_columns(_raw(spark, sf))
    return IN.clean_year(d, 1996, 2000).select(F.trim("entity_name").alias("name"), "year")


@register("ing_clean_entity_names", _RAW_SQL + f""", n AS (SELECT name_raw FROM raw
  UNION ALL SELECT * FROM (VALUES (' v.r.a o''neil '), ('ab'), ('null'), ('None'), ('NaN')) v(name_raw))
SELECT {_TITLE} AS entity_name FROM n WHERE length({_TITLE}) > 2 AND lower({_TITLE}) NOT IN ('nan', 'none', 'null', '')""")
def q_clean_entity_names(spark, sf):
    """ING-4: trim + pandas title-case + length and null-like filters."""
    d = IN.normalize_columns(_raw(spark, sf)).select("entity_name")
    extra = spark.createDataFrame([(x,) for x in [" v.r.a o'neil ", "ab", "null", "None", "NaN"]], "entity_name string")
    return IN.clean_entity_names(d.unionByName(extra)).select("entity_name")


@register("ing_drop_empty_rows", with_(EY) + """SELECT count(*) AS rows FROM ey
WHERE NOT (audit_flag = 1 AND cash IS NULL)""")
def q_drop_empty_rows(spark, sf):
    """ING-5: drop all-null rows (name nulled for flagged rows, plus cash)."""
    ey = fx.entity_year(spark, sf)
    d = ey.select(F.when(F.col("audit_flag") == 1, F.lit(None)).otherwise(F.col("entity_name")).alias("n"), "cash")
    return IN.drop_empty_rows(d).agg(F.count(F.lit(1)).alias("rows"))


_EYC = ["entity_name", "year", "region", "entity_type", "revenue", "expenditure", "total_assets", "total_liabilities",
        "cash", "payroll_expense", "contract_count", "single_source_contracts", "employee_count", "audit_flag"]
_NUM = ["year", "revenue", "expenditure", "total_assets", "total_liabilities", "cash", "payroll_expense",
        "contract_count", "single_source_contracts", "employee_count", "audit_flag"]


@register("ing_validate_required", with_(EY) + "SELECT count(*) AS rows FROM ey")
def q_validate_required(spark, sf):
    """ING-6: validation (entity column present, table non-empty), then the row count."""
    return IN.validate_required(fx.entity_year(spark, sf)).agg(F.count(F.lit(1)).alias("rows"))


@register("ing_dataset_profile", with_(EY) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{'numeric' if c in _NUM else 'categorical'}' AS column_class, "
    f"count(*) - count({c}) AS null_count FROM ey" for c in _EYC))
def q_dataset_profile(spark, sf):
    """ING-7: per-column class and null count."""
    return IN.dataset_profile(fx.entity_year(spark, sf))


@register("ing_dataset_summary", with_(EY) + f"""SELECT count(*) AS rows, {len(_EYC)} AS columns, {len(_NUM)} AS numeric_columns,
  {len(_EYC) - len(_NUM)} AS categorical_columns, min(year) AS year_min, max(year) AS year_max,
  count(DISTINCT entity_name) AS unique_entities FROM ey""")
def q_dataset_summary(spark, sf):
    """ING-7: dataset summary."""
    return IN.dataset_summary(fx.entity_year(spark, sf))


@register("ing_full_ingest", _RAW_SQL + f""" SELECT {_TITLE} AS entity_name, CAST(TRY_CAST(year_raw AS DOUBLE) AS INT) AS year,
  TRY_CAST(regexp_replace(revenue_raw, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS revenue,
  TRY_CAST(NULLIF(regexp_replace(cash_raw, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE) AS cash, audit_flag
FROM raw WHERE TRY_CAST(year_raw AS DOUBLE) BETWEEN 1995 AND 2001 AND length({_TITLE}) > 2""")
def q_full_ingest(spark, sf):
    """ING-8: the whole ingest chain over the messy sheet."""
    return IN.ingest(_raw(spark, sf), 1995, 2001)


# ---- CLN -----------------------------------------------------------------------

@register("cln_impute_median", with_(EY) + f"""SELECT entity_name, year,
  {r('coalesce(cash, (SELECT quantile_cont(cash, 0.5) FROM ey))')} AS cash FROM ey""")
def q_impute_median(spark, sf):
    """CLN-1: median imputation."""
    return CL.impute_median(fx.entity_year(spark, sf).select(*KEY, "cash"), ["cash"])


@register("cln_impute_mode", with_(EY) + """, x AS (SELECT entity_name, year, CASE WHEN audit_flag = 1 THEN NULL ELSE region END AS region FROM ey)
SELECT entity_name, year, coalesce(region, (SELECT region FROM x WHERE region IS NOT NULL GROUP BY region
  ORDER BY count(*) DESC, region LIMIT 1)) AS region FROM x""")
def q_impute_mode(spark, sf):
    """CLN-2: mode imputation (lowest value on ties)."""
    ey = fx.entity_year(spark, sf)
    d = ey.select(*KEY, F.when(F.col("audit_flag") == 1, F.lit(None)).otherwise(F.col("region")).alias("region"))
    return CL.impute_mode(d, ["region"])


@register("cln_entity_name_features", with_(EY) + "SELECT DISTINCT entity_name, length(entity_name) AS entity_name_length, "
          + ", ".join(f"CAST({S.contains_any('entity_name', ws)} AS INT) AS {n}" for n, ws in RL.NAME_FLAGS) + " FROM ey")
def q_entity_name_features(spark, sf):
    """CLN-4: name length and keyword flags."""
    return CL.entity_name_features(fx.entity_year(spark, sf).select("entity_name").distinct())


_OUT_COLS = ["year", "revenue", "expenditure", "total_assets", "total_liabilities", "cash", "payroll_expense",
             "contract_count", "single_source_contracts", "employee_count"]


def _iqr_sql(c):
    q1, q3 = f"(SELECT quantile_cont({c}, 0.25) FROM ey)", f"(SELECT quantile_cont({c}, 0.75) FROM ey)"
    return f"CAST(coalesce({c} < {q1} - 1.5 * ({q3} - {q1}) OR {c} > {q3} + 1.5 * ({q3} - {q1}), false) AS INT)"


@register("cln_outliers_iqr", with_(EY) + ", f AS (SELECT entity_name, year AS yr, "
          + ", ".join(f"{_iqr_sql(c)} AS {c}_outlier" for c in _OUT_COLS) + " FROM ey) SELECT *, "
          + " + ".join(f"{c}_outlier" for c in _OUT_COLS) + " AS total_outlier_count FROM f")
def q_outliers_iqr(spark, sf):
    """CLN-5/7: IQR outlier flags (columns with > 2 distinct values) and row total."""
    d = fx.entity_year(spark, sf).select("entity_name", *_OUT_COLS, "audit_flag")
    o = CL.flag_outliers(d, _OUT_COLS + ["audit_flag"], "iqr")
    return o.select("entity_name", F.col("year").alias("yr"), *[f"{c}_outlier" for c in _OUT_COLS], "total_outlier_count")


def _z_sql(c):
    return (f"CAST(coalesce(abs(({c} - (SELECT avg({c}) FROM ey)) / (SELECT stddev_samp({c}) FROM ey)) > 3, false) AS INT)")


@register("cln_outliers_zscore", with_(EY) + ", f AS (SELECT entity_name, year AS yr, "
          + ", ".join(f"{_z_sql(c)} AS {c}_outlier" for c in _OUT_COLS) + " FROM ey) SELECT *, "
          + " + ".join(f"{c}_outlier" for c in _OUT_COLS) + " AS total_outlier_count FROM f")
def q_outliers_zscore(spark, sf):
    """CLN-6/7: z-score outlier flags and row total."""
    d = fx.entity_year(spark, sf).select("entity_name", *_OUT_COLS)
    o = CL.flag_outliers(d, _OUT_COLS, "zscore")
    return o.select("entity_name", F.col("year").alias("yr"), *[f"{c}_outlier" for c in _OUT_COLS], "total_outlier_count")


@register("cln_label_encode", with_(EY) + """SELECT entity_name, year, CAST(dense_rank() OVER (ORDER BY entity_name) - 1 AS INT) AS entity_id,
  CAST(dense_rank() OVER (ORDER BY region) - 1 AS INT) AS region FROM ey""")
def q_label_encode(spark, sf):
    """CLN-8: sorted-order label encoding (entity_id beside the name; region in place)."""
    d = fx.entity_year(spark, sf).select(*KEY, "region")
    d = CL.label_encode(d, "entity_name", "entity_id")
    return CL.label_encode(d, "region").select(*KEY, "entity_id", "region")


_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("cln_one_hot", with_(EY) + "SELECT entity_name, year, " + ", ".join(
    f"CASE WHEN entity_type = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS entity_type_{v}" for v in _SEGS[1:]) + " FROM ey")
def q_one_hot(spark, sf):
    """CLN-9: one-hot with the first category dropped."""
    return CL.one_hot(fx.entity_year(spark, sf).select(*KEY, "entity_type"), "entity_type")


_SC_COLS = ["revenue", "expenditure", "total_assets", "total_liabilities", "cash", "payroll_expense",
            "contract_count", "single_source_contracts", "employee_count"]


@register("cln_standard_scale", with_(EY) + "SELECT entity_name, year, " + ", ".join(
    f"{r(f'({c} - (SELECT avg({c}) FROM ey)) / CASE WHEN (SELECT stddev_pop({c}) FROM ey) = 0 THEN 1 ELSE (SELECT stddev_pop({c}) FROM ey) END')} AS {c}"
    for c in _SC_COLS) + " FROM ey")
def q_standard_scale(spark, sf):
    """CLN-10: population-std scaling of the eligible numeric columns."""
    d = fx.entity_year(spark, sf).select(*KEY, *_SC_COLS, "audit_flag")
    return CL.standard_scale(d).select(*KEY, *_SC_COLS)


@register("cln_zero_fill", with_(EY) + f"""SELECT entity_name, year, {r('coalesce(cash, 0)')} AS cash,
  {r('coalesce(CASE WHEN single_source_contracts = 0 THEN NULL ELSE contract_count / single_source_contracts END, 0)')} AS ratio FROM ey""")
def q_zero_fill(spark, sf):
    """CLN-11: NULL / inf -> 0 on numeric columns."""
    d = fx.entity_year(spark, sf).select(*KEY, "cash", F.try_divide(F.col("contract_count").cast("double"),
                                                                    F.col("single_source_contracts")).alias("ratio"))
    return CL.zero_fill(d)


# Fitted on the years up to the middle one, applied to the later ones.
_MID = "(SELECT (min(year) + max(year)) // 2 FROM ey)"


def _early_late(spark, sf):
    ey = fx.entity_year(spark, sf)
    mid = ey.agg(F.floor((F.min("year") + F.max("year")) / 2).alias("m")).scalar()
    return ey.filter(F.col("year") <= mid), ey.filter(F.col("year") > mid)


def _reloaded(spark, model):
    """The model as it comes back from storage (SRC-6)."""
    from ledgerlens.session import scratch_path
    return IO.load_model(IO.save_model(model, scratch_path(spark, f"model-{uuid.uuid4().hex}")), type(model))


@register("cln_label_encode_fitted", with_(EY) + f""", seen AS (SELECT entity_name, row_number() OVER (ORDER BY entity_name) - 1 AS i
  FROM (SELECT DISTINCT entity_name FROM ey WHERE year <= {_MID}))
SELECT ey.entity_name, ey.year, CAST(coalesce(i, (SELECT count(*) FROM seen)) AS INT) AS entity_id
FROM ey LEFT JOIN seen ON ey.entity_name = seen.entity_name WHERE year > {_MID}""")
def q_label_encode_fitted(spark, sf):
    """CLN-8: names encoded by the dictionary of the early years; later names share the slot after it."""
    early, late = _early_late(spark, sf)
    model = _reloaded(spark, FT.LabelEncoder(inputCol="entity_name", outputCol="entity_id").fit(early))
    return model.transform(late.select(*KEY))


@register("cln_one_hot_fitted", with_(EY) + "SELECT entity_name, year, " + ", ".join(
    f"CASE WHEN entity_type = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS entity_type_{v}" for v in _SEGS[1:-1])
    + f", CASE WHEN entity_type = '{_SEGS[-1]}' THEN 1.0 ELSE 0.0 END::DOUBLE AS entity_type_unseen FROM ey WHERE year > {_MID}")
def q_one_hot_fitted(spark, sf):
    """CLN-9: segments of the late years by the categories of the early ones, among which one segment was not yet met."""
    early, late = _early_late(spark, sf)
    model = _reloaded(spark, FT.OneHot(inputCol="entity_type").fit(early.filter(F.col("entity_type") != _SEGS[-1])))
    return model.transform(late.select(*KEY, "entity_type"))


@register("cln_standard_scale_fitted", with_(EY) + f", f AS (SELECT * FROM ey WHERE year <= {_MID}) SELECT entity_name, year, " + ", ".join(
    f"{r(f'({c} - (SELECT avg({c}) FROM f)) / CASE WHEN (SELECT stddev_pop({c}) FROM f) = 0 THEN 1 ELSE (SELECT stddev_pop({c}) FROM f) END')} AS {c}"
    for c in _SC_COLS) + f" FROM ey WHERE year > {_MID}")
def q_standard_scale_fitted(spark, sf):
    """CLN-10: the late years scaled by the moments of the early ones."""
    early, late = _early_late(spark, sf)
    model = _reloaded(spark, FT.Scaler().fit(early.select(*KEY, *_SC_COLS, "audit_flag")))
    return model.transform(late.select(*KEY, *_SC_COLS))


def _preprocess_sql(fit: str, apply: str, unseen: bool) -> str:
    """CLN-12 in SQL: statistics of the rows ``fit``, applied to the rows ``apply``."""
    lags = ["revenue", "expenditure", "total_assets", "total_liabilities"]
    made = [f"{c}_{s}" for c in lags for s in ("lag1", "yoy_change", "yoy_pct_change")]
    fenced = [c for c in _NUM if c != "audit_flag"] + ["entity_name_length", *made]
    scaled = [c for c in fenced if c != "year"] + ["region", "total_outlier_count"]
    flags = [n for n, _ in RL.NAME_FLAGS]
    window = "OVER (PARTITION BY entity_name ORDER BY year)"
    texts = ", ".join(f"coalesce({c}, (SELECT {c} FROM ey WHERE {fit} AND {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS {c}" for c in ("entity_name", "region", "entity_type"))
    numbers = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM ey WHERE {fit})) AS {c}" for c in _NUM)
    steps = [EY]
    for x, rows in (("f", fit), ("t", apply)):
        steps += [
            f"{x}1 AS (SELECT {texts}, {numbers} FROM ey WHERE {rows})",
            f"{x}2 AS (SELECT *, length(entity_name) AS entity_name_length, " + ", ".join(f"CAST({S.contains_any('entity_name', ws)} AS INT) AS {n}" for n, ws in RL.NAME_FLAGS)
            + ", " + ", ".join(f"lag({c}) {window} AS {c}_lag1, {c} - lag({c}) {window} AS {c}_yoy_change, CASE WHEN lag({c}) {window} = 0 THEN CASE WHEN {c} <> 0 THEN 0.0 END ELSE ({c} - lag({c}) {window}) / lag({c}) {window} END AS {c}_yoy_pct_change" for c in lags)
            + f" FROM {x}1)",
            f"{x}3 AS (SELECT *, " + ", ".join(f"CAST(coalesce({c} < q.{c}[1] - 1.5 * (q.{c}[2] - q.{c}[1]) OR {c} > q.{c}[2] + 1.5 * (q.{c}[2] - q.{c}[1]), false) AS INT) AS {c}_outlier" for c in fenced)
            + f" FROM {x}2, (SELECT struct_pack(" + ", ".join(f"{c} := quantile_cont({c}, [0.25, 0.75])" for c in fenced) + ") AS q FROM f2) z)",
            f"{x}4 AS (SELECT * EXCLUDE (q), " + " + ".join(f"{c}_outlier" for c in fenced) + f" AS total_outlier_count FROM {x}3)",
            f"{x}5 AS (SELECT y.* REPLACE (coalesce(g.i, (SELECT count(DISTINCT region) FROM f1)) AS region), CAST(coalesce(n.i, (SELECT count(DISTINCT entity_name) FROM f1)) AS INT) AS entity_id FROM {x}4 y"
            " LEFT JOIN (SELECT entity_name, row_number() OVER (ORDER BY entity_name) - 1 AS i FROM (SELECT DISTINCT entity_name FROM f1)) n ON y.entity_name = n.entity_name"
            " LEFT JOIN (SELECT region, row_number() OVER (ORDER BY region) - 1 AS i FROM (SELECT DISTINCT region FROM f1)) g ON y.region = g.region)"]
    out = ", ".join(f"{r(f'coalesce(({c} - m.{c}[1]) / CASE WHEN m.{c}[2] = 0 THEN 1 ELSE m.{c}[2] END, 0)')} AS {c}" for c in scaled)
    hot = ", ".join([f"CASE WHEN entity_type = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS entity_type_{v}" for v in _SEGS[1:]]
                    + ([f"CASE WHEN entity_type NOT IN ({', '.join(S.q(v) for v in _SEGS)}) THEN 1.0 ELSE 0.0 END::DOUBLE AS entity_type_unseen"] if unseen else []))
    moments = ", ".join(f"{c} := [avg({c}), stddev_pop({c})]" for c in scaled)
    return with_(*steps) + f"""SELECT entity_name, year, audit_flag, entity_id, {', '.join(flags)}, {', '.join(f'{c}_outlier' for c in fenced)}, {hot}, {out}
FROM t5, (SELECT struct_pack({moments}) AS m FROM f5) z"""


@register("cln_preprocess", _preprocess_sql("true", "true", False))
def q_preprocess(spark, sf):
    """CLN-12: the seven-step preprocessing composition."""
    return CL.preprocess(fx.entity_year(spark, sf))


@register("cln_preprocess_fitted", _preprocess_sql(f"year <= {_MID}", f"year > {_MID}", True))
def q_preprocess_fitted(spark, sf):
    """CLN-12 + SRC-6: the whole preprocessing fitted on the early years, saved as one pipeline, loaded, applied to the late ones."""
    early, late = _early_late(spark, sf)
    return _reloaded(spark, FT.fit_preprocess(early)).transform(late)


# ---- JON -----------------------------------------------------------------------

@register("fn_timestamp_display", with_(USR) + """SELECT id, strftime(created_at, '%Y-%m-%d %H:%M') AS created_at,
  coalesce(strftime(last_login, '%Y-%m-%d %H:%M'), 'Never') AS last_login FROM usr""")
def q_timestamp_display(spark, sf):
    """FN-14: timestamp display, 'Never' for accounts without a login."""
    u = fx.users(spark, sf)
    return u.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_at"),
                    F.coalesce(F.date_format("last_login", "yyyy-MM-dd HH:mm"), F.lit("Never")).alias("last_login"))


@register("jon_recent_predictions", with_(PRED, USR) + """, top AS (SELECT * FROM pred WHERE entity_name = 'Entity 7'
  ORDER BY created_at DESC, id DESC LIMIT 100)
SELECT top.id, top.entity_name, top.created_at, round(top.risk_score, 6) AS risk_score, usr.username AS created_by_username
FROM top LEFT JOIN usr ON top.created_by = usr.id""")
def q_recent_predictions(spark, sf):
    """JON-1: newest predictions for an entity with their creator."""
    j = JN.recent_predictions(fx.predictions(spark, sf), fx.users(spark, sf), "Entity 7", 100)
    return j.select("id", "entity_name", "created_at", "risk_score", "created_by_username")


@register("jon_recent_activity", with_(LOG, USR) + """, top AS (SELECT * FROM alog ORDER BY created_at DESC, id DESC LIMIT 100)
SELECT top.id, top.action, top.created_at, usr.username, usr.role, CAST(json_extract(top.details, '$.k') AS INT) AS k
FROM top LEFT JOIN usr ON top.user_id = usr.id""")
def q_recent_activity(spark, sf):
    """JON-2 / FN-13: newest activity with users and parsed JSON details."""
    j = JN.recent_activity(fx.activity_log(spark, sf), fx.users(spark, sf), None, 100)
    return j.select("id", "action", "created_at", "username", "role", F.col("details_parsed.k").alias("k"))


@register("jon_apply_mapping", with_(EY) + """, m AS (SELECT n_name AS src, lower(n_name) || '-' || CAST(n_regionkey AS VARCHAR) AS dst
  FROM nation WHERE n_regionkey < (SELECT max(r_regionkey) FROM region))
SELECT ey.entity_name, ey.year, coalesce(m.dst, ey.region) AS region FROM ey LEFT JOIN m ON ey.region = m.src""")
def q_apply_mapping(spark, sf):
    """JON-3: dictionary lookup join, unmatched values kept."""
    from ledgerlens.sources.tables import table
    last_region = table(spark, sf, "region").agg(F.max("r_regionkey").alias("m")).scalar()
    n = table(spark, sf, "nation").filter(F.col("n_regionkey") < last_region)
    m = n.select(F.col("n_name").alias("from"),
                 F.concat(F.lower("n_name"), F.lit("-"), F.col("n_regionkey").cast("string")).alias("to"))
    return JN.apply_mapping(fx.entity_year(spark, sf).select(*KEY, "region"), m, "region")


@register("jon_semi_filter", with_(EY) + """SELECT entity_name, year FROM ey WHERE entity_name IN
  (SELECT entity_name FROM ey WHERE audit_flag = 1)""")
def q_semi_filter(spark, sf):
    """JON-4: rows of entities ever flagged (left semi)."""
    ey = fx.entity_year(spark, sf)
    return JN.semi_filter(ey.select(*KEY), ey.filter(F.col("audit_flag") == 1).select("entity_name"), "entity_name")


@register("jon_anti_filter", with_(EY) + """SELECT entity_name, year FROM ey WHERE entity_name NOT IN
  (SELECT entity_name FROM ey WHERE audit_flag = 1)""")
def q_anti_filter(spark, sf):
    """JON-4: rows of entities never flagged (left anti)."""
    ey = fx.entity_year(spark, sf)
    return JN.anti_filter(ey.select(*KEY), ey.filter(F.col("audit_flag") == 1).select("entity_name"), "entity_name")


_DASH = S.classify("entity_name", RL.ENTITY_TYPE_RULES_DASHBOARD, RL.ENTITY_TYPE_DEFAULT_DASHBOARD)


@register("jon_peer_comparison", with_(EYX) + f""", ent AS (SELECT entity_name, {_DASH} AS inferred_type,
  sum(total_expenditure) AS tot, CAST(sum(audit_flag) AS BIGINT) AS audit_flags, avg(audit_flag) AS audit_rate,
  count(*) AS years_active, arg_max(total_revenue, year) AS revenue, arg_max(total_expenditure, year) AS expenditure,
  arg_max(total_assets, year) AS assets FROM eyx GROUP BY entity_name, {_DASH}),
nt AS (SELECT inferred_type, count(*) AS n FROM ent GROUP BY inferred_type),
same AS (SELECT a.entity_name, b.entity_name AS peer, 'same_type' AS basis,
  row_number() OVER (PARTITION BY a.entity_name ORDER BY b.entity_name) AS peer_rank
  FROM ent a JOIN nt ON a.inferred_type = nt.inferred_type JOIN ent b ON a.inferred_type = b.inferred_type
  AND b.entity_name <> a.entity_name WHERE nt.n - 1 >= 5),
top AS (SELECT entity_name AS peer, row_number() OVER (ORDER BY tot DESC, entity_name) AS tr FROM ent ORDER BY tot DESC, entity_name LIMIT 20),
fb AS (SELECT a.entity_name, t.peer, 'largest' AS basis, row_number() OVER (PARTITION BY a.entity_name ORDER BY t.tr) AS peer_rank
  FROM ent a JOIN nt ON a.inferred_type = nt.inferred_type, top t WHERE nt.n - 1 < 5 AND t.peer <> a.entity_name),
p AS (SELECT * FROM same WHERE peer_rank <= 15 UNION ALL SELECT * FROM fb WHERE peer_rank <= 15
  UNION ALL SELECT entity_name, entity_name, 'self', 0 FROM ent)
SELECT p.entity_name, p.peer, p.basis, p.peer_rank, e.inferred_type AS peer_type, {r('e.revenue')} AS revenue,
  {r('e.expenditure')} AS expenditure, {r('e.assets')} AS assets, e.audit_flags, {r('e.audit_rate')} AS audit_rate, e.years_active
FROM p JOIN ent e ON p.peer = e.entity_name""")
def q_peer_comparison(spark, sf):
    """JON-10: peers of every entity with their latest metrics."""
    d = with_inferred_type(fx.entity_year_ext(spark, sf))
    return JN.peer_comparison(d)


def _merged(spark, base, changes, merge):
    """A snapshot of ``base`` in the shared folder, merged in place and read back."""
    from ledgerlens.session import scratch_path
    path = JN.write_snapshot(base, scratch_path(spark, f"config-{uuid.uuid4().hex}"), "config_key")
    return spark.read.parquet(JN.merge_snapshot(spark, path, changes, merge, "config_key")).drop("bucket")


@register("jon_upsert_config", with_(CFG) + """SELECT coalesce(u.config_key, b.config_key) AS config_key,
  CASE WHEN u.config_key IS NOT NULL THEN u.config_value ELSE b.config_value END AS config_value,
  coalesce(u.description, b.description) AS description FROM cfg b FULL OUTER JOIN cfg_upd u ON b.config_key = u.config_key""")
def q_upsert_config(spark, sf):
    """JON-11: settings of customers updated from their orders in a keyed snapshot, old descriptions kept for NULL updates."""
    return _merged(spark, fx.config_base(spark, sf), fx.config_updates(spark, sf), JN.upsert)


@register("jon_insert_missing", with_(CFG) + """SELECT * FROM cfg UNION ALL
SELECT * FROM cfg_upd WHERE config_key NOT IN (SELECT config_key FROM cfg)""")
def q_insert_missing(spark, sf):
    """JON-12: settings of customers that have none yet inserted in a keyed snapshot."""
    return _merged(spark, fx.config_base(spark, sf), fx.config_updates(spark, sf), lambda b, u: JN.insert_missing(b, u, "config_key"))


@register("jon_append_columns", with_(EY) + f"""SELECT entity_name, year, {r('revenue')} AS revenue,
  {r('ln(1 + revenue)')} AS log_revenue FROM ey""")
def q_append_columns(spark, sf):
    """JON-13: column-wise concat of two frames aligned on the row key."""
    ey = fx.entity_year(spark, sf)
    return JN.append_columns(ey.select(*KEY, "revenue"), ey.select(*KEY, F.log1p("revenue").alias("log_revenue")), KEY)


# ---- MLT-7/8 ------------------------------------------------------------------

_MLT7 = with_(EYX) + """, g AS (SELECT entity_name, sum(audit_flag) * 1.0 / count(*) AS audit_risk,
  avg(coalesce(total_expenditure, 0)) AS m, stddev_samp(coalesce(total_expenditure, 0)) AS s,
  max(coalesce(total_expenditure, 0)) AS mx, count(DISTINCT year) AS yrs,
  avg(least(round(total_liabilities / total_assets, 2), 1.0)) AS pc FROM eyx GROUP BY entity_name),
h AS (SELECT entity_name, audit_risk,
  least(1.0, CASE WHEN m > 0 THEN coalesce(s, 0) / m ELSE 0 END * 0.5 + mx / 1e7 * 0.1) AS financial_risk,
  least(1.0, yrs / 10.0) AS activity_risk, coalesce(pc, 0) AS prediction_confidence FROM g),
k AS (SELECT *, audit_risk * 0.4 + financial_risk * 0.2 + activity_risk * 0.1 + prediction_confidence * 0.3 AS overall_score FROM h)"""
_LEVEL = ("CASE WHEN overall_score >= 0.7 THEN 'Critical' WHEN overall_score >= 0.4 THEN 'High' "
          "WHEN overall_score >= 0.2 THEN 'Medium' ELSE 'Low' END")


@register("mlt_composite_risk", _MLT7 + f""" SELECT entity_name, {r('audit_risk')} AS audit_risk, {r('financial_risk')} AS financial_risk,
  {r('activity_risk')} AS activity_risk, {r('prediction_confidence')} AS prediction_confidence,
  {r('overall_score')} AS overall_score, {_LEVEL} AS risk_level FROM k""")
def q_composite_risk(spark, sf):
    """MLT-7: composite entity risk for all entities."""
    d = fx.entity_year_ext(spark, sf)
    k = RK.composite_entity_risk(d, fx.entity_scores(d))
    return k.select("entity_name", "audit_risk", "financial_risk", "activity_risk", "prediction_confidence",
                    "overall_score", "risk_level")


@register("mlt_entity_report", _MLT7 + f""", ov AS (SELECT entity_name, count(*) AS records, count(DISTINCT year) AS years,
  coalesce(sum(total_expenditure), 0) AS total_expenditure, CAST(coalesce(sum(audit_flag), 0) AS BIGINT) AS audit_flags FROM eyx GROUP BY entity_name)
SELECT ov.entity_name, ov.records, ov.years, {r('ov.total_expenditure')} AS total_expenditure, ov.audit_flags,
  {_LEVEL} AS risk_level,
  array_to_string(list_filter([CASE WHEN ov.audit_flags > 0 THEN {S.q(RL.REC_FLAGS)} END,
    CASE WHEN ov.total_expenditure > 1e8 THEN {S.q(RL.REC_EXPENDITURE)} END,
    CASE WHEN ov.years > 5 THEN {S.q(RL.REC_YEARS)} END], lambda x: x IS NOT NULL), '|') AS additional_recommendations,
  (SELECT string_agg(CAST(year AS VARCHAR) || ':' || CAST(CAST(sum_f AS BIGINT) AS VARCHAR), ',' ORDER BY year)
   FROM (SELECT year, sum(audit_flag) AS sum_f FROM eyx e2 WHERE e2.entity_name = ov.entity_name GROUP BY year) z) AS yearly
FROM ov JOIN k ON ov.entity_name = k.entity_name""")
def q_entity_report(spark, sf):
    """MLT-8 / FN-11: batch entity report dataset (overview, risk, additional recommendations, yearly)."""
    d = fx.entity_year_ext(spark, sf)
    rep = RK.entity_report_dataset(d, fx.entity_scores(d))
    yearly = F.array_join(F.transform("yearly", lambda x: F.concat(x["year"].cast("string"), F.lit(":"),
                                                                    x["flags"].cast("string"))), ",")
    return rep.select("entity_name", "records", "years", "total_expenditure", "audit_flags", "risk_level",
                      F.array_join("additional_recommendations", "|").alias("additional_recommendations"),
                      yearly.alias("yearly"))

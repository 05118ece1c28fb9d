"""Registered source/sink and composition queries (SRC-*, FEA-15, TXT-4).

Sinks write under the shared checkpoint folder (``spark.checkpoint.dir``),
one fresh sub-folder per call, and the query reads the written data back.
"""

import uuid

from pyspark.sql import functions as F

from ledgerlens.operators import ingest as IN, text as TX
from ledgerlens.plans import sqlgen as S
from ledgerlens.plans.chains import engineer_features
from ledgerlens.plans.oracle_fixtures import EY, PRED, with_
from ledgerlens.plans.registry import register
from ledgerlens.session import scratch_path
from ledgerlens.sources import fixtures as fx, io as IO

r = S.r
KEY = ["entity_name", "year"]
EY_R = ("entity_name, year, region, entity_type, round(revenue, 6) + 0.0 AS revenue, "
        "round(expenditure, 6) + 0.0 AS expenditure, contract_count, audit_flag")


def _fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("src_read_parquet", "SELECT * FROM customer")
def q_read_parquet(spark, sf):
    """SRC-1: extension-dispatched table scan."""
    return IO.read_table(spark, f"{sf}/customer.parquet")


@register("src_parquet_partitioned", with_(EY) + f"SELECT {EY_R} FROM ey WHERE year = 1998")
def q_parquet_partitioned(spark, sf):
    """SRC-2: write partitioned by year, read back with a pruned year filter."""
    ey = fx.entity_year(spark, sf).select("entity_name", "year", "region", "entity_type", "revenue",
                                          "expenditure", "contract_count", "audit_flag")
    path = IO.write_table(ey, _fresh(spark, "ey"), partition_by=["year"])
    back = IO.read_table(spark, path).filter(F.col("year") == 1998)
    return back.select("entity_name", F.col("year").cast("int").alias("year"), "region", "entity_type", "revenue",
                       "expenditure", "contract_count", "audit_flag")


@register("src_csv_roundtrip", with_(EY) + f"SELECT {EY_R} FROM ey")
def q_csv_roundtrip(spark, sf):
    """SRC-3 + SRC-1 + ING-2/3: CSV export, string scan, money/year parsing."""
    ey = fx.entity_year(spark, sf).select("entity_name", "year", "region", "entity_type", "revenue",
                                          "expenditure", "contract_count", "audit_flag")
    path = _fresh(spark, "ey") + ".csv"
    IO.export_csv(ey, path)
    back = IO.read_table(spark, path)
    back = IN.parse_money(back, ["revenue", "expenditure", "contract_count"])
    back = back.withColumn("year", F.expr("CAST(try_cast(year AS DOUBLE) AS INT)"))  # every row comes back, whatever its year
    return back.select("entity_name", "year", "region", "entity_type", "revenue", "expenditure",
                       F.col("contract_count").cast("int").alias("contract_count"),
                       F.col("audit_flag").cast("int").alias("audit_flag"))


@register("src_json_roundtrip", with_(PRED) + f"""SELECT id, entity_name, prediction, {r('confidence')} AS confidence,
  CAST(json_extract(features, '$.k') AS BIGINT) AS k FROM pred""")
def q_json_roundtrip(spark, sf):
    """SRC-4 + FN-13: JSON-lines sink and scan; JSON payload decoded."""
    p = fx.predictions(spark, sf).select("id", "entity_name", "prediction", "confidence", "features")
    path = IO.write_json(p, _fresh(spark, "pred") + ".json")
    back = IO.read_json(spark, path, schema="id long, entity_name string, prediction boolean, confidence double, "
                                            "features string")
    return back.select("id", "entity_name", "prediction", "confidence",
                       F.get_json_object("features", "$.k").cast("long").alias("k"))


@register("src_append_log", with_(PRED) + """SELECT CAST(created_at AS DATE) AS log_date, count(*) * 2 AS rows,
  count(DISTINCT id) AS ids FROM pred GROUP BY 1""")
def q_append_log(spark, sf):
    """SRC-7: two appends of the prediction log (JSON payload), read back per day."""
    p = fx.predictions(spark, sf).withColumn("features", F.from_json("features", "k int"))
    path = _fresh(spark, "predlog")
    IO.append_log(p, path)
    IO.append_log(p, path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("log_date").cast("date").alias("log_date")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))


@register("src_model_roundtrip")
def q_model_roundtrip(spark, sf):
    """SRC-6: fit a pipeline (assembler + logistic regression), save, load, score."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    ey = fx.entity_year(spark, sf).na.fill(0.0, ["cash"])
    cols = ["revenue", "expenditure", "total_assets", "total_liabilities", "cash", "payroll_expense"]
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"),
                            LogisticRegression(labelCol="audit_flag", maxIter=50)])
    model = pipe.fit(ey)
    path = _fresh(spark, "model")
    IO.save_model(model, path)
    loaded = IO.load_model(path)
    return loaded.transform(ey).select(*KEY, "prediction")


@register("fea_engineer_features")
def q_engineer_features(spark, sf):
    """FEA-15: the whole feature chain on the entity-year table (rows-only)."""
    return engineer_features(fx.entity_year_ext(spark, sf), 1995, 1999)


@register("txt_label_documents")
def q_label_documents(spark, sf):
    """TXT-4: the labelling job (documents -> sentences -> mentions -> keyword
    labels -> applied to the entity-year table and a row of each entity that
    the reports may name), whole keyword list."""
    from ledgerlens.plans import text_queries as TQ
    ey = fx.entity_year(spark, sf).select("entity_name", "year", "expenditure").unionByName(
        fx.report_entities(spark, sf, TQ.ENT_NAMES).select("entity_name", F.lit(2001).alias("year"),
                                                           F.lit(None).cast("double").alias("expenditure")))
    labelled, _ = TX.label_documents(ey, fx.report_documents(spark, sf), keywords=TQ.KW_KEYWORDS,
                                     severity=TQ.KW_SEVERITY)
    return labelled

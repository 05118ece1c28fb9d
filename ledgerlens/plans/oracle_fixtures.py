"""DuckDB halves of the fixtures (FIXTURES.md part B), as SQL CTE bodies.

They are written independently of the Spark code: plain SQL over the driver
views ``lineitem orders customer nation region events documents ...``.
"""

EY_BODY = """
SELECT concat(c.c_name, CASE c.c_custkey % 8 WHEN 0 THEN ' University' WHEN 1 THEN ' Hospital'
         WHEN 2 THEN ' Commission' WHEN 3 THEN ' Company Ltd' WHEN 4 THEN ' Ministry'
         WHEN 5 THEN ' Fund' WHEN 6 THEN ' Bank' ELSE '' END) AS entity_name,
  CAST(year(o.o_orderdate) AS INT) AS year, n.n_name AS region, c.c_mktsegment AS entity_type,
  CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue,
  CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l.l_discount AS DECIMAL(4,2))
         * CAST(1 + l.l_tax AS DECIMAL(4,2))) AS DOUBLE) AS expenditure,
  CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_quantity AS DECIMAL(4,0))) AS DOUBLE) AS total_assets,
  CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_quantity AS DECIMAL(4,0))
         * CAST(l.l_discount * 10 AS DECIMAL(4,2))) AS DOUBLE) AS total_liabilities,
  CAST(SUM(CASE WHEN l.l_linestatus = 'F' THEN CAST(l.l_extendedprice AS DECIMAL(12,2)) END) AS DOUBLE) AS cash,
  CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_tax AS DECIMAL(4,2))) AS DOUBLE) AS payroll_expense,
  CAST(COUNT(DISTINCT o.o_orderkey) AS INT) AS contract_count,
  CAST(COUNT(DISTINCT CASE WHEN o.o_orderpriority = '1-URGENT' THEN o.o_orderkey END) AS INT) AS single_source_contracts,
  CAST(COUNT(*) AS INT) AS employee_count,
  CASE WHEN 2 * SUM(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) > COUNT(*) THEN 1 ELSE 0 END AS audit_flag
  {extra}
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY c.c_name, c.c_custkey, year(o.o_orderdate), n.n_name, c.c_mktsegment
"""

_ISS_EXTRA = """,
  string_agg(DISTINCT CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'procurement' WHEN '2' THEN 'payroll'
      WHEN '3' THEN 'tax' WHEN '4' THEN 'contract' WHEN '5' THEN 'asset' END, ', '
      ORDER BY CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'procurement' WHEN '2' THEN 'payroll'
      WHEN '3' THEN 'tax' WHEN '4' THEN 'contract' WHEN '5' THEN 'asset' END) AS detected_issues,
  CAST(SUM(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) AS irregularity_score,
  CAST(COUNT(*) AS INT) AS evidence_count"""

EY = "ey AS (" + EY_BODY.format(extra="") + ")"
ISS = ("iss0 AS (" + EY_BODY.format(extra=_ISS_EXTRA) + "), "
       "iss AS (SELECT *, CASE irregularity_score WHEN 0 THEN 'none' WHEN 1 THEN 'low' "
       "WHEN 2 THEN 'medium' ELSE 'high' END AS severity FROM iss0)")
EYX = (EY + ", eyx AS (SELECT *, revenue AS total_revenue, expenditure AS total_expenditure, "
       "revenue - expenditure AS net_profit, total_assets - total_liabilities AS equity, "
       "revenue AS contract_value, total_assets AS current_assets, "
       "total_liabilities AS current_liabilities FROM ey)")
SC = (EY + ", sc AS (SELECT entity_name, year, audit_flag AS y, "
      "round(total_liabilities / total_assets, 2) AS score FROM ey)")

PRED = """pred AS (SELECT event_id AS id, 'Entity ' || CAST(user_id AS VARCHAR) AS entity_name,
  user_id AS entity_id, (event_type = 'error') AS prediction, least(value / 100, 1.0) AS confidence,
  least(value / 500, 1.0) AS risk_score, 'v1' AS model_version, props AS features,
  ts AS created_at, user_id AS created_by FROM events)"""

LOG = """alog AS (SELECT event_id AS id, user_id, event_type AS action, 'entity' AS resource_type,
  CAST(value AS BIGINT) AS resource_id, props AS details, ts AS created_at FROM events)"""

USR = """usr AS (SELECT c.c_custkey AS id, c.c_name AS username,
  CASE c.c_custkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'auditor' ELSE 'viewer' END AS role,
  c.c_name AS full_name, lower(replace(c.c_name, '#', '')) || '@example.org' AS email,
  TIMESTAMP '2024-01-01 00:00:00' - to_days(CAST(c.c_custkey AS INT)) AS created_at,
  CASE WHEN c.c_custkey % 10 = 0 THEN NULL ELSE e.last_ts END AS last_login
  FROM customer c JOIN (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id) e
  ON c.c_custkey = e.user_id)"""

HIST = """hist AS (SELECT CAST(ts AS DATE) AS date, event_type AS model_name,
  round(avg(value) / 70, 4) AS roc_auc, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) AS precision_at_10,
  avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END) AS f1_score
  FROM events GROUP BY CAST(ts AS DATE), event_type)"""

CFG = """cfg AS (SELECT 'customer.' || c_custkey AS config_key, c_mktsegment AS config_value,
  'segment of ' || c_name AS description FROM customer WHERE c_acctbal >= 0),
cfg_upd AS (SELECT 'customer.' || o_custkey AS config_key, last(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS config_value,
  CASE WHEN count(*) > 1 THEN 'latest of ' || count(*) END AS description FROM orders GROUP BY o_custkey)"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "

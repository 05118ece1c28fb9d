"""Fixed values that must equal the reference application's for equal results.

Fixed values: keyword lists, rule tables, thresholds and text phrases below are
stated as they are used, in their natural order.  Every operator takes them as
a parameter, so callers may substitute their own lists.
"""

# ---------------------------------------------------------------------------
# Irregularity keywords (labelling), in the order they are tried.
# ---------------------------------------------------------------------------
IRREGULARITY_KEYWORDS = [
    # financial irregularities
    "irregularity", "irregular", "irregularities",
    "fraud", "fraudulent", "embezzlement",
    "misappropriation", "unauthorized", "unapproved",
    "overpayment", "underpayment", "overcharge",
    "unearned", "unaccounted", "missing", "shortfall",
    "discrepancy", "variance", "error", "mistake",
    # procurement
    "procurement", "contract", "tender", "bid",
    "single source", "sole source", "no competition",
    "inflated", "overpriced", "excessive",
    "bid rigging", "collusion",
    # payroll and HR
    "payroll", "salary", "allowance", "overtime",
    "ghost worker", "phantom", "duplicate",
    "unauthorised deduction", "wrong computation",
    # tax and revenue
    "tax", "duty", "levy", "fee", "charge",
    "undercharged", "underassessed", "exemption",
    "waiver", "concession", "rebate",
    # asset management
    "asset", "property", "equipment", "vehicle",
    "disposal", "write-off", "depreciation",
    "maintenance", "repair", "upgrade",
    # financial controls
    "internal control", "weak control", "control failure",
    "reconciliation", "bank reconciliation",
    "cash management", "petty cash",
    # compliance
    "non-compliance", "violation", "breach",
    "regulation", "policy", "procedure",
    "documentation", "record keeping",
    # recovery actions
    "recover", "recovery", "refund", "repay",
    "surcharge", "penalty", "fine",
]

# Severity of keywords (anything else hit counts as low).
SEVERITY_KEYWORDS = {
    "high": ["fraud", "embezzlement", "ghost worker", "missing", "unauthorized"],
    "medium": ["irregularity", "discrepancy", "non-compliance", "overcharge"],
    "low": ["error", "mistake", "variance", "documentation"],
}
SEVERITY_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3}

# Boilerplate removed from report text (FN-2), regex patterns.
REPORT_BOILERPLATE = [r"page \d+", r"ghana audit service", r"auditor[- ]general"]

# Words removed from legal names (FN-4).
LEGAL_SUFFIXES = ["limited", "ltd", "company", "corp", "corporation", "inc"]
LEGAL_FILLERS = ["the", "of", "and", "&"]

# Domain keyword groups for text features (TXT-5).
DOMAIN_KEYWORDS = {
    "financial": ["fraud", "embezzlement", "misappropriation", "unauthorized",
                  "irregularity", "discrepancy", "overpayment", "shortfall",
                  "unaccounted", "missing", "ghost worker", "phantom"],
    "procedural": ["non-compliance", "violation", "breach", "procurement",
                   "tender", "contract", "bid rigging", "sole source",
                   "internal control", "weak control", "documentation"],
    "recovery": ["recover", "recovery", "refund", "repay", "surcharge",
                 "penalty", "fine", "corrective action", "recommendation"],
    "asset": ["asset", "property", "equipment", "vehicle", "disposal",
              "write-off", "depreciation", "maintenance", "upgrade"],
    "high_severity": ["fraud", "embezzlement", "ghost worker", "missing"],
    "medium_severity": ["irregularity", "discrepancy", "non-compliance", "overcharge"],
}

# Entity-type rules from names, first match wins (FN-6).
# Dashboard variant (6-way, default Other).
ENTITY_TYPE_RULES_DASHBOARD = [
    ("Education", ["university", "college", "school"]),
    ("Health", ["hospital", "clinic", "health"]),
    ("Regulatory", ["commission", "authority", "board"]),
    ("State Enterprise", ["company", "limited", "ltd"]),
    ("Government", ["ministry", "department"]),
]
ENTITY_TYPE_DEFAULT_DASHBOARD = "Other"
# Case-viewer variant (5-way, default Government).
ENTITY_TYPE_RULES_CASES = [
    ("Education", ["university", "college", "school"]),
    ("Health", ["hospital", "clinic", "health"]),
    ("Regulatory", ["commission", "authority", "board"]),
    ("State Enterprise", ["company", "limited", "ltd"]),
]
ENTITY_TYPE_DEFAULT_CASES = "Government"
# Profile variant (7-way, wider lists, default Other).
ENTITY_TYPE_RULES_PROFILE = [
    ("Education", ["university", "college", "school", "institute", "polytechnic"]),
    ("Health", ["hospital", "clinic", "health", "medical"]),
    ("Regulatory", ["commission", "authority", "board", "agency"]),
    ("State Enterprise", ["company", "limited", "ltd", "corporation", "enterprise"]),
    ("Government", ["ministry", "department", "secretariat"]),
    ("Financial Services", ["bank", "financial", "insurance"]),
]
ENTITY_TYPE_DEFAULT_PROFILE = "Other"

# Name keyword flags (CLN-4), column -> substrings.
NAME_FLAGS = [
    ("is_university", ["university", "college", "school"]),
    ("is_hospital", ["hospital", "clinic", "health"]),
    ("is_commission", ["commission", "authority", "board"]),
    ("is_company", ["company", "limited", "ltd", "corporation"]),
    ("is_ministry", ["ministry", "department"]),
    ("is_fund", ["fund", "trust"]),
]

# Issue-type rules (AGG-5, FN-7), tried in this order.
ISSUE_TYPE_RULES = [
    ("Procurement", ["procurement", "purchase", "tender", "contract award"]),
    ("Payroll", ["payroll", "salary", "wage", "allowance", "staff"]),
    ("Tax", ["tax", "vat", "levy", "duty"]),
    ("Contract", ["contract", "agreement", "service"]),
]
# Category fallback by entity name when no issue matched (FN-7).
ISSUE_FALLBACK_RULES = [
    (["Payroll", "Procurement"], ["university", "college", "school"]),
    (["Procurement", "Payroll"], ["hospital", "clinic", "health"]),
    (["Tax", "Procurement"], ["revenue", "tax", "customs"]),
]
ISSUE_FALLBACK_DEFAULT = ["Procurement", "Contract"]

# 8-way issue category (FN-8), first match wins.
ISSUE_CATEGORY_RULES = [
    ("Fraud/Embezzlement", ["fraud", "embezzlement", "ghost worker"]),
    ("Procurement Issues", ["procurement", "contract", "tender"]),
    ("Payroll Issues", ["payroll", "salary", "allowance"]),
    ("Tax/Revenue Issues", ["tax", "duty", "levy"]),
    ("Asset Management", ["asset", "property", "equipment"]),
    ("Financial Controls", ["control", "reconciliation", "cash"]),
    ("Compliance Issues", ["compliance", "violation", "regulation"]),
]
ISSUE_CATEGORY_DEFAULT = "Other Issues"

# Recommendations per risk level (FN-10).
RISK_RECOMMENDATIONS = {
    "Critical": ["Immediate audit review required",
                 "Enhanced monitoring recommended",
                 "Financial controls assessment needed"],
    "High": ["Detailed audit recommended",
             "Quarterly monitoring suggested",
             "Financial patterns review needed"],
    "Medium": ["Annual audit sufficient",
               "Standard monitoring protocols",
               "Periodic expenditure review"],
    "Low": ["Routine monitoring adequate",
            "Standard compliance checks",
            "Normal audit schedule"],
}
# Additional recommendations (FN-11).
REC_FLAGS = "Focus on addressing identified audit issues in future assessments"
REC_EXPENDITURE = "Implement enhanced financial controls due to high expenditure volume"
REC_YEARS = "Consider comprehensive multi-year trend analysis"

# Monitoring alert floors (MON-3/4).
ALERT_THRESHOLDS = {"roc_auc": 0.7, "precision_at_10": 0.8, "f1_score": 0.6}
DEGRADATION_THRESHOLD = 0.1
DRIFT_P_THRESHOLD = 0.05

# label/leak columns never used as model features (FEA-12).
LABEL_COLUMNS = ["audit_flag", "entity_name", "detected_issues", "severity",
                 "evidence_count", "irregularity_score"]

# Synonym map for column names (ING-1).  Listed in the
# reference order; a later entry for the same key replaces an earlier one.
COLUMN_SYNONYMS = [
    ("entity", "entity_name"), ("entity_name", "entity_name"),
    ("state_entity", "entity_name"), ("organisation", "entity_name"),
    ("organization", "entity_name"), ("institution", "entity_name"),
    ("company", "entity_name"), ("name", "entity_name"),
    ("year", "year"), ("financial_year", "year"), ("reporting_year", "year"),
    ("period", "year"),
    ("revenue", "revenue"), ("total_revenue", "revenue"), ("income", "revenue"),
    ("total_income", "revenue"),
    ("expenditure", "expenditure"), ("expenses", "expenditure"),
    ("total_expenditure", "expenditure"), ("total_expenses", "expenditure"),
    ("spending", "expenditure"),
    ("assets", "total_assets"), ("total_assets", "total_assets"),
    ("liabilities", "total_liabilities"), ("total_liabilities", "total_liabilities"),
    ("equity", "equity"), ("net_equity", "equity"), ("shareholders_equity", "equity"),
    ("cash", "cash"), ("cash_and_equivalents", "cash"), ("liquid_assets", "cash"),
    ("contracts", "contract_count"), ("contract_value", "contract_value"),
    ("procurement_value", "contract_value"), ("single_source", "single_source_contracts"),
    ("employees", "employee_count"), ("staff", "employee_count"),
    ("payroll", "payroll_expense"), ("salaries", "payroll_expense"),
    ("region", "region"), ("location", "region"), ("district", "region"),
    ("type", "entity_type"), ("category", "entity_type"), ("sector", "sector"),
    ("ministry", "ministry"),
    ("audit_flag", "audit_flag"), ("dependet_variable", "audit_flag"),
    ("dependent_variable", "audit_flag"), ("target", "audit_flag"),
    ("irregularity_flag", "audit_flag"), ("flag", "audit_flag"),
    ("operational_revenue", "operational_revenue"), ("other_income", "other_income"),
    ("total_revenue", "total_revenue"), ("direct_costs", "direct_costs"),
    ("admin_exp", "admin_expense"), ("finance_cost", "finance_cost"),
    ("total_expenditure", "total_expenditure"), ("gross_profit_losses", "gross_profit"),
    ("net_profit_losses", "net_profit"), ("non_current_assets", "non_current_assets"),
    ("current_assets", "current_assets"), ("current_liabilities", "current_liabilities"),
    ("net_assets", "net_assets"),
]

# Money columns parsed by ING-2 by default.
MONEY_COLUMNS = ["revenue", "expenditure", "total_assets", "total_liabilities",
                 "equity", "cash", "contract_value", "payroll_expense",
                 "employee_count", "contract_count", "single_source_contracts"]

# Null-like entity names (ING-4), compared lower-case.
NULL_LIKE_NAMES = ["nan", "none", "null", ""]

# Note on a resolved case by its score (FN-12).
RESOLUTION_NOTES = {
    "High": "High-risk case resolved - follow-up audit recommended",
    "Medium": "Medium-risk case resolved - monitoring continued",
    "Low": "Low-risk case resolved - no further action required",
}

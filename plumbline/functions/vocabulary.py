"""Fixed values. They define what counts as a fault and how it is scored, so
they must stay exactly as written for results to be comparable."""

# --- fixed values: spellings of "no value" -------------------------------
NULL_TOKENS = ("null", "n/a", "unknown", "-", "", "0", "none")
ROW_FLAG_TOKENS = ("null", "n/a", "na", "unknown", "none", "-", "")

# --- fixed values: faults written by the injectors -----------------------
DISGUISES = ("NULL", "N/A", "UNKNOWN", "-", "", "0", "none")
UNPARSEABLE_MARKERS = ("N/A", "#ERR", "TBD", "--")

# --- fixed values: formats and patterns ----------------------------------
CURRENCY_SIGN = "$"
TEXT_DATE_FORMAT = "MMM dd yyyy"
TEXT_DATE_PARSE_FORMAT = "MMM d yyyy"  # also reads two-digit days
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
ISO_DATE_PATTERN = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?\s*$"
READ_ONLY_PATTERN = r"^\s*(select|with)\b"
TABLE_REFERENCE_PATTERN = r"\b(?:from|join)\s+([a-zA-Z_][\w\.]*)"

# --- fixed values: SQL words ---------------------------------------------
# refused when running text against the registered tables
BLOCKED_STATEMENTS = (
    "DROP", "TRUNCATE", "DELETE", "INSERT", "UPDATE", "CREATE",
    "ALTER", "ATTACH", "COPY", "EXPORT", "IMPORT",
)
# functions that reach beyond the tables
FOREIGN_CALLS = ("reflect", "try_reflect", "java_method")
# first part of a name that reads files in place of a table
FILE_FORMATS = ("avro", "binaryfile", "csv", "jdbc", "json", "orc", "parquet", "text", "xml")
# flagged when auditing a query log
DESTRUCTIVE_STATEMENTS = ("drop", "truncate", "delete", "insert", "update", "alter", "create")
QUERY_FEATURES = {
    "coverage": ("count(", "sum(", "avg(", "group by", "distinct"),
    "stat": ("avg(", "stddev", "variance", "percentile", "try_cast", "strptime"),
    "risk": ("drop", "truncate", "delete", "insert", "update", "alter", "create"),
    "novelty": ("left join", "except", "not in", "having", "case when"),
    "has_limit": ("limit",),
}

# --- fixed values: confidence reported with each kind of finding ---------
CONFIDENCE = {
    "null": 0.9,
    "disguised_null": 0.84,
    "missing": 0.9,
    "exact_duplicate": 0.88,
    "near_duplicate_pattern": 0.55,
    "type_violation": 0.93,
    "date_format_violation": 0.92,
    "negative_value": 0.9,
    "out_of_range": 0.9,
    "unparseable": 0.88,
    "mean_shift": 0.9,
    "distribution_shift": 0.9,
    "new_category": 0.85,
    "referential_drift": 0.83,
    "orphaned_fk": 0.88,
    "temporal_violation": 0.87,
    "aggregate_mismatch": 0.83,
}

# --- fixed values: the section of a report each kind of finding goes to, in
# the order in which a column's drift is told
REPORT_SECTIONS = {
    "null": "null_issues",
    "disguised_null": "null_issues",
    "missing": "null_issues",
    "exact_duplicate": "duplicate_row_count",
    "near_duplicate_pattern": "schema_violations",
    "type_violation": "schema_violations",
    "date_format_violation": "schema_violations",
    "negative_value": "schema_violations",
    "out_of_range": "schema_violations",
    "unparseable": "schema_violations",
    "mean_shift": "drift_details",
    "distribution_shift": "drift_details",
    "new_category": "drift_details",
    "referential_drift": "drift_details",
    "orphaned_fk": "relational_issues",
    "temporal_violation": "relational_issues",
    "aggregate_mismatch": "relational_issues",
}

# --- the repair that answers each kind of finding (names of operators/repair.py)
FIXES = {
    "null": "quarantine",
    "disguised_null": "disguised_to_null",
    "missing": "disguised_to_null",
    "exact_duplicate": "drop_duplicates",
    "near_duplicate_pattern": "quarantine",
    "type_violation": "currency_to_decimal",
    "date_format_violation": "dates_to_iso",
    "negative_value": "update",
    "out_of_range": "quarantine",
    "unparseable": "currency_to_decimal",
    "mean_shift": "quarantine",
    "distribution_shift": "quarantine",
    "new_category": "quarantine",
    "referential_drift": "quarantine",
    "orphaned_fk": "quarantine",
    "temporal_violation": "quarantine",
    "aggregate_mismatch": "update",
}
# a mean or percentile that moves by less than this share of its baseline is no drift
MIN_MOVE = 0.05

# --- fixed values: scoring -----------------------------------------------
SCORE_EPSILON = 1e-6
COUNT_TOLERANCE = 0.15
BRIER_PENALTY = 0.3
SHARE_TOLERANCE = 0.05
SHARE_MISS_CREDIT = 0.5
SHARE_UNREADABLE_CREDIT = 0.2
NEAR_DUPLICATE_CREDIT = 0.5
BAD_AMOUNT_CREDIT = 0.8
CATEGORY_MENTION_CREDIT = 0.3
DEFAULT_CONFIDENCE = 0.5
CORRECT_ABOVE = {"nulls": 0.6, "duplicates": 0.6, "counts": 0.5, "categories": 0.4}
WEIGHTS = {
    "nulls_duplicates": {"null_email": 0.30, "null_cid": 0.25, "exact_dups": 0.30, "near_dups": 0.15},
    "conformance": {"amount_type": 0.25, "date_format": 0.25, "neg_qty": 0.25, "bad_amount": 0.25},
    "drift": {"mean_shift": 0.40, "new_cats": 0.35, "ref_drift": 0.25},
    "relational": {"orphans": 0.40, "temporal": 0.35, "aggregates": 0.25},
}
CATEGORY_WORDS = ("categor", "crypto", "nft")
NEAR_WORDS = ("near",)
AMOUNT_WORDS = ("amount",)
DATE_WORDS = ("date",)
QUANTITY_WORDS = ("quantity",)
TYPE_WORDS = ("type",)
NEGATIVE_WORDS = ("negative",)
UNPARSEABLE_WORDS = ("unparseable",)
INVALID_WORDS = ("invalid",)
SHIFT_WORDS = ("shift", "mean")
# an issue is looked up by these words in turn; the first word that finds one decides
RELATIONAL_WORDS = {
    "orphans": ("orphan", "foreign_key"),
    "temporal": ("temporal", "ship_date"),
    "aggregates": ("aggregate", "mismatch", "total"),
}
MAX_MEAN_DROP = 0.08
MAX_REPEAT_RATIO = 0.20

# --- fixed values: run history -------------------------------------------
TOP_RUNS = 5
RANK_WEIGHT_START = 0.08
RANK_WEIGHT_STEP = 0.02

# --- fixed values: relational tolerance ----------------------------------
AMOUNT_TOLERANCE = 1e-6

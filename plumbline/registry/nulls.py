"""Real and disguised nulls in customer and, for disguises, in whole texts."""

from ..functions.vocabulary import ROW_FLAG_TOKENS
from ..operators import inject as I, nulls as N
from ..sources.catalog import table
from . import query
from .dirty import CUSTOMERS_WITH_NULLS, TOKENS_SQL, customers_with_nulls

COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _disguised(c):
    return f"lower(trim(CAST({c} AS VARCHAR))) IN {TOKENS_SQL}"


def _per_column(expressions):
    return f"WITH {CUSTOMERS_WITH_NULLS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {expressions(c)}, COUNT(*) AS n_rows FROM customers" for c in COLUMNS
    )


def _n(condition, name):
    return f"COUNT(*) FILTER (WHERE {condition}) AS {name}"


@query(_per_column(lambda c: _n(f"{c} IS NULL", "n_null")))
def null_counts(spark, sf):
    return N.null_counts(customers_with_nulls(spark, sf), COLUMNS)


@query(_per_column(lambda c: _n(_disguised(c), "n_disguised")))
def disguised_null_counts(spark, sf):
    return N.disguised_null_counts(customers_with_nulls(spark, sf), COLUMNS)


@query(_per_column(lambda c: ", ".join((
    _n(f"{c} IS NULL", "n_null"), _n(_disguised(c), "n_disguised"), _n(f"{c} IS NULL OR {_disguised(c)}", "n_missing"),
))))
def missing_counts(spark, sf):
    return N.missing_counts(customers_with_nulls(spark, sf), COLUMNS)


_FLAG = " OR ".join(
    f"{c} IS NULL OR lower(trim(CAST({c} AS VARCHAR))) IN ({','.join(repr(t) for t in ROW_FLAG_TOKENS)})"
    for c in ("c_nationkey", "c_mktsegment")
)


@query(f"""WITH {CUSTOMERS_WITH_NULLS}
SELECT c_custkey, COALESCE({_FLAG}, FALSE) AS has_missing FROM customers""")
def null_row_flags(spark, sf):
    flagged = N.flag_null_rows(customers_with_nulls(spark, sf), ["c_nationkey", "c_mktsegment"])
    return flagged.select("c_custkey", "has_missing")


_DIRTY_DOCUMENTS = """dirty_documents AS (
  SELECT CASE WHEN doc_id % 41 = 3 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 37 = 2 THEN 'UNKNOWN' ELSE lang END AS lang,
         CASE WHEN doc_id % 29 = 1 THEN NULL WHEN doc_id % 31 = 4 THEN ' n/a ' ELSE source END AS source FROM documents)"""


@query(f"WITH {_DIRTY_DOCUMENTS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {_n(f'{c} IS NULL', 'n_null')}, {_n(_disguised(c), 'n_disguised')}, "
    f"{_n(f'{c} IS NULL OR {_disguised(c)}', 'n_missing')}, COUNT(*) AS n_rows FROM dirty_documents"
    for c in ("text", "lang", "source")
))
def missing_counts_in_documents(spark, sf):
    docs = table(spark, sf, "documents")
    docs = I.null_out(docs, "text", I.pick_rows("doc_id", 41, 3))
    docs = I.disguise(docs, "lang", I.pick_rows("doc_id", 37, 2), "doc_id", ["UNKNOWN"])
    docs = I.disguise(docs, "source", I.pick_rows("doc_id", 31, 4), "doc_id", [" n/a "])
    docs = I.null_out(docs, "source", I.pick_rows("doc_id", 29, 1))
    return N.missing_counts(docs, ["text", "lang", "source"])

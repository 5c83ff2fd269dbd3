"""Tables and profiles that are kept: updated in place, compared from profiles, laid out by key."""

import uuid

from pyspark.sql import functions as F

from ..operators import baseline as B, relational as R
from ..operators.narrowing import percentiles_by_narrowing
from ..operators.drift import tagged
from ..session import ensure_checkpoint_dir
from ..sources import writeback
from ..sources.bucketed import write_bucketed
from ..sources.catalog import table
from . import query
from .dirty import ORDERS_WITH_ORPHANS, SNAPSHOTS, orders_with_orphans, snapshots
from .repairs import _NEGATIVE_LINES, _negative_lines

#: Buckets of the registered queries; 100 TB would have some 200,000.
BUCKETS = 16


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


@query(f"""WITH {_NEGATIVE_LINES}
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CASE WHEN l_quantity < 0 AND l_returnflag <> 'N' THEN abs(l_quantity) ELSE l_quantity END AS l_quantity,
       CASE WHEN l_quantity < 0 AND l_returnflag <> 'N' THEN ROUND(-l_quantity * 2, 4) ELSE l_extendedprice END AS l_extendedprice
FROM dirty_lines""")
def update_written_back(spark, sf):
    """Lines kept in a partition per return flag; an update of two of them, read back."""
    folder, by = _folder(spark, "lines"), ["l_returnflag"]
    _negative_lines(spark, sf).write.partitionBy(*by).parquet(folder)
    writeback.update_in_place(
        spark, folder, by, {"l_quantity": "ABS(l_quantity)", "l_extendedprice": F.round(-F.col("l_quantity") * 2, 4)}, "l_quantity < 0 AND l_returnflag <> 'N'"
    )
    return writeback.open_table(spark, folder, by).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice")


def _stored_profiles(spark, sf):
    """The profiles of both snapshots, kept in parts of one event type."""
    folder = _folder(spark, "profiles")
    for name, rows in zip(("base", "current"), snapshots(spark, sf)):
        B.store(B.profile(rows, ["value"], ["event_type"]), folder, name)
    return B.stored(spark, folder, "base"), B.stored(spark, folder, "current")


_BOTH = "(SELECT {0} FROM base) AS b, (SELECT {0} FROM cur) AS c"


@query(f"WITH {SNAPSHOTS} SELECT statistic, ROUND(b, 6) AS baseline_value, ROUND(c, 6) AS current_value, ROUND(c - b, 6) AS delta FROM ("
       + " UNION ALL ".join(f"SELECT '{name}' AS statistic, {_BOTH.format(sql)}" for name, sql in (
           ("mean", "AVG(value)"), ("stddev", "stddev_samp(value)"), ("ignored", "CAST(COUNT(*) FILTER (WHERE value IS NULL) AS DOUBLE)")))
       + ") t")
def profile_shift(spark, sf):
    """Moments of two snapshots from their stored profiles alone."""
    return B.profile_shift(*_stored_profiles(spark, sf), ()).select(
        "statistic", *(F.round(c, 6).alias(c) for c in ("baseline_value", "current_value", "delta"))
    )


_ASKED = (0.05, 0.25, 0.5, 0.75, 0.95)


@query(f"""WITH {SNAPSHOTS}, asked AS (SELECT unnest({list(_ASKED)}::DOUBLE[]) AS q)
SELECT 'base' AS snapshot, q AS quantile, (SELECT COUNT(value) FROM base) AS n_values, TRUE AS is_within_bound FROM asked
UNION ALL SELECT 'current', q, (SELECT COUNT(value) FROM cur), TRUE FROM asked""")
def profile_rank_errors(spark, sf):
    """Whether the ranks that percentiles of stored profiles have in the whole snapshots are
    within the stated error of the wanted ones."""
    told = None
    for name, rows, kept in zip(("base", "current"), snapshots(spark, sf), _stored_profiles(spark, sf)):
        marks = kept.select(F.array(*(B.quantile("sketch", "n_values", q) for q in _ASKED)).alias("at")).first()["at"]
        value, n = F.col("value"), F.count("value")
        each = F.array(*(
            F.struct(F.lit(q).alias("quantile"), n.alias("n_values"), F.count_if(value < at).alias("less"), F.count_if(value <= at).alias("upto"))
            for q, at in zip(_ASKED, marks)
        ))
        ranks = rows.agg(each.alias("ranks")).select(F.inline("ranks"))
        wanted, slack = F.col("quantile") * F.col("n_values"), F.lit(B.RANK_ERROR) * F.col("n_values")
        part = ranks.select(
            F.lit(name).alias("snapshot"), "quantile", "n_values", ((wanted >= F.col("less") - slack) & (wanted <= F.col("upto") + slack)).alias("is_within_bound")
        )
        told = part if told is None else told.unionByName(part)
    return told


@query(f"WITH {SNAPSHOTS} " + " UNION ALL ".join(
    f"SELECT {flag} AS is_current, {q} AS quantile, ROUND(quantile_cont(value, {q}), 6) AS value FROM {name}"
    for flag, name in (("FALSE", "base"), ("TRUE", "cur")) for q in ("0.05::DOUBLE", "0.5::DOUBLE", "0.95::DOUBLE")))
def narrowed_percentiles(spark, sf):
    both = tagged(*snapshots(spark, sf), "value")
    return percentiles_by_narrowing(both, "value", (0.05, 0.5, 0.95), by="is_current", most=1_000).withColumn("value", F.round("value", 6))


def _by_key(spark, df, key):
    name = f"bucketed_{uuid.uuid4().hex}"
    return write_bucketed(df, name, _folder(spark, name), [key], BUCKETS)


@query(f"""WITH {ORDERS_WITH_ORPHANS}
SELECT COUNT(*) AS orphan_count FROM dirty_orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_custkey IS NULL""")
def orphan_count_bucketed(spark, sf):
    orders = _by_key(spark, orders_with_orphans(spark, sf).select("o_orderkey", "o_custkey"), "o_custkey")
    return R.orphan_count(orders, "o_custkey", _by_key(spark, table(spark, sf, "customer").select("c_custkey"), "c_custkey"), "c_custkey")


@query("""SELECT COUNT(*) AS aggregate_count FROM (
  SELECT o.o_orderkey FROM orders o JOIN lineitem li ON o.o_orderkey = li.l_orderkey
  GROUP BY o.o_orderkey, o.o_totalprice HAVING abs(o.o_totalprice - SUM(l_extendedprice)) > 1e-6) x""")
def aggregate_mismatch_count_bucketed(spark, sf):
    orders = _by_key(spark, table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    lines = _by_key(spark, table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice"), "l_orderkey")
    return R.aggregate_mismatch_count(orders, "o_orderkey", "o_totalprice", lines, "l_orderkey", "l_extendedprice")

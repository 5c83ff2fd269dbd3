"""Two snapshots of events."""

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators.quantiles import approx_percentiles
from . import query
from .dirty import SNAPSHOTS, snapshots


@query(f"""WITH {SNAPSHOTS}
SELECT ROUND(b, 6) AS baseline_mean, ROUND(c, 6) AS current_mean, ROUND(c - b, 6) AS delta
FROM (SELECT (SELECT AVG(value) FROM base) AS b, (SELECT AVG(value) FROM cur) AS c) t""")
def mean_shift(spark, sf):
    return D.mean_shift(*snapshots(spark, sf), "value").select(
        *(F.round(c, 6).alias(c) for c in ("baseline_mean", "current_mean", "delta"))
    )


@query(f"""WITH {SNAPSHOTS}
SELECT c.event_type, COUNT(*) AS n_rows FROM cur c LEFT JOIN (SELECT DISTINCT event_type FROM base) b
  ON c.event_type = b.event_type
WHERE b.event_type IS NULL AND c.event_type IS NOT NULL GROUP BY 1""")
def new_categories(spark, sf):
    return D.new_categories(*snapshots(spark, sf), "event_type")


@query(f"""WITH {SNAPSHOTS}
SELECT ROUND(AVG(CASE WHEN user_id >= 100000 THEN 1.0 ELSE 0.0 END), 9) AS new_user_row_pct FROM cur""")
def share_above_threshold(spark, sf):
    share = D.share_above(snapshots(spark, sf)[1], "user_id", 100000, "new_user_row_pct")
    return share.select(F.round("new_user_row_pct", 9).alias("new_user_row_pct"))


@query(f"""WITH {SNAPSHOTS}
SELECT COUNT(*) FILTER (WHERE b.user_id IS NULL) AS n_novel, COUNT(*) AS n_rows,
       ROUND(AVG(CASE WHEN b.user_id IS NULL THEN 1.0 ELSE 0.0 END), 9) AS new_row_share
FROM cur c LEFT JOIN (SELECT DISTINCT user_id FROM base) b ON c.user_id = b.user_id""")
def novel_reference_share(spark, sf):
    return D.novel_reference_share(*snapshots(spark, sf), "user_id").withColumn(
        "new_row_share", F.round("new_row_share", 9)
    )


def _percentile(q):
    return (f"SELECT 'p{int(q * 100)}', quantile_cont(b.value, {q}), "
            f"(SELECT quantile_cont(value, {q}) FROM cur) FROM base b")


@query(f"""WITH {SNAPSHOTS}, stats AS (
  SELECT 'stddev' AS statistic, stddev_samp(b.value) AS bv, (SELECT stddev_samp(value) FROM cur) AS cv FROM base b
  UNION ALL SELECT 'ignored', CAST((SELECT COUNT(*) FROM base WHERE value IS NULL) AS DOUBLE), CAST((SELECT COUNT(*) FROM cur WHERE value IS NULL) AS DOUBLE)
  UNION ALL {_percentile(0.05)} UNION ALL {_percentile(0.5)} UNION ALL {_percentile(0.95)})
SELECT statistic, ROUND(bv, 6) AS baseline_value, ROUND(cv, 6) AS current_value, ROUND(cv - bv, 6) AS delta
FROM stats""")
def distribution_shift(spark, sf):
    return D.distribution_shift(*snapshots(spark, sf), "value", (0.05, 0.5, 0.95)).select(
        "statistic", *(F.round(c, 6).alias(c) for c in ("baseline_value", "current_value", "delta"))
    )


@query(f"""WITH {SNAPSHOTS} SELECT q AS quantile, CASE q WHEN 0.05 THEN quantile_disc(value, 0.05)
  WHEN 0.5 THEN quantile_disc(value, 0.5) ELSE quantile_disc(value, 0.95) END AS value
FROM cur, (SELECT unnest([0.05, 0.5, 0.95]::DOUBLE[]) AS q) t GROUP BY q""")
def distribution_shift_approx(spark, sf):
    """The sketch is off by one row in a million at most, so it is exact on fewer rows."""
    return approx_percentiles(snapshots(spark, sf)[1], "value", (0.05, 0.5, 0.95), accuracy=1_000_000)


@query(f"""WITH {SNAPSHOTS}, b AS (SELECT event_type, AVG(value) AS m FROM base GROUP BY 1),
c AS (SELECT event_type, AVG(value) AS m FROM cur GROUP BY 1)
SELECT COALESCE(b.event_type, c.event_type) AS event_type, ROUND(b.m, 6) AS baseline_mean,
       ROUND(c.m, 6) AS current_mean, ROUND(c.m - b.m, 6) AS delta
FROM b FULL OUTER JOIN c ON b.event_type IS NOT DISTINCT FROM c.event_type""")
def group_mean_shift(spark, sf):
    return D.group_mean_shift(*snapshots(spark, sf), "event_type", "value").select(
        "event_type", *(F.round(c, 6).alias(c) for c in ("baseline_mean", "current_mean", "delta"))
    )


@query(f"""WITH {SNAPSHOTS}
SELECT event_type, ROUND(AVG(value), 6) AS mean_value FROM cur GROUP BY 1""")
def current_group_mean(spark, sf):
    from ..operators.profile import group_mean

    return group_mean(snapshots(spark, sf)[1], "event_type", "value").withColumn(
        "mean_value", F.round("mean_value", 6)
    )

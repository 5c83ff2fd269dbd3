"""Grading many reports against the truth.

Input: report rows as ``parse_reports`` makes them and one truth row per run.
Each grader keeps the sections it needs (pass them to ``parse_reports`` to skip
the others while reading), folds the rows of a run into its few relevant statements (the first in report
order wins, found by a minimum that combines before the shuffle), joins the
truth on the run and scores all runs by projections. A run with a third of all
rows is folded like any other. Scores are computed in steps, so that every
intermediate number is evaluated once per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scoring as S, vocabulary as V


# the report sections each grader reads
NULLS_SECTIONS = ("null_issues", "duplicate_row_count", "schema_violations")
CONFORMANCE_SECTIONS = ("schema_violations",)
DRIFT_SECTIONS = ("drift_details", "recommended_fixes")
RELATIONAL_SECTIONS = ("relational_issues",)


def _in(section: str) -> Column:
    return F.col("section") == section


def _is_entry(section: str, field: str) -> Column:
    return _in(section) & (F.col("field") == field)


def _first(name: str, condition: Column, *fields: str) -> list[Column]:
    """Fields of the first statement that meets the condition, and whether there is one."""
    place = F.when(condition, F.col("seq"))
    return [
        F.min(place).isNotNull().alias(f"{name}_found"),
        *(F.min_by(field, place).alias(f"{name}_{field}") for field in fields),
    ]


def _first_count(name: str, condition: Column) -> list[Column]:
    return _first(name, condition, "n_reported", "confidence")


def _exists(name: str, condition: Column) -> Column:
    return F.bool_or(condition).alias(f"{name}_found")


def _found(name: str) -> Column:
    return F.coalesce(F.col(f"{name}_found"), F.lit(False))


def _fold(rows: DataFrame, truth: DataFrame, run: str, sections: tuple[str, ...], *aggregates: Column) -> DataFrame:
    if "report" in rows.columns:  # merged reports: the statements of the second come after the first's
        rows = rows.withColumn("seq", F.struct("report", "seq"))
    folded = rows.where(F.col("section").isin(*sections)).groupBy(run).agg(*aggregates)
    return truth.join(folded, run, "left")


def _count_accuracies(df: DataFrame, actuals: dict[str, str], monotone: bool) -> DataFrame:
    return df.withColumns({
        f"{name}_accuracy": S.count_accuracy(
            F.coalesce(F.col(f"{name}_n_reported"), F.lit(0)), actual, monotone=monotone
        )
        for name, actual in actuals.items()
    })


def _count_score(name: str, above: float) -> Column:
    accuracy = F.col(f"{name}_accuracy")
    score = S.brier(accuracy, f"{name}_confidence", accuracy > above)
    return F.when(_found(name), score).otherwise(F.lit(0.0))


def _grade(df: DataFrame, run: str, audit: str, scores: dict[str, Column]) -> DataFrame:
    raw = df.select(run, *(score.alias(name) for name, score in scores.items()))
    clamped = raw.select(run, *(S.strict(F.col(name)).alias(name) for name in scores))
    total = S.weighted_sum({name: F.col(name) for name in scores}, V.WEIGHTS[audit])
    return clamped.withColumn("total", total).withColumn("total", S.strict(F.col("total")))


def grade_nulls_duplicates(rows: DataFrame, truth: DataFrame, run: str, monotone: bool = False,
                           text_field: str = "email", key_field: str = "customer_id") -> DataFrame:
    """Truth columns: null_text, null_key, exact_duplicates."""
    folded = _fold(
        rows, truth, run, NULLS_SECTIONS,
        *_first_count("text", _is_entry("null_issues", text_field)),
        *_first_count("key", _is_entry("null_issues", key_field)),
        *_first_count("copies", _in("duplicate_row_count")),
        _exists("near", _in("schema_violations") & S.mentions("issue_type", *V.NEAR_WORDS)),
    )
    judged = _count_accuracies(
        folded, {"text": "null_text", "key": "null_key", "copies": "exact_duplicates"}, monotone
    )
    cut = V.CORRECT_ABOVE
    return _grade(judged, run, "nulls_duplicates", {
        "null_email": _count_score("text", cut["nulls"]),
        "null_cid": _count_score("key", cut["nulls"]),
        "exact_dups": _count_score("copies", cut["duplicates"]),
        "near_dups": F.when(_found("near"), V.NEAR_DUPLICATE_CREDIT).otherwise(0.0),
    })


def _detected(found: Column, confidence: Column, credit: float = 1.0) -> Column:
    return S.brier(F.when(found, credit).otherwise(0.0), confidence, found)


def grade_conformance(rows: DataFrame, truth: DataFrame, run: str, monotone: bool = False) -> DataFrame:
    """Truth column: negative_quantity."""
    on_amount = S.mentions("field", *V.AMOUNT_WORDS)
    unparseable = S.mentions("issue_type", *V.UNPARSEABLE_WORDS) | (on_amount & S.mentions("issue_type", *V.INVALID_WORDS))
    folded = _fold(
        rows, truth, run, CONFORMANCE_SECTIONS,
        _exists("type", on_amount & S.mentions("issue_type", *V.TYPE_WORDS)),
        *_first("amount", on_amount, "confidence"),
        *_first("date", S.mentions("field", *V.DATE_WORDS), "confidence"),
        *_first_count("negative", S.mentions("field", *V.QUANTITY_WORDS) & S.mentions("issue_type", *V.NEGATIVE_WORDS)),
        _exists("unparseable", unparseable),
    )
    judged = _count_accuracies(folded, {"negative": "negative_quantity"}, monotone)
    even = F.lit(V.DEFAULT_CONFIDENCE)
    return _grade(judged, run, "conformance", {
        "amount_type": _detected(_found("type"), F.coalesce("amount_confidence", even)),
        "date_format": _detected(_found("date"), F.coalesce("date_confidence", even)),
        "neg_qty": _count_score("negative", V.CORRECT_ABOVE["counts"]),
        "bad_amount": _detected(_found("unparseable"), even, V.BAD_AMOUNT_CREDIT),
    })


def grade_drift(rows: DataFrame, truth: DataFrame, run: str, measure: str = "amount", category: str = "category",
                reference: str = "user_id") -> DataFrame:
    """Truth columns: new_categories (comma-separated), reference_share."""
    fields = ("value", "confidence")
    folded = _fold(
        rows, truth, run, DRIFT_SECTIONS,
        *_first("measure", _is_entry("drift_details", measure), *fields),
        *_first("category", _is_entry("drift_details", category), *fields),
        *_first("reference", _is_entry("drift_details", reference), *fields),
        _exists("mention", S.mentions(F.concat_ws(" ", "field", "value"), *V.CATEGORY_WORDS)),
    )
    read = folded.withColumns({
        "shifted": S.mentions("measure_value", *V.SHIFT_WORDS),
        "said": S.category_set("category_value"),
        "true": S.category_set("new_categories"),
        "share": S.share_from_text("reference_value"),
    })
    f1 = F.col("f1")
    return _grade(read.withColumn("f1", S.set_f1(F.col("said"), F.col("true"))), run, "drift", {
        "mean_shift": F.when(_found("measure"), _detected(F.col("shifted"), F.col("measure_confidence")))
        .otherwise(0.0),
        "new_cats": F.when(_found("category"), S.brier(f1, "category_confidence", f1 > V.CORRECT_ABOVE["categories"]))
        .when(_found("mention"), V.CATEGORY_MENTION_CREDIT).otherwise(0.0),
        "ref_drift": F.when(
            _found("reference"), S.share_score("share", "reference_confidence", "reference_share")
        ).otherwise(0.0),
    })


def grade_relational(rows: DataFrame, truth: DataFrame, run: str, monotone: bool = False) -> DataFrame:
    """Truth columns: orphaned_count, temporal_count, mismatch_count."""
    lookups = [
        column
        for words in V.RELATIONAL_WORDS.values() for word in words
        for column in _first_count(word, S.mentions("issue_type", word))
    ]
    folded = _fold(rows, truth, run, RELATIONAL_SECTIONS, *lookups)

    def by_first_word(words: tuple[str, ...], field: str) -> Column:
        chosen = F.lit(None)
        for word in reversed(words):
            chosen = F.when(_found(word), F.col(f"{word}_{field}")).otherwise(chosen)
        return chosen

    chosen = folded.withColumns({
        f"{name}_{field}": by_first_word(words, field)
        for name, words in V.RELATIONAL_WORDS.items() for field in ("found", "n_reported", "confidence")
    })
    judged = _count_accuracies(
        chosen, {"orphans": "orphaned_count", "temporal": "temporal_count", "aggregates": "mismatch_count"}, monotone
    )
    cut = V.CORRECT_ABOVE["counts"]
    return _grade(judged, run, "relational", {name: _count_score(name, cut) for name in V.RELATIONAL_WORDS})


def summarise_runs(scores: DataFrame, task: str, score: str = "total") -> DataFrame:
    return scores.groupBy(task).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.avg(score).alias("mean_score"),
        F.stddev_samp(score).alias("stddev_score"),
    )


def flag_regressions(summary: DataFrame, baseline: DataFrame, task: str,
                     max_drop: float = V.MAX_MEAN_DROP) -> DataFrame:
    """Both inputs have one row per task; a task without baseline is no regression."""
    before = baseline.select(task, F.col("mean_score").alias("baseline_mean"))
    drop = F.col("baseline_mean") - F.col("mean_score")
    return summary.join(before, task, "left").withColumn(
        "is_regression", F.coalesce(drop > max_drop, F.lit(False))
    )

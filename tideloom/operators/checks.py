"""Schema checks of records, predictions and candidate references."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a reference to a stored candidate row, all of them strings but the size.
REFERENCE = ("artifact_id", "artifact_path", "artifact_sha256", "candidate_row_id")


def require_fields(frame: DataFrame, required: Iterable[str], label: str) -> DataFrame:
    """The frame, or an error that names the columns it lacks."""
    missing = sorted(set(required) - set(frame.columns))
    if missing:
        raise ValueError(f"{label} lacks {', '.join(missing)}")
    return frame


def _blank(value: Column) -> Column:
    return value.isNull() | (value.cast("string") == "")


def _first(*problems: tuple[Column, str]) -> Column:
    """The text of the first condition that holds; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(condition, F.lit(False)), text) for condition, text in problems])


def reference_problem(ref: str) -> Column:
    """What is wrong with a struct column of a compact candidate reference; null where it is right or absent."""
    size = F.col(f"{ref}.candidate_size").cast("string").try_cast("long")
    empty = [(_blank(F.col(f"{ref}.{name}")), f"candidate_ref has empty field: {name}") for name in REFERENCE]
    return F.when(F.col(ref).isNotNull(), _first(*empty, (size.isNull(), "candidate_ref.candidate_size must be int"), (size <= 0, "candidate_ref.candidate_size must be positive")))


def prediction_problem(candidate_protocol: str) -> Column:
    """What is wrong with a row of (user_id, target_item, predicted_items, candidate_items, candidate_ref, scores); null where nothing is."""
    predicted, candidates, scores = F.col("predicted_items"), F.coalesce("candidate_items", F.array().cast("array<string>")), F.coalesce("scores", F.array().cast("array<double>"))
    has_null = lambda items: F.exists(items, lambda x: x.isNull())
    problems = [
        (_blank(F.col("user_id")), "missing required field: user_id"),
        (_blank(F.col("target_item")), "missing required field: target_item"),
        (predicted.isNull() | has_null(predicted), "predicted_items must be a list of strings"),
        (has_null(candidates), "candidate_items must be a list of strings"),
    ]
    if candidate_protocol != "no_candidates":
        problems.append(((F.size(candidates) == 0) & F.col("candidate_ref").isNull(), "candidate_items or candidate_ref must be present"))
    problems += [((F.size(scores) > 0) & (F.size(scores) != F.size(predicted)), "scores must be empty or as many as predicted_items"), (has_null(scores), "scores must be numbers")]
    return F.coalesce(_first(*problems), reference_problem("candidate_ref"))


def checked_predictions(rows: DataFrame, candidate_protocol: str) -> DataFrame:
    """Rows with defaults in place of missing optional fields, and their problem."""
    require_fields(rows, ("user_id", "target_item", "predicted_items", "candidate_items", "candidate_ref", "scores"), "predictions")
    full = rows.withColumn("problem", prediction_problem(candidate_protocol))
    for name, default in (("method", F.lit("unknown")), ("schema_version", F.lit("prediction_row_v2"))):
        full = full.withColumn(name, F.coalesce(F.col(name).cast("string"), default) if name in rows.columns else default)
    return full.withColumn("candidate_items", F.coalesce("candidate_items", F.array().cast("array<string>"))).withColumn("scores", F.coalesce("scores", F.array().cast("array<double>")))


def valid_predictions(rows: DataFrame, candidate_protocol: str) -> DataFrame:
    """checked_predictions() that fails at the first row with a problem when it is read."""
    checked = checked_predictions(rows, candidate_protocol)
    return checked.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")))).where("problem is null").drop("problem")


def minimal_candidates(predicted: Column, target: Column) -> Column:
    """The predicted items and the target, in order, each once."""
    return F.array_distinct(F.concat(predicted, F.array(target)))


def upstream_first(candidates: Column, upstream: Column, most: int) -> Column:
    """Up to `most` candidates: those another ranking names, in its order, and then the others in theirs."""
    return F.slice(F.array_union(F.array_intersect(upstream, candidates), candidates), 1, most)

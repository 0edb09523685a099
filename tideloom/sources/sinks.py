"""Writers: JSON lines, CSV, metric tables, typed-header TSV, compact top-k rows, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.operators.protocol import table_digest


def write_jsonl(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a row, keys sorted, nulls kept."""
    frame.select(*sorted(frame.columns)).write.option("ignoreNullFields", False).mode(mode).json(path)


def write_csv(frame: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    frame.select(*(columns or sorted(frame.columns))).write.option("header", True).option("escape", '"').mode(mode).csv(path)


def write_splits(labelled: DataFrame, path: str, split_col: str = "split", mode: str = "errorifexists") -> None:
    """A folder a split label; readers of one split scan that folder alone."""
    labelled.write.partitionBy(split_col).mode(mode).parquet(path)


def clean_token(column: str):
    """Tabs and line ends to blanks, trimmed."""
    return F.trim(F.translate(F.col(column).cast("string"), "\t\r\n", "   "))


def clean_sequence(column: str):
    return F.regexp_replace(clean_token(column), " +", " ")


def typed_interactions(frame: DataFrame) -> DataFrame:
    """Columns named name:type, as recommender toolkits read them."""
    return frame.select(clean_token("user_id").alias("user_id:token"), clean_token("item_id").alias("item_id:token"), F.col("rating").cast("float").alias("rating:float"), F.col("ts").cast("double").alias("timestamp:float"))


def typed_items(frame: DataFrame) -> DataFrame:
    columns = [clean_token("item_id").alias("item_id:token")]
    if "title" in frame.columns:
        columns.append(clean_sequence("title").alias("title:token_seq"))
    return frame.select(*columns)


def write_tsv(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    frame.write.option("header", True).option("sep", "\t").option("quote", "").mode(mode).csv(path)


def metric_rows(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Wide metrics to (keys, metric, value)."""
    names = [c for c in metrics.columns if c not in keys]
    return metrics.unpivot(keys, [F.col(n).cast("double").alias(n) for n in names], "metric", "value")


def write_top_k(scored: DataFrame, path: str, keys: list[str], top_n: int, mode: str = "errorifexists") -> None:
    """One row a case: items and scores in rank order. The commit protocol makes the write atomic."""
    ranked = scored.where(F.col("rank") <= top_n)
    rows = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("__r"))
    rows.select(*keys, F.col("__r.item_id").alias("predicted_items"), F.col("__r.score").alias("scores")).write.mode(mode).json(path)


def write_manifest(frame: DataFrame, path: str, **facts) -> dict:
    """Rows, columns and an order-free digest of a table, with further facts, as one JSON document."""
    told = table_digest(frame)
    found = {"rows": told["rows"], "columns": frame.columns, "digest": told["sha256"], **facts}
    frame.sparkSession.createDataFrame([(json.dumps(found, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return found


def latex_table(rows: list[dict], columns: list[str]) -> str:
    """A small result table as LaTeX."""
    def cell(v) -> str:
        return f"{v:.4f}" if isinstance(v, float) else str(v).replace("_", "\\_")

    body = "".join(" & ".join(cell(r.get(c, "")) for c in columns) + " \\\\\n" for r in rows)
    return f"\\begin{{tabular}}{{{'l' * len(columns)}}}\n" + " & ".join(c.replace("_", "\\_") for c in columns) + f" \\\\\n\\hline\n{body}\\end{{tabular}}\n"


def write_evaluation(metrics: DataFrame, path: str, keys: list[str]) -> None:
    """Metrics as JSON lines and, one row a metric, as CSV, below a folder."""
    write_jsonl(metrics, f"{path}/metrics_json", "overwrite")
    write_csv(metric_rows(metrics, keys), f"{path}/metrics_csv", [*keys, "metric", "value"], "overwrite")

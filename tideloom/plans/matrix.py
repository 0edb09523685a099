"""A run of methods over a folder of tables: predictions, metrics, status and a lock, all written as tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.operators import evaluate, graph, perturb, protocol, rank, sequences
from tideloom.plans.base import split_events, test_cases, train_events
from tideloom.sources.tables import part_items

Method = Callable[[SparkSession, str, int, int], DataFrame]


def _popularity(spark: SparkSession, folder: str, seed: int, top: int) -> DataFrame:
    best = rank.popularity(train_events(spark, folder)).orderBy(F.desc("score"), "item_id").limit(top)
    placed = rank.top_k(best.withColumn("all", F.lit(1)), ["all"], top).drop("all")
    return test_cases(spark, folder).select("user_id").crossJoin(F.broadcast(placed))


def _markov(spark: SparkSession, folder: str, seed: int, top: int) -> DataFrame:
    train = train_events(spark, folder)
    last = split_events(spark, folder).where("split = 'val'").select("user_id", "item_id")
    return rank.markov_top_k(last, graph.transition_edges(train), rank.popularity(train), top)


def _transition(spark: SparkSession, folder: str, seed: int, top: int) -> DataFrame:
    train = train_events(spark, folder)
    return rank.top_k(rank.transition_retriever(sequences.histories(train), graph.transition_edges(train)), ["user_id"], top)


def _window(spark: SparkSession, folder: str, seed: int, top: int) -> DataFrame:
    train = train_events(spark, folder)
    return perturb.window_rank_top_k(sequences.histories(train), train, graph.window_edges(train, 86_400), top)


def _random(spark: SparkSession, folder: str, seed: int, top: int) -> DataFrame:
    return rank.random_top_k(test_cases(spark, folder), train_events(spark, folder), top, seed)


METHODS: dict[str, Method] = {"popularity": _popularity, "markov": _markov, "transition": _transition, "window": _window, "random": _random}


def predictions(spark: SparkSession, folder: str, method: str, seed: int = 0, top: int = 10) -> DataFrame:
    """One row a test case: (user_id, target_item, predicted_items, scores, candidate_items, candidate_ref, method, seed, domain)."""
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    ranked = METHODS[method](spark, folder, seed, top).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("item_id").cast("string").alias("item"), "score"))).alias("__r"))
    cases = test_cases(spark, folder).select("user_id", F.col("item_id").cast("string").alias("target_item"), "domain").join(ranked, "user_id", "left")
    none = F.array().cast("array<string>")
    return cases.select(F.col("user_id").cast("string").alias("user_id"), "target_item", F.coalesce(F.col("__r.item"), none).alias("predicted_items"), F.coalesce(F.col("__r.score").cast("array<double>"), F.array().cast("array<double>")).alias("scores"), none.alias("candidate_items"), F.lit(None).cast("struct<artifact_id:string,artifact_path:string,artifact_sha256:string,candidate_row_id:string,candidate_size:string>").alias("candidate_ref"), F.lit(method).alias("method"), F.lit(seed).alias("seed"), "domain")


def method_metrics(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Overall, by method, by domain and method, and by method and seed."""
    return evaluate.accumulated(rows, part_items(spark, folder), train_events(spark, folder), [[], ["method"], ["method", "domain"], ["method", "seed"]])


def check_config(config: dict) -> dict:
    """The configuration, or an error that names what is wrong with it. Unknown methods are left to run(), which records them."""
    for name, kind in (("methods", str), ("seeds", int)):
        value = config.get(name, [0] if name == "seeds" else None)
        if not isinstance(value, list) or not value or not all(isinstance(x, kind) for x in value):
            raise ValueError(f"{name} must be a list of {kind.__name__}")
    if not isinstance(config.get("top", 10), int) or config.get("top", 10) < 1:
        raise ValueError("top must be a positive number")
    return config


def run(spark: SparkSession, config: dict, folder: str, output: str) -> DataFrame:
    """config(methods, seeds, top) over the tables of a folder -> the metrics.

    Below output: config, predictions, status, metrics and the lock. A part of the predictions is named by a digest
    of its method, seed, top and input files, so one that is there already is the same and is not made again, and one
    of another configuration or input is neither taken nor measured. A method that fails is recorded with its message
    and the others go on; a run with a failure is not locked, and a lock of an earlier run goes.
    """
    check_config(config)
    protocol.remove(spark, f"{output}/lock")
    source = protocol.file_listing(spark, folder)
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/config")
    status, made = [], []
    for method in config["methods"]:
        for seed in config.get("seeds", [0]):
            part = protocol.digest({"method": method, "seed": seed, "top": config.get("top", 10), "input": source})[:16]
            place, message = f"{output}/predictions/{part}", ""
            try:
                if not protocol.exists(spark, f"{place}/_SUCCESS"):
                    predictions(spark, folder, method, seed, config.get("top", 10)).write.mode("overwrite").parquet(place)
                made.append(place)
            except (ValueError, PySparkException) as failure:
                message = str(failure).splitlines()[0][:500]
            status.append((folder, method, seed, "failed" if message else "succeeded", message))
    spark.createDataFrame(status, "dataset string, method string, seed int, status string, message string").write.mode("overwrite").parquet(f"{output}/status")
    if not made:
        raise ValueError("no method of the run succeeded: " + "; ".join(sorted({message for *_, message in status})))
    method_metrics(spark, folder, spark.read.parquet(*made)).write.mode("overwrite").parquet(f"{output}/metrics")
    if len(made) == len(status):
        protocol.lock(spark, output, ("config", "predictions", "metrics", "status"))
    return spark.read.parquet(f"{output}/metrics")

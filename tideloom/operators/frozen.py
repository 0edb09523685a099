"""Candidate lists that are drawn once, frozen with a digest, and resolved by row id.

A frozen list is a Parquet folder bucketed and sorted by row id, with a manifest beside it. It is read back only
if its rows still give the digest of the manifest, and a case is answered only if its list has the promised size
and holds the target; anything else is an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideloom.operators.prep import numbered
from tideloom.operators.protocol import digest, exists, remove, write_json

_CHUNK = 4096  # rows, or digests, that one digest covers


def _place_of(text: Column, count: int) -> Column:
    """The first 64 bits of a text's SHA-256, as a number without a sign, modulo count."""
    if count >= 1 << 31:
        raise ValueError("the ring holds 2 ** 31 - 1 items at most")
    hexed = F.sha2(text, 256)
    high, low = (F.conv(F.substring(hexed, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.pmod(F.pmod(high, F.lit(count)) * F.lit((1 << 32) % count).cast("long") + low, F.lit(count).cast("long"))


def ring_sample(cases: DataFrame, items: DataFrame, size: int, seed: int = 0, dataset: str = "") -> DataFrame:
    """cases(row_id, item_id), items(item_id) -> (row_id, item_id): the target and size - 1 items of a slice of the ring.

    The ring is the catalogue in the order of the SHA-256 of `seed|dataset|item`. A case's slice starts at the
    SHA-256 of `seed|row_id` and passes over its target; it comes by an equi-join on places.
    """
    catalogue = items.select("item_id").distinct()
    ring = numbered(catalogue, [F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(dataset), F.col("item_id").cast("string")), 256), F.col("item_id")], "place")
    count = catalogue.count()
    if not count:
        return cases.select("row_id", "item_id")
    others = min(size, count) - 1
    start = _place_of(F.concat_ws("|", F.lit(str(seed)), "row_id"), count)
    drawn = cases.select("row_id", F.col("item_id").alias("target"), start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(min(others, count - 1)))).alias("offset"))
    met = drawn.withColumn("place", F.pmod(F.col("start") + F.col("offset"), F.lit(count).cast("long"))).join(ring, "place").where("item_id <> target")
    kept = met.withColumn("r", F.row_number().over(Window.partitionBy("row_id").orderBy("offset"))).where(F.col("r") <= others)
    return kept.select("row_id", "item_id").union(cases.select("row_id", "item_id"))


def listed(candidates: DataFrame, cases: DataFrame) -> DataFrame:
    """candidates(row_id, item_id), cases(row_id, item_id) -> (row_id, target_item, candidate_items as sorted text)."""
    lists = candidates.groupBy("row_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("candidate_items"))
    return cases.select("row_id", F.col("item_id").cast("string").alias("target_item")).join(lists, "row_id")


def ordered_digest(frame: DataFrame, order: list[str]) -> dict:
    """{rows, sha256} of a table in a total order: other rows, and the same rows in another order, give another digest.

    A tree of digests: each covers 4096 rows, or 4096 digests of the level below, in order. So it does not depend
    on partitions, and no task and not the driver sees more than one node.
    """
    level = numbered(frame.select(*order, F.sha2(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"}), 256).alias("h")), list(order), "place").select("place", "h")
    rows = size = level.count()
    while True:
        nodes = level.groupBy(F.expr(f"place div {_CHUNK}").alias("node")).agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("below"))
        level = nodes.select(F.col("node").alias("place"), F.sha2(F.array_join(F.transform("below", lambda x: x["h"]), ""), 256).alias("h"))
        size = -(-size // _CHUNK)
        if size <= 1:
            break
    top = level.first()
    return {"rows": rows, "sha256": top["h"] if top else digest({})}


def planned(datasets: Mapping[str, dict], folder: str) -> dict:
    """What a freeze would write for each dataset(size, seed, splits), without reading any data."""
    entries = {name: {"candidates": f"{folder}/{name}/candidates", "manifest": f"{folder}/{name}/manifest", **{k: spec[k] for k in ("size", "seed", "splits") if k in spec}} for name, spec in sorted(datasets.items())}
    return {"status": "planned", "datasets": entries, "sha256": digest(entries)}


def freeze(lists: DataFrame, folder: str, size: int, buckets: int = 16, facts: dict | None = None, force: bool = False) -> dict:
    """Write listed(...) below folder, bucketed by row_id, and its manifest; a frozen folder is not written again unless forced."""
    spark = lists.sparkSession
    if exists(spark, f"{folder}/manifest") and not force:
        raise FileExistsError(f"{folder} is frozen already")
    problems = lists.agg(F.count("*").alias("rows"), F.count_if(F.size("candidate_items") != size).alias("sizes"), F.count_if(~F.array_contains("candidate_items", F.col("target_item"))).alias("targets"), F.countDistinct("row_id").alias("ids")).first()
    if problems["sizes"] or problems["targets"] or problems["ids"] != problems["rows"]:
        raise ValueError(f"{problems['sizes']} lists are not of size {size}, {problems['targets']} lack their target, {problems['rows'] - problems['ids']} row ids repeat")
    remove(spark, f"{folder}/manifest")
    name = f"frozen_{uuid.uuid4().hex}"
    remove(spark, f"{folder}/candidates")
    lists.select("row_id", "target_item", "candidate_items").write.bucketBy(buckets, "row_id").sortBy("row_id").option("path", f"{folder}/candidates").format("parquet").saveAsTable(name)
    manifest = {"buckets": buckets, "size": size, **ordered_digest(spark.table(name), ["row_id"]), **(facts or {})}
    spark.sql(f"DROP TABLE {name}")  # the files stay
    write_json(spark, f"{folder}/manifest", manifest)
    return manifest


def opened(spark: SparkSession, folder: str, sha256: str | None = None, verify: bool = True) -> tuple[DataFrame, dict]:
    """The lists of a frozen folder, still bucketed, and its manifest; an error where they are not what was frozen, or not `sha256`."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    name = f"frozen_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (row_id STRING, target_item STRING, candidate_items ARRAY<STRING>) USING parquet LOCATION '{folder}/candidates' CLUSTERED BY (row_id) SORTED BY (row_id) INTO {int(manifest['buckets'])} BUCKETS")
    lists = spark.table(name)
    if sha256 not in (None, manifest["sha256"]):
        raise ValueError(f"{folder} holds {manifest['sha256']} and not {sha256}")
    if verify and (found := ordered_digest(lists, ["row_id"])["sha256"]) != manifest["sha256"]:
        raise ValueError(f"the rows of {folder} give {found}, its manifest {manifest['sha256']}")
    return lists, manifest


def resolve(cases: DataFrame, folder: str, sha256: str | None = None, verify: bool = True) -> DataFrame:
    """cases(row_id, target_item, ...) with candidate_items. A case without a list, with another target or size, is an error.

    The frozen side is read by its buckets and is not exchanged.
    """
    lists, manifest = opened(cases.sparkSession, folder, sha256, verify)
    found = cases.join(lists.withColumnRenamed("target_item", "__target"), "row_id", "left")
    wrong = found.where(F.col("__target").isNull() | (F.col("__target") != F.col("target_item").cast("string")) | (F.size("candidate_items") != manifest["size"]) | ~F.array_contains("candidate_items", F.col("target_item").cast("string")))
    first = wrong.select("row_id").limit(5).collect()
    if first:
        raise ValueError("no list, or another target or size, for " + ", ".join(str(r["row_id"]) for r in first))
    return found.drop("__target")


def batches(resolved: DataFrame, size: int, order: list[str]) -> DataFrame:
    """resolved with `batch`, the number of its batch of `size` rows in the given total order."""
    return numbered(resolved, order, "__place").withColumn("batch", F.expr(f"__place div {int(size)}")).drop("__place")

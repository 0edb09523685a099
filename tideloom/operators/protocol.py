"""Manifests and audits of runs: frozen configurations, fingerprints, integrity, failures, ablation switches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(context._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.exists(found)


def names_below(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none where it is not there."""
    found, system = _path(spark, folder)
    return sorted(entry.getPath().getName() for entry in system.listStatus(found)) if system.exists(found) else []


def remove(spark: SparkSession, path: str) -> None:
    """A file or folder goes, if it is there."""
    found, system = _path(spark, path)
    system.delete(found, True)


def file_listing(spark: SparkSession, folder: str) -> list[list]:
    """[path below the folder, bytes, time of change] of its files, in order: what tells one input from another without reading it."""
    found, system = _path(spark, folder)
    root, files, each = system.getFileStatus(found).getPath().toString(), [], system.listFiles(found, True)
    while each.hasNext():
        file = each.next()
        files.append([file.getPath().toString().removeprefix(root), file.getLen(), file.getModificationTime()])
    return [[root, 0, 0], *sorted(files)]


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def digest(value: dict) -> str:
    """SHA-256 of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def table_digest(frame: DataFrame) -> dict:
    """Rows and an order-free digest of a table."""
    row = frame.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*frame.columns).cast("decimal(38,0)")).alias("x")).first()
    return {"rows": row["n"], "sha256": hashlib.sha256(f"{row['n']}:{row['x']}".encode()).hexdigest()}


def freeze(spark: SparkSession, folder: str, version: str, configs: dict[str, dict], tables: dict[str, DataFrame], force: bool = False) -> dict:
    """Write a manifest of configurations and tables. An existing one is not overwritten unless forced."""
    if exists(spark, f"{folder}/manifest") and not force:
        raise FileExistsError(f"{folder}/manifest is frozen already")
    named = lambda key: sorted({str(x) for c in configs.values() for x in c.get(key, [])})
    manifest = {"version": version, "configs": {n: digest(c) for n, c in configs.items()}, "methods": named("methods"), "seeds": named("seeds"), "metrics": named("metrics"), "tables": {n: table_digest(t) for n, t in tables.items()}}
    write_json(spark, f"{folder}/manifest", manifest)
    return manifest


def lock(spark: SparkSession, folder: str, required: tuple[str, ...] = ("config", "predictions", "metrics")) -> dict:
    """Mark a run as complete; an error where a required part is missing."""
    missing = [name for name in required if not exists(spark, f"{folder}/{name}")]
    if missing:
        raise ValueError(f"{folder} lacks {', '.join(missing)}")
    manifest = {"locked": True, "required": list(required)}
    write_json(spark, f"{folder}/lock", manifest)
    return manifest


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files below a path. Executors read each file in pieces of 1 MiB, so its size is no bound."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for name in batch.column(0).to_pylist():
                system, inside = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                seen = hashlib.sha256()
                with system.open_input_stream(unquote(inside)) as stream:
                    while piece := stream.read(1 << 20):
                        seen.update(piece)
                sums.append(seen.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.string())], names=["path", "bytes", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    return files.mapInArrow(hashed, "path string, bytes long, sha256 string")


def integrity(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """before and after(keys, sha256): every artifact of either, and whether it is the same in both."""
    a, b = before.select(*keys, F.col("sha256").alias("before")), after.select(*keys, F.col("sha256").alias("after"))
    return a.join(b, keys, "full_outer").withColumn("unchanged", F.coalesce(F.col("before") == F.col("after"), F.lit(False)))


def failures(status: DataFrame) -> DataFrame:
    """status(dataset, method, status, message) -> the rows that did not succeed, with a category."""
    state = F.lower(F.coalesce("status", F.lit("succeeded")))
    text = F.lower(F.concat_ws(" ", "status", "message"))
    category = F.when(text.contains("skip") | text.contains("unavailable"), "skipped_dependency").when(text.contains("validation"), "validation_error").otherwise("runtime_error")
    return status.where(~state.isin("succeeded", "success", "trained")).withColumn("category", category)


def failure_counts(status: DataFrame) -> DataFrame:
    return failures(status).groupBy("category").agg(F.count("*").alias("failures"))


# The switches and their defaults.
@dataclass(frozen=True)
class Switches:
    """What a method uses; these are the defaults that an ablation turns off."""

    use_llm: bool = False
    use_retrieval: bool = True
    use_temporal_graph: bool = True
    use_transition_edges: bool = True
    use_time_window_edges: bool = True
    use_time_gap_tags: bool = True
    use_semantic_similarity: bool = True
    use_user_profile: bool = True
    use_recent_block: bool = True
    use_long_term_block: bool = True
    use_grounding_constraint: bool = True
    use_explanation: bool = True
    use_dynamic_encoder: bool = False


_GRAPH = ("use_temporal_graph", "use_transition_edges", "use_time_window_edges", "use_time_gap_tags")
_PROFILE = ("use_user_profile", "use_recent_block", "use_long_term_block")

# The named ablations and the switches that each turns off.
ABLATIONS = {
    "full": (),
    "w_o_llm": ("use_llm",),
    "w_o_retrieval": ("use_retrieval",),
    "w_o_temporal_graph": _GRAPH,
    "w_o_transition_edges": ("use_transition_edges",),
    "w_o_time_window_edges": ("use_time_window_edges",),
    "w_o_time_gap_tags": ("use_time_gap_tags",),
    "w_o_semantic_similarity": ("use_semantic_similarity",),
    "w_o_user_profile": _PROFILE,
    "w_o_grounding_constraint": ("use_grounding_constraint",),
    "w_o_explanation": ("use_explanation",),
    "w_o_dynamic_encoder": ("use_dynamic_encoder",),
    "encoder_only": (
        "use_llm", "use_retrieval", "use_temporal_graph", "use_transition_edges", "use_time_window_edges", "use_time_gap_tags",
        "use_semantic_similarity", "use_user_profile", "use_recent_block", "use_long_term_block", "use_grounding_constraint",
    ),
    "text_only": (*_GRAPH, "use_dynamic_encoder"),
    "graph_only": ("use_llm", "use_semantic_similarity", "use_explanation", "use_dynamic_encoder"),
}


def ablation(name: str) -> Switches:
    if name not in ABLATIONS:
        raise ValueError(f"no such ablation: {name}")
    return replace(Switches(), **dict.fromkeys(ABLATIONS[name], False), **({"use_dynamic_encoder": True} if name == "encoder_only" else {}))


def ablated(evidence: DataFrame, name: str) -> DataFrame:
    """Evidence rows of the kinds that an ablation leaves on; gap tags go where these are off."""
    on = ablation(name)
    kinds = {"transition": on.use_transition_edges, "time_window": on.use_time_window_edges, "semantic": on.use_semantic_similarity, "contrastive": on.use_semantic_similarity and on.use_transition_edges, "history": on.use_recent_block, "user_drift": on.use_long_term_block}
    left = evidence.where(F.col("evidence_type").isin([k for k, keep in kinds.items() if keep]) if on.use_retrieval else F.lit(False))
    return left if on.use_time_gap_tags else left.withColumn("gap_bucket", F.lit(None).cast("string"))

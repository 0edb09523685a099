"""Prompts, answers, request cost and a stand-in provider, as columns."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.operators.prep import first_per_key

# Features that a prompt variant shows.
VARIANTS = {
    "history_only": (),
    "with_time_gaps": ("gaps",),
    "with_time_buckets": ("buckets",),
    "with_transition_evidence": ("transition",),
    "with_time_window_evidence": ("window",),
    "with_contrastive_evidence": ("contrastive",),
    "full": ("gaps", "buckets", "transition", "window", "contrastive"),
}


def human_gap(gap: Column) -> Column:
    """A length of time in words: seconds, hours or days, as printf %.0f and %.1f round."""

    def shown(value: Column, places: int, unit: str) -> Column:
        return F.concat(F.replace(F.format_number(value.cast("double"), places), F.lit(","), F.lit("")), F.lit(f" {unit}"))

    return F.when(gap.isNull(), "unknown gap").when(gap < 3600, shown(gap, 0, "seconds")).when(gap < 86_400, shown(gap / 3600, 1, "hours")).otherwise(shown(gap / 86_400, 1, "days"))


def chain(steps: DataFrame, variant: str) -> DataFrame:
    """steps(case_id, place, title, gap, bucket) -> the history line of a prompt."""
    shown = VARIANTS[variant]
    piece = F.col("title")
    if "gaps" in shown:
        piece = F.when(F.col("place") == 0, F.col("title")).otherwise(F.concat(F.lit("after "), human_gap(F.col("gap")), F.lit(" -> "), F.col("title")))
    elif "buckets" in shown:
        piece = F.concat(F.lit("["), F.coalesce("bucket", F.lit("unknown")), F.lit("] "), F.col("title"))
    rows = steps.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))).alias("p"))
    return rows.select("case_id", F.array_join(F.col("p.piece"), "; ").alias("history_line"))


def build(cases: DataFrame, variant: str) -> DataFrame:
    """cases(case_id, history_line, candidate_line, evidence_line) -> prompt text, the same for the same row."""
    lines = [F.lit("Rank the candidates for the user's next item. Answer with JSON."), F.concat(F.lit("History: "), F.col("history_line")), F.concat(F.lit("Candidates: "), F.col("candidate_line"))]
    if set(VARIANTS[variant]) & {"transition", "window", "contrastive"}:
        lines.append(F.when(F.length("evidence_line") > 0, F.concat(F.lit("Evidence: "), F.col("evidence_line"))))
    return cases.withColumn("prompt", F.concat_ws("\n", *lines)).withColumn("variant", F.lit(variant))


_ANSWER = T.StructType([T.StructField("parse_success", T.BooleanType()), T.StructField("ranked", T.ArrayType(T.StringType())), T.StructField("invalid", T.ArrayType(T.StringType())), T.StructField("duplicates", T.ArrayType(T.StringType())), T.StructField("evidence_ids", T.ArrayType(T.StringType()))])
_FENCE = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.DOTALL)


def json_object(text: str) -> dict | None:
    """The first JSON object of an answer: fenced, or the first balanced braces outside strings."""
    fenced = _FENCE.search(text)
    decoder = json.JSONDecoder()
    for start in ([fenced.start(1)] if fenced else []) + [m.start() for m in re.finditer(r"\{", text)]:
        try:
            found, _ = decoder.raw_decode(text, start)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def parse_answer(text: str | None, candidates: Sequence[str]) -> dict:
    """Ranked candidates of an answer, ids that are none, repeats, and the evidence it names."""
    found = json_object(text or "")
    if found is None:
        return {"parse_success": False, "ranked": [], "invalid": [], "duplicates": [], "evidence_ids": []}
    given = found.get("ranked_items", found.get("ranking", []))
    known, ranked, invalid, repeats = set(candidates), [], [], []
    for x in given if isinstance(given, list) else []:
        name = str(x.get("item_id") if isinstance(x, dict) else x)
        (invalid if name not in known else repeats if name in ranked else ranked).append(name)
    used = found.get("evidence_ids", [])
    return {"parse_success": isinstance(given, list), "ranked": ranked, "invalid": invalid, "duplicates": repeats, "evidence_ids": [str(e) for e in used] if isinstance(used, list) else []}


def parse(answers: DataFrame) -> DataFrame:
    """answers(response, candidates array<string>, ...) with the parsed answer, Arrow-batched."""

    @F.pandas_udf(_ANSWER)
    def parsed(text: pd.Series, candidates: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_answer(t, list(c) if c is not None else []) for t, c in zip(text, candidates, strict=True)], columns=[f.name for f in _ANSWER])

    return answers.withColumn("answer", parsed("response", "candidates")).select("*", "answer.*").drop("answer")


def audit(answers: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """answers(keys, response, candidates) -> predictions, answers that could not be read, and answers that name items that are no candidates.

    A prediction lists the ranked candidates and then the made-up ids, with scores that fall from their number to 1.
    """
    rows = parse(answers)
    predicted = F.concat("ranked", "invalid")
    scores = F.transform(predicted, lambda x, i: (F.size(predicted) - i).cast("double"))
    predictions = rows.select(*keys, "candidates", predicted.alias("predicted_items"), scores.alias("scores"), "parse_success", "duplicates", "invalid", "evidence_ids")
    return predictions, rows.where("not parse_success").select(*keys, "response"), rows.where(F.size("invalid") > 0).select(*keys, "invalid", "response")


def store(answers: DataFrame, folder: str) -> None:
    """Add answers(cache_key, ...) to a store of answers, which uncached() and stored() read back."""
    answers.write.mode("append").parquet(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The answers of a store, one a key: of several writers' answers the first as text, so that a join doubles none."""
    answers = spark.read.parquet(folder)
    return first_per_key(answers, ["cache_key"], [F.to_json(F.struct(*sorted(answers.columns)))])


def complete(ranked: Column, candidates: Column) -> Column:
    """What was ranked, then the candidates that were not."""
    return F.array_distinct(F.concat(ranked, F.array_except(candidates, ranked)))


def mock_answer(kind: str, candidates: Column, scores: Column | None = None) -> Column:
    """The answer of a stand-in provider: identity, reverse, hallucinating, or transition_aware by a map of scores."""
    if kind == "reverse":
        order = F.reverse(candidates)
    elif kind == "hallucinating":
        order = F.concat(F.array(F.lit("made_up_item")), candidates)
    elif kind in ("transition_aware", "time_bucket_aware") and scores is not None:
        keyed = F.transform(candidates, lambda c, i: F.struct((-F.coalesce(F.element_at(scores, c), F.lit(0.0))).alias("s"), i.alias("i"), c.alias("c")))
        order = F.transform(F.array_sort(keyed), lambda s: s["c"])
    else:
        order = candidates
    return F.to_json(F.struct(order.alias("ranked_items")))


def token_estimate(text: Column) -> Column:
    """The larger of a quarter of the characters (rounded up) and the words, 1 at least; 0 for no text."""
    words = F.size(F.filter(F.split(text, "\\s+"), lambda w: w != ""))
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.greatest(F.ceil(F.length(text) / 4), words, F.lit(1))).cast("long")


def request_cost(prompt_tokens: Column, completion_tokens: Column, cache_hit: Column, hit_price: float, miss_price: float, output_price: float) -> Column:
    """Dollars at prices for a million tokens."""
    return prompt_tokens / 1e6 * F.when(cache_hit, hit_price).otherwise(miss_price) + completion_tokens / 1e6 * output_price


def cost_summary(requests: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """requests(prompt_tokens, completion_tokens, latency_ms, cache_hit, cost): counts, cost, latency, cache share and requests a minute."""
    seconds = F.sum("latency_ms") / 1000
    return requests.groupBy(*groups).agg(F.count("*").alias("requests"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.sum("cost").alias("estimated_cost"), F.avg("latency_ms").alias("latency_mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)").alias("latency_p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("latency_p95"), F.avg(F.col("cache_hit").cast("double")).alias("cache_hit_rate"), F.when(seconds > 0, F.count("*") * 60 / seconds).otherwise(0.0).alias("requests_per_minute"))


def uncached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose key no cached answer has."""
    return requests.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def cache_key(*parts: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)

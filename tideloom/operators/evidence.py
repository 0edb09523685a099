"""Evidence rows from graphs and histories, their text, and whether answers are grounded in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.functions.text import item_tokens, jaccard
from tideloom.operators.prep import first_per_key

COLUMNS = ("case_id", "evidence_type", "source_id", "target_id", "transition_count", "window_score", "similarity", "recent_signal", "mean_gap", "gap_bucket", "drift_from", "drift_to")
_KINDS = {"transition_count": "long", "window_score": "double", "similarity": "double", "recent_signal": "double", "mean_gap": "double", "gap_bucket": "string", "drift_from": "string", "drift_to": "string"}


def _shaped(frame: DataFrame, kind: str) -> DataFrame:
    """Evidence columns in order, nulls where the kind has none, and an id that depends on the content alone."""
    full = frame.withColumn("evidence_type", F.lit(kind))
    for name, of in _KINDS.items():
        full = full.withColumn(name, F.col(name).cast(of) if name in frame.columns else F.lit(None).cast(of))
    identity = F.concat(F.lit("ev_"), F.substring(F.sha1(F.concat_ws("|", "evidence_type", "source_id", "target_id")), 1, 16))
    return full.select(*COLUMNS, identity.alias("evidence_id"))


def dominant_bucket(buckets: Sequence[str]) -> Column:
    """The largest of several count columns, ties by name, null where all are zero."""
    best = F.array_sort(F.array(*[F.struct((-F.col(b)).alias("n"), F.lit(b.split("_", 1)[1]).alias("b")) for b in buckets]))[0]
    return F.when(best["n"] < 0, best["b"])


def probe(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """sources(case_id, source_id, recency) and candidates(case_id, target_id) -> every pair of a case, cut, since four kinds of evidence start from it."""
    return cut(sources.select("case_id", "source_id", "recency").join(candidates.select("case_id", "target_id"), "case_id"))


def transition_evidence(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of probe() that an edge joins."""
    known = edges.select("source_id", "target_id", F.col("count").alias("transition_count"), "mean_gap", "gap_bucket")
    return _shaped(pairs.drop("recency").join(known, ["source_id", "target_id"]), "transition")


def window_evidence(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return _shaped(pairs.drop("recency").join(edges.select("source_id", "target_id", F.col("weight").alias("window_score"), "mean_gap"), ["source_id", "target_id"]), "time_window")


def similar(pairs: DataFrame, items: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs of probe() of two different items with the likeness of their texts. A pair of items is compared once, however many cases have it."""
    bags = items.select("item_id", item_tokens(F.concat_ws(" ", *columns)).alias("t"))
    a = bags.select(F.col("item_id").alias("source_id"), F.col("t").alias("ta"))
    b = bags.select(F.col("item_id").alias("target_id"), F.col("t").alias("tb"))
    once = pairs.where("source_id <> target_id").select("source_id", "target_id").distinct().join(a, "source_id").join(b, "target_id")
    return cut(pairs.drop("recency").join(once.select("source_id", "target_id", jaccard(F.col("ta"), F.col("tb")).alias("similarity")), ["source_id", "target_id"]))


def semantic_evidence(alike: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Rows of similar() from the threshold on."""
    return _shaped(alike.where(F.col("similarity") >= threshold), "semantic")


def contrastive_evidence(alike: DataFrame, edges: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Moves that text similarity does not explain."""
    known = edges.select("source_id", "target_id", F.col("count").alias("transition_count"), "gap_bucket")
    return _shaped(alike.where(F.col("similarity") <= threshold).join(known, ["source_id", "target_id"]), "contrastive")


def history_evidence(pairs: DataFrame) -> DataFrame:
    """A signal of 1 / recency."""
    return _shaped(pairs.withColumn("recent_signal", 1 / F.col("recency")).drop("recency"), "history")


def drift_evidence(histories: DataFrame, candidates: DataFrame, items: DataFrame) -> DataFrame:
    """histories(case_id, items): where the dominant categories of the older and newer half differ and the candidate has the newer one."""
    placed = histories.select("case_id", F.size("items").alias("n"), F.posexplode("items").alias("p", "item_id")).where("n >= 2")
    half = F.when(F.col("p") < F.floor(F.col("n") / 2), "old").otherwise("new")
    kinds = placed.join(items.select("item_id", "category"), "item_id").where("category is not null").groupBy("case_id", half.alias("half"), "category").agg(F.count("*").alias("k"))
    best = kinds.withColumn("r", F.row_number().over(Window.partitionBy("case_id", "half").orderBy(F.desc("k"), "category"))).where("r = 1")
    moved = best.groupBy("case_id").agg(F.max(F.when(F.col("half") == "old", F.col("category"))).alias("drift_from"), F.max(F.when(F.col("half") == "new", F.col("category"))).alias("drift_to")).where("drift_from <> drift_to")
    tagged = candidates.select("case_id", "target_id").join(items.select(F.col("item_id").alias("target_id"), "category"), "target_id")
    return _shaped(tagged.join(moved, "case_id").where("category = drift_to").withColumn("source_id", F.lit(None).cast("long")).drop("category"), "user_drift")


def first_of_each(evidence: DataFrame, top_k: int) -> DataFrame:
    """One row an id, the strongest and then the first as text, and top_k rows a candidate at most: transitions and windows before the rest, strongest first."""
    kind = F.array_position(F.array(*[F.lit(x) for x in ("transition", "time_window", "contrastive", "semantic", "history", "user_drift")]), F.col("evidence_type"))
    strength = F.coalesce(F.col("transition_count").cast("double"), F.col("window_score"), F.col("similarity"), F.col("recent_signal"), F.lit(0.0))
    once = first_per_key(evidence, ["case_id", "evidence_id"], [F.desc(strength), F.to_json(F.struct(*sorted(evidence.columns)))])
    w = Window.partitionBy("case_id", "target_id").orderBy(kind, F.desc(strength), "evidence_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def weighted_score(evidence: DataFrame, transition: float = 1.0, window: float = 0.5, semantic: float = 0.3, recent: float = 0.2) -> DataFrame:
    """Summed weighted signals of each candidate."""
    part = transition * F.coalesce("transition_count", F.lit(0)) + window * F.coalesce("window_score", F.lit(0.0)) + semantic * F.coalesce("similarity", F.lit(0.0)) + recent * F.coalesce("recent_signal", F.lit(0.0))
    return evidence.groupBy("case_id", "target_id").agg(F.sum(part).alias("score"))


def short_number(value: Column) -> Column:
    """As printf %.4g, for zero and values from 1e-4 to 1e15: four significant digits, trailing zeros dropped, an exponent from 1e4 on."""
    size, sign = F.abs(value), F.when(value < 0, "-").otherwise("")

    def trimmed(text: Column) -> Column:
        text = F.replace(text, F.lit(","), F.lit(""))
        return F.when(F.instr(text, ".") > 0, F.regexp_replace(F.regexp_replace(text, "0+$", ""), "[.]$", "")).otherwise(text)

    def with_exponent(e: int) -> Column:
        mantissa = F.bround(size.cast("decimal(38,12)"), 3 - e) / F.lit(10**e).cast("decimal(20,0)")
        return F.concat(trimmed(mantissa.cast("decimal(10,3)").cast("string")), F.lit(f"e+{e:02d}"))

    out = F.when(size == 0, "0")
    for e in range(15, -5, -1):  # an amount that rounds up to a power of ten counts as one
        out = out.when(size >= 10.0**e - 0.5 * 10.0 ** (e - 4), with_exponent(e) if e > 3 else trimmed(F.format_number(size, 3 - e)))
    return F.concat(sign, out)


def translate(evidence: DataFrame, label: str = "item {}") -> DataFrame:
    """A sentence for each row from its own fields."""
    before, after = label.split("{}")
    source = F.concat(F.lit(before), F.col("source_id").cast("string"), F.lit(after))
    target = F.concat(F.lit(before), F.col("target_id").cast("string"), F.lit(after))

    def part(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), value.cast("string")))

    count = part("transition_count", F.col("transition_count"))
    gap = part("mean_gap_seconds", short_number(F.col("mean_gap")))
    bucket = part("gap_bucket", F.col("gap_bucket"))
    similar = part("semantic_similarity", short_number(F.col("similarity")))

    def said(*parts: Column) -> Column:
        return F.concat(F.concat_ws("; ", *parts), F.lit("."))

    kind = F.col("evidence_type")
    text = (
        F.when(kind == "transition", said(F.concat(F.lit("After "), source, F.lit(", users reached "), target), count, gap, bucket))
        .when(kind == "time_window", said(F.concat(source, F.lit(" and "), target, F.lit(" appeared in the configured time window")), part("time_window_score", short_number(F.col("window_score"))), bucket))
        .when(kind == "contrastive", said(F.concat(target, F.lit(" is contrasted with "), source), similar, F.when(F.col("transition_count") > 0, count), bucket))
        .when(kind == "semantic", said(F.concat(source, F.lit(" and "), target, F.lit(" share item metadata evidence")), similar))
        .when(kind == "history", said(F.concat(source, F.lit(" is in the user's history before considering "), target), part("recent_signal", short_number(F.col("recent_signal")))))
        .otherwise(said(F.concat(F.lit("History category drift supports checking "), target), part("drift_from", F.col("drift_from")), part("drift_to", F.col("drift_to"))))
    )
    return evidence.withColumn("text", text)


def grounding(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """answers(case_id, evidence_id, mentions_bucket) against the evidence that was given: rates of grounded ids and of bucket use."""
    known = allowed.select("case_id", "evidence_id", "gap_bucket").distinct().withColumn("__k", F.lit(True))
    joined = answers.join(known, ["case_id", "evidence_id"], "left")
    good = F.coalesce("__k", F.lit(False))
    return joined.agg(F.count("*").alias("used"), F.avg(good.cast("double")).alias("grounding_rate"), F.avg((good & F.coalesce(F.col("mentions_bucket") == F.col("gap_bucket"), F.lit(False))).cast("double")).alias("bucket_rate"))


def leaks(rows: DataFrame) -> DataFrame:
    """rows(case_id, history, target_id, case_ts, evidence_ts, provenance) that break the protocol, with the reason; must be empty for a clean run."""
    reason = F.when(F.array_contains("history", F.col("target_id")), "target_in_history").when(F.col("evidence_ts") >= F.col("case_ts"), "evidence_after_case").when(F.col("provenance") != "train_only", "evidence_not_from_train")
    return rows.withColumn("violation", reason).where("violation is not null")

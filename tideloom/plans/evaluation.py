"""Queries: runs of methods, schema checks, variants against a reference, conversion, costs and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.operators import checks, evaluate, evidence, prep, prompts, protocol, rank, runs, stats
from tideloom.plans import matrix, sql
from tideloom.plans.base import rounded, split_events, train_events
from tideloom.plans.experiments import _PERTURBED, _ranked, _variants
from tideloom.plans.language import _case_sql, _evidence
from tideloom.plans.ranking import _LAST, _POP, _RECENT, _RING
from tideloom.plans.registry import register
from tideloom.sources.tables import event_interactions, part_items, table

_KS = (1, 5, 10)


def _hits(ks=_KS) -> str:
    return ", ".join(f"round(avg((coalesce(rank, 99) <= {k})::INT), 6) AS recall_{k}, round(avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_{k}, round(avg(CASE WHEN rank <= {k} THEN 1.0 / rank ELSE 0 END), 6) AS mrr_{k}" for k in ks)


_SHOWN = """round(count(DISTINCT item_id) FILTER (item_id IN (SELECT p_partkey FROM part)), 6)::BIGINT AS item_coverage, round(count(DISTINCT item_id) FILTER (item_id IN (SELECT p_partkey FROM part)) / (SELECT count(*) FROM part), 6) AS coverage,
  round(avg((item_id NOT IN (SELECT p_partkey FROM part))::INT), 6) AS hallucination_rate, round(1 - avg((item_id NOT IN (SELECT p_partkey FROM part))::INT), 6) AS validity_rate, round(avg((item_id IN (SELECT item_id FROM tail))::INT), 6) AS long_tail_ratio,
  round(avg(-log2((coalesce(n, 0) + 1) / ((SELECT sum(n) + count(*) + 1 FROM pop)))), 6) AS novelty"""

_METHODS = """r5 AS (SELECT user_id, source_id FROM recent WHERE p <= 5),
mk AS (SELECT u.user_id, p.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY round(coalesce(m.count, 0) + 1e-6 * coalesce(p.n, 0), 9) DESC, p.item_id) AS rank FROM last u CROSS JOIN pop p LEFT JOIN moves m ON m.source_id = u.source_id AND m.target_id = p.item_id QUALIFY rank <= 10),
tr AS (SELECT user_id, target_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY sum(count)::DOUBLE DESC, target_id) AS rank FROM r5 JOIN moves USING (source_id) WHERE NOT EXISTS (SELECT 1 FROM loo l WHERE l.split = 'train' AND l.user_id = r5.user_id AND l.item_id = moves.target_id) GROUP BY user_id, target_id QUALIFY rank <= 10),
pp AS (SELECT item_id, row_number() OVER (ORDER BY n DESC, item_id) AS rank FROM pop QUALIFY rank <= 10),
preds AS (SELECT 'popularity' AS method, user_id, pp.item_id, pp.rank FROM cases CROSS JOIN pp UNION ALL SELECT 'markov', user_id, item_id, rank FROM mk UNION ALL SELECT 'transition', user_id, item_id, rank FROM tr),
told AS (SELECT m.method, c.domain, c.user_id, p.rank FROM cases c CROSS JOIN (VALUES ('popularity'), ('markov'), ('transition')) m(method) LEFT JOIN preds p ON p.method = m.method AND p.user_id = c.user_id AND p.item_id = c.item_id),
shown AS (SELECT preds.method, c.domain, preds.item_id, pop.n FROM preds JOIN (SELECT user_id, domain FROM cases) c USING (user_id) LEFT JOIN pop USING (item_id))"""


def _methods(spark, folder):
    parts = [matrix.predictions(spark, folder, name) for name in ("popularity", "markov", "transition")]
    return cut(parts[0].unionByName(parts[1]).unionByName(parts[2]))  # read by both halves of the metrics


@register(
    "method_metrics",
    sql.query(
        sql.EVENTS, sql.SPLIT, sql.CASES, sql.ALL_TRANSITIONS, _POP, sql.TAIL, _LAST, _RECENT, _METHODS,
        f"a AS (SELECT method, domain, count(*) AS num_predictions, {_hits()} FROM told GROUP BY GROUPING SETS ((), (method), (method, domain)))",
        f"b AS (SELECT method, domain, {_SHOWN} FROM shown GROUP BY GROUPING SETS ((), (method), (method, domain)))",
        select="SELECT a.*, b.* EXCLUDE (method, domain) FROM a LEFT JOIN b ON a.method IS NOT DISTINCT FROM b.method AND a.domain IS NOT DISTINCT FROM b.domain",
    ),
)
def _(spark, folder):
    return rounded(evaluate.accumulated(_methods(spark, folder), part_items(spark, folder), train_events(spark, folder), [[], ["method"], ["method", "domain"]]).drop("level"))


def _variant_rows(spark, folder):
    """The first ten of every perturbed history's retrieval, with the user's validation item as target."""
    target = split_events(spark, folder).where("split = 'val'").select("user_id", F.col("item_id").cast("string").alias("target_item"))
    best = _ranked(spark, folder).where("rank <= 10").groupBy("user_id", "variant").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("item_id").cast("string").alias("item")))).alias("r"))
    cases = _variants(spark, folder).select("user_id", "variant").join(target, "user_id")
    none = F.array().cast("array<string>")
    return cut(cases.join(best, ["user_id", "variant"], "left").select("user_id", "variant", "target_item", F.coalesce("r.item", none).alias("predicted_items"), none.alias("candidate_items")))


_VARIANT_SQL = (sql.EVENTS, sql.SPLIT, sql.ALL_TRANSITIONS, _PERTURBED, _POP, sql.TAIL,
                "shown AS (SELECT variant, item_id, n FROM rk LEFT JOIN pop USING (item_id) WHERE rank <= 10)",
                f"vm AS (SELECT * FROM (SELECT variant, count(*) AS num_predictions, {_hits()} FROM tg GROUP BY variant) LEFT JOIN (SELECT variant, {_SHOWN} FROM shown GROUP BY variant) USING (variant))")


def _variant_metrics(spark, folder):
    return rounded(evaluate.accumulated(_variant_rows(spark, folder), part_items(spark, folder), train_events(spark, folder), [["variant"]]).drop("level"))


@register("variant_metrics", sql.query(*_VARIANT_SQL, select="SELECT * FROM vm"))
def _(spark, folder):
    return _variant_metrics(spark, folder)


_DELTAS = ("recall_5", "ndcg_5", "mrr_5", "validity_rate", "hallucination_rate")
_DELTA_SQL = "vd AS (SELECT a.variant, " + ", ".join(f"round(a.{n} - b.{n}, 6) AS delta_{n}" for n in _DELTAS) + " FROM vm a CROSS JOIN (SELECT * FROM vm WHERE variant = 'original') b)"


def _variant_deltas(spark, folder):
    return rounded(evaluate.against_reference(_variant_metrics(spark, folder), "variant", "original", _DELTAS))


@register("variant_deltas", sql.query(*_VARIANT_SQL, _DELTA_SQL, select="SELECT * FROM vd"))
def _(spark, folder):
    return _variant_deltas(spark, folder)


@register("strongest_variant", sql.query(*_VARIANT_SQL, _DELTA_SQL, select="SELECT *, greatest(abs(delta_recall_5), abs(delta_ndcg_5)) AS absolute_effect FROM vd WHERE variant <> 'original' ORDER BY absolute_effect DESC, variant LIMIT 1"))
def _(spark, folder):
    return evaluate.strongest(_variant_deltas(spark, folder), "variant", "original", ["recall_5", "ndcg_5"])


_CHANGE_SQL = """t5 AS (SELECT v.user_id, v.variant, list(rk.item_id ORDER BY rk.rank) FILTER (rk.item_id IS NOT NULL) AS l FROM v JOIN loo t ON t.user_id = v.user_id AND t.split = 'val' LEFT JOIN rk ON rk.user_id = v.user_id AND rk.variant = v.variant AND rk.rank <= 5 GROUP BY ALL),
cc AS (SELECT a.user_id, a.variant, CASE WHEN len(coalesce(a.l, [])) + len(coalesce(b.l, [])) = 0 THEN 1.0 ELSE len(list_intersect(coalesce(a.l, []), coalesce(b.l, []))) / len(list_distinct(list_concat(coalesce(a.l, []), coalesce(b.l, [])))) END AS overlap
  FROM t5 a JOIN t5 b ON a.user_id = b.user_id AND b.variant = 'original' AND a.variant <> 'original')"""


def _changes(spark, folder):
    return evaluate.case_changes(_variant_rows(spark, folder), ["user_id"], "variant", "original")


@register("case_changes", sql.query(sql.EVENTS, sql.SPLIT, sql.ALL_TRANSITIONS, _PERTURBED, _CHANGE_SQL, select="SELECT user_id, variant, round(overlap, 6) AS overlap, overlap < 1 AS output_changed FROM cc"))
def _(spark, folder):
    return rounded(_changes(spark, folder))


@register("change_rates", sql.query(sql.EVENTS, sql.SPLIT, sql.ALL_TRANSITIONS, _PERTURBED, _CHANGE_SQL, select="SELECT variant, count(*) AS compared, round(avg(overlap), 6) AS mean_overlap, round(1 - avg(overlap), 6) AS output_change_rate FROM cc GROUP BY variant"))
def _(spark, folder):
    return rounded(evaluate.change_rates(_changes(spark, folder), "variant"))


@register("recovered_cases", sql.query(sql.EVENTS, sql.SPLIT, sql.ALL_TRANSITIONS, _PERTURBED, select="SELECT count(*) AS compared, count(*) FILTER (coalesce(a.rank, 99) > 5 AND b.rank <= 5) AS recovered FROM tg a JOIN tg b ON a.user_id = b.user_id AND a.variant = 'remove_recent_5' AND b.variant = 'original'"))
def _(spark, folder):
    ranks = _variant_rows(spark, folder).withColumn("rank", evaluate.rank_of_target())
    return evaluate.recovered(ranks.where("variant = 'remove_recent_5'"), ranks.where("variant = 'original'"), ["user_id"])


@register("prediction_contributions", sql.query(sql.EVENTS, sql.SPLIT, sql.ALL_TRANSITIONS, _PERTURBED, select="SELECT user_id, (coalesce(rank, 99) <= 5)::INT::DOUBLE AS recall_5, round(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END, 6) AS ndcg_5, round(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END, 6) AS mrr_10 FROM tg WHERE variant = 'original'"))
def _(spark, folder):
    rows = _variant_rows(spark, folder).where("variant = 'original'")
    return rounded(evaluate.contributions(rows).select("user_id", "recall_5", "ndcg_5", "mrr_10"))


@register(
    "main_table",
    sql.query(sql.EVENTS, "r AS (SELECT domain, event_id % 3 AS seed, avg(rating) AS a, avg(user_id) AS b FROM ia GROUP BY ALL)", "m AS (SELECT domain, avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM r GROUP BY domain)", select="SELECT domain, printf('%.4f +/- %.4f', ma, sa) AS rating, printf('%.4f +/- %.4f', mb, sb) AS user, CASE WHEN domain = 'view' THEN '*' ELSE '' END AS significant FROM m"),
)
def _(spark, folder):
    events = event_interactions(spark, folder).groupBy("domain", (F.col("event_id") % 3).alias("seed")).agg(F.avg("rating").alias("rating"), F.avg("user_id").alias("user"))
    long = events.unpivot(["domain", "seed"], ["rating", "user"], "metric", "value")
    found = stats.multiseed(long, ["domain"], [0, 1, 2])
    return runs.main_table(found, ["domain"], ["rating", "user"], spark.createDataFrame([("view",)], "domain string"))


@register(
    "prediction_problems",
    sql.query(
        sql.EVENTS,
        "u AS (SELECT user_id, count(DISTINCT item_id) AS n FROM ia GROUP BY 1)",
        select="""SELECT user_id, CASE user_id % 9 WHEN 1 THEN 'missing required field: target_item' WHEN 2 THEN 'predicted_items must be a list of strings' WHEN 3 THEN CASE WHEN n <> 1 THEN 'scores must be empty or as many as predicted_items' END
      WHEN 4 THEN 'candidate_items or candidate_ref must be present' WHEN 5 THEN 'candidate_ref has empty field: artifact_path' WHEN 6 THEN 'candidate_ref.candidate_size must be int' WHEN 7 THEN 'candidate_ref.candidate_size must be positive' END AS problem,
      'unknown' AS method, 'prediction_row_v2' AS schema_version FROM u""",
    ),
)
def _(spark, folder):
    """Every user's items as a prediction, with one of eight faults by user_id; the ninth has none."""
    kind = F.col("user_id") % 9
    items = event_interactions(spark, folder).groupBy("user_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    ref = F.struct(F.lit("a").alias("artifact_id"), F.when(kind == 5, "").otherwise("p").alias("artifact_path"), F.lit("s").alias("artifact_sha256"), F.lit("r").alias("candidate_row_id"), F.when(kind == 6, "many").when(kind == 7, "0").otherwise("20").alias("candidate_size"))
    rows = items.select(
        "user_id",
        F.when(kind != 1, "7").alias("target_item"),
        F.when(kind != 2, F.col("items")).alias("predicted_items"),
        F.when(kind.isin(0, 1), F.col("items")).alias("candidate_items"),
        F.when(~kind.isin(0, 1, 4), ref).alias("candidate_ref"),
        F.when(kind == 3, F.array(F.lit(0.5))).alias("scores"),
    )
    return checks.checked_predictions(rows, "sampled").select("user_id", "problem", "method", "schema_version")


@register(
    "upstream_candidates",
    sql.query(
        sql.EVENTS, sql.SPLIT, sql.CASES, sql.ALL_TRANSITIONS, _POP, _LAST, _RECENT, _METHODS, _RING,
        "pl AS (SELECT list(item_id ORDER BY item_id) AS c FROM ring WHERE place < 20)",
        "up AS (SELECT user_id, list(item_id ORDER BY rank) AS u FROM tr GROUP BY 1)",
        select="SELECT user_id, array_to_string((list_filter(u, lambda x: list_contains(c, x)) || list_filter(c, lambda x: NOT list_contains(u, x)))[1:5], ',') AS candidates FROM up CROSS JOIN pl",
    ),
)
def _(spark, folder):
    upstream = matrix.predictions(spark, folder, "transition").where(F.size("predicted_items") > 0)
    shared = rank.pool(event_interactions(spark, folder), 20).agg(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")).alias("c"))
    rows = upstream.crossJoin(F.broadcast(shared))
    return rows.select(F.col("user_id").cast("long").alias("user_id"), F.array_join(checks.upstream_first(F.col("c"), F.col("predicted_items"), 5), ",").alias("candidates"))


_RAW = """raw AS (SELECT domain, CASE WHEN event_id % 17 = 0 THEN '' ELSE user_id::VARCHAR END AS u, item_id, CASE WHEN event_id % 19 = 0 THEN 'soon' ELSE ts::VARCHAR END AS t FROM ia UNION ALL SELECT domain, user_id::VARCHAR, item_id, ts::VARCHAR FROM ia WHERE event_id % 5 = 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0),
ok AS (SELECT DISTINCT domain, u, item_id, t FROM raw WHERE u <> '' AND t <> 'soon'),
it AS (SELECT p_partkey AS item_id, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_name END AS title FROM part WHERE p_partkey % 3 <> 0)"""


@register(
    "domain_conversion",
    sql.query(
        sql.EVENTS, _RAW,
        "w AS (SELECT DISTINCT domain, item_id FROM ok)",
        "d AS (SELECT domain, count(*) AS described, count(*) FILTER (title = '') AS missing_text FROM w JOIN it USING (item_id) GROUP BY 1)",
        select="""SELECT r.domain, r.raw, r.dropped, r.raw - r.dropped - k.kept AS duplicates, k.kept, n.interacted, coalesce(d.described, 0) AS described, coalesce(d.missing_text, 0) AS missing_text, round(coalesce(d.described, 0) / n.interacted, 6) AS coverage, CASE WHEN coalesce(d.described, 0) = n.interacted THEN 'READY' ELSE 'PARTIAL' END AS status
      FROM (SELECT domain, count(*) AS raw, count(*) FILTER (u = '' OR t = 'soon') AS dropped FROM raw GROUP BY 1) r JOIN (SELECT domain, count(*) AS kept FROM ok GROUP BY 1) k USING (domain) JOIN (SELECT domain, count(*) AS interacted FROM w GROUP BY 1) n USING (domain) LEFT JOIN d USING (domain)""",
    ),
)
def _(spark, folder):
    """Event types as domains; some rows without user or time, some twice, a third of the items without metadata."""
    events = event_interactions(spark, folder)
    first = events.select("domain", F.when(F.col("event_id") % 17 == 0, "").otherwise(F.col("user_id").cast("string")).alias("user_id"), F.col("item_id").alias("asin"), F.when(F.col("event_id") % 19 == 0, "soon").otherwise(F.col("ts").cast("string")).alias("timestamp"))
    again = events.where("event_id % 5 = 0 and event_id % 17 <> 0 and event_id % 19 <> 0").select("domain", F.col("user_id").cast("string").alias("user_id"), F.col("item_id").alias("asin"), F.col("ts").cast("string").alias("timestamp"))
    raw = first.unionByName(again)
    normal = prep.normalize_interactions(raw, ["user_id"], ["parent_asin", "asin"], [prep.timestamp_column(raw.columns)], keep=["domain"])
    items = table(spark, folder, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("item_id"), F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_name")).alias("title"))
    domains = events.select("domain").distinct()
    return rounded(prep.convert_domains(normal, domains.crossJoin(items))[2])


_LABELS = "SELECT p_brand AS l FROM part UNION SELECT CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '00' ELSE '' END || p_size FROM part"


@register("natural_order", f"SELECT l AS label, row_number() OVER (ORDER BY (NOT regexp_matches(l, '^-?[0-9]+$'))::INT, TRY_CAST(l AS HUGEINT), l) AS place FROM (SELECT DISTINCT l FROM ({_LABELS}))")
def _(spark, folder):
    part = table(spark, folder, "part")
    sign = F.when(F.col("p_partkey") % 3 == 0, "-").when(F.col("p_partkey") % 3 == 1, "00").otherwise("")
    labels = part.select(F.col("p_brand").alias("label")).union(part.select(F.concat(sign, F.col("p_size").cast("string")))).distinct()
    return prep.numbered(labels, [prep.natural_key(F.col("label"))], "place").select("label", (F.col("place") + 1).alias("place"))


_PROMPT_TOKENS = "CASE WHEN text IS NULL OR text = '' THEN 0 ELSE greatest(CAST(ceil(len(text) / 4) AS BIGINT), len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 1) END"


@register("cost_preflight", f"SELECT role, count(*) AS calls, sum({_PROMPT_TOKENS})::BIGINT AS prompt_tokens, count(*) * 64 AS completion_tokens, count(*) <= 300 AS within_cap FROM conversations GROUP BY role")
def _(spark, folder):
    return runs.preflight(table(spark, folder, "conversations"), 64, 300, ["role"])


@register("failure_audit", "SELECT category, count(*) AS failures FROM (SELECT CASE o_orderpriority[1] WHEN '1' THEN 'skipped_dependency' WHEN '2' THEN 'validation_error' ELSE 'runtime_error' END AS category FROM orders WHERE o_orderstatus = 'F') GROUP BY category")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    message = F.when(F.col("o_orderpriority").startswith("1"), "torch unavailable").when(F.col("o_orderpriority").startswith("2"), "schema validation").otherwise("out of memory")
    status = orders.select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("method"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("status"), message.alias("message"))
    return protocol.failure_counts(status)


@register("artifact_integrity", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE sha256(p_name) END AS before, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN sha256(p_name || '!') ELSE sha256(p_name) END AS after, p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 5 <> 0 AS unchanged FROM part WHERE p_partkey % 77 <> 0")
def _(spark, folder):
    parts = table(spark, folder, "part")
    before = parts.where("p_partkey % 7 <> 0").select("p_partkey", F.sha2("p_name", 256).alias("sha256"))
    after = parts.where("p_partkey % 11 <> 0").select("p_partkey", F.sha2(F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, "!").otherwise("")), 256).alias("sha256"))
    return protocol.integrity(before, after, ["p_partkey"])


_KINDS = {"full": None, "w_o_temporal_graph": ("semantic", "history", "user_drift"), "w_o_semantic_similarity": ("transition", "time_window", "history", "user_drift"), "w_o_user_profile": ("transition", "time_window", "semantic", "contrastive")}
_ABLATED = " UNION ALL ".join(f"SELECT '{n}' AS ablation, * FROM ev" + ("" if k is None else f" WHERE evidence_type IN {k}") for n, k in _KINDS.items())


@register("ablation_scores", _case_sql(f"ab AS ({_ABLATED})", select="SELECT ablation, count(*) AS rows, round(sum(coalesce(transition_count, 0) + 0.5::DOUBLE * coalesce(window_score, 0) + 0.3::DOUBLE * coalesce(similarity, 0) + 0.2::DOUBLE * coalesce(recent_signal, 0)), 4) AS score FROM ab GROUP BY ablation"))
def _(spark, folder):
    rows = cut(_evidence(spark, folder))
    part = None
    for name in _KINDS:
        left = protocol.ablated(rows, name)
        scored = evidence.weighted_score(left).agg(F.sum("score").alias("score"))
        one = left.agg(F.count("*").alias("rows")).crossJoin(scored).select(F.lit(name).alias("ablation"), "rows", F.round("score", 4).alias("score"))
        part = one if part is None else part.unionByName(one)
    return part


@register(
    "answer_audit",
    sql.query(sql.EVENTS, "u AS (SELECT user_id, count(DISTINCT item_id) AS n FROM ia GROUP BY 1)", select="SELECT 'predictions' AS kind, count(*) AS rows, sum(CASE user_id % 3 WHEN 0 THEN n WHEN 1 THEN n + 1 ELSE 0 END)::BIGINT AS items FROM u UNION ALL SELECT 'unread', count(*), 0 FROM u WHERE user_id % 3 = 2 UNION ALL SELECT 'made_up', count(*), count(*) FROM u WHERE user_id % 3 = 1"),
)
def _(spark, folder):
    """Answers in order, answers with a made-up item, and answers that are no JSON."""
    items = event_interactions(spark, folder).groupBy("user_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("candidates"))
    kind, given = F.col("user_id") % 3, F.col("candidates")
    answers = items.withColumn("response", F.when(kind == 0, prompts.mock_answer("identity", given)).when(kind == 1, prompts.mock_answer("hallucinating", given)).otherwise("I cannot say."))
    predictions, unread, made_up = prompts.audit(answers, ["user_id"])
    count = lambda frame, name, size: frame.agg(F.lit(name).alias("kind"), F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("items"))
    return count(predictions, "predictions", F.size("predicted_items")).unionByName(count(unread, "unread", F.lit(0))).unionByName(count(made_up, "made_up", F.size("invalid")))

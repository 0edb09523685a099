"""Normalising, filtering, identity and reports of interaction tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut


def first_present(names: Sequence[str], columns: Sequence[str]) -> Column:
    """The first of several aliased columns that is neither null nor blank; null where there is none."""
    there = [F.when(F.trim(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in names if n in columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def to_seconds(ts: Column) -> Column:
    """Epoch times above 9 999 999 999 are milliseconds."""
    return F.when(ts > 9_999_999_999, (ts / 1000).cast("long")).otherwise(ts.cast("long"))


def normalize_interactions(raw: DataFrame, user: Sequence[str], item: Sequence[str], ts: Sequence[str], rating: Sequence[str] = (), min_rating: float | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Alias-tolerant rows to (keep, user_id, item_id, ts, rating, drop_reason); the reason is null for good rows."""
    u, i = first_present(user, raw.columns), first_present(item, raw.columns)
    when = first_present(ts, raw.columns).try_cast("double")
    value = F.coalesce(first_present(rating, raw.columns).try_cast("double"), F.lit(1.0))
    reason = F.when(u.isNull(), "missing_user").when(i.isNull(), "missing_item").when(when.isNull(), "missing_timestamp")
    if min_rating is not None:
        reason = reason.when(value < min_rating, "low_rating")
    return raw.select(*keep, u.alias("user_id"), i.alias("item_id"), to_seconds(when).alias("ts"), value.alias("rating"), reason.alias("drop_reason"))


def item_text(columns: Sequence[str]) -> Column:
    """Text fields joined by a space, blanks skipped."""
    return F.array_join(F.filter(F.array(*[F.trim(F.col(c).cast("string")) for c in columns]), lambda x: x.isNotNull() & (x != "")), " ")


def first_per_key(frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a total order."""
    return frame.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def k_core(interactions: DataFrame, user_k: int, item_k: int, simultaneous: bool = False, max_rounds: int | None = None, error_when_empty: bool = True) -> DataFrame:
    """Rows left when users and items with too few rows are removed until none is.

    A round removes users and then items of what is left, or both by the same counts. Each round is two
    aggregations and semi-joins, cut to a checkpoint; the driver sees counts alone. Rounds go on to the fixpoint;
    with max_rounds, to so many rounds and then an error.
    """
    rows, size = cut(interactions), -1
    for done in count():
        if done == max_rounds:
            raise ValueError(f"no fixpoint after {max_rounds} rounds")
        before = rows.count() if size < 0 else size
        users = rows.groupBy("user_id").count().where(F.col("count") >= user_k).select("user_id")
        kept = rows.join(users, "user_id", "left_semi")
        items = (rows if simultaneous else kept).groupBy("item_id").count().where(F.col("count") >= item_k).select("item_id")
        rows = cut(kept.join(items, "item_id", "left_semi").select(*interactions.columns))
        size = rows.count()
        if size == before:
            break
        if not size:
            if error_when_empty:
                raise ValueError("no interaction is left")
            break
    return rows


def core_by_deltas(interactions: DataFrame, user_k: int, item_k: int, domain: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, report): the k-core where users count over all domains and items within theirs, by what each round removes.

    Two degree tables are kept. A round takes the users and items below their bound, finds the rows these still had,
    and subtracts those rows from the degrees at their other ends. The interactions are read but never counted or
    written again, so what a round exchanges is in proportion to what it removes and to the number of nodes. The
    fixpoint is that of k_core(); it does not depend on the order of removal. Rows without a user or an item go.

    report(round, users, items, rows): users and items removed in each round, and rows that went with them.
    """
    spark = interactions.sparkSession
    named = interactions.where("user_id is not null and item_id is not null").select(F.struct(*[interactions[c] for c in interactions.columns]).alias("__row"), F.col("user_id").alias("__u"), (item_key(domain) if domain else F.struct(F.col("item_id"))).alias("__i"))
    rows = cut(named)
    ends, bounds = ("__u", "__i"), {"__u": user_k, "__i": item_k}
    degrees = {e: cut(rows.groupBy(e).agg(F.count("*").alias("n")).withColumn("gone", F.lit(None).cast("int"))) for e in ends}
    report = []
    for number in count(1):
        low = {e: cut(degrees[e].where((F.col("n") < bounds[e]) & F.col("gone").isNull()).select(e)) for e in ends}
        removed = {e: low[e].count() for e in ends}
        if not any(removed.values()):
            break
        earlier = {e: degrees[e].where("gone is not null").select(e) for e in ends}
        by_user = rows.select(*ends).join(low["__u"], "__u", "left_semi").join(earlier["__i"], "__i", "left_anti")
        by_item = rows.select(*ends).join(low["__i"], "__i", "left_semi").join(earlier["__u"].union(low["__u"]), "__u", "left_anti")
        hit = cut(by_user.select(*ends).union(by_item.select(*ends)).groupBy(*ends).agg(F.count("*").alias("less")))
        lost = hit.agg(F.sum("less").alias("rows")).first()["rows"] or 0
        for e in ends:
            less, now = hit.groupBy(e).agg(F.sum("less").alias("less")), low[e].withColumn("now", F.lit(number))
            joined = degrees[e].join(less, e, "left").join(now, e, "left")
            degrees[e] = cut(joined.select(e, (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"), F.coalesce("gone", "now").alias("gone")))
        report.append((number, removed["__u"], removed["__i"], lost))
    alive = {e: degrees[e].where("gone is null").select(e) for e in ends}
    kept = rows.join(alive["__u"], "__u", "left_semi").join(alive["__i"], "__i", "left_semi").select("__row.*")
    return kept, spark.createDataFrame(report, "round int, users long, items long, rows long")


def min_counts(interactions: DataFrame, user_min: int, item_min: int | None = None) -> DataFrame:
    """A single pass of the count filters."""
    users = interactions.groupBy("user_id").count().where(F.col("count") >= user_min).select("user_id")
    kept = interactions.join(users, "user_id", "left_semi")
    if item_min:
        kept = kept.join(interactions.groupBy("item_id").count().where(F.col("count") >= item_min).select("item_id"), "item_id", "left_semi")
    return kept.select(*interactions.columns)


def numbered(frame: DataFrame, order: Sequence[Column | str], alias: str) -> DataFrame:
    """A 0-based number for each row in a total order.

    Rows are range-partitioned and numbered within partitions; the counts of the partitions before are
    added. No task holds all rows, and the driver sees one count a partition.
    """
    ordered = cut(frame.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    counts = {r["__p"]: r["count"] for r in ordered.groupBy("__p").count().collect()}
    start, offsets = 0, {}
    for p in sorted(counts):
        offsets[p], start = start, start + counts[p]
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    offset = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])[F.col("__p")] if offsets else F.lit(0)
    return ordered.withColumn(alias, (within - 1 + offset).cast("long")).drop("__p")


def dense_ids(frame: DataFrame, column: str, alias: str) -> DataFrame:
    """Distinct values to 0-based ids in text order: (column, alias)."""
    keys = frame.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    return numbered(keys, [F.col(column).cast("string")], alias)


def event_ids(interactions: DataFrame, order: Sequence[str] = ("user_id", "ts", "item_id", "rating")) -> DataFrame:
    """A 0-based id in the given total order."""
    return numbered(interactions, list(order), "event_id")


def tie_stats(interactions: DataFrame) -> DataFrame:
    """Rows of one user at one time: groups, rows in them, rows beyond the first, users with any, largest."""
    groups = interactions.groupBy("user_id", "ts").agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("tied_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("tied_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"), F.count_distinct("user_id").alias("tied_users"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_group"))


def duplicate_count(interactions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return interactions.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def summary(interactions: DataFrame, group: str | None = None) -> DataFrame:
    """Rows, users, items, first and last time; by a column and overall."""
    measures = [F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    if group is None:
        return interactions.agg(*measures)
    return interactions.groupingSets([[F.col(group)], []], F.col(group)).agg(*measures)


def retention(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """Rows of each group before and after a filter, and the share kept."""
    a = before.groupBy(group).agg(F.count("*").alias("before_rows"))
    b = after.groupBy(group).agg(F.count("*").alias("after_rows"))
    kept = F.coalesce("after_rows", F.lit(0))
    return a.join(b, group, "full_outer").select(group, F.coalesce("before_rows", F.lit(0)).alias("before_rows"), kept.alias("after_rows"), F.when(F.coalesce("before_rows", F.lit(0)) > 0, kept / F.col("before_rows")).otherwise(0.0).alias("kept_share"))


def subsample(interactions: DataFrame, max_users: int | None = None, max_items: int | None = None, max_rows: int | None = None) -> DataFrame:
    """The first users, then the first items of theirs, then the first rows."""
    rows = interactions
    if max_users is not None:
        rows = rows.join(rows.select("user_id").distinct().orderBy("user_id").limit(max_users), "user_id", "left_semi")
    if max_items is not None:
        rows = rows.join(rows.select("item_id").distinct().orderBy("item_id").limit(max_items), "item_id", "left_semi")
    if max_rows is not None:
        rows = rows.orderBy("user_id", "ts", "item_id").limit(max_rows)
    return rows.select(*interactions.columns)


def orphans(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """Interacted items that the catalogue lacks."""
    return interactions.select("item_id").distinct().join(items, "item_id", "left_anti")


def with_items(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """Interactions with catalogue columns; a repeated catalogue id is an error at run time."""
    unique = items.groupBy("item_id").agg(*[F.first(c).alias(c) for c in items.columns if c != "item_id"], F.count("*").alias("__n"))
    checked = unique.where(F.when(F.col("__n") > 1, F.raise_error(F.lit("repeated item_id in the catalogue")).cast("boolean")).otherwise(True)).drop("__n")
    return interactions.join(checked, "item_id", "left")


def readiness(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """One row of counts and a verdict: READY, PARTIAL or MISSING."""
    counts = interactions.agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"), F.count_if(F.col("ts").isNull()).alias("missing_ts"))
    lost = orphans(interactions, items).agg(F.count("*").alias("orphans"))
    both = counts.crossJoin(lost)
    sparsity = F.when(F.col("users") * F.col("items") > 0, 1 - F.col("rows") / (F.col("users") * F.col("items"))).otherwise(0.0)
    verdict = F.when(F.col("rows") == 0, "MISSING").when((F.col("missing_ts") > 0) | (F.col("orphans") > 0), "PARTIAL").otherwise("READY")
    return both.select("*", sparsity.alias("sparsity"), verdict.alias("verdict"))


def item_key(domain: str = "domain", item: str = "item_id") -> Column:
    """An item's key across domains."""
    return F.struct(F.coalesce(F.col(domain), F.lit("")).alias("domain"), F.col(item).cast("string").alias("item_id"))


def natural_key(value: Column) -> Column:
    """A sort key that puts whole numbers of any length first, by value, and other texts behind them.

    A number sorts by its digits' count, negative below zero, then by its digits, which are mirrored (9 for 0) below zero.
    """
    text = value.cast("string")
    digits = F.regexp_replace(text, "^-?0*", "")
    below = text.startswith("-") & (digits != "")
    number = F.struct(F.lit(0).alias("kind"), F.when(below, -F.length(digits)).otherwise(F.length(digits)).alias("length"), F.when(below, F.translate(digits, "0123456789", "9876543210")).otherwise(digits).alias("digits"), text.alias("text"))
    other = F.struct(F.lit(1).alias("kind"), F.lit(0).alias("length"), F.lit("").alias("digits"), text.alias("text"))
    return F.when(text.rlike("^-?[0-9]+$"), number).otherwise(other)


def timestamp_column(columns: Sequence[str], given: str | None = None) -> str:
    """The named column, or the first known one; an error where none is there."""
    for name in (given,) if given else ("timestamp", "unixReviewTime"):
        if name in columns:
            return name
    raise ValueError(f"no timestamp column among {', '.join(columns)}")


def category_text(columns: dict[str, str]) -> Column:
    """columns: name -> type. The categories, joined by a space where they are a list, else the main category."""
    found = []
    if "categories" in columns:
        text = F.array_join(F.filter(F.transform("categories", lambda x: F.trim(x)), lambda x: x != ""), " ") if columns["categories"].startswith("array") else F.trim("categories")
        found.append(F.when(text != "", text))
    if "main_category" in columns:
        found.append(F.when(F.trim("main_category") != "", F.trim("main_category")))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def convert_domains(normalized: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """normalized(domain, user_id, item_id, ts, rating, drop_reason) of all domains, items(domain, item_id, title) -> (interactions, items, report).

    Rows without a reason are kept, of each (domain, user, item, time) the one whose other columns come first; items
    are those of the domain's kept interactions, one a domain and item, a title before none and the first title. The report has a row a domain: raw, dropped, duplicate and kept rows,
    interacted items, items with metadata, their coverage, and whether the domain is READY or PARTIAL.
    """
    good = normalized.where("drop_reason is null").drop("drop_reason")
    keys = ["domain", "user_id", "item_id", "ts"]
    once = first_per_key(good, keys, [F.col(c).asc_nulls_last() for c in good.columns if c not in keys] or ["ts"])
    wanted = once.select("domain", "item_id").distinct()
    titled = [F.coalesce(F.trim("title"), F.lit("")) == "", *[F.col(c).asc_nulls_last() for c in ["title", *[c for c in items.columns if c not in ("domain", "item_id", "title")]]]]
    described = first_per_key(items, ["domain", "item_id"], titled).join(wanted, ["domain", "item_id"], "left_semi")
    counts = normalized.groupBy("domain").agg(F.count("*").alias("raw"), F.count("drop_reason").alias("dropped"))
    kept = once.groupBy("domain").agg(F.count("*").alias("kept"))
    sizes = wanted.groupBy("domain").agg(F.count("*").alias("interacted"))
    known = described.groupBy("domain").agg(F.count("*").alias("described"), F.count_if(F.coalesce(F.trim("title"), F.lit("")) == "").alias("missing_text"))
    joined = counts.join(kept, "domain", "left").join(sizes, "domain", "left").join(known, "domain", "left").na.fill(0)
    report = joined.select("domain", "raw", "dropped", (F.col("raw") - F.col("dropped") - F.col("kept")).alias("duplicates"), "kept", "interacted", "described", "missing_text", F.when(F.col("interacted") > 0, F.col("described") / F.col("interacted")).otherwise(0.0).alias("coverage"), F.when(F.col("described") == F.col("interacted"), "READY").otherwise("PARTIAL").alias("status"))
    return once, described, report

"""Bayesian personalised ranking by matrix factorisation, and dot-product scoring."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideloom.functions.cuts import cut
from tideloom.operators import protocol
from tideloom.operators.prep import numbered


def positive_pairs(train: DataFrame) -> DataFrame:
    return train.select("user_id", "item_id").distinct()


def _start(ids: DataFrame, kind: str, grid: DataFrame) -> DataFrame:
    """Factors from a normal distribution of deviation 0.1, by hashes of (seed, kind, id, place)."""
    unit = lambda i, salt: (F.shiftrightunsigned(F.xxhash64("seed", F.lit(kind), "id", i, F.lit(salt)), 11) + 1) / float((1 << 53) + 1)
    normal = F.transform(F.sequence(F.lit(1), F.col("factors")), lambda i: 0.1 * F.sqrt(-2 * F.ln(unit(i, 1))) * F.cos(2 * math.pi * unit(i, 2)))
    return ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct().crossJoin(F.broadcast(grid)).select("trial", F.lit(kind).alias("kind"), "id", normal.alias("vector"), F.lit(0.0).alias("bias"))


def _train_block(epoch: int, stratum: int, batch: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A pass over the pairs of a block of users and a block of items, in batches of the seed's order."""

    def train(pairs: pd.DataFrame, factors: pd.DataFrame) -> pd.DataFrame:
        out = factors[["trial", "kind", "id", "vector", "bias"]]
        if not len(pairs) or not len(factors):
            return out
        t = factors.iloc[0]
        user, item = factors[factors.kind == "user"].sort_values("id"), factors[factors.kind == "item"].sort_values("id")
        if not len(item):
            return out
        p, q, bias = np.stack(user.vector.to_numpy()), np.stack(item.vector.to_numpy()), item.bias.to_numpy().copy()
        pairs = pairs.sort_values(["user", "item"], kind="stable")
        u, i = np.searchsorted(user.id.to_numpy(), pairs.user.to_numpy()), np.searchsorted(item.id.to_numpy(), pairs.item.to_numpy())
        known = np.sort(u * len(q) + i)
        rng = np.random.default_rng([int(t.seed), epoch, stratum, int(t.part)])
        order = rng.permutation(len(u))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            us, pos = u[some], i[some]
            neg = rng.integers(len(q), size=len(some))
            for _ in range(20):
                code = us * len(q) + neg
                bad = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code
                if not bad.any():
                    break
                neg[bad] = rng.integers(len(q), size=int(bad.sum()))
            else:
                us, pos, neg = us[~bad], pos[~bad], neg[~bad]
            pu, diff = p[us], q[pos] - q[neg]
            g = 1 / (1 + np.exp(np.clip(bias[pos] - bias[neg] + (pu * diff).sum(axis=1), -35, 35)))[:, None]
            np.add.at(p, us, t.rate * (g * diff - t.decay * pu))
            np.add.at(q, pos, t.rate * (g * pu - t.decay * q[pos]))
            np.add.at(q, neg, t.rate * (-g * pu - t.decay * q[neg]))
            np.add.at(bias, pos, t.rate * (g[:, 0] - t.decay * bias[pos]))
            np.add.at(bias, neg, t.rate * (-g[:, 0] - t.decay * bias[neg]))
        made = pd.concat([user.assign(vector=list(p)), item.assign(vector=list(q), bias=bias)])
        return made[["trial", "kind", "id", "vector", "bias"]]

    return train


def _fresh(frame: DataFrame) -> DataFrame:
    """The same columns under attributes of their own, for two frames that come from one."""
    return frame.select(*[F.col(c).alias(c) for c in frame.columns])


_FACTORS = "trial int, kind string, id long, vector array<double>, bias double"


def _steps_done(spark: SparkSession, folder: str) -> list[int]:
    """The steps whose factors are committed below folder. A step without its commit mark does not count."""
    return sorted(int(name.removeprefix("step=")) for name in protocol.names_below(spark, folder) if name.startswith("step=") and protocol.exists(spark, f"{folder}/{name}/_SUCCESS"))


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """The factors of the last committed step of a sweep with a folder; an error where none is there."""
    done = _steps_done(spark, folder)
    if not done:
        raise FileNotFoundError(f"{folder} holds no trained factors")
    return spark.read.schema(_FACTORS).parquet(f"{folder}/step={done[-1]}")


def sweep(pairs: DataFrame, trials: list[dict], block_pairs: int = 200_000, batch: int = 64, folder: str | None = None, most_steps: int | None = None) -> DataFrame:
    """pairs(user, item), the positive ones -> (trial, kind, id, vector, bias) of each trial's trained factors.

    Users and items are hashed into B blocks each, so that a block of both has about `block_pairs` pairs or fewer. A
    stratum is B such blocks that share neither users nor items, trained side by side, one task a block and trial;
    B strata are an epoch. Negatives of a pair come from its item block. With one block this is plain stochastic
    descent. Between strata the factors are cut, so a lost executor costs a stratum at most.

    With a folder each stratum's factors are a version there, committed as Spark commits a write, and a call goes on
    from the last one; the result is that of a call without a break. A folder of other trials or pairs is an error.
    most_steps ends a call after so many strata. Versions before the last two go.
    """
    spark = pairs.sparkSession
    blocks = max(1, math.ceil(math.sqrt(pairs.count() / block_pairs)))
    grid = pairs.sparkSession.createDataFrame([(i, t["factors"], t["epochs"], float(t["rate"]), float(t["decay"]), t["seed"]) for i, t in enumerate(trials)], "trial int, factors int, epochs int, rate double, decay double, seed long")
    of = lambda column, salt: F.pmod(F.xxhash64(F.col(column).cast("long"), F.lit(salt)), F.lit(blocks))
    placed = cut(pairs.select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"), of("user", 1).alias("ub"), of("item", 2).alias("ib")))
    done: list[int] = []
    if folder:
        told = protocol.digest({"trials": trials, "block_pairs": block_pairs, "batch": batch, "pairs": protocol.table_digest(placed)})
        if not protocol.exists(spark, f"{folder}/config"):
            protocol.write_json(spark, f"{folder}/config", {"sha256": told})
        elif json.loads(spark.read.text(f"{folder}/config").first()["value"])["sha256"] != told:
            raise ValueError(f"{folder} holds factors of other trials or pairs")
        done = _steps_done(spark, folder)
    factors = saved(spark, folder) if done else cut(_start(placed.select("user"), "user", grid).union(_start(placed.select("item"), "item", grid)))
    first, made = (done[-1] + 1 if done else 0), 0
    for epoch in range(max(t["epochs"] for t in trials)):
        for stratum in range(blocks):
            number = epoch * blocks + stratum
            if number < first:
                continue
            if made == most_steps:
                return factors
            part = F.when(F.col("kind") == "user", of("id", 1)).otherwise(F.pmod(of("id", 2) - stratum, F.lit(blocks)))
            live = factors.join(F.broadcast(grid), "trial").withColumn("part", part)
            turn = placed.where(F.pmod(F.col("ib") - F.col("ub"), F.lit(blocks)) == stratum).select("user", "item", F.col("ub").alias("part"))
            asked = turn.crossJoin(F.broadcast(grid.where(F.col("epochs") > epoch).select("trial")))
            step = _fresh(asked).groupBy("trial", "part").cogroup(_fresh(live).groupBy("trial", "part"))
            trained = step.applyInPandas(_train_block(epoch, stratum, batch), _FACTORS)
            made += 1
            if folder:
                trained.write.mode("overwrite").parquet(f"{folder}/step={number}")
                factors = spark.read.schema(_FACTORS).parquet(f"{folder}/step={number}")
                for old in _steps_done(spark, folder)[:-2]:
                    protocol.remove(spark, f"{folder}/step={old}")
            else:
                factors = cut(trained)
    return factors


def best_trial(ranks: DataFrame, measure: str = "ndcg", k: int = 10) -> int:
    """ranks(trial, rank) of held-out cases, null where the target was not reached -> the trial of the best mean hr, ndcg or mrr at k; the first of equals."""
    part = {"hr": F.lit(1.0), "ndcg": 1 / F.log2(F.col("rank") + 1), "mrr": 1 / F.col("rank")}
    if measure not in part:
        raise ValueError(f"no such measure: {measure}")
    means = ranks.groupBy("trial").agg(F.avg(F.when(F.col("rank") <= k, part[measure]).otherwise(0.0)).alias("mean"))
    best = means.orderBy(F.desc(F.round("mean", 12)), "trial").first()
    if best is None:
        raise ValueError("no case was ranked")
    return best["trial"]


def with_popularity(ranked: DataFrame, cases: DataFrame, popular: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """ranked(trial, user, item, score, rank) and, for cases(trial, user) without any row, the k most popular items(item, score) they have not seen.

    Such a user has seen few items, so k and as many popular items as that user has seen are looked at.
    """
    cold = cases.select("trial", "user").distinct().join(ranked.select("trial", "user").distinct(), ["trial", "user"], "left_anti")
    known = seen.select("user", "item").distinct()
    held = cold.join(known.groupBy("user").agg(F.count("*").alias("held")), "user", "left").withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("held", F.lit(0)) + k - 1)))
    order = numbered(popular.select("item", F.col("score").cast("double").alias("score")), [F.desc("score"), "item"], "place")
    met = held.join(order, "place").join(known, ["user", "item"], "left_anti")
    w = Window.partitionBy("trial", "user").orderBy("place")
    more = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("trial", "user", "item", "score", "rank").union(more.select("trial", "user", "item", "score", "rank"))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sides(factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    users = factors.where("kind = 'user'").select("trial", F.col("id").alias("user"), F.col("vector").alias("p"))
    return users, factors.where("kind = 'item'").select("trial", F.col("id").alias("item"), F.col("vector").alias("q"), "bias")


def score(factors: DataFrame, cases: DataFrame) -> DataFrame:
    """cases(trial, user, item, ...) with the score of each; cases without factors are left out."""
    users, items = _sides(factors)
    return cases.join(users, ["trial", "user"]).join(items, ["trial", "item"]).withColumn("score", _dot("p", "q") + F.col("bias")).drop("p", "q", "bias")


def _block_scores(asked: pd.DataFrame, items: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Item ids in order and the score of every asked row with each; a sum takes its terms in the order of the places."""
    items = items.sort_values("item")
    p, q = np.stack(asked.p.to_numpy()), np.stack(items.q.to_numpy())
    scores = np.zeros((len(p), len(q)))
    for d in range(p.shape[1]):
        scores += p[:, d, None] * q[:, d]
    return items.item.to_numpy(), scores + items.bias.to_numpy()


def _against_items(factors: DataFrame, asked: DataFrame, reduce, schema: str, case_block: int, item_block: int) -> DataFrame:
    """asked(trial, p, ...) and all items of the trial, every block of the ones with every block of the others in a task of its own."""
    _, items = _sides(factors)
    n, m = (max(1, -(-frame.count() // size)) for frame, size in ((asked, case_block), (items, item_block)))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    a = _fresh(asked).withColumn("cases", F.pmod(F.xxhash64("trial", "user"), F.lit(n))).withColumn("items", every(m))
    b = _fresh(items).withColumn("items", F.pmod(F.xxhash64("item"), F.lit(m))).withColumn("cases", every(n))
    return _fresh(a).groupBy("trial", "cases", "items").cogroup(_fresh(b).groupBy("trial", "cases", "items")).applyInPandas(reduce, schema)


def top_unseen(factors: DataFrame, cases: DataFrame, seen: DataFrame, k: int, case_block: int = 512, item_block: int = 4096) -> DataFrame:
    """cases(trial, user) -> the k best items that seen(user, item) has not: (trial, user, item, score, rank).

    A block of items gives each case its k best and one more for every seen item of that block.
    """
    users, _ = _sides(factors)
    known = seen.select("user", "item").distinct().groupBy("user").agg(F.count("*").alias("held"))
    asked = cut(cases.select("trial", "user").distinct().join(users, ["trial", "user"]).join(known, "user", "left").select("trial", "user", "p", F.coalesce("held", F.lit(0)).alias("held")))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"trial": [], "user": [], "item": [], "score": []})
        ids, scores = _block_scores(a, b)
        order = np.argsort(-scores, axis=1, kind="stable")
        rows = [(t, u, ids[c], scores[r, c]) for r, (t, u, held) in enumerate(zip(a.trial, a.user, a.held, strict=True)) for c in order[r, : k + held]]
        return pd.DataFrame(rows, columns=["trial", "user", "item", "score"])

    found = _against_items(factors, asked, best, "trial int, user long, item long, score double", case_block, item_block)
    left = found.join(seen.select("user", "item").distinct(), ["user", "item"], "left_anti")
    w = Window.partitionBy("trial", "user").orderBy(F.desc("score"), "item")
    return left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("trial", "user", "item", "score", "rank")


def target_ranks(factors: DataFrame, cases: DataFrame, seen: DataFrame, case_block: int = 512, item_block: int = 4096) -> DataFrame:
    """cases(trial, case_id, user, item) -> the target's rank among all items of the trial that seen(user, item) has not, score descending, then id.

    Blocks count the items ahead of each target; seen items ahead of it are counted by a join and taken off. A
    target without factors has no rank and no row.
    """
    users, _ = _sides(factors)
    own = cut(score(factors, cases.select("trial", "case_id", "user", "item")).join(users, ["trial", "user"]).select("trial", "case_id", "user", "item", "score", "p"))

    def ahead(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"trial": [], "case_id": [], "ahead": []})
        ids, scores = _block_scores(a, b)
        mine, target = a.score.to_numpy()[:, None], a["item"].to_numpy()[:, None]
        over = (scores > mine) | ((scores == mine) & (ids < target))
        return pd.DataFrame({"trial": a.trial, "case_id": a.case_id, "ahead": (over & (ids != target)).sum(axis=1)})

    counted = _against_items(factors, own, ahead, "trial int, case_id long, ahead long", case_block, item_block).groupBy("trial", "case_id").agg(F.sum("ahead").alias("ahead"))
    held = own.select("trial", "case_id", "user", F.col("item").alias("target"), F.col("score").alias("own")).join(seen.select("user", "item").distinct(), "user").where("item <> target")
    before = score(factors, held).where("score > own or score = own and item < target").groupBy("trial", "case_id").agg(F.count("*").alias("hidden"))
    joined = own.select("trial", "case_id", "user", "item").join(counted, ["trial", "case_id"]).join(before, ["trial", "case_id"], "left")
    return joined.select("trial", "case_id", "user", "item", (F.col("ahead") - F.coalesce("hidden", F.lit(0)) + 1).alias("rank"))

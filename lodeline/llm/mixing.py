"""A mix of sources in target shares of tokens, by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.tokens import token_counts
from lodeline.tables import cut, table

#: Documents of one source are rounded in bins of about so many.
BIN_DOCUMENTS = 20_000


def solve(histogram: DataFrame, targets: list, total_tokens: int | None = None, tolerance: float = 1e-10, rounds: int = 60) -> list[tuple]:
    """(source, goal, rate, tilt, mean, cap) of each usable source, from (source, n_tokens, n) and (source, target_share, max_repeats).

    Minimal relative entropy to one copy of each document, under the goal of each source's tokens and at
    most ``max_repeats`` copies: the copies of a document are min(max_repeats, exp(tilt * n_tokens / mean)).
    The dual is convex and falls apart by source; each Newton round is one aggregation over the
    histogram, from which two sums per source come back, and is kept inside a bracket by bisection.
    The total is the largest for which every source can meet its share, or ``total_tokens`` if smaller.
    Raises ArithmeticError where a source is still off by more than a millionth after ``rounds`` rounds.
    """
    spark = histogram.sparkSession
    sizes = {r[0]: (r[1], r[2]) for r in histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")), F.sum("n")).collect()}
    usable = [t for t in targets if t["source"] in sizes and (t["target_share"] or 0) > 0 and (t["max_repeats"] or 0) > 0]
    shares = sum(t["target_share"] for t in usable)
    if not usable:
        return []
    limit = min(t["max_repeats"] * sizes[t["source"]][0] * shares / t["target_share"] for t in usable)
    total = limit if total_tokens is None else min(limit, total_tokens)
    state = {}
    for t in usable:
        tokens, n = sizes[t["source"]]
        goal, cap = total * t["target_share"] / shares, float(t["max_repeats"])
        full = goal >= cap * tokens * (1 - 1e-12)
        state[t["source"]] = {"goal": goal, "cap": cap, "mean": tokens / n, "tilt": math.inf if full else 0.0, "low": -math.inf, "high": math.inf, "done": full}
    for _ in range(rounds):
        open_ = [(s, v["tilt"], v["mean"], v["cap"]) for s, v in state.items() if not v["done"]]
        if not open_:
            break
        tilts = spark.createDataFrame(open_, "source string, tilt double, mean double, cap double")
        x = F.col("n_tokens") / F.col("mean")
        weight = F.least(F.col("cap"), F.exp(F.least(F.col("tilt") * x, F.lit(700.0))))
        inner = F.when(weight < F.col("cap"), weight).otherwise(0.0)
        sums = histogram.join(F.broadcast(tilts), "source").groupBy("source").agg(
            F.sum(F.col("n") * weight * F.col("n_tokens")), F.sum(F.col("n") * inner * F.col("n_tokens") * x)
        )
        for source, got, slope in sums.collect():
            v = state[source]
            v["miss"] = miss = v["goal"] - got
            if abs(miss) <= tolerance * v["goal"]:
                v["done"] = True
                continue
            v["low" if miss > 0 else "high"] = v["tilt"]
            step = v["tilt"] + miss / slope if slope > 0 else math.nan
            if not v["low"] < step < v["high"]:
                step = (v["low"] + v["high"]) / 2 if math.isfinite(v["low"] + v["high"]) else v["tilt"] * 2 + math.copysign(1, miss)
            v["tilt"] = step
    if missed := [s for s, v in state.items() if not v["done"] and abs(v.get("miss", math.inf)) > 1e-6 * v["goal"]]:
        raise ArithmeticError(f"no tilt found in {rounds} rounds for {missed}")
    return [(s, v["goal"], v["tilt"], v["mean"], v["cap"]) for s, v in state.items()]


def mix(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, rate, copies), one row per document with at least one copy, and the report of shares.

    ``counts`` has (doc_id, source, n_tokens). Rates are rounded so that the tokens are kept: within bins of
    about ``BIN_DOCUMENTS`` documents of a source, from the largest document to the smallest, each gets its
    whole copies and one more if the tokens still owed are at least half of its own. Documents of sources without target, without tokens, or with a null source get no copies.
    A source without documents is reported with share 0, and the others keep their proportions.
    Targets of one source given twice count once, the larger share. Repeated ids are documents of their own.
    ``targets`` comes to the driver: one row per source that has a target.
    """
    spark = counts.sparkSession
    goals = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()
    kept = cut(counts.select("doc_id", "source", "n_tokens"))
    histogram = cut(kept.where("source is not null and n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    solved = solve(histogram, goals, total_tokens)
    sizes = {r[0]: (r[1], r[2]) for r in histogram.groupBy("source").agg(F.sum("n"), F.sum(F.col("n") * F.col("n_tokens"))).collect()}
    rows = [(s, t, m, c, max(1, math.ceil(sizes[s][0] / BIN_DOCUMENTS))) for s, _, t, m, c in solved]
    rates = spark.createDataFrame(rows, "source string, tilt double, mean double, cap double, bins bigint")
    hashed = F.xxhash64("doc_id", F.lit("mix"))
    rate = F.when(F.col("tilt") == math.inf, F.col("cap")).otherwise(F.least(F.col("cap"), F.exp(F.least(F.col("tilt") * F.col("n_tokens") / F.col("mean"), F.lit(700.0)))))
    rated = kept.where("n_tokens > 0").join(F.broadcast(rates), "source").select(
        "doc_id", "source", "n_tokens", "cap", rate.alias("rate"), hashed.alias("_hash"), F.pmod(F.xxhash64("doc_id", F.lit("bin")), "bins").alias("_bin")
    )

    def rounded(frame: pd.DataFrame) -> pd.DataFrame:
        """Whole copies of one bin, from the largest document to the smallest, each settling the tokens still owed."""
        frame = frame.sort_values(["n_tokens", "_hash", "doc_id"], ascending=[False, True, True], kind="stable")
        copies, owed = np.floor(frame["rate"].to_numpy()).astype("int64"), 0.0
        for i, (size, rate, cap) in enumerate(zip(frame["n_tokens"], frame["rate"], frame["cap"], strict=True)):
            owed += (rate - copies[i]) * size
            if owed >= size / 2 and copies[i] + 1 <= cap:
                copies[i] += 1
                owed -= size
        return frame[["doc_id", "source", "n_tokens", "rate"]].assign(copies=copies)

    kinds = ", ".join(f"{c} {rated.schema[c].dataType.simpleString()}" for c in ("doc_id", "source", "n_tokens", "rate"))
    chosen = cut(rated.groupBy("source", "_bin").applyInPandas(rounded, f"{kinds}, copies bigint"))
    used = chosen.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.max("copies").alias("most_repeats"))
    had = histogram.groupBy("source").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"))
    wanted = spark.createDataFrame([(g["source"], g["target_share"], g["max_repeats"]) for g in goals], "source string, target_share double, max_repeats int")
    report = wanted.join(had, "source", "left").join(used, "source", "left").fillna(0, ["documents", "tokens", "copies", "mixed_tokens", "most_repeats"])
    whole = used.agg(F.sum("mixed_tokens").alias("_whole"))
    report = report.join(F.broadcast(whole)).withColumn("actual_share", F.coalesce(F.col("mixed_tokens") / F.col("_whole"), F.lit(0.0))).drop("_whole")
    return chosen.where("copies > 0"), report


def _mixed(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return mix(token_counts(table(spark, folder, "documents")), table(spark, folder, "mix_targets"))


def p8_mix(spark, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p8_shares(spark, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}

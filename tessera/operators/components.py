"""Connected components of object pairs, and what hangs on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.storage import stored


def components(pairs: DataFrame, a: str = "object1", b: str = "object2") -> DataFrame:
    """label, base for every label of a pair: base is the smallest label of its component.

    Labels repeatedly take the smallest label of their neighbours and then their label's label, which reaches any
    component in logarithmically many rounds on paths too; each round's table is stored, only a count reaches the driver.
    """
    both = pairs.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = stored(both.union(both.select("v", "u")).distinct(), "edges")
    now = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("base")).withColumnRenamed("u", "label"), "bases")
    while True:
        seen = both.join(now, both["v"] == now["label"]).groupBy("u").agg(F.min("base").alias("near"))
        step = now.join(seen, now["label"] == seen["u"]).select("label", F.least("base", "near").alias("base"), F.col("base").alias("old"))
        hop = step.select(F.col("label").alias("base"), F.col("base").alias("hop"))
        new = stored(step.join(hop, "base", "left").select("label", F.least("base", F.coalesce("hop", "base")).alias("base"), "old"), "bases")
        if new.where("base != old").isEmpty():
            return new.select("label", "base")
        now = new.select("label", "base")


class Union:
    """Labels united pair by pair: the larger side's base stays, the first pair member's on a tie."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.size: dict[int, int] = {}

    def base(self, x: int) -> int:
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, x: int, y: int) -> None:
        p, q = self.base(x), self.base(y)
        if p != q:
            keep, lose = (q, p) if self.size.get(q, 1) > self.size.get(p, 1) else (p, q)
            self.parent[lose] = keep
            self.size[keep] = self.size.get(keep, 1) + self.size.get(lose, 1)


def replayed(pairs: DataFrame, key: str = "buffer_id", order: str = "pair_seq") -> DataFrame:
    """key, label, base with representatives as an incremental union gives them in the order of arrival. Depends on that order, so each buffer is one ordered group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, union = pdf.sort_values(order), Union()
        for x, y in zip(pdf["object1"].tolist(), pdf["object2"].tolist(), strict=True):
            union.join(x, y)
        labels = np.array(sorted(union.parent), np.int64)
        return pd.DataFrame({key: pdf[key].iloc[0], "label": labels, "base": [union.base(int(x)) for x in labels]}).astype({key: "int64", "base": "int64"})

    return pairs.groupBy(key).applyInPandas(run, f"{key} long, label long, base long")


def correlation_table(bases: DataFrame, count: DataFrame, start: int = 1) -> DataFrame:
    """label, base for every label from start (0 or 1) below the count (one row, n), in use or not: labels without links are their own base."""
    labels = count.select(F.explode(F.when(F.col("n") > start, F.sequence(F.lit(start).cast("bigint"), F.col("n") - 1))).alias("label"))
    return labels.join(bases, "label", "left").select("label", F.coalesce("base", "label").alias("base"))


def reindex_labels(labels: DataFrame, bases: DataFrame) -> DataFrame:
    """label: the distinct representatives of a set of labels."""
    return labels.join(bases, "label", "left").select(F.coalesce("base", "label").alias("label")).distinct()


def component_sizes(bases: DataFrame) -> DataFrame:
    return bases.groupBy("base").agg(F.count("*").alias("n"))


def partial_objects(raw: DataFrame, bases: DataFrame) -> DataFrame:
    """label, raw_partial, partial. raw: label, raw_partial.

    An object is partial if it and its base are and so are all its component's members below the last raw partial label; those
    beyond that bound have no vote unless they are the base.
    """
    last = raw.where("raw_partial").agg(F.max("label").alias("last"))
    named = raw.join(bases, "label", "left").withColumn("base", F.coalesce("base", "label")).join(F.broadcast(last))
    votes = named.groupBy("base").agg(F.min(F.when((F.col("label") <= F.col("last")) | (F.col("label") == F.col("base")), F.col("raw_partial"))).alias("all_"))
    return named.join(votes, "base").select("label", "raw_partial", (F.col("raw_partial") & F.coalesce("all_", F.lit(False))).alias("partial"))

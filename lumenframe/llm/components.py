"""Connected components of a table of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.shared import drop_scratch, materialize


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, comp) after links (a, b) between ids have joined their components.

    A component's label is its least id. In each turn every label is hooked to its least neighbour,
    the chains of hooks are halved until flat, and the links are contracted. Tables that
    meet in a join are written out first, so that a label with very many links can be split.
    """
    a, b = labels.select(F.col("id").alias("a"), F.col("comp").alias("u")), labels.select(F.col("id").alias("b"), F.col("comp").alias("v"))
    open_ = materialize(links.select("a", "b").join(a, "a").join(b, "b").where("u <> v").select("u", "v").distinct(), "links")
    while not open_.isEmpty():
        both = open_.select("u", "v").union(open_.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = materialize(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "hooks")
        while True:
            up = hooks.select(F.col("u").alias("p"), F.col("p").alias("q"))
            flat = materialize(hooks.join(up, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "flat")
            drop_scratch(hooks)
            hooks = flat
            if flat.where("moved").isEmpty():
                break
        u, v = hooks.select("u", F.col("p").alias("pu")), hooks.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        left = materialize(open_.join(u, "u").join(v, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "links")
        new = materialize(labels.join(hooks.select(F.col("u").alias("comp"), "p"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp")), "labels")
        for old in (open_, hooks, labels):
            drop_scratch(old)
        open_, labels = left, new
    drop_scratch(open_)
    return labels

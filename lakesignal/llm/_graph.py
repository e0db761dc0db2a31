"""Connected components: local spanning forests, then star contractions; and
joins that do not send a frequent key's rows to one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import partitions, shared_dir


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) with the same components."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(names))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    kids = np.flatnonzero(root != np.arange(len(names)))
    return names[kids], names[root[kids]]


def looked_up(rows: DataFrame, key: str, table: DataFrame, name: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table`` (its key ``name`` is unique, its
    column ``n`` counts the rows that ask for it, ``total`` in all).

    Keys that more than a share of 1 / (4 x partitions) of all rows ask for
    are at most 4 x partitions: those are broadcast, the others joined by hash.
    """
    most = max(1, total // (4 * partitions(rows.sparkSession)))
    rest = [c for c in table.columns if c not in (name, "n")]
    hot = F.broadcast(table.where(F.col("n") > most).select(F.col(name).alias("_k"), F.struct(*rest).alias("_hot")))
    marked = rows.join(hot, F.col(key) == F.col("_k"), "left").drop("_k")
    cold = table.where(F.col("n") <= most).select(F.col(name).alias("_k"), F.struct(*rest).alias("_cold"))
    near = marked.where("_hot IS NOT NULL").select(*rows.columns, "_hot.*")
    far = marked.where("_hot IS NULL").join(cold, F.col(key) == F.col("_k")).select(*rows.columns, "_cold.*")
    return near.unionByName(far)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root): root is the least node of the component.

    Large-star and small-star in turn until nothing changes; minima are
    aggregated before they are looked up, hubs' minima being broadcast (see
    ``looked_up``).  Each round is cut off by a reliable checkpoint.  If
    ``rounds`` do not suffice, an error is raised, as the labels would be
    unfinished.
    """
    shared_dir(edges.sparkSession)

    def state(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)")).alias("h")).first()
        return r["n"], r["h"]

    def lows(e: DataFrame) -> DataFrame:
        return e.groupBy(F.col("src").alias("u")).agg(F.min("dst").alias("m"), F.count("*").alias("n"))

    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct().checkpoint()
    was = state(e)
    for _ in range(rounds):
        if not was[0]:
            break
        both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = lows(both).withColumn("m", F.least("u", "m"))
        large = looked_up(both.where("dst > src"), "src", low, "u", 2 * was[0]).select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        small = looked_up(large, "src", lows(large), "u", was[0]).select(F.explode(F.array(F.struct(F.col("src").alias("s"), F.col("m").alias("d")), F.struct(F.col("dst").alias("s"), F.col("m").alias("d")))).alias("x")).select(F.col("x.s").alias("src"), F.col("x.d").alias("dst")).where("src <> dst").distinct()
        e = small.checkpoint()
        now = state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return e.union(e.select("dst", "dst")).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("root"))

"""Fixed-weight graph convolutions over an edge table ``src, dst, w``.

One hop is one join with the features (broadcast after a check of their number) and one aggregation,
partial before its shuffle. Lineage is cut every few hops."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .flow_graph import small

CUT_EVERY = 5


def hop(edges: DataFrame, values: DataFrame, names: list[str], rows: int) -> DataFrame:
    """The weighted sum of the values of each node's sources."""
    source = small(values.withColumnRenamed("zone_id", "src"), rows)
    return edges.join(source, "src").groupBy(F.col("dst").alias("zone_id")).agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in names])


def diffuse(edges: DataFrame, values: DataFrame, names: list[str], hops: int) -> DataFrame:
    """``values`` after ``hops`` hops."""
    edges = materialize(edges, "operator") if hops > 1 else edges
    rows = values.count()
    for i in range(1, hops + 1):
        values = hop(edges, values, names, rows)
        if i % CUT_EVERY == 0 and i < hops:
            values = materialize(values, "hop")
    return values


def fixed_head(names: list[str]) -> tuple[Column, Column]:
    """The two outputs of the untrained head: X and Y as they are, every further feature in both by equal weight."""
    more = [F.col(n) for n in names[2:]]
    if not more:
        return F.col(names[0]), F.col(names[1])
    extra = sum(more[1:], more[0]) * F.lit(1 / math.sqrt(len(more)))
    return F.col(names[0]) + extra, F.col(names[1]) + extra


def sgcn(edges: DataFrame, values: DataFrame, names: list[str], hops: int) -> DataFrame:
    """``ZoneID, Emb_X, Emb_Y`` by plain diffusion and the fixed head."""
    x, y = fixed_head(names)
    return diffuse(edges, values, names, hops).select(F.col("zone_id").alias("ZoneID"), x.alias("Emb_X"), y.alias("Emb_Y"))


def glorot(sizes: Sequence[int], seed: int = 42) -> list[tuple[np.ndarray, np.ndarray]]:
    """Uniform random weights and no bias for layers of these sizes. They are not those of any other library's generator."""
    draw = np.random.default_rng(seed)
    limits = [math.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    return [(draw.uniform(-t, t, (b, a)), np.zeros(b)) for a, b, t in zip(sizes, sizes[1:], limits, strict=False)]


def gcn(edges: DataFrame, values: DataFrame, names: list[str], layers: Sequence[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``ZoneID, Emb_X, Emb_Y`` by convolutions with given weights (out x in) and biases, cut at 0 in between."""
    if len(layers[0][0][0]) != len(names) or len(layers[-1][0]) != 2:
        raise ValueError("weights must lead from the features to two outputs")
    edges = materialize(edges, "operator")
    rows = values.count()
    for i, (weight, bias) in enumerate(layers):
        outs = [f"f{j}" for j in range(len(weight))]
        mixed = [sum((F.col(n) * F.lit(float(w)) for n, w in zip(names, row, strict=True)), F.lit(0.0)).alias(o) for o, row in zip(outs, weight, strict=True)]
        moved = hop(edges, values.select("zone_id", *mixed), outs, rows)
        shifted = [F.col(o) + F.lit(float(b)) for o, b in zip(outs, bias, strict=True)]
        values = moved.select("zone_id", *[(F.greatest(c, F.lit(0.0)) if i < len(layers) - 1 else c).alias(o) for o, c in zip(outs, shifted, strict=True)])
        names = outs
    return values.select(F.col("zone_id").alias("ZoneID"), F.col("f0").alias("Emb_X"), F.col("f1").alias("Emb_Y"))

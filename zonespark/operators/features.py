"""Node features of the embedding: coordinates, population and hospital inflow, standardized."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import FEATURE_MODES
from .flow_graph import small
from .prepare import as_double

#: Standard deviations below this count as 1.
LEAST_STD = 1e-8


def hospital_inflow(flows: DataFrame, zones: DataFrame, hospital: str) -> DataFrame:
    """``zone_id, inflow``: all flow into zones whose flag is not below 0.5. A null or NaN flag counts as
    hospital; origins need not be known, and self-flows and flows below 0 count."""
    flag = as_double(zones, hospital)
    hospitals = zones.where(flag.isNull() | F.isnan(flag) | (flag >= 0.5)).select(F.col("zone_id").alias("destin"))
    return flows.join(small(hospitals), "destin", "left_semi").groupBy(F.col("destin").alias("zone_id")).agg(F.sum("flow").alias("inflow"))


def raw_features(zones: DataFrame, flows: DataFrame, mode: str, hospital: str | None = None) -> tuple[DataFrame, list[str]]:
    """``zone_id`` and the columns of a feature mode before they are standardized."""
    mode = mode.strip().lower()
    if mode not in FEATURE_MODES:
        raise ValueError(f"unknown feature mode {mode!r}; one of {', '.join(FEATURE_MODES)}")
    columns = {"f0": F.col("XCoord").cast("double"), "f1": F.col("YCoord").cast("double")}
    if "pop" in mode:
        popu = F.coalesce(as_double(zones, "POPU"), F.lit(float("nan"))) if "POPU" in zones.columns else F.lit(0.0)
        columns[f"f{len(columns)}"] = F.log1p(F.when(F.isnan(popu), popu).otherwise(F.greatest(popu, F.lit(0.0))))
    if "hosp" in mode:
        if hospital is None or hospital not in zones.columns:
            raise KeyError(hospital or "hosp")
        zones = zones.join(hospital_inflow(flows, zones, hospital).withColumnRenamed("inflow", "_inflow"), "zone_id", "left")
        columns[f"f{len(columns)}"] = F.log1p(F.greatest(F.coalesce("_inflow", F.lit(0.0)), F.lit(0.0)))
    return zones.select("zone_id", *[c.alias(n) for n, c in columns.items()]), list(columns)


def features(zones: DataFrame, flows: DataFrame, mode: str = "coords", hospital: str | None = None) -> tuple[DataFrame, list[str]]:
    """``zone_id, f0, f1, ...`` standardized by mean and population deviation. A column with a NaN becomes 0
    throughout, a constant one 0 by its own mean."""
    raw, names = raw_features(zones, flows, mode, hospital)
    of = raw.agg(*[g(n).alias(f"{g.__name__}_{n}") for n in names for g in (F.avg, F.stddev_pop)]).first()
    made = []
    for n in names:
        mean, std = of[f"avg_{n}"], of[f"stddev_pop_{n}"]
        if mean is None or not math.isfinite(mean) or not math.isfinite(std):
            made.append(F.lit(0.0).alias(n))
        else:
            made.append(((F.col(n) - F.lit(mean)) / F.lit(1.0 if std < LEAST_STD else std)).alias(n))
    return raw.select("zone_id", *made), names

"""Settings of the two stages and the rules that derive them from user constraints."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: A constraint on clusters: (column, "min" or "max", value).
Constraint = tuple[str, str, float]

# The names of columns; of the hospital flag's in order of preference.
HOSPITAL_COLUMNS = ("hosp", "Hosp_ZoneI", "HOSP", "has_hosp")
FLOW_COLUMNS = ("Origin", "Destin", "Flow")
POPULATION_COLUMN = "POPU"
FEATURE_MODES = ("coords", "coords_pop", "coords_hosp_inflow", "coords_pop_hosp_inflow")
BACKBONES = ("sgcn", "gcn")


@dataclass(frozen=True)
class EmbeddingConfig:
    backbone: str = "sgcn"
    k_hops: int = 5
    gcn_hidden: int = 16
    gcn_layers: int = 2
    spatial_glue: float | None = None
    w_adj_percentile: float = 75.0
    feature_mode: str = "coords"
    seed: int = 42


@dataclass(frozen=True)
class PartitionConfig:
    min_population: float = 10_000
    min_hospitals: float = 1
    min_local_index: float = 0.3
    max_population: float = 500_000
    population_column: str = POPULATION_COLUMN
    hospital_column: str | None = None
    min_per_child_attributes: dict[str, float] = field(default_factory=dict)
    max_cluster_attributes: dict[str, float] = field(default_factory=dict)
    origin_col: str | None = None
    destin_col: str | None = None
    flow_col: str | None = None
    embedding_x_col: str = "Emb_X"
    embedding_y_col: str = "Emb_Y"


@dataclass(frozen=True)
class PipelineConfig:
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    partition: PartitionConfig = field(default_factory=PartitionConfig)


def first_present(groups: Iterable[tuple[str, ...]], columns: Sequence[str]) -> tuple[str, ...] | None:
    """The first group of names that a table has in full, by exact spelling."""
    return next((g for g in groups if set(g) <= set(columns)), None)


def hospital_column(zones: DataFrame) -> str:
    """The column that flags hospitals."""
    found = first_present(((name,) for name in HOSPITAL_COLUMNS), zones.columns)
    if found is None:
        raise KeyError(f"no hospital column; looked for {', '.join(HOSPITAL_COLUMNS)}")
    return found[0]


def flow_columns(flows: DataFrame, origin: str | None = None, destin: str | None = None, flow: str | None = None) -> tuple[str, str, str]:
    """Names of the origin, destination and flow columns: the three given (a lone one or two count for nothing), or
    else the usual three, or else whichever three come first."""
    given = (origin, destin, flow)
    found = given if all(given) else first_present((FLOW_COLUMNS, tuple(flows.columns[:3])), flows.columns)
    if len(found) < 3:
        raise ValueError("a flow table needs three columns")
    return found


_TWO_NAMES = re.compile(r"\s*(?P<x>[^,\s](?:[^,]*[^,\s])?)\s*,\s*(?P<y>[^,\s](?:[^,]*[^,\s])?)\s*")


def coordinate_names(text: str | None) -> tuple[str, str] | None:
    """The two names in "x,y"; None for no text."""
    if not (text or "").strip():
        return None
    pair = _TWO_NAMES.fullmatch(text)
    if pair is None:
        raise ValueError("coordinates must be given as two column names with a comma between them")
    return pair["x"], pair["y"]


def check_constraints(constraints: Sequence[Constraint], zones: DataFrame) -> None:
    """Each constraint has three parts, a known mode and a column of the zone table."""
    for c in constraints:
        if len(c) != 3:
            raise ValueError(f"a constraint is (column, mode, value): {c!r}")
        if str(c[1]).lower() not in ("min", "max"):
            raise ValueError(f"mode must be min or max: {c!r}")
        if c[0] not in zones.columns:
            raise KeyError(c[0])


#: How well a column's bounds speak for its being the population: both, a cap alone, a floor alone.
_SPEAKS = {frozenset({"min", "max"}): 0, frozenset({"max"}): 1, frozenset({"min"}): 2}


def population_column_of(constraints: Sequence[Constraint]) -> str:
    """The population column that constraints imply: the one whose bounds speak best for it, of equal ones the first by
    name (but the usual name before others where both bounds are given); without constraints the usual name."""
    bounds: dict[str, set[str]] = defaultdict(set)
    for column, mode, _ in constraints:
        bounds[column].add(mode.lower())
    ranked = ((_SPEAKS[frozenset(modes)], len(modes) == 2 and column != POPULATION_COLUMN, column) for column, modes in bounds.items())
    return min(ranked, default=(0, False, POPULATION_COLUMN))[-1]


#: Where a bound on the population or the hospital flag goes; all other bounds are kept per column.
_ROUTES = {("population", "min"): "min_population", ("population", "max"): "max_population", ("hospital", "min"): "min_hospitals"}
_PER_COLUMN = {"min": "min_per_child_attributes", "max": "max_cluster_attributes"}


def partition_config(constraints: Sequence[Constraint], population: str, hospital: str | None, min_local_index: float = 0.3, origin: str | None = None, destin: str | None = None, flow: str | None = None) -> PartitionConfig:
    """Settings of the partition stage from constraints, by the table of routes; of repeated ones the last counts.

    Without a named hospital flag, the first floor on a column that is called like one makes it the flag; without
    a floor on the flag no hospital is asked for."""
    bounds = [(column, mode.lower(), float(value)) for column, mode, value in constraints]
    flag = hospital or next((c for c, mode, _ in bounds if mode == "min" and c != population and c in HOSPITAL_COLUMNS), None)
    kinds = {flag: "hospital", population: "population"}
    settings: dict = {"min_hospitals": 0, **{name: {} for name in _PER_COLUMN.values()}}
    for column, mode, value in bounds:
        route = _ROUTES.get((kinds.get(column), mode))
        if route:
            settings[route] = value
        else:
            settings[_PER_COLUMN[mode]][column] = value
    return PartitionConfig(**settings, min_local_index=min_local_index, population_column=population, hospital_column=flag, origin_col=origin, destin_col=destin, flow_col=flow)

import numpy as np
import pytest

from zonespark.operators import flow_graph, ordering, prepare, validate
from zonespark.plans import config


def zones(spark):
    return spark.createDataFrame([(0, "1", 0.0, 0.0, 5.0), (1, "1.0", 9.0, 9.0, 7.0), (2, "2", None, 1.0, 3.0), (3, "2", 1.0, 1.0, 4.0), (4, " ", 1.0, 1.0, 4.0)], "row_ord long, id string, XCoord double, YCoord double, POPU double")


def test_first_record_counts(spark):
    # ids are made unique before the coordinates are looked at, or after
    embed = {r["zone_id"]: r for r in prepare.embedding_zones(zones(spark), "id").collect()}
    assert embed["1"]["POPU"] == 5 and embed["2"]["XCoord"] is None and len(embed) == 2
    located = {r["zone_id"]: r["POPU"] for r in prepare.located_zones(zones(spark).withColumnRenamed("id", "zone_id").replace({"1.0": "1"}, subset="zone_id")).collect()}
    assert located["1"] == 5 and located["2"] == 4


def test_position_is_the_id_without_a_column(spark):
    rows = prepare.partition_zones(zones(spark)).orderBy("row_ord").collect()
    assert [r["zone_id"] for r in rows] == ["0", "1", "2", "3", "4"]
    with pytest.raises(KeyError):
        prepare.partition_zones(zones(spark), "nope")


def test_coordinates(spark):
    df = spark.createDataFrame([("a", "1.5", "x"), ("b", " 2 ", "3")], "id string, east string, north string")
    rows = {r["zone_id"]: (r["XCoord"], r["YCoord"]) for r in prepare.embedding_zones(df, "id", "east, north").collect()}
    assert rows == {"a": (1.5, None), "b": (2.0, 3.0)}
    with pytest.raises(KeyError):
        prepare.embedding_zones(df, "id", "east,south")
    with pytest.raises(KeyError):
        prepare.embedding_zones(df, "id")
    square = spark.createDataFrame([("a", [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]), ("b", None)], "id string, geometry array<array<struct<x: double, y: double>>>")
    rows = {r["zone_id"]: (r["XCoord"], r["YCoord"]) for r in prepare.embedding_zones(square, "id").collect()}
    assert rows == {"a": (1.0, 1.0), "b": (None, None)}
    with pytest.raises(ValueError):
        prepare.embedding_zones(square.where("id = 'b'"), "id")


def test_names():
    assert config.coordinate_names(" ") is None and config.coordinate_names("a, b") == ("a", "b")
    for bad in ("a", "a,b,c", "a,"):
        with pytest.raises(ValueError):
            config.coordinate_names(bad)


def test_flow_and_adjacency_columns(spark):
    flows = spark.createDataFrame([("1", "2", "3"), ("1", "2", "x"), (None, "2", "1")], "a string, b string, c string")
    assert [tuple(r) for r in prepare.flows_of(flows).collect()] == [("1", "2", 3.0), (None, "2", 1.0)]
    assert config.flow_columns(flows, "a", None, "c") == ("a", "b", "c")
    with pytest.raises(ValueError):
        config.flow_columns(flows.select("a", "b"))
    adj = spark.createDataFrame([(1, 2.0), (None, 3.0)], "FOCAL int, Neighbor double")
    assert [tuple(r) for r in prepare.adjacency_of(adj).collect()] == [("1", "2")]
    with pytest.raises(ValueError):
        prepare.adjacency_of(flows)


def test_external_embedding(spark):
    df = spark.createDataFrame([("1.0", 1.0, 2.0), (None, 0.0, 0.0), ("1", 3.0, 4.0)], "z string, p double, q double")
    assert [tuple(r) for r in prepare.external_embedding(df, "z", "p", "q").collect()] == [("1", 1.0, 2.0), ("1", 3.0, 4.0)]


FLOWS = [("1", "2", 3.0), ("1", "2", 5.0), ("2", "1", 1.0), ("1", "1", 9.0), ("1", "3", 0.0), ("1", "3", -2.0), ("1", "99", 4.0), (None, "1", 1.0)]


def test_flow_edges_and_validation(spark):
    z = spark.createDataFrame([("1", 0.0, 0.0), ("2", 3.0, 4.0), ("3", 0.0, 0.0)], "zone_id string, XCoord double, YCoord double")
    flows = spark.createDataFrame(FLOWS, "origin string, destin string, flow double")
    edges = sorted(tuple(r) for r in flow_graph.flow_edges(flows, z).collect())
    assert edges == [("1", "2", 3.0, 5.0), ("1", "2", 5.0, 5.0), ("2", "1", 1.0, 5.0)]
    with pytest.raises(ValueError, match="99"):
        validate.check_flows(flows, z)
    validate.check_flows(flows.where("destin <> '99'"), z)
    adj = spark.createDataFrame([("1", "2"), ("2", "7")], "focal string, neighbor string")
    with pytest.raises(ValueError, match="7"):
        validate.check_adjacency(adj, z)
    none = spark.createDataFrame([], "origin string, destin string, flow double")
    with pytest.raises(RuntimeError):
        flow_graph.weighted_flows(none, z)


def test_repeated_adjacency_doubles_the_glue(spark):
    z = spark.createDataFrame([(str(i), float(i), 0.0) for i in range(1, 4)], "zone_id string, XCoord double, YCoord double")
    adj = spark.createDataFrame([("1", "2"), ("2", "1"), ("1", "2"), ("1", "1"), ("2", "3"), ("3", "8")], "focal string, neighbor string")
    empty = spark.createDataFrame([], "origin string, destin string, w double")
    made = {(r["src"], r["dst"]): r["w"] for r in flow_graph.symmetric_edges(empty, flow_graph.known_neighbours(adj, z), 0.5).collect()}
    assert made == {("1", "2"): 1.5, ("2", "1"): 1.5, ("2", "3"): 0.5, ("3", "2"): 0.5}


@pytest.mark.parametrize("one_task", [0, 1000])
@pytest.mark.parametrize(("flows", "median"), [([1.0, 1.0, 1.0, 1.0], 2.0), ([4.0, 1.0, 1.0, 2.0], 1.0)])
def test_weighted_median(spark, flows, median, one_task):
    df = spark.createDataFrame(list(zip([1.0, 2.0, 2.0, 3.0], flows, strict=True)), "dist double, flow double")
    assert ordering.weighted_quantile(df, "dist", "flow", one_task=one_task) == median
    assert ordering.weighted_quantile(df.where("false"), "dist", "flow", one_task=one_task) is None


@pytest.mark.parametrize("one_task", [-1, 1000])
def test_percentile_and_numbers_like_numpy(spark, one_task):
    values = np.random.default_rng(1).normal(size=501).round(2).tolist()
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for p in (0, 12.5, 50, 75, 99, 100):
        assert ordering.percentile(df, "v", p, one_task) == pytest.approx(np.percentile(values, p), abs=1e-12)
    numbered = ordering.number_rows(df.where("v is not null"), ["v"], "n", one_task).orderBy("n").collect()
    assert [r["n"] for r in numbered] == list(range(501)) and [r["v"] for r in numbered] == sorted(values)
    empty = df.where("false")
    assert ordering.percentile(empty, "v", 50, one_task) is None and ordering.number_rows(empty, ["v"], "n", one_task).count() == 0


def test_population_and_routes():
    # a cap and a floor before a cap alone before a floor alone; the usual name first only among those with both
    assert config.population_column_of([("a", "min", 1), ("a", "max", 2), ("POPU", "MIN", 1), ("POPU", "Max", 2)]) == "POPU"
    assert config.population_column_of([("POPU", "max", 1), ("a", "max", 2)]) == "POPU" and config.population_column_of([("POPU", "max", 1), ("A", "max", 2)]) == "A"
    given = [("has_hosp", "min", 1), ("hosp", "min", 3), ("has_hosp", "min", 2), ("POPU", "max", 9)]
    cfg = config.partition_config(given, "POPU", None)
    assert (cfg.hospital_column, cfg.min_hospitals, cfg.min_per_child_attributes, cfg.max_population) == ("has_hosp", 2, {"hosp": 3}, 9)
    named = config.partition_config([("hosp", "min", 3)], "POPU", "beds")
    assert (named.hospital_column, named.min_hospitals, named.min_per_child_attributes) == ("beds", 0, {"hosp": 3})
    assert config.partition_config([("hosp", "min", 3)], "hosp", None).min_population == 3


def test_names_by_preference(spark):
    both = spark.createDataFrame([], "HOSP double, has_hosp double, Hosp_ZoneI double")
    assert config.hospital_column(both) == "Hosp_ZoneI"
    with pytest.raises(KeyError):
        config.hospital_column(spark.createDataFrame([], "Hosp double"))
    usual = spark.createDataFrame([], "x string, Flow double, Destin string, Origin string")
    assert config.flow_columns(usual) == ("Origin", "Destin", "Flow") and config.flow_columns(usual, "x", "Destin", "Flow") == ("x", "Destin", "Flow")
    assert config.flow_columns(usual.withColumnRenamed("Flow", "n")) == ("x", "n", "Destin")
    assert config.coordinate_names(" my x ,my y") == ("my x", "my y") and config.coordinate_names(None) is None
    for bad in (",", " , b", "a,b,"):
        with pytest.raises(ValueError):
            config.coordinate_names(bad)


def test_constraints(spark):
    table = spark.createDataFrame([], "POPU double, hosp double, beds double")
    assert config.population_column_of([]) == "POPU"
    assert config.population_column_of([("b", "min", 1), ("b", "max", 2), ("a", "max", 2)]) == "b"
    assert config.population_column_of([("b", "max", 1), ("a", "max", 2), ("0", "min", 1)]) == "a"
    assert config.population_column_of([("b", "min", 1)]) == "b"
    cfg = config.partition_config([("POPU", "min", 5), ("POPU", "min", 6), ("hosp", "min", 2), ("hosp", "max", 9), ("beds", "min", 3)], "POPU", None)
    assert (cfg.min_population, cfg.max_population, cfg.hospital_column, cfg.min_hospitals) == (6, 500_000, "hosp", 2)
    assert cfg.min_per_child_attributes == {"beds": 3} and cfg.max_cluster_attributes == {"hosp": 9}
    assert config.partition_config([], "POPU", None).min_hospitals == 0
    for bad, error in ((("POPU", "min"), ValueError), (("POPU", "mean", 1), ValueError), (("nope", "min", 1), KeyError)):
        with pytest.raises(error):
            config.check_constraints([bad], table)
    assert config.hospital_column(table) == "hosp"
    with pytest.raises(KeyError):
        config.hospital_column(table.select("POPU"))

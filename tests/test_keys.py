from pyspark.sql import functions as F

from zonespark.functions.keys import is_full_zone_key, letters_and_digits, norm_zone_key, zone_key

WRITTEN = ["1", "1.0", "1.9", "-1.9", "-0.5", "007", " 12 ", "1e3", "1_000", "1d", "1f", "0x10", "inf", "nan", "A12 ", "9007199254740993", "1e20", "", "  ", None]
NORMAL = ["1", "1", "1", "-1", "0", "7", "12", "1000", "1000", "1d", "1f", "0x10", "inf", "nan", "A12", "9007199254740992", "100000000000000000000", None, None, None]


def test_norm_zone_key_of_text(spark):
    rows = spark.createDataFrame(list(enumerate(WRITTEN)), "i int, z string").select("i", norm_zone_key(F.col("z")).alias("k")).orderBy("i").collect()
    assert [r["k"] for r in rows] == NORMAL


def test_norm_zone_key_of_numbers(spark):
    df = spark.createDataFrame([(1.9, 3), (float("nan"), None), (None, 4)], "d double, n int")
    rows = df.select(norm_zone_key(F.col("d"), df.schema["d"].dataType).alias("d"), norm_zone_key(F.col("n"), df.schema["n"].dataType).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("1", "3"), (None, None), (None, "4")]


def test_zone_key(spark):
    written = ["ql-04 12345", "“QL‐04‑12345–b”", "\tql 041_2345\r", " - ", "", None, "QL-04-1234"]
    rows = spark.createDataFrame([(w,) for w in written], "z string").select(zone_key(F.col("z")).alias("k"), is_full_zone_key(zone_key(F.col("z"))).alias("f")).collect()
    assert [tuple(r) for r in rows] == [("QL0412345", True), ("QL0412345B", True), ("QL0412345", True), (None, False), (None, False), (None, False), ("QL041234", False)]


def test_letters_and_digits(spark):
    rows = spark.createDataFrame([("Café  B.",), ("--",), (None,)], "z string").select(letters_and_digits(F.col("z"))).collect()
    assert [r[0] for r in rows] == ["CAFÉB", "", None]

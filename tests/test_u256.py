import random

from pyspark.sql import functions as F

from ledgerlake.functions import chain, u256


def values():
    draw = random.Random(3)
    return [0, 1, 2**32 - 1, 2**32, 10**26 - 1, 10**26, 10**52, 2**255, 2**256 - 1, *(draw.getrandbits(draw.randint(1, 256)) for _ in range(40))]


def test_hex_to_text(spark):
    df = spark.createDataFrame([("0x" + format(v, "x").zfill(64), str(v)) for v in values()], "h string, want string")
    assert df.where(u256.to_text(u256.limbs_from_hex(F.col("h"))) != F.col("want")).count() == 0


def test_decimal_round_trip(spark):
    df = spark.createDataFrame([(str(v),) for v in values()], "d string")
    assert df.where(u256.to_text(u256.limbs_from_decimal(F.col("d"))) != F.col("d")).count() == 0


def test_saturation_and_odd_input(spark):
    rows = [("0x" + "1" * 65, u256.MAX_TEXT), ("0x" + "0" * 30 + "f" * 64, u256.MAX_TEXT), ("", "0"), ("0x", "0"), ("0xzz", None)]
    df = spark.createDataFrame(rows, "h string, want string")
    assert df.where(~u256.to_text(u256.limbs_from_hex(F.col("h"))).eqNullSafe(F.col("want"))).count() == 0
    assert spark.range(1).select(u256.to_text(chain.decode_uint256(F.lit(None).cast("string"))).alias("v")).head().v == "0"


def test_exact_sum(spark):
    v = [x >> 4 for x in values()]
    df = spark.createDataFrame([(str(x),) for x in v], "d string")
    got = df.select(u256.limbs_from_decimal(F.col("d")).alias("l")).agg(u256.to_text(u256.sum_limbs(F.col("l"))).alias("s")).head().s
    assert int(got) == sum(v)


def test_order(spark):
    v = sorted(values())
    df = spark.createDataFrame([(str(x), k) for k, x in enumerate(v)], "d string, k int")
    got = [r.d for r in df.orderBy(u256.limbs_from_decimal(F.col("d")), "k").collect()]
    assert got == [str(x) for x in v]


def test_parse_numeric(spark):
    rows = [
        ("12", "12", None), (" 007 ", "7", None), ("0xff", "255", None), ("0X0", "0", None), ("1e3", "1000", None), ("1.50e2", "150", None), ("1.234e2", None, "not a whole number"),
        ("abc", None, "not a whole number"), ("1.5", None, "not a whole number"), ("", None, "empty"), (None, None, "empty"), (str(2**256 - 1), str(2**256 - 1), None),
        (str(2**256), None, "overflow"), ("1e78", None, "overflow"), ("-5", None, "not a whole number"), ("0x" + "f" * 65, None, "not a whole number"),
    ]
    df = spark.createDataFrame(rows, "t string, v string, e string").select("*", chain.parse_numeric(F.col("t")).alias("p"))
    bad = df.where(~F.col("p.value").eqNullSafe(F.col("v")) | ~F.col("p.error").eqNullSafe(F.col("e"))).collect()
    assert not bad, bad


def test_format_amount(spark):
    rows = [("0", 18, "0.0000"), ("1", 18, "0.0000"), ("1234567", 6, "1.2345"), ("19999", 4, "1.9999"), ("5", 0, "5.0000"), ("123456789012345", 0, "123456...345.0000"), ("12", 1, "1.2000")]
    df = spark.createDataFrame(rows, "a string, d int, w string")
    bad = df.withColumn("g", chain.format_amount(F.col("a"), F.col("d"))).where("g <> w").collect()
    assert not bad, bad


def test_client_ip(spark):
    rows = [("203.0.113.7:99", "x", "203.0.113.7"), ("203.0.113.7, 10.0.0.1", "x", "203.0.113.7"), (None, "10.1.1.1:80", "10.1.1.1"), ("", "[::1]:80", "::1"), ("::1", "x", "::1"), (" 1.2.3.4 ", "x", "1.2.3.4")]
    df = spark.createDataFrame(rows, "f string, r string, w string").withColumn("g", chain.client_ip(F.col("f"), F.col("r")))
    bad = df.where("g <> w").collect()
    assert not bad, bad

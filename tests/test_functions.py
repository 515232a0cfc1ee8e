"""Hand-computed cases of normalization, lists, metrics and n-grams."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import metrics, text
from tessera.sources import tables


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def applied(spark, values, f):
    return [r["y"] for r in column(spark, values).select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


NAMES = [
    ("Payne Énterprises", "payne enterprises", "payne enterprises"),
    ("Acme Pvt. Ltd.", "acme pvt ltd", "acme"),
    ("Foo Co., Ltd", "foo co ltd", "foo co"),
    ("Limited", "limited", "limited"),
    ("Cisco", "cisco", "cisco"),
    ("L.L.C.", "l l c", "l l c"),
    ("एसएस फूड प्राइवेट लिमिटेड", "एसएस फूड प्राइवेट लिमिटेड", "एसएस फूड"),
    ("foo एलएलपी", "foo एलएलपी", "foo एलएलपी"),
    ("", "", ""),
    (None, "", ""),
    ("ｆｕｌｌ　ｗｉｄｔｈ №5", "full width no5", "full width no5"),
    ("a​b\tc d_e", "a b c d e", "a b c d e"),
]


def test_norm_basic_and_legal(spark):
    basic = applied(spark, [n for n, _, _ in NAMES], text.norm_basic)
    assert basic == [b for _, b, _ in NAMES]
    assert applied(spark, basic, text.norm_legal) == [x for _, _, x in NAMES]


def test_norm_audit_and_light(spark):
    assert applied(spark, ["Énterprises", "  A--b_c  ", None], text.norm_audit) == ["e nterprises", "a b_c", ""]
    assert applied(spark, ["  Ab C "], text.norm_light) == ["ab c"]


def test_parse_list(spark):
    assert applied(spark, ["S2-1, ,S3-2", "", None, " , ", "10,1"], text.parse_list) == [["S2-1", "S3-2"], [], [], [], ["10", "1"]]


def test_char_ngrams(spark):
    grams = lambda c: text.char_ngrams(c, 3, 5)
    assert applied(spark, ["acme", "ab", ""], grams) == [["acm", "cme", "acme"], [], []]


def test_script(spark):
    assert applied(spark, ["फूड", "food"], text.has_devanagari) == [True, False]


@pytest.mark.parametrize("truth,predicted,right,want", [(0, 0, 0, 1.0), (0, 3, 0, 0.0), (2, 0, 0, 0.0), (2, 5, 0, 0.0), (2, 2, 2, 1.0), (4, 3, 2, 0.625)])
def test_entity_f05(spark, truth, predicted, right, want):
    row = spark.range(1).select(metrics.entity_f05(F.lit(truth), F.lit(predicted), F.lit(right)).alias("f")).first()
    assert row["f"] == pytest.approx(want)


def test_ratios(spark):
    row = spark.range(1).select(
        metrics.ratio(F.lit(1), F.lit(0)).alias("zero"), metrics.f_beta(F.lit(0.5), F.lit(0.25)).alias("f"), metrics.f_beta(F.lit(0.0), F.lit(0.0)).alias("none"),
        metrics.reduction_ratio(F.lit(5), F.lit(10), F.lit(10)).alias("spared"), metrics.pair_space(F.lit(10**12), F.lit(10**12)).alias("space"),
    ).first()
    assert row["zero"] == 0 and row["none"] == 0 and row["f"] == pytest.approx(1.25 * 0.125 / 0.375) and row["spared"] == pytest.approx(0.95) and int(row["space"]) == 10**24


def test_truth_lists(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1, ,S3-2"), ("S1-2", "")], tables.TRUTH)
    pairs = sorted(map(tuple, tables.truth_pairs(lists).collect()))
    assert pairs == [("S1-1", "S2-1", "S2"), ("S1-1", "S3-2", "S3")]
    s1 = spark.createDataFrame([("S1-1", "n", "a", "US")], tables.RECORD)
    assert sorted(map(tuple, tables.truth_summary(lists, s1).collect())) == [("S1-1", "US", 2, False), ("S1-2", "UNKNOWN", 0, True)]

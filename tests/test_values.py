import datetime

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import values as fn


def column(spark, texts, expression, schema="x string"):
    df = spark.createDataFrame([(t,) for t in texts], schema).coalesce(1)
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_coerce_numeric(spark):
    raw = ["45000", " 45000 ", "59,900", "30%", "", "NaN", "1f", "1.0d", "inf", "-1", "1e3", ".5", None]
    got = column(spark, raw, fn.coerce_numeric)
    assert got == [45000.0, 45000.0, None, None, None, None, None, None, float("inf"), -1.0, 1000.0, 0.5, None]


def test_parse_money_percent(spark):
    assert column(spark, ["59,900원", "30%", "", "free"], fn.parse_money_percent) == [59900.0, 30.0, None, None]


def test_text_or_nan(spark):
    assert column(spark, [None, "a"], fn.text_or_nan) == ["", "a"]
    assert column(spark, [None, "a"], lambda c: fn.text_or_nan(c, compat_nan=True)) == ["nan", "a"]


def test_percent_format_rounds_half_even(spark):
    assert column(spark, [12.5, 13.5, 0.5, 99.6], fn.percent_format, "x double") == ["12", "14", "0", "100"]


def test_severity_level(spark):
    assert column(spark, [0.0, 19.9, 20.0, 99.0, 100.0], fn.severity_level, "x double") == [1, 1, 2, 5, 5]


def test_extract_keywords(spark):
    got = column(spark, ["예쁜 옷! 정말 예쁜 색 abc", None], fn.extract_keywords)
    assert got == [["예쁜", "정말", "예쁜"], []]


AS_OF = datetime.datetime(2024, 1, 20, 12, 0)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("3시간 전", datetime.datetime(2024, 1, 20, 9, 0)),
        ("2일 전", datetime.datetime(2024, 1, 18, 12, 0)),
        ("1주일 전", datetime.datetime(2024, 1, 13, 12, 0)),
        ("2주 전", datetime.datetime(2024, 1, 6, 12, 0)),
        ("1개월 전", datetime.datetime(2023, 12, 21, 12, 0)),
        ("2달 전", datetime.datetime(2023, 11, 21, 12, 0)),
        ("24.01.15", datetime.datetime(2024, 1, 15)),
        ("2024.01.15", datetime.datetime(2024, 1, 15)),
        ("2024/1/5 10:00", datetime.datetime(2024, 1, 5)),
        ("2024-02-30", None),
        ("조금 전", None),
        ("nonsense", None),
    ],
)
def test_parse_review_date(spark, text, expected):
    as_of = F.lit(AS_OF)
    assert column(spark, [text], lambda c: fn.parse_review_date(c, as_of)) == [expected]


def test_parse_review_date_compat(spark):
    as_of = F.lit(AS_OF)
    got = column(spark, ["1주일 전", "nonsense", "조금 전"], lambda c: fn.parse_review_date(c, as_of, True))
    assert got == [datetime.datetime(2024, 1, 19, 12, 0), AS_OF, None]


def test_review_fields(spark):
    assert column(spark, ["4점 좋아요", "별3", "★5", "평점은 2", "none"], fn.parse_rating) == ["4", "3", "5", "2", ""]
    assert column(spark, [None, "도움 12", "도움"], fn.helpful_count) == ["0", "12", None]
    assert column(spark, [0, 2, None], fn.has_image, "x int") == ["N", "Y", "N"]

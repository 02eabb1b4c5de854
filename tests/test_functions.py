"""Scalar functions at their edges."""

import pytest
from pyspark.sql import functions as F

from panelwright.functions import exprs as X
from panelwright.functions.keys import accession_key, annual_form, firm_key


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_keys(spark):
    assert values(spark, firm_key, ["CIK0001000437", " 1000437.0 ", "1000437", "000", "abc", "", None, "12-3"]) == ["1000437", "1000437", "1000437", "0", None, None, None, "123"]
    assert values(spark, X.numeric_key, ["1750.0", "0001750", "abc", "12-3", None]) == ["1750", "1750", None, None, None]
    given = ["0001200018-20-000685", "000120001820000685", "1200018-20-000685", "edgar/data/9/0001200018-20-000685.txt", "0001200018 - 20 - 000685", "x", None]
    assert values(spark, accession_key, given) == ["0001200018-20-000685"] * 5 + [None, None]
    assert values(spark, annual_form, ["10-K", "form 10-k", "10 - K", "10K/A", "10-KA", "10-Q", "", None]) == ["10-K", "10-K", "10-K", "10-K/A", "10-K/A", None, None, None]


def test_numbers(spark):
    assert values(spark, X.safe_log, [1.0, 0.0, -1.0, None], "double") == [0.0, None, None, None]
    assert values(spark, lambda c: X.ratio(F.lit(1.0), c), [2.0, 0.0, -2.0, None], "double") == [0.5, None, None, None]
    assert values(spark, lambda c: X.plain_ratio(F.lit(1.0), c), [2.0, 0.0, None], "double") == [0.5, None, None]
    assert values(spark, lambda c: X.null_sum(c, F.lit(None).cast("double")), [2.0, None], "double") == [2.0, None]
    assert values(spark, lambda c: X.clip(c, F.lit(0.0), F.lit(1.0)), [2.0, -1.0, None], "double") == [1.0, 0.0, None]
    assert values(spark, X.fixed, [-0.0001, 1.23456, None], "double") == ["0.000", "1.235", ""]
    assert values(spark, lambda c: X.stars(c), [0.001, 0.04, 0.5, None], "double") == ["***", "**", "", ""]
    assert values(spark, X.grouped, [1234567.0, None], "double") == ["1,234,567", ""]


def test_texts(spark):
    assert values(spark, X.to_int, ["1750.0", "x", "", None]) == [1750, None, None, None]
    assert values(spark, X.parse_year, [" 2019-01-02", "19", "x2019", None]) == [2019, None, None, None]
    assert values(spark, X.squish, ["a  \tb ", None]) == ["a b", None]
    assert values(spark, X.parse_percent, ["12.5%", "S", ".", "", None, "7"]) == [0.125, None, None, None, None, 0.07]
    assert [str(v) for v in values(spark, X.parse_date, ["2020-01-31", "1/31/2020", "31/31/2020", "", None])] == ["2020-01-31", "2020-01-31", "None", "None", "None"]
    assert values(spark, X.truth, ["True", "1", "yes", "False", "0", None]) == [True, True, True, False, False, False]
    assert values(spark, X.structured_text, ["a • b\r\n\r\n\r\n\r\nc | d a) Xy"]) == ["a\nb\n\nc\nd\na) Xy"]


def test_normal_p(spark):
    got = values(spark, lambda c: X.normal_p(c, F.lit(1.0)), [1.959963984540054, 0.0, None], "double")
    assert got[0] == pytest.approx(0.05) and got[1] == 1.0 and got[2] is None


def test_hash_fraction_is_the_first_sixteen_digits(spark):
    import hashlib

    want = int(hashlib.sha256(b"abc").hexdigest()[:16], 16) / 16**16
    assert values(spark, X.hash_fraction, ["abc"]) == [pytest.approx(want)]

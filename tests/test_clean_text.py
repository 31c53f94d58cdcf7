"""Cleaning, rounding, text and calendar functions on literal rows."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tessera.functions import dates as DT
from tessera.functions import text as TX
from tessera.functions.numeric import round_half_even
from tessera.operators import clean as C


def test_round_half_even_like_pandas(spark):
    import pandas as pd
    vals = [0.125, 0.135, 2.5, 3.5, -0.125, 1.0005, 272072.6635, 1.23456]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.y for r in df.select(round_half_even("x", 3).alias("y")).collect()]
    exp = pd.Series(vals).round(3).tolist()
    assert got[:6] == exp[:6]
    assert abs(got[6] - 272072.664) < 1e-9  # a half-way point of the decimal text goes to even


def test_parse_rating_and_blanking(spark):
    rows = [("7",), (" 8 ",), ("7.9",), ("Rate: 8",), ("As an AI language model I cannot",), (None,), ("10",)]
    df = spark.createDataFrame(rows, "r string")
    out = df.select(C.parse_rating("r").alias("p"), C.blank_long(C.blank_refusals("r"), 4).alias("b")).collect()
    assert [o.p for o in out] == [7, 8, 7, None, None, None, 10]
    assert [o.b for o in out] == ["7", " 8 ", "7.9", None, None, None, "10"]


def test_drop_invalid_warmup_zero_nan_inf(spark):
    rows = [("A", dt.date(2020, 1, i), v) for i, v in enumerate(
        [0.0, 1.0, float("nan"), 2.0, float("inf"), 3.0, 4.0, 5.0, 6.0, 7.0, 0.0, None, 8.0], start=1)]
    df = spark.createDataFrame(rows, "tic string, date date, macd double")
    kept = sorted(r.date.day for r in C.drop_invalid(df, ["macd"], warmup=10).collect())
    assert kept == [2, 4, 6, 7, 8, 9, 10, 11, 13]  # zero on day 1 (warm-up) dropped, on day 11 kept


def test_check_contract_counts_violations(spark):
    df = spark.createDataFrame([("1", "x"), ("2", None), ("a", "y")], "n string, s string")
    r = {x.column: (x.present, x.violations) for x in C.check_contract(df, {"n": "int", "s": "string", "z": "int"}).collect()}
    assert r == {"n": (True, 1), "s": (True, 0), "z": (False, 0)}


def test_normalise_text_unicode_whitespace(spark):
    s = 'a b\x1cc  "d"\r\n\te　f '
    out = spark.createDataFrame([(s,)], "t string").select(TX.normalise_text("t").alias("o")).first().o
    assert out == " ".join(s.replace('"', "").split())


def test_html_to_text_script_comment_entities(spark):
    h = ('<!DOCTYPE html><html><head><style>p{x:1}</style><script>var t="</p>";</script></head>'
         '<body><!-- c --><p>Caf&eacute; &amp; co</p><div>next</div></body></html>')
    out = spark.createDataFrame([(h,)], "h string").select(TX.html_to_text("h").alias("o")).first().o
    assert out == "Café & conext"


def test_truncate_words(spark):
    t = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(t,), ("short text",), ("",)], "t string")
    out = [r.o for r in df.select(TX.truncate_words("t", 5).alias("o")).collect()]
    assert out == ["w0 w1 w2 w3 w4...", "short text", ""]


def test_interval_names():
    assert TX.normalise_interval("15Min") == "15m" and TX.normalise_interval("1W") == "1wk"
    assert TX.normalise_interval("3M") == "3mo" and TX.normalise_interval("1H") == "1h"
    try:
        TX.normalise_interval("7X")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_next_180_sessions_golden(spark):
    start = spark.createDataFrame([("X", dt.date(2023, 5, 4))], "tic string, date date")
    s = sorted(r.date for r in DT.next_sessions(start, spark, 180).collect())
    assert len(s) == 180 and s[0] == dt.date(2023, 5, 5) and s[-1] == dt.date(2024, 1, 23)


def test_cyclic_encoding(spark):
    df = spark.createDataFrame([(dt.date(2023, 3, 15), 2)], "date date, day int")
    r = DT.cyclic_dates(df).first()
    assert abs(r.month_sin - math.sin(2 * math.pi * 3 / 12)) < 1e-12
    assert abs(r.day_of_week_cos - math.cos(2 * math.pi * 2 / 5)) < 1e-12

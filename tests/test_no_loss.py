"""Nothing is lost: null keys and orders, file layouts of streams, long texts, tickers."""

import datetime as dt
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tessera.functions.text import html_to_text, strip_tags
from tessera.operators.features import lead_target
from tessera.operators.rating import lexicon_scorer, rate_text
from tessera.operators.risk import wide
from tessera.operators.series import IDX, ffill, with_index
from tessera.plans.textplans import news_batch
from tessera.streaming import streams as ST

D = dt.date


@pytest.fixture(scope="module")
def nullish(spark):
    rows = [("A", D(2024, 1, 2), 1.0), ("A", None, 2.0), ("A", D(2024, 2, 2), None), (None, D(2024, 1, 2), 4.0),
            (None, D(2024, 3, 2), None)]
    return spark.createDataFrame(rows, "tic string, date date, close double")


def test_index_keeps_rows_with_null_key_or_order(nullish):
    got = sorted(((r.tic, r.date, r[IDX]) for r in with_index(nullish).collect()), key=str)
    assert got == sorted([("A", None, 0), ("A", D(2024, 1, 2), 1), ("A", D(2024, 2, 2), 2), (None, D(2024, 1, 2), 0),
                          (None, D(2024, 3, 2), 1)], key=str)
    assert with_index(nullish).columns == nullish.columns + [IDX]


def test_lead_and_fill_keep_rows(nullish):
    assert lead_target(nullish, 1, "close", "target").count() == 5
    got = {(r.tic, r.date): r.close for r in ffill(nullish, ["close"]).collect()}
    assert got[(None, D(2024, 3, 2))] == 4.0 and got[("A", D(2024, 2, 2))] == 1.0 and len(got) == 5


@pytest.mark.parametrize("layout", ["file", "files", "folder"])
def test_stream_bars_do_not_depend_on_files(spark, tmp_path, layout):
    from tessera.plans.q_streaming import EVENTS_SCHEMA
    src, land = f"{SF001}/events.parquet", tmp_path / "land"
    land.mkdir()
    events = spark.read.parquet(src)
    if layout == "file":
        shutil.copy(src, land / "events.parquet")
    elif layout == "folder":
        events.repartition(4, "event_id").write.parquet(str(land / "events.parquet"))
    else:  # every file spans the whole period
        events.repartition(4, "event_id").write.parquet(str(tmp_path / "parts"))
        for k, f in enumerate(sorted((tmp_path / "parts").glob("*.parquet"))):
            shutil.copy(f, land / f"events-{k}.parquet")
    s = ST.file_stream(spark, str(land), "events", EVENTS_SCHEMA).withColumnRenamed("event_type", "tic")
    out = str(tmp_path / "out")
    ST.run_available_now(ST.stream_bars(s, "1 hour", "10 minutes"), out)
    got = spark.read.parquet(out + "/out").agg(F.sum("volume"), F.count("*")).first()
    last = events.agg(F.date_trunc("hour", F.max("ts"))).first()[0]
    closed = events.filter(F.col("ts") < F.lit(last))  # the open window is held back
    assert got[0] == closed.count()
    assert got[1] == closed.select("event_type", F.date_trunc("hour", "ts")).distinct().count()


def test_rating_reads_whole_texts(spark):
    df = spark.createDataFrame([(1, "word " * 3000 + "gain surge"), (2, None)], "doc_id long, body string")
    got = {r.doc_id: r.rating for r in rate_text(df).collect()}
    assert got == {1: 7, 2: None}
    assert {r.rating for r in rate_text(df.filter("doc_id = 1"), max_words=1500).collect()} == {5}


def test_scorer_failures(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else "gain") for i in range(10)], "doc_id long, body string").coalesce(1)

    def some(texts: pd.Series) -> pd.Series:
        if (texts == "bad").any():
            raise ValueError("refused")
        return lexicon_scorer(texts)

    def dead(texts: pd.Series) -> pd.Series:
        raise ValueError("down")

    # a tolerance must be asked for: by default one failure fails the run
    with pytest.raises(Exception, match="scorer failed on 1 of 10"):
        rate_text(df, some).collect()
    got = {r.doc_id: r.rating for r in rate_text(df, some, max_failures=0.5).collect()}
    assert got == {i: None if i == 3 else 6 for i in range(10)}
    again = rate_text(df, done=spark.createDataFrame([(i, 6) for i in range(10) if i != 3], "doc_id long, rating int"))
    assert [r.doc_id for r in again.collect()] == [3]
    with pytest.raises(Exception, match="scorer failed on 10 of 10"):
        rate_text(df, dead).collect()


def test_wide_takes_every_ticker(spark):
    df = spark.createDataFrame([("Z", D(2024, 1, 1), 1.0), ("B", D(2024, 1, 1), 2.0)], "tic string, date date, close double")
    assert wide(df).columns == ["date", "B", "Z"]
    with pytest.raises(Exception, match="ticker not in the list: Z"):
        wide(df, ["B"]).collect()


def test_news_text(spark):
    rows = [(1, "T", "2024-01-02", 'He said "x"', "<p title='a>b'>A &amp; B&nbsp;C</p>"), (2, "T", "2024-01-03", "He said x", "later"),
            (3, "U", "2024-01-02", "He said x", "other ticker, same day"), (4, "U", "2024-01-04", "He said x", "later"),
            (5, "U", "2024-01-05", "new", None)]
    df = spark.createDataFrame(rows, "doc_id long, tic string, created string, title string, body string")
    assert [tuple(r) for r in news_batch(df).collect()] == [(1, "T", "2024-01-02", "He said x", "A & B C")]
    odd = spark.createDataFrame([("<p title=\"a>b\">x</p>",), ("a < b it's 5 > 3",), ("<a " + "b='c' " * 20000 + ">y",)], "h string")
    assert [r[0] for r in odd.select(strip_tags("h")).collect()] == ["x", "a < b it's 5 > 3", "y"]
    assert odd.select(html_to_text("h")).first()[0] == "x"


def test_ties_and_record_filters(spark):
    from tessera.operators.asof import asof_backward, point_in_time
    facts = spark.createDataFrame([("A", D(2024, 1, 5))], "tic string, date date")
    rec = spark.createDataFrame([("A", D(2024, 1, 2), 1, "Q", 1.0), ("A", D(2024, 1, 2), 3, "Q", 3.0), ("A", D(2024, 1, 2), 2, "Q", 2.0),
                                 ("A", D(2024, 1, 3), 9, "Y", 9.0)], "tic string, date date, seq int, period string, v double")
    assert asof_backward(facts, rec.filter("period = 'Q'"), ["v"], tie=["seq"]).first()["v"] == 3.0
    got = point_in_time(facts, rec, ["tic"], "date", "date", ["v"], tie=["seq"], where={"period": "Q"})
    assert got.columns == ["tic", "date", "v"] and got.first()["v"] == 3.0


def test_checkpoint_folder_is_required_on_a_cluster(spark):
    from types import SimpleNamespace
    from tessera.session import checkpoint_dir
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077",
                              getConf=lambda: SimpleNamespace(get=lambda k, d: None))
    with pytest.raises(RuntimeError, match="shared folder"):
        checkpoint_dir(SimpleNamespace(sparkContext=context))


def test_movers_filters(spark):
    from tessera.operators.screen import movers
    rows = [(t, dt.datetime(2024, 1, d, h), p) for t, a, b in (("A", 1.0, 2.0), ("B", 1.0, 3.0), ("C", 1.0, 0.5))
            for d, h, p in ((2, 10, a), (3, 10, b), (3, 20, 99.0))]
    df = spark.createDataFrame(rows, "tic string, ts timestamp_ntz, close double")
    u = spark.createDataFrame([("A", 2e9, 5.0, "x", "i"), ("B", 5e8, 5.0, "x", "j"), ("C", 3e9, 1.0, "y", "i")],
                              "tic string, marketcap double, close double, sector string, industry string")
    def top(**f):
        m = movers(df, "2024-01-01", "2024-01-04", date="ts", session="REGULAR", universe=u, **f)
        return [r.tic for r in m.filter("side = 'gainer'").collect()]
    assert top() == ["B", "A", "C"] and top(market_cap_gt="1b") == ["A", "C"] and top(market_cap_lt="2.5b") == ["B", "A"]
    assert top(close_gt=4) == ["B", "A"] and top(sector="y") == ["C"] and top(industry="i") == ["A", "C"]

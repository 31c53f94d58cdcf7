"""Registered queries: features, model dataflow, rating, risk and the text plans
(ML-*, WIN-11, PIPE-08..11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.functions.numeric import round_half_up
from tessera.operators import bars as B
from tessera.operators import events as EV
from tessera.operators import features as FE
from tessera.operators import iterative as IT
from tessera.operators import model as M
from tessera.operators import rating as R
from tessera.operators import textclass as TXC
from tessera.operators.indicators import add_indicators, pct_change
from tessera.operators.series import IDX, ffill, with_index
from tessera.operators.risk import turbulence
from tessera.plans.fixtures import Fixtures
from tessera.plans.flagship import flagship
from tessera.plans.registry import query
from tessera.session import materialize

WS = TX.WS_CLASS


def _fx(spark, sf_dir):
    return Fixtures(spark, sf_dir)


@query("ml_01_one_hot_month", "SELECT tic, date, " + ", ".join(
    f"CAST(month(date) = {k} AS INT) AS Month_{k}" for k in range(1, 13)) + " FROM bars_d", ("bars_d",))
def ml_01(spark, sf_dir):
    d = FE.one_hot_month(_fx(spark, sf_dir).bars_d)
    return d.select("tic", "date", *[f"Month_{k}" for k in range(1, 13)])


@query("ml_02_standardise", """
SELECT tic, date, round((close - avg(close) FILTER (WHERE labelled) OVER (PARTITION BY tic))
    / CASE WHEN coalesce(stddev_pop(close) FILTER (WHERE labelled) OVER (PARTITION BY tic), 0) = 0 THEN 1
      ELSE stddev_pop(close) FILTER (WHERE labelled) OVER (PARTITION BY tic) END, 6) AS close_z,
  round((volume - avg(volume) FILTER (WHERE labelled) OVER (PARTITION BY tic))
    / CASE WHEN coalesce(stddev_pop(volume) FILTER (WHERE labelled) OVER (PARTITION BY tic), 0) = 0 THEN 1
      ELSE stddev_pop(volume) FILTER (WHERE labelled) OVER (PARTITION BY tic) END, 6) AS volume_z
FROM (SELECT *, date < DATE '1999-01-01' AS labelled FROM bars_d) b""", ("bars_d",))
def ml_02(spark, sf_dir):
    b = _fx(spark, sf_dir).bars_d.withColumn("labelled", F.col("date") < F.lit("1999-01-01").cast("date"))
    d = FE.standardise(b, ["close", "volume"], fit_mask="labelled", suffix="_z")
    return d.select("tic", "date", round_half_up("close_z", 6).alias("close_z"),
                    round_half_up("volume_z", 6).alias("volume_z"))


@query("ml_03_minmax", """
SELECT tic, date, CASE WHEN max(close) OVER w = min(close) OVER w THEN 0.0
  ELSE round((close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w), 6) END AS close,
  CASE WHEN max(volume) OVER w = min(volume) OVER w THEN 0.0
  ELSE round((volume - min(volume) OVER w) / (max(volume) OVER w - min(volume) OVER w), 6) END AS volume
FROM bars_d WINDOW w AS (PARTITION BY tic)""", ("bars_d",))
def ml_03(spark, sf_dir):
    d = FE.minmax(_fx(spark, sf_dir).bars_d.select("tic", "date", "close", "volume"), ["close", "volume"])
    return d.select("tic", "date", round_half_up("close", 6).alias("close"), round_half_up("volume", 6).alias("volume"))


@query("ml_04_hash_split", """SELECT tic, CASE WHEN b < 900 THEN 'train' ELSE 'test' END AS split, count(*) AS n
FROM (SELECT tic, CAST(('0x' || substr(md5(concat_ws('|', '42', tic, CAST(date AS VARCHAR))), 1, 8)) AS BIGINT) % 1000 AS b
      FROM bars_d) h GROUP BY 1, 2""", ("bars_d",))
def ml_04(spark, sf_dir):
    b = _fx(spark, sf_dir).bars_d.select("tic", "date")
    d = FE.hash_split(b, ["tic", "date"], (0.9, 0.1), ("train", "test"))
    return d.groupBy("tic", "split").agg(F.count(F.lit(1)).alias("n"))


@query("ml_04_exact_split", """WITH h AS (SELECT tic, date, md5(concat_ws('|', '42', tic, CAST(date AS VARCHAR))) AS h,
    md5(concat_ws('|', '7', tic, CAST(date AS VARCHAR))) AS h2, count(*) OVER (PARTITION BY tic) AS n FROM bars_d),
a AS (SELECT *, row_number() OVER (PARTITION BY tic ORDER BY substr(h, 1, 15)) <= n - ceil(round(n * 0.1, 6)) AS keep FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY tic ORDER BY substr(h2, 1, 15)) AS rk, count(*) OVER (PARTITION BY tic) AS m FROM a WHERE keep)
SELECT tic, date, CASE WHEN rk <= m - ceil(round(m * 0.2, 6)) THEN 'train' ELSE 'val' END AS split FROM b
UNION ALL SELECT tic, date, 'test' FROM a WHERE NOT keep""", ("bars_d",))
def ml_04_exact(spark, sf_dir):
    """Exactly 90/10, then 80/20 of the rest, per ticker."""
    b = _fx(spark, sf_dir).bars_d.select("tic", "date")
    d = FE.exact_split(b, ["tic"], ["tic", "date"], 0.1)
    train = FE.exact_split(d.filter("split = 'train'").drop("split"), ["tic"], ["tic", "date"], 0.2, ("train", "val"), seed=7)
    return train.unionByName(d.filter("split = 'test'"))


@query("ml_05_feature_array", """SELECT tic, date, [close, volume, CAST(day AS DOUBLE), high - low] AS features FROM bars_d""",
       ("bars_d",))
def ml_05(spark, sf_dir):
    b = _fx(spark, sf_dir).bars_d.withColumn("spread", F.col("high") - F.col("low"))
    return FE.assemble(b, ["close", "volume", "day", "spread"]).select("tic", "date", "features")


def _flagship_sql() -> str:
    """DuckDB text of the flagship: the PIPE-05 merge, calendar features, the 90-row lead
    target, per-ticker z-scores fitted on labelled rows (population std, 0 -> 1) and the
    feature array (close first, unscaled)."""
    from tessera.plans.flagship import FEATURE_BASE, HORIZON_ROWS, MONTHS
    from tessera.plans.q_daily import SQL_MERGE
    cut = SQL_MERGE.rindex("\nSELECT tic, date, close, volume, day,")
    tau = "6.283185307179586"
    cal = {"month_sin": f"sin({tau} * month(date) / 12)", "month_cos": f"cos({tau} * month(date) / 12)",
           "day_of_month_sin": f"sin({tau} * dayofmonth(date) / 31)",
           "day_of_month_cos": f"cos({tau} * dayofmonth(date) / 31)",
           "day_of_week_sin": f"sin({tau} * day / 5)", "day_of_week_cos": f"cos({tau} * day / 5)",
           "Year": "year(date)", "Day": "dayofmonth(date)"}
    cal.update({m: f"CAST(month(date) = {m.split('_')[1]} AS INT)" for m in MONTHS})
    feats = list(FEATURE_BASE) + list(MONTHS)
    src = {c: (f"x_{c}" if c in cal else c) for c in feats}
    stats = ", ".join(f"avg(CASE WHEN labelled THEN CAST({src[c]} AS DOUBLE) END) AS mu{i}, "
                      f"stddev_pop(CASE WHEN labelled THEN CAST({src[c]} AS DOUBLE) END) AS sd{i}"
                      for i, c in enumerate(feats))
    zs = ", ".join(f"(CAST(lb.{src[c]} AS DOUBLE) - st.mu{i}) / "
                   f"(CASE WHEN st.sd{i} = 0 OR st.sd{i} IS NULL THEN 1.0 ELSE st.sd{i} END)"
                   for i, c in enumerate(feats))
    return (SQL_MERGE[:cut] + ",\nmg AS (" + SQL_MERGE[cut:].strip() + "),\n"
            + "cal AS (SELECT *, " + ", ".join(f"{e} AS x_{c}" for c, e in cal.items()) + " FROM mg),\n"
            + f"lb AS (SELECT *, lead(close, {HORIZON_ROWS}) OVER (PARTITION BY tic ORDER BY date) AS target, "
            + f"lead(close, {HORIZON_ROWS}) OVER (PARTITION BY tic ORDER BY date) IS NOT NULL AS labelled FROM cal),\n"
            + f"st AS (SELECT tic, {stats} FROM lb GROUP BY tic)\n"
            + f"SELECT lb.tic, lb.date, lb.close, lb.target, lb.labelled, list_transform([CAST(lb.close AS DOUBLE), {zs}], lambda x: round(x, 4)) AS features\n"
            + "FROM lb JOIN st ON lb.tic = st.tic")


@query("ml_05_flagship_features", _flagship_sql(), ("bars_d", "macro_m", "news", "earnings"))
def ml_05_flagship(spark, sf_dir):
    """The flagship feature frame over the whole fixtures (every ticker)."""
    return flagship(spark, sf_dir)


def _model_frame(spark, sf_dir, horizon=30):
    # one row index serves the previous close, the lead target and the positional split
    b = with_index(_fx(spark, sf_dir).bars_d)
    b = pct_change(b, "close", "ret")
    d = FE.lead_target(b, horizon, "close", "target")
    d = B.chrono_split(d).drop(IDX)
    d = FE.add_calendar_features(d)
    # the frame is cut once: fits, stores and scores read the same table
    return materialize(FE.assemble(d.fillna(0.0, ["ret"]), ["close", "ret", "month_sin", "month_cos", "day_of_week_sin"], "features"))


@query("ml_06_fit_per_ticker", None)
def ml_06(spark, sf_dir):
    return M.fit_per_ticker(_model_frame(spark, sf_dir), lam=1.0)


@query("ml_07_grid_search", None)
def ml_07(spark, sf_dir):
    return M.grid_search(_model_frame(spark, sf_dir), [0.1, 1.0, 10.0, 100.0])


def _descent_frame(spark, sf_dir):
    """Standardised close and volume against the standardised close 30 sessions on."""
    b = FE.lead_target(with_index(_fx(spark, sf_dir).bars_d), 30, "close", "target")
    d = B.chrono_split(b).filter(F.col("target").isNotNull()).drop(IDX)
    d = FE.standardise(d.withColumn("_fit", F.col("split") == "train"), ["close", "volume", "target"], fit_mask="_fit")
    return FE.assemble(d, ["close", "volume"], "features")


def _descent_sql(sets: list[tuple]) -> str:
    """Gradient descent over sufficient statistics in a recursive query; a set is (set_id,
    learning_rate, epochs, patience)."""
    values = ", ".join(f"({i}, {lr:.17g}::DOUBLE, {e}, {p})" for i, lr, e, p in sets)
    return f"""
WITH RECURSIVE b0 AS (SELECT tic, date, close, volume, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY tic) AS n,
    lead(close, 30) OVER w AS target FROM bars_d WINDOW w AS (PARTITION BY tic ORDER BY date)),
b1 AS (SELECT *, CASE WHEN j >= floor(n * 0.8) THEN 'test' WHEN j >= floor(floor(n * 0.8) * 0.8) THEN 'val' ELSE 'train' END AS split
       FROM b0 WHERE target IS NOT NULL),
z AS (SELECT tic, avg(close) AS m1, stddev_pop(close) AS s1, avg(volume) AS m2, stddev_pop(volume) AS s2, avg(target) AS m3,
        stddev_pop(target) AS s3 FROM b1 WHERE split = 'train' GROUP BY tic),
r AS (SELECT b1.tic, split, (close - m1) / CASE WHEN coalesce(s1, 0) = 0 THEN 1 ELSE s1 END AS x1,
        (volume - m2) / CASE WHEN coalesce(s2, 0) = 0 THEN 1 ELSE s2 END AS x2, (target - m3) / CASE WHEN coalesce(s3, 0) = 0 THEN 1 ELSE s3 END AS y
      FROM b1 JOIN z ON b1.tic = z.tic),
st AS (SELECT tic, count(*) AS n, sum(x1) / count(*) AS a1, sum(x2) / count(*) AS a2, sum(x1 * x1) / count(*) AS a11, sum(x1 * x2) / count(*) AS a12,
         sum(x2 * x2) / count(*) AS a22, sum(y) / count(*) AS ay, sum(x1 * y) / count(*) AS a1y, sum(x2 * y) / count(*) AS a2y
       FROM r WHERE split = 'train' GROUP BY tic),
ps(set_id, lr, epochs, patience) AS (VALUES {values}),
gd AS (SELECT tic, set_id, 0 AS epoch, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS b FROM st, ps
  UNION ALL
  SELECT gd.tic, gd.set_id, epoch + 1, w1 - lr * (a11 * w1 + a12 * w2 + a1 * b - a1y), w2 - lr * (a12 * w1 + a22 * w2 + a2 * b - a2y),
    b - lr * (a1 * w1 + a2 * w2 + b - ay)
  FROM gd JOIN st ON gd.tic = st.tic JOIN ps ON gd.set_id = ps.set_id WHERE epoch < epochs),
v AS (SELECT gd.tic, set_id, epoch, any_value(w1) AS w1, any_value(w2) AS w2, any_value(b) AS b, avg(abs(w1 * x1 + w2 * x2 + b - y)) AS mae
      FROM gd JOIN r ON gd.tic = r.tic AND r.split = 'val' GROUP BY gd.tic, set_id, epoch),
run AS (SELECT v.tic, v.set_id, v.epoch, v.mae AS best, v.epoch AS be, patience, epochs FROM v JOIN ps ON v.set_id = ps.set_id WHERE v.epoch = 0
  UNION ALL
  SELECT run.tic, run.set_id, run.epoch + 1, CASE WHEN v.mae < best - 1e-6 THEN v.mae ELSE best END,
    CASE WHEN v.mae < best - 1e-6 THEN v.epoch ELSE be END, patience, epochs
  FROM run JOIN v ON run.tic = v.tic AND run.set_id = v.set_id AND v.epoch = run.epoch + 1
  WHERE run.epoch < epochs AND run.epoch - be < patience),
fin AS (SELECT tic, set_id, max(epoch) AS last_epoch, arg_max(be, epoch) AS best_epoch FROM run GROUP BY tic, set_id),
models AS (SELECT fin.tic, fin.set_id, fin.best_epoch, fin.last_epoch, round(v.b, 6) AS intercept, round(v.w1, 6) AS w_close,
         round(v.w2, 6) AS w_volume, round(v.mae, 6) AS val_mae, v.mae AS raw_mae, st.n AS n_train
       FROM fin JOIN v ON fin.tic = v.tic AND fin.set_id = v.set_id AND fin.best_epoch = v.epoch JOIN st ON fin.tic = st.tic)
"""


def _told(models):
    return models.select("tic", "set_id", "best_epoch", "last_epoch", round_half_up("intercept", 6).alias("intercept"),
                         round_half_up(F.col("coef")[0], 6).alias("w_close"), round_half_up(F.col("coef")[1], 6).alias("w_volume"),
                         round_half_up("val_mae", 6).alias("val_mae"), "n_train")


_MODEL_COLUMNS = "tic, set_id, best_epoch, last_epoch, intercept, w_close, w_volume, val_mae, n_train"


@query("ml_06_early_stop", _descent_sql([(0, 0.4, 25, 3)]) + f"SELECT {_MODEL_COLUMNS} FROM models", ("bars_d",))
def ml_06_early_stop(spark, sf_dir):
    """Gradient descent per ticker, stopped 3 epochs after the last improvement of the validation MAE."""
    models, _ = IT.fit_iterative(_descent_frame(spark, sf_dir), [{"learning_rate": 0.4, "epochs": 25, "patience": 3}], 2)
    return _told(models)


@query("ml_06_convergence", _descent_sql([(0, 0.4, 8, 8)]) + """SELECT v.tic, v.set_id, v.epoch, round(v.mae, 6) AS val_mae, v.epoch = run.be AS best
FROM run JOIN v ON run.tic = v.tic AND run.set_id = v.set_id AND run.epoch = v.epoch""", ("bars_d",))
def ml_06_convergence(spark, sf_dir):
    """The convergence table of the fit: the validation MAE of every epoch of every ticker."""
    _, told = IT.fit_iterative(_descent_frame(spark, sf_dir), [{"learning_rate": 0.4, "epochs": 8, "patience": 8}], 2)
    return told.withColumn("val_mae", round_half_up("val_mae", 6))


_GRID = [(0, 0.05, 10, 2), (1, 0.4, 10, 2), (2, 0.4, 10, 6), (3, 0.9, 10, 2)]


@query("ml_07_early_stop_grid", _descent_sql(_GRID) + f"""SELECT {_MODEL_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY tic ORDER BY raw_mae, set_id) AS rk FROM models) m WHERE rk = 1""", ("bars_d",))
def ml_07_early_stop_grid(spark, sf_dir):
    """Learning rates and patiences per ticker at once; the best set by validation MAE."""
    grid = [{"learning_rate": lr, "epochs": e, "patience": p} for _, lr, e, p in _GRID]
    models, _ = IT.fit_iterative(_descent_frame(spark, sf_dir), grid, 2)
    return _told(IT.best_of_grid(models))


@query("ml_08_load_or_fit", None)
def ml_08(spark, sf_dir):
    """A store holding two tickers' models; the other three are fitted and appended."""
    frame = _model_frame(spark, sf_dir)
    store = M.fit_per_ticker(frame.filter(F.col("tic").isin("1-URGENT", "2-HIGH")))
    return M.load_or_fit(frame, store)


@query("ml_09_score", None)
def ml_09(spark, sf_dir):
    frame = _model_frame(spark, sf_dir)
    coefs = M.fit_per_ticker(frame)
    return M.score(frame, coefs).select("tic", "date", "split", "prediction", F.col("target").alias("observed"))


@query("ml_13_evaluate", None)
def ml_13(spark, sf_dir):
    frame = _model_frame(spark, sf_dir)
    p = M.score(frame, M.fit_per_ticker(frame)).withColumnRenamed("target", "observed")
    return M.evaluate(p)


def _ridge_sql(out: str) -> str:
    """Ridge on the standardised close alone, in closed form: slope = Sxy / (Sxx + 1)."""
    cut = _descent_sql([(0, 0.1, 1, 1)]).index("st AS (")
    return _descent_sql([(0, 0.1, 1, 1)])[:cut].replace("WITH RECURSIVE", "WITH").rstrip().rstrip(",") + """,
sx AS (SELECT tic, avg(x1) AS xm, avg(y) AS ym, sum(x1 * x1) - count(*) * avg(x1) ^ 2 AS sxx, sum(x1 * y) - count(*) * avg(x1) * avg(y) AS sxy,
         count(*) AS n FROM r WHERE split = 'train' GROUP BY tic),
co AS (SELECT tic, sxy / (sxx + 1) AS w, ym - xm * sxy / (sxx + 1) AS b, n FROM sx),
pd AS (SELECT r.tic, split, x1, y, w * x1 + b AS p FROM r JOIN co ON r.tic = co.tic)
""" + out


def _one_feature(spark, sf_dir):
    return _descent_frame(spark, sf_dir).withColumn("features", F.slice("features", 1, 1))


@query("ml_06_ridge_one_feature", _ridge_sql("""SELECT co.tic, round(w, 6) AS slope, round(b, 6) AS intercept, n AS n_train, round(v.mae, 6) AS val_mae
FROM co JOIN (SELECT tic, avg(abs(p - y)) AS mae FROM pd WHERE split = 'val' GROUP BY tic) v ON co.tic = v.tic"""), ("bars_d",))
def ml_06_ridge(spark, sf_dir):
    m = M.fit_per_ticker(_one_feature(spark, sf_dir), lam=1.0)
    return m.select("tic", round_half_up(F.col("coef")[0], 6).alias("slope"), round_half_up("intercept", 6).alias("intercept"), "n_train",
                    round_half_up("val_mae", 6).alias("val_mae"))


@query("ml_13_evaluate_fitted", _ridge_sql("""SELECT tic, split, round(avg(abs(p - y)), 6) AS mae, round(avg((p - y) ^ 2), 6) AS mse, count(*) AS n
FROM pd GROUP BY tic, split"""), ("bars_d",))
def ml_13_fitted(spark, sf_dir):
    """Evaluation of the fitted rows per ticker and split."""
    frame = _one_feature(spark, sf_dir)
    e = M.evaluate(M.score(frame, M.fit_per_ticker(frame, lam=1.0)).withColumnRenamed("target", "observed"))
    return e.select("tic", "split", round_half_up("mae", 6).alias("mae"), round_half_up("mse", 6).alias("mse"), "n")


@query("ml_09_score_stored", """SELECT tic, date, round(CASE tic WHEN '1-URGENT' THEN 0.5 * close - 2 * volume + 10
  WHEN '2-HIGH' THEN 1.25 * close + 0.5 * volume - 3 END, 4) AS prediction FROM bars_d""", ("bars_d",))
def ml_09_stored(spark, sf_dir):
    """Scoring by a stored coefficients table that holds two tickers; the others have no prediction."""
    frame = FE.assemble(_fx(spark, sf_dir).bars_d, ["close", "volume"], "features")
    coefs = spark.createDataFrame([("1-URGENT", 10.0, [0.5, -2.0]), ("2-HIGH", -3.0, [1.25, 0.5])], "tic string, intercept double, coef array<double>")
    return M.score(frame, coefs).select("tic", "date", round_half_up("prediction", 4).alias("prediction"))


@query("ml_13_evaluate_naive", """
SELECT tic, split, round(avg(abs(prediction - observed)), 4) AS mae, round(avg((prediction - observed) ^ 2), 2) AS mse, count(*) AS n
FROM (SELECT p.*, CASE WHEN j >= floor(n * 0.8) THEN 'test' WHEN j >= floor(floor(n * 0.8) * 0.8) THEN 'val' ELSE 'train' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY tic ORDER BY date) - 1 AS j, count(*) OVER (PARTITION BY tic) AS n FROM preds) p) x
WHERE prediction IS NOT NULL AND observed IS NOT NULL GROUP BY tic, split""", ("preds",))
def ml_13n(spark, sf_dir):
    """Evaluation per ticker and chronological split of the naive previous-close model."""
    p = B.chrono_split(_fx(spark, sf_dir).preds)
    e = M.evaluate(p)
    return e.select("tic", "split", round_half_up("mae", 4).alias("mae"), round_half_up("mse", 2).alias("mse"), "n")


@query("ml_10_align_predictions", """SELECT tic, date, lead(date, 30) OVER (PARTITION BY tic ORDER BY date) AS target_date,
  date + 30 AS calendar_date FROM bars_d""", ("bars_d",))
def ml_10(spark, sf_dir):
    b = _fx(spark, sf_dir).bars_d.select("tic", "date")
    d = M.align_predictions(b, 30)
    d = M.align_predictions(d, 30, parity=True, out="calendar_date")
    return d.select("tic", "date", "target_date", "calendar_date")


@query("ml_12_timeline", """
SELECT tic, date, split, prediction, coalesce(observed, 0.0) AS observed FROM (
  SELECT tic, date, CASE WHEN date < DATE '1998-01-01' THEN 'train' ELSE 'test' END AS split, prediction, observed FROM preds
  UNION ALL SELECT tic, date + 1, 'new', observed, NULL FROM (SELECT tic, max_by(date, date) AS date, max_by(observed, date) AS observed
    FROM preds GROUP BY tic) l) u""", ("preds",))
def ml_12(spark, sf_dir):
    p = _fx(spark, sf_dir).preds
    hist = p.withColumn("split", F.when(F.col("date") < F.lit("1998-01-01").cast("date"), "train").otherwise("test"))
    last = p.groupBy("tic").agg(F.max_by("observed", "date").alias("prediction"), F.max("date").alias("d"))
    new = last.select("tic", F.date_add("d", 1).alias("date"), F.lit("new").alias("split"), "prediction",
                      F.lit(None).cast("double").alias("observed"))
    return M.timeline(hist.unionByName(new)).select("tic", "date", "split", "prediction", "observed")


def lexicon_sql(body: str) -> str:
    """The word-list score of a text in SQL."""
    def lit(words):
        return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"
    words = (f"list_transform(string_split(trim(regexp_replace({body}, '{WS}', ' ', 'g')), ' '), "
             "lambda w: lower(trim(w, '.,;:!?\"''()')))")
    def hits(words_in):
        return f"len(list_filter({words}, lambda w: w IN {lit(words_in)}))"
    return f"CAST(greatest(1, least(10, 5 + {hits(R.POSITIVE)} - {hits(R.NEGATIVE)})) AS INT)"


@query("ml_14_rate_text", f"""SELECT doc_id, {lexicon_sql('body')} AS rating FROM news
WHERE TRY_CAST(benz_rate AS INT) IS NULL""", ("news",))
def ml_14(spark, sf_dir):
    """Rate the stories that have no usable rating yet (offline word-list scorer)."""
    from tessera.operators.clean import parse_rating
    n = _fx(spark, sf_dir).news
    done = n.filter(parse_rating("benz_rate").isNotNull()).select("doc_id", parse_rating("benz_rate").alias("rating"))
    return R.rate_text(n, done=done)


@query("ml_15_few_shot", """
WITH lab AS (SELECT * FROM embeddings WHERE label IS NOT NULL), q AS (SELECT * FROM embeddings),
el AS (SELECT label, i, CAST(e AS DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS e, unnest(range(len(embedding))) AS i FROM lab) t),
cent AS (SELECT label, list(c ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS c FROM el GROUP BY label, i) a GROUP BY label),
s AS (SELECT q.vec_id, cent.label, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), cent.c) AS cos FROM q CROSS JOIN cent)
SELECT vec_id, CAST(arg_max(label, (cos, -label)) AS INT) AS predicted, round(max(cos), 6) AS similarity FROM s GROUP BY vec_id""")
def ml_15(spark, sf_dir):
    # every embedding is classified against the centroids of every labelled embedding
    e = _fx(spark, sf_dir).embeddings
    r = R.few_shot(e, e.filter(F.col("label").isNotNull()))
    return r.select("vec_id", "predicted", round_half_up("similarity", 6).alias("similarity"))


def _bayes_sql(texts: str, labelled: str, out: str) -> str:
    """Multinomial naive Bayes over TF-IDF; ``texts`` (id, text) are all texts, ``labelled`` (id, label)
    the classes of some."""
    return f"""
WITH dd AS ({texts}), lb AS ({labelled}),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM dd) t GROUP BY id, term),
nn AS (SELECT count(*) AS n FROM lb),
pr AS (SELECT label, count(*) AS c FROM lb GROUP BY label),
lt AS (SELECT lb.label, tf.term, sum(tf) AS tf, count(*) AS df FROM tf JOIN lb ON tf.id = lb.id GROUP BY lb.label, tf.term),
vo AS (SELECT term, ln((1.0 + n) / (1 + sum(df))) + 1 AS idf FROM lt, nn GROUP BY term, n),
cw AS (SELECT label, term, tf * idf AS w FROM lt JOIN vo USING (term)),
ct AS (SELECT label, sum(w) + (SELECT count(*) FROM vo) AS total FROM cw GROUP BY label),
wt AS (SELECT id, term, tf * idf AS w FROM tf JOIN vo USING (term)),
kn AS (SELECT id, sum(w) AS w FROM wt GROUP BY id),
se AS (SELECT id, label, sum(wt.w * ln(cw.w + 1)) AS g FROM wt JOIN cw USING (term) GROUP BY id, label),
sc AS (SELECT dd.id, pr.label, round((ln(pr.c / n) + coalesce(kn.w, 0) * ln(1 / ct.total) + coalesce(se.g, 0)) * 1e6) AS s
       FROM dd CROSS JOIN pr CROSS JOIN nn JOIN ct ON ct.label = pr.label LEFT JOIN kn ON kn.id = dd.id
       LEFT JOIN se ON se.id = dd.id AND se.label = pr.label),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, CAST(label AS VARCHAR)) AS rk FROM sc)
SELECT {out} FROM rk WHERE rk = 1"""


@query("ml_15_text", _bayes_sql("SELECT doc_id AS id, body AS text FROM news",
                                "SELECT doc_id AS id, TRY_CAST(benz_rate AS INT) AS label FROM news WHERE TRY_CAST(benz_rate AS INT) IS NOT NULL AND body IS NOT NULL",
                                "id AS doc_id, label AS predicted, round(s / 1e6, 4) AS score"), ("news",))
def ml_15_text(spark, sf_dir):
    """Classes 1 to 10 of every story from its words, learnt from the rated stories."""
    from tessera.operators.clean import parse_rating
    n = _fx(spark, sf_dir).news.withColumn("label", parse_rating("benz_rate"))
    model = TXC.fit_text(n, "label", "doc_id", "body")
    return TXC.classify_text(n, model, "doc_id", "body").select(F.col("id").alias("doc_id"), "predicted", round_half_up("score", 4).alias("score"))


@query("ml_15_spam", _bayes_sql("SELECT doc_id AS id, text FROM documents",
                                "SELECT DISTINCT l.doc_id AS id, CASE WHEN quality = 0 THEN 'spam' ELSE 'not spam' END AS label FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality IS NOT NULL AND text IS NOT NULL",
                                "id AS doc_id, label AS predicted"))
def ml_15_spam(spark, sf_dir):
    """Spam or not of every text from its words, learnt from the texts with a quality label."""
    fx = _fx(spark, sf_dir)
    marks = fx.labels.filter(F.col("quality").isNotNull()).select(
        "doc_id", F.when(F.col("quality") == 0, "spam").otherwise("not spam").alias("label")).distinct()
    docs = fx.documents.select("doc_id", "text")
    model = TXC.fit_text(docs.join(marks, "doc_id"), "label")
    return TXC.classify_text(docs, model).select(F.col("id").alias("doc_id"), "predicted")


@query("win_11_turbulence", None)
def win_11(spark, sf_dir):
    r = pct_change(_fx(spark, sf_dir).bars_x, "close", "ret")
    return turbulence(r, lookback=252)


@query("win_11_turbulence_pair", """
WITH dd AS (SELECT DISTINCT date FROM bars_x WHERE tic IN ('Brand#11', 'Brand#12')),
gx AS (SELECT t.tic, dd.date FROM (VALUES ('Brand#11'), ('Brand#12')) t(tic) CROSS JOIN dd),
fl AS (SELECT gx.tic, gx.date, last_value(b.close IGNORE NULLS) OVER (PARTITION BY gx.tic ORDER BY gx.date
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM gx LEFT JOIN bars_x b ON b.tic = gx.tic AND b.date = gx.date),
rt AS (SELECT tic, date, close / lag(close) OVER (PARTITION BY tic ORDER BY date) - 1 AS ret FROM fl),
wd AS (SELECT date, max(ret) FILTER (WHERE tic = 'Brand#11') AS a, max(ret) FILTER (WHERE tic = 'Brand#12') AS b FROM rt GROUP BY date),
hh AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, a, b, avg(a) OVER w AS ma, avg(b) OVER w AS mb, var_samp(a) OVER w AS va,
         var_samp(b) OVER w AS vb, covar_samp(a, b) OVER w AS vab, count(a) OVER w AS na, count(b) OVER w AS nb FROM wd
       WINDOW w AS (ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
tb AS (SELECT date, p, CASE WHEN p < 252 THEN 0.0
         WHEN na = nb THEN (vb * (a - ma) ^ 2 - 2 * vab * (a - ma) * (b - mb) + va * (b - mb) ^ 2) / (va * vb - vab ^ 2)
         WHEN na > nb THEN (a - ma) ^ 2 / va ELSE (b - mb) ^ 2 / vb END AS v FROM hh)
SELECT date, round(CASE WHEN v > 0 AND sum(CAST(v > 0 AS INT)) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) > 2 THEN v ELSE 0.0 END, 6) AS turbulence
FROM tb""", ("bars_x",))
def win_11_pair(spark, sf_dir):
    """Turbulence of two tickers, whose inverse covariance has a closed form; closes filled forward."""
    x = _fx(spark, sf_dir).bars_x.filter(F.col("tic").isin("Brand#11", "Brand#12")).select("tic", "date", "close")
    grid = x.select("date").distinct().withColumn("tic", F.explode(F.array(F.lit("Brand#11"), F.lit("Brand#12"))))
    r = pct_change(ffill(grid.join(x, ["tic", "date"], "left"), ["close"]), "close", "ret")
    return turbulence(r, lookback=252).withColumn("turbulence", round_half_up("turbulence", 6))


# ---- text plans ----------------------------------------------------------------------------

@query("pipe_08_news_batch", f"""
SELECT doc_id, tic, created, title, body FROM (
  SELECT *, row_number() OVER (PARTITION BY created, title ORDER BY created, doc_id) AS rk FROM (
    SELECT *, row_number() OVER (PARTITION BY tic, title ORDER BY created, doc_id) AS rt FROM (
      SELECT doc_id, tic, created, replace(title, '"', '') AS title, {TX.html_text_sql('body')} AS body FROM news) c) x
  WHERE rt = 1) y WHERE rk = 1""", ("news",))
def pipe_08(spark, sf_dir):
    from tessera.plans.textplans import news_batch
    return news_batch(_fx(spark, sf_dir).news)


@query("pipe_09_clean_ratings", """
SELECT doc_id, tic, created, CASE WHEN length(r1) <= 4 THEN r1 END AS benz_rate
FROM (SELECT doc_id, tic, created, CASE WHEN NOT coalesce(contains(benz_rate, 'AI language model'), false) THEN benz_rate END AS r1
      FROM news) n""", ("news",))
def pipe_09(spark, sf_dir):
    from tessera.plans.textplans import clean_ratings
    return clean_ratings(_fx(spark, sf_dir).news.select("doc_id", "tic", "created", "benz_rate"))


@query("pipe_10_transcripts", """
SELECT v.video_id, v.title, v.created, t.body FROM
  (SELECT doc_id AS video_id, text AS title, DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS created FROM documents
   WHERE DATE '2024-01-01' + CAST(doc_id % 60 AS INT) BETWEEN DATE '2024-01-10' AND DATE '2024-02-20') v
LEFT JOIN (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS body FROM conversations GROUP BY conv_id) t
  ON v.video_id = t.conv_id""")
def pipe_10(spark, sf_dir):
    from tessera.plans.textplans import transcripts
    fx = _fx(spark, sf_dir)
    videos = fx.documents.select(F.col("doc_id").alias("video_id"), F.col("text").alias("title"),
                                 F.date_format(F.date_add(F.lit("2024-01-01").cast("date"),
                                                          (F.col("doc_id") % 60).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
                                 .alias("publishedAt"))
    return transcripts(videos, fx.conversations, "2024-01-10", "2024-02-20")


@query("pipe_11_latest_snapshot", """
WITH m AS (SELECT event_type AS tic, date_trunc('minute', ts) AS ts, max_by(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2),
lim AS (SELECT max(ts) AS hi FROM m),
g AS (SELECT unnest(generate_series((SELECT hi FROM lim) - INTERVAL 119 MINUTE, (SELECT hi FROM lim), INTERVAL 1 MINUTE)) AS ts),
s AS (SELECT k.tic, g.ts, m.close FROM (SELECT DISTINCT tic FROM m) k CROSS JOIN g LEFT JOIN m ON m.tic = k.tic AND m.ts = g.ts),
f AS (SELECT tic, ts, coalesce(close, last_value(close IGNORE NULLS) OVER (PARTITION BY tic ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(close IGNORE NULLS) OVER (PARTITION BY tic ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS close FROM s),
i AS (SELECT tic, ts, close, avg(close) OVER (PARTITION BY tic ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma20,
        row_number() OVER (PARTITION BY tic ORDER BY ts DESC) AS rk FROM f)
SELECT tic, ts, close, round(ma20, 6) AS ma20 FROM i WHERE rk = 1""")
def pipe_11(spark, sf_dir):
    from tessera.plans.textplans import latest_snapshot
    ev = _fx(spark, sf_dir).events
    ticks = ev.select(F.col("event_type").alias("tic"), "ts", F.col("value").alias("close"), "event_id")
    s = latest_snapshot(ticks, minutes=120, ma=20)
    return s.select("tic", "ts", "close", round_half_up("ma20", 6).alias("ma20"))

"""Model queries: ridge, stacking, screening, MLlib learners, regime states, residual signals."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from quantloom.functions.columns import by, div
from quantloom.functions.rolling import rolling
from quantloom.operators import features as ft
from quantloom.operators import learners as ln
from quantloom.operators import metrics as mt
from quantloom.operators import models as ml
from quantloom.operators import signals as sg
from quantloom.operators import splits as sp
from quantloom.operators.residuals import residual_z
from quantloom.plans.queries_backtest import smooth
from quantloom.plans.queries_signals import universe_bars
from quantloom.plans.registry import query
from quantloom.plans.sqltext import lr, windows
from quantloom.plans.views import bars, scored, sectors, table
from quantloom.session import durable
from quantloom.streaming.record import run_available, source, work_folder

ROWS_SQL = f"""rw AS (SELECT symbol, date, close / open - 1 AS x1, volume / 25 AS x2, lead(close) OVER wk / close - 1 AS y FROM bars {windows()}), rr AS (SELECT * FROM rw WHERE y IS NOT NULL),
dt AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM rr)), k AS (SELECT greatest(CAST(ceil((n - 500 - 250) / 250) AS BIGINT), 0) + 1 AS folds FROM dt LIMIT 1),
fd AS (SELECT date, CAST(fold AS INTEGER) AS fold, CASE WHEN idx < 500 + fold * 250 THEN 'train' ELSE 'test' END AS role FROM dt, k, (SELECT unnest(range(0, 100)) AS fold) WHERE fold < folds AND idx < 500 + fold * 250 + 250)"""


def model_rows(spark, sf):
    d = bars(spark, sf).select("symbol", "date", (F.col("close") / F.col("open") - 1).alias("x1"), (F.col("volume") / 25).alias("x2"), (div(F.lead("close").over(by()), "close") - 1).alias("y"))
    return d.filter("y IS NOT NULL")


def model_folds(rows):
    return sp.walk_forward(rows, 500, 250, 250)


# closed form of the standardised two-feature ridge with alpha 1
RIDGE_SQL = f"""{ROWS_SQL}, m AS (SELECT fold, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM rr JOIN fd USING (date) WHERE role = 'train' GROUP BY fold),
z AS (SELECT *, n + 1.0 AS a, n * c12 / (s1 * s2) AS b, n * c1 / s1 AS p, n * c2 / s2 AS q FROM m), w AS (SELECT fold, (p * a - q * b) / (a * a - b * b) / s1 AS w1, (q * a - p * b) / (a * a - b * b) / s2 AS w2, m1, m2, my FROM z),
pr AS (SELECT symbol, rr.date, fd.fold, y, my + w1 * (x1 - m1) + w2 * (x2 - m2) AS prediction FROM rr JOIN fd ON rr.date = fd.date AND role = 'test' JOIN w ON w.fold = fd.fold)"""


@query("ML1 ML6 CV5 MT7", f"WITH @bars, {RIDGE_SQL} SELECT symbol, date, fold, prediction, y FROM pr", "prediction y")
def ridge_walk_forward(spark, sf):
    rows = model_rows(spark, sf)
    return ml.ridge_walk_forward(rows, model_folds(rows), ["x1", "x2"], "y").select("symbol", "date", "fold", "prediction", "y")


@query("ML6 MT4 SRC24", f"WITH @bars, {RIDGE_SQL} SELECT fold, count(*) AS rows, 1 - sum((y - prediction) ** 2) / sum(y * y) AS r2, corr(y, prediction) AS ic, avg(CASE WHEN (y > 0) = (prediction > 0) THEN 1.0 ELSE 0 END) AS accuracy FROM pr GROUP BY fold", "r2 ic accuracy")
def holdout_evaluation(spark, sf):
    rows = model_rows(spark, sf)
    p = ml.ridge_walk_forward(rows, model_folds(rows), ["x1", "x2"], "y")
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), mt.zero_mean_r2("y", "prediction").alias("r2"), mt.safe_corr("y", "prediction").alias("ic"), mt.directional_accuracy("y", "prediction").alias("accuracy"))


@query("ML5 ML6", """WITH @scored, s AS (SELECT y, pred AS a, y * 0.5 + pred * 0.1 AS b FROM scored), g AS (SELECT sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM s), w AS (SELECT CASE WHEN (ay * bb - by_ * ab) > 0 AND (by_ * aa - ay * ab) > 0 THEN (ay * bb - by_ * ab) / (aa * bb - ab * ab) WHEN by_ * by_ / bb >= ay * ay / aa THEN 0 ELSE ay / aa END AS wa,
 CASE WHEN (ay * bb - by_ * ab) > 0 AND (by_ * aa - ay * ab) > 0 THEN (by_ * aa - ay * ab) / (aa * bb - ab * ab) WHEN by_ * by_ / bb >= ay * ay / aa THEN by_ / bb ELSE 0 END AS wb FROM g), n AS (SELECT wa / (wa + wb) AS wa, wb / (wa + wb) AS wb FROM w), e AS (SELECT y, wa * a + wb * b AS p FROM s, n)
SELECT count(*) AS rows, avg(p) AS mean_stacked, 1 - sum((y - p) ** 2) / sum(y * y) AS r2, avg(abs(p) / (abs(p) + (SELECT sqrt(avg((y - p) ** 2)) FROM e))) AS mean_confidence FROM e""", "mean_stacked r2 mean_confidence")
def stacked_models(spark, sf):
    d = scored(spark, sf).select("y", F.col("pred").alias("a"), (F.col("y") * 0.5 + F.col("pred") * 0.1).alias("b"), "w")
    assert "b" in ml.active_models(d, ["a", "b"], "y", "w")
    s = ml.stacked(d, ml.stack_weights(d, ["a", "b"], "y"))
    return s.agg(F.count(F.lit(1)).alias("rows"), F.avg("stacked").alias("mean_stacked"), mt.zero_mean_r2("y", "stacked").alias("r2"), F.avg("confidence").alias("mean_confidence"))


@query("ML7", """WITH t AS (SELECT l_extendedprice, l_quantity, l_discount, CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' THEN 1 ELSE 0 END AS h FROM lineitem), u AS (SELECT 'price' AS feature, l_extendedprice AS x, h FROM t UNION ALL SELECT 'quantity', l_quantity, h FROM t UNION ALL SELECT 'discount', l_discount, h FROM t),
r AS (SELECT feature, h, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS r FROM u), s AS (SELECT feature, (sum(CASE WHEN h = 1 THEN r ELSE 0 END) - sum(h) * (sum(h) + 1) / 2.0) / (CAST(sum(h) AS DOUBLE) * (count(*) - sum(h))) AS auc FROM r GROUP BY feature)
SELECT feature, greatest(auc, 1 - auc) AS auc, greatest(auc, 1 - auc) >= 0.6 AS "drop" FROM s""", "auc")
def adversarial_auc(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
                                            (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).cast("int").alias("holdout"))
    return ml.univariate_auc(d, ["price", "quantity", "discount"], "holdout")


def learner_rows(spark, sf):
    """Monthly universe rows for the tree learners: features known at the date, next return as target."""
    b = universe_bars(spark, sf)
    d = ft.volatility(ft.returns_momentum(b, (1, 5, 20), ()), windows=(20,)).withColumn("y", div(F.lead("close").over(by()), "close") - 1)
    return d.select("symbol", "date", "log_return_1", "log_return_5", "log_return_20", "realized_vol_20", "y").dropna()


FEATS = ["log_return_1", "log_return_5", "log_return_20", "realized_vol_20"]


@query("ML2")
def linear_grid(spark, sf):
    rows = learner_rows(spark, sf)
    folds = sp.walk_forward(rows, 1000, 500, 500)
    learners = {"elastic_net": ml.linear_model("elastic_net", "y"), "huber": ml.linear_model("huber", "y"), "sgd_huber": ln.HuberSGD("y")}
    out = None
    for kind, learner in learners.items():
        p = ml.walk_forward_model(rows, folds, FEATS, learner)
        m = p.groupBy("fold").agg(F.lit(kind).alias("model"), F.count(F.lit(1)).alias("rows"), mt.safe_corr("y", "prediction").alias("ic"))
        out = m if out is None else out.unionByName(m)
    return out


@query("ML3")
def boosted_trees(spark, sf):
    rows = learner_rows(spark, sf)
    folds = sp.walk_forward(rows, 1000, 500, 500)
    p = ml.walk_forward_model(rows, folds, FEATS, ln.StoppedTrees("y", rounds=500))  # at most the published 500 rounds, the newest tenth of the train rows decides
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), mt.safe_corr("y", "prediction").alias("ic"))


@query("ML4 SG32 JN18")
def meta_labels(spark, sf):
    d = ft.meta_label_features(universe_bars(spark, sf))
    d = sg.triple_barrier(d).dropna(subset=["triple_barrier_label", "realized_vol_20", "volume_z_20", "log_return_lookback"])
    feats = ["log_return_1", "log_return_5", "log_return_lookback", "realized_vol_20", "volume_z_20"]
    folds = sp.walk_forward(d, 1000, 500, 500)
    p = ml.walk_forward_model(d, folds, feats, ml.forest_classifier("triple_barrier_label", trees=200), probability=True)
    take = F.col("probability_1") >= 0.5
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.count_if(take).alias("taken"), F.avg("triple_barrier_label").alias("base_rate"), F.avg(F.when(take, F.col("triple_barrier_label"))).alias("taken_rate"))


@query("ML8 ML11 MT10")
def surrogate_classifier(spark, sf):
    from quantloom.functions.noise import gaussian
    d = learner_rows(spark, sf).withColumn("noise", gaussian("date", "symbol", seed=5)).withColumn("label", F.when(F.col("y") < -0.02, 0).when(F.col("y") > 0.02, 2).otherwise(1))
    feats = [*FEATS, "noise"]
    x = ml.assembler(feats).transform(durable(ml.clean(d, feats)))
    cut = F.lit("2000-01-01").cast("date")
    model = ln.StoppedClasses("label", 3).fit(x.filter(F.col("date") < cut))
    weak = ml.below_noise_floor(list(zip(feats, model.importances().tolist())))
    return mt.class_metrics(model.transform(x.filter(F.col("date") >= cut)), "label", "prediction", 3).withColumn("n_below_noise", F.lit(len(weak)))


@query("ML10 ML3")
def stored_model(spark, sf):
    """Final refits on all rows, stored, read back and applied to the table and to a stream of it; ``differing`` counts rows that do not equal the model in memory."""
    rows = durable(learner_rows(spark, sf))
    landed = work_folder(spark, "rows")
    rows.write.parquet(landed)
    stages = {"elastic_net": ml.linear_model("elastic_net", "y"), "boosted_trees": ln.StoppedTrees("y", rounds=500)}
    out = None
    for kind, learner in stages.items():
        fitted = learner.fit(ml.assembler(FEATS).transform(ml.clean(rows, FEATS)))
        model, path = PipelineModel([ml.assembler(FEATS), fitted]), work_folder(spark, "model")
        ln.save_artifact(model, path, FEATS, "y", spark)
        key = ["symbol", "date"]
        want = ml.score_frame(ml.clean(rows, FEATS), model).select(*key, F.col("prediction").alias("memory"))
        streamed = run_available(ln.score_stored(source(spark, f"{landed}/*.parquet"), path).select(*key, "prediction"), "scores")
        got = ln.score_stored(rows, path).select(*key, "prediction", "signal_side").join(streamed.withColumnRenamed("prediction", "streamed"), key, "full").join(want, key, "full")
        same = F.col("prediction").eqNullSafe(F.col("memory")) & F.col("streamed").eqNullSafe(F.col("memory"))
        m = got.agg(F.lit(kind).alias("model"), F.count(F.lit(1)).alias("rows"), F.count_if(~same).alias("differing"), F.count_if(F.col("signal_side") > 0).alias("n_long"))
        out = m if out is None else out.unionByName(m)
    return out


@query("ML9 WN29")
def regime_states(spark, sf):
    d = ft.index_state_features(universe_bars(spark, sf))
    s = ml.regime_states(d, ["log_return", "realized_vol_21"], ["symbol"], states=(2, 3))
    return ml.state_stability(s, ["symbol"])


@query("SG24 SG25 UD4")
def residual_signals(spark, sf):
    z = residual_z(smooth(spark, sf), sectors(spark, sf), window=30, components=2)
    return sg.residual_state(z.select("symbol", "date", "residual_z")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("position") != 0).alias("n_active"), F.avg("residual_z").alias("mean_z"))

"""Queries over time series, streams, graphs, models and facts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.functions.tables import shared_folder
from tallyloom.operators import facts as FA
from tallyloom.operators import graph as G
from tallyloom.operators import models as ML
from tallyloom.operators import profile as P
from tallyloom.operators import timeseries as T
from tallyloom.plans.profiling import outlier_sql, profile_sql, rounded
from tallyloom.plans.registry import ORACLE_SQL, query
from tallyloom.session import table
from tallyloom.streaming import events as Z

DAILY = "SELECT event_type AS entity, CAST(date_trunc('day', ts) AS TIMESTAMP) AS date, avg(value) AS value FROM events GROUP BY 1, 2"
WHOLE = "SELECT '' AS entity, CAST(date_trunc('day', ts) AS TIMESTAMP) AS date, avg(value) AS value FROM events GROUP BY 1, 2"


def daily(s, d, entity="event_type"):
    return T.series(table(s, d, "events"), "ts", "value", entity)


@query("t02_daily_series", f"SELECT entity, date, round(value, 6) AS value FROM ({DAILY})")
def _(s, d):
    return rounded(daily(s, d))


@query("w01_rolling", f"SELECT entity, date, round(value, 6) AS value, round(avg(value) OVER w, 6) AS rolling_mean, round(stddev_samp(value) OVER w, 6) AS rolling_std FROM ({DAILY}) WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def _(s, d):
    return rounded(T.rolling(daily(s, d)))


@query("w02_smooth", f"SELECT entity, date, round(value, 6) AS value, round(avg(value) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM ({DAILY})")
def _(s, d):
    return rounded(T.smooth(daily(s, d)))


@query("w03_recent", f"SELECT entity, round(avg(value) FILTER (r <= 7), 6) AS recent, round(avg(value) FILTER (r > 7), 6) AS earlier FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r FROM ({DAILY})) GROUP BY 1")
def _(s, d):
    return rounded(T.recent_against_earlier(daily(s, d)))


@query("w04_turns", f"SELECT entity, date, round(value, 6) AS value, CASE WHEN b > 1 AND a > 1 THEN 'peak' ELSE 'valley' END AS turn FROM (SELECT *, value - lag(value) OVER w AS b, value - lead(value) OVER w AS a FROM ({DAILY}) WINDOW w AS (PARTITION BY entity ORDER BY date)) WHERE (b > 1 AND a > 1) OR (b < -1 AND a < -1)")
def _(s, d):
    return rounded(T.turns(daily(s, d), 1.0))


@query("w05_spikes", f"SELECT entity, date, round(value, 6) AS value, round(m, 6) AS mean FROM (SELECT *, avg(value) OVER (PARTITION BY entity) AS m, coalesce(lag(value) OVER w, 0) AS b, coalesce(lead(value) OVER w, 0) AS a FROM ({DAILY}) WINDOW w AS (PARTITION BY entity ORDER BY date)) WHERE value > 1.1 * m AND b <= 1.05 * m AND a <= 1.05 * m")
def _(s, d):
    return rounded(T.spikes(daily(s, d), 1.1, 1.05))


@query("w06_autocorrelation", f"SELECT entity, round(corr(value, p), 6) AS r, count(p) AS n FROM (SELECT *, lag(value, 2) OVER (PARTITION BY entity ORDER BY date) AS p FROM ({DAILY})) GROUP BY 1")
def _(s, d):
    return rounded(T.autocorrelation(daily(s, d), 2))


@query("w08_chains", "SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS chain FROM (SELECT *, coalesce((ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 120 MINUTE)::INT, 0) AS new FROM events)")
def _(s, d):
    return T.chains(table(s, d, "events"), "user_id", "ts", "INTERVAL 120 MINUTES").select("event_id", F.col("chain").cast("long").alias("chain"))


STEP = f"SELECT entity, avg(step) FILTER (r <= 7) AS drift, max_by(value, date) AS last, count(*) AS n FROM (SELECT *, value - lag(value) OVER (PARTITION BY entity ORDER BY date) AS step, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r FROM ({DAILY})) GROUP BY 1"


@query("w09_recent_drift", f"SELECT entity, round(drift, 6) AS drift, round(last, 6) AS last, n FROM ({STEP})")
def _(s, d):
    return rounded(T.recent_drift(daily(s, d)).drop("last_date"))


@query("t07_drift_forecast", f"SELECT entity, CASE WHEN drift > 0 THEN 'up' WHEN drift < 0 THEN 'down' ELSE 'flat' END AS direction, CASE WHEN abs(drift / last) > 0.05 THEN 'strong' WHEN abs(drift / last) > 0.01 THEN 'moderate' ELSE 'weak' END AS strength, CAST(k AS BIGINT) AS k, round(last + k * drift, 6) AS forecast FROM ({STEP}), (SELECT unnest(range(1, 13)) AS k) WHERE n >= 20")
def _(s, d):
    return rounded(T.drift_forecast(daily(s, d), least=20))


@query("w10_last_points", f"SELECT entity, date, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r FROM ({DAILY})) WHERE r <= 10")
def _(s, d):
    return rounded(T.last_points(daily(s, d), 10))


@query("a29_series_stats", f"SELECT entity, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(max_by(value, date), 6) AS last FROM ({DAILY}) GROUP BY 1")
def _(s, d):
    return rounded(T.stats(daily(s, d)))


for _u in ("day", "week", "month", "quarter", "year"):
    query(f"t09_counts_{_u}", f"SELECT CAST(date_trunc('{_u}', o_orderdate) AS TIMESTAMP) AS period, count(*) AS n FROM orders GROUP BY 1")(lambda s, d, u=_u: T.period_counts(table(s, d, "orders"), "o_orderdate", u))

for _p, _e in (("weekday", "isodow(o_orderdate) - 1"), ("month", "month(o_orderdate)")):
    query(f"t10_seasonal_{_p}", f"SELECT CAST({_e} AS BIGINT) AS bucket, count(*) AS n, round(count(*) / avg(count(*)) OVER () - 1, 6) AS deviation, abs(count(*) / avg(count(*)) OVER () - 1) > 0.3 AS strong FROM orders GROUP BY 1")(lambda s, d, p=_p: rounded(T.seasonal(table(s, d, "orders"), "o_orderdate", p)))


@query("t11_trend_line", f"SELECT entity, round(regr_slope(value, x), 6) AS slope, round(regr_intercept(value, x), 6) AS intercept, round(regr_r2(value, x), 6) AS r2, round(avg(value), 6) AS mean, count(*) AS n, CASE WHEN regr_slope(value, x) > 0.05 * avg(value) THEN 'up' WHEN regr_slope(value, x) < -0.05 * avg(value) THEN 'down' ELSE 'flat' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) - 1 AS x FROM ({DAILY})) GROUP BY 1")
def _(s, d):
    return rounded(T.trend_line(daily(s, d)))


@query("t12_count_anomalies", "WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT avg(n) AS a, stddev_pop(n) AS s FROM c) SELECT period, n, round((n - a) / s, 6) AS z FROM c, m WHERE abs((n - a) / s) > 2")
def _(s, d):
    return rounded(T.count_anomalies(T.period_counts(table(s, d, "orders"), "o_orderdate", "month")))


@query("t08_anomalous_dates", "WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) SELECT CAST(ts AS DATE) AS date, count(*) AS n_outliers FROM events, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(s, d):
    return T.anomalous_dates(table(s, d, "events"), "ts", ["value"])


@query("t01_grouping")
def _(s, d):
    return rounded(T.grouping(table(s, d, "events"), "ts", ["event_type", "user_id"]))


@query("t04_ljung_box", f"""WITH s AS (SELECT entity, value - avg(value) OVER (PARTITION BY entity) AS x, row_number() OVER (PARTITION BY entity ORDER BY date) AS i, count(*) OVER (PARTITION BY entity) AS n FROM ({DAILY})),
r AS (SELECT a.entity, max(a.n) AS n, b.i - a.i AS k, sum(a.x * b.x) AS c FROM s a JOIN s b ON a.entity = b.entity AND b.i - a.i BETWEEN 0 AND least(20, greatest(floor(a.n / 5), 1)) GROUP BY 1, 3),
z AS (SELECT entity, c AS c0 FROM r WHERE k = 0) SELECT entity, CAST(max(n) AS BIGINT) AS n, CAST(max(k) AS BIGINT) AS h, round(max(n) * (max(n) + 2) * sum(c / c0 * c / c0 / (n - k)), 6) AS q FROM r JOIN z USING (entity) WHERE k > 0 GROUP BY 1""")
def _(s, d):
    return rounded(T.ljung_box(daily(s, d)))


@query("t03_diagnose")
def _(s, d):
    return rounded(T.diagnose(daily(s, d)))


@query("t06_verdict", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r, lag(value) OVER (PARTITION BY entity ORDER BY date) AS p FROM ({DAILY})),
c AS (SELECT entity, coalesce(abs(avg(value) FILTER (r <= 7) / avg(value) FILTER (r > 7) - 1) < 0.02, false) AS stationary, coalesce(abs(corr(value, p)) > 0.1, false) AS correlated FROM r GROUP BY 1)
SELECT entity, stationary, correlated, CASE WHEN stationary AND correlated THEN 'model directly' WHEN stationary THEN 'white noise' WHEN correlated THEN 'difference first' ELSE 'no structure' END AS verdict FROM c""")
def _(s, d):
    """Series whose last week keeps the level, and whose neighbouring days go together."""
    level = T.recent_against_earlier(daily(s, d)).select("entity", F.coalesce(F.abs(F.col("recent") / F.col("earlier") - 1) < 0.02, F.lit(False)).alias("stationary"))
    both = level.join(T.autocorrelation(daily(s, d), 1).select("entity", F.coalesce(F.abs("r") > 0.1, F.lit(False)).alias("correlated")), "entity")
    return both.withColumn("verdict", T.verdict(F.col("stationary"), F.col("correlated")))


@query("t14_arima_forecast")
def _(s, d):
    return rounded(T.arima_forecast(daily(s, d)))


# ---- streams


def stream(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("z01_stream_daily", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, count(value) AS n_value, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(s, d):
    return rounded(Z.run_to_memory(Z.daily(stream(s, d)), f"daily_{uuid.uuid4().hex}"), 4)


@query("z02_stream_sliding", "SELECT CAST(day AS TIMESTAMP) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events, (SELECT unnest(range(TIMESTAMP '2023-12-01', TIMESTAMP '2024-03-01', INTERVAL 1 DAY)) AS day) WHERE ts >= day AND ts < day + INTERVAL 7 DAY GROUP BY 1")
def _(s, d):
    return rounded(Z.run_to_memory(Z.sliding_mean(stream(s, d)), f"sliding_{uuid.uuid4().hex}"))


@query("z03_stream_sessions", "SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM (SELECT *, coalesce((ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE)::INT, 1) AS new FROM events)) GROUP BY user_id, c")
def _(s, d):
    return Z.run_to_files(Z.sessions(stream(s, d)), f"{shared_folder(s)}/sessions-{uuid.uuid4().hex}", "complete")


@query("z04_stream_alerts", "SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE NOT (value < 100)")
def _(s, d):
    return rounded(Z.run_to_memory(Z.alerts(stream(s, d), "value < 100", ["event_id", "user_id", "value"]), f"alerts_{uuid.uuid4().hex}", "append"))


@query("z05_stream_once", "SELECT event_id, user_id FROM events")
def _(s, d):
    return Z.run_to_files(Z.once(stream(s, d)).select("event_id", "user_id"), f"{shared_folder(s)}/once-{uuid.uuid4().hex}")


# ---- graphs: customers' nations as vertices, trade between nations as edges

TRADE = "SELECT c_nationkey AS src, s_nationkey AS dst, count(*) * 1.0 AS weight FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"


def trade(s, d):
    line = table(s, d, "lineitem")
    out = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(line, F.col("o_orderkey") == F.col("l_orderkey")).join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return out.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


BOTH = f"SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM ({TRADE}) UNION ALL SELECT dst, src, weight FROM ({TRADE})) WHERE src <> dst GROUP BY 1, 2"


@query("g01_undirected", f"SELECT CAST(src AS INT) AS src, CAST(dst AS INT) AS dst, CAST(weight AS DOUBLE) AS weight FROM ({BOTH})")
def _(s, d):
    return G.undirected(trade(s, d))


@query("g06_neighbours", f"SELECT CAST(dst AS INT) AS id, CAST(weight AS DOUBLE) AS weight FROM ({BOTH}) WHERE src = 3")
def _(s, d):
    return G.neighbours(trade(s, d), 3)


SAME = "SELECT p_partkey AS src, p_partkey + 1000 + 100000 * p_size AS dst FROM part UNION ALL SELECT p_partkey, p_partkey + p_size FROM part"


@query("g05_components", f"WITH RECURSIVE e AS (SELECT src, dst FROM ({SAME}) UNION SELECT dst, src FROM ({SAME})), r(id, seen) AS (SELECT src, src FROM e UNION SELECT r.id, e.dst FROM r JOIN e ON r.seen = e.src) SELECT id, min(seen) AS component FROM r GROUP BY 1")
def _(s, d):
    p = table(s, d, "part")
    e = p.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1000 + 100000 * F.col("p_size")).alias("dst")).unionByName(p.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size")).alias("dst")))
    return G.components(e)


@query("g02_pagerank")
def _(s, d):
    return rounded(G.pagerank(trade(s, d)))


@query("g03_betweenness")
def _(s, d):
    return rounded(G.betweenness(trade(s, d)))


@query("g04_communities")
def _(s, d):
    return G.communities(trade(s, d))


@query("g07_chains", "SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS chain FROM (SELECT *, coalesce((day - lag(day) OVER (PARTITION BY user_id ORDER BY day) > 2)::INT, 0) AS new FROM (SELECT event_id, user_id, CAST(day(ts) AS INT) AS day FROM events))")
def _(s, d):
    e = table(s, d, "events").select("event_id", "user_id", F.dayofmonth("ts").alias("day"))
    return G.chains(e, "user_id", "day").select("event_id", F.col("chain").cast("long").alias("chain"))


@query("g08_merge_entities", "SELECT lower(p_name) AS key, min(p_name) AS name, 'part' AS kind, count(DISTINCT p_brand) AS n FROM part GROUP BY 1")
def _(s, d):
    p = table(s, d, "part").select(F.col("p_name").alias("name"), F.lit("part").alias("kind"), F.lit("brand").alias("attribute"), F.col("p_brand").alias("value"), F.lit(None).cast("string").alias("time"))
    none = s.createDataFrame([], "src string, dst string, predicate string, confidence double")
    return G.merge_entities(p, none)[0].select("key", "name", "kind", F.size("attributes").cast("long").alias("n"))


@query("x45_hierarchy", """WITH t AS (SELECT 'r' || r_regionkey AS id, 'r' || r_regionkey AS path, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey || '/n' || n_nationkey, 1 FROM nation
UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT id, path, CAST(depth AS INTEGER) AS depth FROM t""")
def _(s, d):
    """Customers under nations under regions."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    t = table(s, d, "region").select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    t = t.unionByName(table(s, d, "nation").select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent")))
    t = t.unionByName(table(s, d, "customer").select(name("c", "c_custkey").alias("id"), name("n", "c_nationkey").alias("parent")))
    return G.hierarchy(t).select("id", F.array_join("path", "/").alias("path"), "depth")


# ---- models

FEATURES = ["l_quantity", "l_discount", "l_tax"]
PRED = "SELECT l_returnflag AS y, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS p, l_extendedprice AS v, l_quantity * 1500.0 AS w FROM lineitem"


def predicted(s, d):
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R").alias("p"), F.col("l_extendedprice").alias("v"), (F.col("l_quantity") * 1500.0).alias("w"))


@query("m08_classification_metrics", f"""WITH c AS (SELECT DISTINCT y AS c FROM ({PRED})), b AS (SELECT c, (SELECT count(*) FROM ({PRED}) WHERE y = c) AS ny, (SELECT count(*) FROM ({PRED}) WHERE p = c) AS np, (SELECT count(*) FROM ({PRED}) WHERE p = c AND y = c) AS tp FROM c),
m AS (SELECT *, tp * 1.0 / np AS pr, tp * 1.0 / ny AS re FROM b) SELECT round(sum(tp) * 1.0 / sum(ny), 6) AS accuracy, round(sum(pr * ny) / sum(ny), 6) AS precision, round(sum(re * ny) / sum(ny), 6) AS recall, round(sum(2 * pr * re / (pr + re) * ny) / sum(ny), 6) AS f1 FROM m""")
def _(s, d):
    return rounded(ML.classification_metrics(predicted(s, d), "y", "p"))


@query("m08_confusion", f"SELECT y AS label, p AS prediction, count(*) AS n FROM ({PRED}) GROUP BY 1, 2")
def _(s, d):
    return ML.confusion(predicted(s, d), "y", "p")


@query("m09_regression_metrics", f"SELECT round(avg((v - w) * (v - w)), 2) AS mse, round(sqrt(avg((v - w) * (v - w))), 2) AS rmse, round(avg(abs(v - w)), 2) AS mae, round(1 - sum((v - w) * (v - w)) / (var_pop(v) * count(*)), 2) AS r2, round(1 - var_pop(v - w) / var_pop(v), 2) AS explained_variance, round(avg(abs((v - w) / v)) FILTER (v <> 0) * 100, 2) AS mape FROM ({PRED})")
def _(s, d):
    return rounded(ML.regression_metrics(predicted(s, d), "v", "w"), 2)


@query("m11_forecast_metrics", f"SELECT round(sqrt(avg((v - w) * (v - w))), 4) AS rmse, round(avg(abs(v - w)), 4) AS mae, round(avg(abs((v - w) / (v + 1e-8))) * 100, 4) AS mape, round(avg(2 * abs(v - w) / (abs(v) + abs(w) + 1e-8)) * 100, 4) AS smape FROM ({PRED})")
def _(s, d):
    return rounded(ML.forecast_metrics(predicted(s, d), "v", "w"), 4)


@query("m10_cluster_metrics")
def _(s, d):
    df = table(s, d, "part").withColumn("g", F.when(F.col("p_size") < 25, 0).otherwise(1))
    return rounded(ML.cluster_metrics(df, ["p_size", "p_retailprice"], "g"), 4)


@query("p05_impute_median", "SELECT event_id, round(coalesce(v, (SELECT median(v) FROM (SELECT CASE WHEN user_id < 40 THEN NULL ELSE value END AS v FROM events))), 6) AS value FROM (SELECT event_id, CASE WHEN user_id < 40 THEN NULL ELSE value END AS v FROM events) WHERE v IS NOT NULL")
def _(s, d):
    df = table(s, d, "events").select("event_id", F.when(F.col("user_id") >= 40, F.col("value")).alias("value"))
    filled = ML.impute(df.withColumn("was", F.col("value")), ["value"], "median")
    return rounded(filled.where("was IS NOT NULL").drop("was"))


@query("p06_scaled", "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS p_retailprice FROM part")
def _(s, d):
    return rounded(ML.scaled(table(s, d, "part"), ["p_retailprice"]).select("p_partkey", "p_retailprice"))


@query("p06_scaled_robust", "SELECT p_partkey, round((p_size - (SELECT median(p_size) FROM part)) / (SELECT quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) FROM part), 6) AS p_size FROM part")
def _(s, d):
    return rounded(ML.scaled(table(s, d, "part"), ["p_size"], "robust").select("p_partkey", "p_size"))


@query("p07_encoded", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority_index FROM orders")
def _(s, d):
    return ML.encode_labels(table(s, d, "orders"), ["o_orderpriority"]).select("o_orderkey", "o_orderpriority_index")


@query("p08_feature_kinds", "SELECT 'numeric' AS kind, 'l_quantity,l_extendedprice' AS columns UNION ALL SELECT 'categorical', 'l_linenumber,l_returnflag'")
def _(s, d):
    a, b = ML.feature_kinds(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_linenumber", "l_returnflag"])
    return s.createDataFrame([("numeric", ",".join(a)), ("categorical", ",".join(b))], "kind string, columns string")


@query("m01_train_classifier")
def _(s, d):
    df = table(s, d, "lineitem").withColumn("id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
    a, b = ML.split(df, "id")
    model = ML.train(a, "classification", "tree", [*FEATURES, "l_linestatus"], "l_returnflag")
    out = ML.predict(model, b)
    return rounded(ML.classification_metrics(out, "label", "prediction"), 4)


@query("m02_train_regression")
def _(s, d):
    model = ML.train(table(s, d, "part"), "regression", "linear", ["p_size", "p_type"], "p_retailprice")
    return rounded(ML.regression_metrics(ML.predict(model, table(s, d, "part")), "p_retailprice", "prediction"), 4)


@query("m05_registry", "SELECT event_type, CASE WHEN n < 1000 THEN 'logistic,tree,naive_bayes,forest,mlp' ELSE 'forest,logistic,tree,naive_bayes,mlp' END AS classifiers, CASE WHEN n < 1000 THEN 'linear,elastic_net,tree,gbt,forest' ELSE 'gbt,forest,linear,elastic_net,tree' END AS regressors FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def _(s, d):
    """Models to try on the rows of each type of event."""
    n = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).collect()
    return s.createDataFrame([(r.event_type, ",".join(ML.recommended("classification", r.n, 3)), ",".join(ML.recommended("regression", r.n))) for r in n], "event_type string, classifiers string, regressors string")


@query("m07_grid_search")
def _(s, d):
    model = ML.train(table(s, d, "part"), "regression", "ridge", ["p_size"], "p_retailprice", grid={"regParam": [0.01, 0.1]}, folds=2)
    return s.createDataFrame([(len(model.stages),)], "stages int")


@query("m16_segments")
def _(s, d):
    return rounded(ML.segments(table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 3)[1], 4)


@query("m17_alerts", "SELECT o_custkey, CASE WHEN n < 0.8 * 10 THEN 'error' WHEN n < 10 THEN 'warning' END AS level FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def _(s, d):
    n = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", F.when(F.col("n") < 8, "error").when(F.col("n") < 10, "warning").alias("level"))


@query("m14_recommendations", "SELECT 'regression' AS kind, 'twin' AS target, 'p_retailprice' AS feature, round(corr(p_retailprice, p_retailprice * 2 + p_size * 0.001), 6) AS strength FROM part UNION ALL SELECT 'clustering', NULL, NULL, NULL")
def _(s, d):
    from tallyloom.operators.association import correlations
    from tallyloom.plans.relations import twins

    c = correlations(twins(s, d), ["p_retailprice", "twin", "p_size"])
    none = s.createDataFrame([], "group string, value string, eta2 double"), s.createDataFrame([], "a string, b string, v double")
    return rounded(ML.recommendations(c, *none, 1000, 3, 1))


# ---- facts and insights


@query("i01_facts_events", f"""SELECT 'rows' AS fact, CAST(count(*) AS DOUBLE) AS value FROM events UNION ALL SELECT 'series_points', CAST(count(DISTINCT CAST(ts AS DATE)) AS DOUBLE) FROM events UNION ALL SELECT 'missing_columns', 0 UNION ALL SELECT 'duplicate_rows', 0
UNION ALL SELECT 'outlier_columns', CAST(count(*) FILTER (n_outliers > 0) AS DOUBLE) FROM ({outlier_sql('events', ['value'])}) UNION ALL SELECT 'skewed_columns', CAST((abs(skewness(value)) > 1)::INT AS DOUBLE) FROM events
UNION ALL SELECT fact, v FROM (SELECT CAST(count(*) AS DOUBLE) AS columns, CAST(count(*) FILTER (semantic_type = 'continuous') AS DOUBLE) AS numeric_count, CAST(count(*) FILTER (semantic_type IN ('categorical', 'categorical_numeric')) AS DOUBLE) AS categorical_count, CAST(count(*) FILTER (semantic_type = 'identifier') AS DOUBLE) AS identifier_count, CAST(count(*) FILTER (semantic_type = 'text') AS DOUBLE) AS text_columns, CAST(count(*) FILTER (semantic_type = 'datetime') AS DOUBLE) AS time_columns, 0.0::DOUBLE AS relations, 0.0::DOUBLE AS rules, 0.0::DOUBLE AS predictable FROM ({profile_sql('events')}) WHERE "column" <> 'user_id') UNPIVOT (v FOR fact IN (columns, numeric_count, categorical_count, identifier_count, text_columns, time_columns, relations, rules, predictable))""")
def _(s, d):
    df = table(s, d, "events").drop("user_id")
    return FA.facts(df, FA.types_of(df))


@query("i02_scenarios")
def _(s, d):
    df = table(s, d, "events")
    return FA.scenarios(FA.facts(df, FA.types_of(df)))


#: Users' numbers have no outliers, so the records are those of the values.
@query("i03_execute_outliers", ORACLE_SQL["u21_outlier_rows_events"])
def _(s, d):
    df = table(s, d, "events")
    return rounded(FA.execute(df, "E2", ["event_id"], FA.types_of(df)))


@query("i04_ranking", "SELECT event_type, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def _(s, d):
    return rounded(FA.ranking(table(s, d, "events"), "event_type"))


@query("i05_by_year", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return FA.by_year(table(s, d, "orders"), "o_orderdate")


@query("i06_cross", "SELECT o_orderstatus, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r <= 3 ORDER BY n DESC, 1, 2 LIMIT 30")
def _(s, d):
    return FA.cross(table(s, d, "orders"), "o_orderstatus", "o_orderpriority", 3)


@query("i08_conclusions")
def _(s, d):
    df = table(s, d, "events")
    return s.createDataFrame(FA.conclusions({r["fact"]: r["value"] for r in FA.facts(df, FA.types_of(df)).collect()}), "level string, text string")


@query("i10_questions")
def _(s, d):
    return s.createDataFrame([(q,) for q in FA.questions(FA.types_of(table(s, d, "orders")))], "question string")


def angles_sql(name: str) -> str:
    return f"""WITH t AS (SELECT count(*) FILTER (semantic_type = 'datetime') AS d, count(*) FILTER (semantic_type = 'continuous') AS c, count(*) FILTER (semantic_type = 'categorical') AS g FROM ({profile_sql(name)}))
SELECT unnest(list_filter([CASE WHEN d > 0 AND c > 0 THEN 'trend' END, CASE WHEN g > 0 AND c > 0 THEN 'contrast' END, CASE WHEN c > 1 THEN 'correlation' END, CASE WHEN d > 0 AND c > 0 THEN 'forecast' END, CASE WHEN c > 0 THEN 'anomaly' END, CASE WHEN g > 1 THEN 'association' END], lambda x: x IS NOT NULL)) AS angle FROM t"""


@query("i14_angles", angles_sql("orders"))
def _(s, d):
    return s.createDataFrame([(a,) for a in FA.angles(FA.types_of(table(s, d, "orders")))], "angle string")


@query("i14_angles_events", angles_sql("events"))
def _(s, d):
    return s.createDataFrame([(a,) for a in FA.angles(FA.types_of(table(s, d, "events")))], "angle string")


@query("i13_compare", f"SELECT a.\"column\", a.n AS n_a, a.missing_pct AS missing_pct_a, a.n_unique AS n_unique_a, b.n AS n_b, b.missing_pct AS missing_pct_b, b.n_unique AS n_unique_b FROM ({profile_sql('orders')}) a JOIN ({profile_sql('orders').replace('FROM orders', 'FROM (SELECT * FROM orders WHERE o_custkey < 300)')}) b ON a.\"column\" = b.\"column\"")
def _(s, d):
    o = table(s, d, "orders")
    return FA.compare(o, o.where("o_custkey < 300"))




@query("z06_stream_spikes", "SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, CAST(count(*) FILTER (value > 3 * m) AS BIGINT) AS n_spikes FROM (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) GROUP BY 1")
def _(s, d):
    return rounded(Z.run_to_files(Z.spikes(stream(s, d)), f"{shared_folder(s)}/spikes-{uuid.uuid4().hex}", "update", ["user_id"]))


@query("i09_captions")
def _(s, d):
    r = P.summary(table(s, d, "events"), ["value"]).first().asDict()
    m = P.modes(table(s, d, "events"), ["event_type"]).first().asDict()
    return s.createDataFrame([(FA.caption("histogram", "value", r),), (FA.caption("bar", "event_type", m),)], "caption string")


@query("i12_intent", """SELECT intent, coalesce(value, '') AS value, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(text), 'predict|forecast|estimate') THEN 'predict' WHEN regexp_matches(lower(text), 'show|list|which|how many') THEN 'query' WHEN regexp_matches(lower(text), 'why|explain') THEN 'explain' ELSE 'other' END AS intent, regexp_extract(lower(text), 'the\\s*(?:=|is|of|:)\\s*([-a-z0-9_.]+)', 1) AS value FROM (SELECT coalesce(text, '') AS text FROM conversations)) GROUP BY 1, 2""")
def _(s, d):
    """What each turn of a conversation asks for, and what it says `the` is."""
    said = FA.intents(table(s, d, "conversations"), "text", ["the"])
    return said.groupBy("intent", F.coalesce(F.col("values")["the"], F.lit("")).alias("value")).agg(F.count("*").alias("n"))


@query("i15_named_results", "SELECT * FROM (VALUES ('duplicates'), ('facts'), ('missing'), ('modes'), ('outliers'), ('profile'), ('scenarios'), ('score'), ('series'), ('diagnostics'), ('trend'), ('suggestions'), ('summary'), ('top_values'), ('concentration')) t(name)")
def _(s, d):
    from tallyloom.plans.analysis import Profile

    return s.createDataFrame([(k,) for k in Profile(table(s, d, "events").drop("user_id")).run()], "name string")

"""Operators against SQL on the smallest tables, and on small made-up tables with nulls."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom import catalogue
from tallyloom.functions import mathx
from tallyloom.functions import text as X
from tallyloom.operators import advice as D
from tallyloom.operators import association as A
from tallyloom.operators import filters as FI
from tallyloom.operators import graph as G
from tallyloom.operators import models as ML
from tallyloom.operators import multitable as M
from tallyloom.operators import profile as P
from tallyloom.operators import quality as Q
from tallyloom.operators import rules as U
from tallyloom.operators import timeseries as T
from tallyloom.sources import readers as R
from tallyloom.sources import sinks as S

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{round(x, 5) + 0.0:.4f}"
    return str(x)


#: A query of each family; the driver compares all of them.
SOME = """a01_profile_lineitem a01_types_loose_orders a02_summary_lineitem a03_modes_lineitem a06_missing_events a07_outliers_events a08_duplicates_lineitem_key a16_histogram_price a18_score_orders a27_concentration_part
p02_date_features f03_between f06_is_outlier f13_preview_page r01_correlations r02_spearman_part r03_cramers_v_orders r03_yates_lineitem r04_eta2_lineitem j02_star_merge j04_discover_by_prefix u02_equalities u09_verify u11_dependencies_part
u16_working_days u17_calendar w01_rolling t04_ljung_box t11_trend_line x13_prefix_duplicates x14_near_duplicates x17_tfidf_terms x28_pmi m08_classification_metrics i06_cross g05_components z01_stream_daily
t05_seasonality m15_roles_in_models m18_rule_advice u06_sums_with_exceptions t13_keywords_by_period x03_sentences x07_filtered_tokens x22_sentiment x23_sentiment_distribution x37_rising_topics x43_text_advice j08_profiles p10_display_names
i03_execute_relations i03_execute_identifiers g01_undirected""".split()


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 11


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, f"user_{i}", float(20 + i % 40) if i % 9 else None, "M" if i % 3 else "F", None if 20 <= i <= 25 else ["a", "b", "c", "d"][i % 4], float(i) if i != 50 else 10_000.0) for i in range(1, 101)]
    return spark.createDataFrame(rows, "id int, name string, age double, gender string, city string, salary double")


def test_types(people):
    strict = {r["column"]: r["semantic_type"] for r in P.profile(people).collect()}
    assert strict == {"id": "identifier", "name": "text", "age": "continuous", "gender": "categorical", "city": "categorical", "salary": "continuous"}
    loose = {r["column"]: r["semantic_type"] for r in P.profile(people, mode="loose").collect()}
    assert loose["salary"] == "identifier"
    assert {r["column"]: r["n_missing"] for r in Q.missing(people).collect()} == {"age": 11, "city": 6}


def test_empty_tables(people):
    none = people.limit(0)
    assert P.profile(none).count() == 0 and Q.outliers(none, ["age"]).count() == 0 and Q.duplicates(none).first()["n"] == 0
    assert P.histogram(none, "age").count() == 0 and U.dependencies(none, ["gender", "city"]).count() == 0


def test_outliers_and_filters(people):
    assert [r["n_outliers"] for r in Q.outliers(people, ["salary"]).collect()] == [1]
    assert [r["id"] for r in FI.apply(people, [{"field": "salary", "op": "is_outlier"}]).collect()] == [50]
    assert FI.apply(people, [{"field": "x", "op": "eq", "value": 1}]).count() == 100
    with pytest.raises(ValueError):
        FI.predicate(people, "id", "nope")


def test_only_queries_pass(spark):
    assert FI.is_query(spark, "SELECT 1") and not FI.is_query(spark, "DROP TABLE x") and not FI.is_query(spark, "DELETE FROM x") and not FI.is_query(spark, "what")


def test_one_pass_for_all_columns(spark):
    plan = P.profile(spark.read.parquet(f"{SF}/lineitem.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Expand" not in plan


def test_only_needed_columns_are_read(spark):
    plan = P.summary(spark.read.parquet(f"{SF}/lineitem.parquet"), ["l_tax"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_tax:double>" in plan


def test_distribution_tails():
    assert abs(mathx.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9 and abs(mathx.chi2_sf(18.307038, 10) - 0.05) < 1e-6
    assert abs(mathx.t_two_sided(2.2281388519649385, 10) - 0.05) < 1e-9 and abs(mathx.f_sf(3.3258345, 5, 10) - 0.05) < 1e-6
    assert abs(mathx.normal_quantile(0.975) - 1.959963985) < 1e-8
    rng = np.random.default_rng(0)
    assert mathx.shapiro(rng.normal(size=200))[1] > 0.05 > mathx.shapiro(rng.exponential(size=200))[1]


def test_series_diagnostics(spark):
    rng = np.random.default_rng(1)
    walk, noise = np.cumsum(rng.normal(size=300)), rng.normal(size=300)
    assert T.adf(walk)[1] > 0.05 > T.adf(noise)[1]
    ar = np.zeros(400)
    for i in range(1, 400):
        ar[i] = 0.7 * ar[i - 1] + rng.normal()
    f = T.arima(ar + 5, 1, 0, 0, 5)
    assert abs(f[-1] - 5) < 3
    rows = [("a", i, float(v)) for i, v in enumerate(ar)] + [("b", i, float(v)) for i, v in enumerate(noise)]
    got = {r["entity"]: r["verdict"] for r in T.diagnose(spark.createDataFrame(rows, "entity string, date int, value double")).collect()}
    assert got["a"] == "model directly"


def test_planted_rules(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(a + b), float(c)) for a, b, c in rng.integers(1, 1000, (300, 3))]
    df = spark.createDataFrame(rows, "a double, b double, total double, other double")
    found = U.sums(df, df.columns).collect()
    assert any({*r["lhs"], *r["rhs"]} == {"a", "b", "total"} and r["confidence"] == 1.0 for r in found)
    assert U.parse("b = a + 2") == (["b"], "=", ["a"], 2) and U.parse("a <= b")[1] == "<="
    assert U.simplify([(["a", "b"], "s"), (["a", "b", "c"], "t")])[1] == (["c", "s"], "t")


def test_working_days_match_numpy(spark):
    days = np.datetime64("2020-01-01") + np.random.default_rng(3).integers(0, 900, (200, 2))
    rows = [(str(a), str(b)) for a, b in days]
    got = [r["w"] for r in spark.createDataFrame(rows, "a string, b string").select(U.working_days(F.to_date("a"), F.to_date("b")).alias("w")).collect()]
    want = [-1 if b < a else int(np.busday_count(a + 1, b + 1)) for a, b in days]
    assert got == want


def test_relations(spark):
    users = spark.createDataFrame([(i, f"u{i}") for i in range(50)], "user_id int, name string")
    orders = spark.createDataFrame([(i, i % 40) for i in range(200)], "order_id int, user_id int")
    r = M.discover({"users": users, "orders": orders}).collect()
    assert [(x["from_table"], x["relation_type"], x["common"]) for x in r] == [("orders", "many_to_one", 40)]
    assert M.star_merge({"users": users, "orders": orders}, [r[0].asDict()], "orders").count() == 200
    assert M.merge_relations([r[0].asDict()], [r[0].asDict()]) == [r[0].asDict()]
    assert A.cramers_v(users.limit(0), "user_id", "name").count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("<html>Hello</html> see http://x.y now! It is not good. Bad day",), (None,), ("",)], "t string")
    r = df.select(X.clean(F.col("t")).alias("c"), X.sentiment(F.col("t")).alias("s"), X.sentences(F.col("t")).alias("n"), X.ngrams(X.tokens(F.col("t")), 2).alias("g")).collect()
    assert r[0]["c"] == "Hello see now! It is not good. Bad day" and r[0]["s"]["label"] == "negative" and len(r[0]["n"]) >= 3
    assert r[2]["g"] == [] and r[2]["s"]["label"] == "neutral"


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 7)], "src int, dst int")
    assert {r["id"]: r["component"] for r in G.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6}
    assert abs(sum(r["rank"] for r in G.pagerank(e).collect()) - 1) < 1e-9
    assert G.shortest_path(e, 1, 4) == [1, 2, 3, 4] and G.shortest_path(e, 1, 7) is None
    b = {r["id"]: r["betweenness"] for r in G.betweenness(e).collect()}
    assert b[2] == b[3] > b[1] == 0


def test_models(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), float(i % 7), "y" if i > 100 else "n") for i in range(200)], "id int, x double, z double, label_ string")
    a, b = ML.split(df, "id")
    assert a.count() + b.count() == 200
    m = ML.train(a, "classification", "tree", ["x", "z"], "label_")
    assert ML.classification_metrics(ML.predict(m, b), "label", "prediction").first()["accuracy"] > 0.95
    store = ML.ModelStore(spark, str(tmp_path / "m"))
    store.save("one", m, accuracy=0.9)
    assert store.list() == ["one"] and store.best("accuracy") == "one" and store.load("one")[1] == {"accuracy": 0.9}
    store.delete("one")
    assert store.list() == []
    with pytest.raises(ValueError):
        ML.train(a, "classification", "xgboost", ["x"], "label_")


def test_sources_and_sinks(spark, tmp_path):
    p = Path(tmp_path)
    (p / "a.csv").write_text("id, name ,order_date\n1,x,2023-01-02\n2, ,nope\n")
    df = R.read(spark, str(p / "a.csv"))
    assert df.columns == ["id", "name", "order_date"] and df.where("name IS NULL").count() == 1 and df.where("order_date IS NULL").count() <= 1
    (p / "b.txt").write_text("a;b\n1;2\n")
    assert R.read(spark, str(p / "b.txt")).first().asDict() == {"a": 1, "b": 2}
    (p / "c.json").write_text('[{"a": 1}, {"a": 2}]')
    assert R.read(spark, str(p / "c.json")).count() == 2 and R.from_json(spark, "{'a': 1}").first()["a"] == 1
    with pytest.raises(ValueError):
        R.read(spark, str(p / "x.bin"))
    S.write_parquet(df, str(p / "o.parquet"))
    assert R.read(spark, str(p / "o.parquet")).count() == 2
    lines = list(S.stream_rows(df, batch=1))
    assert len(lines) == 4 and '"complete"' in lines[-1]
    assert "<table>" in S.to_html({"t": df}) and "| id |" in S.to_markdown({"t": df})
    assert R.sniff_encoding("中文".encode("gb18030")) == "gb18030" and R.excluded("user_password")
    assert list(R.read_many(spark, [str(p / "a.csv"), str(p / "a.csv")])) == ["a", "a_2"]


def test_trade_graph_is_of_the_whole_table(spark, con):
    from tallyloom.plans import series

    want = {(a, b): n for a, b, n in con.execute("SELECT c_nationkey, s_nationkey, count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2").fetchall()}
    assert {(r.src, r.dst): int(r.weight) for r in series.trade(spark, SF).collect()} == want
    around = {r.id for r in catalogue.QUERIES["g03_betweenness"](spark, SF).collect()}
    assert around == {x for a, b in want if a != b for x in (a, b)}


def test_entities_of_all_languages(spark, tmp_path):
    import re

    rows = [(1, "we met Anna Berg in Rome", "en"), (2, "Le Monde parle de Paris", "fr"), (3, "wir sahen Karl Marx", "de"), (4, "Nobody Knows", None), (5, None, "en"), (6, "none", "es")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.entity) for r in catalogue.QUERIES["x25_entities"](spark, str(tmp_path)).collect())
    assert got == sorted({(i, m) for i, t, _ in rows for m in re.findall(r"\b(?:[A-Z][a-z]+)(?:\s+[A-Z][a-z]+)*\b", t or "")})


def test_long_texts_are_ranked_whole(spark):
    from tallyloom.operators import text as O

    late = " ".join(f"word{i}" for i in range(2500)) + " " + " ".join(f"hub side{i}" for i in range(200))
    top = O.textrank(spark.createDataFrame([(1, late), (2, "")], "doc_id long, text string")).collect()
    assert len(top) == 10 and max(top, key=lambda r: r.score).word == "hub"
    seq = late.split()
    m = np.zeros((len(set(seq)),) * 2)
    at = {w: i for i, w in enumerate(dict.fromkeys(seq))}
    for d in range(1, 5):
        for a, b in zip(seq, seq[d:], strict=False):
            if a != b:
                m[at[a], at[b]] += 1
                m[at[b], at[a]] += 1
    m /= np.maximum(m.sum(0), 1e-12)
    r = np.full(len(m), 1 / len(m))
    for _ in range(50):
        r = 0.15 / len(m) + 0.85 * (m @ r)
    assert all(abs(t.score - r[at[t.word]]) < 1e-7 for t in top)
    one = [f"alone{i} apart{i} single{i}." for i in range(450)]
    hits = ["red green blue.", "red green grey.", "red blue grey."]
    got = O.summary_sentences(spark.createDataFrame([(1, " ".join(one + hits))], "doc_id long, text string")).first().summary
    assert got == " ".join(hits)


def test_near_duplicates_with_members_are_all_pairs(spark):
    from tallyloom.operators import text as O

    texts = ["one two three four five six"] * 3 + ["six FIVE four three two one one", "one two three four five seven", "quite other words stand in here", "in here stand other words quite", "too short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: set(t.lower().split()) for i, t in enumerate(texts) if len(t) >= 20 and len(set(t.lower().split())) > 3}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    member = {r.doc_id: r.representative for r in O.near_duplicate_members(df).collect()}
    pairs = {(r.a, r.b) for r in O.near_duplicates(df).collect()}
    assert member.keys() == sets.keys()
    assert {(a, b) for a in member for b in member if a < b and (member[a] == member[b] or tuple(sorted((member[a], member[b]))) in pairs)} == want


def test_near_duplicate_members_equal_sql(spark, con):
    test_query_equals_sql(spark, con, "x14_near_duplicate_members")


def test_chinese_tokens_entities_and_summaries(spark):
    from tallyloom.operators import text as O

    df = spark.createDataFrame([(1, "Spark处理数据，很快。 ok -- 中"), (2, "负责人王小明，他在浙江省工作。腾讯公司 Anna Berg"), (3, "plain words")], "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", X.tokens(F.col("text")).alias("t")).collect()}
    assert got[1] == ["spark", "处理", "理数", "数据", "很快", "ok", "--", "中"] and got[3] == ["plain", "words"]
    found = {(r.doc_id, r.entity) for r in O.entities(df).collect()}
    assert {(2, "王小明"), (2, "他在浙江省"), (2, "腾讯公司"), (2, "Anna Berg")} <= found
    text = "天地玄黄。今天天气很好我们出门。今天天气很好他们回家。宇宙洪荒。今天天气很好大家开心。日月盈昃。"
    assert O.summary_sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().summary == "今天天气很好我们出门。 今天天气很好他们回家。 今天天气很好大家开心。"


def test_reports_and_charts_of_tables(spark):
    import json

    from tallyloom.plans.analysis import Dataset, Profile

    made = Dataset({t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("nation", "region")}, [{"from_table": "nation", "from_col": "n_regionkey", "to_table": "region", "to_col": "r_regionkey"}])
    told = json.loads(made.report())
    assert set(told) == {"relations", "groups", "merged", "tables"} and set(told["tables"]) == {"nation", "region"} and told["groups"] == [["nation", "region"]]
    assert len(told["merged"]["profile"]) == 5
    charts = Profile(spark.read.parquet(f"{SF}/events.parquet")).charts()
    assert {"boxes", "histogram of value", "bars of event_type", "line", "rolling", "weekdays", "months"} <= set(charts)
    assert charts["boxes"]().count() >= 1 and charts["months"]().count() >= 1


def test_chinese_sentiment(spark):
    texts = {"这个产品很好，非常满意": "positive", "太差了，垃圾产品": "negative", "今天天气不错": "positive", "": "neutral", "这个不好": "neutral", "not good": "neutral", "Great, I love it": "positive"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.s.label for r in df.select("t", X.sentiment(F.col("t")).alias("s")).collect()} == texts


@pytest.mark.parametrize("text", ["WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "FROM t INSERT INTO u SELECT *", "CACHE TABLE x", "REFRESH TABLE x", "SET a=b", "TRUNCATE TABLE x", "CREATE TABLE x AS SELECT 1", "no sql"])
def test_what_is_no_query_is_refused(spark, text):
    assert not FI.is_query(spark, text)


def test_queries_of_all_shapes_pass(spark):
    assert FI.is_query(spark, "WITH a AS (SELECT 1 AS b) SELECT b, count(*) FROM a JOIN y USING (b) WHERE b IN (SELECT c FROM z) GROUP BY b HAVING count(*) > 1 ORDER BY b LIMIT 3")
    assert all(FI.is_query(spark, q) for q in ("SELECT * FROM VALUES (1), (2) t(a)", "SELECT sum(a) OVER (PARTITION BY b) FROM t UNION SELECT 1", "SELECT * FROM t LATERAL VIEW explode(x) e AS y", "TABLE x"))


def test_star_merge_keeps_all_rows_of_the_other_side(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    relation = [{"from_table": "l", "from_col": "k", "to_table": "r", "to_col": "k"}]
    rows = M.star_merge({"l": left, "r": right}, relation, "l").collect()
    assert sorted((r.k, r.v or "") for r in rows) == [(1, "a"), (1, "b"), (2, "c"), (3, "")]


def test_long_paths_and_deep_trees_are_followed_to_the_end(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    assert G.shortest_path(path, 0, 12) == list(range(13)) and G.shortest_path(path, 0, 12, 5) is None and G.shortest_path(path, 0, 99) is None
    assert {r.component for r in G.components(path).collect()} == {0}
    tree = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(14)] + [("x", "y"), ("y", "x"), ("n3", "n13")], "id string, parent string")
    got = G.hierarchy(tree).collect()
    assert len(got) == 14 and max(r.depth for r in got) == 13


def test_betweenness_of_a_star_and_a_path(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 6)], "src long, dst long")
    assert {r.id: round(r.betweenness, 9) for r in G.betweenness(star).collect()} == {0: 1.0, **dict.fromkeys(range(1, 6), 0.0)}
    path = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long")
    assert {r.id: round(r.betweenness * 12) for r in G.betweenness(path).collect()} == {0: 0, 1: 6, 2: 8, 3: 6, 4: 0}
    with pytest.raises(ValueError):
        G.betweenness(path, most_edges=3)


def test_limits_of_reports_are_told(spark):
    df = spark.range(30)
    assert '"limited"' in list(S.stream_rows(df, 20))[-1] and '"complete", "rows": 30' in list(S.stream_rows(df))[-1] and '"complete"' in list(S.stream_rows(df, 30))[-1]
    small = S.collect_small({"a": df, "b": spark.range(3)}, 10)
    assert len(small["a"]) == 10 and "a (first 10 rows)" in small and list(small) == ["a", "a (first 10 rows)", "b"]


def test_lines_that_do_not_fit_are_kept(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,note\n1,"two\nlines"\n2,"a ""quoted"" word"\n3\n')
    rows = R.read_csv(spark, str(path)).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3] and rows[0].note == "two\nlines" and rows[1].note == 'a "quoted" word' and rows[2].note is None
    assert R.read_csv(spark, str(path), dropped=True).count() <= 3


def test_normality_of_a_sparse_column_beside_a_full_one(spark):
    df = spark.range(60_000).select(F.randn(1).alias("full"), F.when(F.col("id") % 1200 == 0, F.randn(2)).alias("sparse"))
    got = {r.column: r for r in P.normality(df, ["full", "sparse"]).collect()}
    assert got["sparse"].n == 50 and got["sparse"].shapiro_w is not None and got["full"].shapiro_w is not None


def test_series_advice(spark):
    rng = np.random.default_rng(4)
    x = [0.0]
    for e in rng.normal(size=199):
        x.append(0.7 * x[-1] + e)
    made = {"ar": x, "noise": rng.normal(size=200), "walk": np.cumsum(rng.normal(size=200)), "short": rng.normal(size=12)}
    rows = [(k, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", float(v)) for k, values in made.items() for i, v in enumerate(values)]
    s = spark.createDataFrame(rows, "entity string, date string, value double").withColumn("date", F.to_timestamp("date"))
    got = {r.entity: r for r in D.series_advice(s).collect()}
    assert got["ar"].suitable and got["ar"].method == "ARIMA or SARIMA" and got["walk"].method == "ARIMA after differencing"
    assert not got["noise"].suitable and not got["short"].suitable and got["short"].method == "mean or median"


def test_roles_in_models(spark, people):
    df = spark.createDataFrame([(i, 1.0, float(i), None if i % 3 else 2.0, "ab"[i % 2], "x") for i in range(30)], "id long, flat double, num double, sparse double, cat string, one string")
    types = {"id": "identifier", "flat": "continuous", "num": "continuous", "sparse": "continuous", "cat": "categorical", "one": "categorical"}
    got = {r.column: (r.feature, r.regression_target, r.classification_target) for r in D.roles_in_models(df, types).collect()}
    assert got == {"id": (False, False, False), "flat": (False, False, False), "num": (True, True, False), "sparse": (False, False, False), "cat": (True, False, True), "one": (False, False, False)}


def test_display_names(spark):
    assert D.display_names("成员设计名 类型 中文名\nabc int 数量\nde string 名称 x\n\n") == {"abc": "数量", "de": "名称"}
    assert D.display_names("amount：金额\nprice: 价格: 元\na=b\n无") == {"amount": "金额", "price": "价格: 元"}
    assert D.renamed(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), {"a": "x", "b": "x"}).columns == ["x", "x (b)", "c"]


def test_insights(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = D.insights(
        make([("e1", 150), ("e2", 20)], "entity string, n long"), make([("a", "b", 9, 4.0)], "a string, b string, n long, pmi double"), make([("positive", 6), ("negative", 1), ("neutral", 3)], "label string, n long"),
        make([("c1", 60, 0.6, "p q r"), ("c2", 40, 0.4, "p s t")], "label string, size long, share double, words string"), make([("t", 30.0, 10.0), ("u", 1.0, 10.0)], "entity string, recent double, earlier double"), make([("m", "2024-01-05")], "entity string, date string").withColumn("date", F.to_timestamp("date")),
    )
    rows = {(r.kind, r.subject): (round(r.score, 3), r.priority) for r in got.collect()}
    assert rows[("hot_entity", "e1")] == (1.0, "high") and rows[("hot_entity", "e2")] == (0.2, "medium") and rows[("strong_association", "a ~ b")] == (0.8, "high")
    assert rows[("sentiment", "positive")] == (0.6, "high") and rows[("main_cluster", "c1")] == (0.6, "high") and rows[("contrast", "c1 / c2")] == (0.667, "medium")
    assert rows[("trend", "t")] == (1.0, "high") and ("trend", "u") not in rows and rows[("sentiment_shift", "m 2024-01-05")] == (0.7, "high")

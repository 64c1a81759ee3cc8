"""Queries over itemsets, density, neighbours, two-sample tests, summaries and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import boosting as B
from tallyloom.operators import comparison as CO
from tallyloom.operators import density as D
from tallyloom.operators import itemsets as I
from tallyloom.operators import margins as SV
from tallyloom.operators import models as ML
from tallyloom.operators import neighbours as N
from tallyloom.operators import seasonal as SE
from tallyloom.operators import rules as U
from tallyloom.operators import summaries as SU
from tallyloom.operators import text as T
from tallyloom.plans.profiling import rounded
from tallyloom.plans.registry import query
from tallyloom.plans.series import daily
from tallyloom.plans.texts import ITEMS, SPLIT, docs, items
from tallyloom.session import table

# ---- itemsets

LEVELS = "CASE WHEN l_quantity < 17 THEN 'few' WHEN l_quantity < 34 THEN 'some' ELSE 'many' END"
LINE_ITEMS = f"(SELECT DISTINCT l_orderkey AS k, unnest([l_returnflag, l_linestatus, 'line ' || l_linenumber, {LEVELS}]) AS item FROM lineitem)"


def order_baskets(s, d):
    level = F.when(F.col("l_quantity") < 17, "few").when(F.col("l_quantity") < 34, "some").otherwise("many")
    flat = table(s, d, "lineitem").select("l_orderkey", F.explode(F.array("l_returnflag", "l_linestatus", F.concat(F.lit("line "), F.col("l_linenumber").cast("string")), level)).alias("item"))
    return I.baskets(flat, ["l_orderkey"], "item")


def sets_sql(items: str, least: str) -> str:
    """Itemsets of one to three items by joining items with themselves."""
    return f"""WITH i AS MATERIALIZED {items}, f AS MATERIALIZED (SELECT * FROM i WHERE item IN (SELECT item FROM i GROUP BY 1 HAVING count(*) >= {least})),
s AS (SELECT [item] AS items, 1 AS size, count(*) AS n FROM f GROUP BY 1 UNION ALL
SELECT [a.item, b.item], 2, count(*) FROM f a JOIN f b ON a.k = b.k AND a.item < b.item GROUP BY 1 UNION ALL
SELECT [a.item, b.item, c.item], 3, count(*) FROM f a JOIN f b ON a.k = b.k AND a.item < b.item JOIN f c ON b.k = c.k AND b.item < c.item GROUP BY 1)
SELECT array_to_string(items, ' + ') AS items, CAST(size AS BIGINT) AS size, n FROM s WHERE n >= {least}"""


def said(found):
    return found.select(F.array_join("items", " + ").alias("items"), F.col("size").cast("long").alias("size"), "n")


ORDER_LEAST = "(SELECT CAST(ceil(count(DISTINCT l_orderkey) * 0.1) AS BIGINT) FROM lineitem)"


@query("x29_itemsets_orders", sets_sql(LINE_ITEMS, ORDER_LEAST))
def _(s, d):
    sets = order_baskets(s, d)
    n = sets.count()
    return said(I.frequent(sets, -(-n // 10), 3))


WORDS = f"(SELECT DISTINCT doc_id AS k, unnest({SPLIT}) AS item FROM documents)"


@query("x29_itemsets", sets_sql(WORDS, "(SELECT CAST(ceil(count(*) * 0.4) AS BIGINT) FROM documents)"))
def _(s, d):
    """Words that share documents, by sets of up to three."""
    every = table(s, d, "documents")
    words = every.select("doc_id", F.explode(F.filter(F.split(F.lower("text"), r"[ \t\n\r\x0B\f]+"), lambda x: F.length(x) > 0)).alias("item"))
    return said(I.frequent(I.baskets(words, ["doc_id"], "item"), -(-every.count() * 4 // 10), 3))


@query("x29_itemset_rules", f"""WITH s AS ({sets_sql(LINE_ITEMS, ORDER_LEAST)}), i AS (SELECT string_split(items, ' + ') AS items, size, n FROM s), c AS (SELECT count(DISTINCT l_orderkey) AS c FROM lineitem),
p AS (SELECT list_filter(items, lambda y: y <> x) AS antecedent, x AS consequent, n FROM (SELECT items, n, unnest(items) AS x FROM i WHERE size > 1))
SELECT array_to_string(antecedent, ' + ') AS antecedent, consequent, p.n, round(p.n * 1.0 / c, 6) AS support, round(p.n * 1.0 / a.n, 6) AS confidence, round(p.n * 1.0 / a.n * c / b.n, 6) AS lift
FROM p JOIN i a ON a.items = antecedent JOIN i b ON b.items = [consequent], c WHERE p.n * 1.0 / a.n >= 0.5 AND p.n * 1.0 / a.n * c / b.n >= 1""")
def _(s, d):
    sets = order_baskets(s, d)
    n = sets.count()
    return rounded(I.rules(I.frequent(sets, -(-n // 10), 3), n).withColumn("antecedent", F.array_join("antecedent", " + ")))


@query("x29_closed_itemsets")
def _(s, d):
    """Any size, in place of up to three items."""
    sets = order_baskets(s, d)
    return said(I.closed(I.frequent(sets, -(-sets.count() // 10))))


# ---- density, neighbours, summaries


def flat(s, d, size=2):
    """Embeddings by their first principal components."""
    rows = SU.reduced(table(s, d, "embeddings").select("vec_id", "embedding"), "embedding", size, size)
    return rows.select("vec_id", *[F.round(F.col("v")[i], 9).alias(f"x{i}") for i in range(size)])


@query("m03_dbscan")
def _(s, d):
    return D.dbscan(flat(s, d), "vec_id", ["x0", "x1"], 0.2, 5)


@query("m03_dbscan_parts", "SELECT p_partkey, CASE WHEN p_retailprice IS NULL THEN NULL ELSE (SELECT min(p_partkey) FROM part) END AS cluster, p_retailprice IS NOT NULL AS core FROM part")
def _(s, d):
    """Prices are a tenth apart or nearer, so parts are one cluster, of core rows alone."""
    return D.dbscan(table(s, d, "part"), "p_partkey", ["p_retailprice"], 0.51, 3)


@query("m03_power_iteration")
def _(s, d):
    return N.spectral(N.vectors(table(s, d, "embeddings"), "vec_id", ["embedding"]), 4)


@query("m01_knn")
def _(s, d):
    """The ten nearest of every fiftieth vector, among all."""
    rows = N.vectors(table(s, d, "embeddings"), "vec_id", ["embedding"])
    return rounded(N.nearest(rows, rows.where("id % 50 = 0")), 9)


def part_numbers(s, d, test):
    rows = N.vectors(table(s, d, "part"), "p_partkey", ["p_size", "p_retailprice"]).join(table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_retailprice"), "id")
    return rows.where((F.col("id") % 50 == 0) == test)


@query("m01_knn_classifier")
def _(s, d):
    return rounded(N.predict(part_numbers(s, d, False).withColumnRenamed("p_type", "label"), part_numbers(s, d, True).select("id", "v"), 5))


@query("m02_knn_regression")
def _(s, d):
    return rounded(N.predict(part_numbers(s, d, False).withColumnRenamed("p_retailprice", "label"), part_numbers(s, d, True).select("id", "v"), 5, number=True))


@query("m03_birch")
def _(s, d):
    rows = table(s, d, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), (F.col("p_retailprice") / 50).cast("double")).alias("v"))
    return SU.birch(rows, 4).select("p_partkey", "cluster")


@query("x33_ward")
def _(s, d):
    """Each text vector's cluster, by Ward's merges, in two to ten clusters."""
    return SU.ward_clusters(SU.reduced(table(s, d, "embeddings").select("vec_id", "embedding"), "embedding"))[0].select("vec_id", "cluster")


# ---- two-sample and independence tests


def ks_sql(name: str, cols: list[str], first: str) -> str:
    one = lambda c: f"""SELECT '{c}' AS "column", max(n_a) AS n_a, max(n_b) AS n_b, round(max(abs(a / n_a - b / n_b)), 9) AS d FROM (SELECT v, sum(sum(CASE WHEN f THEN 1 ELSE 0 END)) OVER (ORDER BY v) AS a, sum(sum(CASE WHEN f THEN 0 ELSE 1 END)) OVER (ORDER BY v) AS b, max(n_a) AS n_a, max(n_b) AS n_b FROM (SELECT {c} AS v, {first} AS f, count(*) FILTER ({first}) OVER () AS n_a, count(*) FILTER (NOT ({first})) OVER () AS n_b FROM {name} WHERE {c} IS NOT NULL AND ({first}) IS NOT NULL) GROUP BY v)"""
    return f"SELECT \"column\", CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, d FROM ({' UNION ALL '.join(map(one, cols))})"


@query("r13_ks", ks_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], "l_linestatus = 'F'"))
def _(s, d):
    return rounded(CO.ks(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], F.col("l_linestatus") == "F"), 9).drop("p")


@query("r13_ks_p_values")
def _(s, d):
    return CO.ks(table(s, d, "events"), ["value", "user_id"], F.col("event_type") == "click")


def independence_sql(name: str, pairs: list[tuple[str, str]]) -> str:
    one = lambda a, b: f"""SELECT '{a}' AS a, '{b}' AS b, sum((o - e) * (o - e) / e) AS chi2, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS dof, sum(o) AS n, avg(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END) AS low FROM (SELECT x, y, coalesce(o, 0) AS o, r * 1.0 * c / (SELECT count(*) FROM {name} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS e FROM (SELECT {a} AS x, count(*) AS r FROM {name} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) CROSS JOIN (SELECT {b} AS y, count(*) AS c FROM {name} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT {a} AS x, {b} AS y, count(*) AS o FROM {name} GROUP BY 1, 2) USING (x, y))"""
    return f"SELECT a, b, round(chi2, 6) AS chi2, CAST(dof AS BIGINT) AS dof, CAST(n AS BIGINT) AS n, round(low, 6) AS low FROM ({' UNION ALL '.join(one(*p) for p in pairs)}) WHERE dof > 0"


@query("r13_chi_square", independence_sql("lineitem", [("l_returnflag", "l_linestatus"), ("l_linestatus", "l_linenumber"), ("l_linenumber", "l_quantity")]))
def _(s, d):
    return rounded(CO.chi_square(table(s, d, "lineitem"), [("l_returnflag", "l_linestatus"), ("l_linestatus", "l_linenumber"), ("l_linenumber", "l_quantity")])).drop("p")


# ---- models


def features(df, cols):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(df)


@query("m01_adaboost")
def _(s, d):
    """Rows never taught, by boosted stumps and by the first of them: accuracy of each."""
    df = table(s, d, "part").withColumn("label", (((F.col("p_size") > 12) & (F.col("p_size") < 38)) | (F.col("p_retailprice") > 1000)).cast("double"))
    a, b = ML.split(features(df, ["p_size", "p_retailprice"]), "p_partkey")
    made = B.adaboost(a, 12)
    first = B.Boosted(made.classes, made.trees[:1], made.weights[:1])
    rate = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    return rounded(made.predict(b).agg(rate.alias("accuracy"), F.lit(len(made.trees)).alias("trees")).join(first.predict(b).agg(rate.alias("first"))), 4)


@query("m02_svr")
def _(s, d):
    """Each part's price and what the machine makes of its size and number."""
    rows = table(s, d, "part").select("p_partkey", F.array((F.col("p_size") / 50).cast("double"), (F.col("p_partkey") / 1000).cast("double")).alias("v"), (F.col("p_retailprice") / 100).alias("label"))
    return rounded(SV.fit(rows, 0.05).predict(rows).select("p_partkey", "label", "prediction"), 4)


@query("m04_sarima")
def _(s, d):
    return rounded(SE.sarima_forecast(daily(s, d), (1, 0, 0), (0, 1, 1, 7)), 4)


@query("m04_sarima_fits")
def _(s, d):
    return rounded(SE.sarima_fits(daily(s, d), (1, 0, 1), (1, 0, 0, 7)), 4)


# ---- rules, classes of near copies, importances

IDENTITIES = "SELECT p_size AS a, p_retailprice AS b, p_size + p_retailprice AS c, p_partkey % 97 AS d, (p_partkey * 31) % 89 AS e, p_partkey % 97 + (p_partkey * 31) % 89 AS f FROM part"


def identities(s, d):
    return table(s, d, "part").select(*[e.cast("double").alias(n) for n, e in (("a", F.col("p_size")), ("b", F.col("p_retailprice")), ("c", F.col("p_size") + F.col("p_retailprice")), ("d", F.col("p_partkey") % 97), ("e", F.col("p_partkey") * 31 % 89), ("f", F.col("p_partkey") % 97 + F.col("p_partkey") * 31 % 89))])


@query("u08_passes", f"SELECT 'abc' AS fields, count(*) AS valid_rows, count(*) FILTER (abs(a + b - c) < 1e-6) AS satisfied_rows FROM ({IDENTITIES}) UNION ALL SELECT 'def', count(*), count(*) FILTER (abs(d + e - f) < 1e-6) FROM ({IDENTITIES})")
def _(s, d):
    """Two identities over six fields."""
    found = U.sums_in_passes(identities(s, d), list("abcdef"), 0.99)
    return found.where("size(lhs) + size(rhs) = 3").select(F.array_join(F.array_sort(F.concat("lhs", "rhs")), "").alias("fields"), "valid_rows", "satisfied_rows")


@query("l10_distinct_rules", f"SELECT 'abc' AS fields, count(*) AS valid_rows, count(*) AS satisfied_rows FROM ({IDENTITIES}) UNION ALL SELECT 'def', count(*), count(*) FROM ({IDENTITIES})")
def _(s, d):
    """Rules over the same fields, written in several ways, are one."""
    ways = [(["a", "b"], ["c"]), (["b", "a"], ["c"]), (["c"], ["a", "b"]), (["d", "e"], ["f"]), (["e", "d"], ["f"])]
    return U.distinct_rules(U.verify(identities(s, d), ways)).select(F.array_join(F.array_sort(F.concat("lhs", "rhs")), "").alias("fields"), "valid_rows", "satisfied_rows")


@query("a30_rule_counts", f"{ITEMS} SELECT (SELECT count(DISTINCT doc_id) FROM k) AS transactions, (SELECT count(DISTINCT item) FROM k) AS entities, (SELECT count(*) FROM p) AS pairs")
def _(s, d):
    return T.rule_counts(items(s, d))


@query("x14_near_duplicate_classes", f"""WITH RECURSIVE h AS (SELECT doc_id, list_sort(list_distinct({SPLIT})) AS t FROM documents WHERE length(text) >= 20 AND len(list_distinct({SPLIT})) > 3), s AS (SELECT t, min(doc_id) AS doc_id, count(*) AS size FROM h GROUP BY 1),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.doc_id < b.doc_id AND least(len(a.t), len(b.t)) >= 0.7 * greatest(len(a.t), len(b.t)) WHERE len(list_intersect(a.t, b.t)) * 1.0 / len(list_distinct(list_concat(a.t, b.t))) >= 0.7), l AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS class_id FROM r GROUP BY 1), n AS (SELECT l.a, sum(s.size) AS near FROM l JOIN s ON l.b = s.doc_id GROUP BY 1)
SELECT h.doc_id, c.class_id, CAST(s.size - 1 + coalesce(n.near, 0) AS BIGINT) AS n_links FROM h JOIN s ON h.t = s.t JOIN c ON c.a = s.doc_id LEFT JOIN n ON n.a = s.doc_id""")
def _(s, d):
    return T.near_duplicate_classes(docs(s, d))


@query("m12_named_importances")
def _(s, d):
    """What a forest goes by, by name, where the price is a sum of two features."""
    df = table(s, d, "part").withColumn("y", F.col("p_size") * 10.0 + F.when(F.col("p_type") == "PROMO", 50.0).otherwise(0.0))
    model = ML.train(df, "regression", "forest", ["p_size", "p_retailprice", "p_type"], "y")
    return rounded(s.createDataFrame(ML.named_importances(model, df), "feature string, importance double"), 4)

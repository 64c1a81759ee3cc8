"""Queries over checks and findings: what data is fit for, names behind ids, keywords by period, rules with exceptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import advice as D
from tallyloom.operators import charts as CH
from tallyloom.operators import facts as FA
from tallyloom.operators import multitable as M
from tallyloom.operators import rules as U
from tallyloom.operators import text as T
from tallyloom.operators import timeseries as S
from tallyloom.plans.profiling import profile_sql, rounded, union
from tallyloom.plans.registry import query
from tallyloom.plans.texts import TOKENS, M as MENTIONS, docs, mentions
from tallyloom.session import table

DAILY = "SELECT event_type AS entity, CAST(date_trunc('day', ts) AS TIMESTAMP) AS date, avg(value) AS value FROM events GROUP BY 1, 2"


def daily(s, d):
    return S.series(table(s, d, "events"), "ts", "value", "event_type")


@query("t05_seasonality", f"SELECT entity, count(*) AS n, round(corr(value, past), 6) AS r, count(*) >= 24 AND abs(corr(value, past)) > 0.3 AS seasonal FROM (SELECT *, lag(value, 12) OVER (PARTITION BY entity ORDER BY date) AS past FROM ({DAILY})) GROUP BY 1")
def _(s, d):
    return rounded(S.seasonality(daily(s, d)))


@query("r12_series_advice")
def _(s, d):
    return D.series_advice(daily(s, d))


ROLES = f"""WITH p AS ({profile_sql('part')}), v AS ({union([f"SELECT '{c}' AS \"column\", {spread} AS std, min({c}) <> max({c}) AS two FROM part" for c, spread in (("p_partkey", "stddev_samp(p_partkey)"), ("p_name", "NULL"), ("p_brand", "NULL"), ("p_type", "NULL"), ("p_size", "stddev_samp(p_size)"), ("p_retailprice", "stddev_samp(p_retailprice)"))])})
SELECT p."column", missing_pct <= 50 AND NOT (semantic_type = 'continuous' AND coalesce(std = 0, false)) AND (semantic_type NOT IN ('categorical', 'categorical_numeric', 'ordinal') OR two) AND semantic_type <> 'identifier' AS feature, missing_pct <= 50 AND semantic_type = 'continuous' AND coalesce(std > 0, false) AND p."column" <> 'p_size' AS regression_target,
missing_pct <= 50 AND semantic_type IN ('categorical', 'categorical_numeric', 'ordinal') AND two AND p."column" <> 'p_size' AS classification_target FROM p JOIN v ON p."column" = v."column\""""


@query("m15_roles_in_models", ROLES)
def _(s, d):
    df = table(s, d, "part")
    return D.roles_in_models(df, FA.types_of(df), {"p_size"})


def with_total(s, d):
    """Lines whose total is the sum of two fields, but for every seventh."""
    extra = F.when(F.col("l_linenumber") == 7, 1.0).otherwise(0.0)
    return table(s, d, "lineitem").withColumn("total", F.col("l_discount") + F.col("l_tax") + extra).withColumn("whole", F.col("l_discount") + F.col("l_tax"))


@query(
    "m18_rule_advice",
    """SELECT 'medium' AS priority, 'mend violations' AS task, 'l_discount + l_tax = total' AS subject, round(count(*) FILTER (l_linenumber <> 7) * 1.0 / count(*), 6) AS share FROM lineitem UNION ALL SELECT 'medium', 'watch the rule', 'l_discount + l_tax = whole', 1.0
UNION ALL SELECT 'high', 'mend the key', 'customer.nationkey -> supplier.nationkey', round(c * 1.0 / least(a, b), 6) FROM (SELECT (SELECT count(DISTINCT c_nationkey) FROM customer) AS a, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS b, (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS c) WHERE c < least(a, b)
UNION ALL SELECT 'low', 'normalise', 'p_partkey -> p_size', 1.0""",
)
def _(s, d):
    sums = U.verify(with_total(s, d), [(["l_discount", "l_tax"], ["total"]), (["l_discount", "l_tax"], ["whole"])])
    keys = M.discover({"customer": table(s, d, "customer").select(F.col("c_nationkey").alias("nationkey")), "supplier": table(s, d, "supplier").select(F.col("s_nationkey").alias("nationkey"))})
    return rounded(D.rule_advice(sums, keys, U.dependencies(table(s, d, "part"), ["p_partkey", "p_size"])))


@query("u06_sums_with_exceptions", "SELECT 'p_size + p_retailprice = total' AS rule, count(*) AS valid_rows, count(*) FILTER (p_partkey % 10 < 7) AS satisfied_rows FROM part")
def _(s, d):
    """A sum that holds for seven rows of ten."""
    df = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_size") + F.col("p_retailprice") + F.when(F.col("p_partkey") % 10 >= 7, F.col("p_partkey") * 37 % 1000 + 50).otherwise(0)).alias("total"))
    return U.sums(df, ["p_size", "p_retailprice", "total"]).select("rule", "valid_rows", "satisfied_rows")


DATED = "SELECT text, TIMESTAMP '2024-01-01' + INTERVAL (doc_id % 90) DAY AS day FROM documents"


def dated(s, d):
    """The documents with days of three months by their id."""
    return docs(s, d).select("text", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).cast("timestamp").alias("day"))


@query("t13_keywords_by_period", f"SELECT period, CAST(rank AS BIGINT) AS rank, token, n FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, token) AS rank FROM (SELECT strftime(TIMESTAMP '2024-01-01' + INTERVAL (doc_id % 90) DAY, '%Y-%m') AS period, token, count(*) AS n FROM ({TOKENS}) GROUP BY 1, 2)) WHERE rank <= 10")
def _(s, d):
    return rounded(D.keywords_by_period(dated(s, d), "day"))


@query(
    "x43_text_advice",
    f"""WITH r AS (SELECT count(*) AS n, coalesce(avg(nullif(length(text), 0)), 0) AS m, count(day) AS dated, count(DISTINCT day) AS days FROM ({DATED}))
SELECT 'sample_size' AS "check", n >= 10 AS suitable, CASE WHEN n < 10 THEN 'basic statistics' WHEN n < 50 THEN 'basic statistics and keywords' ELSE 'all' END AS method, n FROM r UNION ALL SELECT 'text_length', m >= 10, CASE WHEN m < 10 THEN 'statistics' WHEN m < 50 THEN 'keywords and sentiment' ELSE 'all' END, n FROM r
UNION ALL SELECT 'time_series', dated >= 10 AND days >= 5, CASE WHEN dated >= 10 AND days >= 5 THEN 'trends and anomalies' END, n FROM r UNION ALL SELECT 'clustering', n >= 20 AND m >= 20, CASE WHEN n >= 20 AND m >= 20 THEN 'k-means' END, n FROM r UNION ALL SELECT 'topic_modeling', n >= 50 AND m >= 50, CASE WHEN n >= 50 AND m >= 50 THEN 'LDA' END, n FROM r""",
)
def _(s, d):
    return D.text_advice(dated(s, d), "day")


@query("x37_rising_topics", f"SELECT entity, round(recent, 6) AS recent, round(earlier, 6) AS earlier, round((recent - earlier) / earlier * 100, 6) AS increase_pct FROM (SELECT entity, avg(value) FILTER (r <= 7) AS recent, avg(value) FILTER (r > 7) AS earlier FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r FROM ({MENTIONS})) GROUP BY 1) WHERE recent > earlier")
def _(s, d):
    return rounded(D.hot_topics(mentions(s, d), over=0.0))


@query("x42_insights")
def _(s, d):
    """Entities, their pairs, moods and the languages as clusters of the whole corpus; topics and their turns by day."""
    items = T.frequent_of(docs(s, d).select("doc_id", T.X.entities(F.col("text")).alias("x")), 40)
    daily_mood = docs(s, d).select(F.col("doc_id"), "text").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).cast("timestamp"))
    mood = daily_mood.select(F.lit("all").alias("entity"), F.col("day").alias("date"), T.X.sentiment(F.col("text")).alias("m")).groupBy("entity", "date").agg((F.avg("m.positive") - F.avg("m.negative")).alias("value"))
    shifts = T.sentiment_shifts(mood, 0.01)
    return rounded(D.insights(T.entity_stats(docs(s, d)), T.pmi(items), T.sentiment_distribution(docs(s, d)), T.cluster_profile(table(s, d, "documents"), "lang"), D.hot_topics(mentions(s, d), over=0.0), shifts))


@query(
    "j08_profiles",
    """WITH r AS (SELECT s_suppkey AS entity_id, 'next out ' || o AS x FROM (SELECT a.s_suppkey, b.s_name AS o FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1) UNION ALL SELECT s_suppkey, 'next in ' || o FROM (SELECT b.s_suppkey, a.s_name AS o FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1)),
e AS (SELECT l_suppkey AS entity_id, l_linestatus || ' ' || l_returnflag AS x, count(*) AS k FROM lineitem GROUP BY 1, 2), rr AS (SELECT entity_id, string_agg(x, '; ' ORDER BY x) AS related, count(*) AS k FROM r GROUP BY 1), ee AS (SELECT entity_id, string_agg(x, '; ' ORDER BY x) AS events, sum(k) AS k FROM e GROUP BY 1)
SELECT s_suppkey AS entity_id, s_name AS name, 'supplier' AS kind, related, events, n_name AS themes, CAST(2 + coalesce(rr.k, 0) + coalesce(ee.k, 0) + 1 AS BIGINT) AS importance FROM supplier LEFT JOIN rr ON rr.entity_id = s_suppkey LEFT JOIN ee ON ee.entity_id = s_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey""",
)
def _(s, d):
    """Suppliers as entities, each with the next; lines as their events, nations as their themes."""
    one = table(s, d, "supplier")
    entities = one.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.lit(2).alias("n_attributes"))
    next_one = one.select((F.col("s_suppkey") + 1).alias("object_id")).join(one.select(F.col("s_suppkey").alias("object_id")), "object_id").select((F.col("object_id") - 1).alias("subject_id"), "object_id", F.lit("next").alias("predicate"))
    line = table(s, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_returnflag").alias("summary"), F.col("l_suppkey").alias("entity_id"), F.col("l_linestatus").alias("role"))
    themes = one.join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("theme_id"), F.col("n_name").alias("name"), F.col("s_suppkey").alias("entity_id"))
    return D.profiles(entities, next_one, line, themes)


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")


@query("k11_boxes_lineitem", union([f"SELECT '{c}' AS \"column\", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, CAST(min({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS low, CAST(max({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS high, count(*) FILTER ({c} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, median({c}) AS median, quantile_cont({c}, 0.75) AS q3 FROM lineitem) GROUP BY q1, median, q3" for c in NUMBERS]))
def _(s, d):
    return rounded(CH.boxes(table(s, d, "lineitem"), list(NUMBERS)))


@query("k11_chart_bars_part", "SELECT CASE WHEN r <= 5 THEN v ELSE 'other' END AS value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT p_type AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1) GROUP BY 1")
def _(s, d):
    df = table(s, d, "part")
    return CH.chart_data(df, FA.types_of(df))["bars of p_type"]()


@query("p10_display_names", 'SELECT r_regionkey AS "Region", r_name AS "Name" FROM region')
def _(s, d):
    return D.renamed(table(s, d, "region"), D.display_names("r_regionkey: Region\nr_name = Name\nunknown -> nothing"))


@query("i03_execute_relations", "SELECT 'customer' AS from_table, 'nation' AS to_table, 'many_to_one' AS relation_type, count(DISTINCT c_nationkey) AS common FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(s, d):
    some = {t: table(s, d, t).select(f"{t[0]}_nationkey") for t in ("customer", "nation")}
    return FA.execute(some["customer"], "B4", [], {}, tables=some, strip_prefix=True)


@query("i03_execute_roles", ROLES.replace(" AND p.\"column\" <> 'p_size'", ""))
def _(s, d):
    df = table(s, d, "part")
    return FA.execute(df, "D2", ["p_partkey"], FA.types_of(df))


@query("i03_execute_identifiers", "SELECT 'o_orderkey' AS \"column\", count(DISTINCT o_orderkey) AS n_unique, min(CAST(o_orderkey AS VARCHAR)) AS min, max(CAST(o_orderkey AS VARCHAR)) AS max FROM orders")
def _(s, d):
    df = table(s, d, "orders")
    return FA.execute(df, "F2", ["o_orderkey"], {"o_orderkey": "identifier"})

"""Queries over association, several tables, rules."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tallyloom.operators import association as A
from tallyloom.operators import multitable as M
from tallyloom.operators import profile as P
from tallyloom.operators import rules as U
from tallyloom.plans.profiling import LINE, profile_sql, rounded, union
from tallyloom.plans.registry import query
from tallyloom.session import table

CORR = union([f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM lineitem" for a, b in combinations(LINE, 2)])


@query("r01_correlations", f"SELECT a, b, round(r, 6) AS r, n FROM ({CORR})")
def _(s, d):
    return rounded(A.correlations(table(s, d, "lineitem"), LINE))


@query("a12_high_correlations", f"SELECT a, b, round(r, 3) AS r, n FROM ({CORR}) WHERE abs(r) >= 0.002")
def _(s, d):
    return A.high_correlations(table(s, d, "lineitem"), LINE, 0.002)


TWIN = "SELECT p_partkey, p_retailprice, p_retailprice * 2 + p_size * 0.001 AS twin, p_size FROM part"


def twins(s, d):
    return table(s, d, "part").select("p_partkey", "p_retailprice", (F.col("p_retailprice") * 2 + F.col("p_size") * 0.001).alias("twin"), "p_size")


@query("i07_redundant", f"SELECT 'p_retailprice' AS a, 'twin' AS b, round(corr(p_retailprice, twin), 6) AS r, count(*) AS n, 1 AS redundancy FROM ({TWIN})")
def _(s, d):
    return A.redundant(twins(s, d), ["p_retailprice", "twin", "p_size"]).withColumn("r", F.round("r", 6))


RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("r02_spearman_part", f"SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM (SELECT {RANK.format(c='p_size')} AS a, {RANK.format(c='p_retailprice')} AS b FROM part)")
def _(s, d):
    return rounded(A.spearman(table(s, d, "part"), "p_size", "p_retailprice"))


@query("w07_average_rank", f"SELECT p_partkey, CAST({RANK.format(c='p_size')} AS DOUBLE) AS rank FROM part")
def _(s, d):
    return A.average_rank(table(s, d, "part").select("p_partkey", "p_size"), "p_size", "rank").select("p_partkey", F.col("rank").cast("double").alias("rank"))


@query("r02_significant_pairs")
def _(s, d):
    return rounded(A.numeric_pairs(twins(s, d), ["p_retailprice", "twin", "p_size"]))


def chi2_sql(t: str, a: str, b: str) -> str:
    return f"""WITH c AS (SELECT {a} AS x, {b} AS y, count(*) AS o FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, sum(o) OVER (PARTITION BY x) AS r, sum(o) OVER (PARTITION BY y) AS k, sum(o) OVER () AS n FROM c),
z AS (SELECT max(n) AS n, count(DISTINCT x) AS nr, count(DISTINCT y) AS nc, max(n) * (sum(o * o * 1.0 / (r * k)) - 1) AS chi2 FROM m)
SELECT round(chi2, 6) AS chi2, CAST((nr - 1) * (nc - 1) AS BIGINT) AS dof, round(sqrt(chi2 / ((SELECT count(*) FROM {t}) * (least(nr, nc) - 1))), 6) AS v, CAST(n AS BIGINT) AS n FROM z WHERE nr > 1 AND nc > 1"""


@query("r03_cramers_v_orders", chi2_sql("orders", "o_orderstatus", "o_orderpriority"))
def _(s, d):
    return rounded(A.cramers_v(table(s, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query("r03_yates_lineitem", """WITH b AS (SELECT l_linestatus AS x, l_tax > 0.04 AS y FROM lineitem), t AS (SELECT count(*) AS n, count(*) FILTER (x = 'F' AND NOT y) AS o11, count(*) FILTER (x = 'F') AS r1, count(*) FILTER (NOT y) AS c1 FROM b),
g AS (SELECT *, abs(o11 - r1 * 1.0 * c1 / n) AS dif FROM t), h AS (SELECT *, (dif - least(0.5, dif)) AS g, n - r1 AS r2, n - c1 AS c2 FROM g), k AS (SELECT n, g * g * (1.0 / (r1 * 1.0 * c1 / n) + 1.0 / (r1 * 1.0 * c2 / n) + 1.0 / (r2 * 1.0 * c1 / n) + 1.0 / (r2 * 1.0 * c2 / n)) AS chi2 FROM h)
SELECT round(chi2, 6) AS chi2, 1::BIGINT AS dof, round(sqrt(chi2 / n), 6) AS v, CAST(n AS BIGINT) AS n FROM k""")
def _(s, d):
    return rounded(A.cramers_v(table(s, d, "lineitem").select("l_linestatus", (F.col("l_tax") > 0.04).alias("y")), "l_linestatus", "y"))


@query("r03_categorical_pairs")
def _(s, d):
    return rounded(A.categorical_pairs(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], 1.1))


@query("r04_eta2_lineitem", "WITH m AS (SELECT avg(l_extendedprice) AS m FROM lineitem), g AS (SELECT l_returnflag, count(*) AS k, avg(l_extendedprice) AS a FROM lineitem GROUP BY 1) SELECT round((SELECT sum(k * (a - m) * (a - m)) FROM g, m WHERE k > 1) / (SELECT sum((l_extendedprice - m) * (l_extendedprice - m)) FROM lineitem, m), 6) AS eta2, (SELECT CAST(sum(k) AS BIGINT) FROM g) AS n, (SELECT count(*) FROM g WHERE k > 1) AS n_groups")
def _(s, d):
    return rounded(A.eta_squared(table(s, d, "lineitem"), "l_returnflag", "l_extendedprice"))


@query("r04_eta2_part_size", "WITH m AS (SELECT avg(p_retailprice) AS m FROM part), g AS (SELECT p_size, count(*) AS k, avg(p_retailprice) AS a FROM part GROUP BY 1) SELECT round((SELECT sum(k * (a - m) * (a - m)) FROM g, m WHERE k > 1) / (SELECT sum((p_retailprice - m) * (p_retailprice - m)) FROM part, m), 6) AS eta2, (SELECT CAST(sum(k) AS BIGINT) FROM g) AS n, (SELECT count(*) FROM g WHERE k > 1) AS n_groups")
def _(s, d):
    return rounded(A.eta_squared(table(s, d, "part"), "p_size", "p_retailprice"))


@query("r06_strength", f"SELECT a, b, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'medium' WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'none' END AS strength FROM ({CORR})")
def _(s, d):
    return A.correlations(table(s, d, "lineitem"), LINE).select("a", "b", A.strength(F.col("r")).alias("strength"))


@query("r07_pair_advice", """WITH c AS (SELECT p_brand AS x, p_type AS y, count(*) AS o FROM part GROUP BY 1, 2), m AS (SELECT *, sum(o) OVER (PARTITION BY x) AS r, sum(o) OVER (PARTITION BY y) AS k, sum(o) OVER () AS n FROM c),
z AS (SELECT max(n) AS n, count(DISTINCT x) AS la, count(DISTINCT y) AS lb, count(*) FILTER (r * 1.0 * k / n >= 5) AS f, max(r) * 1.0 / max(n) AS ta, max(k) * 1.0 / max(n) AS tb FROM m)
SELECT CAST(n AS BIGINT) AS n, la AS levels_a, lb AS levels_b, CASE WHEN la > 50 OR lb > 50 THEN 'reduce levels' WHEN n < 100 OR (la * lb - f) * 1.0 / (la * lb) > 0.2 THEN 'fisher' ELSE 'chi2' END AS advice, greatest(ta, tb) > 0.9 AS imbalanced FROM z""")
def _(s, d):
    return A.pair_advice(table(s, d, "part"), "p_brand", "p_type")


def one_row(s, name: str, value):
    return s.createDataFrame([(name, str(value))], "name string, value string")


@query("r08_group_test")
def _(s, d):
    return one_row(s, "test", A.group_test(table(s, d, "lineitem"), "l_returnflag", "l_quantity")["test"])


@query("r09_cluster_advice", "SELECT 'method' AS name, CASE WHEN count(*) < 10 THEN 'None' WHEN count(*) > 10000 THEN 'minibatch' WHEN count(*) > 1000 THEN 'kmeans' ELSE 'hierarchical' END AS value FROM customer")
def _(s, d):
    return one_row(s, "method", A.cluster_advice(table(s, d, "customer"), ["c_acctbal"])["method"])


@query("r10_basket_advice", "SELECT 'method' AS name, CASE WHEN count(*) > 100000 THEN 'fp-growth' WHEN count(*) > 10000 THEN 'either' ELSE 'apriori' END AS value FROM part")
def _(s, d):
    return one_row(s, "method", A.basket_advice(table(s, d, "part"), ["p_brand", "p_type"])["method"])


@query("r11_suggested_queries")
def _(s, d):
    return s.createDataFrame([(q,) for q in A.suggested_queries(table(s, d, "orders"), "o_orderdate", "o_orderstatus", "o_totalprice")], "condition string")


# ---- several tables

TABLES = ("customer", "nation", "orders", "region", "supplier")


@query("j01_left_join", "SELECT o_orderkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    return M.left_join(table(s, d, "orders"), table(s, d, "customer"), [("o_custkey", "c_custkey")], "customer").select("o_orderkey", "c_name", "c_nationkey")


RELATIONS = [
    {"from_table": "customer", "from_col": "c_custkey", "to_table": "orders", "to_col": "o_custkey"}, {"from_table": "nation", "from_col": "n_nationkey", "to_table": "customer", "to_col": "c_nationkey"},
    {"from_table": "nation", "from_col": "n_regionkey", "to_table": "region", "to_col": "r_regionkey"},
]


@query("j02_star_merge", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    return M.star_merge({t: table(s, d, t) for t in TABLES}, RELATIONS, "orders").select("o_orderkey", "c_name", "n_name", "r_name")


KEYS = "SELECT (SELECT count(DISTINCT {a}) FROM {t}) AS n_a, (SELECT count(DISTINCT {b}) FROM {u}) AS n_b, (SELECT count(*) FROM (SELECT DISTINCT {a} FROM {t} INTERSECT SELECT {b} FROM {u})) AS common, (SELECT count({a}) FROM {t}) AS rows_a, (SELECT count({b}) FROM {u}) AS rows_b"


@query("j03_common_keys", KEYS.format(a="o_custkey", t="orders", b="c_custkey", u="customer"))
def _(s, d):
    return M.common_keys(table(s, d, "orders"), table(s, d, "customer"), "o_custkey", "c_custkey")


def relation_sql(t: str, a: str, u: str, b: str) -> str:
    k = KEYS.format(a=a, t=t, b=b, u=u)
    return f"SELECT '{t}' AS from_table, '{a}' AS from_col, '{u}' AS to_table, '{b}' AS to_col, CASE WHEN n_a = rows_a AND n_b = rows_b THEN 'one_to_one' WHEN n_a = rows_a THEN 'one_to_many' WHEN n_b = rows_b THEN 'many_to_one' ELSE 'many_to_many' END AS relation_type, common, round(common * 1.0 / least(n_a, n_b), 6) AS confidence FROM ({k})"


LINKS = [("customer", "c_custkey", "orders", "o_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "supplier", "s_nationkey"), ("customer", "c_acctbal", "supplier", "s_acctbal"), ("nation", "n_nationkey", "supplier", "s_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]


@query("j04_discover_by_prefix", f"SELECT * FROM ({union([relation_sql(*r) for r in LINKS])}) WHERE common > 0")
def _(s, d):
    return rounded(M.discover({t: table(s, d, t) for t in TABLES}, strip_prefix=True))


@query("j04_discover_by_name", "SELECT 'x' AS from_table, 'x' AS from_col, 'x' AS to_table, 'x' AS to_col, 'x' AS relation_type, 0::BIGINT AS common, 0.0::DOUBLE AS confidence WHERE false")
def _(s, d):
    return M.discover({t: table(s, d, t) for t in TABLES})


@query("j07_table_groups", f"""WITH RECURSIVE l AS (SELECT from_table AS a, to_table AS b FROM ({union([relation_sql(*r) for r in LINKS])}) WHERE common > 0), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT t, t FROM (VALUES {', '.join(f"('{t}')" for t in TABLES)}) v(t)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a, min(b) AS root FROM r GROUP BY 1) SELECT string_agg(a, ',' ORDER BY a) AS tables FROM g GROUP BY root""")
def _(s, d):
    """Tables that relations found between their values connect."""
    found = M.discover({t: table(s, d, t) for t in TABLES}, strip_prefix=True).collect()
    return s.createDataFrame([(",".join(g),) for g in M.groups(list(TABLES), [r.asDict() for r in found])], "tables string")


@query("j09_join_on_id", "SELECT d.doc_id, quality, toxic, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("doc_id", "quality", "toxic", "n_chars")


@query("j11_merged_types", f"""SELECT "column", CASE WHEN regexp_matches("column", '(^|_)(id|code|key)(_|$)') THEN 'identifier' ELSE semantic_type END AS semantic_type FROM ({profile_sql('orders')} UNION ALL {profile_sql('events')})""")
def _(s, d):
    """Types of the columns of two tables, each by its own values, as a merged table would have them."""
    merged = M.merged_types({t: {r["column"]: r["semantic_type"] for r in P.profile(table(s, d, t)).collect()} for t in ("orders", "events")})
    return s.createDataFrame(list(merged.items()), "column string, semantic_type string")


@query("s09_semi_sample", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _(s, d):
    return M.semi_sample(table(s, d, "lineitem"), table(s, d, "orders").where("o_orderstatus = 'P'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("s10_sampled_tables")
def _(s, d):
    out = M.sampled({t: table(s, d, t) for t in ("orders", "customer", "nation")}, RELATIONS[:2], 100, "c_custkey")
    return s.createDataFrame([(k, v.count()) for k, v in sorted(out.items())], "table string, n long")


# ---- rules

PLANTED = "SELECT l_orderkey, l_linenumber, l_quantity AS a, CAST(l_suppkey % 50 AS DOUBLE) AS b, CASE WHEN l_partkey % 50 = 0 THEN l_quantity + l_suppkey % 50 + 50 ELSE l_quantity + l_suppkey % 50 END AS c, CASE WHEN l_suppkey % 9 = 0 THEN l_tax ELSE l_discount END AS twin, l_discount FROM lineitem"


def planted(s, d):
    other = (F.col("l_suppkey") % 50).cast("double")
    total = F.col("l_quantity") + other
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), other.alias("b"), F.when(F.col("l_partkey") % 50 == 0, total + 50).otherwise(total).alias("c"), F.when(F.col("l_suppkey") % 9 == 0, F.col("l_tax")).otherwise(F.col("l_discount")).alias("twin"), "l_discount")


@query("u02_equalities", f"SELECT 'twin' AS a, 'l_discount' AS b, count(*) AS common, count(*) FILTER (abs(twin - l_discount) < 1e-6) AS equal, round(count(*) FILTER (abs(twin - l_discount) < 1e-6) * 1.0 / count(*), 6) AS confidence, true AS strong FROM ({PLANTED})")
def _(s, d):
    return rounded(U.equalities(planted(s, d), ["a", "b", "twin", "l_discount"]))


GAP = "SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS event_type, CASE WHEN user_id < 40 THEN NULL ELSE value END AS value, ts FROM events"


@query("u03_null_patterns", f"SELECT concat(CASE WHEN event_type IS NULL THEN '0' ELSE '1' END, CASE WHEN value IS NULL THEN '0' ELSE '1' END, '1') AS pattern, count(*) AS n FROM ({GAP}) GROUP BY 1")
def _(s, d):
    from tallyloom.plans.profiling import with_gaps

    return U.null_patterns(with_gaps(s, d), ["event_type", "value", "ts"])


@query("u04_column_clusters", "SELECT * FROM (VALUES ('p_retailprice,twin'), ('p_size')) t(columns)")
def _(s, d):
    return s.createDataFrame([(",".join(c),) for c in U.column_clusters(twins(s, d), ["p_retailprice", "twin", "p_size"])], "columns string")


@query("u05_cooccurrence", union([f"SELECT '{a}' AS a, '{b}' AS b, CAST(count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n FROM ({GAP})" for a, b in combinations(("event_type", "value", "ts"), 2)]))
def _(s, d):
    from tallyloom.plans.profiling import with_gaps

    return U.cooccurrence(with_gaps(s, d), ["event_type", "value", "ts"])


@query("u06_sums_planted", f"SELECT 'b + a = c' AS rule, count(*) AS valid_rows, count(*) FILTER (abs(a + b - c) / greatest(1, a + b, c) < 1e-4) AS satisfied_rows, round(count(*) FILTER (abs(a + b - c) / greatest(1, a + b, c) < 1e-4) * 1.0 / count(*), 6) AS confidence FROM ({PLANTED})")
def _(s, d):
    # the rule's fields are written in the order of their weights' signs, so they are put in order here
    found = U.sums(planted(s, d), ["a", "b", "c"])
    return rounded(found.select(F.lit("b + a = c").alias("rule"), "valid_rows", "satisfied_rows", "confidence").where(F.array_sort(F.concat("lhs", "rhs")) == F.array(F.lit("a"), F.lit("b"), F.lit("c"))))


@query("u09_verify", f"SELECT 'a + b = c' AS rule, count(*) AS valid_rows, count(*) FILTER (abs(a + b - c) / greatest(1, a + b, c) < 1e-4) AS satisfied_rows, round(count(*) FILTER (abs(a + b - c) / greatest(1, a + b, c) < 1e-4) * 1.0 / count(*), 6) AS confidence FROM ({PLANTED})")
def _(s, d):
    return rounded(U.verify(planted(s, d), [(["a", "b"], ["c"])]).drop("lhs", "rhs"))


@query("u20_violations", f"SELECT l_orderkey, l_linenumber, 'a + b = c' AS rule, round(x, 6) AS \"left\", round(c, 6) AS \"right\", round(gap, 6) AS gap, CAST(rank AS BIGINT) AS rank, CASE WHEN gap > 0.1 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT *, row_number() OVER (ORDER BY gap DESC, l_orderkey, l_linenumber, c) AS rank FROM (SELECT l_orderkey, l_linenumber, a + b AS x, c, abs(a + b - c) / greatest(1, abs(a + b), abs(c)) AS gap FROM ({PLANTED})) WHERE gap > 1e-4) WHERE rank <= 200")
def _(s, d):
    out = U.violations(planted(s, d), ["l_orderkey", "l_linenumber", "c"], [(["a", "b"], ["c"])]).drop("c")
    return rounded(out).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


def fd_sql(t: str, cols: list[str]) -> str:
    pairs = [(a, b) for a in cols for b in cols if a != b]
    return f"SELECT * FROM ({union([f'''SELECT '{a}' AS a, '{b}' AS b, count(DISTINCT {a}) AS groups FROM {t} HAVING count(DISTINCT {a}) = (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM {t})) AND count(DISTINCT {b}) > 1''' for a, b in pairs])})"


@query("u11_dependencies_part", fd_sql("part", ["p_partkey", "p_brand", "p_type", "p_size"]))
def _(s, d):
    return U.dependencies(table(s, d, "part"), ["p_partkey", "p_brand", "p_type", "p_size"])


@query("u11_dependencies_nation", fd_sql("nation", ["n_nationkey", "n_name", "n_regionkey"]))
def _(s, d):
    return U.dependencies(table(s, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


STEPS = "SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS ordered, CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 10 = 0 THEN 5 ELSE 3 END AS INTEGER) AS paid, CAST(o_orderdate AS DATE) + CAST(CASE o_orderstatus WHEN 'F' THEN 14 ELSE 21 END AS INTEGER) AS closed FROM orders"


def steps(s, d):
    day = F.to_date("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", "o_orderstatus", day.alias("ordered"), F.date_add(day, F.when(F.col("o_orderkey") % 10 == 0, 5).otherwise(3)).alias("paid"), F.date_add(day, F.when(F.col("o_orderstatus") == "F", 14).otherwise(21)).alias("closed"))


@query("u15_day_lag", f"SELECT 'ordered' AS \"start\", 'paid' AS \"end\", 'day' AS unit, true AS ordered, false AS equal, 3::BIGINT AS lag, count(*) FILTER (datediff('day', ordered, paid) = 3) AS satisfied, count(*) AS valid, round(count(*) FILTER (datediff('day', ordered, paid) = 3) * 1.0 / count(*), 6) AS confidence FROM ({STEPS})")
def _(s, d):
    return rounded(U.lag_rule(steps(s, d), "ordered", "paid"))


CUM = "(5 * floor(datediff('day', DATE '1970-01-05', {c}) / 7.0) + least(isodow({c}), 5))"
WORK = f"CAST({CUM.format(c='paid')} - {CUM.format(c='ordered')} AS BIGINT)"


@query("u16_working_days", f"SELECT o_orderkey, {WORK} AS workdays FROM ({STEPS})")
def _(s, d):
    return steps(s, d).select("o_orderkey", U.working_days(F.col("ordered"), F.col("paid")).alias("workdays"))


@query("u17_calendar", f"SELECT o_orderkey, {WORK} - CASE WHEN DATE '1999-05-03' > ordered AND DATE '1999-05-03' <= paid THEN 1 ELSE 0 END AS workdays FROM ({STEPS})")
def _(s, d):
    cal = U.calendar(s, "1994-12-01", "2002-12-31", ["1999-05-03"])
    return U.working_days_by_calendar(steps(s, d), "ordered", "paid", cal).select("o_orderkey", "workdays")


@query("u18_shifted")
def _(s, d):
    return U.shifted(steps(s, d), "ordered", "paid", U.calendar(s, "1994-12-01", "2002-12-31"))


@query("u19_conditional_lags", f"SELECT o_orderstatus AS value, CAST(max(datediff('day', ordered, closed)) AS BIGINT) AS lag, count(*) AS satisfied, count(*) AS valid, 1.0::DOUBLE AS confidence FROM ({STEPS}) GROUP BY 1")
def _(s, d):
    return rounded(U.conditional_lags(steps(s, d), "ordered", "closed", "o_orderstatus", "day"))


@query("u14_date_rules")
def _(s, d):
    return rounded(U.date_rules(steps(s, d), ["ordered", "paid", "closed"]))


@query("u23_trimmed_fit")
def _(s, d):
    vector, n = U.trim_fit(planted(s, d), ["a", "b", "c"])
    return s.createDataFrame([(float(abs(v) / abs(vector[2])),) for v in vector], "weight double")

"""Itemsets, density, neighbours, tests of difference, summaries and models against brute force and planted truth."""

import datetime
import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.catalogue import QUERIES
from tallyloom.operators import boosting, comparison, density, itemsets, margins, neighbours, seasonal, summaries
from tallyloom.plans import learning

SF = "/root/testdata/sf0.001"


def test_itemsets_equal_counting(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [x for x in "abcdefg" if rng.random() < 0.5]) for k in range(60)] + [(60, []), (61, None)]
    flat = spark.createDataFrame([(k, x) for k, xs in rows for x in (xs or [None])] + [(0, "a"), (0, "a")], "k long, x string")
    held = {k: set() for k, _ in rows}
    for r in flat.collect():
        held[r.k] |= {r.x} - {None}
    want = {c: n for size in range(1, 8) for c in combinations("abcdefg", size) if (n := sum(set(c) <= s for s in held.values())) >= 6}
    sets = itemsets.baskets(flat, ["k"], "x")
    found = itemsets.frequent(sets, 6)
    assert {tuple(r["items"]): r.n for r in found.collect()} == want
    assert {tuple(r["items"]) for r in itemsets.closed(found).collect()} == {c for c, n in want.items() if not any(set(c) < set(e) and m == n for e, m in want.items())}
    made = {(tuple(r.antecedent), r.consequent): (r.confidence, r.lift) for r in itemsets.rules(found, 62, 0.5, 0.0).collect()}
    ruled = {(tuple(y for y in c if y != x), x): (n / want[tuple(y for y in c if y != x)], n / want[tuple(y for y in c if y != x)] * 62 / want[x,]) for c, n in want.items() if len(c) > 1 for x in c}
    assert made.keys() == {k for k, v in ruled.items() if v[0] >= 0.5} and all(made[k] == pytest.approx(ruled[k]) for k in made)
    assert itemsets.frequent(sets.where("false"), 2).count() == 0


def dbscan_by_hand(x, ids, reach, least):
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    near = far <= reach**2
    core, n = near.sum(1) >= least, len(x)
    of = [None] * n
    for i in range(n):
        if core[i] and of[i] is None:
            todo, seen = [i], {i}
            while todo:
                k = todo.pop()
                for j in np.flatnonzero(near[k] & core).tolist():
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            for j in seen:
                of[j] = min(ids[m] for m in seen)
    for i in range(n):
        if not core[i] and (c := [(far[i, j], ids[j], of[j]) for j in np.flatnonzero(near[i] & core)]):
            of[i] = min(c)[2]
    return {i: (c, bool(k)) for i, c, k in zip(ids, of, core, strict=True)}


@pytest.mark.parametrize(("d", "reach", "least", "tile"), [(2, 0.3, 5, density.TILE), (2, 0.3, 5, 4), (1, 0.05, 4, 2), (3, 0.6, 6, 8)])
def test_dbscan(spark, d, reach, least, tile):
    """Blobs, scattered rows, copies, and two crowded cells that are nearly within reach of each other; with a small tile
    cells are compared by finer and finer boxes."""
    rng = np.random.default_rng(1)
    x = np.concatenate([*(rng.normal(c, 0.25, (150, d)) for c in (0, 1.5, 3)), rng.uniform(-1, 4, (60, d)), np.repeat(rng.normal(0, 1, (3, d)), 9, 0), rng.normal(5, 0.02, (150, d)), rng.normal(5, 0.02, (150, d)) + reach * 0.95 * np.eye(d)[0]])
    ids = rng.permutation(len(x)).tolist()
    cols = [f"c{k}" for k in range(d)]
    rows = [(i, *map(float, r)) for i, r in zip(ids, x, strict=True)]
    bad = [(-1, None, *[0.0] * (d - 1)), (-2, float("nan"), *[0.0] * (d - 1)), (-3, float("inf"), *[0.0] * (d - 1))]
    df = spark.createDataFrame(rows + bad, "id long, " + ", ".join(f"{c} double" for c in cols)).withColumns({c: F.lit("x") for c in ("cell", "core", "place", "name")})
    got = {r.id: (r.cluster, r.core) for r in density.dbscan(df, "id", cols, reach, least, tile).collect()}
    assert got == dbscan_by_hand(x, ids, reach, least) | {k: (None, False) for k in (-1, -2, -3)}


def test_dbscan_query(spark):
    rows = learning.flat(spark, SF).collect()
    want = dbscan_by_hand(np.array([(r.x0, r.x1) for r in rows]), [r.vec_id for r in rows], 0.2, 5)
    assert {r.vec_id: (r.cluster, r.core) for r in QUERIES["m03_dbscan"](spark, SF).collect()} == want
    assert density.dbscan(learning.flat(spark, SF).where("false"), "vec_id", ["x0", "x1"], 0.2).count() == 0


def test_nearest(spark):
    rows = neighbours.vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), "vec_id", ["embedding"])
    asked = rows.where("id % 10 = 0")
    x = {r.id: np.array(r.v) for r in rows.collect()}
    want = {(q, i) for q in x if q % 10 == 0 for i in sorted((j for j in x if j != q), key=lambda j: (np.sqrt(((x[j] - x[q]) ** 2).sum()), j))[:10]}
    got = {(r["query"], r["id"]) for r in neighbours.nearest(rows, asked).collect()}
    assert len(got & want) / len(want) >= 0.9
    exact = neighbours.nearest(rows, asked, cells=1, block=64)  # one crowded cell, dealt out in tiles
    assert {(r["query"], r["id"]) for r in exact.collect()} == want
    assert neighbours.recall(rows, asked, neighbours.nearest(rows, asked)) == pytest.approx(len(got & want) / len(want))
    assert neighbours.nearest(rows.where("false"), asked).count() == 0


def planted(n=80, d=3, at=((0, 0, 0), (6, 0, 0), (0, 6, 0)), seed=5):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.5, (n, d)) for c in at])
    return x, np.repeat(np.arange(len(at)), n)


def same_parts(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def framed(spark, x, **more):
    rows = [(i, [float(y) for y in v], *[float(m[i]) for m in more.values()]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>" + "".join(f", {k} double" for k in more)).repartition(5, "id")


def test_neighbours_predict_and_part(spark):
    x, of = planted()
    rows = framed(spark, x, label=of)
    got = {r["query"]: r.prediction for r in neighbours.predict(rows, rows.select("id", "v"), 5).collect()}
    assert all(got[i] == of[i] for i in range(len(of)))
    means = {r["query"]: r.prediction for r in neighbours.predict(rows, rows.select("id", "v"), 5, number=True).collect()}
    assert means[0] == 0.0 and means[len(of) - 1] == 2.0
    parts = {r.id: r.cluster for r in neighbours.spectral(rows.select("id", "v"), 3, k=80, cells=1).collect()}
    right = Counter((parts[i], of[i]) for i in parts)
    assert len(parts) == len(of) and sum(n for _, n in right.most_common(3)) / len(of) > 0.95
    links = neighbours.affinities(rows.select("id", "v"), 7)
    assert links.count() <= 7 * len(of) and links.where("weight <= 0 OR weight > 1 OR src >= dst").count() == 0


def test_ks_and_chi_square(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 300).round(1), rng.normal(0.3, 1, 200).round(1)
    rows = [(float(v), 7.0, True) for v in a] + [(float(v), None, False) for v in b] + [(None, 1.0, True), (float("nan"), 1.0, False), (9.0, 9.0, None)]
    got = {r["column"]: r for r in comparison.ks(spark.createDataFrame(rows, "x double, y double, f boolean"), ["x", "y"], F.col("f")).collect()}
    every = np.concatenate([a, b])
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in every)
    assert got["x"].d == pytest.approx(d) and (got["x"].n_a, got["x"].n_b) == (300, 200)
    assert got["y"].d == pytest.approx(300 / 301)
    assert comparison.kolmogorov_sf(1.3581) == pytest.approx(0.05, abs=1e-4) and comparison.kolmogorov_sf(0.8276) == pytest.approx(0.5, abs=1e-3) and comparison.kolmogorov_sf(1.6276) == pytest.approx(0.01, abs=1e-4)
    table = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5 + [(None, "x"), ("c", None)]
    r = comparison.chi_square(spark.createDataFrame([(*t, "k") for t in table], "p string, q string, r string"), [("p", "q"), ("p", "r")]).collect()
    o = np.array([[10, 20], [30, 5]])
    e = o.sum(1)[:, None] * o.sum(0)[None] / o.sum()
    assert len(r) == 1 and r[0].chi2 == pytest.approx(((o - e) ** 2 / e).sum()) and r[0].dof == 1 and r[0].n == 65 and r[0].low == 0 and r[0].p == pytest.approx(math.erfc(math.sqrt(r[0].chi2 / 2)))


def test_birch(spark):
    x, of = planted(300)
    rows = framed(spark, x)
    got = {r.id: r.cluster for r in summaries.birch(rows, 3, most=20).collect()}
    assert same_parts([got[i] for i in range(len(of))], of.tolist())
    serial = summaries.Features(20)
    serial.add(np.ones(len(x)), x, (x**2).sum(axis=1))
    held = summaries.summarise(rows, 20, fan=2)
    for f in (held, serial):
        assert len(f.n) <= 20 and f.n.sum() == len(x)
        np.testing.assert_allclose(f.total.sum(axis=0), x.sum(axis=0))
        np.testing.assert_allclose(f.squares.sum(), (x**2).sum())
    a, b = (np.array(sorted(summaries.centres(f, 3).tolist())) for f in (held, serial))
    np.testing.assert_allclose(a, b, atol=0.2)
    assert summaries.birch(rows.where("false"), 3).count() == 0


def test_ward_against_all_merges(spark):
    rng = np.random.default_rng(8)
    x, n = rng.normal(size=(24, 2)), rng.integers(1, 6, 24)
    groups = [[i] for i in range(24)]

    def within(g):
        m = np.average(x[g], axis=0, weights=n[g])
        return (n[g] * ((x[g] - m) ** 2).sum(axis=1)).sum()

    while len(groups) > 4:
        _, i, j = min((within(a + b) - within(a) - within(b), i, j) for (i, a), (j, b) in combinations(enumerate(groups), 2))
        groups[i] += groups.pop(j)
    want = np.zeros(24, int)
    for k, g in enumerate(groups):
        want[g] = k
    assert same_parts(summaries.ward(n, x, 4).tolist(), want.tolist())
    x, of = planted(60)
    out, rated = summaries.ward_clusters(framed(spark, x), 5, most=40)
    got = {r.id: r.cluster for r in out.collect()}
    assert max(rated, key=rated.get) == 3 and same_parts([got[i] for i in range(len(of))], of.tolist())
    near = {r.cluster: r for r in summaries.cluster_profile(out, "id").collect()}
    assert {r["size"] for r in near.values()} == {60} and all(got[r.nearest] == c for c, r in near.items())


def test_adaboost(spark):
    r = QUERIES["m01_adaboost"](spark, "/root/testdata/sf0.01").first()
    assert r.accuracy > r.first + 0.1 and r.accuracy > 0.9
    x, of = planted(60)
    three = learning.features(framed(spark, x, label=of).selectExpr("id", "label", "v[0] AS a", "v[1] AS b"), ["a", "b"])
    out = boosting.adaboost(three, 10).predict(three).collect()
    assert np.mean([r.prediction == r.label for r in out]) > 0.95 and all(0 < r.confidence <= 1 for r in out)
    one = learning.features(framed(spark, x, label=np.zeros(len(of))).selectExpr("id", "label", "v[0] AS a"), ["a"])
    assert {r.prediction for r in boosting.adaboost(one).predict(one).collect()} == {0.0}


def test_svr_against_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = x @ [1.5, -2.0, 0.5] + 3 + rng.normal(0, 0.3, 200)
    made = margins.fit(framed(spark, x, label=y), epsilon=0.2, cost=1.0)
    full = np.column_stack([x, np.ones(200)])
    ridge, w = np.diag([1.0, 1.0, 1.0, 0.0]), np.zeros(4)
    for _ in range(100):  # the minimum by repeated weighted least squares over the rows outside epsilon
        off = full @ w - y
        out = np.abs(off) > 0.2
        w = np.linalg.solve(ridge + 2 * full[out].T @ full[out], 2 * full[out].T @ (y[out] + 0.2 * np.sign(off[out])))
    best = 0.5 * w[:3] @ w[:3] + (np.maximum(0, np.abs(full @ w - y) - 0.2) ** 2).sum()
    assert made.loss <= 1.01 * best
    got = {r.id: r.prediction for r in made.predict(framed(spark, x)).collect()}
    np.testing.assert_allclose([got[i] for i in range(200)], x @ made.weights + made.shift)


def test_sarima(spark):
    rng = np.random.default_rng(6)
    e, w = rng.normal(0, 1, 900), np.zeros(900)
    for t in range(8, 900):
        w[t] = 0.5 * w[t - 1] + 0.4 * w[t - 7] - 0.2 * w[t - 8] + e[t] + 0.3 * e[t - 1]
    made = seasonal.fit(w[100:] + 50, (1, 0, 1), (1, 0, 0, 7))
    ar, ma, sar, _ = made.parts()
    assert ar[0] == pytest.approx(0.5, abs=0.12) and ma[0] == pytest.approx(0.3, abs=0.15) and sar[0] == pytest.approx(0.4, abs=0.1) and made.variance == pytest.approx(1, abs=0.15)
    # differences of both kinds are undone: a line and a week's pattern go on
    y = np.arange(70) * 2.0 + np.tile([0, 5, 1, 0, 3, 9, 2], 10)
    np.testing.assert_allclose(seasonal.forecast(y, seasonal.fit(y, (0, 0, 0), (0, 1, 0, 7)), 14), np.tile(y[-7:], 2))
    for order, season in (((0, 1, 0), (0, 1, 0, 7)), ((0, 1, 0), (0, 2, 0, 7)), ((0, 2, 0), (0, 1, 0, 7))):
        np.testing.assert_allclose(seasonal.forecast(y, seasonal.fit(y, order, season), 14), np.arange(70, 84) * 2.0 + np.tile([0, 5, 1, 0, 3, 9, 2], 2), atol=1e-6)
    start = datetime.datetime(2024, 1, 1)
    rows = [("a", start + datetime.timedelta(days=k), float(v)) for k, v in enumerate(y) if k not in (10, 11, 30)] + [("b", start, 1.0)]
    s = spark.createDataFrame(rows, "entity string, date timestamp, value double")
    out = seasonal.sarima_forecast(s, (0, 0, 0), (0, 1, 0, 7), 7).collect()
    assert len(out) == 7 and {r.filled for r in out} == {3}
    assert [r.forecast for r in sorted(out, key=lambda r: r.k)] == pytest.approx(y[-7:].tolist())
    assert {r.entity for r in seasonal.sarima_fits(s, (1, 0, 0), (1, 0, 0, 7)).collect()} == {"a"}


def test_reports_and_importances(spark):
    from tallyloom.operators import models, reports

    rows = [(i, float(i % 7) if i % 3 else None, "a" if i % 20 else "b", 5.0 if i % 10 else 500.0) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, x double, g string, y double").withColumn("z", F.col("x") * 2)
    report = reports.table_report(df)
    got = {(r.section, r["item"]): r["value"] for r in report.collect()}
    assert got["overview", "rows"] == "200" and got["alerts", "x"] == "missing 33.5 %" and got["imbalanced", "g"] == "a 95.0 %"
    said = reports.markdown(report, "T").split("\n")
    assert said[0] == "# T" and said[2] == "## Overview" and "## Alerts" in said and "- rows: 200" in said
    asked = [(r.scene, r.section, r.question) for r in reports.questions(report).collect()]
    assert ("quality", "alerts", "What should be done about x (missing 33.5 %)?") in asked and len({a[0] for a in asked}) >= 5
    assert reports.text_report(spark.createDataFrame([(1, "The harbour is good. The sea is bad."), (2, None)], "doc_id long, text string")).where("section = 'overview'").count() > 3
    model = models.train(df.na.drop().withColumn("t", F.col("y") * 3.0), "regression", "tree", ["x", "y", "g"], "t")
    names = [n for n, _ in models.named_importances(model, df)]
    assert names[0].split("=")[0] == "y" and {n.split("=")[0] for n in names} == {"x", "y", "g"}


def test_rule_passes_and_classes(spark):
    from tallyloom.operators import rules, text

    found = rules.sums_in_passes(learning.identities(spark, SF), list("abcdef"), 0.99).collect()
    assert {tuple(sorted(r.lhs + r.rhs)) for r in found if len(r.lhs + r.rhs) == 3} == {("a", "b", "c"), ("d", "e", "f")}
    base = [f"word{k}" for k in range(40)]
    docs = [(i, " ".join(base[:i] + base[i + 1 :])) for i in range(30)] + [(100, " ".join(base[1:])), (200, "quite another text with its own words")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in text.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[200] == (200, 0) and all(got[i] == (0, 30) for i in [*range(30), 100])

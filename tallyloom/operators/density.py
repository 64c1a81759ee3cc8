"""Density clusters (DBSCAN) over grid cells, exactly, without comparing all pairs of a crowded cell.

Cells are so narrow that all of a cell's rows are within reach of each other: a cell with enough rows is dense, and its
rows are core rows, with no comparison. Rows of other cells are few a cell; what their neighbour cells hold counts whole
where the cell's box is within reach, not at all where it is beyond, and row by row otherwise. Two cells of core rows are
linked by their boxes where these decide; else by their rows where these are few; else by the boxes of finer cells, and so
on. Linked cells make clusters. Equal places are one row with a count, so copies cost nothing.

Work is in equi-joins by cell, whose hot cells adaptive execution can split; a row of a cell with few rows meets its
neighbour cells only.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tables import settle
from tallyloom.operators.graph import components

#: Pairs of rows that two cells may have to be compared row by row; cells a side that a finer grid makes of one.
TILE, FINER = 1 << 16, 8
MOST_COLUMNS = 4


def _offsets(d: int) -> list[tuple[int, ...]]:
    """Steps to the cells that may hold a row within reach."""
    m = ceil(sqrt(d))
    return [o for o in product(range(-m, m + 1), repeat=d) if any(o) and sum(max(0, abs(x) - 1) ** 2 for x in o) <= d]


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _box(d: int, prefix: str = "") -> list[Column]:
    return [f(f"x{i}").alias(f"{prefix}{n}{i}") for i in range(d) for n, f in (("lo", F.min), ("hi", F.max))]


def _least(d: int, a: str = "a_", b: str = "b_") -> Column:
    """Least squared distance of two boxes; a point is a box of no width."""
    return _sum([F.pow(F.greatest(F.lit(0.0), F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}"), F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}")), 2) for i in range(d)])


def _most(d: int, a: str = "a_", b: str = "b_") -> Column:
    return _sum([F.pow(F.greatest(F.col(f"{b}hi{i}") - F.col(f"{a}lo{i}"), F.col(f"{a}hi{i}") - F.col(f"{b}lo{i}")), 2) for i in range(d)])


def _as_box(df: DataFrame, d: int, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{n}{i}": F.col(f"x{i}") for i in range(d) for n in ("lo", "hi")})


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _around(cells: DataFrame, offsets: list[tuple[int, ...]]) -> DataFrame:
    """cells (cell, ...) with `other`, each cell a step away."""
    steps = F.array(*[F.array(*map(F.lit, o)) for o in offsets])
    return cells.withColumn("step", F.explode(steps)).withColumn("other", F.zip_with("cell", "step", lambda x, y: x + y)).drop("step")


def _cell(d: int, side: float) -> Column:
    return F.array(*[F.floor(F.col(f"x{i}") / side) for i in range(d)])


def _links(cores: DataFrame, d: int, side: float, reach: float, tile: int, finer: int) -> DataFrame:
    """(src, dst) of cells, by name, that hold core rows within reach of each other. cores: name, cell, x0 .."""
    boxes = settle(cores.groupBy("name", "cell").agg(F.count("*").alias("rows"), *_box(d)))
    ahead = [o for o in _offsets(d) if o > (0,) * d]
    pairs = _prefixed(_around(boxes, ahead), "a_").join(_prefixed(boxes, "b_"), F.col("a_other") == F.col("b_cell"))
    found, level = None, 0
    while True:
        rated = settle(pairs.withColumns({"least": _least(d), "most": _most(d)}).where(F.col("least") <= reach**2))
        sure = rated.where(F.col("most") <= reach**2).select(F.col("a_name").alias("src"), F.col("b_name").alias("dst"))
        unsure = rated.where(F.col("most") > reach**2)
        few = unsure.where(F.col("a_rows") * F.col("b_rows") <= tile)
        at = cores.withColumn("cell", _cell(d, side / finer**level)).select("name", "cell", *[f"x{i}" for i in range(d)])
        apart = _sum([F.pow(F.col(f"p_x{i}") - F.col(f"q_x{i}"), 2) for i in range(d)])
        # both cells' rows, by the finer cells they are in
        met = few.select("a_name", "a_cell", "b_name", "b_cell").join(_prefixed(at, "p_"), (F.col("a_name") == F.col("p_name")) & (F.col("a_cell") == F.col("p_cell")))
        met = met.join(_prefixed(at, "q_"), (F.col("b_name") == F.col("q_name")) & (F.col("b_cell") == F.col("q_cell")) & (apart <= reach**2))
        new = sure.unionByName(met.select(F.col("a_name").alias("src"), F.col("b_name").alias("dst"))).distinct()
        found = settle(new if found is None else found.unionByName(new).distinct())
        many = unsure.where(F.col("a_rows") * F.col("b_rows") > tile).select("a_name", "a_cell", "b_name", "b_cell").join(found, (F.col("a_name") == F.col("src")) & (F.col("b_name") == F.col("dst")), "left_anti")
        if many.isEmpty():
            return found
        level += 1
        whole = many.select(F.explode(F.array(F.struct(F.col("a_name").alias("name"), F.col("a_cell").alias("above")), F.struct(F.col("b_name").alias("name"), F.col("b_cell").alias("above")))).alias("u")).select("u.*").distinct()
        inside = cores.withColumn("above", _cell(d, side / finer ** (level - 1))).join(whole, ["name", "above"]).withColumn("cell", _cell(d, side / finer**level))
        smaller = settle(inside.groupBy("name", "above", "cell").agg(F.count("*").alias("rows"), *_box(d)))
        one = _prefixed(smaller, "a_").withColumnRenamed("a_above", "up_a").withColumnRenamed("a_name", "own_a")
        two = _prefixed(smaller, "b_").withColumnRenamed("b_above", "up_b").withColumnRenamed("b_name", "own_b")
        pairs = many.withColumnsRenamed({"a_cell": "was_a", "b_cell": "was_b"}).join(one, (F.col("a_name") == F.col("own_a")) & (F.col("was_a") == F.col("up_a"))).join(two, (F.col("b_name") == F.col("own_b")) & (F.col("was_b") == F.col("up_b")))


def dbscan(df: DataFrame, key: str, cols: list[str], reach: float, least: int = 5, tile: int = TILE, finer: int = FINER) -> DataFrame:
    """(key, cluster, core): cluster is the least key of the core rows of a row's cluster, null for noise.

    A core row has `least` rows or more within reach, itself included. A row that is no core row belongs to the nearest
    core row within reach, the least key among equally near ones. Rows with a null, NaN or infinite value are noise.
    """
    d = len(cols)
    if not 1 <= d <= MOST_COLUMNS:
        raise ValueError(f"1 to {MOST_COLUMNS} columns: reduce others first")
    side = reach / sqrt(d) * (1 - 1e-9)
    xs = [f"x{i}" for i in range(d)]
    rows = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(x) for c, x in zip(cols, xs, strict=True)])
    finite = reduce(lambda a, b: a & b, [F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) for x in xs])
    good = rows.where(finite)
    places = settle(good.groupBy(*xs).agg(F.count("*").alias("n"), F.min("key").alias("id")).withColumn("cell", _cell(d, side)).withColumn("place", F.xxhash64(*xs)))
    cells = settle(places.groupBy("cell").agg(F.sum("n").alias("held"), *_box(d)))
    thin = cells.where(F.col("held") < least)
    near = settle(_around(thin.select("cell", F.col("held").alias("own")), _offsets(d)).join(_prefixed(cells, "b_"), F.col("other") == F.col("b_cell")).drop("b_cell"))
    loose = places.join(thin.select("cell", F.col("held").alias("own")), "cell")
    beside = _as_box(loose.select("cell", *xs), d, "a_").join(near, "cell").where(_least(d) <= reach**2)
    known = beside.groupBy(*xs).agg(F.sum(F.when(_most(d) <= reach**2, F.col("b_held")).otherwise(0)).alias("more"))
    counted = settle(loose.join(known, xs, "left").withColumn("sure", F.col("own") + F.coalesce("more", F.lit(0))))
    apart = _sum([F.pow(F.col(x) - F.col(f"q_{x}"), 2) for x in xs])
    short = _as_box(counted.where(F.col("sure") < least).select("cell", *xs), d, "a_").join(near.drop("own"), "cell").where((_least(d) <= reach**2) & (_most(d) > reach**2))
    others = short.join(_prefixed(places.select("cell", "n", *xs), "q_"), (F.col("other") == F.col("q_cell")) & (apart <= reach**2)).groupBy(*xs).agg(F.sum("q_n").alias("others"))
    full = counted.join(others, xs, "left").withColumn("core", F.col("sure") + F.coalesce("others", F.lit(0)) >= least)
    marked = settle(places.join(cells.where(F.col("held") >= least).select("cell"), "cell", "left_semi").withColumn("core", F.lit(True)).unionByName(full.select(*places.columns, "core")))

    cores = settle(marked.where("core").join(marked.where("core").groupBy("cell").agg(F.min("id").alias("name")), "cell").select("id", "name", "cell", *xs))
    roots = components(_links(cores, d, side, reach, tile, finer)).withColumnRenamed("id", "name")
    named = settle(cores.join(roots, "name", "left").select("id", "cell", *xs, F.coalesce("component", "name").alias("cluster")))

    rim = marked.where(~F.col("core")).select("cell", *xs)
    boxes = named.groupBy("cell").agg(*_box(d))
    reached = _around(rim.select("cell").distinct(), [(0,) * d, *_offsets(d)]).join(_prefixed(boxes, "b_"), F.col("other") == F.col("b_cell")).drop("b_cell")
    close = _as_box(rim, d, "a_").join(reached, "cell").where(_least(d) <= reach**2).select("other", *xs)
    best = close.join(_prefixed(named, "q_"), (F.col("other") == F.col("q_cell")) & (apart <= reach**2)).groupBy(*xs).agg(F.min(F.struct(apart.alias("far"), "q_id", "q_cluster")).alias("to"))
    labels = named.select(*xs, "cluster", F.lit(True).alias("core")).unionByName(best.select(*xs, F.col("to.q_cluster").alias("cluster"), F.lit(False).alias("core")))
    out = good.join(labels, xs, "left").unionByName(rows.where(~finite).withColumns({"cluster": F.lit(None).cast(labels.schema["cluster"].dataType), "core": F.lit(False)}))
    return out.select(F.col("key").alias(key), "cluster", F.coalesce("core", F.lit(False)).alias("core"))

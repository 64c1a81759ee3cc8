"""Graphs of entities as vertex and edge tables: ranks, communities, components, paths, chains."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.tables import settle


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of (src, dst, weight), loops left out, weights of parallel edges added."""
    w = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    both = w.select("src", "dst", "weight").unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def nodes_and_links(entities: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, kind, n) of (doc_id, kind, entity), and undirected links (src, dst, weight) of counted pairs."""
    nodes = entities.groupBy(F.col("entity").alias("id")).agg(F.min("kind").alias("kind"), F.count("*").alias("n"))
    links = pairs.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("n").alias("weight")).where("src <> dst")
    return nodes, links


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank) on the undirected weighted graph; ranks sum to 1."""
    e = settle(undirected(edges))
    out = e.groupBy("src").agg(F.sum("weight").alias("out"))
    share = settle(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p")))
    n = out.count()
    rank = settle(out.select(F.col("src").alias("id"), F.lit(1.0 / max(1, n)).alias("rank")))
    for _ in range(rounds):
        got = share.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        both = settle(rank.join(got, "id", "left").select("id", F.col("rank").alias("was"), (F.lit((1 - damping) / max(1, n)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
        moved = both.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
        rank = both.select("id", "rank")
        if moved < tolerance:
            break
    return rank


def components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id, component): the least id that can be reached. Labels are followed from label to label, so rounds grow with the
    logarithm of the longest path; if they should run out, that is an error and no result."""
    e = settle(undirected(edges).select("src", "dst"))
    label = settle(e.groupBy(F.col("src").alias("id")).agg(F.least("src", F.min("dst")).alias("component")))
    for _ in range(rounds):
        near = e.join(label.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        low = label.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        jump = label.select(F.col("id").alias("low"), F.col("component").alias("far"))
        new = settle(low.join(jump, "low", "left").select("id", "was", F.least("low", F.coalesce("far", "low")).alias("component")))
        changed = new.where("was <> component").limit(1).count()
        label = new.select("id", "component")
        if not changed:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, community) by label propagation: each vertex takes the label of most weight around it, the least among
    equals; every other round only half of the vertices move, so that two labels do not swap for ever."""
    e = settle(undirected(edges))
    label = settle(e.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")))
    for k in range(rounds):
        votes = e.join(label.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("community").alias("community"))).alias("top")).select("id", F.col("top.community").alias("new"))
        moves = F.pmod(F.xxhash64("id"), F.lit(2)) == k % 2
        label = settle(label.join(best, "id").select("id", F.when(moves, F.col("new")).otherwise(F.col("community")).alias("community")))
    return label


def neighbours(edges: DataFrame, node) -> DataFrame:
    return undirected(edges).where(F.col("src") == F.lit(node)).select(F.col("dst").alias("id"), "weight")


def shortest_path(edges: DataFrame, start, end, most: int | None = None) -> list | None:
    """A path with the fewest edges, by levels, of at most so many edges if that is asked; None where there is none. Each
    level is one join against the frontier; levels go on until they reach the end or nothing new."""
    e = settle(undirected(edges).select("src", "dst"))
    spark = edges.sparkSession
    kind = e.schema["src"].dataType
    level = settle(spark.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(None).cast(kind).alias("via")))
    seen, trail = level, [level]
    while most is None or len(trail) <= most + 1:
        if level.where(F.col("id") == F.lit(end)).count():
            path = [end]
            for step in reversed(trail[1:]):
                path.append(step.where(F.col("id") == F.lit(path[-1])).first()["via"])
            return path[::-1]
        step = e.join(level.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("via"))
        level = settle(step.join(seen.select("id"), "id", "left_anti"))
        if not level.limit(1).count():
            return None
        seen = settle(seen.unionByName(level))
        trail.append(level)
    return None


#: Edges, in both directions, that are sent to every task: 16 bytes each there.
MOST_EDGES = 4_000_000


def betweenness(edges: DataFrame, sources: int = 500, most_edges: int = MOST_EDGES) -> DataFrame:
    """(id, betweenness) by Brandes' method. Above 500 vertices, `sources` of them, least by checksum, stand for all (give
    their number for the exact value). Sources are dealt out over tasks and their shares added up; each task holds the
    edges, so graphs of more than `most_edges` of them are refused."""
    spark = edges.sparkSession
    e = settle(undirected(edges).select("src", "dst"))
    if (k := e.count()) > most_edges:
        raise ValueError(f"{k} edges are too many to send to every task")
    kind = e.schema["src"].dataType.simpleString()
    around: dict = defaultdict(list)
    for r in e.orderBy("src", "dst").toLocalIterator():
        around[r["src"]].append(r["dst"])
    names = sorted(around)
    if not (n := len(names)):
        return spark.createDataFrame([], f"id {kind}, betweenness double")
    some = names if n <= 500 else sorted(names, key=lambda v: (zlib.crc32(str(v).encode()), str(v)))[:sources]
    number = {v: i for i, v in enumerate(names)}
    sent = spark.sparkContext.broadcast([[number[w] for w in around[v]] for v in names])

    def shares(batches):
        near = sent.value
        total = np.zeros(n)
        for pdf in batches:
            for s in pdf["source"]:
                _brandes(near, int(s), total)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"number": at, "share": total[at]})

    started = spark.createDataFrame([(number[v],) for v in some], "source long").repartition(min(len(some), 4 * spark.sparkContext.defaultParallelism))
    scale = (n / len(some)) / max(1.0, (n - 1) * (n - 2))
    summed = started.mapInPandas(shares, "number long, share double").groupBy("number").agg((F.sum("share") * scale).alias("betweenness"))
    ids = spark.createDataFrame(list(enumerate(names)), f"number long, id {kind}")
    return ids.join(summed, "number", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _brandes(near: list[list[int]], s: int, total: np.ndarray) -> None:
    """Adds to total what shortest paths from s give each vertex."""
    order, before, paths, far = [], defaultdict(list), defaultdict(float), {s: 0}
    paths[s] = 1.0
    queue = deque([s])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near[v]:
            if w not in far:
                far[w] = far[v] + 1
                queue.append(w)
            if far[w] == far[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    gain: dict[int, float] = defaultdict(float)
    for w in reversed(order):
        for v in before[w]:
            gain[v] += paths[v] / paths[w] * (1 + gain[w])
        if w != s:
            total[w] += gain[w]


def chains(events: DataFrame, entity: str, year: str, gap: int = 2) -> DataFrame:
    """Events of an entity in chains: a gap of more than so many years starts a new one."""
    w = Window.partitionBy(entity).orderBy(year)
    new = F.coalesce((F.col(year) - F.lag(year).over(w) > gap).cast("int"), F.lit(0))
    return events.withColumn("_new", new).withColumn("chain", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_entities(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (name, kind, attribute, value, time) under one name each, with distinct attributes, and relations
    (src, dst, predicate, confidence) with the best confidence of each."""
    name = F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))
    known = F.when(F.col("kind").isNotNull() & (F.col("kind") != "other"), F.col("kind"))
    one = entities.withColumn("key", name).groupBy("key").agg(F.min("name").alias("name"), F.coalesce(F.min(known), F.lit("other")).alias("kind"), F.array_sort(F.collect_set(F.struct("attribute", "value", "time"))).alias("attributes"))
    tidy = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    links = relations.groupBy(tidy("src").alias("src"), tidy("dst").alias("dst"), "predicate").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    return one, links


def hierarchy(themes: DataFrame) -> DataFrame:
    """(id, path, depth) of (id, parent): parents are followed level by level to the deepest; what lies on a cycle is left
    out."""
    done = themes.where("parent IS NULL").select("id", F.array("id").alias("path"), F.lit(0).alias("depth"))
    level = done
    for k in count(1):
        below = themes.join(level.select(F.col("id").alias("parent"), F.col("path").alias("up")), "parent").where(~F.array_contains("up", F.col("id")))
        level = settle(below.select("id", F.concat("up", F.array("id")).alias("path"), F.lit(k).alias("depth")))
        if not level.limit(1).count():
            break
        done = done.unionByName(level)
    return done

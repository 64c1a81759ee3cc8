"""Rules that rows keep: equalities, sums, dependencies, dates and working days; and the rows that break them."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import columns as C
from tallyloom.functions.mathx import smallest_direction

TOLERANCE = 1e-4
MONDAY = "1970-01-05"


def add(cols: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).cast("double") for c in cols])


def there(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def holds(left: list[str], right: list[str], tolerance: float = TOLERANCE) -> Column:
    """Both sums agree, relative to the larger; null where a field is missing."""
    x, y = add(left), add(right)
    return F.when(there(left + right), F.abs(x - y) / F.greatest(F.lit(1.0), F.abs(x), F.abs(y)) < tolerance)


def usable(df: DataFrame, cols: list[str], least: int = 10, share: float = 0.01) -> list[str]:
    """Columns with enough values to look for rules in."""
    r = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in cols]).first()
    return [c for c in cols if r[c] >= least or (r["_n"] and r[c] / r["_n"] >= share)]


def equalities(df: DataFrame, cols: list[str], least: int = 5, share: float = 0.8) -> DataFrame:
    """(a, b, common, equal, confidence) of column pairs that are mostly equal. All pairs are aggregates of one pass."""
    pairs = list(combinations(cols, 2))
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(there([a, b])).alias("common"), F.count_if(there([a, b]) & (F.abs(F.col(a).cast("double") - F.col(b)) < 1e-6)).alias("equal"), F.count(a).alias("na"), F.count(b).alias("nb")) for a, b in pairs])
    flat = df.agg(cells.alias("x")).select(F.explode("x").alias("x")).select("x.*")
    kept = flat.where((F.col("common") >= least)).withColumn("confidence", F.col("equal") / F.col("common")).where(F.col("confidence") >= share)
    return kept.withColumn("strong", F.col("common") >= 0.8 * F.greatest("na", "nb")).drop("na", "nb")


def null_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """(pattern, n): which columns are there, as a string of 0 and 1 in column order; few however many rows."""
    return df.groupBy(F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in cols]).alias("pattern")).agg(F.count("*").alias("n"))


def pattern_clusters(df: DataFrame, cols: list[str], least: float = 0.99) -> list[list[str]]:
    """Null patterns whose presence vectors, weighted against common columns, point the same way."""
    rows = null_patterns(df, cols).collect()
    total = sum(r["n"] for r in rows)
    seen = np.array([sum(r["n"] for r in rows if r["pattern"][i] == "1") for i in range(len(cols))])
    weight = np.log((total + 1) / (seen + 1)) ** 3 + 1e-9
    out: list[tuple[np.ndarray, list[str]]] = []
    for r in sorted(rows, key=lambda r: (-r["n"], r["pattern"])):
        v = np.array([int(x) for x in r["pattern"]]) * weight
        v = v / (np.linalg.norm(v) or 1)
        if (near := next((g for g in out if g[0] @ v > least), None)) is not None:
            near[1].append(r["pattern"])
        else:
            out.append((v, [r["pattern"]]))
    return [g[1] for g in out]


def connected(names: list[str], links: list[tuple[str, str]]) -> list[list[str]]:
    root = {n: n for n in names}
    for a, b in links:
        x, y = a, b
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
    out: dict[str, list[str]] = {}
    for n in names:
        x = n
        while root[x] != x:
            x = root[x]
        out.setdefault(x, []).append(n)
    return list(out.values())


def column_clusters(df: DataFrame, cols: list[str], least: float = 0.3) -> list[list[str]]:
    """Columns that correlations connect."""
    from tallyloom.operators.association import correlations

    return connected(cols, [(r["a"], r["b"]) for r in correlations(df, cols).where(F.abs("r") > least).collect()])


def cooccurrence(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, n): rows in which both columns are there; counted by pattern first."""
    p = null_patterns(df, cols)
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), ((F.substring("pattern", i + 1, 1) == "1") & (F.substring("pattern", j + 1, 1) == "1")).alias("hit")) for (i, a), (j, b) in combinations(enumerate(cols), 2)])
    return p.select("n", F.explode(cells).alias("x")).groupBy("x.a", "x.b").agg(F.coalesce(F.sum(F.when(F.col("x.hit"), F.col("n"))), F.lit(0)).alias("n"))


def moments(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, int]:
    """Sample covariance of the columns over rows where all are there, in one aggregate."""
    held = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    r = held.agg(F.count("*").alias("n"), *[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] or 0.0
    return cov, r["n"]


def signs(vector: np.ndarray, cols: list[str], same: float = 0.5) -> tuple[list[str], list[str]] | None:
    """Two sides of fields whose weights are about equal in size; the smaller side is the sum."""
    size = np.abs(vector)
    big = size >= same * size.max()
    if big.sum() < 3:
        return None
    up = [c for c, v, b in zip(cols, vector, big, strict=True) if b and v > 0]
    down = [c for c, v, b in zip(cols, vector, big, strict=True) if b and v < 0]
    return (max(up, down, key=len), min(up, down, key=len)) if up and down else None


def sums(df: DataFrame, cols: list[str], confidence: float = 0.5) -> DataFrame:
    """Sums of fields that equal a field or a sum of others: the least direction of the covariance gives a candidate;
    the field of least weight goes and the next is tried, until three are left; then all candidates are held against all
    rows in one pass. The covariance is computed once; only matrices of a row a column are on the driver. Rows that break a
    rule bend the covariance, so directions of small parts of a bounded sample (robust_sums) are candidates too."""
    cols = usable(df, cols)
    seen: dict[frozenset, tuple[list[str], list[str]]] = {}
    # a small part of a sum may correlate with nothing: only wide tables are split by correlation
    for group in [cols] if len(cols) <= 12 else column_clusters(df, cols):
        if len(group) < 3:
            continue
        cov, n = moments(df, group)
        if n < 10:
            continue
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-300))
        trials = [list(range(len(group)))]
        while trials:
            left = trials.pop()
            while len(left) >= 3:
                _, v = smallest_direction(cov[np.ix_(left, left)])
                if (rule := signs(v, [group[i] for i in left])) and frozenset(rule[0] + rule[1]) not in seen:
                    seen[frozenset(rule[0] + rule[1])] = rule
                left = [i for k, i in enumerate(left) if k != int(np.argmin(np.abs(v) * scale[left]))]
        for rule in robust_sums(df, group):
            seen.setdefault(frozenset(rule[0] + rule[1]), rule)
        if len(group) <= 12:  # small groups: every three fields
            for three in combinations(range(len(group)), 3):
                _, v = smallest_direction(cov[np.ix_(three, three)])
                if rule := signs(v, [group[i] for i in three]):
                    seen.setdefault(frozenset(rule[0] + rule[1]), rule)
    return verify(df, list(seen.values())).where(F.col("confidence") >= confidence)


def sums_in_passes(df: DataFrame, cols: list[str], confidence: float = 0.5, most: int = 3) -> DataFrame:
    """sums(), and then again over the fields that are in none of the rules found, which another identity may have hidden;
    with the number of the pass. A pass that finds nothing is the last."""
    out, left, known = None, list(cols), set()
    for k in range(1, most + 1):
        if len(left) < 3:
            break
        found = distinct_rules(sums(df, left, confidence)).withColumn("pass", F.lit(k))
        rows = found.collect()
        if not rows:
            break
        found = df.sparkSession.createDataFrame(rows, found.schema)
        out = found if out is None else out.unionByName(found)
        known |= {f for r in rows for f in [*r["lhs"], *r["rhs"]]}
        left = [c for c in left if c not in known]
    return out if out is not None else verify(df, []).withColumn("pass", F.lit(0))


def distinct_rules(rules: DataFrame) -> DataFrame:
    """One rule for each set of fields: the most satisfied, then the first by name."""
    fields = F.array_sort(F.concat("lhs", "rhs"))
    order = Window.partitionBy(fields).orderBy(F.desc("satisfied_rows"), "rule")
    return rules.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


#: Rows of the sample that candidates for sums with exceptions come from, trials, rows a trial, and the share of the sample
#: that a candidate must hold for.
SAMPLE, TRIALS, TRIAL_ROWS, INLIERS = 2000, 20, 20, 0.5


def robust_sums(df: DataFrame, cols: list[str], seed: int = 42) -> list[tuple[list[str], list[str]]]:
    """Candidates for sums that hold for half of the rows or more: the least direction of a few random rows of a sample
    (least by hash), for all columns and then without the one of least weight until three are left. A trial of three rows
    more than columns has a fair chance to hit none that breaks the rule; sums are held against all rows later."""
    held = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    x = np.array([list(r) for r in held.orderBy(F.xxhash64(*cols, F.lit(seed)), *cols).limit(SAMPLE).collect()], dtype=float).reshape(-1, len(cols))
    if len(x) < 10:
        return []
    rng, out = np.random.default_rng(seed), {}
    for trial in range(TRIALS * 4):
        left = list(range(len(cols)))
        while len(left) >= 3:
            # few rows for few columns, so that a trial without exceptions is likely
            size = min(len(x), TRIAL_ROWS if trial % 2 else len(left) + 2)
            some = x[rng.choice(len(x), size, replace=False)][:, left]
            direction = np.linalg.svd(some - some.mean(axis=0), full_matrices=False)[2][-1]
            if rule := signs(direction, [cols[i] for i in left]):
                a, b = (x[:, [cols.index(c) for c in side]].sum(axis=1) for side in rule)
                if np.mean(np.abs(a - b) / np.maximum(1.0, np.maximum(np.abs(a), np.abs(b))) < TOLERANCE) >= INLIERS:
                    out[frozenset(rule[0] + rule[1])] = rule
            left.pop(int(np.argmin(np.abs(direction) * (x[:, left].std(axis=0) + 1e-12))))
    return list(out.values())


def verify(df: DataFrame, candidates: list[tuple[list[str], list[str]]], tolerance: float = TOLERANCE) -> DataFrame:
    """(rule, lhs, rhs, valid_rows, satisfied_rows, confidence) of given sums, all in one pass."""
    spark = df.sparkSession
    if not candidates:
        return spark.createDataFrame([], "rule string, lhs array<string>, rhs array<string>, valid_rows long, satisfied_rows long, confidence double")
    cells = F.array(*[
        F.struct(
            F.lit(f"{' + '.join(a)} = {' + '.join(b)}").alias("rule"), F.array(*map(F.lit, a)).alias("lhs"), F.array(*map(F.lit, b)).alias("rhs"),
            F.count(holds(a, b, tolerance)).alias("valid_rows"), F.count_if(holds(a, b, tolerance)).alias("satisfied_rows"),
        )
        for a, b in candidates
    ])
    flat = df.agg(cells.alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return flat.withColumn("confidence", C.share(F.col("satisfied_rows"), F.col("valid_rows")))


def simplify(rules: list[tuple[list[str], str]]) -> list[tuple[list[str], str]]:
    """In sums `fields = total`, fields that another sum adds up are replaced by its total."""
    out = []
    for fields, total in rules:
        for part, name in sorted(rules, key=lambda r: -len(r[0])):
            if name != total and len(part) < len(fields) and set(part) <= set(fields):
                fields = [f for f in fields if f not in part] + [name]
        out.append((fields, total))
    return out


def dependencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b): every value of a goes with one value of b, over rows where both are there; b is not constant. All ordered
    pairs share one exchange: distinct pairs are counted by value pair first."""
    spark = df.sparkSession
    pairs = list(combinations(cols, 2))
    if not pairs:
        return spark.createDataFrame([], "a string, b string, groups long")
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs])
    distinct = df.select(F.explode(cells).alias("c")).select("c.*").where("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    both = distinct.unionByName(distinct.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("y").alias("x"), F.col("x").alias("y"), "n"))
    by_x = both.groupBy("a", "b", "x").agg(F.count("*").alias("ys"), F.min("y").alias("y"))
    found = by_x.groupBy("a", "b").agg(F.count("*").alias("groups"), F.max("ys").alias("most"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return found.where("most = 1 AND y0 <> y1").select("a", "b", "groups")


def day_pairs(df: DataFrame, cols: list[str], least: int = 100) -> list[tuple[str, str]]:
    """Pairs of time columns worth trying: the earliest with each other one, and neighbours in the order of their minima."""
    r = df.agg(*[F.min(c).alias(c) for c in cols]).first()
    order = sorted([c for c in cols if r[c] is not None], key=lambda c: (r[c], c))
    pairs = list(dict.fromkeys([(order[0], c) for c in order[1:]] + list(zip(order, order[1:], strict=False)))) if order else []
    if not pairs:
        return []
    n = df.agg(*[F.count_if(there([a, b])).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    return [p for i, p in enumerate(pairs) if n[f"{i}"] >= least]


def working_days(start: Column, end: Column) -> Column:
    """Days from Monday to Friday in (start, end], by arithmetic; -1 where end is before start or over ten years later."""
    a, b = F.to_date(start), F.to_date(end)

    def total(d: Column) -> Column:
        since = F.datediff(d, F.lit(MONDAY).cast("date"))
        return 5 * F.floor(since / 7) + F.least(F.weekday(d) + 1, F.lit(5))

    return F.when((b < a) | (F.datediff(b, a) > 3650), F.lit(-1)).otherwise(total(b) - total(a)).cast("long")


def calendar(spark, first: str, last: str, holidays: list[str] = (), workdays: list[str] = ()) -> DataFrame:
    """(day, working, number, next_workday): number counts working days so far. A row a day, so it is small by nature."""
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS day")
    working = (F.weekday("day") < 5) & ~F.col("day").cast("string").isin(list(holidays) or [""]) | F.col("day").cast("string").isin(list(workdays) or [""])
    order = Window.partitionBy().orderBy("day")
    marked = days.withColumn("working", working).withColumn("number", F.sum(F.col("working").cast("long")).over(order))
    return marked.withColumn("next_workday", F.min(F.when(F.col("working"), F.col("day"))).over(order.rowsBetween(1, Window.unboundedFollowing)))


def working_days_by_calendar(df: DataFrame, start: str, end: str, cal: DataFrame, to: str = "workdays") -> DataFrame:
    """Working days in (start, end] with a calendar's holidays: two look-ups of the running count."""
    c = cal.select("day", "number")
    a = F.broadcast(c.select(F.col("day").alias("_d1"), F.col("number").alias("_n1")))  # a row a day
    b = F.broadcast(c.select(F.col("day").alias("_d2"), F.col("number").alias("_n2")))
    out = df.join(a, F.to_date(start) == F.col("_d1"), "left").join(b, F.to_date(end) == F.col("_d2"), "left")
    lag = F.when(F.col("_d2") < F.col("_d1"), F.lit(-1)).otherwise(F.col("_n2") - F.col("_n1"))
    return out.withColumn(to, lag.cast("long")).drop("_d1", "_d2", "_n1", "_n2")


def shifted(df: DataFrame, start: str, end: str, cal: DataFrame, days: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(days, valid, satisfied): how often end is the first working day after start plus so many days."""
    look = F.broadcast(cal.select("day", "next_workday"))
    held = df.select(F.to_date(start).alias("s"), F.to_date(end).alias("e")).where("s IS NOT NULL AND e IS NOT NULL")
    tries = held.select("e", F.explode(F.array(*[F.struct(F.lit(d).alias("days"), F.date_add("s", d - 1).alias("d")) for d in days])).alias("x")).select("e", "x.days", F.col("x.d").alias("day"))
    return tries.join(look, "day").groupBy("days").agg(F.count("*").alias("valid"), F.count_if(F.col("e") == F.col("next_workday")).alias("satisfied"))


def lag_rule(df: DataFrame, start: str, end: str, unit: str = "day") -> DataFrame:
    """(start, end, unit, ordered, equal, lag, satisfied, valid, confidence): the commonest lag; ties go to the least."""
    lag = F.datediff(end, start).cast("long") if unit == "day" else working_days(F.col(start), F.col(end))
    held = df.where(there([start, end])).select(lag.alias("lag"), (F.col(start) <= F.col(end)).alias("o"))
    counts = held.groupBy("lag").agg(F.count("*").alias("k"), F.count_if("o").alias("o"))
    one = counts.agg(F.sum("k").alias("valid"), F.sum("o").alias("o"), F.min(F.struct((-F.col("k")).alias("k"), F.col("lag").alias("lag"))).alias("top"), F.coalesce(F.sum(F.when(F.col("lag") == 0, F.col("k"))), F.lit(0)).alias("same"))
    return one.where("valid > 0").select(F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(unit).alias("unit"), (F.col("o") == F.col("valid")).alias("ordered"), (F.col("same") == F.col("valid")).alias("equal"), F.col("top.lag").alias("lag"), (-F.col("top.k")).alias("satisfied"), "valid", (-F.col("top.k") / F.col("valid")).alias("confidence"))


def date_rules(df: DataFrame, cols: list[str], least: int = 100, confidence: float = 0.7) -> DataFrame:
    """Order, equality, day lags and working-day lags of the pairs worth trying."""
    out = None
    for a, b in day_pairs(df, cols, least):
        for unit in ("day", "workday"):
            r = lag_rule(df, a, b, unit)
            out = r if out is None else out.unionByName(r)
    if out is None:
        return df.sparkSession.createDataFrame([], "start string, end string, unit string, ordered boolean, equal boolean, lag long, satisfied long, valid long, confidence double")
    return out.where(F.col("ordered") | F.col("equal") | ((F.col("confidence") >= confidence) & (F.col("lag") != 0)))


def conditional_lags(df: DataFrame, start: str, end: str, cat: str, unit: str = "workday", most_levels: int = 20, least_eta: float = 0.1, confidence: float = 0.7) -> DataFrame:
    """(value, lag, satisfied, valid, confidence) by category, where the category explains enough of the lag."""
    from tallyloom.operators.association import eta_squared

    lag = F.datediff(end, start).cast("long") if unit == "day" else working_days(F.col(start), F.col(end))
    held = df.where(there([start, end, cat])).select(F.col(cat).cast("string").alias("value"), lag.alias("lag"))
    gate = eta_squared(held, "value", "lag").where((F.col("eta2") >= least_eta) & (F.col("n_groups") <= most_levels))
    counts = held.groupBy("value", "lag").agg(F.count("*").alias("k"))
    best = counts.groupBy("value").agg(F.sum("k").alias("valid"), F.min(F.struct((-F.col("k")).alias("k"), F.col("lag").alias("lag"))).alias("top"))
    out = best.join(F.broadcast(gate.select("eta2")))  # one row or none
    return out.select("value", F.col("top.lag").alias("lag"), (-F.col("top.k")).alias("satisfied"), "valid", (-F.col("top.k") / F.col("valid")).alias("confidence")).where(F.col("confidence") >= confidence)


def parse(rule: str) -> tuple[list[str], str, list[str], int]:
    """Sides, operator and offset of `a + b = c`, `a <= b` or `b = a + 2`; fields are names, the offset a whole number."""
    m = re.fullmatch(r"\s*(.+?)\s*(<=|>=|=|<|>)\s*(.+?)\s*", rule)
    if not m:
        raise ValueError(f"no rule: {rule}")
    sides, offset = [], 0
    for side, sign in ((m[1], -1), (m[3], 1)):
        fields = []
        for part in re.split(r"\s*\+\s*", side):
            if re.fullmatch(r"\d+", part):
                offset += sign * int(part)
            else:
                fields.append(part)
        sides.append(fields)
    return sides[0], m[2], sides[1], offset


def violations(df: DataFrame, key: list[str], rules: list[tuple[list[str], list[str]]], per_rule: int = 200, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, rule, left, right, gap, rank, severity) of rows that break a sum: the largest relative gaps of each rule.
    severity is high where the gap is over a tenth."""
    cells = F.array(*[F.struct(F.lit(f"{' + '.join(a)} = {' + '.join(b)}").alias("rule"), add(a).alias("left"), add(b).alias("right")) for a, b in rules])
    flat = df.select(*key, F.explode(cells).alias("x")).select(*key, "x.*").where("left IS NOT NULL AND right IS NOT NULL")
    gap = F.abs(F.col("left") - F.col("right")) / F.greatest(F.lit(1.0), F.abs("left"), F.abs("right"))
    bad = flat.withColumn("gap", gap).where(F.col("gap") > tolerance)
    rank = F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("gap"), *key))
    return bad.withColumn("rank", rank).where(F.col("rank") <= per_rule).withColumn("severity", F.when(F.col("gap") > 0.1, "high").otherwise("medium"))


def trim_fit(df: DataFrame, cols: list[str], rounds: int = 5, drop: float = 0.1) -> tuple[np.ndarray, float]:
    """The least direction after dropping, round by round, the tenth of the rows that keep it worst: a fit that a
    minority of bad rows does not turn. Each round is an aggregate and an approximate quantile."""
    held = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    vector = smallest_direction(moments(held, cols)[0])[1]
    for _ in range(rounds):
        off = F.abs(reduce(lambda a, b: a + b, [F.col(c) * float(v) for c, v in zip(cols, vector, strict=True)])) / (1 + F.abs(F.col(cols[0])))
        limit = held.agg(F.percentile_approx(off, 1 - drop, 1000).alias("q")).first()["q"]
        if limit is None or limit < 1e-9:
            break
        held = held.where(off <= limit)
        vector = smallest_direction(moments(held, cols)[0])[1]
    return vector, float(held.count())



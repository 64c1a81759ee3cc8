"""Relations between tables: key discovery, joins along them, and sampling that keeps keys whole."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER_KEYS = frozenset({"id", "_id", "pk"})
SCHEMA = "from_table string, from_col string, to_table string, to_col string, relation_type string, common long, confidence double"


def left_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], suffix: str, null_safe: bool = False) -> DataFrame:
    """Left equi-join; the right side's other columns get the suffix where a name is taken."""
    renamed = {c: f"{c}_{suffix}" if c in left.columns else c for c in right.columns}
    other = right.select(*[F.col(c).alias(n) for c, n in renamed.items()])
    conditions = [left[a].eqNullSafe(other[renamed[b]]) if null_safe else left[a] == other[renamed[b]] for a, b in keys]
    joined = left.join(other, conditions, "left")
    return joined.drop(*[renamed[b] for a, b in keys if a == b])


def semi_sample(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The child's rows whose key is in the parent."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def common_keys(a: DataFrame, b: DataFrame, a_col: str, b_col: str) -> DataFrame:
    """(n_a, n_b, common, rows_a, rows_b) over distinct keys. Both sides are counted by key before they meet."""
    x = a.where(F.col(a_col).isNotNull()).groupBy(F.col(a_col).cast("string").alias("k")).agg(F.count("*").alias("ra"))
    y = b.where(F.col(b_col).isNotNull()).groupBy(F.col(b_col).cast("string").alias("k")).agg(F.count("*").alias("rb"))
    both = x.join(y, "k", "full")
    return both.agg(F.count("ra").alias("n_a"), F.count("rb").alias("n_b"), F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("common"), F.coalesce(F.sum("ra"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("rb"), F.lit(0)).alias("rows_b"))


def bare(name: str, strip_prefix: bool) -> str:
    """A column's name for matching; prefixes of one or two letters and an underscore can be left off."""
    return re.sub(r"^[a-z]{1,2}_", "", name.lower()) if strip_prefix else name.lower()


def value_counts(tables: dict[str, DataFrame], strip_prefix: bool = False) -> DataFrame | None:
    """(table, column, name, v, n) over the columns that another table has under the same name and with the same kind of
    type; a table is read once for all of its columns."""
    named: dict[tuple[str, str], set[str]] = {}
    for t, df in tables.items():
        for f in df.schema:
            named.setdefault((bare(f.name, strip_prefix), f.dataType.typeName()[:3]), set()).add(t)
    out = None
    for t in sorted(tables):
        some = [(f.name, bare(f.name, strip_prefix), f.dataType.typeName()[:3]) for f in tables[t].schema]
        some = [(c, name, kind) for c, name, kind in some if name not in NEVER_KEYS and len(named[name, kind]) > 1]
        if some:
            cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(f"{name}:{kind}").alias("name"), F.col(c).cast("string").alias("v")) for c, name, kind in some])
            counts = tables[t].select(F.explode(cells).alias("x")).select(F.lit(t).alias("table"), "x.*").where("v IS NOT NULL").groupBy("table", "column", "name", "v").agg(F.count("*").alias("n"))
            out = counts if out is None else out.unionByName(counts)
    return out


def discover(tables: dict[str, DataFrame], strip_prefix: bool = False) -> DataFrame:
    """Relations by equal column names with a common value; confidence is the common share of the smaller key set. Columns
    meet by name and value after their values are counted, so a hot value is a row a column."""
    counts = value_counts(tables, strip_prefix)
    if counts is None:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], SCHEMA)
    size = counts.groupBy("table", "column").agg(F.count("*").alias("values"), F.sum("n").alias("rows"))
    # at one value of a name there is a row for each column that has it: tables are few
    held = counts.groupBy("name", "v").agg(F.array_sort(F.collect_list(F.struct("table", "column"))).alias("x")).where(F.size("x") > 1)
    pairs = F.flatten(F.transform("x", lambda p, i: F.transform(F.filter(F.slice("x", i + 2, F.size("x")), lambda q: q["table"] != p["table"]), lambda q: F.struct(p["table"].alias("from_table"), p["column"].alias("from_col"), q["table"].alias("to_table"), q["column"].alias("to_col")))))
    common = held.select(F.explode(pairs).alias("p")).groupBy("p.from_table", "p.from_col", "p.to_table", "p.to_col").agg(F.count("*").alias("common"))
    for side, s in (("from", "a"), ("to", "b")):
        common = common.join(F.broadcast(size.select(F.col("table").alias(f"{side}_table"), F.col("column").alias(f"{side}_col"), F.col("values").alias(f"n_{s}"), F.col("rows").alias(f"rows_{s}"))), [f"{side}_table", f"{side}_col"])
    one_a, one_b = F.col("n_a") == F.col("rows_a"), F.col("n_b") == F.col("rows_b")
    kind = F.when(one_a & one_b, "one_to_one").when(one_a, "one_to_many").when(one_b, "many_to_one").otherwise("many_to_many")
    return common.select("from_table", "from_col", "to_table", "to_col", kind.alias("relation_type"), "common", (F.col("common") / F.least("n_a", "n_b")).alias("confidence"))


def merge_relations(own: list[dict], found: list[dict]) -> list[dict]:
    """The user's relations, then those found between other column pairs, in either direction."""
    key = lambda r: frozenset([(r["from_table"], r["from_col"]), (r["to_table"], r["to_col"])])
    taken = {key(r) for r in own}
    return [*own, *[r for r in found if key(r) not in taken]]


def groups(tables: list[str], relations: list[dict]) -> list[list[str]]:
    """Tables that relations connect, each group in order; a table is one of few, so this is driver work."""
    root = {t: t for t in tables}

    def find(t: str) -> str:
        while root[t] != t:
            t = root[t]
        return t

    for r in relations:
        a, b = find(r["from_table"]), find(r["to_table"])
        root[max(a, b)] = min(a, b)
    out: dict[str, list[str]] = {}
    for t in sorted(tables):
        out.setdefault(find(t), []).append(t)
    return sorted(out.values())


def main_table(tables: list[str], relations: list[dict]) -> str:
    """The table with most relations; the first by name among equals."""
    degree = {t: sum(t in (r["from_table"], r["to_table"]) for r in relations) for t in tables}
    return min(tables, key=lambda t: (-degree[t], t))


def star_merge(tables: dict[str, DataFrame], relations: list[dict], main: str | None = None) -> DataFrame:
    """Left joins from the main table outward, one relation a table; tables without one stay out. A row stays once for
    each row of the other table with its key: joined from the many side, as main_table picks it, rows stay as they are."""
    main = main or main_table(list(tables), relations)
    out, merged = tables[main], {main}
    names = {(main, c): c for c in tables[main].columns}
    moved = True
    while moved:
        moved = False
        for r in relations:
            for here, key, there, other in ((r["from_table"], r["from_col"], r["to_table"], r["to_col"]), (r["to_table"], r["to_col"], r["from_table"], r["from_col"])):
                if here in merged and there in tables and there not in merged and (here, key) in names and other in tables[there].columns:
                    right = tables[there]
                    new = {c: f"{c}_{there}" if c in out.columns else c for c in right.columns}
                    renamed = right.select(*[F.col(c).alias(n) for c, n in new.items()])
                    out = out.join(renamed, out[names[here, key]] == renamed[new[other]], "left")
                    names |= {(there, c): n for c, n in new.items()}
                    merged.add(there)
                    moved = True
    return out


def sampled(tables: dict[str, DataFrame], relations: list[dict], n: int, key: str) -> dict[str, DataFrame]:
    """n rows of the main table by hash of the key, and of every related table the rows that go with them."""
    from tallyloom.operators.filters import stable_sample

    main = main_table(list(tables), relations)
    out = {main: stable_sample(tables[main], key, n)}
    for r in relations:
        for here, a, there, b in ((r["from_table"], r["from_col"], r["to_table"], r["to_col"]), (r["to_table"], r["to_col"], r["from_table"], r["from_col"])):
            if here in out and there in tables and there not in out:
                out[there] = semi_sample(tables[there], out[here], b, a)
    return out | {t: stable_sample(df, df.columns[0], n) for t, df in tables.items() if t not in out}


def merged_types(types: dict[str, dict[str, str]], loose: bool = False) -> dict[str, str]:
    """Semantic types of the merged table: by column, the first table's; names of ids, codes and keys are identifiers."""
    out: dict[str, str] = {}
    for t in types.values():
        for c, kind in t.items():
            words = re.split(r"[_\W]+|(?<=[a-z])(?=[A-Z])", c)
            hit = any(w in c.lower() for w in ("id", "code", "key")) if loose else any(w.lower() in ("id", "code", "key") for w in words)
            out.setdefault(c, "identifier" if hit else kind)
    return out

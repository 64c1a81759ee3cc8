"""How far the sources of a language differ in their terms, by pairs of sources and by terms.

Terms are counted in each task and summed by (language, source, term), all of a term in one partition, so that the
language's counts are a window over its sources. Each language keeps the terms of LEAST_DOCS documents or more; kept
terms get a chunk by hash and a place in the chunk by rank. A group's shares are packed into one vector a chunk.

Pairs of groups are computed as tiles: groups of a language, BLOCK at a time, against BLOCK others. A group's vectors are
sent to every tile of its block, a tile takes SLAB chunks of the vocabulary, one after another, and holds a matrix of
pair sums and one chunk's vectors. Sums of the slabs are added after.

Shares are whole billionths, computed as decimals; squared differences stay below 2^63; so all results are exact.

Defined cases: null text, language and source are empty strings; a group without a kept term has the shares of no count
at all; a language without a kept term has pair values of zero and no term rows; ties go by the item's UTF-8 bytes;
repeated rows count as documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, partitions, small, table

#: Documents of a language that hold a term it keeps.
LEAST_DOCS = 10
#: Ranks of the terms of a group.
TOP = 10
#: (source, term) rows of a chunk of the vocabulary, about; sources of a block; chunks of a slab.
CHUNK_ROWS, BLOCK, SLAB = 1 << 17, 8, 8
#: Terms a task holds before it passes its counts on; bytes of a text that are cut into terms at once.
HELD, PIECE = 400_000, 1 << 22
#: ASCII letters in lower case, bytes of other letters as they are, anything else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str):
    """Lists of terms, a list for each piece of the text; no term is cut."""
    raw = text.encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= PIECE else (raw.find(b" ", at + PIECE) + 1 or len(raw))
        yield raw[at:end].split()
        at = end


def group_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs, of_docs): occurrences and documents of each term in a group, and documents of the
    group's language that hold it; a null term stands for the group itself."""

    def run(batches):
        occurs: dict[tuple[str, str], Counter] = {}
        holds: dict[tuple[str, str], Counter] = {}

        def told():
            for (of_lang, of_source), counts in occurs.items():
                docs = holds[of_lang, of_source]
                names = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([of_lang] * (len(names) + 1)), pa.array([of_source] * (len(names) + 1)), pa.array([*names, None], pa.binary()).cast(pa.string()), pa.array([*counts.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, names), 0], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            occurs.clear()
            holds.clear()

        for batch in small(batches):
            for of_lang, of_source, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group = (of_lang or "", of_source or "")
                counts, docs = occurs.setdefault(group, Counter()), holds.setdefault(group, Counter())
                seen: set[bytes] = set()
                for words in terms_of(t or ""):
                    counts.update(words)
                    seen.update(words)
                docs.update(seen)
            if sum(map(len, occurs.values())) > HELD:
                yield from told()
        yield from told()

    counted = docs.select(F.col(lang).cast("string"), F.col(source).cast("string"), F.col(text)).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return summed


def share(n: str, total: str, terms: str) -> F.Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exactly."""
    return F.expr(f"1L + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(20, 0))) div CAST({total} + 2 * {terms} AS DECIMAL(20, 0))")


def gap(p: str, q: str) -> F.Column:
    """floor((p - q)^2 / (p + q))."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def tile_sums(packed: DataFrame, block: int = BLOCK, slab: int = SLAB) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources from packed: a row for each group and chunk with lang,
    source, place (of the group in its language, from 0), blocks (of the language), chunk, width (terms in the chunk),
    bare (the share without a count), at and shares (places in the chunk and shares of terms with a count)."""
    # a group of block b goes to the tiles (b, j >= b) and (i < b, b)
    mine = F.floor(F.col("place") / block).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = packed.withColumn("mine", mine).withColumn("other", other).select("*", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), F.floor(F.col("chunk") / slab).alias("slab"))
    keys = ["lang", "low", "high", "slab"]
    tiles = sent.select(*keys, "chunk", "place", "source", "width", "bare", "at", "shares").repartition(4 * partitions(packed.sparkSession), *keys).sortWithinPartitions(*keys, "chunk", "place")

    def run(batches):
        tile, chunk, rows, sums, names = None, None, {}, {}, {}

        def close_chunk():
            if not rows:
                return
            places = sorted(rows)
            width = rows[places[0]][0]
            matrix = np.empty((len(places), width), dtype=np.int64)
            for k, x in enumerate(places):
                _, bare, at, shares = rows[x]
                matrix[k] = bare
                matrix[k, at] = shares
            low, high = tile[1], tile[2]
            for k, x in enumerate(places):
                if x // block != low:
                    break
                to = [j for j in range(k + 1, len(places)) if places[j] // block == high]
                if to:
                    apart, both = matrix[to] - matrix[k], matrix[to] + matrix[k]
                    apart *= apart
                    apart //= both
                    for j, s in zip(to, apart.sum(axis=1).tolist(), strict=True):
                        sums[x, places[j]] = sums.get((x, places[j]), 0) + s
            rows.clear()

        def close_tile():
            close_chunk()
            if sums:
                pairs = [(names[i], names[j], v) for (i, j), v in sums.items()]
                pairs += [(b, a, v) for a, b, v in pairs]
                yield pa.RecordBatch.from_arrays([pa.array([tile[0]] * len(pairs)), *(pa.array(c, k) for c, k in zip(zip(*pairs, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True))], names=["lang", "source", "item", "value"])
            sums.clear()
            names.clear()

        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            for k in range(batch.num_rows):
                now = tuple(c[n][k].as_py() for n in keys)
                if now != tile:
                    yield from close_tile()
                    tile, chunk = now, None
                if (at := c["chunk"][k].as_py()) != chunk:
                    close_chunk()
                    chunk = at
                place = c["place"][k].as_py()
                names[place] = c["source"][k].as_py()
                rows[place] = (c["width"][k].as_py(), c["bare"][k].as_py(), c["at"][k].values.to_numpy(), c["shares"][k].values.to_numpy())
        yield from close_tile()

    return tiles.mapInArrow(run, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, chunk_rows: int = CHUNK_ROWS, block: int = BLOCK, slab: int = SLAB, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Both parts with their ranks."""
    by_term = Window.partitionBy("lang", "term")
    counted = group_terms(docs, lang, source, text)
    summed = counted.withColumns({"of_docs": F.sum("docs").over(by_term), "of_lang": F.sum("n").over(by_term), "nth": F.row_number().over(by_term.orderBy("source"))})
    kept = cut(summed.where((F.col("of_docs") >= least_docs) | F.col("term").isNull()), "terms")
    terms = kept.where("term IS NOT NULL")
    langs = cut(kept.groupBy("lang").agg(F.sum(F.when(F.col("term").isNotNull() & (F.col("nth") == 1), 1).otherwise(0)).alias("v"), F.sum("n").alias("of_n"), F.count("term").alias("rows"), F.countDistinct("source").alias("sources")), "langs")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row a source
    groups = cut(totals.withColumn("place", place).withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("rows") / chunk_rows)).cast("int")).withColumn("bare", F.when(F.col("v") > 0, share("0", "total", "v"))), "groups")

    shared = terms.join(groups.select("lang", "source", "total", "v", "of_n", "chunks", "bare"), ["lang", "source"]).withColumn("p", share("n", "total", "v"))
    told = shared.withColumn("q", share("of_lang", "of_n", "v")).where("p > q")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    by_terms = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value")).withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    in_chunk = Window.partitionBy("lang", "chunk").orderBy("term")
    placed = shared.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")).withColumn("at", F.dense_rank().over(in_chunk) - 1)
    vectors = cut(placed.groupBy("lang", "chunk", "source").agg(F.sort_array(F.collect_list(F.struct("at", "p"))).alias("cells")).select("lang", "chunk", "source", F.col("cells.at").alias("at"), F.col("cells.p").alias("shares")), "vectors")
    widths = vectors.groupBy("lang", "chunk").agg(F.max(F.array_max("at") + 1).alias("width"))
    # every group has a row in every chunk, with or without terms there
    rows = groups.select("lang", "source", "place", "bare", F.ceil(F.col("sources") / block).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    packed = rows.join(vectors, ["lang", "chunk", "source"], "left").join(widths, ["lang", "chunk"], "left").select(
        "lang", "source", "place", "blocks", "chunk", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("bare", F.lit(1)).alias("bare"), F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("shares", F.array().cast("array<long>")).alias("shares")
    )
    pairs = tile_sums(packed, block, slab).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(by_terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS of_lang FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(of_lang) AS of_n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
cells AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total + 2 * l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.of_lang + 2)) // (l.of_n + 2 * l.v)::HUGEINT AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(p.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM cells WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

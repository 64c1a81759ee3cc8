"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import text as T
from tallyloom.operators import timeseries as S
from tallyloom.plans.profiling import rounded
from tallyloom.plans.registry import query
from tallyloom.session import table


def docs(s, d):
    return T.corpus(table(s, d, "documents"), "text", "doc_id")


STOP = ", ".join(f"'{w}'" for w in [*X.STOP_EN, *X.STOP_ZH])
SPLIT = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\x0b\\f]+'), lambda x: length(x) > 0)"
TOKENS = f"SELECT doc_id, unnest(list_filter({SPLIT}, lambda x: NOT list_contains([{STOP}], x) AND length(trim(x)) > 1)) AS token FROM documents"


@query("x01_clean", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), 'https?://\\S+|www\\.\\S+', '', 'g'), '\\S+@\\S+\\.\\S+', '', 'g'), '[^\\x{4e00}-\\x{9fff}a-zA-Z0-9\\s.,!?;:''\"()-]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", X.clean(F.col("text")).alias("text"))


@query("x02_languages", "SELECT CASE WHEN length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) * 1.0 / length(text) > 0.3 THEN 'zh' WHEN regexp_matches(text, '[a-zA-Z]') THEN 'en' ELSE 'unknown' END AS language, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1")
def _(s, d):
    return T.language_mix(docs(s, d))


SENTENCES = "list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?\\n]+[。！？.!?\\n]?'), lambda x: trim(replace(x, chr(10), ''))), lambda x: length(x) > 0)"


@query("x03_sentences", f"SELECT doc_id, CAST(len({SENTENCES}) AS INT) AS n_sentences FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sentences"))


@query("x04_token_counts", f"SELECT doc_id, CAST(len({SPLIT}) AS BIGINT) AS n FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n"))


@query("x05_without_stop_words", f"SELECT doc_id, count(*) AS n FROM ({TOKENS}) GROUP BY 1")
def _(s, d):
    return T.token_counts(docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("x06_noise_lines", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) < 20)) AS BIGINT) AS n_short FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) < 20)).cast("long").alias("n_short"))


NO_WORD = " OR ".join(f"regexp_matches(x, '{p}')" for p in (r"^\d+(\.\d+)?$", r"^[06]\d{5}$", r"^\d{4}[-/.]?\d{0,2}[-/.]?\d{0,2}$", r"^\d+(\.\d+)?[a-z%]{1,3}$", "^[a-zA-Z]{1,2}$"))


@query("x07_filtered_tokens", f"SELECT doc_id, CAST(len(list_filter({SPLIT}, lambda x: NOT ({NO_WORD}) AND regexp_matches(x, '[a-zA-Z\\x{{4e00}}-\\x{{9fff}}\\x{{c0}}-\\x{{24f}}]'))) AS INT) AS n FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.size(X.filtered_tokens(X.tokens(F.col("text")))).alias("n"))


@query("x08_template_words")
def _(s, d):
    return T.template_words(docs(s, d))


@query("x11_statistics", "SELECT count(*) AS n_docs, count(*) FILTER (text = '') AS n_empty, CAST(min(length(text)) AS DOUBLE) AS min_chars, CAST(max(length(text)) AS DOUBLE) AS max_chars, round(avg(length(text)), 6) AS mean_chars, round(median(length(text)), 6) AS median_chars, round(stddev_pop(length(text)), 6) AS std_chars, CAST(sum(len(" + SPLIT + ")) AS BIGINT) AS n_words FROM documents")
def _(s, d):
    return rounded(T.statistics(docs(s, d)).drop("n_sentences"))


@query("x12_length_outliers", "WITH m AS (SELECT avg(length(text)) AS m, stddev_pop(length(text)) AS s FROM documents) SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CASE WHEN length(text) > m THEN 'long' ELSE 'short' END AS kind FROM documents, m WHERE abs(length(text) - m) > 2 * s")
def _(s, d):
    return T.length_outliers(docs(s, d))


@query("x13_prefix_duplicates", "SELECT doc_id, o AS original_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY substring(text, 1, 500)) AS o FROM documents WHERE text <> '') WHERE doc_id > o")
def _(s, d):
    return T.prefix_duplicates(docs(s, d))


@query("x14_near_duplicates", f"WITH s AS (SELECT list_sort(list_distinct({SPLIT})) AS t, min(doc_id) AS doc_id FROM documents WHERE length(text) >= 20 GROUP BY 1 HAVING len(t) > 3) SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.t, b.t)) * 1.0 / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM s a JOIN s b ON a.doc_id < b.doc_id AND least(len(a.t), len(b.t)) >= 0.7 * greatest(len(a.t), len(b.t)) WHERE len(list_intersect(a.t, b.t)) * 1.0 / len(list_distinct(list_concat(a.t, b.t))) >= 0.7")
def _(s, d):
    return rounded(T.near_duplicates(docs(s, d)))


@query("x14_near_duplicate_members", f"SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(list_distinct({SPLIT}))) AS representative FROM documents WHERE length(text) >= 20 AND len(list_distinct({SPLIT})) > 3")
def _(s, d):
    return T.near_duplicate_members(docs(s, d))


@query("x15_quality_report", "SELECT 'empty' AS \"check\", count(*) FILTER (text = '') AS n, round(count(*) FILTER (text = '') * 1.0 / count(*), 6) AS share FROM documents UNION ALL SELECT 'short', count(*) FILTER (text <> '' AND length(text) < 10), round(count(*) FILTER (text <> '' AND length(text) < 10) * 1.0 / count(*), 6) FROM documents UNION ALL SELECT 'no_letters', count(*) FILTER (NOT regexp_matches(text, '\\pL')), round(count(*) FILTER (NOT regexp_matches(text, '\\pL')) * 1.0 / count(*), 6) FROM documents UNION ALL SELECT 'duplicate', count(*), round(count(*) * 1.0 / (SELECT count(*) FROM documents), 6) FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY substring(text, 1, 500)) AS o FROM documents WHERE text <> '') WHERE doc_id > o")
def _(s, d):
    return rounded(T.quality_report(docs(s, d)))


@query("x16_top_tokens", f"SELECT token, count(*) AS n FROM ({TOKENS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(s, d):
    return T.top_tokens(docs(s, d))


IDF = f"""WITH tf AS (SELECT doc_id, token, count(*) AS tf FROM ({TOKENS}) GROUP BY 1, 2), v AS (SELECT token, count(*) AS df FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, token LIMIT 5000),
n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, token, tf * (ln((1 + n) * 1.0 / (1 + df)) + 1) AS w FROM tf JOIN v USING (token), n), k AS (SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM r)"""


@query("x17_tfidf_terms", f"{IDF} SELECT token, round(sum(w) / (SELECT n FROM n), 6) AS weight FROM k GROUP BY 1 ORDER BY sum(w) DESC, token LIMIT 20")
def _(s, d):
    return rounded(T.tfidf_terms(docs(s, d)))


@query("x18_document_keywords", f"{IDF} SELECT doc_id, token, round(w, 6) AS weight, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, token) AS rank FROM k) WHERE rank <= 5")
def _(s, d):
    return rounded(T.document_keywords(docs(s, d)))


@query("x19_textrank")
def _(s, d):
    return rounded(T.textrank(docs(s, d)))


@query("x21_ngrams", f"SELECT ngram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || t[i + 1])) AS ngram FROM (SELECT list_filter({SPLIT}, lambda x: NOT list_contains([{STOP}], x) AND length(trim(x)) > 1) AS t FROM documents)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(s, d):
    return T.ngram_counts(docs(s, d))


def hits(words) -> str:
    """The score of a sentence's words w of one side, d being the place of its first word of denial."""
    return f"greatest(0, coalesce(list_sum(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains([{', '.join(map(repr, words))}], w[i]) THEN CASE WHEN d IS NULL OR i < d THEN 1.0 ELSE -0.5 END ELSE 0.0 END)), 0))"


MOODS = f"""WITH s AS (SELECT doc_id, unnest({SENTENCES}) AS x FROM documents), t AS (SELECT doc_id, list_transform(regexp_extract_all(lower(x), '[a-z'']+'), lambda v: replace(v, chr(39), '')) AS w FROM s),
p AS (SELECT *, list_min(list_filter(range(1, len(w) + 1), lambda i: list_contains([{', '.join(map(repr, X.DENIAL))}], w[i]))) AS d FROM t), b AS (SELECT doc_id, sum({hits(X.POSITIVE)}) AS p, sum({hits(X.NEGATIVE)}) AS q FROM p GROUP BY 1), a AS (SELECT doc_id, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM documents LEFT JOIN b USING (doc_id))
SELECT doc_id, round(CAST(p AS DOUBLE), 6) AS positive, round(CAST(q AS DOUBLE), 6) AS negative, CASE WHEN p > q THEN 'positive' WHEN q > p THEN 'negative' ELSE 'neutral' END AS label, round(CAST(least(abs(p - q) / greatest(p, q, 1), 1) AS DOUBLE), 6) AS confidence FROM a"""


@query("x22_sentiment", MOODS)
def _(s, d):
    return rounded(T.sentiment(docs(s, d)))


@query("x23_sentiment_distribution", f"SELECT label, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM ({MOODS}) GROUP BY 1")
def _(s, d):
    return rounded(T.sentiment_distribution(docs(s, d)))


@query("x24_summaries")
def _(s, d):
    return T.summary_sentences(docs(s, d))


#: No SQL: word ends beside accented letters are not the same in both engines.
@query("x25_entities")
def _(s, d):
    return T.entities(docs(s, d))


@query("x27_entity_stats")
def _(s, d):
    return T.entity_stats(docs(s, d))


ITEMS = f"WITH i AS (SELECT DISTINCT doc_id, token AS item FROM ({TOKENS})), top AS (SELECT item, count(*) AS f FROM i GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40), k AS (SELECT doc_id, item FROM i JOIN top USING (item)), p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.item < y.item GROUP BY 1, 2)"


def items(s, d):
    return T.frequent(T.token_counts(docs(s, d)).withColumnRenamed("token", "item"), 40)


@query("x28_pair_counts", f"{ITEMS} SELECT a, b, n FROM p")
def _(s, d):
    return T.pair_counts(items(s, d))


@query("x28_pmi", f"{ITEMS} SELECT a, b, n, round(ln(n * (SELECT sum(n) FROM p) * 1.0 / (x.f * y.f)), 6) AS pmi FROM p JOIN top x ON a = x.item JOIN top y ON b = y.item WHERE ln(n * (SELECT sum(n) FROM p) * 1.0 / (x.f * y.f)) > 0.5 ORDER BY round(ln(n * (SELECT sum(n) FROM p) * 1.0 / (x.f * y.f)), 9) DESC, a, b LIMIT 30")
def _(s, d):
    return rounded(T.pmi(items(s, d)))


@query("x29_association_rules", f"{ITEMS} SELECT CASE WHEN x.f <= y.f THEN a ELSE b END AS antecedent, CASE WHEN x.f <= y.f THEN b ELSE a END AS consequent, round(n * 1.0 / c, 6) AS support, round(n * 1.0 / least(x.f, y.f), 6) AS confidence, round(n * 1.0 / least(x.f, y.f) * c / greatest(x.f, y.f), 6) AS lift FROM p JOIN top x ON a = x.item JOIN top y ON b = y.item, (SELECT count(*) AS c FROM documents) WHERE n >= 0.01 * c AND n * 1.0 / least(x.f, y.f) >= 0.5 AND n * 1.0 / least(x.f, y.f) * c / greatest(x.f, y.f) >= 1.2 ORDER BY round(n * 1.0 / least(x.f, y.f) * c / greatest(x.f, y.f), 9) DESC, 1, 2 LIMIT 20")
def _(s, d):
    return rounded(T.association_rules(items(s, d), table(s, d, "documents").count()))


@query("x33_clusters")
def _(s, d):
    return T.clusters(table(s, d, "embeddings"), "embedding", 10).groupBy("cluster").agg(F.count("*").alias("n"))


@query("x35_lda_topics")
def _(s, d):
    return rounded(T.lda_topics(docs(s, d), 3, 5))


@query("x36_class_topics", f"WITH t AS (SELECT lang AS label, token, count(*) AS tf FROM ({TOKENS}) JOIN documents USING (doc_id) GROUP BY 1, 2), a AS (SELECT token, sum(tf) AS s FROM t GROUP BY 1), c AS (SELECT token FROM a ORDER BY s DESC, token LIMIT 50) SELECT label, token, round(sc, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sc, 9) DESC, token) AS rank FROM (SELECT label, token, tf * ln((SELECT count(*) FROM documents) * 1.0 / s) AS sc FROM t JOIN a USING (token) WHERE token NOT IN (SELECT token FROM c))) WHERE rank <= 15")
def _(s, d):
    df = table(s, d, "documents").select("doc_id", "text", "lang")
    return rounded(T.class_topics(df, "lang"))


def mentions(s, d):
    """Event types as topics, with their daily counts: what the trend operators look at."""
    return table(s, d, "events").groupBy(F.col("event_type").alias("entity"), F.date_trunc("day", "ts").alias("date")).agg(F.count("*").cast("double").alias("value"))


M = "SELECT event_type AS entity, CAST(date_trunc('day', ts) AS TIMESTAMP) AS date, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2"


@query("x37_hot_topics", f"SELECT entity, round(avg(value) FILTER (r <= 7), 6) AS recent, round(avg(value) FILTER (r > 7), 6) AS earlier FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r FROM ({M})) GROUP BY 1")
def _(s, d):
    return rounded(S.recent_against_earlier(mentions(s, d)))


@query("x39_hot_peaks", f"SELECT entity, date, value, round(m, 6) AS mean FROM (SELECT *, avg(value) OVER (PARTITION BY entity) AS m, coalesce(lag(value) OVER w, 0) AS b, coalesce(lead(value) OVER w, 0) AS a FROM ({M}) WINDOW w AS (PARTITION BY entity ORDER BY date)) WHERE value > 1.2 * m AND b <= 1.1 * m AND a <= 1.1 * m")
def _(s, d):
    return rounded(S.spikes(mentions(s, d), 1.2, 1.1))


@query("x40_timeline", "SELECT event_type AS entity, CAST(date_trunc('day', ts) AS TIMESTAMP) AS date, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2")
def _(s, d):
    return mentions(s, d)


@query("s19_roles", "SELECT * FROM (VALUES ('text', 'content'), ('lang', 'other'), ('source', 'other')) t(\"column\", role)")
def _(s, d):
    return s.createDataFrame(list(T.roles(table(s, d, "documents")).items()), "column string, role string")


@query("s18_corpus", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def _(s, d):
    return docs(s, d)


@query("x09_trimmed")
def _(s, d):
    held = T.said(docs(s, d))
    return T.trim_templates(held, T.template_words(held))


@query("x10_prepared", f"SELECT doc_id, CAST(len({SPLIT}) AS BIGINT) AS n FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), 'https?://\\S+|www\\.\\S+', '', 'g'), '\\S+@\\S+\\.\\S+', '', 'g'), '[^\\pL\\pN\\s.,!?;:''\"()-]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM documents)")
def _(s, d):
    return T.prepared(docs(s, d)).select("doc_id", F.size("tokens").cast("long").alias("n"))


@query("x20_word_cloud", f"SELECT token, count(*) AS n FROM ({TOKENS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def _(s, d):
    return T.top_tokens(docs(s, d), 200)


@query("x34_cluster_profile", f"SELECT d.lang AS label, count(*) AS size, round(count(*) * 1.0 / (SELECT count(*) FROM documents), 6) AS share, any_value(w.words) AS words FROM documents d LEFT JOIN (SELECT lang, string_agg(token, ' ' ORDER BY r) AS words FROM (SELECT lang, token, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, token) AS r FROM ({TOKENS}) JOIN documents USING (doc_id) GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1) w ON w.lang = d.lang GROUP BY 1")
def _(s, d):
    return rounded(T.cluster_profile(table(s, d, "documents"), "lang"))


@query("x38_sentiment_shifts")
def _(s, d):
    return rounded(T.sentiment_shifts(mentions(s, d), 0.1))


@query("x41_entity_profile", "WITH e AS (SELECT user_id AS doc_id, event_type AS entity FROM events), s AS (SELECT DISTINCT * FROM e), p AS (SELECT a.entity AS a, b.entity AS b, count(*) AS n FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.entity <> b.entity GROUP BY 1, 2) SELECT entity, count(*) AS n, count(DISTINCT doc_id) AS n_docs, (SELECT string_agg(b, ',' ORDER BY n DESC, b) FROM p WHERE a = entity) AS related FROM e GROUP BY 1")
def _(s, d):
    return T.entity_profile(table(s, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("entity")))


@query("x44_plug_in", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def _(s, d):
    return T.plug_in(docs(s, d), lambda pdf: pdf.assign(n=pdf["text"].str.len())[["doc_id", "n"]], "doc_id long, n long")

"""Queries over documents, benchmark, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import saved
from ..operators import contexts, sketch, text
from . import Registry, table

R = Registry()

TOKENS = r"regexp_extract_all(lower(trim(coalesce(text, ''))), '[\p{L}\p{Mn}\p{Nd}\p{Pc}]+')"
TF = f"tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY doc_id, token)"
N = "n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents)"
IDF = "idf AS (SELECT token, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM (SELECT token, count(*) AS df FROM tf GROUP BY token), n)"
LEN = f"len AS (SELECT doc_id, len({TOKENS}) AS length FROM documents)"


def _tf(spark: SparkSession, d: str) -> DataFrame:
    """Term counts, saved: the texts are read once for all that follows."""
    return saved(text.term_counts(table(spark, d, "documents")), "tf")


def _n(spark: SparkSession, d: str) -> int:
    return table(spark, d, "documents").count()


def _weights(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tf = _tf(spark, d)
    idf = text.idf(tf, _n(spark, d))
    return tf, idf, text.tfidf(tf, idf)


def _lengths(spark: SparkSession, d: str, tf: DataFrame) -> DataFrame:
    """Every document's tokens, without reading the texts again."""
    n = tf.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    return saved(table(spark, d, "documents").select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("length", F.lit(0)).alias("length")), "lengths")


@R.add(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = text.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@R.add(f"SELECT page_id, CAST(len(t) AS BIGINT) AS n_tokens FROM (SELECT page_id, regexp_extract_all(lower(trim(coalesce(html, ''))), '[\\p{{L}}\\p{{Mn}}\\p{{Nd}}\\p{{Pc}}]+') AS t FROM pages)")
def page_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.size(text.tokens(F.col("html"))).cast("long").alias("n_tokens"))


@R.add(f"WITH {TF}, {N} SELECT token, df, round(ln((n + 1) / (df + 1)) + 1, 9) AS idf_smooth, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf_rsj, round(ln(n / df), 9) AS idf_plain FROM (SELECT token, count(*) AS df FROM tf GROUP BY token), n")
def doc_freq_idf(spark: SparkSession, d: str) -> DataFrame:
    n = F.lit(float(_n(spark, d)))
    df = text.document_frequency(_tf(spark, d))
    return df.select("token", "df", *[F.round(f(n, F.col("df")), 9).alias(f"idf_{k}") for k, f in text.IDF.items()])


@R.add(f"WITH {TF}, {N}, {IDF}, w AS (SELECT doc_id, token, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (token)) SELECT doc_id, count(*) AS n_terms, round(sqrt(sum(w * w)), 6) AS norm, round(max(w), 6) AS top_weight FROM w GROUP BY doc_id")
def tfidf_norms(spark: SparkSession, d: str) -> DataFrame:
    """Sublinear weights before normalisation, per document."""
    tf = _tf(spark, d)
    w = text.tfidf(tf, text.idf(tf, _n(spark, d)), variant="sublinear", normalise=False)
    return w.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.sqrt(F.sum(F.col("weight") ** 2)), 6).alias("norm"), F.round(F.max("weight"), 6).alias("top_weight"))


_W = f"{TF}, {N}, {IDF}, raw AS (SELECT doc_id, token, tf * idf AS w FROM tf JOIN idf USING (token)), w AS (SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)"


@R.add(f"WITH {_W}, q AS (SELECT item_id, token, tf * idf AS w FROM (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest({TOKENS}) AS token FROM benchmark) GROUP BY item_id, token) JOIN idf USING (token)), qn AS (SELECT item_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM q), s AS (SELECT item_id AS query_id, doc_id, round(sum(qn.w * w.w), 9) AS score FROM qn JOIN w USING (token) GROUP BY item_id, doc_id) SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s) WHERE rank <= 10")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for each benchmark text."""
    _, idf, docs = _weights(spark, d)
    q = text.tfidf(text.term_counts(table(spark, d, "benchmark"), "item_id"), idf, "item_id")
    return text.top_documents(q, docs, 10, "item_id")


@R.add(f"WITH {_W}, s AS (SELECT a.doc_id AS query_id, b.doc_id, round(sum(a.w * b.w), 9) AS score FROM w a JOIN w b USING (token) WHERE a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id) SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s) WHERE rank <= 10")
def tfidf_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Nearest documents of every fiftieth one (the stated query set), against all."""
    _, _, docs = _weights(spark, d)
    return text.top_documents(docs.where("doc_id % 50 = 0"), docs, 10, "doc_id")


@R.add(f"WITH {TF}, {N}, {IDF}, {LEN}, a AS (SELECT avg(length) AS avgdl FROM len), w AS (SELECT doc_id, token, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl)) AS w FROM tf JOIN idf USING (token) JOIN len USING (doc_id), a), q AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS token FROM benchmark) GROUP BY item_id, token), s AS (SELECT item_id AS query_id, doc_id, round(sum(qtf * w), 9) AS score FROM q JOIN w USING (token) GROUP BY item_id, doc_id) SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s) WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    tf = _tf(spark, d)
    lengths = _lengths(spark, d, tf)
    avg = lengths.agg(F.avg("length")).first()[0]
    w = text.bm25(tf, text.idf(tf, _n(spark, d)), lengths, avg)
    q = text.term_counts(table(spark, d, "benchmark"), "item_id").withColumnRenamed("tf", "weight")
    return text.top_documents(q, w, 10, "item_id")


def _grams(key: str, source: str) -> str:
    return f"(SELECT DISTINCT {key}, array_to_string(t[p:p + 4], ' ') AS gram FROM (SELECT {key}, t, unnest(range(1, len(t) - 3)) AS p FROM (SELECT {key}, {TOKENS} AS t FROM {source})))"


@R.add(f"WITH a AS {_grams('item_id', 'benchmark')}, b AS {_grams('doc_id', 'documents')}, na AS (SELECT item_id, count(*) AS na FROM a GROUP BY item_id), nb AS (SELECT doc_id, count(*) AS nb FROM b GROUP BY doc_id), j AS (SELECT item_id, doc_id, count(*) AS shared FROM a JOIN b USING (gram) GROUP BY item_id, doc_id) SELECT item_id, doc_id, shared, round(shared / (na + nb - shared), 9) AS jaccard, round(shared / na, 9) AS containment, round(shared / least(na, nb), 9) AS overlap, round(2 * shared / (na + nb), 9) AS dice FROM j JOIN na USING (item_id) JOIN nb USING (doc_id)")
def word_shingle_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard, containment, overlap and Dice of every benchmark text and document that share five words in a row."""
    j = text.shingle_overlap(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")
    return j.select("item_id", "doc_id", "shared", *[F.round(c, 9).alias(c) for c in ("jaccard", "containment", "overlap", "dice")])


_COOC = f"p AS (SELECT t[i] AS x, t[j] AS y FROM (SELECT t, i, unnest(range(i + 1, least(i + 5, len(t)) + 1)) AS j FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT {TOKENS} AS t FROM documents)))), c AS (SELECT a, b, CAST(2 * count(*) AS BIGINT) AS n FROM (SELECT x AS a, y AS b FROM p UNION ALL SELECT y, x FROM p) GROUP BY a, b)"
_PPMI = f"{_COOC}, m AS (SELECT a, sum(n) AS m FROM c GROUP BY a), t AS (SELECT sum(n) AS total FROM c), s AS (SELECT c.a, c.b, c.n, ln(c.n * total / (CAST(ma.m AS DOUBLE) * mb.m + 1e-10)) AS pmi FROM c JOIN m ma ON c.a = ma.a JOIN m mb ON c.b = mb.a, t)"


def _cooc(spark: SparkSession, d: str) -> DataFrame:
    return text.cooccurrence(table(spark, d, "documents"))


@R.add(f"WITH {_COOC} SELECT a, b, n FROM c")
def cooc_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Co-occurrence of all tokens within five places."""
    return _cooc(spark, d)


@R.add(f"WITH {_PPMI} SELECT a, b, n, ppmi, rank FROM (SELECT a, b, n, round(greatest(0, pmi), 9) AS ppmi, CAST(row_number() OVER (PARTITION BY a ORDER BY round(greatest(0, pmi), 9) DESC, b) AS INT) AS rank FROM s) WHERE rank <= 5")
def ppmi_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five best neighbours of every token; no row is made for a pair."""
    return contexts.ppmi_best(table(spark, d, "documents"))


@R.add(f"WITH {_COOC} SELECT a, CAST(sum(n) AS BIGINT) AS n, round(-sum(p * log2(p)), 6) AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END, 6) AS normalised FROM (SELECT a, n, n / sum(n) OVER (PARTITION BY a) AS p FROM c) GROUP BY a")
def contextual_entropy(spark: SparkSession, d: str) -> DataFrame:
    e = text.contextual_entropy(_cooc(spark, d))
    return e.select("a", "n", F.round("entropy", 6).alias("entropy"), F.round("normalised", 6).alias("normalised"))


@R.add(f"WITH {TF}, v AS (SELECT DISTINCT token FROM tf), b AS (SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM benchmark) GROUP BY token), j AS (SELECT v.token, coalesce(b.n, 0) AS n FROM v LEFT JOIN b USING (token)) SELECT token, round((n + 0.5) / (sum(n) OVER () + 0.5 * count(*) OVER ()), 12) AS p FROM j")
def unigram_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's smoothed unigram distribution over all of the documents' tokens."""
    counts = text.term_counts(table(spark, d, "benchmark"), "item_id").groupBy("token").agg(F.sum("tf").alias("n"))
    h = text.smoothed_histogram(counts, text.vocabulary(_tf(spark, d), 0), 0.5)
    return h.select("token", F.round("p", 12).alias("p"))


@R.add("SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS distance, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 9) AS similarity FROM part")
def levenshtein_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"), F.round(text.levenshtein_similarity(F.col("p_name"), F.col("p_type")), 9).alias("similarity"))


_H = "CAST(('0x' || substr(md5({t}), {i}, {n})) AS BIGINT)"
_H1, _H2 = _H.format(t="token", i=1, n=8), _H.format(t="token", i=9, n=8)


@R.add(f"WITH a AS (SELECT DISTINCT unnest({TOKENS}) AS token FROM documents), bits AS (SELECT DISTINCT ({_H1} + i * {_H2}) % 1437759 AS bit FROM a, range(0, 10) r(i)), q AS (SELECT DISTINCT token FROM (SELECT unnest({TOKENS}) AS token FROM benchmark)) SELECT token, bool_and((({_H1} + i * {_H2}) % 1437759) IN (SELECT bit FROM bits)) AS present FROM q, range(0, 10) r(i) GROUP BY token")
def bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    """Which benchmark tokens a Bloom filter of the documents' tokens (100,000 expected, 0.1 % false) lets through."""
    bits, hashes = sketch.bloom_size(100_000, 0.001)
    docs = table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token")).distinct()
    items = table(spark, d, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("token"))
    return sketch.bloom_probe(items, "token", sketch.bloom_build(docs, "token", bits, hashes), bits, hashes)


@R.add(f"WITH c AS (SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY token), s AS (SELECT i, ({_H1} + i * {_H2}) % 2719 AS cell, sum(n) AS n FROM c, range(0, 5) r(i) GROUP BY ALL), q AS (SELECT DISTINCT token FROM (SELECT unnest({TOKENS}) AS token FROM benchmark)) SELECT token, CAST(min(coalesce(s.n, 0)) AS BIGINT) AS estimate FROM (SELECT token, i, ({_H1} + i * {_H2}) % 2719 AS cell FROM q, range(0, 5) r(i)) p LEFT JOIN s ON p.i = s.i AND p.cell = s.cell GROUP BY token")
def count_min_estimates(spark: SparkSession, d: str) -> DataFrame:
    width, depth = sketch.count_min_size(0.001, 0.01)
    counts = _tf(spark, d).groupBy("token").agg(F.sum("tf").alias("n"))
    items = table(spark, d, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("token"))
    return sketch.count_min_estimate(items, "token", sketch.count_min(counts, "token", width, depth), width, depth)


@R.add(f"WITH t AS (SELECT DISTINCT lang, unnest({TOKENS}) AS token FROM documents), h AS (SELECT lang, {_H.format(t='token', i=1, n=3)} AS register, {_H.format(t='token', i=4, n=13)} AS rest FROM t), r AS (SELECT lang, register, max(CASE WHEN rest = 0 THEN 53 ELSE 52 - floor(log2(CAST(rest AS DOUBLE))) END) AS rank FROM h GROUP BY lang, register), s AS (SELECT lang, sum(pow(2.0, -rank)) AS z, count(*) AS used FROM r GROUP BY lang) SELECT lang, round(CASE WHEN raw <= 10240 AND used < 4096 THEN 4096 * ln(4096 / (4096.0 - used)) ELSE raw END, 6) AS estimate FROM (SELECT lang, used, 0.7213 / (1 + 1.079 / 4096) * 4096 * 4096 / (z + (4096 - used)) AS raw FROM s)")
def hll_tokens_by_lang(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("lang", F.explode(text.tokens(F.col("text"))).alias("token"))
    e = sketch.hll_estimate(sketch.hll_registers(t, "token", ["lang"]), ["lang"])
    return e.select("lang", F.round("estimate", 6).alias("estimate"))


_BIT = ", ".join(f"CASE WHEN sum(CASE WHEN ({'lo' if i < 32 else 'hi'} >> {i % 32}) & 1 = 1 THEN w ELSE -w END) > 0 THEN '1' ELSE '0' END" for i in range(63, -1, -1))


@R.add(f"WITH {TF}, {N}, {IDF}, {LEN}, a AS (SELECT avg(length) AS avgdl FROM len), w AS (SELECT doc_id, {_H1} AS hi, {_H2} AS lo, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl)) AS w FROM tf JOIN idf USING (token) JOIN len USING (doc_id), a) SELECT doc_id, concat({_BIT}) AS simhash FROM w GROUP BY doc_id")
def simhash_documents(spark: SparkSession, d: str) -> DataFrame:
    """64 bits from BM25-weighted tokens; documents without tokens have no hash."""
    tf = _tf(spark, d)
    lengths = _lengths(spark, d, tf)
    avg = lengths.agg(F.avg("length")).first()[0]
    return sketch.simhash(tf, text.idf(tf, _n(spark, d)), lengths, avg)


@R.add()
def minhash_lsh_groups(spark: SparkSession, d: str) -> DataFrame:
    """Candidate groups of MinHash signatures, by band."""
    return sketch.lsh_groups(sketch.minhash(table(spark, d, "documents")))


@R.add()
def ctph_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", sketch.ctph_column("text").alias("ctph"))


def _window_hash() -> str:
    h = "0"
    for k in range(5):
        h = f"((xor({h}, u[i + {k}]) * 31) & 255)"
    return h


@R.add(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(string_split(coalesce(text, ''), ''), lambda c: unicode(c) & 255) AS u FROM documents), long AS (SELECT * FROM d WHERE length(text) >= 50), w AS (SELECT doc_id, {_window_hash()} AS h FROM (SELECT doc_id, u, unnest(range(1, len(u) - 3)) AS i FROM long)), n AS (SELECT doc_id, h, count(*) AS n FROM w GROUP BY ALL), every AS (SELECT a.doc_id, a.k, coalesce(n.n, 0) AS n FROM (SELECT doc_id, unnest(range(0, 256)) AS k FROM long) a LEFT JOIN n ON n.doc_id = a.doc_id AND n.h = a.k), q AS (SELECT doc_id, list_sort(list(n)) AS s FROM every GROUP BY doc_id), c AS (SELECT doc_id, k, CASE WHEN n <= s[65] THEN 0 WHEN n <= s[129] THEN 1 WHEN n <= s[193] THEN 2 ELSE 3 END AS code FROM every JOIN q USING (doc_id)), body AS (SELECT doc_id, string_agg(format('{{:02x}}', v), '' ORDER BY p) AS body FROM (SELECT doc_id, k // 4 AS p, CAST(sum(code << (2 * (k % 4))) AS BIGINT) AS v FROM c GROUP BY ALL) GROUP BY doc_id), head AS (SELECT doc_id, text, list_sum(list_transform(range(0, octet_length(encode(text))), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS BIGINT))) AS total FROM long) SELECT d.doc_id, CASE WHEN body IS NULL THEN '' ELSE 'T1' || format('{{:02x}}', CAST(total % 256 AS BIGINT)) || format('{{:x}}', least(15, CAST(floor(ln(length(d.text)) / ln(2)) AS BIGINT))) || body END AS tlsh FROM d LEFT JOIN body USING (doc_id) LEFT JOIN head USING (doc_id)")
def tlsh_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", sketch.tlsh_column("text").alias("tlsh"))


@R.add()
def compression_distances(spark: SparkSession, d: str) -> DataFrame:
    """Of each conversation turn from the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).where("before IS NOT NULL")
    return c.select("conv_id", "turn", F.round(sketch.compression_distance(F.col("before"), F.col("text")), 9).alias("ncd"))

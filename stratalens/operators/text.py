"""Tokens, weights, co-occurrence and set similarity over text tables, as DataFrame plans.

A token is a run of letters, non-spacing marks, decimal digits and connectors in the
lower-cased text. Compatibility folding (NFKC) has no built-in: ``fold=True`` adds one
Arrow function around the text column; everything else stays in the JVM.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.tables import saved

TOKEN = r"([\p{L}\p{Mn}\p{Nd}\p{Pc}]+)"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def tokens(text: Column, ignore_case: bool = True, fold: bool = False, min_length: int = 1) -> Column:
    """array<string> of a text's tokens; blank or null text has none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    t = _nfkc(t) if fold else t
    t = F.regexp_extract_all(F.lower(t) if ignore_case else t, F.lit(TOKEN), F.lit(1))
    return F.filter(t, lambda x: F.length(x) >= min_length) if min_length > 1 else t


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda, an expression would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def shingles(words: Column, width: int = 2, separator: str = " ") -> Column:
    """Word n-grams; fewer words than ``width`` give none."""

    def grams(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, F.lit(width)), separator))
        return F.when(F.size(w) >= width, every).otherwise(F.array().cast("array<string>"))

    return bound(words, grams)


def shingle_set(words: Column, width: int = 2, separator: str = " ") -> Column:
    return F.array_distinct(shingles(words, width, separator))


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, token, tf)."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col), **options)).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("tf"))


IDF = {
    "smooth": lambda n, df: F.log((n + 1) / (df + 1)) + 1,
    "rsj": lambda n, df: F.log(1 + (n - df + 0.5) / (df + 0.5)),
    "plain": lambda n, df: F.log(n / df),
}


def document_frequency(tf: DataFrame) -> DataFrame:
    """(token, df) from term counts."""
    return tf.groupBy("token").agg(F.count("*").alias("df"))


def idf(tf: DataFrame, n_docs: int, formula: str = "smooth", min_df: int = 1, max_df_ratio: float = 1.0) -> DataFrame:
    """(token, df, idf): vocabulary pruned by document frequency."""
    df = document_frequency(tf).where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df_ratio * n_docs)))
    return df.withColumn("idf", IDF[formula](F.lit(float(n_docs)), F.col("df")))


def tfidf(tf: DataFrame, weights: DataFrame, id_col: str = "doc_id", variant: str = "raw", normalise: bool = True) -> DataFrame:
    """Sparse rows (id, token, weight), L2-normalised unless a norm is 1e-12 or less."""
    t = F.col("tf") if variant == "raw" else 1 + F.log("tf")
    w = tf.join(weights.select("token", "idf"), "token").select(id_col, "token", (t * F.col("idf")).alias("weight"))
    if not normalise:
        return w
    norm = F.sqrt(F.sum(F.col("weight") ** 2).over(Window.partitionBy(id_col)))
    return w.withColumn("norm", norm).select(id_col, "token", F.when(F.col("norm") > 1e-12, F.col("weight") / F.col("norm")).otherwise(F.col("weight")).alias("weight"))


#: Query terms that travel in one block, and candidates that a task holds before it sorts them out.
BLOCK_TERMS = 1_000_000
HELD = 500_000


def vectors(weights: DataFrame, id_col: str) -> DataFrame:
    """(id, tokens, weights): each row's sparse vector."""
    return weights.groupBy(id_col).agg(F.collect_list(F.struct("token", F.col("weight").cast("double").alias("weight"))).alias("v")).select(id_col, F.col("v.token").alias("tokens"), F.col("v.weight").alias("weights"))


def _best_of_block(names: list, places: dict[str, int], start: np.ndarray, query: np.ndarray, weight: np.ndarray, k: int, skip_own: bool):
    """Mapper: the ``k`` best documents of its partition for each query of a block.

    Token t's postings lie from start[places[t]] on; a document that scores less than the
    k-th best so far of a query is left out at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_name = {x: i for i, x in enumerate(names)} if skip_own else {}
        held: list[tuple] = []  # query, number of the document, score
        ids: list = []
        bar = np.full(len(names), -np.inf)
        rows = 0

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, n, s = (np.concatenate([h[i] for h in held]) for i in range(3))
            met, n = np.unique(n, return_inverse=True)
            known = [ids[i] for i in met.tolist()]
            rank = np.empty(len(known), np.int64)
            rank[sorted(range(len(known)), key=known.__getitem__)] = np.arange(len(known))
            order = np.lexsort((rank[n], -s, q))
            first = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]])
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            last = order[place == k - 1]
            bar[q[last]] = s[last]
            kept = order[place < k]
            ids[:] = known
            return q[kept], n[kept], s[kept]

        for b in batches:
            for r in range(b.num_rows):
                name, tokens, weights = (b.column(i)[r].as_py() for i in range(3))
                met = [(places[t], w) for t, w in zip(tokens, weights, strict=True) if t in places]
                if not met:
                    continue
                q = np.concatenate([query[start[t] : start[t + 1]] for t, _ in met])
                score = np.round(np.bincount(q, np.concatenate([weight[start[t] : start[t + 1]] * w for t, w in met]), len(names)), 9)
                # a query is met if it shares a token, whatever the weights
                shared = np.bincount(q, minlength=len(names)) > 0
                if name in at_name:
                    shared[at_name[name]] = False
                at = np.flatnonzero(shared & (score >= bar))
                if len(at):
                    held.append((at, np.full(len(at), len(ids)), score[at]))
                    ids.append(name)
                    rows += len(at)
                if rows > HELD:
                    held = [best()]
                    # what is left may be more than half of that
                    rows = min(len(held[0][0]), HELD // 2)
        if held:
            q, n, s = best()
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q.tolist()]), pa.array([ids[i] for i in n.tolist()]), pa.array(s)], names=["query_id", "id", "score"])

    return run


def top_documents(queries: DataFrame, docs: DataFrame, k: int, query_id: str, id_col: str = "doc_id") -> DataFrame:
    """(query_id, id, score, rank) of the k best dot products among documents that share a token; ties by id.

    Both sides are sparse weights. Queries travel in blocks of bounded size, as lists by
    token, and every document meets a block once: no row is made for a pair, and only the
    best of each partition are shuffled.
    """
    d = saved(vectors(docs, id_col), "vectors")
    q = vectors(queries, query_id)
    q = saved(q.withColumn("n", F.size("tokens")), "queries")
    total = q.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // BLOCK_TERMS) or 1
    kinds = dict(docs.dtypes), dict(queries.dtypes)
    schema = f"query_id {kinds[1][query_id]}, id {kinds[0][id_col]}, score double"
    out = None
    for i in range(blocks):
        names, places, token, query, weight = [], {}, array("i"), array("i"), array("d")
        own = q if blocks == 1 else q.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i)
        for r in own.toLocalIterator():
            token.extend(places.setdefault(t, len(places)) for t in r["tokens"])
            query.extend([len(names)] * len(r["tokens"]))
            weight.extend(r["weights"])
            names.append(r[query_id])
        t = np.frombuffer(token, np.int32) if token else np.zeros(0, np.int32)
        order = np.argsort(t, kind="stable")
        start = np.r_[0, np.cumsum(np.bincount(t, minlength=len(places)))]
        sent = d.sparkSession.sparkContext.broadcast((names, places, start, np.array(query, np.int32)[order], np.array(weight, float)[order]))

        def met(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield from _best_of_block(*sent.value, k, query_id == id_col)(batches)

        one = d.mapInArrow(met, schema)
        out = one if out is None else out.unionByName(one)
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", r).where(F.col("rank") <= k).withColumnRenamed("id", id_col)


def bm25(tf: DataFrame, weights: DataFrame, lengths: DataFrame, avg_length: float, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id") -> DataFrame:
    """(id, token, weight) with BM25 term weights; ``lengths`` holds (id, length)."""
    w = tf.join(weights.select("token", "idf"), "token").join(lengths, id_col)
    return w.select(id_col, "token", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(avg_length)))).alias("weight"))


def vocabulary(tf: DataFrame, size: int, min_frequency: int = 1) -> DataFrame:
    """(token, frequency): the ``size`` most frequent tokens (0: all); ties by token."""
    v = tf.groupBy("token").agg(F.sum("tf").alias("frequency")).where(F.col("frequency") >= min_frequency)
    return v.orderBy(F.desc("frequency"), "token").limit(size) if size else v


def cooccurrence(docs: DataFrame, vocab: DataFrame | None = None, window: int = 5, text_col: str = "text") -> DataFrame:
    """(a, b, n) symmetric counts within ``window`` positions: each unordered pair of places adds 2 to a cell.

    Pairs are made inside each row's token array and counted as unordered pairs; all
    tokens count, or those of ``vocab`` (token).
    """
    def pairs(t: Column) -> Column:
        def apart(d: int) -> Column:
            n = F.greatest(F.size(t) - d, F.lit(0))
            return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(1 + d), n), lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))

        return F.flatten(F.array(*[apart(d) for d in range(1, window + 1)]))

    near = docs.select(F.explode(bound(tokens(F.col(text_col)), pairs)).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    if vocab is not None:
        v = vocab.select("token")
        near = near.join(v.withColumnRenamed("token", "a"), "a", "left_semi").join(v.withColumnRenamed("token", "b"), "b", "left_semi")
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (4 * F.col("n")).alias("n")))).otherwise(F.array(F.struct("a", "b", (2 * F.col("n")).alias("n")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), (2 * F.col("n")).alias("n"))))
    return near.select(F.inline(sides))


def ppmi(counts: DataFrame) -> DataFrame:
    """(a, b, n, pmi, ppmi) of the non-zero cells."""
    marginal = counts.groupBy("a").agg(F.sum("n").alias("m"))
    total = counts.agg(F.sum("n").alias("total"))
    j = counts.join(marginal.select("a", F.col("m").alias("ma")), "a").join(marginal.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b").join(F.broadcast(total))  # one row
    p = F.log(F.col("n") * F.col("total") / (F.col("ma") * F.col("mb") + 1e-10))
    return j.select("a", "b", "n", p.alias("pmi"), F.greatest(F.lit(0.0), p).alias("ppmi"))


def contextual_entropy(counts: DataFrame) -> DataFrame:
    """(a, n, entropy, normalised): bits of each token's context distribution."""
    m = F.sum("n").over(Window.partitionBy("a"))
    p = F.col("n") / F.col("m")
    e = counts.withColumn("m", m).groupBy("a").agg(F.max("m").alias("n"), (-F.sum(p * F.log2(p))).alias("entropy"), F.count("*").alias("contexts"))
    return e.select("a", "n", "entropy", F.when(F.col("contexts") > 1, F.col("entropy") / F.log2("contexts")).otherwise(0.0).alias("normalised"))


def smoothed_histogram(counts: DataFrame, vocab: DataFrame, alpha: float) -> DataFrame:
    """(token, p): add-alpha smoothed distribution over a vocabulary; other tokens are dropped."""
    j = vocab.select("token").join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    total = j.agg(F.sum("n").alias("_total"), F.count("*").alias("_v"))
    return j.join(F.broadcast(total)).select("token", ((F.col("n") + alpha) / (F.col("_total") + alpha * F.col("_v"))).alias("p"))


def set_similarity(a: Column, b: Column) -> dict[str, Column]:
    """Jaccard, containment of a in b, overlap coefficient and Dice of two arrays of distinct elements; empty pairs give 1."""
    both, na, nb = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return similarity_from_counts(both, na, nb)


def similarity_from_counts(both: Column, na: Column, nb: Column) -> dict[str, Column]:
    one = F.lit(1.0)
    return {
        "jaccard": F.when(na + nb == 0, one).otherwise(both / (na + nb - both)),
        "containment": F.when(na == 0, one).otherwise(both / na),
        "overlap": F.when(F.least(na, nb) == 0, one).otherwise(both / F.least(na, nb)),
        "dice": F.when(na + nb == 0, one).otherwise(2 * both / (na + nb)),
    }


def shingle_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, width: int = 5, text_col: str = "text") -> DataFrame:
    """Set similarities of all pairs that share a shingle, found by an equi-join on shingles."""
    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.select(name, F.explode(shingle_set(tokens(F.col(text_col)), width)).alias("gram"))

    a, b = sets(left, left_id), sets(right, right_id)
    na = a.groupBy(left_id).agg(F.count("*").alias("na"))
    nb = b.groupBy(right_id).agg(F.count("*").alias("nb"))
    j = a.join(b, "gram").groupBy(left_id, right_id).agg(F.count("*").alias("shared")).join(na, left_id).join(nb, right_id)
    return j.select(left_id, right_id, "shared", *[c.alias(n) for n, c in similarity_from_counts(F.col("shared"), F.col("na"), F.col("nb")).items()])


def levenshtein_similarity(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


#: Distance measures by name, as builders of (similarity) columns.
MEASURES = {
    "levenshtein": levenshtein_similarity,
    "jaccard": lambda a, b: set_similarity(a, b)["jaccard"],
    "dice": lambda a, b: set_similarity(a, b)["dice"],
    "containment": lambda a, b: set_similarity(a, b)["containment"],
    "overlap": lambda a, b: set_similarity(a, b)["overlap"],
}

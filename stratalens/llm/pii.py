"""Information-theoretic sanitisation.

Four patterns give the protected entities of a text, in time that grows with its length. A term betrays an entity if the
corpus says so: with n(e) and n(t) documents that hold the entity and the term, and
n(t,e) documents that hold both, however far apart, the term's
pointwise mutual information with the entity, log2(N n(t,e) / (n(t) n(e))), is compared
with the entity's own information, log2(N / n(e)). A term that conveys at least the
share ``theta`` of it exceeds the disclosure threshold: in documents that hold the entity
it is marked wherever it stands, and generalised when the text is rewritten. That is, n(t,e) / n(t) has to reach
(n(e) / N) ** (1 - theta). A context is what stands within ``reach`` words of an entity:
copies of it count once, and a term farther off has the entity's first one. With fewer than ``support``
contexts the exact lower confidence bound of that ratio has to reach it, so that rare
entities are judged too, but no word is marked just for being as rare as its entity. An
entity with a single context has no terms: every word that stands nowhere else would be one.

From the threshold follows how frequent a term may be at most. Words are counted over
the whole corpus first, and only those rare enough are paired with entities.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, merge_spans, saved, small_batches, texts

KINDS = ["email", "ip", "card", "phone", "term"]
#: The patterns are those of the contract, written so that no run of characters is tried from each of its
#: places: an address is looked for from its "@", numbers begin at the first digit of a run.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Contexts that a disclosing term has at least.
FEWEST = 2
#: Of the bound for terms with few contexts.
CONFIDENCE = 0.9
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]{2,}")

#: Placeholders of the rewritten text; a term is generalised to its broad class.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost addresses: the part before an "@" reaches back to the last match, the last "@" or another character."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            yield "email", start, free
        at = text.find("@", free)


def _octet(digits: str) -> bool:
    """Whether a number is at most 255, however many digits it has."""
    d = digits.lstrip("0")
    return len(d) < 3 or (len(d) == 3 and d <= "255")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive."""
    out = list(_emails(text))
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return in_order(out)


def in_order(spans) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def entity_of(kind: str, text: str) -> str:
    """The entity that a span names, however it is written."""
    return f"{kind}:{text.lower() if kind == 'email' else text if kind == 'ip' else _NOT_DIGIT.sub('', text)}"


def _words(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int], list[bool]]:
    """Starts and ends of the text's words, and whether each touches no span."""
    starts, ends, free, k, taken = [], [], [], 0, merge_spans([(s, e) for _, s, e in spans])
    for m in _WORD.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        starts.append(s)
        ends.append(e)
        free.append(k == len(taken) or e <= taken[k][0])
    return starts, ends, free


def contexts(text: str, spans: list[tuple[str, int, int]], reach: int) -> list[tuple[str, str, int]]:
    """(entity, term, hash of the context) of every word within ``reach`` words of an entity, outside all spans."""
    out, (starts, ends, free) = [], _words(text, spans)
    for kind, s, e in spans:
        i, j = bisect_right(ends, s), bisect_left(starts, e)
        near = [text[starts[k] : ends[k]].lower() for k in (*range(max(0, i - reach), i), *range(j, min(len(starts), j + reach))) if free[k]]
        key = xxhash.xxh3_64_intdigest(" ".join(near).encode()) - (1 << 63)
        entity = entity_of(kind, text[s:e])
        out += [(entity, t, key) for t in near]
    return out


def free_words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of every word of the text outside its spans."""
    return [(text[s:e].lower(), s, e) for s, e, f in zip(*_words(text, spans), strict=True) if f]


_FOUND = "uid bigint, spans array<struct<kind:string,s:int,e:int>>, near array<struct<entity:string,term:string,context:bigint>>, held array<struct<entity:string,context:bigint>>, words array<struct<term:string,s:int,e:int>>"
_SPAN = pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())])
_NEAR = pa.struct([("entity", pa.string()), ("term", pa.string()), ("context", pa.int64())])
_HELD = pa.struct([("entity", pa.string()), ("context", pa.int64())])
_TERM = pa.struct([("term", pa.string()), ("s", pa.int32()), ("e", pa.int32())])


def find(docs: DataFrame, keep: list[str], reach: int) -> DataFrame:
    """``keep``, a number for each row, its base spans, the words near them, its entities with their first contexts and, if there are any, all words. The number holds once saved."""
    small_batches(docs.sparkSession)
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(_FOUND).fields])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            spans, near, held, words = [], [], [], []
            for t in texts(b, "_text"):
                s = base_spans(t)
                spans.append([{"kind": k, "s": x, "e": y} for k, x, y in s])
                by = contexts(t, s, reach) if s else []
                near.append([{"entity": x, "term": w, "context": c} for x, w, c in dict.fromkeys(by)])
                first = {entity_of(k, t[x:y]): 0 for k, x, y in s} | {c[0]: c[2] for c in reversed(by)}
                held.append([{"entity": x, "context": c} for x, c in first.items()])
                words.append([{"term": w, "s": x, "e": y} for w, x, y in free_words(t, s)] if s else [])
            n = len(spans)
            new = [pa.array(range(uid, uid + n), pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(near, pa.list_(_NEAR)), pa.array(held, pa.list_(_HELD)), pa.array(words, pa.list_(_TERM))]
            uid += n
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *new], names=[*keep, "uid", "spans", "near", "held", "words"])

    return docs.select(*keep, "_text").mapInArrow(lean(found), schema)


def term_documents(docs: DataFrame) -> DataFrame:
    """(term, n_term): the documents that hold each word, counted over whole texts and added up by task first."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_pydict({"term": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})
            c.clear()
            return b

        for b in batches:
            for t in texts(b, "_text"):
                c.update({w.lower() for w in set(_WORD.findall(t))})
            if len(c) > 300_000:
                yield out()
        yield out()

    return docs.select("_text").mapInArrow(lean(counted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def _bounded(k, n, p, support: int):
    """Column: whether the lower bound of k of n, with k < ``support``, is at least p: k or more are unlikely below p."""
    below, choose = F.lit(0.0), F.lit(1.0)
    for i in range(support - 1):
        below = below + F.when(k > i, choose * p**i * (1 - p) ** (n - i)).otherwise(0.0)
        choose = choose * (n - i) / (i + 1)
    return (k < support) & (1 - below <= 1 - CONFIDENCE)


def disclosing(found: DataFrame, docs: DataFrame, theta: float, support: int) -> DataFrame:
    """(entity, term): pairs whose term exceeds the entity's disclosure threshold.

    Words too frequent for every entity of their document are left out before they are paired.
    """
    n = float(max(found.count(), 1))
    near = found.select("uid", F.explode("near").alias("x")).select("uid", "x.entity", "x.term", "x.context")
    held = found.select("uid", F.explode("held").alias("x")).select("uid", "x.entity", "x.context")
    each = near.groupBy("entity").agg(F.countDistinct("context").alias("c"))
    entities = held.groupBy("entity").agg(F.countDistinct("uid").alias("n_entity"), F.countDistinct("context").alias("c_held")).join(each, "entity", "left").withColumn("c_entity", F.greatest("c_held", F.coalesce("c", F.lit(0))))
    ratio = lambda c: F.pow(F.col(c) / F.lit(n), F.lit(1 - theta))
    # both rules ask for (contexts or documents with both) / (documents with the term) of at least a ratio
    most = F.col("n_entity") + F.greatest("n_entity", "c_entity") / F.least(ratio("n_entity"), ratio("c_entity")) + 1e-6
    entities = saved(entities.where(F.col("c_entity") >= FEWEST).select("entity", "n_entity", ratio("c_entity").alias("least"), most.alias("most")), "pii-entities")
    own = held.join(entities.select("entity", "most"), "entity")
    limit = own.groupBy("uid").agg(F.max("most").alias("limit"))
    words = found.select("uid", F.array_distinct("words.term").alias("terms")).join(limit, "uid").select("uid", "limit", F.explode("terms").alias("term"))
    rare = saved(words.join(term_documents(docs), "term").where("n_term <= limit").select("uid", "term", "n_term"), "pii-rare")
    both = own.join(rare, "uid").where("n_term <= most").select("entity", "term", "n_term", F.col("context").alias("first"), F.lit(None).cast("long").alias("context"))
    beside = near.join(entities, "entity", "left_semi").join(rare, ["uid", "term"]).select("entity", "term", "n_term", F.lit(None).cast("long").alias("first"), "context")
    pairs = both.unionByName(beside).groupBy("entity", "term", "n_term").agg(F.greatest(F.countDistinct("first"), F.countDistinct("context")).alias("contexts"), F.count("first").alias("n_both"))
    pairs = pairs.where((F.col("contexts") >= FEWEST) & (F.col("n_both") > 0)).join(entities.drop("most"), "entity")
    info = F.log2(F.lit(n) / F.col("n_entity"))
    pmi = F.log2(F.lit(n) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    seen = F.col("contexts") + F.greatest(F.col("n_term") - F.col("n_both"), F.lit(0))  # copies beside the entity count once
    enough = F.when(F.col("contexts") >= support, pmi >= theta * info).otherwise(_bounded(F.col("contexts"), seen, F.col("least"), support))
    return pairs.where((info > 0) & enough).select("entity", "term")


def _with_terms(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, terms): the marked term spans of each row that has any; the join is on the pair, the rows are small."""
    held = found.select("uid", F.explode("held.entity").alias("entity")).join(pairs, "entity").select("uid", "term").distinct()
    words = found.select("uid", F.explode("words").alias("x")).select("uid", "x.term", "x.s", "x.e")
    return words.join(held, ["uid", "term"]).groupBy("uid").agg(F.collect_set(F.struct(F.lit("term").alias("kind"), "s", "e")).alias("terms"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, spans, terms = (b.column(k).to_pylist() for k in range(3))
        rows = []
        for d, base, more in zip(ids, spans, terms, strict=True):
            own = in_order((x["kind"], x["s"], x["e"]) for x in base)
            every = in_order([*own, *((x["kind"], x["s"], x["e"]) for x in more or [])])
            text = lambda s: ",".join(f"{k}:{x}:{y}" for k, x, y in s)
            n = Counter(k for k, _, _ in own)
            rows.append((d, *(n[k] for k in KINDS[:4]), hashlib.sha256(text(own).encode()).hexdigest(), text(every)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.string()] * 2, strict=True)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def _inner(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))


def pii(docs: DataFrame, reach: int = 8, theta: float = 0.9, support: int = 3) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per row of ``docs``.

    Null text is empty and has no spans; rows with one doc_id are judged each on its own;
    other columns are ignored. No rows give none.
    """
    d = _inner(docs)
    found = saved(find(d, ["doc_id"], reach), "pii")
    terms = _with_terms(found, disclosing(found, d, theta, support))
    rows = found.select("doc_id", "uid", "spans").join(terms, "uid", "left").select("doc_id", "spans", "terms")
    return rows.mapInArrow(lean(_digest), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def rewrite(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by a placeholder; overlapping spans become one."""
    out, at = [], 0
    runs: list[list] = []
    for k, s, e in in_order(spans):
        if runs and s < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], e)
        else:
            runs.append([k, s, e])
    for k, s, e in runs:
        word = text[s:e]
        out += [text[at:s], MARKS.get(k) or ("[NAME]" if word[:1].isupper() else "[TERM]")]
        at = e
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, reach: int = 8, theta: float = 0.9, support: int = 3, closure_pairs: int = 200_000) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in ``text`` (null stays null).

    A column ``n_chars``, if there is one, gets the length of each rewritten text.
    Few disclosing pairs travel with the tasks; beyond ``closure_pairs`` the rows are
    saved with numbers and joined with their marked terms.
    """
    spark, d = docs.sparkSession, _inner(docs)
    found = saved(find(d, ["doc_id"], reach), "pii")
    pairs = saved(disclosing(found, d, theta, support), "pii-pairs")
    columns = list(docs.columns)
    text = columns.index("text")
    chars = columns.index("n_chars") if "n_chars" in columns else None

    def put(b: pa.RecordBatch, new: list[str | None]) -> pa.RecordBatch:
        cols = [pa.array(new, b.column(k).type) if k == text else b.column(k) for k in range(len(columns))]
        if chars is not None:
            old, was = b.column(chars).to_pylist(), b.column(text).to_pylist()
            cols[chars] = pa.array([len(n) if n != o else c for n, o, c in zip(new, was, old, strict=True)], b.column(chars).type)
        return pa.RecordBatch.from_arrays(cols, names=columns)

    if pairs.count() <= closure_pairs:
        small_batches(spark)
        known: dict[str, set[str]] = {}
        for entity, term in pairs.toLocalIterator():
            known.setdefault(entity, set()).add(term)

        def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = []
                for t in b.column(text).to_pylist():
                    spans = base_spans(t) if t else []
                    own = set().union(*(known.get(entity_of(k, t[s:e]), ()) for k, s, e in spans)) if known else ()
                    terms = [("term", s, e) for w, s, e in free_words(t, spans) if w in own] if own else []
                    new.append(rewrite(t, [*spans, *terms]) if spans else t)
                yield put(b, new)

        return docs.mapInArrow(lean(swept), docs.schema)

    names = [f"_in{k}" for k in range(len(docs.columns))]
    inner = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("text").cast("string").alias("_text"))
    rows = saved(find(inner, names, reach), "pii-rows")
    j = rows.drop("near", "held", "words").join(_with_terms(rows, pairs), "uid", "left").select(*names, "spans", "terms")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        for b in batches:
            new = [rewrite(t, [(x["kind"], x["s"], x["e"]) for x in [*base, *(more or [])]]) if t else t for t, base, more in zip(b.column(text).to_pylist(), b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
            yield put(b, new)

    return j.mapInArrow(lean(joined), docs.schema)

"""Mergeable sketches and locality-sensitive hashes over text.

Token hashes are the first 16 hex digits of md5 where a plain SQL engine should be able
to follow, and seeded 64-bit FNV-1a with a mixing step in Arrow functions.
"""

from __future__ import annotations

import base64
import gzip
import lzma
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FNV-1a, 64 and 32 bits.
FNV64_BASIS, FNV64_PRIME = 0xCBF29CE484222325, 0x100000001B3
FNV32_BASIS, FNV32_PRIME = 0x811C9DC5, 0x01000193


def hex_bits(token: Column, first: int, digits: int) -> Column:
    """A slice of md5's hex digits as a number (up to 15 digits stay positive)."""
    return F.conv(F.substring(F.md5(token), first, digits), 16, 10).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fnv1a64(data: bytes, seed: int = 0) -> int:
    h = FNV64_BASIS ^ int(mix64(np.array([seed], np.uint64))[0])
    for b in data:
        h = (h ^ b) * FNV64_PRIME & 0xFFFFFFFFFFFFFFFF
    return int(mix64(np.array([h], np.uint64))[0])


def bloom_size(expected: int, fpp: float) -> tuple[int, int]:
    """(bits, hashes) for the expected items and false-positive probability."""
    m = math.ceil(-expected * math.log(fpp) / math.log(2) ** 2)
    return m, max(1, round(m / expected * math.log(2)))


def bloom_positions(token: Column, bits: int, hashes: int) -> Column:
    """array<long> of the bits of a token, by double hashing."""
    h1, h2 = hex_bits(token, 1, 8), hex_bits(token, 9, 8)
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (h1 + i * h2) % bits)


def bloom_build(items: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """(bit) rows that are set: a filter as a table, of at most ``bits`` rows."""
    return items.select(F.explode(bloom_positions(F.col(column), bits, hashes)).alias("bit")).distinct()


def bloom_probe(items: DataFrame, column: str, bloom: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(column, present) for each distinct item."""
    p = items.select(column).distinct().select(column, F.explode(F.array_distinct(bloom_positions(F.col(column), bits, hashes))).alias("bit"))
    return p.join(bloom.withColumn("_set", F.lit(1)), "bit", "left").groupBy(column).agg((F.count("*") == F.count("_set")).alias("present"))


def count_min_size(epsilon: float, delta: float) -> tuple[int, int]:
    return math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta))


def count_min_cells(token: Column, width: int, depth: int) -> Column:
    h1, h2 = hex_bits(token, 1, 8), hex_bits(token, 9, 8)
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.struct(i.alias("row"), ((h1 + i * h2) % width).alias("cell")))


def count_min(counts: DataFrame, column: str, width: int, depth: int) -> DataFrame:
    """(row, cell, n): at most width * depth rows; tables merge by summing."""
    return counts.select(F.explode(count_min_cells(F.col(column), width, depth)).alias("c"), "n").groupBy("c.row", "c.cell").agg(F.sum("n").alias("n"))


def count_min_estimate(items: DataFrame, column: str, sketch: DataFrame, width: int, depth: int) -> DataFrame:
    p = items.select(column).distinct().select(column, F.explode(count_min_cells(F.col(column), width, depth)).alias("c")).select(column, "c.row", "c.cell")
    return p.join(sketch, ["row", "cell"], "left").groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def hll_registers(items: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, register, rank) with 4096 registers: at most that many rows a group; tables merge by maximum."""
    register, rest = hex_bits(F.col(column), 1, 3), hex_bits(F.col(column), 4, 13)
    rank = F.when(rest == 0, 53).otherwise(52 - F.floor(F.log2(rest.cast("double")))).cast("int")
    return items.select(*(by or []), register.alias("register"), rank.alias("rank")).groupBy(*(by or []), "register").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, estimate) with linear counting below 2.5 m."""
    m = 4096.0
    s = registers.groupBy(*(by or [])).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("z"), F.count("*").alias("used"))
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("z") + (m - F.col("used")))
    empty = m - F.col("used")
    return s.select(*(by or []), F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).otherwise(raw).alias("estimate"))


def simhash(tf: DataFrame, weights: DataFrame, lengths: DataFrame, avg_length: float, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id") -> DataFrame:
    """(id, simhash): 64 signed sums of BM25 weights by bit of the token's hash; set where positive."""
    from .text import bm25

    w = bm25(tf, weights, lengths, avg_length, k1, b, id_col)
    h = w.select(id_col, "weight", hex_bits(F.col("token"), 1, 8).alias("hi"), hex_bits(F.col("token"), 9, 8).alias("lo"))
    bits = [F.sum(F.when(F.shiftright("lo" if i < 32 else "hi", i % 32).bitwiseAND(1) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{i}") for i in range(64)]
    s = h.groupBy(id_col).agg(*bits)
    return s.select(id_col, F.array(*[F.when(F.col(f"b{i}") > 0, 1).otherwise(0) for i in range(63, -1, -1)]).alias("bits")).select(id_col, F.array_join("bits", "").alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hash columns (longs)."""
    return F.bit_count(a.bitwiseXOR(b))


def _shingle_hashes(text: str, k: int) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    n = len(raw) - k + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    h = np.full(n, FNV32_BASIS, np.uint64)
    for j in range(k):
        for shift in (0, 8, 16):
            h = (h ^ ((raw[j : j + n] >> np.uint32(shift)) & np.uint32(255)).astype(np.uint64)) * np.uint64(FNV32_PRIME) & np.uint64(0xFFFFFFFF)
    return np.unique(h.astype(np.uint32))


def minhash(docs: DataFrame, size: int = 128, k: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, signature array<long>): minima of seeded 32-bit hashes of the character k-shingles; no shingles give none."""
    salt = mix64(np.arange(size, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for t in p[text_col]:
                x = _shingle_hashes(t, k).astype(np.uint64)
                sig = np.full(size, 0xFFFFFFFF, np.uint64)
                for s in range(0, len(x), 4096):
                    sig = np.minimum(sig, (mix64(x[s : s + 4096, None] ^ salt) >> np.uint64(32)).min(0))
                out.append(sig.astype(np.int64).tolist() if len(x) else None)
            yield pd.DataFrame({id_col: p[id_col], "signature": out})

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} long, signature array<long>")


def jaccard_estimate(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def lsh_bands(signatures: DataFrame, bands: int = 32, id_col: str = "doc_id") -> DataFrame:
    """(id, band, key): rows of one band and key are candidates for one another."""
    size = F.size("signature")
    parts = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.slice("signature", (i * (size / bands) + 1).cast("int"), (size / bands).cast("int"))))
    return signatures.where("signature IS NOT NULL").select(id_col, F.posexplode(parts).alias("band", "key"))


def lsh_groups(signatures: DataFrame, bands: int = 32, id_col: str = "doc_id") -> DataFrame:
    """(band, key, n, first): candidate groups of two or more, as sizes and smallest members, without listing pairs."""
    return lsh_bands(signatures, bands, id_col).groupBy("band", "key").agg(F.count("*").alias("n"), F.min(id_col).alias("first")).where("n > 1")


def _units(text: str | None) -> np.ndarray:
    """UTF-16 code units."""
    return np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), "<u2")


def _fnv1a(units) -> int:
    h = FNV64_BASIS
    for c in units:
        h = (h ^ c) * FNV64_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def _pieces(units: list[int], size: int, most: int) -> list[int]:
    """Hashes of the first pieces; one ends where the hash of everything so far is ``size`` - 1 modulo ``size``."""
    out, start, h = [], 0, FNV64_BASIS
    for i, c in enumerate(units):
        h = (h ^ c) * FNV64_PRIME & 0xFFFFFFFFFFFFFFFF
        if h % size == size - 1:
            out.append(_fnv1a(units[start : i + 1]))
            start = i + 1
            if len(out) == most:
                return out
    return out + [_fnv1a(units[start:])] if start < len(units) else out


# Block sizes from 3 to 96; 3 below 4,096 units; 64 digits, which is 6 hashes, of each digest.
def ctph(text: str | None, block_size: int = 0) -> str:
    """Context-triggered piecewise hash ``size:h1:h2`` over UTF-16 units, base-64 digits of the pieces' FNV-1a hashes at a size and its double."""
    units = _units(text).tolist()
    if not units:
        return "0::"
    n = len(units)
    size = max(block_size, 3) if block_size else 3 if n < 4096 else min(96, max(3, math.ceil(math.log(n / 64) / math.log(2))))
    digest = lambda k: base64.b64encode(np.array(_pieces(units, k, 6), "<u8").tobytes()).decode()[:64]
    return f"{size}:{digest(size)}:{digest(2 * size)}"


@F.pandas_udf(T.StringType())
def ctph_column(s: pd.Series) -> pd.Series:
    return s.map(ctph)


def ctph_similarity(a: Column, b: Column) -> Column:
    """0..100: the first parts at one block size, the second ones if the larger is at most double, else 0."""
    p, q = F.split(a, ":"), F.split(b, ":")
    na, nb = p[0].cast("long"), q[0].cast("long")
    score = lambda x, y: 100 * levenshtein_ratio(x, y)
    return F.when(na == nb, score(p[1], q[1])).when(F.greatest(na, nb) <= 2 * F.least(na, nb), score(p[2], q[2])).otherwise(0.0)


def levenshtein_ratio(x: Column, y: Column) -> Column:
    n = F.greatest(F.length(x), F.length(y))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / n)


# Windows of 5 units, 256 buckets, factor 31, at least 50 units.
def tlsh(text: str | None) -> str:
    """Locality-sensitive digest ``T1``, checksum, log length, body: 2-bit quartile codes of 256 buckets of windows; '' under 50 UTF-16 units."""
    units = _units(text)
    if len(units) < 50:
        return ""
    w = np.lib.stride_tricks.sliding_window_view((units & 255).astype(np.int64), 5)
    h = np.zeros(len(w), np.int64)
    for j in range(5):
        h = ((h ^ w[:, j]) * 31) & 255
    n = np.bincount(h, minlength=256)
    codes = np.searchsorted(np.sort(n)[[64, 128, 192]], n, "left").reshape(-1, 4)  # how many quartiles lie below
    body = (codes << np.array([0, 2, 4, 6])).sum(1).astype(np.uint8).tobytes().hex()
    length = min(int(math.log(len(units)) / math.log(2)), 15)
    return f"T1{sum(text.encode('utf-8', 'replace')) % 256:02x}{length:x}{body}"


@F.pandas_udf(T.StringType())
def tlsh_column(s: pd.Series) -> pd.Series:
    return s.map(tlsh)


def tlsh_distance(a: Column, b: Column) -> Column:
    """12 for each step of length, the checksums' difference, and the body digits that differ."""
    num = lambda c, i, n: F.conv(F.substring(c, i, n), 16, 10).cast("long")
    body = lambda c: F.split(F.substring(c, 6, 128), "")
    differ = F.aggregate(F.zip_with(body(a), body(b), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return 12 * F.abs(num(a, 5, 1) - num(b, 5, 1)) + F.abs(num(a, 3, 2) - num(b, 3, 2)) + differ


def _lzma(data: bytes) -> int:
    """Its window holds all of the data, so the second half sees the whole first one."""
    size = max(4096, 1 << max(len(data) - 1, 1).bit_length())
    return len(lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": size}]))


#: Compressed sizes by codec. zlib's and gzip's windows are 32 KB: use them for short texts only.
CODECS = {"lzma": _lzma, "zlib": lambda d: len(zlib.compress(d, 6)), "gzip": lambda d: len(gzip.compress(d, 6, mtime=0)), "deflate": lambda d: len(zlib.compress(d, 6, -15))}


def compression_distance(a: Column, b: Column, codec: str = "lzma") -> Column:
    """Normalised compression distance; null is empty, and two empty texts are 0 apart."""
    size = CODECS[codec]

    @F.pandas_udf(T.DoubleType())
    def ncd(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: str, q: str) -> float:
            u, v = (p or "").encode(), (q or "").encode()
            cu, cv, cuv = size(u), size(v), size(u + v)
            return (cuv - min(cu, cv)) / max(cu, cv) if u or v else 0.0

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return ncd(a, b)

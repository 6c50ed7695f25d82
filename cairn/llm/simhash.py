"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

Fingerprint: A-Z in lower case, words between ASCII white space, shingles of words with repeats, XXH64 of each; a bit
is set if it is set in over half the hashes. Texts that are null or hold no word get fingerprint 0 and link like any
other.

Search for links within ``radius`` bits: every bit position i has a non-zero vector m(i) of radius + 1 bits, and table
v (any non-zero vector) keys a fingerprint by the bits with odd <m(i), v>. Up to ``radius`` differing positions span
less than the whole space, so some v is orthogonal to all of them and that table gives both fingerprints the same key:
no pair within the radius is missed. Equal fingerprints are one node from the start. A bucket of up to ``block`` nodes
is compared in one task, which returns a spanning forest. In larger buckets every node goes to the centres reached by
flipping up to half the radius (rounded up) of the bits that the table ignores; at each centre the smallest node within
the rounded-down half links with all others there. Those links are true and keep all components, and their number is
linear in the nodes.

Defined results: repeated rows get the same component; a null id never names a component unless all its members have
null ids; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, relieved, row_digest, rows_of, written_for_later

#: Row b has the bits of byte b, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANE = (np.arange(8, dtype=np.int64) * 256)[None, :]
#: Shingles that are hashed at a time, so that memory does not grow with a document.
_AT_ONCE = 1 << 18


def set_in(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set."""
    return (np.bincount((hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()


def fingerprint(text: str | None, ngram: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n, joined, h = len(words), b" ".join(words), xxhash.xxh64_intdigest
    if n < ngram:
        return h(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    first = np.concatenate(([0], ends[: n - ngram] + 1)).tolist()
    last = ends[ngram - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for i in range(0, len(first), _AT_ONCE):
        votes += set_in(np.array([h(joined[a:b], seed) for a, b in zip(first[i : i + _AT_ONCE], last[i : i + _AT_ONCE], strict=True)], "<u8"))
    return int(np.packbits(votes * 2 > len(first), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "fp", ngram: int = 3, seed: int = 42) -> DataFrame:
    """docs with the fingerprint as a signed long in column ``to``."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        out = np.array([fingerprint(t, ngram, seed) for t in texts], np.uint64).view(np.int64)
        del texts
        relieved()
        return pd.Series(out)

    return docs.withColumn(to, of(F.col(f"`{text}`").cast("string")))


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering family: one mask of kept bits for each non-zero vector."""
    top = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if bin((1 + i % top) & v).count("1") & 1) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the values within radius bits of each other."""
    root = np.arange(len(values))
    found = []

    def up(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values) - 1):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= radius) + i + 1:
            a, b = up(i), up(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((i, int(j)))
    return found


def links(nodes: DataFrame, radius: int, block: int, scratch: Scratch) -> DataFrame:
    """(a, b) links between distinct fingerprints (nodes: fp) that connect just what links within the radius connect."""
    family = masks(radius)
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(family)])).alias("k")).select("k.t", "k.key", "fp")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch(keyed.join(sizes, ["t", "key"]), "buckets")
    small = shared.where(F.col("n") <= block).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def inside(buckets: pd.Series) -> pd.Series:
        out = []
        for one in buckets:
            signed = np.sort(np.asarray(one, np.int64))
            out.append([{"a": int(signed[i]), "b": int(signed[j])} for i, j in _forest(signed.view(np.uint64), radius)])
        return pd.Series(out)

    near = small.select(F.explode(inside("fps")).alias("e")).select("e.a", "e.b")
    large = shared.where(F.col("n") > block)
    if large.isEmpty():
        return near.distinct()
    more, less = (radius + 1) // 2, radius // 2
    flips = [(t, k, _signed(sum(1 << i for i in c))) for t, m in enumerate(family) for k in range(more + 1) for c in combinations([i for i in range(64) if not m >> i & 1], k)]
    moves = nodes.sparkSession.createDataFrame(flips, "t byte, k int, flip long")
    at = large.join(F.broadcast(moves), "t").select("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"), "k", "fp")
    lead = at.where(F.col("k") <= less).groupBy("t", "centre").agg(F.min("fp").alias("lead"))
    stars = at.join(lead, ["t", "centre"]).where("fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b"))
    return near.unionByName(stars).distinct()


def _grouped(docs: DataFrame, key: str, text: str, radius: int, ngram: int, seed: int, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (_key, _row, fp) and what is known of each fingerprint: fp, rep (null, _key and _row of its component's first row)."""
    named = docs.select(F.col(f"`{key}`").alias("_key"), row_digest(key, text).alias("_row"), F.col(f"`{text}`").alias("_text"))
    prints = scratch(with_fingerprint(named, "_text", "fp", ngram, seed).select("_key", "_row", "fp"), "fingerprints")
    first = F.min(F.struct(F.col("_key").isNull().alias("null"), "_key", "_row"))
    nodes = scratch(prints.groupBy("fp").agg(first.alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius, block, scratch), scratch)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return prints, rooted.join(rooted.groupBy("root").agg(F.min("least").alias("rep")), "root").select("fp", "rep")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, ngram: int = 3, seed: int = 42, block: int = 2048) -> DataFrame:
    """One row per document: its id, fp (signed long) and component_id, the smallest id that links reach."""
    scratch = Scratch(docs.sparkSession)
    prints, known = _grouped(docs, key, text, radius, ngram, seed, block, scratch)
    done = written_for_later(prints.join(known, "fp").select(F.col("_key").alias(key), "fp", F.col("rep._key").alias("component_id")), "simhash")
    scratch.drop()
    return done


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, ngram: int = 3, seed: int = 42, block: int = 2048) -> DataFrame:
    """docs with one row of each component: that with the smallest id (null last), and among equal ids of the smallest text digest."""
    scratch = Scratch(docs.sparkSession)
    prints, known = _grouped(docs, key, text, radius, ngram, seed, block, scratch)
    kept = written_for_later(known.select("rep._row").distinct(), "kept")
    repeats = not prints.groupBy("_row").count().where("count > 1").isEmpty()
    scratch.drop()
    return rows_of(docs, kept, key, text, repeats)

"""Near-duplicates by the exact Jaccard similarity of the sets of five-word shingles, for the pipeline.

Two texts are linked if their sets of shingle hashes (XXH64, of A-Z in lower case) share at least ``share`` per cent of
their union. Candidates come from two searches, and every one is verified on the whole sets, which are hashed again from
the texts. Equal sets are one node.

1. The covering tables of ``simhash``: nodes whose 64-bit fingerprints (of the sets) differ in at most ``radius`` bits.
   They connect the closest copies; at a similarity of 0.8 about ten bits differ, which no covering family reaches.
2. Prefix filtering, which loses no pair at any number of texts: all sets are sorted by one total order. Two sets of that
   similarity share an element among the first n - ceil(share x n) + 1 of each (n: its own size), its head, so texts are
   posted under the elements of their heads and compared where these meet. The order is by count, then by hash, so that
   common passages come last: a sample of the texts gives first counts, and then the elements under which ``HOT`` texts or
   more are posted get their count there and move back, for ``ROUNDS`` rounds. Only the time depends on these counts. A
   pair is dropped unread if its sizes, what can follow its first common element, what its heads share, or (in large
   groups) how many of their elements fall into the same classes of hashes rule the similarity out. Under each element every text is compared with one other first, and as long as large groups stay open
   with further ones. What all these links do not connect yet is compared in full: elements of up to ``block`` texts in
   one task, larger ones dealt into blocks by a hash and every pair of blocks a task of its own. Where the bounds leave
   at most ``PAIRED`` pairs a text, these are verified like the others. Where they leave more, the whole sets of the
   texts that are in such pairs meet in one task (or in blocks of ``ELEMENTS`` shingles), which compares them exactly
   and returns a spanning forest: what a group writes is linear in its texts, what its task compares is not.

Defined results: texts without words have the empty set and are equal; repeated rows get the same component; a null id
names a component only if all its members have null ids; one row of each component stays, that with the smallest id (null
last) and among equal ids of the smallest text digest, so unlike texts under one id or under null ids stay; very long
texts are hashed whole; an empty table gives no rows; the documents that stay keep all their columns, whatever the names
of these.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, blocks, components, released, relieved, row_digest, rows_of, small, written_for_later

#: Texts whose shingles are counted for the first order, and the most shingles that the sample or a round ranks.
SAMPLE, RANKED = 8192, 500_000
#: Texts under an element that make it move back, how often that is done, and how often groups are compared with one text.
HOT, ROUNDS, STARS = 16, 3, 2
#: Texts of an open group from which on their sketches bound pairs, and counters of a sketch.
LARGE, COUNTERS = 8, 128
#: Pairs for each text of a large group that are verified singly, and the shingles of a block of whole sets.
PAIRED, ELEMENTS = 2, 1 << 20


def shingles(text: str | bytes | None, ngram: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted set of the shingle hashes of a text (bytes: in UTF-8); empty for a text without words."""
    words = ((text or "").encode("utf-8", "surrogatepass") if not isinstance(text, bytes) else text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n, joined, h = len(words), b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    size = min(n, ngram)
    first = np.concatenate(([0], ends[: n - size] + 1)).tolist()
    return np.unique(np.fromiter((h(joined[a:b], seed) for a, b in zip(first, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(first)))


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed longs."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8").tolist()
    return a, b


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of a set as a signed long."""
    return int(np.packbits(simhash.set_in(hashes) * 2 > len(hashes), bitorder="little").view("<i8")[0]) if len(hashes) else 0


def sketch(hashes: np.ndarray) -> bytes:
    """How many elements of a set fall into each of COUNTERS classes: two sets share at most the sum of the lesser numbers."""
    return np.minimum(np.bincount((hashes >> np.uint64(40)).astype(np.int64) % COUNTERS, minlength=COUNTERS), 0xFFFF).astype("<u2").tobytes()


def head(hashes: np.ndarray, ranked: np.ndarray, counts: np.ndarray, share: int) -> np.ndarray:
    """What a set is posted under: its first elements by (count, hash). ranked: sorted hashes with counts; others have 0."""
    if not len(hashes):
        return hashes
    count = np.zeros(len(hashes), np.int64)
    if len(ranked):
        at = np.minimum(np.searchsorted(ranked, hashes), len(ranked) - 1)
        count = np.where(ranked[at] == hashes, counts[at], 0)
    return hashes[np.argsort(count, kind="stable")][: len(hashes) + (-share * len(hashes)) // 100 + 1]


def reaches(common: np.ndarray, n: np.ndarray, m: np.ndarray, share: int) -> np.ndarray:
    """Whether sets of n and m elements with so many in common have the similarity."""
    return common * (100 + share) >= share * (n + m)


def pairs_under(x: np.ndarray, share: int, sketches: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows (root, size, place of the common element) to compare: of two roots and not ruled out."""
    a, b = [], []
    full = np.zeros(len(x), bool) if sketches is None else (sketches == 0xFFFF).any(1)
    for i in range(len(x) - 1):
        y = x[i + 1 :]
        most = np.minimum(x[i, 1] - x[i, 2], y[:, 1] - y[:, 2])
        j = np.flatnonzero((y[:, 0] != x[i, 0]) & reaches(most, x[i, 1], y[:, 1], share)) + i + 1
        if sketches is not None and len(j):
            shared = np.minimum(sketches[i], sketches[j]).sum(1, dtype=np.int64)
            j = j[reaches(shared, x[i, 1], x[j, 1], share) | full[j] | full[i]]
        a.append(np.full(len(j), i))
        b.append(j)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def forest(ids: np.ndarray, x: np.ndarray, hashes: np.ndarray, share: int) -> tuple[list[int], list[int]]:
    """Links (a, b) that connect the roots of a group just as all its links of the similarity do.

    x: rows (root, size, place of the common element, block) of sets whose hashes follow each other. If there are two
    blocks, only pairs across them are compared.
    """
    a, b = [], []
    _, keys, times = np.unique(hashes, return_inverse=True, return_counts=True)
    root, two = np.unique(x[:, 0], return_inverse=True)[1], len(np.unique(x[:, 3])) > 1
    shared = times[keys] > 1  # the common element is, so that no set becomes empty
    starts = np.concatenate(([0], np.cumsum(shared)))[np.concatenate(([0], np.cumsum(x[:, 1])))]
    keys, mark = keys[shared], np.zeros(len(times), np.int32)
    for i in range(len(ids) - 1):
        y = x[i + 1 :]
        ask = (root[i + 1 :] != root[i]) & reaches(np.minimum(x[i, 1] - x[i, 2], y[:, 1] - y[:, 2]), x[i, 1], y[:, 1], share)
        j = np.flatnonzero(ask & (y[:, 3] != x[i, 3]) if two else ask) + i + 1
        if not len(j):
            continue
        own = keys[starts[i] : starts[i + 1]]
        mark[own] = 1
        if len(j) < 16:
            common = np.array([mark[keys[starts[k] : starts[k + 1]]].sum() for k in j])
        else:
            common = np.add.reduceat(mark[keys[starts[j[0]] :]], starts[j[0] : -1] - starts[j[0]])[j - j[0]]
        mark[own] = 0
        for k in j[reaches(common.astype(np.int64), x[i, 1], x[j, 1], share)]:
            if root[k] != root[i]:
                a.append(int(min(ids[i], ids[k])))
                b.append(int(max(ids[i], ids[k])))
                root[root == root[k]] = root[i]
    return a, b


def order_of(texts: DataFrame, ngram: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several of a sample of texts (_row, _text) share, sorted, and their counts as for all texts."""

    @F.pandas_udf("array<long>")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, ngram).view(np.int64) for t in values], dtype=object)

    share = min(1.0, SAMPLE / max(1, texts.count()))
    some = F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(1_000_003)) < int(1_000_003 * share)
    counted = texts.where(some).select(F.explode(of("_text")).alias("h")).groupBy("h").count().where("count >= 3").orderBy(F.desc("count"), "h").limit(RANKED).toPandas()
    ranked, counts = counted["h"].to_numpy(np.int64).view(np.uint64), (counted["count"].to_numpy(np.int64) / share).astype(np.int64)
    by = np.argsort(ranked)
    return ranked[by], counts[by]


def moved_back(ranked: np.ndarray, counts: np.ndarray, h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order with the counts k of the hashes h where these are greater than before, and the hashes that they move."""
    every = np.union1d(ranked, h)
    old, new = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    old[np.searchsorted(every, ranked)] = counts
    new[np.searchsorted(every, h)] = k
    return every, np.maximum(old, new), every[new > old]


def refined(heads: DataFrame, nodes: DataFrame, texts: DataFrame, repeats: bool, order: tuple[np.ndarray, np.ndarray], ngram: int, share: int, scratch: Scratch) -> DataFrame:
    """heads (id, n, head) by an order in which the elements under which many are posted come later."""
    for _ in range(ROUNDS):
        found = heads.select(F.explode("head").alias("h")).groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= HOT).orderBy(F.desc("k"), "h").limit(RANKED).toPandas()
        ranked, counts, moved = moved_back(*order, found["h"].to_numpy(np.int64).view(np.uint64), found["k"].to_numpy(np.int64))
        order = ranked, counts
        released(heads.sparkSession)
        if not len(moved):
            break

        def anew(batches: Iterable[pa.RecordBatch], ranked: np.ndarray = ranked, counts: np.ndarray = counts) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, some in blocks(x.as_py() for x in batch.column(2).cast(pa.binary())):
                    new = [head(shingles(t, ngram), ranked, counts, share).view(np.int64) for t in some]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, new)]), pa.int32()), pa.array(np.concatenate(new)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(some)), batch.column(1).slice(i, len(some)), lists], ["id", "n", "head"])
            relieved()

        # an element that moves back leaves the heads that it is not in as they are
        hot = F.broadcast(heads.sparkSession.createDataFrame(pd.DataFrame({"h": moved.view(np.int64)})))
        changed = scratch(heads.select("id", F.explode("head").alias("h")).join(hot, "h", "left_semi").select("id").distinct(), "changed")
        rows = small(scratch(changed.join(nodes.select("id", "n", "rep._row"), "id"), "rows"))
        read = texts.join(rows, "_row")
        again = (read.dropDuplicates(["id"]) if repeats else read).select("id", "n", "_text").mapInArrow(anew, "id long, n int, head array<long>")
        heads = scratch(heads.join(small(changed), "id", "left_anti").unionByName(again), "heads")
        scratch.drop_named("heads", keep=1)
    return heads


def sets_of(ids: DataFrame, nodes: DataFrame, texts: DataFrame, repeats: bool, ngram: int, scratch: Scratch) -> DataFrame:
    """The whole sets (id, hashes) of nodes (ids: id), hashed again from the texts."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, some in blocks(x.as_py() for x in batch.column(1).cast(pa.binary())):
                sets = [shingles(t, ngram).view(np.int64) for t in some]
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(some)), lists], ["id", "hashes"])
        relieved()

    used = scratch(ids.join(nodes.select("id", "rep._row"), "id"), "used")
    read = texts.join(small(used), "_row")
    return scratch((read.dropDuplicates(["id"]) if repeats else read).select("id", "_text").mapInArrow(hashed, "id long, hashes array<long>"), "sets")


def verified(pairs: DataFrame, nodes: DataFrame, heads: DataFrame, texts: DataFrame, repeats: bool, ngram: int, share: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes (id, rep) with heads (id, n, head) whose whole sets have the similarity."""

    # what two heads share and what can follow them bounds what the sets share
    ids = lambda df: df.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    heads = heads.join(small(scratch(ids(pairs), "asked")), "id")
    x, y = (heads.select(F.col("id").alias(c), F.col("n").cast("long").alias("n" + c), F.col("head").alias("h" + c)) for c in "ab")
    most = F.size(F.array_intersect("ha", "hb")) + F.greatest(F.col("na") - F.size("ha"), F.col("nb") - F.size("hb"))
    pairs = scratch(pairs.join(x, "a").join(y, "b").where(most * (100 + share) >= (F.col("na") + F.col("nb")) * share).select("a", "b"), "pairs")
    sets = sets_of(ids(pairs), nodes, texts, repeats, ngram, scratch)
    x, y = (sets.select(F.col("id").alias(c), F.col("hashes").alias("_" + c)) for c in "ab")
    same = F.size(F.array_intersect("_a", "_b")) * (100 + share) >= share * (F.size("_a") + F.size("_b"))
    links = scratch(pairs.join(x, "a").join(y, "b").where(same).select("a", "b"), "links")
    scratch.drop_named("sets")
    return links


def links(nodes: DataFrame, heads: DataFrame, texts: DataFrame, repeats: bool, ngram: int, share: int, radius: int, block: int, scratch: Scratch) -> DataFrame:
    """(a, b) links of nodes (id, rep, n, fp, sketch) with heads (id, n, head) that connect just what all pairs of the similarity connect."""
    # one node of each fingerprint stands for it in the covering tables, the others are paired with that one
    prints = scratch(nodes.groupBy("fp").agg(F.min("id").alias("lead"), F.count("*").alias("k")), "prints")
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("lead").alias("lead_" + c))
    close = simhash.links(prints.select("fp"), radius, block, scratch).join(of("a"), "a").join(of("b"), "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    equal = nodes.select("id", "fp").join(prints.where("k > 1"), "fp").where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))

    posted = heads.select("id", F.col("n").cast("long").alias("n"), F.posexplode("head").alias("at", "h"))
    shared = scratch(posted.join(posted.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "h"), "posted")
    released(nodes.sparkSession)

    def possible(n: Column, i: Column, m: Column, j: Column) -> Column:
        return F.least(n - i, m - j) * (100 + share) >= (n + m) * share

    def stars(members: DataFrame, turn: int) -> DataFrame:
        """Each member of a group with the one that a hash of the turn chooses, if they have different roots."""
        chosen = F.min(F.struct(F.xxhash64("root", F.lit(turn)).alias("r"), F.xxhash64("id", F.lit(turn)).alias("x"), "id")) if turn else F.min(F.struct("id"))
        lead = members.join(members.groupBy("h").agg(chosen.alias("c")).select("h", "c.id"), ["h", "id"]).select("h", F.col("id").alias("lead"), F.col("root").alias("lead_root"), F.col("n").alias("lead_n"), F.col("at").alias("lead_at"))
        met = members.join(lead, "h").where("root <> lead_root").where(possible(F.col("n"), F.col("at"), F.col("lead_n"), F.col("lead_at")))
        return met.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))

    rooted, found = shared.withColumn("root", F.col("id")), None
    for turn in range(STARS):
        pairs = stars(rooted, turn)
        if not turn:
            pairs = pairs.unionByName(close.unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        now = verified(scratch(pairs.distinct(), "stars"), nodes, heads, texts, repeats, ngram, share, scratch)
        found = now if found is None else found.unionByName(now)
        roots = components(found, scratch).withColumnRenamed("node", "id")
        rooted = shared.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        open_ = scratch(rooted.join(rooted.groupBy("h").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high").select("h"), "h"), "open")
        rooted = open_
        posts, most = open_.groupBy("h").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0))).first()
        if most <= 2 * HOT * posts:
            break
    first = found
    sized = open_.join(open_.groupBy("h").agg(F.count("*").alias("c")), "h").drop("k")
    member, wide = F.struct("id", "root", "n", "at"), F.struct("id", "root", "n", "at", "sketch")
    tile = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    few = sized.where(F.col("c") < LARGE).groupBy("h").agg(F.collect_list(member).alias("m"))
    many = sized.where(F.col("c") >= LARGE).join(nodes.select("id", "sketch"), "id")
    whole = many.where(F.col("c") <= block).groupBy("h").agg(F.collect_list(wide).alias("m")).select("h", "m")
    dealt = many.where(F.col("c") > block).withColumn("blocks", F.ceil(F.col("c") * 1.25 / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = paired.groupBy("h", *tile).agg(F.collect_list(wide).alias("m")).select("h", "m")

    def compared(group: list, sketches: np.ndarray | None, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs to verify, or, if they are more than most for each member, the members that they hold."""
        ids, *x = (np.asarray(v, np.int64) for v in group)
        i, j = pairs_under(np.stack(x, 1), share, sketches)
        if most is not None and len(i) > most * len(ids):
            return ids[:0], ids[:0], ids[np.union1d(i, j)]
        return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), ids[:0]

    @F.pandas_udf("a array<long>, b array<long>")
    def under(ids: pd.Series, root: pd.Series, n: pd.Series, at: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compared(g, None)[:2] for g in zip(ids, root, n, at, strict=True)], columns=["a", "b"])

    @F.pandas_udf("a array<long>, b array<long>, dense array<long>")
    def under_large(ids: pd.Series, root: pd.Series, n: pd.Series, at: pd.Series, sketches: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compared(g, np.frombuffer(b"".join(map(bytes, x)), "<u2").reshape(-1, COUNTERS), PAIRED) for *g, x in zip(ids, root, n, at, sketches, strict=True)], columns=["a", "b", "dense"])

    def linked(group: pa.Table) -> pa.Table:
        ids, *x = (group.column(c).to_numpy() for c in ("id", "root", "n", "at", "own"))
        hashes = np.concatenate([c.flatten().to_numpy() for c in group.column("hashes").chunks])
        a, b = forest(ids, np.stack([v.astype(np.int64) for v in x], 1), hashes, share)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    columns = [F.col(f"m.{c}") for c in ("id", "root", "n", "at")]
    large = scratch(whole.unionByName(parts).select("h", under_large(*columns, F.col("m.sketch")).alias("p")), "large", rows=8)
    met = few.select(under(*columns).alias("p")).unionByName(large.select(F.struct("p.a", "p.b").alias("p")))
    rest = scratch(met.select(F.explode(F.arrays_zip("p.a", "p.b")).alias("p")).select("p.a", "p.b").distinct(), "rest")
    first = first.unionByName(verified(rest, nodes, heads, texts, repeats, ngram, share, scratch))
    dense = scratch(large.select("h", F.explode("p.dense").alias("id")).distinct().join(open_.select("h", "id", "root", "n", "at"), ["h", "id"]), "dense")
    if dense.isEmpty():
        return first
    # each group's blocks hold at most about ELEMENTS shingles, as the sets that meet are whole
    into = F.when((F.col("c") <= block) & (F.col("s") <= ELEMENTS), 1).otherwise(F.ceil(F.greatest(F.col("c") / block, F.col("s") / ELEMENTS) * 1.25).cast("int"))
    dealt = dense.join(dense.groupBy("h").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select("h", into.alias("blocks")), "h").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("h", *tile, "id", "root", "n", "at", "own")
    sets = sets_of(dense.select("id").distinct(), nodes, texts, repeats, ngram, scratch)
    spanned = scratch(paired.join(sets, "id").groupBy("h", "i", "j").applyInArrow(linked, "a long, b long"), "spanned")
    scratch.drop_named("sets")
    return first.unionByName(spanned)


def _grouped(docs: DataFrame, key: str, text: str, ngram: int, share: int, radius: int, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, bool]:
    """Rows (_key, _row, d0, d1); of each set d0, d1, rep (null, _key and _row of its component's first row); and whether rows repeat."""
    texts = docs.select(F.col(f"`{key}`").alias("_key"), row_digest(key, text).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))
    ranked, counts = order = order_of(texts, ngram)

    @F.pandas_udf("d0 long, d1 long, n int, fp long, sketch binary, head array<long>")
    def of(values: pd.Series) -> pd.DataFrame:
        rows = []
        for t in values:
            s = shingles(t, ngram)
            rows.append((*digest(s), len(s), print_of(s), sketch(s), head(s, ranked, counts, share).view(np.int64)))
        del values
        relieved()
        return pd.DataFrame(rows, columns=["d0", "d1", "n", "fp", "sketch", "head"])

    prints = scratch(texts.select("_key", "_row", of("_text").alias("p")).select("_key", "_row", "p.*"), "shingles")
    first = F.min(F.struct(F.col("_key").isNull().alias("null"), "_key", "_row"))
    # what is wide is kept once: heads and sketches leave the rows' table, and heads the sets' table
    whole = scratch(prints.groupBy("d0", "d1").agg(first.alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("head").alias("head")).withColumn("id", F.monotonically_increasing_id()), "whole")
    prints = scratch(prints.select("_key", "_row", "d0", "d1"), "rows")
    scratch.drop_named("shingles")
    nodes, heads = scratch(whole.drop("head"), "nodes"), scratch(whole.select("id", "n", "head"), "heads")
    scratch.drop_named("whole")
    repeats = not prints.groupBy("_row").count().where("count > 1").isEmpty()
    said = texts.select("_row", "_text")
    heads = refined(heads, nodes, said, repeats, order, ngram, share, scratch)
    roots = components(links(nodes, heads, said, repeats, ngram, share, radius, block, scratch), scratch)
    rooted = nodes.select("id", "d0", "d1", "rep").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return prints, rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("first")), "root").select("d0", "d1", F.col("first").alias("rep")), repeats


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", ngram: int = 5, share: int = 80, radius: int = 3, block: int = 2048) -> DataFrame:
    """One row per document: its id, and component_id, the smallest id that links reach."""
    scratch = Scratch(docs.sparkSession)
    prints, known, _ = _grouped(docs, key, text, ngram, share, radius, block, scratch)
    done = written_for_later(prints.join(known, ["d0", "d1"]).select(F.col("_key").alias(key), F.col("rep._key").alias("component_id")), "similar")
    scratch.drop()
    return done


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", ngram: int = 5, share: int = 80, radius: int = 3, block: int = 2048) -> DataFrame:
    """docs with one row of each component, that with the smallest id."""
    scratch = Scratch(docs.sparkSession)
    _, known, repeats = _grouped(docs, key, text, ngram, share, radius, block, scratch)
    kept = written_for_later(known.select("rep._row").distinct(), "kept")
    scratch.drop()
    return rows_of(docs, kept, key, text, repeats)

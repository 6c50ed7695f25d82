"""Exact cosine links between vectors of equal label by dual traversal of cover trees.

Unit vectors with cosine c lie at distance sqrt(2 - 2c), so a threshold on the cosine is one on a metric. A tree's
levels are nested: a node's points are covered by children whose radii are at most half its own. Two nodes whose centres
lie farther apart than both covering radii and the threshold hold no link and are pruned; two nodes all of whose points
must be linked are counted at once; other pairs go on to their children. What is left is decided by the cosine in
double precision.

Across tasks the same tree is a table. Equal vectors are one point with a weight from the start. A label's points form
its root; a node of more than ``cap`` points gets children by pivots, each farthest from those before, until they halve
the radius of a bounded sample of it; where more than ``fan`` pivots would be needed, the children that are still too
large are split again, so such a level takes several rounds. Points go to the nearest pivot, and the true radius is
measured afterwards, so that results never depend on the sample. Node pairs are joined level by level and pruned by their
radii. The pairs of leaves that are left are dealt into tiles of ``_TILE`` x ``_TILE`` neighbouring leaves: a tile is one
row that holds each of its leaves once, and decides its pairs in one task. A label that holds most rows is many tiles.

Vectors that are null or zero or hold null or non-finite components, and vectors with a null label, link with nothing.
Defined results: vectors of different length never link; repeated rows link with each other (weights count them);
null keys get null components unless another key is reached; equal distances to pivots go to the first one; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, relieved, written_for_later

#: Points in a tree's leaf; sampled points of a node that choose its pivots; nodes whose pivots are sent at once.
_LEAF, _SAMPLE, _NODES = 48, 256, 1024
#: Leaves on a side of a tile, fewer where a tile would hold more numbers than that.
_TILE, _NUMBERS = 8, 4 << 20
_EPS = 1e-7


class Tree:
    """A cover tree of unit vectors x: centre (a point), radius, children and points of each node; node 0 is the root."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.points: list[np.ndarray] = []
        todo = [(np.arange(len(x)), 0, 2.0, -1)]
        below: dict[int, list[int]] = {}
        while todo:
            points, centre, level, parent = todo.pop()
            node = len(self.centre)
            far = np.sqrt(np.maximum(0, 2 - 2 * (x[points] @ x[centre])))
            self.centre.append(centre)
            self.radius.append(float(far.max()))
            self.points.append(points)
            if parent >= 0:
                below.setdefault(parent, []).append(node)
            if len(points) <= _LEAF or self.radius[-1] < 1e-6:
                continue
            half = min(level, self.radius[-1]) / 2
            rest = points[np.argsort(far, kind="stable")]
            while len(rest):
                near = 2 - 2 * (x[rest] @ x[rest[0]]) <= half * half
                near[0] = True
                todo.append((rest[near], int(rest[0]), half, node))
                rest = rest[~near]
        self.children = [np.array(below.get(i, ()), np.int64) for i in range(len(self.centre))]
        self.c, self.r = x[self.centre], np.array(self.radius)


def linked(a: Tree, b: Tree, cosine: float, weight_a: np.ndarray, weight_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weights of the other side's points that each point of a and of b links with, and links that connect the same.

    a and b may be the same tree: then each pair counts once on either side, and no point with itself.
    """
    same, tau = a is b, float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    got_a, got_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    n = len(a.x)
    root = np.arange(n if same else n + len(b.x))
    forest: list[tuple[int, int]] = []

    def up(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> None:
        p, q = up(i), up(j if same else n + j)
        if p != q:
            root[max(p, q)] = min(p, q)
            forest.append((i, j))

    todo = [(0, 0)]
    while todo:
        p, q = todo.pop()
        own = same and p == q
        pa, pb = a.points[p], b.points[q]
        d = float(np.sqrt(max(0.0, 2 - 2 * float(a.c[p] @ b.c[q]))))
        if d > a.r[p] + b.r[q] + tau + _EPS:
            continue
        if d + a.r[p] + b.r[q] <= tau - _EPS:
            if own:
                got_a[pa] += weight_a[pa].sum() - weight_a[pa]
            else:
                got_a[pa] += weight_b[pb].sum()
                got_b[pb] += weight_a[pa].sum()
            for i in pa:
                join(int(i), int(pb[0]))
            for j in pb[1:]:
                join(int(pa[0]), int(j))
            continue
        if not len(a.children[p]) and not len(b.children[q]):
            hit = a.x[pa] @ b.x[pb].T >= cosine
            if own:
                np.fill_diagonal(hit, False)
                got_a[pa] += hit @ weight_a[pa]
            else:
                got_a[pa] += hit @ weight_b[pb]
                got_b[pb] += weight_a[pa] @ hit
            for i, j in zip(*np.nonzero(np.triu(hit) if own else hit), strict=True):
                join(int(pa[i]), int(pb[j]))
            continue
        left = a.children[p] if len(a.children[p]) else np.array([p])
        right = b.children[q] if len(b.children[q]) else np.array([q])
        for i in range(0, len(left), 1024):
            some = left[i : i + 1024]
            square = np.maximum(0, 2 - 2 * (a.c[some] @ b.c[right].T))
            ok = np.sqrt(square) <= a.r[some][:, None] + b.r[right][None, :] + tau + _EPS
            if own:
                ok &= some[:, None] <= right[None, :]
            u, v = np.nonzero(ok)
            todo.extend(zip(some[u].tolist(), right[v].tolist(), strict=True))
    return got_a + got_b if same else got_a, got_b, forest


def _unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.asarray([np.asarray(r, float) for r in rows], float)
    return x / np.sqrt((x * x).sum(1))[:, None]


def pivots_of(sample: np.ndarray, fan: int) -> np.ndarray:
    """Points of the sample, each farthest from those before, until they cover it by half its radius or are fan."""
    chosen = [0]
    far = np.sqrt(np.maximum(0, 2 - 2 * (sample @ sample[0])))
    half = far.max() / 2
    while len(chosen) < max(2, fan) and (len(chosen) < 2 or far.max() > half):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(np.maximum(0, 2 - 2 * (sample @ sample[chosen[-1]]))))
    return sample[chosen]


def _valid(vec: str) -> F.Column:
    x = F.col(vec)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(good & (F.size(x) > 0) & F.exists(x, lambda v: v != 0), F.lit(False))


def _nearest(sent):  # noqa: ANN001, ANN202
    """The number of the pivot nearest to a vector, from a broadcast of (g, path) to pivots."""

    @F.pandas_udf("int")
    def nearest(g: pd.Series, path: pd.Series, vec: pd.Series) -> pd.Series:
        out = np.zeros(len(g), np.int32)
        for key, at in pd.Series(range(len(g))).groupby([g.to_numpy(), path.to_numpy()]).indices.items():
            out[at] = (_unit(list(vec.iloc[at])) @ sent.value[tuple(key)].T).argmax(1)
        return pd.Series(out)

    return nearest


def _split(points: DataFrame, cap: int, fan: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """points with their leaf's path (child numbers joined by dots), and the depth of the tree."""
    spark = points.sparkSession
    level, open_now, done = 0, points.withColumn("path", F.lit("r")), None

    @F.pandas_udf("array<array<double>>")
    def choose(samples: pd.Series, fans: pd.Series) -> pd.Series:
        return pd.Series([[row.tolist() for row in pivots_of(_unit(list(s)), int(f))] for s, f in zip(samples, fans, strict=True)])

    while True:
        sizes = open_now.groupBy("g", "path").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > cap)
        picked = open_now.join(large, ["g", "path"]).where(F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 20)) < F.ceil(F.lit(float(_SAMPLE << 20)) / F.col("n")))
        sampled = picked.groupBy("g", "path", "n").agg(F.collect_list("vec").alias("sample"))
        asked = F.least(F.greatest(F.ceil(2 * F.col("n") / cap), F.lit(2)), F.lit(fan))
        pivots = scratch(sampled.select("g", "path", choose("sample", asked).alias("p")).where(F.size("p") > 1), "pivots")
        count = pivots.count()
        last = level >= 40 or not count
        small = open_now if last else open_now.join(pivots.select("g", "path"), ["g", "path"], "left_anti")
        # what no pivot separates is dealt into leaves by a hash: the measured radius keeps results exact
        dealt = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / (cap / 2)).cast("long")))
        leaves = small.join(large, ["g", "path"], "left").withColumn("path", F.concat("path", F.lit("#"), dealt.cast("string"))).drop("n")
        done = leaves if done is None else done.unionByName(leaves)
        if last:
            break
        moved = None
        for b in range(-(-count // _NODES)):
            some = pivots if count <= _NODES else pivots.where(F.pmod(F.xxhash64("g", "path"), F.lit(-(-count // _NODES))) == b)
            sent = spark.sparkContext.broadcast({(r.g, r.path): np.array(r.p) for r in some.collect()})

            nearest = _nearest(sent)
            part = open_now.join(some.select("g", "path"), ["g", "path"]).withColumn("path", F.concat("path", F.lit("."), nearest("g", "path", "vec").cast("string")))
            moved = part if moved is None else moved.unionByName(part)
        open_now = scratch(moved.select(*points.columns, "path"), "points")
        level += 1
    return scratch(done.select(*points.columns, "path"), "placed"), level


def links(points: DataFrame, cosine: float, cap: int, fan: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """For distinct points (g: group, id: long, weight: long, vec): (id, linked weight) and connecting links (a, b)."""
    placed, depth = _split(points, cap, fan, scratch)
    tau = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    @F.pandas_udf("centre array<double>, radius double, body binary")
    def packed(vecs: pd.Series) -> pd.DataFrame:
        out = []
        for v in vecs:
            x = _unit(list(v))
            c = x.mean(0)
            out.append((c.tolist(), float(np.sqrt(((x - c) ** 2).sum(1).max())), x.astype("<f8").tobytes()))
        return pd.DataFrame(out, columns=["centre", "radius", "body"])

    members = placed.groupBy("g", "path").agg(F.collect_list(F.struct("id", "weight", "vec")).alias("m"))
    leaves = scratch(members.select("g", "path", F.col("m.id").alias("ids"), F.col("m.weight").alias("weights"), packed(F.col("m.vec")).alias("p")).select("g", "path", "ids", "weights", "p.*"), "leaves", rows=16)
    prefix = lambda k: F.when(F.size(F.split("path", r"\.")) > k + 1, F.concat(F.substring_index("path", ".", k + 1), F.lit("."))).otherwise(F.col("path"))

    @F.pandas_udf("centre array<double>, radius double")
    def around(centres: pd.Series, radii: pd.Series) -> pd.DataFrame:
        out = []
        for c, r in zip(centres, radii, strict=True):
            x = np.array([np.asarray(v, float) for v in c])
            m = x.mean(0)
            out.append((m.tolist(), float((np.sqrt(((x - m) ** 2).sum(1)) + np.asarray(r, float)).max())))
        return pd.DataFrame(out, columns=["centre", "radius"])

    # upwards: a node's centre and radius from its children's, at most fan of them; downwards: pairs of nodes
    levels = [leaves.select("g", "path", "centre", "radius")]
    for k in range(depth - 1, -1, -1):
        up = levels[0].withColumn("up", prefix(k)).groupBy("g", "up").agg(F.collect_list("centre").alias("c"), F.collect_list("radius").alias("r"))
        levels.insert(0, scratch(up.select("g", F.col("up").alias("path"), around("c", "r").alias("p")).select("g", "path", "p.*"), "level"))
    top = levels[0].select("g", "path")
    pairs = top.alias("a").join(top.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.path") <= F.col("b.path"))).select(F.col("a.g").alias("g"), F.col("a.path").alias("p"), F.col("b.path").alias("q"))
    for k, level in enumerate(levels[1:]):
        child = level.withColumn("up", prefix(k))
        left, right = (child.select("g", F.col("up").alias(s), F.col("path").alias(s + "2"), F.col("centre").alias("c" + s), F.col("radius").alias("r" + s)) for s in "pq")
        apart = F.sqrt(F.aggregate(F.zip_with("cp", "cq", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        pairs = pairs.join(left, ["g", "p"]).join(right, ["g", "q"]).where((F.col("p") != F.col("q")) | (F.col("p2") <= F.col("q2"))).where(apart <= F.col("rp") + F.col("rq") + tau + _EPS).select("g", F.col("p2").alias("p"), F.col("q2").alias("q"))
        pairs = scratch(pairs, "pairs")
    # leaves that follow each other in the tree's order share tiles
    order = leaves.select("g", "path", F.size("centre").alias("dim"), (F.row_number().over(Window.partitionBy("g").orderBy("path")) - 1).alias("nth"))
    side = F.greatest(F.lit(1), F.least(F.lit(_TILE), F.floor(F.lit(float(_NUMBERS)) / (2 * cap * F.col("dim"))).cast("int")))
    order = scratch(order.select("g", "path", F.floor(F.col("nth") / side).alias("tile")), "order")
    at = lambda c: order.select("g", F.col("path").alias(c), F.col("tile").alias("t" + c))
    dealt = scratch(pairs.join(at("p"), ["g", "p"]).join(at("q"), ["g", "q"]), "dealt")
    todo = dealt.groupBy("g", "tp", "tq").agg(F.collect_list(F.struct("p", "q")).alias("todo"))
    needed = dealt.select("g", "tp", "tq", F.explode(F.array("p", "q")).alias("path")).distinct()
    bodies = needed.join(leaves.select("g", "path", "ids", "weights", "body"), ["g", "path"]).groupBy("g", "tp", "tq").agg(F.collect_list(F.struct("path", "ids", "weights", "body")).alias("leaves"))

    @F.pandas_udf("counts array<struct<id:long,n:long>>, forest array<struct<a:long,b:long>>")
    def decide(todo: pd.Series, held: pd.Series) -> pd.DataFrame:
        out = []
        for asked, members in zip(todo, held, strict=True):
            trees = {m["path"]: (np.asarray(m["ids"], np.int64), np.asarray(m["weights"], np.int64), Tree(np.frombuffer(m["body"], "<f8").reshape(len(m["ids"]), -1))) for m in members}
            counts: dict[int, int] = {}
            joined = []
            for pair in asked:
                (ip, wp, a), (iq, wq, b) = trees[pair["p"]], trees[pair["q"]]
                got_a, got_b, forest = linked(a, b, cosine, wp, wq)
                for ids, got in ((ip, got_a), (iq, got_b)) if a is not b else ((ip, got_a),):
                    for i in np.flatnonzero(got):
                        counts[int(ids[i])] = counts.get(int(ids[i]), 0) + int(got[i])
                joined += [{"a": int(ip[i]), "b": int(iq[j])} for i, j in forest]
            out.append(([{"id": i, "n": n} for i, n in counts.items()], joined))
        del trees
        relieved()
        return pd.DataFrame(out, columns=["counts", "forest"])

    decided = scratch(todo.join(bodies, ["g", "tp", "tq"]).select(decide("todo", "leaves").alias("d")).select("d.*"), "decided", rows=1)
    counts = decided.select(F.explode("counts").alias("c")).select("c.*").groupBy("id").agg(F.sum("n").alias("n"))
    return counts, decided.select(F.explode("forest").alias("e")).select("e.*")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, cap: int = 2048, fan: int = 32) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    rows = rows.withColumn("ok", _valid("vec") & F.col("label").isNotNull()).withColumn("g", F.concat_ws("/", F.size("vec").cast("string"), "label"))
    good = rows.where("ok")
    # a point of equal vectors is named by a number of its own, for keys may be null or repeat
    scratch = Scratch(vectors.sparkSession)
    points = scratch(good.groupBy("g", "vec").agg(F.min("id").alias("least"), F.count("*").alias("weight")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    counts, forest = links(points.select("g", "id", "weight", "vec"), cosine, cap, fan, scratch)
    roots = components(forest, scratch)
    named = points.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    classes = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(classes, "root").join(counts, "id", "left").select("g", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked_rows = good.join(known, ["g", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    done = written_for_later(linked_rows.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), "linked")
    scratch.drop()
    return done

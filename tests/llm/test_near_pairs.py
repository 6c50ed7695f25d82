"""The near-duplicate stage against all pairs, at the similarity that it states."""

import random

import numpy as np
import pytest

from cairn.llm import similar

SF = "/root/testdata/sf0.01"


def all_pairs(texts, share=80):
    """The smallest index that links of the similarity reach, for each text."""
    sets, under, common, root = [], {}, {}, list(range(len(texts)))
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()})
    for i, s in enumerate(sets):
        for x in s:
            for j in under.setdefault(x, []):
                common[j, i] = common.get((j, i), 0) + 1
            under[x].append(i)

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), n in common.items():
        if 100 * n >= share * (len(sets[i]) + len(sets[j]) - n):
            a, b = up(i), up(j)
            root[max(a, b)] = min(a, b)
    return [up(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [2048, 4])
def test_every_pair_at_the_threshold_is_found(spark, block):
    """Pairs just over and just under 0.8, which differ in about 39 of 256 bits, under a passage that all texts share."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = " ".join(word() for _ in range(30))
    texts = []
    for i in range(300):
        words = [word() for _ in range(220)]
        changed = list(words)
        # each change away from others takes five shingles: 5 x c of n leave (n - 5c) / (n + 5c)
        for c in range(5 if i % 2 else 6):
            changed[10 + 12 * c] = word()
        texts += [" ".join(words) + " " + passage, " ".join(changed) + " " + passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(df, block=block).collect()}
    want = all_pairs(texts)
    assert len(set(want)) == 450
    assert got == dict(enumerate(want))


def test_links_equal_the_exact_similarity(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = all_pairs([r.text for r in rows])
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == {r.doc_id: rows[i].doc_id for r, i in zip(rows, want, strict=True)}


def test_heads_meet_at_any_order():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, extra = int(rng.integers(1, 200)), int(rng.integers(0, 30))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, extra).astype(np.uint64))))
        ranked = np.unique(rng.choice(np.union1d(a, b), 40))
        counts = rng.integers(3, 9, len(ranked))
        same = len(np.intersect1d(a, b))
        if same * 100 >= 80 * (len(a) + len(b) - same):
            assert np.isin(similar.head(a, ranked, counts, 80), similar.head(b, ranked, counts, 80)).any()


def test_bounds_never_rule_a_pair_out():
    """What sketches and heads bound is at least what the sets share, at any order and after elements moved back."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.85], rng.integers(0, 1 << 63, int(rng.integers(0, 60))).astype(np.uint64))))
        same = len(np.intersect1d(a, b))
        x, y = (np.frombuffer(similar.sketch(s), "<u2").astype(int) for s in (a, b))
        assert np.minimum(x, y).sum() >= same
        ranked, counts, moved = similar.moved_back(a[::7], np.full(len(a[::7]), 3), a[::5], rng.integers(1, 9, len(a[::5])))
        assert set(moved) <= set(a[::5]) and (np.diff(ranked.view(np.int64)) > 0).all()
        ha, hb = (similar.head(s, ranked, counts, 80) for s in (a, b))
        assert len(np.intersect1d(ha, hb)) + max(len(a) - len(ha), len(b) - len(hb)) >= same


@pytest.mark.parametrize("block", [2048, 40])
def test_large_groups_of_borderline_copies(spark, block):
    """Many copies of one text, each changed so that some pairs reach 0.8 and some do not, under a passage that others share."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(40)]
    texts = []
    for _ in range(150):
        changed = list(base)
        for _ in range(rng.randint(1, 4)):
            changed[rng.randrange(120)] = word()
        texts.append(" ".join(changed))
    texts += [" ".join([*passage, *[word() for _ in range(60)]]) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(df, block=block).collect()}
    assert got == dict(enumerate(all_pairs(texts)))


def test_a_forest_connects_what_all_links_of_a_group_connect():
    rng = np.random.default_rng(6)
    for turn in range(60):
        base, n = rng.integers(0, 1 << 62, int(rng.integers(20, 90))), int(rng.integers(2, 60))
        sets = [np.unique(np.concatenate((base[:1], base[rng.random(len(base)) < rng.uniform(0.8, 1)], rng.integers(0, 1 << 62, int(rng.integers(0, 9)))))) for _ in range(n)]
        ids, roots, block = np.arange(n) * 3, rng.integers(0, n, n), rng.integers(0, 2, n) if turn % 2 else np.zeros(n, int)

        def joined(links, roots=roots, n=n):
            label = roots.copy()
            for i, j in links:
                label[label == label[i]] = label[j]
            return [[label[i] == label[j] for j in range(n)] for i in range(n)]

        every = []
        for i in range(n):
            for j in range(i):
                same = len(np.intersect1d(sets[i], sets[j]))
                if same * 100 >= 80 * (len(sets[i]) + len(sets[j]) - same) and (block[i] != block[j] or len(set(block)) == 1):
                    every.append((j, i))
        x = np.stack([roots, [len(s) for s in sets], np.zeros(n, int), block], 1)
        a, b = similar.forest(ids, x, np.concatenate(sets), 80)
        found = [(i // 3, j // 3) for i, j in zip(a, b, strict=True)]
        assert set(found) <= set(every) and len(found) < n
        assert joined(found) == joined(every)


@pytest.mark.parametrize(("block", "elements", "blocks"), [(2048, 1 << 20, 1), (100, 5000, 10)])
def test_large_groups_without_links_write_few_rows(spark, monkeypatch, block, elements, blocks):
    """Copies that each change three words in a row: 0.89 where they change the same three, else 0.785, which no bound rules out.

    A table has at most the rows of all heads (24 of 116 shingles each), times the blocks that a group is dealt into.
    """
    rng = random.Random(29)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base, texts = [word() for _ in range(120)], []
    for i in range(320):
        changed, at = list(base), 4 + 7 * (i % 16)
        changed[at : at + 3] = [word() for _ in range(3)]
        texts.append(" ".join(changed))
    rows, call = [], similar.Scratch.__call__

    def counted(self, df, name, *more, **how):
        table = call(self, df, name, *more, **how)
        rows.append((table.count(), name))
        if name == "large":
            rows.append((sum(len(r.p.a) for r in table.select("p").collect()), name))
        return table

    monkeypatch.setattr(similar.Scratch, "__call__", counted)
    monkeypatch.setattr(similar, "ELEMENTS", elements, raising=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(df, block=block).collect()}
    want = all_pairs(texts)
    assert len(set(want)) == 16
    assert got == dict(enumerate(want))
    assert max(rows)[0] <= 24 * len(texts) * blocks

"""MinHash and embedding near-dedup and connected components against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from viewlens.llm import components as C
from viewlens.llm import embedding_dedup as E
from viewlens.llm import minhash_dedup as M
from viewlens.llm.shingles import Shingler

SCHEMA = "doc_id long, text string, lang string, kept string"


def roots_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    edges += [(200, 200 + k) for k in range(1, 40)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = roots_of({x for a, b in edges if a != b for x in (a, b)}, edges)
    assert {r.node: r.root for r in C.components(df).collect()} == want
    assert C.components(df.limit(0)).count() == 0


# ---------------------------------------------------------------------- MinHash
def word_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_near(rows, threshold=85):
    """Component of every id: rows with equal ids are one document."""
    sets = [(i, word_set(t)) for i, t in rows]
    edges = []
    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b and i is not None and j is not None and 100 * len(a & b) >= threshold * len(a | b):
                edges.append((i, j))
    return roots_of({i for i, _ in rows if i is not None}, edges)


def corpus(rng):
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((" " if rng.random() < 0.5 else "\n").join(copy).title())
    # a chain: neighbours are alike, the ends are not
    chain = [f"c{k}" for k in range(200)]
    rows += [" ".join(chain[k:k + 100]) for k in range(0, 60, 3)]
    rows += ["", None, " ", "a", "A", "a b", "a b c d e", "a b c d e ", "b a", "the " * 3000, "THE " * 2000]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [(2000, 2_000_000), (3, 150)])
def test_near_groups_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(M, "BUCKET_ROWS", blocks[0])
    monkeypatch.setattr(M, "BLOCK_SHINGLES", blocks[1])
    rng = random.Random(5)
    rows = list(enumerate(corpus(rng)))
    df = spark.createDataFrame([(i, t, "en", "yes") for i, t in rows], SCHEMA)
    want = brute_near(rows)
    got = M.near_groups(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(word_set(rows[r.doc_id][1]))
        assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    left = M.one_of_each(df)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == set(want.values())


def test_bundles_of_a_group_of_many_blocks_hold_two_blocks(spark, monkeypatch):
    """One group of near copies of many blocks, with one of its rows repeated very often."""
    from pyspark.sql import functions as F
    from pyspark.sql.group import GroupedData
    monkeypatch.setattr(M, "BUCKET_ROWS", 20)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 2000)
    largest = {}
    apply = GroupedData.applyInPandas

    def measured(self, func, schema):
        rows = self._df
        if "bundle" in rows.columns:
            volume = F.sum(F.length("shingles") / 8) if "shingles" in rows.columns else F.count(F.lit(1))
            what = "shingles" if "shingles" in rows.columns else "rows"
            largest[what] = rows.groupBy("bundle").agg(volume.alias("v")).agg(F.max("v")).first()[0]
        return apply(self, func, schema)

    monkeypatch.setattr(GroupedData, "applyInPandas", measured)
    base = [f"w{k}" for k in range(104)]
    rows = [(k, " ".join([*base, f"end{k}"])) for k in range(200)]  # 101 shingles each: 11 blocks
    rows += [rows[7]] * 300
    df = spark.createDataFrame([(i, t, "en", "yes") for i, t in rows], SCHEMA)
    got = M.near_groups(df).collect()
    assert len(got) == 500 and {r.component_id for r in got} == {0}
    # two blocks, dealt by hash: some blocks are larger than the mean
    assert largest["rows"] <= 2 * 20 * 2 and largest["shingles"] <= 2 * 2000 * 2, largest


def test_near_groups_with_null_and_repeated_ids(spark):
    a, b = "one two three four five six seven eight", "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(5, a), (5, a), (None, a), (7, b), (5, b), (None, "quite alone in here now"), (9, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "yes") for i, t in rows], SCHEMA)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in M.near_groups(df).collect())
    assert got == Counter({(5, 5, True): 3, (None, 5, True): 1, (7, 5, False): 1, (None, None, True): 2, (9, 9, True): 1})
    assert M.near_groups(df.limit(0)).count() == 0
    assert M.one_of_each(df).count() == 7


def test_minima_estimate_similarity():
    shingler, minhash = Shingler(), M.MinHash()
    a = [f"w{k}" for k in range(3000)]
    b = a[:2800] + [f"v{k}" for k in range(200)]
    x, y = (shingler.set_of(" ".join(t)) for t in (a, b))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    got = (minhash.minima(x) == minhash.minima(y)).mean()
    assert abs(got - true) < 0.1


def test_forest_joins_each_tree_once():
    f = M.Forest(6)
    f.link(0, np.array([1, 2]))
    f.link(3, np.array([4]))
    f.link(1, np.array([2, 3, 4]))
    assert len(f.edges) == 4 and len(set(f.tree.tolist())) == 2


# ------------------------------------------------------------------- embeddings
def clustered(rng, n, size=32):
    base = rng.standard_normal((n, size))
    out = []
    for v in base:
        v /= np.linalg.norm(v)
        for _ in range(rng.integers(1, 5)):
            noise = rng.standard_normal(size)
            out.append(v + noise / np.linalg.norm(noise) * rng.uniform(0, 0.35))
    return np.array(out)


def test_near_vectors_recall_and_exactness(spark):
    rng = np.random.default_rng(8)
    x = clustered(rng, 250)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(5000, rows[0][1], 2), (5001, (x[0] * 3).tolist(), 2)]
    odd = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] * 32, [1.0] * 16]
    rows += [(6000 + k, v, 3) for k, v in enumerate(odd)] + [(None, rows[3][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept int")
    got = {r.vec_id: r for r in E.near_vectors(df).collect()}
    assert len(got) == len(rows)
    # the null id's vector equals that of id 3
    ids = [r[0] for r in rows[:len(x) + 2]] + [-3]
    v = np.vstack([x, x[0], x[0] * 3, x[3]])
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= 0.9
    np.fill_diagonal(near, False)
    want = {i: int(n) for i, n in zip(ids, near.sum(axis=1))}
    have = {i: got[None if i == -3 else i].n_links for i in ids}
    assert all(have[i] <= want[i] for i in ids)
    assert sum(have.values()) >= 0.95 * sum(want.values())
    full = roots_of(ids[:-1], [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if -3 not in (ids[a], ids[b])])
    assert sum(got[i].component_id == full[i] for i in ids[:-1]) >= 0.95 * len(ids)
    for i in ids[:-1]:
        assert got[i].kept == (got[i].component_id == i) and full[got[i].component_id] == full[i]
    for k in range(len(odd)):
        assert (got[6000 + k].n_links, got[6000 + k].component_id, got[6000 + k].kept) == (0, 6000 + k, True)
    assert got[None].component_id == full[3] and got[None].kept is True
    assert E.near_vectors(df.limit(0)).count() == 0
    assert E.near_vectors(df.where("vec_id >= 6000 AND vec_id < 6006")).count() == 6


def test_windows_count_each_pair_once_per_table(spark):
    rng = np.random.default_rng(3)
    units = rng.standard_normal((60, 8))
    units /= np.linalg.norm(units, axis=1)[:, None]
    df = spark.createDataFrame([(k, u.tobytes()) for k, u in enumerate(units)], "node long, unit binary")
    tables, coarse, window = 12, 1, 0.4
    cell, at = E.entries_of(units, tables, coarse)
    want = Counter()
    for t in range(tables):
        for i in range(60):
            for j in range(i + 1, 60):
                if cell[i, t] == cell[j, t] and abs(at[i, t] - at[j, t]) <= window:
                    want[i, j] += 1
    assert Counter(map(tuple, E.collisions(df, tables, coarse, window).collect())) == want


def test_calibrated_count_finds_the_share_it_promises():
    rng = np.random.default_rng(5)
    units = rng.standard_normal((256, 64))
    units /= np.linalg.norm(units, axis=1)[:, None]
    for n in (500, 50_000):
        tables, coarse, window = E.shape(n, 0.9)
        count = E.least_count(units, tables, coarse, window, 0.9)
        assert 1 <= count <= E.COLLISIONS
    groups = defaultdict(int)
    for n in (10**3, 10**6):
        groups[n] = E.shape(n, 0.9)[0] * n
    assert groups[10**6] / groups[10**3] < 1000 ** 1.35

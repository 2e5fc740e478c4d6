"""Curriculum mixing, ranked search and centroid clustering against brute force, with awkward rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from asofkit.llm import curriculum, ordering, pivot_clusters, ranked_search  # noqa: E402


def test_running_places_and_sums(spark):
    from pyspark.sql import functions as F

    values = [random.Random(k).randrange(50) for k in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long").repartition(7)
    got = sorted((r["place"], r["id"], r["before"]) for r in ordering.running(df, [F.col("v").desc(), F.col("id")], "v").collect())
    order = sorted(range(len(values)), key=lambda k: (-values[k], k))
    assert got == [(n, k, b) for n, (k, b) in enumerate(zip(order, itertools.accumulate([0, *(values[k] for k in order)]), strict=False))]
    assert ordering.running(df.limit(0), [F.col("v")], "v").count() == 0


# curriculum


def mixed(rows, weights=(1, 2, 3), repeats=3):
    """rows: (id, text, source). For each row (id, size, source size, target, taken)."""
    size = [len(re.findall(curriculum.WORD, t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    full = set()
    while True:
        rest = sum(weight[s] for s in sources if s not in full)
        level = (sum(size) - sum(repeats * total[s] for s in full)) / rest if rest else 0
        more = {s for s in sources if repeats * total[s] <= weight[s] * level} - full
        if not more:
            break
        full |= more
    target = {s: repeats * total[s] if repeats * total[s] <= weight[s] * level else weight[s] * level for s in sources}
    taken = [0] * len(rows)
    for s in sources:
        own = sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (hashlib.md5((str(rows[k][0]) if rows[k][0] is not None else rows[k][1] or "").encode()).hexdigest(), rows[k][0] is not None, rows[k][0] or 0, size[k]))
        left = math.floor(target[s])
        for k in own * repeats:
            taken[k] += min(left, size[k])
            left -= min(left, size[k])
    return sorted(((r[0], n, total[r[2]], target[r[2]], t) for r, n, t in zip(rows, size, taken, strict=True)), key=str)


def words(n):
    return " ".join(["w"] * n)


MIXES = {
    "plain": [(k, words(5 + k % 13), f"s{k % 4}") for k in range(80)],
    "caps": [(k, words(40), "b") for k in range(30)] + [(100, words(3), "a"), (101, words(2), "c"), (102, words(7), None), (103, words(1), "d")],
    "hot": [(k, words(1 + k % 5), "big" if k % 3 else f"s{k}") for k in range(120)],
    "awkward": [(1, None, "a"), (1, words(4), "a"), (1, words(4), "a"), (None, words(9), "a"), (None, None, None), (None, words(9), "b"), (2, "", "e"), (3, " \t\n", "é"), (4, words(3000), "z")],
    "empty": [(1, None, "a"), (2, "", None)],
}


@pytest.mark.parametrize("name", list(MIXES))
def test_mix_against_brute_force(spark, name):
    rows = MIXES[name]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, source string, size int, place string").repartition(3)
    out = curriculum.mix(df, "doc_id", "text", "source").collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in out), key=str) == mixed(rows)
    assert all(r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0) for r in out)
    again = curriculum.mix(df.repartition(5), "doc_id", "text", "source").collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mix_of_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert curriculum.mix(df, "doc_id", "text", "source").count() == 0


def test_training_order_follows_the_schedules(spark):
    df = spark.createDataFrame([(k, words(10), f"s{k % 3}") for k in range(900)], "doc_id long, text string, source string")
    copies = curriculum.training_order(curriculum.placed(df, "doc_id", "text", "source")).collect()
    copies.sort(key=lambda r: r["number"])
    assert [r["number"] for r in copies] == list(range(len(copies)))
    assert [r["position"] for r in copies] == list(itertools.accumulate([0, *(r["words"] for r in copies)]))[:-1]
    assert [r["progress"] for r in copies] == sorted(r["progress"] for r in copies)
    early, late = (Counter(r["source"] for r in half) for half in (copies[: len(copies) // 2], copies[len(copies) // 2 :]))
    assert early["s0"] > 1.2 * late["s0"] and late["s2"] > 1.2 * early["s2"]


def test_inverse_integral_of_a_bent_schedule(spark):
    from pyspark.sql import functions as F

    schedule = ((0.0, 0.0), (0.25, 2.0), (0.5, 2.0), (0.5, 0.0), (0.75, 0.0), (1.0, 4.0))
    assert curriculum.integral(schedule) == pytest.approx(0.25 + 0.5 + 0.5)
    grid = np.linspace(0, 1, 400_001)
    weight = np.interp(grid, [0, 0.25, 0.5, 0.5 + 1e-12, 0.75, 1], [0, 2, 2, 0, 0, 4])
    area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2 / 400_000)])
    for q, at in spark.range(21).select((F.col("id") / 20).alias("q")).select("q", curriculum.progress_at(schedule, F.col("q")).alias("t")).collect():
        assert np.interp(at, grid, area) == pytest.approx(q * area[-1], abs=1e-5)


# ranked search


def ranked(docs, items, most=50):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    found = [(i, split(t)) for i, t in docs]
    n_docs, n_words = sum(bool(w) for _, w in found), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(split(t))
    out = []
    for item, own in wanted.items():
        scores = []
        for i, w in found:
            tf, m = Counter(w), 100 - 50 + (50 * len(w) * n_docs) // max(n_words, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in own if tf[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=str)


def prose(seed, n, words=60):
    r = random.Random(seed)
    return " ".join(f"t{min(r.randrange(words), r.randrange(words))}" for _ in range(n))


@pytest.mark.parametrize("entries, block", [(1 << 20, 4 << 20), (90, 120)])
def test_search_against_brute_force(spark, monkeypatch, entries, block):
    monkeypatch.setattr(ranked_search, "TRIE_ENTRIES", entries)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    texts = [prose(k, 1 + k * 7 % 60) for k in range(150)] + ["t1 t2 T3", "t1 t2 t3"] * 40 + [None, "", "--", "É t5,T5;é 5", prose(3, 5000)]
    docs = [*enumerate(texts), (3, "t1 t9"), (3, "t1 t9"), (None, "t1 t2 t3"), (None, "t1 t9")]
    items = [(k, prose(1000 + k, 12)) for k in range(9)] + [(20, None), (21, "??"), (22, "unheard"), (23, "5 é É"), (5, "t59 t58"), (None, "t1 t2")]
    df = spark.createDataFrame([(i, t, "x", -1) for i, t in docs], "doc_id long, text string, item string, n int").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in ranked_search.search(df, asked).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == ranked(docs, items)


def test_search_of_no_rows(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for d, i in ((docs, items), (one, items.limit(0)), (docs, items.limit(0)), (one.selectExpr("doc_id", "CAST(NULL AS STRING) AS text"), items)):
        assert ranked_search.search(d, i).count() == 0


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_trie_bounds_hold_and_spare_documents(leaf):
    r, spared = np.random.default_rng(leaf), 0
    for _ in range(30):
        n = int(r.integers(2, 400))
        vectors = [np.unique(np.minimum(r.integers(0, 40, k), r.integers(0, 40, k))) for k in r.integers(1, 12, n)]
        at, ranks = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]), np.concatenate(vectors)
        tfs, m, ids = r.integers(1, 9, len(ranks)), r.integers(50, 400, n), r.permutation(n)
        trie = ranked_search.Trie(ids, m, at, ranks, tfs, leaf)
        assert sorted(trie.ids) == list(range(n)) and all(b - a <= leaf or k for a, b, k in zip(trie.low, trie.high, trie.kids, strict=True))
        own = np.sort(r.choice(40, 8, replace=False))
        weights = np.zeros(40, np.int64)
        weights[own] = 100 * (own + 1)
        scores = np.zeros(n, np.int64)
        np.add.at(scores, np.repeat(np.arange(n), np.diff(at)), weights[ranks] * ranked_search.part(tfs, np.repeat(m, np.diff(at))))
        (got, found), scored = trie.search(own.tolist(), weights, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 5)
        expected = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if s > 0)[:5]
        assert list(zip((-got).tolist(), found.tolist(), strict=True)) == expected
        spared += n - scored
    assert spared > 0 or leaf == 64


# clusters


def clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    spread = Counter()
    for _, c, d in found:
        spread[c] += d
    return sorted(((i, c, d, spread[c], sum(spread.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def vectors(seed, n, dims=64, steps=9):
    r = random.Random(seed)
    return [[r.randrange(-steps, steps) / 32 + (k % 5) for _ in range(dims)] for k in range(n)]


@pytest.mark.parametrize("rows", [
    list(enumerate(vectors(1, 300))),
    list(enumerate([[(k % 7) / 64] * 64 for k in range(90)])),  # ties and empty centroids
    [*enumerate(vectors(2, 40)), (5, vectors(2, 6)[5]), (None, vectors(3, 1)[0]), (None, None), (90, [0.1] * 63), (91, [0.1] * 65), (92, [*[0.1] * 63, None]), (93, [*[0.1] * 63, float("nan")]), (94, [*[0.1] * 63, -float("inf")]), (95, [])],
    list(enumerate(vectors(4, 3))),
    [(1, None)],
], ids=["plain", "ties", "awkward", "few", "none"])
@pytest.mark.parametrize("pivots", [1, 8])
def test_clusters_against_brute_force(spark, rows, pivots):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    out = pivot_clusters.clustered(df, "vec_id", "embedding", pivots=pivots)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == clusters(rows)


def test_pivots_rule_centroids_out():
    r = np.random.default_rng(5)
    centroids = r.integers(-500, 500, (16, 64))
    v = centroids[r.integers(0, 16, 2000)] + r.integers(-20, 20, (2000, 64))
    pivots = pivot_clusters.choose_pivots(centroids)
    to_pivots = np.stack([pivot_clusters.squared(v, p) for p in pivots], 1)
    best, distance, computed = pivot_clusters.nearest(v, to_pivots, centroids, pivots)
    every = np.square(v[:, None] - centroids[None]).sum(-1)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert computed < 0.3 * every.size


def test_huge_components_count_as_the_largest(spark):
    df = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["distance"] for r in pivot_clusters.clustered(df, "vec_id", "embedding").collect()} == {1: 0, 2: 0, 3: 0}

"""Substring and passage removal, and the Jaccard join, against brute force on awkward tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from asofkit.llm import arrays, bwt_merge, components, decontaminate, jaccard_join, recompression


def cut_bytes(rows, length=50):
    """(n_bytes, n_removed, n_spans, sha256) per row; ids order rows, null last."""
    rank = {id_: k for k, id_ in enumerate(sorted({r[0] for r in rows if r[0] is not None}))}
    own = [(rank.get(i, len(rank)), (t or "").encode()) for i, t in rows]
    first = {}
    for r, b in own:
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(r, first.get(b[k : k + length], r))
    out = []
    for (i, _), (r, b) in zip(rows, own, strict=True):
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < r:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def cut_words(rows, width=35):
    own = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in own for k in range(len(w) - width + 1))
    out = []
    for i, w in own:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def sets(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def groups(texts):
    s, lead = [sets(t) for t in texts], list(range(len(texts)))
    for a in range(len(s)):
        for b in range(a):
            n = len(s[a] & s[b])
            if n and 100 * n >= 85 * len(s[a] | s[b]) and lead[a] != lead[b]:
                old, new = max(lead[a], lead[b]), min(lead[a], lead[b])
                lead = [new if x == old else x for x in lead]
    return [(k, len(x), lead[k]) for k, x in enumerate(s)]


@pytest.fixture
def awkward(passage):
    shared, other = passage(0, 60), passage(500, 80)
    return [
        None, "", " \n\t ", "short", shared, shared, f"x {shared} y", passage(3, 50), f"{other} {shared}", f"{other}\n{passage(900, 70)}", f"é{other}ü", "na " * 120, "na " * 90 + "end", "a b " * 60,
        f"{passage(2000, 40)} {passage(2000, 40)}", passage(2000, 39), passage(7000, 4000), passage(8000, 300), shared.upper(), "\u0000" * 60, "\u0000" * 55 + "b",
    ]


def test_bytes_of_earlier_documents_go(docs, rows, awkward):
    got = rows(bwt_merge.remove_repeats(docs(awkward), "doc_id", "text"), "doc_id")
    assert got == cut_bytes(list(enumerate(awkward)))


def test_words_of_repeated_windows_go(docs, rows, awkward):
    got = rows(recompression.remove_repeats(docs(awkward), "doc_id", "text"), "doc_id")
    assert got == cut_words(list(enumerate(awkward)))


def test_repeated_and_null_ids(docs, rows, passage):
    ids, texts = [7, 7, 3, None, None], [passage(0, 60), passage(0, 60), passage(0, 50), passage(0, 60), "z"]
    got = sorted(rows(bwt_merge.remove_repeats(docs(texts, ids), "doc_id", "text")), key=repr)
    assert got == sorted(cut_bytes(list(zip(ids, texts, strict=True))), key=repr)
    got = sorted(rows(recompression.remove_repeats(docs(texts, ids), "doc_id", "text")), key=repr)
    assert got == sorted(cut_words(list(zip(ids, texts, strict=True))), key=repr)
    found = jaccard_join.similar(docs(texts, ids), "doc_id", "text").select("doc_id", "n_shingles", "component_id")
    assert sorted(rows(found), key=repr) == sorted([(7, 57, 7), (7, 57, 7), (3, 47, 3), (None, 57, 7), (None, 1, None)], key=repr)


@pytest.mark.parametrize("blocks", [(4000, 1 << 24), (6, 1 << 24)])
def test_near_copies_are_linked(docs, rows, passage, awkward, blocks):
    words = passage(100, 120).split()
    near = [" ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in range(0, 120, 6)]
    chain = [" ".join(words[k : k + 60]) for k in range(0, 60, 4)]
    texts = [*awkward, *near, *chain, "one two three", "one two three", "ONE two three", "a b c d", "a b c d a b c d"]
    got = rows(jaccard_join.similar(docs(texts), "doc_id", "text", block_docs=blocks[0], block_bytes=blocks[1]).select("doc_id", "n_shingles", "component_id"), "doc_id")
    assert got == groups(texts)


@pytest.mark.parametrize("most", [4000, 6])
def test_one_document_of_each_group_stays(docs, rows, passage, awkward, most):
    words = passage(100, 120).split()
    texts = [*awkward, *(" ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in range(0, 120, 6)), *(" ".join(words[k : k + 60]) for k in range(0, 60, 4))]
    table = docs(texts)
    kept = jaccard_join.representatives(table, "doc_id", "text", block_docs=most)
    assert kept.columns == table.columns and dict(kept.dtypes) == dict(table.dtypes)
    assert rows(kept, "doc_id") == [tuple(r) for r, (own, _, component) in zip(rows(table, "doc_id"), groups(texts), strict=True) if own == component]


def test_representatives_of_repeated_and_null_ids(docs, rows, passage, spark):
    ids, texts = [7, 7, 3, None, None, 9, 9, None], [passage(0, 60), passage(0, 60), passage(0, 50), passage(0, 60), "z", None, "", None]
    kept = jaccard_join.representatives(docs(texts, ids), "doc_id", "text").select("doc_id", "text")
    assert sorted(rows(kept), key=repr) == sorted([(7, passage(0, 60)), (3, passage(0, 50)), (None, "z"), (9, None), (9, ""), (None, None)], key=repr)
    numbers = spark.createDataFrame([(1, 5), (2, None), (3, 5)], "doc_id long, text int")
    assert rows(jaccard_join.representatives(numbers, "doc_id", "text"), "doc_id") == [(1, 5), (2, None)]
    assert jaccard_join.representatives(numbers.limit(0), "doc_id", "text").count() == 0


def test_empty_tables(docs, spark):
    none = docs(["x"]).limit(0)
    assert bwt_merge.remove_repeats(none, "doc_id", "text").count() == recompression.remove_repeats(none, "doc_id", "text").count() == 0
    assert jaccard_join.similar(none, "doc_id", "text").count() == 0


def test_merged_transforms_give_the_order_of_all_suffixes():
    rng = np.random.default_rng(3)
    strings = rng.integers(97, 99, (40, 12)).astype(np.uint8)
    shards = [bwt_merge.transform(strings[k : k + 9]) for k in range(0, 40, 9)]
    for c, order, common in bwt_merge.merge(shards, 5):
        suffixes = [strings[i, c:].tobytes() for i in order]
        assert suffixes == sorted(suffixes)
        for a, b, n in zip(suffixes, suffixes[1:], common[1:], strict=False):
            assert a[:n] == b[:n] and (n == len(a) or a[n] != b[n])


def test_symbols_away_from_the_ends_do_not_depend_on_the_context():
    rng = np.random.default_rng(5)
    inner = rng.integers(0, 6, 200).astype(np.uint64)
    found = []
    for k in range(2):
        word = np.concatenate([rng.integers(0, 6, 30 + k), inner, rng.integers(0, 6, 9)]).astype(np.uint64)
        symbol, first, _ = recompression.parse(word, np.zeros(len(word), np.int64))
        assert np.diff(np.append(first, len(word))).max() <= recompression.MARGIN
        at = first - 30 - k
        found.append([(int(a), int(s)) for a, s in zip(at, symbol, strict=True) if 8 <= a < 192])
    assert found[0] == found[1] and len(found[0]) > 20


def test_signatures_meet_for_all_linked_sets():
    rng = np.random.default_rng(7)
    for size in (1, 2, 6, 7, 8, 13, 20, 47, 120, 400):
        for _ in range(30):
            a = rng.integers(0, 1 << 62, size).astype(np.uint64)
            apart = rng.integers(0, jaccard_join.may_differ(np.array(size)) + 1)
            b = np.concatenate([a[: size - apart // 2], rng.integers(0, 1 << 62, apart - apart // 2).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * len(np.union1d(a, b)):
                continue
            own = [np.unique(a), np.unique(b)]
            mark, doc = jaccard_join.signatures(np.concatenate(own), np.cumsum([0, len(own[0]), len(own[1])]))
            assert np.intersect1d(mark[doc == 0], mark[doc == 1]).size


def test_documents_with_a_common_signature_have_a_common_block(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    rng = np.random.default_rng(11)
    groups = [[f"{g}w{k}" for k in range(40)] for g in range(3)]
    texts = [list(groups[k % 3]) for k in range(90)]
    for words in texts:
        for k in rng.integers(0, 40, 3):
            words[k] = f"new{rng.integers(0, 4)}"
    texts = [" ".join(words) for words in texts]
    ids = rng.permutation(90).tolist()
    table = spark.createDataFrame(list(zip(ids, texts, strict=True)), "key long, text string").repartition(7)
    led = jaccard_join.candidates(table, 4, 85).persist()
    assert led.where("NOT between").count() and led.where("between").count()
    found = rows(jaccard_join.blocks(led))
    assert len(set(found)) == len(found)
    own = {i: {b for k, b in found if k == i} for i in ids}
    data = "".join(texts).encode()
    hashes, at = jaccard_join.shingles(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]))
    mark, doc = jaccard_join.signatures(hashes, at)
    marks = [set(mark[doc == k].tolist()) for k in range(90)]
    lost = [(ids[a], ids[b]) for a in range(90) for b in range(a) if marks[a] & marks[b] and not own[ids[a]] & own[ids[b]]]
    assert not lost


def test_components_of_a_chain_and_a_star(spark, rows):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = rows(components.components(spark.createDataFrame(edges, "a long, b long")), "a")
    assert got == [(k, 0) for k in range(21)] + [(k, 100) for k in range(100, 130)]


def thue_morse(n, swap=False):
    """Two words of n letters that any polynomial hash modulo 2**64 takes for one from n = 1,024 on."""
    return "".join("ab"[(bin(k).count("1") + swap) % 2] for k in range(n))


@pytest.mark.parametrize("n", [64, 65, 1024, 4096])
def test_words_that_collide_under_polynomials_are_different(docs, rows, spark, n):
    fill = [f"w{k}" for k in range(34)]
    texts = [" ".join([*fill[:17], thue_morse(n, s), *fill[17:]]) for s in (False, True)] + [thue_morse(n), thue_morse(n, True)]
    got = rows(recompression.remove_repeats(docs(texts), "doc_id", "text"), "doc_id")
    assert got == cut_words(list(enumerate(texts))) and [g[2] for g in got] == [0, 0, 0, 0]
    assert rows(jaccard_join.similar(docs(texts), "doc_id", "text").select("doc_id", "n_shingles", "component_id"), "doc_id") == groups(texts)
    assert rows(bwt_merge.remove_repeats(docs(texts), "doc_id", "text"), "doc_id") == cut_bytes(list(enumerate(texts)))
    bench = spark.createDataFrame([(1, thue_morse(n))], "item_id long, text string")
    assert rows(decontaminate.contamination(docs(texts), bench).select("n_hit"), "doc_id") == [(1,), (0,), (1,), (0,)]


def test_names_that_clash_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(arrays, "word_names", lambda data, start, end, salt=0: (end - start).astype(np.uint64))
    data = np.frombuffer(b"one two six one three two", np.uint8)
    start, end, _ = arrays.words(data, np.array([0, len(data)]), arrays.NOT_SPACE)
    first, own = arrays.distinct_words(data, start, end)
    assert own.tolist() == [0, 1, 2, 0, 3, 1] and first.tolist() == [0, 1, 2, 4]
    lines = np.array([[1, 2], [3, 4], [1, 2], [3, 5]], np.uint8)
    first, own = bwt_merge.distinct(lines)
    assert (lines[first[own]] == lines).all() and len(first) == 3


def test_lists_are_merged_with_skips():
    rng = np.random.default_rng(2)
    for needed in (1, 2, 3, 5):
        lists = [sorted(rng.choice(60, rng.integers(1, 30), replace=False).tolist()) for _ in range(9)]
        many = Counter(d for own in lists for d in own)
        found, count = jaccard_join.merge_skip(lists, needed)
        assert dict(zip(found.tolist(), count.tolist(), strict=True)) == {d: n for d, n in many.items() if n >= needed}
        assert [x.tolist() for x in jaccard_join.merge_runs(np.concatenate([np.array(own) for own in lists]), needed)] == [found.tolist(), count.tolist()]


@pytest.mark.parametrize(("heap", "dense"), [(0, 1), (10**9, 10**9), (40, 3), (10**9, 1), (0, 10**9)])
def test_searches_find_all_links_of_a_block(monkeypatch, heap, dense):
    """Near copies about the threshold: by heap or by runs, by bitmaps or by binary probes."""
    monkeypatch.setattr(jaccard_join, "HEAP", heap)
    monkeypatch.setattr(jaccard_join, "DENSE", dense)
    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
    sets = []
    for k in range(150):
        own = base.copy()
        at = rng.choice(60, rng.integers(0, 9), replace=False)
        own[at] = rng.integers(1 << 41, 1 << 50, len(at))
        sets.append(np.unique(own) if k % 5 else np.unique(rng.choice(base, 12)))
    hashes, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    lists = jaccard_join.Lists(np.unique(hashes, return_inverse=True)[1], at, np.arange(150))
    linked = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
    for q in range(0, 150, 7):
        assert lists.search(q, 85).tolist() == [d for d in range(150) if linked(q, d)]


@pytest.mark.parametrize("seed", range(3))
def test_links_over_many_files_of_hot_groups(spark, rows, tmp_path, monkeypatch, seed):
    """Groups that are hot in single files, whose leaders are led elsewhere by other parts of their sets."""
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 6)
    r = random.Random(seed)
    base = [[f"g{g}w{k}" for k in range(16)] for g in range(4)]
    texts = []
    for k in range(160):
        words = list(base[r.randrange(4)])
        for _ in range(r.randrange(3)):
            words[r.choice((0, 15, r.randrange(16)))] = f"x{r.randrange(6)}"
        if not k % 5:  # halves of two groups: parts of a set with other leaders
            words = base[r.randrange(4)][:8] + base[r.randrange(4)][8:]
        texts.append(" ".join(words))
    ids = r.sample(range(1000), len(texts))
    for k in range(8):
        spark.createDataFrame(list(zip(ids, texts, strict=True))[k::8], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/part{k}")
    got = rows(jaccard_join.similar(spark.read.parquet(*(f"{tmp_path}/part{k}" for k in range(8))), "doc_id", "text", block_docs=6).select("doc_id", "n_shingles", "component_id"), "doc_id")
    order = sorted(range(len(ids)), key=lambda k: ids[k])
    own = [ids[k] for k in order]
    assert got == [(own[k], n, own[lead]) for k, n, lead in groups([texts[k] for k in order])]

"""The pipeline against its stages' rules applied by hand."""

import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from asofkit.llm import secrets  # noqa: E402


def test_stages(spark, passage, tmp_path):
    secret = "token = abcdef123456"
    texts = [passage(0, 80), passage(0, 80), passage(0, 79) + " end0", f"{passage(3000, 60)} {secret}", passage(9000, 40) + " " + passage(5000, 13), "123 ...", None, passage(6000, 700)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage(5000, 13))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        seen.append((name, sorted(r["doc_id"] for r in kept.collect())))
    assert [ids for _, ids in seen] == [[0, 1, 2, 3, 4, 7], [0, 3, 4, 7], [0, 3, 7], [0, 3, 7]]
    text = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert text[3] == re.sub(re.escape(secret), "*" * len(secret), texts[3]) and text[0] == texts[0]
    assert not [r for r in secrets.find_secrets(kept, "doc_id", "text").collect() if r["spans"]]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 3, 7]


def test_near_duplicates_are_five_word_shingles_at_four_fifths(spark, passage):
    words = [passage(k, 50).split() for k in (0, 2000, 4000)]
    near = [" ".join([*w[:25], *(f"new{k}" for k in range(n)), *w[25 + n :]]) for n, w in enumerate(words, 1)]
    texts = [t for w, other in zip(words, near, strict=True) for t in (" ".join(w), other)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(46)} for t in texts]
    expected = [a for a in range(6) if not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for b in range(a))]
    assert expected == [0, 2, 3, 4, 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == expected

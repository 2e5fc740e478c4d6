"""All operators and stages on awkward tables: nulls, empty and very long texts, repeated rows, no rows, clashing column names."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from asofkit.llm import arrays, bwt_merge, byte_bpe, decontaminate, jaccard_join, langid, matroska, recompression, secrets, token_counts, zip_warc  # noqa: E402

BPE, WORDS = public.path("byte_bpe_multi_50k.tiktoken"), public.path("word_bpe_49k.json")


def _archives(docs):
    return zip_warc.read_archives(zip_warc.build_archives(docs.withColumn("url", docs["row"]), "doc_id", "url", "text")).withColumnRenamed("id", "doc_id")


def _languages(docs):
    model = langid.fit(docs.where("length(text) < 5000"), "text", "key")
    return langid.identify(docs, "doc_id", "text", model)


#: By name: the operator with its id column, and whether equal texts get equal results in rows of different ids.
OPERATORS = {
    "op1": (lambda docs: matroska.media_report(matroska.store_media(docs, "doc_id", "text"), "doc_id", "media", "n_bytes"), True),
    "op2": (lambda docs: bwt_merge.remove_repeats(docs, "doc_id", "text"), False),
    "op3": (lambda docs: jaccard_join.similar(docs, "doc_id", "text").select("doc_id", "n_shingles", "component_id"), True),
    "op4": (lambda docs: decontaminate.contamination(docs, docs.where("length(text) BETWEEN 100 AND 5000").withColumnRenamed("doc_id", "item_id")), True),
    "op5": (_languages, True),
    "op6": (lambda docs: byte_bpe.encode(docs, "doc_id", "text", BPE, public.PATTERN), True),
    "op7": (lambda docs: recompression.remove_repeats(docs, "doc_id", "text"), True),
    "op8": (lambda docs: _archives(docs).drop("record_type", "refers_to"), True),
    "op9": (lambda docs: secrets.find_secrets(docs, "doc_id", "text"), True),
    "op10": (lambda docs: token_counts.count_tokens(docs, "doc_id", "text", WORDS), True),
}


def _plain(row):
    return json.loads(json.dumps(row.asDict(recursive=True), default=lambda v: bytes(v).hex()))


@pytest.fixture
def texts(passage):
    long_text = passage(20_000, 180_000)
    assert len(long_text) > arrays.SLICE_BYTES / 2 and len(long_text.encode()) > 1 << 20
    long_text += " " + passage(300_000, 180_000)
    assert len(long_text.encode()) > arrays.SLICE_BYTES
    return [None, "", " \n ", "x", passage(0, 60), long_text, passage(0, 60), long_text, "é" * 3000, None, "token = abcdef123456 " + passage(0, 40)]


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators(docs, texts, name):
    operator, alike = OPERATORS[name]
    assert operator(docs(texts).limit(0)).count() == 0
    got = {r["doc_id"]: _plain(r) for r in operator(docs(texts)).collect()}
    assert sorted(got) == list(range(len(texts)))
    if alike:
        for a, b in ((4, 6), (5, 7), (0, 9)):
            one, other = ({k: v for k, v in got[i].items() if k != "doc_id"} for i in (a, b))
            if name == "op3" and a == 0:  # documents without shingles are linked with nothing
                one, other = (x["n_shingles"] for x in (one, other))
            assert one == other, (name, a)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_repeated_and_null_ids(docs, name, passage):
    operator, _ = OPERATORS[name]
    ids, texts = [7, 7, 3, None, None, 7], [passage(0, 60), passage(0, 60), passage(0, 50), passage(0, 60), "z", None]
    got = sorted((_plain(r) for r in operator(docs(texts, ids)).collect()), key=str)
    assert sorted((r["doc_id"] for r in got), key=str) == sorted(ids, key=str)
    again = sorted((_plain(r) for r in operator(docs(texts[::-1], ids[::-1])).collect()), key=str)
    assert got == again


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, texts, tmp_path, name, passage):
    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame([(1, passage(9_000_000, 20)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = docs(texts).withColumn("lang", F.col("key"))
    assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0
    out = stage(spark, rows, str(tmp_path))
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == rows.columns
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    every = set(range(len(texts)))
    assert kept == {"language_id": every - {0, 1, 2, 9}, "near_duplicates": every - {6, 7}}.get(name, every)


def test_long_texts_have_whole_results(docs, texts):
    """A text over one slice is not cut: its own digests and counts come back."""
    body = texts[5].encode()
    media = OPERATORS["op1"][0](docs(texts[5:6])).first()
    assert media["payload_bytes"] == -(-len(body) // 192) * 192 and media["payload_sha256"] == hashlib.sha256(body.ljust(media["payload_bytes"])).hexdigest()
    assert media["media_sha256"] == hashlib.sha256(matroska.store_media(docs(texts[5:6]), "doc_id", "text").first()["media"]).hexdigest()
    assert OPERATORS["op6"][0](docs(texts[5:6])).first()["decoded_sha256"] == hashlib.sha256(body).hexdigest()
    assert OPERATORS["op2"][0](docs(texts[5:6])).first()["kept_sha256"] == hashlib.sha256(body).hexdigest()
    removed = {r["doc_id"]: r["n_removed"] for r in OPERATORS["op7"][0](docs(texts[4:8], range(4, 8))).collect()}
    assert removed == {4: 60, 5: 360_000, 6: 60, 7: 360_000}

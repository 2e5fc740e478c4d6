"""Language identification as a mixture: each word of a document comes from one of the learned languages.

Hashed byte n-grams give every word a likelihood under every language. Expectation-maximisation estimates
a document's proportions; the set of languages is the one of highest likelihood less a penalty for each further language.
A word's likelihood depends on the word alone, so it is found once for each distinct word of a run of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays

ORDERS = (2, 3, 4)
#: Bits of a cell's number in each order's table, and bytes of the whole model, which is broadcast: more languages than fit take smaller tables.
BITS, MODEL_BYTES = 16, 200 << 20
#: Cells whose counts travel together.
BLOCK = 4096
#: Words that are worked on at once.
CHUNK = 1 << 16
#: A document's proportions are found when a step moves none of them so far.
TOLERANCE = 1e-4
#: Log-likelihood that a further language must gain, times the log of the number of words.
PENALTY = 3.0
#: Log-likelihood a word by which proportions that are found may stay below the best ones.
SLACK = 1e-3
UNKNOWN = "und"

_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_ANY_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """Languages by name and log-probabilities, a row for each cell."""

    languages: list[str]
    table: np.ndarray  # (ORDERS * 2**bits, languages), float32
    bits: int


def bits_for(languages: int) -> int:
    """Bits of a cell's number, so that the model stays below MODEL_BYTES."""
    most = MODEL_BYTES // (4 * len(ORDERS) * max(1, languages))
    return max(4, min(BITS, most.bit_length() - 1))


def distinct_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of each distinct word, and of all words the number among these and the row."""
    low = arrays.LOWER[data]
    start, end, row = arrays.words(low, at, _LETTER)
    first, own = arrays.distinct_words(low, start, end)
    return low, start[first], end[first], own, row


def cells(data: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders, places) cells of the n-grams of words, each with a space before it and spaces after, and where each word's places begin."""
    size = end - start + 1  # n-grams begin at the space before a word and at each of its bytes
    wide = size + max(ORDERS)
    at = np.cumsum(wide) - wide
    text = np.full(int(wide.sum()), 32, np.uint8)
    text[arrays.spans(at + 1, size - 1)] = data[arrays.spans(start, size - 1)]
    place, out = arrays.spans(at, size), []
    gram = np.zeros(len(place), np.uint32)
    for k in range(max(ORDERS)):
        gram = gram << np.uint32(8) | text[place + k]
        if k + 1 in ORDERS:
            out.append((gram * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)).astype(np.int64) + (len(out) << bits))
    return np.stack(out), np.cumsum(size) - size


def is_training(id_col: str) -> Column:
    """All documents but the held-out quarter."""
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


def fit(df: DataFrame, text_col: str, lang_col: str, smoothing: float = 0.5) -> Model:
    """Counts the n-grams of every whole text that has a language. Without such texts the model knows no language.

    Tasks send their counts by language and block of cells; the sums of a block are added up row by row.
    """
    arrays.bounded_batches(df.sparkSession)
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    bits = bits_for(rows.select("lang").distinct().count())
    total, schema = len(ORDERS) << bits, "lang string, block int, counts binary"

    def sent(held: dict[tuple[str, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (lang, block), counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([block], pa.int32()), pa.array([arrays.pack(counts)], pa.binary())], names=["lang", "block", "counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for part, data, at in arrays.slices(batches, limit=arrays.SLICE_BYTES // 2):
            low, start, end, own, row = distinct_words(data, at)
            langs, which = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            for k, lang in enumerate(langs.tolist()):
                times = np.bincount(own[which[row] == k], minlength=len(start))
                used = np.flatnonzero(times)
                counts = held.setdefault(lang, np.zeros(total))
                for at_ in range(0, len(used), CHUNK):
                    some = used[at_ : at_ + CHUNK]
                    cell, _ = cells(low, start[some], end[some], bits)
                    weight = np.repeat(times[some], end[some] - start[some] + 1)
                    counts += np.bincount(cell.ravel(), np.tile(weight, len(ORDERS)), total)
        yield from sent({(lang, low): counts[low : low + BLOCK].astype(np.int64) for lang, counts in held.items() for low in range(0, total, BLOCK) if counts[low : low + BLOCK].any()})

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for lang, block, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "counts")), strict=True):
                if (lang, block) != now:
                    if now:
                        yield from sent({now: held})
                    now, held = (lang, block), 0
                held = held + arrays.unpack(counts, "i8")[0]
        if now:
            yield from sent({now: held})

    added = rows.mapInArrow(count, schema).repartition(arrays.partitions(df.sparkSession), "lang", "block").sortWithinPartitions("lang", "block").mapInArrow(add, schema)
    found = added.collect()  # MODEL_BYTES bounds it
    languages = sorted({r["lang"] for r in found})
    table = np.full((total, len(languages)), smoothing, np.float32)
    for r in found:
        counts = arrays.unpack(r["counts"], "i8")[0]
        table[r["block"] : r["block"] + len(counts), languages.index(r["lang"])] += counts
    for k in range(len(ORDERS)):
        own = table[k << bits : (k + 1) << bits]
        own[:] = (np.log(own) - np.log(own.sum(0, dtype=np.float64))) / len(ORDERS)
    return Model(languages, table, bits)


def _by_doc(values: Callable[[slice], np.ndarray], doc: np.ndarray, n: int, width: int) -> np.ndarray:
    """Sums of values by document, chunk by chunk; doc is sorted."""
    out = np.zeros((n, width))
    for low in range(0, len(doc), CHUNK):
        part = slice(low, low + CHUNK)
        begin = np.flatnonzero(np.diff(doc[part], prepend=-1))
        out[doc[part][begin]] += np.add.reduceat(values(part), begin, axis=0)
    return out


def maximise(likelihood: np.ndarray, times: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood by document, from its distinct words and how often each occurs; `start` has zeros where a language is not in the set."""
    share, width = start.copy(), likelihood.shape[1]
    n = np.bincount(doc, times, len(share))
    live, words, own, often = np.arange(len(n)), likelihood, doc, times
    while len(live):
        now = share[live]

        def given(part: slice, words=words, now=now, own=own, often=often) -> np.ndarray:
            joint = words[part] * now[own[part]]
            return joint * (often[part] / joint.sum(1))[:, None]

        new = _by_doc(given, own, len(live), width) / n[live][:, None]
        on = np.abs(new - now).max(1) >= TOLERANCE
        share[live] = new
        if not on.all():  # documents that are done leave, each by itself
            keep = on[own]
            words, often, own, live = words[keep], often[keep], (np.cumsum(on) - 1)[own[keep]], live[on]
    return share, _by_doc(lambda part: (np.log((likelihood[part] * share[doc[part]]).sum(1)) * times[part])[:, None], doc, len(share), 1)[:, 0]


def word_logs(model: Model, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(words, languages) log-likelihoods."""
    out = np.zeros((len(start), len(model.languages)), np.float32)
    for k in range(0, len(start), CHUNK // 8):
        part = slice(k, k + CHUNK // 8)
        cell, at = cells(low, start[part], end[part], model.bits)
        out[part] = sum(np.add.reduceat(model.table[own], at, axis=0) for own in cell)
    return out


def infer(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(documents, languages) proportions; a document without words has zeros."""
    out = np.zeros((len(at) - 1, len(model.languages)))
    low, start, end, own, row = distinct_words(data, at)
    if not len(model.languages) or not len(own):
        return out
    logs = word_logs(model, low, start, end)
    pairs, times = np.unique(row * len(start) + own, return_counts=True)
    ids, doc = np.unique(pairs // len(start), return_inverse=True)
    word, n = pairs % len(start), np.bincount(doc, times)
    logs -= logs.max(1, keepdims=True)
    likelihood = np.exp(np.maximum(logs, -80))[word]
    full, most = maximise(likelihood, times, doc, np.full((len(ids), len(model.languages)), 1 / len(model.languages)))
    order = np.argsort(-full, axis=1, kind="stable")
    single = _by_doc(lambda part: logs[word[part]] * times[part][:, None].astype(np.float64), doc, len(ids), len(model.languages))
    best = single.argmax(1)
    share, value = np.zeros_like(full), single[np.arange(len(ids)), best]
    share[np.arange(len(ids)), best] = 1
    for k in range(2, len(model.languages) + 1):
        # no set is likelier than all languages: only documents that these would lift over the best set so far can gain
        use = np.flatnonzero(most + SLACK * n - PENALTY * (k - 1) * np.log(n + 1) > value)
        if not len(use):
            break
        keep = np.isin(doc, use)
        allowed = np.zeros((len(use), len(model.languages)))
        np.put_along_axis(allowed, order[use, :k], 1 / k, 1)
        fresh, gained = maximise(likelihood[keep], times[keep], np.searchsorted(use, doc[keep]), allowed)
        gained -= PENALTY * (k - 1) * np.log(n[use] + 1)
        better = gained > value[use]
        share[use[better]], value[use[better]] = fresh[better], gained[better]
    out[ids] = np.round(share, 9)
    return out


def identify(df: DataFrame, id_col: str, text_col: str, model: Model, carry: bool = False) -> DataFrame:
    """Per row: doc_id, lang_pred, score (the predicted language's proportion), languages, shares (of the selected set, largest first).

    A null text, a text without letters, and any text under an empty model are `und` with score 0; so are texts
    whose only letters leave no word. A text's memory grows with its distinct words times the languages. Equal texts get equal results; repeated rows give repeated results. carry adds the input row.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    limit = max(1 << 16, arrays.SLICE_BYTES // max(2, len(model.languages)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, data, at in arrays.slices(batches, limit=limit):
            share = infer(model, data, at)
            plain = np.zeros(len(data) + 1, np.int64)
            np.cumsum((arrays.LOWER[data] >= 97) & (arrays.LOWER[data] <= 122), out=plain[1:])
            found, score, names, parts = [], [], [], []
            for k, has in enumerate((plain[at[1:]] > plain[at[:-1]]).tolist()):
                own = np.argsort(-share[k], kind="stable")
                own = own[share[k][own] > 0]
                if not len(own) or not (has or _ANY_LETTER.search(rows.column("text")[k].as_py())):
                    own = own[:0]
                found.append(model.languages[own[0]] if len(own) else UNKNOWN)
                score.append(float(min(1.0, share[k][own[0]])) if len(own) else 0.0)
                names.append([model.languages[i] for i in own])
                parts.append(share[k][own].tolist())
            yield arrays.result(rows, {"doc_id": rows.column("doc_id"), "lang_pred": pa.array(found), "score": pa.array(score, pa.float64()), "languages": pa.array(names, pa.list_(pa.string())), "shares": pa.array(parts, pa.list_(pa.float64()))})

    kind = df.schema[id_col].dataType.simpleString()
    docs = arrays.texts(df, id_col, text_col, carry)
    return docs.mapInArrow(run, arrays.schema(f"doc_id {kind}, lang_pred string, score double, languages array<string>, shares array<double>", docs))

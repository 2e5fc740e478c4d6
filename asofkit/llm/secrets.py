"""Secret scans by a trigram inverted index.

Each rule's regex gives a Boolean query over trigrams. Every run of documents gets an inverted index of the
trigrams that some rule asks for; a rule's candidates come from intersecting and joining its postings, and
the regex verifies them. A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays


@dataclass(frozen=True)
class Rule:
    """kind, regex, and the least length of `group`; shorter matches are dropped. base: counted by kind.

    linear: a regex whose group 1 has the same matches and that looks at no run of characters twice, where `regex` would.
    """

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = False
    linear: str = ""


#: The base rules, then the more specific ones that the method adds. Fixed values.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # only the first eyJ of a run can match, or none of the run
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", linear=r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,})"),
    Rule("hosted", r"(?:ghp|gho|ghs|ghr)_[A-Za-z0-9]{30,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("live", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    # only the first letter of the run before :// can begin a match
    Rule("login", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@", linear=r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+://[^\s:/@]++:[^\s:/@]++@)"),
)

#: A query is True (any document), ("and", ...) or ("or", ...) over queries and trigrams of three lower-cased bytes.
Query = object


def _both(parts: list) -> Query:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *dict.fromkeys(parts))


def _either(parts: list) -> Query:
    return True if any(p is True for p in parts) else parts[0] if len(set(parts)) == 1 else ("or", *dict.fromkeys(parts))


def _literal(text: str) -> Query:
    raw = text.encode().translate(bytes(arrays.LOWER))
    return _both([raw[i : i + 3] for i in range(len(raw) - 2)])


#: So many strings can stand for a part of a regex; beyond that it only cuts the text.
STRINGS = 24


def trigram_query(pattern: str) -> Query:
    """What the trigrams of every match of a regex satisfy; letters count in either case."""

    def walk(items: Iterable) -> Query:
        """A sequence: the strings that can stand next to each other so far, and the queries of what was closed."""
        closed, open_strings = [], {""}

        def close() -> None:
            if open_strings != {""}:
                closed.append(_either([_literal(s) for s in open_strings]))

        for op, value in items:
            exact = strings([(op, value)])
            if exact is not None and len(open_strings) * len(exact) <= STRINGS:
                open_strings = {a + b for a in open_strings for b in exact}
                continue
            close()
            open_strings = exact if exact is not None else {""}
            if exact is None:
                closed.append(inner(op, value))
        close()
        return _both(closed)

    def inner(op: object, value: object) -> Query:
        if op is C.SUBPATTERN:
            return walk(value[-1])
        if op is C.BRANCH:
            return _either([walk(b) for b in value[1]])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            return walk(value[2])
        return True

    def strings(items: Iterable) -> set[str] | None:
        """All strings that a part can match, if they are few."""
        out = {""}
        for op, value in items:
            if op is C.LITERAL:
                own = {chr(value)}
            elif op is C.SUBPATTERN:
                own = strings(value[-1])
            elif op is C.BRANCH:
                each = [strings(b) for b in value[1]]
                own = None if None in each else set().union(*each)
            elif op is C.IN and all(k is C.LITERAL for k, _ in value):
                own = {chr(v) for _, v in value}
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[1] != C.MAXREPEAT and value[1] <= 3:
                one = strings(value[2])
                own, level = (None, {""}) if one is None else (set(), {""})
                for k in range(value[1] + 1):
                    if own is None:
                        break
                    if k >= value[0]:
                        own |= level
                    level = {a + b for a in level for b in one}
                    own = None if len(level) > STRINGS else own
            elif op is C.AT:
                own = {""}
            else:
                own = None
            if own is None or len(out) * len(own) > STRINGS:
                return None
            out = {a + b for a in out for b in own}
        return out

    return walk(sre.parse(pattern))


def trigrams_of(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set() if query is True else set().union(*map(trigrams_of, query[1:]))


class Index:
    """Postings, as ordinals of documents, of the wanted trigrams in a run of texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray, wanted: dict[bytes, int], table: np.ndarray):
        self.all = np.arange(len(at) - 1)
        self.postings: dict[bytes, np.ndarray] = {}
        if len(data) < 3:
            return
        low = arrays.LOWER[data].astype(np.uint32)
        which = table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        place = np.flatnonzero(which)
        doc = np.searchsorted(at, place, "right") - 1
        inside = place + 3 <= at[doc + 1]
        pairs = np.unique(which[place[inside]].astype(np.int64) << 32 | doc[inside])
        names = list(wanted)
        edges = np.searchsorted(pairs, np.arange(1, len(names) + 2) << 32)
        self.postings = {name: pairs[edges[k] : edges[k + 1]] & 0xFFFFFFFF for k, name in enumerate(names)}

    def find(self, query: Query) -> np.ndarray:
        if query is True:
            return self.all
        if isinstance(query, bytes):
            return self.postings.get(query, self.all[:0])
        lists = sorted(map(self.find, query[1:]), key=len)
        out = lists[0]
        for more in lists[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if query[0] == "and" else np.union1d(out, more)
        return out


@lru_cache(8)
def prepared(rules: tuple[Rule, ...]) -> tuple[list, dict[bytes, int], np.ndarray]:
    queries = [trigram_query(r.regex) for r in rules]
    wanted = {t: k + 1 for k, t in enumerate(sorted(set().union(*map(trigrams_of, queries))))}
    table = np.zeros(1 << 24, np.uint16)
    for t, k in wanted.items():
        table[t[0] << 16 | t[1] << 8 | t[2]] = k
    return queries, wanted, table


def matcher(rule: Rule) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Leftmost matches that do not overlap, without those whose group is too short."""
    if re.fullmatch(r"\[[^]]+\]\+", rule.regex) and rule.least > 1:  # a run of one class: only runs long enough can count
        found = re.compile(f"{rule.regex[:-1]}{{{rule.least},}}")
        return lambda text: (m.span() for m in found.finditer(text))
    if rule.linear:
        found = re.compile(rule.linear)
        return lambda text: (m.span(1) for m in found.finditer(text) if len(m[1]) >= rule.least)
    found = re.compile(rule.regex)
    return lambda text: (m.span() for m in found.finditer(text) if len(m[rule.group]) >= rule.least)


def find_secrets(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES, mask: bool = False) -> DataFrame:
    """Per row: doc_id, spans array<struct<kind, start, stop>> in code points (stop exclusive), by start, then by the rules' order.

    A null or empty text has none. Repeated rows give repeated results. mask adds the input row as `row` and the text
    without its secrets as `masked` (null stays null).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted, table = prepared(rules)
        match = [matcher(r) for r in rules]
        for rows, data, at in arrays.slices(batches):
            index, found, text = Index(data, at, wanted, table), {}, {}
            for k, query in enumerate(queries):
                for doc in index.find(query).tolist():
                    if doc not in text:
                        text[doc] = rows.column("text")[doc].as_py()
                    for low, high in match[k](text[doc]):
                        found.setdefault(doc, []).append((low, k, high))
            spans = [[{"kind": rules[k].kind, "start": low, "stop": high} for low, k, high in sorted(found.get(d, ()))] for d in range(rows.num_rows)]
            out = {"doc_id": rows.column("doc_id"), "spans": pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))}
            if mask:
                given = rows.column("row").field(text_col)
                out["masked"] = pa.array([mask_secrets(text[d] if own else given[d].as_py(), own) for d, own in enumerate(spans)], pa.string())
            yield arrays.result(rows, out)

    kind = df.schema[id_col].dataType.simpleString()
    docs = arrays.texts(df, id_col, text_col, mask)
    return docs.mapInArrow(run, arrays.schema(f"doc_id {kind}, spans array<struct<kind:string,start:int,stop:int>>" + ", masked string" * mask, docs))


def mask_secrets(text: str | None, spans: list | None, fill: str = "*") -> str | None:
    """A text whose spans are written over, one `fill` for each character."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        low = max(at, s["start"])
        out += [text[at:low], fill * max(0, s["stop"] - low)]
        at = max(at, s["stop"])
    return "".join([*out, text[at:]])

"""SQL twins of the text queries that SQL can express on the whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

#: The patterns of the secret rules as SQL regexes: kind, pattern, counted group, its least length; base rules first.
_SECRETS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("hosted", "(?:ghp|gho|ghs|ghr)_[A-Za-z0-9]{30,}", 0, 0),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("live", "(?:sk|rk)_live_[A-Za-z0-9]{16,}", 0, 0),
    ("login", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@", 0, 0),
)


def _matches(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of one rule with their places: the lengths of what lies between matches, and of the matches before."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {number} AS k, '{kind}' AS kind, len(gs[i]) >= {least} AS ok, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a, length(ms[i]) AS n
 FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS gs, string_split_regex(t, '{p}') AS ps FROM d))"""


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(_matches(n, *rule) for n, rule in enumerate(_SECRETS))}),
s AS (SELECT doc_id, k, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT) AS span FROM m WHERE ok),
g AS (SELECT doc_id, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex, string_agg(CASE WHEN k < 3 THEN span END, ',' ORDER BY a, k) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_PLAIN}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 4 THEN array_to_string(ws[i:i + 3], ' ') ELSE array_to_string(ws, ' ') || ' ' END AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

PHRASE_INDEX = rf"""
WITH iw AS (SELECT item_id, regexp_extract_all({_PLAIN}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT l, s, list_distinct(list(CAST(item_id AS VARCHAR))) AS ids FROM (SELECT item_id, least(13, len(ws)) AS l, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS i FROM iw WHERE len(ws) > 0)) GROUP BY l, s),
dw AS (SELECT doc_id, regexp_extract_all({_PLAIN}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dl AS MATERIALIZED (SELECT doc_id, i, l, array_to_string(ws[i:i + l - 1], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM dw), (SELECT DISTINCT l FROM win) WHERE i + l - 1 <= len(ws)),
h AS (SELECT doc_id, i, dl.l, ids FROM dl JOIN win ON win.s = dl.s AND win.l = dl.l),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS j FROM h) GROUP BY doc_id),
f AS (SELECT doc_id, list_sort(list_distinct(list(id))) AS ids FROM (SELECT doc_id, unnest(ids) AS id FROM h) GROUP BY doc_id)
SELECT dw.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(f.ids), 0) AS n_items, sha256(coalesce(array_to_string(f.ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN c ON c.doc_id = dw.doc_id LEFT JOIN f ON f.doc_id = dw.doc_id"""

RECOMPRESSION = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN md5(array_to_string(ws[i:i + 34], ' ')) END AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM w)),
t AS (SELECT h FROM s WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
c AS (SELECT s.*, bool_or(t.h IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM s LEFT JOIN t ON t.h = s.h)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256 FROM w LEFT JOIN (SELECT doc_id, CAST(count_if(gone) AS BIGINT) AS n_removed, string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY i) AS kept FROM c GROUP BY doc_id) g ON g.doc_id = w.doc_id"""


BWT_MERGE = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN 2 * i + 100 <= strlen(h) THEN md5(substr(h, 2 * i + 1, 100)) END AS s FROM (SELECT doc_id, h, unnest(generate_series(0, CAST(strlen(h) / 2 AS BIGINT) - 1)) AS i FROM b)),
f AS (SELECT s, min(doc_id) AS m FROM w WHERE s IS NOT NULL GROUP BY s),
c AS (SELECT w.doc_id, i, x, coalesce(bool_or(f.m < w.doc_id) OVER (PARTITION BY w.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), FALSE) AS gone FROM w LEFT JOIN f ON f.s = w.s),
d AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM c),
g AS (SELECT doc_id, count_if(gone) AS n_removed, count_if(opens) AS n_spans, string_agg(CASE WHEN NOT gone THEN x END, '' ORDER BY i) AS kept FROM d GROUP BY doc_id)
SELECT b.doc_id, CAST(strlen(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM b LEFT JOIN g ON g.doc_id = b.doc_id"""

ZIP_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages), f AS (SELECT d, min(page_id) AS m FROM p GROUP BY d)
SELECT page_id, strlen(h) AS payload_bytes, array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(p.d, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM p JOIN f ON f.d = p.d"""


def _progress(q: str) -> str:
    """The inverse integrals of the three schedules of curriculum.SCHEDULES: 1.5 to 0.5, 2 throughout, 1.5 to 4.5."""
    root = lambda whole, v, slope: f"2.0 * ({q} * {whole}) / ({v} + sqrt(greatest({v * v} + {2.0 * slope} * ({q} * {whole}), 0.0)))"
    return f"CASE kind WHEN 0 THEN {root(1.0, 1.5, -1.0)} WHEN 1 THEN {root(2.0, 2.0, 0.0)} ELSE {root(3.0, 1.5, 3.0)} END"


CURRICULUM = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS mark FROM documents),
s AS (SELECT source, n, (row_number() OVER o - 1) % 3 AS kind, CAST(sum(n) OVER (o ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS f FROM (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source) WINDOW o AS (ORDER BY source NULLS LAST)),
r AS (SELECT *, kind + 1.0::DOUBLE AS w, 3 * n AS cap, (3 * n) / (kind + 1.0::DOUBLE) AS ratio FROM s),
l AS (SELECT *, CAST(sum(n) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM r WINDOW b AS (ORDER BY ratio, f, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT level FROM l WHERE level * w <= cap ORDER BY ratio, f, source NULLS LAST LIMIT 1),
t AS (SELECT *, CASE WHEN cap <= w * level THEN CAST(cap AS DOUBLE) ELSE w * level END AS target FROM (SELECT r.*, v.level FROM r, v)),
c AS (SELECT d.*, t.n, t.f, t.kind, t.target, CAST(floor(t.target) AS BIGINT) AS quota, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mark, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS before FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
e AS (SELECT *, before + e * n AS a, least(quota - (before + e * n), size) AS words FROM (SELECT *, unnest([0, 1, 2]) AS e FROM c)),
p AS (SELECT doc_id, words, sum(words) OVER (ORDER BY {_progress("(CAST(a AS DOUBLE) / quota)")}, f, source NULLS LAST, a ROWS UNBOUNDED PRECEDING) - words AS position FROM e WHERE words > 0),
g AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS taken, count(*) AS copies, CAST(min(position) AS BIGINT) AS position FROM p GROUP BY doc_id)
SELECT c.doc_id, c.size, c.n AS source_size, c.target, coalesce(g.taken, 0) AS taken, coalesce(g.copies, 0) AS copies, g.position FROM c LEFT JOIN g ON g.doc_id = c.doc_id"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

DOCUMENT_TRIE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_PLAIN}, '{_TERM}') AS ws FROM documents),
z AS (SELECT count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
i AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all({_PLAIN}, '{_TERM}')) AS term FROM benchmark),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), z),
m AS (SELECT doc_id, 50 + (50 * len(ws) * n) // l AS m FROM d, z WHERE len(ws) > 0),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""


def _rounds(n: int) -> str:
    distance = "list_sum(list_transform(list_zip(v.v, c.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = ""
    for r in range(n + 1):
        out += f", a{r} AS MATERIALIZED (SELECT v.vec_id, v.v, min({distance} * 16 + c.c) AS k FROM v, c{r} c GROUP BY v.vec_id, v.v)"
        if r < n:
            out += f""", m{r + 1} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (SELECT k % 16 AS c, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(generate_series(1, 64)) AS i FROM a{r}) GROUP BY ALL) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.m, c.m) AS m FROM c{r} c LEFT JOIN m{r + 1} n ON n.c = c.c)"""
    return out


PIVOT_CLUSTERS = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS c, v AS m FROM v QUALIFY c < 16){_rounds(3)},
s AS (SELECT k % 16 AS c, CAST(sum(k // 16) AS BIGINT) AS n FROM a3 GROUP BY 1)
SELECT a.vec_id, CAST(s.c AS INTEGER) AS cluster, CAST(a.k // 16 AS BIGINT) AS distance, s.n AS cluster_inertia, CAST(sum(a.k // 16) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.m, ',')) AS centroid_sha256 FROM a3 a JOIN s ON s.c = a.k % 16 JOIN c3 ON c3.c = s.c"""

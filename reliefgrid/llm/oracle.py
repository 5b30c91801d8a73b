"""SQL forms of the queries, for DuckDB."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP1 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id != b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP2 = rf"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT item, len(v) AS size, array_to_string(v, ' ') AS v FROM (
    SELECT DISTINCT item, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w]
      ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS v FROM items)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS v
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes)),
hits AS (SELECT r.doc_id, r.i, r.size, w.item FROM runs r JOIN windows w ON r.v = w.v AND r.size = w.size),
per_word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
per_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN per_word USING (doc_id) LEFT JOIN per_item USING (doc_id)
"""

_OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id != c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

_OP5 = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
cuts AS (
  SELECT row, 'assign' AS kind, 0 AS k, regexp_extract_all(text, '{_ASSIGN}') AS m, regexp_split_to_array(text, '{_ASSIGN}') AS p FROM docs
  UNION ALL SELECT row, 'access', 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL SELECT row, 'hex', 2, regexp_extract_all(text, '[0-9a-f]+'), regexp_split_to_array(text, '[0-9a-f]+') FROM docs),
each AS (SELECT row, kind, k, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS found, unnest(p[1:len(m)]) AS gap FROM cuts),
placed AS (
  SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY row, kind ORDER BY i) AS stop FROM each),
kept AS (
  SELECT row, kind, k, (stop - length(found))::BIGINT AS start, stop::BIGINT AS stop FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(found, '{_ASSIGN}', 2)) >= 6
    WHEN 'access' THEN length(found) >= 20 ELSE length(found) >= 24 END),
listed AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
  FROM kept GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (row)
"""

_DISTANCE = "list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.c[i]) * (v.e[i] - c.c[i])))::HUGEINT"


def _rounds(rounds: int) -> str:
    """Assignments and moved centroids of each round, then the last assignment."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d
  FROM (SELECT v.row, c.cluster, {_DISTANCE} AS d FROM v, c{r} c) GROUP BY row)""")
        if r < rounds:
            parts.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
      FROM (SELECT a.cluster, unnest(range(1, 65)) AS i, unnest(v.e) AS x FROM a{r} a JOIN v ON v.row = a.row) GROUP BY cluster, i) GROUP BY cluster) m
  ON m.cluster = c.cluster)""")
    return ",".join(parts)


_OP11 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, embedding, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)::HUGEINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, embedding) - 1 AS cluster, e AS c
  FROM (SELECT sha256('1:' || vec_id) AS h, embedding, e FROM v) ORDER BY h NULLS LAST, embedding LIMIT 16),{_rounds(3)}
SELECT v.vec_id, a.cluster::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a3 a JOIN v ON v.row = a.row JOIN c3 c ON c.cluster = a.cluster
"""

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
_CARD = r"[0-9]([\x20-]?[0-9])+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TERM = r"[\pL\pN]+"
_KINDS = (("email", _EMAIL), ("ip", _IP), ("card", _CARD), ("phone", _PHONE))


def _pieces(side: str, lowered: str) -> str:
    """Terms of a context with their places in it."""
    return f"""SELECT blob, copies, entity, '{side}' AS side, begin, stop, part,
    unnest(range(1, len(w) + 1)) AS i, unnest(w) AS term, g, w
    FROM (SELECT *, {lowered} AS part, regexp_extract_all({lowered}, '{_TERM}') AS w, regexp_split_to_array({lowered}, '{_TERM}') AS g FROM base)"""


def _lowered(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


_OP12 = rf"""
WITH texts AS MATERIALIZED (SELECT sha256(coalesce(text, '')) AS blob, any_value(coalesce(text, '')) AS text, count(*) AS copies FROM documents GROUP BY ALL),
cuts AS (
  {" UNION ALL ".join(f"SELECT blob, copies, {i} AS number, '{k}' AS kind, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS p FROM texts" for i, (k, p) in enumerate(_KINDS))}),
each AS (SELECT blob, copies, number, kind, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS found, unnest(p[1:len(m)]) AS gap, unnest(p[2:len(m) + 1]) AS next FROM cuts),
placed AS (
  SELECT *, regexp_replace(found, '[^0-9]', '', 'g') AS digits,
    (sum(length(gap) + length(found)) OVER (PARTITION BY blob, number ORDER BY i))::BIGINT AS stop FROM each),
valid AS (
  SELECT *, stop - length(found) AS begin FROM placed WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(found, '.'), lambda x: length(ltrim(x, '0')) > 3 OR lpad(ltrim(x, '0'), 3, '0') > '255')) = 0
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN substr(reverse(digits), i, 1)::INTEGER
        ELSE (2 * substr(reverse(digits), i, 1)::INTEGER) // 10 + (2 * substr(reverse(digits), i, 1)::INTEGER) % 10 END)) % 10 = 0
    ELSE length(digits) BETWEEN 9 AND 15 END),
base AS MATERIALIZED (
  SELECT blob, copies, number, kind, begin, stop, right(gap, 65) AS before, left(next, 65) AS after,
    kind || ':' || CASE kind WHEN 'email' THEN {_lowered("found")} WHEN 'ip' THEN found ELSE digits END AS entity FROM valid),
context AS (
  {_pieces("before", _lowered("before"))} UNION ALL {_pieces("after", _lowered("after"))}),
located AS (
  SELECT *, CASE side WHEN 'before' THEN begin - length(part) ELSE stop END AS origin,
    (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0))::BIGINT AS place FROM context),
terms AS MATERIALIZED (
  SELECT DISTINCT blob, copies, entity, term, origin + place AS begin, origin + place + length(term) AS stop FROM located
  WHERE NOT (length(part) > 64 AND CASE side WHEN 'before' THEN place = 0 ELSE place + length(term) = length(part) END)),
held AS (SELECT entity, sum(copies) AS n_e FROM (SELECT DISTINCT blob, copies, entity FROM base) GROUP BY entity),
once AS (SELECT DISTINCT blob, copies, entity, term, CASE WHEN length(term) > 4 THEN left(term, 4) || '*' END AS stem FROM terms),
pairs AS (SELECT entity, term, stem, sum(copies) AS n FROM once GROUP BY ALL HAVING count(*) >= 2),
stems AS (SELECT entity, stem, sum(copies) AS n_stem FROM (SELECT DISTINCT blob, copies, entity, stem FROM once WHERE stem IS NOT NULL) GROUP BY entity, stem),
words AS (SELECT copies, list_distinct(regexp_extract_all({_lowered("text")}, '{_TERM}')) AS w FROM texts),
counts AS MATERIALIZED (
  SELECT key, sum(copies) AS n FROM (
    SELECT copies, unnest(w || list_distinct(list_transform(list_filter(w, lambda x: length(x) > 4), lambda x: left(x, 4) || '*'))) AS key FROM words)
  WHERE key IN (SELECT term FROM pairs UNION SELECT stem FROM pairs) GROUP BY key),
total AS (SELECT sum(copies)::DOUBLE AS rows FROM texts),
told AS (
  SELECT entity, term, CASE WHEN log2(rows * n_stem / (n_e * s.n)) < 0.75 * log2(rows / n_e) - 1e-9 THEN stem END AS label
  FROM pairs p JOIN held USING (entity) JOIN counts t ON t.key = p.term LEFT JOIN stems USING (entity, stem) LEFT JOIN counts s ON s.key = p.stem, total
  WHERE n_e < rows AND log2(rows * p.n / (n_e * t.n)) >= 0.75 * log2(rows / n_e) - 1e-9),
chosen AS (SELECT DISTINCT blob, begin, stop FROM terms JOIN told USING (entity, term)),
clear AS (SELECT * FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.blob = c.blob AND b.begin < c.stop AND c.begin < b.stop)),
every AS (SELECT blob, number, kind, begin, stop FROM base UNION ALL SELECT blob, 4, 'term', begin, stop FROM clear),
listed AS (
  SELECT blob, count(*) FILTER (number = 0) AS n_email, count(*) FILTER (number = 1) AS n_ip, count(*) FILTER (number = 2) AS n_card, count(*) FILTER (number = 3) AS n_phone,
    string_agg(kind || ':' || begin || ':' || stop, ',' ORDER BY number, begin) FILTER (number < 4) AS own,
    string_agg(kind || ':' || begin || ':' || stop, ',' ORDER BY number, begin) AS spans FROM every GROUP BY blob)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS address FROM documents) LEFT JOIN listed ON blob = address
"""

# Letters beyond ASCII as one byte each, since editing distance is counted in bytes here.
_FOLD = ("".join(chr(x) for x in range(0xC0, 0x100)), "".join(chr(x) for x in range(33, 97)).replace("'", "''"))

_OP13 = rf"""
WITH RECURSIVE bits AS (
  SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(0, 256)) AS b)),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
seen AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc || ':' || run, ''), lambda s:
    CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [195::BIGINT, unicode(s)::BIGINT - 64] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM seen, crc),
worn AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n, translate(word, '{_FOLD[0]}', '{_FOLD[1]}') AS f FROM worn WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
keys AS (
  SELECT word, n, f, unnest(list_distinct(list_concat([f], list_transform(range(1, length(f) + 1), lambda i: substr(f, 1, i - 1) || substr(f, i + 1))))) AS k FROM words),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM keys a JOIN keys b ON a.k = b.k AND a.word != b.word WHERE levenshtein(a.f, b.f) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS top FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 5 * w.n THEN other END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best USING (word)),
follow AS (SELECT word, word AS target FROM forms UNION ALL SELECT f.word, g.form FROM follow f JOIN forms g ON g.word = f.target WHERE g.form IS NOT NULL)
SELECT word, form, target AS root, n, n_near, form_n FROM forms JOIN (
  SELECT l.word AS key, target FROM follow l JOIN forms g ON g.word = l.target WHERE g.form IS NULL) ON key = word
"""

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": _OP1,
    "op2_benchmark_decontamination": _OP2,
    "op4_exact_top_k": _OP4,
    "op5_secret_scans": _OP5,
    "op11_centroid_clustering": _OP11,
    "op12_pii_sanitisation": _OP12,
    "op13_spelling_variants": _OP13,
}

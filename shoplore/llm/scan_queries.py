"""Queries of the operators that scan for licences, draw by importance and search by terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplore.llm.importance import importance_draw
from shoplore.llm.licenses import BASE_PHRASES, LIMITS, NOTICES, licence_digest, scan_licences
from shoplore.llm.ranked_search import ranked_search
from shoplore.llm.registry import query

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _places(phrase: str) -> str:
    words = phrase.split()
    here = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {here})"


_BASE_COLUMNS = ", ".join(f"{_places(p)} AS b{n}" for n, (p, _) in enumerate(BASE_PHRASES))
_BASE_ALL = " || ".join(f"b{n}" for n in range(len(BASE_PHRASES)))
_BASE_LABELS = ", ".join(f"CASE WHEN len(b{n}) > 0 THEN '{label}' END" for n, (_, label) in enumerate(BASE_PHRASES))
_NOTICE_LABELS = ", ".join(f"CASE WHEN len({_places(p)}) > 0 THEN '{label}' END" for p, label in NOTICES)
_LIMIT = " ".join(f"WHEN '{label}' THEN {limit}" for label, limit in LIMITS.items())

OP11_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents),
found AS (SELECT doc_id, w, {_BASE_COLUMNS} FROM docs),
told AS (SELECT doc_id, len(w) AS n_words, {_BASE_ALL} AS places,
  list_sort(list_distinct(list_filter([{_BASE_LABELS}], lambda x: x IS NOT NULL))) AS base,
  list_sort(list_distinct(list_filter([{_BASE_LABELS}, {_NOTICE_LABELS}], lambda x: x IS NOT NULL))) AS labels FROM found)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(labels, ',') AS labels,
  CAST(coalesce(list_max(list_transform(labels, lambda x: CASE x {_LIMIT} END)), 0) AS DOUBLE) AS score
FROM told
"""


@query(OP11_SQL)  # as long as no given text holds an identifier tag; tests have tags and expressions
def op11_licenses(table):
    return licence_digest(scan_licences(table("documents")))


_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
OP12_SQL = f"""
WITH crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: {_CRC_STEP})) AS t),
d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS.format(t='text')} AS w FROM documents),
b AS (SELECT {_WORDS.format(t='text')} AS w FROM benchmark),
dw AS (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
spelt AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295,
    list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket FROM spelt, crc),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (word) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN hashed USING (word) GROUP BY 1),
gain AS (SELECT g.bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(0, 10000)) AS bucket) g LEFT JOIN s ON s.bucket = g.bucket LEFT JOIN t ON t.bucket = g.bucket),
weighed AS (SELECT rid, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, rid, len(w) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5)
    / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (rid)),
placed AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (rid)
"""


@query(OP12_SQL)
def op12_importance(table):
    return importance_draw(table("documents"), table("benchmark"))


OP13_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS.format(t='text')} AS w FROM documents),
docs AS (SELECT doc_id, rid, len(w) AS n FROM d WHERE len(w) > 0),
size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
items AS (SELECT item_id, row_number() OVER () AS iid, {_WORDS.format(t='text')} AS w FROM benchmark),
asked AS (SELECT iid, term, count(*) AS times FROM (SELECT iid, unnest(w) AS term FROM items) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY 1),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, size),
part AS (SELECT rid, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))) AS part
  FROM tf JOIN weight USING (term) JOIN docs USING (rid), size),
scores AS (SELECT iid, rid, CAST(sum(times * part) AS BIGINT) AS score FROM asked JOIN part USING (term) GROUP BY ALL HAVING sum(times * part) > 0),
ranked AS (SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN docs USING (rid))
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (iid) WHERE rank <= 20
"""


@query(OP13_SQL)
def op13_search(table):
    return ranked_search(table("documents"), table("benchmark"))

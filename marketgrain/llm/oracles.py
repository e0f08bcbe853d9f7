"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from marketgrain.llm.licenses import EQUIVALENT, KNOWN, whole_texts
from marketgrain.llm.quality import BOILERPLATE

_SPACED = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM} AS w FROM benchmark),
iw AS (SELECT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g FROM b, generate_series(1, greatest(1, len(w) - 12)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM d, ks, generate_series(1, len(w) - k + 1) AS t(i)),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN iw USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _normalised(text: str) -> str:
    sql = f"regexp_replace(lower({text}), '(?m)^[ \\t*#/;-]*(copyright\\b|\\(c\\)|©|all rights reserved\\b)[^\\n]*$', '', 'g')"
    sql = f"(' ' || regexp_replace({sql}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') || ' ')"
    for spelt, as_ in EQUIVALENT.items():
        sql = f"replace({sql}, {_quote(spelt)}, {_quote(as_)})"
    return sql


def _digest(text: str) -> str:
    one = f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'))"
    return f"CASE WHEN {one} <> '' THEN sha256({one}) END"


_VALUES = ", ".join(f"({_quote(k)}, {_quote(v)})" for k, v in KNOWN.items())


def _scan(documents: str, known: str = _VALUES, more: str = "") -> str:
    return f"""
WITH {more}known AS (SELECT {_digest('n')} AS digest, min(license_id) AS license_id FROM (SELECT license_id, {_normalised('text')} AS n FROM (VALUES {known}) AS t(license_id, text)) GROUP BY 1),
d AS (SELECT doc_id, {_normalised('text')} AS n FROM {documents}),
whole AS (SELECT doc_id, {_digest('n')} AS digest FROM d),
lines AS (SELECT doc_id, {_digest('l')} AS digest FROM (SELECT doc_id, unnest(string_split(n, chr(10))) AS l FROM d)),
hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS names FROM lines JOIN known USING (digest) GROUP BY 1)
SELECT whole.doc_id, whole.digest AS text_sha256, known.license_id AS license, coalesce(hits.n, 0) AS n_license_lines, coalesce(names, '') AS line_licenses
FROM whole LEFT JOIN known ON known.digest = whole.digest LEFT JOIN hits ON hits.doc_id = whole.doc_id"""


OP4 = _scan("documents")
_WHOLE = whole_texts()
_COPIES = f"""texts AS (SELECT * FROM (VALUES {', '.join(f'({k}, {_quote(t)})' for k, (_, t) in enumerate(_WHOLE))}) AS t(k, t)),
shouted AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(t) ELSE t END AS t FROM documents JOIN texts ON k = (doc_id // 20) % {len(_WHOLE)} WHERE doc_id % 20 = 0),
spelt AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(t, 'license', 'licence') ELSE t END AS t FROM shouted),
copies AS (SELECT -1 - doc_id AS doc_id, 'Copyright (c) 2024 Author ' || doc_id || chr(10) || 'All rights reserved.' || chr(10) || chr(10) || CASE WHEN doc_id % 11 = 0 THEN replace(t, ',', ' ,') ELSE t END AS text FROM spelt),
"""
OP4_TEXTS = _scan("(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM copies)", _VALUES + "".join(f", ({_quote(n)}, {_quote(t)})" for n, t in _WHOLE), _COPIES)

_BOILERPLATE = " OR ".join(f"contains(lower(l), {_quote(p)})" for p in BOILERPLATE)
_COUNT = "len(regexp_extract_all({}, '{}'))".format
OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPACED} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, generate_series(1, len(w) - 2) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
worded AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup FROM l WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
judged AS (SELECT doc_id, l, {_COUNT('l', '[^\\x20\\x09-\\x0D]+')} AS n, {_COUNT('l', '[#*$%&|<>]')} AS symbols FROM l),
lost AS (SELECT doc_id, sum(n) AS lost FROM judged WHERE n > 0 AND ((n < 3 AND NOT regexp_matches(l, '[.!?:;…"''”’)][\\x20\\x09-\\x0D]*$')) OR {_COUNT('l', '[|<>]')} >= 3 OR (symbols > 0 AND 100 * symbols >= 50 * n) OR {_BOILERPLATE}) GROUP BY 1),
c AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_COUNT('text', '[#*$%&|<>]')} AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(w) - coalesce(lost, 0) AS n_kept_words FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN worded USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, CAST(n_kept_words AS BIGINT) AS n_kept_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_kept_words >= 50 * n_words AS kept FROM c"""

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}'))".format
_QUERY = "list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)=')))"
OP8 = f"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, {_QUERY} AS q FROM pages),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical FROM p),
r AS (SELECT *, CASE WHEN {_FITS('example.net', '/en/')} THEN 'example.net/en/' WHEN {_FITS('example.com', '/de/')} THEN 'example.com/de/' WHEN {_FITS('org', '/fr/')} THEN 'org/fr/' WHEN {_FITS('net', '/')} THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN canonical IN (SELECT canonical FROM c WHERE regexp_matches(host, '(^|\\.)(adult-x|casino-win|free-bets|cheap-pills|spam-farm|ads-track)\\.') AND canonical IS NOT NULL) THEN 'block' ELSE 'allow' END END AS verdict FROM r"""

OP9 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS kept_by FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept_by = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN kept_by <> page_id THEN kept_by END AS refers_to FROM m"""

OP10 = f"""
WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS g FROM d, generate_series(1, len(w) - 19) AS t(i)),
f AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS p FROM f)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP11 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS u FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.u, v.u) AS BIGINT) AS score FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

OP13 = f"""
WITH dt AS (SELECT doc_id, unnest({_ALNUM}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY 1, 2),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, c GROUP BY 1),
m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // terms AS m FROM n, c),
it AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_ALNUM}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM it JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""

ORACLE_SQL = {"op3_decontamination": OP3, "op4_license_scan": OP4, "op4_license_texts": OP4_TEXTS, "op6_quality_rules": OP6, "op8_url_filter": OP8, "op8_url_list": OP8, "op9_warc": OP9, "op10_substring_dedup": OP10, "op11_top_k": OP11, "op13_ranked_search": OP13}

"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

LINES = r"""
WITH lines AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS key, d.rowid_ AS rid, doc_id, u.line, u.n
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents) d,
  LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n) u
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), firsts AS (
  SELECT k, min(key) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(key) < max(key)
)
SELECT any_value(a.doc_id) AS doc_id, count(*)::BIGINT AS n_lines,
  count(*) FILTER (WHERE f.first IS NOT NULL AND a.key <> f.first)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(a.line, chr(10) ORDER BY a.n) FILTER (WHERE f.first IS NULL OR a.key = f.first), '')) AS kept_sha256
FROM keyed a LEFT JOIN firsts f ON a.k = f.k
GROUP BY a.rid
"""

_FOLD = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_FOLD} AS w FROM documents),
b AS (SELECT item_id, {_FOLD} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, win, len(win) AS size FROM (
    SELECT item_id, unnest(CASE WHEN len(w) >= 13 THEN [w[i:i + 12] for i in range(1, len(w) - 11)] ELSE [w] END) AS win FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
occurring AS (
  SELECT p.rid, p.st, p.size, windows.item_id FROM (
    SELECT rid, size, st, w[st:st + size - 1] AS win FROM (
      SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS st FROM d, sizes WHERE len(w) >= size)) p
  JOIN windows ON p.win = windows.win AND p.size = windows.size
), hit AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(st, st + size)) AS pos FROM occurring) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM occurring GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(named.ids, '')) AS items_sha256, coalesce(hit.n > 0 AND 20 * hit.n >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(page_id, 9223372036854775807) AS id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
f AS (SELECT hex, min(id) AS first FROM p GROUP BY hex)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    ((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::BIGINT // (32 ** (3 - i % 4))::BIGINT) % 32 + 1)::INT]), 'string_agg', '') AS payload_digest,
  CASE WHEN id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN id <> first THEN first END AS refers_to
FROM p JOIN f USING (hex)
"""

REPEATS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, p, md5(b[p:p + 199]) AS s FROM (SELECT rid, b, unnest(range(1, octet_length(b) - 198)) AS p FROM d WHERE octet_length(b) >= 200)),
twice AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
dup AS (SELECT rid, p FROM w SEMI JOIN twice USING (s)),
runs AS (SELECT rid, min(p) AS s, max(p) + 199 AS e FROM (
  SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS g FROM (
    SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM dup)) GROUP BY rid, g),
kept AS (SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) + 1 AS a, s - 1 AS z FROM runs
  UNION ALL SELECT rid, coalesce(max(e), 0) + 1, NULL FROM d LEFT JOIN runs USING (rid) GROUP BY rid),
joined AS (SELECT rid, string_agg(CASE WHEN coalesce(z, octet_length(b)) >= a THEN hex(b[a:coalesce(z, octet_length(b))]) ELSE '' END, '' ORDER BY a) AS h FROM kept JOIN d USING (rid) GROUP BY rid),
gone AS (SELECT rid, sum(e - s + 1) AS n, count(*) AS k FROM runs GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone.n, 0)::BIGINT AS n_removed, coalesce(gone.k, 0)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN joined USING (rid) LEFT JOIN gone USING (rid)
"""

#: The patterns as the contract has them; DuckDB's engine needs no help to read a text once.
_PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0.5),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND ('0' || substr(ltrim(x, '0'), 1, 3))::INT <= 255))", 0.5),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        "length(translate(v, ' -', '')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(translate(v, ' -', '')) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse(translate(v, ' -', ''))[i]::INT"
        " ELSE translate(reverse(translate(v, ' -', ''))[i], '0123456789', '0246813579')::INT END)) % 10 = 0",
        0.8,
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 9 AND 15", 0.5),
    "iban": (
        r"\b[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?\b",
        "length(replace(v, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_concat([0], list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''), lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)),"
        " lambda r, x: (r * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1",
        0.8,
    ),
}
_CONTEXT = {
    "email": "mail|e-mail|email|contact|write|correo|kontakt|courriel",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon|teléfono|téléphone",
    "iban": "iban|account|bank|konto|cuenta|compte",
}


def _found(n: int, kind: str, pattern: str, valid: str, score: float) -> str:
    return f"""SELECT rid, {n} AS k, '{kind}' AS kind, s, s + length(v) AS e, CASE WHEN regexp_matches(lower(substr(text, greatest(s - 40, 0) + 1, least(s, 40))), '(^|[^a-z])({_CONTEXT[kind]})($|[^a-z])') THEN {score} + 0.2 ELSE {score} END AS score
FROM (SELECT rid, text, v, (sum(length(gap)) OVER before + coalesce(sum(length(v)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s FROM (
  SELECT rid, text, unnest(gaps) AS gap, unnest(hits) AS v, generate_subscripts(gaps, 1) AS i FROM (SELECT rid, text, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits FROM d))
  WINDOW before AS (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE v IS NOT NULL AND {valid}"""


PERSONAL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_found(n, kind, *spec) for n, (kind, spec) in enumerate(_PATTERNS.items()))}),
named AS (SELECT *, kind || ':' || s::BIGINT::VARCHAR || ':' || e::BIGINT::VARCHAR AS span FROM found)
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))},
  sha256(coalesce(string_agg(span, ',' ORDER BY k, s) FILTER (WHERE kind <> 'iban'), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY k, s), '') AS spans,
  count(*) FILTER (WHERE kind = 'iban') AS n_added, max(score)::DOUBLE AS best_score
FROM d LEFT JOIN named USING (rid) GROUP BY rid
"""

ORACLES = {"op4_linededup": LINES, "op5_decontaminate": DECONTAMINATE, "op7_warc": WARC, "op9_suffix": REPEATS, "op10_pii": PERSONAL}

"""DuckDB SQL for the registered queries, written from the operators' definitions."""

from __future__ import annotations

from marginalia.functions.analyzer import COMPOUNDS, STOPWORDS, analyze_text
from marginalia.plans.config import EXTENSIONS, FILENAMES
from marginalia.queries import PAGES_QUERY, PARTS_QUERY, QUERY, REPEATED, STEMS

SEPARATORS = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}!-&(-/:-@\x5B-\x60\x7B-\x7E]+"
ENDING = r"'(?i)(''s|s'')$'"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


DOCS = r"""docs AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS path_prefix FROM (
  SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc_' || doc_id::VARCHAR || '.md' AS path, split_part(text, chr(10), 1) AS name,
    regexp_replace(text, '[\r\n]+\z', '') AS description, text AS body FROM documents))"""
PAGES = r"""docs AS (SELECT path, CASE WHEN title <> '' THEN title ELSE regexp_replace(split_part(path, '/', -1), '(.)\.[^.]*$', '\1') END AS name, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\r\n]+\z', '') AS description FROM (
  SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', '') || '/page_' || page_id::VARCHAR || '.md' AS path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html FROM pages))"""
PARTS = "docs AS (SELECT replace(p_brand, '#', '-') || '/part_' || p_partkey::VARCHAR || '.md' AS path, p_name AS name, p_type AS description FROM part)"


def terms(source: str, keep: str = "") -> str:
    """(keep, raw) of the texts of source."""
    k = keep + ", " if keep else ""
    compounds = " ".join(f"WHEN lower(part) = '{c}' THEN [{quoted(t)}]" for c, t in COMPOUNDS.items())
    return rf"""SELECT {k}raw FROM (
  SELECT {k}unnest(CASE {compounds} ELSE [regexp_replace(lower(part), {ENDING}, '')] END) AS raw FROM (
    SELECT {k}unnest(string_split(regexp_replace(regexp_replace(regexp_replace(chunk, {ENDING}, ''), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' ')) AS part FROM (
      SELECT {k}unnest(regexp_split_to_array(text, '{SEPARATORS}')) AS chunk FROM {source}) WHERE chunk <> ''))
WHERE raw <> '' AND raw NOT IN ({quoted(STOPWORDS)})"""


def index(docs: str = DOCS, where: str = "true", stem: str = "raw") -> str:
    return rf"""WITH {docs.replace("docs AS", "all_docs AS", 1)}, docs AS (SELECT * FROM all_docs WHERE {where}),
fields AS (SELECT path, 'name' AS field, name AS text FROM docs UNION ALL SELECT path, 'description', description FROM docs UNION ALL SELECT path, 'path', regexp_replace(regexp_extract(path, '^(.*)/[^/]*$', 1), '\.md\z', '') FROM docs),
raws AS (SELECT path, field, {stem} AS raw FROM ({terms("fields", "path, field")})),
postings AS (SELECT path, raw AS term, count(*) FILTER (WHERE field = 'name') AS n_name, count(*) FILTER (WHERE field = 'description') AS n_description, count(*) FILTER (WHERE field = 'path') AS n_path,
  (3 * count(*) FILTER (WHERE field = 'name') + count(*) FILTER (WHERE field <> 'name'))::BIGINT AS f FROM raws GROUP BY path, raw),
lengths AS (SELECT path, sum(f)::BIGINT AS len FROM postings GROUP BY path),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
stats AS (SELECT n, total, CASE WHEN n > 0 AND total > 0 THEN total / n ELSE 1.0 END AS avgdl FROM (SELECT (SELECT count(*) FROM docs) AS n, (SELECT coalesce(sum(len), 0) FROM lengths)::DOUBLE AS total))"""


IDF = "ln(1 + (greatest(n, 1) - df + 0.5) / (df + 0.5))"


def scored(queries: str, docs: str = DOCS, where: str = "true", stem: str = "raw") -> str:
    """queries: SQL for (query, term, times)."""
    return rf"""{index(docs, where, stem)}, q AS ({queries}),
found AS (SELECT query, path, sum(times * {IDF} * 2.2 * f / (f + 1.2 * (0.25 + 0.75 * len / greatest(avgdl, 1e-6)))) AS score, sum(times)::BIGINT AS matched,
  min(CASE WHEN n_name > 0 THEN 0 WHEN n_description > 0 THEN 1 ELSE 2 END)::BIGINT AS first_field
  FROM postings JOIN q USING (term) JOIN dfs USING (term) JOIN lengths USING (path), stats GROUP BY query, path)"""


def literal(query: str) -> str:
    found = analyze_text(query, stemmed=False)
    return "SELECT * FROM (VALUES " + ", ".join(f"(1, {quoted([t])}, {found.count(t)})" for t in sorted(set(found))) + ") v(query, term, times)"


ORDER = "ORDER BY round(score, 9) DESC, matched DESC, first_field, path LIMIT 10"


def top(query: str, docs: str = DOCS, where: str = "true") -> str:
    return f"{scored(literal(query), docs, where)} SELECT path, round(score, 6) AS score, matched, first_field FROM (SELECT * FROM found {ORDER})"




def explained(found: str, terms: int) -> str:
    return f"""{found}, best AS (SELECT *, score / max(score) OVER () AS share, matched / {terms} AS covered FROM (SELECT * FROM found {ORDER})),
shown AS (SELECT path, score, round(100 * share)::INT::VARCHAR || '% of top' AS relative, matched::VARCHAR || '/{terms} terms' AS coverage,
  CASE WHEN share >= 0.75 AND covered >= 0.75 THEN 'high' WHEN share >= 0.35 OR covered >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM best)"""


EXPLAIN = explained(scored(literal(QUERY)), len(analyze_text(QUERY, False))) + " SELECT path, round(score, 6) AS score, relative, coverage, band FROM shown"

# --- stems, written out: of the parts' words all others are their own, of the sample's words in their order
STEM = "CASE raw WHEN 'large' THEN 'larg' WHEN 'economy' THEN 'economi' ELSE raw END"
STEMS_OF = (
    "consign consign consign consign consist consist consist consist consist consist consist consol consol consolatori consol consol consol consolid consolid consolid consol consol consol conson",
    "knack knackeri knack knag knave knave knavish knead knead knee kneel kneel kneel kneel knee knell knelt knew knick knif knife knight knight knight knit knit knit knit knive knob knob knock knock knocker knocker knock knock",
)
STEMMED = scored("SELECT 1 AS query, unnest(['larger', 'larg', 'economi', 'ring', 'plate']) AS term, 1 AS times", PARTS, stem=STEM)
MARKED = r"regexp_replace({}, '\b(large|economy|ring|plate)\b', chr(27) || '[1m\1' || chr(27) || '[0m', 'gi')"

BATCH = f"""{scored("SELECT query, raw AS term, count(*) AS times FROM (" + terms("(SELECT item_id AS query, text FROM benchmark)", "query") + ") GROUP BY query, raw")}
SELECT query, path, round(score, 6) AS score, matched, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, matched DESC, first_field, path) AS rank FROM found) WHERE rank <= 5"""

# --- rules: which of the three entries of the queries' rule file apply to a path
RULE2 = "(path LIKE 'src1/%' AND NOT path LIKE 'src1/fr/%')"
RULE3 = r"regexp_matches(path, '^src2/(.*/)?doc_1[^/]*\.md$')"
LINES = "(length(body) - length(replace(body, chr(10), '')) + CASE WHEN body = '' OR body LIKE '%' || chr(10) THEN 0 ELSE 1 END)"
MAX_LINES = f"CASE WHEN {RULE3} THEN NULL WHEN {RULE2} THEN 4 ELSE 12 END"

MAX_LINES_FOUND = f"""SELECT path AS file, 1 AS line, 1 AS "column", CASE WHEN {RULE2} THEN 'warning' ELSE 'error' END AS severity, 'max-lines' AS rule,
  'File has ' || n::VARCHAR || ' lines, which exceeds configured max-lines = ' || most::VARCHAR || '.' AS message, false AS fixable
FROM (SELECT path, {LINES} AS n, {MAX_LINES} AS most FROM docs) WHERE n > most"""

# --- cards and notes: what the queries' files hold, by construction
PART_FILES = "parts AS (SELECT p_partkey AS k, p_name, p_type, p_brand, p_size, replace(p_brand, '#', '-') AS folder, replace(p_brand, '#', '-') || '/part_' || p_partkey::VARCHAR || '.md' AS path FROM part)"
CARDS = f"""{PART_FILES}, cards AS (SELECT *, k % 13 = 0 AS broken, CASE WHEN k % 11 = 0 THEN '' ELSE p_name END AS title,
  CASE k % 3 WHEN 0 THEN p_type || ' ' || p_brand || chr(10) || 'size ' || p_size::VARCHAR || chr(10) WHEN 1 THEN p_type || ' ' || p_name END AS described,
  (3 + CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 3 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END)::BIGINT AS lines FROM parts)"""
CARD_DOCS = f"""{CARDS}, docs AS (SELECT path, folder AS path_prefix, CASE WHEN broken THEN 'part_' || k::VARCHAR ELSE title END AS name, CASE WHEN NOT broken THEN rtrim(described, chr(10)) END AS description FROM cards)"""
CARD_FIELDS = f"""WITH {CARDS}
SELECT path, 'malformed' AS status, lines AS malformed_line, NULL::VARCHAR AS key, NULL::VARCHAR AS kind, NULL::VARCHAR AS scalar, NULL::VARCHAR AS seq, NULL::VARCHAR AS map FROM cards WHERE broken
UNION ALL SELECT path, 'valid', NULL, 'name', 'scalar', title, NULL, NULL FROM cards WHERE NOT broken
UNION ALL SELECT path, 'valid', NULL, 'description', 'scalar', described, NULL, NULL FROM cards WHERE NOT broken AND described IS NOT NULL
UNION ALL SELECT path, 'valid', NULL, 'tags', 'sequence', NULL, folder || ',size ' || p_size::VARCHAR, NULL FROM cards WHERE NOT broken AND k % 4 = 0
UNION ALL SELECT path, 'valid', NULL, 'box', 'mapping', NULL, NULL, 'size=' || p_size::VARCHAR FROM cards WHERE NOT broken AND k % 5 = 0"""
ROW = r"concat_ws(' | ', " + ", ".join(rf"replace(regexp_replace(coalesce({c}, ''), '[\r\n]', ' ', 'g'), '|', '\|')" for c in ("path", "name", "description")) + ")"
CARD_FOUND = f"""WITH {CARDS}, found AS (
  SELECT path, 'frontmatter-malformed' AS rule, 'Frontmatter block is malformed or uses unsupported YAML constructs (line ' || lines::VARCHAR || ').' AS message FROM cards WHERE broken
  UNION ALL SELECT path, 'frontmatter-field-missing', 'Required frontmatter field `' || field || '` is missing.' FROM (
    SELECT path, unnest(list_concat(CASE WHEN described IS NULL THEN ['description'] ELSE [] END, CASE WHEN k % 4 <> 0 THEN ['tags'] ELSE [] END)) AS field FROM cards WHERE NOT broken AND folder <> 'Brand-7')
  UNION ALL SELECT path, 'frontmatter-field-max-chars', 'Frontmatter field `' || field || '` has ' || n::VARCHAR || ' characters, which exceeds configured max-chars = ' || most::VARCHAR || '.' FROM (
    SELECT path, 'name' AS field, length(title) AS n, 9 AS most FROM cards WHERE NOT broken UNION ALL SELECT path, 'description', length(described), 20 FROM cards WHERE NOT broken) WHERE n > most)
SELECT path AS file, 1 AS line, 1 AS "column", 'error' AS severity, rule, message, false AS fixable FROM found"""
NOTES = f"""{PART_FILES}, notes AS (SELECT a.*, replace(a.p_name, ' ', '-') AS slug, 'part_' || (a.k + 7)::VARCHAR || '.md' AS next_ref, 'part_' || (a.k + 1)::VARCHAR || '.md' AS code_ref, '#size-' || a.p_size::VARCHAR AS own_ref,
  '#size-' || (a.p_size + 1)::VARCHAR AS lost_ref, '../' || a.folder || '/part_' || a.k::VARCHAR || '.md#' || replace(a.p_name, ' ', '-') || '-1' AS twin_ref, 'Brand-2/part_' || (a.k + 1)::VARCHAR || '.md' AS brand_ref,
  '/Brand-4/part_' || (a.k + 2)::VARCHAR || '.md#size-' || a.p_size::VARCHAR AS root_ref, coalesce(n.folder = a.folder, false) AS has_next, coalesce(b.folder = 'Brand-2', false) AS has_brand, coalesce(r.folder = 'Brand-4' AND r.p_size = a.p_size, false) AS has_root,
  (SELECT count(*) > 0 FROM parts WHERE folder = 'Brand-3') AS has_folder FROM parts a LEFT JOIN parts n ON n.k = a.k + 7 LEFT JOIN parts b ON b.k = a.k + 1 LEFT JOIN parts r ON r.k = a.k + 2),
nodes AS (SELECT *, 7 + length('[twin](), ') + length(twin_ref) AS brand_col FROM notes),
placed AS (SELECT *, brand_col + length('``, ') + length(brand_ref) AS folder_col, brand_col + length('``, ') + length(brand_ref) + length('`../Brand-3/` and ') AS root_col FROM nodes)"""
OUTLINE = f"""WITH {NOTES}
SELECT path, 'heading' AS type, p_name AS value, NULL::VARCHAR AS url, 1::BIGINT AS line, 3::BIGINT AS col FROM placed
UNION ALL SELECT path, 'link', 'next', next_ref, 2, 12 FROM placed
UNION ALL SELECT path, 'code', code_ref, NULL, 2, 12 + length('[next]() and ') + length(next_ref) FROM placed
UNION ALL SELECT path, 'heading', 'Size ' || p_size::VARCHAR, NULL, 4, 4 FROM placed
UNION ALL SELECT path, 'link', 'own', own_ref, 5, 7 FROM placed
UNION ALL SELECT path, 'link', 'lost', lost_ref, 5, 7 + length('[own]() or ') + length(own_ref) FROM placed
UNION ALL SELECT path, 'heading', p_name, NULL, 7, 4 FROM placed
UNION ALL SELECT path, 'link', 'twin', twin_ref, 9, 7 FROM placed
UNION ALL SELECT path, 'code', brand_ref, NULL, 9, brand_col FROM placed
UNION ALL SELECT path, 'code', '../Brand-3/', NULL, 9, folder_col FROM placed
UNION ALL SELECT path, 'link', 'root', root_ref, 9, root_col FROM placed"""


def _link(label: str, ref: str) -> str:
    return f"'Local repository link `[{label}](' || {ref} || ')` does not resolve within the repository.'"


def _code(ref: str) -> str:
    return f"'Local repository path `' || {ref} || '` does not resolve within the repository.'"


SEVERITY = "CASE folder WHEN 'Brand-5' THEN 'warning' ELSE 'error' END"
NOTE_FOUND = f"""{NOTES}, found AS (
  SELECT path AS file, 2 AS line, 12 AS "column", 'error' AS severity, 'unresolved-link-path' AS rule, {_link('next', 'next_ref')} AS message, false AS fixable FROM placed WHERE NOT has_next AND folder <> 'Brand-6'
  UNION ALL SELECT path, 2, 12 + length('[next]() and ') + length(next_ref), {SEVERITY}, 'unresolved-backtick-path', {_code('code_ref')}, false FROM placed WHERE folder <> 'Brand-6'
  UNION ALL SELECT path, 5, 7 + length('[own]() or ') + length(own_ref), 'error', 'unresolved-link-path', {_link('lost', 'lost_ref')}, false FROM placed WHERE folder <> 'Brand-6'
  UNION ALL SELECT path, 9, brand_col, {SEVERITY}, 'unresolved-backtick-path', {_code('brand_ref')}, false FROM placed WHERE NOT has_brand AND folder <> 'Brand-6'
  UNION ALL SELECT path, 9, brand_col, 'error', 'prefer-links-for-local-paths', 'Local repository path `' || brand_ref || '` should use Markdown link syntax.', true FROM placed WHERE has_brand AND folder LIKE 'Brand-1%'
  UNION ALL SELECT path, 9, folder_col, 'error', 'prefer-links-for-local-paths', 'Local repository path `../Brand-3/` should use Markdown link syntax.', true FROM placed WHERE has_folder AND folder LIKE 'Brand-1%'
  UNION ALL SELECT path, 9, root_col, 'error', 'unresolved-link-path', {_link('root', 'root_ref')}, false FROM placed WHERE NOT has_root AND folder <> 'Brand-6')"""
FIXED = f"""WITH {NOTES} SELECT path, '# ' || p_name || chr(10) || 'Intro with [next](' || next_ref || ') and `' || code_ref || '` there.' || chr(10) || chr(10) || '## Size ' || p_size::VARCHAR || chr(10) || '* see [own](' || own_ref || ') or [lost](' || lost_ref || ')'
  || chr(10) || chr(10) || '## ' || p_name || chr(10) || chr(10) || 'Über [twin](' || twin_ref || '), ' || CASE WHEN has_brand THEN '[' || brand_ref || '](../' || brand_ref || ')' ELSE '`' || brand_ref || '`' END
  || ', ' || CASE WHEN has_folder THEN '[../Brand-3/](../Brand-3/)' ELSE '`../Brand-3/`' END || ' and [root](' || root_ref || ').' || chr(10) || '```' || chr(10) || '[x](nowhere.md) `nowhere.md`' || chr(10) || '```' || chr(10) AS content
FROM placed WHERE folder LIKE 'Brand-1%' AND (has_brand OR has_folder)"""

# --- references
HREFS = r"""refs AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS file, u.n - 1 AS n, u.ref FROM pages,
  LATERAL (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS n) u),
hrefs AS (SELECT page_id, file, n, ref FROM refs UNION ALL SELECT page_id, file, n + 100000, regexp_replace(ref, '^https?://[^/]*/', '../') FROM refs)"""


def candidate(link: bool) -> str:
    path = "split_part(r, '#', 1)" if link else "r"
    base = f"regexp_extract({path}, '([^/]*)$', 1)"
    known = rf"regexp_extract({base}, '.(\.[^.]*)$', 1) IN ({quoted(sorted(EXTENSIONS))}) OR {path} IN ({quoted(sorted(FILENAMES))})"
    shape = rf"regexp_matches({path}, '[/\\]')" if link else rf"regexp_matches({path}, '[/\\]$')"
    rest = "OR regexp_matches(r, '(?s)#.')" if link else ""
    allowed = "true" if link else r"NOT regexp_matches(r, '//|\.\.\.|[\p{Z}\s\x0B*?\[{:()<>""'']')"
    return rf"(r <> '' AND NOT regexp_matches(r, '^(http://|https://|mailto:)') AND {allowed} AND (regexp_matches({path}, '^\.{{0,2}}/') OR {shape} {rest} OR {known}))"


CLASSIFIED = rf"""WITH {HREFS} SELECT page_id, n::BIGINT AS n, ref, regexp_matches(r, '^(http://|https://|mailto:)') AS external, {candidate(True)} AS as_link, {candidate(False)} AS as_code,
  CASE WHEN regexp_matches(split_part(r, '#', 1), '^\.{{1,2}}/') THEN 'relative' WHEN r LIKE '/%' THEN 'root' ELSE 'standard' END AS syntax,
  CASE WHEN regexp_matches(r, '(?s)^[^#]*#.') THEN url_decode(replace(regexp_extract(r, '(?s)^[^#]*#(.+)$', 1), '+', '%2B')) END AS anchor
FROM (SELECT *, trim(ref) AS r FROM hrefs)"""
TARGETS = rf"""targets AS (SELECT page_id, n::BIGINT AS n, ref, CASE WHEN p = '' THEN file WHEN folded IN ('', '!') THEN NULL ELSE substr(folded, 2) END AS target, regexp_matches(p, '[/\\]$') AS folder_like FROM (
  SELECT *, list_reduce(list_concat([''], string_split(CASE WHEN NOT p LIKE '/%' AND prefix <> '' THEN prefix || '/' || plain ELSE plain END, '/')), lambda acc, x:
    CASE WHEN x IN ('', '.') OR acc = '!' THEN acc WHEN x = '..' AND acc = '' THEN '!' WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END) AS folded FROM (
    SELECT *, regexp_extract(file, '^(.*)/[^/]*$', 1) AS prefix, regexp_replace(replace(p, '\', '/'), '^/+', '') AS plain FROM (
      SELECT *, split_part(r, '#', 1) AS p FROM (SELECT *, trim(ref) AS r FROM hrefs) WHERE {candidate(True)}))))"""

WITH_DOCS = f"WITH {DOCS}"
ORACLES = {
    "corpus_documents": f"{WITH_DOCS} SELECT path, path_prefix, name, description FROM docs",
    "tokenize_explode": f"{WITH_DOCS} SELECT raw AS term, count(*) AS n FROM ({terms('(SELECT description AS text FROM docs)')}) GROUP BY raw",
    "compound_expand": "SELECT id, raw AS term, count(*) AS n FROM ("
    + terms("(SELECT p_partkey AS id, concat_ws(' ', 'ExecPlan''s execplan XMLParser EXECPLAN execplans dogs''', p_name, p_type) AS text FROM part)", "id")
    + ") GROUP BY id, raw",
    "field_term_freq": f"{index()} SELECT * FROM postings",
    "field_lengths": f"{index()} SELECT * FROM lengths",
    "doc_frequency": f"{index()} SELECT * FROM dfs",
    "corpus_stats": f"{index()} SELECT n, total::BIGINT AS total, round(avgdl, 6) AS avgdl FROM stats",
    "idf_table": f"{index()} SELECT term, df, round({IDF}, 6) AS idf FROM dfs, stats",
    "match_topk": top(QUERY),
    "match_saved": top(QUERY),
    "match_explain": EXPLAIN,
    "match_duplicate_terms": top(REPEATED),
    "match_scoped": top(QUERY, where="path LIKE 'src1/%'"),
    "match_exclude": top(QUERY, where=r"(path LIKE '%/doc_17.md' OR NOT (path LIKE 'src1/%' OR regexp_matches(path, '/doc_[^/]*7\.md$')))"),
    "match_parts": top(PARTS_QUERY, PARTS),
    "match_pages": top(PAGES_QUERY, PAGES),
    "match_batch": BATCH,
    "lint_max_lines": f"{WITH_DOCS} {MAX_LINES_FOUND}",
    "rule_policy_fold": f"""{WITH_DOCS} SELECT path, CASE WHEN {RULE3} THEN NULL ELSE 'error' END AS backtick_severity, {RULE3} AS prefer_links, coalesce({MAX_LINES}, 0)::BIGINT AS max_lines,
  CASE WHEN {RULE3} THEN NULL WHEN {RULE2} THEN 'warning' ELSE 'error' END AS max_lines_severity, CASE WHEN {RULE2} THEN 'unresolved-link-path' ELSE '' END AS ignored,
  CASE WHEN {RULE3} THEN 'status' ELSE 'name,description' END AS required, 'description=4000,name=' || CASE WHEN {RULE3} THEN '80' ELSE '300' END AS field_max_chars FROM docs""",
    "glob_self_vs_ancestor": rf"""{WITH_DOCS}, own AS (SELECT path, path_prefix, regexp_matches(path, '/doc_[^/]*3\.md$') OR regexp_matches(path, '^src[3-4]/(.*/)?doc_[^/]\.md$') AS itself FROM docs)
SELECT path, itself, itself OR (path_prefix <> 'src1/de' AND (path LIKE 'src1/%' OR path_prefix = 'src2/en')) AS or_parent FROM own""",
    "page_links_classified": CLASSIFIED,
    "page_links_resolved": f"WITH {HREFS}, {TARGETS} SELECT page_id, n, ref, target, folder_like FROM targets",
    "edit_overlap_check": """SELECT * FROM (SELECT path, start, "end", lead(start) OVER (PARTITION BY path ORDER BY start, "end") AS next_start FROM (
  SELECT l_orderkey AS path, l_partkey % 1000 AS start, l_partkey % 1000 + l_quantity::BIGINT AS "end" FROM lineitem)) WHERE "end" > next_start""",
    "list_described": f"{WITH_DOCS} SELECT {ROW} AS row FROM docs WHERE description IS NOT NULL",
    "lint_budgets": f"""{WITH_DOCS} SELECT path AS file, 1 AS line, 1 AS "column", CASE WHEN {RULE2} THEN 'error' ELSE 'warning' END AS severity, 'max-tokens' AS rule,
  'File has ' || strlen(body)::VARCHAR || ' tokens, which exceeds configured max-tokens = ' || (CASE WHEN {RULE2} THEN 500 ELSE 2000 END)::VARCHAR || '.' AS message, false AS fixable
FROM docs WHERE strlen(body) > CASE WHEN {RULE2} THEN 500 ELSE 2000 END AND NOT path LIKE 'src2/%'""",
    "file_sizes": f"{WITH_DOCS} SELECT path, {LINES} AS lines, ({MAX_LINES})::BIGINT AS max_lines, strlen(body)::BIGINT AS tokens FROM docs WHERE {LINES} >= 5 OR strlen(body) >= 3000",
    "default_policy": rf"""{WITH_DOCS}, named AS (SELECT path_prefix || '/' || CASE WHEN path LIKE '%0.md' THEN 'AGENTS.md' WHEN path LIKE '%1.md' THEN 'SKILL.md' WHEN path LIKE '%2.md' THEN 'README.md' WHEN path LIKE '%3.md' THEN 'CLAUDE.md' WHEN path LIKE '%4.md' THEN 'GEMINI.md'
  ELSE split_part(path, '/', -1) END AS path FROM docs)
SELECT path, CASE WHEN path LIKE '%/AGENTS.md' THEN 100 WHEN path LIKE '%/SKILL.md' THEN 500 END::BIGINT AS max_lines, CASE WHEN path LIKE '%/AGENTS.md' THEN 1000 WHEN path LIKE '%/SKILL.md' THEN 5000 END::BIGINT AS max_tokens,
  CASE WHEN path LIKE '%/SKILL.md' THEN 'name,description' WHEN regexp_matches(path, '/(AGENTS|CLAUDE|GEMINI|README)\.md$') THEN '' ELSE 'description' END AS required, 1024::BIGINT AS description_chars FROM named""",
    "list_rows": f"WITH {CARD_DOCS} SELECT {ROW} AS row FROM docs WHERE description IS NOT NULL OR path IN ('Brand-2/part_99.md', 'Brand-8/part_5.md') UNION ALL SELECT {ROW} FROM docs WHERE description IS NOT NULL AND path_prefix = 'Brand-2'",
    "list_scopes": rf"""{WITH_DOCS}, moved AS (SELECT regexp_replace(replace(replace(path, '/en/', '/active/'), '/de/', '/completed/'), '/doc_(\d+)0\.md$', '/doc_\1/SKILL.md') AS path FROM docs)
SELECT path, path LIKE 'src1/%' AND path LIKE '%/SKILL.md' AS skills, path LIKE 'src2/%' AS plans, path LIKE 'src2/active/%' AS active_plans, path LIKE 'src2/completed/%' AS completed_plans,
  regexp_matches(path, '^src2/active/[^/]*$') AS shallow, CASE WHEN path LIKE 'src2/%' THEN substr(path, 6) END AS below FROM moved""",
    "discover_filter": rf"""{WITH_DOCS} SELECT path FROM (SELECT path, split_part(path, '/', -1) AS file FROM docs) WHERE (path LIKE 'src1/%' OR regexp_matches(file, '^doc_.*2\.md$') OR regexp_matches(path, '^src3/[^/]*/doc_..\.md$'))
  AND NOT (file <> 'doc_22.md' AND (path LIKE 'src1/fr/%' OR regexp_matches(file, '^doc_2.\.md$')))""",
    "repository_documents": f"WITH {CARD_DOCS} SELECT path, path_prefix, name, description FROM docs",
    "frontmatter_fields": CARD_FIELDS,
    "lint_frontmatter": CARD_FOUND,
    "markdown_outline": OUTLINE,
    "heading_anchor_list": f"WITH {NOTES} SELECT path, slug || ' size-' || p_size::VARCHAR || ' ' || slug || '-1' AS anchors FROM placed",
    "lint_references": f'WITH {NOTE_FOUND} SELECT * REPLACE ("column"::INT AS "column") FROM found',
    "diagnostic_texts": f"""WITH {NOTE_FOUND} SELECT file || ':' || line::VARCHAR || ':' || "column"::VARCHAR || '  ' || chr(27) || CASE severity WHEN 'error' THEN '[31m' ELSE '[33m' END || severity || chr(27) || '[0m  ' || rule
  || CASE WHEN fixable THEN '  fixable' ELSE '' END || chr(10) || message AS text FROM found""",
    "fix_files": FIXED,
    "fix_summary": f"WITH {NOTE_FOUND} SELECT count(*) AS count, coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule), '') AS rules FROM found WHERE fixable",
    "run_status": f"""WITH {NOTE_FOUND}, counted AS (SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity <> 'error') AS warnings, count(*) FILTER (WHERE fixable) AS fixable,
  coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule) FILTER (WHERE fixable), '') AS rules, coalesce(bool_or(severity = 'error'), false) AS lint, coalesce(bool_or(severity = 'error' AND NOT fixable), false) AS fix FROM found)
SELECT 'lint' AS mode, errors, warnings, fixable, rules, lint AS failed FROM counted UNION ALL SELECT 'fix', errors, warnings, fixable, rules, fix FROM counted""",
    "anchor_slugs": rf"""{WITH_DOCS}, titles AS (SELECT path, u.n - 1 AS n, u.title FROM docs, LATERAL (SELECT unnest(string_split(body, chr(10))) AS title, generate_subscripts(string_split(body, chr(10)), 1) AS n) u)
SELECT path, n::BIGINT AS n, replace(regexp_replace(lower(trim(regexp_replace(title, '[<>*_`\[\]!\\#&~|]', '', 'g'))), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\- ]', '', 'g'), ' ', '-') AS slug FROM titles""",
    "stem_terms": f"WITH {PART_FILES}, words AS ({terms('(SELECT p_name AS text FROM parts UNION ALL SELECT p_type FROM parts)')}) SELECT DISTINCT raw, {STEM} AS term FROM words UNION SELECT * FROM (VALUES "
    + ", ".join(f"('{w}', '{t}')" for w, t in zip(" ".join(STEMS).split(), " ".join(STEMS_OF).split(), strict=True))
    + ") v(raw, term)",
    "match_parts_stemmed": f"{STEMMED} SELECT path, round(score, 6) AS score, matched, first_field FROM (SELECT * FROM found {ORDER})",
    "match_rows": f"""{explained(STEMMED, 5)} SELECT path, chr(27) || CASE band WHEN 'high' THEN '[32m' WHEN 'medium' THEN '[33m' ELSE '[31m' END || printf('%.2f', score) || chr(27) || '[0m | ' || relative || ' | ' || coverage || ' | ' || {MARKED.format('path')}
  || ' | ' || {MARKED.format('name')} || ' | ' || {MARKED.format('description')} AS line FROM shown JOIN docs USING (path)""",
    "match_paths": f"{STEMMED} SELECT path AS line FROM found {ORDER}",
}

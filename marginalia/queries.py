"""Registered queries: each applies operators to whole tables; their DuckDB SQL is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import render
from marginalia.functions import text
from marginalia.functions.analyzer import explode_terms, stems_of
from marginalia.functions.frontmatter import frontmatter
from marginalia.functions.markdown import heading_anchors, markdown_nodes
from marginalia.operators import fix, lint, listing, ranking, sizes
from marginalia.operators import references as R
from marginalia.plans.config import default, parse
from marginalia.runtime import new_folder, ship
from marginalia.sources import adapters
from marginalia.sources import repository as repo
from marginalia.sources.globs import compile_patterns, taken

#: What the ranking queries look for; words that occur in the tables, and stop words that don't count.
QUERY = "the thon inwh der que OnSt erst's"
REPEATED = "thon thon inwh plan"
PARTS_QUERY = "small blue ECONOMY ring"
PAGES_QUERY = "thon privacy elle thant"
#: A query whose terms have stems that differ from them, and words with well-known stems: Porter2's own sample.
STEMMED_QUERY = "larger LARGE economies rings plates"
STEMS = (
    "consign consigned consigning consignment consist consisted consistency consistent consistently consisting consists consolation consolations consolatory console consoled consoles consolidate consolidated consolidating consoling consolingly consols consonant",
    "knack knackeries knacks knag knave knaves knavish kneaded kneading knee kneel kneeled kneeling kneels knees knell knelt knew knick knif knife knight knightly knights knit knits knitted knitting knives knob knobs knock knocked knocker knockers knocking knocks",
)
#: A rule file for the queries on literals and documents.
RULES = """
[[rules]]
path = "*.md"
max-lines = 12
enable = ["unresolved-backtick-path"]
[rules.frontmatter]
required = ["name", "description"]
[rules.frontmatter.fields.name]
max-chars = 300
[rules.frontmatter.fields.description]
max-chars = 4000

[[rules]]
path = "src1/"
exclude = ["src1/fr/"]
severity = "warn"
max-lines = 4
disable = ["unresolved-link-path"]

[[rules]]
path = "/src2/**/doc_1*.md"
disable = ["max-lines", "unresolved-backtick-path"]
enable = ["prefer-links-for-local-paths"]
[rules.frontmatter]
required = ["status"]
[rules.frontmatter.fields.name]
max-chars = 80
"""


def r6(column: str) -> F.Column:
    return F.round(column, 6).alias(column)


def corpus_documents(spark: SparkSession, d: str) -> DataFrame:
    return adapters.documents(spark, d).select("path", "path_prefix", "name", "description")


def tokenize_explode(spark: SparkSession, d: str) -> DataFrame:
    terms = explode_terms(adapters.documents(spark, d), "description", [])
    return terms.groupBy(F.col("raw").alias("term")).agg(F.count("*").alias("n"))


def compound_expand(spark: SparkSession, d: str) -> DataFrame:
    names = adapters.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.lit("ExecPlan's execplan XMLParser EXECPLAN execplans dogs'"), "p_name", "p_type").alias("text"))
    return explode_terms(names, "text", ["id"]).groupBy("id", F.col("raw").alias("term")).agg(F.count("*").alias("n"))


def _index(spark: SparkSession, d: str) -> ranking.Index:
    return ranking.build_index(adapters.documents(spark, d), stemmed=False)


def field_term_freq(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).postings


def field_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).lengths


def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).frequencies()


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).stats().select("n", F.col("total").cast("long").alias("total"), r6("avgdl"))


def idf_table(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return index.frequencies().crossJoin(F.broadcast(index.stats())).select("term", "df", F.round(ranking.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def _top(found: DataFrame) -> DataFrame:
    return found.select("path", r6("score"), F.col("matched").cast("long").alias("matched"), F.col("first_field").cast("long").alias("first_field"))


def match_topk(spark: SparkSession, d: str) -> DataFrame:
    return _top(ranking.match(_index(spark, d), QUERY, 10))


def match_saved(spark: SparkSession, d: str) -> DataFrame:
    """As match_topk, by an index that is written and read again."""
    return _top(ranking.match(_index(spark, d).save(new_folder(spark, "index")), QUERY, 10))


def match_explain(spark: SparkSession, d: str) -> DataFrame:
    return ranking.explain(_index(spark, d), QUERY, 10).select("path", r6("score"), "relative", "coverage", "band")


def match_duplicate_terms(spark: SparkSession, d: str) -> DataFrame:
    return _top(ranking.match(_index(spark, d), REPEATED, 10))


def match_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Statistics come from the scope, not from all documents."""
    docs = adapters.documents(spark, d)
    return _top(ranking.match(ranking.build_index(docs.where(F.startswith("path", F.lit("src1/"))), stemmed=False), QUERY, 10))


def match_exclude(spark: SparkSession, d: str) -> DataFrame:
    docs = adapters.documents(spark, d)
    kept = docs.where(~taken(compile_patterns(["src1/**", "doc_*7.md", "!doc_17.md"]), F.col("path")))
    return _top(ranking.match(ranking.build_index(kept, stemmed=False), QUERY, 10))


def match_parts(spark: SparkSession, d: str) -> DataFrame:
    return _top(ranking.match(ranking.build_index(adapters.parts(spark, d), stemmed=False), PARTS_QUERY, 10))


def match_pages(spark: SparkSession, d: str) -> DataFrame:
    return _top(ranking.match(ranking.build_index(adapters.pages(spark, d), stemmed=False), PAGES_QUERY, 10))


def match_batch(spark: SparkSession, d: str) -> DataFrame:
    queries = adapters.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return ranking.match_batch(_index(spark, d), queries, 5).select("query", "path", r6("score"), F.col("matched").cast("long").alias("matched"), F.col("rank").cast("long").alias("rank"))


def match_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return _top(ranking.match(ranking.build_index(adapters.documents(spark, d)), QUERY, 10))


def list_described(spark: SparkSession, d: str) -> DataFrame:
    return listing.rows(listing.list_documents(adapters.documents(spark, d)))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files with front matter: every third without a description, every seventh broken off."""
    ship(spark)
    docs = adapters.documents(spark, d)
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("long")
    head = F.concat(F.lit("---\nname: '"), F.replace(F.col("name"), F.lit("'"), F.lit(" ")), F.lit("'\n"))
    described = F.when(number % 3 == 0, "").otherwise(F.concat(F.lit("description: d"), F.regexp_replace("description", r"\s+", " "), F.lit("\n")))
    return docs.select("path", F.concat(head, described, F.when(number % 7 == 0, "").otherwise("---\n"), F.col("body"), F.lit("\nSee `src1/en/` and [one](../en/doc_1.md#missing).\n")).alias("content"))


def lint_max_lines(spark: SparkSession, d: str) -> DataFrame:
    files = adapters.documents(spark, d).select("path", F.col("body").alias("content"))
    return lint.line_findings(lint.with_policy(files, parse(RULES))).select(*lint.COLUMNS)


def rule_policy_fold(spark: SparkSession, d: str) -> DataFrame:
    p = parse(RULES).policy(F.col("path"))
    docs = adapters.documents(spark, d).select("path", p.alias("p"))
    return docs.select(
        "path", "p.backtick_severity", "p.prefer_links", F.coalesce("p.max_lines", F.lit(0)).alias("max_lines"), "p.max_lines_severity", F.array_join("p.ignored", ",").alias("ignored"), F.array_join("p.required", ",").alias("required"),
        F.array_join(F.transform("p.field_max_chars", lambda x: F.concat_ws("=", x["field"], x["max_chars"].cast("string"))), ",").alias("field_max_chars"),
    )


def glob_self_vs_ancestor(spark: SparkSession, d: str) -> DataFrame:
    patterns = compile_patterns(["src1", "src2/en/", "doc_*3.md", "!src1/de", "src[3-4]/**/doc_?.md"])
    path = F.col("path")
    return adapters.documents(spark, d).select("path", taken(patterns, path).alias("itself"), taken(patterns, path, parents=True).alias("or_parent"))


def _hrefs(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, n, file, ref): the targets of a page's links in order, twice: as they are, and without their host."""
    pages = adapters.table(spark, d, "pages")
    refs = pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("file"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("n", "ref"))
    bare = refs.select("page_id", (F.col("n") + 100_000).alias("n"), "file", F.regexp_replace("ref", "^https?://[^/]*/", "../").alias("ref"))
    return refs.unionByName(bare)


def page_links_classified(spark: SparkSession, d: str) -> DataFrame:
    config = default()
    ref, link = F.trim("ref"), F.lit(True)
    return _hrefs(spark, d).select(
        "page_id", F.col("n").cast("long").alias("n"), "ref", R.is_external(ref).alias("external"), R.is_candidate(ref, link, config.extensions, config.filenames).alias("as_link"),
        R.is_candidate(ref, F.lit(False), config.extensions, config.filenames).alias("as_code"), R.syntax(R.path_text(ref, link)).alias("syntax"), R.anchor(ref, link).alias("anchor"),
    )


def _targets(spark: SparkSession, d: str) -> DataFrame:
    config = default()
    ref, link = F.trim("ref"), F.lit(True)
    return _hrefs(spark, d).where(R.is_candidate(ref, link, config.extensions, config.filenames)).select("page_id", F.col("n").cast("long").alias("n"), "ref", R.target(F.col("file"), ref, link).alias("target"), R.is_folder_like(ref, link).alias("folder_like"))


def page_links_resolved(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d)


def anchor_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Each document's lines as headings: their anchors before repeats are numbered."""
    docs = adapters.documents(spark, d).select("path", F.posexplode(F.split("body", "\n")).alias("n", "title"))
    return docs.select("path", F.col("n").cast("long").alias("n"), text.slug(F.trim(F.translate("title", "<>*_`[]!\\#&~|", ""))).alias("slug"))


#: Rules for the cards and notes made of the parts.
CARD_RULES = """
[[rules]]
path = "*.md"
[rules.frontmatter]
required = ["name", "description", "tags"]
[rules.frontmatter.fields.name]
max-chars = 9
[rules.frontmatter.fields.description]
max-chars = 20

[[rules]]
path = "Brand-7/"
disable = ["frontmatter-field-missing"]
"""
NOTE_RULES = """
[[rules]]
path = "*.md"
enable = ["unresolved-backtick-path"]

[[rules]]
path = "Brand-1*/"
enable = ["prefer-links-for-local-paths"]

[[rules]]
path = "Brand-5"
severity = "warn"
enable = ["unresolved-backtick-path"]

[[rules]]
path = "Brand-6/"
disable = ["unresolved-backtick-path", "unresolved-link-path"]
"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    folder = F.replace(F.col("p_brand"), F.lit("#"), F.lit("-"))
    return adapters.table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_type", "p_brand", "p_size", folder.alias("folder"), F.concat(folder, F.lit("/part_"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """A file with front matter for each part: blank names, folded descriptions or none, lists, mappings, and blocks that don't end."""
    k = F.col("k")
    lines = lambda template, *columns: F.format_string(template, *columns)
    head = F.concat(
        F.lit("---\n"),
        F.when(k % 11 == 0, "name:\n").otherwise(lines("name: '%s'\n", "p_name")),
        F.when(k % 3 == 0, lines("description: >\n  %s\n  %s\n\n  size %d\n", "p_type", "p_brand", "p_size")).when(k % 3 == 1, lines("description: %s %s\n", "p_type", "p_name")).otherwise(""),
        F.when(k % 4 == 0, lines("tags:\n  - %s\n  - size %d\n", "folder", "p_size")).otherwise(""),
        F.when(k % 5 == 0, lines("box:\n  size: %d\n", "p_size")).otherwise(""),
        F.when(k % 13 == 0, "").otherwise("---\n"),
    )
    return _parts(spark, d).select("path", F.concat(head, F.lit("body\n")).alias("content"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """A file of headings, links and code spans for each part; many of the references point nowhere."""
    slug = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    content = F.format_string(
        "# %s\nIntro with [next](part_%d.md) and `part_%d.md` there.\n\n## Size %d\n* see [own](#size-%d) or [lost](#size-%d)\n\n## %s\n\n"
        "Über [twin](../%s/part_%d.md#%s-1), `Brand-2/part_%d.md`, `../Brand-3/` and [root](/Brand-4/part_%d.md#size-%d).\n```\n[x](nowhere.md) `nowhere.md`\n```\n",
        "p_name", F.col("k") + 7, F.col("k") + 1, "p_size", "p_size", F.col("p_size") + 1, "p_name", "folder", "k", slug, F.col("k") + 1, F.col("k") + 2, "p_size",
    )
    return _parts(spark, d).select("path", content.alias("content"))


def frontmatter_fields(spark: SparkSession, d: str) -> DataFrame:
    parsed = _cards(spark, d).select("path", frontmatter("content").alias("f")).select("path", "f.status", F.col("f.malformed_line").cast("long").alias("malformed_line"), F.inline_outer("f.fields"))
    return parsed.select("path", "status", "malformed_line", "key", "kind", "scalar", F.array_join("seq", ",").alias("seq"), F.array_join(F.transform("map", lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("map"))


def repository_documents(spark: SparkSession, d: str) -> DataFrame:
    """Name and description as the repository source reads them from front matter."""
    return repo.documents(_cards(spark, d)).select("path", "path_prefix", "name", "description")


def list_rows(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of a folder's own files, and one more that was asked for by name."""
    docs = repo.documents(_cards(spark, d))
    return listing.rows(listing.list_documents(docs, ("Brand-2/part_99.md", "Brand-8/part_5.md"))).union(listing.rows(listing.list_documents(docs, folder="Brand-2", recurse=False)))


def list_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Which scopes a path belongs to; documents in folders of plans and skills."""
    config = parse('skills-dir = "src1"\nplans-dir = "src2"\n')
    docs = adapters.documents(spark, d)
    moved = F.replace(F.replace(F.col("path"), F.lit("/en/"), F.lit("/active/")), F.lit("/de/"), F.lit("/completed/"))
    docs = docs.select(F.regexp_replace(moved, r"/doc_(\d+)0\.md$", "/doc_$1/SKILL.md").alias("path"))
    path = F.col("path")
    scopes = [listing.in_scope(path, s, config).alias(s.replace("-", "_")) for s in ("skills", "plans", "active-plans", "completed-plans")]
    return docs.select("path", *scopes, listing.shallow(path, "src2/active").alias("shallow"), text.repo_relative(F.concat(F.lit("C:\\work\\"), F.replace(path, F.lit("/"), F.lit("\\"))), "C:\\work\\src2").alias("below"))


def discover_filter(spark: SparkSession, d: str) -> DataFrame:
    """Paths that patterns include and do not exclude; a folder's pattern doesn't reach what is below it."""
    config = parse('include = ["src1/**", "doc_*2.md", "/src3/*/doc_??.md"]\nexclude = ["src1/fr/*", "src2", "doc_2?.md", "!doc_22.md"]\n')
    return adapters.documents(spark, d).where(config.in_scope(F.col("path"))).select("path")


def stem_terms(spark: SparkSession, d: str) -> DataFrame:
    """The stems of the parts' words, and of words for which they are known."""
    words = spark.createDataFrame([(w,) for w in " ".join(STEMS).split()], "raw string")
    found = explode_terms(_parts(spark, d).select(F.concat_ws(" ", "p_name", "p_type").alias("text")), "text", [])
    return stems_of(found.union(words)).select("raw", "term")


def match_parts_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return _top(ranking.match(ranking.build_index(adapters.parts(spark, d)), STEMMED_QUERY, 10))


def match_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as a terminal shows them: scores in their band's colour, the query's terms marked."""
    docs = adapters.parts(spark, d)
    found = ranking.explain(ranking.build_index(docs), STEMMED_QUERY, 10).join(docs.select("path", "name", "description"), "path")
    return render.match_rows(found, STEMMED_QUERY, colour=True, explain=True).select("path", "line")


def match_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = adapters.parts(spark, d)
    found = ranking.match(ranking.build_index(docs), STEMMED_QUERY, 10).join(docs.select("path", "name", "description"), "path")
    return render.match_rows(found, STEMMED_QUERY, colour=True, path_only=True).select("line")


def markdown_outline(spark: SparkSession, d: str) -> DataFrame:
    """Headings, links and code spans, with their place in bytes."""
    return _notes(spark, d).select("path", F.inline(markdown_nodes("content"))).select("path", "type", "value", "url", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"))


def heading_anchor_list(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("path", F.array_join(heading_anchors("content"), " ").alias("anchors"))


def lint_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    return lint.frontmatter_findings(lint.with_policy(_cards(spark, d), parse(CARD_RULES))).select(*lint.COLUMNS)


def _note_findings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files, rules = _notes(spark, d), parse(NOTE_RULES)
    return files, lint.reference_findings(lint.with_policy(files, rules), files.select("path"), rules)


def lint_references(spark: SparkSession, d: str) -> DataFrame:
    return _note_findings(spark, d)[1].select(*lint.COLUMNS)


def diagnostic_texts(spark: SparkSession, d: str) -> DataFrame:
    return render.diagnostics(_note_findings(spark, d)[1], colour=True).select("text")


def fix_files(spark: SparkSession, d: str) -> DataFrame:
    return fix.rewrites(*_note_findings(spark, d))


def fix_summary(spark: SparkSession, d: str) -> DataFrame:
    return fix.summary(_note_findings(spark, d)[1]).select("count", F.array_join("rules", ",").alias("rules"))


def run_status(spark: SparkSession, d: str) -> DataFrame:
    found = _note_findings(spark, d)[1]
    both = lint.status(found).withColumn("mode", F.lit("lint")).union(lint.status(found, fixing=True).withColumn("mode", F.lit("fix")))
    return both.select("mode", "errors", "warnings", "fixable", F.array_join("rules", ",").alias("rules"), "failed")


def edit_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    """Line items as edits of their order's file: where one reaches into the next."""
    items = adapters.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_partkey") % 1000).alias("start"), (F.col("l_partkey") % 1000 + F.col("l_quantity").cast("long")).alias("end"))
    return fix.overlaps(items)


def lint_budgets(spark: SparkSession, d: str) -> DataFrame:
    """The rule for token budgets, where a byte counts as a token."""
    files = adapters.documents(spark, d).select("path", F.col("body").alias("content"))
    rules = parse(
        '[[rules]]\npath = "*.md"\nmax-tokens = 2000\nseverity = "warn"\n[[rules]]\npath = "src1/"\nexclude = ["src1/fr/"]\nmax-tokens = 500\n[[rules]]\npath = "src2"\ndisable = ["max-tokens"]\n'
    )
    return lint.token_findings(lint.with_policy(files, rules), F.octet_length).select(*lint.COLUMNS)


def file_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Lines and bytes of documents with many of either, beside the limits that apply."""
    files = adapters.documents(spark, d).select("path", F.col("body").alias("content"))
    return sizes.sizes(files, parse(RULES), F.octet_length, min_lines=5, min_tokens=3000).select("path", "lines", "max_lines", "tokens")


def default_policy(spark: SparkSession, d: str) -> DataFrame:
    """The built-in rules for documents, some of them under the names of guides."""
    path, last = F.col("path"), F.regexp_extract("path", r"(.)\.md$", 1)
    names = {"0": "AGENTS.md", "1": "SKILL.md", "2": "README.md", "3": "CLAUDE.md", "4": "GEMINI.md"}
    named = text.base_name(path)
    for digit, name in names.items():
        named = F.when(last == digit, name).otherwise(named)
    docs = adapters.documents(spark, d).select(F.concat_ws("/", text.path_prefix(path), named).alias("path"))
    policy = docs.select("path", default().policy(path).alias("p"))
    return policy.select("path", "p.max_lines", "p.max_tokens", F.array_join("p.required", ",").alias("required"), F.filter("p.field_max_chars", lambda x: x["field"] == "description")[0]["max_chars"].alias("description_chars"))


def lint_max_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token budgets by the vocabulary at hand, which stands in for the one that rule files are meant for."""
    import public_tokenizers

    from marginalia.functions.tokens import TokenCounter, count_tokens

    counter = TokenCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    files = adapters.documents(spark, d).select("path", F.col("body").alias("content"))
    rules = parse('[[rules]]\npath = "*.md"\nmax-tokens = 2000\nseverity = "warn"\n')
    found = lint.token_findings(lint.with_policy(files, rules), count_tokens(counter))
    return found.select(*lint.COLUMNS, F.lit(counter.name).alias("vocabulary"))


def lint_files(spark: SparkSession, d: str) -> DataFrame:
    """All rules over documents as files, whose texts hold Markdown of any kind."""
    files = _files(spark, d)
    rules = parse(RULES + '\n[[rules]]\npath = "src3/"\nenable = ["prefer-links-for-local-paths"]\n')
    return lint.findings(files, files.select("path"), rules).select(*lint.COLUMNS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        corpus_documents, tokenize_explode, compound_expand, field_term_freq, field_lengths, doc_frequency, corpus_stats, idf_table, match_topk, match_saved, match_explain, match_duplicate_terms, match_scoped, match_exclude, match_parts, match_pages,
        match_batch, match_stemmed, match_parts_stemmed, match_rows, match_paths, stem_terms, list_described, list_rows, list_scopes, discover_filter, repository_documents, frontmatter_fields, markdown_outline, heading_anchor_list, lint_max_lines,
        lint_frontmatter, lint_references, diagnostic_texts, rule_policy_fold, glob_self_vs_ancestor, page_links_classified, page_links_resolved, anchor_slugs, fix_summary, fix_files, run_status, edit_overlap_check, lint_budgets, file_sizes, default_policy, lint_max_tokens,
        lint_files,
    )
    return {f.__name__: f for f in found}


"""BM25F over name, folder and description.

An index is built once: a row for each document and term, with its frequency in each field. A query
joins its few terms to it. Statistics come from the same rows, after whatever selects the corpus; the
number of documents comes from the documents, as those without terms have no rows. A single query on an
index that is neither written nor persisted reads the texts once, and stems only words that may have its terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.analyzer import analyze_text, explode_terms, stems_of
from marginalia.functions.porter2 import word_prefix
from marginalia.functions.text import path_prefix
from marginalia.runtime import materialize

#: The fields' weights and BM25's parameters.
BOOSTS = {"name": 3, "description": 1, "path": 1}
K1, B, LEAST = 1.2, 0.75, 1e-6
LIMIT = 5


class QueryError(ValueError):
    """The query has nothing to look for."""


def query_terms(query: str, stemmed: bool = True) -> list[str]:
    """A query's terms in order, repeats kept."""
    if not query.strip():
        raise QueryError("query must contain at least one non-empty word")
    terms = analyze_text(query, stemmed)
    if not terms:
        raise QueryError("query must contain at least one non-stopword term")
    return terms


@dataclass
class Index:
    """docs: the corpus. postings: path, term, n_name, n_description, n_path, f. lengths: path, len.

    A saved index also has the tables that frequencies() and stats() give. passing says that postings
    are worked out from docs whenever they are read.
    """

    docs: DataFrame | None
    postings: DataFrame
    lengths: DataFrame
    stemmed: bool
    terms: DataFrame | None = None
    figures: DataFrame | None = None
    passing: bool = False

    def stats(self) -> DataFrame:
        """One row: n documents, and avgdl, their mean length (1 if there is nothing)."""
        if self.figures is not None:
            return self.figures
        n = self.docs.agg(F.count("*").alias("n"))
        total = self.lengths.agg(F.coalesce(F.sum("len"), F.lit(0)).cast("double").alias("total"))
        return n.join(total).select("n", "total", F.when((F.col("n") > 0) & (F.col("total") > 0), F.col("total") / F.col("n")).otherwise(1.0).alias("avgdl"))

    def frequencies(self) -> DataFrame:
        """(term, df): in how many documents a term stands, in whatever field."""
        return self.terms if self.terms is not None else self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def persist(self) -> Index:
        self.postings.persist()
        self.lengths.persist()
        self.passing = False
        return self

    def save(self, path: str) -> Index:
        """Write the index below path, postings in the order of their terms, and give the one that reads it.

        A query then reads the row groups of its terms only. A very frequent term lies in several files.
        """
        self.postings.repartitionByRange("term", "path").sortWithinPartitions("term", "path").write.parquet(f"{path}/postings")
        read = self.postings.sparkSession.read
        postings = read.parquet(f"{path}/postings")
        postings.groupBy("path").agg(F.sum("f").alias("len")).write.parquet(f"{path}/lengths")
        written = Index(self.docs, postings, read.parquet(f"{path}/lengths"), self.stemmed)
        written.frequencies().write.parquet(f"{path}/terms")
        written.stats().write.parquet(f"{path}/stats")
        return load_index(self.postings.sparkSession, path, self.stemmed)


def load_index(spark: SparkSession, path: str, stemmed: bool = True) -> Index:
    """An index that save() wrote."""
    postings, lengths, terms, stats = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms", "stats"))
    return Index(None, postings, lengths, stemmed, terms, stats)


def raw_terms(docs: DataFrame) -> DataFrame:
    """(path, field, raw): a row for each term of each field. Of the path its folder counts, less one ending .md."""
    fields = F.array(
        F.struct(F.lit("name").alias("field"), F.col("name").alias("text")),
        F.struct(F.lit("description").alias("field"), F.col("description").alias("text")),
        F.struct(F.lit("path").alias("field"), F.regexp_replace(path_prefix(F.col("path")), r"\.md\z", "").alias("text")),
    )
    return explode_terms(docs.select("path", F.explode(fields).alias("f")).select("path", "f.field", "f.text"), "text", ["path", "field"])


def counts(raw: DataFrame) -> DataFrame:
    """(path, raw, n_name, n_description, n_path) of raw (path, field, raw)."""
    return raw.groupBy("path", "raw").agg(*[F.count(F.when(F.col("field") == f, 1)).alias(f"n_{f}") for f in BOOSTS])


def weighted() -> Column:
    """A row's frequency over all fields by their weights."""
    return sum((F.col(f"n_{f}") * w for f, w in BOOSTS.items()), F.lit(0)).cast("long")


def postings_of(counted: DataFrame, stems: DataFrame | None) -> DataFrame:
    """The postings of counts; with stems (raw, term) words that share a stem meet in one row, and words without one go."""
    if stems is not None:
        counted = counted.join(stems, "raw").groupBy("path", "term").agg(*[F.sum(f"n_{f}").alias(f"n_{f}") for f in BOOSTS])
    else:
        counted = counted.withColumnRenamed("raw", "term")
    return counted.select("path", "term", *[f"n_{f}" for f in BOOSTS], weighted().alias("f"))


def build_index(docs: DataFrame, stemmed: bool = True) -> Index:
    """The index of docs (path, name, description)."""
    counted = counts(raw_terms(docs))
    postings = postings_of(counted, stems_of(counted) if stemmed else None)
    return Index(docs, postings, postings.groupBy("path").agg(F.sum("f").alias("len")), stemmed, passing=True)


def narrowed(index: Index, terms: list[str]) -> Index:
    """The index with the postings of terms only, all lengths and the same statistics, from one pass over the texts.

    A working table has a row for each document and word that may have one of the terms, and one for all its other
    words, which count for its length whatever their stems are. Of the former each distinct one is stemmed.
    """
    raw = F.col("raw")
    if index.stemmed:
        starts = sorted({p for t in terms for p in (word_prefix(t), f"'{word_prefix(t)}")})
        may = F.lit(False)
        for start in starts:
            may = may | F.startswith(raw, F.lit(start))
    else:
        may = raw.isin(terms)
    counted = materialize(counts(raw_terms(index.docs).withColumn("raw", F.when(may, raw))), "narrowed")
    words = counted.where("raw is not null")
    stems = stems_of(words).where(F.col("term").isin(terms)) if index.stemmed else None
    lengths = counted.groupBy("path").agg(F.sum(weighted()).alias("len"))
    return Index(index.docs, postings_of(words, stems), lengths, index.stemmed)


def idf(n: Column, df: Column) -> Column:
    """Doubles and log1p, so that a term in all of very many documents still counts a little."""
    return F.log1p((F.greatest(n, F.lit(1)) - df + 0.5) / (df + 0.5))


def first_field() -> Column:
    """0 for a hit in the name, 1 in the description, 2 in the path only."""
    return F.when(F.col("n_name") > 0, 0).when(F.col("n_description") > 0, 1).otherwise(2)


def weighed(index: Index, wanted: DataFrame | list[str]) -> DataFrame:
    """(path, term, part, field) of each posting of the wanted terms: what the term adds to the document's score.

    The terms' side is the small one: it picks postings, which are all that moves. Whether it is
    broadcast is left to its size at run time; listed terms are a filter on the scan.
    """
    if isinstance(wanted, list):
        hits, known = (t.where(F.col("term").isin(wanted)) for t in (index.postings, index.frequencies()))
    else:
        hits = index.postings.join(wanted, "term", "left_semi")
        known = index.terms.join(wanted, "term", "left_semi") if index.terms is not None else hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(known, "term").join(index.lengths, "path").crossJoin(F.broadcast(index.stats()))
    norm = 1 - B + B * F.col("len") / F.greatest(F.col("avgdl"), F.lit(LEAST))
    part = idf(F.col("n"), F.col("df")) * (K1 + 1) * F.col("f") / (F.col("f") + K1 * norm)
    return rows.select("path", "term", part.alias("part"), first_field().alias("field"))


def summed(rows: DataFrame) -> DataFrame:
    """(query, path, score, matched, first_field) of rows (query, path, part, times, field)."""
    return (
        rows.groupBy("query", "path")
        .agg(F.sum(F.col("part") * F.col("times")).alias("score"), F.sum("times").alias("matched"), F.min("field").alias("first_field"))
        .where("score > 0")
    )


def score(index: Index, queries: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(query, path, score, matched, first_field) of each document with a term; queries: (query, term, times), terms all its terms if known."""
    return summed(weighed(index, terms if terms is not None else queries.select("term").distinct()).join(queries, "term"))


def ordering() -> list[Column]:
    """Best first. Scores that differ only by the order of their sums, as those of copies do, are ties."""
    return [F.round("score", 9).desc(), F.desc("matched"), F.asc("first_field"), F.asc("path")]


def match(index: Index, query: str, limit: int = LIMIT) -> DataFrame:
    """The limit best documents: path, score, matched, first_field, n_terms, in order."""
    terms = query_terms(query, index.stemmed)
    rows = [(query, t, terms.count(t)) for t in sorted(set(terms))]
    queries = index.postings.sparkSession.createDataFrame(rows, "query string, term string, times long")
    found = score(narrowed(index, sorted(set(terms))) if index.passing else index, queries, sorted(set(terms)))
    return found.select("path", "score", "matched", "first_field", F.lit(len(terms)).cast("long").alias("n_terms")).orderBy(*ordering()).limit(limit)


def explain(index: Index, query: str, limit: int = LIMIT) -> DataFrame:
    """match() with relative (to the best score), coverage and band."""
    found = match(index, query, limit)
    top = F.max("score").over(Window.partitionBy())  # limit rows at most
    share, covered = F.col("score") / top, F.col("matched") / F.col("n_terms")
    band = F.when((share >= 0.75) & (covered >= 0.75), "high").when((share >= 0.35) | (covered >= 0.5), "medium").otherwise("low")
    return found.select(
        "path",
        "score",
        F.concat(F.round(100 * share).cast("int").cast("string"), F.lit("% of top")).alias("relative"),
        F.concat(F.col("matched").cast("string"), F.lit("/"), F.col("n_terms").cast("string"), F.lit(" terms")).alias("coverage"),
        band.alias("band"),
        "matched",
        "first_field",
    )


def match_batch(index: Index, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The limit best documents of each query of queries (query, text): query, path, score, matched, rank."""
    raw = explode_terms(queries.select("query", "text"), "text", ["query"])
    terms = raw.join(stems_of(raw), "raw") if index.stemmed else raw.withColumnRenamed("raw", "term")
    counted = terms.groupBy("query", "term").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(*ordering()))
    return score(index, counted).withColumn("rank", place).where(F.col("rank") <= limit).select("query", "path", "score", "matched", "rank")

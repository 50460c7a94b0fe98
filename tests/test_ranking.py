import pytest
from pyspark.sql import functions as F

from marginalia.functions import porter2
from marginalia.functions import text as X
from marginalia.operators import ranking


def corpus(spark, rows):
    return spark.createDataFrame(rows, "path string, name string, description string")


A = [("docs/low.md", "low", "zetasoup"), ("docs/medium.md", "Uniquealpha", None), ("docs/high.md", "Alpha Beta", None)]
B = [("docs/top.md", "Alpha Beta Gamma Delta", None), ("docs/mid.md", "Alpha Beta", None), ("docs/low.md", "low", "Alpha")]


@pytest.mark.parametrize("query, path, score", [("zetasoup", "docs/low.md", 1.0066), ("uniquealpha", "docs/medium.md", 1.6285), ("alpha beta", "docs/high.md", 2.8891)])
def test_scores(spark, query, path, score):
    top = ranking.match(ranking.build_index(corpus(spark, A)), query).first()
    assert top.path == path and top.score == pytest.approx(score, abs=1e-4)


def test_explain(spark):
    rows = ranking.explain(ranking.build_index(corpus(spark, B)), "alpha beta gamma delta").collect()
    assert [(r.path, r.relative, r.coverage, r.band) for r in rows] == [("docs/top.md", "100% of top", "4/4 terms", "high"), ("docs/mid.md", "27% of top", "2/4 terms", "medium"), ("docs/low.md", "4% of top", "1/4 terms", "low")]
    assert [r.score for r in rows] == pytest.approx([3.5991, 0.9821, 0.1597], abs=1e-4)


def test_repeated_terms_count_twice(spark):
    index = ranking.build_index(corpus(spark, A))
    once, twice = ranking.match(index, "zetasoup").first(), ranking.match(index, "zetasoup zetasoup").first()
    assert twice.score == pytest.approx(2 * once.score) and (twice.matched, twice.n_terms) == (2, 2)


def test_queries_are_checked_first():
    for query in ("", "  ", "the of"):
        with pytest.raises(ranking.QueryError):
            ranking.query_terms(query)


def test_documents_without_terms_count(spark):
    stats = ranking.build_index(corpus(spark, [("a.md", "x", None), ("the.md", "the", None)])).stats().first()
    assert (stats.n, stats.avgdl) == (2, 1.5)
    empty = ranking.build_index(corpus(spark, []))
    assert tuple(empty.stats().first()) == (0, 0.0, 1.0)
    assert ranking.match(empty, "x").collect() == []


def test_ties_by_path_and_limit(spark):
    index = ranking.build_index(corpus(spark, [(f"alpha/{i}.md", "n", None) for i in range(6)]))
    assert [r.path for r in ranking.match(index, "alpha").collect()] == [f"alpha/{i}.md" for i in range(5)]
    assert ranking.match(index, "alpha", 0).collect() == []


def test_batch_equals_single(spark):
    index = ranking.build_index(corpus(spark, A + B[:2]))
    queries = ["alpha beta", "zetasoup low", "nothing here", "beta beta medium"]
    batch = ranking.match_batch(index, spark.createDataFrame(list(enumerate(queries)), "query long, text string")).collect()
    for n, q in enumerate(queries):
        got = [(r.path, round(r.score, 9)) for r in sorted(batch, key=lambda r: r["rank"]) if r["query"] == n]
        assert got == [(r.path, round(r.score, 9)) for r in ranking.match(index, q).collect()]


@pytest.mark.parametrize("path, stem, prefix", [("a/foo.bar.md", "foo.bar", "a"), (".hidden", ".hidden", ""), ("x", "x", ""), ("a/b/c.md", "c", "a/b")])
def test_names(spark, path, stem, prefix):
    assert tuple(spark.createDataFrame([(path,)], "p string").select(X.file_stem(F.col("p")), X.path_prefix(F.col("p"))).first()) == (stem, prefix)


@pytest.mark.parametrize("text, n", [("", 0), ("a", 1), ("a\n", 1), ("a\n\n", 2), ("a\r\nb", 2)])
def test_lines(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(X.count_lines(F.col("t"))).first()[0] == n


@pytest.mark.parametrize("path, out", [("a/./b", "a/b"), ("a/../b", "b"), ("../a", None), ("a/..", None), ("a//b/", "a/b"), ("", None), ("a/../../b", None)])
def test_normalize(spark, path, out):
    assert spark.createDataFrame([(path,)], "p string").select(X.normalize(F.col("p"))).first()[0] == out


def test_a_saved_index_gives_the_same(spark, tmp_path):
    index = ranking.build_index(corpus(spark, A + B[:1]))
    saved = index.save(str(tmp_path / "index"))
    for query in ("zetasoup alpha", "alpha beta alpha", "nowhere"):
        want, got = (sorted(map(tuple, ranking.match(i, query).collect())) for i in (index, saved))
        assert got == want
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "zetasoup")], "query long, text string")
    assert sorted(map(tuple, ranking.match_batch(saved, queries).collect())) == sorted(map(tuple, ranking.match_batch(index, queries).collect()))
    again = ranking.load_index(spark, str(tmp_path / "index"))
    plan = ranking.match(again, "zetasoup")._jdf.queryExecution().toString()
    assert "In(term" in plan or "EqualTo(term" in plan


def test_a_query_reads_the_texts_once(spark):
    """What a query alone takes is worked out in one pass, equal to the whole index; other words aren't stemmed."""
    rows = [("a/x.md", "'Tis possibility's", "possibilities dying skies early dies"), ("b/y.md", "possible", "possibly plates plating the consigned"), ("c.md", "die", None), (None, "sky", "possibility"), ("d/the.md", "the", "consigning early skis")]
    docs = corpus(spark, rows)
    for stemmed in (True, False):
        index, whole = ranking.build_index(docs, stemmed), ranking.build_index(docs, stemmed).persist()
        for query in ("possibility", "dying sky skis", "early early plates", "consign 'tis die", "nowhere"):
            found = ranking.match(index, query)
            assert found.collect() == ranking.match(whole, query).collect()
            assert "Generate" not in found._jdf.queryExecution().toString()


def test_stems_start_as_their_words_do():
    sample = [w + s for w in ("consol", "poss", "abil", "di", "sk", "ear", "rel", "hop", "'tw", "y", "gener") for s in ("", "e", "y", "ing", "ied", "ies", "ational", "ibility", "bly", "ely", "izer", "iveness", "ical", "ll", "ogist", "entli", "eed")]
    for word in (*sample, *porter2.WHOLE, *porter2.UNCHANGED):
        start = porter2.word_prefix(porter2.stem(word))
        assert word.startswith((start, f"'{start}")), word

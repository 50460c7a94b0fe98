import pytest

from marginalia.functions.analyzer import Span, analyze_path, analyze_text, explode_terms, highlight, spans
from marginalia.functions.porter2 import stem


@pytest.mark.parametrize(
    "text, terms",
    [
        ("plans reviews analyzed", "plan review analyz"),
        ("XMLParser", "xml parser"),
        ("BM25F v1 f32 R2D2 SD500 ADR0004", "bm25f v1 f32 r2d2 sd500 adr0004"),
        ("O'Reilly", "o'reilli"),
        ("'s", ""),
        ("s'", ""),
        ("execplan EXECPLAN", "exec plan exec plan"),
        ("was the of", ""),
        ("you're", "you'r"),
        ("the's", ""),
        ("plan plans", "plan plan"),
        ("", ""),
    ],
)
def test_text(text, terms):
    assert analyze_text(text) == terms.split()


def test_path_loses_one_ending():
    assert analyze_path("docs/the-active-plans/scoring-guide.md") == "doc activ plan score guid".split()
    assert analyze_path("a.md.md", stemmed=False) == ["md"]


@pytest.mark.parametrize("word, out", [("dogs", "dog"), ("generously", "generous"), ("skies", "sky"), ("hoping", "hope"), ("hopping", "hop"), ("relational", "relat"), ("cries", "cri"), ("ties", "tie"), ("agreed", "agre"), ("national", "nation"), ("happy", "happi"), ("by", "by"), ("communication", "communic"), ("proceed", "proceed"), ("controlling", "control"), ("rational", "ration"), ("decisiveness", "decis"), ("consign", "consign"), ("knightly", "knight"), ("yelled", "yell")])
def test_stem(word, out):
    assert stem(word) == out


def test_spans_join_to_the_chunk():
    assert spans("ExecPlan's") == [Span("Exec", ("exec",)), Span("Plan", ("plan",)), Span("'s", ())]
    for chunk in ("execplan", "HTTPServerS'", "abc", "'s", "ExecPlanExecplan"):
        assert "".join(s.surface for s in spans(chunk)) == chunk


def test_highlight_escapes():
    assert highlight("Plans | a\nplan", {"plan"}, "<", ">") == "<Plans> \\| a <plan>"


def test_column_analyzer_equals_the_plain_one(spark):
    texts = ["ExecPlan's XMLParser", "dogs' boss' Cat's", "the Fox's dEN", "a\u00a0b\u2003c\u0085d", "O'Reilly_x", "", "é ÀB aÉ", "execplans EXECPLAN", "''s's", "AbCDEf", "s' 's"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id long, text string")
    found = {}
    for row in explode_terms(df, "text", ["id"]).collect():
        found.setdefault(row.id, []).append(row.raw)
    for i, t in enumerate(texts):
        assert sorted(found.get(i, [])) == sorted(analyze_text(t, stemmed=False)), t

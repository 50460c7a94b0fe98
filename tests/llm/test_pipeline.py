"""The pipeline against a plain version of its stages, each on its own input; and its registration."""

import random

import brute
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from marginalia.llm import bpe, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(["an", "the", "ion", "re", "st", "ou"], k=rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = "This line stands in many documents"
    items = [(i, text(20)) for i in range(4)]
    rows = [(i, "\n".join([text(40), text(30), shared if i % 3 == 0 else text(9)]), "en", "s", 1) for i in range(30)]
    rows += [(100 + i, rows[i][1].replace("the ", "teh ", 1), "en", "s", 1) for i in range(5)]
    whole = [text(300) for _ in range(3)]
    rows += [(150 + 10 * i + k, f"{t} end{k}", "en", "s", 1) for i, t in enumerate(whole) for k in range(4)]
    rows += [(200, items[0][1], "en", "s", 1), (201, text(400) + " " + items[1][1] + " " + text(300), "en", "s", 1), (202, "12 !!", None, None, None), (203, None, "en", None, 0), (204, "", "de", "s", 0), (205, text(30), None, None, None)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, items


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, folder, tmp_path):
    path, rows, items = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(docs)
        out = stage(spark, docs, path)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert docs.columns == COLUMNS
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None and name in ("lines", "benchmark"))
            seen[name] = before, pairs(docs)
    before, after = seen["language"]
    assert after == [(i, t) for i, t in before if t and any(c.isalpha() for c in t)]
    before, after = seen["lines"]
    assert after == sorted((i, kept) for i, _, _, kept in brute.lines(before))
    before, after = seen["near_duplicates"]
    found = brute.simhash(before)
    assert after == [(i, t) for i, t in before if found[i][1] == i] and len(after) < len(before)
    before, after = seen["benchmark"]
    found = {i: (hit, bad) for i, _, hit, _, bad in brute.decontaminate(before, items)}
    assert [i for i, _ in after] == [i for i, _ in before if not found[i][1]] and 200 not in dict(after) and 201 in dict(after)
    assert all(t == dict(before)[i] for i, t in after if not found[i][0])
    assert items[1][1] not in dict(after)[201]
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(queries.RANKS)), special_tokens={})
    want = [(i, len(x), brute.sha(",".join(map(str, x))), brute.sha(t or ""), x) for i, t in after for x in [plain.encode_ordinary(t or "")]]
    assert sorted(tuple(r) for r in docs.collect()) == want
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, path).collect()) == want


def test_language_stage_decides(spark):
    """Clean documents stay, whatever their language; texts in none that was learned go; lang is what was predicted."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    alien = ["Всё что было, то прошло и быльём поросло", "これは日本語の文章です。これは日本語の文章です。", "qzxv wkjq zzqx vvkq xkcd qqqq"]
    rows = spark.createDataFrame([(10**7 + i, t, None, "s", 1) for i, t in enumerate(alien)], SCHEMA)
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs.union(rows), "").collect()}
    known = {r.doc_id: r.lang for r in docs.where("lang is not null").collect()}
    assert known.keys() <= kept.keys() and sum(kept[i] == lang for i, lang in known.items()) >= 0.99 * len(known)
    assert not kept.keys() & {10**7, 10**7 + 1, 10**7 + 2}


def test_null_and_repeated_ids(spark, folder, tmp_path):
    """Rows that share an id, or have none, go through every stage: near-duplicates leave one row, others all stay."""
    path, _, items = folder
    rng = random.Random(44)
    text = lambda n: " ".join("".join(rng.choices(["an", "the", "ion", "re", "st", "ou"], k=2)) for _ in range(n))
    a, b, c, d = (text(60) for _ in range(4))
    rows = [(None, a), (None, b), (7, c), (7, d), (7, c), (None, a), (8, a), (None, items[0][1]), (9, None), (None, "")]
    spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append((name, docs.count()))
    # empty texts go first; copies lose their one line, and are near-duplicates of each other then; the test item goes
    assert sizes[:2] == [("language", 8), ("lines", 8)]
    ids = sorted((r.doc_id for r in docs.collect()), key=str)
    assert ids in ([7, 7, 8, None], [7, 7, 8, None, None])


def test_empty_table(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).collect() == []


def test_extra_columns_stay(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 AS kept", "2 AS score", "3 AS key", "4 AS clean", "5 AS component_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == COLUMNS, name


def test_registration():
    found = queries.queries()
    assert [n for n in found if n.startswith("op")] == ["op1_langid", "op2_simhash", "op3_bpe", "op4_linededup", "op5_decontaminate", "op6_media", "op7_warc", "op8_toxicity", "op9_suffix", "op10_pii"]
    assert "pipeline" in found and set(queries.oracle_sql()) <= set(found) and 4 <= len(corpus_pipeline.STAGES) <= 5

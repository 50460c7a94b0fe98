from marginalia.operators.ranking import build_index, match
from marginalia.plans.config import parse
from marginalia.streaming.reindex import index_stream, line_findings_stream, read_index


def test_index_grows(spark, tmp_path):
    schema = "path string, name string, description string"
    rows = [("a.md", "alpha", "one"), ("b.md", "beta", "alpha two"), ("c.md", "gamma", None)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        index_stream(stream, str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
        docs = spark.createDataFrame(rows[: i + 1], schema)
        got = match(read_index(docs, str(tmp_path / "index")), "alpha two").collect()
        assert [(r.path, round(r.score, 9)) for r in got] == [(r.path, round(r.score, 9)) for r in match(build_index(docs), "alpha two").collect()]


def test_findings(spark, tmp_path):
    schema = "path string, content string"
    spark.createDataFrame([("a.md", "x\ny\n"), ("b.md", "x")], schema).write.parquet(str(tmp_path / "in"))
    rules = parse('[[rules]]\npath = "*.md"\nmax-lines = 1\n')
    line_findings_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), rules, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [(r.file, r.rule) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a.md", "max-lines")]

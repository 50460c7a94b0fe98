import pytest
from pyspark.sql import functions as F

from marginalia.functions import register

VALUES = ["A Title, of sorts!", "a/b/c.tar.md", "x\ny\r\n", "", "caf%C3%A9+b", "a|b", "हिन्दी शीर्षक", ".md"]


@pytest.mark.parametrize("name", sorted(register.EXPRESSIONS))
def test_expressions(spark, name):
    assert name in register.register(spark)
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    column, _ = register.EXPRESSIONS[name]
    got = df.select(column(F.col("v")).alias("want"), F.expr(f"{name}(v)").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_python_functions(spark):
    register.register(spark)
    row = spark.sql("SELECT md_stem('knitting') AS s, md_terms('The Larger plates') AS t, md_path_terms('docs/ExecPlan.md') AS p, md_anchors('# A b\\n# A b') AS a, md_frontmatter('---\\nname: x\\n---').status AS f, md_nodes('[x](y.md)')[0].url AS u").first()
    assert tuple(row) == ("knit", ["larger", "plate"], ["doc", "exec", "plan"], ["a-b", "a-b-1"], "valid", "y.md")

"""SQL functions give what the columns give."""

from pyspark.sql import functions as F

from citeloom.functions import keys, sql
from citeloom.operators import prose

VALUES = [None, "", " https://doi.org/10.1/A ", "http://dx.doi.org/doi:10.2", "1 -- 9", "a\\b  c\n", "HTTP://u@Ex.org:80/x", "a, EVIDENCE-WEB, b"]


def test_functions_equal_columns(spark):
    assert sql.register(spark) == list(sql.FUNCTIONS)
    df = spark.createDataFrame([(v,) for v in VALUES], "x string")
    columns = {name: getattr(keys, name) for name in sql.FUNCTIONS if hasattr(keys, name)} | {"without_tiers": prose.without_tiers}
    for name, column in columns.items():
        wrong = df.select("x", F.expr(f"{name}(x)").alias("a"), column(F.col("x")).alias("b")).filter("NOT a <=> b").collect()
        assert wrong == [], name

from pyspark.sql import functions as F


def rows(df, *columns):
    """Rows as sorted tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


def one(spark, expression):
    """Value of a column expression on a one-row frame."""
    return spark.range(1).select(expression.alias("v")).first()["v"]


def over(spark, values, function, kind="string"):
    """Values of a function of column ``v``, in input order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()

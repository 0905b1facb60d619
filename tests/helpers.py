"""Small tools for the tests: evaluate column expressions over literal rows."""


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(spark, rows, schema, *columns):
    """The columns' values per input row, in input order."""
    numbered = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, "_i int, " + schema)
    named = [c.alias(f"v{i}") for i, c in enumerate(columns)]
    out = sorted(df.select("_i", *named).collect(), key=lambda r: r["_i"])
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in out]

"""Small tables with the odd cases every operator must take."""

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, parts=3):
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOC).repartition(parts)


def clashing(df):
    """Extra columns named like those the operators use inside."""
    from pyspark.sql import functions as F

    names = ("row", "digest", "key", "h", "k", "gram", "length", "part", "keep_id", "h1", "set_id", "comp", "a", "b")
    return df.withColumns({n: F.lit(1) for n in names})


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}

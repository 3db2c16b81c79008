"""Small documents that every operator must take: nulls, empty and long texts, repeated rows, clashing column names."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from the old barn near the river bank. "


def documents(spark, extra: list[tuple] = ()):
    long = PROSE * 3000
    rows = [
        (1, PROSE * 3, "en", "a", None), (2, PROSE * 3, "en", "a", None), (2, PROSE * 3, "en", "a", None), (3, None, "en", "a", None), (4, "", None, None, None),
        (5, long, "en", "b", None), (None, "no id here at all", "en", "b", None), (6, " \n\t ", "de", "b", None), (7, "x", "de", "b", None), *extra,
    ]
    return spark.createDataFrame(rows, SCHEMA)


#: Columns whose names operators use inside.
CLASHES = ["spans", "start", "end", "fp", "id", "a", "b", "path", "shared", "score", "w", "h", "line", "label", "count", "host", "rule", "language", "secret_spans", "contamination"]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})

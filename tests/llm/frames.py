"""Small frames with the cases that every operator has a defined result for."""

import pandas as pd
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
#: Names that operators use inside; none of them may disturb a result.
CLASHING = ("print", "rank", "body", "size", "block", "cell", "node", "taken", "length", "host", "held")
LONG = "word " * 30_000

ROWS = [
    (1, "Hello big world of text", "en", "a"),
    (2, "hello BIG world of text", "en", None),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \t\n ", "de", "b"),
    (6, LONG, "en", "a"),
    (7, "Hello big world of text", "en", "a"),
    (7, "Hello big world of text", "en", "a"),
    (None, "no id here at all, really", "en", "c"),
    (None, None, None, None),
    (9, "ÄÖ É straße あい 🙂 ٣", "de", "c"),
    (10, "one", "en", "c"),
    (11, "mail jane.doe@example.org or +1 (017) 555-7713 from 10.0.0.1, later 555-7713", "en", "c"),
]


def documents(spark, rows=ROWS):
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields] + [T.StructField(c, T.StringType()) for c in CLASHING])
    data = [(*r, None if r[1] is None else len(r[1]), *(["x"] * len(CLASHING))) for r in rows]
    return spark.createDataFrame(data, schema)


def as_pandas(df) -> pd.DataFrame:
    return df.toPandas()

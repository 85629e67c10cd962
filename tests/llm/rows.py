"""Rows that every operator has to stand: nulls, empty and long texts, repeats, ties, clashing names."""

ODD = [
    (None, None, None, None, None),
    (None, "", "en", "s", 0),
    (7001, None, "en", None, 1),
    (7002, "", None, "s", 0),
    (7003, "x", "en", "s", 1),
    (7003, "x", "en", "s", 1),
    (7004, "same id, other text " * 30, "en", "s", 5),
    (7004, "same id, another text " * 30, "en", "s", 5),
    (7005, "Ünï ｗｉｄｅ 𝔘 \U0001f600 İK \x00 \t\x0b tail", "de", "s", 9),
    (7006, "a long text with many words and no end " * 4000, "en", "s", 9),
    (7006, "a long text with many words and no end " * 4000, "en", "s", 9),
    (7007, "aaaa" * 3000, "en", "s", 9),
    (7008, "All rights reserved. CC BY and the general public license", "en", "s", 9),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ("rid", "did", "dh", "w", "m", "n", "pos", "spans", "label", "grams", "bits", "copies", "lo", "kh", "first")


def documents(spark, sf=None):
    """The odd rows, with the smallest table's documents if ``sf`` is given, and further columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, DOC_SCHEMA)
    if sf:
        df = df.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select(*df.columns))
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]

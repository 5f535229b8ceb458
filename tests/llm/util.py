"""Small shared fixtures: texts that every operator must bear."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977} filler{i % 31}" for i in range(30_000))
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\x0b", None, None, None), (4, LONG, "en", "a", 1),
    (5, "x", "en", None, 1), (5, "x", "en", None, 1), (None, "no id here at all", "en", "b", 3), (7, "Éé 中文 | $5 <|endoftext|>", "fr", "b", 3),
    (8, None, None, None, None), (9, "a b c a b c a b c", "en", "a", 9), (9, "another text under the same id", "en", "a", 9),
]


def odd_docs(spark):
    from pyspark.sql import functions as F

    # Extra columns whose names clash with what operators add.
    return spark.createDataFrame(ODD, SCHEMA).withColumns(
        {c: F.lit("extra") for c in ("n_words", "words", "kept", "copy", "score", "text_hash", "found")})


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

"""Small tables with the awkward cases every operator must take."""

from tests.conftest import SF

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
AWKWARD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, "   \n\t ", "en", None), (4, LONG, "en", "b"), (5, "same text here again and again " * 12, "en", "b"),
    (6, "same text here again and again " * 12, "en", "b"), (7, "single", "de", "b"), (8, "Ünï cödé — “quotes” 😀 <|endoftext|>  two  spaces \n\n end ", "fr", "c"),
    (9, LONG + " tail", None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Names that operators use inside or return, in other cases too.
CLASHING = "row key gone id a b x y h1 line component n bucket packed N_Words kept Kept words sketch tokens stays copies n_removed removed_ c0 o0 c1 __words __kept __doc __gone __row set_key Base_Failed topic n_tokens terms salt weight p".split()


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated texts, a row without doc_id, and columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*row[:2], *row[2:]) for row in AWKWARD], SCHEMA)
    names = [n for n in CLASHING if n not in df.columns]
    return df.select("*", *[F.lit(f"mine {i}").alias(f"e{i}") if i % 3 else F.lit(None).cast("double").alias(f"e{i}") for i in range(len(names))]).toDF(*df.columns, *names)


def clash_free(df):
    """The columns by position, for reading rows of a table with names that differ in case only."""
    return df.toDF(*[f"k{i}" for i in range(len(df.columns))])


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}

"""Awkward rows that every operator on documents must take."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(60_000))
PLAIN = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf"
ROWS = [
    (1, PLAIN),
    (1, PLAIN),  # a repeated row
    (2, PLAIN),  # a copy
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, PLAIN + " again"),
    (None, None),
    (6, "one two"),
    (7, "Ünïcode straße ΣΑΣ 中文 <|endoftext|> x"),
    (8, LONG),
    (9, LONG + " end"),
]
#: Names that operators use inside.
CLASHING = "id likely text_hash _hash _id n v g s at digest prefix rank length _part _place slot shard reject_score seeds d".split()


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({name: F.lit("x") for name in CLASHING})


def empty(spark):
    return documents(spark, [])

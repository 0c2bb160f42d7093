"""Small documents tables with the hard cases of every operator."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def table(spark, rows):
    """rows: (doc_id, text) or whole rows."""
    full = [(r[0], r[1], "en", f"s{(r[0] or 0) % 3}", len(r[1] or "")) if len(r) == 2 else r for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def hard_rows():
    """Null and empty texts, null ids, repeated rows, ties, odd white space, other scripts, long words and a long text."""
    passage = " ".join(f"w{i}" for i in range(60))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "Hello World's end, isn't it? 42 It'll 'S"),
        (4, "Hello World's end, isn't it? 42 It'll 'S"),
        (None, "hello world's end, isn't it? 42 it'll 's"),
        (None, None),
        (5, "Ünïcode Straße ΑΣ ΟΔΟΣ nb em \x1c\x1d ok \x85 é ́x ǅ İ ı ﬀ"),
        (6, "日本語 текст हिन्दी ١٢٣ ½ 🙂🙂 <|endoftext|> a<|startoftext|>b <|EndOfText|>"),
        (7, "x" * 3000 + " " + "é" * 700),
        (8, passage + " tail one"),
        (9, "head " + passage),
        (10, passage + " " + passage),
        (11, ("lorem ipsum dolor sit amet " * 400).strip()),
        (12, "a</w> </w> b'll'll d'D' 12ab34 __x__ ###trash###"),
    ]

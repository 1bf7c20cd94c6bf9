"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

ODD_TEXTS = [
    None, "", " \n\t ", "one", "Two words", "two  WORDS", "a b c", "...", "12 34", "café naïve über",
    "  　 “quoted” — dash", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "x" * 5000, "w " * 3000, "▁a ▁▁b", "tail \n",
]


def documents(spark, rows, extra=""):
    """(doc_id, text, lang, source, n_chars) and columns whose names operators use themselves."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, key string, component string"
    full = [(i, t, lang, "s", len(t or ""), 1, "k", "c") for i, t, lang in rows]
    return spark.createDataFrame(full, schema)


def odd_documents(spark):
    rows = [(i, t, "en") for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "one", "en"), (3, "one", "en"), (None, "one", None), (None, None, "fr"), (100, "one", "de")]
    return documents(spark, rows)


def empty_documents(spark):
    return documents(spark, [])

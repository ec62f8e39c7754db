"""Small awkward tables: nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""

PLAIN = "The river runs past the old mill. It turns the wheel all day long. Nobody remembers who built it."
LONG = " ".join(f"word{k % 977}" for k in range(120_000)) + "."
ROWS = [
    (1, PLAIN, "en", "a", 1), (2, None, None, "a", None), (3, "", "en", None, 0), (None, "A text without an id.", "en", "b", 5),
    (4, LONG, "en", "b", 7), (5, PLAIN, "en", "c", 1), (6, "Repeated row.", "fr", "c", 2), (6, "Repeated row.", "fr", "c", 2),
    (7, "  \n\t ", "de", "", 3), (8, "one", "es", "d", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = ["row", "score", "size", "bucket", "key", "fp", "part", "length", "rank", "copies", "held_out", "n_removed", "_d", "_k", "_s"]


def documents(spark, rows=ROWS):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


def empty(spark):
    return documents(spark, [])


def labels(spark, rows=((1, 1, 0), (5, 0, 1), (8, 1, 0), (None, 1, 1), (6, None, None), (6, 1, 0), (6, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def clusters(pairs):
    """Smallest member reachable, by brute force: pairs -> {node: root}."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}

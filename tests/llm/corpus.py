"""Small corpora for the tests, made by rule, and edge cases that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{c}{v}{d}" for c in "bcdfgh" for v in "aeiou" for d in "klmnprst"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=3, n=60):
    """(doc_id, text, lang, source, n_chars): prose, copies, near copies, shared lines."""
    rng, rows, texts = random.Random(seed), [], []
    shared = sentence(rng, 60)
    for i in range(n):
        kind = i % 6
        if kind == 4 and texts:
            text = rng.choice(texts)
        elif kind == 5 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
        else:
            text = "\n".join(sentence(rng, rng.randrange(4, 50)) for _ in range(rng.randrange(1, 6)))
            if kind == 3:
                text += "\n" + shared
        texts.append(text)
        rows.append((i, text, ["en", "de"][i % 2], f"s{i % 5}", len(text)))
    return rows


def edges():
    """Nulls in every column, empty and wordless texts, symbols, one word, repeated rows, one id with two texts, a
    long text."""
    long = "\n".join(f"alpha beta {i % 7} gamma delta epsilon {i}" for i in range(4000))
    return [
        (1000, None, "en", "s0", None), (1001, "", "en", "s1", 0), (1002, " \t\n ", None, None, 4), (1003, "!!! ### 　", "en", "s1", 9),
        (1004, "Single", None, "s2", 6), (1005, "twice the same row of words", "en", "s2", 10), (1005, "twice the same row of words", "en", "s2", 10),
        (1006, "first text of this id", "en", "s2", 10), (1006, "another text of the same id", "en", "s2", 10), (None, "a row without any id at all", "de", "s3", 10),
        (None, "a second row without any id", "de", "s3", 10), (1007, long, "de", "s4", len(long)), (1008, "ÉÀ Ünicode İ ſ MIT License x", "fr", "s4", 5),
    ]


CLASHES = (
    "n_words", "kept", "component_id", "score", "labels", "key", "h", "w", "n", "size", "copy_", "home", "c", "pos", "line", "value", "target", "th",
    "copy", "rate", "entry", "sketch", "template", "__lid", "__lkey", "__ldrop", "__lparts", "__dropped", "__bad_id", "__bad_key", "__own_id", "__own_key",
    "__text_key", "__row", "__rid", "__copies", "__copy", "__good_row", "__id", "__key", "__d", "__k", "__c", "__i", "__s", "__z", "__llines",
)


def frame(spark, rows, clash=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("other") for c in CLASHES}) if clash else df


def tables(spark, folder, rows, clash=True, benchmark=(), labels=()):
    """Writes documents, benchmark and labels; returns the folder for queries."""
    frame(spark, rows, clash).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)

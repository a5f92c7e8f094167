import random
import re

WORDS = "the of and stone river light amber field cloud north seven quiet maple winter signal garden copper silver harbor meadow".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_texts():
    """Null, empty, blank, one word, repeated lines, non-ASCII, a very long word and a very long text."""
    rng = random.Random(3)
    return [None, "", " \n\t", "one", "a b c d", "same line\nsame line\nother", "Été À l'été — ÜBER\u2003x 日本語 テキスト", "x" * 30_000, prose(rng, 30_000), "\x00 \x1c a\x0bb"]


def table(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """df with extra columns named like results."""
    from pyspark.sql import functions as F

    extra = ["n_words", "kept", "score", "items", "spans", "base", "ids", "component_id", "key", "held_out", "p", "u"]
    return df.withColumns({c: F.lit("x") for c in extra})

"""Small inputs with every awkward case, and plain versions of shared definitions."""

import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "two words",
    "the quick brown fox jumps over the lazy dog " * 8,
    "the quick brown fox jumps over the lazy dog " * 8,
    "spam&&& spam&&& spam&&& " * 40,
    "A.\nB.\nA.\nA.\n\n\n",
    "123 456 !!",
    "é ß ünïcode 日本語 " * 20,
    LONG,
    LONG + " tail",
]


def rows():
    out = [(i, t, ("en", None, "de")[i % 3], (None, "a", "b")[i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    return [*out, out[5], (None, "an id of null", "en", "a", 13)]


def words(text):
    return WORDS.findall(text or "")


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def frame(spark, data=None, extra=True):
    """Documents, with extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows() if data is None else data, DOCS)
    return crowded(df) if extra else df


def put(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


#: Names that stages use inside, or used to, and some that need quoting.
INTERNAL = (
    "x _whole _t row text_ _text _trusted _good _id weights counts all_good j h t w g b k src place end given whole target taken size source_size quota rest n "
    "before key keys sig rep least digest first last shares root component node part other task lost one parts others centre a b_ order c f m y good raw score kept predicted "
    "wasteful sequence_id offset piece start length _carry_0 _carry_text _row _k id mixed"
).split() + ["a b", "dot.ted", "tick`ed", "Ünï"]


def crowded(df):
    """The rows with a column for every internal name."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"v{k}").alias(c) for k, c in enumerate(INTERNAL)])

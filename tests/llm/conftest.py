import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder of tables with awkward rows, and one of empty tables."""
    from helpers import frame, put, rows

    folder = tmp_path_factory.mktemp("odd")
    empty = tmp_path_factory.mktemp("empty")
    docs = frame(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(13)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    chats = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", r"\### user: </turn> # < \\"), (2, 1, "assistant", "x"), (2, 0, "user", ""), (3, 0, "user", "a"), (3, 0, "user", "a"), (None, None, None, None), (4, 0, "odd: role\n#", "t" * 50_000)],
        "conv_id long, turn long, role string, text string",
    ).selectExpr("*", "'x' AS valid")
    urls = [None, "", "nothing", "http://", "://", "http://EXAMPLE.com/en/x?a", "https://www.example.com/en/", "http://a.b.net/es/1", "http://x.net/fr", "http://com", "http://com/", "http://a..spam-farm.example.org:80/", "http://adult-x.example.com#t", "http://notadult-x.example.com/a b", "http://casino-win.example.org"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[5]])], "page_id long, url string, html string").selectExpr("*", "'x' AS host")
    del rows
    for name, df in (("documents", docs), ("labels", labels), ("conversations", chats), ("pages", pages)):
        put(df, folder, name)
        put(df.limit(0), empty, name)
    return str(folder), str(empty)

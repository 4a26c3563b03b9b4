"""The engine's table functions for SQL: ``register(spark)`` makes them known to a session.

    SELECT f.path, d.* FROM files f, LATERAL extract_defs(f.path, f.text) d
    SELECT f.path, r.* FROM files f, LATERAL find_refs(f.path, f.text, 'name') r
    SELECT f.path, t.tri FROM files f, LATERAL trigrams(f.text) t
    SELECT rlike(line, re2('\\bpattern$'))
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from dredge.functions import symbols
from dredge.plans.pattern import to_java


class ExtractDefs:
    def eval(self, path: str, text: str):
        if path is not None and text is not None:
            yield from symbols.extract(path, text)


class FindRefs:
    def eval(self, path: str, text: str, name: str):
        if path is not None and text is not None and name in text:
            yield from symbols.references(path, text, name)


class Trigrams:
    def eval(self, text: str):
        from dredge.operators.index import trigram_keys

        if text is not None:
            for key in trigram_keys(text.encode()):
                yield (int(key),)


def register(spark: SparkSession) -> None:
    spark.udtf.register("extract_defs", udtf(ExtractDefs, returnType="name string, kind string, container string, line int"))
    spark.udtf.register("find_refs", udtf(FindRefs, returnType="line int, kind string"))
    spark.udtf.register("trigrams", udtf(Trigrams, returnType="tri int"))
    spark.udf.register("re2", to_java, "string")

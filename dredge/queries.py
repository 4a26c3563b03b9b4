"""The engine's queries over the driver tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge import generated as G
from dredge.conf import EngineConf
from dredge.functions import paths
from dredge.functions import text as T
from dredge.operators import delta as D
from dredge.operators import index as I
from dredge.operators import symbols as Y
from dredge.operators.lines import lines
from dredge.plans import search as S
from dredge.sources import corpus as C
from dredge.storage import shared_folder
from dredge.streaming import changes as H

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FILES = "f AS (SELECT coalesce(source, 'null') || '/' || coalesce(lang, 'null') || '/' || coalesce(doc_id::VARCHAR, 'null') || '.txt' AS path, strlen(text) AS size, doc_id, text FROM documents WHERE text IS NOT NULL)"
LINES = (
    FILES
    + r""", p AS (SELECT path, size, CASE WHEN ends_with(text, chr(10)) OR text = '' THEN list_slice(string_split(text, chr(10)), 1, -2) ELSE string_split(text, chr(10)) END AS parts FROM f),
l AS (SELECT path, size, unnest(generate_series(1, len(parts)))::INT AS line, unnest(parts) AS text FROM p)"""
)


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.spread(C.document_files(C.table(spark, sf_dir, "documents")))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.source_files(C.spread(C.table(spark, sf_dir, "documents").select("doc_id", "text")))


def grep_sql(test: str, before: str, where: str = "true") -> str:
    """Matching lines; ``before`` is the text of a line before its first match."""
    return f"WITH {LINES} SELECT path, line, text, strlen({before})::INT AS col, strlen(text)::INT AS line_len FROM l WHERE {where} AND {test}"


def literal_sql(literal: str, where: str = "true") -> str:
    return grep_sql(f"contains(text, '{literal}')", f"substr(text, 1, strpos(text, '{literal}') - 1)", where)


def regex_sql(pattern: str, where: str = "true", nocase: bool = False) -> str:
    flag = "(?i)" if nocase else ""
    return grep_sql(f"regexp_matches(text, '{flag}{pattern}')", f"regexp_extract(text, '(?s)^(.*?){'(?i:' if nocase else '(?:'}{pattern})', 1)", where)


# plain search


@query("grep_literal", literal_sql("thand"))
def _(spark, sf_dir):
    """A literal."""
    return S.search(docs(spark, sf_dir), "thand")


@query("grep_fixed_meta", literal_sql("the***"))
def _(spark, sf_dir):
    """a fixed string of metacharacters."""
    return S.search(docs(spark, sf_dir), "the***", fixed=True)


REGEX = r"\b[Tt]h\w+ing\b[,.]"


@query("grep_regex", regex_sql(REGEX))
def _(spark, sf_dir):
    """A regular expression."""
    return S.search(docs(spark, sf_dir), REGEX)


@query("grep_anchor_line", regex_sql(r"^[ÀÈÉ]\w*.*[[:alpha:]]\.$"))
def _(spark, sf_dir):
    """anchors and a class, per line."""
    return S.search(docs(spark, sf_dir), r"^[ÀÈÉ]\w*.*[[:alpha:]]\.$")


@query("grep_word_edge", regex_sql(r"\ber\b"))
def _(spark, sf_dir):
    """word edges are ASCII, also next to é."""
    return S.search(docs(spark, sf_dir), r"\ber\b")


@query(
    "grep_nocase_ascii",
    grep_sql(f"contains(translate(text, '{T.UPPER}', '{T.LOWER}'), 'license')", f"substr(text, 1, strpos(translate(text, '{T.UPPER}', '{T.LOWER}'), 'license') - 1)"),
)
def _(spark, sf_dir):
    """A literal without case."""
    return S.search(docs(spark, sf_dir), "LICENSE", nocase=True)


@query("grep_nocase_unicode", regex_sql("ÈAUX", nocase=True))
def _(spark, sf_dir):
    """Without case beyond ASCII."""
    return S.search(docs(spark, sf_dir), "ÈAUX", nocase=True)


@query("grep_multiline", f"WITH {FILES} SELECT path, len(regexp_extract_all(text, '\\.\\n[A-Z][a-z]+\\.\\n'))::BIGINT AS count FROM f WHERE regexp_matches(text, '\\.\\n[A-Z][a-z]+\\.\\n')")
def _(spark, sf_dir):
    """Matches that span lines, counted per file."""
    return S.search(docs(spark, sf_dir), r"\.\n[A-Z][a-z]+\.\n", mode="occurrences", scope="file")


@query("grep_multiline_files", f"WITH {FILES} SELECT path FROM f WHERE regexp_matches(text, '\\A[A-Z][a-z]+\\.\\n')")
def _(spark, sf_dir):
    """Anchors hold for the whole file."""
    return S.search(docs(spark, sf_dir), r"^[A-Z][a-z]+\.\n", mode="files", scope="file")


@query(
    "grep_file_scope_rows",
    f"WITH {LINES} SELECT path, line, text, strlen(regexp_extract(text, '(?s)^(.*?)(?:reed)', 1))::INT AS col, strlen(text)::INT AS line_len FROM l WHERE regexp_matches(text, 're{{1}}ed')",
)
def _(spark, sf_dir):
    """Rows of a whole-file match that stays in a line equal those of a line match."""
    return S.search(docs(spark, sf_dir), "re{1}ed", scope="file")


@query("files_with_matches", f"WITH {LINES} SELECT DISTINCT path FROM l WHERE regexp_matches(text, 'was [a-z]+ing')")
def _(spark, sf_dir):
    """Files only; lines are not exploded."""
    return S.search(docs(spark, sf_dir), "was [a-z]+ing", mode="files")


@query("files_without_literal_prune", f"WITH {LINES} SELECT DISTINCT path FROM l WHERE regexp_matches(text, 'thwas|anding|x?ou,$')")
def _(spark, sf_dir):
    """an alternation has no required literal, so nothing is pruned."""
    return S.search(docs(spark, sf_dir), "thwas|anding|x?ou,$", mode="files")


@query("count_lines", f"WITH {LINES} SELECT path, count(*) AS count FROM l WHERE contains(text, 'the') GROUP BY path")
def _(spark, sf_dir):
    """Matching lines per file."""
    return S.search(docs(spark, sf_dir), "the", mode="count")


@query("count_occurrences", f"WITH {LINES} SELECT path, sum(len(regexp_extract_all(text, '[aeiou]{{3,}}')))::BIGINT AS count FROM l WHERE regexp_matches(text, '[aeiou]{{3,}}') GROUP BY path")
def _(spark, sf_dir):
    """A2: matches per file without overlap."""
    return S.search(docs(spark, sf_dir), "[aeiou]{3,}", mode="occurrences")


@query("count_occurrences_literal", f"WITH {FILES} SELECT path, ((strlen(text) - strlen(replace(text, 'thth', ''))) // 4)::BIGINT AS count FROM f WHERE contains(text, 'thth')")
def _(spark, sf_dir):
    """A literal's occurrences."""
    return S.search(docs(spark, sf_dir), "thth", mode="occurrences")


@query("limit_topk", literal_sql("ing") + " ORDER BY path, line LIMIT 100")
def _(spark, sf_dir):
    """The first of the total order."""
    return S.search(docs(spark, sf_dir), "ing", limit=100)


@query("truncated_summary", f"WITH {LINES}, m AS (SELECT path FROM l WHERE contains(text, 'ing') ORDER BY path, line LIMIT 100) SELECT count(*) AS matches, count(DISTINCT path) AS file_hits, (SELECT count(*) FROM l WHERE contains(text, 'ing')) > 100 AS truncated FROM m")
def _(spark, sf_dir):
    """A4 O3: what a limited search reports at its end."""
    return S.done(S.search(docs(spark, sf_dir), "ing"), 100)


@query("done_summary", f"WITH {LINES} SELECT count(*) AS matches, count(DISTINCT path) AS file_hits, false AS truncated FROM l WHERE contains(text, 'ing')")
def _(spark, sf_dir):
    """A4: the same without a limit."""
    return S.done(S.search(docs(spark, sf_dir), "ing"))


@query("match_columns", regex_sql("[é][[:alpha:]]+ée"))
def _(spark, sf_dir):
    """C4 D3: columns are byte offsets."""
    return S.search(docs(spark, sf_dir), "[é][[:alpha:]]+ée")


def _window_sql(width: int) -> str:
    at = "length(substr(text, 1, strpos(text, 'license') - 1))"
    start = f"greatest(0, least(greatest(0, {at} - {width // 2}), length(text) - {width}))"
    cut = f"(CASE WHEN {start} > 0 THEN '…' ELSE '' END) || substr(text, ({start} + 1)::BIGINT, {width}) || (CASE WHEN {start} + {width} < length(text) THEN '…' ELSE '' END)"
    return (
        f"WITH {LINES} SELECT path, line, CASE WHEN strlen(text) > {width} AND length(text) > {width} THEN {cut} ELSE text END AS text, "
        f"strlen(substr(text, 1, strpos(text, 'license') - 1))::INT AS col, strlen(text)::INT AS line_len FROM l WHERE contains(text, 'license')"
    )


@query("max_columns_window", _window_sql(40))
def _(spark, sf_dir):
    """Long lines are shown around their first match."""
    return S.search(docs(spark, sf_dir), "license", max_columns=40)


@query("location_only", f"WITH {LINES} SELECT path, line, CASE WHEN strlen(text) > 200 THEN '' ELSE text END AS text, strlen(substr(text, 1, strpos(text, 'thand') - 1))::INT AS col, strlen(text)::INT AS line_len FROM l WHERE contains(text, 'thand')")
def _(spark, sf_dir):
    """Long lines give only their place."""
    return S.search(docs(spark, sf_dir), "thand", max_columns=200, location_only=True)


@query("line_lookup", f"WITH {FILES} SELECT path, coalesce(string_split(text, chr(10))[3], '') AS text FROM f")
def _(spark, sf_dir):
    """A line by number."""
    return docs(spark, sf_dir).select("path", T.line_of(F.col("text"), F.lit(3)).alias("text"))


@query("search_pages", "WITH p AS (SELECT 'pages/' || page_id || '.html' AS path, unnest(generate_series(1, len(string_split(html, chr(10)))))::INT AS line, unnest(string_split(html, chr(10))) AS text FROM pages) SELECT path, line, text, strlen(substr(text, 1, strpos(text, '<title>') - 1))::INT AS col, strlen(text)::INT AS line_len FROM p WHERE contains(text, '<title>')")
def _(spark, sf_dir):
    """over another corpus."""
    return S.search(C.page_files(C.table(spark, sf_dir, "pages")), "<title>")


@query("search_chats", "SELECT 'conv/' || conv_id || '/' || turn || '.' || role AS path FROM conversations WHERE role = 'system' AND regexp_matches(text, '[Tt]he')")
def _(spark, sf_dir):
    """Files of a deep tree, by extension."""
    return S.search(C.conversation_files(C.table(spark, sf_dir, "conversations")), "[Tt]he", mode="files", globs=["*.system"])


# path filters

GLOBS = ["src1/[de]?/*.txt", "99?.txt"]


@query("glob_filter", literal_sql("nd", f"(regexp_matches(path, '{paths.any_of(map(paths.glob_regex, GLOBS))}') OR regexp_matches(string_split(path, '/')[-1], '{paths.any_of(map(paths.glob_regex, GLOBS))}'))"))
def _(spark, sf_dir):
    """globs on the path or the last segment."""
    return S.search(docs(spark, sf_dir), "nd", globs=GLOBS)


def _any(globs: list[str]) -> str:
    pattern = paths.any_of(map(paths.include_regex, globs))
    return f"(regexp_matches(path, '{pattern}') OR regexp_matches(string_split(path, '/')[-1], '{pattern}'))"


@query("exclude_include", literal_sql("nd", f"(NOT {_any(['src1/*', '*7.txt'])} OR {_any(['src1/fr/*'])})"))
def _(spark, sf_dir):
    """What is included is not excluded."""
    return S.search(docs(spark, sf_dir), "nd", exclude=["src1/*", "*7.txt"], include=["src1/fr/*"])


HIDE = "CASE WHEN doc_id % 3 = 0 THEN '.cache/' || path WHEN doc_id % 3 = 1 THEN 'a/.b/' || path ELSE path END"


@query("hidden_filter", f"WITH {FILES}, h AS (SELECT {HIDE} AS path, text FROM f) SELECT path FROM h WHERE NOT regexp_matches(path, '(^|/)\\.') AND contains(text, 'the')")
def _(spark, sf_dir):
    """hidden files are left out."""
    d = C.table(spark, sf_dir, "documents").select("doc_id", "text", C.document_path().alias("path"), F.octet_length("text").cast("long").alias("size"))
    return S.search(d.select(F.expr(HIDE).alias("path"), "size", "text"), "the", mode="files")


@query("subtree", f"WITH {FILES} SELECT substr(path, 9) AS path, count(*) AS count FROM (SELECT path, unnest(string_split(text, chr(10))) AS text FROM f WHERE starts_with(path, 'src3/en/')) WHERE contains(text, 'the') GROUP BY ALL")
def _(spark, sf_dir):
    """Below a folder, with paths relative to it."""
    return S.search(docs(spark, sf_dir), "the", mode="count", subtree="src3/en")


@query("max_filesize", literal_sql("the", "size <= 1024"))
def _(spark, sf_dir):
    """Small files only."""
    return S.search(docs(spark, sf_dir), "the", max_filesize="1K")


RULES = ["src2/", "*5.txt", "/src3/en", "**/de/1*.txt", "!src2/", "# none"]


@query("ignore_rules", f"WITH {FILES} SELECT path FROM f WHERE contains(text, 'nd') AND NOT regexp_matches(path, '{paths.ignore_regex(RULES)}')")
def _(spark, sf_dir):
    """Ignore rules as one expression."""
    return S.search(docs(spark, sf_dir), "nd", mode="files", gitignore=RULES)


NESTED = [("src1", "en/"), ("src1/fr", "*2.txt"), ("", "*9.txt")]


@query("gitignore_tree", f"WITH {FILES} SELECT path FROM f WHERE contains(text, 'nd') AND NOT (starts_with(path, 'src1/') AND contains(path, '/en/')) AND NOT (starts_with(path, 'src1/fr/') AND ends_with(path, '2.txt')) AND NOT ends_with(path, '9.txt')")
def _(spark, sf_dir):
    """rules of nested ignore files hold below their folder."""
    return S.search(docs(spark, sf_dir), "nd", mode="files", gitignore=NESTED)


#: What the ignore files of the query hold, besides those of each source and language.
IGNORE_FILES = [(".gitignore", "src2/\n"), ("src3/.gitignore", " en/ \n# fr/\n!fr/\n/fr/1*\n")]


@query(
    "gitignore_loaded",
    f"""WITH {FILES}, p AS (SELECT path, string_split(path, '/') AS part FROM f WHERE contains(text, 'nd'))
SELECT path FROM p WHERE part[1] = 'src2' AND part[2] = 'fr' OR NOT (part[1] = 'src2' OR part[1] = 'src3' AND (part[2] = 'en' OR part[2] = 'fr' AND starts_with(part[3], '1'))
  OR ends_with(part[3], (strlen(part[1]) % 10) || '.txt'))""",
)
def _(spark, sf_dir):
    """Rules read from the ignore files of the corpus, and what is included in spite of them."""
    d = docs(spark, sf_dir)
    folder = F.regexp_extract("path", "^(.*)/", 1)
    own = d.select(folder.alias("folder")).distinct().select(F.concat("folder", F.lit("/.gitignore")).alias("path"), F.concat(F.lit("\n*"), F.length(F.substring_index("folder", "/", 1)) % 10, F.lit(".txt\n")).alias("text"))
    rules = own.unionByName(spark.createDataFrame(IGNORE_FILES, "path string, text string")).select("path", F.octet_length("text").cast("long").alias("size"), "text")
    return S.search(d.unionByName(rules), "nd", mode="files", gitignore=True, include=["src2/fr/*"])


#: Rules, each with an SQL test of its own.
RULE_CASES = {
    "build/": "starts_with(path, 'build/') OR contains(path, '/build/')",
    "/build": "starts_with(path, 'build/')",
    "*7.txt": "ends_with(path, '7.txt')",
    "src?/**": "path[1:3] = 'src' AND path[4] <> '/' AND path[5] = '/'",
    "x/*/src1": "starts_with(path, 'x/build/src1/')",
    "**/en": "contains('/' || path, '/en/')",
    "[0-9].txt": "false",
    "# build/": "false",
    "!build/": "false",
    "/": "false",
}
PLACED = "CASE doc_id % 5 WHEN 0 THEN 'build/' WHEN 1 THEN 'x/build/' WHEN 2 THEN '.git/' WHEN 3 THEN 'x/.git/y/' ELSE '' END || path"


@query(
    "ignore_cases",
    f"WITH {FILES}, x AS (SELECT {PLACED} AS path FROM f) "
    + " UNION ALL ".join(f"SELECT '{rule}' AS rule, path, starts_with(path, '.git/') OR contains(path, '/.git/') OR ({test}) AS ignored FROM x" for rule, test in RULE_CASES.items()),
)
def _(spark, sf_dir):
    """Single rules on every path."""
    d = docs(spark, sf_dir).select("path", F.substring_index(F.substring_index("path", "/", -1), ".", 1).cast("long").alias("doc_id"))
    path = F.expr(PLACED)
    return d.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), path.alias("path"), paths.ignored(path, [r]).alias("ignored")) for r in RULE_CASES])))


@query("language_of_path", f"WITH {FILES}, x AS (SELECT path || CASE doc_id % 6 WHEN 0 THEN '.go' WHEN 1 THEN '.JAVA' WHEN 2 THEN '.py' WHEN 3 THEN '.tsx' WHEN 4 THEN '.mjs' ELSE '' END AS path, doc_id FROM f) SELECT path, CASE doc_id % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'java' WHEN 2 THEN 'python' WHEN 3 THEN 'typescript' WHEN 4 THEN 'typescript' ELSE '' END AS lang FROM x")
def _(spark, sf_dir):
    """Languages by extension."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".go", ".JAVA", ".py", ".tsx", ".mjs", "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    d = C.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(C.document_path(), ext).alias("path"))
    return d.select("path", T.language_of(F.col("path")).alias("lang"))


@query("root_hash", "SELECT 'src' || doc_id AS root, substr(sha256('src' || doc_id || CASE WHEN doc_id % 2 = 0 THEN chr(0) || 'follow' ELSE '' END), 1, 16) AS hash FROM documents")
def _(spark, sf_dir):
    """The name of a root's index."""
    d = C.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src"), "doc_id").alias("root"))
    return d.select("root", T.root_hash(F.col("root"), F.col("doc_id") % 2 == 0).alias("hash"))


# ingest


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files with contents: some with a NUL in front, some unreadable."""
    d = C.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    content = F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("\0").cast("binary"), F.col("text").cast("binary"))).when(F.col("doc_id") % 50 == 9, F.lit(None).cast("binary")).otherwise(F.col("text").cast("binary"))
    return d.select(C.document_path().alias("path"), F.octet_length("text").cast("long").alias("size"), content.alias("content"))


ROUTED = f"""WITH {FILES}, s AS (SELECT path, size, doc_id, size > 1048576 AS large, sum(CASE WHEN size > 1048576 THEN 0 ELSE size END) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) > 1048576 AS over FROM f),
r AS (SELECT path, size, CASE WHEN doc_id % 50 = 9 THEN 'error' WHEN large THEN 'large' WHEN doc_id % 50 = 7 THEN 'binary' WHEN over THEN 'budget' ELSE 'indexed' END AS route FROM s) """
CONF = EngineConf(max_filesize_mb=1, max_index_mb=1)


@query("route_files", ROUTED + "SELECT path, size, route FROM r")
def _(spark, sf_dir):
    """Where each file goes."""
    return C.route(raw(spark, sf_dir), CONF).select("path", "size", "route")


@query("skip_counters", ROUTED + "SELECT count(*) FILTER (route = 'indexed') AS files, coalesce(sum(size) FILTER (route = 'indexed'), 0)::BIGINT AS bytes, count(*) FILTER (route = 'large') AS large, count(*) FILTER (route = 'budget') AS budget, count(*) FILTER (route = 'binary') AS binary, count(*) FILTER (route = 'error') AS errors, count(*) FILTER (route IN ('large', 'budget', 'binary')) AS stream FROM r")
def _(spark, sf_dir):
    """A5 M1: status of a root."""
    return C.status(C.route(raw(spark, sf_dir), CONF))


@query("stream_set", ROUTED + "SELECT path, size FROM r WHERE route IN ('large', 'budget') AND size <= 4096")
def _(spark, sf_dir):
    """Files that are searched without the index."""
    routed = C.route(raw(spark, sf_dir), CONF)
    return routed.where("route IN ('large', 'budget')").where("size <= 4096").select("path", "size").orderBy("path")


@query("utf16_decode", f"WITH {FILES} SELECT path, CASE WHEN doc_id % 5 <> 4 THEN text END AS text, CASE WHEN doc_id % 5 = 4 THEN 'binary' ELSE 'indexed' END AS route FROM f")
def _(spark, sf_dir):
    """Byte order marks, an odd last byte, and NULs."""
    mark = lambda m, code, tail="": F.expr(f"concat(X'{m}', encode(text, '{code}'), X'{tail}')")
    k = F.col("doc_id") % 5
    content = F.when(k == 0, mark("FFFE", "UTF-16LE")).when(k == 1, mark("FEFF", "UTF-16BE")).when(k == 2, mark("FFFE", "UTF-16LE", "21")).when(k == 3, F.col("text").cast("binary"))
    d = C.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    files = d.select(C.document_path().alias("path"), F.octet_length("text").cast("long").alias("size"), content.otherwise(F.expr("concat(X'FFFE0000', encode(text, 'UTF-16LE'))")).alias("content"))
    routed = C.route(files, EngineConf(max_index_mb=0))
    return routed.select("path", F.when(F.col("route") == "indexed", F.col("text")).alias("text"), "route")


# index


@query("trigram_candidates", f"WITH {FILES}, x AS (SELECT path, translate(text, '{T.UPPER}', '{T.LOWER}') AS t FROM f) SELECT path FROM x WHERE contains(t, 'tha') AND contains(t, 'han') AND contains(t, 'and') AND contains(t, 'nde')")
def _(spark, sf_dir):
    """Files that hold all trigrams of a literal."""
    keys = [int(k) for k in I.trigram_keys(b"Thande")]
    return I.candidates(I.postings(docs(spark, sf_dir)), keys)


@query("trigram_postings", f"""WITH {FILES}, h AS (SELECT path, hex(encode(translate(text, '{T.UPPER}', '{T.LOWER}'))) AS h FROM f),
t AS (SELECT path, unnest(list_distinct(list_transform(range(0, strlen(h) // 2 - 2), lambda i: substr(h, 2 * i + 1, 6)))) AS t FROM h)
SELECT ('0x' || t)::INT AS tri, count(*) AS files FROM t GROUP BY t""")
def _(spark, sf_dir):
    """Files per trigram."""
    return I.postings(docs(spark, sf_dir)).groupBy("tri").agg(F.count("*").alias("files"))


@query("index_equals_scan", regex_sql("th(and|ere)[a-z]+, "))
def _(spark, sf_dir):
    """A search through postings finds what a scan finds."""
    d = docs(spark, sf_dir)
    return I.indexed_search(d, I.postings(d), "th(and|ere)[a-z]+, ")


#: Indexes that this process has built: by session and tables.
BUILT: dict[tuple[str, str], I.Index] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> I.Index:
    """The index of the documents and the source files made from them, in the shared folder; built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in BUILT or not BUILT[key].exists():
        index = I.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
        index.build(docs(spark, sf_dir).unionByName(sources(spark, sf_dir)).withColumn("mtime_ns", F.lit(1).cast("long")), target=4 << 20, least=2 << 20)
        BUILT[key] = index
    return BUILT[key]


@query("index_search_warm", literal_sql("thand"))
def _(spark, sf_dir):
    """A selective literal through a stored index."""
    return stored_index(spark, sf_dir).search("thand", globs=["*.txt"])


@query("index_search_broad", f"WITH {LINES} SELECT path, count(*) AS count FROM l WHERE contains(translate(text, '{T.UPPER}', '{T.LOWER}'), 'the') GROUP BY path")
def _(spark, sf_dir):
    """A broad literal through a stored index."""
    return stored_index(spark, sf_dir).search("THE", nocase=True, mode="count", globs=["*.txt"])


@query("index_defs", G.defs_sql("name = 'seats'"))
def _(spark, sf_dir):
    """Definitions that the index has stored."""
    return Y.find_definitions(stored_index(spark, sf_dir).definitions(), "seats")


@query("index_refs", G.refs_sql())
def _(spark, sf_dir):
    """Uses of a name in the files that hold its trigrams, by a stored index."""
    return stored_index(spark, sf_dir).references("ring", globs=[f"*{G.USES.ext}"])


@query("refs_limit", G.refs_sql() + " ORDER BY path, line LIMIT 7")
def _(spark, sf_dir):
    """The first uses only."""
    return Y.find_references(sources(spark, sf_dir).where(F.col("path").endswith(G.USES.ext)), "ring").limit(7)


@query(
    "index_then_stream",
    f"WITH {LINES}, m AS (SELECT path, line, text, size > 4096 AS late FROM l WHERE contains(text, 'thand')) SELECT path, line, text FROM m ORDER BY late, path, line LIMIT 9",
)
def _(spark, sf_dir):
    """Results of indexed files come first, then those of files that are read without the index; the limit is over both."""
    d = docs(spark, sf_dir)
    small = d.where("size <= 4096")
    return S.united(I.indexed_search(small, I.postings(small), "thand"), S.search(d.where("size > 4096"), "thand"), 9).select("path", "line", "text")


@query(
    "index_compact_reconcile",
    f"WITH {FILES} SELECT path, CASE doc_id % 10 WHEN 3 THEN 'unchanged' WHEN 5 THEN 'deleted' WHEN 7 THEN 'changed' ELSE 'unchanged' END AS change FROM f WHERE doc_id % 10 <> 9",
)
def _(spark, sf_dir):
    """After changes are written into an index, only later ones differ from it."""
    d = C.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(C.document_path().alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit(1).cast("long").alias("mtime_ns"), "text", (F.col("doc_id") % 10).alias("k"))
    index = I.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.build(d.drop("k"), target=TARGET, least=LEAST)
    change = d.where("k IN (3, 9)").select("path", (F.col("k") == 9).alias("deleted"), F.lit(1).cast("long").alias("seq"), (F.col("size") + 1).alias("size"), F.lit(2).cast("long").alias("mtime_ns"), F.concat("text", F.lit("!")).alias("text"))
    index.compact(change, threshold=1)
    k = F.col("k")
    now = d.where("k NOT IN (5, 9)").select("path", F.when(k == 3, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(k == 3, 2).when(k == 7, 3).otherwise(1).cast("long").alias("mtime_ns"))
    return D.reconcile(index.table("files").select("path", "size", "mtime_ns"), now)


TARGET, LEAST = 100_000, 60_000
SHARDS = f"""WITH RECURSIVE {FILES}, o AS (SELECT path, size, row_number() OVER (ORDER BY path) AS k FROM f),
g AS (SELECT k, path, size, 0 AS shard, size AS filled FROM o WHERE k = 1
  UNION ALL SELECT o.k, o.path, o.size, CASE WHEN g.filled >= {TARGET} THEN g.shard + 1 ELSE g.shard END, CASE WHEN g.filled >= {TARGET} THEN o.size ELSE g.filled + o.size END FROM g JOIN o ON o.k = g.k + 1),
b AS (SELECT shard, sum(size) AS bytes FROM g GROUP BY shard),
s AS (SELECT path, size, (CASE WHEN shard > 0 AND shard = (SELECT max(shard) FROM b) AND (SELECT bytes FROM b ORDER BY shard DESC LIMIT 1) < {LEAST} THEN shard - 1 ELSE shard END)::INT AS shard FROM g),
m AS (SELECT shard, min(path) AS path_min, max(path) AS path_max, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM s GROUP BY shard) """


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.packed(docs(spark, sf_dir), TARGET, LEAST, apart=0)


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).join(packed(spark, sf_dir).select("path", "shard"), "path")


@query("shard_packing", SHARDS + "SELECT path, shard FROM s")
def _(spark, sf_dir):
    """Files packed into shards in path order."""
    return packed(spark, sf_dir).select("path", "shard")


@query("shard_manifest", SHARDS + "SELECT * FROM m")
def _(spark, sf_dir):
    """Path ranges and sizes of shards."""
    return I.manifest(packed(spark, sf_dir))


@query("shard_skip", SHARDS + f", x AS (SELECT shard, translate(text, '{T.UPPER}', '{T.LOWER}') AS t FROM s JOIN f USING (path)) SELECT shard FROM x GROUP BY shard HAVING bool_or(contains(t, 'ice')) AND bool_or(contains(t, 'cen')) AND bool_or(contains(t, 'ens')) AND bool_or(contains(t, 'nse'))")
def _(spark, sf_dir):
    """Shards that lack a trigram are skipped."""
    return I.shards_with(I.postings(sharded(spark, sf_dir), "shard"), [int(k) for k in I.trigram_keys(b"icense")])


@query("path_to_shard", SHARDS + "SELECT 'src' || (doc_id % 25) || '/en/' || doc_id || '.md' AS path, coalesce(shard, -1)::INT AS shard FROM documents LEFT JOIN m ON 'src' || (doc_id % 25) || '/en/' || doc_id || '.md' BETWEEN path_min AND path_max")
def _(spark, sf_dir):
    """The shard whose range holds a path."""
    p = C.table(spark, sf_dir, "documents").select(F.concat(F.lit("src"), F.col("doc_id") % 25, F.lit("/en/"), "doc_id", F.lit(".md")).alias("path"))
    return I.shard_of(p, I.manifest(packed(spark, sf_dir)))


# changes


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document changed twice, the last time deleted for some."""
    d = C.table(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id % 10 = 3")
    path = C.document_path().alias("path")
    one = d.select(path, F.lit(False).alias("deleted"), F.lit(1).cast("long").alias("seq"), F.lit(5).cast("long").alias("size"), F.lit("stale").alias("text"))
    gone = F.col("doc_id") % 20 == 3
    text = F.when(~gone, F.concat(F.lit("class Fresh\n"), "text"))
    return one.unionByName(d.select(path, gone.alias("deleted"), F.lit(2).cast("long").alias("seq"), F.octet_length(text).cast("long").alias("size"), text.alias("text")))


NOW = FILES + ", n AS (SELECT path, CASE WHEN doc_id % 10 = 3 THEN 'class Fresh' || chr(10) || text ELSE text END AS text FROM f WHERE doc_id % 20 <> 3)"


@query("delta_overlay_search", f"WITH {NOW} SELECT path FROM n WHERE contains(text, 'Fresh') OR contains(text, 'stale')")
def _(spark, sf_dir):
    """The newest version of each file is searched, deleted ones are not."""
    return S.search(D.overlay(docs(spark, sf_dir), changes(spark, sf_dir)), "Fresh|stale", mode="files")


@query("delta_counts", f"WITH {NOW} SELECT path, count(*) AS count FROM (SELECT path, unnest(string_split(text, chr(10))) AS text FROM n) WHERE contains(text, 'the') GROUP BY path")
def _(spark, sf_dir):
    """Counts over the overlay."""
    return S.search(D.overlay(docs(spark, sf_dir), changes(spark, sf_dir)), "the", mode="count")


@query("prefix_delete", f"WITH {FILES} SELECT path FROM f WHERE NOT starts_with(path, 'src1/en/') AND path <> 'src1/en'")
def _(spark, sf_dir):
    """T5: a folder's files go."""
    d = docs(spark, sf_dir)
    return D.overlay(d, D.delete_prefix(d, "src1/en", 3)).select("path")


@query("reconcile_diff", f"WITH {FILES} SELECT path, CASE doc_id % 7 WHEN 1 THEN 'new' WHEN 2 THEN 'deleted' WHEN 3 THEN 'changed' WHEN 4 THEN 'changed' ELSE 'unchanged' END AS change FROM f")
def _(spark, sf_dir):
    """Listing against index."""
    d = C.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    path, k = C.document_path().alias("path"), F.col("doc_id") % 7
    size = F.octet_length("text").cast("long")
    was = d.where(k != 1).select(path, size.alias("size"), F.lit(0).cast("long").alias("mtime_ns"))
    now = d.where(k != 2).select(path, F.when(k == 3, size + 1).otherwise(size).alias("size"), F.when(k == 4, 1).otherwise(0).cast("long").alias("mtime_ns"))
    return D.reconcile(was, now)


@query("dirty_shards", SHARDS + ", d AS (SELECT shard FROM s JOIN f USING (path) WHERE doc_id % 10 = 3) SELECT shard, count(*) AS dirty FROM d GROUP BY shard HAVING count(*) >= 5 OR (SELECT count(*) FROM d) <= 5")
def _(spark, sf_dir):
    """Shards with enough changes to be rewritten."""
    return D.dirty_shards(packed(spark, sf_dir), changes(spark, sf_dir), 5)


@query("debounce_batches", """WITH e AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM events),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, before NULLS FIRST ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT event_type, min(ts) AS batch_start, count(*) AS n FROM b GROUP BY event_type, k""")
def _(spark, sf_dir):
    """Bursts of changes, a pause ends one."""
    return H.bursts(C.table(spark, sf_dir, "events"), "10 minutes", "event_type")


@query("latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def _(spark, sf_dir):
    """The last change of each key."""
    return H.latest_state(C.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query(
    "nested_roots",
    f"WITH {FILES} SELECT path, CASE WHEN starts_with(path, 'src1/en/') THEN 'src1/en' WHEN starts_with(path, 'src1/') THEN 'src1' WHEN starts_with(path, 'src2/') THEN 'src2' END AS root FROM f",
)
def _(spark, sf_dir):
    """The innermost root that covers a path; src1 covers nothing of src10."""
    roots = spark.createDataFrame([("src1",), ("src1/en",), ("src2",), ("src",), ("src3/en/x",)], "root string")
    return D.containing_root(docs(spark, sf_dir).select("path"), roots)


# symbols

for _lang, _template in (("go", G.GO), ("java", G.JAVA), ("python", G.PYTHON), ("ts", G.TS)):

    @query(f"extract_{_lang}", G.defs_sql(templates=(_template,)))
    def _(spark, sf_dir, e=_template.ext):
        """Definitions of one language, with their source lines."""
        return Y.definitions(sources(spark, sf_dir).where(F.col("path").endswith(e)))


@query("defs_exact", G.defs_sql("name = 'seats'"))
def _(spark, sf_dir):
    """Definitions of a name."""
    return Y.find_definitions(Y.definitions(sources(spark, sf_dir)), "seats")


@query("defs_fold", G.defs_sql("lower(name) = 'till11'"))
def _(spark, sf_dir):
    """Without case."""
    return Y.find_definitions(Y.definitions(sources(spark, sf_dir)), "tiLL11", nocase=True)


@query("file_outline", G.defs_sql("path = 'src/13.ts'"))
def _(spark, sf_dir):
    """All definitions in a file."""
    return Y.outline(sources(spark, sf_dir), "src/13.ts")


@query("delta_defs", f"{G.defs_sql('doc_id % 15 <> 0', (G.GO,))} UNION ALL SELECT 'src/' || doc_id || '.go' AS path, 'Renewed' AS name, 'func' AS kind, '' AS container, 2 AS line, 'func Renewed() {{}}' AS text FROM documents WHERE text IS NOT NULL AND doc_id % 30 = 15")
def _(spark, sf_dir):
    """Definitions in a changed file are the new ones, in a deleted one there are none."""
    files = sources(spark, sf_dir).where(F.col("path").endswith(".go"))
    number = F.regexp_extract("path", r"(\d+)\.go$", 1).cast("long")
    gone = number % 30 == 0
    text = F.when(~gone, F.lit("package p\nfunc Renewed() {}\n"))
    change = files.where(number % 15 == 0).select("path", gone.alias("deleted"), F.lit(1).cast("long").alias("seq"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))
    return Y.definitions(D.overlay(files, change))


@query("refs_call_vs_ref", G.refs_sql())
def _(spark, sf_dir):
    """Uses of a name outside its definition, comments and strings."""
    return Y.find_references(sources(spark, sf_dir), "ring")


@query("refs_track", "WITH p AS (SELECT 'pages/' || page_id || '.html' AS path, unnest(generate_series(1, len(string_split(html, chr(10)))))::INT AS line, unnest(string_split(html, chr(10))) AS text FROM pages) SELECT path, 'track' AS name, CASE WHEN ends_with(regexp_extract(text, '(?:^|\\W)track(\\s*\\(|\\W|$)', 1), '(') THEN 'call' ELSE 'ref' END AS kind, line, trim(text) AS text FROM p WHERE regexp_matches(text, '\\btrack\\b')")
def _(spark, sf_dir):
    """Calls in every page."""
    return Y.find_references(C.page_files(C.table(spark, sf_dir, "pages")), "track")


# sinks


@query("text_sink", f"WITH {LINES} SELECT 'x/' || path || ':' || line || ':' || text AS value FROM l WHERE contains(text, 'thand')")
def _(spark, sf_dir):
    """Lines for a text sink."""
    return S.as_text(S.search(docs(spark, sf_dir), "thand"), "x/")


@query(
    "json_sink",
    f"""WITH {LINES}, m AS (SELECT path, line, text, strlen(substr(text, 1, strpos(text, 'thand') - 1))::INT AS col, strlen(text)::INT AS line_len FROM l WHERE contains(text, 'thand')),
s AS (SELECT * FROM m ORDER BY path, line LIMIT 5)
SELECT to_json({{'type': 'match', 'path': path, 'line': line, 'text': text, 'col': col, 'line_len': line_len}})::VARCHAR AS value FROM s
UNION ALL SELECT to_json({{'type': 'done', 'matches': (SELECT count(*) FROM s), 'file_hits': (SELECT count(DISTINCT path) FROM s), 'truncated': (SELECT count(*) FROM m) > 5}})::VARCHAR AS value""",
)
def _(spark, sf_dir):
    """One JSON object per match, and the one that ends a search."""
    return S.as_events(S.search(docs(spark, sf_dir), "thand"), 5)


@query("all_lines_stats", f"WITH {LINES} SELECT path, count(*) AS n, max(strlen(text))::INT AS longest FROM l GROUP BY path")
def _(spark, sf_dir):
    """Line numbering and the model of lines."""
    return lines(docs(spark, sf_dir)).groupBy("path").agg(F.max("line").cast("long").alias("n"), F.max(F.octet_length("text")).alias("longest"))

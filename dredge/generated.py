"""Source files made from the documents table, for the symbol queries, with the definitions that each must give.

A document becomes one file of a language that its id chooses: a template with the id in its names and the
document's text in a comment, so line numbers behind the comment depend on the text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Template(NamedTuple):
    ext: str
    source: str  # @K stands for the document's id, @T for its text
    #: (name, kind, container, line, whether the line is behind the text)
    defs: tuple[tuple[str, str, str, int, bool], ...]


GO = Template(
    ".go",
    """package ledger@K

type Book@K struct{ rows []int }
/* func Lost@K() {}
@T */
type (
	Shelf@K[T any] interface{ Get(i int) T }
	Page@K          = string
)

const quote = `func Hidden() {}`

func Open@K(name string) *Book@K { return nil }
func (b *Book@K) Add@K(n int) { type inner struct{}; push(n) }
func (s Sorted[T]) Len@K() int { return 0 }
""",
    (
        ("Book@K", "struct", "", 3, False),
        ("Shelf@K", "interface", "", 7, True),
        ("Page@K", "type", "", 8, True),
        ("Open@K", "func", "", 13, True),
        ("Add@K", "method", "Book@K", 14, True),
        ("Len@K", "method", "Sorted", 15, True),
    ),
)
JAVA = Template(
    ".java",
    """package x.y;
/* class Lost@K { @T */
public class Till@K<T extends Coin> extends Base {
    private String note = "void lost() {";
    public Till@K(int n) { this.n = n; }
    @Checked(by = {"a", "b"})
    protected long total@K(int[] xs) throws Oops {
        Runnable r = new Runnable() { public void run() { stop(); } };
        for (int x : xs) { if (odd(x)) { add(x); } }
        return sum(xs);
    }
    enum Coin@K { CENT(1), DIME(10) { int worth() { return 9; } }; int worth() { return 1; } }
}
interface Desk@K { void open(int n); default int seats() { return 2; } }
record Spot@K(int x, int y) { }
""",
    (
        ("Till@K", "class", "", 3, True),
        ("Till@K", "method", "Till@K", 5, True),
        ("total@K", "method", "Till@K", 7, True),
        ("run", "method", "Till@K", 8, True),
        ("Coin@K", "enum", "Till@K", 12, True),
        ("worth", "method", "Coin@K", 12, True),
        ("worth", "method", "Coin@K", 12, True),
        ("Desk@K", "interface", "", 14, True),
        ("open", "method", "Desk@K", 14, True),
        ("seats", "method", "Desk@K", 14, True),
        ("Spot@K", "record", "", 15, True),
    ),
)
PYTHON = Template(
    ".py",
    '''class Queue@K(list):
    """class Lost: pass
@T
    """
    async def seats(self):
        def later@K():
            pass
        return later@K

    class Slot@K:
        def take(self): return "def no(): pass"

def drain@K(q):  # def no(): pass
    return q
''',
    (
        ("Queue@K", "class", "", 1, False),
        ("seats", "method", "Queue@K", 5, True),
        ("later@K", "func", "seats", 6, True),
        ("Slot@K", "class", "Queue@K", 10, True),
        ("take", "method", "Slot@K", 11, True),
        ("drain@K", "func", "", 13, True),
    ),
)
TS = Template(
    ".ts",
    """export enum Tone@K { Low, High }
/* function lost() {}
@T */
export default class Radio@K<T> extends Base<T> {
  private dial: Map<string, number> = new Map()
  constructor({ low, high }: Range) { super() }
  async tune<K>(to: K): Promise<T[]> {
    if (ready(to)) { return one(to) }
    const pick@K = (x: number): string => { return `${x}` }
  }
  get seats(): number { return 1 }
}
interface Wave@K { length(): number }
type Band@K<T> = T | "function no() {}"
export function* scan@K(from: number) { yield from }
let mute@K = async x => x
""",
    (
        ("Tone@K", "enum", "", 1, False),
        ("Radio@K", "class", "", 4, True),
        ("constructor", "method", "Radio@K", 6, True),
        ("tune", "method", "Radio@K", 7, True),
        ("pick@K", "func", "", 9, True),
        ("seats", "method", "Radio@K", 11, True),
        ("Wave@K", "interface", "", 13, True),
        ("Band@K", "type", "", 14, True),
        ("scan@K", "func", "", 15, True),
        ("mute@K", "func", "", 16, True),
    ),
)
USES = Template(
    ".mjs",
    """function ring(x) {}
/* ring() @T */
function answer@K(n) {
  ring  (n)
  const again = ring; ring(2)
  const said = "ring()"
  return new ring
}
""",
    (("ring", "func", "", 1, False), ("answer@K", "func", "", 3, True)),
)
#: (kind, line) of the uses of ``ring``; all are behind the text.
USED = (("call", 4), ("ref", 5), ("call", 7))
TEMPLATES = (GO, JAVA, PYTHON, TS, USES)


def source_files(docs: DataFrame) -> DataFrame:
    """Files (path, size, text) of the documents (doc_id, text) that have a text."""
    path, source = F.lit(None).cast("string"), F.lit(None).cast("string")
    inside = F.replace(F.replace(F.replace(F.col("text"), F.lit("*/"), F.lit("* ")), F.lit('"'), F.lit("'")), F.lit("\\"), F.lit("/"))
    for k, t in enumerate(TEMPLATES):
        one = F.col("doc_id") % len(TEMPLATES) == k
        path = F.when(one, F.concat(F.lit("src/"), "doc_id", F.lit(t.ext))).otherwise(path)
        source = F.when(one, F.replace(F.replace(F.lit(t.source), F.lit("@K"), F.col("doc_id").cast("string")), F.lit("@T"), inside)).otherwise(source)
    return docs.where("text IS NOT NULL AND doc_id >= 0").select(path.alias("path"), F.octet_length(source).cast("long").alias("size"), source.alias("text"))


def defs_sql(where: str = "true", templates: tuple[Template, ...] = TEMPLATES) -> str:
    """SQL for the definitions (path, name, kind, container, line, text) in the files of the documents table."""
    text = lambda v: "'" + v.replace("'", "''") + "'"
    parts = []
    for t in templates:
        lines = t.source.split("\n")
        rows = []
        for name, kind, container, line, behind in t.defs:
            # the line's own text; the documents' text is on none of these lines
            rows.append(f"({text(name)}, {text(kind)}, {text(container)}, {line}, {behind}, {text(lines[line - 1].strip())})")
        named = ", ".join(f"replace(v.{c}, '@K', doc_id::VARCHAR) AS {c}" for c in ("name", "container", "source"))
        parts.append(
            f"SELECT 'src/' || doc_id || '{t.ext}' AS path, doc_id, kind, (line + CASE WHEN behind THEN length(text) - length(replace(text, chr(10), '')) ELSE 0 END)::INT AS line, {named} "
            f"FROM documents, (VALUES {', '.join(rows)}) v(name, kind, container, line, behind, source) WHERE text IS NOT NULL AND doc_id % {len(TEMPLATES)} = {TEMPLATES.index(t)}"
        )
    return f"SELECT path, name, kind, container, line, source AS text FROM ({' UNION ALL '.join(parts)}) WHERE {where}"


def refs_sql() -> str:
    """SQL for the uses (path, name, kind, line, text) of ``ring``."""
    lines = USES.source.split("\n")
    rows = ", ".join(f"('{kind}', {line}, '{lines[line - 1].strip()}')" for kind, line in USED)
    return (
        f"SELECT 'src/' || doc_id || '{USES.ext}' AS path, 'ring' AS name, kind, (line + length(d.text) - length(replace(d.text, chr(10), '')))::INT AS line, v.text AS text "
        f"FROM documents d, (VALUES {rows}) v(kind, line, text) WHERE d.text IS NOT NULL AND doc_id % {len(TEMPLATES)} = {TEMPLATES.index(USES)}"
    )

r"""Chat formatting: a finite-state machine over roles, a declarative template, and a loss mask.

``format_chats`` turns turns into text segments: a header, the escaped text and a footer for each turn,
each segment with its own loss flag. Joined in order, a conversation's segments are its formatted text.
``read_back`` parses formatted text again. Conversations are dealt by id and sorted by turn; rows then
stream through in Arrow batches, so a conversation of any length needs the memory of one turn.

Escaping is reversible and breaks every control string: ``\`` becomes ``\\``, ``#`` becomes ``\#`` and
``</`` becomes ``<\/``, so neither ``### `` nor ``</turn>`` can occur inside a text. In a role, ``: `` is
broken as ``:\ `` too.

Defined edge cases: null text is empty, null role is the role ``""``, a null conversation id is one
conversation of its own, null turns come first; equal turns are ordered by role and text; a breach of
the turn order is flagged (``valid``, first bad turn) and the conversation is formatted all the same;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dredge.llm.common import table

#: header and footer of a turn, the roles under the loss, and the states of the turn order: for each
#: state the roles that may follow and the state that they lead to.
TEMPLATE = {
    "header": "### {role}: ",
    "footer": "</turn>\n",
    "loss_roles": ["assistant"],
    "loss_on_footer": False,
    "start": "start",
    "moves": {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
}
SEGMENTS = "conv_id long, turn_no long, part string, text string, loss boolean, valid boolean"
HARD_CASE = r"\### Assistant: </turn> ok"
HARD_CONV = -7


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace(": ", ":\\ ")


def read_back(formatted: str, template: dict = TEMPLATE) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    before, between = template["header"].split("{role}")
    at = 0
    while at < len(formatted):
        if not formatted.startswith(before, at):
            raise ValueError(f"no turn begins at {at}")
        mid = formatted.index(between, at + len(before))
        end = formatted.index(template["footer"], mid)
        yield unescape(formatted[at + len(before) : mid]), unescape(formatted[mid + len(between) : end])
        at = end + len(template["footer"])


def format_chats(chats: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Segments of every conversation, a conversation's in order and together within a partition."""
    rows = chats.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, valid, number, begun = None, template["start"], True, 0, False
        for batch in batches:
            out = []
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for c, _, role, text in zip(*cols, strict=True):
                if not begun or c != conv:
                    conv, state, valid, number, begun = c, template["start"], True, 0, True
                state = template["moves"].get(state, {}).get(role)
                valid = valid and state is not None
                loss = role in template["loss_roles"]
                out.append((c, number, "header", template["header"].format(role=escape_role(role)), False, valid))
                out.append((c, number, "text", escape(text), loss, valid))
                out.append((c, number, "footer", template["footer"], loss and template["loss_on_footer"], valid))
                number += 1
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            names = ["conv_id", "turn_no", "part", "text", "loss", "valid"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)

    return rows.mapInArrow(segments, SEGMENTS)


def digests(segments: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation from what its formatted text and loss mask say when read back."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        conv, begun, record = None, False, []
        turns = loss = None
        n = loss_chars = chars = 0
        good = True

        def done():
            return (conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, good)

        for batch in batches:
            out = []
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for c, _, part, text, under_loss, valid in zip(*cols, strict=True):
                if not begun or c != conv:
                    if begun:
                        out.append(done())
                    conv, begun, record = c, True, []
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = loss_chars = chars = 0
                record.append(text)
                chars += len(text)
                good = valid
                if under_loss:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                if part == "footer":
                    for role, said in read_back("".join(record), template):
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    record = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(done(), kinds, strict=True)], names)

    return segments.mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one made to look like the template."""
    chats = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(HARD_CONV, t, r, HARD_CASE) for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return digests(format_chats(chats.unionByName(hard)))


def _escaped(column: str) -> str:
    return rf"replace(replace(replace({column}, '\', '\\'), '#', '\#'), '</', '<\/')"


SQL = rf"""
WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '{HARD_CASE}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE false END AS fits FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(replace({_escaped("role")}, ': ', ':\ ')) + 2 + length({_escaped("text")}) + 8)::BIGINT AS formatted_chars,
  bool_and(fits) AS valid
FROM f GROUP BY conv_id
"""

"""Chat formatting with compiled templates, and reading it back.

A conversation's rows, ordered by turn (ties by role and text, null first),
stream through the compiled template of panelforge.llm.template; markers that
stand in a text or a role are escaped by a backslash, so that read_turns()
gives the turns back exactly. A task holds one message at a time.

Edge cases: null text and null role count as empty; rows with a null conv_id
form one conversation with a null id; repeated rows are turns of their own;
an empty table gives no conversation. A very long conversation passes a message
at a time through one task; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import template
from panelforge.llm.common import table

#: Turns as `### role:`, text, `</turn>`; assistant texts are learned.
TEMPLATE = """\
{% for m in messages %}### {{ m.role | escape_role }}:
{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>
{% endfor %}"""


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def escape_role(role: str) -> str:
    return re.sub(r"([\\:#<])", r"\\\1", role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


FILTERS = {"escape": escape, "escape_role": escape_role}
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+):\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict]]:
    for b in batches:
        conv, role, text = (b.column(k).to_pylist() for k in range(3))
        for c, r, t in zip(conv, role, text, strict=True):
            yield c, {"role": r or "", "text": t or ""}


def _groups(rows: Iterator[tuple[object, dict]]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Like itertools.groupby, but a message at a time."""
    end = object()
    now = next(rows, end)
    while now is not end:
        key = now[0]

        def own() -> Iterator[dict]:
            nonlocal now
            while now is not end and now[0] == key:
                m = now[1]
                now = next(rows, end)
                yield m

        yield key, own()
        while now is not end and now[0] == key:
            now = next(rows, end)


def ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def formatted(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """(conv_id, text, learned): formatted text and the [start, end) code points of what is learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = template.compile(source, FILTERS)
        for conv, messages in _groups(_by_conversation(batches)):
            parts, spans, at = [], [], 0
            for text, learned in render(messages):
                if learned and text:
                    spans.append({"start": at, "end": at + len(text)})
                at += len(text)
                parts.append(text)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "text": "".join(parts), "learned": spans}], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("text", pa.string()), ("learned", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    return ordered(conversations).mapInArrow(run, "conv_id long, text string, learned array<struct<start: long, end: long>>")


def digests(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """What a reader finds in each formatted conversation; the output is read turn by turn as it is rendered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = template.compile(source, FILTERS)
        found = {c: [] for c in schema.names}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict(found, schema=schema)
            for c in found.values():
                c.clear()
            return out

        for conv, messages in _groups(_by_conversation(batches)):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = at = 0
            pending: list[str] = []
            mask: list[tuple[int, int]] = []  # places in the output that is pending

            def read_back() -> None:
                nonlocal n, loss_chars, at
                whole = "".join(pending)
                for role, said in read_turns(whole):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for s, e in mask:
                    own = unescape(whole[s:e])
                    loss_chars += len(own)
                    loss.update(own.encode("utf-8", "surrogatepass"))
                pending.clear()
                mask.clear()
                at = 0

            for text, learned in render(messages):
                chars += len(text)
                pending.append(text)
                if learned:
                    mask.append((at, at + len(text)))
                at += len(text)
                if text.endswith("</turn>\n") and _TURN.fullmatch("".join(pending)):  # a turn may end here
                    read_back()
            read_back()
            for c, x in zip(schema.names, (conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars), strict=True):
                found[c].append(x)
            if len(found["conv_id"]) >= 1000:
                yield flush()
        yield flush()

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return ordered(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, read back, of every formatted conversation and of conversation -7."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(rows.unionByName(more))


OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS safe, regexp_replace(role, '([\\:#<])', '\\\1', 'g') AS safe_role FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || safe_role || ':' || chr(10) || safe || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

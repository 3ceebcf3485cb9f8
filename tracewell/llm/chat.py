"""Chat formatting with loss masks (operator 6).

A finite-state machine over roles validates the order of turns; each turn becomes segments of text with a
loss flag, from a declarative template. Rows are clustered by conversation and sorted by turn, then streamed:
a conversation of any length needs the memory of one Arrow batch.

The template's control strings begin with "<|". Inside texts "<" becomes "<" + ESCAPE when it or more
escapes precede "|", which is undone by dropping one ESCAPE: an injective, reversible escape.

Defined results. Null text: empty. Null role: the empty role, invalid. Null conv_id: one conversation of
its own. Rows that share conv_id and turn go by role, then text. A conversation against TRANSITIONS is
formatted all the same, with valid false. Roles that the template doesn't know use DEFAULT_ROLE, named inside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands before a turn's text and after it; {role} is the escaped role. Text of the roles in `loss` is learned."""

    before: str = "<|start|>{role}<|text|>"
    after: str = "<|end|>\n"
    loss: frozenset[str] = frozenset({"assistant"})
    #: State after a role, by state; "" is the start. Anything else is invalid.
    transitions: dict[str, dict[str, str]] = field(default_factory=lambda: {"": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant", "tool": "tool"}, "tool": {"assistant": "assistant", "tool": "tool"}, "assistant": {"user": "user", "tool": "tool"}})
    final: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self) -> None:
        if not all(x.startswith("<|") for x in (*self.before.split("{role}"), self.after)) or self.before.count("{role}") != 1:
            raise ValueError('before is a control string, {role} and a control string, and each begins with "<|"')

    def turn(self) -> re.Pattern:
        """One formatted turn: the escaped role and text are its groups. No escaped string has "<|", so the first match is the only one."""
        head, tail = (re.escape(x) for x in self.before.split("{role}"))
        return re.compile(f"{head}(.*?){tail}(.*?){re.escape(self.after)}", re.S)


DEFAULT = Template()
_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No result has "<|" in it."""
    return _OPEN.sub(lambda m: f"<{ESCAPE}{m[1]}|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(lambda m: f"<{m[1]}|", text)


SEGMENTS = "conv_id long, turn_no long, segments array<struct<text:string,loss:boolean>>, valid boolean"
_SEGMENT = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """A row for each turn, in order within partitions: its segments, and whether the turns so far are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, valid, n = object(), "", True, 0
        for b in batches:
            convs, roles, texts = (b.column(i).to_pylist() for i in range(3))
            segments, ok, nos = [], [], []
            for conv, role, text in zip(convs, roles, texts, strict=True):
                if conv != now or n == 0:
                    now, state, valid, n = conv, "", True, 0
                n += 1
                role, text = role or "", text or ""
                after = template.transitions.get(state, {}).get(role)
                valid, state = valid and after is not None, after if after is not None else role
                segments.append([{"text": template.before.format(role=escape(role)), "loss": False}, {"text": escape(text), "loss": role in template.loss}, {"text": template.after, "loss": False}])
                ok.append(valid)
                nos.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nos, pa.int64()), pa.array(segments, _SEGMENT), pa.array(ok)], ["conv_id", "turn_no", "segments", "valid"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), "turn")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_arrow(ordered.select("conv_id", "role", "text"), run, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Parses the formatted turns, which must still be in order within partitions, into a row of digests for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
        row, turns, loss, last = None, None, None, ""
        turn = template.turn()
        done: list[dict] = []

        def close() -> None:
            if row:
                done.append(row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest(), "valid": row["valid"] and last in template.final})

        for b in batches:
            for conv, no, parts, valid in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if no == 1:
                    close()
                    row, turns, loss = {"conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "valid": True}, hashlib.sha256(), hashlib.sha256()
                formatted = "".join(p["text"] for p in parts)
                m = turn.fullmatch(formatted)
                if not m:
                    raise ValueError(f"turn {no} of conversation {conv} can't be read back")
                last, text = unescape(m[1]), unescape(m[2])
                turns.update(f"{last}\n{text}\n".encode("utf-8", "surrogatepass"))
                for p in parts:
                    if p["loss"]:
                        learned = unescape(p["text"])
                        row["loss_chars"] += len(learned)
                        loss.update(learned.encode("utf-8", "surrogatepass"))
                row["n_turns"] += 1
                row["formatted_chars"] += len(formatted)
                row["valid"] = valid
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done.clear()
        close()
        yield pa.RecordBatch.from_pylist(done, schema)

    return in_arrow(segments, run, DIGESTS)


#: A text that looks like other templates' control strings.
PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(format_turns(rows))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS no,
         count(*) OVER (PARTITION BY conv_id) AS all_turns,
         length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) AS role_chars,
         length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS text_chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(25 + role_chars + text_chars) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN no = 1 THEN role IN ('system', 'user')
                     WHEN before = 'system' THEN role = 'user'
                     WHEN before = 'user' THEN role IN ('assistant', 'tool')
                     WHEN before = 'tool' THEN role IN ('assistant', 'tool')
                     WHEN before = 'assistant' THEN role IN ('user', 'tool') ELSE false END)
         AND max(role) FILTER (no = all_turns) = 'assistant' AS valid
FROM n GROUP BY conv_id
"""

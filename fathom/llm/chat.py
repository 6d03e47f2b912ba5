"""Operator 7: chat formatting by a finite-state machine over roles and a declarative template.

A template names, for each role, the text before and after a turn, and whether the turn is learned (its loss
flag).  Formatting emits segments (text, loss flag); control strings of the template inside a turn are escaped, so
that they can't be taken for marks, and ``read_back`` undoes it.  Every turn is emitted once, whatever the order;
``valid`` says if the roles follow the machine.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import store

#: state -> role -> next state; what has no next state is invalid from there on.
MACHINE = {
    "start": {"system": "asked", "user": "answering"},
    "asked": {"user": "answering"},
    "answering": {"assistant": "answered"},
    "answered": {"user": "answering"},
}


@dataclass(frozen=True)
class Template:
    """before and after by role; other roles get ``before_other``, where {role} is the escaped role."""

    before: dict = field(default_factory=lambda: {"system": "<<SYS>> ", "user": "<s>[INST] ", "assistant": "<<ANS>> "})
    after: dict = field(default_factory=lambda: {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"})
    before_other: str = "<<ROLE>>{role}<</ROLE>> "
    after_other: str = "<</TURN>>"
    learned: frozenset = frozenset({"assistant"})
    #: The first characters of all control strings, with which each text after a turn begins; ESCAPE goes before them, and before itself, inside texts.
    openers: str = "<["
    escape: str = "\\"

    def escaped(self, text: str) -> str:
        return re.sub(f"[{re.escape(self.openers + self.escape)}]", lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}(.)", r"\1", text, flags=re.S)


def format_turns(turns: list[tuple[str | None, str | None]], template: Template) -> tuple[list[tuple[str, bool]], bool]:
    """Segments (text, loss) of (role, text) turns, and whether the roles' order is valid."""
    segments, state = [], "start"
    for role, text in turns:
        state = MACHINE.get(state, {}).get(role, "invalid")
        if role in template.before:
            before, after = template.before[role], template.after[role]
        else:
            before, after = template.before_other.replace("{role}", template.escaped(role or "")), template.after_other
        segments += [(before, False), (template.escaped(text or ""), role in template.learned), (after, False)]
    return segments, state != "invalid"


def read_turns(text: str, template: Template) -> list[tuple[str, str, int, int]]:
    """(role, text, from, to) of each turn of a formatted conversation; from and to: its place in there."""
    body = rf"((?:[^{re.escape(template.openers + template.escape)}]|{re.escape(template.escape)}.)*+)"
    kinds = [re.escape(template.before[r]) + body + re.escape(template.after[r]) for r in template.before]
    kinds.append(re.escape(template.before_other).replace(r"\{role\}", body) + body + re.escape(template.after_other))
    pattern, roles, out, at = re.compile("|".join(kinds), re.S), list(template.before), [], 0
    while at < len(text):
        m = pattern.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        k = next(i for i in range(1, pattern.groups + 1) if m[i] is not None)
        if k <= len(roles):
            out.append((roles[k - 1], template.unescaped(m[k]), *m.span(k)))
        else:
            out.append((template.unescaped(m[k]), template.unescaped(m[k + 1]), *m.span(k + 1)))
        at = m.end()
    return out


def format_chat(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """A row per conv_id of turns (conv_id, turn, role, text): formatted, segments, loss_spans, valid.

    Turns stand in the order of turn, ties by role and text, nulls first; repeated rows are turns of their own.
    Null texts and roles are empty ones; rows with a null conv_id are one conversation.  loss_spans are the places
    (code points, from and to) in formatted under the loss mask.  Texts are formatted whole, whatever their length, as
    long as a conversation fits in a row; further columns of any name are ignored; an empty table gives no rows.
    """
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part, rows = batch.slice(i, 500), []
                for turns_ in part.column("turns").to_pylist():
                    segments, valid = format_turns([(t["role"], t["text"]) for t in turns_], template)
                    at, spans = 0, []
                    for text, loss in segments:
                        if loss:
                            spans.append({"from": at, "to": at + len(text)})
                        at += len(text)
                    rows.append({"formatted": "".join(x for x, _ in segments), "loss_spans": spans, "valid": valid})
                columns = pa.RecordBatch.from_pylist(rows, schema=schema)
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), *columns.columns], names=["conv_id", *schema.names])

    schema = pa.schema([("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("valid", pa.bool_())])
    kind = turns.schema["conv_id"].dataType.simpleString()
    return grouped.mapInArrow(store.tidied(run), f"conv_id {kind}, formatted string, loss_spans array<struct<from: long, to: long>>, valid boolean")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of the turns and of what is under the loss mask, from format_chat's output alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns = read_turns(text, template)
                learned = "".join(template.unescaped(text[s["from"] : s["to"]]) for s in spans)
                said = "".join(f"{role}\n{words}\n" for role, words, _, _ in turns)
                digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
                rows.append((len(turns), digest(said), len(learned), digest(learned), len(text)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds)), batch.column("valid")], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(store.tidied(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7: all conversations and one whose texts look like the template's marks."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return read_back(format_chat(turns.unionByName(extra)))

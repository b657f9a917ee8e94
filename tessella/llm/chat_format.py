"""Chat formatting: records of any known layout become canonical turns and one marked-up text.

A mapping declares which fields it reads. A record's fingerprint is the hash of the sorted nested paths, with their
kinds, of those fields alone; the further fields of records, turns and parts of texts are left out, whatever they are.
The first mapping that knows the fingerprint says where turns, roles and texts are. Control strings inside roles and
texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: a list field with role and text fields, or single fields with fixed roles. Either may have a
    `system` field for a turn before the others."""

    name: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ("system",)

    def fits(self, record: dict[str, Any]) -> bool:
        """Whether the record has the fields that all views of this mapping have."""
        return self.turns in record if self.turns is not None else all(f in record for f, _ in self.fields if f not in self.optional)

    def view(self, record: dict[str, Any]) -> dict[str, Any]:
        """The record's fields that the mapping reads. A text may be a list of parts with types and texts."""
        if self.turns is None:
            return {k: record[k] for k, _ in self.fields if k in record}
        turns = record.get(self.turns)
        if isinstance(turns, list):
            turns = [{k: _parts(t[k]) for k in (self.role, self.text) if k in t} if isinstance(t, dict) else t for t in turns]
        return ({self.turns: turns} if self.turns in record else {}) | ({"system": record["system"]} if "system" in record else {})

    def apply(self, view: dict[str, Any]) -> list[tuple[str, str]]:
        if self.turns is not None:
            names, head = dict(self.roles), view.get("system")
            turns = [(names.get(role := t.get(self.role) or "", role), _plain(t.get(self.text))) for t in view[self.turns] or []]
            return [("system", head), *turns] if head else turns
        out: list[tuple[str, str]] = []
        for name, role in self.fields:
            text = view.get(name)
            if text is None or text == "" and name in self.optional:
                continue
            if role == "context":  # further input of the turn before it
                out = [*out[:-1], (out[-1][0], f"{out[-1][1]}\n\n{text}") if out else ("user", text)]
            else:
                out.append((role, text))
        return out

    def prints(self) -> Iterator[str]:
        """The fingerprints of its views."""
        if self.turns is None:
            kinds = [("string", "null", None) if f in self.optional else ("string", "null") for f, _ in self.fields]
            for chosen in itertools.product(*kinds):
                yield fingerprint({f".{f}:{k}" for (f, _), k in zip(self.fields, chosen, strict=True) if k})
            return
        role, text = f".{self.turns}[].{self.role}", f".{self.turns}[].{self.text}"
        roles = [{f"{role}:string"}, {f"{role}:string", f"{role}:null"}]
        texts = [f"{text}:string", f"{text}:null", f"{text}:list", f"{text}[].type:string", f"{text}[].text:string", f"{text}[].text:null"]
        bodies = [{f".{self.turns}:list"}, *(r | {t for t, y in zip(texts, chosen, strict=True) if y} for r in roles for chosen in itertools.product((False, True), repeat=len(texts)) if any(chosen))]
        for body, system in itertools.product(bodies, (set(), {".system:string"}, {".system:null"})):
            yield fingerprint(body | system)


def _parts(text: Any) -> Any:
    return [{k: p[k] for k in ("type", "text") if k in p} if isinstance(p, dict) else p for p in text] if isinstance(text, list) else text


def _plain(text: str | list | None) -> str:
    """The text, or the texts of its parts, a line each; parts without text (pictures, say) give none."""
    return "\n".join(p["text"] for p in text if p.get("text")) if isinstance(text, list) else text or ""


def field_paths(value: Any, at: str = "") -> set[str]:
    """Nested field paths with the kinds of their values; list elements share the path `[]`."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}") for k, v in value.items())) or {f"{at}:object"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) or {f"{at}:list"}
    kind = "null" if value is None else "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
    return {f"{at}:{kind}"}


def fingerprint(paths: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

#: The known layouts; of a record that has the fields of several the first is taken.
LAYOUTS = [
    Mapping("messages", "messages"),
    Mapping("conversations", "conversations", "from", "value", _NAMES),
    Mapping("dialogue", "dialogue", "speaker", "utterance"),
    Mapping("prompt", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("completion", fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant"))),
    Mapping("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "context"), ("output", "assistant")), optional=("system", "input")),
    Mapping("question", fields=(("system", "system"), ("question", "user"), ("answer", "assistant"))),
]
PRINTS = {m.name: frozenset(m.prints()) for m in LAYOUTS}


def choose(record: Any) -> tuple[Mapping | None, dict[str, Any], str]:
    """The mapping of a record, its view of it and the fingerprint; without a mapping, the fingerprint of the whole record."""
    if isinstance(record, dict):
        for m in (m for m in LAYOUTS if m.fits(record)):
            if (print_ := fingerprint(field_paths(view := m.view(record)))) in PRINTS[m.name]:
                return m, view, print_
    return None, {}, fingerprint(field_paths(record))


def escape(text: str) -> str:
    """`<`, any backslashes, `|` gets one more backslash, so a text never holds a control string."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The marked-up text and the spans of assistant texts in it, as code points."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a marked-up text: the inverse of render."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        turns.append((_unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def format_chats(records: DataFrame, *, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """(conv_id, layout, fingerprint, formatted, loss_spans) for every row of JSON records.

    Fields that a layout's mapping doesn't read are left out. Unknown layouts, records that are no JSON object and null records
    have layout null, formatted "" and no spans, so no row is lost; unknown_layouts counts them. Null roles and texts are empty. Repeated ids are records of their own.
    """
    schema = "conv_id long, layout string, fingerprint string, formatted string, loss_spans array<struct<start:long,end:long>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                try:
                    record = json.loads(text or "null", strict=False)
                except ValueError:
                    record = None
                mapping, view, print_ = choose(record)
                formatted, spans = render(mapping.apply(view)) if mapping else ("", [])
                rows.append((mapping.name if mapping else None, print_, formatted, [{"start": a, "end": b} for a, b in spans]))
            layout, prints, formatted, spans = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(layout, pa.string()), pa.array(prints, pa.string()), pa.array(formatted, pa.string()), pa.array(spans, span)], names=["conv_id", "layout", "fingerprint", "formatted", "loss_spans"])

    return records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(record_col).cast("string").alias("record")).mapInArrow(work, schema)


def unknown_layouts(formatted: DataFrame) -> DataFrame:
    """(fingerprint, n) of the rows that no mapping knows."""
    return formatted.filter("layout is null").groupBy("fingerprint").agg(F.count("*").alias("n"))


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted chats: turns, their hash, and the text under the loss mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(work, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def records_from_turns(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, record): rows of turns as one JSON record for each conversation, in order of (turn, role, text).

    A user's turn with the assistant's answer alone becomes a prompt layout, other conversations a dialogue or, where the id is
    even, messages; each has further fields that no mapping reads. Null roles and texts are empty. One conversation has to fit a
    cell, as its formatted text has to.
    """
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    t, last = F.col("t"), F.element_at("t", -1)
    pair = (F.size(t) == 2) & (t[0]["role"] == "user") & (last["role"] == "assistant")
    prompt = F.to_json(F.struct(F.col("conv_id").alias("id"), t[0]["text"].alias("prompt"), last["text"].alias("response")))
    messages = F.to_json(F.struct(F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), x["turn"].alias("index"))).alias("messages")))
    dialogue = F.to_json(F.struct(F.transform(t, lambda x: F.struct(x["role"].alias("speaker"), x["text"].alias("utterance"))).alias("dialogue"), F.size(t).alias("n_turns")))
    return grouped.select("conv_id", F.when(pair, prompt).when(F.col("conv_id") % 2 == 0, messages).otherwise(dialogue).alias("record"))

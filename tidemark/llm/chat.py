r"""Chat formatting by schema fingerprints.

A record's fingerprint is the hash of its sorted nested field paths. It selects
a declarative mapping that says where turns, roles and texts are; so prompt and
response pairs, instructions, message lists and tables of turns all become
canonical turns (conv_id, turn, role, text). `render` writes a conversation's
turns into one template with a loss mask over the assistant's texts;
`read_back` recovers turns and masked text from the output alone.

Template: `<|turn|>` role `<|text|>` text `<|end|>` for each turn. In roles and
texts a backslash is doubled, and each control string becomes `\c`, its number
and `;`, so no text can hold one and escaping is reversible.

Odd input: null roles and texts are empty; a null turn comes last, equal turns
are ordered by role and text, and repeated rows stay; a record whose layout is
not known, or whose values don't fit it (a list of messages that is none, is
empty or holds other things than objects, a turn that is no whole number, JSON
nested too deep to be parsed), becomes one turn of the role `unmapped` that
holds it as it came, none is lost; null payloads have no fields and are
unmapped, too; fields of EXTRA beside a known layout are passed over; an empty
table gives an empty result. One conversation is held in memory at a time, as its
output is one row, with finished ones up to a bounded size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

#: Characters of finished conversations that a task holds before it gives them out; one longer conversation goes alone.
TOGETHER = 1 << 20

#: The template's own marks first, then other formats' control strings.
CONTROL = ["<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]

#: Other names of roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Layouts: field paths, then either fixed turns (role, field) or a list with the fields of role and text, or a row that is a turn.
MAPPINGS = [
    (["conv_id", "role", "text", "turn"], {"row": ("turn", "role", "text")}),
    (["prompt", "response"], {"turns": [("user", "prompt"), ("assistant", "response")]}),
    (["prompt", "completion"], {"turns": [("user", "prompt"), ("assistant", "completion")]}),
    (["question", "answer"], {"turns": [("user", "question"), ("assistant", "answer")]}),
    (["instruction", "output"], {"turns": [("user", "instruction"), ("assistant", "output")]}),
    (["instruction", "input", "output"], {"turns": [("user", "instruction"), ("user", "input"), ("assistant", "output")]}),
    (["system", "prompt", "response"], {"turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")]}),
    (["messages"], {"list": ("messages", "role", "content")}),
    (["messages", "messages[].content", "messages[].role"], {"list": ("messages", "role", "content")}),
    (["conversations"], {"list": ("conversations", "from", "value")}),
    (["conversations", "conversations[].from", "conversations[].value"], {"list": ("conversations", "from", "value")}),
]


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a parsed record; a list's elements share one."""
    if isinstance(value, dict):
        fields = {f"{at}.{k}" if at else k: v for k, v in value.items()}
        return {p for own, v in fields.items() for p in {own} | paths(v, own)}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")}
    return set()


def fingerprint(field_paths) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(field_paths)))


#: Fields beside a layout's own that change nothing in it.
EXTRA = frozenset(["id", "source", "lang", "dataset", "model", "timestamp"])

BY_FINGERPRINT = {fingerprint(of): mapping for of, mapping in MAPPINGS}


_LONE = re.compile("[\ud800-\udfff]")


def _text(value) -> str:
    """A value as text; halves of surrogate pairs, which no text can hold, become U+FFFD."""
    return _LONE.sub("\ufffd", value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False))


def _mapped(record, mapping: dict) -> list[tuple[int | None, str, str]] | None:
    """The turns of a record of a known layout; None if a value isn't of the kind that the mapping takes."""
    if "row" in mapping:
        turn, role, text = (record[k] for k in mapping["row"])
        return [(turn, _text(role), _text(text))] if turn is None or type(turn) is int and abs(turn) < 1 << 63 else None
    if "turns" in mapping:
        return [(i, role, _text(record[field])) for i, (role, field) in enumerate(mapping["turns"])]
    field, role, text = mapping["list"]
    turns = record[field]
    if not isinstance(turns, list) or not turns or not all(isinstance(m, dict) for m in turns):
        return None
    return [(i, ROLES.get(r := _text(m.get(role)), r), _text(m.get(text))) for i, m in enumerate(turns)]


def turns_of(payload: str | None) -> tuple[int, list[tuple[int | None, str, str]]]:
    """The fingerprint and the canonical turns (turn, role, text) of a record."""
    mark, turns = fingerprint(()), None
    try:
        record = json.loads(payload) if payload else {}
        own = paths(record)
        mark = fingerprint(own)
        mapping = BY_FINGERPRINT.get(mark) or BY_FINGERPRINT.get(fingerprint(p for p in own if p not in EXTRA))
        turns = mapping and _mapped(record, mapping)
    except (ValueError, RecursionError):  # no JSON, or nested too deep
        pass
    return mark, turns or [(0, "unmapped", payload or "")]


def canonical_turns(records: DataFrame) -> DataFrame:
    """records (conv_id, payload: JSON) -> conv_id, turn, role, text, layout (the fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, payload in enumerate(batch.column("payload").to_pylist()):
                mark, turns = turns_of(payload)
                ids += [i] * len(turns)
                rows += [(*t, mark - (1 << 64) if mark >> 63 else mark) for t in turns]
            turn, role, text, layout = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(ids, pa.int32())), pa.array(turn, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string()), pa.array(layout, pa.int64())], names=["conv_id", "turn", "role", "text", "layout"])

    return small_batches(records.select("conv_id", "payload")).mapInArrow(run, f"conv_id {dict(records.dtypes)['conv_id']}, turn long, role string, text string, layout long")


_CONTROL = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_ESCAPED = re.compile(r"\\(?:\\|c(\d+);)")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"\\c{CONTROL.index(m[0])};", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: CONTROL[int(m[1])] if m[1] else "\\", text)


def render_one(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(role, text) turns -> the formatted text and the spans of it, in code points, that bear loss."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"<|turn|>{escape(role)}<|text|>", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "<|end|>"]
        at += len(head) + len(body) + len("<|end|>")
    return "".join(out), mask


def render(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> a row a conversation: conv_id, formatted, mask (array of start, end)."""
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(turns.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, done, size, id_type = None, [], [], 0, None

        def finish() -> None:
            nonlocal size
            done.append((current, *render_one(held)))
            held.clear()
            size += len(done[-1][1])

        def flush() -> pa.RecordBatch:
            nonlocal size
            ids, formatted, mask = zip(*done, strict=True)
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(formatted, pa.string()), pa.array([[{"start": s, "end": e} for s, e in m] for m in mask], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["conv_id", "formatted", "mask"],
            )
            done.clear()
            size = 0
            return out

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if held and conv != current:
                    finish()
                    if size > TOGETHER:
                        yield flush()
                current = conv
                held.append((role, text))
        if held:
            finish()
        if done:
            yield flush()

    in_order = small_batches(turns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return in_order.mapInArrow(run, f"conv_id {kind}, formatted string, mask array<struct<start: int, end: int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, mask -> conv_id, turns (role, text), loss (texts under the mask, unescaped), formatted_chars."""
    kind = dict(formatted.dtypes)["conv_id"]
    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, masks = batch.column("formatted").to_pylist(), batch.column("mask").to_pylist()
            turns = [[{"role": unescape(r), "text": unescape(t)} for r, t in _TURN.findall(x)] for x in texts]
            loss = [[unescape(x[s["start"] : s["end"]]) for s in m] for x, m in zip(texts, masks, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(turns, turn_type), pa.array(loss, pa.list_(pa.string())), pa.array(list(map(len, texts)), pa.int64())], names=["conv_id", "turns", "loss", "formatted_chars"])

    return small_batches(formatted.select("conv_id", "formatted", "mask")).mapInArrow(run, f"conv_id {kind}, turns array<struct<role: string, text: string>>, loss array<string>, formatted_chars long")


def as_records(conversations: DataFrame) -> DataFrame:
    """A table of turns as records: conv_id, payload."""
    return conversations.select("conv_id", F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("payload"))


def digests(read: DataFrame) -> DataFrame:
    """What read_back gives, as digests."""
    lines: Column = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")

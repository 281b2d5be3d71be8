"""Chat formatting by incremental black-box rendering.

A template is any function from a list of ``(role, text)`` turns to one string; nothing is known about it. The growing
prefixes of a conversation are rendered one after the other. As long as each output begins with the one before, what was
appended is the span of the new turn; inside it the text is found by rendering the same prefix once more with a marker
character in place of the text, which shows the turn's head and tail. A template that changes what it has already rendered
(``rewritten_at`` = first such prefix) gets no spans: a loss mask over it would train on text that a later turn alters.

A conversation is the unit of work (one row after grouping); its cost is its turns times its length, in string copies.

Defined results: null text or role is empty; rows are put in order of ``turn`` (null first), equal turns by role, then text;
repeated rows are repeated turns; rows with a null ``conv_id`` form one conversation; an empty table gives an empty table; further
columns are ignored. A text with the marker character is rendered with another one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

# Control strings of common chat formats. A text that holds one must not be read as control.
CONTROLS = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]",
    "<<SYS>>", "<</SYS>>",
)
START, END = "<|im_start|>", "<|im_end|>"

_raw = re.compile("|".join(f"{re.escape(c[0])}(\\\\*){re.escape(c[1:])}" for c in CONTROLS))
_kept = re.compile("|".join(f"{re.escape(c[0])}\\\\(\\\\*){re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    """One backslash more after the first character of each control string, already escaped ones included."""
    return _raw.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _kept.sub(lambda m: m[0][0] + m[0][2:], text)


def _name(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(name: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name))


def marked_turns(turns: Turns) -> str:
    """Default template: start mark, role, line feed, escaped text, end mark."""
    return "".join(f"{START}{_name(role)}\n{escape(text)}{END}\n" for role, text in turns)


_turn = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_marked(output: str) -> Turns:
    """The turns of a string rendered by ``marked_turns``; fails on anything else."""
    turns, at = [], 0
    while at < len(output):
        found = _turn.match(output, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((_role(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def spans(turns: Turns, template: Template) -> tuple[str, list[tuple[int, int]] | None, int | None]:
    """The rendered conversation, the span of each turn's text in it, and the first prefix that rewrote history."""
    done, found = template([]), []
    for k, (role, text) in enumerate(turns, 1):
        prefix = turns[:k - 1]
        now = template(turns[:k])
        mark = next(chr(c) for c in range(0xE000, 0xF900) if chr(c) not in text and chr(c) not in role)
        probe = template([*prefix, (role, mark)])
        if not now.startswith(done) or not probe.startswith(done):
            return template(turns), None, k
        head = probe.find(mark, len(done))
        tail = len(probe) - head - 1
        if head < 0 or not now.startswith(probe[len(done):head], len(done)) or not now.endswith(probe[head + 1:]):
            raise ValueError(f"turn {k}: the template doesn't keep the text in one piece")
        found.append((head, len(now) - tail))
        done = now
    return done, found, None


SHAPE = ("conv_id {}, formatted string, roles array<string>, starts array<bigint>, ends array<bigint>, rewritten_at bigint")


def render(conversations: DataFrame, template: Template = marked_turns) -> DataFrame:
    """One row per conversation: the formatted string and each turn's role and text span (code points, end exclusive)."""
    turns = conversations.select("conv_id", F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"formatted": [], "roles": [], "starts": [], "ends": [], "rewritten_at": []}
            for row in batch.column("turns").to_pylist():
                told = [(t["role"], t["text"]) for t in row]
                text, where, changed = spans(told, template)
                for key, value in zip(out, (text, [r for r, _ in told], where and [a for a, _ in where], where and [b for _, b in where], changed)):
                    out[key].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(out["formatted"], pa.string()), pa.array(out["roles"], pa.list_(pa.string())),
                 *(pa.array(out[k], pa.list_(pa.int64())) for k in ("starts", "ends")), pa.array(out["rewritten_at"], pa.int64())],
                names=["conv_id", *out])

    return whole.mapInArrow(run, SHAPE.format(conversations.schema["conv_id"].dataType.simpleString()))


def digests(rendered: DataFrame, trained: str = "assistant") -> DataFrame:
    """What the formatted strings hold, read back from them alone: turns, and the text under the loss mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.select(["formatted", "roles", "starts", "ends"]).to_pylist():
                turns = read_marked(r["formatted"])
                masked = "".join(unescape(r["formatted"][a:b]) for role, a, b in zip(r["roles"], r["starts"] or [], r["ends"] or []) if role == trained)
                rows.append((len(turns), _hex("".join(f"{role}\n{text}\n" for role, text in turns)), len(masked), _hex(masked), len(r["formatted"])))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = rendered.schema["conv_id"].dataType.simpleString()
    return rendered.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

r"""Chat formatting of typed content parts.

A visitor flattens the text, image, audio and document parts of a turn into one string: text is escaped, every other
part becomes a placeholder in its place, its reference is recorded as an attachment and its expanded token count is
noted. Turns are marked ``<turn role="...">`` and ``</turn>``; backslashes and control strings inside texts are
escaped with a backslash, so ``read_turns`` gives back exactly what went in.

Turns stream: rows are dealt by conversation and sorted inside partitions, and each turn is formatted alone. A
conversation of any length needs the memory of one batch; its place in the formatted conversation is a running sum.

Text parts count as the tokens of the vocabulary of ``token_counts``.

Defined results: null texts, roles and references are empty; a part of another type becomes an ``unknown`` placeholder
of no tokens, its reference recorded; turns come in order of turn (null first), then role,
then text, so ties and repeated rows keep a fixed order; null ids form one conversation; an empty table gives no
rows; extra columns are not read.
"""

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import VOCABULARY, encoding

TAGS = ("turn", "image", "audio", "document", "unknown")
_SPECIAL = re.compile(r'\\|"|<(?=/?(?:' + "|".join(TAGS) + r")\b)", re.ASCII)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TOKEN = re.compile(r'\\.|<turn role="((?:[^"\\]|\\.)*)">\n|\n</turn>\n', re.DOTALL)

IMAGE_PATCH = 14
AUDIO_TOKENS_A_SECOND = 25
DOCUMENT_TOKENS_A_PAGE = 256


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattener:
    """Visits the parts of a turn in order."""

    out: list = field(default_factory=list)
    attachments: list = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.out.append(escape(text))
        self.tokens += len(encoding(VOCABULARY).encode_ordinary(text)) if text else 0

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or IMAGE_PATCH) / IMAGE_PATCH) * math.ceil((part.get("height") or IMAGE_PATCH) / IMAGE_PATCH)
        self.place("image", part, tiles)

    def visit_audio(self, part: dict) -> None:
        self.place("audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS_A_SECOND))

    def visit_document(self, part: dict) -> None:
        self.place("document", part, (part.get("pages") or 1) * DOCUMENT_TOKENS_A_PAGE)

    def visit_unknown(self, part: dict) -> None:
        self.place("unknown", part, 0)

    def place(self, kind: str, part: dict, tokens: int) -> None:
        self.out.append(f"<{kind} {len(self.attachments)}/>")
        self.attachments.append({"kind": kind, "ref": part.get("ref") or "", "tokens": tokens})
        self.tokens += tokens


def format_turn(role: str | None, parts: list[dict]) -> dict:
    """The formatted turn, its loss span (an assistant's content; else empty), attachments and token count."""
    v = Flattener()
    for part in parts:
        v.visit(part)
    head, body = f'<turn role="{escape(role or "")}">\n', "".join(v.out)
    end = len(head) + len(body)
    return {"formatted": f"{head}{body}\n</turn>\n", "loss_start": len(head) if role == "assistant" else end, "loss_end": end, "attachments": v.attachments, "tokens": v.tokens}


def read_turns(formatted: str):
    """(role, text) of each turn of a formatted conversation whose parts are texts."""
    role, start = None, 0
    for m in _TOKEN.finditer(formatted):
        if m[0][0] == "\\":
            continue
        if m[1] is not None:
            role, start = unescape(m[1]), m.end()
        else:
            yield role, unescape(formatted[start : m.start()])


PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
_OUT = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachments", _ATTACHMENTS), ("tokens", pa.int64()), ("offset", pa.int64())])
_OUT_DDL = "conv bigint, turn bigint, formatted string, loss_start bigint, loss_end bigint, attachments array<struct<kind:string,ref:string,tokens:bigint>>, tokens bigint, offset bigint"


def text_parts(text_col: str = "text"):
    """A plain text column as one text part."""
    nothing = lambda kind: F.lit(None).cast(kind)
    return F.array(
        F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), nothing("string").alias("ref"), nothing("int").alias("width"), nothing("int").alias("height"), nothing("double").alias("seconds"), nothing("int").alias("pages"))
    )


def _format(batches):
    here, offset = object(), 0
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["conv"] != here:
                here, offset = r["conv"], 0
            one = format_turn(r["role"], r["parts"] or [])
            rows.append({"conv": r["conv"], "turn": r["turn"], "offset": offset, **one})
            offset += len(one["formatted"])
        yield pa.RecordBatch.from_pylist(rows, _OUT)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts=None) -> DataFrame:
    """A row per turn, in order inside partitions that hold whole conversations: conv, turn, formatted, its loss span
    and attachments, token count, and its offset in the formatted conversation (the turns' strings, one after another)."""
    parts = text_parts() if parts is None else parts
    wanted = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), parts.alias("parts"))
    return wanted.repartition("conv").sortWithinPartitions("conv", "turn", "role", "parts").mapInArrow(_format, _OUT_DDL)


def whole_conversations(formatted: DataFrame) -> DataFrame:
    """One formatted string a conversation, with its loss spans, for conversations that fit in a row."""
    g = formatted.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("offset", "formatted", "loss_start", "loss_end"))).alias("t"), F.sum("tokens").alias("tokens"))
    spans = F.transform(F.filter("t", lambda x: x["loss_end"] > x["loss_start"]), lambda x: F.struct((x["offset"] + x["loss_start"]).alias("start"), (x["offset"] + x["loss_end"]).alias("end")))
    return g.select("conv", F.array_join(F.col("t.formatted"), "").alias("formatted"), spans.alias("loss"), "tokens")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_READ_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


class _Digest:
    def __init__(self, conv):
        self.conv, self.n, self.all, self.loss, self.loss_chars, self.chars = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0

    def add(self, r: dict) -> None:
        for role, text in read_turns(r["formatted"]):
            self.n += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        loss = unescape(r["formatted"][r["loss_start"] : r["loss_end"]])
        self.loss.update(loss.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(loss)
        self.chars += len(r["formatted"])

    def row(self) -> dict:
        return {"conv_id": self.conv, "n_turns": self.n, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def _read_back(batches):
    now = None
    for batch in batches:
        done = []
        for r in batch.select(["conv", "formatted", "loss_start", "loss_end"]).to_pylist():
            if now is None or r["conv"] != now.conv:
                if now is not None:
                    done.append(now.row())
                now = _Digest(r["conv"])
            now.add(r)
        yield pa.RecordBatch.from_pylist(done, _READ)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], _READ)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests read back from the formatted turns; it keeps the partitions of ``format_conversations``."""
    return formatted.mapInArrow(_read_back, _READ_DDL)


PROBE = (-7, r"\### Assistant: </turn> ok")


def op8_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    conv, text = PROBE
    probe = spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return conversation_digests(format_conversations(turns.unionByName(probe)))

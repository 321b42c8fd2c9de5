"""Sync messages on the wire (protocol-buffer encoding) and ledger archives, in Arrow batches.

Envelope: timestamp 1, encrypted 2, content 3. Message: dataset 1, row 2, column 3, value 4. Request: envelopes 1,
file 2, group 3, key 5, since 6. Response: envelopes 1, merkle 2.
"""

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE_FIELDS = ("dataset", "row", "column", "value")
_MESSAGE = pa.struct([(c, pa.string()) for c in ("timestamp", *MESSAGE_FIELDS)])
#: Bytes that are decoded at once.
PIECE = 1 << 20


# Reading: all fields of all messages of a batch at once


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number that would begin at each byte and how many bytes it has; 0 bytes where it does not end."""
    n = len(data)
    value, size = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
    at = np.arange(n)
    for k in range(10):
        at = at[at + k < n]
        b = data[at + k].astype(np.uint64)
        value[at] |= (b & np.uint64(127)) << np.uint64(7 * k)
        ends = b < 128
        size[at[ends]] = k + 1
        at = at[~ends]
    return value, size


@dataclass
class _Fields:
    """Fields in the order of the bytes: the message each belongs to, its number, whether it has bytes, their range, and
    the number it has otherwise."""

    owner: np.ndarray
    number: np.ndarray
    bytes_: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    value: np.ndarray

    def of(self, number: int) -> np.ndarray:
        return np.flatnonzero((self.number == number) & self.bytes_)


def _fields(numbers: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> _Fields:
    """The fields of the messages at start to stop. For every byte of a message the end of a field that would begin there
    is known; which bytes do begin one follows by doubling steps from the messages' first bytes."""
    value, size = numbers
    n = len(value) - 1
    length = stop - start
    at = np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
    owner = np.repeat(np.arange(len(start)), length)
    end = np.repeat(stop, length)
    kind = (value[at] & np.uint64(7)).astype(np.int64)
    body = np.minimum(at + size[at], n)
    told, told_size = value[body], size[body]
    wide = np.where(kind == 2, np.minimum(told, np.uint64(1 << 40)).astype(np.int64), np.array([0, 8, 0, -1, -1, 4, -1, -1])[kind])
    first = body + np.where((kind == 0) | (kind == 2), told_size, 0)
    last = first + wide
    good = (size[at] > 0) & (wide >= 0) & ~(((kind == 0) | (kind == 2)) & (told_size == 0)) & (last <= end)
    done, broken = len(at), len(at) + 1
    place = np.full(n + 1, broken)  # a byte's place among the messages' bytes
    place[at] = np.arange(len(at))
    step = np.append(np.where(good, np.where(last == end, done, place[np.minimum(last, n)]), broken), [done, broken])
    begins = np.zeros(len(at) + 2, bool)
    begins[(np.cumsum(length) - length)[length > 0]] = True
    known = 0
    while (now := int(np.count_nonzero(begins))) > known:
        known = now
        begins[step[np.flatnonzero(begins)]] = True
        step = step[step]
    if begins[broken]:
        raise ValueError("truncated or unknown field")
    p = np.flatnonzero(begins[:done])
    return _Fields(owner[p], (value[at[p]] >> np.uint64(3)).astype(np.int64), kind[p] != 0, first[p], last[p], told[p])


def _texts(data: np.ndarray, found: _Fields, number: int, n: int) -> pa.Array:
    """The last field ``number`` of each of ``n`` messages as text, '' without one."""
    start, stop = np.zeros(n, np.int64), np.zeros(n, np.int64)
    i = found.of(number)
    start[found.owner[i]], stop[found.owner[i]] = found.start[i], found.stop[i]
    length = stop - start
    ends = np.cumsum(length)
    taken = data[np.repeat(start - ends + length, length) + np.arange(int(ends[-1]) if n else 0)]
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(taken)]).cast(pa.string())


def _number(raw, at: int, stop: int) -> tuple[int, int]:
    """The number that begins at ``at`` and the place behind it."""
    value = 0
    for k in range(min(10, stop - at)):
        value |= (raw[at + k] & 127) << 7 * k
        if raw[at + k] < 128:
            return value, at + k + 1
    raise ValueError("truncated or unknown field")


def _cuts(raw, at: int, stop: int) -> list[int]:
    """Places between a body's outer fields, PIECE bytes apart or one field, and its end: what lies between two of them
    is a response of its own."""
    cuts, last = [], at
    while at < stop:
        kind, body = _number(raw, at, stop)
        kind &= 7
        if kind in (0, 2):
            told, body = _number(raw, body, stop)
            end = body + (told if kind == 2 else 0)
        elif kind in (1, 5):
            end = body + (8 if kind == 1 else 4)
        else:
            raise ValueError("truncated or unknown field")
        if end > stop:
            raise ValueError("truncated or unknown field")
        if end - last > PIECE and at > last:
            cuts.append(at)
            last = at
        at = end
    return [*cuts, stop]


def _pieces(bodies: pa.Array) -> Iterator[tuple[np.ndarray, pa.StructArray]]:
    """The messages of binary responses, some at a time, each with the number of its body.

    Reading takes some tens of bytes for each byte at hand, so about PIECE bytes are read at once: small bodies together,
    a large one in parts."""
    bodies = pc.fill_null(bodies, b"")
    n = len(bodies)
    offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    held = bodies.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and n else np.zeros(0, np.uint8)
    raw, places, owners = memoryview(data), [int(offsets[0])], []
    for k, large in enumerate(np.diff(offsets) > PIECE):
        ends = _cuts(raw, int(offsets[k]), int(offsets[k + 1])) if large else [int(offsets[k + 1])]
        places += ends
        owners += [k] * len(ends)
    places, owners, at = np.array(places), np.array(owners, np.int64), 0
    while at < len(owners):
        next_ = max(at + 1, int(np.searchsorted(places, places[at] + PIECE, "right")) - 1)
        some = _decode(data[places[at] : places[next_]], places[at : next_ + 1] - places[at])
        yield np.repeat(owners[at:next_], np.diff(some.offsets.to_numpy())), some.values
        at = next_


def decode_responses(bodies: pa.Array) -> pa.Array:
    """The messages of each binary response, in order, with their envelope's timestamp; null and empty bodies have none.
    Unknown fields are skipped; ValueError on a truncated body, or one that holds encrypted messages."""
    found = list(_pieces(bodies))
    owners = np.concatenate([np.zeros(0, np.int64), *[o for o, _ in found]])
    ends = np.searchsorted(owners, np.arange(len(bodies) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays([pa.array([], _MESSAGE), *[m for _, m in found]]))


def _decode(data: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """The messages of the bodies that lie in ``data``."""
    n = len(offsets) - 1
    numbers = _numbers(data)
    outer = _fields(numbers, offsets[:-1], offsets[1:])
    mine = outer.of(1)
    m = len(mine)
    envelopes = _fields(numbers, outer.start[mine], outer.stop[mine])
    flag = np.zeros(m, bool)
    said = np.flatnonzero(envelopes.number == 2)
    flag[envelopes.owner[said]] = np.where(envelopes.bytes_[said], envelopes.stop[said] > envelopes.start[said], envelopes.value[said] > 0)
    if flag.any():
        raise ValueError("encrypted messages are not supported")
    start, stop = np.zeros(m, np.int64), np.zeros(m, np.int64)
    content = envelopes.of(3)
    start[envelopes.owner[content]], stop[envelopes.owner[content]] = envelopes.start[content], envelopes.stop[content]
    messages = _fields(numbers, start, stop)
    columns = [_texts(data, envelopes, 1, m), *[_texts(data, messages, k, m) for k in range(1, 5)]]
    ends = np.searchsorted(outer.owner[mine], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["timestamp", *MESSAGE_FIELDS]))


# Writing: a message's bytes are an expression, a request joins those of its messages


def _varint(n: Column) -> Column:
    """A length as bytes of seven bits each, the last one under 128."""
    byte = lambda x: F.unhex(F.lpad(F.hex(x), 2, "0"))
    part = lambda k: F.shiftright(n, 7 * k).bitwiseAND(F.lit(127))
    out = byte(part(4))
    for k in reversed(range(4)):
        out = F.when(n < 1 << 7 * (k + 1), byte(part(k))).otherwise(F.concat(byte(part(k).bitwiseOR(F.lit(128))), out))
    return out


def _block(number: int, raw: str, size: str) -> Column:
    return F.concat(F.lit(bytes([number << 3 | 2])), _varint(F.col(size)), F.col(raw))


def with_envelopes(messages: DataFrame, out: str, fields: tuple[str, ...] = MESSAGE_FIELDS) -> DataFrame:
    """Messages with their envelope as binary field 1 of a request; empty and null texts are left out of the message.

    Bytes and their lengths are columns of their own, step by step, so that no expression holds another one twice."""
    names = ("timestamp", *fields)
    x = messages.withColumns({f"__b{k}": F.encode(F.coalesce(F.col(c), F.lit("")), "UTF-8") for k, c in enumerate(names)})
    x = x.withColumns({f"__n{k}": F.octet_length(f"__b{k}") for k in range(len(names))})
    x = x.withColumn("__content", F.concat(*[F.when(F.col(f"__n{k}") > 0, _block(k, f"__b{k}", f"__n{k}")).otherwise(F.lit(b"")) for k in range(1, len(names))]))
    x = x.withColumn("__n", F.octet_length("__content")).withColumn("__envelope", F.concat(_block(1, "__b0", "__n0"), _block(3, "__content", "__n")))
    x = x.withColumn("__size", F.octet_length("__envelope")).withColumn(out, _block(1, "__envelope", "__size"))
    return x.drop(*[f"__{c}{k}" for c in "bn" for k in range(len(names))], "__content", "__n", "__envelope", "__size")


def response_messages(responses: DataFrame, body_col: str = "body") -> DataFrame:
    """One row per message of binary sync responses, with its ordinal in the response. Messages leave the task as they
    are read, so it never holds those of all its responses."""
    kept = [c for c in responses.columns if c != body_col]
    names = [*kept, "ord", *_MESSAGE.names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, before = None, 0  # the body that the piece before ended in, and its messages until then
            for owners, found in _pieces(batch.column(body_col)):
                if not len(owners):
                    continue
                first = np.searchsorted(owners, owners)
                place = np.arange(len(owners)) - first + np.where(owners == body, before, 0)
                body, before = owners[-1], int(place[-1]) + 1
                own = [batch.column(c).take(pa.array(owners)) for c in kept]
                yield pa.record_batch([*own, pa.array(place.astype(np.int32)), *found.flatten()], names=names)

    kind = T.StructType([*[responses.schema[c] for c in kept], T.StructField("ord", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in _MESSAGE.names]])
    return responses.select(*kept, F.col(body_col).cast("binary").alias(body_col)).mapInArrow(read, kind)


def joined(lists: pa.Array) -> pa.Array:
    """The elements of each list of binaries, one behind the other: they lie like that already."""
    flat, ends = lists.flatten(), np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    at = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at[ends].astype(np.int32)), flat.buffers()[2] if len(flat) else pa.py_buffer(b"")])


def in_requests(messages: DataFrame, by: list[str], a_request: int) -> DataFrame:
    """Messages with the number of their ``request``, which has ``a_request`` messages of a ``by`` group at most. Numbers
    go up with ``ord`` and have gaps: each range of (group, ord) counts for itself, so no task sees a group."""
    place = F.monotonically_increasing_id()  # the partition's number, then 33 bits
    dealt = messages.repartitionByRange(*by, "ord").sortWithinPartitions(*by, "ord", *[c for c in messages.columns if c not in (*by, "ord")]).withColumn("request", place)
    last = (1 << 33) - 1
    return dealt.withColumn("request", F.col("request") - F.col("request").bitwiseAND(F.lit(last)) % a_request)


def request_bodies(messages: DataFrame, file: str, group: str, by: list[str], since: str = "") -> DataFrame:
    """Messages (timestamp, dataset, row, column, value, ord) to one binary request for each ``by`` group."""
    one = with_envelopes(messages, "__e")
    grouped = one.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ord", "__e"))).alias("__m"))
    tail = [(n, v.encode()) for n, v in ((2, file), (3, group), (6, since)) if v]
    said = [F.concat(F.lit(bytes([n << 3 | 2])), _varint(F.lit(len(v))), F.lit(v)) for n, v in tail]
    return grouped.select(*by, F.concat(F.arrow_udf(joined, "binary")(F.col("__m.__e")), *said).alias("body"))


ARCHIVE_FILES = ("db.sqlite", "metadata.json")


def archive_files(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """The two known files of each zip archive (by base name, whatever their folder)."""

    def unpack(contents: pa.Array) -> pa.Array:
        out = []
        for raw in contents.to_pylist():
            found = []
            if raw:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    found = [{"name": base, "data": z.read(n)} for n in z.namelist() if (base := n.rpartition("/")[2]) in ARCHIVE_FILES]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("name", pa.string()), ("data", pa.binary())])))

    kept = [c for c in archives.columns if c != content_col]
    parsed = archives.withColumn("__f", F.arrow_udf(unpack, "array<struct<name:string,data:binary>>")(F.col(content_col)))
    return parsed.select(*kept, F.explode("__f").alias("__x")).select(*kept, "__x.*")

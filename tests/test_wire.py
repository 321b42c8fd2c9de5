"""The codec over buffers against the plain one."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests import wire_model as plain

from tallyspark.sources import wire

NAMES = ("timestamp", *wire.MESSAGE_FIELDS)


def decoded(*bodies):
    return wire.decode_responses(pa.array(bodies, pa.binary())).to_pylist()


def body(r, n):
    text = lambda: "".join(r.choices("aé🙂:", k=r.choice([0, 1, 5, 130, 20_000 if r.random() < 0.05 else 3])))
    messages = [plain.encode_envelope(text(), plain.encode_message(text(), text(), text(), text())) for _ in range(n)]
    return plain.encode_request(messages, text(), text(), since=text())


@pytest.mark.parametrize("seed", range(4))
def test_decoding_equals_the_plain_codec(seed):
    r = random.Random(seed)
    bodies = [body(r, n) for n in (0, 1, 2, 300, 5, 0)] + [b""]
    assert decoded(*bodies, None) == [plain.decode_response(b)[0] for b in bodies] + [[]]
    assert wire.decode_responses(pa.array(bodies, pa.binary())[2:5]).to_pylist() == [plain.decode_response(b)[0] for b in bodies[2:5]]


def block(number, kind, raw):
    return plain._varint(number << 3 | kind) + raw


def test_unknown_repeated_and_wide_fields():
    one = plain.encode_message("d", "r", "c", "v")
    odd = block(9, 0, b"\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01") + block(10, 1, b"12345678") + block(11, 5, b"1234") + plain._block(300, b"x" * 200)
    envelope = plain._block(1, b"old") + odd + plain._block(3, one + odd + plain._block(4, b"last")) + plain._block(1, b"new") + block(2, 0, b"\x00")
    raw = odd + plain._block(1, envelope) + plain._block(2, b"merkle") + plain._block(1, plain._block(1, b"t"))
    want = [dict(zip(NAMES, x, strict=True)) for x in (("new", "d", "r", "c", "last"), ("t", "", "", "", ""))]
    assert decoded(raw) == [want] == [plain.decode_response(raw)[0]]


def test_truncated_encrypted_and_random_bytes():
    raw = plain.encode_request([plain.encode_envelope("t1", plain.encode_message("d", "r", "c", "S:é" * 50))], "file", "g")
    refused = 0
    for n in range(len(raw)):
        try:
            want = plain.decode_response(raw[:n])[0]
        except ValueError:
            refused += 1
            with pytest.raises(ValueError):
                decoded(raw[:n])
        else:
            assert decoded(raw[:n]) == [want]
    assert refused > 100
    for bad in (plain.encode_request([plain.encode_envelope("t", b"", True)], "", ""), block(1, 3, b""), block(1, 7, b"x"), plain._block(1, plain._block(1, b"\xff\xfe")), plain._block(1, b"\x0a\xff\xff"), b"\x80" * 11):
        with pytest.raises(ValueError):
            decoded(b"", bad)
    r = random.Random(4)
    for _ in range(3000):
        some = bytes(r.choices([0, 1, 2, 3, 8, 10, 18, 26, 34, 127, 128, 200, 255], k=r.randint(1, 12)))
        try:
            want = plain.decode_response(some)[0]
        except (ValueError, AttributeError, TypeError):
            continue
        assert decoded(some) == [want], some


@pytest.mark.parametrize("seed", range(2))
def test_requests_equal_the_plain_codec(spark, seed):
    r = random.Random(seed)
    text = lambda: r.choice([None, "", "a", "é🙂" * r.randint(1, 90), "x" * r.choice([127, 128, 16_383, 16_384])])
    rows = [(k % 5, k, f"t{k}" * r.choice([1, 60]), text(), text(), text(), text()) for k in range(120)]
    df = spark.createDataFrame(rows, "g int, ord long, timestamp string, dataset string, row string, column string, value string").repartition(3)
    got = {x["g"]: bytes(x["body"]) for x in wire.request_bodies(df, "file", "group", ["g"], since="s").collect()}
    for g in range(5):
        envelopes = [plain.encode_envelope(x[2], plain.encode_message(*[c or "" for c in x[3:]])) for x in rows if x[0] == g]
        assert got[g] == plain.encode_request(envelopes, "file", "group", since="s")


def test_there_and_back_in_spark(spark):
    df = spark.range(500).select(F.lit(1).alias("g"), F.col("id").alias("ord"), F.col("id").cast("string").alias("timestamp"), *[F.concat(F.lit(c), "id").alias(c) for c in wire.MESSAGE_FIELDS])
    back = wire.response_messages(wire.request_bodies(df, "", "", ["g"]))
    assert back.where(F.col("ord").cast("string") != F.col("timestamp")).count() == 0 and back.select(*NAMES).exceptAll(df.select(*NAMES)).count() == 0 and back.count() == 500


def test_large_bodies_are_read_in_parts(monkeypatch):
    """As many bytes at once as PIECE says, whatever the size of a body and the number of bodies (F1, F2)."""
    bodies = [plain.encode_request([plain.encode_envelope(f"t{n}{k}", plain.encode_message("d", "r", "c", "S:" + "x" * (k % 7))) for k in range(n)], "file", "") for n in (0, 3, 400, 1, 90)]
    want, read = [plain.decode_response(b)[0] for b in bodies], []
    monkeypatch.setattr(wire, "PIECE", 200)
    numbers = wire._numbers
    monkeypatch.setattr(wire, "_numbers", lambda data: read.append(len(data)) or numbers(data))
    assert wire.decode_responses(pa.array([*bodies, None], pa.binary())).to_pylist() == [*want, []]
    assert max(read) <= 200 and sum(read) == sum(map(len, bodies))
    with pytest.raises(ValueError):
        decoded(bodies[2][:-1])


def test_a_group_is_sent_in_several_requests(spark):
    df = spark.range(1000).select((F.col("id") % 3 > 0).cast("int").alias("g"), F.col("id").alias("ord"), F.col("id").cast("string").alias("timestamp"), *[F.concat(F.lit(c), "id").alias(c) for c in wire.MESSAGE_FIELDS])
    sent = wire.request_bodies(wire.in_requests(df, ["g"], 40), "", "", ["g", "request"])
    back = wire.response_messages(sent).orderBy("g", "request", "ord").collect()
    for g in (0, 1):
        assert [int(x["timestamp"]) for x in back if x["g"] == g] == [k for k in range(1000) if (k % 3 > 0) == g]
    assert max(x["ord"] for x in back) == 39 and sent.count() >= 25

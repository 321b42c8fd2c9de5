"""The wire format, one message after another: what the codec over buffers is held against."""

MESSAGE_FIELDS = ("dataset", "row", "column", "value")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(number: int, raw: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def fields(raw: bytes):
    """(number, value) of every field; raises ValueError on a truncated message."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while at < end:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7
        raise ValueError("truncated number")

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}.get(kind, -1)
        if size < 0 or at + size > end:
            raise ValueError("truncated or unknown field")
        yield key >> 3, raw[at : at + size]
        at += size


def encode_message(dataset: str, row: str, column: str, value: str) -> bytes:
    return b"".join(_block(k, v.encode()) for k, v in enumerate((dataset, row, column, value), 1) if v)


def decode_message(raw: bytes) -> dict:
    got = {k: v for k, v in fields(raw) if isinstance(v, bytes)}
    return {name: got.get(k, b"").decode() for k, name in enumerate(MESSAGE_FIELDS, 1)}


def encode_envelope(timestamp: str, content: bytes, encrypted: bool = False) -> bytes:
    return _block(1, timestamp.encode()) + (_varint(2 << 3) + b"\x01" if encrypted else b"") + _block(3, content)


def encode_request(envelopes: list[bytes], file: str, group: str, key: str = "", since: str = "") -> bytes:
    return b"".join(_block(1, e) for e in envelopes) + b"".join(_block(n, v.encode()) for n, v in ((2, file), (3, group), (5, key), (6, since)) if v)


def decode_response(raw: bytes) -> tuple[list[dict], str]:
    """Messages with their envelope's timestamp, in order, and the merkle text; encrypted envelopes are an error."""
    messages, merkle = [], ""
    for number, value in fields(raw):
        if number == 1:
            e = dict(fields(value))
            if e.get(2):
                raise ValueError("encrypted messages are not supported")
            messages.append({"timestamp": e.get(1, b"").decode(), **decode_message(e.get(3, b""))})
        elif number == 2:
            merkle = value.decode()
    return messages, merkle

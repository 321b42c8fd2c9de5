"""Keys of a stream dealt into a fixed number of buckets, whose state is one Arrow table each.

Calling Python for every key costs milliseconds a key: frames, and calls to the state store. A bucket's keys are met with
one call, one read and one write; keys that a batch does not name pass by as columns. The number of buckets belongs to
a stream's checkpoint. A task holds one bucket at a time: its keys and its rows of one batch.
"""

from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 1024


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def exact(names: Iterable[str], whole: Iterable[str]) -> list[Column]:
    """Columns for a pandas function: whole numbers as text, which pandas would make floats of beside a null."""
    return [F.col(n).cast("string").alias(n) if n in whole else F.col(n) for n in names]


def records(frames: Iterable[pd.DataFrame], whole: Iterable[str]) -> list[dict]:
    """The rows of all pieces of a bucket's batch, in order of ``feed_ord``, with what ``exact`` made text as numbers."""
    g = pd.concat(list(frames))
    columns = {n: [None if v is None or v is pd.NaT or v != v else int(v) if n in whole else v for v in g[n].tolist()] for n in g.columns}
    rows = [dict(zip(columns, v, strict=True)) for v in zip(*columns.values(), strict=True)]
    return sorted(rows, key=lambda x: (x["feed_ord"] is None, x["feed_ord"] or 0)) if "feed_ord" in columns else rows


def load(held: bytes | None, schema: pa.Schema) -> pa.Table:
    return schema.empty_table() if held is None else pa.ipc.open_stream(held).read_all()


def parted(table: pa.Table, names: Iterable[str]) -> tuple[dict[str, dict], pa.Table]:
    """The states of ``names`` (column ``key``), and those of all other keys."""
    met = pc.is_in(table["key"], pa.array(list(names), pa.string()))
    return {x["key"]: x for x in table.filter(met).to_pylist()}, table.filter(pc.invert(met))


def saved(rest: pa.Table, met: Iterable[dict]) -> bytes:
    out = pa.concat_tables([rest, pa.Table.from_pylist(list(met), rest.schema)]).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(out)
    return sink.getvalue().to_pybytes()

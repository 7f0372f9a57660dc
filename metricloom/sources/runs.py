"""Tables whose rows occur many times over, stored as Parquet with run lengths.

Parquet keeps the values of a page as places in a dictionary, and equal places in a row as one run: a number and how often it stands there. Here the runs are
written as they are known, not found again value by value, so writing costs as much as the different lines and not as the rows. What is stored is an ordinary
Parquet table with every row in it.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from metricloom.sources.heads import opened

#: Rows of a row group, about; a line that occurs more often is cut.
GROUP_ROWS = 1 << 24
#: Spark type: physical type, converted type, Arrow type of its plain values.
TYPES = {
    "tinyint": (1, 15, pa.int32()), "smallint": (1, 16, pa.int32()), "int": (1, None, pa.int32()), "date": (1, 6, pa.int32()), "bigint": (2, None, pa.int64()),
    "timestamp": (2, 10, pa.int64()), "float": (4, None, pa.float32()), "double": (5, None, pa.float64()), "string": (6, 0, pa.binary()), "binary": (6, None, pa.binary()),
}
_I32, _I64, _TEXT, _LIST, _STRUCT = 5, 6, 8, 9, 12
_PLAIN, _RLE, _RLE_DICTIONARY = 0, 3, 8
_SNAPPY = 1


def can_hold(schema: StructType, folder: str) -> bool:
    """Whether all columns are of a type that is written here, and the folder is in a store that pyarrow knows."""
    try:
        opened(folder)
    except (pa.ArrowException, OSError):
        return False
    return all(f.dataType.simpleString() in TYPES for f in schema.fields)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _thrift(*fields: tuple[int, int, object]) -> bytes:
    """A struct of ``(id, type, value)`` in Thrift's compact protocol; lists are ``(type, values)``, and fields without a value are left out."""
    out, last = b"", 0
    for at, kind, value in fields:
        if value is not None:
            out += bytes([(at - last) << 4 | kind]) + _thrift_value(kind, value)
            last = at
    return out + b"\0"


def _thrift_value(kind: int, value) -> bytes:
    if kind in (_I32, _I64):
        return _varint(value << 1)  # never negative here
    if kind == _TEXT:
        return _varint(len(value.encode())) + value.encode()
    if kind == _LIST:
        inner, items = value
        head = bytes([len(items) << 4 | inner]) if len(items) < 15 else bytes([0xF0 | inner]) + _varint(len(items))
        return head + b"".join(_thrift_value(inner, x) for x in items)
    return value


def _runs(times: np.ndarray, values: np.ndarray, width: int) -> bytes:
    """Each value, ``width`` bytes wide, ``times`` times over."""
    head = (times.astype(np.uint64) << np.uint64(1))[:, None] >> (np.arange(5, dtype=np.uint64) * np.uint64(7))
    used = head > 0
    used[:, 0] = True
    more = np.zeros_like(used)
    more[:, :-1] = used[:, 1:]
    body = values.astype(np.uint64)[:, None] >> (np.arange(width, dtype=np.uint64) * np.uint64(8))
    whole = np.concatenate([(head & np.uint64(0x7F)) | (more * np.uint64(0x80)), body & np.uint64(0xFF)], axis=1).astype(np.uint8)
    return whole[np.concatenate([used, np.ones(body.shape, bool)], axis=1)].tobytes()


def _plain(values: pa.Array, kind: pa.DataType) -> bytes:
    if pa.types.is_binary(kind):
        return b"".join(struct.pack("<I", len(v)) + v for v in values.cast(kind).to_pylist())
    same_width = values.type.bit_width == kind.bit_width
    return (values.view(kind) if same_width else values.cast(kind)).to_numpy(zero_copy_only=False).tobytes()


def _page(kind: int, body: bytes, header: tuple[int, int, bytes]) -> tuple[bytes, int]:
    packed = pa.compress(body, codec="snappy", asbytes=True)
    head = _thrift((1, _I32, kind), (2, _I32, len(body)), (3, _I32, len(packed)), header)
    return head + packed, len(head) + len(body)


def _chunk(values: pa.Array, times: np.ndarray, kind: pa.DataType) -> tuple[bytes, bytes, int]:
    """The pages of a column: the dictionary, the runs, and their bytes before packing."""
    rows, held = int(times.sum()), pc.is_valid(values).to_numpy(zero_copy_only=False)
    there = _runs(times, held, 1) if not held.all() else _runs(np.array([rows]), np.array([1]), 1)
    own = values.drop_null()
    bits = max(1, (len(own) - 1).bit_length())
    body = struct.pack("<I", len(there)) + there + bytes([bits]) + _runs(times[held], np.arange(len(own)), -(-bits // 8))
    first, size = _page(2, _plain(own, kind), (7, _STRUCT, _thrift((1, _I32, len(own)), (2, _I32, _PLAIN))))
    second, more = _page(0, body, (5, _STRUCT, _thrift((1, _I32, rows), (2, _I32, _RLE_DICTIONARY), (3, _I32, _RLE), (4, _I32, _RLE))))
    return first, second, size + more


class RunWriter:
    """One Parquet file. ``write`` takes lines and how often each occurs."""

    def __init__(self, stream, names: list[str], kinds: list[str]):
        self.stream, self.names, self.kinds = stream, names, [TYPES[k] for k in kinds]
        self.rows, self.groups = 0, []
        self.at = stream.write(b"PAR1")

    def write(self, columns: list[pa.Array], times: np.ndarray) -> None:
        pieces = np.maximum(1, -(-times // GROUP_ROWS))
        line = np.repeat(np.arange(len(times)), pieces)
        nth = np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        times = np.minimum(times[line] - nth * GROUP_ROWS, GROUP_ROWS)
        begins = np.flatnonzero(np.diff((np.cumsum(times) - times) // GROUP_ROWS, prepend=-1))
        for a, b in zip(begins, [*begins[1:], len(times)]):
            self._group([c.take(pa.array(line[a:b])) for c in columns], times[a:b])

    def _group(self, columns: list[pa.Array], times: np.ndarray) -> None:
        rows, total, chunks = int(times.sum()), 0, []
        for name, (physical, _, kind), values in zip(self.names, self.kinds, columns):
            first, second, size = _chunk(values, times, kind)
            packed, begin = len(first) + len(second), self.at
            self.stream.write(first)
            self.stream.write(second)
            self.at += packed
            meta = _thrift(
                (1, _I32, physical), (2, _LIST, (_I32, [_PLAIN, _RLE, _RLE_DICTIONARY])), (3, _LIST, (_TEXT, [name])), (4, _I32, _SNAPPY), (5, _I64, rows),
                (6, _I64, size), (7, _I64, packed), (9, _I64, begin + len(first)), (11, _I64, begin),
            )
            chunks.append(_thrift((2, _I64, begin), (3, _STRUCT, meta)))
            total += size
        self.rows += rows
        self.groups.append(_thrift((1, _LIST, (_STRUCT, chunks)), (2, _I64, total), (3, _I64, rows)))

    def close(self) -> None:
        root = _thrift((4, _TEXT, "spark_schema"), (5, _I32, len(self.names)))
        leaves = [_thrift((1, _I32, physical), (3, _I32, 1), (4, _TEXT, name), (6, _I32, converted)) for name, (physical, converted, _) in zip(self.names, self.kinds)]
        foot = _thrift((1, _I32, 1), (2, _LIST, (_STRUCT, [root, *leaves])), (3, _I64, self.rows), (4, _LIST, (_STRUCT, self.groups)), (6, _TEXT, "metricloom"))
        self.stream.write(foot + struct.pack("<I", len(foot)) + b"PAR1")
        self.stream.close()


def write_runs(df: DataFrame, schema: StructType, folder: str) -> int:
    """Add the lines of ``df``, each as often as its last column says, to the stored table ``folder`` of ``schema``. The tasks write their files in a hidden
    folder, and those of the tasks that count are moved when all are complete. Returns the rows written."""
    names, kinds = schema.names, [f.dataType.simpleString() for f in schema.fields]
    hidden = f"_runs-{uuid.uuid4().hex[:8]}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system, root = opened(folder)
                system.create_dir(f"{root}/{hidden}", recursive=True)
                name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.snappy.parquet"
                writer = RunWriter(system.open_output_stream(f"{root}/{hidden}/{name}"), names, kinds)
            writer.write(batch.columns[:-1], batch.columns[-1].to_numpy(zero_copy_only=False))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "rows": pa.array([writer.rows], pa.int64())})

    written = df.mapInArrow(write, "file string, rows bigint").collect()  # one row per task
    system, root = opened(folder)
    for r in written:
        system.move(f"{root}/{hidden}/{r['file']}", f"{root}/{r['file']}")
    if written:
        system.delete_dir(f"{root}/{hidden}")
    return sum(r["rows"] for r in written)

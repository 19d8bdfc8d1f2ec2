"""Blocks of documents and questions between them.

A block is a run of consecutive rows of one input split, a few megabytes of text, written once to the
shared folder, so that its id and its order stay the same whatever is computed again later. An operator
that must know whether a key of a document occurs elsewhere sends each distinct key of a block once, packed
(sorted, as differences, zstd), to the part of the key space that owns it, and gets one small code a key back.
A key that a third of all rows share is one entry a block, so no part grows with the size of a group.

The number of parts follows the number of blocks, so a part holds the keys of some PART_BLOCKS blocks at every size, and
each part is one task. A block's keys make one blob a part; with more blocks blobs get smaller, until the shuffle is one
of plain rows. Larger blocks (spark.lumenframe.block.bytes) keep blobs large where executors have the memory: work
arrays are some ten times a block's text. Blocks are bucketed by their id, so only keys and codes are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ._shared import stash
from ._text import release

BLOCK_BYTES = 4 << 20
#: A part of the key space gets the keys of so many blocks' worth of text.
PART_BLOCKS = 4
BLOCK_SCHEMA = "block_id long, payload binary"


def _to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def _cut(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row(tables):
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << 32) | seq], pa.int64()), pa.array([_to_ipc(pa.concat_tables(tables))], pa.binary())],
            names=["block_id", "payload"],
        )

    for batch in batches:
        t = pa.Table.from_batches([batch])
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(t["text"]), 0).to_numpy(), dtype=np.int64) + 8)
        at, done = 0, 0
        while at < t.num_rows:
            upto = max(int(np.searchsorted(ends, done + limit - size, side="right")), at + (not held))
            if upto > at:
                held.append(t.slice(at, upto - at))
                size += int(ends[upto - 1]) - done
                at, done = upto, int(ends[upto - 1])
            if at < t.num_rows or size >= limit:
                yield row(held)
                seq, held, size = seq + 1, [], 0
    if held:
        yield row(held)


def to_blocks(docs: DataFrame, carry: tuple = (), limit: int | None = None) -> DataFrame:
    """(block_id, payload): the ids and whole texts of ``docs``, and columns to ``carry``, in the shared folder."""
    limit = limit or int(docs.sparkSession.conf.get("spark.lumenframe.block.bytes", str(BLOCK_BYTES)))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    return stash(narrow.mapInArrow(lambda it: _cut(it, limit), BLOCK_SCHEMA), by="block_id")


def pack(sorted_keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Sorted 64-bit keys as differences, and columns beside them, by byte planes, compressed."""
    n = len(sorted_keys)
    planes = [np.array([n, len(columns), *[c.dtype.itemsize for c in columns]], dtype=np.int64).tobytes()]
    for c in [np.diff(sorted_keys, prepend=np.zeros(1, sorted_keys.dtype)), *columns]:
        planes.append(np.ascontiguousarray(c.view(np.uint8).reshape(n, c.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, dtypes: list) -> tuple[np.ndarray, list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, k = np.frombuffer(raw, np.int64, 2)
    at = 16 + 8 * int(k)
    out = []
    for dtype in [np.dtype(np.uint64), *map(np.dtype, dtypes)]:
        step = int(n) * dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, step, at).reshape(dtype.itemsize, int(n))
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(-1))
        at += step
    return np.cumsum(out[0], dtype=np.uint64), out[1:]


def squeeze(codes: np.ndarray) -> bytes:
    """Codes as bytes, their width first."""
    wide = np.ascontiguousarray(codes)
    return zstandard.ZstdCompressor(level=1).compress(bytes([wide.dtype.itemsize]) + wide.tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(raw, f"u{raw[0]}", offset=1)


def parts_of(blocks: DataFrame) -> int:
    """How many parts the key space of written blocks has: a power of two."""
    return 1 << max(0, -(-blocks.count() // PART_BLOCKS) - 1).bit_length()


def deal(df: DataFrame, parts: int) -> GroupedData:
    """Groups by ``part``, each a task of its own."""
    return df.repartitionById(parts, F.col("part")).groupBy("part")


def send_keys(blocks: DataFrame, emit: Callable[..., tuple[np.ndarray, list[np.ndarray]]], parts: int, answers: list[str] = ()) -> DataFrame:
    """(part, block_id, blob): the distinct keys of each block, dealt by their leading bits to ``parts`` parts.

    emit(table, *codes of the named ``answers`` columns) gives a block's distinct keys, sorted, and columns beside them.
    """
    shift = np.uint64(64 - parts.bit_length() + 1)
    answers = list(answers)

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block_id")[i].as_py()
                got = [codes_of(batch.column(c)[i].as_py()) for c in answers]
                keys, columns = emit(from_ipc(batch.column("payload")[i].as_py()), *got)
                own = keys >> shift if parts > 1 else np.zeros(len(keys), np.uint64)
                cuts = np.searchsorted(own, np.arange(parts + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(cuts))
                for at in range(0, len(full), 64):
                    some = full[at : at + 64]
                    blobs = [pack(keys[cuts[p] : cuts[p + 1]], [c[cuts[p] : cuts[p + 1]] for c in columns]) for p in some]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "block_id", "blob"])
                del keys, columns, own
                release()

    return blocks.select("block_id", "payload", *answers).mapInArrow(send, "part int, block_id long, blob binary")


def part_of_keys(group: pa.Table, dtypes: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """The keys and columns of one part, block after block, and how many each block sent."""
    got = [unpack(b.as_py(), dtypes) for b in group["blob"]]
    columns = [np.concatenate([c[j] for _, c in got]) for j in range(len(dtypes))]
    return np.concatenate([k for k, _ in got]), columns, [len(k) for k, _ in got]


def answer_keys(sent: DataFrame, decide: Callable[..., np.ndarray], dtypes: list[str], parts: int, name: str = "codes") -> DataFrame:
    """(block_id, ``name``): a code for each key that a block sent; decide(keys, columns) sees one part of the key space."""

    def answer(group: pa.Table) -> pa.Table:
        keys, columns, sizes = part_of_keys(group, dtypes)
        codes = decide(keys, columns)
        cuts = np.cumsum([0, *sizes])
        out = pa.table({"block_id": group["block_id"], "part": group["part"], "blob": pa.array([squeeze(codes[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())})
        release()
        return out

    return by_block(deal(sent, parts).applyInArrow(answer, "block_id long, part int, blob binary"), name)


def by_block(replies: DataFrame, name: str) -> DataFrame:
    """(block_id, ``name``): the blobs of each block, by part, in the shared folder."""
    own = replies.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("part", "blob"))).alias(name))
    return stash(own.select("block_id", F.col(f"{name}.blob").alias(name)))


def ask(blocks: DataFrame, emit: Callable, decide: Callable, dtypes: list[str], parts: int, answers: list[str] = (), name: str = "codes") -> DataFrame:
    """What each block learns about its keys: answer_keys of send_keys."""
    return answer_keys(send_keys(blocks, emit, parts, answers), decide, dtypes, parts, name)


def codes_of(blobs: list[bytes] | None) -> np.ndarray:
    """The codes of a block's entries, in the order in which it sent them."""
    return np.concatenate([unsqueeze(b) for b in blobs]) if blobs else np.zeros(0, np.uint8)


def with_answers(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Answers grow with the blocks: always by a shuffled join, never by a broadcast that small tables would get."""
    for a in answers:
        blocks = blocks.join(a.hint("merge"), "block_id", "left")
    return blocks


def finish(blocks: DataFrame, make: Callable[..., pa.RecordBatch], schema: str, answers: list[str]) -> DataFrame:
    """One call of make(table, *codes) a block; its record batches are the result."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield make(from_ipc(batch.column("payload")[i].as_py()), *[codes_of(batch.column(c)[i].as_py()) for c in answers])
                release()

    return blocks.select("payload", *answers).mapInArrow(run, schema)


def distinct(keys: np.ndarray, *order: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, group): index of the first entry by ``order`` of each distinct key, keys ascending; the group of each entry.

    also: a second half of the keys.
    """
    more = () if also is None else (also,)
    by = np.lexsort((*order[::-1], *more, keys)) if order or more else np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[by][1:] != keys[by][:-1]
    for other in more:
        new[1:] |= other[by][1:] != other[by][:-1]
    group = np.empty(len(keys), dtype=np.int64)
    group[by] = np.cumsum(new) - 1
    return by[new], group


#: An id for rows whose doc_id is null: after all others.
NO_ID = np.iinfo(np.int64).max


def ids_of(table: pa.Table) -> np.ndarray:
    return np.asarray(pc.fill_null(table["doc_id"], NO_ID).to_numpy(), dtype=np.int64)

"""Harmonic packing of documents into token sequences of a fixed capacity.

Class ``j`` of capacity C holds pieces of at most C/j tokens and fills each of
its sequences with exactly j of them. Whatever a document has in whole
capacities is class 1. The rest goes to the class of its length if that wastes
no more than ``slack`` of a sequence; otherwise it is cut to the size of the
next class, which fills a sequence of that class to the brim, and what remains
goes on the same way. So a rest takes three pieces or fewer in most cases.

Workers fill their bins independently: each holds one open sequence a class,
whose pieces are counted, not searched for, and reports it when it is full.
Nothing is shuffled. At the end of a partition the pieces in open sequences are
laid end to end and cut at each capacity; of what is left over, the largest
powers of two become sequences of their own, which need no padding.

A worker holds the open sequences (a hundred classes or so, at most one
sequence each) and the ids of the document at hand. A lost executor's partitions
are packed again to the same rows, since they depend on the partition's rows in
their order and on its number only.

Defined cases: a null text is empty and yields the end id only; null and
repeated ids stay documents of their own; a text of any length is cut into as
many pieces as it takes; an empty table gives no pieces. Extra columns are left
aside.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import new_path, released, text_batches
from tabulon.llm.token_files import batch_slices, cached_encoder

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TYPES = (*(pa.int64(),) * 7, pa.binary())
_NAMES = (*(part.split()[0] for part in PIECE_SCHEMA.split(", ")), "ids")


def classes_of(n: int, capacity: int, slack: float) -> list[tuple[int, int]]:
    """How ``n`` tokens are cut: (length, pieces in a sequence of that class), in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        if capacity - j * rest <= slack * capacity:
            return [*out, (rest, j)]
        size = capacity // (j + 1)
        out.append((size, j + 1))
        rest -= size
    return out


def padding(length: int, capacity: int) -> int:
    """What a sequence of ``length`` tokens is padded by: nothing at a power of two."""
    return 0 if length & (length - 1) == 0 else capacity - length


Piece = tuple[int | None, int, int, bytes]  # doc_id, start, doc_tokens, ids (4 bytes each)


class Bins:
    """One worker's open sequences; gives each as a list of pieces once it is full."""

    def __init__(self, capacity: int, slack: float):
        self.capacity, self.slack = capacity, slack
        self.open: dict[int, list[Piece]] = {}

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[Piece]]:
        n, start = len(ids) // 4, 0
        for length, j in classes_of(n, self.capacity, self.slack):
            held = self.open.setdefault(j, [])
            held.append((doc_id, start, n, ids[4 * start : 4 * (start + length)]))
            start += length
            if len(held) == j:
                yield self.open.pop(j)

    def close(self) -> Iterator[list[Piece]]:
        """Open sequences end to end, cut at each capacity, then at powers of two."""
        left = [p for _, held in sorted(self.open.items()) for p in held]
        self.open = {}
        total = sum(len(p[3]) for p in left) // 4
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << k for k in reversed(range(self.capacity.bit_length())) if (total % self.capacity) >> k & 1]
        left.reverse()
        for room in sizes:
            sequence = []
            while room:
                doc_id, start, n, ids = left.pop()
                take = min(room, len(ids) // 4)
                sequence.append((doc_id, start, n, ids[: 4 * take]))
                if 4 * take < len(ids):
                    left.append((doc_id, start + take, n, ids[4 * take :]))
                room -= take
            yield sequence


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int | None = 0,
    slack: float = 1 / 32,
    with_ids: bool = True,
    make_encoder: Callable[[str], Callable[[pa.Array], list[bytes]]] = cached_encoder,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and their places: ``PIECE_SCHEMA``, and ``ids`` if asked for.

    ``ids`` holds little-endian unsigned 32-bit integers. Pieces of a sequence are
    neighbours, in the order of ``offset``; sequence ids are unique over all workers.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    end = b"" if end_id is None else struct.pack("<I", end_id)
    width = len(_NAMES) - (not with_ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = make_encoder(tokenizer_path), Bins(capacity, slack)
        made = TaskContext.get().partitionId() << 33

        def batch_of(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal made
            out = []
            for sequence in sequences:
                offset = 0
                for doc_id, start, n, ids in sequence:
                    out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, made, offset, ids)[:width])
                    offset += len(ids) // 4
                made += 1
            cols = zip(*out, strict=True) if out else [()] * width
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=False)], list(_NAMES[:width]))

        for part in batch_slices(released(batches), column=1):
            full = [s for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True) for s in bins.add(doc_id, ids + end)]
            yield batch_of(full)
        yield batch_of(list(bins.close()))

    return text_batches(rows).mapInArrow(pack, PIECE_SCHEMA + ", ids binary" * with_ids)


def write_sequences(pieces: DataFrame, out: str | None = None) -> DataFrame:
    """Write the packed pieces with their ids as Parquet; each file holds whole sequences in order."""
    out = out or new_path(pieces.sparkSession, "sequences")
    pieces.write.option("compression", "zstd").parquet(out)
    return pieces.sparkSession.read.schema(pieces.schema).parquet(out)


def packing_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The contract's query: each piece of each document with its sequence and place there."""
    return pack_documents(docs, tokenizer_path, with_ids=False)

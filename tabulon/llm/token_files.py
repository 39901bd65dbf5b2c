"""Token-id files: independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames followed by two skippable frames::

    data frame 0 .. n-1    ids of whole documents, little-endian uint32
    skippable frame        document index: (doc_id int64, 1 if it is null uint8,
                           frame uint32, first id within the frame uint64,
                           ids uint64)
    skippable frame        seek table of the public seekable format: for each
                           frame compressed size, size, low 32 bits of XXH64;
                           then frame count, descriptor byte, magic number

Any zstandard decoder reads the whole file. A reader that wants single
documents takes the seek table and the index from the end, then fetches and
decompresses only the frames that hold them; each frame's checksum is tested.

Documents are split over files by ranges of the id, so files and the rows in
them ascend. Ranges come from a quantile summary of the id column alone. Files
are written under a name of their own and moved into place when complete, so
a repeated task replaces the same bytes. Paths are URIs of any store that
pyarrow reaches.

Defined cases: a null text is an empty text and yields the end id only; a null
id sorts first and is read back as null; repeated ids
stay separate documents, ordered by text; a document longer than a frame gets a
frame of its own; an empty table gives no files and an empty report.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.common import new_path, released, text_batches

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

INDEX_ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("first", "<u8"), ("n", "<u8")])

FILES_SCHEMA = "file string, part int, docs long, tokens long, bytes long, frames int"


# ---------------------------------------------------------------- encoding

#: A cut before such a space could part a run of white space.
_UNSAFE = re.compile(r"\s \s|\s \Z")
#: Pieces that begin or end with white space, are empty, or hold the mark that cuts are made by.
_ALONE = r"^$|^\s|\s$|\x00"
#: Where a piece is cut further: before the punctuation that ends a word, before single line breaks.
_CUTS = ((r"(\p{L})([.,;:!?]+)(\n|$)", "\\1\x00\\2\\3"), (r"([^\s\x00])\n([^\s])", "\\1\x00\n\\2"))

Coded = tuple[np.ndarray, np.ndarray]  # ids of all rows, one after the other, and how many each row has


def _gather(which: np.ndarray, bounds: np.ndarray, coded: Coded) -> Coded:
    """Rows made of the coded ones ``which``, those between two ``bounds`` each."""
    ids, sizes = coded
    starts, lengths = (np.cumsum(sizes) - sizes)[which], sizes[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)], np.diff(np.concatenate([[0], ends])[bounds])


class Remembered:
    """Strings with their ids, ``most`` at most; then those that were asked for last stay."""

    def __init__(self, encode: Callable[[pa.Array], Coded], most: int):
        self.encode, self.most = encode, most
        self.known: dict[str, int] = {}
        self.coded: Coded = (np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))

    def places(self, strings: pa.Array) -> np.ndarray:
        """Where the distinct ``strings`` stand, after the new ones were encoded."""
        names = strings.to_pylist()
        out = np.array([self.known.get(x, -1) for x in names], dtype=np.int64)
        new = out < 0
        if len(self.known) + new.sum() > self.most:
            kept = out[~new]
            self.coded = _gather(kept, np.arange(len(kept) + 1), self.coded)
            out[~new] = np.arange(len(kept))
            self.known = {x: k for x, k in zip(names, out.tolist(), strict=True) if k >= 0}
        if new.any():
            out[new] = first = len(self.known) + np.arange(new.sum())
            added = strings.filter(pa.array(new))
            self.coded = tuple(np.concatenate(x) for x in zip(self.coded, self.encode(added), strict=True))
            self.known.update(zip(added.to_pylist(), first.tolist(), strict=True))
        return out


class DistinctEncoder:
    """Whole-text encoding with the tokenizers library, once for each distinct word of some texts.

    The byte-level pre-tokenizer of the vocabulary never joins a space to what
    stands before it unless both are white space, so a text may be cut before
    each single space and the ids of the pieces joined. Pieces are cut further
    before the punctuation that ends a word and before single line breaks, where
    the pre-tokenizer cuts as well. The distinct new words, each after its space
    or line break, make one line; the library encodes it in one call, and the ids
    of each word are told apart by the bytes that they stand for. Words are
    remembered, within a bound. Nearly all of it is done on arrays. Texts with a run
    of white space that a cut could part, or with the string of an added token, go
    to the library whole. The result equals ``encode`` on every text (tested).

    Strings of the vocabulary's special tokens get those tokens' ids, as in the
    library's plain call; with ``special=False`` they are ordinary text.
    """

    def __init__(self, path: str, special: bool = True, max_words: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole_only = [t.content for t in added if special or not t.special]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, k in vocab.items():
            self.width[k] = len(token)  # one character stands for one byte
        self.words = Remembered(self._word_ids, max_words)

    def whole(self, texts: list[str]) -> Coded:
        found = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype="<u4"), *found]), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def _piece_ids(self, pieces: pa.Array) -> Coded:
        """Ids of pieces after a space; none is empty, or begins or ends with white space."""
        cut = pc.binary_join_element_wise("", pieces, " ")
        for pattern, marked in _CUTS:
            cut = pc.replace_substring_regex(cut, pattern, marked)
        parts = pc.split_pattern(cut, "\0")
        words = parts.values.dictionary_encode()
        return _gather(self.words.places(words.dictionary)[words.indices.to_numpy()], parts.offsets.to_numpy(), self.words.coded)

    def _word_ids(self, words: pa.Array) -> Coded:
        """Ids of words after their space or line break, and of punctuation."""
        led = pc.match_substring_regex(words, r"^\s").to_numpy(zero_copy_only=False)
        line, marks = words.filter(pa.array(led)), words.filter(pa.array(~led))
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(line.to_pylist())], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum(pc.binary_length(line).to_numpy())
        sizes = np.diff(np.searchsorted(np.cumsum(self.width[ids]), ends) + 1, prepend=0)
        others = self.whole(marks.to_pylist())
        order = np.empty(len(words), dtype=np.int64)
        order[led], order[~led] = np.arange(len(line)), len(line) + np.arange(len(marks))
        return _gather(order, np.arange(len(words) + 1), (np.concatenate([ids, others[0]]), np.concatenate([sizes, others[1]])))

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        unsafe = np.array([_UNSAFE.search(t) is not None for t in texts.to_pylist()], dtype=bool)
        for mark in self.whole_only:
            unsafe |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for k in np.flatnonzero(unsafe).tolist():
            out[k] = self.whole([texts[k].as_py()])[0].tobytes()
        rows = np.flatnonzero(~unsafe)
        if not len(rows):
            return out
        parts = pc.split_pattern(texts.take(pa.array(rows)), " ")
        bounds = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        which, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        # Three kinds of pieces, numbered one after the other: those cut into words, those alone, and first ones.
        alone = pc.match_substring_regex(pieces, _ALONE).to_numpy(zero_copy_only=False)
        place = np.empty(len(pieces), dtype=np.int64)
        place[~alone] = np.arange(len(pieces) - alone.sum())
        known = self._piece_ids(pieces.filter(pa.array(~alone)))
        place[alone] = len(known[1]) + np.arange(alone.sum())
        firsts = pieces.take(pa.array(which[bounds[:-1]])).to_pylist()  # no space before them
        other = self.whole([" " + p for p in pieces.filter(pa.array(alone)).to_pylist()] + firsts)
        which = place[which]
        which[bounds[:-1]] = len(known[1]) + alone.sum() + np.arange(len(rows))
        ids, sizes = _gather(which, bounds, (np.concatenate([known[0], other[0]]), np.concatenate([known[1], other[1]])))
        ends = np.cumsum(sizes)
        for k, a, b in zip(rows.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            out[k] = ids[a:b].tobytes()
        return out


@cache
def cached_encoder(path: str) -> DistinctEncoder:
    """One encoder for all tasks of a Python worker."""
    return DistinctEncoder(path)


# ---------------------------------------------------------------- one file


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class FrameFile:
    """Writes one file; a document never spans frames."""

    def __init__(self, out, frame_bytes: int, level: int):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.buffer, self.held, self.table, self.index = [], 0, [], []
        self.size = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held + len(ids) > self.frame_bytes:
            self.flush()
        self.index.append((doc_id or 0, doc_id is None, len(self.table), self.held // 4, len(ids) // 4))
        self.buffer.append(ids)
        self.held += len(ids)
        self.tokens += len(ids) // 4

    def flush(self) -> None:
        import xxhash

        raw = b"".join(self.buffer)
        frame = self.zstd.compress(raw)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.out.write(frame)
        self.size += len(frame)
        self.buffer, self.held = [], 0

    def finish(self) -> None:
        if self.index and self.index[-1][2] == len(self.table):
            self.flush()
        index = _skippable(INDEX_MAGIC, np.array(self.index, dtype=INDEX_ENTRY).tobytes())
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        seek = _skippable(SKIPPABLE_MAGIC, rows + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC))
        self.out.write(index)
        self.out.write(seek)
        self.size += len(index) + len(seek)


class FrameReader:
    """Random access to one file given as a seekable binary stream."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.zstd = stream, zstandard.ZstdDecompressor()
        end = stream.seek(0, 2)
        stream.seek(end - 9)
        count, flag, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        at = end - 9 - 12 * count - 8
        stream.seek(at)
        if struct.unpack("<II", stream.read(8)) != (SKIPPABLE_MAGIC, 12 * count + 9):
            raise ValueError("the seek table's frame is damaged")
        self.table = np.frombuffer(stream.read(12 * count), dtype="<u4").reshape(count, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        stream.seek(int(self.starts[-1]))
        magic, size = struct.unpack("<II", stream.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError("the document index is missing")
        self.index = np.frombuffer(stream.read(size), dtype=INDEX_ENTRY)

    def frame(self, k: int) -> bytes:
        import xxhash

        packed, size, check = (int(x) for x in self.table[k])
        self.stream.seek(int(self.starts[k]))
        raw = self.zstd.decompress(self.stream.read(packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        return raw

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document; decompresses one frame."""
        e = self.index[k]
        return np.frombuffer(self.frame(int(e["frame"])), dtype="<u4")[int(e["first"]) : int(e["first"] + e["n"])]


def batch_slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, chars: int = 8 << 20, column: int = 2) -> Iterator[pa.RecordBatch]:
    """Parts of ``rows`` rows; of fewer, down to one, where a part has over ``chars`` bytes of text in ``column``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if rows > 1 and pc.sum(pc.binary_length(part.column(column))).as_py() > chars:
                yield from batch_slices(iter([part]), -(-rows // 8), chars, column)
            else:
                yield part


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- tables


def _id_bounds(docs: DataFrame, files: int) -> list[int]:
    if files < 2:
        return []
    shares = [k / files for k in range(1, files)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * files)).alias("b")).first()["b"]
    return sorted(set(found or []))


def write_token_files(
    docs: DataFrame,
    out: str,
    tokenizer_path: str,
    end_id: int | None = 0,
    files: int = 16,
    frame_bytes: int = 1 << 20,
    level: int = 3,
    make_encoder: Callable[[str], Callable[[pa.Array], list[bytes]]] = cached_encoder,
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write about ``files`` token files under ``out``.

    Returns one row per file. Each task writes the ranges dealt to it, reading
    rows one batch at a time; it holds one frame and the file's index.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = _id_bounds(rows, files)
    part = F.lit(0)
    for half in _halves(bounds, 0):
        part = half
    rows = rows.select(F.when(F.col("doc_id").isNull(), 0).otherwise(part).cast("int").alias("part"), "doc_id", "text")
    rows = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "text")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, stream, now, names = make_encoder(tokenizer_path), None, None, None, None
        store, root = _open(out)
        store.create_dir(root, recursive=True)

        def close() -> pa.RecordBatch:
            file.finish()
            stream.close()
            store.move(*names)
            return pa.RecordBatch.from_pydict(
                {"file": [f"{out}/{names[1].rpartition('/')[2]}"], "part": [now], "docs": [len(file.index)], "tokens": [file.tokens], "bytes": [file.size], "frames": [len(file.table)]},
                schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("frames", pa.int32())]),
            )

        for batch in batch_slices(released(batches)):
            coded = encode(batch.column(2))
            for k, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), coded, strict=True):
                if k != now:
                    if file:
                        yield close()
                    now = k
                    names = f"{root}/.part-{k:06d}-{os.urandom(8).hex()}", f"{root}/part-{k:06d}.tok.zst"
                    stream = store.open_output_stream(names[0])
                    file = FrameFile(stream, frame_bytes, level)
                file.add(doc_id, ids + end)
        if file:
            yield close()

    listed = text_batches(rows).mapInArrow(write, FILES_SCHEMA)
    listed.write.parquet(f"{out}/_files")
    return docs.sparkSession.read.schema(FILES_SCHEMA).parquet(f"{out}/_files")


def _halves(bounds: list[int], base: int):
    """The number of bounds below an id, as nested conditions of logarithmic depth."""
    if not bounds:
        yield F.lit(base)
        return
    mid = len(bounds) // 2
    (low,) = _halves(bounds[:mid], base)
    (high,) = _halves(bounds[mid + 1 :], base + mid + 1)
    yield F.when(F.col("doc_id") <= bounds[mid], low).otherwise(high)


def read_token_files(files: DataFrame, with_ids: bool = False, spread: int | None = None) -> DataFrame:
    """Documents of the listed files: doc_id, file, part, nth, n_tokens, ids_crc32 (and ids).

    The unit of work is a frame: rows (file, frame) are dealt to the tasks, and
    each decompresses only its own frames.
    """
    spread = spread or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frames = files.select("file", "part", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame"))
    frames = frames.repartition(spread, "file", F.floor(F.col("frame") / 16)).sortWithinPartitions("file", "frame")
    schema = "doc_id long, file string, part int, nth long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, reader, stream = None, None, None
        for batch in batches:
            for file, part, frame in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if file != opened:
                    if stream:
                        stream.close()
                    store, path = _open(file)
                    stream = store.open_input_file(path)
                    reader, opened = FrameReader(stream), file
                raw = reader.frame(frame)
                lo, hi = np.searchsorted(reader.index["frame"], [frame, frame + 1])
                rows = reader.index[lo:hi]
                cuts = [raw[4 * int(e["first"]) : 4 * int(e["first"] + e["n"])] for e in rows]
                cols = [
                    pa.array(rows["doc_id"], mask=rows["null"] == 1),
                    pa.array([file] * len(rows)),
                    pa.array([part] * len(rows), pa.int32()),
                    pa.array(np.arange(lo, hi, dtype=np.int64)),
                    pa.array(rows["n"].astype(np.int64)),
                    pa.array([zlib.crc32(x) for x in cuts], pa.int64()),
                ]
                names = ["doc_id", "file", "part", "nth", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int64) for x in cuts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        if stream:
            stream.close()

    return frames.mapInArrow(read, schema)


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents before each one, over all files.

    The file offsets are a running sum over the list of files; within a file a
    running sum over its documents. Their number in a file is bounded by the
    number of files (``MOST_DOCS``), so no window grows with the corpus.
    """
    offsets = files.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    before = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return rows.join(offsets, "part").withColumn("start", F.col("offset") + F.col("before")).drop("offset", "before")


#: Documents in a file, about: bounds a file's index to some 28 MB.
MOST_DOCS = 1_000_000


def token_report(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, out: str | None = None, files: int | None = None) -> DataFrame:
    """Write token files for ``docs`` and report every document as read back from them.

    Unless told otherwise there is a file for each shuffle partition, and more
    where those would hold over ``MOST_DOCS`` documents each.
    """
    spark: SparkSession = docs.sparkSession
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // MOST_DOCS))
    listed = write_token_files(docs, out or new_path(spark, "tokens"), tokenizer_path, end_id, files)
    rows = with_starts(read_token_files(listed), listed)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "nth")

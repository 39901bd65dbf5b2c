"""Trie of the prefixes that conversations share, from vertical bitmaps.

A shard is a run of conversations by id. It indexes (position, turn) to the
bitset of its conversations that hold this turn there; the walk goes down from
the shard's whole bitset, and a bitset and a posting intersect to a child. The
bits set count its members, those of conversations as long as the node is deep
give its end list. Once one conversation is left its other turns follow without
bitsets.

Nodes of all shards then meet by the digest of their prefix: a node that all
conversations share has one row a shard, however many conversations pass it.
Sums over subtrees need no walk over the whole trie. A node's smallest member
lies in one shard, which holds all nodes above as well; the node counts there
only, each shard sums the counted nodes in its own walk's order, and sums of
equal nodes are added.

Turns are told apart by 128-bit digests of role and text, prefixes by digests
of the turns' digests. A shard holds at most ``shard_convs`` conversations and
about ``shard_turns`` turns, as 16-byte digests; one conversation is never cut,
so the longest one bounds a task's memory.

Defined cases: a null role or text is empty; turns with the same number are
ordered by their digests, and a repeated row is a turn of its own; rows without
a conversation id belong to none. A conversation without turns is a member of
the root. An empty table has no nodes. Extra columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import stage

ROOT = bytes(16)
LOCAL_SCHEMA = "shard long, pre int, fin int, key binary, parent binary, depth int, conv_id long, n long, chars int, first_end long, ends binary"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_FIELDS = [(name, _ARROW[kind]) for name, kind in (part.split() for part in LOCAL_SCHEMA.split(", "))]


# ---------------------------------------------------------------- turns


def digested_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, chars``: turns in their order, without their texts."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).alias("chars"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("conv_id", (place - 1).alias("pos"), "digest", "chars")


def with_all(turns: DataFrame) -> DataFrame:
    """A row without a turn before each conversation's own, so that turnless ones show."""
    marks = turns.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("chars"))
    return marks.unionByName(turns)


def rebuilt(turns: DataFrame, base: Column, head: Column) -> DataFrame:
    """Each conversation with its first ``head`` turns replaced by those of conversation ``base``.

    Both are expressions of ``conv_id``. Positions keep the order; they may have gaps.
    """
    convs = turns.select("conv_id").distinct().withColumns({"base": base, "head": head})
    own = turns.withColumn("head", head).filter(F.col("pos") >= F.col("head")).drop("head")
    first = turns.select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    lent = convs.join(first, "base").filter(F.col("pos") < F.col("head")).select("conv_id", "pos", "digest", "chars")
    marks = convs.select("conv_id", F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("chars"))
    return marks.unionByName(lent).unionByName(own)


# ---------------------------------------------------------------- one shard


def shard_nodes(convs: list[int], turns: list[list[bytes]], chars: list[list[int]]) -> list[tuple]:
    """Nodes of one shard in preorder: pre, fin, key, parent, depth, conv_id, n, chars, ends.

    ``convs`` ascend; a node's subtree is the run from ``pre`` to before ``fin``.
    """
    members: dict[tuple[int, bytes], list[int]] = defaultdict(list)
    ended: dict[int, int] = defaultdict(int)
    for i, seq in enumerate(turns):
        ended[len(seq)] |= 1 << i
        for place, turn in enumerate(seq):
            members[place, turn].append(i)
    postings = {}
    for at, held in members.items():
        if len(held) > 1:
            bits = np.zeros(held[-1] + 1, dtype=np.uint8)
            bits[held] = 1
            postings[at] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    nodes: list[tuple] = []
    stack = [((1 << len(convs)) - 1, 0, ROOT, None, 0)]
    while stack:
        bits, depth, key, parent, size = stack.pop()
        if not bits & (bits - 1):  # one conversation is left
            i = bits.bit_length() - 1
            seq, sizes = turns[i], chars[i]
            while depth < len(seq):
                nodes.append((key, parent, depth, convs[i], 1, size, []))
                parent, key, size, depth = key, hashlib.md5(key + seq[depth]).digest(), sizes[depth], depth + 1
            nodes.append((key, parent, depth, convs[i], 1, size, [convs[i]]))
            continue
        here = bits & ended.get(depth, 0)
        ends, rest = _numbers(here, convs), bits & ~here
        nodes.append((key, parent, depth, convs[_lowest(bits)], bits.bit_count(), size, ends))
        below = []
        while rest:
            i = _lowest(rest)
            turn = turns[i][depth]
            child = bits & postings.get((depth, turn), 1 << i)
            rest &= ~child
            below.append((child, depth + 1, hashlib.md5(key + turn).digest(), key, chars[i][depth]))
        stack += reversed(below)

    fin, open_nodes = [len(nodes)] * len(nodes), []
    for k, node in enumerate(nodes):
        while open_nodes and nodes[open_nodes[-1]][2] >= node[2]:
            fin[open_nodes.pop()] = k
        open_nodes.append(k)
    return [(k, fin[k], *node) for k, node in enumerate(nodes)]


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _numbers(bits: int, convs: list[int]) -> list[int]:
    if not bits:
        return []
    raw = np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), dtype=np.uint8)
    return [convs[i] for i in np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()]


def local_tries(rows: DataFrame, shard_convs: int, shard_turns: int, parts: int) -> DataFrame:
    """``rows`` (conv_id, pos, digest, chars; a row without digest for each conversation) as nodes of shards."""
    rows = rows.repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id", "pos")
    rows = rows.select(F.spark_partition_id().alias("part"), "conv_id", "digest", "chars")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, turns, chars, held, made, part = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            cols: list[list] = [[] for _ in _FIELDS]
            for *node, ends in shard_nodes(convs, turns, chars):
                for col, value in zip(cols, [(part << 32) + made, *node, ends[0] if ends else None, np.array(ends, dtype="<i8").tobytes()], strict=True):
                    col.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], [n for n, _ in _FIELDS])

        for batch in batches:
            for part_now, conv, digest, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = part_now
                if not convs or conv != convs[-1]:
                    if len(convs) >= shard_convs or held >= shard_turns:
                        yield close()
                        convs, turns, chars, held, made = [], [], [], 0, made + 1
                    convs.append(conv)
                    turns.append([])
                    chars.append([])
                if digest is not None:
                    turns[-1].append(digest)
                    chars[-1].append(size)
                    held += 1
        if convs:
            yield close()

    return rows.mapInArrow(build, LOCAL_SCHEMA)


# ---------------------------------------------------------------- all shards


def _subtree_sums(local: DataFrame, values: DataFrame) -> DataFrame:
    """``key, n_leaves, saved_tokens``: sums of each node's values over its subtree.

    ``values`` (key, conv_id, leaf, saved) counts in the shard of the smallest member.
    """
    rows = local.select("shard", "pre", "fin", "key", F.col("conv_id").alias("here")).join(values, "key")
    owned = F.col("here") == F.col("conv_id")
    rows = rows.select("shard", "pre", "fin", "key", *[F.when(owned, F.col(c)).otherwise(0).cast("long").alias(c) for c in ("leaf", "saved")])

    def sums(t: pa.Table) -> pa.Table:
        order = np.argsort(t["pre"].to_numpy())
        fin, out = t["fin"].to_numpy()[order], {"key": t["key"].take(pa.array(order))}
        for name in ("leaf", "saved"):
            before = np.concatenate([[0], np.cumsum(t[name].to_numpy()[order])])
            out[name] = pa.array(before[fin] - before[:-1])
        return pa.table(out)

    found = rows.groupBy("shard").applyInArrow(sums, "key binary, leaf long, saved long")
    return found.groupBy("key").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _end_digests(local: DataFrame) -> DataFrame:
    """``key, ends_sha256``: lists are hashed shard by shard as they come; none is held whole."""
    lists = local.filter(F.col("first_end").isNotNull()).select("key", "first_end", "ends")
    lists = lists.repartition(F.col("key")).sortWithinPartitions("key", "first_end").select("key", "ends")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for key, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = ",".join(map(str, np.frombuffer(ends, dtype="<i8").tolist())).encode()
                if key == now:
                    state.update(b"," + text)
                else:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(text)
            yield _digests(done)
        if now is not None:
            yield _digests([(now, state.hexdigest())])

    return lists.mapInArrow(hashed, "key binary, ends_sha256 string")


def _digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "ends_sha256"])


def prefix_trie(rows: DataFrame, shard_convs: int = 4096, shard_turns: int = 65536) -> DataFrame:
    """All nodes of the trie of ``rows`` (see ``local_tries``), with the digest of the prefix as ``key``.

    Columns: key, parent, conv_id (smallest member), parent_conv_id, depth, n_convs,
    n_children, n_leaves, saved_tokens (over the subtree: characters of the last turn that
    members beyond the first need not read again), ends_sha256.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = stage(local_tries(rows, shard_convs, shard_turns, parts), "tries")
    nodes = local.groupBy("key").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").cast("long").alias("depth"), F.sum("n").alias("n_convs"), F.max("chars").alias("chars"))
    nodes = stage(nodes, "nodes")
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    values = nodes.select("key", "conv_id", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(_subtree_sums(local, values), "key").join(_end_digests(local), "key", "left").join(parents, "parent", "left")
    none = F.sha2(F.lit(""), 256)
    return out.select("key", "parent", "conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are."""
    return prefix_trie(with_all(stage(digested_turns(conversations), "turns")))


def trie_report(conversations: DataFrame) -> DataFrame:
    """The contract's query: conversations are rebuilt to share the first turns of their hundred's first."""
    c = F.col("conv_id")
    turns = stage(digested_turns(conversations), "turns")
    rows = rebuilt(turns, c - c % 100, F.crc32(c.cast("string")) % 6)
    return prefix_trie(rows).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

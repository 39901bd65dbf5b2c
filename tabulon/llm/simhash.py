"""SimHash near-duplicates by Golay-code fuzzy hashing.

Every text gets a 64-bit SimHash of its word shingles. Equal fingerprints are
one node. Nodes that differ in one or two bits are found without comparing all:

* A fingerprint is cut into three segments of 22, 21 and 21 bits. Of any two
  errors, at least one segment is free, and with segment ``i`` taken as exact
  and ``i + 1`` (cyclic) as fuzzy, some ``i`` has no error in the exact and at
  most one in the fuzzy segment.
* The fuzzy segment, padded to 23 bits, is decoded with the perfect binary
  Golay code. Its keys are the codewords within distance 4: the nearest one,
  and where that is 3 bits off, five more. Two words that differ in one bit
  share at least one key.
* Rows that share (``i``, exact segment, codeword) are candidates; the join
  condition verifies the distance.

A bucket with more than ``bucket_limit`` distinct fingerprints is not paired.
Its members go another exact way: each emits its 65 words at distance 0 or 1,
and two fingerprints differ in at most two bits exactly if they share such a
word. All that share one are linked to the least of them, which gives the same
components from rows that grow linearly with the members.

Two bits of 64 are few: texts that share 0.8 of their shingles differ in about
ten, and a distance only estimates that share. For a given similarity there is
``similar_nodes``: the Golay keys find the closest texts, and keys of min-wise
hashes, of which two texts at 0.8 share at least one with a probability of
1 - 3e-6, the others. Within a bucket of a large group, pairs are found by the
rarest shingles in which texts depart from the group's centre, so that texts
just below the share are not paired. The distinct shingles of both decide about every pair so
found, so none is linked in error.

Components come from repeated min-label steps over the links with pointer
jumping; each round is written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; a text of fewer words than a shingle is one shingle; repeated rows
and ids stay rows; null ids are kept and never name a component unless a
component has no other id; an empty table gives an empty result. Extra columns
are ignored by the report and kept by the stage. The stage tells rows apart by
id and text, so different texts under one id, or under none, are all kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import broadcast_if_small, drop_stage, free_name, released, stage, text_batches

#: Start and width of the segments of a fingerprint, from the lowest bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 2

# Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0xC75


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``words`` words, A-Z lower-cased."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 42)], dtype=np.uint64)
    line = b" ".join(parts)
    ends = (np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))) + np.arange(len(parts))).tolist()
    starts = [0, *(e + 1 for e in ends[: len(parts) - words])]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=True)]), dtype=">u8").astype(np.uint64)


def vote(h: np.ndarray) -> int:
    """SimHash of 64 bits: a bit is set if over half of the hashes have it."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 255 * 64):  # 255 ones at most fit the byte that counts them
        bits = np.unpackbits(h[at : at + 255 * 64].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of the shingles of ``text``, repeats included."""
    return vote(shingle_hashes(text or "", words))


def text_key() -> Column:
    """A hash by which equal texts are known; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(text_batches).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- Golay code


def _remainders(words: np.ndarray) -> np.ndarray:
    """The 11-bit syndrome of 23-bit words."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


@cache
def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the error patterns of weight up to 4 that it may stand for.

    The first column is the single pattern of weight up to 3 (the code is
    perfect); where its weight is 3 the others are the five of weight 4. Unused
    places repeat the first. The second array holds how many differ.
    """
    bits = 1 << np.arange(23)
    pairs = np.array([bits[i] | bits[j] for i in range(23) for j in range(i)])
    triples = np.array([p | b for p in pairs for b in bits[1:] if b > p])
    fours = np.array([t | b for t in triples for b in bits if b > t])
    near = np.concatenate([[0], bits, pairs, triples])
    first = np.zeros(2048, dtype=np.int64)
    first[_remainders(near)] = near
    patterns = np.repeat(first[:, None], 6, axis=1)
    count = np.ones(2048, dtype=np.int64)
    for p, s in zip(fours.tolist(), _remainders(fours).tolist(), strict=True):
        patterns[s, count[s]] = p
        count[s] += 1
    return patterns, count


def codewords_near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codewords within distance 4 of each word: ``(which word, 12-bit index)``."""
    patterns, count = golay_keys()
    s = _remainders(words)
    keep = np.arange(6)[None, :] < count[s][:, None]
    codes = (words[:, None] ^ patterns[s]) >> 11
    which = np.broadcast_to(np.arange(len(words))[:, None], keep.shape)
    return which[keep], codes[keep]


def golay_buckets(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bucket keys of unsigned fingerprints: ``(which fingerprint, key)``.

    A key packs the number of the exact segment, its bits and the codeword.
    """
    which, keys = [], []
    for i, (at, width) in enumerate(SEGMENTS):
        exact = (fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
        at, width = SEGMENTS[(i + 1) % 3]
        fuzzy = (fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
        w, code = codewords_near(fuzzy)
        which.append(w)
        keys.append(i << 34 | exact[w] << 12 | code)
    return np.concatenate(which), np.concatenate(keys)


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """``(fp, key)`` for each distinct fingerprint, about 14 rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 1 << 14):
                part = fps[at : at + (1 << 14)]
                which, keys = golay_buckets(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(part[which]), pa.array(keys)], ["fp", "key"])

    return nodes.select("fp").mapInArrow(run, "fp long, key long")


# ---------------------------------------------------------------- links


def fingerprint_links(nodes: DataFrame, bucket_limit: int = 16) -> DataFrame:
    """Links ``(a, b)``, a < b, whose components are those of all pairs within two bits.

    ``nodes`` holds distinct fingerprints ``fp``. Buckets of one fingerprint
    link nothing and end with the count. Small ones are paired; the members of
    larger ones are linked through the words one bit off.
    """
    rows = stage(bucket_rows(nodes), "golay-keys")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stage(rows.join(shared.hint("merge"), "key"), "golay-shared")
    small = shared.filter(F.col("n") <= bucket_limit).select("key", "fp")
    a, b = small.toDF("key", "a"), small.toDF("key", "b")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = a.join(b.hint("merge"), (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (differ <= MAX_BITS)).select("a", "b")
    crowded = shared.filter(F.col("n") > bucket_limit).select("fp").distinct()
    links = stage(pairs.unionByName(midpoint_links(crowded)).distinct(), "fingerprint-links")
    drop_stage(rows, shared)
    return links


def midpoint_links(nodes: DataFrame) -> DataFrame:
    """Links to the least fingerprint that shares a word at distance 0 or 1."""
    masks = np.concatenate([[0], 1 << np.arange(64, dtype=np.uint64)]).astype(np.uint64).view(np.int64)
    flips = F.transform(F.array(*map(F.lit, masks.tolist())), lambda m: F.col("fp").bitwiseXOR(m))
    words = stage(nodes.select("fp", F.explode(flips).alias("word")), "words-one-bit-off")
    least = words.groupBy("word").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = words.join(least.hint("merge"), "word").filter(F.col("a") < F.col("fp"))
    return joined.select("a", F.col("fp").alias("b"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; the root is the least node.

    Each round gives a node the least label among itself and its neighbours,
    then that label's own label (pointer jumping), until none changes. A round
    aggregates before it shuffles, so a node with very many links is no hot key.
    """
    spark = links.sparkSession
    links = stage(links, "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    for _ in range(max_rounds):
        other = labels.select(F.col("node").alias("b"), "root")
        heard = both.join(other.hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        step = labels.join(heard.hint("merge"), "node").select("node", "root", F.least("root", "heard").alias("next"))
        step = stage(step, "labels-step")
        own = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        jumped = stage(step.join(own.hint("merge"), "next").select("node", F.least("next", "far").alias("root"), (F.col("root") != F.least("next", "far")).alias("moved")), "labels")
        drop_stage(labels, step)
        labels = jumped.select("node", "root")
        if not jumped.filter("moved").limit(1).count():
            drop_stage(links)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds on {spark.sparkContext.appName}")


def near_duplicate_components(docs: DataFrame, words: int = 3, bucket_limit: int = 16) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs (doc_id, text)``.

    ``component_id`` is the least id that can be reached over fingerprints
    within two bits.
    """
    rows = stage(fingerprints(docs, words), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    return _component_ids(rows, nodes, fingerprint_links(nodes, bucket_limit))


def simhash_report(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per document with its fingerprint in hex and its component."""
    found = near_duplicate_components(docs, words)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- similar texts

#: Share of the distinct shingles of both texts that similar texts have in common.
SIMILAR = 0.8
#: Keys of a text and the min-wise hashes in each: two texts at 0.8 share no key with a probability of (1 - 0.8**4)**24 = 3e-6.
KEYS, KEY_HASHES = 24, 4
#: Bits of the sketch by which pairs far below 0.8 are told before their shingles are read.
SKETCH_BITS = 512
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]


@cache
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors: of the min-wise hashes, and of those that form a key."""
    odd = np.random.default_rng(42).integers(1, 1 << 63, (2, KEYS * KEY_HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd[0], odd[1].reshape(KEYS, KEY_HASHES)


def min_hash_keys(h: np.ndarray) -> np.ndarray:
    """The keys of a set of shingle hashes; none of an empty set."""
    if not len(h):
        return np.empty(0, dtype=np.int64)
    factors, mix = multipliers()
    with np.errstate(over="ignore"):
        least = np.min([(h[at : at + 2048, None] * factors).min(axis=0) for at in range(0, len(h), 2048)], axis=0)
        return ((least.reshape(KEYS, KEY_HASHES) * mix).sum(axis=1) ^ mix[:, 0]).view(np.int64)


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """For each of 512 classes of hashes, whether an odd number of the set belongs to it; as 8 longs.

    Only the hashes that one of two sets has and the other lacks make their
    sketches differ, so the bits that differ tell how many those are.
    """
    odd = np.bincount((h & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def keyed_rows(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, text_key, fp, size, simhash, keys, s0 ..)``: ``fp`` is a hash of the set of shingles."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(t.as_py() or "", words)) for t in part.column(2)]
                fps = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], dtype=np.uint64).view(np.int64)
                votes = np.array([vote(x) for x in sets], dtype=np.uint64).view(np.int64)
                keys = pa.array([min_hash_keys(x) for x in sets], pa.list_(pa.int64()))
                sketch = np.array([parity_sketch(x) for x in sets])
                columns = [part.column(0), part.column(1), pa.array(fps), pa.array(list(map(len, sets)), pa.int32()), pa.array(votes), keys]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(x)) for x in sketch.T)], names)

    names = ["doc_id", "text_key", "fp", "size", "simhash", "keys", *SKETCH]
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return text_batches(kept).mapInArrow(run, "doc_id long, text_key long, fp long, size int, simhash long, keys array<long>, " + ", ".join(f"{n} long" for n in SKETCH))


def _may_be_similar(a: str, b: str) -> Column:
    """False where the nodes with columns ``a_size, a_s0 ..`` and ``b_size ..`` cannot be similar.

    Similar sets differ in at most a ninth of the sum of their sizes. Of ``m``
    bits, ``d`` differences make (1 - exp(-2 d / m)) m / 2 differ on average; the
    bound lies five standard deviations above.
    """
    x, y = F.col(f"{a}_size"), F.col(f"{b}_size")
    share = (x + y) * ((1 - SIMILAR) / (1 + SIMILAR)) / SKETCH_BITS
    mean = (1 - F.exp(-2 * share)) * (SKETCH_BITS / 2)
    spread = (1 - F.exp(-4 * share) * (1 + 4 * share)) * (SKETCH_BITS / 4)
    differ = sum((F.bit_count(F.col(f"{a}_{n}").bitwiseXOR(F.col(f"{b}_{n}"))) for n in SKETCH), F.lit(0))
    return (F.least(x, y) >= SIMILAR * F.greatest(x, y) - 1e-9) & (differ <= mean + 5 * F.sqrt(spread) + 1)


def _side(nodes: DataFrame, side: str, *more: str) -> DataFrame:
    return nodes.select(*[F.col(n).alias(f"{side}_{n}") for n in ("fp", "size", *SKETCH, *more)])


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``(fp, shingles)``: the distinct shingle hashes of each row of ``texts (fp, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [np.unique(shingle_hashes(t.as_py() or "", words)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "shingles"])

    return text_batches(texts.select("fp", "text")).mapInArrow(run, "fp long, shingles array<long>")


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, least: float = SIMILAR) -> DataFrame:
    """The pairs ``(a, b)`` whose texts share at least ``least`` of their distinct shingles."""
    pairs = stage(pairs.select("a", "b"), "pairs")
    if not pairs.limit(1).count():
        return pairs
    need = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    keys = stage(nodes.select("fp", "text_key").join(need.hint("merge"), "fp"), "texts-of-pairs")
    texts = docs.select(text_key().alias("text_key"), "text").join(broadcast_if_small(keys, 100_000), "text_key")
    sets = stage(shingle_sets(texts.dropDuplicates(["text_key"]), words), "shingle-sets")
    a, b = (sets.select(F.col("fp").alias(side), F.col("shingles").alias(f"{side}_set")) for side in ("a", "b"))
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("a_set", "b_set")))
    good = stage(both.filter(F.col("shared") >= least * (F.size("a_set") + F.size("b_set") - F.col("shared")) - 1e-9).select("a", "b"), "similar-pairs")
    drop_stage(pairs, keys, sets)
    return good


def _differences(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """``(fp, hub, most, width, shingle)``: what sets ``(fp, shingles)`` have and their hubs lack, or the other way round.

    Two sets differ in as much as their differences from one hub do. Where a
    set differs from its hub in more than half of the hub's size, no hub (null)
    is taken, so that all its shingles count. Sets up to a quarter of their own
    size nearer come in both forms, since a similar set may lie beyond the half.
    ``most`` is how much a similar set may differ.
    """
    own, hubs = sets.select("fp", "shingles"), sets.select(F.col("fp").alias("hub"), F.col("shingles").alias("of_hub"))
    most = F.size("shingles") * ((1 - SIMILAR) / SIMILAR)
    pairs = nodes.select("fp", F.explode("hubs").alias("hub")).filter("fp <> hub").join(own.hint("merge"), "fp").join(hubs.hint("merge"), "hub")
    pairs = pairs.withColumn("apart", F.concat(F.array_except("shingles", "of_hub"), F.array_except("of_hub", "shingles"))).withColumn("width", F.size("apart"))
    near, beyond = F.col("width") <= F.size("of_hub") / 2, F.col("width") > F.size("of_hub") / 2 - most
    pairs = stage(pairs.select("fp", "hub", most.alias("most"), "width", F.when(near, F.col("apart")).alias("shingles"), beyond.alias("beyond")), "differences-from-hubs")
    whole = own.join(pairs.filter("beyond").select("fp").distinct().hint("merge"), "fp")
    whole = whole.select("fp", F.lit(None).cast("long").alias("hub"), most.alias("most"), F.size("shingles").alias("width"), "shingles")
    both = pairs.filter("shingles is not null").select("fp", "hub", "most", "width", "shingles").unionByName(whole)
    return both.select("fp", "hub", "most", "width", F.explode("shingles").alias("shingle"))


def _rare_first(parts: DataFrame) -> DataFrame:
    """``(fp, width, token, at)``: the first elements of each difference, with their places from 1; a token is a hub and a shingle.

    The elements about a hub are in one order for all, rare ones first. Two
    differences that have ``o`` elements in common share one of the first
    ``width - o + 1`` of each, which is ``most + 1`` at most. Elements that only one has keep their places and
    are left out.
    """
    token = F.when(F.col("hub").isNull(), F.col("shingle")).otherwise(F.xxhash64("hub", "shingle"))
    parts = stage(parts.select("fp", "hub", "most", "width", token.alias("token")), "differences")
    times = parts.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    common = stage(parts.join(times.hint("merge"), "token"), "shared-differences")
    one = Window.partitionBy("fp", "hub")
    at = F.col("width") - F.count(F.lit(1)).over(one) + F.row_number().over(one.orderBy("times", "token"))
    placed = common.select("fp", "most", "width", "token", at.cast("int").alias("at")).filter(F.col("at") <= F.col("most") + 1 + 1e-9)
    rows = stage(placed.drop("most"), "rare-differences")
    drop_stage(parts, common)
    return rows


def _similar_of_other_roots(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Similar pairs ``(a, b)`` of ``nodes (fp, root, outside, hubs, ..)`` that have a hub in common and different roots, one ``outside``.

    Every node must have been compared with its hubs. Then at least one of a
    pair of different roots is not similar to the hub, and so, if similar to
    each other, their differences from it share an element: the members of a
    group are told by how they depart from its centre, not by what all share.
    """
    texts = docs.select(text_key().alias("text_key"), "text").join(broadcast_if_small(nodes.select("fp", "text_key"), 100_000), "text_key")
    sets = stage(shingle_sets(texts.dropDuplicates(["text_key"]), words), "shingle-sets-of-mixed-keys")
    rows = _rare_first(_differences(nodes, sets))
    rows = stage(rows.join(nodes.drop("hubs").hint("merge"), "fp"), "first-differences")
    x, y = (_side(rows, side, "root", "outside", "width", "token", "at") for side in ("x", "y"))
    once = ~F.col("y_outside") | (F.col("x_fp") < F.col("y_fp"))
    left = F.least(F.col("x_width") - F.col("x_at"), F.col("y_width") - F.col("y_at")) + 1
    may_differ = (F.col("x_size") + F.col("y_size")) * ((1 - SIMILAR) / (1 + SIMILAR))
    enough = 2 * left >= F.col("x_width") + F.col("y_width") - may_differ - 1e-9
    late = x.filter("x_outside").join(y.hint("merge"), (F.col("x_token") == F.col("y_token")) & (F.col("x_root") != F.col("y_root")) & once & enough & _may_be_similar("x", "y"))
    late = late.select(F.least("x_fp", "y_fp").alias("a"), F.greatest("x_fp", "y_fp").alias("b")).distinct()
    good = _similar(late, nodes, docs, words)
    drop_stage(sets, rows)
    return good


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``(fp, root)`` of ``roots (fp, root)`` after ``links (a, b)`` between roots."""
    moved = components(links).withColumnRenamed("root", "least_root")
    return roots.join(broadcast_if_small(moved, BROADCAST_NODES), roots["root"] == moved["node"], "left").select("fp", F.coalesce("least_root", "root").alias("root"))


#: Rows of up to three longs that are broadcast.
BROADCAST_NODES = 300_000


def similar_nodes(docs: DataFrame, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """``rows (doc_id, text_key, fp)`` and ``nodes (fp, least, root)`` of similar texts.

    ``least`` is the least ``(no id, doc_id, text_key)`` at a node, which is a
    set of distinct shingles. Nodes are linked exactly if they share 0.8 of
    them, as far as they share a key (see ``KEYS``).

    First each node is compared with the nodes of close fingerprints, found by
    their Golay keys, and with the hub of each of its buckets, and components
    are formed. The hub is the member that is met most often, which in a group
    of copies lies near what they are copies of. Members of one component need
    no more links, so then only those outside a bucket's main component are
    compared, with the members whose rarest differences from the hub they share
    (see ``_similar_of_other_roots``). No bucket is capped.
    """
    rows = stage(keyed_rows(docs, words), "shingle-keys")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("least")
    facts = F.first(F.struct("size", "simhash", "keys", *SKETCH)).alias("facts")
    nodes = rows.groupBy("fp").agg(least, F.min("text_key").alias("text_key"), facts)
    nodes = stage(nodes.select("fp", "least", "text_key", "facts.*"), "distinct-sets")

    keyed = nodes.select("fp", F.explode("keys").alias("key"))
    buckets = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-keys")
    shared = stage(keyed.join(broadcast_if_small(buckets, BROADCAST_NODES), "key"), "nodes-of-keys")
    rank = shared.groupBy("fp").agg(F.sum("n").alias("rank"))
    ranked = stage(shared.join(rank.hint("merge"), "fp").select("key", "fp", "rank"), "ranks-in-keys")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("rank", "fp")).alias("hub"))
    hubs = stage(hubs.select("key", F.col("hub.fp").alias("hub")), "hubs")
    in_keys = stage(ranked.select("key", "fp").join(broadcast_if_small(hubs, BROADCAST_NODES), "key"), "nodes-and-hubs")
    by_key = in_keys.filter("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
    marks = nodes.groupBy("simhash").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    marks = stage(marks.withColumnRenamed("simhash", "mark"), "distinct-fingerprints")
    same = nodes.select("simhash", "fp").join(broadcast_if_small(marks.filter("low < high"), BROADCAST_NODES), F.col("simhash") == F.col("mark"))
    same = same.filter("fp > low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    close = fingerprint_links(marks.select(F.col("mark").alias("fp")))
    end = marks.select("mark", "low")
    close = close.join(end.toDF("a", "x").hint("merge"), "a").join(end.toDF("b", "y").hint("merge"), "b")
    close = close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    stars = stage(by_key.union(same).union(close).distinct(), "first-pairs")

    met = shared.select("fp").union(stars.select("a")).union(stars.select("b")).distinct()
    met = stage(nodes.drop("least", "simhash", "keys").join(met.hint("merge"), "fp"), "nodes-met")
    pairs = stars.join(_side(met, "x").hint("merge"), F.col("a") == F.col("x_fp")).join(_side(met, "y").hint("merge"), F.col("b") == F.col("y_fp"))
    linked = _similar(pairs.filter(_may_be_similar("x", "y")), met, docs, words)
    roots = components(linked).withColumnRenamed("node", "fp")
    roots = met.select("fp").join(broadcast_if_small(roots, BROADCAST_NODES), "fp", "left")
    roots = stage(roots.withColumn("root", F.coalesce("root", "fp")), "first-roots")

    member = in_keys.join(roots.hint("merge"), "fp")
    parts = member.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("key", "main")
    mixed = member.join(mixed.hint("merge"), "key").groupBy("fp", "root").agg(F.max(F.col("root") != F.col("main")).alias("outside"), F.collect_set("hub").alias("hubs"))
    mixed = stage(mixed.join(met.hint("merge"), "fp"), "members-of-mixed-keys")
    good = _similar_of_other_roots(mixed, docs, words)
    at = [roots.select(F.col("fp").alias(side), F.col("root").alias(f"r{side}")) for side in ("a", "b")]
    both = good.join(at[0].hint("merge"), "a").join(at[1].hint("merge"), "b")
    found = stage(_joined(roots, both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()), "last-roots")
    placed = nodes.select("fp", "least").join(broadcast_if_small(found, BROADCAST_NODES), "fp", "left")
    placed = stage(placed.withColumn("root", F.coalesce("root", "fp")), "placed-sets")
    kept = stage(rows.select("doc_id", "text_key", "fp"), "rows-of-sets")
    drop_stage(rows, nodes, buckets, shared, ranked, hubs, in_keys, marks, stars, met, linked, roots, mixed, good, found)
    return kept, placed


def similar_components(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, component_id``: one row per document; the least id among its similar texts."""
    rows, nodes = similar_nodes(docs, words)
    ids = nodes.groupBy("root").agg(F.min("least").alias("least")).select("root", F.col("least.doc_id").alias("component_id"))
    table = stage(nodes.select("fp", "root").join(ids.hint("merge"), "root").select("fp", "component_id"), "set-components")
    return rows.join(table.hint("merge"), "fp").select("doc_id", "component_id")


def _component_ids(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of ``rows`` from the links between their nodes."""
    found = components(links)
    # The least id of a component may stand at another node than its root.
    linked = nodes.join(found.hint("merge"), nodes["fp"] == found["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    table = stage(linked.join(ids.hint("merge"), "root").select("fp", "component_id"), "fingerprint-components")
    return rows.join(table.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates; columns as they came.

    Of each component the row with the least id stays, of different texts with
    that id the one with the least text hash, of equal rows one; a component
    without an id keeps one row. Rows to drop are few, so they are what the
    texts are joined to.
    """
    rows, nodes = similar_nodes(docs, words)
    keepers = nodes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("keep_id"), F.col("least.text_key").alias("keep_key"))
    times = rows.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key"))
    times = times.join(keepers.hint("merge"), stays, "left").withColumn("stays", F.col("keep_key").isNotNull())
    marked = times.filter(~F.col("stays") | (F.col("n") > 1))
    mark, key = free_name(docs, "_marked"), free_name(docs, "_text_key")
    marked = stage(marked.select(F.col("doc_id").alias("marked_id"), F.col("text_key").alias("marked_key"), F.col("stays").alias("again")), "rows-marked")
    drop_stage(rows, nodes)
    near = broadcast_if_small(marked.select(F.struct("marked_id", "marked_key", "again").alias(mark)), BROADCAST_NODES)
    both = docs.withColumn(key, text_key()).join(near, F.col("doc_id").eqNullSafe(F.col(f"{mark}.marked_id")) & (F.col(key) == F.col(f"{mark}.marked_key")), "left")
    single = both.filter(F.col(mark).isNull()).drop(mark, key)
    if not marked.filter("again").limit(1).count():
        return single
    return single.unionByName(both.filter(f"{mark}.again").drop(mark).dropDuplicates(["doc_id", key]).drop(key))

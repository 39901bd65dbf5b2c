"""Hard negatives for labelled vectors, found by angular triangle filtering.

Every row stores its norm and its angles to a few reference directions. The
triangle inequality of angles bounds the angle between an anchor and a row from
both sides, by each direction; the tightest bounds, their cosines times both
norms, enclose the score. Bounds are widened by more than all rounding, so a row
outside what an anchor still looks for is passed over safely; the others get
their exact integer inner product.

Anchors are a stated query set. They meet all rows in blocks: rows are dealt to
``g`` groups and anchors to ``c`` groups, and each of the ``g * c`` cells is one
cogroup of bounded size. A cell reports the best few of each anchor, and ranks
over the cells' reports give the result, once for the positives, then for the
negatives in the windows that the positives' scores open.

The reference directions come from a bounded sample (``sample_rows``) and change
the work only, never the result. Where vectors spread evenly over all
directions, angles tell little and nearly every pair is scored.

Defined cases: rows without a label or a vector, or with a null or non-finite
component (or one that is not finite times 256), take no part. Repeated rows
stay rows of their own: a copy of an anchor is one of its positives, and each
copy is an anchor. A null id is never an anchor and comes last in ties. Shorter
vectors count as padded by zeros; an empty one scores zero. Components whose
products could exceed 2**53 are multiplied as whole numbers of any size; scores
beyond 64 bits are held at its ends. An empty table gives an empty result.
Extra columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import stage

#: Angles are stored as 32-bit floats; their rounding and that of arccos stay far below this.
ANGLE_SLACK = 4e-6
LONG = 2**63 - 1

ROW_SCHEMA = "rid long, vec_id long, label long, vec binary, angles binary, norm double"
POSITIVE_SCHEMA = "rid long, anchor_id long, positive_id long, positive_score long"
NEGATIVE_SCHEMA = "rid long, k int, negative_id long, negative_score long"


# ---------------------------------------------------------------- rows


def usable(df: DataFrame) -> DataFrame:
    """Rows that take part, with a number of their own and their components times 256."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * 256)
    finite = F.forall("scaled", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("scaled"))
    return rows.filter(F.col("label").isNotNull() & F.col("scaled").isNotNull() & finite)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _dense(vectors: list, width: int | None = None) -> np.ndarray:
    """Vectors as rows of one matrix; short ones are padded by zeros."""
    width = max(map(len, vectors), default=0) if width is None else width
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : min(len(v), width)] = v[:width]
    return out


def reference_directions(rows: DataFrame, count: int, sample_rows: int) -> np.ndarray:
    """``count`` directions far from each other, among ``sample_rows`` rows drawn by a hash."""
    drawn = rows.select("scaled").orderBy(F.xxhash64("scaled"), "scaled").limit(sample_rows).collect()
    u = _unit(np.floor(_dense([r[0] for r in drawn])))
    if not len(u) or not u.shape[1]:
        return np.zeros((0, 0))
    chosen, far = [0], np.abs(u @ u[0])
    while len(chosen) < min(count, len(u)):
        chosen.append(int(far.argmin()))
        far = np.maximum(far, np.abs(u @ u[chosen[-1]]))
    return u[chosen]


def _coded(v: np.ndarray) -> bytes:
    return b"i" + v.astype("<i4").tobytes() if not len(v) or np.abs(v).max() < 2**31 else b"d" + v.astype("<f8").tobytes()


def _decoded(col: pa.ChunkedArray) -> np.ndarray:
    raw = col.to_pylist()
    if raw and all(len(x) == len(raw[0]) for x in raw) and all(x[0] == 105 for x in raw):
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1)[:, 1:]
        return np.ascontiguousarray(flat).view("<i4").astype(float)
    return _dense([np.frombuffer(x, dtype="<i4" if x[0] == 105 else "<f8", offset=1) for x in raw])


def with_angles(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """Integer vectors with their norms and stored angles to the reference directions."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.floor(np.array(v, dtype=float)) for v in batch.column("scaled").to_pylist()]
            m = _dense(vectors)
            norm, width = np.linalg.norm(m, axis=1), references.shape[1]
            u = _unit(m)  # what the references do not have is zero in them
            shared = min(width, m.shape[1])
            angles = np.arccos(np.clip(u[:, :shared] @ references[:, :shared].T, -1, 1)).astype("<f4")
            cols = [batch.column(c) for c in ("rid", "vec_id", "label")]
            cols += [pa.array([_coded(v) for v in vectors], pa.binary()), pa.array([a.tobytes() for a in angles], pa.binary()), pa.array(norm)]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "vec_id", "label", "vec", "angles", "norm"])

    return rows.mapInArrow(measure, ROW_SCHEMA)


# ---------------------------------------------------------------- one cell


class Cell:
    """Some anchors and some rows; bounds of all their scores, exact scores on demand."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        self.rid, self.label = rows["rid"].to_numpy(), rows["label"].to_numpy()
        ids = rows["vec_id"].to_pylist()
        self.ids = ids
        # Positions by id, null last: ties are settled by them.
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        self.place = np.empty(len(ids), dtype=np.int64)
        self.place[order] = np.arange(len(ids))
        self.vec, self.anchor_vec = _decoded(rows["vec"]), _decoded(anchors["vec"])
        width = min(self.vec.shape[1], self.anchor_vec.shape[1])  # beyond it one side is zero
        self.vec, self.anchor_vec = self.vec[:, :width], self.anchor_vec[:, :width]
        self.norm, self.anchor_norm = rows["norm"].to_numpy(), anchors["norm"].to_numpy()
        self.angles, self.anchor_angles = self._angles(rows), self._angles(anchors)
        self.anchor_label, self.anchor_rid = anchors["label"].to_numpy(), anchors["rid"].to_numpy()
        # Neighbours in this order share most rows that pass their bounds.
        nearest = self.anchor_angles.argmin(0) if len(self.anchor_angles) else np.zeros(len(self.anchor_rid))
        self.order = np.lexsort((nearest, self.anchor_label))
        most = max(1, width) * float(np.abs(self.vec).max(initial=0)) * float(np.abs(self.anchor_vec).max(initial=0))
        self.exact = most < 2**53  # then 64-bit floats hold every sum of products
        if not self.exact:
            self.vec, self.anchor_vec = (np.array([[int(x) for x in v] for v in m], dtype=object).reshape(m.shape) for m in (self.vec, self.anchor_vec))

    @staticmethod
    def _angles(t: pa.Table) -> np.ndarray:
        n = t.num_rows
        return np.ascontiguousarray(np.frombuffer(b"".join(t["angles"].to_pylist()), dtype="<f4").reshape(n, -1).T) if n else np.zeros((0, 0), dtype="f4")

    def bounds(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's lowest and highest score with anchor ``a``, rounded outwards."""
        low, high = np.zeros(len(self.rid), dtype="f4"), np.full(len(self.rid), np.pi, dtype="f4")
        for mine, theirs in zip(self.anchor_angles[:, a], self.angles, strict=True):
            np.maximum(low, np.abs(theirs - mine), out=low)
            both = theirs + mine
            np.minimum(high, np.minimum(both, np.float32(2 * np.pi) - both), out=high)
        size = self.norm * self.anchor_norm[a]
        slack = 1 + 1e-6 * size
        return np.cos(np.minimum(high + ANGLE_SLACK, np.pi), dtype=float) * size - slack, np.cos(np.maximum(low - ANGLE_SLACK, 0), dtype=float) * size + slack

    def scores(self, some: list[int], rows: np.ndarray) -> np.ndarray:
        """Exact scores of anchors and rows, as integers."""
        found = self.anchor_vec[some] @ self.vec[rows].T
        return found.astype(np.int64) if self.exact else found

    def best(self, rows: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """Positions in ``rows`` of the ``n`` highest scores, ties by smaller id."""
        if len(rows) > 4 * n and scores.dtype != object:
            least = np.partition(scores, len(scores) - n)[len(scores) - n]
            kept = np.flatnonzero(scores >= least)
        else:
            kept = np.arange(len(rows))
        order = sorted(kept.tolist(), key=lambda k: (-int(scores[k]), self.place[rows[k]]))
        return np.array(order[:n], dtype=np.int64)

    def blocks(self, passing, size: int = 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each anchor with the rows that pass for it and their scores.

        ``passing(a)`` tells the rows by their bounds; those of a few anchors
        are multiplied in one step.
        """
        for at in range(0, len(self.order), size):
            some = self.order[at : at + size].tolist()
            masks = [passing(a) for a in some]
            union = np.flatnonzero(np.logical_or.reduce(masks))
            scores = self.scores(some, union)
            for k, a in enumerate(some):
                own = masks[k][union]
                yield a, union[own], scores[k][own]


def _held(x: int) -> int:
    return max(-LONG - 1, min(LONG, int(x)))


def _positives(n: int):
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        cell, out = Cell(anchors, rows), []

        def passing(a: int) -> np.ndarray:
            mask = (cell.label == cell.anchor_label[a]) & (cell.rid != cell.anchor_rid[a])
            if mask.sum() > n:
                low, high = cell.bounds(a)
                of = low[mask]
                mask &= high >= np.partition(of, len(of) - n)[len(of) - n]  # n rows score no less
            return mask

        anchor_ids = anchors["vec_id"].to_pylist()
        if rows.num_rows:
            for a, found, scores in cell.blocks(passing):
                for k in cell.best(found, scores, n).tolist():
                    out.append((int(cell.anchor_rid[a]), anchor_ids[a], cell.ids[found[k]], _held(scores[k])))
        return _table(out, ("rid", "anchor_id", "positive_id", "positive_score"), (pa.int64(),) * 4)

    return find


def _negatives(n: int, low_share: int, high_share: int):
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        cell, out = Cell(anchors, rows), []
        wanted = [[int(s) for s in p] for p in anchors["positive_scores"].to_pylist()]
        # Whole scores s with low_share * p <= 100 * s <= high_share * p.
        windows = [[(-(-low_share * p // 100), high_share * p // 100) for p in own] for own in wanted]

        def passing(a: int) -> np.ndarray:
            mask = cell.label != cell.anchor_label[a]
            low, high = cell.bounds(a)
            some = np.zeros(len(mask), dtype=bool)
            for first, last in set(windows[a]):
                if first <= last:
                    inside = mask & (low >= first) & (high <= last)
                    least = float(first)
                    if inside.sum() > n:  # n rows of the window score no less
                        of = low[inside]
                        least = np.partition(of, len(of) - n)[len(of) - n]
                    some |= mask & (high >= least) & (low <= last)
            return some

        if rows.num_rows:
            for a, found, scores in cell.blocks(passing):
                done = {}
                for k, (first, last) in enumerate(windows[a]):
                    if (first, last) not in done:
                        inside = np.flatnonzero((scores >= first) & (scores <= last))
                        done[first, last] = [(cell.ids[found[j]], _held(scores[j])) for j in inside[cell.best(found[inside], scores[inside], n)].tolist()]
                    out += [(int(cell.anchor_rid[a]), k, i, s) for i, s in done[first, last]]
        return _table(out, ("rid", "k", "negative_id", "negative_score"), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))

    return find


def _table(rows: list[tuple], names: tuple, types: tuple) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)})


# ---------------------------------------------------------------- all cells


def _cells(df: DataFrame, own: str, own_groups: int, other: str, other_groups: int, seed: int) -> DataFrame:
    """Deal rows to groups of one side, and copy each to all groups of the other."""
    mine = F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(own_groups)).cast("int")
    df = df.select(*[F.col(c).alias(c) for c in df.columns])  # columns of its own: both sides come from one table
    return df.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_groups - 1))))


def _first(rows: DataFrame, keys: list[str], score: str, tie: str, n: int, rank: str) -> DataFrame:
    order = [F.col(score).desc(), F.col(tie).asc_nulls_last()]
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low_share: int = 30,
    high_share: int = 90,
    references: int = 16,
    sample_rows: int = 2000,
    cell_bytes: int = 64 << 20,
) -> DataFrame:
    """``vectors`` (vec_id, label, embedding): each anchor's positives, and for each the
    hardest negatives that score between ``low_share`` and ``high_share`` percent of it.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    ``is_anchor`` is a condition on ``vec_id`` and ``label``. ``cell_bytes`` bounds the
    vectors that a task holds of either side.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    rows = stage(with_angles(rows, reference_directions(rows, references, sample_rows)), "vectors")
    anchors = rows.filter(F.coalesce(is_anchor, F.lit(False)))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vec")).alias("b"), F.count(F.when(is_anchor, 1)).alias("a")).first()
    held = max(1, cell_bytes // (2 * (size["b"] or 1) + 8 * references + 100))
    most = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // 4096)))
    g, c = max(most, -(-size["n"] // held)), max(1, -(-size["a"] // held))

    dealt = _cells(rows, "g", g, "c", c, 1)
    found = _cells(anchors, "c", c, "g", g, 2).groupBy("c", "g").cogroup(dealt.groupBy("c", "g")).applyInArrow(_positives(positives), POSITIVE_SCHEMA)
    pairs = stage(_first(found, ["rid"], "positive_score", "positive_id", positives, "k").withColumn("k", F.col("k") - 1), "positives")

    opened = pairs.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "positive_score"))), lambda x: x["positive_score"]).alias("positive_scores"))
    looking = anchors.join(opened, "rid")
    found = _cells(looking, "c", c, "g", g, 2).groupBy("c", "g").cogroup(dealt.groupBy("c", "g")).applyInArrow(_negatives(negatives, low_share, high_share), NEGATIVE_SCHEMA)
    hard = _first(found, ["rid", "k"], "negative_score", "negative_id", negatives, "rank")
    return pairs.join(hard, ["rid", "k"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def hard_negative_report(vectors: DataFrame) -> DataFrame:
    """The contract's query: some labels are changed, every hundredth row is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", label.alias("label"), "embedding")
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)

"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target of words. With ``r`` the target over the source's
size, every document is taken ``floor(r)`` times and once more with inclusion
probability ``r - floor(r)``. Which ones is decided by the cube method: the
vector of probabilities moves at random through the null space of the balancing
constraints (words and documents of the source keep their expected totals)
until a component reaches 0 or 1; that document is decided, and the walk goes
on. Each step takes the direction that moves the longest open document most
and lets all the others make up for it, so long documents are decided first,
while many are left to balance them, and the short ones last.

The walk runs in blocks of rows within a source, so a source that holds a third
of all rows is many tasks. Each block leaves its shortest 50 documents open;
they meet in blocks of the next level, 80 times fewer each time, until one block
per source is left. There the landing drops the constraint on documents, goes on
to the shortest one, and rounds that.

Targets: total times ``scale`` is shared by weight; no target exceeds ``cap``
times its source's size, and the excess is shared again by weight.

Defined cases: null text has size 0; the null source is a source, last in
order; sources of size 0 get target 0 and their documents are taken 0 times;
rows are decided by hashes of id, text and source, so reruns agree whatever the
partitions, and rows that repeat all three are decided as one; an empty table
gives an empty mix. Further columns are kept by ``take_mix``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import WORD, broadcast_if_small, free_name, stage

WEIGHTS = (5.0, 2.0, 1.0)
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, scale: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, rows, source_size, target``; ``sizes`` has ``source, rows, source_size``.

    The result of capping and sharing again is the common level ``x`` with
    target ``min(cap * size, x * weight)``: sources in order of the level at
    which they reach their cap, the first ones are capped as long as the rest
    would lie above. Windows here run over one row per source.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("nth", rank).withColumn("weight", F.element_at(table, (F.col("nth") % n + 1).cast("int")))
    limit = F.col("source_size") * cap
    order = Window.orderBy((F.col("source_size") * cap / F.col("weight")).asc(), "nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * scale
    # The level if all sources before this one are capped and this and later ones are not.
    level = (total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= limit)
    # The first open source fixes the level; it exists unless scale exceeds cap.
    s = s.withColumn("first", F.min(F.when(F.col("open"), F.struct((F.col("source_size") * cap / F.col("weight")).alias("k"), "nth", "level"))).over(Window.partitionBy()))
    target = F.when(F.col("first").isNull(), limit).otherwise(F.least(limit, F.col("first.level") * F.col("weight")))
    return s.select("source", "rows", "source_size", target.alias("target"))


# ---------------------------------------------------------------- the cube method


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, leave: int, documents: bool = True) -> np.ndarray:
    """Decide documents, the longest first, until ``leave`` of them lie strictly between 0 and 1.

    Each step moves the longest open document; all other open ones make up for
    it, each by an amount that is linear in its size, so that the sum of sizes
    and, with ``documents``, the sum of probabilities stay. It goes up or down
    as far as the first document reaches 0 or 1, with odds that keep every
    probability on average.
    """
    tiny, p = 1e-9, p.astype(float).copy()
    p[p < tiny], p[p > 1 - tiny] = 0.0, 1.0
    live = np.flatnonzero((p > 0) & (p < 1))
    live = live[np.argsort(size[live], kind="stable")]  # the last one is the longest
    while len(live) > max(leave, 1):
        q, x = p[live], size[live].astype(float)
        others, n = x[:-1], len(live) - 1
        s1, s2 = others.sum(), (others * others).sum()
        spread = n * s2 - s1 * s1
        d = np.ones(n + 1)
        if documents and spread > 1e-9 * n * s2:
            slope = (s1 - n * x[-1]) / spread
            d[:-1] = slope * others - (1 + slope * s1) / n
        else:
            d[:-1] = -x[-1] / s1 if s1 > 0 else -1 / n
        with np.errstate(divide="ignore"):
            up = np.min(np.where(d > tiny, (1 - q) / d, np.where(d < -tiny, -q / d, np.inf)))
            down = np.min(np.where(d > tiny, q / d, np.where(d < -tiny, (q - 1) / d, np.inf)))
        q = q + d * (up if rng.random() * (up + down) < down else -down)
        q[q < tiny], q[q > 1 - tiny] = 0.0, 1.0
        p[live] = q
        live = live[(q > 0) & (q < 1)]
    return p


def landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the last few: keep the words balanced to the shortest one, then round it."""
    p = flight(p, size, rng, 1, documents=False)
    return np.where((p > 0) & (p < 1), (rng.random(len(p)) < p).astype(float), p)


def _walk(level: int, last: bool, leave: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "order", "row"], kind="stable")  # the same order on every run
        p, x, order = (pdf[c].to_numpy() for c in ("p", "size", "order"))
        rng = np.random.default_rng([level, len(pdf), int(order.min()) & (2**63 - 1)])
        # On the last level both totals are kept until four are open; the words alone from there.
        p = flight(p, x, rng, 4 if last else leave)
        return pdf.assign(p=landing(p, x, rng) if last else p)

    return run


def balanced_sample(rows: DataFrame, seed: int, block_rows: int = 4_000, leave: int = 50) -> DataFrame:
    """``row, taken`` for ``rows (row, grp, rows_in_grp, size, p)``; groups are balanced apart.

    The number of blocks of a group follows from its row count, so no task gets
    more than about ``block_rows`` rows; each leaves ``leave`` open ones to the
    next level. Levels follow from the largest group.
    """
    schema = "row long, grp long, blocks long, block long, size long, p double, order long"
    leave = min(leave, block_rows // 4)  # each level is a fraction of the one before
    order = F.xxhash64("row", F.lit(seed))
    work = rows.withColumn("order", order)
    work = work.withColumn("blocks", F.ceil(F.col("rows_in_grp") / block_rows))
    work = work.withColumn("block", F.pmod("order", F.col("blocks"))).drop("rows_in_grp")
    most = rows.agg(F.max("rows_in_grp")).first()[0] or 0
    levels, left = 1, math.ceil(most / block_rows)
    while left > 1:
        levels, left = levels + 1, math.ceil(leave * left / block_rows)
    done = []
    for k in range(levels):
        work = work.groupBy("grp", "block").applyInPandas(_walk(k, k == levels - 1, leave), schema)
        work = stage(work, "cube-level")
        done.append(work.filter("p = 0 or p = 1").select("row", (F.col("p") == 1).alias("taken")))
        work = work.filter("p > 0 and p < 1").withColumn("blocks", F.ceil(leave * F.col("blocks") / block_rows))
        work = work.withColumn("block", F.pmod("order", F.col("blocks")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix_units(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, scale: float = 1.5, cap: float = 2.0, seed: int = 17, block_rows: int = 4_000) -> DataFrame:
    """``doc_id, key, repeats, size, source_size, target, copies`` for each distinct row.

    ``key`` is a hash of id, text and source. The mixture is decided on these
    narrow rows; texts are read once, for their size and hash.
    """
    size = word_count(F.col("text"))
    units = docs.select("doc_id", "source", size.alias("size"), row_key().alias("key"))
    units = stage(units.groupBy("doc_id", "key", "source", "size").agg(F.count(F.lit(1)).alias("repeats")), "units")
    per = units.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("size") * F.col("repeats")).alias("source_size"))
    targets = stage(source_targets(per, weights, scale, cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    group = F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    rated = targets.withColumn("grp", group).withColumn("r", ratio).withColumnRenamed("source", "of")
    both = units.join(broadcast_if_small(rated, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of")))
    both = both.withColumn("whole", F.floor("r")).withColumn("p", F.col("r") - F.col("whole")).withColumn("row", F.xxhash64("doc_id", "key"))
    weighed = both.filter("p > 0").select("row", "grp", F.col("rows").alias("rows_in_grp"), (F.col("size") * F.col("repeats")).alias("size"), "p")
    # Rows whose 64-bit numbers meet share a decision; none is told twice.
    drawn = balanced_sample(weighed, seed, block_rows).groupBy(F.col("row").alias("drawn")).agg(F.max("taken").alias("taken"))
    more = F.coalesce(F.col("taken").cast("long"), F.lit(0))
    decided = both.join(drawn, F.col("row") == F.col("drawn"), "left")
    return decided.select("doc_id", "key", "repeats", "size", "source_size", "target", (F.col("whole") + more).alias("copies"))


def row_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")), F.col("source").isNull())


def mixing_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its size, its source's size and target, the words taken."""
    units = mix_units(docs, **options)
    each = units.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, columns as they came."""
    units = mix_units(docs, **options).filter("copies > 0")
    mix, key, nth = (free_name(docs, n) for n in ("_mix", "_row_key", "_nth"))
    units = units.select(F.struct("doc_id", "key", F.col("copies").cast("int").alias("copies")).alias(mix))
    same = F.col("doc_id").eqNullSafe(F.col(f"{mix}.doc_id")) & (F.col(key) == F.col(f"{mix}.key"))
    rows = docs.withColumn(key, row_key()).join(units, same)
    return rows.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(f"{mix}.copies")))).select(*[f"`{c}`" for c in docs.columns])

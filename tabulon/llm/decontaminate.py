"""Benchmark decontamination by winnowing.

Words are runs of letters and digits of the text with A-Z lower-cased. A text
is reduced to the hashes of its ``gram``-word sequences, and of every
``window - gram + 1`` consecutive hashes the least is kept (winnowing). Two
texts that share ``window`` consecutive words share all hashes of that span and
so its least one: no shared window is lost, and only about two hashes in seven
are joined.

1. The winnowed hashes of documents are joined to those of the benchmark. What
   matches gives, per document, the set of hashes hit.
2. Each hit is extended: around every place of a hit hash in the document the
   windows that hold it are compared, as text, with the benchmark's windows.
   A false hash match ends here.
3. Matching windows give the words hit (overlaps counted once) and the items.

Items of fewer words than a window are one window of their own length. Their
hashes cannot be winnowed, so where such items exist every sequence of their
lengths is taken from the documents.

Defined cases: null and empty texts have no words; items without words match
nothing; repeated items all count; repeated document ids are told apart by
text, as are documents without an id; a null item id counts as an item but is
not named. Extra columns do not matter and are kept, whatever their names. Everything here is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import ascii_lower, broadcast_if_small, free_name, small_enough, stage

#: Separators between words: everything below 0x80 that is no letter or digit.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A benchmark table of up to this many hashes or windows is broadcast (about 100 bytes each).
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, NO_WORD), "")


def _at(length: int, n: Column) -> Column:
    """0-based starts of the sequences of ``length`` words; none if there are fewer words."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def gram_hashes(words: Column, n: Column, length: int) -> Column:
    return F.transform(_at(length, n), lambda i: F.xxhash64(F.slice(words, i + 1, length)))


def winnowed(hashes: Column, size: int) -> Column:
    """The distinct minima of all ``size`` consecutive hashes."""
    n = F.size(hashes)
    return F.array_distinct(F.transform(_at(size, n), lambda i: F.array_min(F.slice(hashes, i + 1, size))))


def _text(words: Column, start: Column, length) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """``(item_id, len, window)``: the distinct windows of each item as text."""
    w = items.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    w = w.withColumn("len", F.least("n", F.lit(window)))
    starts = F.sequence(F.lit(0), F.col("n") - F.col("len"))
    texts = F.array_distinct(F.transform(starts, lambda i: _text(F.col("words"), i, F.col("len"))))
    return w.select("item_id", "len", F.explode(texts).alias("window"))


def hit_windows(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, start, len, item_id, *keep)`` for every occurrence of an item's window.

    ``docs`` needs ``doc_id`` and ``text``; columns named in ``keep`` are carried.
    """
    keep = keep or []
    size = window - gram + 1
    of_items = stage(item_windows(items, window), "item-windows")
    short = sorted(r["len"] for r in of_items.filter(F.col("len") < window).select("len").distinct().collect())

    def hashes(words: Column, n: Column, h: Column) -> Column:
        rest = [F.array_distinct(gram_hashes(words, n, k)) for k in short]
        return F.concat(winnowed(h, size), *rest)

    # The same rule on both sides; an item's windows are texts of its words.
    window_words = F.split("window", " ")
    own = of_items.select(
        F.explode(
            F.when(F.col("len") == window, winnowed(gram_hashes(window_words, F.lit(window), gram), size)).otherwise(F.array(F.xxhash64(window_words)))
        ).alias("hash")
    ).distinct()
    own = broadcast_if_small(stage(own, "item-hashes"), BROADCAST_ROWS)

    worded = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), words_of(F.col("text")).alias("words"))
    worded = worded.withColumn("n", F.size("words")).withColumn("h", gram_hashes(F.col("words"), F.col("n"), gram))
    found = worded.select("doc_id", F.xxhash64("text").alias("of"), F.explode(hashes(F.col("words"), F.col("n"), F.col("h"))).alias("hash"))
    # A document meets a hash of the benchmark at most once for each of the benchmark's hashes.
    hit = found.join(own, "hash").groupBy("doc_id", "of").agg(F.collect_set("hash").alias("hit"))
    hit = stage(hit, "hit-hashes")

    again = docs.withColumn("of", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = again["doc_id"].eqNullSafe(hit["doc_id"]) & (again["of"] == hit["of"])
    near = broadcast_if_small(hit, 20_000) if small_enough(hit, 20_000) else hit
    near = again.join(near, same).select(again["doc_id"], "text", "hit", *keep)
    near = near.withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words"))
    words, n = F.col("words"), F.col("n")

    def extended(length: int, g: int) -> Column:
        """Windows of ``length`` words around each place of a hit ``g``-gram."""
        at = F.filter(_at(g, n), lambda i: F.array_contains("hit", F.xxhash64(F.slice(words, i + 1, g))))
        around = F.transform(at, lambda p: F.sequence(F.greatest(F.lit(0), p - (length - g)), p))
        starts = F.filter(F.array_distinct(F.flatten(around)), lambda s: s <= n - length)
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(length).alias("len"), _text(words, s, length).alias("window")))

    tried = F.concat(extended(window, gram), *[extended(k, k) for k in short])
    rows = near.select("doc_id", *keep, F.inline(tried))
    return rows.join(broadcast_if_small(of_items, BROADCAST_ROWS), ["window", "len"]).drop("window")


def words_hit(windows: DataFrame, key: list[str]) -> DataFrame:
    """Words covered by ``windows`` per ``key``; overlapping windows count once."""
    ends = windows.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    return ends.groupBy(*key).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("from"))).cast("long").alias("n_hit"))


def _unit() -> Column:
    """What tells documents apart: id and text, also where the id is null."""
    return F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def decontamination_report(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """One row per document: words, words hit, items found, whether it is contaminated."""
    docs = docs.select("doc_id", "text", _unit().alias("unit"))
    windows = stage(hit_windows(docs, items, window, gram, ["unit"]).drop("doc_id").distinct(), "hit-windows")
    named = windows.select("unit", "item_id").distinct().groupBy("unit").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256"),
    )
    hit = broadcast_if_small(stage(words_hit(windows, ["unit"]).join(named, "unit"), "documents-hit"), BROADCAST_ROWS)
    both = docs.select("doc_id", "unit", F.size(words_of(F.col("text"))).cast("long").alias("n_words")).join(hit, "unit", "left")
    return both.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose share of words hit is at most ``share``; all columns kept."""
    unit = free_name(docs, "unit")
    keyed = docs.withColumn(unit, _unit())
    narrow = keyed.select("doc_id", "text", F.col(unit).alias("unit"))
    windows = stage(hit_windows(narrow, items, window, gram, ["unit"]).drop("item_id", "doc_id").distinct(), "hit-windows")
    hit = words_hit(windows, ["unit"])
    if share > 0:
        size = narrow.select("unit", F.size(words_of(F.col("text"))).alias("n")).distinct()
        hit = hit.join(size, "unit").filter(F.col("n_hit") > share * F.col("n"))
    hit = broadcast_if_small(stage(hit.select(F.col("unit").alias(unit)), "documents-hit"), BROADCAST_ROWS)
    return keyed.join(hit, unit, "left_anti").select(*[f"`{c}`" for c in docs.columns])

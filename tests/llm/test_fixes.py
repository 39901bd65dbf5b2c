"""Wide ids, document totals of the mix, places by exact fractions, page cases and hostile tags."""

import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tabulon.llm import exact_dedup, mixing, sharding
from tabulon.llm.html_extract import main_text


def test_dedup_of_ids_over_all_64_bits(spark):
    rows = [(9 * 10**18, "a"), (-9 * 10**18, "a"), (0, "b"), (None, "b"), (-(2**63), "c"), (2**63 - 1, "c"), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.dedup_report(docs, 2).collect()}
    a, c = 9 * 10**18, 2**63 - 1
    assert got == {(a, a, True), (-a, a, False), (0, 0, True), (None, 0, False), (c, c, True), (-c - 1, c, False), (5, 5, True), (None, 5, False)}
    one = spark.createDataFrame([(7, "x"), (7, "x")], "doc_id long, text string")
    assert sorted(r["kept"] for r in exact_dedup.dedup_report(one, 2).collect()) == [False, True]


@pytest.mark.parametrize("n", [30, 50, 400])
def test_mix_balances_documents_and_words(spark, n):
    rng = random.Random(n)
    rows = [(k, " ".join(["w"] * rng.randint(1, 400)), "abc"[k % 3]) for k in range(3 * n)]
    rows += [(3 * n, None, "a"), (3 * n + 1, "long " * 800, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per = {}
    for r in mixing.mixing_report(docs, block_rows=80).withColumn("copies", F.when(F.col("size") > 0, F.col("taken") / F.col("size"))).join(docs, "doc_id").collect():
        s = per.setdefault(r["source"], {"words": 0, "copies": 0, "n": 0, "target": r["target"], "of": r["source_size"]})
        s["words"] += r["taken"]
        s["copies"] += r["copies"] or 0
        s["n"] += r["size"] > 0
    for s in per.values():
        assert abs(s["copies"] - s["n"] * s["target"] / s["of"]) <= 2.5
        assert abs(s["words"] - s["target"]) <= max(0.01 * s["target"], 800)


def test_places_follow_exact_fractions(spark):
    rows = [(k, f"t{k % 37}", ("hot" if k % 3 else f"s{k % 4}") if k % 11 else None) for k in range(300)] + [(5, "t5", "hot"), (None, None, "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    hashed = docs.withColumns({"key": key, "tie": tie}).withColumn("mixed", F.xxhash64("doc_id", "tie", F.lit(23))).collect()
    by = {}
    for r in hashed:
        by.setdefault(r["key"], []).append((r["mixed"] % (1 << 30), r["mixed"], r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]))
    ranked = [(Fraction(2 * k + 1, 2 * len(v)), source, k + 1, x) for source, v in by.items() for k, x in enumerate(sorted(v))]
    salt = {(r["s"], r["k"]): r["h"] for r in spark.createDataFrame([(s, k) for _, s, k, _ in ranked], "s string, k long").withColumn("h", F.xxhash64("s", "k", F.lit(23))).collect()}
    ranked.sort(key=lambda x: (x[0], salt[x[1], x[2]], x[1]))
    want = [(s, x[3] if x[2] else None) for _, s, _, x in ranked]
    got = sharding.shard_report(docs, 8, bucket_rows=40).orderBy("shard", "slot").collect()
    assert [("" if r["source"] is None else "=" + r["source"], r["doc_id"]) for r in got] == want
    counts = [sum(r["shard"] == k for r in got) for k in range(8)]
    assert max(counts) - min(counts) <= 1


P = "This is a long sentence of the article about many things. It goes on, and on. " * 3


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<body><form id=f><nav><a href=x>Home</a></nav><div id=main><p>{P}</p><p>{P}</p></div></form>", f"{P.strip()}\n{P.strip()}"),
        (f"<form><div role=main><p>{P}</p></div><input></form>", P.strip()),
        (f"<article><p>{P}</p></article><form><p>Subscribe now to our letter please.</p></form>", P.strip()),
        (f"<article><p>{P}</p></article><!-- secret <p>{P}", P.strip()),
        (f"<article><p>{P}</p></article><a href='x", P.strip()),
        (f"<div class='alert alert-info'><p>We use cookies to improve your experience. By using this site you accept our policy.</p></div><article><p>{P}</p></article>", P.strip()),
        (f"<article><p>{P}</p><section><h3>12 Comments</h3><p>{P} first</p><p>I agree</p></section></article>", P.strip()),
        (f"<article><p>{P} a &lt; b &amp; c</p>", f"{P.strip()} a < b & c"),
        ("", ""),
        ("<!--", ""),
    ],
)
def test_page_cases(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("tag", ["<a ", "<!--", "<span>x<hr>", "<b>", "<p><i>x", "<div>x", "</b", "<form>", "&"])
def test_hostile_tags_take_linear_time(tag):
    def seconds(n):
        start = time.process_time()
        main_text(tag * (n // len(tag)))
        return time.process_time() - start

    seconds(1000)
    assert seconds(64_000) < 20 * max(seconds(8_000), 0.02)


def test_generated_pages_come_back_whole():
    """Pages put together from parts whose kind is known."""
    rng = random.Random(11)
    words = "river stone cloud winter paper engine garden letter music forest bridge window market".split()
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(8, 16))).capitalize() + "."
    boiler = [
        "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>", "<header><div class=logo>Site</div></header>", "<aside><h4>Related</h4><a href=/x>More of this</a></aside>",
        "<div class=cookie-banner>We use cookies. <button>Accept</button></div>", "<div id=comments><p>Nice one, thanks for this.</p></div>", "<script>var a = '<p>no</p>';</script><style>p {}</style>", "<form><input><label>Mail</label></form>",
    ]
    for _ in range(60):
        paragraphs = [" ".join(sentence() for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(2, 8))]
        before, after = (rng.sample(boiler, k=rng.randint(0, 4)) for _ in range(2))
        wrap = rng.choice(["article", "main", "div class=content"])
        body = "".join(f"<p>{p}</p>\n" for p in paragraphs)
        page = f"<html><body>{''.join(before)}<{wrap}>{body}</{wrap.split()[0]}>{''.join(after)}<footer>© 2024 Site. All rights reserved.</footer></body></html>"
        assert main_text(page) == "\n".join(paragraphs)

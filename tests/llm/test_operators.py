"""The training-data operators against brute force, exact round trips and odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, exact_dedup, html_extract, langid, mixing, quality, sharding, simhash, token_files, warc
from tabulon.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi pi rho sig tau ups phi chi psi om".split()


def rows(n=60, seed=1):
    rng = random.Random(seed)
    out = [(k, " ".join(rng.choices(WORDS, k=rng.randint(1, 60))), "en", f"s{k % 4}" if k % 3 else "hot", 1, 1, "x") for k in range(n)]
    out += [(n, None, None, None, None, None, None), (n + 1, "", "en", None, 0, 0, ""), (n + 2, out[0][1], "en", "s1", 1, 1, "x"), (n + 3, "wort " * 30_000, "en", "hot", 1, 1, "x")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup_matches_brute_force(docs, empty):
    groups = {}
    for r in rows():
        groups.setdefault(r[1] or "", []).append(r[0])
    got = {r["doc_id"]: r for r in exact_dedup.dedup_report(docs, 4).collect()}
    assert len(got) == len(rows())
    for text, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.dedup_report(empty, 4).count() == 0


def test_exact_dedup_keeps_one_of_equal_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b"), (3, "b"), (2, "b"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.dedup_report(docs, 2).collect()
    assert sorted((r["keep_id"] or 0, r["group_size"], r["kept"]) for r in got) == sorted([(0, 2, True), (0, 2, False), (3, 4, True)] + [(3, 4, False)] * 3)


def test_index_appends_only_new_digests(spark, docs):
    index = exact_dedup.DigestIndex(spark, "digest_index_test", 4)
    index.drop()
    d = exact_dedup.digests(docs)
    index.add(d)
    n = index.rows().count()
    index.add(d)
    assert index.rows().count() == n
    index.drop()


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out = f"file://{tmp_path}/tok"
    listed = token_files.write_token_files(docs, out, tokenizer_path(), files=3, frame_bytes=2000)
    got = token_files.with_starts(token_files.read_token_files(listed, with_ids=True), listed).orderBy("start").collect()
    start = 0
    for r, want in zip(got, sorted(rows()), strict=True):
        ids = [*t.encode(want[1] or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) == (want[0], start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert token_files.token_report(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a \n b", "a\n\n  b\tc", "x   y", "  x 　 y", "", " ", "<|endoftext|> a", "é è 中文 字"])
def test_cached_encoder_equals_the_library(text):
    e = token_files.DistinctEncoder(tokenizer_path())
    texts = ["warm up " + text, text, "up.\nwarm, " + text]
    assert e(pa.array(texts)) == [e.whole([t])[0].tobytes() for t in texts] == e(pa.array(texts))


def test_damaged_frame_is_noticed(spark, docs, tmp_path):
    listed = token_files.write_token_files(docs, f"file://{tmp_path}/d", tokenizer_path(), files=1).collect()
    data = bytearray(open(listed[0]["file"].removeprefix("file://"), "rb").read())
    import io

    good = token_files.FrameReader(io.BytesIO(bytes(data)))
    assert len(good.document(3)) == good.index[3]["n"]
    data[int(good.starts[0]) + 40] ^= 255
    with pytest.raises(Exception):  # noqa: B017  the decoder or the checksum
        token_files.FrameReader(io.BytesIO(bytes(data))).frame(0)


def test_golay_words_one_bit_apart_share_a_key():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 23, 500)
    y = x ^ (1 << rng.integers(0, 23, 500))
    keys = lambda v: {(w, c) for w, c in zip(*map(np.ndarray.tolist, simhash.codewords_near(v)), strict=True)}
    assert {w for w, _ in keys(x) & keys(y)} == set(range(500))


@pytest.mark.parametrize("limit", [1, 16])
def test_simhash_links_match_brute_force(spark, limit):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:40]:
        fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(8)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.components(simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), limit))
    got = {r["node"]: r["root"] for r in found.collect()}
    parent = {f: f for f in signed}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    assert {f: got.get(f, f) for f in signed} == {f: top(f) for f in signed}


def test_near_duplicates_keep_one_and_clean_rows(spark, empty):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [[word() for _ in range(300)] for _ in range(12)]
    near = [[*b[:150], word(), *b[151:]] for b in base[:6]]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(base + near + [[], []])], "doc_id long, text string")
    kept = {r[0] for r in simhash.keep_one_of_each(docs).select("doc_id").collect()}
    assert kept == {*range(12), 18}
    assert simhash.keep_one_of_each(empty).count() == 0 and simhash.simhash_report(empty).count() == 0


def test_near_duplicates_at_the_threshold(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    docs, pairs = [], {}
    for k in range(60):
        a = [word() for _ in range(400)]
        b = a[: 400 - k] + [word() for _ in range(k)]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        pairs[2 * k] = len(x & y) / len(x | y)
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    joined = {k: found[k] == found[k + 1] for k in pairs}
    assert len(found) == 120 and all(v in (k, k - k % 2) for k, v in found.items())
    assert all(joined[k] == (j >= 0.8) for k, j in pairs.items())


def test_shingles_decide_between_unsure_pairs(spark):
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in [(0, 100), (8, 100), (40, 140)]]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    nodes = docs.select(F.col("doc_id").alias("fp"), simhash.text_key().alias("text_key"))
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3)], "a long, b long")
    assert {tuple(r) for r in simhash._similar(pairs, nodes, docs, 5).collect()} == {(0, 1)}


def test_near_duplicates_tell_rows_without_an_id_apart(spark):
    rng = random.Random(11)
    a, b, c = (" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(100)) for _ in range(3))
    docs = spark.createDataFrame([(None, a), (None, b), (None, a), (7, b), (8, c), (8, a), (8, c)], "doc_id long, text string")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted([(7, b), (8, c), (8, a)])


def similar_pairs(texts):
    """Pairs of ``texts`` with 0.8 of their distinct shingles in common, and the least member of each one's component."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = list(range(len(sets)))
    for _ in sets:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return pairs, root


def found_components(spark, texts):
    found = simhash.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r["component_id"] for r in sorted(found)]


def random_words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def test_no_pair_below_the_threshold_is_linked(spark):
    rng = random.Random(12)
    line, texts = " ".join(random_words(rng, 12)), []
    for k in range(30):  # shares of 0.6 to 0.79
        a = random_words(rng, 300)
        b = a[: 225 + k] + random_words(rng, 75 - k)
        texts += [" ".join(a), " ".join(b if k < 29 else a[:230])]
    for k in (20, 50, 80):
        texts += [" ".join([*random_words(rng, 200), *[line] * k]) for _ in range(2)]
    assert not similar_pairs(texts)[0]
    assert found_components(spark, texts) == list(range(len(texts)))


def test_repeated_lines_hide_no_near_duplicate(spark):
    rng, texts = random.Random(13), []
    for k in (1, 5, 10, 20, 40):
        a = random_words(rng, 312)
        texts += [" ".join(a), " ".join(a + a[-12:] * k)]
    assert found_components(spark, texts) == [k - k % 2 for k in range(len(texts))]


def test_every_pair_at_the_threshold_is_found(spark):
    rng, texts = random.Random(14), []
    for k in range(150):  # shares about 0.8
        a = random_words(rng, 200)
        texts += [" ".join(a), " ".join(a[: 175 + k % 12] + random_words(rng, 25 - k % 12))]
    base = random_words(rng, 120)
    for _ in range(60):  # a group whose members are about as near
        w = list(base)
        for i in rng.sample(range(120), 2):
            w[i] = random_words(rng, 1)[0]
        texts.append(" ".join(w))
    pairs, root = similar_pairs(texts)
    assert len(pairs) > 150 and found_components(spark, texts) == root


def test_decontamination_matches_brute_force(spark, docs, empty):
    rng = random.Random(4)
    texts = [r[1] or "" for r in rows()]
    items = [(1, " ".join(texts[3].split()[:14])), (2, "ALPHA, Beta"), (3, ""), (4, None), (5, "not there at all " * 5), (6, texts[7]), (6, texts[7])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    got = {r["doc_id"]: r for r in decontaminate.decontamination_report(docs, bench).collect()}
    for doc_id, text, *_ in rows():
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        r = got[doc_id]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(found)), doc_id
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert decontaminate.decontamination_report(empty, bench).count() == 0
    assert decontaminate.decontamination_report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_of_rows_without_an_id(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(None, text, "k"), (None, "clean", "k"), (5, text, "k"), (5, text, "k"), (5, "other", "k")], "doc_id long, text string, text_hash string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.decontamination_report(docs, bench).collect())
    assert got == [(0, 1, 0, 0, False), (0, 11, 11, 1, True), (5, 1, 0, 0, False), (5, 11, 11, 1, True), (5, 11, 11, 1, True)]
    for share in (0.0, 0.5):
        assert sorted((r[0] or 0, *r[1:]) for r in decontaminate.drop_contaminated(docs, bench, share=share).collect()) == [(0, "clean", "k"), (5, "other", "k")]


def test_language_letters_and_clashing_columns(spark):
    data = [(k, t, lang, "mine", 7) for k, (t, lang) in enumerate([("der und die das", "de"), ("the and of to", "en")] * 20 + [("½ ² Ⅷ ① 12_", "en")])]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, lang_pred string, lang_score int")
    assert langid.language_report(docs).filter("doc_id = 40").first()["lang_pred"] == "und"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(data[:40])


def test_language_grams_match_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices("abcdé ß.1\n", k=rng.randrange(30)))
        words = re.findall(r"[^\W\d_]+", text.lower())
        grams = [f" {w} "[i : i + n] for w in words for n in (1, 2, 3, 4) for i in range(len(w) + 3 - n)]
        want = sum(g != " " for g in grams)
        assert langid.gram_counts(text, 256).sum() == want
    long = "ab cde " * 60_000
    assert (langid.gram_counts(long, 256) == 60_000 * langid.gram_counts("ab cde ", 256)).all()


def test_simhash_report_matches_brute_force(spark):
    import xxhash

    rng = random.Random(15)
    texts = [" ".join(random_words(rng, rng.randrange(0, 9))) for _ in range(60)] + ["A b C d", "a B c D", None, "", " \x0b "]
    texts += [f"{texts[3]} tail", *texts[:5], "x y " * 300]
    prints = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            for j in range(i):
                if (a ^ prints[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    got = simhash.simhash_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(k, f"{p:016x}", root[k]) for k, p in enumerate(prints)}


def test_language_is_told_on_held_out_rows(spark, empty):
    rng = random.Random(2)
    vocab = {"en": "the and of to in that with for".split(), "de": "der und die das nicht mit für ein".split(), "fr": "le la et des que pour dans une".split(), "es": "el los que por para una con del".split()}
    data = [(k, " ".join(rng.choices(vocab[lang], k=30)), lang) for k, lang in enumerate(list(vocab) * 60)] + [(900, "123 --", "en"), (901, None, "en"), (902, "", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.language_report(docs, 40).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in data[:240] if got[k]["held_out"])
    assert {got[k]["lang_pred"] for k in (900, 901, 902)} == {"und"} and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert langid.keep_identified(docs).count() == 240
    assert langid.language_report(empty).count() == 0


def test_mix_meets_targets(spark, docs, empty):
    rng = random.Random(8)
    data = [(k, " ".join(rng.choices(WORDS, k=rng.randint(1, 50))), f"s{k % 5}" if k % 3 else None) for k in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, mixing.mixing_report(docs, block_rows=200).collect())) for _ in range(2))
    assert a == b and len(a) == 3000
    source = {k: s for k, _, s in data}
    for s in {*source.values()}:
        own = [r for r in a if source[r[0]] == s]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= 5 and all(r[4] <= 2 * r[1] for r in own)
    total = sum(r[1] for r in a)
    assert abs(sum({source[r[0]]: r[3] for r in a}.values()) - 1.5 * total) < 1e-6 * total
    assert [r[:2] for r in a] == [(k, len(t.split())) for k, t, _ in data]
    assert mixing.mixing_report(empty).count() == 0 and mixing.take_mix(empty).count() == 0


def test_mix_of_skewed_sizes_comes_near_its_targets(spark):
    rng = np.random.default_rng(6)
    sizes = np.minimum(20_000, rng.lognormal(5, 1.3, 1500)).astype(int) + 1
    docs = spark.createDataFrame([(k, "w " * int(n), f"s{k % 6}") for k, n in enumerate(sizes)], "doc_id long, text string, source string")
    got = mixing.mixing_report(docs, block_rows=100).collect()
    for s in range(6):
        own = [r for r in got if r["doc_id"] % 6 == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(3 * min(r["size"] for r in own), 0.01 * own[0]["target"])


def test_mix_of_odd_rows(spark):
    odd = [(None, "a b", None, "x"), (None, "a b", None, "y"), (1, None, "s", "z"), (1, "", "s", "z"), (2, "c d e", "s", "z")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, source string, _copies string")
    got = mixing.mixing_report(docs).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == [(-1, 2), (-1, 2), (1, 0), (1, 0), (2, 3)]
    assert all(r["taken"] <= 2 * r["size"] for r in got) and mixing.take_mix(docs).columns == docs.columns


def test_cube_keeps_totals_and_probabilities():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 100, 500), np.full(500, 0.3)
    q = mixing.flight(p, size, rng, 20)
    assert ((q > 0) & (q < 1)).sum() <= 20 and abs(q.sum() - 150) < 1e-6 and abs(q @ size - p @ size) < 1e-4
    few, p = np.array([5000, 700, 600, 300, 200, 100, 50, 20, 10]), np.full(9, 0.3)
    mean = np.mean([mixing.landing(mixing.flight(p, few, g, 4), few, g) for g in map(np.random.default_rng, range(4000))], axis=0)
    assert np.abs(mean - 0.3).max() < 0.03


def test_sharding_keeps_columns_of_any_name(spark):
    names = "rank share mixed slice bucket n_source source_key place user_row".split()
    docs = spark.createDataFrame([(k, "t", "s", *[f"{k}{n}" for n in names]) for k in range(20)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = sharding.shard_rows(docs, 4)
    assert got.columns == [*docs.columns, "shard", "slot"]
    assert sorted(map(tuple, got.drop("shard", "slot").collect())) == sorted(map(tuple, docs.collect()))


def test_shards_are_even_and_proportional(docs, empty):
    got = sharding.shard_report(docs, bucket_rows=10).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    hot = [sum(r["source"] == "hot" for r in got if r["shard"] == s) for s in range(8)]
    assert max(hot) - min(hot) <= 2
    assert sharding.shard_report(empty).count() == 0
    assert sharding.shard_rows(docs).drop("shard", "slot").columns == docs.columns


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to serve you better.</div><article><h1>A title</h1><p>First &amp; <b>bold
 text</b> of the article, which goes on.<p>Second paragraph, long enough to be told.<script>var x = '</p>';</script></article>
<aside>See also</aside><div id="comments"><p>I like this article very much, thank you for it.</p></div><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "A title\nFirst & bold text of the article, which goes on.\nSecond paragraph, long enough to be told."
    assert html_extract.main_text(None) == html_extract.main_text("<p></p>") == ""


ARTICLE = "<article><h1>A title</h1><p>First text of the article, which goes on. It has two sentences.</article>"
ARTICLE_TEXT = "A title\nFirst text of the article, which goes on. It has two sentences."


@pytest.mark.parametrize(
    "before",
    [
        "<body><div><button>Share</div>",
        "<body><div><span><select><option>One<option>Two</span></div>",
        "<body><div><button><div>Share</div> it</button></div>",
        "<body><svg class=i />",
        "<body><a href=x>See<svg class=i><path d=x><g/></a>",
        "<body><svg><title>t</title><path d=x>",
        "<body><math/><iframe src=x />",
        "<html><head><title>t</title><meta charset=x><noscript><img src=x></noscript>",
        "<html><head><title>t</title><link rel=x><body>",
        "<div><noscript><p>One<p>Two</noscript><button>x<svg/></button></div>",
    ],
)
def test_unclosed_dropped_elements_swallow_no_article(before):
    assert html_extract.main_text(before + ARTICLE) == ARTICLE_TEXT


def test_text_ends_an_unclosed_head():
    text = "A text without any tag around it, long enough to be told. It goes on and on."
    assert html_extract.main_text("<head><title>t</title>" + text) == text


@pytest.mark.parametrize(
    "start",
    [
        "<div class='layout has-sidebar'>",
        "<div id=content class='no-sidebar'>",
        "<div class='page with_banner'>",
        "<div class='sidebar-layout'>",
        "<div class='search-page'><div id=main>",
    ],
)
def test_names_of_wrappers_lose_no_article(start):
    assert html_extract.main_text(start + ARTICLE) == ARTICLE_TEXT


def test_names_are_weighed():
    title = ARTICLE.replace("<h1>A title</h1>", "<div class='post-header'><h1>A title</h1></div>")
    assert html_extract.main_text(title) == ARTICLE_TEXT
    long = " ".join(f"Sentence {k} of a long text that stands in an oddly named element." for k in range(60))
    assert html_extract.main_text(f"<div class='promo-page'><div id=content><p>{long}</p></div></div>") == long
    comment = "<p>I like this article very much, thank you for it. I have read it twice. " + "It is good to read. " * 8
    for rest in (
        f"<div id=comments>{comment}</div>",
        f"<div id=comments><article class='comment-body'>{comment}</article></div>",
        "<div class='related-posts'><article><p>One more to read.</article><article><p>Another one to read.</article></div>",
    ):
        assert html_extract.main_text(ARTICLE + rest) == ARTICLE_TEXT


def test_min_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 7)
        s = [rng.uniform(-3, 3) for _ in range(n)]
        e = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6]
        cost = lambda x: sum(max(v, 0) if not t else max(-v, 0) for v, t in zip(s, x, strict=True)) + sum(w for a, b, w in e if x[a] != x[b])  # noqa: E731, B023
        best = min(cost([m >> k & 1 == 1 for k in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.min_cut(s, e)) - best) < 1e-6


def test_revisits(spark):
    schema = "record_id long, type string, url string, ts timestamp, etag string, last_modified string, headers map<string,string>"
    import datetime as dt

    t = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    data = [
        (1, "response", "http://www.a.org/x?b=1&a=2#f", t(0), '"1"', None, {"Content-Type": "text/html", "Date": "d0"}),
        (2, "response", "https://a.org:443/x?a=2&b=1", t(50), '"2"', None, {"Content-Type": "text/html", "Date": "d50"}),
        (3, "revisit", "http://a.org/x?a=2&b=1&utm_source=z", t(10), 'W/"1"', None, {"date": "d10", "Content-Length": "0"}),
        (4, "revisit", "http://a.org/x?a=2&b=1", t(120), '"1"', None, {}),
        (5, "revisit", "http://a.org/x?a=2&b=1", t(50), None, None, None),
        (6, "revisit", "http://b.org/", t(1), '"1"', None, {}),
        (7, "revisit", None, t(1), None, None, {}),
    ]
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(data, schema)).collect()}
    assert {k: (r["status"], r["response_id"]) for k, r in got.items()} == {3: ("resolved", 1), 4: ("changed", None), 5: ("unchecked", 1), 6: ("missing", None), 7: ("missing", None)}
    assert got[3]["headers"] == {"content-type": "text/html", "date": "d10"}


def test_ordinal_model_tells_toxic_words(spark, empty):
    rng = random.Random(7)
    data = [(k, " ".join(rng.choices(WORDS, k=30) + (["awful"] if k % 5 == 0 else [])), int(k % 5 == 0)) for k in range(600)]
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, t) for k, _, t in data], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_report(docs, labels).collect()}
    assert got == {k: not t for k, _, t in data}
    assert quality.quality_report(empty, labels.limit(0)).count() == 0


def test_pipeline_stages_keep_columns(spark, docs):
    import corpus_pipeline

    out = docs
    for name, step in corpus_pipeline.STAGES[:4]:
        out = step(spark, out, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
    assert corpus_pipeline.STAGES[4][1](spark, out, "").filter(F.col("n_tokens") < 1).count() == 0


def test_texts_just_below_the_threshold_are_not_paired(spark, monkeypatch):
    rng = random.Random(16)
    base, texts = random_words(rng, 150), []
    for k in range(150):  # 20 words of their own: 146 of 186 shingles in common
        texts.append(" ".join(base + random_words(rng, 20)))
        if k % 10 == 0:  # linked to that one only
            texts.append(texts[-1] + " " + " ".join(random_words(rng, 15)))
    paired, similar = [], simhash._similar

    def counted(pairs, *rest):
        paired.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(simhash, "_similar", counted)
    pairs, root = similar_pairs(texts)
    assert len(pairs) == 15 and found_components(spark, texts) == root
    assert sum(paired) <= 10 * len(texts)  # 12,527 when all of a bucket were compared

"""Hard negatives, prefix tries and packing against brute force and odd inputs."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.llm import hard_negatives, packing, prefix_trie, token_files
from tabulon.llm.queries import tokenizer_path

VECTORS = "vec_id long, label int, embedding array<double>, rid string, g int"


# ---------------------------------------------------------------- hard negatives


def vector_rows(seed=3, n=400, scale=1.0):
    """Clusters of vectors, with ties, copies and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    out = []
    for k in range(n):
        v = (centres[k % 6] + 0.2 * rng.normal(size=8)) * scale
        out.append((k * 10, int(k % 6 if k % 5 else rng.integers(6)), [float(x) for x in np.round(v, 1)], "u", 0))
    out += [(7, 1, None, "u", 0), (8, None, [1.0] * 8, "u", 0), (9, 1, [1.0, None] + [0.0] * 6, "u", 0), (11, 1, [math.inf] + [0.0] * 7, "u", 0), (12, 2, [math.nan] * 8, "u", 0)]
    out += [(None, 2, [float(x) for x in centres[2]], None, None), (100, 3, out[10][2], "u", 0), (200, 2, [], "u", 0), (13, 2, [float(centres[2][0])], "u", 0), (300, 4, [0.0] * 8, "u", 0)]
    return [*out, out[20]]


def brute_negatives(rows, positives=5, negatives=10):
    held = []
    for vec_id, label, v, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    key = lambda r: (-r[1], r[0] is None, r[0] or 0)
    for a, (anchor, label, v) in enumerate(held):
        if anchor is None or anchor % 100:
            continue
        scored = [(i, sum(x * y for x, y in zip(v, w)), other) for k, (i, other, w) in enumerate(held) if k != a]
        for p, score, _ in sorted([s for s in scored if s[2] == label], key=key)[:positives]:
            found = sorted([s for s in scored if s[2] != label and 30 * score <= 100 * s[1] <= 90 * score], key=key)[:negatives]
            out += [(anchor, p, k + 1, i, score, s) for k, (i, s, _) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("scale", [1.0, 1e6])  # the second is beyond what 64-bit floats hold
def test_hard_negatives_match_brute_force(spark, scale):
    rows = vector_rows(scale=scale)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted([tuple(r) for r in hard_negatives.hard_negative_report(df).collect()], key=str)
    want = brute_negatives(rows)
    assert got == want and len(want) > 500
    assert hard_negatives.hard_negative_report(df.limit(0)).count() == 0
    assert hard_negatives.hard_negative_report(df.filter("vec_id = 7")).count() == 0


def test_hard_negatives_in_many_cells(spark):
    rows = vector_rows()
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = spark.createDataFrame(rows, VECTORS).withColumn("label", label)
    got = hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0, cell_bytes=8000, references=4, sample_rows=20)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_negatives(rows)


def test_large_components_are_multiplied_exactly():
    def side(vectors):
        n = len(vectors)
        return pa.table({"rid": list(range(n)), "vec_id": list(range(n)), "label": [1] * n, "vec": [hard_negatives._coded(np.array(v)) for v in vectors],
                         "angles": [b""] * n, "norm": [float(np.linalg.norm(v)) for v in vectors]})

    big = [[2.0**40, 1.0], [2.0**40 + 1, -1.0], [3.0, 5.0]]
    cell = hard_negatives.Cell(side(big), side(big))
    assert not cell.exact
    assert cell.scores([0], np.arange(3)).tolist()[0] == [2**80 + 1, 2**80 + 2**40 - 1, 3 * 2**40 + 5]


def test_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    m = np.floor(256 * np.concatenate([centres[k % 8] + 0.05 * rng.normal(size=16) for k in range(800)]).reshape(800, 16))
    u = hard_negatives._unit(m)
    refs = hard_negatives._unit(centres)
    n = len(m)
    t = pa.table({"rid": range(n), "vec_id": range(n), "label": [0] * n, "vec": [hard_negatives._coded(v) for v in m],
                  "angles": [a.astype("<f4").tobytes() for a in np.arccos(np.clip(u @ refs.T, -1, 1))], "norm": np.linalg.norm(m, axis=1)})
    cell = hard_negatives.Cell(t.slice(0, 40), t)
    spared = []
    for a in range(40):
        low, high = cell.bounds(a)
        exact = m @ m[a]
        assert (low <= exact).all() and (exact <= high).all()
        of = np.sort(exact)[-6]
        spared.append((high < of).mean())
    assert np.mean(spared) > 0.5


# ---------------------------------------------------------------- prefix tries


def conversation_rows(seed=5, n=260):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        if c % 100 == 0 and c == 200:
            continue  # a hundred without its first conversation
        for turn in range(rng.randint(1, 7)):
            out.append((c, turn, rng.choice(["user", None, "assistant"]), rng.choice(["hi", "hi there", "", None, "ünïcode"]) if turn < 3 else f"text {rng.randint(0, 3)}", "x", 1))
    out += [(3, None, "user", "first", "x", 1), (5, 2, "user", "tie", "x", 1), (5, 2, "user", "tie", "x", 1), (None, 0, "user", "none", "x", 1), (-250, 0, "user", "hi", "x", 1), (10**15, 0, "a", "far", "x", 1)]
    return out


def digest(role, text):
    return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()


def brute_trie(rows, rebuild):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), len(text or "")))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, turns in own.items():
        if rebuild:
            h = zlib.crc32(str(c).encode()) % 6
            base = c - int(math.fmod(c, 100))
            convs[c] = own.get(base, [])[:h] + turns[h:]
        else:
            convs[c] = turns
    nodes, children, chars = {}, {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            path = tuple(t[0] for t in turns[:d])
            nodes.setdefault(path, []).append(c)
            chars[path] = turns[d - 1][1] if d else 0
            if d:
                children.setdefault(path[:-1], set()).add(path)
    sums = {}
    for path in sorted(nodes, key=len, reverse=True):
        kids = children.get(path, ())
        sums[path] = (sum(sums[k][0] for k in kids) if kids else 1, (len(nodes[path]) - 1) * chars[path] + sum(sums[k][1] for k in kids))
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children.get(path, ())), *sums[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string, digest string, shard int"


def test_trie_matches_brute_force(spark):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, CONVERSATIONS)
    assert sorted([tuple(r) for r in prefix_trie.trie_report(df).collect()], key=str) == brute_trie(rows, True)
    plain = prefix_trie.conversation_trie(df).drop("key", "parent")
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted([tuple(r) for r in plain.select(*order).collect()], key=str) == brute_trie(rows, False)
    assert prefix_trie.trie_report(df.limit(0)).count() == 0


def test_small_shards_meet(spark):
    rows = conversation_rows(n=120)
    rows += [(c, t, "user", f"same {t}", "x", 1) for c in range(1000, 1100) for t in range(4)]  # a third of all: copies
    rows += [(5000, t, "user", "long " * 50 + str(t % 7), "x", 1) for t in range(600)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    turns = prefix_trie.digested_turns(df)
    got = prefix_trie.prefix_trie(prefix_trie.with_all(turns), shard_convs=7, shard_turns=40)
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted([tuple(r) for r in got.select(*order).collect()], key=str) == brute_trie(rows, False)


# ---------------------------------------------------------------- packing


def packing_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length int")


def text_rows(n=300, seed=2):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta, eta. theta! ünïcode 漢字 12345".split()
    out = [(k, " ".join(rng.choices(words, k=int(rng.paretovariate(1) * 20) % 4000)), "x", 1) for k in range(n)]
    return [*out, (None, "no id", "x", 1), (None, "no id", "x", 1), (7, out[7][1], "x", 1), (n, None, "x", 1), (n + 1, "", "x", 1), (n + 2, "word " * 20_000, "x", 1), (n + 3, "a <|endoftext|> b<|endoftext|>", "x", 1)]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = text_rows()
    docs = packing_docs(spark, rows).repartition(3)
    pieces = packing.write_sequences(packing.pack_documents(docs, tokenizer_path())).collect()
    sequences, texts = {}, {}
    for r in pieces:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert r["length"] == len(ids) > 0 and r["ids_crc32"] == zlib.crc32(r["ids"])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        texts.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    total = pad = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        total, pad = total + at, pad + packing.padding(at, 1024)
    assert pad < 0.01 * total
    want = {}
    for doc_id, text, *_ in rows:
        want.setdefault(doc_id, []).append([*t.encode(text or "", add_special_tokens=False).ids, 0])
    for doc_id, docs_of in want.items():
        got = sorted(texts[doc_id], key=lambda p: (p[0]))
        assert sum(len(p[1]) for p in got) == sum(map(len, docs_of))
        if len(docs_of) == 1:
            assert [i for p in got for i in p[1]] == docs_of[0]
            assert {p[2] for p in got} == {len(docs_of[0])}
    assert packing.packing_report(packing_docs(spark, []), tokenizer_path()).count() == 0


def test_cuts_follow_the_classes():
    for capacity in (1024, 1000, 16, 7):
        for n in range(1, 3 * capacity + 1):
            cuts = packing.classes_of(n, capacity, 1 / 32)
            assert sum(c[0] for c in cuts) == n
            assert all(0 < length * j <= capacity for length, j in cuts)
    cuts = [packing.classes_of(n, 1024, 1 / 32) for n in range(1, 1024)]
    assert sum(map(len, cuts)) / len(cuts) < 2.5
    assert sum(1024 / j - length for c in cuts for length, j in c) < 0.005 * 1024 * 1023 / 2


def test_special_strings_are_tokens_unless_told(spark):
    texts = pa.array(["a <|endoftext|> b<|endoftext|>", "plain text", "<|endoftext|>"])
    plain = token_files.DistinctEncoder(tokenizer_path())
    assert np.frombuffer(plain(texts)[2], dtype="<u4").tolist() == [50256]
    assert plain(texts) == [plain.whole([t])[0].tobytes() for t in texts.to_pylist()]
    text = token_files.DistinctEncoder(tokenizer_path(), special=False)
    assert 50256 not in np.frombuffer(text(texts)[0], dtype="<u4")
    assert text(texts) == [text.whole([t])[0].tobytes() for t in texts.to_pylist()]


def test_null_and_lowest_ids_stay_apart(spark):
    docs = spark.createDataFrame([(None, "b"), (-(2**63), "a"), (2**63 - 1, "c"), (None, "a")], "doc_id long, text string")
    got = [r["doc_id"] for r in token_files.token_report(docs, tokenizer_path(), files=2).orderBy("start").collect()]
    assert got == [None, None, -(2**63), 2**63 - 1]

"""Importance resampling, vector codes and SimHash against plain versions of themselves."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from demoflux.llm import importance, simhash, vector_codes, words

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
own = random.Random(11)
VOCABULARY = ["".join(own.choice("abcdefgh") for _ in range(own.randint(2, 7))) for _ in range(200)]


def prose(n, seed):
    it = random.Random(seed)
    return " ".join(it.choice(VOCABULARY) for _ in range(n))


BASE = prose(150, 1)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace(BASE.split()[60], "changed", 1)), (4, None), (5, ""), (6, " \n\t"),
    (7, "Été ÉTÉ " * 20 + prose(40, 2)), (8, prose(3, 3)), (9, prose(9000, 4)), (9, prose(9000, 4)), (10, "ab " * 400),
    (None, "no id " + prose(60, 6)), (None, "no id " + prose(70, 7)), (11, "One, TWO;three four 5six\x1fseven"), (12, "Two words"),
] + [(i, prose(own.randint(5, 60), i)) for i in range(20, 140)]
COLUMNS = "doc_id bigint, text string, score string, rank int, print string, n int, behind string, at string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", 1, "p", 2, "b", "a") for i, t in TEXTS], COLUMNS).repartition(5)


def test_words_come_in_pieces():
    text = ("Aé " * 50 + "x" * 40 + "\n" + "b ").encode()
    table = words.word_table(words.BLANKS)
    for piece in (1, 7, 64, 1 << 20):
        assert [w for part in words.word_pieces(text, table, piece) for w in part] == [b"a\xc3\xa9"] * 50 + [b"x" * 40, b"b"]
    assert list(words.word_pieces(b" \n ", table)) == []


def plain_features(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
    return len(found), found + [f"{a} {b}" for a, b in zip(found, found[1:])]


def plain_draw(texts, targets, share, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (collections.Counter(bucket(f) for x in some for f in plain_features(x)[1]) for some in ([x for _, x in texts], targets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for i, text in texts:
        n, features = plain_features(text)
        weight = sum(gain(bucket(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], -r[2], -r[1]))
    ranks = collections.defaultdict(list)
    for k, r in enumerate(able[:len(able) * share // 100], 1):
        ranks[tuple(r[:4])].append(k)
    return sorted(((*r[:4], ranks[tuple(r[:4])].pop(0) if ranks[tuple(r[:4])] else None) for r in rows), key=repr)


@pytest.mark.parametrize("share,least", [(25, 20), (100, 1), (0, 20), (3, 5)])
def test_resampling_equals_a_plain_draw(spark, docs, share, least):
    targets = [prose(200, 500), None, "", BASE]
    got = importance.resample(docs, spark.createDataFrame([(1, t) for t in targets], "item_id int, text string"), (share, 100), least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == plain_draw(TEXTS, targets, share, least)


def test_resampling_of_nothing(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert importance.resample(none, none).collect() == []
    assert importance.resample(docs, none).filter("rank is not null").count() == sum(plain_features(t)[0] >= 20 for _, t in TEXTS) // 4


def test_bisection_finds_exact_cuts(spark):
    values = [own.choice([-5, 0, 0, 0, 3, 1 << 40, -(1 << 62)]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for wanted in (1, 150, 300):
        assert importance.smallest_reaching(df, "v", wanted) == sorted(values)[wanted - 1]


def plain_codes(rows, parts, k, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    m = np.floor(1024 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    d = m.shape[1] // parts
    codes, error, books = [], np.zeros(len(rows), np.int64), []
    for p in range(parts):
        x = m[:, p * d:(p + 1) * d]
        book = x[:k].copy()
        for step in range(rounds + 1):
            far = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            near = far.argmin(axis=1)
            if step < rounds:
                for e in np.unique(near):
                    inside = x[near == e]
                    book[e] = [int(v) // len(inside) for v in inside.sum(axis=0)]
        codes.append(near)
        error += far.min(axis=1)
        books.append(book)
    labels = collections.Counter()
    for r, e in zip(rows, error.tolist()):
        labels[r[2]] += e
    found = [(r[0], "".join(f"{c[i]:02x}" for c in codes), int(error[i]), labels[r[2]]) for i, r in enumerate(rows)]
    return sorted(found, key=repr), hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def vectors_of(n, length, spread, seed):
    it = np.random.default_rng(seed)
    centres = it.normal(size=(9, length))
    return (centres[it.integers(0, 9, n)] + spread * it.normal(size=(n, length))).astype(np.float32)


@pytest.mark.parametrize("n,length,spread,k", [(700, 16, 0.01, 32), (700, 16, 1.0, 32), (300, 8, 0.0, 256), (40, 8, 0.3, 256), (5, 4, 1.0, 7), (1, 4, 1.0, 3)])
def test_codes_equal_plain_rounds(spark, n, length, spread, k, monkeypatch):
    rows = [(i // 2 if i < 20 else i, v.tolist(), None if i % 7 == 0 else i % 3) for i, v in enumerate(vectors_of(n, length, spread, n))]
    if n > 100:
        rows[150:190] = [(i + 150, [1e4] * length, 2) for i in range(40)]  # far from all others
        rows[260] = (None, rows[3][1], 1)
    odd = [(1, None, 1), (2, [float("nan")] * length, 1), (3, [None] * length, 1), (4, [float("inf")] + [0.0] * (length - 1), None),
           (10_001, [1.0] * (length + 4), 1), (10_002, [], 1), (10_003, [1.0] * (length + 1), 1)]
    df = spark.createDataFrame(
        [(*r, "x", 1) for r in rows + odd], "vec_id bigint, embedding array<float>, label int, code string, error int").repartition(3)
    codes, books = vector_codes.compress(df, entries=k)
    want, digest = plain_codes(rows, 4, k, 4)
    assert sorted(map(tuple, codes.collect()), key=repr) == want
    assert vector_codes.digest(books) == digest


def test_whole_nodes_take_their_sums_at_once():
    points = np.floor(1000 * vectors_of(2000, 4, 0.001, 5)).astype(np.int64)
    tree = vector_codes.Tree(points[vector_codes.tree_order(points, 6)], 6)
    entries = points[np.unique(points // 200, axis=0, return_index=True)[1]][:8]
    whole, single = vector_codes.nearest(tree, vector_codes.Codebook(entries))
    taken = sum(int((ends - begins).sum()) for level, nodes, _ in whole if len(nodes) for begins, ends in [tree.stretch(int(level[0]), nodes)])
    assert taken + sum(end - begin for begin, end, _ in single) == 2000 and taken > 1000


def test_codes_of_nothing_and_far_components(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert vector_codes.codes_query(empty).collect() == []
    far = spark.createDataFrame([(1, [3e38] * 4, 1), (2, [-3e38] * 4, 1), (3, [0.0] * 4, 1)], "vec_id bigint, embedding array<float>, label int")
    codes, books = vector_codes.compress(far, entries=2)
    bound = vector_codes.bound_of(4)
    assert [int(e[0]) for e in books[0]] == [bound // 2, -bound] and len(codes.collect()) == 3


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL))
    runs = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    codes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def plain_components(prints):
    values = np.array(prints, np.uint64)
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2):
            a, b = root[i], root[j]
            if a != b:
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash_equals_all_pairs(docs):
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_query(docs).collect() if r["doc_id"] is not None)
    prints = [plain_print(t) for _, t in TEXTS]
    roots = plain_components(prints)
    least = {}
    for (i, _), r in zip(TEXTS, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert got == sorted((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(TEXTS, prints, roots) if i is not None)
    assert {r["component_id"] for r in simhash.simhash_query(docs).filter("doc_id is null").collect()} == {None}


def test_simhash_of_nothing(spark):
    assert simhash.simhash_query(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def flips(centre, n, bits, seed):
    it = random.Random(seed)
    return [centre ^ sum(1 << b for b in it.sample(range(64), it.randint(0, bits))) for _ in range(n)]


@pytest.mark.parametrize("block", [2, 20, 4096])
def test_links_of_crowded_postings(spark, block):
    it = random.Random(2)
    low = [0x0123456789AB0000 | it.getrandbits(16) for _ in range(300)]  # six equal bytes
    values = sorted({*flips(0x5555, 300, 4, 1), *flips((1 << 64) - 1, 200, 2, 2), *low, *(it.getrandbits(64) for _ in range(200)), 0, 1, 7})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links_of(spark.createDataFrame([(v,) for v in signed], "print bigint"), block).collect()
    place = {v: i for i, v in enumerate(signed)}
    a, b = (np.array([place[r[c]] for r in links], np.int64) for c in ("a", "b"))
    assert all(bin(values[i] ^ values[j]).count("1") <= 48 for i, j in zip(a, b))
    assert simhash.smallest_links(len(values), a, b).tolist() == plain_components(values)


def test_every_link_shares_an_entry_of_the_index():
    for bits in ((0, 63), (7, 8), (15, 16), (31, 32), (3, 4)):
        a = 0x0F1E2D3C4B5A6978
        b = a ^ sum(1 << x for x in bits)
        for choices in (simhash.ENTRIES, simhash.CHOICES):
            assert any((a ^ b) & simhash.mask_of(c) == 0 for c in choices)
    assert len(simhash.ENTRIES) == 6 and len(simhash.CHOICES) == 28

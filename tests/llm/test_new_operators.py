"""Vector codes, source divergences and repeated passages against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from answerflow.llm import codes, divergence, preferences, quality, repeats, vectors
from answerflow.llm.common import join_groups, table
from tests.llm import brute


def both(df):
    return [df, df.where("1 = 0")]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 28), st.integers(0, 2**32 - 1))
def test_products_of_limbs_are_exact(width, bits, seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(-(1 << bits), 1 << bits, (n, width)) for n in (7, 5))
    want = a.astype(object) @ b.astype(object).T
    assert (codes.exact_product(a, b) == want.astype(np.int64)).all()
    entry, distance = codes.nearest(a, b)
    for x, e, d in zip(a.tolist(), entry, distance):
        all_of = [sum((p - q) ** 2 for p, q in zip(x, y)) for y in b.tolist()]
        assert (all_of.index(min(all_of)), min(all_of)) == (e, d)


def test_limbs_stay_below_the_exact_bound():
    for width in (1, 2, 7, 8, 9, 64, 1000):
        bits = codes.limb_bits(width)
        assert width << (2 * bits) <= 1 << 53 < width << (2 * bits + 2)
    v = np.array([[(1 << 27) - 1, -(1 << 27) + 1, 0, -1]])
    parts = codes.limbs(v, 10)
    assert len(parts) == 3 and (sum(p.astype(np.int64) << (10 * i) for i, p in enumerate(parts)) == v).all()


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(10).round(3).tolist(), i % 3 if i % 7 else None) for i in range(200)]
    rows += [(200 + i, rows[5][1], 1) for i in range(60)]  # ties and a hot label
    rows += [(7, rows[7][1], 2), (7, rows[7][1], 2)]  # a repeated id
    rows += [(300, [1000.5] * 10, 5), (301, [-1000.25] * 10, 5)]
    dropped = [(-1, None, 1), (-2, [None] + [1.0] * 9, 1), (-3, [float("nan")] * 10, 1), (-4, [float("inf")] + [0.0] * 9, 1),
               (400, [1.0] * 4, 1), (401, [1e300] * 10, 1), (402, [], 1)]
    return rows, dropped


def test_codes(spark):
    rows, dropped = vector_rows()
    schema = "vec_id long, embedding array<double>, label int, code string, error int, id string, ints int, _n int"
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows + dropped], schema).repartition(5)
    got, books = codes.compress(df, scale=4096, parts=8, entries=16, rounds=6)
    got = got.collect()
    kept = sorted(rows, key=lambda r: (r[0], [int(np.floor(4096 * x)) for x in r[1]]))
    want, want_books = brute.codes([(i, v) for i, v, _ in kept], 4096, 8, 16, 6)
    assert [b.tolist() for b in books] == want_books
    assert Counter((r.id, r.code, r.error) for r in got) == Counter(want)
    sums = Counter()
    for (_, _, label), (_, _, error) in zip(kept, want):
        sums[label] += error
    assert all(r.label_error == sums[r.label] for r in got)
    again, books_again = codes.compress(df.repartition(2))
    assert codes.fingerprint(books) == codes.fingerprint(books_again) and Counter(again.collect()) == Counter(got)


def test_codes_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    got, books = codes.compress(spark.createDataFrame([], schema))
    assert got.collect() == [] and books == []
    got, books = codes.compress(spark.createDataFrame([(None, [0.5, -0.5], None), (3, [0.25, 1.0], None)], schema), parts=2)
    assert [b[:, 0].tolist() for b in books] == [[1024, 2048], [4096, -2048]]
    assert sorted((r.id or 0, r.code, r.error, r.label_error) for r in got.collect()) == [(0, "0101", 0, 0), (3, "0000", 0, 0)]
    got, books = codes.compress(spark.createDataFrame([(1, [], 1), (2, [], 1)], schema))
    assert {(r.code, r.error) for r in got.collect()} == {("00" * 8, 0)}


@pytest.mark.parametrize("tile, together, held", [(256, 2048, 500_000), (2, 3, 4)])
def test_divergence(spark, documents, sf, monkeypatch, tile, together, held):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "TERMS_TOGETHER", together)
    monkeypatch.setattr(divergence, "HELD_ENTRIES", held)
    monkeypatch.setattr(divergence, "SPILLED_TOGETHER", held)
    rng = random.Random(1)
    terms = ["Über", "straße", "a", "B", "été", "d", "naïve", "zebra9zoo", "你好"]
    mixed = [(rng.choice(["en", "de", None, ""]), rng.choice("abcdefg"), " ".join(rng.choices(terms, k=rng.randrange(30)))) for _ in range(150)]
    mixed += [("xx", "alone", "word"), ("yy", "a", None), ("yy", "b", "12 34"), ("en", "silent", None)]
    made = spark.createDataFrame([(*r, "n", "v") for r in mixed], "lang string, source string, text string, term string, value string")
    for df, least in [(made, 3), (made, 1), (documents, 2), *([(table(spark, sf, "documents"), 10)] if tile > 2 else [])]:
        rows = df.select("lang", "source", "text").collect()
        got = divergence.audit(df.repartition(7), least_docs=least, top=4)
        assert Counter(map(tuple, got.collect())) == Counter(brute.divergences(rows, least, 4))
    assert divergence.audit(made.where("1 = 0")).count() == 0


def test_shares_do_not_overflow():
    big = np.array([10**12, 9 * 10**14], np.int64)
    size = np.array([3 * 10**12, 10**15], np.int64)
    assert divergence.share(big, size).tolist() == [1 + 10**9 * (int(c) + 2) // int(s) for c, s in zip(big, size)]


def passages(seed, vocabulary):
    """Documents with passages of others, near copies, a passage in a third of all, and runs of one word."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    shared = [fresh(rng.randrange(5, 40)) for _ in range(6)]
    rows = []
    for i in range(120):
        body = fresh(rng.randrange(0, 30))
        if i % 3 == 0:
            body = fresh(rng.randrange(5)) + shared[0][:9] + fresh(rng.randrange(5)) + body
        if rng.random() < 0.6:
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            body += p[a : a + rng.randrange(1, 40)] + fresh(rng.randrange(6))
        if rng.random() < 0.2 and rows:
            body = rng.choice(rows)[1].split() + body
        if rng.random() < 0.1:
            body += ["same"] * rng.randrange(30)
        rows.append((rng.randrange(200) if i % 11 else None, "  ".join(body)))
    return rows + rows[:7] + [(500, None), (501, ""), (502, " \n\t"), (503, "one")]


@pytest.mark.parametrize("crowd, block, at_once", [(4_096, 1 << 19, 1 << 20), (2, 40, 50), (4_096, 1, 9)])
def test_repeats(spark, monkeypatch, crowd, block, at_once):
    monkeypatch.setattr(repeats, "IN_ONE_BLOCK", crowd)
    monkeypatch.setattr(repeats, "BLOCK_WORDS", block)
    for seed, vocabulary in ((1, 500), (2, 3)):
        rows = passages(seed, vocabulary)
        df = spark.createDataFrame([(*r, "p", 1, "w") for r in rows], "doc_id long, text string, piece string, start int, words string")
        got = repeats.without_repeats(df.repartition(6), window=8, anchor=4)
        assert Counter((r.id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == Counter(brute.repeats(rows, 8))


def test_repeats_on_documents(spark, documents, sf):
    for df in [*both(documents), table(spark, sf, "documents")]:
        rows = df.select("doc_id", "text").collect()
        got = repeats.without_repeats(df)
        assert Counter((r.id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == Counter(brute.repeats(rows, 50))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=5), st.integers(1, 9), st.integers(1, 9), st.integers(1, 30))
def test_pieces_hold_every_window_once(docs, anchor, more, at_once):
    window = anchor + more - 1
    words = np.array([w + 7 for d in docs for w in d], np.uint64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    starts, sizes, anchors, pieces = repeats.cut_pieces(words, doc, window, anchor)
    covered = [i for s, n in zip(starts, sizes) for i in range(s, s + n - window + 1)]
    want = [i for i in range(len(words) - window + 1) if doc[i] == doc[i + window - 1]]
    assert sorted(covered) == want
    by_window = {}
    for s, n, a in zip(starts.tolist(), sizes.tolist(), anchors.tolist()):
        for i in range(s, s + n - window + 1):
            assert by_window.setdefault(words[i : i + window].tobytes(), a) == a
    text = {}
    for s, n, p in zip(starts.tolist(), sizes.tolist(), pieces.tolist()):
        assert text.setdefault(p, words[s : s + n].tobytes()) == words[s : s + n].tobytes()


def test_run_hashes():
    words = np.random.default_rng(0).integers(0, 1 << 63, 70).astype(np.uint64)
    for size in (1, 2, 3, 7, 8, 20, 50, 70, 71):
        got = repeats.run_hashes(words, size)
        want = [sum(int(w) * pow(repeats.BASE, size - 1 - j, 1 << 64) for j, w in enumerate(words[i : i + size])) % (1 << 64) for i in range(70 - size + 1)]
        assert got.tolist() == want


def test_groups_joined_by_size(spark):
    rows = spark.createDataFrame([(None, i) for i in range(900)] + [(i % 300, i) for i in range(600)], "k int, v int")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n").where("k is null or k < 250")
    got = join_groups(rows, groups, ["k"], "n")
    assert Counter((r.k, r.n) for r in got.collect()) == Counter({(None, 900): 900} | {(k, 2): 2 for k in range(250)})


def test_very_large_and_small_vectors_link(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-310, 1e-310]), (4, [3.0, 3.0]), (5, [1e300, -1e300]), (6, [0.0, 0.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {(r.vec_id, r.n_links, r.component_id) for r in got.collect()} == {(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 0, 5), (6, 0, 6)}


def test_a_label_does_not_judge_its_own_row(spark):
    docs = spark.createDataFrame([(1, "some words here", "en", "a"), (2, "some words here", "en", "b")], "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    rows = {r.id: r for r in quality.score(docs, known).collect()}
    assert rows[1].site_good == pytest.approx(0.5) and rows[2].site_good == pytest.approx(0.5)
    assert rows[1].kept and rows[2].kept and quality.keep(docs, known).count() == 2


def test_pairs_that_repeat_or_have_no_id(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, "user", "hi")],
        "conv_id long, turn long, role string, text string",
    )
    one = [("prompt", "<|user|>\nhi<|end|>\n"), ("chosen", "<|assistant|>\nyes<|end|>\n"), ("rejected", "<|assistant|>\nno<|end|>\n")]
    for pair_ids in ([7, 7], [None], [None, None, 3]):
        pairs = spark.createDataFrame([(p, 1, 2) for p in pair_ids], "pair_id long, chosen long, rejected long")
        got = preferences.preferences(turns, pairs).collect()
        assert Counter((r.pair_id, r.part, r.text) for r in got) == Counter((p, *x) for p in pair_ids for x in one)
    # Two different pairs under one id.
    pairs = spark.createDataFrame([(7, 1, 2), (7, 1, 3)], "pair_id long, chosen long, rejected long")
    got = preferences.preferences(turns, pairs).collect()
    assert Counter((r.part, r.text) for r in got) == Counter([*one, one[0], one[1]])

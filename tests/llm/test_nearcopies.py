"""Near copies of the pipeline against all pairs of texts."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tagmill.llm import nearcopies
from tagmill.llm.words import Words, grams

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_sets_have_the_sizes_of_the_texts():
    texts = ["one two three four five six", "One, two three four FIVE six!", "a b", "a", "", "x " * 40, "é é é é é é ß"]
    w = Words([t.encode() for t in texts])
    sets = nearcopies.shingle_set(w, 5)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[0] == sets[1]).all() and not np.intersect1d(sets[2], sets[3]).size


def test_hashes_do_not_depend_on_the_place():
    a, b = Words([b"zz one two three"]), Words([b"one two three"])
    assert (grams(a.hash, 3)[1:] == grams(b.hash, 3)).all()
    assert (nearcopies.fingerprints_of(Words([b"q q", b"one two three"]), 2, 3)[1] == nearcopies.fingerprints_of(b, 2, 3)[0]).all()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(3000)]
    out = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(60, 400))
        out.append(base)
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(copy)
    rng.shuffle(out)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


def test_classes(spark, texts):
    got = {r.doc_id: r.keep_id for r in nearcopies.near_copies(spark.createDataFrame([(*t, "x") for t in texts], "doc_id BIGINT, text STRING, node STRING")).collect()}
    sets = [shingles(t) for _, t in texts]
    close = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in close:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(len(texts))}
    assert all(want[i] == want[got[i]] for i in got)  # nothing unlike is put together
    found = sum(got[i] == got[j] for i, j in close)
    assert found >= 0.97 * len(close) > 20


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "a b"), (5, "A, b"), (5, "A, b"), (None, "a b"), (6, "b a")]
    got = sorted((r.doc_id, r.keep_id) for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect())
    assert got == [(4, 4), (5, 4), (5, 4), (6, 6)]
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0


def test_equal_hashes_of_unlike_texts(spark, texts, monkeypatch):
    """With names of six bits nearly every node clashes, and the classes are the same."""
    rows = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    want = sorted(map(tuple, nearcopies.near_copies(rows).collect()))
    plain = nearcopies._node
    monkeypatch.setattr(nearcopies, "_node", lambda x: plain(x) & np.uint64(63))
    w = Words([t.encode() for _, t in texts])
    sets = nearcopies.shingle_set(w, 5)
    clash = {}
    for x in sets:
        clash.setdefault(int(nearcopies._node(x)), int(nearcopies._check(x)))
    names = {int(nearcopies._name(x, clash)) for x in sets}
    assert len(names) == len({x.tobytes() for x in sets}) > len({int(nearcopies._node(x)) for x in sets})
    assert sorted(map(tuple, nearcopies.near_copies(rows).collect())) == want


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(2)
    for n in (1, 3, 4, 9, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        for m in (0, n // 2, n):
            b = np.unique(np.concatenate([a[:m], rng.integers(0, 1 << 63, max(2 * n - m, 1), np.uint64)]))
            shared = len(np.intersect1d(a, b))
            assert shared <= nearcopies.most_shared(nearcopies.sketch(a), nearcopies.sketch(b)) == nearcopies.most_shared(nearcopies.sketch(b), nearcopies.sketch(a))
        assert nearcopies.most_shared(nearcopies.sketch(a), nearcopies.sketch(a)) == len(a)


def edited(base, places):
    """The words with new ones at the places."""
    return [f"new{p}" if p in places else w for p, w in enumerate(base)]


def test_every_pair_at_the_threshold_is_found(spark):
    """Pairs without a third copy, similarity 0.80 to 0.84, scattered edits: all of them end in one class."""
    rng = random.Random(11)
    rows, close = [], []
    for k in range(400):
        n = rng.randint(100, 600)
        base = [f"w{rng.randrange(50_000)}" for _ in range(n)]
        edits = int(n * rng.uniform(0.017, 0.024)) or 1
        pair = [" ".join(base), " ".join(edited(base, {int((i + 0.5) * n / edits) for i in range(edits)}))]
        rows += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
        if 0.8 <= similarity(*map(shingles, pair)) < 0.84:
            close.append(k)
    assert len(close) > 80
    got = {r.doc_id: r.keep_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert [k for k in close if got[2 * k] != got[2 * k + 1]] == []


def test_copies_that_hang_on_an_unlike_text(spark):
    """A large family on one base: near fingerprints all around, but only the two of each couple are alike."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(50_000)}" for _ in range(900)]
    rows = []
    for k in range(150):
        own = list(base)
        for p in rng.sample(range(900), 14):
            own[p] = f"own{k}x{p}"
        other = list(own)
        for p in rng.sample(range(900), 13):
            other[p] = f"other{k}x{p}"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    sets = [shingles(t) for _, t in rows]
    close = [(i, j) for i in range(300) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    assert 140 < len(close) < 400
    got = {r.doc_id: r.keep_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert [(i, j) for i, j in close if got[i] != got[j]] == []

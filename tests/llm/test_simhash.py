"""Fingerprints, links and classes against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tagmill.llm import simhash
from tagmill.llm.components import connected_components


def slow(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def classes(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abAÉé\xa0\x1c \t\n\x0b", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow(text)


def test_fingerprint_of_long_text():
    text = " ".join(random.Random(1).choices(["one", "two", "three", "Four"], k=3000))
    assert simhash.fingerprint(text) == slow(text)


@pytest.mark.parametrize("bits", range(8))
def test_position_sets_cover(bits):
    sets = simhash.position_sets(bits)
    assert all(any(set(s) <= set(equal) for s in sets) for equal in combinations(range(8), 8 - bits))
    assert len(sets) == len(set(sets))
    if bits == 4:
        assert len(sets) == 20


def _cloud(n, spread, seed):
    rng = random.Random(seed)
    base = rng.getrandbits(64)
    out = {base}
    while len(out) < n:
        x = base
        for _ in range(rng.randint(1, 9)):
            x ^= 1 << rng.randrange(spread)
        out.add(x)
    return np.array(sorted(out | {rng.getrandbits(64) for _ in range(n // 4)}), np.uint64)


@pytest.mark.parametrize(("n", "spread"), [(300, 64), (400, 12), (12_000, 20)])
def test_links_span_all_components(spark, n, spread):
    """The last case has lists that are longer than they may be, so they are dealt again."""
    points = _cloud(n, spread, n)
    got = simhash.links(spark.createDataFrame(pd.DataFrame({"fp": points.view(np.int64)})), 4, 8192)
    signed = points.view(np.int64).tolist()
    place = {p: i for i, p in enumerate(signed)}
    edges = [(place[r.a], place[r.b]) for r in got.collect()]
    assert all(int(points[a] ^ points[b]).bit_count() <= 4 for a, b in edges)
    want = []
    for i in range(len(points)):
        want += [(i, i + 1 + int(j)) for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= 4)] if n < 1000 else []
    if n >= 1000:
        a, b = simhash._forest(points, 4, None)
        want = [(place[x], place[y]) for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True)]
    assert classes(len(points), edges) == classes(len(points), want)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    root = classes(31, edges)
    assert got == {i: root[i] for a, b in edges if a != b for i in (a, b)}


def test_a_long_chain(spark):
    got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a BIGINT, b BIGINT")).collect()
    assert {r.root for r in got} == {0} and len(got) == 201


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "a b"), (10_004, "a b"), (None, "a b"), (None, "c")], "doc_id BIGINT, text STRING")
    rows = docs.unionByName(odd)
    got = simhash.near_duplicates(rows).collect()
    assert len(got) == rows.count()
    assert {r.component_id for r in got if r.doc_id in (10_001, 10_002, 10_003)} == {10_001}
    assert {r.component_id for r in got if r.doc_id == 10_004} == {10_004}
    text = {r.doc_id: r.text for r in docs.collect()}
    own = sorted(text)
    fps = np.array([slow(text[i]) for i in own], np.uint64)
    edges = [(i, j) for i in range(len(own)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    root = classes(len(own), edges)
    by = {r.doc_id: r for r in got}
    for i, doc in enumerate(own):
        assert by[doc].fingerprint == f"{int(fps[i]):016x}"
        assert by[doc].component_id == own[root[i]]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0

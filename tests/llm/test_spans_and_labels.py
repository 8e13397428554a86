"""Decontamination, license scan and language identification."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter
from re import _parser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagmill.llm import langid, licenses, winnow
from tagmill.llm.license_rules import RULES, STEMS, Rule

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, span):
    w = words(text)
    hit, found = set(), set()
    for name, other in items:
        o = words(other)
        n = min(span, len(o))
        windows = {tuple(o[i : i + n]) for i in range(len(o) - n + 1)} if o else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(name)
    return len(w), sorted(hit), found


text = st.lists(st.sampled_from(["a", "B", "c,", "é", "longerthantwelveletters1", "longerthantwelveletters2", "-"]), max_size=30).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(text, min_size=1, max_size=4), st.lists(text, min_size=1, max_size=4), st.integers(1, 6), st.integers(1, 3))
def test_windows(docs, items, span, k):
    k = min(k, span)
    index = winnow.Items([str(i) for i in range(len(items))], [t.encode() for t in items], span, k)
    w, hit, found = winnow.matches([t.encode() for t in docs], index)
    for i, doc in enumerate(docs):
        n, at, names = brute(doc, list(enumerate(items)), span)
        a, b = w.bounds[i], w.bounds[i + 1]
        assert b - a == n
        assert np.flatnonzero(hit[a:b]).tolist() == at
        assert found[i] == names


def test_documents(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 40)))) for i in range(30)] + [(30, None), (31, "..."), (32, "only three words"), (32, "only three words"), (100, " ".join(vocabulary[:12]))]
    docs = [(i, " ".join(rng.choices(vocabulary, k=50)) + " " + (items[i % 30][1] or "") + " ONLY three, words") for i in range(40)] + [(50, None), (51, ""), (52, "w1"), (52, "w1"), (None, items[0][1])]
    a = spark.createDataFrame([(*d, 1) for d in docs], "doc_id BIGINT, text STRING, spans INT")
    b = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    want = []
    for doc, body in docs:
        n, at, names = brute(body, items, 10)
        want.append((doc is None, doc or 0, n, len(at), len(names), hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest(), bool(at)))
    for block in (winnow.BLOCK_BYTES, 300):  # the second way goes through many blocks
        got = winnow.decontaminate(a, b, block_bytes=block).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    assert winnow.decontaminate(a.limit(0), b).count() == 0
    assert not any(r.contaminated for r in winnow.decontaminate(a, b.limit(0)).collect())


def test_rules_hold_together():
    assert len(RULES) > 200 and len({(r.label, r.pattern) for r in RULES}) == len(RULES)
    for r in RULES:
        assert _parser.parse(r.pattern).getwidth()[1] < licenses.REACH, r


def scan_one(text, rules=RULES):
    """The scan in plain Python."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    labels, best = [], 0
    if any(s in text.lower() for s in STEMS):
        plain = re.sub(r"[ \t\n\x0b\f\r]+", " ", low).replace("licence", "license")
        found = sorted((m.start(), -m.end(), -r.priority, i, r.label) for i, r in enumerate(rules) if r.keyword in plain for m in re.finditer(r.pattern, plain, re.ASCII))
        for i, d in enumerate(found):
            if not any(-e[1] >= -d[1] and -e[2] >= -d[2] for e in found[:i]):
                labels.append(d[4])
                best = max(best, -d[2])
    w, base, places = words(text), [], []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        base += [label] if at else []
    score = max({3: 1.0, 2: 0.8, 1: 0.5, 0: 0.0}[best], 0.8 if places else 0.0)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted({*base, *labels})), score


LICENSES = [
    "Released under the MIT License.", "the mit-license MIT, license mit license", "SPDX-License-Identifier: Apache-2.0", "Apache\nLicence, Version 2.0", "GNU General Public License version 3 or later; GNU  General Public License",
    "licensed under the GNU Lesser General Public License, version 2.1", "Copyright (c) 2019 Someone. All rights reserved.", "see https://opensource.org/licenses/MIT and http://creativecommons.org/licenses/by-sa/4.0/",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this", "general public license general public license", "apache license " * 300, "no such thing", "", "mİt license K",
]


def test_scan(spark, data):
    texts = [*LICENSES, *(r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect())]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(10_000, None, 1), (0, texts[0], 1), (None, texts[0], 1)], "doc_id BIGINT, text STRING, labels INT")
    got = licenses.scan(docs).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        want = scan_one("" if r.doc_id == 10_000 else texts[r.doc_id or 0])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want
    assert licenses.scan(docs.limit(0)).count() == 0


def alternatives(parsed):
    """Strings that a parsed expression matches: each branch, and each repeat as seldom as it may and once."""
    out = [""]
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                part = [chr(arg)]
            case "BRANCH":
                part = [x for branch in arg[1] for x in alternatives(branch)]
            case "SUBPATTERN":
                part = alternatives(arg[3])
            case "MAX_REPEAT" | "MIN_REPEAT":
                part = [x * n for n in {arg[0], max(arg[0], 1)} for x in alternatives(arg[2])]
            case "IN":
                one = arg[0] if str(arg[0][0]) != "NEGATE" else arg[1]
                part = {"LITERAL": lambda v: [chr(v)], "RANGE": lambda v: [chr(v[0])], "CATEGORY": lambda v: {"CATEGORY_DIGIT": ["1"], "CATEGORY_SPACE": [" "], "CATEGORY_WORD": ["t"], "CATEGORY_NOT_WORD": ['"']}[str(v)]}[str(one[0])](one[1])
            case "ANY":
                part = ["~"]
            case "AT" | "ASSERT_NOT":
                part = [""]
            case _:
                raise ValueError(op)
        out = [a + b for a in out for b in part]
    return out


def test_prefilters_hold_for_every_alternative():
    assert not [s for s in STEMS if re.search(r"\s", s)]
    lost = []
    for r in RULES:
        strings = alternatives(_parser.parse(r.pattern))
        assert any(re.search(r.pattern, x, re.ASCII) for x in strings)
        lost += [(r.label, r.keyword, x) for x in strings if r.keyword not in x or not any(s in x for s in STEMS)]
    assert lost == []


def test_prefilters_drop_no_match(spark):
    texts = {"the Modified BSD License": "bsd-3-clause", "revised BSD licence": "bsd-3-clause", "Beerware License": "beerware", "the zlib/libpng License": "zlib", "All rights\nreserved": "all-rights-reserved", "shall be used for Good,\tnot  Evil; the software shall be used for good, not\nevil": "json", "Altered source\nversions must be plainly marked as such": "zlib", "as long as you retain\nthis notice you can do whatever you want": "beerware", "neither the\nname of X nor the names of its contributors": "bsd-3-clause"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(docs).collect()}
    assert [t for i, (t, label) in enumerate(texts.items()) if label not in got[i]] == []


def test_long_texts_take_time_in_proportion(spark):
    """Two megabytes of notices; a fold over all matches would take hours."""
    line = "copyright 2019 a\n"
    n = 2_000_000 // len(line)
    docs = spark.createDataFrame([(1, line * n), (2, "x" * 5000 + " MIT License " + "y " * 4000 + "apache-2.0")], "doc_id BIGINT, text STRING")
    begun = time.perf_counter()
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert time.perf_counter() - begun < 120
    assert (got[1].labels, got[1].score, got[1].n_words) == ("copyright", 0.5, 3 * n)
    assert got[2].labels == "apache-2.0,mit" and got[2].n_base == 1


def test_notices_at_the_borders_of_segments(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choices([*LICENSES[:10], "word", "license", "the"], k=60)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    for size in (64, 300):
        monkeypatch.setattr(licenses, "SEGMENT", size)
        monkeypatch.setattr(licenses, "CHUNK", 2 * size)
        for r in licenses.scan(docs).collect():
            assert r.labels == scan_one(texts[r.doc_id])[5]


def test_containment(spark):
    rules = [Rule("whole", 2, "big license", "big license text"), Rule("part", 1, "license", "license"), Rule("strong", 3, "license", "license text")]
    docs = spark.createDataFrame([(1, "big license text"), (2, "a license")], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.labels for r in licenses.scan(docs, rules=rules, stems=["license"]).collect()}
    assert got == {1: "strong,whole", 2: "part"}


@pytest.fixture(scope="module")
def model(spark, data):
    return langid.train(langid.sample(spark.read.parquet(f"{data}/documents.parquet")))


def test_probabilities_add_up(model):
    """After any context the probabilities of all symbols and of one unknown symbol per leftover share come to one."""
    letters = [chr(c) for c in range(97, 123)]
    keys, values = model.grams[0]
    total = np.exp(values.astype(float)).sum(0)
    assert (total < 1.0).all() and (total > 0.9).all()
    p, q = (np.exp(model.log_probabilities(langid.encode([t])[0])[-1]) for t in ("the", "thq"))
    assert p[model.languages.index("en")] > q[model.languages.index("en")]
    assert letters


def brute_kneser_ney(samples):
    """Interpolated Kneser-Ney by dictionaries: language -> function of (context, symbol) tuples."""
    order = langid.ORDER
    symbols = {k: [[1] * (order - 1) + [int(c) for c in langid.encode([t])[0][order:]] for t in texts] for k, texts in samples.items()}
    counts = {k: [Counter(tuple(x[i - n + 1 : i + 1]) for x in xs for i in range(order - 1, len(x))) for n in range(1, order + 1)] for k, xs in symbols.items()}
    kinds = len({g for c in counts.values() for g in c[0]})

    def model(own):
        levels = []
        for n in range(1, order + 1):
            if n < order:  # in how many ways a run goes on to the left
                count = Counter(g[1:] for g in own[n])
            else:
                count = own[n - 1]
            ones, twos = sum(v == 1 for v in count.values()), sum(v == 2 for v in count.values())
            total, after = Counter(), Counter()
            for g, v in count.items():
                total[g[:-1]] += v
                after[g[:-1]] += 1
            levels.append((count, ones / (ones + 2 * twos) if ones and twos else 0.5, total, after))

        def p(gram):
            if not gram:
                return 1 / (kinds + 1)
            count, d, total, after = levels[len(gram) - 1]
            lower = p(gram[1:])
            context = gram[:-1]
            if not total[context]:
                return lower
            return max(count[gram] - d, 0) / total[context] + d * after[context] / total[context] * lower

        return p

    return {k: model(own) for k, own in counts.items()}


def test_probabilities_against_brute_force():
    rng = random.Random(3)
    words_of = {"a": ["lorem", "ipsum", "dolor", "sit"], "b": ["foo", "bar", "baz", "ipsum"], "c": ["zzz", "éa"]}
    samples = {k: [" ".join(rng.choices(v, k=rng.randint(1, 12))) for _ in range(15)] for k, v in words_of.items()}
    model = langid.train(samples)
    brute = brute_kneser_ney({k: [t for i, t in enumerate(v) if i % 5] for k, v in samples.items()})
    order = langid.ORDER
    for text in ["lorem ipsum", "foo bar zzz", "é", "q", "x lorem-q!", "ipsum " * 5]:
        codes = langid.encode([text])[0]
        got = model.log_probabilities(codes)
        for i in range(1, len(got)):
            gram = tuple(int(c) for c in codes[i : i + order])
            for j, name in enumerate(model.languages):
                assert got[i, j] == pytest.approx(np.log(brute[name](gram)), abs=2e-5), (text, i, name)
        total, n, _ = model.score([text])
        best = model.languages[int((total[0] / n[0]).argmin())]
        plain = {k: -sum(np.log(p(tuple(int(c) for c in codes[i : i + order]))) for i in range(1, len(got))) / (len(got) - 1) for k, p in brute.items()}
        assert plain[best] <= min(plain.values()) + 1e-4
    together, alone = model.score(["q", "q", "é x"])[0], [model.score([t])[0][0] for t in ("q", "q", "é x")]
    assert np.allclose(together, alone, atol=1e-4)  # a text's place in a batch plays no part


def test_garbage_among_the_labelled_rows_does_not_end_rejection():
    rng = random.Random(8)
    noise = lambda: " ".join("".join(rng.choices("qxzjkvwyß", k=7)) for _ in range(60))
    samples = {"a": [" ".join(rng.choices(["lorem", "ipsum", "dolor", "sit", "amet"], k=80)) for _ in range(100)] + [noise() for _ in range(6)]}
    rng.shuffle(samples["a"])
    model = langid.train(samples)
    assert model.judge([noise()])[0][3] and not model.judge(["lorem ipsum dolor"])[0][3]


def test_every_language_is_learned(spark):
    rows = [(i, "alpha beta " * 3000, "long") for i in range(30)] + [(100 + i, f"word{chr(97 + i % 26)} " * 9, f"l{i % 120:03}") for i in range(2400)] + [(None, "x", "long"), (5000, None, "none")]
    got = langid.sample(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"))
    assert len(got) == 121 and all(len(t) <= langid.SAMPLE_CHARS for t in got["long"]) and all(len(v) >= 5 for v in got.values())


def test_held_out_accuracy(spark, data, model):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 < r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) / len(got) < 0.02


def test_odd_texts(spark, model):
    rng = random.Random(1)
    noise = " ".join("".join(rng.choices("qxzjkvwyß", k=7)) for _ in range(300))
    rows = [(1, None), (2, ""), (3, "123 -- !"), (4, "the"), (4, "the"), (5, noise), (6, "the and with " * 30_000), (None, "the")]
    got = langid.predict(spark.createDataFrame([(*r, "x") for r in rows], "doc_id BIGINT, text STRING, score STRING"), model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1, 2, 3))
    assert by[5].rejected and by[5].lang_pred in model.languages
    assert by[6].lang_pred == "en" and not by[None].held_out
    assert langid.predict(spark.createDataFrame([], "doc_id BIGINT, text STRING"), model).count() == 0


def test_scores_do_not_depend_on_neighbours(model):
    texts = ["the one", "le deux et la", "x", "der die das"]
    together = model.judge(texts)
    assert together == [model.judge([t])[0] for t in texts]


def test_blocks_add_up(model, monkeypatch):
    text = "the quick brown fox and the lazy dog " * 50
    whole = model.score([text, "le"])[0]
    monkeypatch.setattr(langid, "BLOCK", 97)
    assert np.allclose(model.score([text, "le"])[0], whole)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None), (4, None, "en")], "doc_id BIGINT, text STRING, lang STRING")
    got = langid.identify(docs).collect()
    assert [r.lang_pred for r in got] == ["und", "und"]


def test_only_training_rows_are_learned(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    import zlib

    texts = {t for x in langid.sample(docs).values() for t in x}
    held = {r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    free = {r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert texts <= free and not texts & (held - free)

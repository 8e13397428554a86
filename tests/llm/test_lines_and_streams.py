"""Line deduplication, stateful exact deduplication and the cuckoo filter against brute force."""

from __future__ import annotations

import random
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.llm import linededup, streamdedup
from tagmill.llm.cuckoo import CuckooFilter

SPACE = " \t\n\x0b\x0c\r"


def test_filter_never_misses():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    f = CuckooFilter.of(keys)
    assert f.contains(keys).all()
    others = np.setdiff1d(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64), keys)
    assert f.contains(others).mean() < 0.01
    for k in keys[:2500].tolist():
        assert f.delete(k)
    again = CuckooFilter.from_bytes(f.to_bytes())
    assert again.contains(keys[2500:]).all() and again.contains(keys[:2500]).mean() < 0.01


def test_a_full_filter_stays_as_it_was():
    f = CuckooFilter(1)
    kept = [h for h in range(1 << 40, (1 << 40) + 40) if f.insert(h << 20)]
    assert f.contains(np.array([h << 20 for h in kept], np.uint64)).all()
    assert not f.insert(12345 << 50) or len(kept) < 16


def brute(docs, least=5, chars=40):
    import re

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))

    held = {}
    for i, (_, text) in enumerate(docs):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= chars:
                held.setdefault(k, set()).add(i)
    last = {k: max((docs[i][0] for i in v if docs[i][0] is not None), default=None) for k, v in held.items() if len(v) >= least}
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        gone = [key(x) in last and last[key(x)] is not None and (doc is None or doc < last[key(x)]) for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    pool = [f"line number {i} is quite a bit longer than forty code points é" for i in range(8)]
    make = lambda x: rng.choice([x, "  " + x.upper().replace("É", "é") + "\t", x + "\r", "short"])
    docs = [(i, "\n".join(make(rng.choice(pool)) for _ in range(rng.randint(1, 6)))) for i in range(n)]
    return [*docs, (1000, None), (1001, ""), (1002, "\n\n"), (None, pool[0]), (3, pool[1]), (999, pool[0] + "\n" + pool[0])]


def result(frame):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.kept) for r in frame.collect()))


def expected(docs):
    return sorted((d is None, d or 0, n, g, k) for d, n, g, k in brute(docs))


@pytest.mark.parametrize("limit", [linededup.BROADCAST_KEYS, 0])
def test_lines(spark, limit, monkeypatch):
    """Both ways: exact counts broadcast, and joined with what the filters let through; there filter by filter."""
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", limit)
    monkeypatch.setattr(linededup, "FILTER_BYTES", limit)
    docs = [*corpus(1), (1, None), (1, corpus(1)[1][1])]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id BIGINT, text STRING, kept STRING")
    index = linededup.LineIndex.build(frame)
    assert result(index.apply(frame)) == expected(docs)
    again = index.rewrite(frame)
    assert again.columns == frame.columns and sorted(r.text for r in again.collect()) == sorted(k for *_, k in brute(docs))


def tables(index):
    f = index.table("filters").collect()
    spent = {bytes(r.digest) for r in index.spent().collect()}
    digests = np.array([int.from_bytes(d[:8], "little") for d in spent], np.uint64)
    for r in f:
        assert r.n_shards == linededup.shards_for(len(digests))
        own = digests[digests % np.uint64(r.n_shards) == r.shard]
        assert r.n_keys == len(np.unique(own)) and CuckooFilter.from_bytes(r["filter"]).contains(own).all()
    assert sum(r.n_keys for r in f) == len(digests)
    return sorted((bytes(r.digest), r.n_docs, r.max_doc) for r in index.table("counts").collect())


def test_shards_follow_the_keys():
    assert [linededup.shards_for(n) for n in (0, 400_000, 400_001, 10**7, 10**12)] == [8, 8, 16, 256, linededup.SLOTS]


def test_columns_used_inside(spark):
    docs = spark.createDataFrame([(1, "x", "y")], "doc_id BIGINT, text STRING, __drops STRING")
    with pytest.raises(ValueError):
        linededup.LineIndex.build(docs).rewrite(docs)


@pytest.mark.parametrize("keys", [linededup.SHARD_KEYS, 1])
def test_inserting_and_deleting_is_reversible(spark, keys, monkeypatch):
    """With filters that change key by key, and with numbers of shards that change, too."""
    monkeypatch.setattr(linededup, "SHARD_KEYS", keys)
    monkeypatch.setattr(linededup, "LEAST_SHARDS", min(keys, 8))
    docs = [d for d in corpus(2, 40) if d[0] is not None and d[0] != 3]
    first, more = docs[:25], docs[25:]
    frame = lambda x: spark.createDataFrame(x, "doc_id BIGINT, text STRING")
    one = linededup.LineIndex.build(frame(first))
    two = one.insert(frame(more))
    assert tables(two) == tables(linededup.LineIndex.build(frame(docs)))
    assert result(two.apply(frame(docs))) == expected(docs)
    back = two.delete(frame(more).select("doc_id"))
    assert tables(back) == tables(one)
    none = back.delete(frame(first).select("doc_id"))
    assert tables(none) == []


def test_no_lines(spark):
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert linededup.LineIndex.build(empty).apply(empty).count() == 0


def _texts():
    return [(5, "a b"), (3, "a  b"), (3, "a\t\nb"), (9, "x"), (7, None), (8, ""), (4, " "), (None, "x"), (None, "only"), (11, "z" * 100_000)]


def groups(rows):
    import re

    by = {}
    for i, t in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return sorted((t[:20], min((i for i in ids if i is not None), default=None) or -1, len(ids)) for t, ids in by.items())


@pytest.mark.parametrize("weak", [False, True])
def test_stream(spark, tmp_path, weak):
    """With a digest of one byte's half different texts meet and must be told apart by their bytes."""
    path = f"{tmp_path}/t.parquet"
    rows = [*_texts(), *((100 + i, f"text {i % 30}") for i in range(60))]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id BIGINT, text STRING, digest INT").write.parquet(path)
    digest = (lambda sha: F.substring(F.hex(sha), 1, 1)) if weak else (lambda sha: sha)
    got = streamdedup.deduplicate(spark, path, digest).collect()
    assert len(got) == len(rows)
    kept = [r for r in got if r.kept]
    assert sorted((r.keep_id if r.keep_id is not None else -1, r.group_size) for r in kept) == sorted((k, n) for _, k, n in groups(rows))
    for r in got:
        assert r.kept <= (r.keep_id == r.doc_id)
    assert {(r.doc_id, r.keep_id) for r in got if r.doc_id in (5, 3)} == {(5, 3), (3, 3)}


def test_stream_goes_on(spark, tmp_path):
    path, work = f"{tmp_path}/t.parquet", f"file://{tmp_path}/work"
    frame = lambda x: spark.createDataFrame(x, "doc_id BIGINT, text STRING")
    frame([(5, "a"), (6, "b")]).write.parquet(path)
    assert {r.doc_id: r.keep_id for r in streamdedup.deduplicate(spark, path, work=work).collect()} == {5: 5, 6: 6}
    frame([(2, "a"), (9, "b")]).write.mode("append").parquet(path)
    assert {r.doc_id: r.keep_id for r in streamdedup.deduplicate(spark, path, work=work).collect()} == {5: 2, 2: 2, 6: 6, 9: 6}


def test_empty_stream(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.createDataFrame([], "doc_id BIGINT, text STRING").write.parquet(path)
    assert streamdedup.deduplicate(spark, path).count() == 0


def test_local_disk_of_many_state_stores(data, tmp_path):
    """211 shuffle partitions: what executors keep in their own folder stays small, as stores reserve nothing."""
    code = f"""
        import os, threading, time
        from pyspark.sql import SparkSession
        from tagmill.llm import streamdedup
        local = "{tmp_path}/local"
        spark = SparkSession.builder.master("local[4]").config("spark.local.dir", local).config("spark.sql.shuffle.partitions", "211").config("spark.sql.adaptive.enabled", "false").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
        most, done = [0], []
        def watch():
            while not done:
                size = 0
                for d, _, names in os.walk(local):
                    for n in names:
                        try:
                            size += os.stat(os.path.join(d, n)).st_blocks * 512
                        except OSError:
                            pass
                most[0] = max(most[0], size)
                time.sleep(0.2)
        t = threading.Thread(target=watch)
        t.start()
        rows = streamdedup.deduplicate(spark, "{data}/documents.parquet").count()
        done.append(1)
        t.join()
        print("result", rows, most[0])
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=600)
    rows, most = next(map(int, x.split()[1:]) for x in out.stdout.splitlines() if x.startswith("result"))
    assert rows > 0 and most < 100 << 20

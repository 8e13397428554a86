"""Compaction and the Merkle audit."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tagmill.llm import merkle
from tagmill.llm.compaction import CommitConflict, ShardTable

ROWS = "doc_id BIGINT, text STRING, __x INT"


def _frame(spark, a, b):
    return spark.createDataFrame([(i, None if i % 11 == 0 else f"text {i} " * 50, i % 3) for i in range(a, b)] + [(a, "twin", 0)] * 2, ROWS)


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_compaction_keeps_every_row(spark, tmp_path):
    t = ShardTable(spark, f"file://{tmp_path}/t", _frame(spark, 0, 1).schema)
    assert t.read().count() == 0 and t.versions() == []
    all_rows = []
    for i in range(5):
        part = _frame(spark, 100 * i, 100 * i + 100)
        all_rows += rows(part)
        t.append(part)
    before = t.manifest().collect()
    assert t.versions() == [1, 2, 3, 4, 5] and rows(t.read()) == sorted(all_rows)
    assert rows(t.read(2)) == sorted(all_rows[:204])
    assert t.compact(target=1 << 20, fanout=4) == 6
    after = t.manifest().collect()
    assert len(after) < len(before) and sum(r.rows for r in after) == len(all_rows)
    assert rows(t.read()) == sorted(all_rows) and rows(t.read(5)) == sorted(all_rows)
    assert t.vacuum() == 0
    assert t.vacuum(1, 0) == len({r.path for r in before} - {r.path for r in after})
    assert rows(t.read()) == sorted(all_rows)
    assert t.compact(target=1 << 20, fanout=4) is None


def test_plan_by_size(spark, tmp_path):
    """Only tiers with enough shards are merged, in files of about the target size; large shards stay."""
    t = ShardTable(spark, f"file://{tmp_path}/t", _frame(spark, 0, 1).schema)
    sizes = [70_000] * 9 + [1 << 20] * 3 + [9 << 20]
    listed = spark.createDataFrame([(f"file:///data/x{i:02}", 1, s, i + 1) for i, s in enumerate(sizes)], "path STRING, rows BIGINT, bytes BIGINT, added INT")
    t._commit(1, listed)
    plan = {r.path[-2:]: r.into for r in t.plan(target=300_000, fanout=4).collect()}
    assert sorted(plan) == [f"{i:02}" for i in range(9)]
    assert [plan[f"{i:02}"] for i in range(9)] == [0, 0, 0, 0, 0, 1, 1, 1, 1]


def test_one_writer_wins(spark, tmp_path):
    t = ShardTable(spark, f"file://{tmp_path}/t", _frame(spark, 0, 1).schema)
    t.append(_frame(spark, 0, 10))
    with pytest.raises(CommitConflict):
        t._commit(1, t.manifest())
    assert t.versions() == [1] and t.read().count() == 12


def test_a_slower_writer_goes_on_top(spark, tmp_path, monkeypatch):
    """Between the write and the commit of an arrival another one is committed, and unlisted files are vacuumed."""
    t = ShardTable(spark, f"file://{tmp_path}/t", _frame(spark, 0, 1).schema)
    other = ShardTable(spark, t.root, t.schema)
    plain = t._write

    def slow(*args):
        made = plain(*args)
        other.append(_frame(spark, 500, 510))
        assert other.vacuum() == 0
        return made

    monkeypatch.setattr(t, "_write", slow)
    assert t.append(_frame(spark, 0, 10), arrivals=2, by=F.col("doc_id")) == [2, 3]
    assert rows(t.read()) == sorted(rows(_frame(spark, 0, 10)) + rows(_frame(spark, 500, 510)))


def test_compactions_that_meet(spark, tmp_path, monkeypatch):
    """One merges what the other has merged meanwhile: it starts over and leaves no file behind; arrivals in between stay."""
    t = ShardTable(spark, f"file://{tmp_path}/t", _frame(spark, 0, 1).schema)
    for i in range(4):
        t.append(_frame(spark, 100 * i, 100 * i + 50).coalesce(1))
    other = ShardTable(spark, t.root, t.schema)
    plain, calls = t._write, []

    def slow(*args):
        made = plain(*args)
        calls.append(1)
        if len(calls) == 1:
            other.append(_frame(spark, 900, 910).coalesce(1))
            assert other.compact(1 << 20, 4) == 6
        return made

    before = rows(t.read())
    monkeypatch.setattr(t, "_write", slow)
    assert t.compact(1 << 20, 4) is None and len(calls) == 1
    assert rows(t.read()) == sorted(before + rows(_frame(spark, 900, 910)))
    t.vacuum(1, 0)
    assert rows(t.read()) == sorted(before + rows(_frame(spark, 900, 910)))


def test_merging_tasks_stay_below_twice_the_target(spark, tmp_path):
    t = ShardTable(spark, f"file://{tmp_path}/t", spark.range(1).withColumn("text", F.lit("")).schema)
    data = spark.range(24_000).withColumn("text", F.sha2(F.col("id").cast("string"), 512))
    for i in range(4):
        t.append(data.filter(F.col("id") % 4 == i).repartition(20))
    target = 60_000
    t.compact(target, 4)
    sizes = sorted(r.bytes for r in t.manifest().collect())
    assert len(sizes) >= 10 and sizes[-1] < 2 * target and sum(sizes) > 10 * target
    assert t.read().distinct().count() == 24_000


def test_columns_used_inside(spark, tmp_path):
    with pytest.raises(ValueError):
        ShardTable(spark, f"file://{tmp_path}/t", spark.range(1).withColumn("__into", F.lit(1)).schema)


def test_many_arrivals_at_once(spark, tmp_path):
    t = ShardTable(spark, f"file://{tmp_path}/t", _frame(spark, 0, 1).schema)
    data = _frame(spark, 0, 200)
    assert t.append(data, arrivals=3, by=F.col("doc_id")) == [1, 2, 3]
    assert t.read(1).filter("doc_id % 3 <> 0").count() == 0
    assert rows(t.read()) == rows(data)


def test_empty_arrival(spark, tmp_path):
    t = ShardTable(spark, f"file://{tmp_path}/t", _frame(spark, 0, 1).schema)
    t.append(_frame(spark, 0, 5).limit(0))
    assert t.read().count() == 0 and t.versions() == [1]


def _records(spark, n, change=(), drop=(), add=()):
    out = [(i, f"record {i} " + ("!" if i in change else ".") + "x" * (i % 50)) for i in range(n) if i not in drop]
    return spark.createDataFrame([*out, *((i, f"new {i}") for i in add), (None, "no id"), (7, "again"), (7, "again")], "rec_id BIGINT, record STRING")


def test_audit_names_damaged_records(spark):
    a = _records(spark, 300)
    one, two, found = merkle.fixity(a, _records(spark, 300, change={5, 123}, drop={200}, add={1000}), range_bytes=256, fanout=4)
    assert one.root() != two.root()
    assert {(r.rec_id, r.status) for r in found.collect()} == {(5, "changed"), (123, "changed"), (200, "missing"), (1000, "extra")}
    assert len(one.levels) > 3


def test_offsets_are_those_of_the_archive(spark):
    a = _records(spark, 100)
    got = sorted(((r.rec_id is not None, r.rec_id or 0, r.digest, r.offset, r.n_bytes) for r in merkle.copies(merkle.index(a, 256)).collect()))
    assert len(got) == 103
    at = 0
    for _, _, _, offset, n in sorted(got, key=lambda r: r[3]):
        assert offset == at
        at += n
    assert [g[:3] for g in sorted(got, key=lambda r: r[3])] == [g[:3] for g in got]


def test_equal_and_empty_replicas(spark):
    a = _records(spark, 40)
    one, two, found = merkle.fixity(a, a.repartition(3), range_bytes=256)
    assert one.root() == two.root() and found.count() == 0
    none = a.limit(0)
    assert merkle.fixity(none, none)[2].count() == 0
    assert {r.status for r in merkle.fixity(a, none, range_bytes=256)[2].collect()} == {"missing"}


def test_only_mismatching_branches_are_read(spark):
    """Trees that differ in one range agree in every node that isn't above it."""
    one, two, _ = merkle.fixity(_records(spark, 300), _records(spark, 300, change={150}), range_bytes=256, fanout=4)
    for x, y in zip(one.levels, two.levels, strict=True):
        assert x.join(y, ["node", "hash"], "left_anti").count() == 1


def test_a_shift_changes_its_own_range_only(spark):
    """A longer record, a missing one and extra ones at both ends: all other ranges have equal hashes."""
    a = _records(spark, 300)
    rows = [(r.rec_id, r.record + "longer" * 9 if r.rec_id == 40 else r.record) for r in a.collect() if r.rec_id != 150]
    rows += [(-5, "before all"), (10**6, "after all")] + [(220, "much more " + str(i)) for i in range(60)] + [(None, None)]
    one, two, found = merkle.fixity(a, spark.createDataFrame(rows, "rec_id BIGINT, record STRING"), range_bytes=256, fanout=4)
    got = sorted((r.rec_id is not None, r.rec_id or 0, r.status) for r in found.collect())
    assert got == sorted([(True, 40, "changed"), (True, 150, "missing"), (True, -5, "extra"), (True, 10**6, "extra"), (False, 0, "extra"), *[(True, 220, "extra")] * 60])
    leaves = one.levels[0].count()
    assert one.levels[0].join(two.levels[0], ["node", "hash"], "left_anti").count() <= 5 < leaves


def test_many_equal_records_are_one_row(spark):
    a = spark.createDataFrame([(1, "same")] * 500 + [(2, "x")], "rec_id BIGINT, record STRING")
    b = spark.createDataFrame([(1, "same")] * 497 + [(2, "y")], "rec_id BIGINT, record STRING")
    one, _, found = merkle.fixity(a, b, range_bytes=64)
    assert one.records.count() == 2
    assert sorted((r.rec_id, r.status, r.offset_a) for r in found.collect()) == [(1, "missing", 4 * i) for i in (497, 498, 499)] + [(2, "changed", 2000)]


def test_warc_files(spark, tmp_path):
    """Records of files on disk, plain and gzipped record by record; two copies are audited."""
    import gzip

    pages = [(i, f"http://x/{i}", "WARC/1.1 in a body\r\n\r\n" * (i % 3) + "é") for i in range(20)]
    made = [r.r for r in spark.createDataFrame(pages, "id BIGINT, url STRING, html STRING").select(merkle.warc_record(F.col("id"), F.col("url"), F.col("html")).alias("r")).collect()]
    raw = [m.encode() for m in made]
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
    (tmp_path / "one" / "a.warc").write_bytes(b"".join(raw[:12]))
    (tmp_path / "one" / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, raw[12:])))
    bad = bytearray(b"".join(raw))
    bad[len(b"".join(raw[:5])) - 6] ^= 1
    (tmp_path / "two" / "a.warc").write_bytes(bad)
    (tmp_path / "two" / "empty.warc").write_bytes(b"")
    one, two = (merkle.read_warc(spark, f"file://{tmp_path}/{x}") for x in ("one", "two"))
    places = sorted((r.file[-1], r.offset, bytes(r.record)) for r in one.collect())
    assert [r for _, _, r in places] == raw and [p[1] for p in places[:12]] == [sum(map(len, raw[:i])) for i in range(12)]
    assert [(r.rec_id, r.status) for r in merkle.fixity(one, two, range_bytes=500)[2].collect()] == [("urn:page:4", "changed")]


def test_record_form(spark):
    row = spark.createDataFrame([(1, None, "é"), (None, "u", None)], "id BIGINT, url STRING, html STRING").select(merkle.warc_record(F.col("id"), F.col("url"), F.col("html")).alias("r")).collect()
    assert row[0].r.endswith("Content-Length: 2\r\n\r\né\r\n\r\n") and "Content-Length: 0\r\n\r\n\r\n\r\n" in row[1].r

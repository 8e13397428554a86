"""Token-id files under Re-Pair grammar compression (operator 2).

Documents are encoded in ascending document order and laid end to end. A *shard* is a run of whole documents of about
``SHARD_TOKENS`` ids. In each shard frequent pairs of neighbouring symbols are replaced by nonterminals, round after
round, until no pair is frequent or the rules are used up. The file keeps, per shard, the reduced sequence, the rules
(two symbols each) and the expansion length of every rule; from the lengths a reader finds the symbols that cover any
range of ids and expands only those (``decode_range``).

Format: a Parquet folder, one row a shard::

    part, seq        place of the shard: parts, and shards within a part, ascend with doc_id
    part_start       ids of the same part before this shard
    n_ids            ids in the shard
    doc_ids, starts  documents of the shard in order, and where in the shard each one starts
    base             number of the first rule; ids lie below it
    symbols          reduced sequence, little-endian unsigned integers of ``width`` bytes
    rules            two symbols a rule, same width; rule i is symbol ``base + i``
    lengths          expansion length of each rule, little-endian unsigned 32-bit

Null texts count as empty: they have the end id alone. A null doc_id comes first. Rows that repeat a doc_id keep an
entry each, in the order of their texts. An empty table gives no files' rows and an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagmill.llm.common import slices, small_batches, tidy, two_columns
from tagmill.llm.pieces import PieceEncoder

#: Ids after which a shard is closed; a document is never split.
SHARD_TOKENS = 1 << 20
#: A pair is frequent from this many occurrences in a shard.
MIN_COUNT = 16
#: Rounds of counting and replacing at most (a shard ends sooner: when no pair is frequent, the rules are used up, or a round
#: saves less than a hundredth), and new rules of a round at most.
MAX_ROUNDS = 64
RULES_A_ROUND = 4096
#: Share of the sequence that a round must save if another one is to follow.
LEAST_SAVING = 0.01
#: Settings of ``repair`` that leave no pair that occurs twice: slow, as every rule takes a pass.
TO_THE_END = {"min_count": 2, "rounds": 1 << 62, "rules_a_round": 1, "least_saving": 0.0, "wide": True}
#: Documents that one call of ``read_documents`` gives at most.
MAX_WANTED = 100_000
#: Pieces that the library gets as one text.
RUN = 32


def repair(ids: np.ndarray, base: int, min_count: int = MIN_COUNT, rounds: int = MAX_ROUNDS, rules_a_round: int = RULES_A_ROUND, least_saving: float = LEAST_SAVING, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Reduced sequence and rules (n x 2) of ids below ``base``.

    Each round counts all neighbouring pairs exactly, takes the most frequent ones and replaces their occurrences at
    once. Where two occurrences overlap the more frequent pair goes first, and of a run of one pair every second. ``TO_THE_END``
    has the settings with which one pair at a time goes, until none is left that occurs twice.
    """
    small = base < 1 << 16 and not wide
    symbol, key, half = (np.uint16, np.uint32, 16) if small else (np.uint32, np.uint64, 32)
    room = (1 << 16) - base if small else (1 << 32) - base
    seq = ids.astype(symbol)
    rules: list[np.ndarray] = []
    n_rules = 0
    bits, mix = 16, 0x9E3779B1 if small else 0x9E3779B97F4A7C15
    for _ in range(rounds):
        if len(seq) < 2 or n_rules >= room:
            break
        pairs = (seq[:-1].astype(key) << key(half)) | seq[1:]
        ordered = np.sort(pairs)
        last = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True))
        counts = np.diff(last, prepend=-1)
        frequent = np.flatnonzero(counts >= min_count)
        if not len(frequent):
            break
        values, counts = ordered[last[frequent]], counts[frequent]
        best = np.argsort(-counts, kind="stable")[: min(rules_a_round, room - n_rules)]
        chosen = values[best]
        # a hash table of one entry a slot; a pair that loses its slot to a more frequent one waits for the next round
        n = len(chosen)
        hashed = lambda x: (x * key(mix)) >> key(8 * np.dtype(key).itemsize - bits)
        table = np.full(1 << bits, n, np.int32)
        table[hashed(chosen)[::-1]] = np.arange(n, dtype=np.int32)[::-1]
        rank = table[hashed(pairs)]
        known = (np.append(chosen, key(0))[rank] == pairs) & (rank < n)
        rank = np.where(known, rank, n)
        take = known
        alike = np.flatnonzero((rank[1:] == rank[:-1]) & take[1:]) + 1
        take[1:] &= rank[1:] < rank[:-1]
        if len(alike):  # of a run of one pair every second occurrence goes
            run = np.cumsum(np.append(True, np.diff(alike) > 1)) - 1
            inside = alike - alike[np.flatnonzero(np.append(True, np.diff(alike) > 1))][run]
            take[alike[inside % 2 == 1]] = True
        take[:-1] &= rank[:-1] <= rank[1:]
        at = np.flatnonzero(take)
        if not len(at):
            break
        used, number = np.unique(rank[at], return_inverse=True)  # a pair that lost all its occurrences makes no rule
        chosen = chosen[used]
        seq[at] = (number + (base + n_rules)).astype(symbol)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        before, seq = len(seq), seq[keep]
        rules.append(np.stack([(chosen >> key(half)).astype(symbol), (chosen & key((1 << half) - 1)).astype(symbol)], 1))
        n_rules += len(chosen)
        if before - len(seq) < before * least_saving:
            break
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), symbol)


class Grammar:
    """Rules of a shard with every expansion laid flat, and each symbol's place and length in it."""

    def __init__(self, rules: np.ndarray, base: int):
        n = len(rules)
        self.base = base
        self.lengths = np.ones(base + n, np.int64)
        self.places = np.arange(base + n, dtype=np.int64)
        self.flat = np.arange(base, dtype=np.uint32)
        rules = rules.astype(np.int64)
        deepest = rules.max(1) if n else rules[:, 0]
        done = 0
        while done < n:  # rules whose parts are all known, a run at a time
            late = np.flatnonzero(deepest[done:] >= base + done)
            end = done + int(late[0]) if len(late) else n
            run = rules[done:end]
            sizes = self.lengths[run].sum(1)
            self.lengths[base + done : base + end] = sizes
            self.places[base + done : base + end] = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, self.expand(run.ravel())])
            done = end

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.lengths[symbols]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.places[symbols] - (ends - sizes), sizes) + np.arange(total)]


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    return Grammar(rules, base).lengths[base:].astype("<u4")


def decode_range(shard: dict, start: int, stop: int) -> np.ndarray:
    """Ids start .. stop of one row of the files.

    The symbols that cover the range are found by their expansion lengths. Symbols wholly inside are expanded; of the two at
    the ends the rules are descended, passing by each part that lies outside.
    """
    base, kind = shard["base"], f"<u{shard['width']}"
    rules = np.frombuffer(shard["rules"], kind).reshape(-1, 2).tolist()
    lengths = np.frombuffer(shard["lengths"], "<u4")
    symbols = np.frombuffer(shard["symbols"], kind)
    sizes = np.ones(len(symbols), np.int64)
    is_rule = symbols >= base
    sizes[is_rule] = lengths[symbols[is_rule].astype(np.int64) - base]
    ends = np.cumsum(sizes)
    first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
    out: list[int] = []
    at = int(ends[first] - sizes[first]) if first < len(ends) else stop
    stack = symbols[first : last + 1].tolist()[::-1]
    while stack and at < stop:
        s = stack.pop()
        size = 1 if s < base else int(lengths[s - base])
        if at + size <= start:
            at += size
        elif s < base:
            out.append(s)
            at += 1
        else:
            stack += rules[s - base][::-1]
    return np.array(out, np.uint32)


@cache
def _tokenizer(path: str) -> tuple[PieceEncoder, int]:
    """Encoder and size of the vocabulary; one for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    length = np.array([len(t.id_to_token(i) or "") for i in range(t.get_vocab_size())], np.int64)  # a character a byte

    def ids_of(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)]

    def make(parts: list[str], bare: bool) -> list[bytes]:
        if bare:
            return [pack(f"<{len(x)}I", *x) for x in ids_of(parts)]
        # parts that begin with a blank and have others after it: several are encoded as one text, which is cut again
        out: list[bytes] = []
        runs = [parts[a : a + RUN] for a in range(0, len(parts), RUN)]
        for run, ids in zip(runs, ids_of([" " + " ".join(r) for r in runs]), strict=True):
            found = np.array(ids, "<u4")
            stops = np.searchsorted(np.cumsum(length[found]), np.cumsum([len(p.encode()) + 1 for p in run])) + 1
            raw = found.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in pairwise([0, *stops.tolist()])]
        return out

    special = {x.content: pack("<I", i) for i, x in t.get_added_tokens_decoder().items()}
    return PieceEncoder(make, special=special), t.get_vocab_size()


_SHARD = "part int, seq int, part_start bigint, n_ids bigint, doc_ids array<{}>, starts array<bigint>, width int, base bigint, symbols binary, rules binary, lengths binary"


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, key: str = "doc_id", text: str = "text", grammar: dict | None = None) -> None:
    """Encode every whole text and write the files. ``tokenizer_path`` must be readable on the executors; ``grammar`` has
    settings of ``repair``, such as TO_THE_END.

    One shuffle, by ranges of doc_id, sorted within; encoding and compression hold one shard at a time.
    """
    source = two_columns(docs, key, text)
    kind = dict(source.dtypes)["doc_id"]
    key_type = source.schema["doc_id"].dataType
    grammar = dict(grammar or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        encoder, vocabulary = _tokenizer(tokenizer_path)
        base = max(vocabulary, end_id + 1)
        part = TaskContext.get().partitionId()
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(to_arrow_type(key_type)), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = ["part", "seq", "part_start", "n_ids", "doc_ids", "starts", "width", "base", "symbols", "rules", "lengths"]
        seq = before = 0
        held: list[np.ndarray] = []
        sizes: list[int] = []
        keys: list = []

        def shard() -> pa.RecordBatch:
            counts = np.array(sizes, np.int64)
            symbols, rules = repair(np.concatenate(held), base, **grammar)
            row = [part, seq, before, int(counts.sum()), keys, (np.cumsum(counts) - counts).tolist(), symbols.dtype.itemsize, base, symbols.tobytes(), rules.tobytes(), rule_lengths(rules, base).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for whole in batches:
            for batch in slices(whole, "text"):
                docs = batch.column(0).to_pylist()
                ids, counts = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
                ids = np.insert(ids, np.cumsum(counts), end_id)
                stops = np.cumsum(counts + 1)
                at = 0
                while at < len(docs):  # up to the document that fills the shard
                    begun = int(stops[at - 1]) if at else 0
                    to = min(int(np.searchsorted(stops, begun + SHARD_TOKENS - sum(map(len, held)))) + 1, len(docs))
                    held.append(ids[begun : int(stops[to - 1])])
                    sizes += (counts[at:to] + 1).tolist()
                    keys += docs[at:to]
                    at = to
                    if sum(map(len, held)) >= SHARD_TOKENS:
                        yield shard()
                        seq, before = seq + 1, before + sum(sizes)
                        held, sizes, keys = [], [], []
        if held:
            yield shard()

    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    small_batches(docs.sparkSession)
    ordered.mapInArrow(tidy(run), _SHARD.format(kind)).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone: doc_id, start, n_tokens, ids_crc32 of every document."""
    files = spark.read.parquet(path)
    element = files.schema["doc_ids"].dataType.elementType
    kind = element.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for row in batch.to_pylist():
                symbol = f"<u{row['width']}"
                rules = np.frombuffer(row["rules"], symbol).reshape(-1, 2)
                symbols = np.frombuffer(row["symbols"], symbol).astype(np.int64)
                ids = Grammar(rules, row["base"]).expand(symbols).astype("<u4")
                starts = np.array(row["starts"], np.int64)
                ends = np.append(starts[1:], row["n_ids"])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], to_arrow_type(element)), pa.array(np.full(n, row["part"], np.int32)), pa.array(starts + row["part_start"]), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
                )

    decoded = files.mapInArrow(tidy(run), f"doc_id {kind}, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint")
    # one row a part, of which there are as many as shuffle partitions
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base_start"))
    return decoded.join(parts, "part").select("doc_id", (F.col("base_start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """doc_id, ids (an array) of the documents whose doc_id is in the single column of ``ids``, each as often as it was written.

    Only shards that hold one of them are decoded, and of those only the documents' ranges. At most MAX_WANTED ids are sent to
    every task; more are read by ``read_documents`` in several calls, or all by ``read_shards``.
    """
    wanted = [r[0] for r in ids.limit(MAX_WANTED + 1).collect()]
    if len(wanted) > MAX_WANTED:
        raise ValueError(f"more than {MAX_WANTED} documents")
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    asked = set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, docs in enumerate(batch.column(batch.schema.get_field_index("doc_ids")).to_pylist()):
                at = [j for j, doc in enumerate(docs) if doc in asked]
                if at:
                    row = batch.slice(i, 1).to_pylist()[0]
                    ends = [*row["starts"][1:], row["n_ids"]]
                    found = [decode_range(row, row["starts"][j], ends[j]).astype(np.int64) for j in at]
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_ids")).slice(i, 1).flatten().take(pa.array(at)), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return files.mapInArrow(tidy(run), f"doc_id {kind}, ids array<bigint>")

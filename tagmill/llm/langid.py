"""Language identification by Kneser-Ney character models (operator 1).

One interpolated Kneser-Ney model of ``ORDER`` characters per language, over lower-cased letters; everything between
letters is one boundary symbol. All languages share their tables: per order a sorted array of n-gram hashes with a row
of log probabilities (one column a language, already interpolated down to the uniform distribution), and a sorted array
of context hashes with the logarithms of the back-off weights. A whole text is scored in every language; the one of
the lowest cross-entropy per symbol wins, ties go to the first by name.

Rejection is calibrated on documents that the models haven't seen: the cross-entropy of n symbols of a language is taken
to scatter by ``a + b / n`` around its mean. A document is rejected if it is further off than ``z`` such deviations and
also nearer to letters drawn at random than to its language; so documents that mix learned languages stay. A rejected
document still gets its best language; rejecting is a column of its own.

The classifier is fitted on a bounded sample of labelled rows: ``SAMPLE_ROWS`` documents in all (or five a language, if that
is more), shared evenly by all languages that occur, the ones with the smallest hashes of their ids, and of longer texts
``SAMPLE_CHARS`` characters. One in five of them calibrates. Neither lang nor source nor doc_id enters a prediction.

A null text, or one without letters, gets language ``und``, score 0 and is rejected. Without training rows every text
is ``und``. Rows that repeat an id each get a prediction; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import slices, small_batches, tidy, two_columns

ORDER = 4
SAMPLE_ROWS = 2400
SAMPLE_CHARS = 20_000
#: Sharpness of the score: the softmax of -SHARPNESS x cross-entropy.
SHARPNESS = 10.0
#: Rejection needs this many deviations at least.
LEAST_Z = 8.0
#: Symbols that are scored at once.
BLOCK = 1 << 19

_SEPARATOR = 0x10FFFF
_GAP, _EDGE = 0, 1
_P = np.uint64(0x9E3779B97F4A7C15)


@cache
def _symbols() -> np.ndarray:
    """code point -> lower-cased letter, the boundary for all else, and an edge symbol for the separator."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x30000):  # letters lie in the first planes; the others are looked at below
        letter = chr(c)
        if letter.isalpha():
            low = letter.lower()
            table[c] = ord(low) if len(low) == 1 else c
    for c in range(0x30000, 0x323B0):  # rare ideographs
        if chr(c).isalpha():
            table[c] = c
    table[_SEPARATOR] = _EDGE
    return table


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts with ORDER - 1 edges before each, where each text starts and ends among them (edges excluded).

    One more edge stands before them all, so that every symbol of a text has a place before it, at which its context ends.
    """
    edges = chr(_SEPARATOR) * (ORDER - 1)
    joined = chr(_SEPARATOR) + edges + edges.join(texts)
    codes = _symbols()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    gap = codes == _GAP
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # of neighbouring gaps the first stays
    before = np.concatenate([[0], np.cumsum(keep)])
    lengths = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(lengths + ORDER - 1) - lengths + 1
    return codes[keep], before[start], before[start + lengths]


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For k = 1 .. ORDER the hash of the k symbols that end at each place from ORDER - 1 on."""
    n = len(codes) - ORDER + 1
    out: list[np.ndarray] = []
    h, power = np.zeros(max(n, 0), np.uint64), np.uint64(1)
    for k in range(1, ORDER + 1):
        with np.errstate(over="ignore"):
            h = h + (codes[ORDER - k : ORDER - k + n].astype(np.uint64) + np.uint64(7)) * power
            power = power * _P
            mixed = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93 + 2 * k)
        out.append(mixed ^ (mixed >> np.uint64(29)))
    return out


@dataclass
class Model:
    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # of order k: hashes, log probabilities
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # of k - 1 symbols: hashes, log weights
    floor: float = 0.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None  # a and b of each language
    z: float = LEAST_Z

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """A row per place from ORDER - 1 on, a column per language."""
        hashes = _hashes(codes)
        n = len(hashes[0])
        out = np.zeros((n, len(self.languages)), np.float32)
        open_ = np.arange(n)
        for k in range(ORDER, 0, -1):
            keys, values = self.grams[k - 1]
            h = hashes[k - 1][open_]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            out[open_[hit]] += values[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            if k > 1:  # back off: the weight of the k - 1 symbols before
                keys, values = self.contexts[k - 1]
                known = open_[open_ > 0]
                h = hashes[k - 2][known - 1]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                out[known[hit]] += values[at[hit]]
        out[open_] += self.floor + self.contexts[0][1][0]  # a symbol that no language has: the weight of the empty context
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed negative log probability of each text in each language, number of symbols, number of letters."""
        codes, start, stop = encode(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for a in range(0, max(len(codes) - ORDER + 1, 0), BLOCK):
            # the first place of a block looks back at the context that ends before it
            part = self.log_probabilities(codes[max(a - 1, 0) : a + BLOCK + ORDER - 1])[min(a, 1) :]
            # place p of codes is row p - (ORDER - 1) - a of this part
            lo = np.clip(start - (ORDER - 1) - a, 0, len(part))
            hi = np.clip(stop - (ORDER - 1) - a, 0, len(part))
            some = np.flatnonzero(hi > lo)
            if len(some):
                cuts = np.stack([lo[some], hi[some]], 1).ravel()
                sums = np.add.reduceat(np.concatenate([part, np.zeros((1, part.shape[1]), np.float32)]), cuts, axis=0, dtype=np.float64)[::2]
                total[some] -= sums
        letters = np.concatenate([[0], np.cumsum(codes > _EDGE)])
        return total, stop - start, letters[stop] - letters[start]

    def judge(self, texts: list[str]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, cross-entropy, rejected."""
        if not texts:
            return []
        if not self.languages:
            return [("und", 0.0, None, True)] * len(texts)
        total, n, letters = self.score(texts)
        entropy = total / np.maximum(n, 1)[:, None]
        best = entropy.argmin(1)
        low = entropy[np.arange(len(texts)), best]
        score = 1 / np.exp(-SHARPNESS * (entropy - low[:, None])).sum(1)
        off = (low - self.mean[best]) / np.sqrt(self.spread[best, 0] + self.spread[best, 1] / np.maximum(n, 1))
        random = (low - self.mean[best]) > (-self.floor - low)
        return [(self.languages[b], float(s), float(e), bool(o > self.z and r)) if k else ("und", 0.0, None, True) for b, s, e, o, r, k in zip(best.tolist(), score, low, off, random, letters.tolist(), strict=True)]


def _count(values: np.ndarray, universe: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """How often each of the sorted universe occurs among the values."""
    return np.bincount(np.searchsorted(universe, values), times, len(universe)).astype(np.float64)


def _distinct_grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 1 .. ORDER the distinct n-grams of a language with their contexts, suffixes and counts. One text at a time is laid out."""
    parts: list[list[tuple]] = [[] for _ in range(ORDER)]
    for text in texts:
        codes, start, stop = encode([text])
        h = _hashes(codes)
        places = slice(int(start[0]) - ORDER + 1, int(stop[0]) - ORDER + 1)
        none = np.zeros(len(h[0]), np.uint64)
        for k in range(ORDER):
            before = np.concatenate([none[:1], h[k - 1][:-1]]) if k else none
            values, first, counts = np.unique(h[k][places], return_index=True, return_counts=True)
            parts[k].append((values, before[places][first], (h[k - 1] if k else none)[places][first], counts))
    out = []
    for own in parts:
        values, first, inverse = np.unique(np.concatenate([x[0] for x in own]), return_index=True, return_inverse=True)
        out.append((values, np.concatenate([x[1] for x in own])[first], np.concatenate([x[2] for x in own])[first], np.bincount(inverse, np.concatenate([x[3] for x in own]), len(values))))
    return out


def train(samples: dict[str, list[str]]) -> Model:
    """Models of the texts of each language, calibrated on every fifth text."""
    model = Model(sorted(k for k, texts in samples.items() if any(c.isalpha() for t in texts for c in t)))
    if not model.languages:
        return model
    learn = {k: [t for i, t in enumerate(samples[k]) if i % 5] or samples[k] for k in model.languages}
    held = {k: [t for i, t in enumerate(samples[k]) if not i % 5] for k in model.languages}
    seen = [_distinct_grams(learn[name]) for name in model.languages]
    languages = len(model.languages)
    lower: np.ndarray | None = None
    lower_keys: np.ndarray | None = None
    for k in range(ORDER):
        keys, first = np.unique(np.concatenate([x[k][0] for x in seen]), return_index=True)
        context_of = np.concatenate([x[k][1] for x in seen])[first]
        suffix_of = np.concatenate([x[k][2] for x in seen])[first]
        contexts = np.unique(context_of)
        context_at = np.searchsorted(contexts, context_of)
        p = np.zeros((len(keys), languages))
        weight = np.ones((len(contexts), languages))
        below = lower[np.searchsorted(lower_keys, suffix_of)] if k else np.full((len(keys), languages), 1.0 / (len(keys) + 1))
        for i in range(languages):
            if k == ORDER - 1:
                count = _count(seen[i][k][0], keys, seen[i][k][3])
            else:  # in how many ways it continues to the left: distinct longer n-grams that end in it
                count = _count(seen[i][k + 1][2], keys)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total = np.bincount(context_at, count, len(contexts))
            kinds = np.bincount(context_at, count > 0, len(contexts))
            used = total > 0
            weight[used, i] = discount * kinds[used] / total[used]
            share = np.maximum(count - discount, 0) / np.maximum(total, 1)[context_at]
            p[:, i] = share + weight[context_at, i] * below[:, i]
        model.grams.append((keys, np.log(p).astype(np.float32)))
        model.contexts.append((contexts, np.log(weight).astype(np.float32)))
        if not k:
            model.floor = float(-np.log(len(keys) + 1.0))
        lower, lower_keys = p, keys
    _calibrate(model, held, learn)
    return model


def _calibrate(model: Model, held: dict[str, list[str]], learn: dict[str, list[str]]) -> None:
    mean, spread, off = [], [], []
    for i, name in enumerate(model.languages):
        texts = [t for t in held[name] if any(c.isalpha() for c in t)] or [t for t in learn[name] if any(c.isalpha() for c in t)]
        n = np.zeros(len(texts), np.int64)
        entropy, scatter = np.zeros(len(texts)), np.zeros(len(texts))
        for j, text in enumerate(texts):  # the sample is small; one text at a time bounds the driver's memory
            codes, start, stop = encode([text])
            of_place = -model.log_probabilities(codes)[int(start[0]) - ORDER + 1 : int(stop[0]) - ORDER + 1, i].astype(np.float64)
            n[j], entropy[j], scatter[j] = len(of_place), of_place.mean(), of_place.var()
        centre = float(np.median(entropy))
        b = 3 * float(scatter.mean()) + 1e-3
        long = n >= 100
        around = np.abs(entropy[long] - centre) if long.any() else np.abs(entropy - centre)
        a = float(np.median(around) * 1.4826) ** 2 + 1e-4  # of the middle half: odd documents don't widen it
        mean.append(centre)
        spread.append((a, b))
        # texts that are nearer to random letters than to their language are no measure of it
        like = (entropy - centre) <= (-model.floor - entropy)
        off.append(((entropy - centre) / np.sqrt(a + b / np.maximum(n, 1)))[like])
    model.mean, model.spread = np.array(mean), np.array(spread)
    every = np.concatenate(off)
    model.z = max(LEAST_Z, 1.25 * float(np.quantile(every, 0.999))) if len(every) else LEAST_Z


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """The bounded sample of labelled texts by language, the same for the same table."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    slim = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    counts = slim.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row a language
    languages = counts.count()
    if not languages:
        return {}
    each = max(5, -(-SAMPLE_ROWS // languages))
    # of a language with n rows the smallest hashes lie below a share of their range; with this much room too few are next to never found
    share = F.least(F.lit(1.0), (each + 6 * each**0.5 + 20) / F.col("n"))
    below = slim.join(F.broadcast(counts), "lang").filter(F.col("h") / 2.0**64 + 0.5 <= share)
    chosen = below.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("k") <= each)
    # at most SAMPLE_ROWS ids, or five a language: safe to broadcast; a repeated id counts once
    got = rows.join(F.broadcast(chosen.select(F.col("doc_id").alias("i"), F.col("lang").alias("l"), "h").distinct()), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("lang") == F.col("l")))
    got = got.filter("text IS NOT NULL").withColumn("text", F.substring("text", 1, SAMPLE_CHARS))
    got = got.groupBy("lang", "h", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", "h", "doc_id").select("lang", "text").toArrow()
    out: dict[str, list[str]] = {}
    for name, value in zip(got["lang"].to_pylist(), got["text"].to_pylist(), strict=True):
        out.setdefault(name, []).append(value)
    return out


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of every whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample
    source = two_columns(docs, key, text)
    kind = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                name, score, entropy, rejected = zip(*known.judge([x or "" for x in batch.column(1).to_pylist()]), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    made = source.mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    return predict(docs, train(sample(docs, key, text, lang)), key, text)


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows, with all their columns, whose text isn't rejected. No shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                values = batch.column(batch.schema.get_field_index(text)).to_pylist()
                yield batch.filter(pa.array([not x[3] for x in known.judge([x or "" for x in values])], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)

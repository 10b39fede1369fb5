"""Toxicity by compression distance: windows compressed with a toxic and an ordinary zstandard dictionary."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import mapped, quoted, stored
from granary.llm.words import in_groups, released

WINDOW = 4
LEVELS = range(2, 8)
#: Numbers that describe a text: windows over each level, as a logarithm and as a share, and the most saved, twice; windows.
STATISTICS = 2 * (2 * len(LEVELS) + 1) + 1
ORDINARY_BYTES = 8192
#: Least likelihood ratio statistic and documents of a fragment of the toxic dictionary.
LEAST_G2, LEAST_DOCS = 50.0, 5
#: Held by both dictionaries and before every window, so that a match costs the same in each window.
CARRIER = bytes(range(33, 97))


@dataclass
class Model:
    """Both dictionaries' contents, and the logistic calibration of the window statistics."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _compressor(content: bytes, log: int):
    """Raw dictionary, no frame extras: lengths differ by what the dictionaries match and nothing else.

    log is the number of bits in the size of the larger dictionary: in tables that are smaller, its beginning, where
    toxic fragments are, is lost.
    """
    import zstandard as z

    made = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    how = z.ZstdCompressionParameters(
        window_log=max(17, log + 1), hash_log=max(13, log), chain_log=max(12, log), search_log=3, min_match=5, strategy=z.STRATEGY_GREEDY,
        format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    made.precompute_compress(compression_params=how)
    return z.ZstdCompressor(dict_data=made, compression_params=how)


def _statistics(ordinary: bytes, toxic: bytes):
    """A function from a text to its window statistics: how far the toxic dictionary shortens which share of windows.

    Each window is compressed three times: with the toxic dictionary, with the ordinary one and with neither.
    """
    log = max(len(ordinary), len(toxic)).bit_length()
    with_none, with_ordinary, with_toxic = (_compressor(content, log) for content in (CARRIER, ordinary, toxic))

    def of(text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        over, n, most = np.zeros((2, len(LEVELS))), 0, np.full(2, -np.inf)
        for low in range(0, max(len(words), 1), 8192 * WINDOW):
            part = words[low : low + 8192 * WINDOW]
            windows = [CARRIER + f" {' '.join(part[i : i + WINDOW])} ".encode("utf-8", "replace") for i in range(0, max(len(part), 1), WINDOW)]
            none, plain, bad = (np.array([len(x) for x in c.multi_compress_to_buffer(windows)]) for c in (with_none, with_ordinary, with_toxic))
            for k, saved in enumerate((none - bad, plain - bad)):
                over[k] += [(saved >= level).sum() for level in LEVELS]
                most[k] = max(most[k], saved.max())
            n += len(windows)
        return np.r_[np.log1p(over).ravel(), (over / n).ravel(), most, np.log(n)]

    return of


def _fragments(text: str | None) -> set[str]:
    """Beginnings of words of four or more letters, and whole words, each after a space."""
    out = set()
    for w in set((text or "").lower().split()):
        out.update(f" {w[:k]}" for k in range(4, min(len(w), 11) + 1))
        if len(w) <= 12:
            out.add(f" {w} ")
    return out


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int, longest: int, text: str, key: str, label: str) -> DataFrame:
    """toxic (0 or 1) and text of at most per_class documents a class: those first by hash of the key.

    labels must hold training rows only. Documents over longest bytes are not trained on.
    """
    known = labels.filter(quoted(key).isNotNull() & quoted(label).isin(0, 1)).select(quoted(key).alias("id"), quoted(label).alias("toxic")).distinct()
    order = F.xxhash64("id")
    chosen = [known.filter(F.col("toxic") == t).orderBy(order, "id").limit(per_class) for t in (0, 1)]
    ids = stored(chosen[0].unionByName(chosen[1]), "sample_ids")  # at most 2 * per_class rows, so they may be broadcast
    short = docs.filter(F.octet_length(quoted(text)) <= longest).select(quoted(key).alias("id"), quoted(text).alias("text"))
    return stored(short.join(F.broadcast(ids), "id").select("toxic", "text"), "sample")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, longest: int = 20_000, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Trains both dictionaries and the calibration on a bounded sample of labelled rows.

    The dictionaries are trained apart and share nothing but the carrier. The ordinary one holds the words that most
    ordinary documents use, up to ORDINARY_BYTES. The toxic one holds all word beginnings whose documents are toxic far
    over their share (likelihood ratio over LEAST_G2), save those that begin another one or go on from it; only the
    sample bounds their number. What counts of a window is how much shorter the toxic dictionary makes it than none
    does, and than the ordinary one does.
    The calibration is a logistic regression on the sample's window statistics, moved to the share of toxic among all
    training labels. Labels that are null or neither 0 nor 1 are left out, null ids too; a null text is an empty one; rows
    with equal hashes of the key go by the key, fragments with equal statistics by length and text; with one class only
    every text gets the class's share. Counts and statistics are made in tasks; the driver sees the fragments that pass and one row of
    statistics for each of at most 2 * per_class documents.
    """
    sample = training_sample(docs, labels, per_class, longest, text, key, label)
    totals = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        rate = (n1 + 1) / (n0 + n1 + 2)
        return Model(CARRIER, CARRIER, np.zeros(STATISTICS), np.ones(STATISTICS), np.r_[np.log(rate / (1 - rate)), np.zeros(STATISTICS)])

    def count(batches):
        held: Counter = Counter()
        for b in batches:
            for toxic, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.update((f, toxic) for f in _fragments(t))
        names = list({f for f, _ in held})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([held[f, t] for f in names], pa.int64()) for t in (0, 1))], ["f", "b", "a"])

    counts = stored(sample.mapInArrow(released(count), "f string, b long, a long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "fragments")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    g2 = 2 * (a * F.log(a * (n0 + n1) / ((a + b) * n1)) + F.when(b > 0, b * F.log(b * (n0 + n1) / ((a + b) * n0))).otherwise(0.0))
    often = (F.col("a") >= LEAST_DOCS) & (a / n1 > 4 * (b + 0.5) / n0)
    rated = counts.filter(often).withColumn("g2", g2).filter(F.col("g2") >= LEAST_G2)
    chosen: list[str] = []
    taken: set[str] = set()
    begun: set[str] = set()
    for r in rated.orderBy(F.desc("g2"), F.desc(F.length("f")), "f").collect():
        begins = {r.f[:k] for k in range(1, len(r.f) + 1)}
        if r.f not in begun and taken.isdisjoint(begins):
            chosen.append(r.f)
            taken.add(r.f)
            begun |= begins
    word = F.col("f").endswith(" ") & (F.col("b") >= 3)
    plain = counts.filter(word).orderBy(F.desc(F.col("b") * F.length("f")), "f").limit(ORDINARY_BYTES // 3).collect()
    content, size = [], 0
    for r in plain:
        size += len(r.f.encode())
        if size > ORDINARY_BYTES:
            break
        content.append(r.f)
    ordinary = "".join(content[::-1]).encode() + CARRIER
    toxic = "".join(f"{f} " for f in chosen[::-1]).encode() + CARRIER

    def measure(batches):
        of = _statistics(ordinary, toxic)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t).tolist() for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["toxic", "x"])

    kind = sample.schema["toxic"].dataType.simpleString()
    got = sample.repartition(32).mapInArrow(released(measure), f"toxic {kind}, x array<double>").collect()
    got.sort(key=lambda r: (r.toxic, r.x))
    x, y = np.array([r.x for r in got]), np.array([r.toxic for r in got], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    ridge = np.r_[0.0, np.full(z.shape[1] - 1, 5e-4 * len(y))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
    share = {r[0]: r[1] for r in labels.filter(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    w[0] += np.log(share[1] / share[0]) - np.log(n1 / n0)
    return Model(ordinary, toxic, mean, scale, w)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of df with out, the probability (0 to 1) that the text is toxic; no shuffle.

    Every window of the whole text counts. Null and empty texts are one empty window. A column of df with the
    name of out is replaced.
    """
    rest = [c for c in df.columns if c != out]
    at = rest.index(text)

    def run(batches):
        of = _statistics(model.ordinary, model.toxic)
        for whole in batches:
            for batch in in_groups(whole, at):
                x = np.array([of(t) for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.probability(x))], [*rest, out])

    return mapped(df, rest, released(run), [T.StructField(out, T.DoubleType())])

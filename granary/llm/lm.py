"""Log-bilinear language model (Mnih and Hinton, 2007) trained by noise-contrastive estimation, and a unigram base."""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stored
from granary.llm.words import in_groups, released, split_words

HEAD = 131_072
OWN = 2000
SHARED = 128
CONTEXT = 512
WIDTH = 12
NOISE = 64
BATCH = 1024
ROUNDS = 2
RATE = 0.2
#: The end token is the empty word, which no text holds.
END = ""


def _shared_class(word: str) -> int:
    return OWN + zlib.crc32(word[:2].encode()) % SHARED


@dataclass
class Vocabulary:
    """Counts of at most HEAD training words, the most frequent, and of all others by class."""

    words: pa.Array  # by rank; ranks below OWN are classes of their own
    counts: np.ndarray
    tokens: int
    distinct: int
    class_tokens: np.ndarray  # of shared classes
    class_words: np.ndarray

    def __post_init__(self) -> None:
        n = len(self.words)
        self.classes = np.array([k if k < OWN else _shared_class(w) for k, w in enumerate(self.words.to_pylist())], np.int32)
        self.end = self.words.index(END).as_py()
        # log10 of a word's share of its class; a class keeps one place for words that training never saw
        self.log_count = np.log10(self.counts + 1.0)
        self.log_class = np.zeros(OWN + SHARED)
        self.log_class[OWN:] = np.log10(self.class_tokens + self.class_words + 1)
        self.within = np.where(np.arange(n) < OWN, 0.0, self.log_count - self.log_class[self.classes])


def vocabulary(training: DataFrame, text: str) -> tuple[Vocabulary, DataFrame]:
    """The head for the driver and the counts of all words (word, c) as a table, over all training texts."""

    def count(batches):
        for whole in batches:
            for batch in in_groups(whole, 0, 16 << 20):
                words, at = split_words(batch.column(0))
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                names = pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([END])])
                yield pa.RecordBatch.from_arrays([names, pa.array(np.r_[n, len(at) - 1].astype(np.int64))], ["word", "c"])

    counts = training.select(text).mapInArrow(released(count), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = stored(counts.filter("c > 0"), "vocabulary")
    # the head is made of whole steps of the count, so that no task sends more than its share of it to the driver
    step = F.floor(F.log2("c") * 8).cast("int")
    least, total = 0, 0
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), reverse=True):
        least, total = r.s, total + r.n
        if total > HEAD:
            least += 1
            break
    found = counts.filter((step >= least) | (F.col("word") == END)).collect()
    head = sorted(found, key=lambda r: (-r.c, r.word))
    # the end always has a class of its own
    head = [r for r in head if r.word == END] + [r for r in head if r.word != END]
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    shared = (F.crc32(F.substring("word", 1, 2).cast("binary")) % SHARED).cast("int")
    by = {r[0]: (r[1], r[2]) for r in counts.groupBy(shared).agg(F.sum("c"), F.count("*")).collect()}
    ct, cw = np.zeros(SHARED), np.zeros(SHARED)
    for k, (c, n) in by.items():
        ct[k], cw[k] = c, n
    for r in head[:OWN]:
        k = _shared_class(r.word) - OWN
        ct[k], cw[k] = ct[k] - r.c, cw[k] - 1
    words = pa.array([r.word for r in head] or [END], pa.string())
    n = np.array([r.c for r in head] or [0], np.int64)
    return Vocabulary(words, n, tokens, distinct, ct, cw), counts


def _stream(texts: pa.Array, voc: Vocabulary):
    """(ranks, classes, contexts, offsets, words): the tokens of all texts, each text with its end.

    Rank -1 is a word outside the head. Contexts are the classes of the two tokens before, folded to CONTEXT;
    the last context stands for no token.
    """
    words, at = split_words(texts)
    ranks = pc.fill_null(pc.index_in(words.dictionary, value_set=voc.words), -1).to_numpy()
    names = words.dictionary.to_pylist()
    own = np.where(ranks >= 0, voc.classes[ranks], 0).astype(np.int32)
    for k in np.flatnonzero(ranks < 0):
        own[k] = _shared_class(names[k])
    codes = words.indices.to_numpy()
    offsets = at + np.arange(len(at))
    ends = offsets[1:] - 1
    inner = np.ones(offsets[-1], bool)
    inner[ends] = False
    rank, cls, code = np.empty(len(inner), np.int64), np.empty(len(inner), np.int64), np.full(len(inner), -1, np.int64)
    rank[inner], cls[inner], code[inner] = ranks[codes], own[codes], codes
    rank[ends], cls[ends] = voc.end, voc.classes[voc.end]
    folded = np.where(cls < CONTEXT // 2, cls, CONTEXT // 2 + cls % (CONTEXT // 2 - 1))
    before = np.full((2, len(cls)), CONTEXT - 1)
    before[0, 1:], before[1, 2:] = folded[:-1], folded[:-2]
    starts = offsets[:-1]
    before[:, starts] = CONTEXT - 1
    before[1, starts[starts + 1 < offsets[1:]] + 1] = CONTEXT - 1
    return rank, cls, before, offsets, code, words.dictionary


@dataclass
class Model:
    """Scores of class t after contexts (c1, c2): (first[c1] + second[c2]) . target[t] + bias[t]."""

    first: np.ndarray
    second: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def rows(self) -> np.ndarray:
        pad = lambda m: np.c_[m, np.zeros(len(m))]
        return np.concatenate([pad(self.first), pad(self.second), np.c_[self.target, self.bias]])

    @staticmethod
    def of(rows: np.ndarray) -> Model:
        a, b, c = rows[:CONTEXT], rows[CONTEXT : 2 * CONTEXT], rows[2 * CONTEXT :]
        return Model(a[:, :-1].copy(), b[:, :-1].copy(), c[:, :-1].copy(), c[:, -1].copy())


def start(noise: np.ndarray, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    small = lambda n: rng.normal(0, 0.3, (n, WIDTH))
    return Model(small(CONTEXT), small(CONTEXT), small(len(noise)) * 0.3, np.log(noise))


def _add(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values (m, WIDTH) by row number, as an (n, WIDTH) array."""
    flat = (rows[:, None] * WIDTH + np.arange(WIDTH)).ravel()
    return np.bincount(flat, values.ravel(), n * WIDTH).reshape(n, WIDTH)


def train_on(model: Model, state: list[np.ndarray], cls: np.ndarray, before: np.ndarray, noise: np.ndarray, rng) -> None:
    """One pass of NCE over the tokens: each batch shares NOISE noise classes; steps are scaled as in AdaGrad."""
    log_noise = np.log(noise * NOISE)
    total = np.cumsum(noise)
    for low in range(0, len(cls), BATCH):
        t, c1, c2 = cls[low : low + BATCH], before[0, low : low + BATCH], before[1, low : low + BATCH]
        n = np.minimum(np.searchsorted(total, rng.random(NOISE) * total[-1]), len(noise) - 1)
        r = model.first[c1] + model.second[c2]
        qt, qn = model.target[t], model.target[n]
        up = 1 / (1 + np.exp(np.clip((r * qt).sum(1) + model.bias[t] - log_noise[t], -30, 30)))  # 1 - sigmoid
        down = -1 / (1 + np.exp(-np.clip(r @ qn.T + model.bias[n] - log_noise[n], -30, 30)))
        gr = up[:, None] * qt + down @ qn
        g = [
            _add(c1, gr, CONTEXT),
            _add(c2, gr, CONTEXT),
            _add(t, up[:, None] * r, len(noise)) + _add(n, down.T @ r, len(noise)),
            (np.bincount(t, up, len(noise)) + np.bincount(n, down.sum(0), len(noise)))[:, None],
        ]
        for x, s, own in zip((model.first, model.second, model.target, model.bias[:, None]), state, g):
            s += own * own
            # the biases start at their optimum without context
            x += (RATE if x.shape[1] > 1 else 0.1 * RATE) * own / np.sqrt(s + 1)


def train(training: DataFrame, voc: Vocabulary, text: str, part: Column) -> Model:
    """Rounds of local passes, each over its share of the documents (part: 0 to ROUNDS - 1), averaged by tokens.

    A task starts from the broadcast model, whose size is fixed, trains on its own texts and returns its
    parameter rows; sums per parameter row are combined before the shuffle. Together the rounds read each training
    document once. A lost task is trained again from the same start with the same noise seed.
    """
    noise = np.zeros(OWN + SHARED)
    np.add.at(noise, voc.classes[: min(OWN, len(voc.classes))], voc.counts[:OWN])
    noise[OWN:] += voc.class_tokens
    noise = (noise + 1) / (noise + 1).sum()
    model = start(noise)
    columns = [f"v{k}" for k in range(WIDTH + 1)]
    spark = training.sparkSession
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(cloudpickle.dumps((voc, model)))

        def local(batches, shared=shared):
            voc, model = pickle.loads(shared.value)
            model = Model.of(model.rows())
            state = [np.zeros_like(x) for x in (model.first, model.second, model.target)] + [np.zeros((len(model.bias), 1))]
            rng, seen = np.random.default_rng(11), 0
            for whole in batches:
                for batch in in_groups(whole, 0, 8 << 20):
                    _, cls, before, *_ = _stream(batch.column(0), voc)
                    train_on(model, state, cls, before, noise, rng)
                    seen += len(cls)
            rows = model.rows() * seen
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), float(seen))), *map(pa.array, rows.T.copy())], ["row", "n", *columns])

        sent = training.filter(part == k).select(text).mapInArrow(released(local), "row long, n double, " + ", ".join(f"{c} double" for c in columns))
        got = sent.groupBy("row").agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in columns]).orderBy("row").collect()
        if got:
            model = Model.of(np.array([[r[c] for c in columns] for r in got]))
    return model


def _tables(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of every class after each first and second context, and the log of each context pair's sum."""
    one, two = model.first @ model.target.T, model.second @ model.target.T + model.bias
    one32, two32 = one.astype(np.float32), two.astype(np.float32)
    norm = np.empty((CONTEXT, CONTEXT))
    for c in range(CONTEXT):
        s = one32[c] + two32
        top = s.max(1)
        norm[c] = top + np.log(np.exp(s - top[:, None]).sum(1, dtype=np.float64))
    return one, two, norm


def language_model_scores(df: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of df.

    Tokens are words between ASCII white space with A-Z lower-cased, and one end. base_score is the log10
    probability under add-one unigrams of the training rows (held_out false or null). score is that of the model: a word's
    class after the two tokens before it, log-bilinear and normalised over all classes, times the word's add-one
    share of its class. The OWN most frequent words are classes of their own; the others share SHARED classes by
    their first two letters, each with one place for unseen words, so both scores sum to 1 over known words and
    the unseen.

    Counts of the HEAD most frequent words (a fixed number) are broadcast; rarer words meet their counts in one
    join, which no frequent word takes part in, after folding to one row for each document and word.
    Null and empty texts hold the end alone. Repeated rows are scored each. Other columns are left out. Without
    training rows every word is unseen.
    """
    docs = df.select(F.col(key).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    training = docs.filter(~F.col("held_out"))
    voc, counts = vocabulary(training, "text")
    part = F.pmod(F.xxhash64("text"), F.lit(ROUNDS).cast("long"))
    model = train(training, voc, "text", F.coalesce(part, F.lit(0)))
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(cloudpickle.dumps((voc, _tables(model))))
    log10 = float(np.log(10))

    def run(batches):
        voc, (one, two, norm) = pickle.loads(shared.value)
        for whole in batches:
            for batch in in_groups(whole, 2, 4 << 20):
                rank, cls, before, offsets, code, names = _stream(batch.column(2), voc)
                c1, c2 = before
                part = (one[c1, cls] + two[c2, cls] - norm[c1, c2]) / log10
                known = rank >= 0
                count = np.where(known, voc.log_count[rank], 0.0)
                # words outside the head lack their count until the join
                part += np.where(known, voc.within[rank], -voc.log_class[cls])
                add = lambda x: np.add.reduceat(x, offsets[:-1]) if len(offsets) > 1 else x[:0]
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                rare, n = np.unique(row[~known] * len(names) + code[~known], return_counts=True)
                word, at = names.take(pa.array(rare % max(len(names), 1))), np.searchsorted(rare // max(len(names), 1), np.arange(len(offsets)))
                pairs = pa.StructArray.from_arrays([word.cast(pa.string()), pa.array(n.astype(np.int64))], ["word", "n"])
                seen = known & (voc.counts[rank] > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.array(add(seen.astype(np.int64))),
                        pa.array(add(count)),
                        pa.array(add(part)),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pairs),
                    ],
                    ["id", "held_out", "n_tokens", "known", "base", "model", "rare"],
                )

    kind = df.schema[key].dataType.simpleString()
    fields = f"id {kind}, held_out boolean, n_tokens long, known long, base double, model double, rare array<struct<word string, n long>>"
    scored = stored(docs.mapInArrow(released(run), fields).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    met = rare.join(counts, "word").groupBy("row").agg(F.sum("n").alias("known_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("extra"))
    out = scored.drop("rare").join(met, "row", "left")
    extra = F.coalesce("extra", F.lit(0.0))
    unit = float(np.log10(voc.tokens + voc.distinct + 1.0))
    return out.select(
        F.col("id").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("model") + extra).alias("score"),
    )

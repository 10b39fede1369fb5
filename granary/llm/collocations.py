"""Phrase collocations by best-first branch and bound: prefixes grow while their bound reaches a language's last place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import _bloom, dropped, quoted, stored
from granary.llm.words import MIX_A, STEP, in_groups, mixed, released

#: What ends a piece and what parts words, after A-Z are lower-cased (fixed by the contract of the query).
ENDS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
LONGEST = 4
#: Pairs and neighbours that a task counts before it passes them on; phrases that one pass over the texts expands.
HELD, PHRASES = 3 << 19, 1 << 20
#: Prefixes a language expands in the first round; every further round takes four times as many. Bytes of text taken together.
FIRST_ROUND, GROUP = 16_000, 8 << 20

_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ENDS + GAPS, b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(ENDS) + b" " * len(GAPS))


class Tokens:
    """Words of texts of one language: codes into distinct words, and whether a word has the next one in its piece."""

    def __init__(self, texts: list[bytes], lang: str, seed: int):
        import xxhash

        data = np.frombuffer(b"\n".join(texts).translate(_TABLE), np.uint8)
        gap = (data == 32) | (data == 10)
        first = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
        last = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
        offsets = np.r_[0, np.cumsum(last - first)].astype(np.int64)
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])])
        coded = made.dictionary_encode()
        self.words, self.codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        before = lang.encode() + b"\n"
        self.hashes = np.array([xxhash.xxh3_64_intdigest(before + w, seed) for w in self.words], np.uint64)
        piece = np.cumsum(data == 10)[first]
        self.linked = piece[1:] == piece[:-1]

    def each(self) -> np.ndarray:
        return self.hashes[self.codes]


def _tokens(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[str, Tokens]]:
    for whole in batches:
        for b in in_groups(whole, 1, GROUP):
            coded = b.column(0).dictionary_encode()
            codes = coded.indices.to_numpy()
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                texts = [x.as_buffer().to_pybytes() for x in b.column(1).filter(pa.array(codes == k))]
                if any(texts):
                    yield lang, Tokens(texts, lang, seed)


def _word_counts(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, t in _tokens(batches, seed):
            n = np.bincount(t.codes, minlength=len(t.words))
            columns = [pa.array([lang] * len(n), pa.string()), pa.array(t.words, pa.binary()), pa.array(t.hashes.view(np.int64)), pa.array(n)]
            yield pa.record_batch(columns, ["lang", "word", "h", "n"])

    return run


def _among(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether each k may be in the set behind the bitmaps; never no for one that is."""
    bucket, bit = (k & np.uint64(255)).astype(np.int64), ((k >> np.uint64(8)) & np.uint64(32767)).astype(np.int64)
    return (bits[bucket, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _bitmaps(keys: DataFrame) -> np.ndarray:
    """The bitmaps of column k: 256 rows of 4 KB, whatever the number of keys."""
    out = np.zeros((256, 4096), np.uint8)
    for r in _bloom(keys).collect():
        out[r["_bucket"]] = np.frombuffer(r["_map"], np.uint8)
    return out


def _key(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(STEP) + h * np.uint64(MIX_A))


def _counted(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate(x).view(np.int64) for x in zip(*parts)]
    t = pa.table(columns, names).group_by(names).aggregate([([], "count_all")])
    return t.select([*names, "count_all"]).rename_columns([*names, "n"]).combine_chunks().to_batches()[0]


def _pair_counts(seed: int, frequent: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences of words one after another, both of them frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for _, t in _tokens(batches, seed):
            often = _among(frequent, t.hashes)[t.codes]
            at = np.flatnonzero(t.linked & often[:-1] & often[1:])
            if len(at):
                held.append([t.hashes[t.codes[at]], t.hashes[t.codes[at + 1]]])
                size += len(at)
            if size >= HELD:
                yield _counted(held, ["h1", "h2"])
                held, size = [], 0
        if held:
            yield _counted(held, ["h1", "h2"])

    return run


class _Phrases:
    """Phrases of one length: numbers of those that begin at each place."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        key = self.keys(hashes.T)
        order = np.argsort(key)
        self.key, self.hashes, self.numbers = key[order], hashes[order], numbers[order]
        if len(key) and (self.key[1:] == self.key[:-1]).any():
            raise ValueError("two phrases of one key: count again with another seed")
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(key >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def keys(columns) -> np.ndarray:
        out = columns[0]
        for c in columns[1:]:
            out = _key(out, c)
        return out

    def at(self, h: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places where one of the phrases begins, its number)."""
        size = self.hashes.shape[1]
        n = len(h) - size + 1
        if n <= 0 or not len(self.key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = linked[:n].copy()
        for k in range(1, size - 1):
            whole &= linked[k : k + n]
        place = np.flatnonzero(whole)
        key = self.keys([h[place + k] for k in range(size)])
        may = self.seen[(key >> np.uint64(42)).astype(np.int64)]
        place, key = place[may], key[may]
        found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        same = self.key[found] == key
        for k in range(size):
            same &= self.hashes[found, k] == h[place + k]
        return place[same], self.numbers[found[same]]


def _neighbours(seed: int, pairs: np.ndarray, phrases: list[_Phrases]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(phrase, side, word beside it) counted; only words that make a frequent pair with the phrase's outer word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for _, t in _tokens(batches, seed):
            h = t.each()
            if len(h) < 2:
                continue
            often = t.linked & _among(pairs, _key(h[:-1], h[1:]))
            for p in phrases:
                place, number = p.at(h, t.linked)
                end = place + p.hashes.shape[1]
                right = np.flatnonzero((end < len(h)) & often[np.minimum(end - 1, len(often) - 1)])
                left = np.flatnonzero((place > 0) & often[np.maximum(place - 1, 0)])
                for side, rows, beside in ((0, right, end[right]), (1, left, place[left] - 1)):
                    if len(rows):
                        held.append([number[rows] * 2 + side, h[beside].view(np.int64)])
                        size += len(rows)
            if size >= HELD:
                yield _counted(held, ["e", "h"])
                held, size = [], 0
        if held:
            yield _counted(held, ["e", "h"])

    return run


def _floor(a: Column, under: Column) -> Column:
    """floor(2000000 * a / under), exact for any longs."""
    top = F.lit(2_000_000).cast("decimal(8,0)") * a.cast("decimal(20,0)")
    return F.call_function("div", top, under.cast("decimal(20,0)"))


def _scored(new: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, p, a, l, r, score and bound of phrases (lang, p, a); counts has the count of every shorter phrase inside them.

    bound holds for the phrase and all it is a prefix of: the rest behind a cut occurs as often as the whole at least, and
    the whole at most a times, so floor(2000000 a / (l + a)) at any cut inside it is not exceeded.
    """
    cut = new.select("lang", "p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cut = cut.withColumns({"head": F.slice("p", F.lit(1), F.col("k")), "tail": F.slice("p", F.col("k") + 1, F.size("p"))})
    cut = cut.join(counts.select(F.col("p").alias("head"), F.col("f").alias("l")), "head")
    cut = cut.join(counts.select(F.col("p").alias("tail"), F.col("f").alias("r")), "tail")
    cut = cut.withColumns({"score": _floor(F.col("a"), F.col("l") + F.col("r")), "most": _floor(F.col("a"), F.col("l") + F.col("a"))})
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cut.groupBy("lang", "p", "a").agg(least, F.min("most").alias("bound")).select("lang", "p", "a", "cut.l", "cut.r", "cut.score", "bound")


def _word_table(texts: DataFrame) -> tuple[DataFrame, int]:
    """All words with their counts and hashes, and a seed with which no two words of the table share a hash."""
    seed = 0
    while True:
        made = texts.mapInArrow(released(_word_counts(seed)), "lang string, word binary, h long, n long")
        words = stored(made.groupBy("lang", "word", "h").agg(F.sum("n").alias("f")), "words")
        if words.groupBy("h").count().filter("count > 1").isEmpty():
            return words, seed
        dropped(words)
        seed += 1


def collocations(
    df: DataFrame, top: int = 2000, least: int = 30, share: tuple[int, int] = (80, 100), lang: str = "lang", text: str = "text", first_round: int = FIRST_ROUND
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of two to four words of each language.

    Counts are exact over all texts: a of the phrase, l and r of its parts at the cut that scores lowest (the first of equal
    ones), n of all words of the language; score is floor(2000000 a / (l + r)). Phrases occur `least` times or more, and
    those inside a longer such phrase with share[1] * f(longer) >= share[0] * a are left out. Null texts are empty, a null lang is `und`;
    repeated rows count each, a long text is one text, other columns are left out, and an empty table gives no rows.

    All words and pairs are counted once. From there on a language expands only prefixes whose bound reaches the score of
    its top-th phrase found so far, best bounds first: one pass over the texts counts the words on either side of the phrases
    of a round, which gives the longer phrases and tells which phrases a longer one covers. It ends when no bound reaches it.
    """
    spark = df.sparkSession
    texts = df.select(F.coalesce(quoted(lang), F.lit("und")).alias("lang"), F.coalesce(quoted(text), F.lit("")).cast("binary").alias("bits"))
    words, seed = _word_table(texts)
    often = words.filter(F.col("f") >= least)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    made = texts.mapInArrow(released(_pair_counts(seed, _bitmaps(often.select(F.col("h").alias("k"))))), "h1 long, h2 long, n long")
    pairs = made.groupBy("h1", "h2").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    pairs = stored(pairs.join(often.select(F.col("h").alias("h1"), "lang"), "h1").select("lang", F.array("h1", "h2").alias("p"), "a"), "pairs")
    counts = [often.select(F.array("h").alias("p"), "f"), pairs.select("p", F.col("a").alias("f"))]
    both = _pair_bitmaps(spark, pairs)
    found = [stored(_scored(pairs, counts[0].union(counts[1])), "phrases")]
    settled: list[DataFrame] = []  # phrases expanded, with the count of their commonest extension
    floor: DataFrame | None = None
    take = first_round
    while True:
        phrases = _all(found)
        shorter = phrases.filter(F.size("p") < LONGEST)
        open_ = shorter.join(_all(settled).select("p"), "p", "left_anti") if settled else shorter
        if floor is not None:
            open_ = open_.join(floor, "lang", "left").filter(F.col("bound") >= F.coalesce("floor", F.lit(0))).drop("floor")
        batch = stored(_best(open_, take).select("lang", "p"), "batch")
        n = batch.count()
        if not n:
            dropped(batch)
            break
        # a phrase of four words is scored by the three behind its first, so the pair behind a phrase's first goes before it
        tails = batch.filter(F.size("p") == 3).select("lang", F.slice("p", 2, 2).alias("p"))
        if settled:
            tails = tails.join(_all(settled).select("p"), "p", "left_anti")
        tails = tails.select("lang", "p").distinct()
        ready = batch.filter(F.size("p") == 2).select("lang", "p").union(tails).distinct()
        late = batch.filter(F.size("p") == 3).withColumn("tail", F.slice("p", 2, 2)).join(tails.select(F.col("p").alias("tail")), "tail", "left_anti").select("lang", "p")
        now = stored(ready.union(late).withColumn("e", F.monotonically_increasing_id()), "expand")
        beside = stored(_expanded(spark, texts, now, seed, both).filter(F.col("n") >= least), "beside")
        on = beside.join(now, "e")
        longer = on.filter("side = 0").select("lang", F.concat("p", F.array("h")).alias("p"), F.col("n").alias("a"))
        counts.append(longer.filter(F.size("p") < LONGEST).select("p", F.col("a").alias("f")))
        found.append(stored(_scored(longer, _all(counts)), "phrases"))
        most = on.groupBy("e").agg(F.max("n").alias("most"))
        settled.append(stored(now.join(most, "e", "left").select("p", F.coalesce("most", F.lit(0)).alias("most")), "settled"))
        if floor is not None:
            dropped(floor)
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
        ranked = _surviving(_all(found), _all(settled), share).select("lang", "score").withColumn("place", place)
        floor = stored(ranked.filter(F.col("place") <= top).groupBy("lang").agg(F.min("score").alias("floor"), F.count("*").alias("n")), "floor")
        floor_at = floor._stored_at
        floor = floor.filter(F.col("n") == top).select("lang", "floor")
        floor._stored_at = floor_at
        dropped(batch)
        take *= 4
    last = _surviving(_all(found), _all(settled), share) if settled else _all(found)
    if floor is not None:
        last = last.join(floor, "lang", "left").filter(F.col("score") >= F.coalesce("floor", F.lit(0))).drop("floor")
    spelled = last.select("lang", "p", "a", "l", "r", "score", F.posexplode("p").alias("at", "h")).join(often.select("h", "word"), "h")
    spelled = spelled.groupBy("lang", "p", "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("ws"))
    phrase = F.array_join(F.transform("ws", lambda w: w["word"].cast("string")), " ").alias("phrase")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = spelled.select("lang", phrase, "a", "l", "r", "score").withColumn("rank", rank).filter(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pair_bitmaps(spark: SparkSession, pairs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).flatten().to_numpy().view(np.uint64).reshape(-1, 2)
            yield pa.record_batch([pa.array(_key(h[:, 0], h[:, 1]).view(np.int64))], ["k"])

    return _bitmaps(pairs.select("p").mapInArrow(run, "k long"))


def _best(open_: DataFrame, take: int) -> DataFrame:
    """About the take best bounds of each language: whole steps of 1000 of the bound, one step at least."""
    stepped = open_.withColumn("step", F.floor(F.col("bound") / 1000))
    steps = stepped.groupBy("lang", "step").agg(F.count("*").alias("n"))
    above = Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    chosen = steps.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).filter(F.col("above") < take).select("lang", "step")
    return stepped.join(chosen, ["lang", "step"], "left_semi")


def _expanded(spark: SparkSession, texts: DataFrame, now: DataFrame, seed: int, pairs: np.ndarray) -> DataFrame:
    """(e, side, h, n): how often word h stands right (side 0) or left (1) of phrase e, in passes of at most PHRASES phrases."""
    slices = -(-now.count() // PHRASES)
    out: list[DataFrame] = []
    for k in range(slices):
        t = now.filter(F.pmod(F.xxhash64("p"), F.lit(slices)) == k).select("e", "p").toArrow()
        size, e = np.array([len(x) for x in t["p"].to_pylist()]), t["e"].to_numpy()
        phrases = []
        for length in (2, 3):
            h = t["p"].filter(pa.array(size == length)).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, length)
            phrases.append((h, e[size == length]))
        sent = spark.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            yield from _neighbours(seed, pairs, [_Phrases(*x) for x in sent.value])(batches)

        made = texts.mapInArrow(released(run), "e long, h long, n long").groupBy("e", "h").agg(F.sum("n").alias("n"))
        out.append(made.select(F.shiftright("e", 1).alias("e"), (F.col("e") % 2).alias("side"), "h", "n"))
    return _all(out)


def _surviving(phrases: DataFrame, settled: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Phrases known not to lie inside a longer one that is nearly as common: those of the greatest length, and expanded ones."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    known = phrases.join(settled, "p").filter(wide("most") * share[1] < wide("a") * share[0]).drop("most")
    return known.unionByName(phrases.filter(F.size("p") == LONGEST).select(known.columns))

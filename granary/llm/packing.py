"""Packing token pieces into sequences: exact complements from the length histogram, then best fit."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import boxed, quoted, stored, unboxed
from granary.llm.words import IdCache, in_groups, released, spread

CACHE = 200_000
SALTS = 256
#: Letters of ASCII and Latin-1: their lower case is one letter, and no other letter composes to it.
LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
#: A chunk's closing run of ASCII marks after a letter.
TAIL = rf"(?P<last>[{LETTERS}])(?P<tail>[!-/:-@\[-`{{-~]+)$"
_ENCODERS: dict[str, Callable] = {}


def _encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """The encoder of a tokenizer file, made once in each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _new_encoder(path)
    return _ENCODERS[path]


def _new_encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Texts to (ids of all, offsets): each text is cut at ASCII white space and each distinct chunk encoded once.

    Needs a tokenizer that never merges across ASCII white space and ignores it, that lower-cases, and that parts
    runs of letters from runs of other marks, as word-level BPE files do. Chunks then share their lower-case form
    without the marks that close them, and chunks of Latin letters alone, which no other step of the tokenizer
    changes or cuts, go to its BPE model at once; all others take the whole way.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenize = tokenizer.model.tokenize
    letters = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LETTERS.lower()}
    plain = re.compile(f"[{LETTERS}]+")

    def ids_of(w: str) -> list[int]:
        if plain.fullmatch(w):
            return [t.id for t in tokenize(w if w.isascii() else w.lower().translate(letters))]
        return tokenizer.encode(w, add_special_tokens=False).ids

    known = IdCache(lambda new: list(map(ids_of, new)), CACHE)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks = pc.ascii_split_whitespace(texts)
        flat = chunks.flatten().dictionary_encode()
        words = flat.dictionary.cast(pa.string())
        special = pc.match_substring(words, "<|")
        tails = pc.if_else(special, "", pc.fill_null(pc.struct_field(pc.extract_regex(words, TAIL), "tail"), ""))
        bases = pc.if_else(special, words, pc.ascii_lower(pc.replace_substring_regex(words, TAIL, "\\1")))
        bases, tails = bases.dictionary_encode(), tails.dictionary_encode()
        names = [*bases.dictionary.to_pylist(), *tails.dictionary.to_pylist()]
        codes = known.codes(list(dict.fromkeys(names)))
        place = dict(zip(dict.fromkeys(names), codes.tolist()))
        code = np.array([place[x] for x in names], np.int64)
        two = np.stack([code[: len(bases.dictionary)][bases.indices.to_numpy()], code[len(bases.dictionary) :][tails.indices.to_numpy()]], 1)
        ids, ends = known.lists(two.ravel())
        ids, after = spread(ids, ends[:-1:2], ends[2::2] - ends[:-1:2], flat.indices.to_numpy())
        return ids, after[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Token pieces of each document: key, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and then end_id; a longer one is cut every capacity tokens. A null text is empty:
    one piece that holds end_id alone. Rows that repeat give pieces that repeat, a null key is kept. Very long texts
    are encoded alone, others in groups of two megabytes. Columns besides key and text are left out; an empty table
    gives an empty one.
    """
    end = np.array([end_id], "<u4")

    def cut(batches):
        encode = _encoder(tokenizer)
        for batch in batches:
            for part in in_groups(batch, 1):
                ids, ends = encode(pc.fill_null(part.column(1), ""))
                out = {n: [] for n in ("row", "piece", "start", "length", "ids_crc32", "ids")}
                for r in range(len(part)):
                    own = np.r_[ids[ends[r] : ends[r + 1]].astype("<u4"), end]
                    for p, s in enumerate(range(0, len(own), capacity)):
                        x = own[s : s + capacity]
                        out["row"].append(r)
                        out["piece"].append(p)
                        out["start"].append(s)
                        out["length"].append(len(x))
                        out["ids_crc32"].append(zlib.crc32(x.tobytes()))
                        if with_ids:
                            out["ids"].append(x.astype("i4"))
                columns = [part.column(0).take(pa.array(out["row"])), pa.array(out["piece"], pa.int32())]
                columns += [pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32")]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(quoted(key), quoted(text)).mapInArrow(released(cut), schema)


def _complement(have: np.ndarray, gap: int, terms: int) -> list[int] | None:
    """terms available lengths, largest first, that fill gap exactly under the counts of have."""
    if terms == 1:
        return [gap] if have[gap] > 0 else None
    if terms == 2:
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        hit = np.flatnonzero((have[a] > 0) & (have[gap - a] > (a == gap - a)))
        return [int(a[hit[0]]), int(gap - a[hit[0]])] if len(hit) else None
    for a in range(gap - 2, (gap - 1) // 3, -1):
        if have[a] > 0:
            have[a] -= 1
            rest = _complement(have, gap - a, 2)
            have[a] += 1
            if rest:
                return [a, *rest]
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, copies), ...] with the number of sequences of each, from the counts by length.

    Lengths go from long to short; each takes the single, pair or triple of other lengths that fills its gap
    exactly, as often as the counts allow. What finds no complement is packed by best fit, longest first, with
    equal bins handled together. The work depends on the number of distinct lengths, not of documents.
    """
    have = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        have[n] = c
    made: list[tuple[list[tuple[int, int]], int]] = []
    if have[capacity]:
        made.append(([(capacity, 1)], int(have[capacity])))
        have[capacity] = 0
    for terms in (1, 2, 3):
        for n in range(capacity - 1, 0, -1):
            while have[n] > 0:
                have[n] -= 1
                rest = _complement(have, capacity - n, terms)
                have[n] += 1
                if not rest:
                    break
                use: dict[int, int] = {}
                for x in (n, *rest):
                    use[x] = use.get(x, 0) + 1
                times = min(int(have[x]) // k for x, k in use.items())
                for x, k in use.items():
                    have[x] -= k * times
                made.append((sorted(use.items(), reverse=True), times))
    bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def put(pattern: list[tuple[int, int]], times: int) -> None:
        if times:
            bins.setdefault(capacity - sum(n * k for n, k in pattern), []).append((pattern, times))

    for n in range(capacity, 0, -1):
        left = int(have[n])
        while left:
            gap = min((g for g in bins if g >= n), default=None)
            if gap is None:
                pattern, times, gap = [], left, capacity
            else:
                pattern, times = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
            each = gap // n
            full = min(times, left // each)
            left -= full * each
            put([*pattern, (n, each)], full)
            times -= full
            if left and times:
                last = min(left, each)
                left -= last
                put([*pattern, (n, last)], 1)
                times -= 1
            if pattern:
                put(pattern, times)
    return made + [x for group in bins.values() for x in group]


def pack(df: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """All columns of df with sequence_id and offset; every sequence holds at most capacity tokens, without gaps.

    Only the counts by length (at most capacity of them) and the plan made of them pass the driver. Rows get
    their rank among the rows of their length from counts by (length, salt), so that a length which a third of
    all rows have is no single task's, and the rank picks the place in the plan. Lengths must be from 1 to
    capacity; others, and null, raise an error. An empty table gives an empty one, rows that repeat are packed each.
    Other columns may have any name; those named sequence_id or offset are replaced.
    """
    names = [c for c in df.columns if c not in ("sequence_id", "offset")]
    held = df.select(*map(quoted, names))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")
    rows = stored(held.select(boxed(held).alias("row"), quoted(length).cast("long").alias("n"), salt), "pieces")
    groups = stored(rows.groupBy("n", "salt").agg(F.count("*").alias("k")), "lengths")
    counts = {r[0]: r[1] for r in groups.groupBy("n").agg(F.sum("k")).limit(capacity + 2).collect()}
    if any(n is None or not 0 < n <= capacity for n in counts):
        raise ValueError(f"a length is not from 1 to {capacity}: {sorted(counts, key=str)[:3]}")
    runs, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, times in plan(counts, capacity):
        offset = 0
        for n, each in pattern:
            runs.append((n, taken[n], each, sequence, offset))
            taken[n] += each * times
            offset += n * each
        sequence += times
    runs.sort()
    lengths, ranks, each, first, offset = (np.array(x, np.int64) for x in zip(*runs)) if runs else [np.zeros(0, np.int64)] * 5
    starts = lengths * (1 << 48) + ranks

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = np.searchsorted(starts, n.to_numpy() * (1 << 48) + rank.to_numpy(), side="right") - 1
        q = rank.to_numpy() - ranks[r]
        return pd.DataFrame({"sequence_id": first[r] + q // each[r], "offset": offset[r] + q % each[r] * n.to_numpy()})

    before = F.sum("k").over(Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    base = groups.select("n", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    order = [F.col("row").getField(c) for c in ("doc_id", "piece") if c in names]
    within = F.row_number().over(Window.partitionBy("n", "salt").orderBy(*order or [F.lit(0)])) - 1
    ranked = rows.withColumn("rank", within.cast("long")).join(base, ["n", "salt"])
    out = ranked.select("row", place("n", F.col("rank") + F.col("base")).alias("at"))
    return out.select(*unboxed("row", names), "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of every sequence, in place order: sequence_id, ids. A group holds at most one capacity of tokens."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(held, lambda x: x["ids"])).alias("ids"))

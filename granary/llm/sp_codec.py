"""SentencePiece encoding over a trie of distinct words, walked depth-first with shared forward states, and decoding."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from granary.llm.common import mapped
from granary.llm.words import IdCache, released, spread

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
KNOWN = 200_000


class Vocabulary:
    """Pieces, scores and byte ids of a model file; kind is bpe or unigram."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.unknown = kind, model.unk_id()
        ids = range(model.vocab_size())
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in ids]
        pieces = [model.id_to_piece(i) for i in ids]
        self.load({p: (i, model.get_score(i)) for i, p in enumerate(pieces) if not special[i]})
        self.byte = {int(pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.out = [self._bytes(i, pieces[i]) for i in ids]

    def load(self, pieces: dict[str, tuple[int, float]]) -> None:
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece goes across words")
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.worst = min((s for _, s in pieces.values()), default=0.0) - 10
        inner = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.inner = np.array(sorted(ord(a) << 32 | ord(b) for a, b in inner), np.uint64)
        if self.kind == "bpe":
            self.fit: dict[tuple[str, str], bool] = {}
            self._grow()

    def _grow(self) -> None:
        """How byte-pair merges make each piece: the symbols at its left and right edge as they grow, with the
        negative score at which each is made. Pieces that merging does not make of their own text stay out."""
        self.left: dict[str, list[tuple[float, str]]] = {}
        self.right: dict[str, list[tuple[float, str]]] = {}
        self.back: dict = {}  # a trie of these pieces from their last character to their first
        for piece in sorted(self.pieces, key=len):
            if len(piece) == 1:
                continue
            halves = self._halves(piece)
            if halves is None:
                continue
            x, y = halves
            node = self.back
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = {}
            made = max([-self.pieces[piece][1], *(self.left[z][-1][0] for z in halves if len(z) > 1)])
            self.left[piece] = [*self.left.get(x, ()), (made, piece)]
            self.right[piece] = [*self.right.get(y, ()), (made, piece)]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two symbols that merging joins last to make the piece; None if it ends in other symbols."""
        parts = list(piece)
        while len(parts) > 2:
            best = max(((self.pieces[x + y][1], -k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.pieces), default=None)
            if best is None:
                return None
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _bytes(self, i: int, piece: str) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if self.model.is_unknown(i):
            return " ⁇ ".encode()
        return b"" if self.model.is_control(i) else piece.replace(MARK, " ").encode()

    def apart(self, left: str, right: str) -> bool:
        """Whether left and right stay two pieces when their text is merged: at no time is joining the symbols on
        both sides of the border better than the next merge beside it."""
        known = self.fit.get((left, right))
        if known is not None:
            return known
        x, y, on_left, on_right = left[-1], right[0], self.right.get(left, ()), self.left.get(right, ())
        i = j = 0
        out = True
        while True:
            next_left = on_left[i][0] if i < len(on_left) else float("inf")
            next_right = on_right[j][0] if j < len(on_right) else float("inf")
            joined = self.pieces.get(x + y)
            if joined and -joined[1] < next_left and -joined[1] <= next_right:
                out = False
                break
            if i == len(on_left) and j == len(on_right):
                break
            if next_left <= next_right:
                x, i = on_left[i][1], i + 1
            else:
                y, j = on_right[j][1], j + 1
        if len(self.fit) > KNOWN:
            self.fit.clear()
        self.fit[left, right] = out
        return out

    def ids(self, piece: str) -> list[int]:
        if piece in self.pieces:
            return [self.pieces[piece][0]]
        if self.byte:
            return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]


@lru_cache(4)
def _held(path: str, kind: str) -> tuple[Vocabulary, IdCache]:
    """The vocabulary of a model file and the ids of the words met, made once in each worker process."""
    voc = Vocabulary(path, kind)
    one = {p: (i,) for p, (i, _) in voc.pieces.items()}

    def learn(new: list[str]) -> list[list[int]]:
        order = sorted(range(len(new)), key=new.__getitem__)
        out: list[list[int]] = [[]] * len(new)
        for at, parts in zip(order, walk([new[k] for k in order], voc)):
            out[at] = [k for p in parts for k in (one[p] if p in one else voc.ids(p))]
        return out

    return voc, IdCache(learn, KNOWN)


def stretches(words: list[str], voc: Vocabulary) -> tuple[list[str], np.ndarray]:
    """The words cut where no piece holds the two characters side by side, and how many stretches each word has.

    No piece goes across such a place, whatever the scores, so stretches are encoded on their own and words share them.
    """
    joined = "".join(words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    pair = codes[:-1] << np.uint64(32) | codes[1:]
    found = np.minimum(np.searchsorted(voc.inner, pair), max(len(voc.inner) - 1, 0))
    cut = np.ones(len(codes), bool)
    if len(voc.inner):
        cut[1:] = voc.inner[found] != pair
    starts = np.cumsum(sizes) - sizes
    cut[starts] = True
    at = np.flatnonzero(cut)
    ends = [*at[1:].tolist(), len(joined)]
    return [joined[a:b] for a, b in zip(at.tolist(), ends)], np.diff(np.r_[np.searchsorted(at, starts), len(at)])


def walk(words: list[str], voc: Vocabulary) -> list[list[str]]:
    """The pieces of each word; words are sorted, so that walking them in order walks their trie depth-first.

    The forward state of a prefix is where its last piece starts, with its best score for a unigram model and
    with the piece itself for byte-pair merges. There a prefix has exactly one segmentation, and its last piece is
    the one that stays apart from the last piece of the prefix before it. States of the prefix shared with the
    word before are kept.
    """
    out, before = [], ""
    last, score = [""], [0.0]
    extend = _extend_merges if voc.kind == "bpe" else _extend_scores
    for word in words:
        shared = 0
        for a, b in zip(word, before):
            if a != b:
                break
            shared += 1
        del last[shared + 1 :], score[shared + 1 :]
        extend(word, shared + 1, last, score, voc)
        found, i = [], len(word)
        while i:
            piece = last[i]
            found.append(piece)
            i -= len(piece)
        found.reverse()
        out.append(found)
        before = word
    return out


def _extend_merges(word: str, begin: int, last: list[str], score: list[float], voc: Vocabulary) -> None:
    back, fit, apart = voc.back, voc.fit, voc.apart
    for i in range(begin, len(word) + 1):
        j = i - 1
        found = word[j]
        node = back.get(found)
        while j and node:
            j -= 1
            node = node.get(word[j])
            if node and "" in node:
                piece = word[j:i]
                if not j:
                    found = piece
                    break
                pair = last[j], piece
                if fit[pair] if pair in fit else apart(*pair):
                    found = piece
                    break
        last.append(found)


def _extend_scores(word: str, begin: int, last: list[str], score: list[float], voc: Vocabulary) -> None:
    pieces = voc.pieces
    for i in range(begin, len(word) + 1):
        best, at = None, i - 1
        for j in range(max(0, i - voc.longest), i):
            own = pieces.get(word[j:i])
            if own is None and j < i - 1:
                continue
            s = score[j] + (own[1] if own else voc.worst)
            if best is None or s > best:
                best, at = s, j
        last.append(word[at:i])
        score.append(best)


def _units(texts: list[str]) -> pa.ListArray:
    """The marked words of each text."""
    if any("\0" in t for t in texts):
        return pa.array([UNIT.findall(t) for t in texts], pa.list_(pa.string()))
    parted = pc.replace_substring_regex(pa.array(texts, pa.string()), f"([^{MARK}])({MARK})", "\\1\0\\2")
    cut = pc.split_pattern(parted, "\0")
    # an empty text is one empty part
    full = np.fromiter((bool(t) for t in texts), bool, len(texts))
    if full.all():
        return cut
    sizes = np.where(full, pc.list_value_length(cut).to_numpy(), 0)
    words = cut.flatten()
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype("int32")), words.filter(pc.not_equal(words, "")))


def _in_groups(batch: pa.RecordBatch, size: np.ndarray, most: int):
    """Slices of the batch of about most bytes, so that very long rows don't meet in memory."""
    group = np.cumsum(size) // most
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        yield batch.slice(at[0], len(at))


def _encoded(texts: pa.Array, voc: Vocabulary, known: IdCache) -> pa.ListArray:
    units = _units([voc.model.normalize(t) if t else "" for t in texts.to_pylist()])
    coded = units.flatten().dictionary_encode()
    parts, count = stretches(coded.dictionary.to_pylist(), voc) if len(coded) else ([], np.zeros(0, np.int64))
    distinct = dict.fromkeys(parts)
    place = dict(zip(distinct, known.codes(list(distinct)).tolist()))
    of_part = np.fromiter((place[x] for x in parts), np.int64, len(parts))
    after = np.r_[0, np.cumsum(count)]
    starts, sizes = after[:-1], count
    stretch, ends = spread(of_part, starts, sizes, coded.indices.to_numpy())
    ids, id_ends = known.lists(stretch)
    rows = id_ends[ends[units.offsets.to_numpy().astype(np.int64) - units.offsets[0].as_py()]]
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids, pa.int32()))


def encode(df: DataFrame, model: str, kind: str = "bpe", text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns of df with ids, the piece ids of the text, and, where it is named, decoded, the text of these ids.

    Each task takes its rows' distinct marked words (a run of word marks with what follows it; no piece of the
    vocabulary goes across them), cuts them where no piece can go across, sorts what is new and walks it as a trie; no
    shuffle. A group of about two megabytes of texts is held at once, known words up to a bound. Texts are normalised
    by the model, which marks spaces. Characters outside the vocabulary become bytes or, without byte pieces, the
    unknown id.

    Null and empty texts give an empty list and decode to an empty text. Columns of df named as ids or decoded are
    replaced. An empty table gives an empty one; repeated rows are encoded each.
    """
    out = [ids] if decoded is None else [ids, decoded]
    rest = [c for c in df.columns if c not in out]
    at_text = rest.index(text)

    def run(batches):
        voc, known = _held(model, kind)
        pieces = pa.array(voc.out, pa.binary())
        for whole in batches:
            for batch in _in_groups(whole, pc.fill_null(pc.binary_length(whole.column(at_text)), 0).to_numpy(), 2 << 20):
                lists = _encoded(batch.column(at_text), voc, known)
                made = [lists] if decoded is None else [lists, texts_of(lists, voc, pieces)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*rest, *out])

    kinds = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded or "", T.StringType())]
    return mapped(df, rest, released(run), kinds[: len(out)])


def texts_of(lists: pa.ListArray, voc: Vocabulary, pieces: pa.Array) -> pa.Array:
    """Texts of lists of ids. The pieces of all lists lie one after another in memory, so a text is a span of them."""
    ids = lists.flatten()
    if len(ids) and (pc.min(ids).as_py() or 0) < 0:
        raise IndexError("an id is below 0")
    at = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]
    if not ids.null_count:
        joined = pieces.take(ids)
        span = np.frombuffer(joined.buffers()[1], np.int32)[at] if len(ids) else np.zeros(len(at), np.int32)
        data = joined.buffers()[2] if len(ids) else None
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        # cut spans apart where the first byte is the space put before the text
        skip = np.zeros(len(at) - 1, bool)
        some = span[1:] > span[:-1]
        skip[some] = raw[span[:-1][some]] == 32
        body = np.ones(int(span[-1]), bool)
        body[span[:-1][skip]] = False
        starts = (span - np.r_[0, np.cumsum(skip)]).astype(np.int32)
        out = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(starts), pa.py_buffer(raw[: len(body)][body])])
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            pass  # bytes that form no character
    texts = [b"".join([voc.out[i] for i in x or () if i is not None]).decode("utf-8", "replace").removeprefix(" ") for x in lists.to_pylist()]
    return pa.array(texts, pa.string())


def decode(df: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of df with decoded, the text of the ids.

    Marks become spaces, the one that encoding puts before the text goes, bytes join to characters (U+FFFD where
    they form none), control ids vanish. A null list gives an empty text; null ids in it are left out and ids
    outside the vocabulary raise an error. A column of df with the name of decoded is replaced.
    """
    rest = [c for c in df.columns if c != decoded]
    at_ids = rest.index(ids)

    def run(batches):
        voc, _ = _held(model, "bpe")
        pieces = pa.array(voc.out, pa.binary())
        for whole in batches:
            for batch in _in_groups(whole, pc.fill_null(pc.list_value_length(whole.column(at_ids)), 0).to_numpy() * 4, 2 << 20):
                yield pa.RecordBatch.from_arrays([*batch.columns, texts_of(batch.column(at_ids), voc, pieces)], [*rest, decoded])

    return mapped(df, rest, released(run), [T.StructField(decoded, T.StringType())])

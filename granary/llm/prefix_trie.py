"""Prefix trie of conversations: union-find over the common-prefix lengths of sorted neighbours, deepest first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import dropped, quoted, stored
from granary.llm.words import released

#: Bytes of a turn's digest, and bytes of sequences that one task's forest holds.
DIGEST, PART_BYTES = 16, 8 << 20
#: Members in one row of a joined list of them.
CHUNK_IDS = 1 << 15


def sequences(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv and its turns in order (null turn numbers first) as an array of (turn, digest, words); null role or text is empty.

    digest is the MD5 of role and text, in hexadecimal; words counts what white space separates. Turns of one number are
    ordered by digest, repeated rows are turns of their own. Rows whose conv is null belong to no conversation and take no
    part. Other columns are left out whatever their names. A conversation's array holds some 50 bytes a turn, whatever its texts.
    """
    who, what = F.coalesce(quoted(role), F.lit("")), F.coalesce(quoted(text), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary"))
    one = F.struct(quoted(turn).alias("turn"), digest.alias("digest"), F.regexp_count(what, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    kept = df.filter(quoted(conv).isNotNull()).select(quoted(conv).alias("conv"), one.alias("one"))
    return kept.groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def rebuilt(seqs: DataFrame, every: int = 20, spread: int = 4) -> DataFrame:
    """Conversations whose first h turns are those of the first of their block of `every`; h = crc32(conv) modulo spread.

    A block's first conversation that has fewer turns gives all it has, one that is absent gives none.
    """
    most = spread - 1
    heads = seqs.filter(F.col("conv") % every == 0).select(F.col("conv").alias("of"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % spread).cast("int")
    own = seqs.select("conv", "turns", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("of"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return own.join(heads, "of", "left").select("conv", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences of digests share at their beginning."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * DIGEST] == b[: mid * DIGEST] else (low, mid - 1)
    return low


#: What a task says of a node. Nodes on the path of the task's first or last sequence are open: other tasks may have members
#: of theirs, and n_children, n_leaves and saved count only what hangs on them away from those paths.
NODE = (
    "open boolean, first boolean, last boolean, node string, above string, above_conv long, depth int, conv long, n_convs long, "
    "n_children long, n_leaves long, saved long, words long"
)


class _Forest:
    """The trie of sorted distinct sequences: a component's top is the node that is not finished yet."""

    def __init__(self, seqs: list[bytes], counts: list[int], least: list[int], words: list[list[int]]):
        n = len(seqs)
        self.seqs, self.words, self.rows = seqs, words, []
        self.of = list(range(n))
        self.top = [len(s) // DIGEST for s in seqs]
        self.n, self.least = list(counts), list(least)
        self.children, self.leaves, self.saved = [0] * n, [0] * n, [0] * n
        self.ends = [True] * n  # a sequence ends at the top
        self.first, self.last = [k == 0 for k in range(n)], [k == n - 1 for k in range(n)]
        self.hung: list[list[int]] = [[] for _ in range(n)]  # rows of finished children of the top
        self.low = list(range(n))  # the component's smallest sequence: the one that can end at its top
        self.keys = [self._keys(seqs[0]), self._keys(seqs[-1])]

    @staticmethod
    def _keys(s: bytes) -> list[str]:
        h, out = hashlib.md5(), []
        out.append(h.hexdigest())
        for k in range(0, len(s), DIGEST):
            h.update(s[k : k + DIGEST])
            out.append(h.hexdigest())
        return out

    def find(self, k: int) -> int:
        while self.of[k] != k:
            self.of[k] = self.of[self.of[k]]
            k = self.of[k]
        return k

    def _finish(self, c: int, depth: int) -> None:
        """Rows of the component's nodes from its top up to below depth; the component then hangs below depth."""
        is_open = self.first[c] or self.last[c]
        keys = self.keys[0] if self.first[c] else self.keys[1]
        words, n, least = self.words[self.low[c]], self.n[c], self.least[c]
        for d in range(self.top[c], depth, -1):
            w = words[d - 1] if d else 0
            key = keys[d] if is_open else hashlib.md5(self.seqs[self.low[c]]).hexdigest() if self.ends[c] else None
            if not is_open:
                self.leaves[c] = self.leaves[c] or 1
                self.saved[c] += (n - 1) * w
            for r in self.hung[c]:
                self.rows[r][4:6] = [key, None] if is_open else [None, least]
            here = len(self.rows)
            above = keys[d - 1] if is_open and d else None
            self.rows.append([is_open, self.first[c], self.last[c], key, above, None, d, least, n, self.children[c], self.leaves[c], self.saved[c], w])
            # on an open path what hangs on a node counts there alone; the paths are added up where the tasks' forests meet
            self.hung[c], self.children[c] = ([], 0) if is_open else ([here], 1)
            if is_open:
                self.leaves[c] = self.saved[c] = 0
            self.ends[c] = False
        self.top[c] = min(self.top[c], depth)

    def join(self, k: int, depth: int) -> None:
        """The components of sequences k and k + 1 have depth turns in common: they meet in one node there."""
        a, b = self.find(k), self.find(k + 1)
        for c in (a, b):
            if self.top[c] > depth:
                self._finish(c, depth)
        if len(self.hung[a]) < len(self.hung[b]):
            a, b = b, a
        self.of[b] = a
        self.low[a] = min(self.low[a], self.low[b])
        self.hung[a] += self.hung[b]
        self.hung[b] = []
        self.least[a] = min(self.least[a], self.least[b])
        for x in (self.n, self.children, self.leaves, self.saved):
            x[a] += x[b]
        for x in (self.ends, self.first, self.last):
            x[a] = x[a] or x[b]

    def nodes(self) -> list[list]:
        edges = [(common(a, b), k) for k, (a, b) in enumerate(zip(self.seqs, self.seqs[1:]))]
        for depth, k in sorted(edges, key=lambda e: -e[0]):
            self.join(k, depth)
        self._finish(self.find(0), -1)
        return self.rows


def _nodes_of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if part is None or not part.num_rows:
        return
    rows = _Forest(*(part[c].to_pylist() for c in ("s", "n", "least", "words"))).nodes()
    kinds = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in NODE.split(", "))])
    for at in range(0, len(rows), 1 << 15):
        columns = zip(*rows[at : at + (1 << 15)])
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def trie(seqs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Nodes of the prefix trie of sequences(): node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.

    A node is a distinct sequence of first turns, the root that of none. conv_id is its smallest member (its text: the
    depth-th turn of that conversation), n_leaves counts the childless nodes of its subtree and saved_tokens adds up, over the
    subtree, the words of a node's last turn times its members but one. node is an id where a sequence ends, for members(),
    else it may be null.

    Equal sequences fold to one with a count. They are sorted and cut into ranges of bounded size; a task links
    neighbours at the number of turns they share and joins components from the deepest link up, each merge making a branching
    node. Nodes that hold a range's first or last sequence may go on in other ranges: of a task's forest only these paths are
    left to merge, by their key, and sums below them run along the paths. No conversations give no node.
    """
    s = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    words = F.transform("turns", lambda t: t["words"])
    flat = seqs.select("conv", s.alias("s"), words.alias("words"))
    folded = stored(flat.groupBy("s").agg(F.count("*").alias("n"), F.min("conv").alias("least"), F.min("words").alias("words")), "sequences")
    size = folded.agg(F.sum(F.octet_length("s") * 2 + 64)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    dealt = folded.repartitionByRange(parts, "s").sortWithinPartitions("s")
    made = stored(dealt.mapInArrow(released(_nodes_of_part), NODE).withColumn("part", F.spark_partition_id()), "nodes")
    dropped(folded)

    some = made.filter("open")
    met = some.groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("depth", "above", "words")],
        F.min("conv").alias("conv"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    met = stored(met, "met")
    below = met.groupBy(F.col("above").alias("node")).agg(F.count("*").alias("open_children"))
    total = F.col("n_children") + F.coalesce("open_children", F.lit(0))
    whole = met.join(below, "node", "left").withColumns(
        {
            "n_children": total,
            "own_leaves": F.when(total == 0, 1).otherwise(F.col("n_leaves")),
            "own_saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("words"),
        }
    )
    # every open node counts on one of the paths that hold it; a path's sums from the bottom up, added over a node's paths
    sides = F.array(*[F.when(F.col(c), F.col("part").cast("long") * 2 + k) for k, c in enumerate(("first", "last"))])
    paths = some.select("node", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("path"))
    own = paths.groupBy("node").agg(F.min("path").alias("own"))
    on = paths.join(own, "node").join(whole.select("node", "depth", "own_leaves", "own_saved"), "node")
    up = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = on.select("node", *[F.sum(F.when(F.col("path") == F.col("own"), F.col(c)).otherwise(0)).over(up).alias(c) for c in ("own_leaves", "own_saved")])
    summed = summed.groupBy("node").agg(F.sum("own_leaves").alias("n_leaves"), F.sum("own_saved").alias("saved"))
    opened = stored(whole.drop("n_leaves", "saved").join(summed, "node"), "opened")
    parents = opened.select(F.col("node").alias("above"), F.col("conv").alias("opened_conv"))
    columns = ["node", "above", "above_conv", "depth", "conv", "n_convs", "n_children", "n_leaves", "saved"]
    rest = made.filter("not open").select(columns)
    full = rest.unionByName(opened.withColumn("above_conv", F.lit(None).cast("long")).select(columns))
    hung = full.filter("above is not null").join(parents, "above").withColumn("above_conv", F.col("opened_conv")).select(columns)
    out = hung.unionByName(full.filter("above is null"))
    return out.select(
        "node",
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("above_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
    )


def members(seqs: DataFrame) -> DataFrame:
    """(node, conv): the node at which each conversation ends, with trie()'s id."""
    return seqs.select(F.md5(F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))).alias("node"), "conv")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a node's members, in order, as one text each of at most CHUNK_IDS members."""
    node, ids = None, []

    def run() -> pa.RecordBatch:
        return pa.record_batch([[node], pa.array([ids[0]], pa.int64()), [",".join(map(str, ids))]], ["node", "least", "ids"])

    for b in batches:
        for key, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if ids and (key != node or len(ids) >= CHUNK_IDS):
                yield run()
                ids = []
            node = key
            ids.append(i)
    if ids:
        yield run()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each node's runs in turn: one state at a time, whatever the number of members."""
    node, h, keys, out = None, None, [], []
    for b in batches:
        for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if key == node:
                h.update(b",")
            else:
                if h:
                    keys.append(node)
                    out.append(h.hexdigest())
                node, h = key, hashlib.sha256()
            h.update(ids.encode())
        if keys:
            yield pa.record_batch([pa.array(keys), pa.array(out)], ["node", "sha256"])
            keys, out = [], []
    if h:
        yield pa.record_batch([pa.array([node]), pa.array([h.hexdigest()])], ["node", "sha256"])


def member_digests(ends: DataFrame) -> DataFrame:
    """(node, sha256) of the comma-joined ascending members of each node of members().

    Members are sorted over ranges of (node, conv), so that those of one node may lie in many tasks, and joined there to
    runs of text. A digest has to read a node's runs one after another: it streams over them, run by run.
    """
    runs = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_joined, "node string, least long, ids string")
    in_turn = runs.repartition("node").sortWithinPartitions("node", "least").select("node", "ids")
    return in_turn.mapInArrow(_digested, "node string, sha256 string")


def empty_digest() -> Column:
    return F.lit(hashlib.sha256(b"").hexdigest())

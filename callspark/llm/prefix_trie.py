"""The trie of conversations that begin with the same turns: members, children, leaves and what shared prefixes save.

Method. Distinct conversations are sorted as sequences of turn digests, and of each two neighbours the number of
turns that they share is taken (LCP). Every candidate prefix, a conversation and a depth that its predecessor doesn't
share, then finds the left and the right end of its members by itself: a binary search on a sparse table of range minima
over the LCPs, without a stack and without an order among the candidates. Members, leaves and savings are differences of
running sums between both ends, the smallest member a range minimum; a parent is the leftmost member one turn up.

Scale. Equal conversations are one row, with a count, before anything is sorted. A prefix with more than ``limit``
distinct conversations below it is heavy: it is no task of its own, but divided among its continuations, and again
while those are heavy; what heavy prefixes have below them is summed by Spark. All lighter subtrees are whole in one of
``bins`` tasks. Conversation ids that end at a node are written in ranges of ids, chunk by chunk, and only the chunks
of a node meet to be hashed. There are as many rounds as the deepest heavy prefix has turns. A conversation itself is one row (16 bytes
a turn), as a document is.

Cases: rows without conv_id belong to no conversation and go. A null role or text is empty. Turns of one number are
ordered by role, then text; repeated rows are turns of their own. A conversation that has no turns ends at the root. Texts of any length
are used through their digests (the first 16 bytes of SHA-256). An empty table gives no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callspark.llm.ordering import numbered, runs
from callspark.llm.staging import Stage

#: Bytes of a turn's digest.
UNIT = 16
#: Distinct conversations that a task of the trie should have at most.
BIN = 50_000
#: Turns that a rebuilt conversation takes from its base at most, plus one.
HEADS = 9
NOTHING = hashlib.sha256(b"").hexdigest()

_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, seq binary, ended boolean"


def ordered_turns(stage: Stage, turns: DataFrame) -> DataFrame:
    """(conv_id, at, turn_key, size): each turn's place in its conversation, digest, and UTF-8 bytes of text."""
    said = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("key"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 2 * UNIT))
    # the order of tied turns is that of their role and text, so these stay until the turns are numbered
    return numbered(stage, said, ["turn", "role", "text"], "turns").select(F.col("key").alias("conv_id"), "at", digest.alias("turn_key"), F.octet_length("text").cast("long").alias("size"))


def rebuilt_conversations(stage: Stage, turns: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes): the first h turns of conversation c - c % 5, then c's own after its first h; h = crc32(c) % 9."""
    own = stage.write(ordered_turns(stage, turns), "ordered")
    convs = own.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    convs = convs.select("conv_id", "h", F.expr("conv_id - conv_id % 5").alias("base"))
    first = own.where(F.col("at") < HEADS - 1).select(F.col("conv_id").alias("base"), "at", "turn_key", "size")
    taken = convs.hint("merge").join(first, "base").where(F.col("at") < F.col("h")).select("conv_id", "at", "turn_key", "size")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    rest = own.where(F.col("at") >= h)
    each = taken.unionByName(rest).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "turn_key", "size"))).alias("turns"))
    each = convs.select("conv_id").unionByName(each, allowMissingColumns=True).groupBy("conv_id").agg(F.first("turns", ignorenulls=True).alias("turns"))
    keys = F.transform(F.coalesce("turns", F.array().cast(each.schema["turns"].dataType)), lambda t: F.hex(t["turn_key"]))
    sizes = F.transform(F.coalesce("turns", F.array().cast(each.schema["turns"].dataType)), lambda t: t["size"])
    return each.select("conv_id", F.unhex(F.array_join(keys, "")).alias("seq"), sizes.alias("sizes"))


def _prefix(depth) -> Column:
    """The first turns of a sequence."""
    return F.expr(f"substring(seq, 1, {UNIT} * {depth})")


class SortedTrie:
    """Sorted distinct sequences with the LCP (in turns) of each and the one before it."""

    def __init__(self, seqs: list[bytes]):
        self.n = len(seqs)
        self.lengths = np.array([len(s) // UNIT for s in seqs], dtype=np.int64)
        data = np.frombuffer(b"".join(seqs), dtype=np.uint64).reshape(-1, UNIT // 8)
        starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.lcp = np.zeros(self.n, dtype=np.int64)
        alive = np.arange(1, self.n)
        while len(alive):
            d = self.lcp[alive]
            alive = alive[(d < self.lengths[alive]) & (d < self.lengths[alive - 1])]
            d = self.lcp[alive]
            alive = alive[(data[starts[alive] + d] == data[starts[alive - 1] + d]).all(axis=1)]
            self.lcp[alive] += 1
        self.minima = self._table(self.lcp)

    @staticmethod
    def _table(values: np.ndarray) -> list[np.ndarray]:
        """Row k: minima of 2^k values from each place."""
        rows, k = [values], 1
        while 2 * k <= len(values):
            rows.append(np.minimum(rows[-1][:-k], rows[-1][k:]))
            k *= 2
        return rows

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The smallest l with LCPs of at least ``depth`` at l + 1 .. at."""
        at = at.copy()
        for k in reversed(range(len(self.minima))):
            row, step = self.minima[k], 1 << k
            begin = at - step + 1
            can = begin >= 1
            can[can] = row[begin[can]] >= depth[can]
            at[can] -= step
        return at

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The largest r with LCPs of at least ``depth`` at ``at + 1`` .. r."""
        at = at.copy()
        for k in reversed(range(len(self.minima))):
            row = self.minima[k]
            can = at + 1 < len(row)
            can[can] = row[at[can] + 1] >= depth[can]
            at[can] += 1 << k
        return at

    @classmethod
    def smallest(cls, values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minimum of values[l..r] for each pair of ends."""
        rows = cls._table(values)
        level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        out = np.empty(len(left), dtype=values.dtype)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(rows[k][left[own]], rows[k][right[own] - (1 << int(k)) + 1])
        return out


def _nodes_of(table: pa.Table) -> pa.RecordBatch:
    """The nodes of all subtrees in a bin: (seq, sizes, n, conv_id, cut), each sequence distinct; depths of ``cut`` and more."""
    table = table.take(pc.sort_indices(table["seq"])).combine_chunks()
    seqs = table["seq"].to_pylist()
    trie = SortedTrie(seqs)
    n, conv, cut = (table[c].to_numpy() for c in ("n", "conv_id", "cut"))
    first_depth = np.maximum(trie.lcp + 1, cut)
    fresh = np.maximum(trie.lengths - first_depth + 1, 0)
    at = np.repeat(np.arange(trie.n), fresh)
    depth = np.arange(len(at)) - np.repeat(np.cumsum(fresh) - fresh, fresh) + first_depth[at]
    left, right = trie.left(at, depth), trie.right(at, depth)
    below = np.concatenate([[0], np.cumsum(n)])
    members = below[right + 1] - below[left]
    sizes = np.concatenate([np.array(x, dtype=np.int64) for x in table["sizes"].to_pylist()])
    starts = np.concatenate([[0], np.cumsum(trie.lengths)])[:-1]
    own = (members - 1) * sizes[starts[at] + depth - 1]
    leaves = np.concatenate([[0], np.cumsum(np.append(trie.lcp[1:], 0) < trie.lengths)])  # the next sequence doesn't go on from a leaf
    saved = np.concatenate([[0], np.cumsum(own)])
    begin = np.concatenate([[0], np.cumsum(fresh)])
    node = np.arange(len(at))
    parent_at = trie.left(at, depth - 1)
    parent = begin[parent_at] + depth - 1 - first_depth[parent_at]
    inner = depth > cut[at]
    children = np.bincount(parent[inner], minlength=len(at))
    smallest = trie.smallest(conv, left, right)
    ended = depth == trie.lengths[at]
    keep = (depth == cut[at]) | ended
    data = [
        pa.array(smallest),
        pa.array(depth),
        pa.array(smallest[np.where(inner, parent, 0)], mask=~inner),
        pa.array(members),
        pa.array(children),
        pa.array(leaves[right + 1] - leaves[left]),
        pa.array(saved[begin[right + 1]] - saved[node]),
        pa.array([seqs[i][: UNIT * d] if k else None for i, d, k in zip(at.tolist(), depth.tolist(), keep.tolist())], pa.binary()),
        pa.array(ended),
    ]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "seq", "ended"]
    return pa.RecordBatch.from_arrays(data, names=names)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs(batches, ["bin"]):
        yield _nodes_of(run)


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks of ids, joined with commas; a node's chunks come in order."""
    node, state = None, None
    out: list[tuple] = []
    for batch in batches:
        for seq, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if seq != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = seq, hashlib.sha256(text.encode())
            else:
                state.update(f",{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], names=["seq", "ends"])
            out = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["seq", "ends"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node within a batch of a sorted range, as one text with the first id."""
    for batch in batches:
        found = [(run["seq"][0].as_py(), run["conv_id"].to_pylist()) for run in runs(iter([batch]), ["seq"])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([seq for seq, _ in found], pa.binary()), pa.array([ids[0] for _, ids in found], pa.int64()), pa.array([",".join(map(str, ids)) for _, ids in found], pa.string())], names=["seq", "first", "ids"]
        )


def _ends(stage: Stage, convs: DataFrame) -> DataFrame:
    """(seq, ends): of each sequence the hash of the ids of the conversations that are it, ascending."""
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = convs.select("seq", "conv_id").repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    chunks = stage.write(ranged.mapInArrow(_chunks, "seq binary, first long, ids string"), "chunks")
    return chunks.repartition("seq").sortWithinPartitions("seq", "first").select("seq", "ids").mapInArrow(_hash_chunks, "seq binary, ends string")


def prefix_trie(convs: DataFrame, bin_size: int = BIN) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, seq, sizes): a row per distinct prefix, the root's included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    """
    stage, spark = Stage(convs.sparkSession, "trie"), convs.sparkSession
    convs = stage.write(convs, "convs")
    distinct = convs.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("sizes").alias("sizes"))
    distinct = stage.write(distinct, "distinct")
    total = stage.rows(distinct)
    bins = max(-(-2 * total // bin_size), min(-(-total // 64), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    limit = max(32, total // (4 * bins))
    length = F.expr(f"octet_length(seq) div {UNIT}")

    # the root is heavy; the continuations of heavy prefixes are, while they have more than the limit below them
    open_, light, heavy = distinct, None, []
    depth = 0
    while True:
        depth += 1
        over = open_.where(length >= depth).groupBy(_prefix(depth).alias("prefix")).count().where(F.col("count") > limit).select("prefix")
        over = stage.write(over, f"heavy-{depth}")
        rows = open_.where(length >= depth).withColumn("cut", F.lit(depth).cast("long"))
        if not stage.rows(over):
            light = rows if light is None else light.unionByName(rows)
            break
        same = _prefix(depth) == F.col("prefix")
        settled = rows.join(stage.side(over), same, "left_anti")
        light = settled if light is None else light.unionByName(settled)
        open_ = stage.write(open_.where(length >= depth).join(stage.side(over), same, "left_semi"), f"open-{depth}")
        heavy.append(open_)

    bin_ = F.expr(f"pmod(xxhash64(substring(seq, 1, {UNIT} * cast(cut as int))), {bins})")
    rows = light.select("seq", "sizes", "n", "conv_id", "cut", bin_.alias("bin")).repartition(bins, "bin").sortWithinPartitions("bin")
    nodes = stage.write(rows.mapInArrow(_grow, _NODES), "nodes")

    # heavy prefixes, from the root on: sums over the subtrees that hang below them
    heads = [distinct.withColumn("d", F.lit(0)), *(t.withColumn("d", F.lit(k + 1)) for k, t in enumerate(heavy))]
    tops = None
    for table, d in zip(heads, range(len(heads))):
        found = table.groupBy(_prefix(d).alias("prefix")).agg(
            F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max(F.element_at("sizes", d) if d else F.lit(0)).cast("long").alias("size"), F.bool_or(length == d).alias("ended")
        ).withColumn("depth", F.lit(d).cast("long"))
        tops = found if tops is None else tops.unionByName(found)
    tops = stage.write(tops, "tops")
    roots = nodes.where("parent_conv_id IS NULL").select("depth", "seq", "n_leaves", "saved_tokens")
    own = tops.where("depth > 0").select("depth", F.col("prefix").alias("seq"), F.lit(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    below = None
    for d in range(len(heads)):
        deeper = roots.where(F.col("depth") > d).withColumn("child", (F.col("depth") == d + 1).cast("long"))
        deeper = deeper.unionByName(own.where(F.col("depth") >= max(d, 1)).withColumn("child", (F.col("depth") == d + 1).cast("long")))
        found = deeper.groupBy(_prefix(d).alias("_prefix")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.sum("child").alias("n_children")).withColumn("_depth", F.lit(d).cast("long"))
        below = found if below is None else below.unionByName(found)
    same = (F.col("depth") == F.col("_depth")) & (F.col("prefix") == F.col("_prefix"))
    full = tops.join(below.hint("merge"), same, "left").select(
        "conv_id", "depth", F.col("prefix").alias("seq"), "n_convs", "ended", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_children", "saved_tokens")), F.when(F.coalesce("n_children", F.lit(0)) == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves")
    )
    full = stage.write(full, "full")
    # of heavy nodes and of the tops of lighter subtrees, the parent is the heavy prefix one turn up
    up = full.select(F.col("seq").alias("_up"), F.col("conv_id").alias("_parent"))
    lifted = full.withColumn("parent_conv_id", F.lit(None).cast("long")).unionByName(nodes.where("parent_conv_id IS NULL"))
    lifted = lifted.join(stage.side(full, up), (F.col("depth") > 0) & (_prefix("cast(depth - 1 as int)") == F.col("_up")), "left").withColumn("parent_conv_id", F.col("_parent"))
    out = lifted.select(*nodes.columns).unionByName(nodes.where("parent_conv_id IS NOT NULL"))
    ends = stage.write(_ends(stage, convs), "ends").select(F.col("seq").alias("_seq"), "ends")
    with_ends = out.where("ended").join(ends.hint("merge"), F.col("seq") == F.col("_seq"), "left").drop("_seq")
    out = with_ends.unionByName(out.where("not ended").withColumn("ends", F.lit(None).cast("string")))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, **options) -> DataFrame:
    """``prefix_trie`` of the conversations that ``rebuilt_conversations`` makes of ``turns``."""
    return prefix_trie(rebuilt_conversations(Stage(turns.sparkSession, "rebuilt"), turns), **options)

"""A manifest of a data set as a Merkle tree: a digest a row, a subtree a source, one root, and a proof for every row.

Method. Every parent hashes the hexadecimal digests of up to three children. While a subtree is built, each parent
keeps a copy of its SHA-256 state before each child's slot. Folding a row whose leaf may have changed resumes the
state before its slot with the new digest and the right siblings only; what stands left of it is not hashed again.

Scale. Leaves are numbered within their source by ranges (``ordering.numbered``), so a source with a third of all
rows is no task of its own. Runs of 3^7 consecutive nodes form blocks, each a task's work of bounded size; a
block's digest is a node of the next tier, until a source has one block. Paths go down again tier by tier: a block
gets one header row with its path to the root, and keeps the states of that path's parents for all its leaves.
No digest goes through the driver; tiers are written in the shared folder.

Cases: a null field counts as ``-``. Rows that repeat a doc_id are leaves in the order of their digests, so equal
rows are interchangeable; null doc_ids come first, a null source is a source of its own, before the others. An empty
or very long text is hashed as it is, in the JVM. A single leaf is its source's subroot, a single subroot the root,
and a row without siblings has the hash of nothing as its proof. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callspark.llm.ordering import numbered, runs
from callspark.llm.staging import Stage

ARITY = 3
#: Levels of one block; a block has ARITY ** LEVELS nodes at most.
LEVELS = 7


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Subtree:
    """The nodes of one block, level by level, and of each parent the hash states before its children's slots.

    Rises until one node is left, or by exactly ``levels`` if the block is a part of a larger tree.
    """

    def __init__(self, digests: list[str], levels: int | None = None):
        self.levels, self.states = [digests], []
        while len(self.levels[-1]) > 1 if levels is None else len(self.levels) <= levels:
            row, above, states = self.levels[-1], [], []
            for first in range(0, len(row), ARITY):
                state = hashlib.sha256()
                for digest in row[first : first + ARITY]:
                    states.append(state.copy())
                    state.update(digest.encode())
                above.append(state.hexdigest())
            self.levels.append(above)
            self.states.append(states)

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """What stands left and right of the node in its run, level by level."""
        out = []
        for row in self.levels[:-1]:
            first = at - at % ARITY
            out.append(("".join(row[first:at]), "".join(row[at + 1 : first + ARITY])))
            at //= ARITY
        return out

    def fold(self, at: int, digest: str) -> str:
        """The top if the node at ``at`` were ``digest``: resumed from the states before its slots."""
        for row, states in zip(self.levels, self.states):
            state = states[at].copy()
            state.update("".join([digest, *row[at + 1 : at - at % ARITY + ARITY]]).encode())
            digest, at = state.hexdigest(), at // ARITY
        return digest


class UpperPath:
    """The way from a block's top to the root: a state before the slot and the right siblings of each level."""

    def __init__(self, path: str):
        self.steps = [tuple(step.split("|")) for step in path.split(",")] if path else []
        self.states = [hashlib.sha256(left.encode()) for left, _ in self.steps]
        self.proof = "".join(left + right for left, right in self.steps).encode()

    def fold(self, digest: str) -> str:
        for state, (_, right) in zip(self.states, self.steps):
            state = state.copy()
            state.update((digest + right).encode())
            digest = state.hexdigest()
        return digest


def _written(steps: list[tuple[str, str]]) -> str:
    return ",".join(f"{left}|{right}" for left, right in steps)


def _tops(levels: int):
    """Of each block its top if it is the whole tree of its key, and its top as a part of a larger tree."""

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for run in runs(batches, ["key", "block"]):
            digests = run["digest"].to_pylist()
            rows.append((run["key"][0].as_py(), run["block"][0].as_py(), Subtree(digests).top, Subtree(digests, levels).top))
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return run_all


_TOPS = pa.schema([("key", pa.string()), ("block", pa.int64()), ("whole", pa.string()), ("part", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema = _TOPS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), schema)], schema=schema)


_DOWN = pa.schema([("key", pa.string()), ("block", pa.int64()), ("path", pa.string()), ("subroot", pa.string()), ("root", pa.string())])


def _open(run: pa.Table, levels: int) -> tuple[dict, list[dict], Subtree]:
    """A block's header, its nodes in order, and its subtree."""
    header, *nodes = run.to_pylist()
    digests = [n["digest"] for n in nodes]
    return header, nodes, Subtree(digests, None if header["digest"] == "whole" else levels)


def _lower(levels: int):
    """For each node of a block the path to the root, as the header of the block below it."""

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["key", "block"]):
            header, nodes, tree = _open(run, levels)
            upper = [header["path"]] if header["path"] else []
            out = []
            for k, node in enumerate(nodes):
                own = _written(tree.siblings(k))
                out.append((node["key"], node["at"], ",".join([*([own] if own else []), *upper]), header["subroot"], header["root"]))
            if out:
                yield _batch(out, _DOWN)

    return run_all


_PROOF = pa.schema([(n, pa.string()) for n in ("source", "leaf", "subroot", "root", "proof_sha256", "folded_root")])
_PROOF = _PROOF.insert(0, pa.field("doc_id", pa.int64()))


def _prove(levels: int):
    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["key", "block"]):
            header, nodes, tree = _open(run, levels)
            upper, out = UpperPath(header["path"]), []
            for k, node in enumerate(nodes):
                proof = hashlib.sha256("".join(left + right for left, right in tree.siblings(k)).encode())
                proof.update(upper.proof)
                folded = upper.fold(tree.fold(k, node["forged"]))
                out.append((node["doc_id"], node["key"], node["digest"], header["subroot"], header["root"], proof.hexdigest(), folded))
            if out:
                yield _batch(out, _PROOF)

    return run_all


def _in_blocks(df: DataFrame) -> DataFrame:
    """Rows of a block together, in order, each block in one partition."""
    return df.repartition("key", "block").sortWithinPartitions(F.col("key").asc_nulls_first(), "block", "at")


def _block(levels: int) -> Column:
    return F.expr(f"at div {ARITY**levels}")


def _rise(stage: Stage, nodes: DataFrame, label: str, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of nodes of all keys' trees, (key, at, digest) each, and the tops (key, tier, digest)."""
    tiers, tops = [nodes], None
    while True:
        blocks = _in_blocks(tiers[-1].select("key", _block(levels).alias("block"), "at", "digest")).mapInArrow(_tops(levels), "key string, block long, whole string, part string")
        blocks = stage.write(blocks, f"{label}-{len(tiers)}")
        several = blocks.where("block = 1").select(F.col("key").alias("_key"))
        same = F.col("key").eqNullSafe(F.col("_key"))
        several = stage.write(several, f"{label}-more")
        alone = blocks.join(stage.side(several), same, "left_anti").select("key", F.lit(len(tiers) - 1).alias("tier"), F.col("whole").alias("digest"))
        tops = alone if tops is None else tops.unionByName(alone)
        if not stage.rows(several):
            return tiers, stage.write(tops, f"{label}-tops")
        above = blocks.join(stage.side(several), same, "left_semi")
        tiers.append(stage.write(above.select("key", F.col("block").alias("at"), F.col("part").alias("digest")), f"{label}-nodes"))


def _with_headers(nodes: DataFrame, headers: DataFrame, levels: int) -> DataFrame:
    """Nodes (key, at, digest, forged, doc_id) in blocks, each block after its header row."""
    none = F.lit(None).cast("string")
    nodes = nodes.select("key", _block(levels).alias("block"), "at", "digest", "forged", "doc_id", none.alias("path"), none.alias("subroot"), none.alias("root"))
    kind = F.when(F.col("whole"), "whole").otherwise("part")
    heads = headers.select("key", "block", F.lit(-1).cast("long").alias("at"), kind.alias("digest"), none.alias("forged"), F.lit(None).cast("long").alias("doc_id"), "path", "subroot", "root")
    return _in_blocks(nodes.unionByName(heads))


def _descend(stage: Stage, tiers: list[DataFrame], tops: DataFrame, label: str, levels: int) -> DataFrame:
    """Headers of the first tier's blocks; ``tops`` has (key, tier, path, subroot, root) of each key's top."""
    headers = None
    for tier in reversed(range(len(tiers))):
        own = tops.where(F.col("tier") == tier).select("key", F.lit(0).cast("long").alias("block"), "path", "subroot", "root", F.lit(True).alias("whole"))
        headers = own if headers is None else headers.withColumn("whole", F.lit(False)).unionByName(own)
        if tier:
            nodes = tiers[tier].select("key", "at", "digest", F.lit(None).cast("string").alias("forged"), F.lit(None).cast("long").alias("doc_id"))
            down = _with_headers(nodes, headers, levels).mapInArrow(_lower(levels), "key string, block long, path string, subroot string, root string")
            headers = stage.write(down, f"{label}-{tier}")
    return headers


def _field(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _leaf(text: Column) -> Column:
    columns = [*(F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars")), text]
    return F.sha2(F.concat(*map(_field, columns)), 256)


def dataset_manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified), a row per row of ``docs``.

    ``tampered`` is the text that is found when the manifest is checked (default: the text itself); a row's
    ``folded_root`` comes from the leaf of that text and the original siblings.
    """
    stage = Stage(docs.sparkSession, "manifest")
    text = F.col("text").cast("string")
    found = text if tampered is None else tampered.cast("string")
    leaves = docs.select(F.col("source").cast("string").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), _leaf(text).alias("digest"), _leaf(found).alias("forged"))
    leaves = stage.write(numbered(stage, stage.write(leaves, "leaves"), ["doc_id", "digest"], "sorted"), "numbered")
    tiers, subroots = _rise(stage, leaves, "source", levels)
    named = subroots.select(F.lit("").alias("key"), F.col("key").alias("source"), "tier", "digest")
    places = stage.write(numbered(stage, named, ["source"], "sources"), "places")
    upper, root = _rise(stage, places.select("key", "at", "digest"), "root", levels)
    top = root.select("key", "tier", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    heads = _descend(stage, upper, top, "root", levels)
    nodes = places.select("key", "at", "digest", F.lit(None).cast("string").alias("forged"), F.lit(None).cast("long").alias("doc_id"))
    # a header's block is a subroot's place, so its path leads from that subroot to the root
    ways = _with_headers(nodes, heads, levels).mapInArrow(_lower(levels), "key string, block long, path string, subroot string, root string")
    ways = stage.write(ways.select(F.col("block").alias("place"), "path", "root"), "ways")
    tops = places.join(stage.side(ways), F.col("at") == F.col("place")).select(F.col("source").alias("key"), "tier", "path", F.col("digest").alias("subroot"), "root")
    headers = _descend(stage, tiers, stage.write(tops, "tops"), "source", levels)
    out = _with_headers(leaves, headers, levels).mapInArrow(_prove(levels), "doc_id long, " + ", ".join(f"{n} string" for n in _PROOF.names[1:]))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

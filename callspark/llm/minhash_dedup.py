"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected groups.

Method. The sketch of a set has ``t`` bins. In round i < t each element picks a bin and a value by the
round's hash; in rounds t .. 2t-1 it gets the fixed bin i - t. A bin keeps the value of its first round,
the smallest there. All bins fill within 2t rounds, and agreeing bins concentrate about the Jaccard
similarity like those of t independent hashes (Dahlgaard, Knudsen, Thorup: Fast Similarity Sketching).
Rounds stop as soon as all bins of a set are filled. Bands of ``rows`` bins are keys; at a similarity of
0.75 a pair shares none of 32 bands of 4 bins with a probability of about 5e-6.

Copies (equal sets) are one class, carried by one document. Candidates among classes come from bands;
pairs that the sketch rules out by more than five standard deviations or that sizes rule out fall, and each
remaining pair is confirmed on its full sets. Groups are closed by ``link_groups``.

Cases: a null or blank text has an empty set and is its own component. Fewer words than five: the
whole sequence is the one shingle. Rows with equal doc_id and text are copies of one another and
all get the same answer; two rows with one doc_id and different texts are two documents with one id. A row
whose doc_id is null can be in a group; if all rows of a group have null, its component_id is null. ``kept``
of a null doc_id is true only in such a group. Extra columns are ignored by ``near_duplicates`` and kept
by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callspark.llm.components import link_groups
from callspark.llm.staging import Stage, packed, passing, unpacked
from callspark.llm.textbytes import SPACE_WORDS, TextSlice, mix, ragged_positions, slices, window_hash

_U = np.uint64
SHINGLE_WORDS = 5
BINS = 128
BAND_ROWS = 4
_ROUND_SEEDS = np.random.default_rng(77).integers(1, 2**63, 2 * BINS, dtype=np.uint64)


def shingle_sets(piece: TextSlice, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, joined, and the rows' offsets in them."""
    words = piece.words(SPACE_WORDS)
    hashes = words.hashes(fold=True)
    sizes = np.maximum(words.counts - size + 1, np.minimum(words.counts, 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], dtype=np.uint64)
    first, row = ragged_positions(words.offsets[:-1], np.maximum(words.counts - size + 1, 0))
    out[first - words.offsets[row] + at[row]] = window_hash(hashes, first, size)
    for short in range(1, size):
        rows = np.flatnonzero(words.counts == short)
        out[at[rows]] = window_hash(hashes, words.offsets[rows], short)
    for k in np.flatnonzero(sizes > 1):
        out[at[k] : at[k + 1]].sort()
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[at[:-1][sizes > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def sketches(sets: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """(rows, bins) array of uint64; rows of empty sets are zero."""
    rows = len(offsets) - 1
    counts = np.diff(offsets)
    out = np.full((rows, bins), _U(2**64 - 1))
    todo = np.flatnonzero(counts)
    for turn in range(2 * bins):
        if not len(todo):
            break
        at, run = ragged_positions(offsets[todo], counts[todo])
        y = mix(sets[at] ^ _ROUND_SEEDS[turn])
        # the round stands above the hash in a value, so that the minimum keeps a bin's first round
        value = (y >> _U(9)) | (_U(turn) << _U(55))
        if turn < bins:
            held = out[todo]
            np.minimum.at(held.reshape(-1), run * bins + (y & _U(bins - 1)).astype(np.int64), value)
            out[todo] = held
        else:
            begins = np.cumsum(counts[todo]) - counts[todo]
            out[todo, turn - bins] = np.minimum(out[todo, turn - bins], np.minimum.reduceat(value, begins))
        todo = todo[(out[todo] == _U(2**64 - 1)).any(axis=1)]
    out[counts == 0] = 0
    return out


def band_keys(sketch: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    n, bins = sketch.shape
    bands = sketch.reshape(n, bins // rows, rows)
    total = np.broadcast_to(mix(np.arange(bins // rows, dtype=np.uint64) + _U(1)), bands.shape[:2]).copy()
    for k in range(rows):
        total = mix(total ^ bands[:, :, k]) + bands[:, :, k]
    return mix(total).view(np.int64)


def _set_digests(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set; equal sets have equal ones."""
    both = []
    for salt in (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)):
        total = np.concatenate([[_U(0)], np.cumsum(mix(sets ^ salt), dtype=np.uint64)])
        both.append(mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64))
    return both[0], both[1]


_SKETCHED = "doc_id long, text_hash long, n_shingles long, node long, check long, small binary, bands array<long>"


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch.column(2)):
            sets, offsets = shingle_sets(piece)
            node, check = _set_digests(sets, offsets)
            sketch = sketches(sets, offsets)
            n = np.diff(offsets)
            keys = band_keys(sketch)[n > 0]
            at = np.concatenate([[0], np.cumsum(np.where(n > 0, BINS // BAND_ROWS, 0))]).astype(np.int32)
            small = (sketch >> _U(20)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(piece.first, piece.rows),
                    batch.column(1).slice(piece.first, piece.rows),
                    pa.array(n.astype(np.int64)),
                    pa.array(node),
                    pa.array(check),
                    pa.array([x.tobytes() for x in small], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1))),
                ],
                names=["doc_id", "text_hash", "n_shingles", "node", "check", "small", "bands"],
            )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch.column(1)):
            sets, offsets = shingle_sets(piece)
            node, _ = _set_digests(sets, offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array([sets[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["node", "hashes"]
            )


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hashes, component) to a row per shingle."""
    for batch in batches:
        hashes = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(1)]
        row = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.int64)
        for k in range(0, len(flat), 200_000):
            at = pa.array(row[k : k + 200_000])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(flat[k : k + 200_000])], names=["id", "component", "shingle"])


def _against_lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, id, n, own, led): sizes, and a bit mark of what ``own`` lacks of ``led``."""
    for batch in batches:
        rows = []
        for own, led in zip(batch.column(3), batch.column(4)):
            own = own.values.to_numpy()
            led = led.values.to_numpy() if led.is_valid else own[:0]
            lacks = np.setdiff1d(led, own, assume_unique=True).view(np.uint64)
            mark = np.zeros(256, dtype=bool)
            mark[(lacks >> _U(56)).astype(np.int64)] = True
            rows.append((len(own), len(led), len(own) - (len(led) - len(lacks)), *np.packbits(mark).view(np.int64).tolist()))
        columns = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names=["lead", "id", "n", "s", "l", "x", "g0", "g1", "g2", "g3"])


def _sketch_filter(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for k in (2, 3))
            same = (one == two).mean(axis=1)
            yield batch.select([0, 1]).filter(pa.array((same - 1 / 256) / (1 - 1 / 256) >= floor))

    return run


def _exact_filter(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, (one, two) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                one, two = np.frombuffer(one.as_buffer(), dtype=np.uint64), np.frombuffer(two.as_buffer(), dtype=np.uint64)
                both = np.sort(np.concatenate([one, two]))
                shared = int((both[1:] == both[:-1]).sum())
                keep[k] = 100 * shared >= percent * (len(both) - shared)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, component), a row per row of ``docs`` (doc_id, text).

    Documents are linked where 100 * |A & B| >= percent * |A | B|; ``kept`` marks the smallest doc_id of
    each connected group. ``text_hash`` is xxhash64 of the text; ``component`` names the group.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "minhash")
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketched = stage.write(text.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_sketch_batches, _SKETCHED), "sketches")
    banded = stage.write(
        sketched.where("n_shingles > 0").groupBy("node", "check").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("small").alias("small"), F.first("bands").alias("bands")), "banded"
    )
    classes = stage.write(banded.select("node", "doc_id", "n", "small"), "classes")
    members = banded.select(F.explode("bands").alias("key"), F.col("node").alias("id"))
    facts = classes.select("node", "n", "small")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, hashes) of the classes in ``nodes``, from the whole text of the document that carries each."""
        needed = stage.write(nodes.join(stage.side(classes, classes.select("node", "doc_id")), "node"), "needed", nameless=F.count_if(F.isnull("doc_id")))
        named = needed.where("doc_id is not null").select("doc_id").distinct()
        found = text.join(stage.side(needed, named), "doc_id").select("doc_id", "text")
        if stage.counted(needed)["nameless"]:
            found = found.union(text.where("doc_id is null"))
        found = found.mapInArrow(_set_batches, "node long, hashes binary").join(stage.side(needed, needed.select("node")), "node", "left_semi")
        return stage.write(found, "sets")  # rows that repeat a doc_id may come twice, which changes nothing below

    def confirm(pairs: DataFrame) -> DataFrame:
        one, two = (stage.side(classes, facts.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("small").alias(f"small_{k}"))) for k in "ab")
        likely = pairs.join(one, "a").join(two, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        likely = likely.select("a", "b", "small_a", "small_b").mapInArrow(_sketch_filter(percent / 100 - 0.2), "a long, b long")
        likely = stage.write(likely, "likely")
        sets = sets_of(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct())
        # whole sets are wide rows, and are never broadcast
        one, two = (sets.select(F.col("node").alias(k), F.col("hashes").alias(f"hashes_{k}")).hint("merge") for k in "ab")
        checked = likely.join(one, "a").join(two, "b").select("a", "b", "hashes_a", "hashes_b")
        return checked.mapInArrow(_exact_filter(percent), "a long, b long")

    def bound(unsettled: DataFrame) -> tuple[DataFrame, str]:
        """What two sets of different components can share at most, exactly, from facts of each.

        Only shingles of two unsettled components or more can be shared: s of n are. Against the lead's such
        shingles (l), a set lacks some, told apart by 256 bits, and has x others: two sets share at most
        l - bits that either lacks + the smaller x.
        """
        parts_of = stage.write(unsettled.select("id", "component").distinct(), "parts")
        sets = sets_of(parts_of.select(F.col("id").alias("node")))
        each = sets.join(stage.side(parts_of, parts_of.select(F.col("id").alias("node"), "component")), "node").mapInArrow(_one_by_one, "id long, component long, shingle long")
        across = each.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        shared = each.join(across.hint("merge"), "shingle").groupBy("id").agg(F.array_sort(F.collect_set("shingle")).alias("own"))  # no longer than one set
        shared = stage.write(shared.join(stage.side(classes, classes.select(F.col("node").alias("id"), "n")), "id"), "shared")
        can = unsettled.select("lead", "id").join(stage.side(shared, shared.where(f"100 * size(own) >= {percent} * n")), "id")
        both = can.join(shared.select(F.col("id").alias("lead"), F.col("own").alias("led")).hint("merge"), "lead", "left")
        facts_of = both.select("lead", "id", "n", "own", "led").mapInArrow(_against_lead, "lead long, id long, n long, s long, l long, x long, g0 long, g1 long, g2 long, g3 long")
        most = "least(s_x, s_y, l_x + least(x_x, x_y)" + "".join(f" - bit_count(g{k}_x | g{k}_y)" for k in range(4)) + ")"
        return facts_of, f"100 * {most} >= {percent} * (n_x + n_y - {most})"

    parts = link_groups(stage, members, confirm, bound)
    named = classes.select("node", "doc_id")
    if parts is None:
        named = named.withColumn("component", F.col("node"))
    else:
        named = named.join(stage.side(parts, parts.select(F.col("id").alias("node"), "component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stage.write(named.select("node", "component").join(lowest.hint("merge"), "component").select("node", "component", "component_id"), "named")
    out = sketched.select("doc_id", "text_hash", "n_shingles", "node").join(named.hint("merge"), "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest doc_id.

    Rows that repeat the doc_id of a kept document with the same words stay once; documents without words
    all stay. All columns stay.
    """
    stage = Stage(docs.sparkSession, "minhash-drop")
    with passing():
        groups = stage.write(near_duplicates(docs, percent).where("n_shingles > 0"), "groups")
    order = F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "text_hash")
    best = stage.write(groups.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1"), "best")
    crowd = groups.join(stage.side(best), "component").select(order.alias("it"), "best")
    losers = stage.write(crowd.where("it <> best").select("it.doc_id", "it.text_hash").distinct().toDF("_id", "_hash"), "losers")
    twice = stage.write(crowd.where("it = best").groupBy("it").count().where("count > 1").select("it.doc_id", "it.text_hash").toDF("_id", "_hash"), "twice")
    same = F.col("at_id").eqNullSafe(F.col("_id")) & (F.col("at_hash") == F.col("_hash"))
    left = packed(docs).join(stage.side(losers), same, "left_anti")
    if not stage.rows(twice):
        return unpacked(left, docs)
    repeated = left.join(stage.side(twice), same, "left_semi").dropDuplicates(["at_id", "text"])
    return unpacked(left.join(stage.side(twice), same, "left_anti").unionByName(repeated), docs)

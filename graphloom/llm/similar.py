"""Near-duplicates of a similarity of 0.8 on five-word shingles, compared by SimHash per anchor.

A similarity (Jaccard) of 0.8 turns about 15 of 100 bits of a fingerprint, more
than the anchors of a covering code alone can serve: every code that covers 20
of 128 bits replicates a fingerprint to a large share of all anchors.  So the
anchors are of two kinds, and whole sets decide:

1. *Who may have a partner.*  In one order of all shingles (by hash), two sets of
   n shingles and a similarity of 0.8 share at least ``k`` of the first
   ``n - ceil(0.8 n) + k`` of either.  Sets of whose first shingles fewer are held
   by any other set have no partner; usually these are nearly all.
2. *Cells.*  The 128-bit fingerprints of the others go to the anchors of the
   covering code of :mod:`graphloom.llm.simhash` (of each of four blocks the one
   within covering radius, which is complete for 3 bits), and then to the first
   ``n - ceil(0.8 n) + 1`` shingles of their set as further anchors, in an order
   that has the most frequent ones last: every pair at 0.8 meets in one of them.
   Each cell links its members within ``LOOSE`` bits by a spanning forest; those
   that the first kind of anchor has joined need no link in the second.  ``LOOSE``
   is six standard deviations beyond what a similarity of 0.8 turns.
3. *Families*, the components of these links, are compared as whole sets of
   shingles, exactly; only spanning links at ``ALIKE`` or more leave a family.  One
   over ``FAMILY`` shingles is cut into salted blocks whose pairs are families.

A class is a component of the links of step 3.  Sets hold 64-bit shingle hashes.

Null text, and text without words, is the empty set, and all of them are one
class; a text of fewer than five words is one shingle.  Of each class the row
that comes first stays, by id (null ones last), then text hash, and of equal
rows one; rows that share an id, or have none, count one by one.  An empty table gives no
rows; extra columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.sieve import sieve
from graphloom.llm.simhash import CELLS, SEED, anchors, majority, meet
from graphloom.operators.linkage import connected_components
from graphloom.plans.shared import stage

WORDS = 5
#: The similarity as a fraction, and the share of a set that step 1 looks at beyond what one common shingle needs.
ALIKE, BEYOND = (4, 5), 10
#: Bits of 128 within which members of a cell are linked; shingles of a family that one task holds.
LOOSE, FAMILY = 44, 1_000_000
#: Shingles counted at once by a task of step 1, and most frequent shingles listed (speed only).
AT_ONCE, FREQUENT = 1_000_000, 100_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all (the finisher of the public SplitMix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingles of the whole text as ordered 64-bit hashes: words are hashed, then combined in order."""
    from xxhash import xxh3_64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    out = np.full(len(parts) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out + w[i : len(parts) - k + 1 + i] + _MIX[0])
    return np.unique(out.view(np.int64))


def wide_fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit SimHash of a set of shingles, as two signed numbers."""
    h = shingles.view(np.uint64)
    both = np.stack([h, _mixed(h + _MIX[0])], 1)
    low, high = np.frombuffer(majority(both.view(np.uint8).reshape(-1, 16)), "<i8").tolist() if len(h) else (0, 0)
    return low, high


def _number(shingles: np.ndarray) -> int:
    """One number for a set."""
    from xxhash import xxh3_64_intdigest

    return int(np.array([xxh3_64_intdigest(shingles.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _least(n: np.ndarray | int) -> np.ndarray | int:
    """What a set of ``n`` has in common, at least, with one as similar as ``ALIKE``."""
    return -(-ALIKE[0] * n // ALIKE[1])


def _key(text: str = "text") -> Column:
    return F.xxhash64(text)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("text_hash"), "text")


def described(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, text_hash, node, n`` per row: the number of its shingle set and the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(_number(s), len(s)) for s in (shingle_set(t.as_py(), words) for t in b.column(2))]
            node, n = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, n], names=["doc_id", "text_hash", "node", "n"])

    return stage(_rows(docs).mapInArrow(run, "doc_id long, text_hash long, node long, n long"), "shingle-sets")


def _first_shingles(words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts a task's first shingles before they are dealt out.

        ``(shingle, node, -1)`` for one that a single set here holds, ``(shingle,
        0, -2)`` for one that several do, and ``(node, node, k)`` with the
        number k of such shingles in each set.
        """
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            nodes = np.array(list(held), np.int64)
            s = np.concatenate(list(held.values()))
            owner = np.repeat(np.arange(len(nodes)), [len(x) for x in held.values()])
            order = np.argsort(s, kind="stable")
            s, owner = s[order], owner[order]
            starts = np.flatnonzero(np.concatenate([np.ones(min(len(s), 1), bool), s[1:] != s[:-1]]))
            times = np.diff(np.append(starts, len(s)))
            known = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(nodes))
            one, many = starts[times == 1], starts[times > 1]
            columns = ([s[one], s[many], nodes], [nodes[owner[one]], np.zeros(len(many), np.int64), nodes], [np.full(len(one), -1), np.full(len(many), -2), known])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=["key", "node", "k"])

        for b in batches:
            for text in b.column(0):
                u = shingle_set(text.as_py(), words)
                node = _number(u)
                if node not in held and len(u):
                    held[node] = u[: len(u) - _least(len(u)) + max(1, len(u) // BEYOND)]
                    size += len(held[node])
                    if size >= AT_ONCE:
                        yield flush()
                        held, size = {}, 0
        if held:
            yield flush()

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, shared, copies)`` from rows of :func:`_first_shingles` in order of their key."""
    key, node, k = (np.zeros(0, np.int64) for _ in range(3))

    def close(key: np.ndarray, node: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        own = k >= 0
        s, n, many = key[~own], node[~own], k[~own] == -2
        starts = np.flatnonzero(np.concatenate([np.ones(min(len(s), 1), bool), s[1:] != s[:-1]]))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(s))))
        # several sets here, or sets of different tasks
        several = np.bincount(run, weights=many, minlength=len(starts)) > 0
        if len(starts):
            several |= np.minimum.reduceat(np.where(many, np.iinfo(np.int64).max, n), starts) < np.maximum.reduceat(np.where(many, np.iinfo(np.int64).min, n), starts)
        hit = n[several[run] & ~many] if len(run) else n
        nodes, times = np.unique(hit, return_counts=True)
        columns = ([node[own], nodes], [k[own], times], [np.ones(own.sum(), np.int64), np.zeros(len(nodes), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=["node", "shared", "copies"])

    for b in batches:
        key, node, k = (np.concatenate([x, b.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate((key, node, k)))
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield close(key[:last], node[:last], k[:last])
            key, node, k = key[last:], node[last:], k[last:]
    if len(key):
        yield close(key, node, k)


def partnered(docs: DataFrame, sets: DataFrame, words: int = WORDS) -> DataFrame:
    """``node, doc_id, text_hash, times``: the sets that may have a partner (step 1), with a row that holds each.

    A shingle that occurs twice in a task is one row of it, so a frequent one
    costs a row per task, not one per document.
    """
    first = docs.select("text").mapInArrow(_first_shingles(words), "key long, node long, k long")
    met = first.repartition("key").sortWithinPartitions("key").mapInArrow(_met, "node long, shared long, copies long")
    met = met.groupBy("node").agg(F.sum("shared").alias("shared"), F.sum("copies").alias("copies"))
    # a partner has at least 0.8 n shingles, and the fewer of both decide
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * ALIKE[0] / ALIKE[1] - F.lit(1e-6)) / BEYOND))
    by_row = sets.where("n > 0").groupBy("node", "n", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), "times")).alias("r")
    held = by_row.groupBy("node", "n").agg(row)
    kept = held.join(met, "node").where(F.col("shared") >= need * F.col("copies"))
    return stage(kept.select("node", F.col("r.id").alias("id"), F.col("r.h").alias("h"), "r.times"), "partnered")


def _whole_sets(docs: DataFrame, some: DataFrame, words: int) -> DataFrame:
    """``node, n, fp, fp2, w``: the whole sets of ``some``; its rows are joined by id and text hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = [shingle_set(t, words) for t in part.column(1).to_pylist()]
                fps = np.array([wide_fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps[:, 0]), pa.array(fps[:, 1]), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "fp", "fp2", "w"])

    # texts that cannot be meant are not shuffled where the join needs a shuffle
    met = _rows(docs).where(sieve(some, "h")(F.col("text_hash"))).join(some, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h"))).select("node", "text")
    out = met.mapInArrow(run, "node long, n long, fp long, fp2 long, w array<long>")
    return stage(out if some.where("times > 1").isEmpty() else out.dropDuplicates(["node"]), "whole-sets")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists in one, and how many each holds."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def _code_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of the covering code's anchors, of rows ``node, fp, fp2``."""
    for b in batches:
        node, fp = b.column(0).to_numpy(), np.stack([b.column(k).to_numpy() for k in (1, 2)], 1)
        rows, keys = anchors(fp.view(np.uint64), 0)
        mine = pa.array(node[rows])
        yield pa.RecordBatch.from_arrays([pa.array(keys), mine, pa.array(fp[rows, 0]), pa.array(fp[rows, 1]), mine], names=["cell", "id", "fp", "fp2", "joined"])


def _shingle_cells(frequent: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of the first shingles, of rows ``node, fp, fp2, joined, w``."""
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                values, n = _lists(part.column(4))
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((values, np.isin(values, frequent), owner))
                rank = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
                first = order[rank < np.repeat(n - _least(n) + 1, n)]
                rest = [pa.array(part.column(k).to_numpy()[owner[first]]) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(values[first]), *rest], names=["cell", "id", "fp", "fp2", "joined"])

    return run


def alike(values: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Links (as numbers of sets) that join all sets as similar as ``ALIKE``, directly or through others.

    ``values`` are the members of all sets, ``n`` of them in each.  A set is
    met with all that are not reached yet through the lists of who holds its
    members, and the search ends once every set is reached.
    """
    num, den = ALIKE
    starts = np.cumsum(n) - n
    token = np.unique(values, return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(len(n)), n)[order]
    at = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=1))])
    open_, out, queue = np.ones(len(n), bool), [], []
    for seed in range(len(n)):
        if not open_[seed]:
            continue
        open_[seed] = False
        queue.append(seed)
        while queue:
            x = queue.pop()
            if not open_.any():
                return out
            mine = token[starts[x] : starts[x] + n[x]]
            lo, many = at[mine], at[mine + 1] - at[mine]
            hit = holder[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            common = np.bincount(hit, minlength=len(n))
            near = np.flatnonzero(open_ & (common * (num + den) >= (n + n[x]) * num))
            out += [(x, int(y)) for y in near]
            open_[near] = False
            queue += near.tolist()
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, node, w`` in order of the key: the links of each family."""
    key, nodes, held, sizes = None, [], [], []

    def close() -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1 or (nodes and len(nodes[0]) > 1):
            ids = np.concatenate(nodes)
            links = np.array(alike(np.concatenate(held), np.concatenate(sizes)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[links[:, 0]]), pa.array(ids[links[:, 1]])], names=["a", "b"])

    for b in batches:
        keys = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi == lo:
                continue
            if keys[lo] != key:
                yield from close()
                key, nodes, held, sizes = keys[lo], [], [], []
            values, n = _lists(b.column(2).slice(lo, hi - lo))
            nodes.append(b.column(1).to_numpy()[lo:hi])
            held.append(values)
            sizes.append(n)
    yield from close()


def similar_sets(sets: DataFrame, cell: int = 20_000, family: int = FAMILY) -> DataFrame:
    """``(a, b)``: links between the nodes of ``sets`` (``node, n, fp, fp2, w``); their components are those of all pairs at ``ALIKE``."""
    counted = sets.select(F.explode("w").alias("s")).groupBy("s").agg(F.count("*").alias("c")).where("c > 8")
    frequent = np.array([r["s"] for r in counted.orderBy(F.desc("c"), "s").limit(FREQUENT).collect()], np.int64)
    close = meet(sets.select("node", "fp", "fp2").mapInArrow(_code_cells, CELLS), LOOSE, cell)
    joined = stage(connected_components(close), "joined")
    known = sets.join(joined, "node", "left").select("node", "fp", "fp2", F.coalesce("component", "node").alias("joined"), "w")
    near = meet(known.mapInArrow(_shingle_cells(frequent), CELLS), LOOSE, cell)
    of = connected_components(close.unionByName(near)).withColumnRenamed("component", "family")
    members = sets.select("node", "n").join(of, "node")
    blocks = members.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(family // 2)).alias("k"))
    blocks = blocks.withColumn("k", F.when(F.col("k") <= 2, F.lit(1)).otherwise(F.col("k")).cast("long"))
    members = stage(members.join(blocks, "family").select("node", "family", "k"), "families")
    # a set of block s is met with block j in the family (s, j); most families are one block
    salt, other = F.pmod(F.xxhash64("node"), F.col("k")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    rows = sets.select("node", "w").join(members, "node").select("node", "w", "family", salt.alias("s"), other.alias("j"))
    rows = rows.select(F.xxhash64("family", F.least("s", "j"), F.greatest("s", "j")).alias("key"), "node", "w")
    return stage(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "a long, b long"), "similar-links")


def similar(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, text_hash, node, class``: one row per row of ``docs``; rows of one class are joined by similar sets."""
    rows = described(docs, words)
    sets = _whole_sets(docs, partnered(docs, rows, words), words)
    of = stage(connected_components(similar_sets(sets)).select("node", F.col("component").alias("class")), "similar-classes")
    return rows.join(of, "node", "left").select("doc_id", "text_hash", "node", F.coalesce("class", "node").alias("class"))


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each class: the first by id (null ones last), then text hash."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h")))
    rows = stage(similar(docs, words), "similar-rows")
    # equal sets are one row each before classes meet, so copies are counted where they lie
    nodes = rows.groupBy("node", "class").agg(first.alias("m"))
    kept = stage(nodes.groupBy("class").agg(F.min("m").alias("m")).select("m.id", "m.h"), "kept")
    every = stage(rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "row-counts")
    same = lambda i, h: F.col(i).eqNullSafe(F.col("id")) & (F.col(h) == F.col("h"))
    # names that no column of the documents has; only what may go is joined
    i, h, gone_i, gone_h = (f"{c}_{uuid4().hex}" for c in ("id", "h", "id", "h"))
    keyed = docs.withColumns({i: F.col("doc_id").cast("long"), h: _key()})
    named = lambda df: df.select(F.col("doc_id").alias(gone_i), F.col("text_hash").alias(gone_h))
    equal = F.col(i).eqNullSafe(F.col(gone_i)) & (F.col(h) == F.col(gone_h))
    gone = stage(named(every.join(kept, same("doc_id", "text_hash"), "left_anti")), "gone")
    maybe = sieve(gone, gone_h)(F.col(h))
    out = keyed.where(~maybe).unionByName(keyed.where(maybe).join(gone, equal, "left_anti"))
    twice = stage(named(every.where("n > 1").join(kept, same("doc_id", "text_hash"), "left_semi")), "repeated")
    if not twice.isEmpty():  # rows that are repeated, of which one stays
        out = out.join(twice, equal, "left_anti").unionByName(out.join(twice, equal, "left_semi").dropDuplicates([i, h]))
    return out.select(*docs.columns)

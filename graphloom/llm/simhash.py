"""SimHash near-duplicates by anchor points of a covering code.

Two fingerprints within 3 bits differ in at most one bit of one 32-bit half.
The anchors of a half are the words of the perfect [31,26] Hamming code on its
low 31 bits (leaving a bit out brings no two closer than they are counted):
every point lies within the covering radius, 1, of exactly one anchor.  Each
different fingerprint is replicated to every anchor within covering radius plus
threshold, 1 + 1, which is 16 of 2^26; then a pair meets at the anchor of either.
Cells are compared exactly on all bits, each by itself.

Copies are one fingerprint, so a group of copies costs one comparison.  A cell
links its members by a spanning forest, not by all pairs.  A cell over
``CELL`` members is not held by one task: it is written out, cut into salted
blocks, and its pairs of blocks are compared as cells of their own.

Null text, and text without words, has fingerprint zero and is linked like any
other; rows with a null ``doc_id`` take part but are never a smallest id unless
alone in their class; repeated rows appear repeatedly; an empty table gives no
rows; extra columns are ignored.  The similarity of 0.8 on five words that the
pipeline asks for is in :mod:`graphloom.llm.similar`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.linkage import connected_components
from graphloom.plans.shared import stage

WORDS, BITS, SEED = 3, 3, 42
#: Members of a cell that one task compares.
CELL = 20_000
#: Members of a cell whose few pairs are all compared at once; larger cells are searched.
_UPTO = 4


def _hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the whole text's word shingles as bytes ``(n, 8)``."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(words, len(parts)) - 1 :].tolist()
    shingles = (joined[a:b] for a, b in zip(starts.tolist(), last))  # noqa: B905
    return np.array([xxh64_intdigest(x, SEED) for x in shingles], "<u8").view(np.uint8).reshape(-1, 8)


def majority(hashes: np.ndarray) -> bytes:
    """The bits set in over half of the hashes ``(n, bytes)``."""
    ones = np.zeros(hashes.shape[1] * 8, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of the whole text's word shingles."""
    return int.from_bytes(majority(_hashes(text, words)), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` of every document; ``fp`` is a signed bigint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.text], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "fp": fp})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def _blocks(fp: np.ndarray) -> list[np.ndarray]:
    """The 32-bit blocks of fingerprints ``(n, 64-bit words)``, 31 bits of each."""
    return [((fp[:, k] >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.uint32) for k in range(fp.shape[1]) for half in (0, 1)]


def anchors(fp: np.ndarray, threshold: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchor keys of all anchors within covering radius, 1, plus ``threshold`` bits, for all blocks of fingerprints ``(n, 64-bit words)``."""
    rows, keys = [], []
    bit = np.arange(1, 32, dtype=np.uint32)
    for block, x in enumerate(_blocks(fp)):
        syndrome = np.zeros(len(x), np.uint32)
        for i in bit:
            syndrome ^= np.where(x >> (i - 1) & 1, i, np.uint32(0)).astype(np.uint32)
        base = np.uint64(block) << np.uint64(31)
        near = np.where(syndrome > 0, x ^ (np.uint32(1) << np.maximum(syndrome, 1) - 1), x).astype(np.uint32)
        rows.append(np.arange(len(x)))
        keys.append(base | near)
        for i in bit if threshold else ():
            j = i ^ syndrome
            ok = np.flatnonzero((syndrome > 0) & (j > i))
            rows.append(ok)
            keys.append(base | (x[ok] ^ (np.uint32(1) << (i - 1)) ^ (np.uint32(1) << (j[ok] - 1))))
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 4000):
            part = fp[at : at + 4000]
            rows, keys = anchors(part[:, None].view(np.uint64))
            mine = pa.array(part[rows])
            yield pa.RecordBatch.from_arrays([pa.array(keys), mine, mine, pa.array(np.zeros(len(rows), np.int64)), mine], names=["cell", "id", "fp", "fp2", "joined"])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints ``(n, 64-bit words)``."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def forest(fp: np.ndarray, bits: int = BITS, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (as row numbers) that join all members within ``bits`` of each other, directly or through others.

    Members of one ``joined`` number are joined already, and need no links.
    """
    joined = np.arange(len(fp)) if joined is None else joined
    left, out, queue = np.arange(len(fp)), [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        x = queue.pop()
        own = joined[left] == joined[x]
        near = own | (_apart(fp[left], fp[x]) <= bits)
        if near.any():
            # one link joins all of a number
            met, first = np.unique(joined[left[near & ~own]], return_index=True)
            new = left[near & ~own][first]
            out += [(int(x), y) for y in new.tolist()]
            more = near | np.isin(joined[left], met)
            queue += left[more].tolist()
            left = left[~more]
    return out


CELLS = "cell long, id long, fp long, fp2 long, joined long"
_LINKS = "cell long, a long, b long, fp long, fp2 long, joined long"


def _compare(bits: int, most: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links ``(null, a, b)``; members of over-full cells come back as ``(cell, id, null, fp, fp2, joined)``."""
        names = ["cell", "a", "b", "fp", "fp2", "joined"]

        def over(cell: int, rows: np.ndarray) -> pa.RecordBatch:
            ids, *rest = (pa.array(c) for c in rows.T.copy())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), cell)), ids, pa.nulls(len(rows), pa.int64()), *rest], names=names)

        def whole(cell: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            ids, joined, raw = rows[:, 0], rows[:, 3], np.ascontiguousarray(rows[:, 1:3]).view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            sizes = np.diff(np.append(starts, len(cell)))
            pairs = []
            small = np.repeat(sizes <= _UPTO, sizes)
            for k in range(1, _UPTO):
                i = np.flatnonzero((cell[k:] == cell[:-k]) & small[:-k] & (joined[k:] != joined[:-k]))
                if len(i):
                    i = i[_apart(raw[i], raw[i + k]) <= bits]
                    pairs.append(np.stack([i, i + k], 1))
            for s, n in zip(starts[sizes > _UPTO].tolist(), sizes[sizes > _UPTO].tolist(), strict=True):
                pairs.append(np.array(forest(raw[s : s + n], bits, joined[s : s + n]), np.int64).reshape(-1, 2) + s)
            if pairs and sum(map(len, pairs)):
                ends = np.unique(np.sort(ids[np.concatenate(pairs)], axis=1), axis=0)
                none = pa.nulls(len(ends), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(ends[:, 0]), pa.array(ends[:, 1]), none, none, none], names=names)

        cells, rows, full = np.zeros(0, np.int64), np.zeros((0, 4), np.int64), None
        for batch in batches:
            c, *r = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            r = np.stack(r, 1)
            if full is not None:  # the rest of a cell that is written out
                n = int(np.searchsorted(c, full, "right"))
                yield over(full, r[:n])
                c, r = c[n:], r[n:]
                if not len(c):
                    continue
                full = None
            cells, rows = np.concatenate([cells, c]), np.concatenate([rows, r])
            last = int(np.searchsorted(cells, cells[-1], "left"))
            if len(cells) - last > most:
                full = int(cells[-1])
                yield over(full, rows[last:])
                yield from whole(cells[:last], rows[:last]) if last else ()
                cells, rows = cells[:0], rows[:0]
            elif last > 200_000:
                yield from whole(cells[:last], rows[:last])
                cells, rows = cells[last:], rows[last:]
        if len(cells):
            yield from whole(cells, rows)

    return run


def meet(cells: DataFrame, bits: int, cell: int = CELL) -> DataFrame:
    """``(a, b)``: spanning links of the members within ``bits`` of each other, of each cell of ``cells`` (``CELLS``).

    Members with the same number ``joined`` (their own id, unless it is known more) need no link.
    """
    compare = lambda df, most: df.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(bits, most), _LINKS)
    found = stage(compare(cells, cell), "simhash-links")
    over, done = found.where("cell IS NOT NULL"), found.where("cell IS NULL").select("a", "b")
    sizes = over.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(cell // 2)).alias("k"))
    if not sizes.isEmpty():
        # a member of block s meets block j in the cell (s, j)
        salt = F.pmod(F.xxhash64("a"), F.col("k"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
        rows = over.join(sizes, "cell").select("cell", F.col("a").alias("id"), "fp", "fp2", "joined", salt.alias("s"), other.alias("j"))
        rows = rows.select(F.xxhash64("cell", F.least("s", "j"), F.greatest("s", "j")).alias("cell"), "id", "fp", "fp2", "joined")
        done = done.unionByName(compare(rows, 2**31).select("a", "b"))
    return done


def links(fps: DataFrame, bits: int = BITS, cell: int = CELL) -> DataFrame:
    """``(a, b)``: links of fingerprints ``fp``; their components are those of all pairs within ``bits`` bits."""
    if bits > 3:
        raise ValueError("two halves with anchors at one bit cover thresholds up to 3")
    return meet(fps.select("fp").distinct().mapInArrow(_replicate, CELLS), bits, cell)


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per document with its class."""
    fps = stage(fingerprints(docs, words), "fingerprints")
    of = connected_components(links(fps, bits)).select(F.col("node").alias("fp"), F.col("component").alias("class"))
    different = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(of, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    different = stage(different, "fingerprint-classes")
    least = different.groupBy("class").agg(F.min("least").alias("component_id"))
    classes = different.join(least, "class").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with fingerprint and class."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

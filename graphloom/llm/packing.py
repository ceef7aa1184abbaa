"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

Pieces of one length are interchangeable, so the packing is decided on the
histogram of lengths: at most ``capacity`` numbers, whatever the corpus.  A bin
is filled greedily with the largest piece that fits; then its smallest piece is
taken out and, if two unpacked pieces fill the expanded gap more tightly, they
replace it.  A pattern repeats for as long as its lengths last, so the number of
different patterns is bounded by the number of lengths and each is applied in
one step.  Pieces are then dealt to the patterns by their rank among those of
their length; ranks come from counters kept per task and a prefix sum of counts
per (task, length), never from gathering the pieces of a length in one place.

Null text is an empty text (its end id alone is a piece of one token).  Only
documents over the capacity are cut.  An empty table gives no rows; repeated
rows are packed as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.tokens import default_path, encoder
from graphloom.plans.shared import stage

CAPACITY = 4096
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Best-two-fit on a histogram: ``[(pieces of each length in a bin, number of such bins)]``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins: list[tuple[dict[int, int], int]] = []
    lengths = np.arange(capacity + 1)
    while left.any():
        have = left.copy()
        bin_: dict[int, int] = {}
        # the largest available length at or below each gap
        largest = np.maximum.accumulate(np.where(have > 0, lengths, 0))
        gap = capacity
        while gap and (size := int(largest[gap])):
            n = min(int(have[size]), gap // size)
            bin_[size] = bin_.get(size, 0) + n
            have[size] -= n
            gap -= n * size
            if not have[size]:
                largest = np.maximum.accumulate(np.where(have > 0, lengths, 0))
        smallest = min(bin_)
        if gap and len(bin_) + bin_[smallest] > 2:
            room = gap + smallest
            largest = np.maximum.accumulate(np.where(have > 0, lengths, 0))
            first = np.flatnonzero(have[: room + 1])
            second = largest[room - first]
            # a length that is there once cannot be both of the two
            twice = (second == first) & (have[first] < 2)
            below = np.concatenate([[0], largest[:-1]])
            second = np.where(twice, below[np.minimum(second, room - first)], second)
            both = np.where(second > 0, first + second, 0)
            if both.size and both.max() > smallest:
                k = int(both.argmax())
                bin_[smallest] -= 1
                for size in (int(first[k]), int(second[k])):
                    bin_[size] = bin_.get(size, 0) + 1
        bin_ = {size: n for size, n in bin_.items() if n}
        times = min(int(left[size]) // n for size, n in bin_.items())
        for size, n in bin_.items():
            left[size] -= n * times
        bins.append((bin_, times))
    return bins


def runs_of(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows ``(first rank, pieces of it in a bin, first sequence, first offset)`` by rank."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for bin_, times in bins:
        offset = 0
        for size, n in sorted(bin_.items(), reverse=True):
            rank = used.get(size, 0)
            rows.setdefault(size, []).append((rank, n, sequence, offset))
            used[size] = rank + n * times
            offset += n * size
        sequence += times
    return {size: np.array(r, np.int64) for size, r in rows.items()}


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every whole text, with their task and their rank there among pieces of their length."""
    path = path or default_path()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows = []
            for i, ids in enumerate(encoder(path).encode_all(b.text)):
                for k in range(-(-len(ids) // (4 * capacity))):
                    part = ids[4 * capacity * k : 4 * capacity * (k + 1)]
                    n = len(part) // 4
                    rows.append((i, k, k * capacity, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            out = pd.DataFrame(rows, columns=["row", "piece", "start", "length", "ids_crc32", "task", "local_rank"])
            yield out.assign(doc_id=b.doc_id.astype("Int64").array.take(out.row.to_numpy())).drop(columns="row")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(pieces, _PIECES)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: its document, place there, checksum, ``sequence_id`` and ``offset``."""
    pieces = stage(cut(docs, path, capacity), "pieces")
    counts = stage(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = runs_of(plan_bins(histogram, capacity))
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    # the counts grow with the number of tasks, so they are never broadcast
    ranked = pieces.join(before.hint("merge"), ["task", "length"]).withColumn("rank", F.col("before") + F.col("local_rank")).drop("before", "local_rank", "task")
    held = docs.sparkSession.sparkContext.broadcast(runs)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for size, rows in b.groupby("length").indices.items():
                run, rank = held.value[int(size)], b["rank"].to_numpy()[rows]
                at = run[np.searchsorted(run[:, 0], rank, "right") - 1]
                sequence[rows] = at[:, 2] + (rank - at[:, 0]) // at[:, 1]
                offset[rows] = at[:, 3] + (rank - at[:, 0]) % at[:, 1] * size
            yield b.drop(columns="rank").assign(doc_id=b.doc_id.astype("Int64"), sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, "length long, doc_id long, piece int, start long, ids_crc32 long, sequence_id long, offset long").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

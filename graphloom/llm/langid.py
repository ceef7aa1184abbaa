"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree of depth ``ORDER``: after a
context seen T times with D different next bytes, a byte seen c times costs
log2((T + D) / c) bits, and an escape to the next shorter context costs
log2((T + D) / D); a context never seen costs nothing to leave, and below the
empty context all 256 bytes are equal.  Statistics are frozen after training, so
the exact code length of a text is the sum of a function of its
(ORDER + 1)-byte windows; those of windows seen in training are tabulated, the
rest are computed.  The language with the shortest code wins (ties: first by
name); the score is its posterior when the bits are taken per ``SCALE`` bytes.

Letters A-Z are lower-cased.  Null text, and text without a letter, is ``und``
with score 0.  Training reads text and non-null ``lang`` only, of about
``TRAIN_DOCS`` different texts of at most ``TRAIN_CHARS`` characters per language,
spread by hash (the documented bound of the sample); more than ``MOST_LANGUAGES``
labels are an error.  Without any language learned everything is ``und``.  An
empty table gives no rows; repeated rows get equal predictions; extra columns
are kept whatever their names.

The filter (:func:`keep_identified`) keeps a document if its best language is
among those asked for (all learned ones by default), its score is at least
``LEAST_SCORE`` and its code takes at most ``MOST_BITS`` bits a byte: text of no
learned language, or none at all, is longer under every tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

ORDER, TRAIN_DOCS, TRAIN_CHARS, MOST_LANGUAGES, SCALE = 3, 400, 100_000, 256, 16
#: What the filter asks for: the posterior of the best language, and bits a byte at most.
LEAST_SCORE, MOST_BITS = 0.4, 7.0
#: Bytes whose windows are held at once.
AT_ONCE = 1_000_000
_LETTER = re.compile(r"[^\W\d_]")
_PAD = b"\0" * ORDER


def _windows(data: np.ndarray) -> np.ndarray:
    """The window that ends at each byte from ``ORDER`` on, as an integer (last byte lowest)."""
    x = data.astype(np.uint32)
    out = x[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= x[ORDER - k : len(x) - k] << np.uint32(8 * k)
    return out


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=counts).astype(np.float64)


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
    return at, (keys[at] == x) if len(keys) else np.zeros(len(x), bool)


class Tree:
    """Frozen context tree of one language, as sorted arrays per order."""

    def __init__(self, windows: np.ndarray, counts: np.ndarray) -> None:
        self.levels = []
        for k in range(ORDER, -1, -1):
            mask = np.uint32(0xFFFFFFFF >> (8 * (ORDER - k)))
            grams, c = _sums(windows & mask, counts)
            contexts, total = _sums(grams >> np.uint32(8), c)
            _, different = _sums(grams >> np.uint32(8), np.ones(len(grams)))
            self.levels.append((mask, grams, c, contexts, total, different))

    def bits(self, windows: np.ndarray) -> np.ndarray:
        """Exact code length of the last byte of each window after the others."""
        out, left = np.zeros(len(windows)), np.arange(len(windows))
        for mask, grams, c, contexts, total, different in self.levels:
            w = windows[left] & mask
            at, seen = _find(contexts, w >> np.uint32(8))
            whole = np.where(seen, total[at] + different[at], 1.0)
            g, hit = _find(grams, w)
            out[left] += np.where(hit, np.log2(whole / c[g]), np.where(seen, np.log2(whole / np.where(seen, different[at], 1.0)), 0.0))
            left = left[~hit]
            if not len(left):
                return out
        out[left] += 8
        return out


@dataclass
class Model:
    """Trees by language, and the code lengths of all windows seen in training in an open-addressing table."""

    languages: list[str]
    trees: list[Tree]
    keys: np.ndarray = field(init=False)
    costs: np.ndarray = field(init=False)
    slots: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.keys = np.unique(np.concatenate([t.levels[0][1] for t in self.trees])) if self.trees else np.zeros(0, np.uint32)
        self.costs = np.stack([t.bits(self.keys) for t in self.trees], 1) if self.trees else np.zeros((0, 0))
        self.width = max(10, int(len(self.keys) * 4).bit_length())
        self.slots = np.full(1 << self.width, -1, np.int32)
        left, probe = np.arange(len(self.keys), dtype=np.int32), 0
        while len(left):
            at = self._slot(self.keys[left], probe)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left, probe = left[self.slots[at] != left], probe + 1
        self.probes = probe

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys * np.uint32(2654435769) >> np.uint32(32 - self.width)) + np.uint32(probe)) & np.uint32((1 << self.width) - 1)

    def lookup(self, windows: np.ndarray) -> np.ndarray:
        """Row of each window in the table, or -1."""
        at = self.slots[self._slot(windows, 0)]
        miss = np.flatnonzero((at >= 0) & (self.keys[np.maximum(at, 0)] != windows))
        for probe in range(1, self.probes):
            if not len(miss):
                break
            got = self.slots[self._slot(windows[miss], probe)]
            wrong = (got >= 0) & (self.keys[np.maximum(got, 0)] != windows[miss])
            at[miss] = np.where(wrong, -1, got)
            miss = miss[wrong]
        at[miss] = -1
        return at

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            data = _PAD + text
            for at in range(0, len(text), AT_ONCE):  # a piece starts with the bytes before it
                held.append((i, data[at : at + AT_ONCE + ORDER]))
                size += len(held[-1][1])
                if size >= AT_ONCE:
                    self._add(held, out)
                    held, size = [], 0
        if held:
            self._add(held, out)
        return out

    def _add(self, pieces: list[tuple[int, bytes]], out: np.ndarray) -> None:
        sizes = np.array([len(p) for _, p in pieces])
        windows = _windows(np.frombuffer(b"".join(p for _, p in pieces), np.uint8))
        # a window that spans two pieces belongs to neither
        starts = np.cumsum(sizes)[:-1]
        own = np.ones(len(windows), bool)
        for k in range(ORDER):
            own[starts - ORDER + k] = False
        windows = windows[own]
        doc = np.repeat(np.array([i for i, _ in pieces]), sizes - ORDER)
        at = self.lookup(windows)
        new = np.flatnonzero(at < 0)
        for k, tree in enumerate(self.trees):
            cost = self.costs[at, k]
            cost[new] = tree.bits(windows[new])
            first = pieces[0][0]
            bits = np.bincount(doc - first, weights=cost)
            out[first : first + len(bits), k] += bits

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a byte of each whole text."""
        raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        lettered = np.array([any(m[0].isalpha() for m in _LETTER.finditer(t or "")) for t in texts], bool)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        bits = self.code_lengths(raw)
        size = np.maximum([len(r) for r in raw], 1) if raw else np.ones(0)
        best = bits.argmin(axis=1) if len(texts) else np.zeros(0, int)
        least = bits.min(axis=1, keepdims=True) if len(texts) else np.zeros((0, 1))
        over = (bits - least) / np.maximum(size[:, None] / SCALE, 1)
        score = 1 / np.exp2(-np.minimum(over, 1000)).sum(axis=1)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0), least[:, 0] / size


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Context trees from about ``train_docs`` different labelled texts of each language.

    Windows are counted by the executors and summed by (language, window); what
    reaches the driver is bounded by the sample.
    """
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= TRAIN_CHARS)).select("lang", F.xxhash64("text").alias("h"), "text")
    # one number per language, as the model has one tree per language; copies count once
    different = labelled.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in different.limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")
    share = F.lit(0.0)
    if sizes:
        share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, train_docs / n)))[F.col("lang")]
    # a text's hash decides alone, so copies are in or out together
    picked = labelled.where(F.col("h") / F.lit(float(2**64)) + 0.5 <= share).select("lang", "text").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang").text:
                for t in texts:
                    data = np.frombuffer(_PAD + t.encode("utf-8", "surrogatepass").lower(), np.uint8)
                    for lo in range(0, len(data) - ORDER, AT_ONCE):
                        w, n = np.unique(_windows(data[lo : lo + AT_ONCE + ORDER]), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "w": w.astype(np.int64), "n": n})

    rows = picked.mapInPandas(count, "lang string, w long, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")).toPandas()
    groups = {lang: g for lang, g in rows.groupby("lang")}
    return Model(sorted(groups), [Tree(g.w.to_numpy().astype(np.uint32), g.n.to_numpy(dtype=np.float64)) for _, g in sorted(groups.items())])


def predict(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """``docs`` with prediction, score and bits a byte under ``names``; other columns stay (one of those names is replaced)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.select(*(c for c in docs.columns if c not in names))
    schema = StructType([*rest.schema.fields, StructField(names[0], StringType()), *(StructField(n, DoubleType()) for n in names[1:])])
    text = rest.columns.index("text")

    def run(batches: Iterator) -> Iterator:  # noqa: ANN401
        import pyarrow as pa

        for b in batches:
            lang, score, bits = held.value.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=[*b.schema.names, *names])

    return rest.mapInArrow(run, schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows outside the held-out fold: crc32 of the id as text is not 0 modulo 5 (a null id is held out)."""
    return docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(False)))


def keep_identified(docs: DataFrame, model: Model, languages: list[str] | None = None, least_score: float = LEAST_SCORE, most_bits: float = MOST_BITS) -> DataFrame:
    """The documents that the model puts in one of ``languages`` (all learned ones by default); a missing ``lang`` is filled in."""
    lang, score, bits = names = tuple(f"{c}_{uuid4().hex}" for c in ("lang", "score", "bits"))
    found = predict(docs, model, names).where((F.col(lang) != "und") & (F.col(score) >= least_score) & (F.col(bits) <= most_bits))
    if languages is not None:
        found = found.where(F.col(lang).isin(languages))
    return found.withColumn("lang", F.coalesce("lang", F.col(lang))).select(*docs.columns)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, learned from the folds that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), train(learnable(docs)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")

"""Vector quantization to 8, 4 or 1 bits.

The calibration-free quantizer flips signs by a seeded sequence, scales to unit
variance, codes against a fixed codebook and keeps one more bit on the residual.
The trained one codes linearly between each dimension's minimum and maximum.
Both score a full-precision query against codes.  Inputs are single precision,
arithmetic is double precision in NumPy over Arrow batches, and norms are stored
in single precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.graph import KnowledgeGraph
from graphloom.operators.vector import Vector, as_vector, dot, literal, matrix

#: Reconstruction levels for one and four bits, the range for eight, and the correction's constant.
LEVELS_1BIT = [-0.7979, 0.7979]
LEVELS_4BIT = [-2.7326, -2.0690, -1.6352, -1.2732, -0.9617, -0.6736, -0.3992, -0.1332, 0.1332, 0.3992, 0.6736, 0.9617, 1.2732, 1.6352, 2.0690, 2.7326]
RANGE_8BIT = 4.0
CORRECTION = 0.7978846
DEFAULT_SEED, SEED_STEP = 0xDEADBEEFCAFEBABE, 0x9E3779B97F4A7C15
#: Names, bits, and published expectations of the levels.
NAMES = {"int8": ["int8", "i8", "8bit"], "int4": ["int4", "i4", "4bit"], "binary": ["binary", "bin", "1bit"]}
INFO = [("int8", 8, 4.0, 0.0, "2-3x"), ("int4", 4, 8.0, 0.02, "4-6x"), ("binary", 1, 32.0, 0.05, "8-10x")]
BITS = {name: bits for name, bits, *_ in INFO}
TINY = 1e-10
QUANTIZED = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("original_norm", T.FloatType()), T.StructField("dims", T.IntegerType()), T.StructField("level", T.StringType()), T.StructField("qjl_bit", T.ByteType()), T.StructField("residual_norm", T.FloatType())])


class QuantizationError(ValueError):
    """A vector or training set that cannot be quantized; ``kind`` tells why."""

    def __init__(self, kind: str) -> None:
        super().__init__(kind)
        self.kind = kind


def parse_level(name: str, default: str = "int8") -> str:
    """The level of a name, whatever its case; unknown names give the default."""
    return next((level for level, names in NAMES.items() if str(name).lower() in names), default)


def signs(dims: int, seed: int) -> np.ndarray:
    """+-1 by the low bit (even: +1) of a 64-bit xorshift sequence."""
    mask, x, out = (1 << 64) - 1, seed or DEFAULT_SEED, np.ones(dims)
    for i in range(dims):
        x ^= x << 13 & mask
        x ^= x >> 7
        x ^= x << 17 & mask
        out[i] = -1 if x & 1 else 1
    return out


def projection(dims: int, seed: int) -> np.ndarray:
    """The residual's projection: the signs of a shifted seed."""
    return signs(dims, (seed + SEED_STEP) & ((1 << 64) - 1))


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes of rows to bytes: even dimension in the low nibble, least significant bit first."""
    if bits == 1:
        return np.packbits(codes.astype(np.uint8), axis=1, bitorder="little")
    if bits == 4:
        even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).astype(np.uint8)
        return even[:, ::2] | even[:, 1::2] << 4
    return codes.astype(np.uint8)


def unpack(data: np.ndarray, bits: int, dims: int) -> np.ndarray:
    if bits == 1:
        return np.unpackbits(data, axis=1, bitorder="little")[:, :dims]
    if bits == 4:
        return np.stack([data & 15, data >> 4], axis=2).reshape(len(data), 2 * data.shape[1])[:, :dims]
    return data


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added in the order of dimensions: equal rows have equal sums wherever they stand, which a matrix product does not promise."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


class FreeQuantizer:
    """Calibration-free quantizer of vectors of ``dims`` numbers."""

    def __init__(self, dims: int, level: str = "int8", seed: int = 0) -> None:
        self.dims, self.level, self.seed = dims, level, seed or DEFAULT_SEED
        self.bits = BITS[level]
        self.signs, self.projection = signs(dims, self.seed), projection(dims, self.seed)
        codebook = {1: LEVELS_1BIT, 4: LEVELS_4BIT, 8: -RANGE_8BIT + np.arange(256) * (2 * RANGE_8BIT / 255)}[self.bits]
        self.codebook = np.asarray(codebook, np.float64)

    def codes(self, t: np.ndarray) -> np.ndarray:
        if self.bits == 8:
            return np.floor((np.clip(t, -RANGE_8BIT, RANGE_8BIT) + RANGE_8BIT) / (2 * RANGE_8BIT) * 255 + 0.5)
        if self.bits == 4:
            return np.searchsorted((self.codebook[1:] + self.codebook[:-1]) / 2, t, side="left")
        return t >= 0

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, norms, residual bits and residual norms of rows; checks nothing."""
        x = np.asarray(x, np.float32).astype(np.float64)
        norm = np.sqrt(_sums(x * x))
        root = self.dims**0.5
        t = x * (root / norm)[:, None] * self.signs
        codes = self.codes(t)
        residual = t - self.codebook[codes.astype(np.int64)]
        bit = np.where(residual @ self.projection >= 0, 1, -1).astype(np.int8)
        return pack(codes, self.bits), norm, bit, np.sqrt((residual * residual).sum(axis=1)) * (norm / root)

    def similarity(self, data: np.ndarray, norm: np.ndarray, bit: np.ndarray, residual: np.ndarray, query: Vector) -> np.ndarray:
        """Cosine of codes with a full-precision query."""
        q = np.asarray(as_vector(query), np.float32).astype(np.float64)
        q_norm = np.sqrt(_sums((q * q)[None])[0])
        if len(q) != self.dims or q_norm < TINY:
            return np.zeros(len(data))
        root = self.dims**0.5
        main = _sums(self.codebook[unpack(data, self.bits, self.dims)] * (self.signs * q)) * (norm / root)
        if self.bits > 1:
            main = main + np.where(residual > TINY, bit * residual * ((q @ self.projection) / root) * CORRECTION, 0)
        return np.where(norm < TINY, 0, np.clip(main / (q_norm * np.maximum(norm, TINY)), -1, 1))

    def quantize(self, vector: Vector) -> dict:
        """One vector, checked."""
        x = np.asarray(as_vector(vector), np.float32)
        if len(x) != self.dims:
            raise QuantizationError("DimensionMismatch")
        if not np.isfinite(x).all():
            raise QuantizationError("InvalidVector")
        if np.sqrt((x * x).sum()) < TINY:
            raise QuantizationError("ConstantVector")
        data, norm, bit, residual = (a[0] for a in self.encode(x[None]))
        return {"data": data.tobytes(), "original_norm": float(norm), "dims": self.dims, "level": self.level, "qjl_bit": int(bit), "residual_norm": float(residual)}

    def cosine_similarity(self, quantized: dict, query: Vector) -> float:
        data = np.frombuffer(quantized["data"], np.uint8)[None]
        one = lambda k: np.array([quantized[k]], np.float64)
        return float(self.similarity(data, one("original_norm"), one("qjl_bit"), one("residual_norm"), query)[0])


def _usable(v: pa.Array, dims: int, least: float = TINY) -> tuple[np.ndarray, np.ndarray]:
    """Which lists are vectors of ``dims`` finite numbers and not below ``least``, and those as a matrix."""
    ok, x = matrix(v, dims)
    with np.errstate(over="ignore", invalid="ignore"):
        x = x.astype(np.float32).astype(np.float64)
        good = np.isfinite(x).all(axis=1) & (np.sqrt((x * x).sum(axis=1)) >= least)
    ok[ok] = good
    return ok, x[good]


def _bytes(data: np.ndarray, ok: np.ndarray) -> pa.Array:
    """Rows of bytes where ``ok``, null elsewhere."""
    at = np.concatenate([[0], np.cumsum(ok)]) * data.shape[1]
    bits = pa.py_buffer(np.packbits(ok, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(ok), [bits, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _spread(values: object, ok: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A value per row where ``ok``, null elsewhere."""
    out = np.zeros(len(ok), kind.to_pandas_dtype())
    out[ok] = values
    return pa.array(out, kind, mask=~ok)


def _stored(quantized: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which structs hold codes of ``width`` bytes, those codes as a matrix, and the structs themselves."""
    ok = np.array([d is not None and len(d) == width for d in quantized.field("data").to_pylist()], bool) & quantized.is_valid().to_numpy(zero_copy_only=False)
    kept = quantized.filter(pa.array(ok))
    return ok, np.frombuffer(b"".join(kept.field("data").to_pylist()), np.uint8).reshape(len(kept), width), kept


def _floats(kept: pa.Array, name: str) -> np.ndarray:
    return kept.field(name).to_numpy(zero_copy_only=False).astype(np.float64)


def encode(df: DataFrame, dims: int, level: str = "int8", seed: int = 0, column: str = "embedding", to: str = "quantized") -> DataFrame:
    """``df`` with a column of codes; null for vectors of another length, zero, or not finite."""
    quantizer = FreeQuantizer(dims, parse_level(level), seed)

    @F.arrow_udf(QUANTIZED)
    def run(v: pa.Array) -> pa.Array:
        ok, x = _usable(v, dims)
        data, norm, bit, residual = quantizer.encode(x)
        level = pa.array(np.full(len(ok), quantizer.level, object), pa.string(), mask=~ok)
        parts = [_bytes(data, ok), _spread(norm, ok, pa.float32()), _spread(dims, ok, pa.int32()), level, _spread(bit, ok, pa.int8()), _spread(residual, ok, pa.float32())]
        return pa.StructArray.from_arrays(parts, QUANTIZED.names)

    out = df.withColumn(to, run(F.col(column).cast("array<float>")))
    return out.withColumn(to, F.when(F.col(f"{to}.data").isNotNull(), F.col(to)))


def score(df: DataFrame, query: Vector, level: str = "int8", seed: int = 0, column: str = "quantized", to: str = "similarity") -> DataFrame:
    """``df`` with the cosine of the codes of :func:`encode` with a query of their length; null without codes."""
    q = as_vector(query)
    quantizer = FreeQuantizer(len(q), parse_level(level), seed)

    @F.arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        ok, data, kept = _stored(v, -(-len(q) * quantizer.bits // 8))
        return _spread(quantizer.similarity(data, *(_floats(kept, c) for c in ("original_norm", "qjl_bit", "residual_norm")), q), ok, pa.float64())

    return df.withColumn(to, run(column))


def quantized_search(graph: KnowledgeGraph, query: Vector, k: int = 10, level: str = "int8", seed: int = 0) -> DataFrame:
    """Top-k by the similarity of codes: ``entity_id, entity_name, entity_type, similarity, quantization_level, compression_ratio``.

    Vectors of another length, zero or not finite are left out; an empty query
    or ``k <= 0`` gives no rows; an unknown level is int8.
    """
    q, level = as_vector(query), parse_level(level)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(f"entity_{c}" if c == "name" else c)
    rows = graph.entities.where(F.col("embedding").isNotNull())
    quantizer = FreeQuantizer(len(q), level, seed)

    @F.arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        ok, x = _usable(v, len(q))
        return _spread(quantizer.similarity(*quantizer.encode(x), q), ok, pa.float64())

    scored = rows.select(F.col("id").alias("entity_id"), blank("name"), blank("entity_type"), run(F.col("embedding").cast("array<float>")).alias("similarity")).where(F.col("similarity").isNotNull())
    if not q or k <= 0:
        scored = scored.where("false")
    return scored.orderBy(F.desc("similarity"), "entity_id").limit(max(k, 0)).select("*", F.lit(level).alias("quantization_level"), F.lit(32.0 / BITS[level]).alias("compression_ratio"))


def search_recall(entities: DataFrame, queries: Column, k: int = 10, level: str = "int8", seed: int = 0, block: int = 4096) -> DataFrame:
    """One row ``recall``: that of ``quantized_search`` for the rows where ``queries`` holds, in blocks of them against blocks of all rows."""
    rows = entities.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    asked = rows.where(queries)
    n, m = (max(-(-df.count() // block), 1) for df in (rows, asked))
    # both sides' keys of one type: groups of unlike types are hashed to different partitions and never meet
    dealt = lambda df, own, of, to, times: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")).withColumn(to, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))

    def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(q):
            x = x.sort_values("id")
            dims, ids = len(q.embedding.iloc[0]), x.id.to_numpy()
            if any(len(v) != dims for v in [*x.embedding, *q.embedding]):
                raise ValueError("a stored vector has another length than the query")
            v = np.stack(x.embedding.to_list()).astype(np.float64)
            norms = np.sqrt((v * v).sum(axis=1))
            ok, usable = _usable(pa.array(x.embedding, pa.list_(pa.float32())), dims)
            quantizer = FreeQuantizer(dims, level, seed)
            codes = quantizer.encode(usable) if ok.any() else None
            for i, e in zip(q.id, q.embedding, strict=True):
                e = np.asarray(e, np.float64)
                size = norms * np.sqrt((e * e).sum())
                exact = np.divide((v * e).sum(axis=1), size, out=np.zeros(len(v)), where=size > 0)
                scores = [("exact", ids, exact)]
                if codes is not None:
                    scores.append(("codes", ids[ok], np.asarray(quantizer.similarity(*codes, e.tolist()), np.float64)))
                for kind, of, score in scores:
                    of, score = of[~np.isnan(score)], score[~np.isnan(score)]
                    top = np.argsort(-score, kind="stable")[:k]
                    out += [(kind, i, int(of[j]), float(score[j])) for j in top]
        return pd.DataFrame(out, columns=["kind", "query_id", "entity_id", "score"])

    left = dealt(rows, "r", n, "c", m).groupBy("r", "c")
    right = dealt(asked, "c", m, "r", n).groupBy("r", "c")
    best = left.cogroup(right).applyInPandas(run, "kind string, query_id long, entity_id long, score double")
    rank = F.row_number().over(Window.partitionBy("kind", "query_id").orderBy(F.desc("score"), "entity_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    hit = best.groupBy("query_id", "entity_id").agg(F.max((F.col("kind") == "exact").cast("int")).alias("e"), F.max((F.col("kind") == "codes").cast("double")).alias("hit"))
    return hit.where("e = 1").agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("recall"))


@dataclass
class TrainedQuantizer:
    """Linear codes between the smallest and largest value of each dimension."""

    level: str
    mins: np.ndarray | None = None
    maxs: np.ndarray | None = None

    @property
    def is_trained(self) -> bool:
        return self.mins is not None

    @property
    def compression_ratio(self) -> float:
        return 32.0 / BITS[self.level]

    def size_bytes(self, dims: int) -> int:
        """Bytes of the codes of ``dims`` numbers."""
        return -(-dims * BITS[self.level] // 8)

    def _ready(self) -> None:
        if not self.is_trained:
            raise QuantizationError("NotTrained")

    def fit(self, df: DataFrame, column: str = "embedding") -> TrainedQuantizer:
        """Ranges over all rows: one partially aggregated row per dimension."""
        v = df.where(F.col(column).isNotNull()).select(F.col(column).cast("array<float>").alias("v"))
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        sizes = v.agg(F.min(F.size("v")), F.max(F.size("v")), F.max(bad)).head()
        if sizes[0] is None or sizes[1] == 0:
            raise QuantizationError("EmptyInput")
        if sizes[0] != sizes[1]:
            raise QuantizationError("DimensionMismatch")
        if sizes[2]:
            raise QuantizationError("InvalidVector")
        rows = sorted(train_ranges(v, "v").collect())  # one row per dimension
        self.mins = np.array([r[1] for r in rows], np.float32)
        self.maxs = np.array([r[2] for r in rows], np.float32)
        self.maxs = np.where(self.maxs - self.mins == 0, self.mins + np.float32(1e-6), self.maxs)
        return self

    def codes(self, x: np.ndarray) -> np.ndarray:
        self._ready()
        x = np.asarray(x, np.float32).astype(np.float64)
        if x.shape[-1] != len(self.mins):
            raise QuantizationError("DimensionMismatch")
        if not np.isfinite(x).all():
            raise QuantizationError("InvalidVector")
        low, high = self.mins.astype(np.float64), self.maxs.astype(np.float64)
        if BITS[self.level] == 1:
            return x >= (low + high) / 2
        top = 2 ** BITS[self.level] - 1
        return np.clip(np.floor((x - low) / (high - low) * top + 0.5), 0, top)

    def quantize(self, vector: Vector) -> dict:
        x = np.asarray(as_vector(vector), np.float32)
        data = pack(self.codes(x[None]), BITS[self.level])[0]
        return {"data": data.tobytes(), "norm": float(np.sqrt((x * x).sum())), "dims": len(x)}

    def dequantize(self, codes: np.ndarray) -> np.ndarray:
        self._ready()
        low, high = self.mins.astype(np.float64), self.maxs.astype(np.float64)
        if BITS[self.level] == 1:
            middle = (low + high) / 2
            return np.where(codes > 0, (middle + high) / 2, (low + middle) / 2)
        return low + codes / (2 ** BITS[self.level] - 1) * (high - low)

    def decode(self, quantized: dict) -> np.ndarray:
        return self.dequantize(unpack(np.frombuffer(quantized["data"], np.uint8)[None], BITS[self.level], quantized["dims"])[0])

    def dot_product(self, quantized: dict, query: Vector) -> float:
        q = np.asarray(as_vector(query), np.float32)
        return float(self.decode(quantized) @ q) if len(q) == quantized["dims"] else 0.0

    def cosine_distance(self, quantized: dict, query: Vector) -> float:
        q = np.asarray(as_vector(query), np.float32)
        norm = float(np.sqrt((q * q).sum()))
        if len(q) != quantized["dims"] or norm < TINY or quantized["norm"] < TINY:
            return 1.0
        return 1.0 - min(1.0, max(-1.0, self.dot_product(quantized, query) / (norm * quantized["norm"])))

    def cosine_similarity(self, quantized: dict, query: Vector) -> float:
        return 1.0 - self.cosine_distance(quantized, query)

    def encode(self, df: DataFrame, column: str = "embedding", to: str = "quantized") -> DataFrame:
        """``df`` with a struct of ``data, norm, dims``; null for vectors that cannot be coded."""
        self._ready()

        dims = len(self.mins)

        @F.arrow_udf("struct<data:binary,norm:float,dims:int>")
        def run(v: pa.Array) -> pa.Array:
            ok, x = _usable(v, dims, 0.0)
            norm = np.sqrt((x * x).sum(axis=1))
            return pa.StructArray.from_arrays([_bytes(pack(self.codes(x), BITS[self.level]), ok), _spread(norm, ok, pa.float32()), _spread(dims, ok, pa.int32())], ["data", "norm", "dims"])

        out = df.withColumn(to, run(F.col(column).cast("array<float>")))
        return out.withColumn(to, F.when(F.col(f"{to}.data").isNotNull(), F.col(to)))

    def score(self, df: DataFrame, query: Vector, column: str = "quantized", to: str = "score") -> DataFrame:
        """``df`` with a struct of ``dot_product, cosine_distance`` of the codes of :meth:`encode` with a query; null without codes."""
        self._ready()
        q, dims, bits = np.asarray(as_vector(query), np.float32).astype(np.float64), len(self.mins), BITS[self.level]
        size = np.sqrt((q * q).sum())

        @F.arrow_udf("struct<dot_product:double,cosine_distance:double>")
        def run(v: pa.Array) -> pa.Array:
            ok, data, kept = _stored(v, self.size_bytes(dims))
            norm = _floats(kept, "norm")
            dot = self.dequantize(unpack(data, bits, dims)) @ q if len(q) == dims else np.zeros(len(kept))
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = np.where((norm < TINY) | (size < TINY) | (len(q) != dims), 0.0, np.clip(dot / (size * norm), -1, 1))
            return pa.StructArray.from_arrays([_spread(dot, ok, pa.float64()), _spread(1 - cosine, ok, pa.float64())], ["dot_product", "cosine_distance"])

        out = df.withColumn(to, run(column))
        return out.withColumn(to, F.when(F.col(f"{to}.dot_product").isNotNull(), F.col(to)))


def train_ranges(df: DataFrame, column: str = "embedding") -> DataFrame:
    """``dim, lo, hi`` over all rows."""
    return df.select(F.posexplode(column).alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def quantize_info(spark) -> DataFrame:  # noqa: ANN001
    """The levels: ``name, bits_per_value, compression_ratio, expected_recall_loss, expected_speedup, is_default``."""
    rows = [(*r, r[0] == "int8") for r in INFO]
    return spark.createDataFrame(rows, "name string, bits_per_value int, compression_ratio double, expected_recall_loss double, expected_speedup string, is_default boolean")


def simple_int8(df: DataFrame, ranges: DataFrame, query: Vector, column: str = "embedding") -> DataFrame:
    """``df`` with ``distance``: int8 between broadcast ranges (a row per dimension), norm of the decoded vector."""
    r = sorted(ranges.collect())
    lo, width = literal([x[1] for x in r]), literal([(x[2] - x[1]) or 1e-6 for x in r])
    q = as_vector(query)
    code = F.zip_with(F.zip_with(F.col(column).cast("array<double>"), lo, lambda a, b: a - b), width, lambda a, w: F.floor(F.least(F.greatest(a / w * 255.0, F.lit(0.0)), F.lit(255.0)) + 0.5) / 255.0 * w)
    decoded = F.zip_with(code, lo, lambda a, b: a + b)
    norm = sum(a * a for a in q) ** 0.5
    return df.withColumn("distance", 1 - dot(decoded, literal(q)) / (F.sqrt(dot(decoded, decoded)) * norm + 1e-10))

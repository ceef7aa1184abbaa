"""Token-id files: one zstandard dictionary, every document compressed on its own.

File format (a Parquet container, so that any Hadoop store can hold it):

* ``dictionary``: one row ``dict_hash string, dictionary binary``;
* ``blocks``: rows ``part int, block long, min_id long, max_id long, n_tokens
  long, dict_hash string, index binary, payload binary``, in row groups of a few
  blocks.  ``payload`` is the concatenation of one
  zstandard frame per document, each compressed against the shared dictionary;
  ``index`` holds ``(int64 doc_id, uint64 offset, uint32 size, uint64 ids)`` per
  document, little-endian, and a null mask byte for the id.  A document is found
  by the blocks' least and largest ids (null ids are in neither), which prune the
  scan, and read by seeking to its offset: no neighbour is decompressed;
* ``places``: ``part int, block long, start long``: the ids before each block.

Parts and blocks follow ascending ``doc_id`` (null first, ties by the ids'
checksum).  Null text is an empty text; an empty text is the end id alone; an
empty table gives an empty file set.  Extra columns of ``documents`` are ignored
and repeated rows are written as often as they occur.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.tokens import default_path, encoder
from graphloom.plans.shared import shared_dir, stage

#: Documents that the dictionary is trained on, at most; runs of a longer document that training sees, spread over all of it, and bytes of each.
SAMPLE_DOCS, SAMPLE_RUNS, SAMPLE_BYTES, DICT_BYTES, LEVEL = 1000, 8, 2048, 65_536, 3
#: A block is closed once it holds so many compressed bytes or documents.
BLOCK_BYTES, BLOCK_DOCS = 4_000_000, 4096
#: Bytes of a row group of the blocks' table.
GROUP_BYTES = 8_000_000
_ENTRY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("size", "<u4"), ("ids", "<u8")])
_BLOCKS = "part int, block long, min_id long, max_id long, n_tokens long, dict_hash string, index binary, payload binary"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long, dict_hash string"


@dataclass(frozen=True)
class TokenFiles:
    """Paths of a written file set."""

    path: str

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_BLOCKS).parquet(f"{self.path}/blocks")

    def places(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/places")

    def dictionary(self, spark: SparkSession) -> tuple[str, bytes]:
        row = spark.read.parquet(f"{self.path}/dictionary").head()
        return row["dict_hash"], bytes(row["dictionary"])


def spread(ids: bytes, runs: int = SAMPLE_RUNS, size: int = SAMPLE_BYTES) -> bytes:
    """``runs`` runs of ``size`` bytes at equal distances from the beginning to the end of longer ids, or all."""
    if len(ids) <= runs * size:
        return ids
    last = (len(ids) - size) // 4
    return b"".join([ids[4 * (last * k // (runs - 1)) :][:size] for k in range(runs)])


def train_dictionary(docs: DataFrame, path: str) -> tuple[str, bytes]:
    """A dictionary from the serialized ids of about ``SAMPLE_DOCS`` documents, spread evenly by hash.

    With too little to train on, the dictionary is empty and frames stand alone.
    """
    import zstandard

    n = docs.count()
    hashed = F.xxhash64("doc_id", "text")
    share = min(1.0, 2 * SAMPLE_DOCS / max(n, 1))
    picked = docs.select(hashed.alias("h"), "text").where(F.col("h") <= min(2**63 - 1, int((share - 0.5) * 2**64)))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b.h, "ids": list(map(spread, encoder(path).encode_all(b.text)))})

    rows = picked.mapInPandas(encode, "h long, ids binary").orderBy("h", "ids").limit(SAMPLE_DOCS).collect()
    samples = [bytes(r["ids"]) for r in rows]
    try:
        trained = zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 10), samples).as_bytes()
    except zstandard.ZstdError:
        trained = b""
    return hashlib.sha256(trained).hexdigest(), trained


def write_token_files(docs: DataFrame, folder: str | None = None, path: str | None = None) -> TokenFiles:
    """Encode every whole text once, compress it alone, and write blocks in ``doc_id`` order."""
    import zstandard

    spark, path = docs.sparkSession, path or default_path()
    files = TokenFiles(folder or f"{shared_dir(spark)}/token-files-{uuid4().hex}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dict_hash, dictionary = train_dictionary(docs, path)
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{files.path}/dictionary")

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_dict_id=False)
        for b in batches:
            rows = [(len(x) // 4, zlib.crc32(x), c.compress(x)) for x in encoder(path).encode_all(b.text)]
            yield pd.DataFrame(rows, columns=["ids", "crc", "frame"]).assign(doc_id=b.doc_id.astype("Int64"))

    framed = stage(docs.mapInPandas(compress, "doc_id long, ids long, crc long, frame binary"), "frames")

    def block_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, block, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pd.DataFrame:
            index = np.zeros(len(rows), _ENTRY)
            index["doc_id"], index["known"] = [r[0] or 0 for r in rows], [r[0] is not None for r in rows]
            index["size"], index["ids"] = [len(r[2]) for r in rows], [r[1] for r in rows]
            index["offset"] = np.cumsum(index["size"], dtype="u8") - index["size"]
            known = [r[0] for r in rows if r[0] is not None]
            ends = (known[0], known[-1]) if known else (None, None)
            row = (part, block, *ends, int(index["ids"].sum()), dict_hash, index.tobytes(), b"".join(r[2] for r in rows))
            return pd.DataFrame([row], columns=["part", "block", "min_id", "max_id", "n_tokens", "dict_hash", "index", "payload"]).astype({"min_id": "Int64", "max_id": "Int64"})

        for b in batches:
            for doc_id, ids, frame in zip(b.doc_id, b.ids, b.frame, strict=True):
                rows.append((None if pd.isna(doc_id) else int(doc_id), ids, frame))
                size += len(frame)
                if size >= BLOCK_BYTES or len(rows) >= BLOCK_DOCS:
                    yield close()
                    block, rows, size = block + 1, [], 0
        if rows:
            yield close()

    ordered = framed.repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    ordered.mapInPandas(block_up, _BLOCKS).write.option("parquet.block.size", GROUP_BYTES).parquet(f"{files.path}/blocks")
    sizes = stage(files.blocks(spark).select("part", "block", "n_tokens"), "block-sizes")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", before(Window.orderBy("part")).alias("base"))
    inside = sizes.select("part", "block", F.col("n_tokens").alias("n")).withColumn("start", before(Window.partitionBy("part").orderBy("block")))
    inside.join(parts, "part").select("part", "block", (F.col("base") + F.col("start")).alias("start")).write.parquet(f"{files.path}/places")
    return files


def _decompressor(dictionary: bytes):  # noqa: ANN202
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read_documents(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """One row per document as the files tell it: its place, length and checksum."""
    dict_hash, dictionary = files.dictionary(spark)
    if hashlib.sha256(dictionary).hexdigest() != dict_hash:
        raise ValueError("the dictionary does not match its hash")
    # read from its file, the small table's size is known and decides how it is joined
    blocks = files.blocks(spark).join(files.places(spark), ["part", "block"])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = _decompressor(dictionary)
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.dict_hash != dict_hash:
                    raise ValueError("a block was written with another dictionary")
                index = np.frombuffer(row.entries, _ENTRY)
                ids = index["ids"].astype("i8")
                crc = [zlib.crc32(d.decompress(row.payload[o : o + s])) for o, s in zip(index["offset"].tolist(), index["size"].tolist(), strict=True)]
                doc_id = pd.Series(index["doc_id"], dtype="Int64").mask(index["known"] == 0)
                yield pd.DataFrame({"doc_id": doc_id, "start": row.start + np.cumsum(ids) - ids, "n_tokens": ids, "ids_crc32": np.array(crc, "i8"), "dict_hash": dict_hash})

    return blocks.select("start", "dict_hash", F.col("index").alias("entries"), "payload").mapInPandas(decode, _DOCS)


def blocks_of(spark: SparkSession, files: TokenFiles, doc_ids: list[int]) -> DataFrame:
    """The blocks that may hold some of a few documents: a filter that reaches the scan."""
    held = F.lit(False)
    for i in doc_ids:
        held = held | ((F.col("min_id") <= i) & (F.col("max_id") >= i))
    return files.blocks(spark).where(held)


def read_ids(spark: SparkSession, files: TokenFiles, doc_ids: list[int]) -> dict[int, list[int]]:
    """Short-document access: ids of a few documents (of equal ids, one); only their blocks are read and only their frames decompressed."""
    _, dictionary = files.dictionary(spark)
    wanted = np.unique(np.array(doc_ids, np.int64))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = _decompressor(dictionary)
        for batch in batches:
            for index, payload in zip(batch["entries"], batch["payload"], strict=True):
                index = np.frombuffer(index, _ENTRY)
                index = index[index["known"] > 0]
                for e in index[np.isin(index["doc_id"], wanted)]:
                    ids = np.frombuffer(d.decompress(payload[int(e["offset"]) : int(e["offset"]) + int(e["size"])]), "<u4")
                    yield pd.DataFrame({"doc_id": [int(e["doc_id"])], "ids": [ids.astype("i8").tolist()]})

    rows = blocks_of(spark, files, wanted.tolist()).select(F.col("index").alias("entries"), "payload").mapInPandas(find, "doc_id long, ids array<long>").collect()
    return {r["doc_id"]: r["ids"] for r in rows}


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, written in the file format and described from what is read back."""
    return read_documents(spark, write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))

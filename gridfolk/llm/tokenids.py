"""Token ids in a compact binary format, and back.

Ids are replaced by their rank in the frequencies of the whole corpus, so
that common ids need one byte. A block of ranks is stored in two parts:

- ``control``: two bits for each rank (its bytes less one), four to a byte,
  the first in the lowest bits;
- ``data``: the bytes of the ranks, least significant first, one after the
  other.

A reader takes lengths from a table by control byte and gathers all ranks of
a block at once with numpy.

A written table (Parquet files of binary columns, committed by Spark) holds
blocks: ``part`` and ``block`` order them, ``part_start`` counts the ids of
earlier blocks of the part, ``doc_ids`` and ``counts`` list the block's
documents (a null id is stored as the smallest long, and comes first).
``part`` 0 holds the smallest document ids, and so on.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import importable, new_path, staged
from .tokens import encoder, public_tokenizer

#: Ids in a block, unless one document has more.
BLOCK_IDS = 1 << 19
#: Stands for a null document id in the files.
NO_ID = -(1 << 63)
#: For each control byte the lengths of its four ranks.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1

RAW = "part int, block int, part_start long, doc_ids binary, counts binary, ids binary"
RAW_NAMES = ["part", "block", "part_start", "doc_ids", "counts", "ids"]
RANKS = "rank int, id int"
CODED = "part int, block int, part_start long, doc_ids binary, counts binary, control binary, data binary"


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4", copy=False)
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    two_bits = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    two_bits[: len(ranks)] = size - 1
    fours = two_bits.reshape(-1, 4)
    control = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    octets = ranks.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), octets[np.arange(4) < size[:, None]].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    octets = np.frombuffer(data, np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    begins, out = ends - size, np.zeros(n, np.uint32)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] |= octets[begins[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_blocks(docs: DataFrame, path: str, kind: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of raw ids in ascending order of the key (nulls first), null text as empty."""

    def blocks(batches):
        enc = encoder(path, kind)
        part, block, start, size, held = TaskContext.get().partitionId(), 0, 0, 0, []

        def row():
            keys, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            octets = [keys.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), ids.astype("<u4").tobytes()]
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), *(pa.array([x], pa.binary()) for x in octets)], RAW_NAMES)

        for batch in batches:
            names = batch.column(0).fill_null(NO_ID).to_numpy()
            for a, b, ids, counts in enc.encode(batch.column(1), end_id):
                held.append((names[a:b], counts, ids))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield row()
                    block, start, size, held = block + 1, start + size, 0, []
        if held:
            yield row()

    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
    return rows.repartitionByRange(key).sortWithinPartitions(key, text).mapInArrow(blocks, RAW)


def frequency_ranks(blocks: DataFrame) -> np.ndarray:
    """ids in order of falling frequency in all blocks, ties by id. At most as many as the vocabulary has."""

    def counted(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                n = np.bincount(np.frombuffer(ids, "<u4"))
                if len(n) > len(total):
                    n, total = total, n
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    counts = blocks.select("ids").mapInPandas(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([x["id"] for x in sorted(counts, key=lambda x: (-x["n"], x["id"]))], np.uint32)


def rank_blocks(blocks: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """Blocks of raw ids to the file format."""
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def coded(batches):
        for batch in batches:
            both = [pack_ranks(rank_of[np.frombuffer(ids, "<u4")]) for ids in batch["ids"]]
            yield batch.drop(columns="ids").assign(control=[c for c, _ in both], data=[d for _, d in both])

    return blocks.mapInPandas(coded, CODED)


def write_token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, kind: str = "words", end_id: int = 1) -> str:
    """Encode whole texts and write the format to ``path`` (a new folder in the shared one by default), which is returned.

    ``path/blocks`` holds the blocks and ``path/ranks`` the ids by rank, so a
    reader needs nothing else. Every text is encoded once; raw ids stay in a
    staged table until the ranks are known. Empty and null texts hold only
    the end id; repeated rows are documents like any other (equal keys are
    ordered by text); documents with a null key come before all others; other
    columns are ignored; an empty table gives a table without blocks.
    """
    spark = docs.sparkSession
    importable(spark)
    path = path or new_path(spark)
    raw = staged(encode_blocks(docs, tokenizer or public_tokenizer("word_bpe_49k.json"), kind, end_id), "lz4")
    by_rank = frequency_ranks(raw)
    spark.createDataFrame(list(enumerate(by_rank.tolist())), RANKS).coalesce(1).write.parquet(f"{path}/ranks")
    rank_blocks(raw, by_rank).write.option("compression", "snappy").parquet(f"{path}/blocks")
    return path


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, the ids themselves."""
    importable(spark)
    files = spark.read.schema(CODED).parquet(f"{path}/blocks")
    # As many rows as the vocabulary has at most.
    by_rank = np.array([x["id"] for x in spark.read.schema(RANKS).parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    # One row for each part, which is a shuffle partition of the writer.
    sizes = files.select("part", "part_start", "counts").mapInPandas(_block_totals, "part int, n long")
    ends = sizes.groupBy("part").agg(F.max("n").alias("n"))
    begins, before = [], 0
    for part, n in ends.orderBy("part").collect():
        begins.append((part, before))
        before += n

    def decoded(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                counts = np.frombuffer(row.counts, "<u4").astype(np.int64)
                ids = by_rank[unpack_ranks(row.control, row.data, int(counts.sum()))].astype("<u4")
                ends = np.cumsum(counts)
                octets = memoryview(ids).cast("B")
                names = np.frombuffer(row.doc_ids, "<i8")
                out = {
                    "doc_id": pd.array(names, "Int64") if names[0] != NO_ID else pd.array([None if x == NO_ID else x for x in names.tolist()], "Int64"), "start": row.part_begin + row.part_start + ends - counts, "n_tokens": counts,
                    "ids_crc32": [zlib.crc32(octets[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)],
                }
                if with_ids:
                    out["ids"] = [ids[e - n : e].astype(np.int64) for e, n in zip(ends, counts, strict=True)]
                yield pd.DataFrame(out)

    offsets = F.broadcast(spark.createDataFrame(begins, "part int, part_begin long"))
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.join(offsets, "part").mapInPandas(decoded, kind)


def _block_totals(batches):
    for batch in batches:
        n = [int(np.frombuffer(x, "<u4").sum(dtype=np.int64)) for x in batch["counts"]]
        yield pd.DataFrame({"part": batch["part"], "n": batch["part_start"] + n})


def token_files(docs: DataFrame, tokenizer: str | None = None, kind: str = "words", end_id: int = 1) -> DataFrame:
    """Write the files and read them back, one row for each document."""
    return read_token_files(docs.sparkSession, write_token_files(docs, None, tokenizer, kind, end_id))

"""Length-delimited binary records of token ids, and an offset index beside them.

A record is framed as

    length      unsigned 64 bits, little-endian: bytes of the payload
    checksum    unsigned 32 bits: masked CRC-32 of the eight length bytes
    payload     one byte (1: a key follows, 0: the key is null), the key as a signed
                64-bit number, then the ids as unsigned 16-bit numbers, little-endian
    checksum    unsigned 32 bits: masked CRC-32 of the payload
    0x0A

The closing byte lets Spark's own text writer end each record, so files appear by its
commit protocol on any file system it can write, and a lost executor leaves none half
written. The index is a Parquet table: part, offset, length, key, number of ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinara.llm.batches import map_slices
from opinara.llm.tokenizing import encoder

MASK_DELTA = 0xA282EAD8  # fixed value of the mask
HEAD, HEAD_BYTES = "<QI", 12
KEY, KEY_BYTES = "<Bq", 9
ENDING = b"\n"
PART_BYTES = 32_000_000  # of text in a part, about
INDEX = "part long, offset long, length long, doc_id long, start_in_part long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted so that checksums of checksums are of use."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its closing byte."""
    length = struct.pack("<Q", len(payload))
    return b"".join(
        (length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)))
    )


def unframe(data, at: int) -> tuple[memoryview, int]:
    """Payload of the record at ``at`` and the place of the next; checks both checksums."""
    view = memoryview(data)
    length, check = struct.unpack_from(HEAD, view, at)
    if masked(view[at : at + 8]) != check:
        raise ValueError(f"record at {at}: its length is damaged")
    body = view[at + HEAD_BYTES : at + HEAD_BYTES + length]
    end = at + HEAD_BYTES + length
    (check,) = struct.unpack_from("<I", view, end)
    if len(body) != length or masked(body) != check or view[end + 4 : end + 5] != ENDING:
        raise ValueError(f"record at {at}: its payload is damaged")
    return body, end + 5


def payload(key: int | None, ids: bytes) -> bytes:
    return struct.pack(KEY, key is not None, key or 0) + ids


def parse(body) -> tuple[int | None, np.ndarray]:
    known, key = struct.unpack_from(KEY, body, 0)
    return (key if known else None), np.frombuffer(body, "<u2", offset=KEY_BYTES)


def write_records(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode every text, append ``end_id`` and write records in ascending key order.

    A null or empty text is the end id alone. Null keys come first, equal keys are
    ordered by a hash of the text. Rows are dealt by ranges of all that orders them, copies
    too, so a key or text of any number of rows is spread over parts, and each row weighs
    by its bytes, so no part holds more than a few times ``PART_BYTES`` and one text.
    """
    ending = struct.pack("<H", end_id)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pc.equal(batch.column(2), 0))
        ids, at = encoder(vocabulary).batch(batch.column(1))
        data = ids.astype("<u2").tobytes()
        frames = [
            frame(payload(k, data[2 * a : 2 * b] + ending))
            for k, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist())
        ]
        return pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 32
    facts = rows.agg(F.sum(size).alias("total"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, -(-(facts["total"] or 0) // PART_BYTES))
    step = max(1, 4 * (facts["total"] or 0) // max(1, facts["n"]))
    order = ["key", "digest", "row", "weight"]
    # a long text has more rows in the dealing, the first of them with the text; encode
    # drops the others, as Spark would move a filter here before the dealing
    weighed = rows.select(
        "key", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row"), "text", (size / step).cast("int").alias("more")
    ).select("key", "digest", "row", "text", F.explode(F.sequence(F.lit(0), "more")).alias("weight"))
    weighed = weighed.withColumn("text", F.when(F.col("weight") == 0, F.col("text")))
    dealt = weighed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    framed = map_slices(dealt.select("key", "text", "weight"), encode, "frame binary")
    framed.select(F.col("frame").cast("string").alias("value")).write.option(
        "lineSep", ENDING.decode()
    ).text(path)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """``(part, content)`` of every file; a part is about one shuffle partition."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = F.regexp_extract(F.col("path"), r"part-(\d+)[^/]*$", 1).cast("long")
    return files.select(number.alias("part"), "content")


def index_records(spark: SparkSession, path: str, index_path: str) -> None:
    """Read all files back, check every record and write the offset index."""

    def walk(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(data.as_buffer())
                rows, at, start = [], 0, 0
                while at < len(data):
                    body, after = unframe(data, at)
                    k, ids = parse(body)
                    rows.append((number, at, after - at, k, start, len(ids), id_checksum(ids)))
                    at, start = after, start + len(ids)
                names = ["part", "offset", "length", "doc_id", "start_in_part", "n_tokens", "ids_crc32"]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7
                yield pa.RecordBatch.from_arrays(columns, names=names)

    contents(spark, path).mapInArrow(walk, INDEX).write.parquet(index_path)


def id_checksum(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def record_table(spark: SparkSession, index_path: str) -> DataFrame:
    """One row per record with ``start``: the number of ids in all records before it."""
    index = spark.read.schema(INDEX).parquet(index_path)
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row per file, not per record
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return index.join(bases, "part").withColumn("start", F.col("base") + F.col("start_in_part"))


def read_shuffled(spark: SparkSession, path: str, index_path: str, seed: int) -> DataFrame:
    """Records in a seeded random order: ``(doc_id, ids)``, read at their offsets."""
    index = spark.read.schema(INDEX).parquet(index_path)
    wanted = index.groupBy("part").agg(F.collect_list(F.struct("offset", "length")).alias("places"))

    def pick(batches):
        for batch in batches:
            for data, places in zip(batch.column(0), batch.column(1).to_pylist()):
                data = memoryview(data.as_buffer())
                got = [parse(unframe(data, p["offset"])[0]) for p in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in got], pa.int64()), pa.array([v.astype("<i4") for _, v in got], pa.list_(pa.int32()))],
                    names=["doc_id", "ids"],
                )

    files = contents(spark, path).join(wanted, "part").select("content", "places")
    rows = files.mapInArrow(pick, "doc_id long, ids array<int>")
    return rows.orderBy(F.xxhash64(F.lit(seed), "doc_id", "ids"))

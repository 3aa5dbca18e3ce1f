"""Token ids in files of canonical length-limited Huffman codes.

A file (all numbers little-endian): MAGIC; u64 documents, tokens, blocks, vocabulary, bits; u8 code length
of each vocabulary id; i64 doc_id, u8 whether it is null (then it is 0; nulls come first), and u32 tokens of each document in ascending
doc_id; u64 bit offset of each block; the code bits, most significant first in bytes, with 4 bytes of padding. A block is BLOCK ids
and is decoded from its offset alone, so all blocks of a file are decoded side by side through one table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeforge.llm.common import Workspace
from tomeforge.llm.tokens import encoded, vocabulary_path, vocabulary_size

MAGIC, BLOCK, CHUNK = b"TFHUF2\0\0", 1024, 1 << 20
#: Longest code; 2**LIMIT codes must hold the vocabulary, and the decoding table has that many rows.
LIMIT = 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        packs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, packs])
        at = np.argsort(merged, kind="stable")
        level = merged[at]
        is_leaf.append(at < len(leaves))
    take, bits = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for flags in reversed(is_leaf):
        n = int(flags[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    out[order] = bits
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.argsort(lengths[used], kind="stable")].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def write_file(doc_ids: np.ndarray, null: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    codes, bits = canonical_codes(lengths), 0
    marks, words, carry = [], [], 0
    for a in range(0, len(ids), CHUNK):
        part = ids[a : a + CHUNK]
        n = lengths[part].astype(np.int64)
        at = np.cumsum(n) - n
        marks.append(bits + at[::BLOCK])
        at += bits % 32
        total = int(at[-1] + n[-1])
        value = codes[part] << (64 - (at & 31) - n).astype(np.uint64)
        word = at >> 5
        packed = np.bincount(word, (value >> np.uint64(32)).astype(float), total // 32 + 1)[: total // 32 + 1]
        low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(float), total // 32 + 2)
        packed = (packed + low[: len(packed)]).astype(np.uint64)
        packed[0] += np.uint64(carry)
        bits += int(n.sum())
        whole = total // 32
        words.append(packed[:whole].astype(">u4"))
        carry = int(packed[whole]) if total % 32 else 0
    words.append(np.array([carry, 0], ">u4"))
    block = np.concatenate(marks).astype("<u8") if marks else np.zeros(0, "<u8")
    head = struct.pack("<5Q", len(doc_ids), len(ids), len(block), len(lengths), bits)
    return b"".join([MAGIC, head, lengths.tobytes(), doc_ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), sizes.astype("<u4").tobytes(), block.tobytes(), *(w.tobytes() for w in words)])


def read_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, which are null, tokens of each, all ids) of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a file of this format")
    docs, tokens, blocks, vocabulary, _ = struct.unpack_from("<5Q", raw, 8)
    at = 48
    lengths = np.frombuffer(raw, np.uint8, vocabulary, at)
    doc_ids = np.frombuffer(raw, "<i8", docs, at := at + vocabulary)
    null = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs).astype(bool)
    sizes = np.frombuffer(raw, "<u4", docs, at := at + docs).astype(np.int64)
    place = np.frombuffer(raw, "<u8", blocks, at := at + 4 * docs).astype(np.int64)
    payload = np.frombuffer(raw, np.uint8, offset=at + 8 * blocks)
    limit = max(1, int(lengths.max(initial=0)))
    codes, used = canonical_codes(lengths), np.flatnonzero(lengths)
    first = (codes[used] << (limit - lengths[used].astype(np.uint64))).astype(np.int64)
    symbol, step = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.int64)
    order = used[np.argsort(first)]
    span = 1 << (limit - lengths[order].astype(np.int64))
    symbol[: int(span.sum())] = np.repeat(order, span)
    step[: int(span.sum())] = np.repeat(lengths[order].astype(np.int64), span)
    out = np.zeros((BLOCK, blocks), np.uint32)
    wide = payload.astype(np.uint32)
    window = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:] if len(wide) > 3 else wide
    last = tokens - (blocks - 1) * BLOCK
    lanes = blocks
    for i in range(BLOCK if blocks > 1 else last if blocks else 0):
        if i == last:
            lanes = blocks - 1
            place = place[:lanes]
        code = (window[place >> 3] >> (32 - limit - (place & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
        out[i, :lanes] = symbol[code]
        place = place + step[code]
    return doc_ids, null, sizes, out.T.reshape(-1)[:tokens]


def _encode(path: str, kind: str):
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33  # of a row in the table that is written: tells rows of one doc_id apart
        for batch in batches:
            for i, j, ids, off in encoded(batch.column(1), path):
                raw, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                parts = [raw[width * a : width * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(place + np.arange(j - i)), pa.array(np.diff(off)), pa.array(parts, pa.binary())], schema=schema)
                place += j - i

    return run


def _tally(size: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, kind)
                if len(ids) * 8 > size:
                    total += np.bincount(ids, minlength=size)
                else:
                    np.add.at(total, ids, 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return run


def _write(folder: str, lengths: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task, keys, null, sizes, ids = TaskContext.get(), [], [], [], []
        for batch in batches:
            keys.append(batch.column(0).fill_null(0).to_numpy())
            null.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            sizes.append(batch.column(1).to_numpy())
            ids.append(np.frombuffer(b"".join(batch.column(2).to_pylist()), kind))
        if not keys or not sum(map(len, keys)):
            return
        raw = write_file(np.concatenate(keys), np.concatenate(null), np.concatenate(sizes), np.concatenate(ids), lengths)
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():08d}.tfh"
        draft = f"{root}/_{name}.{task.taskAttemptId()}"  # an attempt that is lost leaves no part behind
        with system.open_output_stream(draft) as f:
            f.write(raw)
        system.move(draft, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sum(map(len, ids))]), pa.array([len(raw)])], names=["file", "tokens", "bytes"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            doc_ids, null, sizes, ids = read_file(raw.as_py())
            end = np.cumsum(sizes)
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((end - sizes).tolist(), end.tolist(), strict=True)]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]] * n), pa.array(doc_ids, mask=null), pa.array(end - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["file", "doc_id", "within", "n_tokens", "ids_crc32"])


def write_tokens(documents: DataFrame, folder: str, tokenizer: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes the ids of all documents to files in folder, in ascending doc_id over the files in order of name.

    Returns file, tokens, bytes of each file. A null or empty text is the end id alone; documents with a null doc_id come first
    and are marked in the format; rows of one doc_id are written each for itself, in the order of the table; an empty table writes no file.
    """
    spark, path = documents.sparkSession, tokenizer or vocabulary_path()
    ws, size = Workspace(spark, "huffman"), vocabulary_size(path)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = ws.save(docs.mapInArrow(_encode(path, kind), "doc_id long, place long, n long, ids binary"), "ids")
    counts = np.zeros(size, np.int64)
    for i, n in ids.select("ids").mapInArrow(_tally(size, kind), "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n  # at most one row for each id of the vocabulary
    lengths = code_lengths(counts, max(LIMIT, (size - 1).bit_length()))
    tokens = int(counts.sum())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // 4_000_000 + 1)
    ordered = ids.repartitionByRange(parts, "doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "n", "ids")
    return ws.save(ordered.mapInArrow(_write(folder, lengths, kind), "file string, tokens long, bytes long"), "files")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files, from the files alone."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tfh").load(folder).select("path", "content")
    ws = Workspace(spark, "huffman-read")
    rows = ws.save(raw.mapInArrow(_read, "file string, doc_id long, within long, n_tokens long, ids_crc32 long"), "rows")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # one row for each file
    before = totals.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the documents' ids to files in the shared folder and returns what the files hold.

    Edge cases are those of write_tokens; no file (an empty table) gives no rows.
    """
    spark = documents.sparkSession
    folder = Workspace(spark, "token-files").path("data")
    if not write_tokens(documents, folder, tokenizer).limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, folder)

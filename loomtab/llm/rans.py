"""Token-ID output: static range asymmetric numeral system.

A file holds segments of whole documents.  A segment has one static frequency table, shared by its
blocks; a block holds a fixed number of ids in interleaved lanes with one word stream, the lanes'
final states as its checkpoint and a checksum, so any block decodes by itself and all blocks of a
segment decode side by side.  A segment's last part lists its documents and their token counts.

Defined cases: null or empty text is the end id alone; null doc_ids are kept and come first; rows
with the same doc_id are kept, ordered by their text's hash; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_folder, pieces, written
from .files import create, open_at
from .tokens import encoder

BITS = 18  # precision of the frequency tables; at least the number of distinct ids
LANES = 32
BLOCK = 1 << 16  # ids in a block
SEGMENT = 4_000_000  # ids after which a segment ends, at a document's end
TOGETHER = 128  # blocks coded side by side
CHUNK_CHARS = 500_000
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIQQQ")
_BLOCK = struct.Struct("<III")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2**BITS, at least 1 for every id that occurs."""
    total = counts.sum()
    scaled = np.where(counts > 0, np.maximum(1, counts * (1 << BITS) // max(total, 1)), 0)
    spare = (1 << BITS) - int(scaled.sum())
    if spare >= 0:
        scaled[np.argmax(scaled)] += spare
    else:  # rare ids were raised to 1; the frequent ones give that back
        order = np.argsort(-scaled, kind="stable")
        for k in order:
            give = min(-spare, int(scaled[k]) // 2)
            scaled[k] -= give
            spare += give
            if not spare:
                break
    return scaled


def encode_blocks(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray, pad: int) -> Iterator[bytes]:
    """Blocks of ``ids`` (indexes into the table), in groups that are coded side by side."""
    shift = np.uint64(63 - BITS)
    for a in range(0, len(ids), BLOCK * TOGETHER):
        part = ids[a : a + BLOCK * TOGETHER]
        blocks = -(-len(part) // BLOCK)
        steps = BLOCK // LANES if blocks > 1 else -(-len(part) // LANES)
        size = steps * LANES
        grid = np.full(blocks * size, pad, np.int64)
        grid[: len(part)] = part
        grid = grid.reshape(blocks, steps, LANES)
        state = np.full((blocks, LANES), _LOW, np.uint64)
        words = np.zeros((blocks, size), np.uint32)
        room = np.full(blocks, size, np.int64)
        row = np.arange(blocks)[:, None]
        for t in range(steps - 1, -1, -1):
            f, c = freq[grid[:, t]], cum[grid[:, t]]
            over = state >= (f << shift)
            if over.any():
                many = over.sum(1)
                room -= many
                where = room[:, None] + np.cumsum(over, 1) - 1
                words[np.broadcast_to(row, over.shape)[over], where[over]] = (state[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                state[over] >>= np.uint64(32)
            q = state // f
            state = (q << np.uint64(BITS)) + (state - q * f) + c
        for b in range(blocks):
            n = min(size, len(part) - b * size)
            body = state[b].tobytes() + words[b, room[b] :].tobytes()
            yield _BLOCK.pack(n, len(body), zlib.crc32(body)) + body


def decode_blocks(raw: memoryview, total: int, freq: np.ndarray, cum: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; every block's checksum is verified."""
    slot = np.repeat(np.arange(len(freq)), freq.astype(np.int64))
    mask, bits = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    found, at = [], 0
    while at < len(raw):
        n, size, crc = _BLOCK.unpack_from(raw, at)
        body = raw[at + _BLOCK.size : at + _BLOCK.size + size]
        if zlib.crc32(body) != crc:
            raise ValueError("a block's checksum doesn't match")
        found.append((n, body))
        at += _BLOCK.size + size
    out = np.zeros(total, np.int64)
    done = 0
    for g in range(0, len(found), TOGETHER):
        group = found[g : g + TOGETHER]
        steps = max(-(-n // LANES) for n, _ in group) if len(group) == 1 else BLOCK // LANES
        state = np.stack([np.frombuffer(b, np.uint64, LANES) for _, b in group])
        streams = [np.frombuffer(b, np.uint32, offset=8 * LANES) for _, b in group]
        words = np.concatenate([*streams, np.zeros(LANES, np.uint32)])
        sizes = np.array([len(s) for s in streams], np.int64)
        next_word = np.cumsum(sizes) - sizes
        grid = np.zeros((len(group), steps, LANES), np.int64)
        for t in range(steps):
            low = state & mask
            s = slot[low.astype(np.int64)]
            grid[:, t] = s
            state = freq[s] * (state >> bits) + low - cum[s]
            under = state < _LOW
            if under.any():
                where = next_word[:, None] + np.cumsum(under, 1) - 1
                state[under] = (state[under] << np.uint64(32)) | words[where[under]]
                next_word += under.sum(1)
        for b, (n, _) in enumerate(group):
            out[done : done + n] = grid[b].reshape(-1)[:n]
            done += n
    if done != total:
        raise ValueError("a segment lacks ids")
    return out


def write_segment(out: io.RawIOBase, ids: np.ndarray, doc_ids: list, lengths: list[int]) -> int:
    """Append one segment; its length in bytes."""
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    freq = frequencies(counts[used]).astype(np.uint64)
    cum = np.cumsum(freq) - freq
    table = zlib.compress(used.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    number = np.zeros(len(counts), np.int64)
    number[used] = np.arange(len(used))
    body = b"".join(encode_blocks(number[ids], freq, cum, int(np.argmax(freq))))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    listed = zlib.compress(known.tobytes() + names.tobytes() + np.array(lengths, "<i8").tobytes(), 1)
    head = _HEAD.pack(b"LRS1", len(table), len(listed), len(body), len(ids), len(doc_ids))
    for part in (head, struct.pack("<I", zlib.crc32(head + table + listed)), table, listed, body):
        out.write(part)
    return len(head) + 4 + len(table) + len(listed) + len(body)


def read_segment(raw: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    """The ids, doc_ids and token counts of one segment."""
    magic, n_table, n_listed, n_body, n_ids, n_docs = _HEAD.unpack_from(raw)
    view = memoryview(raw)
    at = _HEAD.size + 4
    if magic != b"LRS1" or zlib.crc32(bytes(view[: _HEAD.size]) + bytes(view[at : at + n_table + n_listed])) != struct.unpack_from("<I", raw, _HEAD.size)[0]:
        raise ValueError("not a segment, or its head is damaged")
    table = np.frombuffer(zlib.decompress(view[at : at + n_table]), "<u4")
    used, freq = table[: len(table) // 2], table[len(table) // 2 :].astype(np.uint64)
    listed = zlib.decompress(view[at + n_table : at + n_table + n_listed])
    known = np.frombuffer(listed, np.uint8, n_docs)
    names = np.frombuffer(listed, "<i8", n_docs, n_docs)
    lengths = np.frombuffer(listed, "<i8", n_docs, 9 * n_docs)
    at += n_table + n_listed
    ids = used[decode_blocks(view[at : at + n_body], n_ids, freq, np.cumsum(freq) - freq)]
    return ids, [int(d) if k else None for d, k in zip(names, known)], lengths


def write_tokens(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Encode all texts in ascending doc_id order into files under ``folder``.

    Returns the written manifest, one row per segment: part, segment, file, at, size, n_docs,
    n_tokens.  A task writes its file under a name of its own, and the manifest names the files of
    the tasks that succeeded, so a repeated task leaves at most an unlisted file behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        rows: list[tuple] = []
        held, names, lengths, size = [], [], [], 0
        file, out, at = None, None, 0

        def flush() -> None:
            nonlocal file, out, at, size
            if not names:
                return
            if out is None:
                file, out = create(folder, f"tokens-{part:06d}")
            n = write_segment(out, np.concatenate(held), names, lengths)
            rows.append((part, len(rows), file, at, n, len(names), size))
            at += n
            held.clear(), names.clear(), lengths.clear()
            size = 0

        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            ids, bounds = enc.encode(texts)
            docs_in = batch.column(0).to_pylist()
            first = 0
            for i in range(len(texts)):
                if size + bounds[i + 1] - bounds[first] >= SEGMENT or i == len(texts) - 1:
                    held.append(ids[bounds[first] : bounds[i + 1]])
                    names += docs_in[first : i + 1]
                    lengths += np.diff(bounds[first : i + 2]).tolist()
                    size += int(bounds[i + 1] - bounds[first])
                    first = i + 1
                    if size >= SEGMENT:
                        flush()
        flush()
        if out is not None:
            out.close()
        columns = zip(*rows) if rows else [[]] * 7
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["part", "segment", "file", "at", "size", "n_docs", "n_tokens"])

    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = hashed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    made = ordered.mapInArrow(run, "part int, segment int, file string, at long, size long, n_docs long, n_tokens long")
    return written(made, "manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 (and ids); segments are read in parallel."""
    # one row per file here; the running sum over segments goes file by file
    files = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = files.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    inner = manifest.withColumn("before", F.sum("n_tokens").over(W.partitionBy("part").orderBy("segment")) - F.col("n_tokens"))
    placed = inner.join(base, "part").select("file", "at", "size", (F.col("base") + F.col("before")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, names, lengths = read_segment(open_at(row["file"], row["at"], row["size"]))
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                out = [pa.array(names, pa.int64()), pa.array(row["start"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    segments = max(1, manifest.count())  # a few rows that name files; each names megabytes to read
    return placed.repartition(segments, "file", "at").mapInArrow(run, schema)


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    return read_tokens(write_tokens(docs, path, new_folder(docs.sparkSession, "tokens")))

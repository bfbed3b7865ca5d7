"""Helpers shared by the operators: shared folders, written intermediates, byte-level word splitting."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Reads ``spark.checkpoint.dir`` of the session.  Only in local mode, where that may be unset
    (tests), a temporary folder is made and set as the checkpoint folder of the context.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_loomtab_shared", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomtab-")
        spark._loomtab_shared = found
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage in storage that outlives any executor, so a lost executor costs the tasks
    that were running on it and nothing that was written before.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name built on ``wanted`` that ``df`` doesn't have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in have:
        name += "_"
    return name


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other code point stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: The white space of the contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def column_list(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches whose texts sum to about ``limit`` bytes (or one row), with the texts; null is empty.

    Only a slice's texts are Python strings at a time; what Arrow keeps for later goes back at the end.
    """
    for batch in batches:
        at = batch.schema.get_field_index(text)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)), dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            part = batch.slice(start, stop - start)
            yield part, [t or "" for t in part.column(at).to_pylist()]
            start = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


# --- hashing words on bytes -------------------------------------------------------------------

_P = 0x9E3779B97F4A7C15  # odd multiplier of the polynomial hash over bytes
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            take = min(done, size - done)
            have[done : done + take] = have[:take] * step
            done += take
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` for many spans at once, by prefix sums of a polynomial."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_P, len(data)), out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * _power_table(_P_INV, len(data) + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, lower-cased A-Z, split at the contracts' white space; and the words per text.

    Works on UTF-8 bytes; the white space and A-Z are single bytes there, so whole-text semantics hold.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACE[data]
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    counts = np.diff(np.searchsorted(starts, bounds))
    return span_hashes(data, starts, ends), counts


def shingle_hashes(texts: list[str], width: int) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its word shingles.

    Shorter texts have their whole word sequence as the one shingle; texts without words have none.
    """
    words, counts = word_hashes(texts)
    n = len(words)
    out: list[np.ndarray] = []
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width if n >= width else 0):
        rolled = mix(rolled + words[k : n - width + 1 + k] + np.uint64(k + 1))
    at = 0
    for c in counts.tolist():
        if c >= width:
            s = np.sort(rolled[at : at + c - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif c:
            one = np.full(1, c, np.uint64)
            for w in words[at : at + c]:
                one = mix(one * np.uint64(3) + w)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out

"""Helpers that several text operators need: tables, lineage cuts, span digests, stable hashing."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaybook.plans.lineage import settle

__all__ = ["settle"]

#: ASCII white space of the text contracts, as a character class body for Java and Python patterns.
WHITE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the tables below ``sf_dir`` through Spark's own reader, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of text that go to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same frame, after making sure that the session sends rows to Python workers in small batches.

    Texts can be very long, and a batch of the usual ten thousand of them is held several times over.  Both bounds are settings of the
    session that are read when a job runs, later than this, so they stay; smaller ones are left as they are.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = conf.get(name).lower().removesuffix("b")
        if not (held.isdecimal() and 0 < int(held) <= most):
            conf.set(name, str(most))
    return df


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def one_label(labels: DataFrame, column: str, name: str) -> DataFrame:
    """``(doc_id, name)``: one 0/1 label for each non-null id; where repeated rows disagree the larger one holds."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    return usable.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias(name))


def with_words(df: DataFrame, text: str = "text", name: str = "__qb_words") -> DataFrame:
    """Add the array of words, runs of characters other than ASCII white space; a null text has none."""
    pieces = F.split(F.coalesce(F.col(text), F.lit("")), f"[{WHITE}]+")
    return df.withColumn(name, F.filter(pieces, lambda w: w != ""))


def span_list(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc32_of_ids(ids: bytes) -> int:
    """crc32 over ids already laid out as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids) & 0xFFFFFFFF


def _bounds(batch: pa.RecordBatch | pa.Table, keys: int) -> np.ndarray:
    """Where runs of rows with equal first ``keys`` columns begin, and the number of rows at the end."""
    change = np.zeros(max(batch.num_rows - 1, 0), bool)
    for i in range(keys):
        c = batch.column(i).to_numpy() if isinstance(batch, pa.Table) else batch.column(i).to_numpy(zero_copy_only=False)
        change |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs from rows sorted by their first ``keys`` columns, with the runs' bounds.

    A run that may go on is held back, so no more than a batch and one run are in memory.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[-1].column(i)[-1] == batch.column(i)[0] for i in range(keys)):
            first = int(_bounds(batch, keys)[1])
            if first == batch.num_rows:
                held.append(batch)
                continue
            held.append(batch.slice(0, first))
            batch = batch.slice(first)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield table, _bounds(table, keys)
        last = int(_bounds(batch, keys)[-2])
        if last:
            table = pa.Table.from_batches([batch.slice(0, last)])
            yield table, _bounds(table, keys)
        held = [batch.slice(last)]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _bounds(table, keys)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes, order-sensitive; empty if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = mix64(words[:n] + _MIX)
        for j in range(1, width):
            out = mix64(out * np.uint64(3) + words[j : n + j])
    return out


#: A random odd-looking value for each byte, and powers for the positional sum below.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MIX)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers = {"n": 0, "up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]), dtype=np.uint64)
            _powers["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _INVERSE)]), dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def word_hashes(text: str | None, blanks: np.ndarray = _BLANK) -> np.ndarray:
    """64-bit hash of each word of a text, A-Z lower-cased, words split at ASCII white space or other given bytes."""
    return hashed_words(text.encode("utf-8", "surrogatepass"), blanks)[0] if text else np.empty(0, np.uint64)


def hashed_words(text: bytes, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of an UTF-8 text, and where in bytes each begins and ends.

    Works on the bytes at once, without a Python object for each word.
    """
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    blank = blanks[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    if not len(edge):
        return np.empty(0, np.uint64), edge
    first, last = edge[::2], edge[1::2]
    up, down = _power_tables(len(raw))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)])
        return mix64((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _MIX), edge

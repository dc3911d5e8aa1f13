"""Helpers shared by the operators: staged tables, text buffers, vectorised hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from presswork.session import scratch_path

# Texts are worked on in slices of about this many bytes, so the memory of a
# task follows the longest text, not the size of an Arrow batch.
SLICE_BYTES = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back; ``options`` are the writer's.

    It cuts the lineage: a lost executor costs the running stage, nothing before it.
    What was shuffled for it is removed as soon as it is written.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


# -- text buffers -------------------------------------------------------------

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and the offsets of each; null is empty."""
    array = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes; a longer text is a slice of its own."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last
        first = last


# -- hashes -------------------------------------------------------------------

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, _U), _INVERSE: np.ones(1, _U)}


def fmix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def powers(base: int, count: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``count``."""
    have = _powers[base]
    if len(have) < count:
        size = 1 << (count - 1).bit_length()
        grown = np.full(size, base, _U)
        grown[0] = 1
        np.multiply.accumulate(grown, out=grown)
        have = _powers[base] = grown
    return have[:count]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``; ``span_hash`` reads spans from them."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of each span ``[start, end)``, the same wherever the span stands."""
    inverse = powers(_INVERSE, len(prefix))
    return fmix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(_U))


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

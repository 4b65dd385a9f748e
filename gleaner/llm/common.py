"""Helpers shared by the operators: shared storage, sizing, packing and hashing."""

from __future__ import annotations

import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Spark and Java form of the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or one of our own where none is named (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        import tempfile

        at = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="gleaner-")
        _OWN[spark.sparkContext.applicationId] = at
    return at


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage is cut and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/gleaner/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, so that clashing further columns of the input cannot matter."""
    return df.select(*(F.col(f"`{c}`").alias(name) for name, c in columns.items()))


def text_bytes(docs: DataFrame, column: str) -> int:
    return docs.select(F.sum(F.octet_length(F.col(column)).cast("long")).alias("n")).first()["n"] or 0


def parts_for(total: int, each: int, least: int = 8, most: int = 200_000) -> int:
    return int(min(most, max(least, -(-total // each))))


def mixed(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    size = 1 << max(16, int(n).bit_length())
    for (b, s), found in _POWERS.items():
        if b == base and s >= n + 1:
            return found
    inverse = pow(base, -1, 1 << 64)
    out = []
    for x in (base, inverse):
        a = np.ones(size, np.uint64)
        with np.errstate(over="ignore"):
            a[1:] = np.uint64(x)
            np.multiply.accumulate(a, out=a)
        out.append(a)
    _POWERS[base, size] = out[0], out[1]
    return out[0], out[1]


BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of values[start:end], mixed; values: numbers of any unsigned kind."""
    up, down = powers(base, len(values))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
        got = (sums[ends] - sums[starts]) * down[starts]
        got += (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mixed(got)


def gram_hashes(values: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
    """span_hashes of all runs of n values."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(values))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
        got = sums[n:] - sums[:m]
        got *= down[:m]
        got += np.uint64(n * 0xA24BAED4963EE407 % (1 << 64))
    return mixed(got)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes where one space parts words."""
    gaps = np.flatnonzero(data == 32)
    return np.concatenate([[0], gaps + 1]).astype(np.int64), np.concatenate([gaps, [len(data)]]).astype(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of x[i:i+width], by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have, m = 1, x
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[:n], m[width - have : width - have + n]) if have < width else m[:n]


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, lengths[i] items: the i of each item and its number within i."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return owner, np.arange(len(owner)) - np.repeat(first, lengths)


def pack(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays in one zstd frame."""
    import zstandard

    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(struct.pack(f"<{len(raw) + 1}q", len(raw), *map(len, raw)) + b"".join(raw))


def unpack(blob: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", raw)[0]
    sizes = struct.unpack_from(f"<{n}q", raw, 8)
    at, out = 8 * (n + 1), []
    for s in sizes:
        out.append(raw[at : at + s])
        at += s
    return out


#: Ids that are broadcast at most: some tens of MB.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, id: str, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id is in gone (one column); rows without an id stay. Up to BROADCAST_IDS ids are counted
    and broadcast, so that no text moves; more are joined by Spark's choice."""
    name = f"gone_{uuid.uuid4().hex}"
    gone = stored(gone.toDF(name).where(F.col(name).isNotNull()).distinct(), "gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(few, F.col(f"`{id}`") == F.col(name), "left_anti")

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only used where the session names no shared folder, as in tests.
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. A cluster must name one; a local session, as in tests, gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="inkrow-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(name: str, taken: list[str]) -> str:
    """name, with underscores in front as long as it is taken, whatever the case of its letters."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def remainder(column: Column | str, modulus: int) -> Column:
    """crc32 of the value as text, modulo: the folds of held-out rows. Null counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


def hash_of(column: Column | str) -> Column:
    """63-bit hash of a value, for samples that are the same in every run."""
    return F.xxhash64(column).bitwiseAND(F.lit(2**63 - 1))


def highest_hash(wanted: int, rows: int) -> int:
    """Highest hash_of in a sample of about wanted of so many rows; all of them if there are no more than that."""
    return (min(wanted, rows) << 63) // rows - 1


def slices(batches, rows: int = 500):
    """Record batches of at most so many rows, without copies. At the end the worker gives back what it no longer holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()


def trim() -> None:
    """Python workers outlive their tasks: free memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """run, a function on batches, with trim() once its own data are gone."""

    def outer(batches):
        yield from run(batches)
        trim()

    return outer


def text_array(column: pa.Array) -> pa.Array:
    """Null texts become empty ones. No cast here: Arrow's kernels misread the result of casting a slice to 64-bit offsets."""
    return pc.fill_null(column, "")


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space, A-Z lower-cased: (code of each word, where each text's words start and end, the distinct words)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = split.flatten().dictionary_encode()
    codes, offsets = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # white space at either end
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, offsets, coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between each two neighbouring offsets; empty stretches give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.workspace import ensure_checkpoint_dir, new_folder

#: ASCII white space; everything else belongs to a word.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_aside(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """The same rows; columns named as ``names``, or with ``_`` first, get names that nobody has."""
    taken, new = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.startswith("_") or c.lower() in names:
            free = f"held{c}"
            while free.lower() in taken:
                free = f"held{free}"
            taken.add(free.lower())
            new[c] = free
    return df.withColumnsRenamed(new) if new else df


def sheltered(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose own columns start with ``_``: the input's such columns pass under other names."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **settings) -> DataFrame:
        held = set_aside(docs)
        if held is docs:
            return operator(docs, *args, **settings)
        back = {new: old for new, old in zip(held.columns, docs.columns, strict=True) if new != old}
        return operator(held, *args, **settings).withColumnsRenamed(back)

    return run


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder: a lost executor repeats nothing before it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of an action go when it ends; later actions must not build on them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """The rows written as a compressed table below the checkpoint folder, and read again.

    What was shuffled for them is freed at once.
    """
    path = new_folder(df.sparkSession, "table")
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def tokenizer_folder(spark: SparkSession) -> str:
    """Where every machine of the cluster has the public vocabularies."""
    return spark.conf.get("spark.opinweave.tokenizers", "/opt/tokenizers")


def merged(df: DataFrame) -> DataFrame:
    """The rows of a union of exchanges in as many partitions as one exchange has."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bounded_batches(df: DataFrame) -> None:
    """Lets the session send texts to Python workers in batches of 4 MB instead of 64 MB.

    A batch is held twice by the executor's JVM and twice by the worker, for every core.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def word_count(text: str | Column) -> Column:
    """Words of a text; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def small_batches(
    batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of about ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        data = batch.column(batch.schema.get_field_index(column))
        ends = text_offsets(data)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_offsets(data: pa.Array) -> np.ndarray:
    """The offsets of a string or binary array into its buffer, one more than rows."""
    wide = pa.types.is_large_string(data.type) or pa.types.is_large_binary(data.type)
    kind = np.int64 if wide else np.int32
    if len(data) == 0:
        return np.zeros(1, np.int64)
    raw = np.frombuffer(data.buffers()[1], kind)
    return raw[data.offset : data.offset + len(data) + 1].astype(np.int64)


def text_bytes(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after another, and the offsets of the rows in them."""
    offsets = text_offsets(data)
    buffer = data.buffers()[2] if len(data) else None
    if buffer is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    raw = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]

"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from presswire.session import ship_package, work_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: of searches (all ASCII but lower-case letters and digits), and of counts (white space).
NOT_IN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WHITE_SPACE = r"[\x20\x09-\x0D]+"

#: Lower-cases A-Z and turns every other ASCII byte outside words into a space.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

#: Bytes of text handed to a function at once, so that a batch of long texts stays small.
SLICE_BYTES = 4 << 20


def folded_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text under `NOT_IN_WORDS`, A-Z lower-cased."""
    return text.translate(FOLD).split()


def search_words(text: Column) -> Column:
    """The same words as an array column; a null text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, NOT_IN_WORDS), "")


def count_words(text: Column) -> Column:
    """Words between white space as an array column; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts the lineage, and Spark knows its size."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder in the shared store; a plain path is a mounted one."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def pieces(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text each, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    docs: DataFrame,
    text: str,
    keep: list[str],
    fields: T.StructType,
    make: Callable[[], Callable[[list[bytes], pa.RecordBatch], list]],
) -> DataFrame:
    """The `keep` columns of `docs` plus `fields` worked out from each whole text.

    `make` is called once per task and gives a function from UTF-8 texts, and the batch with
    the kept columns they came in, to one list or Arrow array per field. A null text counts as empty. A kept column with the name of a
    field is replaced by the field. Rows never leave their partition.
    """
    names = [f.name for f in fields]
    kept = [c for c in keep if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + list(fields))
    arrow = [to_arrow_type(f.dataType) for f in fields]
    # a kept text travels once
    at = kept.index(text) if text in kept and docs.schema[text].dataType == T.StringType() else len(kept)
    body = [F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("__text")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], *(body if at == len(kept) else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            raw = batch.column(at).cast(pa.binary()).fill_null(b"")
            for a, b in pieces(raw):
                part = batch.slice(a, b - a)
                made = work(raw.slice(a, b - a).to_pylist(), part)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(kept)],
                     *(x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, arrow))],
                    names=[*kept, *names],
                )

    ship_package(docs.sparkSession)
    return source.mapInArrow(run, schema)

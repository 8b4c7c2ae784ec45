"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type


#: Rows of an Arrow batch that are worked on at once.
SLICE_ROWS = 1000


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it with its lineage cut.

    The folder is the one ``spark.checkpoint.dir`` names. Without that setting a session
    on one machine gets a temporary folder of its own; on a cluster that is an error, for
    other machines could not read it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def fresh(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores added until no column has it; case does not tell columns apart."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def hashed_share(rows: DataFrame, key: Column, bound: int) -> DataFrame:
    """About ``bound`` of ``rows``, chosen by a hash of ``key`` alone (all of them if fewer).

    The choice does not depend on partitioning or order. The row count needs no
    payload column, so the first pass reads the key column only.
    """
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < F.lit(int((1 << 30) * bound / n)))


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows``, so that only one part's values are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_columns(rows: DataFrame, inputs: Sequence[str], keep: Sequence[str], added: dict[str, pa.DataType], start: Callable[[], Callable[..., dict[str, object]]]) -> DataFrame:
    """Columns ``keep`` of ``rows`` as they are, and the columns ``added`` computed from ``inputs``.

    ``start`` runs once a task and returns a function from the lists of the inputs'
    values (None for null) to the added columns. Kept columns pass through in Arrow,
    whatever their types and nulls; no shuffle. A kept column gives way to an added one
    of the same name.
    """
    new = {n.lower() for n in added}
    keep = [c for c in keep if c.lower() not in new]
    wanted = list(dict.fromkeys([*keep, *inputs]))
    place = {name: i for i, name in enumerate(wanted)}
    kinds = list(added.items())
    # plain names inside, for Arrow functions take no names with dots
    fields = [T.StructField(f"k{i}", rows.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType(fields + [T.StructField(f"a{i}", from_arrow_type(t)) for i, (_, t) in enumerate(kinds)])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for whole in batches:
            for batch in slices(whole):
                found = work(*[batch.column(place[c]).to_pylist() for c in inputs])
                arrays = [batch.column(place[c]) for c in keep] + [pa.array(found[n], type=t) for n, t in kinds]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    plain = rows.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(wanted)])
    return plain.mapInArrow(run, schema).toDF(*keep, *added)

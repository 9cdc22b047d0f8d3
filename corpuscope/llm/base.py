"""What the operators share: reading tables, keys of rows, and plain word columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from corpuscope.session import ensure_checkpoint_dir, ship_package

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: rows up to which a counted side may be broadcast; a physical choice only, both ways give the same rows
BROADCAST_ROWS = 200_000
ONE_FILE_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One small file would keep a whole stage on one core, so its rows are dealt out; larger tables come as they are."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if len(table.inputFiles()) == 1 and int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < ONE_FILE_BYTES:
        return table.repartition(spark.sparkContext.defaultParallelism)
    return table


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; a text of ASCII only takes the faster built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_UPPER.lower()))


def text_of(docs: DataFrame) -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def row_key(docs: DataFrame) -> Column:
    """Identity of a document: its id and text. Rows equal in both are one document and get equal results."""
    return F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"))


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """``_key``, ``_id``, ``_text`` of every row, and the ``extra`` columns; others are left out, so that no name of the input can clash."""
    return docs.select(row_key(docs).alias("_key"), docs["doc_id"].alias("_id"), text_of(docs).alias("_text"), *(docs[c] for c in extra))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Counts at most ``rows + 1`` rows."""
    return df.limit(rows + 1).count() <= rows


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, compressed and read back; it survives lost executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread_by: Column, salts: int = 16) -> DataFrame:
    """Inner join with a side of one row per key: a key with a large share of ``many`` is spread over ``salts`` tasks."""
    left = many.withColumn("_salt", F.pmod(spread_by, F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def map_text(rows: DataFrame, column: str, added: str, fn: Callable[[list], list[tuple]], step: int = 256) -> DataFrame:
    """``rows`` without ``column``, plus the ``added`` columns (a DDL list) that ``fn`` gives for a list of its values.

    Arrow batches are worked in slices of ``step`` rows; the other columns pass through untouched, nulls included.
    """
    ship_package(rows.sparkSession)
    kept = [c for c in rows.columns if c != column]
    kinds = dict(rows.dtypes)
    new = StructType.fromDDL(added)
    fields = [(f.name, to_arrow_type(f.dataType)) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                made = fn(batch.column(column).to_pylist())
                values = [pa.array([m[i] for m in made], kind) for i, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *values], names=[*kept, *(n for n, _ in fields)])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), added]))

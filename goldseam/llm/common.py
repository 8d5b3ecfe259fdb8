"""What the operators share: reading tables, stored intermediate results, column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space, the only white space that these operators know.
SPACE = "[\\x20\\x09-\\x0D]"

#: Bytes of texts, or of sets, that a task hands to Python at a time.
BATCH_BYTES = 4 * 1024 * 1024
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a session on this machine alone may do without the setting; it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="goldseam-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows from Parquet in the shared folder; cuts the lineage and survives executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_batches(spark: SparkSession) -> None:
    """From now on, hand rows to Python in batches of ``BATCH_BYTES``, unless the session sets a size.

    Ten thousand rows of whole texts, Spark's batch up to 64 MB, stand in memory several times: in
    the queue and the buffers of the executor, and as a batch and as strings in each of its Python
    processes, which live on and keep what they once took.  Plans read the setting when they run, so it
    stays set.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def text_of(name: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def in_crc32_fold(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the identifier as text leaves the remainder; false for a null one."""
    return F.coalesce(
        F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False)
    )


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under neutral column names, which clash with none, and the name of each."""
    names = {name: f"_in{at}" for at, name in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def back(names: dict[str, str], **instead: Column) -> list[Column]:
    """The columns of a renamed table under their own names, some replaced."""
    return [instead.get(inner, F.col(inner)).alias(name) for name, inner in names.items()]

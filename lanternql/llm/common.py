"""What the operators share: table access, cut lineage, per-worker memory."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run without ASCII white space (Java regular expression).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where this machine keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.  Only a local session that names
    none uses a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


#: Spark drops the shuffle files of a query once its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends here,
    and a lost executor costs no more than the stage that reads the files.  The folder goes
    when the session ends, or earlier by ``discard``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove what ``materialize`` wrote, once nothing lazy reads it any more."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def worker_memory(name: str, make: Callable):
    """One object per Python worker process, made at first use."""
    held = sys.__dict__.setdefault("_lantern_worker_memory", {})
    if name not in held:
        held[name] = make()
    return held[name]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def carried(docs: DataFrame, *names: str | Column) -> DataFrame:
    """The named columns beside a struct _row of all columns, so that no column a stage
    adds can clash with one of the input."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *names)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def in_hash_bucket(key: str, modulus: int, remainder: int) -> Column:
    """crc32 of the key's text, modulo."""
    return F.crc32(F.col(key).cast("string")) % modulus == remainder

"""What the operators share: tables, shared storage, batches for Python workers."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it, for Java and Python expressions.
SPACE = r"[\x20\x09-\x0D]"
#: The largest table, in rows, that an operator broadcasts after counting it.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; make one only where none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint"))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there.

    Later jobs read the files, so a lost executor costs a re-read and what was
    decided once (sampled randomness, sketches) is not decided again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of plans that nobody holds any more.

    Its cleaner acts when the driver's JVM collects the plans, which it does by
    itself only every half hour or when the driver's memory is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Shared:
    """A broadcast of any object, its class included, so executors need no copy of this package."""

    def __init__(self, spark: SparkSession, thing) -> None:
        self.pickled = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    def __getstate__(self):
        return {"pickled": self.pickled}

    @property
    def value(self):
        if "own" not in self.__dict__:
            self.own = cloudpickle.loads(self.pickled.value)
        return self.own


def in_batches(df: DataFrame, function: Callable, schema: str, rows: int = 256) -> DataFrame:
    """mapInArrow that hands ``function`` small record batches, so that a worker's
    memory follows a few hundred rows and not Spark's batch size."""

    # texts may be long: fewer rows at once than Spark's usual number
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.sub(r"\D", "", conf.get(key))
        if not 0 < int(now) <= most:
            conf.set(key, str(most))

    def run(batches: Iterator) -> Iterator:
        def small():
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    yield batch.slice(at, rows)

        yield from function(small())

    return df.mapInArrow(run, schema)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on keys of which nulls equal nulls; keeps the left keys only."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"__{k}"])
        on = term if on is None else on & term
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])

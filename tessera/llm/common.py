"""What the operators of this subpackage share: the shared folder, intermediate tables, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.store import discard, lean, materialize, scratch, shared_dir  # noqa: F401  (for the modules of this subpackage)
from tessera.shipping import ship_code  # noqa: F401

#: Words of the contracts: runs of anything but these. ``bytes.split()`` splits at exactly these bytes.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def splittable(side: DataFrame, key: str) -> DataFrame:
    """An aggregated side of a join, shuffled once more by its integer key.

    Only where both sides of a join come straight from shuffles does Spark split the rows of a hot key of
    the other side over tasks.
    """
    return side.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """At most `limit` rows in order of a hash of the keys, which should tell rows apart.

    A threshold on the hash comes first, so that tasks together send some 1.5 * limit rows to the driver
    however many there are; a sample may fall short of the limit by chance, hardly ever by much.
    """
    total, hashed = rows.count(), F.xxhash64(*keys)
    if total > 2 * limit:
        rows = rows.where(F.pmod(hashed, F.lit(1 << 31)) < int((1 << 31) * 1.5 * limit / total))
    return rows.orderBy(hashed, *keys).limit(limit)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a URI; works on executors and on the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: One run of the separators that delimit words everywhere in this subpackage.
SPACE_RUN = r"[ \t-\r]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local folder in local mode, an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="abundara-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def spill(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder."""
    path = new_folder(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI in the shared folder; works inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_caches: dict[str, dict] = {}


def worker_cache(owner: str | None) -> dict:
    """This Python worker's cache for `owner`, whose caches alone it keeps: workers outlive stages, and what one operator kept is no use to the next."""
    for other in [k for k in _caches if k != owner]:
        del _caches[other]
    return _caches.setdefault(owner, {}) if owner else {}


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null ids fall in the fold of the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int | None:
    """Bytes that the optimizer expects to read for `df` (sizes of files, no scan); None where it has no figure."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Tasks that the rows of one group are dealt to; at most 64, as a long has a bit for each.
SALTS = 64


def salt_of(*cols: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salt_bits(salt: str) -> Column:
    """Aggregate: the salts that occur in a group, as bits. Combines on the map side."""
    return F.bit_or(F.expr(f"shiftleft(1L, {salt})"))


def by_salt(groups: DataFrame, bits: str, salt: str) -> DataFrame:
    """A copy of each group for every salt that occurs in it, so rows of a group of any size meet it in as many tasks."""
    return groups.withColumn(salt, F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda x: F.getbit(F.col(bits), x) == 1))).drop(bits)


def with_group(rows: DataFrame, keys: list[str], aggs: dict[str, Column], salted_by: list[str], having: str = "true") -> DataFrame:
    """`rows` with aggregates of their group, dealt by keys and salt; groups that fail `having` go with their rows."""
    salted = rows.withColumn("__salt", salt_of(*salted_by))
    groups = salted.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()], salt_bits("__salt").alias("__bits")).filter(having)
    return salted.join(by_salt(groups, "__bits", "__salt"), [*keys, "__salt"]).drop("__salt")


def orderable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return orderable(kind.elementType)
    return not isinstance(kind, (MapType, VariantType))


def one_row_each(docs: DataFrame, keys: dict[str, Column], winners: DataFrame) -> DataFrame:
    """Rows of `docs` whose keys are in `winners`; rows that repeat a key collapse to the least of them.

    Null keys equal each other: keys are fields of one struct, which is never null itself. Columns that have no
    order (maps, variants) are ordered by their JSON text.
    Copies collapse in the map-side aggregate, before the shuffle; text moves once.
    """
    fields = docs.schema.fields
    loose = [f.name for f in fields if not orderable(f.dataType)]
    value = F.struct(*[(F.to_json(F.struct(F.col(f"`{f.name}`"))) if f.name in loose else F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)])
    aggs = [F.min(value).alias("__row")]
    if loose:
        aggs.append(F.min_by(F.struct(*[F.col(f"`{c}`") for c in loose]), value).alias("__loose"))
    rows = docs.groupBy(F.struct(*[c.alias(k) for k, c in keys.items()]).alias("__key")).agg(*aggs)
    kept = winners.select(F.struct(*keys).alias("__key"))
    out = [(F.col("__loose")[f.name] if f.name in loose else F.col("__row")[f"c{i}"]).alias(f.name) for i, f in enumerate(fields)]
    return rows.join(kept, "__key", "left_semi").select(*out)

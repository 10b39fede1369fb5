"""Shared helpers: shared-folder tables, connected components, text pieces."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own.

    Without the setting, a local session gets a temporary folder and a cluster a folder in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _OWN[app] = tempfile.mkdtemp(prefix="spark-granary-")
        else:
            _OWN[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/granary_scratch"
    return _OWN[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a stored() table that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> Column:
    """The column of that name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(df: DataFrame) -> Column:
    """All columns of df in one struct, so that none clashes with an operator's own; unboxed() gives them back."""
    return F.struct(*map(quoted, df.columns))


def unboxed(box: str, names: list[str]) -> list[Column]:
    return [F.col(box).getField(n).alias(n) for n in names]


def mapped(df: DataFrame, names: list[str], run, made: list[T.StructField]) -> DataFrame:
    """Columns names of df and those that run adds behind them, by mapInArrow.

    Spark's mapInArrow looks columns up by unquoted names, so it sees numbered ones.
    """
    plain = [f"c{k}" for k in range(len(names) + len(made))]
    kinds = [df.schema[n].dataType for n in names] + [f.dataType for f in made]
    schema = T.StructType([T.StructField(p, kind) for p, kind in zip(plain, kinds)])
    out = df.select(*[quoted(n).alias(p) for n, p in zip(names, plain)]).mapInArrow(lambda batches: (b.rename_columns(plain) for b in run(batches)), schema)
    return out.select(*[F.col(p).alias(n) for p, n in zip(plain, [*names, *(f.name for f in made)])])


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _bloom(keys: DataFrame) -> DataFrame:
    """256 rows of 4 KB bitmaps, a bound that data cannot exceed: 2**23 bits set by column k."""
    bits = keys.select(F.pmod("k", F.lit(256)).alias("_bucket"), F.pmod(F.shiftright("k", 8), F.lit(32768)).alias("_bit"))
    return bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))


def maybe_among(df: DataFrame, k: Column, keys: DataFrame) -> DataFrame:
    """Rows of df whose k (a long) may be among column k of keys; none that is gets lost."""
    probed = df.withColumns({"_bucket": F.pmod(k, F.lit(256)), "_bit": F.pmod(F.shiftright(k, 8), F.lit(32768))})
    byte = F.conv(F.hex(F.substring("_map", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
    return probed.join(F.broadcast(_bloom(keys)), "_bucket").filter(hit).drop("_bucket", "_bit", "_map")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected links: (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Each step is a minimum per node and
    a join, both of which Spark can split for nodes with very many links; every step's links are written to
    the shared folder. Self links and repeated links are allowed; nodes without links have no row.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    links = stored(links, "links")
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        dropped(links)
        links = after
        row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        sign = tuple(row)
        if sign == before:
            break
        before = sign
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

"""Fingerprints of tables as hash trees over ranges of hashed keys: compared from the top, read only where they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Children of a node, as hexadecimal digits of the key's hash.
DIGITS = 1


def _rows(df: DataFrame, key: str, depth: int) -> DataFrame:
    """(range, digest): the range of a row's key, and a digest of the whole row."""
    spot = F.sha2(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\0")), 256)
    whole = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    return df.select(F.substring(spot, 1, DIGITS * depth).alias("range"), whole.alias("digest"))


def _part(k: int) -> Column:
    """A quarter of the digest as a number; sums of quarters do not depend on the order of rows, and count repeated ones."""
    return F.sum(F.conv(F.substring("digest", 16 * k + 1, 16), 16, 10).cast("decimal(38,0)"))


def hash_tree(df: DataFrame, key: str, depth: int = 2) -> DataFrame:
    """(level, range, n, digest): of every range of keys, from level depth up to the one node of level 0.

    A leaf adds up the digests of its rows, which combines before the shuffle; a node above digests its children, at most 16, in
    order of their ranges. No row gathers the digests of more than that. Rows with a null key share a range.
    """
    sums = _rows(df, key, depth).groupBy("range").agg(F.count("*").alias("n"), *[_part(k).alias(f"s{k}") for k in range(4)])
    level = sums.select("range", "n", F.sha2(F.concat_ws("|", "n", *[F.col(f"s{k}").cast("string") for k in range(4)]), 256).alias("digest"))
    out = level.select(F.lit(depth).alias("level"), "range", "n", "digest")
    for up in range(depth - 1, -1, -1):
        child = F.array_sort(F.collect_list(F.struct("range", "digest")))
        text = F.array_join(F.transform(child, lambda c: F.concat(c["range"], F.lit(":"), c["digest"])), ",")
        level = level.groupBy(F.substring("range", 1, DIGITS * up).alias("range")).agg(F.sum("n").alias("n"), F.sha2(text, 256).alias("digest"))
        out = out.unionByName(level.select(F.lit(up).alias("level"), "range", "n", "digest"))
    return out


def fingerprint(df: DataFrame, key: str, depth: int = 2) -> str:
    """The digest of the whole table, whatever the order of its rows; '' for one without rows."""
    top = hash_tree(df, key, depth).filter("level = 0").select("digest").first()
    return top[0] if top else ""


def differing_ranges(a: DataFrame, b: DataFrame, depth: int = 2) -> DataFrame:
    """(range) of the leaves in which two hash trees differ; a level is looked at below nodes that differ only."""
    differ = None
    for level in range(depth + 1):
        one, two = (t.filter(F.col("level") == level).select("range", F.col("digest").alias(d)) for t, d in ((a, "da"), (b, "db")))
        both = one.join(two, "range", "full").filter(~F.col("da").eqNullSafe(F.col("db"))).select("range")
        if differ is not None:
            both = both.withColumn("_up", F.substring("range", 1, DIGITS * (level - 1))).join(differ.withColumnRenamed("range", "_up"), "_up", "left_semi").select("range")
        differ = both
    return differ


def write_ranged(df: DataFrame, path: str, key: str, depth: int = 1) -> None:
    """df in one folder a range of keys, so that a range is read alone."""
    spot = F.sha2(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\0")), 256)
    dealt = df.withColumn("range", F.substring(spot, 1, DIGITS * depth))
    dealt.repartition("range").write.mode("overwrite").partitionBy("range").parquet(path)


def changed_rows(a: DataFrame, b: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """(key, change) between two tables of write_ranged(), of which only the given ranges are read."""
    wanted = [r[0] for r in ranges.collect()]  # at most 16 to the power of the depth, and as few as differ
    columns = [c for c in a.columns if c != "range"]

    def digests(df: DataFrame, out: str) -> DataFrame:
        whole = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
        held = df.filter(F.col("range").isin(wanted)).select(F.col(f"`{key}`").alias("key"), whole.alias("digest"))
        return held.groupBy("key").agg(F.sum(F.conv(F.substring("digest", 1, 15), 16, 10).cast("decimal(38,0)")).alias(out))

    one, two = digests(a, "da"), digests(b, "db")
    both = one.join(two, one["key"].eqNullSafe(two["key"]), "full").select(F.coalesce(one["key"], two["key"]).alias("key"), "da", "db")
    change = F.when(F.col("da").isNull(), "added").when(F.col("db").isNull(), "removed").when(F.col("da") != F.col("db"), "changed")
    return both.select("key", change.alias("change")).filter("change is not null")

"""Comparing two results row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.sources.staging import materialise

c = F.col


def key_set_hash(keys: Column) -> Column:
    """SHA-256 of the sorted keys of a group joined by semicolons; equal for equal sets whatever their order."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(keys)), ";"), 256)


def key_hash(key: Column) -> Column:
    """The first 60 bits of the SHA-256 of a key, as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long")


def set_digest(rows: DataFrame, by: list[str], key: Column) -> DataFrame:
    """by, n, total, mixed: equal for equal multisets of keys. Sums and exclusive ors of hashes, combined where the rows are, so no group
    of keys is ever held together; digests of parts add up to that of the whole."""
    h = key_hash(key)
    return rows.select(*by, h.alias("h")).groupBy(*by).agg(F.count("*").alias("n"), F.sum(c("h").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64("h")).alias("mixed"))


def _unequal(a: DataFrame, b: DataFrame, bits: int) -> DataFrame:
    """The ranges of hashes, by their first ``bits`` of 60, whose digests are not the same on both sides."""
    side = lambda df, name: df.groupBy(F.shiftright("h", 60 - bits).alias("range")).agg(F.struct(F.count("*"), F.sum(c("h").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("h", "v"))).alias(name))
    return side(a, "a").join(side(b, "b"), "range", "full_outer").where(~c("a").eqNullSafe(c("b"))).select("range")


def set_differences(want: DataFrame, got: DataFrame, keys: list[str], values: list[str], bits: tuple[int, ...] = (10, 20, 30)) -> DataFrame:
    """keys, want, got: the keys whose rows (of ``values``) differ, and how many rows with it each side has. What is equal is never compared row by row.

    Both sides are digested by ranges of the keys' hashes; only ranges that differ are digested again, more finely, and only
    rows of the finest that differ are met. So two large tables with few differences cost one pass and a few small ones.
    """
    hashed = lambda df: df.select(*keys, key_hash(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).alias("h"), F.xxhash64(F.to_json(F.struct(*values), {"ignoreNullFields": "false"})).alias("v"))
    a, b = hashed(want), hashed(got)
    for n in bits:
        found = materialise(_unequal(a, b, n), "ranges")
        narrow = lambda df, found=found, n=n: df.join(found, F.shiftright(df["h"], 60 - n) == found["range"], "left_semi")
        a, b = narrow(a), narrow(b)
    count = lambda df, name: df.groupBy("h", *keys, "v").agg(F.count("*").alias(name))
    left, right = count(a, "want"), count(b, "got").select("h", "v", "got", F.struct(*keys).alias("k"))
    both = left.withColumn("k", F.struct(*keys)).select("h", "v", "want", "k").join(right.withColumnRenamed("k", "k2"), ["h", "v"], "full_outer")
    both = both.where(~c("want").eqNullSafe(c("got"))).select(F.coalesce("k", "k2").alias("k"), F.coalesce("want", F.lit(0)).alias("want"), F.coalesce("got", F.lit(0)).alias("got"))
    return both.groupBy("k").agg(F.sum("want").alias("want"), F.sum("got").alias("got")).select("k.*", "want", "got")


def differences(want: DataFrame, got: DataFrame, keys: list[str], exact: list[str], close: dict[str, float]) -> DataFrame:
    """keys, field, ok for every field of every row on either side; fields in ``close`` may differ by their tolerance."""
    a = want.select(*keys, F.struct(*exact, *close).alias("want"))
    b = got.select(*keys, F.struct(*exact, *close).alias("got"))
    both = a.join(b, keys, "full_outer")
    checks = [F.struct(F.lit(f).alias("field"), (F.col("want").isNotNull() & F.col("got").isNotNull() & F.col(f"want.{f}").eqNullSafe(F.col(f"got.{f}"))).alias("ok")) for f in exact]
    checks += [F.struct(F.lit(f).alias("field"), F.coalesce(F.abs(F.col(f"want.{f}") - F.col(f"got.{f}")) <= t, F.lit(False)).alias("ok")) for f, t in close.items()]
    return both.select(*keys, F.explode(F.array(*checks)).alias("check")).select(*keys, "check.field", "check.ok")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("field").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def selector_effects(old: DataFrame, new: DataFrame) -> DataFrame:
    """solved, unchanged: on how many queries a sample of one year (``distinct_years``) became one of several, and on how many the candidates (``hash``) are the same."""
    both = old.select("query_id", F.col("distinct_years").alias("a"), F.col("hash").alias("h")).join(new.select("query_id", F.col("distinct_years").alias("b"), F.col("hash").alias("g")), "query_id")
    return both.agg(F.count_if(F.expr("a = 1 and b > 1")).alias("solved"), F.count_if(F.expr("h = g")).alias("unchanged"))

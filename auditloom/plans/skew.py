"""Joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditloom.plans.lineage import cut

#: A key is hot when it holds more than 1/HOT_SHARE of all rows, so by counting there are
#: fewer than HOT_SHARE hot keys whatever the size of the data: safe to broadcast.
HOT_SHARE = 256


def hot_keys(df: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys above the share, with ``n_salts`` = how many slices each needs.

    At most ``share - 1`` rows come back.  The total is the sum of the keys' counts, whose shuffle is used for both.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n"))
    return (
        counts.withColumn("_slices", F.ceil(F.col("_n") * F.lit(share) / total.scalar()).cast("int"))
        .where(F.col("_slices") > 1)
        .select(*keys, F.col("_slices").alias("n_salts"))
    )


def with_salt(df: DataFrame, hot: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """Give rows of hot keys a salt from ``spread`` columns; all other rows get salt 0."""
    return (
        df.join(F.broadcast(hot), keys, "left")
        .withColumn("salt", F.when(F.col("n_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread), F.col("n_salts").cast("long")).cast("int")))
        .drop("n_salts")
    )


def replicated(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Counterpart of :func:`with_salt`: one copy per slice for hot keys, one copy otherwise."""
    return (
        df.join(F.broadcast(hot), keys, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n_salts") - 1, F.lit(0)))))
        .drop("n_salts")
    )


def parts_of(spark: SparkSession) -> int:
    """Partitions for a job whose cost is not its bytes in: a given number, as adaptive execution would join small ones."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def pair_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join whose cost is its pairs, not its rows: no task gets much more than its share of them, however small both sides are.

    A key above 1/HOT_SHARE of all pairs, so fewer than HOT_SHARE keys, is cut along its longer side; the shorter one is copied.
    Both sides are dealt to a given number of tasks: a broadcast side would leave all pairs to the few tasks that read the other.
    Columns other than ``keys`` must differ.
    """
    count = lambda d, n: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    met = cut(count(left, "_l").join(count(right, "_r"), keys).withColumn("_n", F.col("_l").cast("double") * F.col("_r")))
    slices = F.ceil(F.col("_n") * HOT_SHARE / met.agg(F.sum("_n")).scalar()).cast("int")
    by_left = F.col("_l") >= F.col("_r")
    hot = cut(met.select(*keys, slices.alias("_s"), by_left.alias("_by")).where("_s > 1")
              .select(*keys, F.when(F.col("_by"), F.col("_s")).otherwise(1).alias("_ls"), F.when(F.col("_by"), 1).otherwise(F.col("_s")).alias("_rs")))
    n = parts_of(left.sparkSession)

    def dealt(d: DataFrame, own: str, other: str) -> DataFrame:
        spread = [c for c, t in d.dtypes if "map<" not in t and "variant" not in t]
        one = lambda c: F.coalesce(F.col(c), F.lit(1))
        return (d.join(F.broadcast(hot), keys, "left").withColumn(own + "alt", F.pmod(F.xxhash64(*spread), one(own).cast("long")).cast("int"))
                .withColumn(other + "alt", F.explode(F.sequence(F.lit(0), one(other) - 1))).drop("_ls", "_rs"))

    salted = [*keys, "_lsalt", "_rsalt"]
    pairs = dealt(left, "_ls", "_rs").repartition(n, *salted).join(dealt(right, "_rs", "_ls").repartition(n, *salted).hint("merge"), salted)
    return pairs.drop("_lsalt", "_rsalt")


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where ``many`` may have hot keys and ``few`` has few rows per key."""
    hot = hot_keys(many, keys)
    return with_salt(many, hot, keys, spread).join(replicated(few, hot, keys), keys + ["salt"], how).drop("salt")

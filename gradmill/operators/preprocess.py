"""Feature scaling and hashing over the long form (…, idx, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradmill.functions.hashing import hash_counts, hash_counts_32

CONSTANT = 1e-4  # spreads and variances up to this count as none (a fixed value)


def column_bounds(long: DataFrame) -> DataFrame:
    """min, max and count of the present entries of each column."""
    return long.groupBy("idx").agg(F.min("val").alias("lo"), F.max("val").alias("hi"), F.count("*").alias("n"))


def column_moments(long: DataFrame) -> DataFrame:
    """mean and population sd of the present entries; variances up to CONSTANT are
    an sd of 0."""
    sums = long.groupBy("idx").agg(F.sum(F.col("val") * F.col("val")).alias("s2"), F.sum("val").alias("s1"), F.count("*").alias("n"))
    mean = F.col("s1") / F.col("n")
    var = F.col("s2") / F.col("n") - mean * mean
    return sums.select("idx", mean.alias("mean"), F.when(F.abs(var) <= CONSTANT, F.lit(0.0)).otherwise(F.sqrt(F.abs(var))).alias("sd"), "n")


def minmax_scale(long: DataFrame, lower: float = 0.0, upper: float = 1.0, bounds: DataFrame | None = None) -> DataFrame:
    """Scales present entries to [lower, upper]; a constant column becomes the middle.
    Absent entries stay absent. The statistics have a row for each column; Spark
    broadcasts them where they are small. bounds: known ones, to skip that pass."""
    stats = (column_bounds(long) if bounds is None else bounds).select("idx", "lo", "hi")
    spread = F.col("hi") - F.col("lo")
    scaled = (F.col("val") - F.col("lo")) / spread * (upper - lower) + lower
    return long.join(stats, "idx").withColumn("val", F.when(F.abs(spread) > CONSTANT, scaled).otherwise(F.lit((lower + upper) / 2))).drop("lo", "hi")


def normal_scale(long: DataFrame) -> DataFrame:
    """(val - mean) / sd of present entries; 0 where the sd is 0."""
    stats = column_moments(long).select("idx", "mean", "sd")
    return long.join(stats, "idx").withColumn("val", F.when(F.col("sd") == 0, F.lit(0.0)).otherwise((F.col("val") - F.col("mean")) / F.col("sd"))).drop("mean", "sd")


def trainer_minmax_scale(long: DataFrame) -> DataFrame:
    """As the trainer does it at load: the maximum is 0 at least, and a column whose
    bounds are equal stays as it is."""
    stats = long.groupBy("idx").agg(F.min("val").alias("lo"), F.greatest(F.max("val"), F.lit(0.0)).alias("hi"))
    scaled = (F.col("val") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return long.join(stats, "idx").withColumn("val", F.when(F.col("hi") != F.col("lo"), scaled).otherwise(F.col("val"))).drop("lo", "hi")


def dense_zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population sd of each column; one whose mean is 0 stays."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # a single row
    return out.withColumns({c: F.when(F.col(f"_m_{c}") != 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.col(c)) for c in columns}).drop(*stats.columns)


def standardize_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """value as (x - mean) / population sd of its group; groups without spread are
    dropped. Statistics are combined before the shuffle and joined back, so that a
    group of any size is never gathered."""
    stats = df.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")).filter("_s <> 0")
    return df.join(stats, group).withColumn(value, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def hash_columns(df: DataFrame, key: str, hashed: dict[int, Column], kept: dict[int, Column], buckets: int) -> DataFrame:
    """Hashed columns become counts of hits of murmur3_32(text) mod buckets, without
    the column's number, a null as an empty text; kept ones move to buckets + number.
    Counted within the row: no shuffle."""
    counts = hash_counts_32(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in hashed.values()]), buckets)
    moved = F.array(*[F.struct(F.lit(buckets + i).cast("long").alias("idx"), c.cast("double").alias("val")) for i, c in kept.items()])
    rows = df.select(key, counts.alias("counts"), *([moved.alias("moved")] if kept else []))
    return rows.select(key, F.inline(F.concat("counts", "moved") if kept else F.col("counts"))).withColumn("idx", F.col("idx").cast("int"))


def encode_tokens(df: DataFrame, key: str, tokens: Column, bits: int, bias: bool = True) -> DataFrame:
    """(key, idx, val): counts of the buckets of a row's tokens, empty tokens too, and of
    the constant feature. Counted within the row: no shuffle, and rows of equal key stay
    apart."""
    return df.select(key, hash_counts(tokens, bits, bias).alias("features")).select(key, F.inline("features"))


#: What normalize() dispatches on.
MIN_MAX, NORMAL = "MIN_MAX", "NORMAL"


def normalize(long: DataFrame, kind: str, *args: float) -> DataFrame:
    """One entry for the scalers: MIN_MAX with the lower and upper end, or NORMAL."""
    if kind == MIN_MAX:
        if len(args) != 2:
            raise ValueError("MIN_MAX takes a lower and an upper end")
        return minmax_scale(long, *args)
    if kind == NORMAL:
        if args:
            raise ValueError("NORMAL takes no ends")
        return normal_scale(long)
    raise ValueError(f"normalize knows {MIN_MAX} and {NORMAL}, not {kind!r}")

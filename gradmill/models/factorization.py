"""Matrix factorisation of ratings (user_id, item_id, rating)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradmill.functions.scalars import dot
from gradmill.operators.frames import normal
from gradmill.runtime import materialise

GLOBAL_BIAS = 3.604  # a fixed value


def initial_factors(ids: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """(key, bias, f): biases 0, factors normal with a standard deviation of 1 / k, from a
    digest of id and place: the same for every run."""
    part = lambda i: normal(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(i))), seed) / k
    return ids.select(key).distinct().select(key, F.lit(0.0).alias("bias"), F.array(*[part(i) for i in range(k)]).alias("f"))


def pull(users: DataFrame, items: DataFrame, ratings: DataFrame, first: int, count: int) -> tuple[DataFrame, DataFrame]:
    """The slice of the model for `count` users from `first`: their rows, and the
    rows of the items that they rated."""
    mine = ratings.filter(F.col("user_id").between(first, first + count - 1))
    return users.filter(F.col("user_id").between(first, first + count - 1)), items.join(mine.select("item_id").distinct(), "item_id", "left_semi")


def _met(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    u = users.select("user_id", F.col("bias").alias("bu"), F.col("f").alias("pu"))
    i = items.select("item_id", F.col("bias").alias("bi"), F.col("f").alias("qi"))
    return ratings.join(u, "user_id").join(i, "item_id")


def _predicted() -> Column:
    return F.lit(GLOBAL_BIAS) + F.col("bu") + F.col("bi") + dot("pu", "qi")


def predict(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    return _met(ratings, users, items).select(*ratings.columns, _predicted().alias("prediction"))


def rmse(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    e = F.col("rating") - F.col("prediction")
    return predict(ratings, users, items).agg(F.sqrt(F.sum(e * e) / F.count("*")).alias("rmse"), F.count("*").alias("n"))


def batch_gradient(ratings: DataFrame, users: DataFrame, items: DataFrame, rate: float, reg: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(user_id, bias, f) and (item_id, bias, f): changes, already times rate, summed
    over ratings with the model as it stands."""
    rows = _met(ratings, users, items).withColumn("e", F.col("rating") - _predicted())
    k = len(users.first()["f"]) if users.head(1) else 0

    def side(key: str, bias: str, own: str, other: str) -> DataFrame:
        parts = [F.sum(rate * (F.col("e") * F.col(other)[i] - reg * F.col(own)[i])).alias(f"d{i}") for i in range(k)]
        grouped = rows.groupBy(key).agg(F.sum(rate * (F.col("e") - reg * F.col(bias))).alias("bias"), *parts)
        return grouped.select(key, "bias", F.array(*[f"d{i}" for i in range(k)]).alias("f"))

    return side("user_id", "bu", "pu", "qi"), side("item_id", "bi", "qi", "pu")


def apply_changes(model: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The server's update: changes are added as they are."""
    c = changes.select(key, F.col("bias").alias("db"), F.col("f").alias("df"))
    met = model.join(c, key, "left")
    return met.select(key, (F.col("bias") + F.coalesce("db", F.lit(0.0))).alias("bias"), F.when(F.col("df").isNull(), F.col("f")).otherwise(F.zip_with("f", "df", lambda a, b: a + b)).alias("f"))


def sequential_changes(ratings: DataFrame, users: DataFrame, items: DataFrame, rate: float, block: int, reg: float = 0.01) -> DataFrame:
    """(side, id, bias, f, seen): what one pass of rating-by-rating updates changes, for
    the users ("user") and items ("item") of each block of `block` users. Within a block
    ratings are taken ascending by user and item, and a user's vector moves before the
    item's vector uses it; all blocks start from the same model, as workers do, so an
    item has a row for each block that rates it. A group holds the ratings of one block
    of users."""
    rows = _met(ratings, users, items).withColumn("block", F.floor(F.col("user_id") / block))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["user_id", "item_id"])
        user_ids, u = np.unique(pdf["user_id"].to_numpy(), return_inverse=True)
        item_ids, i = np.unique(pdf["item_id"].to_numpy(), return_inverse=True)
        first_u, first_i = np.unique(u, return_index=True)[1], np.unique(i, return_index=True)[1]
        p0, q0 = np.stack(pdf["pu"].to_numpy()[first_u]).astype(float), np.stack(pdf["qi"].to_numpy()[first_i]).astype(float)
        bu0, bi0 = pdf["bu"].to_numpy(float)[first_u], pdf["bi"].to_numpy(float)[first_i]
        p, q, bu, bi = p0.copy(), q0.copy(), bu0.copy(), bi0.copy()
        for a, b, r in zip(u.tolist(), i.tolist(), pdf["rating"].tolist()):
            mine, item = p[a], q[b]
            e = r - (GLOBAL_BIAS + bu[a] + bi[b] + mine @ item)
            bu[a] += rate * (e - reg * bu[a])
            bi[b] += rate * (e - reg * bi[b])
            mine += rate * (e * item - reg * mine)
            item += rate * (e * mine - reg * item)
        sides = [("user", user_ids, bu - bu0, p - p0, np.bincount(u)), ("item", item_ids, bi - bi0, q - q0, np.bincount(i))]
        return pd.concat([pd.DataFrame({"side": side, "id": ids, "bias": b, "f": list(f), "seen": n}) for side, ids, b, f, n in sides])

    return rows.groupBy("block").applyInPandas(run, "side string, id long, bias double, f array<double>, seen long")


def merged_changes(changes: DataFrame, side: str, key: str) -> DataFrame:
    """(key, bias, f, seen): the changes of one side, summed over the blocks."""
    one = changes.filter(F.col("side") == side)
    parts = one.select("id", "bias", "seen", F.posexplode("f").alias("place", "v"))
    summed = parts.groupBy("id", "place").agg(F.sum("v").alias("v"), F.sum("bias").alias("bias"), F.sum("seen").alias("seen"))
    rows = summed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("f"), F.first("bias").alias("bias"), F.first("seen").alias("seen"))  # a factor's places
    return rows.select(F.col("id").alias(key), "bias", F.col("f.v").alias("f"), "seen")


def sequential_epoch(ratings: DataFrame, users: DataFrame, items: DataFrame, rate: float, block: int, reg: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """The users and items after one pass of sequential_changes(), whose sums the server
    adds as they are."""
    changes = materialise(sequential_changes(ratings, users, items, rate, block, reg), "changes")
    return apply_changes(users, merged_changes(changes, "user", "user_id"), "user_id"), apply_changes(items, merged_changes(changes, "item", "item_id"), "item_id")


def global_mean_rmse(train: DataFrame, test: DataFrame) -> DataFrame:
    mean = train.agg(F.avg("rating").alias("mean"))
    e = F.col("rating") - F.col("mean")
    return test.crossJoin(F.broadcast(mean)).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))  # a single row

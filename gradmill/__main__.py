"""python -m gradmill STEP --config FILE --out FOLDER: one step of a job.

Steps, or their ranks: load (0) writes the input as chunks; train (1) trains on them and
saves the model; evaluate (2) prints loss and quality of the newest model. What ranks
from 3 on did, the gradients of minibatches, is done by Spark's executors."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gradmill.config import parse
from gradmill.models import factorization, logistic, tasks
from gradmill.operators import frames
from gradmill.session import session
from gradmill.sources import readers
from gradmill.sources.writers import read_model, write_rating_chunks

STEPS = ("load", "train", "evaluate")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = argparse.ArgumentParser(prog="gradmill", description=__doc__)
    p.add_argument("step", help="load, train or evaluate; or 0, 1, 2")
    p.add_argument("--config", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--steps", type=int, default=50)
    p.add_argument("--workers", type=int, default=1)
    a = p.parse_args(argv)
    step = STEPS[int(a.step)] if a.step.isdigit() and int(a.step) < len(STEPS) else a.step
    if step not in STEPS:
        p.error(f"no step {a.step!r}: there are {', '.join(STEPS)}")
    spark = spark or session()
    with open(a.config) as f:
        config = parse(f.read())
    factors = config.model_type == "CollaborativeFiltering"
    if step == "load":
        if factors:
            write_rating_chunks(readers.ratings_csv(spark, config.load_input_path), f"{a.out}/data", config.minibatch_size)
        else:
            tasks.load_samples(spark, config).repartition("chunk_id").write.partitionBy("chunk_id").parquet(f"{a.out}/data")
        said = {"rows": spark.read.parquet(f"{a.out}/data").count()}
    elif step == "train":
        data = spark.read.parquet(f"{a.out}/data")
        if factors:
            task = tasks.CollaborativeFilteringTask(config)
            task.run(spark, data.drop("chunk_id")).save(f"{a.out}/model", 0)
        else:
            task = tasks.LogisticRegressionTask(config)
            task.run(spark, data, a.steps, workers=a.workers).save(f"{a.out}/model", 0)
        said = {"evaluations": len(task.log), "loss": task.log[-1][1] if task.log else None}
    elif factors:
        ratings = spark.read.parquet(f"{a.out}/data")
        row = factorization.rmse(ratings, read_model(spark, f"{a.out}/model/users"), read_model(spark, f"{a.out}/model/items")).first()
        said = {"rmse": row["rmse"], "n": row["n"]}
    else:
        data = frames.in_range(spark.read.parquet(f"{a.out}/data"), config.test_set)
        long = data.select("position", "label", F.inline("features"))
        row = logistic.evaluate(long, read_model(spark, f"{a.out}/model"), "position").first()
        said = {"loss": row["loss"], "accuracy": row["accuracy"], "n": row["n"]}
    print(json.dumps(said))
    return said


if __name__ == "__main__":
    main()

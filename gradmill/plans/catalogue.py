"""The registered queries of the engine's own operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradmill import experiments
from gradmill.functions.scalars import sigmoid
from gradmill.models import factorization, logistic, optim, softmax
from gradmill.operators import checks, frames, preprocess
from gradmill.runtime import materialise, scratch
from gradmill.sources import readers, writers
from gradmill.streaming import state

VALUES = {0: "l_quantity", 1: "l_extendedprice", 2: "l_discount", 3: "l_tax"}
WEIGHTS = [0.1, 0.2, 0.3, 0.4]
EPSILON = 1e-4
DENSE_WEIGHTS = [0.1 * (i % 8 + 1) for i in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(name: str, alias: str | None = None):
    return (F.round(F.col(name), 6) + 0.0).alias(alias or name)


def line_long(spark, sf_dir) -> DataFrame:
    return frames.long_form(table(spark, sf_dir, "lineitem"), [], {i: F.col(c) for i, c in VALUES.items()})


def event_long(spark, sf_dir, constant: bool = False) -> DataFrame:
    extra = {2: F.lit(7.0)} if constant else {}
    return frames.long_form(table(spark, sf_dir, "events"), ["event_id"], {0: F.col("value"), 1: F.hour("ts"), **extra})


def column_bounds(spark, sf_dir):
    return preprocess.column_bounds(line_long(spark, sf_dir))


def column_moments(spark, sf_dir):
    return preprocess.column_moments(line_long(spark, sf_dir)).select("idx", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n")


def minmax_scale(spark, sf_dir):
    return preprocess.minmax_scale(event_long(spark, sf_dir), -1.0, 1.0).select("event_id", "idx", r6("val"))


def minmax_scale_constant_midpoint(spark, sf_dir):
    return preprocess.minmax_scale(event_long(spark, sf_dir, True), 0.0, 3.0).select("event_id", "idx", r6("val"))


def normal_scale(spark, sf_dir):
    return preprocess.normal_scale(event_long(spark, sf_dir, True)).select("event_id", "idx", r6("val"))


def trainer_minmax_scale(spark, sf_dir):
    long = frames.long_form(table(spark, sf_dir, "orders"), ["o_orderkey"], {0: F.col("o_totalprice"), 1: -F.col("o_totalprice"), 2: F.lit(0.0)}, keep_zero=True)
    return preprocess.trainer_minmax_scale(long).select("o_orderkey", "idx", r6("val"))


DIMS = 64


def dims(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(DIMS)])


def dense_zscore(spark, sf_dir):
    names = [f"x{i}" for i in range(DIMS)]
    return preprocess.dense_zscore(dims(spark, sf_dir).drop("label"), names).select("vec_id", *map(r6, names))


def per_user_standardize(spark, sf_dir):
    return preprocess.standardize_by(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", "user_id", r6("value"))


def feature_hash_columns(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    hashed = {0: F.col("event_type"), 2: F.col("user_id").cast("string")}
    return preprocess.hash_columns(events, "event_id", hashed, {1: F.col("value")}, 16).select("event_id", "idx", r6("val"))


def hash_encode_row(spark, sf_dir):
    return preprocess.encode_tokens(table(spark, sf_dir, "part"), "p_partkey", F.array("p_brand", "p_type"), 10)


def sparse_explode(spark, sf_dir):
    return event_long(spark, sf_dir).select("event_id", "idx", r6("val"))


def nnz_stats(spark, sf_dir):
    n = sum((F.when(F.col(c) != 0, 1).otherwise(0) for c in VALUES.values()), F.lit(0))
    return table(spark, sf_dir, "lineitem").select(n.alias("nnz")).agg(F.sum("nnz").alias("entries"), F.count("*").alias("rows"), F.max("nnz").alias("most"))


def ratings(spark, sf_dir, rating: Column | None = None) -> DataFrame:
    r = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.avg("value") / 100 if rating is None else rating).alias("rating"))
    names = r.select("event_type").distinct()
    from pyspark.sql import Window

    items = names.select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long").alias("item_id"))  # a row for each type of event
    return r.join(F.broadcast(items), "event_type").select("user_id", "item_id", "rating")


def ratings_dense_ids(spark, sf_dir):
    return frames.with_dense_id(ratings(spark, sf_dir).withColumnRenamed("user_id", "raw_user"), "raw_user", "user_id").select("user_id", "raw_user", "item_id", r6("rating"))


def order_chunks(spark, sf_dir) -> DataFrame:
    return frames.with_chunks(frames.with_position(table(spark, sf_dir, "orders"), "o_orderkey"), "position", 1000, 20)


def chunk_minibatch_ids(spark, sf_dir):
    return order_chunks(spark, sf_dir).select("o_orderkey", "position", "chunk_id", "minibatch_id")


def train_test_split_range(spark, sf_dir):
    """The first four fifths of the chunks for training, the others for the test."""
    chunks = order_chunks(spark, sf_dir)
    count = chunks.agg(F.max("chunk_id")).first()[0] + 1
    cut = count * 4 // 5
    sides = [frames.in_range(chunks, b).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.lit(s).alias("side"), "n", "total") for s, b in (("train", (0, cut)), ("test", (cut, count)))]
    return sides[0].unionByName(sides[1])


def weights_table(spark) -> DataFrame:
    return spark.createDataFrame([(i, w, 0.0) for i, w in enumerate(WEIGHTS[:3])], "idx int, w double, h double")


def sparse_weight_pull(spark, sf_dir):
    return logistic.pull(line_long(spark, sf_dir), weights_table(spark)).groupBy("idx").agg(F.count("*").alias("requests"), F.max("w").alias("w"))


def distinct_index_pull(spark, sf_dir):
    return logistic.pull_distinct(line_long(spark, sf_dir), weights_table(spark)).select("idx", "w")


def scaled_lines(spark, sf_dir) -> tuple[DataFrame, list]:
    """lineitem's features min-max scaled to [0, 1] as columns; 0 is absent."""
    df = table(spark, sf_dir, "lineitem")
    present = {c: F.when(F.col(c) != 0, F.col(c)) for c in VALUES.values()}
    stats = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(present.values()) for n, f in (("lo", F.min), ("hi", F.max))])
    met = df.select("l_returnflag", *VALUES.values()).crossJoin(F.broadcast(stats))  # a single row
    cols = []
    for i, (c, v) in enumerate(present.items()):
        spread = F.col(f"hi{i}") - F.col(f"lo{i}")
        scaled = F.when(F.abs(spread) > preprocess.CONSTANT, (v - F.col(f"lo{i}")) / spread).otherwise(F.when(v.isNotNull(), F.lit(0.5)))
        cols.append(F.coalesce(scaled, F.lit(0.0)).alias(f"v{i}"))
    return met.select((F.col("l_returnflag") == "R").cast("double").alias("label"), *cols), [F.col(f"v{i}") for i in range(len(cols))]


def lr_gradient_step(spark, sf_dir):
    """The flagship: one full-batch step over lineitem in a single pass."""
    df, values = scaled_lines(spark, sf_dir)
    return logistic.wide_gradient(df, F.col("label"), values, WEIGHTS, EPSILON).select(*[r6(f"g{i}") for i in range(4)], r6("loss"), r6("accuracy"), "n")


def sample_long(spark, sf_dir) -> DataFrame:
    """(event_id, label, idx, val): labelled samples with an id."""
    events = table(spark, sf_dir, "events").withColumn("label", (F.col("event_type") == "purchase").cast("double"))
    return frames.long_form(events, ["event_id", "label"], {0: F.col("value") / 500, 1: F.hour("ts") / 24, 2: F.col("user_id") % 7})


def lr_gradient_threshold(spark, sf_dir):
    return logistic.gradient(sample_long(spark, sf_dir), weights_table(spark), "event_id", EPSILON, threshold=300.0, skip_zero=True).select("idx", r6("g"))


def lr_loss_accuracy(spark, sf_dir):
    df = dims(spark, sf_dir)
    p = sigmoid(logistic.wide_margin([F.col(f"x{i}") for i in range(DIMS)], DENSE_WEIGHTS))
    rows = df.select((F.col("label") == 0).cast("double").alias("y"), p.alias("p"))
    return rows.agg(*logistic.evaluation(F.col("y"), F.col("p"))).select(r6("loss"), r6("accuracy"), "n")


def lr_eval_by_minibatch(spark, sf_dir):
    """The roll-up: losses over all rows, accuracy as the mean of minibatches'."""
    rows = logistic.residuals(sample_long(spark, sf_dir), weights_table(spark), "event_id").withColumn("mb", F.floor(F.col("event_id") / 20))
    each = rows.groupBy("mb").agg(*logistic.evaluation(F.col("label"), F.col("p")))
    return each.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"), F.avg("accuracy").alias("accuracy"), F.sum("n").alias("n")).select(r6("loss"), r6("accuracy"), "n")


def lr_dense_gradient(spark, sf_dir):
    df = dims(spark, sf_dir)
    out = logistic.wide_gradient(df, (F.col("label") == 0).cast("double"), [F.col(f"x{i}") for i in range(DIMS)], DENSE_WEIGHTS, EPSILON)
    return out.select(*[r6(f"g{i}") for i in range(DIMS)], r6("loss"), r6("accuracy"), "n")


def step_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Weights, and the mean gradient of lineitem as (idx, g)."""
    df, values = scaled_lines(spark, sf_dir)
    g = logistic.wide_gradient(df, F.col("label"), values, WEIGHTS, EPSILON)
    rows = F.array(*[F.struct(F.lit(i).alias("idx"), (F.col(f"g{i}") / F.col("n")).alias("g")) for i in range(4)])
    weights = spark.createDataFrame([(i, w, 0.01 * i) for i, w in enumerate([*WEIGHTS, 0.5])], "idx int, w double, h double")
    return weights, g.select(F.inline(rows))


def opt_sgd_step(spark, sf_dir):
    w, g = step_inputs(spark, sf_dir)
    return optim.make("sgd", 0.5).step(w, g).select("idx", r6("w"))


def opt_adagrad_step(spark, sf_dir):
    w, g = step_inputs(spark, sf_dir)
    return optim.make("adagrad", 0.5, EPSILON).step(w, g).select("idx", r6("w"), r6("h"))


def opt_momentum_step(spark, sf_dir):
    w, g = step_inputs(spark, sf_dir)
    return optim.make("momentum", 0.5).step(w, g).select("idx", r6("w"))


def opt_nesterov_pull(spark, sf_dir):
    w, g = step_inputs(spark, sf_dir)
    o = optim.make("nesterov", 0.5)
    return o.read(o.step(w, g)).select("idx", r6("w"))


def lr_three_steps_sgd(spark, sf_dir):
    """Three full-batch steps. The model is four numbers: they come to the driver
    after each step, which cuts the lineage."""
    df, values = scaled_lines(spark, sf_dir)
    w = list(WEIGHTS)
    for step in range(3):
        out = logistic.wide_gradient(df, F.col("label"), values, w, EPSILON)
        if step == 2:
            return out.select(*[F.round(F.lit(w[i]) + F.col(f"g{i}") / F.col("n"), 6).alias(f"w{i}") for i in range(4)], "n")
        row = out.first()
        w = [w[i] + row[f"g{i}"] / row["n"] for i in range(4)]


def softmax_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    long = frames.long_form(dims(spark, sf_dir), ["vec_id", "label"], {i: F.col(f"x{i}") for i in range(DIMS)}, keep_zero=True).select("vec_id", "label", F.col("idx").alias("j"), F.col("val").alias("x"))
    w = spark.createDataFrame([(j, k, 0.001 * (j + 1) * (k - 4)) for j in range(DIMS) for k in range(10)], "j int, k int, w double")
    return long, w


def softmax_loss(spark, sf_dir):
    return softmax.loss(*softmax_inputs(spark, sf_dir), "vec_id").select(r6("loss"), r6("accuracy"), "n")


def softmax_gradient(spark, sf_dir):
    return softmax.gradient(*softmax_inputs(spark, sf_dir), "vec_id", EPSILON).select("j", "k", r6("g"))


def factors(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = ratings(spark, sf_dir)
    side = lambda key, a: r.select(key).distinct().select(key, (F.col(key) % a / 100.0).alias("bias"), F.array(*[(F.col(key) * (i + 3) % a / 50.0 - 0.1) for i in range(3)]).alias("f"))
    return r, side("user_id", 11), side("item_id", 7)


def mf_predict(spark, sf_dir):
    return factorization.predict(*factors(spark, sf_dir)).select("user_id", "item_id", r6("prediction"))


def mf_rmse(spark, sf_dir):
    return factorization.rmse(*factors(spark, sf_dir)).select(r6("rmse"), "n")


def mf_batch_gradient(spark, sf_dir):
    r, u, i = factors(spark, sf_dir)
    changes, _ = factorization.batch_gradient(r, u, i, 0.01)
    return factorization.apply_changes(u, changes, "user_id").select("user_id", r6("bias"), *[F.round(F.col("f")[k], 6).alias(f"f{k}") for k in range(3)])


def mf_sequential_epoch(spark, sf_dir):
    """Users after a pass of rating-by-rating updates in blocks of 200 users."""
    users, _ = factorization.sequential_epoch(*factors(spark, sf_dir), 0.01, 200)
    return users.select("user_id", r6("bias"), *[F.round(F.col("f")[k], 6).alias(f"f{k}") for k in range(3)])


def mf_sequential_items(spark, sf_dir):
    """Items after the same pass: the sums of what the blocks changed."""
    _, items = factorization.sequential_epoch(*factors(spark, sf_dir), 0.01, 200)
    return items.select("item_id", r6("bias"), *[F.round(F.col("f")[k], 6).alias(f"f{k}") for k in range(3)])


def global_mean_rmse(spark, sf_dir):
    r = ratings(spark, sf_dir)
    return factorization.global_mean_rmse(r.filter("(user_id + item_id) % 5 <> 0"), r.filter("(user_id + item_id) % 5 = 0")).select(r6("rmse"), "n")


AXES = {"workers": [8, 16, 32], "rate": [0.001, 0.01], "bits": [10, 19]}


def grid_product(spark, sf_dir):
    return experiments.grid(spark, AXES).drop("machine")


def grid_assignment(spark, sf_dir):
    return experiments.grid(spark, AXES, machines=5).groupBy("machine").agg(F.count("*").alias("n"), F.min("experiment_id").alias("first"))


def metric_log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("experiment_id"), "ts", "event_id", F.round("value", 4).alias("loss"))


def top_experiments(spark, sf_dir):
    last = experiments.last_values(metric_log(spark, sf_dir), "experiment_id", ["ts", "event_id"], "loss")
    return experiments.top(last, 10, "experiment_id")


def loss_dedup(spark, sf_dir):
    log = metric_log(spark, sf_dir).withColumn("coarse", F.floor(F.col("loss") / 50).cast("long"))
    return experiments.changed_only(log, "experiment_id", ["ts", "event_id"], ["coarse"]).select("experiment_id", "event_id", "coarse")


def cost_model(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 16 + 1).alias("workers"), F.col("c_nationkey").alias("storage"))
    rate = experiments.cost_per_second(F.lit(256), F.col("workers"), F.lit(1), F.col("storage") * 1000)
    each = c.select(F.round(rate * 1e6, 6).alias("per_second"), (F.col("c_custkey") % 100).alias("seconds"))
    return experiments.cost_totals(each, "per_second", "seconds").select(F.round("cost", 2).alias("cost"), F.round("cost_per_second", 2).alias("cost_per_second"))


def updates_per_second(spark, sf_dir):
    return state.per_second(table(spark, sf_dir, "events"), "ts").select(F.unix_timestamp("second").alias("second"), "updates")


def kv_last_write(spark, sf_dir):
    return state.last_write(table(spark, sf_dir, "events").select("event_type", "ts", "event_id", r6("value")), "event_type", "value", ["ts", "event_id"])


def task_status_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    log = events.filter("event_type = 'click'").select("user_id", "ts", "event_id", F.floor("value").cast("long").alias("status"))
    return state.task_status(log, events.select("user_id").distinct(), "user_id", "status", ["ts", "event_id"])


def task_lease_states(spark, sf_dir):
    return state.lease_codes(lease_log(spark, sf_dir), task="user_id").select("event_id", "user_id", "op", "code")


def duplicate_launches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("nonce"))
    return state.first_launches(docs, ["nonce"], ["doc_id"]).select("doc_id", "duplicate")


def quality_checks(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    rules = {"bad_tax": checks.finite(F.col("l_tax")), "bad_label": checks.binary_label((F.col("l_returnflag") == "R").cast("int")), "bad_line": F.col("l_linenumber") >= 0, "bad_rating": checks.rating(F.col("l_quantity"), 45)}
    return checks.violations(l, rules)


def libsvm_export(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    pairs = F.filter(F.array(*[F.struct(F.lit(i).alias("idx"), F.round(F.col(c) * 100).alias("val")) for i, c in VALUES.items()]), lambda f: f["val"] != 0)
    line = writers.libsvm_line((F.col("l_returnflag") == "R").cast("double"), pairs)
    return l.select(line.alias("line")).groupBy("line").agg(F.count("*").alias("n"))


def rcv1_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    line = F.concat(F.col("o_custkey") % 5, F.lit(","), F.col("o_orderkey") % 3, F.lit(" | "), F.col("o_custkey") % 7, F.lit(":2.75 "), F.col("o_orderkey") % 7, F.lit(":"), F.col("o_orderkey") % 10)
    parsed = readers.multi_label(o.select("o_orderkey", line.alias("value")))
    return parsed.select("o_orderkey", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), F.size("features").alias("n"), F.aggregate("features", F.lit(0.0), lambda s, f: s + f["val"] * (f["idx"] + 1)).alias("weighted"))


def text_hash_lr(spark, sf_dir):
    """A gradient of text classification: hashed words of documents with labels."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    hashed = preprocess.encode_tokens(docs, "doc_id", F.split("text", " "), 14)
    long = hashed.join(docs.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    weights = spark.createDataFrame([], "idx long, w double, h double")
    return logistic.gradient(long, weights, "doc_id", EPSILON).select("idx", r6("g"))


def stream_gradient_sink(spark, sf_dir):
    """events as a stream of gradients into four weights, by micro-batches."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    stream = source.parquet(f"{sf_dir}/events.parque[t]").select((F.col("user_id") % 4).cast("int").alias("idx"), (F.col("value") / 1e6).alias("g"))  # a pattern: a table may be a file
    weights = spark.createDataFrame([(i, 0.0, 0.0) for i in range(4)], "idx int, w double, h double")
    return state.gradient_sink(stream, weights, optim.make("sgd", 1.0).step).select("idx", r6("w"))


def crc32_rows(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", checks.checksum(F.concat_ws("|", "r_regionkey", "r_name")).alias("crc"))


def stream_factor_sink(spark, sf_dir):
    """events as a stream of changes of five items' factors, by micro-batches."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    v = F.col("value") / 1e6
    stream = source.parquet(f"{sf_dir}/events.parque[t]").select(F.lit("item").alias("side"), (F.col("user_id") % 5).alias("id"), v.alias("bias"), F.array(v * 2, -v).alias("f"))  # a pattern: a table may be a file
    model = spark.createDataFrame([("item", i, 0.5, [0.0, float(i)]) for i in range(5)], "side string, id long, bias double, f array<double>")
    return state.factor_sink(stream, model).select("id", r6("bias"), F.round(F.col("f")[0], 6).alias("f0"), F.round(F.col("f")[1], 6).alias("f1"))


def model_snapshot(spark, sf_dir):
    """What a reader sees of a sink's model: its newest version."""
    folder = scratch(spark, "sink")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    weights = spark.createDataFrame([(i, 1.0, 0.0) for i in range(3)], "idx int, w double, h double")
    state.gradient_sink(stream.select((F.col("user_id") % 2).cast("int").alias("idx"), (F.col("value") / 1e6).alias("g")), weights, optim.make("sgd", 0.5).step, folder)
    return state.snapshot(spark, folder).select("idx", r6("w"))


def lease_log(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("event_type in ('signup', 'error')")
    log = events.select("user_id", "event_id", F.when(F.col("event_type") == "signup", "register").otherwise("deregister").alias("op"), F.unix_timestamp("ts").alias("t"), F.lit(86400).alias("lease_s"))
    return log.withColumn("seq", F.struct("t", "event_id"))


def fleet_shortfall(spark, sf_dir):
    """How many tasks run a week into the log, and how many are to be started."""
    codes = state.lease_codes(lease_log(spark, sf_dir), task="user_id")
    at = codes.agg(F.min("t")).first()[0] + 7 * 86400
    return state.fleet(codes, 1000, float(at), task="user_id")


def best_traces(spark, sf_dir):
    """The whole logs of the five experiments that end best."""
    return experiments.traces(metric_log(spark, sf_dir), 5, "experiment_id", ["ts", "event_id"]).select("experiment_id", "event_id", "loss", "rank")


def worst_traces(spark, sf_dir):
    return experiments.traces(metric_log(spark, sf_dir), -3, "experiment_id", ["ts", "event_id"]).select("experiment_id", "event_id", "loss", "rank")


def rounded_metrics(spark, sf_dir):
    return experiments.rounded(table(spark, sf_dir, "events").select("event_id", (F.col("value") / 7).alias("t"), (F.col("value") / 11).alias("loss")))


def lr_train(spark, sf_dir):
    """A training task from a JobConfig: events as samples, four minibatches a step."""
    from gradmill.config import JobConfig
    from gradmill.models import tasks

    e = table(spark, sf_dir, "events")
    pairs = F.array(*[F.struct(F.lit(i).cast("long").alias("idx"), v.cast("double").alias("val")) for i, v in enumerate((F.lit(1.0), F.col("value") / 500, F.hour("ts") / 24))])
    rows = e.select((F.col("value") > 100).cast("double").alias("label"), pairs.alias("features"))
    c = JobConfig(model_bits=3, opt_method="adagrad", learning_rate=0.5, minibatch_size=100, s3_size=1000, train_set=(0, 1 << 40), test_set=(1 << 40, 1 << 41))
    samples = tasks.chunked(rows, c)
    count = samples.agg(F.max("chunk_id")).first()[0] + 1
    cut = max(count * 4 // 5, 1)
    task = tasks.LogisticRegressionTask(replace(c, train_set=(0, cut), test_set=(cut, max(count, cut + 1)) if count > cut else (cut, cut + 1)))
    task.run(spark, samples, steps=20, evaluate_every=10, workers=4)
    return task.metrics(spark).select("seq", F.round("loss", 4).alias("loss"), F.round("quality", 4).alias("accuracy"))


def cf_train(spark, sf_dir):
    """Matrix factorisation from a JobConfig: the RMSE after each of three epochs."""
    from gradmill.config import JobConfig
    from gradmill.models import tasks

    task = tasks.CollaborativeFilteringTask(JobConfig(model_type="CollaborativeFiltering", learning_rate=0.05, num_factors=3, minibatch_size=200))
    task.run(spark, ratings(spark, sf_dir), epochs=3)
    return task.metrics(spark).select("seq", F.round("quality", 6).alias("rmse"))


def grid_search(spark, sf_dir):
    """Four factorisations by a grid of settings, two at a time; the best two."""
    from gradmill.config import JobConfig
    from gradmill.models import tasks

    base = JobConfig(model_type="CollaborativeFiltering", num_factors=3, minibatch_size=200)
    grid = tasks.GridSearch(base, {"learning_rate": [0.01, 0.05], "num_factors": [2, 4]}, jobs=2, machines=2, epochs=2)
    grid.run(spark, materialise(ratings(spark, sf_dir), "ratings"))
    return grid.top(spark, 2).select("experiment_id", F.round("last_loss", 6).alias("last_loss"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lr_gradient_step, column_bounds, column_moments, minmax_scale, minmax_scale_constant_midpoint, normal_scale, trainer_minmax_scale, dense_zscore,
        per_user_standardize, feature_hash_columns, hash_encode_row, sparse_explode, nnz_stats, ratings_dense_ids, chunk_minibatch_ids, train_test_split_range,
        sparse_weight_pull, distinct_index_pull, lr_gradient_threshold, lr_loss_accuracy, lr_eval_by_minibatch, lr_dense_gradient, opt_sgd_step, opt_adagrad_step,
        opt_momentum_step, opt_nesterov_pull, lr_three_steps_sgd, softmax_loss, softmax_gradient, mf_predict, mf_rmse, mf_batch_gradient, mf_sequential_epoch, mf_sequential_items,
        global_mean_rmse, grid_product, grid_assignment, top_experiments, loss_dedup, cost_model, updates_per_second, kv_last_write, task_status_latest,
        task_lease_states, duplicate_launches, quality_checks, libsvm_export, rcv1_parse, text_hash_lr, stream_gradient_sink, crc32_rows,
        stream_factor_sink, model_snapshot, fleet_shortfall, best_traces, worst_traces, rounded_metrics, lr_train, cf_train, grid_search,
    )
}

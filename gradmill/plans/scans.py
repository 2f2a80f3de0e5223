"""Queries over the readers and writers, samples, and model tables, with their SQL.

The readers' queries write rows of the test tables as files of the format to the shared
folder, and read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradmill.functions import scalars
from gradmill.models import factorization, softmax
from gradmill.operators import checks, frames, preprocess
from gradmill.plans import catalogue
from gradmill.plans.catalogue import r6, table
from gradmill.plans.oracles import _SOFT
from gradmill.plans.sql import crc32, normal, uniform, x64
from gradmill.runtime import materialise, scratch
from gradmill.sources import readers, writers


def text_file(spark, name: str, lines: DataFrame, header: str | None = None) -> str:
    """The path of lines (a single column) written as text, with a header line in each file."""
    path = scratch(spark, name)
    if header is None:
        lines.write.text(path)
    else:
        lines.select(F.col(lines.columns[0]).alias(header)).write.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\u0001").csv(path)
    return path


def joined(delimiter: str, *parts: Column) -> Column:
    return F.concat_ws(delimiter, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).alias("value")


def dense_csv_scan(spark, sf_dir):
    """A column of words counts as 0, columns from the fifth on are not read."""
    lines = table(spark, sf_dir, "lineitem").select(joined(",", F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_linestatus"), F.col("l_discount"), F.col("l_tax")))
    rows = readers.dense_csv(spark, text_file(spark, "dense", lines), limit_cols=4)
    return rows.select("label", *[F.col("features")[i].alias(f"x{i}") for i in range(3)], F.size("features").alias("n"))


def wide_csv_scan(spark, sf_dir):
    """All 64 dimensions of embeddings as numbers, the label at the end."""
    numbers = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ",")
    lines = table(spark, sf_dir, "embeddings").select(F.concat_ws(",", numbers, F.col("label").cast("string")).alias("value"))
    rows = readers.dense_csv(spark, text_file(spark, "wide", lines), label_col=-1)
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return rows.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"), F.round(F.sum(total), 4).alias("total"))


def click_lines(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(joined(",", F.col("c_custkey"), F.col("c_custkey") % 2, F.col("c_name"), F.col("c_mktsegment"), F.lit(""), F.col("c_nationkey"), F.col("c_mktsegment")))


def click_log_scan(spark, sf_dir):
    """Every token from the third column on is hashed, the empty one and the constant
    too; equal tokens of a line fall together."""
    path = text_file(spark, "clicks", click_lines(spark, sf_dir), "Id,Label,C1,C2,C3,C4,C5")
    rows = readers.click_log_csv(spark, path, 12)
    return rows.select(F.col("sample_id").cast("long").alias("sample_id"), "label", F.inline("features"))


def click_log_tsv_scan(spark, sf_dir):
    """Without an id and a header: the label, 13 numbers that are not read, categories."""
    p = table(spark, sf_dir, "part")
    lines = p.select(joined("\t", F.col("p_partkey") % 2, *[F.lit(k) for k in range(13)], F.col("p_brand"), F.col("p_type"), F.col("p_brand")))
    rows = readers.click_log_csv(spark, text_file(spark, "categories", lines), 12, "\t", header=False, first=14, label_at=0, bias=False)
    return rows.select("label", F.inline("features"))


def rating_rows(spark, sf_dir) -> DataFrame:
    return catalogue.ratings(spark, sf_dir, F.max("value"))


def rating_scan(spark, sf_dir):
    """Ids from 1 and a header; with the largest ids."""
    lines = rating_rows(spark, sf_dir).select(joined(",", F.col("user_id") + 1, F.col("item_id"), F.col("rating"), F.lit(0)))
    rows = readers.ratings_csv(spark, text_file(spark, "ratings", lines, "userId,movieId,rating,timestamp"))
    most = rows.agg(F.max("user_id").alias("most_user"), F.max("item_id").alias("most_item"))
    return rows.crossJoin(F.broadcast(most))  # a single row


def rating_scan_plain(spark, sf_dir):
    """Ids from 0, no header; short lines are left out."""
    rows = rating_rows(spark, sf_dir).select(joined(",", F.col("user_id"), F.col("item_id"), F.col("rating")))
    path = text_file(spark, "plain", rows.unionByName(spark.createDataFrame([("",), ("1,",)], "value string")))
    return readers.ratings_csv(spark, path, header=False, user_base=0)


def rating_scan_dense_ids(spark, sf_dir):
    """Raw user ids with holes become dense ones, items count from 1."""
    lines = rating_rows(spark, sf_dir).select(joined(",", F.col("user_id") * 7 + 3, F.col("item_id") + 1, F.col("rating")))
    rows = readers.ratings_csv(spark, text_file(spark, "sparse", lines), header=False, user_base=0, item_base=1)
    return frames.with_dense_id(rows.withColumnRenamed("user_id", "raw_user"), "raw_user", "user_id")


def movie_block_scan(spark, sf_dir):
    """Blocks of an item's ratings, each a line with the item and lines of the ratings."""
    r = rating_rows(spark, sf_dir)
    block = r.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list(joined(",", F.col("user_id"), F.col("rating"), F.lit("2005-01-01")))), "\n").alias("lines"))  # of one item
    return readers.movie_blocks(spark, text_file(spark, "blocks", block.select(F.concat(F.col("item_id").cast("string"), F.lit(":\n"), F.col("lines")).alias("value"))))


def rating_matrix(spark, sf_dir):
    """A column for each item, 99 where there is no rating; values are divided by 10."""
    wide = rating_rows(spark, sf_dir).filter("(user_id + item_id) % 4 <> 0").groupBy("user_id").pivot("item_id", list(range(5))).agg(F.first("rating")).na.fill(99.0)
    return readers.unpivot_ratings(wide, "user_id", [str(i) for i in range(5)]).select("user_id", F.col("item_id").cast("long").alias("item_id"), r6("rating"))


def libsvm_lines(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    pairs = F.filter(F.array(*[F.struct(F.lit(i).alias("idx"), F.col(c).alias("val")) for i, c in catalogue.VALUES.items()]), lambda f: f["val"] != 0)
    return l.select(writers.libsvm_line((F.col("l_returnflag") == "R").cast("double"), pairs).alias("value"))


def libsvm_scan(spark, sf_dir):
    path = text_file(spark, "svm", libsvm_lines(spark, sf_dir))
    return readers.libsvm(spark.read.text(path)).select("label", F.inline("features")).groupBy("label", "idx").agg(F.count("*").alias("n"), F.min("val").alias("lo"), F.max("val").alias("hi"))


def libsvm_to_chunks(spark, sf_dir):
    """A file as chunks of 5,000 samples: rows and samples of label 1 in all, by chunk sizes."""
    path, to = text_file(spark, "svm", libsvm_lines(spark, sf_dir)), scratch(spark, "chunks")
    writers.libsvm_chunks(spark, path, to, 5_000, 20)
    sizes = spark.read.parquet(to).groupBy("chunk_id").agg(F.count("*").alias("size"), F.max("minibatch_id").cast("long").alias("last"), F.sum("label").alias("ones"))
    return sizes.agg(F.count("*").alias("chunks"), F.sum("size").alias("n"), F.max("size").alias("most"), F.max("last").alias("last"), F.sum("ones").alias("ones"))


def event_samples(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pairs = F.array(F.struct(F.lit(0).alias("idx"), F.floor("value").cast("double").alias("val")), F.struct((F.col("user_id") + 1).cast("int").alias("idx"), F.lit(0.5).alias("val")))
    return e.select(F.col("event_id").alias("position"), F.floor(F.col("event_id") / 1000).alias("chunk_id"), (F.col("event_type") == "purchase").cast("double").alias("label"), pairs.alias("features"))


def binary_chunk_scan(spark, sf_dir):
    """Samples as binary chunks of 1,000 and back."""
    chunks = materialise(writers.binary_chunks(event_samples(spark, sf_dir)), "binary")
    rows = readers.decode_chunks(chunks).select(F.col("path").cast("long").alias("chunk_id"), "place", F.col("label").cast("int").alias("label"), F.inline("features"))
    return rows.groupBy("chunk_id", "label").agg(F.count("*").alias("entries"), F.countDistinct("place").alias("rows"), F.sum("val").alias("total"), F.sum("idx").alias("idx_total"))


def rating_chunks(spark, sf_dir):
    """Ratings written by ranges of 20 users; two ranges are read."""
    path = scratch(spark, "rating-chunks")
    writers.write_rating_chunks(rating_rows(spark, sf_dir), path, 20)
    rows = frames.in_range(spark.read.parquet(path), (0, 2))
    return rows.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("user_id").alias("first"), F.max("user_id").alias("last"), F.round(F.sum("rating"), 4).alias("total")).withColumn("chunk_id", F.col("chunk_id").cast("long"))


def bounds_file(spark, sf_dir):
    """Bounds of events written as JSON, and the same columns scaled by what is read."""
    long, path = catalogue.event_long(spark, sf_dir), scratch(spark, "bounds")
    writers.write_bounds(preprocess.column_bounds(long), path)
    return preprocess.minmax_scale(long, 0.0, 1.0, writers.read_bounds(spark, path)).select("event_id", "idx", r6("val"))


def model_files(spark, sf_dir):
    """Weights, a softmax layer and factors saved as versions; the newest are read."""
    base = scratch(spark, "models")
    _, users, items = catalogue.factors(spark, sf_dir)
    _, layer = catalogue.softmax_inputs(spark, sf_dir)
    kinds = {"lr": catalogue.weights_table(spark), "softmax": layer, "users": users, "items": items}
    out = None
    for name, model in kinds.items():
        value = "bias" if "bias" in model.columns else "w"
        for version, scale in ((0, 1.0), (3, 2.0)):
            writers.write_model(model.withColumn(value, F.col(value) * scale), f"{base}/{name}", version)
        row = writers.read_model(spark, f"{base}/{name}").agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.lit(name).alias("model"), "n", (F.col("total") + 0.0).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


def row_limit(spark, sf_dir):
    """The first 1,000 orders by key: the limit is the operator."""
    placed = frames.with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return frames.first_rows(placed, "position", 1000).select("o_orderkey", "position")


def column_prefix(spark, sf_dir):
    return frames.first_columns(table(spark, sf_dir, "orders"), 3)


def value_summary(spark, sf_dir):
    return checks.summary(table(spark, sf_dir, "events"), "value").select("lo", "hi", r6("mean"), "n")


def factor_pull(spark, sf_dir):
    """The model's slice for the users from 5 to 44: theirs, and the items they rated high."""
    r, users, items = catalogue.factors(spark, sf_dir)
    mine, rated = factorization.pull(users, items, r.filter("rating > 1.5"), 5, 40)
    rows = mine.select(F.lit("user").alias("side"), F.col("user_id").alias("id"), "bias").unionByName(rated.select(F.lit("item").alias("side"), F.col("item_id").alias("id"), "bias"))
    return rows.select("side", "id", r6("bias"))


def sample_draws(spark, sf_dir):
    """As many draws with replacement as there are orders."""
    placed = frames.with_position(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return frames.draw(placed, "position", placed.count(), 7).select("draw", "o_orderkey")


def row_slice(spark, sf_dir):
    placed = frames.with_position(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return frames.contiguous(placed, "position", 500, 250).select("o_orderkey")


def shuffled_rows(spark, sf_dir):
    return frames.seeded_shuffle(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 42)


def train_test_rows(spark, sf_dir):
    return frames.train_test(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.8)


def k_folds(spark, sf_dir):
    return frames.equal_folds(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


def hash_folds(spark, sf_dir):
    return frames.with_fold(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5)


def user_ranges(spark, sf_dir):
    """Users dealt to seven workers by ranges of ids."""
    events = table(spark, sf_dir, "events")
    high = events.agg(F.max("user_id")).first()[0] + 1
    rows = frames.with_worker(events, "user_id", 0, high, 7)
    return rows.groupBy("worker").agg(F.min("user_id").alias("first"), F.max("user_id").alias("last"), F.count("*").alias("n"))


def scalar_functions(spark, sf_dir):
    """Numbers from tokens, tokens, closeness, first labels, the logarithm of zero."""
    o = table(spark, sf_dir, "orders")
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.lit(""), F.concat(F.round(F.col("o_totalprice"), 2).cast("decimal(18,2)").cast("string"), F.lit("x")), F.col("o_orderstatus"))
    t = scalars.tokens(line, "|")
    third = F.round(F.col("o_totalprice") / 3, 2)
    return o.select(
        "o_orderkey",
        F.size(t).alias("n"),
        scalars.to_number(t[2]).alias("price"),
        (scalars.to_number(t[1]) + scalars.to_number(t[3])).alias("none"),
        scalars.nearly(third * 3, F.col("o_totalprice")).alias("near"),
        F.array_join(scalars.first_labels(F.array(*[F.lit(str(k)) for k in range(6)])), ",").alias("labels"),
        (scalars.log_or_zero(F.col("o_orderkey") * 0.0) == -1e-49).alias("zero"),
    )


def random_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.select("o_orderkey", F.round(frames.uniform("o_orderkey", 42), 9).alias("u"), F.round(frames.normal("o_orderkey", 42), 6).alias("z"))


def zero_model(spark, sf_dir):
    """A model of 2^10 zeros after a pull of the indexes that occur."""
    w = frames.zero_weights(spark, 10)
    return catalogue.event_long(spark, sf_dir).select("idx").distinct().join(w, "idx").select("idx", "w", "h").unionByName(w.agg(F.count("*").cast("int").alias("idx"), F.sum("w").alias("w"), F.sum("h").alias("h")))


def softmax_update(spark, sf_dir):
    long, w = catalogue.softmax_inputs(spark, sf_dir)
    return softmax.update(w, softmax.gradient(long, w, "vec_id", catalogue.EPSILON), 0.5).select("j", "k", r6("w"))


def factor_start(spark, sf_dir):
    """Normal factors with a standard deviation of a third, for three factors."""
    users = factorization.initial_factors(table(spark, sf_dir, "events"), "user_id", 3, 42)
    return users.select("user_id", "bias", *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(3)])


def normalize_min_max(spark, sf_dir):
    return preprocess.normalize(catalogue.event_long(spark, sf_dir), preprocess.MIN_MAX, -2.0, 2.0).select("event_id", "idx", r6("val"))


def normalize_normal(spark, sf_dir):
    return preprocess.normalize(catalogue.event_long(spark, sf_dir), preprocess.NORMAL).select("event_id", "idx", r6("val"))


def crc32_lines(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", checks.checksum(F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment")).alias("crc"))


QUERIES = {
    f.__name__: f
    for f in (
        dense_csv_scan, wide_csv_scan, click_log_scan, click_log_tsv_scan, rating_scan, rating_scan_plain, rating_scan_dense_ids, movie_block_scan, rating_matrix,
        libsvm_scan, libsvm_to_chunks, binary_chunk_scan, rating_chunks, bounds_file, model_files, row_limit, column_prefix, value_summary, factor_pull, sample_draws,
        row_slice, shuffled_rows, train_test_rows, k_folds, hash_folds, user_ranges, scalar_functions, random_numbers, zero_model, softmax_update, factor_start,
        normalize_min_max, normalize_normal, crc32_lines,
    )
}

_RT = "names AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS item_id FROM (SELECT DISTINCT event_type FROM events)), rt AS (SELECT user_id, item_id, max(value) AS rating FROM events JOIN names USING (event_type) GROUP BY ALL)"
_EV = "ev AS (SELECT event_id, 0 AS idx, value AS val FROM events WHERE value <> 0 UNION ALL SELECT event_id, 1, hour(ts)::DOUBLE FROM events WHERE hour(ts) <> 0)"
_MINMAX = "min(val) OVER (PARTITION BY idx) AS a, max(val) OVER (PARTITION BY idx) AS b"
_PLACED = "o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)"
_SHUFFLED = "s AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS place FROM orders)"
_CLICKS = "toks AS (SELECT c_custkey AS sample_id, (c_custkey % 2)::DOUBLE AS label, unnest([c_name, c_mktsegment, '', c_nationkey::VARCHAR, c_mktsegment, 'bias']) AS t FROM customer)"

ORACLES = {
    "dense_csv_scan": "SELECT l_quantity AS label, l_extendedprice AS x0, 0.0::DOUBLE AS x1, l_discount AS x2, 3::INTEGER AS n FROM lineitem",
    "wide_csv_scan": "SELECT label, count(*) AS n, 64::INTEGER AS width, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 4) AS total FROM embeddings GROUP BY label",
    "click_log_scan": f"WITH RECURSIVE {_CLICKS}, {x64('toks')} SELECT sample_id, label, (h % 4096)::BIGINT AS idx, count(*)::DOUBLE AS val FROM toks JOIN hashed USING (t) GROUP BY ALL",
    "click_log_tsv_scan": f"WITH RECURSIVE toks AS (SELECT p_partkey AS sample_id, (p_partkey % 2)::DOUBLE AS label, unnest([p_brand, p_type, p_brand]) AS t FROM part), {x64('toks')}, c AS (SELECT sample_id, label, (h % 4096)::BIGINT AS idx, count(*)::DOUBLE AS val FROM toks JOIN hashed USING (t) GROUP BY ALL) SELECT label, idx, val FROM c",
    "rating_scan": f"WITH {_RT} SELECT *, max(user_id) OVER () AS most_user, max(item_id) OVER () AS most_item FROM rt",
    "rating_scan_plain": f"WITH {_RT} SELECT * FROM rt",
    "rating_scan_dense_ids": f"WITH {_RT} SELECT user_id * 7 + 3 AS raw_user, dense_rank() OVER (ORDER BY user_id) - 1 AS user_id, item_id, rating FROM rt",
    "movie_block_scan": f"WITH {_RT} SELECT * FROM rt",
    "rating_matrix": f"WITH {_RT} SELECT user_id, item_id, round(rating / 10, 6) AS rating FROM rt WHERE (user_id + item_id) % 4 <> 0 AND rating <> 99",
    "libsvm_scan": "WITH x AS (SELECT (l_returnflag = 'R')::INT::DOUBLE AS label, unnest([{'idx': 0, 'val': l_quantity}, {'idx': 1, 'val': l_extendedprice}, {'idx': 2, 'val': l_discount}, {'idx': 3, 'val': l_tax}], recursive := true) FROM lineitem) SELECT label, idx, count(*) AS n, min(val) AS lo, max(val) AS hi FROM x WHERE val <> 0 GROUP BY ALL",
    "libsvm_to_chunks": "SELECT (count(*) + 4999) // 5000 AS chunks, count(*) AS n, least(count(*), 5000) AS most, (least(count(*), 5000) - 1) // 20 AS last, sum((l_returnflag = 'R')::INT)::DOUBLE AS ones FROM lineitem",
    "binary_chunk_scan": "WITH x AS (SELECT event_id // 1000 AS chunk_id, (event_type = 'purchase')::INT AS label, floor(value) + 0.5 AS v, user_id + 1 AS i FROM events) SELECT chunk_id, label, 2 * count(*) AS entries, count(*) AS rows, sum(v) AS total, sum(i)::BIGINT AS idx_total FROM x GROUP BY ALL",
    "rating_chunks": f"WITH {_RT} SELECT (user_id // 20)::BIGINT AS chunk_id, count(*) AS n, min(user_id) AS first, max(user_id) AS last, round(sum(rating), 4) AS total FROM rt WHERE user_id // 20 < 2 GROUP BY 1",
    "bounds_file": f"WITH {_EV} SELECT event_id, idx, round((val - a) / (b - a), 6) + 0.0 AS val FROM (SELECT *, {_MINMAX} FROM ev)",
    "model_files": f"""WITH {_RT} SELECT 'lr' AS model, 3::BIGINT AS n, 1.2::DOUBLE AS total UNION ALL
      SELECT 'softmax', count(*), round(sum(2 * 0.001 * (j + 1) * (k - 4)), 6)::DOUBLE + 0.0 FROM range(64) a(j), range(10) b(k) UNION ALL
      SELECT 'users', count(*), round(sum(2 * (user_id % 11) / 100.0), 6)::DOUBLE FROM (SELECT DISTINCT user_id FROM rt) UNION ALL
      SELECT 'items', count(*), round(sum(2 * (item_id % 7) / 100.0), 6)::DOUBLE FROM (SELECT DISTINCT item_id FROM rt)""",
    "row_limit": f"WITH {_PLACED} SELECT o_orderkey, p AS position FROM o WHERE p < 1000",
    "column_prefix": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "value_summary": "SELECT min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, count(value) AS n FROM events",
    "factor_pull": f"WITH {_RT}, high AS (SELECT DISTINCT item_id FROM (SELECT user_id, item_id, avg(value) / 100 AS rating FROM events JOIN names USING (event_type) GROUP BY ALL) WHERE rating > 1.5 AND user_id BETWEEN 5 AND 44) SELECT 'user' AS side, user_id AS id, user_id % 11 / 100.0::DOUBLE AS bias FROM (SELECT DISTINCT user_id FROM rt) WHERE user_id BETWEEN 5 AND 44 UNION ALL SELECT 'item', item_id, item_id % 7 / 100.0::DOUBLE FROM high",
    "sample_draws": f"WITH {_PLACED}, d AS (SELECT i AS draw, floor({uniform('i', 7)} * (SELECT count(*) FROM orders))::BIGINT AS p FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS i)) SELECT draw, o_orderkey FROM d JOIN o USING (p)",
    "row_slice": f"WITH {_PLACED} SELECT o_orderkey FROM o WHERE p BETWEEN 500 AND 749",
    "shuffled_rows": f"WITH {_SHUFFLED} SELECT o_orderkey, o_orderstatus, place FROM s",
    "train_test_rows": f"SELECT o_orderkey, {uniform('o_orderkey', 42)} < 0.8 AS train FROM orders",
    "k_folds": f"WITH {_SHUFFLED}, n AS (SELECT count(*) // 7 AS size FROM orders) SELECT o_orderkey, (place // size)::INTEGER AS fold FROM s, n WHERE place < 7 * size",
    "hash_folds": f"SELECT o_orderkey, floor({uniform('o_orderkey', 42)} * 5)::INTEGER AS fold FROM orders",
    "user_ranges": "WITH m AS (SELECT (max(user_id) + 1) // 7 + 1 AS size FROM events) SELECT (user_id // size)::INTEGER AS worker, min(user_id) AS first, max(user_id) AS last, count(*) AS n FROM events, m GROUP BY 1",
    "scalar_functions": "SELECT o_orderkey, 4::INTEGER AS n, round(o_totalprice, 2) AS price, 0.0::DOUBLE AS none, abs(round(o_totalprice / 3, 2) * 3 - o_totalprice) < 1e-7 AS near, '0,1,2,3' AS labels, true AS zero FROM orders",
    "random_numbers": f"SELECT o_orderkey, round({uniform('o_orderkey', 42)}, 9) AS u, round({normal('o_orderkey', 42)}, 6) AS z FROM orders",
    "zero_model": f"WITH {_EV} SELECT DISTINCT idx, 0.0::DOUBLE AS w, 0.0::DOUBLE AS h FROM ev UNION ALL SELECT 1024, 0.0, 0.0",
    "softmax_update": f"WITH {_SOFT} SELECT j::INTEGER AS j, k::INTEGER AS k, round(0.001 * (j + 1) * (k - 4) - 0.5 * (g / (SELECT count(*) FROM e) + 1e-4 * 0.001 * (j + 1) * (k - 4)), 6) + 0.0 AS w FROM ({' UNION ALL '.join(f'SELECT {i} AS j, k, sum(x{i} * (p - (k = label)::INT)) AS g FROM sm GROUP BY k' for i in range(64))})",
    "factor_start": f"SELECT DISTINCT user_id, 0.0::DOUBLE AS bias, {', '.join(f'''round({normal(f"user_id || '/{i}'", 42)} / 3, 6) AS f{i}''' for i in range(3))} FROM events",
    "normalize_min_max": f"WITH {_EV} SELECT event_id, idx, round((val - a) / (b - a) * 4 - 2, 6) + 0.0 AS val FROM (SELECT *, {_MINMAX} FROM ev)",
    "normalize_normal": f"WITH {_EV} SELECT event_id, idx, round((val - avg(val) OVER w) / stddev_pop(val) OVER w, 6) + 0.0 AS val FROM ev WINDOW w AS (PARTITION BY idx)",
    "crc32_lines": f"SELECT c_custkey, {crc32('''c_custkey || '|' || c_name || '|' || c_mktsegment''')} AS crc FROM customer",
}

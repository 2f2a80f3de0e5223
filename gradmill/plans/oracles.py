"""DuckDB SQL for the catalogue's queries, written apart from the Spark code."""

from __future__ import annotations

from gradmill.plans.sql import crc32, x64

_LINES = """
lines AS (
  SELECT 0 AS idx, l_quantity AS val FROM lineitem WHERE l_quantity <> 0 UNION ALL
  SELECT 1, l_extendedprice FROM lineitem WHERE l_extendedprice <> 0 UNION ALL
  SELECT 2, l_discount FROM lineitem WHERE l_discount <> 0 UNION ALL
  SELECT 3, l_tax FROM lineitem WHERE l_tax <> 0
)"""
_EVENTS = """
ev AS (
  SELECT event_id, 0 AS idx, value AS val FROM events WHERE value <> 0 UNION ALL
  SELECT event_id, 1, hour(ts)::DOUBLE FROM events WHERE hour(ts) <> 0
)"""
_EVENTS3 = _EVENTS[:-1] + "  UNION ALL SELECT event_id, 2, 7.0::DOUBLE FROM events\n)"
_STATS = """st AS (
  SELECT min(nullif(l_quantity, 0)) a0, max(nullif(l_quantity, 0)) b0, min(nullif(l_extendedprice, 0)) a1, max(nullif(l_extendedprice, 0)) b1,
         min(nullif(l_discount, 0)) a2, max(nullif(l_discount, 0)) b2, min(nullif(l_tax, 0)) a3, max(nullif(l_tax, 0)) b3 FROM lineitem
), x AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y,
         CASE WHEN l_quantity = 0 THEN 0.0 ELSE (l_quantity - a0) / (b0 - a0) END AS x0,
         CASE WHEN l_extendedprice = 0 THEN 0.0 ELSE (l_extendedprice - a1) / (b1 - a1) END AS x1,
         CASE WHEN l_discount = 0 THEN 0.0 ELSE (l_discount - a2) / (b2 - a2) END AS x2,
         CASE WHEN l_tax = 0 THEN 0.0 ELSE (l_tax - a3) / (b3 - a3) END AS x3
  FROM lineitem, st
)"""


def _step(n: int, source: str) -> str:
    """A gradient over x with the weights of `source` (w0..w3): g0.., as table g<n>."""
    return f"""r{n} AS (SELECT x.*, w0, w1, w2, w3, 1 / (1 + exp(-(x0 * w0 + x1 * w1 + x2 * w2 + x3 * w3))) AS p FROM x, {source}),
g{n} AS (SELECT {', '.join(f'sum(x{i} * (y - p)) + 0.0002 * any_value(w{i}) AS g{i}, any_value(w{i}) AS w{i}' for i in range(4))},
  avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS loss, avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM r{n})"""


_W0 = "w AS (SELECT 0.1::DOUBLE w0, 0.2::DOUBLE w1, 0.3::DOUBLE w2, 0.4::DOUBLE w3)"
_GRAD = f"{_STATS}, {_W0}, {_step(0, 'w')}"
_MEAN = f"{_GRAD}, gs AS ({' UNION ALL '.join(f'SELECT {i} AS idx, g{i} / n AS g FROM g0' for i in range(4))}), ws(idx, w, h) AS (VALUES (0, 0.1::DOUBLE, 0.0::DOUBLE), (1, 0.2, 0.01), (2, 0.3, 0.02), (3, 0.4, 0.03), (4, 0.5, 0.04))"
_MOM = f"{_MEAN}, m AS (SELECT m0, 0.9 * m0 + 0.05 * g1 AS m1, 0.9 * (0.9 * m0 + 0.05 * g1) + 0.05 * g2 AS m2, 0.9 * (0.9 * (0.9 * m0 + 0.05 * g1) + 0.05 * g2) + 0.05 * g3 AS m3 FROM (SELECT g0 / n AS m0, g1 / n AS g1, g2 / n AS g2, g3 / n AS g3 FROM g0)), mw AS ({' UNION ALL '.join(f'SELECT {i} AS idx, {0.1 * (i + 1):.1f} + m{i} AS w FROM m' for i in range(4))} UNION ALL SELECT 4, 0.5)"
_THREE = f"{_GRAD}, v1 AS (SELECT {', '.join(f'w{i} + g{i} / n AS w{i}' for i in range(4))} FROM g0), {_step(1, 'v1')}, v2 AS (SELECT {', '.join(f'w{i} + g{i} / n AS w{i}' for i in range(4))} FROM g1), {_step(2, 'v2')}"
_DIMS = "e AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(64)) + " FROM embeddings)"
_EP = f"{_DIMS}, ep AS (SELECT *, CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END AS y, 1 / (1 + exp(-({' + '.join(f'x{i} * {0.1 * (i % 8 + 1)!r}::DOUBLE' for i in range(64))}))) AS p FROM e)"
_LOSS = "round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS loss, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n"
_SAMPLES = "s AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS y, value / 500 AS x0, hour(ts) / 24.0::DOUBLE AS x1, (user_id % 7)::DOUBLE AS x2 FROM events), sp AS (SELECT *, 1 / (1 + exp(-(0.1 * x0 + 0.2 * x1 + 0.3 * x2))) AS p FROM s WHERE x0 <> 0 OR x1 <> 0 OR x2 <> 0)"
_SOFT = _DIMS + ", sc AS (SELECT vec_id, label, k, " + ", ".join(f"x{i}" for i in range(64)) + ", exp(" + " + ".join(f"x{i} * (0.001::DOUBLE * {i + 1} * (k - 4))" for i in range(64)) + ") AS ex FROM e, range(10) t(k)), sm AS (SELECT *, ex / sum(ex) OVER (PARTITION BY vec_id) AS p FROM sc)"
_RATINGS = "names AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS item_id FROM (SELECT DISTINCT event_type FROM events)), rt AS (SELECT user_id, item_id, avg(value) / 100 AS rating FROM events JOIN names USING (event_type) GROUP BY ALL)"


def _side(key: str, a: int) -> str:
    return f"(SELECT {key}, {key} % {a} / 100.0::DOUBLE AS bias, {', '.join(f'{key} * {i + 3} % {a} / 50.0::DOUBLE - 0.1::DOUBLE AS f{i}' for i in range(3))} FROM (SELECT DISTINCT {key} FROM rt))"


_MF = f"{_RATINGS}, u AS {_side('user_id', 11)}, it AS {_side('item_id', 7)}, pr AS (SELECT rt.*, u.bias AS bu, it.bias AS bi, {', '.join(f'u.f{i} AS p{i}, it.f{i} AS q{i}' for i in range(3))}, 3.604::DOUBLE + u.bias + it.bias + u.f0 * it.f0 + u.f1 * it.f1 + u.f2 * it.f2 AS prediction FROM rt JOIN u USING (user_id) JOIN it USING (item_id))"


_LAST = "lst AS (SELECT user_id AS experiment_id, arg_max(round(value, 4), (ts, event_id)) AS last_loss FROM events GROUP BY 1)"
#: One row a rating and block of users: the user's state and all items' after it.
_SEQUENTIAL = f"""WITH RECURSIVE {_RATINGS}, u AS {_side('user_id', 11)}, it AS {_side('item_id', 7)},
o AS (SELECT user_id // 200 AS block, row_number() OVER (PARTITION BY user_id // 200 ORDER BY user_id, item_id) AS r, user_id, item_id + 1 AS i, rating, bias, [f0, f1, f2] AS f FROM rt JOIN u USING (user_id)),
s AS (SELECT block, 0::BIGINT AS r, -1::BIGINT AS user_id, 0.0::DOUBLE AS bu, [0.0::DOUBLE] AS p, (SELECT list(bias ORDER BY item_id) FROM it) AS b, (SELECT list([f0, f1, f2] ORDER BY item_id) FROM it) AS q FROM (SELECT DISTINCT block FROM o)
UNION ALL SELECT block, r, user_id, bu, p, list_transform(b, lambda x, n: CASE WHEN n = i THEN x + 0.01 * (e - 0.01 * x) ELSE x END), list_transform(q, lambda x, n: CASE WHEN n = i THEN [x[1] + 0.01 * (e * p[1] - 0.01 * x[1]), x[2] + 0.01 * (e * p[2] - 0.01 * x[2]), x[3] + 0.01 * (e * p[3] - 0.01 * x[3])] ELSE x END)
FROM (SELECT block, r, user_id, i, e, b, q, bu + 0.01 * (e - 0.01 * bu) AS bu, list_transform(p, lambda x, n: x + 0.01 * (e * q[i][n] - 0.01 * x)) AS p
FROM (SELECT *, rating - (3.604::DOUBLE + bu + b[i] + p[1] * q[i][1] + p[2] * q[i][2] + p[3] * q[i][3]) AS e
FROM (SELECT o.block, o.r, o.user_id, o.i, o.rating, s.b, s.q, CASE WHEN o.user_id = s.user_id THEN s.bu ELSE o.bias END AS bu, CASE WHEN o.user_id = s.user_id THEN s.p ELSE o.f END AS p FROM s JOIN o ON o.block = s.block AND o.r = s.r + 1))))"""


def _mix(k: str) -> str:
    """k scrambled; k is an SQL expression of a UBIGINT below 2 ** 32."""
    one = f"((({k}) * 3432918353::UHUGEINT) & 4294967295::UHUGEINT)"
    two = f"((({one} << 15) | ({one} >> 17)) & 4294967295::UHUGEINT)"
    return f"(({two} * 461845907::UHUGEINT) & 4294967295::UHUGEINT)"


def _murmur(text: str) -> str:
    """Murmur3_x86_32 (seed 42) of an SQL text of ASCII characters."""
    code = lambda at: f"ascii(substr({text}, {at}, 1))::UHUGEINT"
    word = f"({code('4 * i + 1')} + {code('4 * i + 2')} * 256 + {code('4 * i + 3')} * 65536 + {code('4 * i + 4')} * 16777216)"
    words = f"list_transform(range(length({text}) // 4), lambda i: {word})"
    x = f"xor(a, {_mix('k')})"
    step = f"(((((({x} << 13) | ({x} >> 19)) & 4294967295::UHUGEINT) * 5) + 3864292196) & 4294967295::UHUGEINT)"
    h = f"list_reduce(list_prepend(42::UHUGEINT, {words}), lambda a, k: {step})"
    at = f"(length({text}) // 4 * 4)"
    tail = f"(CASE length({text}) % 4 WHEN 0 THEN 0::UHUGEINT WHEN 1 THEN {code(at + ' + 1')} WHEN 2 THEN {code(at + ' + 1')} + {code(at + ' + 2')} * 256 ELSE {code(at + ' + 1')} + {code(at + ' + 2')} * 256 + {code(at + ' + 3')} * 65536 END)"
    return f"xor(xor({h}, {_mix(tail)}), length({text})::UHUGEINT)"


_HASHED = f"""toks AS (SELECT event_id, event_type AS t FROM events UNION ALL SELECT event_id, user_id::VARCHAR FROM events),
d0 AS (SELECT t, {_murmur('t')} AS h FROM (SELECT DISTINCT t FROM toks)),
d1 AS (SELECT t, xor(h, h >> 16) * 2246822507::UHUGEINT & 4294967295::UHUGEINT AS h FROM d0),
d2 AS (SELECT t, xor(h, h >> 13) * 3266489909::UHUGEINT & 4294967295::UHUGEINT AS h FROM d1),
d3 AS (SELECT t, (xor(h, h >> 16) % 16)::INTEGER AS idx FROM d2)"""

ORACLES = {
    "lr_gradient_step": f"WITH {_GRAD} SELECT {', '.join(f'round(g{i}, 6) AS g{i}' for i in range(4))}, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, n FROM g0",
    "column_bounds": f"WITH {_LINES} SELECT idx, min(val) AS lo, max(val) AS hi, count(*) AS n FROM lines GROUP BY idx",
    "column_moments": f"WITH {_LINES} SELECT idx, round(avg(val), 4) AS mean, round(CASE WHEN var_pop(val) <= 1e-4 THEN 0 ELSE stddev_pop(val) END, 4) AS sd, count(*) AS n FROM lines GROUP BY idx",
    "minmax_scale": f"WITH {_EVENTS} SELECT event_id, idx, round(CASE WHEN b - a > 1e-4 THEN (val - a) / (b - a) * 2 - 1 ELSE 0 END, 6) + 0.0 AS val FROM (SELECT *, min(val) OVER w AS a, max(val) OVER w AS b FROM ev WINDOW w AS (PARTITION BY idx))",
    "minmax_scale_constant_midpoint": f"WITH {_EVENTS3} SELECT event_id, idx, round(CASE WHEN b - a > 1e-4 THEN (val - a) / (b - a) * 3 ELSE 1.5 END, 6) + 0.0 AS val FROM (SELECT *, min(val) OVER w AS a, max(val) OVER w AS b FROM ev WINDOW w AS (PARTITION BY idx))",
    "normal_scale": f"WITH {_EVENTS3} SELECT event_id, idx, round(CASE WHEN v <= 1e-4 THEN 0 ELSE (val - m) / sqrt(v) END, 6) + 0.0 AS val FROM (SELECT *, avg(val) OVER w AS m, var_pop(val) OVER w AS v FROM ev WINDOW w AS (PARTITION BY idx))",
    "trainer_minmax_scale": "WITH o AS (SELECT o_orderkey, 0 AS idx, o_totalprice AS val FROM orders UNION ALL SELECT o_orderkey, 1, -o_totalprice FROM orders UNION ALL SELECT o_orderkey, 2, 0.0 FROM orders) SELECT o_orderkey, idx, round(CASE WHEN b <> a THEN (val - a) / (b - a) ELSE val END, 6) + 0.0 AS val FROM (SELECT *, min(val) OVER w AS a, greatest(max(val) OVER w, 0) AS b FROM o WINDOW w AS (PARTITION BY idx))",
    "dense_zscore": f"WITH {_DIMS} SELECT vec_id, {', '.join(f'round((x{i} - avg(x{i}) OVER ()) / stddev_pop(x{i}) OVER (), 6) + 0.0 AS x{i}' for i in range(64))} FROM e",
    "per_user_standardize": "SELECT event_id, user_id, round((value - m) / s, 6) + 0.0 AS value FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m, stddev_pop(value) OVER (PARTITION BY user_id) AS s FROM events) WHERE s <> 0",
    "feature_hash_columns": f"WITH {_HASHED} SELECT event_id, idx, count(*)::DOUBLE AS val FROM toks JOIN d3 USING (t) GROUP BY ALL UNION ALL SELECT event_id, 17, round(value, 6) FROM events",
    "sparse_explode": f"WITH {_EVENTS} SELECT event_id, idx, round(val, 6) AS val FROM ev",
    "nnz_stats": f"WITH {_LINES} SELECT (SELECT count(*) FROM lines) AS entries, count(*) AS rows, max((l_quantity <> 0)::INT + (l_extendedprice <> 0)::INT + (l_discount <> 0)::INT + (l_tax <> 0)::INT) AS most FROM lineitem",
    "ratings_dense_ids": f"WITH {_RATINGS} SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS user_id, user_id AS raw_user, item_id, round(rating, 6) AS rating FROM rt",
    "chunk_minibatch_ids": "SELECT o_orderkey, p AS position, p // 1000 AS chunk_id, p % 1000 // 20 AS minibatch_id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)",
    "train_test_split_range": "WITH o AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS c FROM orders), m AS (SELECT (max(c) + 1) * 4 // 5 AS cut FROM o) SELECT CASE WHEN c < cut THEN 'train' ELSE 'test' END AS side, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o, m GROUP BY 1",
    "sparse_weight_pull": f"WITH {_LINES} SELECT idx, count(*) AS requests, CASE WHEN idx < 3 THEN round(0.1 * (idx + 1), 1)::DOUBLE ELSE 0 END AS w FROM lines GROUP BY idx",
    "distinct_index_pull": f"WITH {_LINES} SELECT DISTINCT idx, round(0.1 * (idx + 1), 1)::DOUBLE AS w FROM lines WHERE idx < 3",
    "lr_gradient_threshold": f"WITH {_SAMPLES}, g AS ({' UNION ALL '.join(f'SELECT {i} AS idx, sum(x{i} * (y - p)) AS d, {0.1 * (i + 1):.1f} * 0.0002 AS pen FROM sp' for i in range(3))}) SELECT idx, round(d + pen, 6) AS g FROM g WHERE d <> 0 AND abs(d + pen) > 300",
    "lr_loss_accuracy": f"WITH {_EP} SELECT {_LOSS} FROM ep",
    "lr_eval_by_minibatch": f"WITH {_SAMPLES}, mb AS (SELECT event_id // 20 AS b, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) AS loss, avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM sp GROUP BY 1) SELECT round(sum(loss) / sum(n), 6) AS loss, round(avg(accuracy), 6) AS accuracy, sum(n)::BIGINT AS n FROM mb",
    "lr_dense_gradient": f"WITH {_EP} SELECT {', '.join(f'round(sum(x{i} * (y - p)) + 0.0002 * {0.1 * (i % 8 + 1)!r}, 6) + 0.0 AS g{i}' for i in range(64))}, {_LOSS} FROM ep",
    "opt_sgd_step": f"WITH {_MEAN} SELECT idx, round(w + coalesce(0.5 * g, 0), 6) AS w FROM ws LEFT JOIN gs USING (idx)",
    "opt_adagrad_step": f"WITH {_MEAN} SELECT idx, round(w + 0.5 * coalesce(g, 0) / (1e-4 + sqrt(h + coalesce(g, 0) ** 2)), 6) AS w, round(h + coalesce(g, 0) ** 2, 6) AS h FROM ws LEFT JOIN gs USING (idx)",
    "opt_momentum_step": f"WITH {_MOM} SELECT idx, round(w, 6) AS w FROM mw",
    "opt_nesterov_pull": f"WITH {_MOM} SELECT idx, round(w + 0.9 * m3, 6) AS w FROM mw, m",
    "lr_three_steps_sgd": f"WITH {_THREE} SELECT {', '.join(f'round(w{i} + g{i} / n, 6) AS w{i}' for i in range(4))}, n FROM g2",
    "softmax_loss": f"WITH {_SOFT} SELECT round(avg(CASE WHEN own < 1e-10 THEN 1e-10 ELSE -ln(own) END), 6) AS loss, round(avg((own >= best)::INT), 6) AS accuracy, count(*) AS n FROM (SELECT max(p) AS best, max(CASE WHEN k = label THEN p END) AS own FROM sm GROUP BY vec_id)",
    "softmax_gradient": f"WITH {_SOFT} SELECT j::INTEGER AS j, k::INTEGER AS k, round(g / (SELECT count(*) FROM e) + 1e-4 * 0.001 * (j + 1) * (k - 4), 6) + 0.0 AS g FROM ({' UNION ALL '.join(f'SELECT {i} AS j, k, sum(x{i} * (p - (k = label)::INT)) AS g FROM sm GROUP BY k' for i in range(64))})",
    "mf_predict": f"WITH {_MF} SELECT user_id, item_id, round(prediction, 6) AS prediction FROM pr",
    "mf_rmse": f"WITH {_MF} SELECT round(sqrt(avg((rating - prediction) ** 2)), 6) AS rmse, count(*) AS n FROM pr",
    "mf_batch_gradient": f"WITH {_MF} SELECT user_id, round(any_value(bu) + sum(0.01 * (rating - prediction - 0.05 * bu)), 6) AS bias, {', '.join(f'round(any_value(p{i}) + sum(0.01 * ((rating - prediction) * q{i} - 0.05 * p{i})), 6) AS f{i}' for i in range(3))} FROM pr GROUP BY user_id",
    "global_mean_rmse": f"WITH {_RATINGS} SELECT round(sqrt(avg((rating - (SELECT avg(rating) FROM rt WHERE (user_id + item_id) % 5 <> 0)) ** 2)), 6) AS rmse, count(*) AS n FROM rt WHERE (user_id + item_id) % 5 = 0",
    "grid_product": "WITH a(i, workers) AS (VALUES (0, 8), (1, 16), (2, 32)), b(j, rate) AS (VALUES (0, 0.001::DOUBLE), (1, 0.01)), c(k, bits) AS (VALUES (0, 10), (1, 19)) SELECT (i * 4 + j * 2 + k)::BIGINT AS experiment_id, workers::INTEGER AS workers, rate, bits::INTEGER AS bits FROM a, b, c",
    "grid_assignment": "SELECT i % 5 AS machine, count(*) AS n, min(i) AS first FROM range(12) t(i) GROUP BY 1",
    "top_experiments": "SELECT experiment_id, last_loss FROM (SELECT user_id AS experiment_id, round(value, 4) AS last_loss, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 ORDER BY last_loss, experiment_id LIMIT 10",
    "loss_dedup": "SELECT experiment_id, event_id, coarse FROM (SELECT *, lag(coarse) OVER (PARTITION BY experiment_id ORDER BY ts, event_id) AS b FROM (SELECT user_id AS experiment_id, ts, event_id, floor(round(value, 4) / 50)::BIGINT AS coarse FROM events)) WHERE b IS NULL OR b <> coarse",
    "cost_model": "SELECT round(sum(r * s), 2) AS cost, round(sum(r), 2) AS cost_per_second FROM (SELECT c_custkey % 100 AS s, round((2 * 0.007488 * (c_custkey % 16 + 1) / 3600 + 0.096 / 3600 + c_nationkey * 1000 / 1024.0 * 0.023 / 720 / 3600)::DOUBLE * 1e6, 6) AS r FROM customer)",
    "updates_per_second": "SELECT epoch(date_trunc('second', ts))::BIGINT AS second, count(*) AS updates FROM events GROUP BY 1",
    "kv_last_write": "SELECT event_type, value, writes FROM (SELECT event_type, round(value, 6) AS value, count(*) OVER (PARTITION BY event_type) AS writes, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "task_status_latest": "SELECT u.user_id, coalesce(s.status, 0) AS status FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT DISTINCT ON (user_id) user_id, floor(value)::BIGINT AS status FROM events WHERE event_type = 'click' ORDER BY user_id, ts DESC, event_id DESC) s USING (user_id)",
    "task_lease_states": """WITH l AS (SELECT event_id, user_id, CASE WHEN event_type = 'signup' THEN 'register' ELSE 'deregister' END AS op, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type IN ('signup', 'error')),
      f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM l),
      b AS (SELECT user_id, min(r) AS r0, arg_min(t, r) AS t0 FROM f WHERE op = 'register' GROUP BY user_id),
      d AS (SELECT user_id, min(f.r) AS r1 FROM f JOIN b USING (user_id) WHERE op = 'deregister' AND f.r > r0 GROUP BY user_id)
      SELECT event_id, f.user_id, op, CASE WHEN op = 'register' THEN (f.r > r0)::INT WHEN r0 IS NULL OR f.r < r0 THEN 2 WHEN f.r > r1 OR t - t0 > 86403 THEN 1 ELSE 0 END AS code
      FROM f LEFT JOIN b ON f.user_id = b.user_id LEFT JOIN d ON f.user_id = d.user_id""",
    "duplicate_launches": "SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents",
    "quality_checks": "SELECT count(*) AS n, count(*) FILTER (l_tax IS NULL OR isnan(l_tax) OR isinf(l_tax)) AS bad_tax, 0::BIGINT AS bad_label, count(*) FILTER (NOT l_linenumber >= 0) AS bad_line, count(*) FILTER (l_quantity > 45 OR l_quantity < -45) AS bad_rating FROM lineitem",
    "libsvm_export": f"SELECT line, count(*) AS n FROM (SELECT concat_ws(' ', (l_returnflag = 'R')::INT, {', '.join(f'CASE WHEN round({c} * 100) <> 0 THEN {i} || chr(58) || round({c} * 100)::BIGINT END' for i, c in enumerate(('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax')))}) AS line FROM lineitem) GROUP BY line",
    "rcv1_parse": "SELECT o_orderkey, (o_custkey % 5 + 1) || ',' || (o_orderkey % 3 + 1) AS labels, CASE WHEN o_custkey % 7 = o_orderkey % 7 THEN 1 ELSE 2 END AS n, (2 * (o_custkey % 7 + 1) + o_orderkey % 10 * (o_orderkey % 7 + 1))::DOUBLE AS weighted FROM orders",
    "hash_encode_row": f"WITH RECURSIVE toks AS (SELECT p_partkey, unnest([p_brand, p_type, 'bias']) AS t FROM part), {x64('toks')} SELECT p_partkey, (h % 1024)::BIGINT AS idx, count(*)::DOUBLE AS val FROM toks JOIN hashed USING (t) GROUP BY ALL",
    "text_hash_lr": f"WITH RECURSIVE toks AS (SELECT quality AS y, unnest(list_append(string_split(text, ' '), 'bias')) AS t FROM documents JOIN labels USING (doc_id)), {x64('toks')} SELECT (h % 16384)::BIGINT AS idx, round(sum(y - 0.5::DOUBLE), 6) + 0.0 AS g FROM toks JOIN hashed USING (t) GROUP BY 1",
    "stream_gradient_sink": "SELECT (user_id % 4)::INTEGER AS idx, round(sum(value / 1e6), 6) AS w FROM events GROUP BY 1",
    "stream_factor_sink": "SELECT user_id % 5 AS id, round(0.5 + sum(value / 1e6), 6) AS bias, round(sum(value * 2 / 1e6), 6) AS f0, round(user_id % 5 - sum(value / 1e6), 6) AS f1 FROM events GROUP BY 1",
    "model_snapshot": "SELECT i::INTEGER AS idx, round(1 + 0.5 * coalesce(sum(value) / 1e6, 0), 6) AS w FROM range(3) t(i) LEFT JOIN events ON user_id % 2 = i GROUP BY i",
    "crc32_rows": f"SELECT r_regionkey, {crc32("r_regionkey || '|' || r_name")} AS crc FROM region",
    "fleet_shortfall": """WITH l AS (SELECT event_id, user_id, event_type = 'signup' AS reg, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type IN ('signup', 'error')), z AS (SELECT min(t) + 604800 AS upto FROM l),
      b AS (SELECT user_id, min(row(t, event_id)) AS s FROM l, z WHERE reg AND t <= upto GROUP BY user_id),
      d AS (SELECT DISTINCT l.user_id FROM l JOIN b USING (user_id), z WHERE NOT reg AND t <= upto AND row(t, event_id) > s AND t - s[1] <= 86403)
      SELECT count(*) AS running, greatest(1000 - count(*), 0) AS to_start FROM b, z WHERE upto - s[1] <= 86403 AND user_id NOT IN (SELECT user_id FROM d)""",
    "best_traces": f"WITH {_LAST}, r AS (SELECT experiment_id, row_number() OVER (ORDER BY last_loss, experiment_id)::INTEGER AS rank FROM lst) SELECT user_id AS experiment_id, event_id, round(value, 4) AS loss, rank FROM events JOIN r ON user_id = experiment_id WHERE rank <= 5",
    "worst_traces": f"WITH {_LAST}, r AS (SELECT experiment_id, row_number() OVER (ORDER BY last_loss DESC, experiment_id)::INTEGER AS rank FROM lst) SELECT user_id AS experiment_id, event_id, round(value, 4) AS loss, rank FROM events JOIN r ON user_id = experiment_id WHERE rank <= 3",
    "rounded_metrics": "SELECT event_id, round(value / 7, 3) AS t, round(value / 11, 4) AS loss FROM events",
    "mf_sequential_epoch": f"{_SEQUENTIAL} SELECT user_id, round(arg_max(bu, r), 6) AS bias, {', '.join(f'round(arg_max(p[{i + 1}], r), 6) AS f{i}' for i in range(3))} FROM s WHERE r > 0 GROUP BY user_id",
    "mf_sequential_items": f"{_SEQUENTIAL}, z AS (SELECT block, arg_max(b, r) AS b, arg_max(q, r) AS q FROM s GROUP BY block) SELECT item_id, round(any_value(it.bias) + sum(z.b[item_id + 1] - it.bias), 6) AS bias, {', '.join(f'round(any_value(it.f{i}) + sum(z.q[item_id + 1][{i + 1}] - it.f{i}), 6) AS f{i}' for i in range(3))} FROM it, z GROUP BY item_id",
}

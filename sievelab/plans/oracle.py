"""Independent DuckDB SQL for the registered queries, on the same tables."""

from __future__ import annotations

WIDE = """
wide AS (
  SELECT o_orderkey AS row_id, o_totalprice AS y, o_orderdate AS end_time, o_orderpriority AS lot_id,
         l.cnt AS "line.cnt", l.qty AS "line.qty", l.price AS "line.price", l.disc AS "line.disc", l.tax AS "line.tax",
         c_acctbal AS "cust.acctbal", CAST(c_nationkey AS DOUBLE) AS "cust.nation",
         CAST(1 AS DOUBLE) AS "const.one", CAST(NULL AS DOUBLE) AS "null.all"
  FROM orders
  LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS cnt, round(sum(l_quantity), 2) AS qty,
                    round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS disc,
                    round(avg(l_tax), 6) AS tax
             FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey)"""

SEVEN = '"line.cnt", "line.qty", "line.price", "line.disc", "line.tax", "cust.acctbal", "cust.nation"'

LONG = f"""{WIDE},
long AS (
  SELECT row_id, variable, value
  FROM (SELECT row_id, {SEVEN}, "const.one", "null.all" FROM wide)
  UNPIVOT INCLUDE NULLS (value FOR variable IN ({SEVEN}, "const.one", "null.all")))"""

FILLED = f"""{LONG},
filled AS (
  SELECT row_id, variable, coalesce(value, avg(value) OVER (PARTITION BY variable)) AS value
  FROM long WHERE variable NOT IN ('const.one', 'null.all'))"""

EMB = """
base AS (
  SELECT vec_id AS row_id, embedding,
         CAST(0.05 AS DOUBLE) * label + CAST(3 AS DOUBLE) * CAST(embedding[9] AS DOUBLE)
         + CAST(-2 AS DOUBLE) * CAST(embedding[36] AS DOUBLE) + CAST(1 AS DOUBLE) * CAST(embedding[47] AS DOUBLE) AS y
  FROM embeddings),
emb AS (
  SELECT row_id, y, 'emb.' || lpad(CAST(j AS VARCHAR), 2, '0') AS variable, CAST(embedding[j + 1] AS DOUBLE) AS value
  FROM base, range(64) t(j))"""

R2 = """CAST(1 AS DOUBLE) - (sum(y * y) - sum(value * y) * sum(value * y) / sum(value * value))
        / (sum(y * y) - sum(y) * sum(y) / count(*))"""

FOLDS = f"""{EMB},
folded AS (
  SELECT e.*, f.fold FROM emb e
  JOIN (SELECT row_id, CAST(ntile(5) OVER (ORDER BY row_id) - 1 AS INTEGER) AS fold FROM base) f USING (row_id)),
scores AS (SELECT fold AS replicate, variable, {R2} AS importance FROM folded GROUP BY fold, variable)"""

STATS = f"""{FOLDS},
stats AS (
  SELECT *, rank() OVER (ORDER BY mean DESC) + (count(*) OVER (PARTITION BY mean) - 1) / 2.0
            AS standard_importance_rank
  FROM (SELECT variable, count(*) AS count, avg(importance) AS mean, stddev_samp(importance) AS std,
               min(importance) AS min, quantile_cont(importance, 0.25) AS p25, quantile_cont(importance, 0.5) AS p50,
               quantile_cont(importance, 0.75) AS p75, max(importance) AS max
        FROM scores GROUP BY variable))"""

RANKED = f"""{EMB},
ranked AS (
  SELECT row_id, variable,
         rank() OVER (PARTITION BY variable ORDER BY value) + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0
         AS r
  FROM (SELECT row_id, variable, value FROM emb UNION ALL SELECT row_id, 'y', y FROM base)),
rho AS (
  SELECT a.variable AS final, b.variable AS suggestion, abs(corr(a.r, b.r)) AS rho
  FROM ranked a JOIN ranked b USING (row_id)
  WHERE a.variable IN ('emb.08', 'emb.35', 'emb.46', 'y') AND b.variable <> 'y'
  GROUP BY ALL),
pairs AS (
  SELECT f.final, f.suggestion, f.rho AS abs_spearman_fs, t.rho AS abs_spearman_ts
  FROM rho f JOIN rho t ON t.suggestion = f.suggestion AND t.final = 'y'
  WHERE f.final <> 'y')"""


INFORMATION = """
margins AS (
  SELECT *, sum(c) OVER (PARTITION BY {grid}, bx) AS mx, sum(c) OVER (PARTITION BY {grid}, bz) AS mz
  FROM joint),
info AS (
  SELECT {grid}, sum(c / n * ln(c * n / (mx * mz))) / ln(least(i, j)) AS score
  FROM margins GROUP BY {grid}, n, i, j),"""


def _mic(source: str) -> str:
    """Grid score of (variable, value, y) rows: all grids of equal rank cells, at most n^0.6 of them."""
    return f"""
sized AS (SELECT *, count(*) OVER (PARTITION BY variable) AS n FROM {source}),
cell AS (
  SELECT variable, n, rank() OVER (PARTITION BY variable ORDER BY value) - 1 AS cx,
         rank() OVER (PARTITION BY variable ORDER BY y) - 1 AS cy
  FROM sized),
counted AS (SELECT variable, n, cx, cy, CAST(count(*) AS DOUBLE) AS c FROM cell GROUP BY ALL),
bounds AS (SELECT DISTINCT variable, n, greatest(CAST(floor(power(n, 0.6)) AS BIGINT), 4) AS b FROM sized),
firsts AS (SELECT *, unnest(range(2, b // 2 + 1)) AS i FROM bounds),
shapes AS (SELECT *, unnest(range(2, b // i + 1)) AS j FROM firsts),
joint AS (
  SELECT variable, n, i, j, cx * i // n AS bx, cy * j // n AS bz, sum(c) AS c
  FROM counted JOIN shapes USING (variable, n)
  GROUP BY ALL),{INFORMATION.format(grid="variable, i, j")}
mic AS (
  SELECT variable, least(greatest(max(score), 0), 1) AS mic, CAST(any_value(b) AS INTEGER) AS b
  FROM info JOIN bounds USING (variable) GROUP BY variable)"""


# Every partition of one axis, as the bits of a mask, against equal parts of the other. No axis has more than 11 values, so
# more than 40 parts are no other partition.
MIC_OF_MARKS = f"""WITH RECURSIVE lines AS (
  SELECT 'line.number' AS variable, CAST(l_linenumber AS DOUBLE) AS x, l_tax AS y FROM lineitem
  UNION ALL SELECT 'line.discount', l_discount, l_tax FROM lineitem
  UNION ALL SELECT 'line.tax', l_tax, l_tax FROM lineitem),
sides AS (SELECT variable, 0 AS side, x AS u, y AS v FROM lines UNION ALL SELECT variable, 1, y, x FROM lines),
counted AS (
  SELECT variable, side, dense_rank() OVER (PARTITION BY variable, side ORDER BY u) - 1 AS iu,
         dense_rank() OVER (PARTITION BY variable, side ORDER BY v) - 1 AS iv, c
  FROM (SELECT variable, side, u, v, count(*) AS c FROM sides GROUP BY ALL)),
sizes AS (SELECT variable, side, iv, CAST(sum(c) AS BIGINT) AS size FROM counted GROUP BY ALL),
bound AS (SELECT count(*) AS n, greatest(CAST(floor(power(count(*), 0.6)) AS BIGINT), 4) AS b FROM lineitem),
walk AS (
  SELECT variable, side, t.p AS parts, iv, size AS held, CAST(0 AS BIGINT) AS part, n AS remaining
  FROM sizes, bound, range(2, 41) t(p) WHERE iv = 0
  UNION ALL
  SELECT variable, side, parts, iv, if(closes, size, held + size), if(closes, part + 1, part), if(closes, remaining - held, remaining)
  FROM (
    SELECT w.variable, w.side, w.parts, s.iv, s.size, w.held, w.part, w.remaining,
           (2 * w.held + s.size) * greatest(w.parts - w.part, 1) >= 2 * w.remaining AS closes
    FROM walk w JOIN sizes s ON s.variable = w.variable AND s.side = w.side AND s.iv = w.iv + 1)),
used AS (SELECT variable, side, parts, max(part) + 1 AS j FROM walk GROUP BY ALL HAVING max(part) > 0),
masks AS (
  SELECT variable, side, unnest(range(1, CAST(1 AS BIGINT) << max(iu))) AS m FROM counted GROUP BY variable, side),
joint AS (
  SELECT c.variable, c.side, w.parts, m.m, n, bit_count(m.m) + 1 AS i, d.j, bit_count(m.m & ((CAST(1 AS BIGINT) << c.iu) - 1)) AS bx,
         w.part AS bz, CAST(sum(c.c) AS DOUBLE) AS c
  FROM counted c JOIN walk w USING (variable, side, iv) JOIN used d USING (variable, side, parts)
  JOIN masks m USING (variable, side), bound
  WHERE (bit_count(m.m) + 1) * w.parts <= b
  GROUP BY ALL),{INFORMATION.format(grid="variable, side, parts, m")}
mic AS (SELECT variable, least(greatest(max(score), 0), 1) AS mic FROM info GROUP BY variable)
SELECT variable, {{mic}}, CAST(b AS INTEGER) AS b FROM mic, bound"""


SCORED = f"""{RANKED},{_mic("emb")},
scored AS (
  SELECT p.*, m.mic, (abs_spearman_fs + abs_spearman_ts) / 2 AS mean_of_corr,
         (abs_spearman_fs + mic) / 2 AS mean_of_corr_mic
  FROM pairs p JOIN mic m ON m.variable = p.suggestion
  WHERE abs_spearman_ts > (SELECT median(abs_spearman_ts) FROM pairs)),
best AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY suggestion ORDER BY mean_of_corr_mic DESC, final) = 1)"""



def _forward(parameters: str) -> str:
    """Forward selection by sweeping each fold's product matrix (fold -1 holds all rows) on the best feature so far.

    ``parameters`` is the number of parameters charged to a model of ``step`` features.
    """

    def adjusted() -> str:
        return f"1 - (1 - r2) * (n - 1) / (n - {parameters} - 1)"

    return f"""RECURSIVE {EMB},
pool AS (SELECT row_id, variable, value FROM emb UNION ALL SELECT row_id, '~y', y FROM base),
place AS (SELECT row_id, CAST(ntile(5) OVER (ORDER BY row_id) - 1 AS INTEGER) AS fold FROM base),
owner AS (SELECT row_id, fold FROM place UNION ALL SELECT row_id, -1 FROM place),
product AS (
  SELECT f.fold, a.variable AS i, b.variable AS j, sum(a.value * b.value) AS g
  FROM pool a JOIN pool b USING (row_id) JOIN owner f USING (row_id) GROUP BY ALL),
sweep AS (
  SELECT 0 AS step, fold, i, j, g, CAST(NULL AS VARCHAR) AS added FROM product
  UNION ALL
  (WITH s AS (SELECT * FROM sweep),
   pick AS (SELECT a.i AS k FROM s a JOIN s d ON d.fold = -1 AND d.i = a.i AND d.j = a.i
            WHERE a.fold = -1 AND a.j = '~y' AND a.i <> '~y' AND d.g > 0
            ORDER BY a.g * a.g / d.g DESC, a.i LIMIT 1)
   SELECT s.step + 1, s.fold, s.i, s.j,
          CASE WHEN s.i = k AND s.j = k THEN -1 / p.g WHEN s.i = k OR s.j = k THEN s.g / p.g
               ELSE s.g - r.g * c.g / p.g END, k
   FROM s, pick
   JOIN s r ON r.fold = s.fold AND r.i = s.i AND r.j = k
   JOIN s c ON c.fold = s.fold AND c.i = k AND c.j = s.j
   JOIN s p ON p.fold = s.fold AND p.i = k AND p.j = k)),
spread AS (SELECT fold, count(*) AS n, var_pop(y) * count(*) AS sst FROM base JOIN owner USING (row_id) GROUP BY fold),
fit AS (
  SELECT step, added, fold, n, 1 - g / sst AS r2 FROM sweep JOIN spread USING (fold)
  WHERE i = '~y' AND j = '~y' AND step > 0),
scored AS (
  SELECT step, any_value(added) AS added, max(CASE WHEN fold = -1 THEN {adjusted()} END) AS adj_r2,
         avg(CASE WHEN fold >= 0 THEN {adjusted()} END) AS kfold_adj_r2
  FROM fit GROUP BY step),
marked AS (
  SELECT *, lag(adj_r2) OVER (ORDER BY step) AS before,
         CASE WHEN kfold_adj_r2 <= max(kfold_adj_r2) OVER (
           ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS miss
  FROM scored),
struck AS (SELECT *, sum(miss) OVER (ORDER BY step) AS strikes FROM marked),
trace AS (
  SELECT * FROM struck
  WHERE step < coalesce((SELECT min(step) FROM struck WHERE adj_r2 - before <= 0 OR strikes >= 10), 1000000))"""


TRACE = """
SELECT CAST(step - 1 AS INTEGER) AS step, CAST(step AS INTEGER) AS n_var, added,
       round(adj_r2, 6) + 0.0 AS adj_r2, round(kfold_adj_r2, 6) + 0.0 AS kfold_adj_r2 FROM trace"""


def _descent(name: str, gram: str, rows: str, penalties: str, rounds: int = 400) -> str:
    """Lasso weights for each (step, alpha) of ``penalties`` by proximal gradient rounds on ``gram`` (i, j, g).

    ``rows`` is the number of rows; the product with the response is the entry (i, '~y').
    """
    return f"""
{name}_bound AS (SELECT max(s) AS b FROM (SELECT sum(abs(g)) AS s FROM {gram} WHERE i <> '~y' AND j <> '~y' GROUP BY i)),
{name} AS (
  SELECT 0 AS round, step, alpha, i AS j, CAST(0 AS DOUBLE) AS w FROM {penalties}, (SELECT DISTINCT i FROM {gram} WHERE i <> '~y')
  UNION ALL
  SELECT round + 1, step, alpha, i, sign(u) * greatest(abs(u) - ({rows}) * alpha / b, 0)
  FROM (SELECT v.round, v.step, v.alpha, m.i, any_value(b) AS b,
               max(CASE WHEN m.i = m.j THEN v.w END) - (sum(m.g * v.w) - any_value(q.g)) / any_value(b) AS u
        FROM {name} v JOIN {gram} m ON m.j = v.j JOIN {gram} q ON q.i = m.i AND q.j = '~y', {name}_bound
        WHERE v.round < {rounds} AND m.i <> '~y' GROUP BY v.round, v.step, v.alpha, m.i))"""


LASSO = f"""RECURSIVE {EMB},
split AS (
  SELECT row_id, row_number() OVER (ORDER BY md5('42:0:' || row_id), row_id) <= ceil(0.3 * count(*) OVER ()) AS is_test
  FROM base),
unit AS (
  SELECT row_id, variable, value / sqrt(sum(value * value) OVER (PARTITION BY variable)) AS value FROM emb
  UNION ALL SELECT row_id, '~y', y FROM base),
train AS (SELECT u.* FROM unit u JOIN split USING (row_id) WHERE NOT is_test),
means AS (SELECT variable, avg(value) AS m FROM train GROUP BY variable),
centred AS (SELECT row_id, variable, value - m AS value FROM train JOIN means USING (variable)),
gram AS (
  SELECT a.variable AS i, b.variable AS j, sum(a.value * b.value) AS g
  FROM centred a JOIN centred b USING (row_id) GROUP BY ALL),
grid AS (SELECT CAST(k AS INTEGER) AS step, power(10, -10 + 7 * CAST(k AS DOUBLE) / 99) AS alpha FROM range(100) t(k)),
{_descent("path", "gram", "SELECT count(*) FROM split WHERE NOT is_test", "grid")},
fitted AS (SELECT * FROM path WHERE round = 400),
offsets AS (
  SELECT step, (SELECT m FROM means WHERE variable = '~y') - sum(w * m) AS b
  FROM fitted JOIN means ON means.variable = fitted.j GROUP BY step),
predicted AS (
  SELECT f.step, u.row_id, sum(f.w * u.value) AS p
  FROM fitted f JOIN unit u ON u.variable = f.j GROUP BY f.step, u.row_id),
errors AS (
  SELECT p.step, s.is_test, 1 - sum(power(y - b - p, 2)) / (var_pop(y) * count(*)) AS r2
  FROM predicted p JOIN offsets USING (step) JOIN base USING (row_id) JOIN split s USING (row_id) GROUP BY ALL),
scores AS (
  SELECT step, max(CASE WHEN NOT is_test THEN r2 END) AS train_score, max(CASE WHEN is_test THEN r2 END) AS test_score
  FROM errors GROUP BY step)"""


def _tail(rho: str) -> str:
    """Two-sided p-value of correlation ``rho`` by Simpson's rule: the null density of asin(rho) is cos^(n-3)."""
    start = f"asin(least({rho}, 1))"
    width = f"least(pi() / 2 - {start}, 12 / sqrt(n - 3))"
    return f"""(SELECT sum((CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
              * power(cos({start} + {width} * k / 2000), n - 3)) * {width} / 6000
       / (0.5 * exp(lgamma(0.5) + lgamma((n - 2) / 2) - lgamma((n - 1) / 2))) FROM range(2001) t(k))"""


STATUS = """
SELECT CAST(user_id AS VARCHAR) AS jobid, arg_min(event_type, (ts, event_id)) AS area,
       arg_max(event_type, (ts, event_id)) AS status,
       CAST(arg_max(event_id % 101, (ts, event_id)) AS INTEGER) AS progress,
       epoch_us(min(ts)) AS start_time, CASE WHEN count(*) > 1 THEN epoch_us(max(ts)) END AS update_time
FROM events GROUP BY user_id"""

GUARDED = """
SELECT o_custkey, n, y_std,
       CASE WHEN n = 0 THEN '-1' WHEN n < 10 THEN '-4' WHEN y_std = 0 THEN '-2' END AS code
FROM (SELECT o_custkey, count(*) AS n, stddev_samp(o_totalprice) AS y_std FROM orders GROUP BY o_custkey)"""


def _sampled(seed: int, replicates: int) -> str:
    return f"""
SELECT row_id, CAST(replicate AS INTEGER) AS replicate,
       row_number() OVER (PARTITION BY replicate
                          ORDER BY md5('{seed}:' || replicate || ':' || row_id), row_id) AS place,
       count(*) OVER (PARTITION BY replicate) AS n
FROM (SELECT o_orderkey AS row_id FROM orders), range({replicates}) t(replicate)"""


AS_OF_DAY = "20240301"


def _six(*names: str, places: int = 6) -> str:
    """Rounded columns; adding zero turns a negative zero into zero."""
    return ", ".join(f"round({n}, {places}) + 0.0 AS {n}" for n in names)


ORACLE: dict[str, str] = {
    "csv_scan": f"""WITH {WIDE}
SELECT row_id, y, variable, value FROM (SELECT row_id, y, {SEVEN} FROM wide)
UNPIVOT INCLUDE NULLS (value FOR variable IN ({SEVEN}))""",
    "table_count": "SELECT count(*) AS n_rows FROM lineitem",
    "limit_n": "SELECT count(*) AS n_rows FROM (SELECT * FROM lineitem LIMIT 10)",
    "project_cols": "SELECT c_name, c_mktsegment, c_acctbal FROM customer",
    "clock_literal": "SELECT o_orderstatus, count(*) AS n, 'connected' AS message FROM orders GROUP BY o_orderstatus",
    "status_upsert": STATUS,
    "status_list": f"SELECT * FROM ({STATUS}) ORDER BY update_time DESC NULLS FIRST, jobid",
    "stage_progress": """
SELECT event_id, CAST(user_id AS VARCHAR) AS jobid,
       CASE event_type WHEN 'signup' THEN 'STARTED' WHEN 'view' THEN 'RF_COMPLETED' WHEN 'click' THEN 'LASSO_COMPLETED'
            WHEN 'purchase' THEN 'STEP_FORWARD_COMPLETED' WHEN 'error' THEN 'MIC_COMPLETED' END AS status,
       CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 30 WHEN 'click' THEN 50 WHEN 'purchase' THEN 70
            WHEN 'error' THEN 90 END AS INTEGER) AS progress
FROM events""",
    "with_dt": "SELECT event_id, strftime(ts, '%Y%m%d') AS dt FROM events",
    "error_rows": f"""
SELECT code, 'error' AS param, 'error' AS step, CAST(NULL AS DOUBLE) AS importance_mean,
       CAST(o_custkey AS VARCHAR) AS job_id, '{AS_OF_DAY}' AS dt
FROM ({GUARDED}) WHERE code IS NOT NULL""",
    "sink_importance": f"""WITH {STATS}
SELECT '0' AS code, split_part(variable, '.', 2) AS param, split_part(variable, '.', 1) AS step,
       round(mean, 6) + 0.0 AS importance_mean, 'job-1' AS job_id, '{AS_OF_DAY}' AS dt FROM stats""",
    "sink_coeff": f"""WITH {EMB}
SELECT '0' AS code, variable, {_six("score", "abs_score")}, 'job-1' AS job_id, '{AS_OF_DAY}' AS dt
FROM (SELECT variable, sum(value * y) / sum(value * value) AS score,
             abs(sum(value * y) / sum(value * value)) AS abs_score FROM emb GROUP BY variable)""",
    "sink_result": f"""WITH {SCORED}
SELECT '0' AS code, final, suggestion,
       {_six("abs_spearman_fs", "abs_spearman_ts", "mean_of_corr", "mic", "mean_of_corr_mic")},
       'job-1' AS job_id, '{AS_OF_DAY}' AS dt FROM best""",
    "guard_code": f"SELECT o_custkey, n, {_six('y_std')}, code FROM ({GUARDED})",
    "drop_null_target": f'WITH {WIDE} SELECT row_id, "line.price" AS y FROM wide WHERE "line.price" IS NOT NULL',
    "feature_unpivot": f"WITH {LONG} SELECT row_id, variable, value FROM long",
    "drop_constant": f"""WITH {LONG}
SELECT row_id, variable, value FROM long
WHERE variable IN (SELECT variable FROM long GROUP BY variable HAVING stddev_samp(value) > 0)""",
    "drop_null_features": f"""WITH {LONG}
SELECT row_id, variable, value FROM long
WHERE variable IN (SELECT variable FROM long GROUP BY variable HAVING count(value) = count(*))""",
    "mean_impute": f"""WITH {LONG}
SELECT row_id, variable, {_six("value")}
FROM (SELECT row_id, variable, coalesce(value, avg(value) OVER (PARTITION BY variable)) AS value FROM long)""",
    "standardize": f"""WITH {FILLED}
SELECT row_id, variable, {_six("value")}
FROM (SELECT row_id, variable, (value - avg(value) OVER w) / coalesce(nullif(stddev_pop(value) OVER w, 0), 1) AS value
      FROM filled WINDOW w AS (PARTITION BY variable))""",
    "l2_normalize": f"""WITH {FILLED}
SELECT row_id, variable, {_six("value", places=9)}
FROM (SELECT row_id, variable, value / sqrt(sum(value * value) OVER (PARTITION BY variable)) AS value FROM filled)""",
    "event_time": f"""WITH {WIDE}
SELECT row_id, epoch_us(end_time) AS time_micros, strftime(end_time, '%Y-%m-%d') AS day FROM wide""",
    "attach_target": f"""WITH {LONG}
SELECT l.row_id, l.variable, l.value, w.y, epoch_us(w.end_time) AS end_micros
FROM long l JOIN wide w USING (row_id) WHERE l.variable IN ('line.qty', 'cust.acctbal')""",
    "split_name": f"""WITH {LONG}
SELECT variable, split_part(variable, '.', 1) AS step, split_part(variable, '.', 2) AS param, count(*) AS n
FROM long GROUP BY variable""",
    "semi_selected": f"""WITH {EMB}
SELECT row_id, variable, value FROM emb
WHERE variable IN (SELECT variable FROM emb GROUP BY variable ORDER BY {R2} DESC, variable LIMIT 10)""",
    "describe_features": f"""WITH {LONG}
SELECT variable, count, {_six("mean", "std", "min", "p25", "p50", "p75", "max")}
FROM (SELECT variable, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
             quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
             max(value) AS max
      FROM long WHERE value IS NOT NULL GROUP BY variable)""",
    "importance_stats": f"""WITH {STATS}
SELECT variable, count, {_six("mean", "std", "min", "p25", "p50", "p75", "max")},
       CAST(standard_importance_rank AS DOUBLE) AS standard_importance_rank FROM stats""",
    "scaled_importance": f"""WITH {FOLDS},
scaled AS (
  SELECT *, importance / std AS s
  FROM (SELECT *, stddev_pop(importance) OVER (PARTITION BY variable) AS std FROM scores))
SELECT replicate, variable, {_six("importance", "std", "s")},
       CAST(rank() OVER (PARTITION BY replicate ORDER BY s)
            + (count(*) OVER (PARTITION BY replicate, s) - 1) / 2.0 AS DOUBLE) AS s_rank,
       CAST(rank() OVER (PARTITION BY replicate ORDER BY importance)
            + (count(*) OVER (PARTITION BY replicate, importance) - 1) / 2.0 AS DOUBLE) AS i_rank
FROM scaled""",
    "positive_importance": f"WITH {STATS} SELECT variable, {_six('mean')} FROM stats WHERE mean > 0",
    "avg_rank_desc": f"""WITH {FILLED}
SELECT row_id, variable,
       CAST(rank() OVER (PARTITION BY variable ORDER BY value DESC)
            + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0 AS DOUBLE) AS avg_rank
FROM filled""",
    "avg_rank_asc": """
SELECT l_quantity, CAST(sum(n) OVER (ORDER BY l_quantity) - n + (n + 1) / 2.0 AS DOUBLE) AS avg_rank, n
FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity)""",
    "top_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "top_n_abs": "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 50",
    "argmax_global": """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1""",
    "argmax_per_group": """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""",
    "distinct_values": "SELECT DISTINCT l_partkey FROM lineitem",
    "adjusted_r2": f"""WITH {EMB},
fits AS (SELECT variable, count(*) AS n, {R2} AS r2 FROM emb GROUP BY variable)
SELECT variable, n, {_six("r2")}, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) + 0.0 AS adj_r2 FROM fits""",
    "above_median": """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT median(o_totalprice) FROM orders)""",
    "result_code": """
SELECT CASE WHEN count(*) > 0 THEN '0' ELSE '2' END AS code
FROM orders WHERE o_totalprice > (SELECT median(o_totalprice) FROM orders)""",
    "train_test_split": f"SELECT row_id, place <= ceil(0.3 * n) AS is_test FROM ({_sampled(42, 1)})",
    "bootstrap_samples": f"SELECT row_id, replicate FROM ({_sampled(7, 10)}) WHERE place > ceil(0.3 * n)",
    "union_replicates": f"SELECT row_id, replicate FROM ({_sampled(11, 3)}) WHERE place > ceil(0.3 * n)",
    "kfold_assign": """
SELECT o_orderkey AS row_id, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders""",
    "kfold_r2": f"WITH {FOLDS} SELECT replicate, variable, {_six('importance')} FROM scores",
    "gram_matrix": f"""WITH {EMB}
SELECT var_i, var_j, {_six("value", places=4)}
FROM (SELECT a.variable AS var_i, b.variable AS var_j, sum(a.value * b.value) AS value
      FROM emb a JOIN emb b USING (row_id) GROUP BY ALL)""",
    "ols_univariate_r2": f"""WITH {EMB}
SELECT variable, n, {_six("slope", "r2")}
FROM (SELECT variable, count(*) AS n, sum(value * y) / sum(value * value) AS slope, {R2} AS r2
      FROM emb GROUP BY variable)""",
    "lasso_univariate": f"""WITH {EMB},
sums AS (SELECT variable, count(*) AS n, sum(value * y) AS q, sum(value * value) AS g FROM emb GROUP BY variable)
SELECT variable, CAST(k AS INTEGER) AS step,
       round(sign(q) * greatest(abs(q) - n * power(10, -10 + 7 * CAST(k AS DOUBLE) / 99), 0) / g, 6) + 0.0 AS coef
FROM sums, range(100) t(k)""",
    "forward_step1": f"""WITH {EMB},
fits AS (SELECT variable, 1 - (1 - ({R2})) * (count(*) - 1) / (count(*) - 2) AS adj_r2 FROM emb GROUP BY variable)
SELECT variable, round(adj_r2, 6) + 0.0 AS adj_r2,
       row_number() OVER (ORDER BY fits.adj_r2 DESC, variable) = 1 AS is_best FROM fits""",
    "step_forward": f"WITH {_forward('1')} {TRACE}",
    "step_forward_penalised": f"WITH {_forward('step')} {TRACE}",
    "best_model": f"""WITH {_forward("step")},
top AS (SELECT step FROM trace ORDER BY kfold_adj_r2 DESC, step LIMIT 1),
norms AS (SELECT variable, sqrt(sum(value * value)) AS norm FROM emb GROUP BY variable),
terms AS (
  SELECT c.i AS variable, c.g * norm AS score
  FROM sweep c JOIN top USING (step) JOIN norms ON norms.variable = c.i
  JOIN sweep d ON d.step = c.step AND d.fold = -1 AND d.i = c.i AND d.j = c.i
  WHERE c.fold = -1 AND c.j = '~y' AND d.g < 0)
SELECT variable, round(score, 6) + 0.0 AS score, round(abs(score), 6) + 0.0 AS abs_score FROM terms""",
    "lasso_path_exact": f"""WITH {LASSO}
SELECT round(log10(alpha), 6) + 0.0 AS log_alpha, round(train_score, 6) + 0.0 AS train_score,
       round(test_score, 6) + 0.0 AS test_score, n_nonzero, true AS converged
FROM scores JOIN grid USING (step)
JOIN (SELECT step, CAST(sum(CASE WHEN w <> 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_nonzero FROM fitted GROUP BY step)
USING (step)""",
    "lasso_select_exact": f"""WITH {LASSO},
chosen AS (SELECT step, alpha FROM grid JOIN scores USING (step) ORDER BY test_score DESC, step LIMIT 1),
whole AS (
  SELECT a.variable AS i, b.variable AS j, sum(a.value * b.value) AS g
  FROM unit a JOIN unit b USING (row_id) GROUP BY ALL),
{_descent("final", "whole", "SELECT count(*) FROM base", "chosen")}
SELECT j AS variable, round(w, 6) + 0.0 AS score, round(abs(w), 6) + 0.0 AS abs_score
FROM final WHERE round = 400 AND w <> 0""",
    "model_quality": f"""WITH {EMB},
fit AS (
  SELECT count(*) AS n,
         1 - sum(power(y - 3 * CAST(embedding[9] AS DOUBLE) + 2 * CAST(embedding[36] AS DOUBLE)
                       - CAST(embedding[47] AS DOUBLE), 2)) / (var_pop(y) * count(*)) AS r2
  FROM base)
SELECT {_six("r2")}, round(1 - (1 - r2) * (n - 1) / (n - 4), 6) + 0.0 AS adj_r2 FROM fit""",
    "spearman_target": f"""WITH {FILLED},
pooled AS (SELECT row_id, variable, value FROM filled UNION ALL SELECT row_id, 'y', y FROM wide),
ranked AS (
  SELECT row_id, variable,
         rank() OVER (PARTITION BY variable ORDER BY value) + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0
         AS r
  FROM pooled)
SELECT a.variable, count(*) AS n, round(corr(a.r, b.r), 6) + 0.0 AS rho
FROM ranked a JOIN ranked b ON a.row_id = b.row_id AND b.variable = 'y' WHERE a.variable <> 'y' GROUP BY a.variable""",
    "feature_pairs": f"""WITH {EMB}
SELECT f.final, e.suggestion FROM (SELECT DISTINCT variable AS suggestion FROM emb) e,
       (VALUES ('emb.08'), ('emb.35'), ('emb.46')) f(final)""",
    "spearman_pairs_lines": """WITH placed AS (
  SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y,
         rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS q,
         rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS d,
         rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0 AS t
  FROM lineitem),
pairs AS (
  SELECT 'line.quantity' AS final, 'line.quantity' AS suggestion, corr(q, q) AS fs, corr(q, y) AS ts, count(*) AS n FROM placed
  UNION ALL SELECT 'line.quantity', 'line.discount', corr(q, d), corr(d, y), count(*) FROM placed
  UNION ALL SELECT 'line.quantity', 'line.tax', corr(q, t), corr(t, y), count(*) FROM placed
  UNION ALL SELECT 'line.discount', 'line.quantity', corr(d, q), corr(q, y), count(*) FROM placed
  UNION ALL SELECT 'line.discount', 'line.discount', corr(d, d), corr(d, y), count(*) FROM placed
  UNION ALL SELECT 'line.discount', 'line.tax', corr(d, t), corr(t, y), count(*) FROM placed)
SELECT final, suggestion, round(abs(fs), 6) AS abs_spearman_fs, round(abs(ts), 6) AS abs_spearman_ts, n FROM pairs""",
    "spearman_pairs": f"""WITH {RANKED}
SELECT final, suggestion, {_six("abs_spearman_fs", "abs_spearman_ts")}, (SELECT count(*) FROM base) AS n FROM pairs""",
    "spearman_pvalue": f"""WITH {RANKED},
sized AS (SELECT *, (SELECT count(*) FROM base) AS n FROM pairs)
SELECT final, suggestion, round({_tail("abs_spearman_fs")}, 6) + 0.0 AS p_fs,
       round({_tail("abs_spearman_ts")}, 6) + 0.0 AS p_ts FROM sized""",
    "mic_grid": f"""WITH lines AS (
  SELECT 'line.quantity' AS variable, l_quantity AS value, l_extendedprice AS y FROM lineitem
  UNION ALL SELECT 'line.discount', l_discount, l_extendedprice FROM lineitem
  UNION ALL SELECT 'line.price', l_extendedprice, l_extendedprice FROM lineitem),{_mic("lines")}
SELECT variable, {_six("mic")}, b FROM mic""",
    "mic_optimized": MIC_OF_MARKS.format(mic=_six("mic")),
    "mic_lookup": f"""WITH {RANKED},{_mic("emb")}
SELECT p.final, p.suggestion, {_six("mic")} FROM pairs p JOIN mic m ON m.variable = p.suggestion""",
    "pair_table": f"""WITH {SCORED}
SELECT final, suggestion, {_six("abs_spearman_fs", "abs_spearman_ts", "mic", "mean_of_corr", "mean_of_corr_mic")}
FROM scored""",
    "blend_scores": f"""WITH {RANKED},{_mic("emb")}
SELECT p.final, p.suggestion, round((abs_spearman_fs + abs_spearman_ts) / 2, 6) + 0.0 AS mean_of_corr,
       round((abs_spearman_fs + mic) / 2, 6) + 0.0 AS mean_of_corr_mic
FROM pairs p JOIN mic m ON m.variable = p.suggestion""",
    "suggestions": f"WITH {SCORED} SELECT suggestion, final, {_six('mean_of_corr_mic')} FROM best",
}

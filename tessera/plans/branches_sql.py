"""SQL for DuckDB of the queries in `branches`, written from the operators' rules."""

from __future__ import annotations

from .oracles import _IOU3, _SETS

_OUT = "o AS (SELECT *, (sample_id + variant) AS k FROM fx_iou), x AS (SELECT *, NOT (k % 17 = 0 OR k % 11 = 0 OR k % 13 = 0) AS ex, k % 7 > 0 AS va, k % 7 > 0 AND k % 3 > 0 AND pred_px > 0 AS ne, k % 7 > 0 AND inter_px > 0 AS ov, k % 4 > 0 AS seg FROM o)"
_RATE = lambda n, e: f"count(*) FILTER ({e}) AS {n}, round(count(*) FILTER ({e}) / count(*), 6) AS {n}_rate"
_PLAN = "d AS (SELECT ['train', 'val', 'test'][(o_orderkey % 3 + 1)::INT] AS split, o_orderstatus AS chart, (o_custkey % 2)::VARCHAR AS referring, (o_orderkey % 4)::VARCHAR AS action, (o_custkey % 3)::VARCHAR AS difficulty FROM orders)"
_LEVELS = {"split": ("split", 5000), "split/chart/referring": ("split || '/' || chart || '/' || referring", 800), "split/chart/referring/action": ("split || '/' || chart || '/' || referring || '/' || action", 200)}
_CONTRACT = " UNION ALL ".join(f"SELECT '{level}' AS level, {key} AS key, {n} AS expected, count(*) AS n, count(*) = {n} AS ok FROM d GROUP BY {key}" for level, (key, n) in _LEVELS.items())
_EVENT_DIMS = "e AS (SELECT ['d' || (event_id % 5), 'd' || (event_id * 3 % 5)] AS dims, floor(value)::INT % 5 - 1 AS s FROM events)"
_GROUP = lambda name, dims: f"SELECT 'coarse' AS level, '{name}' AS dim, s FROM e WHERE list_has_any(dims, {dims})"
_LINE = lambda name, cond: f"SELECT '{name}' AS category, count(*) FILTER ({cond}) AS num, round(coalesce(avg(hit) FILTER ({cond}), 0), 9) AS avg_score FROM d"
_MOVE = "list_transform(range(49), lambda q: {}[((1 + q // 7) * 8 // 10) * 8 + ((2 + 6 - q % 7) * 8 // 12) + 1])"

_BOX = "list_min(list_transform(on_, lambda i: (i - 1) % 4)) AS x0, list_min(list_transform(on_, lambda i: (i - 1) // 4)) AS y0, list_max(list_transform(on_, lambda i: (i - 1) % 4)) AS x1, list_max(list_transform(on_, lambda i: (i - 1) // 4)) AS y1"
_IN_ORDER = lambda name, keys: f"string_agg(k::VARCHAR, ',' ORDER BY {keys}, k) AS {name}"
ORACLES = {
    "GE16_mask_reward": f"WITH {_SETS}, mm AS (SELECT id, len(g) AS n, {_IOU3} AS m FROM st), v AS (SELECT * FROM (VALUES (1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)) AS v(a, b, c)) SELECT id, round(max(m[a][1] + m[b][2] + CASE WHEN n = 3 THEN m[c][3] ELSE 0 END) / 3, 9) AS reward FROM mm, v GROUP BY id",
    "SK07_predictions": f"WITH {_SETS}, e AS (SELECT id, k - 1 AS place, list_transform(range(16), lambda i: p[k][(i % 4) * 4 + i // 4 + 1]) AS f FROM st, range(1, 4) AS a(k)), c AS (SELECT id, place, list_concat(list_concat(CASE WHEN f[1] = 1 THEN [0, 0] ELSE [0] END, list_filter(range(1, 16), lambda i: f[i + 1] <> f[i])), [16]) AS e FROM e) SELECT id AS image_id, place::INT AS place, '{{\"image_id\":' || id || ',\"category_id\":1,\"segmentation\":\"' || array_to_string([e[i + 1] - e[i] FOR i IN range(1, len(e))], ',') || '\",\"score\":1.0}}' AS line FROM c",
    "GE24_outermost": f"WITH {_SETS}, d AS (SELECT id, k - 1 AS pos, p[k] AS m FROM st, range(1, 4) AS a(k) UNION ALL SELECT id, k + 2, list_transform(p[k], lambda v, i: CASE WHEN i < 10 THEN v ELSE 0 END) FROM st, range(1, 4) AS a(k)), n AS (SELECT *, list_sum(m) AS px FROM d) SELECT id, pos::INT AS pos FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.id = a.id AND (b.px > a.px OR b.px = a.px AND b.pos < a.pos) AND list_dot_product(a.m::DOUBLE[], b.m::DOUBLE[]) = a.px)",
    "GE26_painted": f"WITH {_SETS}, d AS (SELECT id, p[1] AS a, list_transform(p[2], lambda v, i: CASE WHEN i < 12 THEN v ELSE 0 END) AS b FROM st), n AS (SELECT *, list_sum(a) AS na, list_sum(b) AS nb FROM d) SELECT id, array_to_string(list_transform(list_zip(a, b), lambda z: CASE WHEN z[1] = 1 AND z[2] = 1 THEN CASE WHEN nb < na THEN 255 ELSE 1 END WHEN z[2] = 1 THEN 255 ELSE z[1] END), ',') AS mask FROM n",
    "ST08_mask_order": f"WITH {_SETS}, e AS (SELECT id, k - 1 AS k, list_filter(range(1, 17), lambda i: p[k][i] = 1) AS on_ FROM st, range(1, 4) AS a(k)), b AS (SELECT id, k, {_BOX} FROM e) SELECT id, {_IN_ORDER('ltr_ttb', 'x0 + x1, y0 + y1')}, {_IN_ORDER('ttb_ltr', 'y0 + y1, x0 + x1')}, {_IN_ORDER('tlbr', 'y0, x0')} FROM b GROUP BY id HAVING count(x0) = 3",
    "PA12_fixed_size": "WITH d AS (SELECT p_partkey, p_size AS n, CASE WHEN p_size >= 5 THEN list_transform(list_sort([{'h': md5('7-' || p_partkey || '-' || i), 'i': i} FOR i IN range(p_size)])[1:5], lambda s: s.i) ELSE [('0x' || substr(md5('7-' || p_partkey || '-' || j), 1, 8))::BIGINT % p_size FOR j IN range(1, 6)] END AS x FROM part) SELECT p_partkey, 5 AS n, array_to_string(list_transform(list_sort(x), lambda i: i + 1), ',') AS items FROM d",
    "GE14_admissible": f"WITH {_SETS}, pq AS (SELECT id, i, j, list_sum(p[i]) + list_sum(g[j]) AS t, list_dot_product(p[i]::DOUBLE[], g[j]::DOUBLE[]) AS x FROM st, range(1, 4) AS a(i), range(1, 4) AS b(j) WHERE j <= len(g)), l AS (SELECT id, list({{'i': i, 'j': j, 'v': CASE WHEN t = 0 THEN 0 ELSE x / (t - x) END, 'a': (id + (i - 1) * 3 + (j - 1) * 5) % 4 / 4.0}} ORDER BY CASE WHEN t = 0 THEN 0 ELSE x / (t - x) END DESC, i, j) AS l FROM pq GROUP BY id), f AS (SELECT id, list_reduce(l, lambda s, x: CASE WHEN s.stop OR list_contains(s.r, x.i) OR list_contains(s.c, x.j) THEN s WHEN x.v < 0.25 OR x.a < 0.25 THEN {{'r': s.r, 'c': s.c, 'v': s.v, 'stop': true}} ELSE {{'r': list_append(s.r, x.i), 'c': list_append(s.c, x.j), 'v': list_append(s.v, x.v), 'stop': false}} END, {{'r': []::BIGINT[], 'c': []::BIGINT[], 'v': []::DOUBLE[], 'stop': false}}) AS s FROM l) SELECT id, len(s.v)::INT AS n, round(coalesce(list_avg(s.v), 0), 9) AS mean FROM f",
    "AG12_by_version_and_subfield": "WITH e AS (SELECT 'v' || (event_id % 4) AS v, event_type AS f, value > 50 AS hit FROM events), a AS (SELECT 'problem_version' AS key, v AS value, hit FROM e UNION ALL SELECT 'subfield', f, hit FROM e UNION ALL SELECT 'average', NULL, hit FROM e), g AS (SELECT key, value, count(*) FILTER (hit) AS correct, count(*) AS total, round(100.0 * count(*) FILTER (hit) / count(*), 2) AS accuracy FROM a GROUP BY key, value) SELECT *, row_number() OVER (PARTITION BY key ORDER BY accuracy DESC, value) AS place FROM g",
    "AG13_combinations": "WITH d AS (SELECT hit, idx % 2 = 0 AS rec, idx % 3 = 0 AS ocr, idx % 5 = 0 AS know FROM fx_eval), e AS (SELECT 'capability' AS part, unnest(list_filter([CASE WHEN rec THEN 'rec' END, CASE WHEN ocr THEN 'ocr' END, CASE WHEN know THEN 'know' END, 'gen', 'Overall'], lambda x: x IS NOT NULL)) AS category, hit FROM d UNION ALL SELECT 'combination', unnest([CASE WHEN rec THEN 'rec_' ELSE '' END || CASE WHEN ocr THEN 'ocr_' ELSE '' END || CASE WHEN know THEN 'know_' ELSE '' END || 'gen', 'Overall']), hit FROM d) SELECT part, category, count(*) AS tot, round(avg(hit) * 100, 6) AS acc FROM e GROUP BY ALL",
    "AG16_fine_and_coarse": f"WITH {_EVENT_DIMS}, l AS (SELECT 'fine' AS level, unnest(dims) AS dim, s FROM e UNION ALL {_GROUP('Perception', ['d0', 'd1'])} UNION ALL {_GROUP('Reasoning', ['d2', 'd3', 'd4'])} UNION ALL {_GROUP('Overall', ['d0', 'd1', 'd2', 'd3', 'd4'])}) SELECT level, dim, round(avg(greatest(s, 0)), 9) AS \"all\", round(avg(s) FILTER (s >= 0), 9) AS valid FROM l GROUP BY ALL",
    "AG20_subtotal_lines": "WITH c AS (SELECT split AS line, sum(hit)::DOUBLE AS score FROM fx_eval GROUP BY split) SELECT * FROM c UNION ALL SELECT 'Germanic', sum(score) FROM c WHERE line IN ('en', 'de') UNION ALL SELECT 'Romance', sum(score) FROM c WHERE line IN ('fr', 'es') UNION ALL SELECT 'Final Score', sum(score) FROM c UNION ALL SELECT 'Final Score Norm', sum(score) / 10 FROM c",
    "AG23_long_documents": "WITH d AS (SELECT idx, hit, l2 <> '1' AS asked, idx % 7 > 0 AS said FROM fx_eval) SELECT 'overall_f1' AS category, count(*) AS num, round(2 * avg(hit) FILTER (asked) * avg(hit) FILTER (said) / (avg(hit) FILTER (asked) + avg(hit) FILTER (said)), 9) AS avg_score FROM d UNION ALL " + " UNION ALL ".join(_LINE(*x) for x in (("overall_acc", "true"), ("text", "idx % 5 = 0"), ("layout", "false"), ("table", "idx % 3 = 0"), ("chart", "idx % 2 = 0"), ("single-page", "idx % 3 = 1"), ("multi-page", "idx % 3 = 2"), ("unanswerable", "idx % 3 = 0"))),
    "AG28_every_flag": f"WITH {_OUT} SELECT chart_type, {_RATE('execution_success', 'ex')}, {_RATE('mask_contract_valid', 'va')}, {_RATE('nonempty_prediction', 'ne')}, {_RATE('empty_prediction', 'NOT ne')}, {_RATE('overlapping_prediction', 'ov')}, {_RATE('segmentation_token', 'seg')}, {_RATE('nonempty_disjoint', 'ne AND NOT ov')}, round(min(iou), 6) AS worst, round(avg(iou), 6) AS macro_iou, round(avg(dice), 6) AS macro_dice, round(sum(inter_px) / sum(union_px), 6) AS micro_iou, round(median(iou), 6) AS median_iou, round(median(dice), 6) AS median_dice FROM x GROUP BY chart_type",
    "VA15_every_outcome": f"WITH {_OUT} SELECT ex::INT AS execution_success, va::INT AS mask_contract_valid, ne::INT AS nonempty_prediction, (NOT ne)::INT AS empty_prediction, ov::INT AS overlapping_prediction, count(*) AS n FROM x GROUP BY ALL",
    "AG32_empty_unions": "SELECT chart_type, round(sum(CASE WHEN sample_id % 10 > 0 THEN inter_px ELSE 0 END) / (sum(CASE WHEN sample_id % 10 > 0 THEN union_px ELSE 0 END) + 1e-10), 9) AS ciou, round(avg(CASE WHEN sample_id % 10 = 0 THEN 1 ELSE inter_px / (union_px + 1e-5) END), 6) AS giou FROM fx_iou GROUP BY chart_type",
    "AG35_every_measure": "WITH e AS (SELECT sample_id, max(chart_type) AS kind, round(avg(iou) * 100, 6) AS j, round(avg(dice) * 100, 6) AS f, round(avg(inter_px / gt_px) * 100, 6) AS a, round(avg(inter_px / pred_px) * 100, 6) AS r FROM fx_iou GROUP BY sample_id), t AS (SELECT kind, avg(j) AS j, avg(f) AS f, avg(a) AS a, avg(r) AS r FROM e GROUP BY kind), u AS (SELECT * FROM t UNION ALL SELECT 'overall', avg(j), avg(f), avg(a), avg(r) FROM t) SELECT kind, round(j, 4) AS j, round(f, 4) AS f, round(a, 4) AS a, round(r, 4) AS r, round((j + f) / 2, 4) AS \"both\" FROM u",
    "AG43_every_level": "WITH d AS (SELECT split, chart_type, style_family, sample_id % 4 AS referring_type, sample_id % 3 AS action, (sample_id // 7) % 3 AS difficulty, sample_id % 6 AS template, sample_id % 5 AS distractors FROM fx_manifest) SELECT split, chart_type, referring_type, action, difficulty, style_family, template, distractors, count(*) AS n FROM d GROUP BY GROUPING SETS ((split), (split, chart_type), (split, referring_type), (split, action), (split, difficulty), (chart_type, referring_type, split), (chart_type, referring_type, split, action), (style_family), (template), (distractors), (difficulty))",
    "JN05_images": "SELECT n_nationkey AS image_id, n_name FROM nation WHERE n_nationkey < 12 AND n_nationkey IN (SELECT image_id FROM fx_ref WHERE split = 'F') AND n_nationkey IN (SELECT image_id FROM fx_ref WHERE split NOT IN ('F', 'O'))",
    "JN15_restored_index": "SELECT 0 AS part, count(*) AS n, sum(n_nationkey)::BIGINT AS index_sum, max(n_nationkey)::BIGINT AS last FROM nation UNION ALL SELECT 1, count(*), sum(s_suppkey)::BIGINT, max(s_suppkey) FROM supplier",
    "MA02_sequence_ratio": "WITH d AS (SELECT uid, sample_id, reward / 100 AS p, (sample_id % 13) / 10 AS q, reward - 50 AS a, CASE WHEN sample_id % 3 > 0 THEN 1 ELSE 0 END AS m FROM fx_rollout), s AS (SELECT *, sum((p - q) * m) OVER (PARTITION BY uid) / (sum(m) OVER (PARTITION BY uid) + 1e-8) * m AS l FROM d), k AS (SELECT *, exp(l) AS x FROM s), h AS (SELECT *, CASE WHEN x < 0.8 THEN 0.8 WHEN x > 1.3 THEN 1.3 ELSE x END AS y FROM k) SELECT sample_id, round(CASE WHEN a < 0 THEN least(greatest(-a * x, -a * y), -3 * a) ELSE greatest(-a * x, -a * y) END, 6) AS loss FROM h",
    "MA13_samplers": "SELECT p_partkey, array_to_string(list_sort(list_distinct([CASE WHEN n > 1 THEN (i * (p_size - 1) // (n - 1))::INT ELSE 0 END FOR i IN range(n)])), ',') AS clamped, array_to_string(range(0, p_size, 4), ',') AS fourth, array_to_string([((i * p_size // 5) + ('0x' || substr(md5(p_partkey || '-' || i), 1, 8))::BIGINT % greatest((i + 1) * p_size // 5 - i * p_size // 5, 1))::INT FOR i IN range(5)], ',') AS drawn FROM (SELECT *, least(greatest(p_size // 4, 4), 8) AS n FROM part)",
    "GE19_leading_dimensions": "SELECT vec_id AS id, CASE WHEN vec_id % 3 > 0 THEN list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) END AS px FROM embeddings",
    "GE22_in_step": f"WITH m AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS m, list_transform(range(64), lambda i: (i * 7 + vec_id) % 256) AS im FROM embeddings) SELECT id, array_to_string({_MOVE.format('im')}, ',') AS image, array_to_string({_MOVE.format('m')}, '') AS mask FROM m",
    "VA01_schema": "SELECT p_partkey, CASE WHEN p_partkey % 29 = 0 THEN 'not an object' ELSE array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'id: missing' END, CASE WHEN p_partkey % 11 = 0 THEN 'extra: unknown' END, CASE WHEN p_partkey % 7 = 0 THEN 'width: not integer' END, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 'parameters.color: not string' END, CASE WHEN p_partkey % 3 = 1 THEN 'parameters.x: unknown' END], lambda x: x IS NOT NULL), '; ') END AS violations FROM part",
    "VA06_action_rows": "SELECT l_partkey, l_quantity::INT % 10 AS expression, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT year(l_shipdate)) > 1 AND count(DISTINCT l_returnflag) > 1",
    "VA09_exact_contract": f"WITH {_PLAN} {_CONTRACT} UNION ALL SELECT 'split', 'holdout', 7, 0, false",
    "VA09_coverage": f"WITH {_PLAN}, g AS (SELECT split, chart, list(DISTINCT difficulty) AS v FROM d WHERE NOT (chart = 'P' AND difficulty = '1') GROUP BY ALL) SELECT split, chart, array_to_string(list_sort(list_filter(['0', '1', '3'], lambda x: NOT list_contains(v, x))), ',') AS missing, array_to_string(list_sort(list_filter(v, lambda x: x NOT IN ('0', '1', '3'))), ',') AS foreign_ FROM g".replace("foreign_", '"foreign"'),
    "VA09_balance": f"WITH {_PLAN}, g AS (SELECT count(*) AS n FROM d GROUP BY difficulty) SELECT min(n) AS lo, max(n) AS hi, max(n) - min(n) AS gap, max(n) - min(n) <= 1 AS even FROM g",
    "PF18_refetched": "WITH d AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS place, count(*) OVER () AS n, s_suppkey % 3 > 0 AS ok FROM supplier), b AS (SELECT place, k, ('0x' || substr(md5(place || '-' || k || '-7'), 1, 8))::BIGINT % n AS pick FROM d, range(1, 6) AS q(k) WHERE NOT ok), f AS (SELECT b.place, arg_min(pick, k) AS pick FROM b JOIN d g ON g.place = pick AND g.ok GROUP BY b.place) SELECT place AS pos, place AS picked, s_suppkey, s_name FROM d WHERE ok UNION ALL SELECT f.place, f.pick, g.s_suppkey, g.s_name FROM f JOIN d g ON g.place = f.pick",
    "SC04_json_object": "SELECT s_suppkey::VARCHAR AS key, s_name, s_nationkey FROM supplier",
    "SC08_samples": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 5 > 0",
    "SC11_listing": "SELECT DISTINCT n_regionkey::VARCHAR AS region, true AS filled FROM nation WHERE n_regionkey <> 2",
    "SC14_pairs": "SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS stem FROM supplier WHERE s_suppkey % 3 > 0",
    "SC15_encodings": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name || ' né “42”' AS text FROM nation",
    "SC01_SK01_formats": "SELECT fmt, count(*) AS n, sum(p_size)::BIGINT AS size, min(p_name || ' \"q\", ' || p_brand) AS first, sum(length(p_name || ' \"q\", ' || p_brand))::BIGINT AS chars FROM part, (SELECT unnest(['csv', 'tsv', 'jsonl', 'parquet']) AS fmt) GROUP BY fmt",
    "SC12_bad_lines": "SELECT '{broken ' || s_suppkey AS value FROM supplier WHERE s_suppkey % 6 = 0",
    "SK02_shard_files": "WITH d AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS s FROM orders) SELECT 'refs-' || lpad(s::VARCHAR, 5, '0') AS shard, count(*) AS n, min(o_orderkey) AS first, sum(o_custkey)::BIGINT AS customers FROM d GROUP BY s",
    "SK04_summary_files": "SELECT 'results' AS file, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS line FROM nation UNION ALL SELECT 'metrics', chart_type || ',' || m || ',' || v FROM (SELECT chart_type, unnest(['inter', 'n']) AS m, unnest([sum(inter_px)::DOUBLE, count(*)::DOUBLE]) AS v FROM fx_iou GROUP BY chart_type)",
    "SK06_submission_rows": "SELECT idx AS index, answer AS prediction FROM fx_option",
}

"""Rollout statistics, batch reshaping and assignment of rows to parts."""

from __future__ import annotations

SQL = {
    "WN01_grpo": "SELECT sample_id, round((reward - avg(reward) OVER (PARTITION BY uid)) / (stddev_samp(reward) OVER (PARTITION BY uid) + 1E-6), 6) AS adv FROM fx_rollout",
    "WN02_passk": """WITH r AS (SELECT uid, sample_id, reward, row_number() OVER (PARTITION BY uid ORDER BY reward DESC, sample_id) AS rn, stddev_samp(reward) OVER (PARTITION BY uid) AS sd FROM fx_rollout),
      s AS (SELECT uid, max(CASE WHEN rn = 2 THEN reward END) AS second FROM r GROUP BY uid)
      SELECT r.sample_id, round(CASE WHEN rn = 1 THEN (reward - second) / (sd + 1E-6) ELSE reward END, 6) AS adv FROM r JOIN s ON r.uid = s.uid""",
    "WN03_rloo": "SELECT sample_id, round(reward - (sum(reward) OVER (PARTITION BY uid) - reward) / (count(*) OVER (PARTITION BY uid) - 1), 6) AS adv FROM fx_rollout",
    "WN06_returns": "SELECT uid, sample_id, round(sum(reward) OVER (PARTITION BY uid ORDER BY sample_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS ret FROM fx_rollout",
    "WN07_response_mask": "SELECT uid, sample_id, CASE WHEN coalesce(sum(CASE WHEN source = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS mask FROM fx_rollout",
    "WN08_inverse_permutation": "SELECT cast(row_number() OVER (ORDER BY reward, sample_id) - 1 AS bigint) AS to_pos, cast(row_number() OVER (ORDER BY sample_id) - 1 AS bigint) AS from_pos FROM fx_rollout",
    "WN09_tertiles": "WITH r AS (SELECT sample_id, row_number() OVER (ORDER BY reward, sample_id) AS rn, count(*) OVER () AS n FROM fx_rollout) SELECT sample_id, cast(least(2, floor((rn - 1) * 3 / cast(n AS double))) AS int) AS tertile FROM r",
    "WN10_position": "SELECT uid, sample_id, cast(row_number() OVER (ORDER BY uid, sample_id) - 1 AS bigint) AS pos FROM fx_rollout",
    "WN13_circular": """WITH k AS (SELECT n_regionkey AS base, n_nationkey AS k, n_nationkey % 4 AS ord FROM nation), p AS (SELECT base, k, (ord - lag(ord) OVER (PARTITION BY base ORDER BY k) + 8) % 4 AS step FROM k)
      SELECT base, min(CASE WHEN step IS NULL OR step = 1 THEN 1 ELSE 0 END) AS valid FROM p GROUP BY base""",
    "WN14_rotated_order": "SELECT s_suppkey AS sample, k.n AS variant, (s_suppkey + k.n) % 3 AS position FROM supplier CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) k",
    "WN15_last_writer": "SELECT uid, sample_id, source FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY sample_id DESC) AS rn FROM fx_rollout) t WHERE rn = 1",
    "WN16_first_occurrence": "SELECT source, min(sample_id) AS first_at FROM fx_rollout GROUP BY source",
    "WN17_crossings": "WITH s AS (SELECT uid, sample_id, CASE WHEN reward - 50 < 0 THEN -1 ELSE 1 END AS sgn FROM fx_rollout), l AS (SELECT uid, sgn, lag(sgn) OVER (PARTITION BY uid ORDER BY sample_id) AS prev FROM s) SELECT uid, count(CASE WHEN sgn <> prev THEN 1 END) AS crossings FROM l GROUP BY uid",
    "PF05_slice": "SELECT idx FROM (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS rn FROM fx_option) t WHERE rn >= 10 AND rn < 400 AND (rn - 10) % 7 = 0",
    "PF06_strided_shard": "SELECT idx FROM fx_option WHERE idx % 8 = 3",
    "PF07_block_shard": "SELECT idx FROM (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS rn FROM fx_option) t WHERE rn >= 100 AND rn < 200",
    "PF08_split_filter": "SELECT sample_id, n_chars FROM fx_manifest WHERE split = 'val'",
    "PF16_any_substring": "SELECT idx FROM fx_option WHERE position('1' IN a) > 0 OR position('3' IN a) > 0",
    "PF17_group_band": "SELECT sample_id, uid FROM (SELECT *, avg(reward) OVER (PARTITION BY uid) AS m FROM fx_rollout) t WHERE m > 45 AND m < 52",
    "PF22_tagged": "SELECT idx, 'part' AS sub_dataset, answer FROM fx_option",
    "SE01_concat": "SELECT sample_id, uid FROM fx_rollout WHERE uid % 2 = 0 UNION ALL SELECT sample_id, uid FROM fx_rollout WHERE uid % 2 = 1",
    "SE02_chunk": "SELECT idx, cast(floor((row_number() OVER (ORDER BY idx) - 1) / (count(*) OVER () / 4.0E0)) AS int) AS chunk FROM fx_option",
    "SE03_repeat": "WITH k AS (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) SELECT s_suppkey AS id, k, cast(row_number() OVER (ORDER BY s_suppkey, k) - 1 AS bigint) AS interleaved, cast(row_number() OVER (ORDER BY k, s_suppkey) - 1 AS bigint) AS tiled FROM supplier CROSS JOIN k",
    "SE04_pad": "WITH r AS (SELECT n_nationkey AS id, row_number() OVER (ORDER BY n_nationkey) - 1 AS rn FROM nation) SELECT id, cast(rn AS bigint) AS pos FROM r UNION ALL SELECT id, cast(rn + 25 AS bigint) FROM r WHERE rn < 7",
    "SE07_round_robin": "WITH s AS (SELECT s_suppkey AS id, s_suppkey % 3 AS shard, cast(row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS bigint) AS pos FROM supplier) SELECT id, cast(row_number() OVER (ORDER BY pos, shard) AS bigint) AS merged FROM s",
    "SE08_shard_merge": "SELECT source, cast(sum(n) AS bigint) AS n FROM (SELECT source, uid % 4 AS shard, count(*) AS n FROM fx_rollout GROUP BY source, uid % 4) t GROUP BY source",
    "SE12_offset": "SELECT cast(CASE WHEN max(idx) >= 1000000 THEN 10000000 ELSE 1000000 END AS bigint) AS off FROM fx_option",
    "AG36_reduce_metrics": "SELECT source AS metric, round(avg(reward), 6) AS mean FROM fx_rollout GROUP BY source",
    "AG37_length_metrics": "WITH m AS (SELECT max(n_chars) AS top FROM documents) SELECT round(avg(cast(n_chars AS double)), 6) AS mean, max(n_chars) AS most, min(n_chars) AS least, avg(CASE WHEN n_chars = top THEN 1.0E0 ELSE 0.0E0 END) AS clip_ratio FROM documents CROSS JOIN m",
    "AG50_imbalance": "WITH c AS (SELECT doc_id % 8 AS chunk, sum(n_chars) AS s FROM documents GROUP BY doc_id % 8) SELECT cast(min(s) AS bigint) AS lo, cast(max(s) AS bigint) AS hi, cast(max(s) - min(s) AS bigint) AS gap FROM c",
}

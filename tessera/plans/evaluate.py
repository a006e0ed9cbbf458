"""Evaluation roll-ups: accuracy per split, ability and category; macro and micro means; scores of answers."""

from __future__ import annotations

SQL = {
    "AG01_report_acc": "SELECT split, l2, category, count(*) AS n, cast(sum(hit) AS bigint) AS hits, cast(sum(hit) AS double) / count(*) AS acc FROM fx_eval GROUP BY GROUPING SETS ((split), (split, l2), (split, category))",
    "AG02_macro_l2": """WITH c AS (SELECT split, l2, category, cast(sum(hit) AS double) / count(*) AS acc FROM fx_eval GROUP BY GROUPING SETS ((split, l2, category), (l2, category)))
      SELECT coalesce(split, 'ALL') AS split, l2, round(avg(acc), 9) AS acc, count(*) AS n_categories FROM c GROUP BY coalesce(split, 'ALL'), l2""",
    "AG03_report_by_column": "SELECT coalesce(CASE WHEN category <> 'src0' THEN category END, 'None') AS grp, count(*) AS n, cast(sum(hit) AS double) / count(*) AS acc FROM fx_eval GROUP BY coalesce(CASE WHEN category <> 'src0' THEN category END, 'None')",
    "AG04_yes_no_rating": "SELECT category, l2, 100.0E0 * cast(sum(hit) AS double) / count(*) AS score FROM fx_eval GROUP BY GROUPING SETS ((), (category), (l2))",
    "AG05_paired_product": """WITH p AS (SELECT c_nationkey AS category, c_custkey % 50 AS image, min(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS every_one, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS right_n, count(*) AS n FROM customer GROUP BY c_nationkey, c_custkey % 50)
      SELECT category, round(100.0E0 * sum(right_n) / sum(n), 6) AS acc, round(100.0E0 * avg(every_one), 6) AS acc_plus FROM p GROUP BY category""",
    "AG06_all_correct": """WITH f AS (SELECT l2, split, category, min(hit) AS ok, count(*) AS n, sum(hit) AS h FROM fx_eval GROUP BY l2, split, category)
      SELECT l2, cast(sum(h) AS double) / sum(n) AS a_acc, cast(sum(ok) AS double) / count(*) AS f_acc FROM f GROUP BY GROUPING SETS ((), (l2))""",
    "AG07_prf1": """WITH e AS (SELECT split AS cat, hit, cast(l2 AS int) AS pred FROM fx_eval UNION ALL SELECT category, hit, cast(l2 AS int) FROM fx_eval),
      s AS (SELECT cat, sum(hit * pred) AS tp, sum(pred) AS pp, sum(hit) AS gp FROM e GROUP BY GROUPING SETS ((), (cat)))
      SELECT cat, CASE WHEN pp > 0 THEN cast(tp AS double) / pp ELSE 0.0E0 END AS prec, CASE WHEN gp > 0 THEN cast(tp AS double) / gp ELSE 0.0E0 END AS rec, CASE WHEN pp + gp > 0 THEN 2.0E0 * tp / (pp + gp) ELSE 0.0E0 END AS f1 FROM s""",
    "AG08_mean_of_category_means": """WITH c AS (SELECT CASE WHEN category IN ('src1', 'src2') THEN 'merged' ELSE category END AS cat, avg(cast(hit AS double)) AS acc FROM fx_eval GROUP BY CASE WHEN category IN ('src1', 'src2') THEN 'merged' ELSE category END)
      SELECT round(avg(acc), 9) AS score, count(*) AS n FROM c""",
    "AG09_cycle_average": """WITH c AS (SELECT split, category, avg(cast(hit AS double)) AS acc FROM fx_eval GROUP BY split, category), k AS (SELECT count(DISTINCT split) AS n FROM fx_eval)
      SELECT category, round(sum(acc) / max(n), 9) AS average FROM c CROSS JOIN k GROUP BY category""",
    "AG10_multi_label": """WITH e AS (SELECT 'Overall' AS label, hit FROM fx_eval UNION ALL SELECT split, hit FROM fx_eval UNION ALL SELECT category, hit FROM fx_eval)
      SELECT label, count(*) AS tot, cast(sum(hit) AS bigint) AS hit, cast(sum(hit) AS double) / count(*) AS rate FROM e GROUP BY label""",
    "AG11_rollup_subject": "SELECT coalesce(category, 'Overall') AS subject, count(*) AS tot, cast(sum(hit) AS bigint) AS hit FROM fx_eval GROUP BY ROLLUP (category)",
    "AG13_capabilities": """WITH cap AS (SELECT 'src1' AS cap UNION ALL SELECT 'src2' UNION ALL SELECT 'src3' UNION ALL SELECT '5')
      SELECT cap, count(*) AS n, cast(sum(hit) AS bigint) AS hits FROM fx_eval CROSS JOIN cap WHERE position(cap IN category) > 0 GROUP BY cap""",
    "AG14_score_ratio": "SELECT l_returnflag AS category, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice) * 100, 6) AS ratio FROM lineitem GROUP BY ROLLUP (l_returnflag)",
    "AG15_clipped_dimensions": "SELECT event_type, cast(sum(least(greatest(cast(floor(value) AS bigint), 0), 10)) AS bigint) AS total, count(*) AS n_all, count(CASE WHEN value >= 0 THEN 1 END) AS n_valid FROM events GROUP BY event_type",
    "AG16_clip_valid": "SELECT event_type, round(avg(greatest(value, 0)), 6) AS mean_all, round(avg(CASE WHEN value >= 10 THEN value END), 6) AS mean_valid FROM events GROUP BY event_type",
    "AG17_duration_cube": "SELECT split, l2, count(*) AS n, cast(sum(hit) AS double) / count(*) AS acc FROM fx_eval GROUP BY CUBE (split, l2)",
    "AG18_task_report": "SELECT coalesce(category, 'overall') AS task, cast(sum(hit) AS bigint) AS correct, count(*) AS total FROM fx_eval GROUP BY ROLLUP (category)",
    "AG19_task_tree": "SELECT split, l2, category, cast(sum(hit) AS double) / count(*) AS acc, count(*) AS n FROM fx_eval GROUP BY ROLLUP (split, l2, category)",
    "AG20_subtotals": "SELECT split, cast(sum(hit) AS bigint) AS final, cast(sum(CASE WHEN l2 = '0' THEN hit ELSE 0 END) AS bigint) AS clean, cast(sum(hit) AS double) / 10 AS tenth FROM fx_eval GROUP BY split",
    "AG21_score_or_null": "SELECT category, cast(sum(hit) AS double) / nullif(count(CASE WHEN l2 = '1' THEN 1 END), 0) AS score FROM fx_eval GROUP BY ROLLUP (category)",
    "AG22_substring_accuracy": "SELECT p_brand AS category, 100.0E0 * sum(CASE WHEN position('a' IN p_name) > 0 THEN 1 ELSE 0 END) / count(*) AS acc FROM part GROUP BY ROLLUP (p_brand)",
    "AG23_evidence_rows": "SELECT sum(CASE WHEN split = 'en' THEN hit END) / cast(count(CASE WHEN split = 'en' THEN 1 END) AS double) AS en, sum(CASE WHEN l2 = '1' THEN hit END) / cast(count(CASE WHEN l2 = '1' THEN 1 END) AS double) AS toxic, 2.0E0 * sum(hit * cast(l2 AS int)) / (sum(hit) + sum(cast(l2 AS int))) AS f1 FROM fx_eval",
    "AG24_means": "SELECT chart_type, round(avg(iou), 6) AS mean_iou, round(avg(dice), 6) AS mean_dice FROM fx_iou GROUP BY chart_type",
    "AG25_vqa_split": "SELECT split, category, round(100 * avg(cast(hit AS double)), 6) AS acc FROM fx_eval GROUP BY GROUPING SETS ((split), (category))",
    "AG45_bincount": "SELECT label AS value, count(*) AS n FROM embeddings GROUP BY label",
    "AG46_failure_rate": "SELECT count(*) AS n, count(CASE WHEN position('Cannot' IN prediction) > 0 THEN 1 END) AS failed, cast(count(CASE WHEN position('Cannot' IN prediction) > 0 THEN 1 END) AS double) / count(*) AS rate FROM fx_option",
    "AG52_contains_accuracy": "SELECT count(*) AS n, count(CASE WHEN position(answer IN prediction) > 0 THEN 1 END) AS correct FROM fx_option",
    "JN01_answer_key": "SELECT o.idx, o.prediction, k.answer AS gt, CASE WHEN position(concat(' ', k.answer, '.') IN o.prediction) > 0 THEN 1 ELSE 0 END AS hit FROM fx_option o JOIN (SELECT idx, answer FROM fx_option WHERE idx % 2 = 0) k ON o.idx = k.idx",
    "JN02_unknown_rows": "SELECT o.idx FROM fx_option o LEFT ANTI JOIN (SELECT idx FROM fx_option WHERE idx % 10 <> 0) k ON o.idx = k.idx",
    "JN15_split_back": "SELECT 'low' AS sub, count(*) AS n, cast(sum(hit) AS bigint) AS hits FROM fx_eval WHERE idx % 2 = 0 UNION ALL SELECT 'high', count(*), cast(sum(hit) AS bigint) FROM fx_eval WHERE idx % 2 = 1",
    "TX12_edit_distance": "SELECT a.n_nationkey AS a, b.n_nationkey AS b, cast(levenshtein(a.n_name, b.n_name) AS bigint) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "TX38_phrase_position": "SELECT doc_id, cast(position('the ' IN lower(text)) - 1 AS bigint) AS pos FROM documents",
    "TX46_reformulated": "SELECT idx, coalesce(c, answer) AS a, CASE WHEN c IS NULL THEN 'Other Answers' ELSE a END AS b, CASE WHEN answer IN ('A', 'B', 'C', 'D') THEN answer ELSE 'A' END AS answer FROM fx_option",
    "PF09_resume": "SELECT idx, prediction FROM fx_option o LEFT ANTI JOIN (SELECT idx AS k FROM fx_option WHERE idx % 7 < 3) d ON o.idx = d.k",
    "PF10_not_null": "SELECT idx, c FROM fx_option WHERE c IS NOT NULL",
    "SE09_concat_reindex": "WITH u AS (SELECT 0 AS part, s_suppkey AS original_index FROM supplier UNION ALL SELECT 1, n_nationkey FROM nation) SELECT part, original_index, cast(row_number() OVER (ORDER BY part, original_index) - 1 AS bigint) AS new_index FROM u",
    "ST01_order_by_index": "SELECT idx, cast(row_number() OVER (ORDER BY idx) AS bigint) AS pos FROM fx_option",
}

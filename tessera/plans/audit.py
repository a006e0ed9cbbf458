"""Masks, annotation joins, dataset audits and experiment comparison."""

from __future__ import annotations

SQL = {
    "AG27_summary": "SELECT chart_type, count(*) AS n, round(avg(iou), 6) AS mean_iou, round(median(iou), 6) AS median_iou, cast(sum(inter_px) AS double) / sum(union_px) AS micro_iou, 2.0E0 * sum(inter_px) / (sum(pred_px) + sum(gt_px)) AS micro_dice FROM fx_iou GROUP BY chart_type",
    "AG28_flags": "SELECT chart_type, count(CASE WHEN inter_px = 0 THEN 1 END) AS disjoint, count(CASE WHEN inter_px = gt_px THEN 1 END) AS covered, count(CASE WHEN pred_px > gt_px THEN 1 END) AS over_n, cast(count(CASE WHEN inter_px = 0 THEN 1 END) AS double) / count(*) AS disjoint_rate, round(min(iou), 9) AS worst FROM fx_iou GROUP BY chart_type",
    "AG29_dimensions": "SELECT chart_type, ref_type, variant, count(*) AS n, round(avg(iou), 6) AS mean_iou, cast(sum(inter_px) AS double) / sum(union_px) AS micro_iou FROM fx_iou GROUP BY GROUPING SETS ((chart_type), (ref_type), (variant))",
    "AG30_group_macro": """WITH g AS (SELECT chart_type, ref_type, round(avg(iou), 9) AS m FROM fx_iou GROUP BY chart_type, ref_type), r AS (SELECT *, row_number() OVER (ORDER BY m, chart_type, ref_type) AS rn FROM g)
      SELECT round(avg(m), 6) AS macro, max(CASE WHEN rn = 1 THEN concat(chart_type, '/', ref_type) END) AS worst FROM r""",
    "AG31_localisation": "SELECT chart_type, cast(count(CASE WHEN iou > 0.5 THEN 1 END) AS double) / count(*) AS lq, round(coalesce(avg(CASE WHEN iou > 0.5 THEN iou END), 0), 6) AS sq, round(avg(iou), 6) AS miou FROM fx_iou GROUP BY ROLLUP (chart_type)",
    "AG34_best_box": "SELECT round(avg(CASE WHEN best >= 0.5 THEN 1.0E0 ELSE 0.0E0 END), 9) AS ap50, round(avg(best), 6) AS mean_best FROM (SELECT sample_id, max(iou) AS best FROM fx_iou GROUP BY sample_id) t",
    "AG35_type_means": "WITH e AS (SELECT sample_id, max(chart_type) AS type_id, round(avg(iou) * 100, 6) AS j FROM fx_iou GROUP BY sample_id), t AS (SELECT type_id, avg(j) AS j FROM e GROUP BY type_id) SELECT round(avg(j), 4) AS j FROM t",
    "AG42_crosstab": "WITH c AS (SELECT DISTINCT chart_type FROM fx_attempt), r AS (SELECT DISTINCT ref_type FROM fx_attempt), n AS (SELECT chart_type, ref_type, count(*) AS k FROM fx_attempt GROUP BY chart_type, ref_type) SELECT c.chart_type, r.ref_type, coalesce(n.k, 0) AS n FROM c CROSS JOIN r LEFT JOIN n ON n.chart_type = c.chart_type AND n.ref_type = r.ref_type",
    "AG43_distributions": "SELECT split, style_family, chart_type, count(*) AS n FROM fx_manifest GROUP BY GROUPING SETS ((split), (style_family), (chart_type), (split, chart_type), (split, style_family, chart_type))",
    "AG48_wins_ties": """WITH m AS (SELECT sample_id, variant, iou, max(iou) OVER (PARTITION BY sample_id) AS top FROM fx_pair), t AS (SELECT sample_id, count(CASE WHEN iou = top THEN 1 END) AS k, min(CASE WHEN iou = top THEN variant END) AS who FROM m GROUP BY sample_id)
      SELECT CASE WHEN k = 1 THEN who END AS winner, count(*) AS n FROM t GROUP BY CASE WHEN k = 1 THEN who END""",
    "JN04_ref_filter": "SELECT ref_id FROM fx_ref WHERE image_id IN (1, 2, 3) AND category_id = 1 AND position('F' IN split) > 0",
    "JN05_ann_ids": "SELECT DISTINCT r.ann_id FROM fx_ref r LEFT SEMI JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) n ON r.image_id = n.n_nationkey",
    "JN07_positional_union": "SELECT a.s_suppkey AS row_id, a.s_name, b.s_acctbal, a.s_nationkey = b.s_nationkey AS consistent FROM supplier a JOIN supplier b ON a.s_suppkey = b.s_suppkey",
    "JN09_summary_delta": "WITH a AS (SELECT chart_type, round(avg(iou), 9) AS m FROM fx_iou WHERE variant = 1 GROUP BY chart_type), b AS (SELECT chart_type, round(avg(iou), 9) AS m FROM fx_iou WHERE variant = 2 GROUP BY chart_type) SELECT coalesce(a.chart_type, b.chart_type) AS chart_type, round(b.m - a.m, 6) AS delta FROM a FULL OUTER JOIN b ON a.chart_type = b.chart_type",
    "JN17_selection_audit": "SELECT 'unknown' AS kind, count(*) AS n FROM (SELECT sample_id + 5 AS k FROM fx_manifest) s LEFT ANTI JOIN fx_manifest m ON s.k = m.sample_id UNION ALL SELECT 'held out', count(*) FROM (SELECT sample_id + 5 AS k FROM fx_manifest) s LEFT SEMI JOIN (SELECT sample_id FROM fx_manifest WHERE split = 'test') m ON s.k = m.sample_id",
    "ST02_worst10": "SELECT sample_id, variant, iou FROM (SELECT sample_id, variant, round(iou, 9) AS iou, row_number() OVER (ORDER BY round(iou, 9), sample_id, variant) AS rn FROM fx_pair) t WHERE rn <= 10",
    "ST04_gallery": "SELECT chart_type, ref_type, min(sample_id) AS pick FROM fx_attempt GROUP BY chart_type, ref_type",
    "ST09_staged_argmax": "WITH v AS (SELECT variant, round(avg(iou), 6) AS a, round(avg(dice), 6) AS b, count(CASE WHEN inter_px = 0 THEN 1 END) AS c FROM fx_iou GROUP BY variant) SELECT variant FROM (SELECT variant, row_number() OVER (ORDER BY a DESC, b DESC, c, variant) AS rn FROM v) t WHERE rn = 1",
    "ST10_best_checkpoint": "WITH v AS (SELECT variant, round(avg(iou), 3) AS a FROM fx_iou GROUP BY variant) SELECT variant FROM (SELECT variant, row_number() OVER (ORDER BY a DESC, variant) AS rn FROM v) t WHERE rn = 1",
    "ST11_reorder": "SELECT n_name, cast(row_number() OVER (ORDER BY (n_nationkey * 7) % 25) - 1 AS bigint) AS pos FROM nation",
    "SE10_overlap": "SELECT sample_id FROM fx_manifest WHERE split = 'val' INTERSECT SELECT sample_id + 1 FROM fx_manifest WHERE split = 'train'",
    "SE14_zero_product": "SELECT r.r_name, s.o_orderstatus FROM region r CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) s",
    "VA05_leakage": "SELECT md5(text) AS digest, count(DISTINCT split) AS n_splits, count(*) AS n FROM fx_manifest GROUP BY md5(text) HAVING count(DISTINCT split) > 1",
    "VA06_action_duplicates": "SELECT style_family, cast(floor(n_chars / 100.0E0) AS bigint) AS size_class, count(*) AS n FROM fx_manifest GROUP BY style_family, cast(floor(n_chars / 100.0E0) AS bigint) HAVING count(DISTINCT split) > 1 AND count(DISTINCT chart_type) > 1",
    "VA07_exact_duplicates": "SELECT digest, count(*) AS n, min(sample_id) AS first_id FROM (SELECT md5(text) AS digest, sample_id FROM fx_manifest) t GROUP BY digest HAVING count(*) > 1",
    "VA09_distribution": "WITH e AS (SELECT DISTINCT chart_type, s.split FROM fx_manifest CROSS JOIN (SELECT DISTINCT split FROM fx_manifest) s), a AS (SELECT chart_type, split, count(*) AS n FROM fx_manifest GROUP BY chart_type, split) SELECT e.chart_type, e.split, coalesce(a.n, 0) AS n, coalesce(a.n, 0) >= 10 AS ok FROM e LEFT JOIN a ON a.chart_type = e.chart_type AND a.split = e.split",
    "VA11_mask_issues": "SELECT count(CASE WHEN pred_px = 0 THEN 1 END) AS empty, count(CASE WHEN pred_px > 40 THEN 1 END) AS large, round(avg(pred_px / 64.0E0), 6) AS mean_ratio, round(median(pred_px / 64.0E0), 6) AS median_ratio FROM fx_attempt",
    "VA15_outcomes": "SELECT sample_id, variant, max(CASE WHEN inter_px = 0 THEN 1 ELSE 0 END) AS disjoint, max(CASE WHEN pred_px < gt_px THEN 1 ELSE 0 END) AS under FROM fx_attempt GROUP BY sample_id, variant",
    "PA11_factorial_plan": "SELECT r.r_regionkey AS chart, n.n_nationkey AS slot, (r.r_regionkey * 7 + n.n_nationkey * 3) % 5 AS palette, md5(concat(cast(r.r_regionkey AS string), '-', cast(n.n_nationkey AS string))) AS seed FROM region r CROSS JOIN nation n",
}

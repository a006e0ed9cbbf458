"""Answer extraction, text scoring and tag handling, and operations on arrays and masks, with higher-order functions."""

from __future__ import annotations


#: Answer prefixes that are taken off (two pairs are one string each and so hardly ever occur).
ANSWER_PREFIXES = ("The best answer is", "The correct answer is", "The answer is", "The answer", "The best option isThe correct option is", "Best answer:Best option:")


def _without(column: str, strings: tuple[str, ...]) -> str:
    for s in strings:
        column = f"replace({column}, '{s}', '')"
    return column



SQL = {
    "TX04_first_letter": f"""WITH s AS (SELECT idx, trim({_without('trim(prediction)', ANSWER_PREFIXES)}) AS s FROM fx_option)
      SELECT idx, CASE WHEN length(s) - length(replace(s, ' ', '')) + 1 > 10 AND regexp_extract(s, '[ABCDE]', 0) = '' THEN '' WHEN regexp_extract(s, '[ABCDE]', 0) <> '' THEN regexp_extract(s, '[ABCDE]', 0)
        WHEN s = '' OR position(lower(s) IN '(a)') > 0 THEN 'A' WHEN position(lower(s) IN '(b)') > 0 THEN 'B' WHEN position(lower(s) IN '(c)') > 0 THEN 'C' WHEN position(lower(s) IN '(d)') > 0 THEN 'D' WHEN position(lower(s) IN '(e)') > 0 THEN 'E' ELSE '' END AS opt FROM s""",
    "TX14_bag_f1": """WITH t AS (SELECT p_partkey AS id, split(lower(p_name), ' ') AS p, split(lower(p_type), ' ') AS g FROM part), c AS (SELECT id, size(p) AS np, size(g) AS ng, size(filter(p, x -> array_contains(g, x))) AS tp FROM t)
      SELECT id, CASE WHEN tp = 0 THEN 0.0E0 ELSE round(2.0E0 * tp / (np + ng), 9) END AS f1 FROM c""",
    "TX39_tags": "WITH t AS (SELECT p_partkey AS id, concat('<obj', cast(p_size AS string), '> near <obj', cast(p_partkey % 9 AS string), '>') AS s FROM part) SELECT id, array_join(regexp_extract_all(s, '<obj([0-9]+)>', 1), ',') AS tags FROM t",
    "TX43_prompt": "SELECT idx, concat('Question: ', prediction, chr(10), 'A. ', a, chr(10), 'B. ', b, CASE WHEN c IS NOT NULL THEN concat(chr(10), 'C. ', c) ELSE '' END, CASE WHEN d IS NOT NULL THEN concat(chr(10), 'D. ', d) ELSE '' END, chr(10), 'Answer: ') AS prompt FROM fx_option",
    "TX51_template": "SELECT idx, CASE WHEN prediction LIKE 'The answer is %.' AND length(prediction) > 15 THEN substr(prediction, 15, length(prediction) - 15) END AS middle FROM fx_option",
    "AG12_metadata": "SELECT cast(get_json_object(props, '$.k') AS int) % 10 AS version, round(100.0E0 * avg(CASE WHEN value > 50 THEN 1.0E0 ELSE 0.0E0 END), 6) AS acc FROM events GROUP BY cast(get_json_object(props, '$.k') AS int) % 10",
    "AG44_quantiles": "SELECT source, round(percentile(reward, 0.25), 6) AS q25, round(percentile(reward, 0.5), 6) AS median, round(percentile(reward, 0.75), 6) AS q75, min(reward) AS lo, max(reward) AS hi FROM fx_rollout GROUP BY source",
    "WN12_history": "SELECT conv_id, turn, array_join(collect_list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), chr(10)) AS prompt FROM fx_turn",
    "ST03_sample_log": "SELECT idx, prediction FROM fx_option ORDER BY md5(concat('7-', cast(idx AS string))) LIMIT 10",
    "ST06_closest_median": "WITH m AS (SELECT source, percentile(reward, 0.5) AS med FROM fx_rollout GROUP BY source), r AS (SELECT f.source, f.sample_id, row_number() OVER (PARTITION BY f.source ORDER BY round(abs(f.reward - m.med), 9), f.sample_id) AS rn FROM fx_rollout f JOIN m ON f.source = m.source) SELECT source, sample_id FROM r WHERE rn = 1",
    "VA10_unique_referent": "SELECT conv_id, count(CASE WHEN role = 'system' THEN 1 END) = 1 AS unique_referent FROM fx_turn GROUP BY conv_id",
    "PA08_fraction": "WITH r AS (SELECT style_family, sample_id, row_number() OVER (PARTITION BY style_family ORDER BY md5(concat('3-', cast(sample_id AS string)))) AS rn, count(*) OVER (PARTITION BY style_family) AS n FROM fx_manifest) SELECT style_family, sample_id FROM r WHERE rn <= floor(n * 0.3E0)",
    "PA14_clip_layout": "SELECT p_partkey, array_join(transform(array_sort(transform(sequence(0, 99), i -> i % p_size)), x -> cast(x AS string)), ',') AS frames FROM part",
    "JN06_many_refs": "WITH r AS (SELECT conv_id AS ref_id, explode(sequence(-1, cast(turn % 3 AS int))) AS ann_id FROM conversations) SELECT r.ref_id, r.ann_id, n.n_name AS mask FROM r LEFT JOIN nation n ON r.ann_id = n.n_nationkey",
}

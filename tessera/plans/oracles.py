"""SQL for DuckDB of the queries in `frames` that the common-dialect modules don't have, written from the operators' rules and
not from their expressions."""

from __future__ import annotations

_STEPS = "WITH RECURSIVE s AS (SELECT uid, event_id AS id, value / 100 AS rw, (event_id % 11) / 10.0::DOUBLE AS v, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM (SELECT *, user_id AS uid FROM events)), m AS (SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM s b WHERE b.uid = a.uid AND b.id < a.id AND b.event_type = 'purchase') THEN 0 ELSE 1 END AS mask FROM s a)"
_MASK = "m AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS m FROM embeddings), pr AS (SELECT a.id, a.m, b.m AS o FROM m a JOIN m b ON a.id % 2 = 0 AND b.id = a.id + 1)"
_PX = f"{_MASK}, px AS (SELECT id, list_sum(m) AS pred, list_sum(o) AS gt, list_sum([least(x, o[i]) FOR x, i IN m]) AS inter FROM pr)"
_SETS = f"{_MASK}, st AS (SELECT id, [m[1:16], m[17:32], m[33:48]] AS p, CASE WHEN (id / 2)::BIGINT % 2 = 0 THEN [o[1:16], o[17:32]] ELSE [o[1:16], o[17:32], o[33:48]] END AS g FROM pr)"
_OPT = "op AS (SELECT idx, answer, CASE WHEN idx % 13 = 0 THEN 'Z' WHEN idx % 11 = 0 THEN 'A or ' || substr('ABCD', (1 + idx % 4)::INT, 1) WHEN idx % 7 = 0 THEN '(' || substr('ABCD', (1 + idx % 4)::INT, 1) || ') I think' ELSE prediction END AS s, list_filter([{'k': 'A', 'v': a}, {'k': 'B', 'v': b}, {'k': 'C', 'v': c}, {'k': 'D', 'v': d}], lambda e: e.v IS NOT NULL) AS o FROM fx_option)"
_BY_LETTER = "list_transform(list_filter(o, lambda e: list_contains(string_split_regex(trim(translate(s, '.()[],:;!*#{}', '             ')), ' +'), e.k)), lambda e: e.k)"
_BY_TEXT = "list_transform(list_filter(o, lambda e: contains(lower(s), lower(e.v))), lambda e: e.k)"
_LETTER = f"CASE WHEN contains(s, 'Cannot determine the answer') THEN 'Z' WHEN len({_BY_LETTER}) = 1 THEN ({_BY_LETTER})[1] WHEN len({_BY_LETTER}) = 0 AND list_contains(string_split_regex(trim(translate(s, '.()[],:;!*#{{}}', '             ')), ' +'), 'Z') THEN 'Z' END"
_TEXT = f"CASE WHEN len({_BY_TEXT}) = 1 THEN ({_BY_TEXT})[1] END"
_SAID = "sd AS (SELECT p_partkey AS id, ['Yes, ', 'No; ', 'yes/no - ', 'The two cats ', '1,5 (a) ', 'It isnt 3.5. ', 'dont [look]: ', 'An ', 'none. '][(p_partkey % 9 + 1)::INT] || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' yes!' ELSE '?' || chr(9) || 'no' END AS text FROM part)"
_MARKS = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")


def _unmarked(source: str) -> str:
    """Steps over the marks one after another as nested selects; periods are doubled by a guard so that RE2 can do it."""
    sql = f"SELECT id, text AS t0, text AS x FROM {source}"
    for m in _MARKS:
        q = m.replace("'", "''")
        sql = f"SELECT id, t0, CASE WHEN contains(t0, '{q} ') OR contains(t0, ' {q}') OR regexp_matches(t0, '[0-9],[0-9]') THEN replace(x, '{q}', '') ELSE replace(x, '{q}', ' ') END AS x FROM ({sql})"
    return f"SELECT id, regexp_replace(regexp_replace(x, '\\.([0-9])', chr(1) || '\\1', 'g'), '\\.', '', 'g') AS y FROM ({sql})"


def _articles(source: str) -> str:
    words = "list_filter(string_split_regex(trim(lower(y)), '\\s+'), lambda w: w <> '')"
    digit = "CASE w WHEN 'none' THEN '0' WHEN 'zero' THEN '0' WHEN 'one' THEN '1' WHEN 'two' THEN '2' WHEN 'three' THEN '3' WHEN 'four' THEN '4' WHEN 'five' THEN '5' WHEN 'six' THEN '6' WHEN 'seven' THEN '7' WHEN 'eight' THEN '8' WHEN 'nine' THEN '9' WHEN 'ten' THEN '10' ELSE w END"
    return f"SELECT id, array_to_string(list_transform(list_filter(list_transform({words}, lambda w: {digit}), lambda w: w NOT IN ('a', 'an', 'the')), lambda w: CASE w WHEN 'isnt' THEN 'isn''t' WHEN 'dont' THEN 'don''t' ELSE w END), ' ') AS text FROM ({source})"


_PLAIN = f"SELECT id, replace(y, chr(1), '.') AS y FROM ({_unmarked('src')})"
_WORDS = "len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> ''))"
_TAG = """tg AS (SELECT id, p_brand, p_type, p_size, CASE WHEN id % 3 = 0 THEN '<think>[SEG] ' || p_name || '</think> <answer>' || ans || '</answer>' WHEN id % 3 = 1 THEN p_name || '<answer>' || ans ELSE 'hm [SEG]</think>' || ans END AS s, ans, p_name, one, two, gt FROM
  (SELECT *, p_type || ' ' || one || CASE WHEN id % 4 = 0 THEN two || one || one || one ELSE two END || ' [SEG]' AS ans FROM (SELECT p_partkey AS id, *, '<|mt_start|><|mt_' || lpad(p_size::VARCHAR, 4, '0') || '|><|mt_000' || (p_partkey % 7) || '|><|mt_end|>' AS one, '<|mt_start|><|mt_000' || (p_partkey % 5) || '|><|mt_000' || (p_partkey % 3) || '|><|mt_end|>' AS two,
  '<|mt_start|><|mt_' || lpad(p_size::VARCHAR, 4, '0') || '|><|mt_000' || (p_partkey % 5) || '|><|mt_end|>' || '<|mt_start|><|mt_000' || (p_partkey % 5) || '|><|mt_000' || (p_partkey % 3) || '|><|mt_end|>' AS gt FROM part)))"""
_IOU3 = "list_transform(p, lambda a: list_transform(g, lambda b: CASE WHEN list_sum(a) + list_sum(b) = 0 THEN 0.0 ELSE list_dot_product(a::DOUBLE[], b::DOUBLE[]) / (list_sum(a) + list_sum(b) - list_dot_product(a::DOUBLE[], b::DOUBLE[])) END))"
_DRAW = "('0x' || substr(md5(b || '-' || j || '-20260916'), 1, 8))::BIGINT"

_LEVELS = "[0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.8999999999999999, 0.95]"
_PICK = "list_max(list_transform(list_filter(range(1, len(x.g) + 1), lambda j: (s.taken[j] = 0 OR x.g[j].crowd) AND x.g[j].u >= threshold AND {} (x.g[j].crowd OR x.g[j].px < lo OR x.g[j].px > hi)), lambda j: {{'u': x.g[j].u, 'j': j}}))"
#: COCO's evaluation: per image and class a fold over detections by falling score, then windows over the global order.
_AP = f"""WITH m AS (SELECT vec_id AS id, vec_id // 10 AS image, vec_id % 2 AS category, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS m FROM embeddings),
tr AS (SELECT image, category, id AS gt, m, id % 10 = 5 AS crowd FROM m WHERE id % 10 < 6),
de AS (SELECT image, category, id AS det, id * 37 % 11 / 11.0::DOUBLE AS score, list_transform(m, lambda v, i: CASE WHEN ((i - 1) * 7 + id) % 16 < id % 4 THEN 1 - v ELSE v END) AS m FROM m),
rk AS (SELECT *, list_sum(m) AS px, row_number() OVER (PARTITION BY image, category ORDER BY score DESC, det) - 1 AS rank FROM de),
ov AS (SELECT r.image, r.category, r.det, list({{'u': CASE WHEN t.crowd THEN list_dot_product(r.m::DOUBLE[], t.m::DOUBLE[]) / r.px ELSE list_dot_product(r.m::DOUBLE[], t.m::DOUBLE[]) / (r.px + list_sum(t.m) - list_dot_product(r.m::DOUBLE[], t.m::DOUBLE[])) END, 'px': list_sum(t.m), 'crowd': t.crowd}} ORDER BY t.gt) AS g FROM rk r JOIN tr t USING (image, category) GROUP BY ALL),
im AS (SELECT r.image, r.category, list({{'score': score, 'rank': rank, 'px': px, 'g': coalesce(g, [])}} ORDER BY rank) AS d FROM rk r LEFT JOIN ov USING (image, category, det) WHERE rank < 5 GROUP BY ALL),
sp AS (SELECT * FROM (VALUES ('all', 0.0, 1e10), ('small', 0.0, 30.0), ('medium', 30.0, 34.0), ('large', 34.0, 1e10)) AS v(area, lo, hi)),
th AS (SELECT unnest({_LEVELS})::DOUBLE AS threshold),
fo AS (SELECT image, category, area, threshold, d, list_reduce(d, lambda s, x: list_transform([coalesce({_PICK.format("NOT")}.j, {_PICK.format("")}.j, 0)], lambda b: {{'taken': list_transform(s.taken, lambda v, i: CASE WHEN i = b THEN 1 ELSE v END),
    'codes': list_append(s.codes, CASE WHEN b = 0 THEN CASE WHEN x.px < lo OR x.px > hi THEN 2 ELSE 0 END WHEN x.g[b].crowd OR x.g[b].px < lo OR x.g[b].px > hi THEN 2 ELSE 1 END)}})[1], {{'taken': list_transform(range(coalesce(len(d[1].g), 0)), lambda j: 0), 'codes': []::INT[]}}).codes AS codes FROM im, sp, th),
un AS (SELECT image, category, area, threshold, d[i].score AS score, d[i].rank AS rank, codes[i] AS code FROM fo, range(1, 6) AS q(i) WHERE i <= len(d)),
tc AS (SELECT category, area, count(*) FILTER (NOT crowd AND list_sum(m) BETWEEN lo AND hi) AS truths FROM tr, sp GROUP BY ALL),
ru AS (SELECT *, sum(code) OVER w AS tp, count(*) OVER w AS n FROM un WHERE code < 2 WINDOW w AS (PARTITION BY category, area, threshold ORDER BY score DESC, image, rank ROWS UNBOUNDED PRECEDING)),
cv AS (SELECT ru.*, truths, tp / truths AS recall, tp / (n + 2.220446049250313e-16) AS prec FROM ru JOIN tc USING (category, area) WHERE truths > 0),
qs AS (SELECT category, area, threshold, r, max(prec) AS q FROM cv, range(101) AS a(r) WHERE recall >= r * 0.01::DOUBLE GROUP BY ALL),
aps AS (SELECT category, area, threshold, sum(q) / 101 AS ap FROM qs GROUP BY ALL),
rc AS (SELECT category, area, threshold, count(*) FILTER (code = 1 AND rank < 1) AS r1, count(*) FILTER (code = 1 AND rank < 3) AS r3, count(*) FILTER (code = 1 AND rank < 5) AS r5 FROM un GROUP BY ALL),
res AS (SELECT category, area, round(threshold, 9) AS threshold, truths, coalesce(ap, 0) AS ap, coalesce(r1, 0) / truths AS recall_1, coalesce(r3, 0) / truths AS recall_3, coalesce(r5, 0) / truths AS recall_5 FROM tc CROSS JOIN th LEFT JOIN aps USING (category, area, threshold) LEFT JOIN rc USING (category, area, threshold) WHERE truths > 0)"""
_CAPTIONS = """c AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN string_split(lower('a ' || p_name || ' of type ' || p_type), ' ') WHEN 1 THEN string_split(lower('the the ' || p_type || ' ' || p_brand || ' the ' || p_name), ' ') WHEN 2 THEN string_split(lower(p_name || ' by ' || p_brand), ' ') ELSE [] END AS hyp,
  CASE WHEN p_partkey % 3 = 0 THEN [string_split(lower('a small ' || p_name || ' of the type ' || p_type), ' '), string_split(lower('the ' || p_type || ' ' || p_name || ' by ' || p_brand || ' of the house'), ' ')] ELSE [string_split(lower('the ' || p_type || ' ' || p_name || ' by ' || p_brand || ' of the house'), ' ')] END AS refs FROM part),
sd AS (SELECT id, 0 AS side, hyp AS w FROM c UNION ALL SELECT id, i AS side, refs[i] FROM c, range(1, 3) AS q(i) WHERE i <= len(refs)),
gr AS (SELECT id, side, n, w[i : i + n - 1] AS g, count(*) AS k FROM sd, range(1, 5) AS a(n), range(1, 30) AS b(i) WHERE i + n - 1 <= len(w) GROUP BY ALL)"""

_MOVED = "((k // {}) % {}) * {}::DOUBLE * CASE WHEN k % 5 = 4 THEN 1 ELSE 0 END"
_PART = "list_transform(e[{}:{}], lambda x: round_even(x::DOUBLE * 8, 0) / 64 + {})"
_GAP = "list_sum(list_transform(list_zip(x.{0}, y.{0}), lambda z: abs(z[1] - z[2])))"
_IMAGES = f"""b AS (SELECT v.vec_id AS k, s.vec_id AS f, s.embedding AS e FROM embeddings v JOIN embeddings s ON s.vec_id = v.vec_id - CASE WHEN v.vec_id % 5 = 4 THEN 1 ELSE 0 END),
im AS (SELECT k, k % 3 = 0 AS val, 1 + f % 4 / 10.0::DOUBLE + {_MOVED.format(19, 3, 0.008)} AS aspect, list_transform(e, lambda x, i: (x > 0) <> (k % 5 = 4 AND (i - 1) % 9 = 0 AND (i - 1) // 9 < (k // 5) % 7)) AS bits,
  {_PART.format(1, 3, _MOVED.format(7, 3, 0.05))} AS hi, {_PART.format(4, 7, _MOVED.format(11, 4, 0.01))} AS ed, {_PART.format(8, 11, _MOVED.format(13, 3, 0.006))} AS ma, f % 50 / 100.0::DOUBLE + {_MOVED.format(17, 3, 0.0015)} AS fg FROM b),
pr AS (SELECT x.k AS a, y.k AS b, len(list_filter(list_zip(x.bits, y.bits), lambda z: z[1] <> z[2])) AS hamming, {_GAP.format('hi')} / 3 AS histogram_l1, {_GAP.format('ed')} / 4 AS edge_mae, {_GAP.format('ma')} / 4 AS mask_mae FROM im x JOIN im y ON x.k < y.k AND x.val <> y.val AND round_even(x.aspect * 20, 0) = round_even(y.aspect * 20, 0) AND abs(x.aspect - y.aspect) <= 0.02 AND abs(x.fg - y.fg) <= 0.002)"""
_BLOTS = "px AS (SELECT vec_id AS id, i, i // 8 AS y, i % 8 AS x, embedding[i + 1] > vec_id % 5 / 8.0::DOUBLE - 0.3::DOUBLE AS one FROM embeddings, range(64) AS q(i))"
_RECORD = "SELECT p_partkey::VARCHAR AS key, CASE WHEN p_partkey % 5 <> 2 THEN p_name END AS p_name, CASE WHEN p_partkey % 5 <> 2 THEN p_size END AS p_size FROM part"
_VALUES = "[0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4, 5, 5, 6]"
ORACLES = {
    "TX25_formulas": f"SELECT p_partkey, {_VALUES}[(p_partkey % 14 + 1)::INT] = {_VALUES}[(p_size % 14 + 1)::INT] AS same FROM part",
    "SC07_keyed_record": f"{_RECORD} WHERE p_partkey IN (3, 7, 12, 77, 1999)",
    "SC07_record_scan": _RECORD,
    "SM04_accumulated": "WITH k AS (SELECT user_id FROM events GROUP BY user_id HAVING avg(value) > 20 AND avg(value) < 80), n AS (SELECT count(*) // 5 AS n FROM k) SELECT b AS batch, 5 AS groups FROM n, range(1000) AS q(b) WHERE b < n",
    "GE25_components": f"WITH RECURSIVE {_BLOTS}, on_ AS (SELECT id, i, y, x FROM px WHERE one), r AS (SELECT id, i, i AS l FROM on_ UNION SELECT b.id, b.i, r.l FROM r JOIN on_ a ON a.id = r.id AND a.i = r.i JOIN on_ b ON b.id = a.id AND abs(a.y - b.y) + abs(a.x - b.x) = 1), t AS (SELECT id, i, min(l) AS l FROM r GROUP BY ALL), k AS (SELECT id, l, count(*) AS n FROM t GROUP BY ALL) SELECT e.vec_id AS id, count(l)::INT AS components, coalesce(max(n), 0) AS largest FROM embeddings e LEFT JOIN k ON k.id = e.vec_id GROUP BY e.vec_id",
    "GE25_point_prompts": f"WITH {_BLOTS}, d AS (SELECT a.id, a.i, coalesce(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2), 128)::BIGINT AS d FROM px a LEFT JOIN px b ON a.id = b.id AND NOT b.one GROUP BY a.id, a.i), g AS (SELECT id, max(d) AS deepest, list(i ORDER BY i) FILTER (d > 1.44) AS inside, arg_max(i, d * 100 - i) AS top FROM d GROUP BY id), p AS (SELECT id, deepest, CASE WHEN len(inside) > 0 THEN inside[(('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % len(inside) + 1)::INT] ELSE top END AS i FROM g) SELECT id, deepest, (i // 8)::INT AS y, (i % 8)::INT AS x FROM p",
    "JN13_near_images": f"WITH {_IMAGES} SELECT a, b, hamming, round(histogram_l1, 6) AS histogram_l1, round(edge_mae, 6) AS edge_mae, round(mask_mae, 6) AS mask_mae FROM pr WHERE hamming <= 4 AND histogram_l1 <= 0.08 AND edge_mae <= 0.025 AND mask_mae <= 0.01",
    "GE23_average_precision": f"{_AP} SELECT category, area, threshold, truths, round(ap, 9) AS ap, round(recall_1, 9) AS recall_1, round(recall_3, 9) AS recall_3, round(recall_5, 9) AS recall_5 FROM res",
    "GE23_summary": f"{_AP} SELECT metric, round(coalesce(value, -1), 9) AS value FROM (SELECT unnest([{{'metric': 'AP', 'value': avg(ap) FILTER (area = 'all')}}, {{'metric': 'AP50', 'value': avg(ap) FILTER (area = 'all' AND threshold = 0.5)}}, {{'metric': 'AP75', 'value': avg(ap) FILTER (area = 'all' AND threshold = 0.75)}}, {{'metric': 'AP_small', 'value': avg(ap) FILTER (area = 'small')}}, {{'metric': 'AP_medium', 'value': avg(ap) FILTER (area = 'medium')}}, {{'metric': 'AP_large', 'value': avg(ap) FILTER (area = 'large')}}, {{'metric': 'AR_1', 'value': avg(recall_1) FILTER (area = 'all')}}, {{'metric': 'AR_3', 'value': avg(recall_3) FILTER (area = 'all')}}, {{'metric': 'AR_5', 'value': avg(recall_5) FILTER (area = 'all')}}, {{'metric': 'AR_small', 'value': avg(recall_5) FILTER (area = 'small')}}, {{'metric': 'AR_medium', 'value': avg(recall_5) FILTER (area = 'medium')}}, {{'metric': 'AR_large', 'value': avg(recall_5) FILTER (area = 'large')}}], recursive := true) FROM res)",
    "GE23_bleu": f"WITH {_CAPTIONS}, cl AS (SELECT id, n, g, max(k) FILTER (side = 0) AS h, coalesce(max(k) FILTER (side > 0), 0) AS r FROM gr GROUP BY ALL), rt AS (SELECT n, sum(least(h, r)) FILTER (h IS NOT NULL) AS ok FROM cl GROUP BY n), le AS (SELECT sum(len(hyp)) AS t, sum(list_min(list_transform(refs, lambda r: {{'d': abs(len(r) - len(hyp)), 'l': len(r)}})).l) AS r FROM c), gu AS (SELECT n, sum(greatest(len(hyp) - n + 1, 0)) AS gs FROM c, range(1, 5) AS a(n) GROUP BY n), pr AS (SELECT n, exp(sum(ln((ok + 1e-15) / (gs + 1e-9))) OVER (ORDER BY n) / n) AS p FROM rt JOIN gu USING (n)) SELECT n::INT AS n, round(p * CASE WHEN t < r THEN exp(1 - (r + 1e-9) / (t + 1e-15)) ELSE 1 END, 9) AS bleu FROM pr, le",
    "GE23_rouge_l": f"WITH {_CAPTIONS}, ls AS (SELECT id, len(hyp) AS h, len(refs[i]) AS r, list_reduce(hyp, lambda p, x: list_reduce(range(1, len(refs[i]) + 1), lambda q, j: list_append(q, CASE WHEN refs[i][j] = x THEN p[j] + 1 ELSE greatest(p[j + 1], q[-1]) END), [0::BIGINT]), list_transform(range(0, len(refs[i]) + 1), lambda j: 0::BIGINT))[-1] AS l FROM c, range(1, 3) AS q(i) WHERE i <= len(refs)), b AS (SELECT id, max(CASE WHEN h > 0 THEN l / h ELSE 0 END) AS p, max(l / r) AS r FROM ls GROUP BY id) SELECT id, round(CASE WHEN p > 0 AND r > 0 THEN 2.44 * p * r / (r + 1.44 * p) ELSE 0 END, 9) AS rouge_l FROM b",
    "GE23_cider": f"WITH {_CAPTIONS}, fr AS (SELECT n, g, count(DISTINCT id) AS f FROM gr WHERE side > 0 GROUP BY ALL), w AS (SELECT gr.*, k * (ln((SELECT count(*) FROM c)::DOUBLE) - ln(greatest(coalesce(f, 0), 1)::DOUBLE)) AS x FROM gr LEFT JOIN fr USING (n, g)), nm AS (SELECT id, side, n, sqrt(sum(x * x)) AS m FROM w GROUP BY ALL), dt AS (SELECT r.id, r.side, r.n, sum(least(h.x, r.x) * r.x) AS d FROM w r JOIN w h ON r.side > 0 AND h.side = 0 AND r.id = h.id AND r.n = h.n AND r.g = h.g GROUP BY ALL), cs AS (SELECT d.id, d.side, sum(CASE WHEN a.m > 0 AND b.m > 0 THEN d / (a.m * b.m) ELSE d END) / 4 AS s FROM dt d JOIN nm a ON a.id = d.id AND a.side = d.side AND a.n = d.n JOIN nm b ON b.id = d.id AND b.side = 0 AND b.n = d.n GROUP BY ALL) SELECT sd.id, round(10 * avg(coalesce(s, 0) * exp(-power(greatest(len(c.hyp) - 1, 0) - greatest(len(sd.w) - 1, 0), 2) / 72)), 6) AS cider FROM sd JOIN c ON c.id = sd.id LEFT JOIN cs ON cs.id = sd.id AND cs.side = sd.side WHERE sd.side > 0 GROUP BY sd.id",
    "VA12_distances": "WITH d AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS a, count(*) OVER () AS n FROM embeddings), p AS (SELECT d.*, ('0x' || substr(md5(a || '-' || k || '-7'), 1, 8))::BIGINT % n AS o FROM d, range(1, 4) AS q(k)), j AS (SELECT CASE WHEN p.label = e.label THEN 'within' ELSE 'across' END AS kind, sqrt(list_sum(list_transform(list_zip(p.embedding, e.embedding), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE))) AS g FROM p JOIN d e ON p.o = e.a WHERE p.a <> p.o) SELECT kind, count(*) AS n, round(avg(g), 6) AS mean, round(median(g), 6) AS median FROM j GROUP BY kind",
    "AG26_router_accuracy": "SELECT split, round((sum(CASE split WHEN 'en' THEN CASE WHEN hit::VARCHAR = l2 THEN 1 ELSE 0 END WHEN 'de' THEN CASE WHEN hit::VARCHAR = l2 THEN 1 ELSE 0 END ELSE 1 - hit END) + 1e-9) / (count(*) + 1e-9), 8) AS acc FROM fx_eval GROUP BY split",
    "AG32_meters": "SELECT chart_type, round(sum(inter_px) / (sum(union_px) + 1e-10), 9) AS ciou, round(avg(CASE WHEN union_px = 0 THEN 1 ELSE inter_px / (union_px + 1e-5) END), 6) AS giou FROM fx_iou GROUP BY chart_type",
    "AG33_no_target": "WITH d AS (SELECT CASE WHEN sample_id % 10 = 0 THEN 0 ELSE pred_px END AS p, CASE WHEN sample_id % 5 = 0 THEN 0 ELSE gt_px END AS g, CASE WHEN sample_id % 5 = 0 THEN 0 ELSE least(inter_px, pred_px) END AS i FROM fx_attempt) SELECT round(avg(CASE WHEN p = 0 THEN 1.0 ELSE 0 END) FILTER (g = 0), 6) AS n_acc, round(avg(CASE WHEN p > 0 THEN 1.0 ELSE 0 END) FILTER (g > 0), 6) AS t_acc, round(avg(CASE WHEN g > 0 THEN i / (p + g - i + 1e-8) WHEN p = 0 THEN 1 ELSE 0 END), 6) AS giou, round(sum(i) / sum(p + g - i), 6) AS ciou FROM d",
    "AG38_data_metrics": "SELECT source, round(min(reward), 6) AS lo, round(max(reward), 6) AS hi, round(avg(reward), 6) AS mean, round(1 - var_samp(-0.5 * (sample_id % 7)) / (var_samp(reward - 0.5 * (sample_id % 7)) + 1e-5), 6) AS explained FROM fx_rollout GROUP BY source",
    "AG39_throughput": f"WITH d AS (SELECT role, length(text) / 50.0 AS s, CASE WHEN text IS NULL THEN NULL ELSE {_WORDS} END AS n FROM conversations) SELECT role, round(sum(s), 6) AS seconds, sum(n)::BIGINT AS tokens, round(1000 * sum(s) / sum(n), 6) AS ms_per_token, round(sum(n) / (sum(s) * 8), 6) AS tokens_per_second FROM d GROUP BY role",
    "AG40_masked_mean": "WITH d AS (SELECT uid, reward AS x FROM fx_rollout WHERE source = 'click'), s AS (SELECT uid, count(*) AS n, sum(x) / (count(*) + 1e-8) AS mean, sum(x * x) / (count(*) + 1e-8) AS q FROM d GROUP BY uid) SELECT u.uid, coalesce(s.n, 0)::BIGINT AS n, round(coalesce(s.mean, 0), 4) AS mean, round(coalesce((q - mean * mean) * CASE WHEN n > 1 THEN n / (n - 1) ELSE 1 END, 0), 4) AS var FROM (SELECT DISTINCT uid FROM fx_rollout) u LEFT JOIN s ON u.uid = s.uid",
    "AG41_average_loss": "WITH s AS (SELECT uid, coalesce(sum(reward) FILTER (sample_id % 3 <> 0), 0) AS t, count(*) FILTER (sample_id % 3 <> 0) AS n FROM fx_rollout GROUP BY uid) SELECT round(sum(t) / (sum(n) + 1e-8), 6) AS token_mode, round(avg(t / (n + 1e-8)), 6) AS seq_mode FROM s",
    "AG47_transitions": "WITH p AS (SELECT a.sample_id, b.variant, a.inter_px AS i1, b.inter_px AS i2 FROM fx_pair a JOIN fx_pair b ON a.sample_id = b.sample_id AND a.variant = 1 AND b.variant BETWEEN 2 AND 7) SELECT variant::INT AS variant, count(*) FILTER (i1 = 0 AND i2 > 0) AS gained, count(*) FILTER (i1 > 0 AND i2 = 0) AS lost, sum(i2 - i1)::BIGINT AS delta FROM p GROUP BY variant",
    "AG49_improved": "WITH g AS (SELECT chart_type || '/' || ref_type AS name, round(round(avg(iou) FILTER (variant = 2), 9) - round(avg(iou) FILTER (variant = 1), 9), 9) AS d FROM fx_pair GROUP BY chart_type, ref_type) SELECT count(*) FILTER (d > 0) AS improved, count(*) FILTER (d < 0) AS declined, count(*) FILTER (d = 0) AS tied, round(max(d), 6) AS max_gain, (SELECT name FROM g ORDER BY d DESC, name LIMIT 1) AS best, round(min(d), 6) AS max_loss, (SELECT name FROM g ORDER BY d, name LIMIT 1) AS worst FROM g",
    "AG51_reward_scatter": "SELECT idx, repeat('0.0,', (idx % 6)::INT) || printf('%.1f', idx % 10 / 10) AS reward FROM fx_option",
    "WN04_gae": f"{_STEPS}, g AS (SELECT uid, k, id, CASE WHEN mask = 1 THEN v ELSE 0.0 END AS nv, CASE WHEN mask = 1 THEN rw - v ELSE 0.0 END AS a FROM m WHERE k = 1 UNION ALL SELECT m.uid, m.k, m.id, CASE WHEN mask = 1 THEN m.v ELSE g.nv END, CASE WHEN mask = 1 THEN m.rw + 0.9 * g.nv - m.v + 0.9 * 0.8 * g.a ELSE g.a END FROM g JOIN m ON m.uid = g.uid AND m.k = g.k + 1) SELECT uid, id AS sample_id, round(a, 6) AS v FROM g",
    "WN05_reinforce": f"{_STEPS}, g AS (SELECT uid, k, id, rw AS ret, mask FROM m WHERE k = 1 UNION ALL SELECT m.uid, m.k, m.id, m.rw + 0.77 * g.ret * g.mask, m.mask FROM g JOIN m ON m.uid = g.uid AND m.k = g.k + 1) SELECT uid, id AS sample_id, round(ret, 6) AS v FROM g",
    "WN11_turn_pairs": "WITH g AS (SELECT *, (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'assistant' AND b.turn < a.turn) AS grp FROM conversations a) SELECT conv_id, grp, string_agg(CASE WHEN role <> 'assistant' THEN text END, chr(10) ORDER BY turn) AS input, max(CASE WHEN role = 'assistant' THEN text END) AS output FROM g GROUP BY conv_id, grp HAVING count(*) FILTER (role = 'assistant') > 0 AND count(*) FILTER (role <> 'assistant') > 0",
    "PF01_select": "SELECT s_suppkey, s_name FROM supplier",
    "PF02_pop": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "PF03_rename": "SELECT n_nationkey AS id, n_name AS label FROM nation",
    "PF04_index_select": "SELECT n_nationkey, n_name, s_suppkey AS pos FROM supplier JOIN nation ON n_nationkey = (s_suppkey * 3) % 25",
    "PF11_fold_case": 'SELECT n_nationkey AS "index", n_name AS question, n_regionkey AS opt FROM nation',
    "PF12_over_length": "WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, len(w) <= 300 AS fits, array_to_string(w[1:5], ' ') AS head, array_to_string(w[greatest(len(w) - 4, 1):], ' ') AS tail FROM d",
    "PF13_caption_size": "SELECT p_partkey FROM part WHERE len(string_split(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' on a table' ELSE '' END, ' ')) >= 3 AND p_size * 4 >= 32 AND p_size * 3 + 20 >= 32",
    "PF14_boxes": "WITH b AS (SELECT *, l_suppkey::INT % 40 - 10 AS x, l_partkey::INT % 40 - 10 AS y, floor(l_quantity)::INT % 12 AS w FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey FROM b WHERE x + w > greatest(x, 0) AND greatest(x, 0) < 24 AND least(x + w, 24) > greatest(x, 0) AND least(y + l_linenumber, 24) > greatest(y, 0) AND w >= 1 AND l_linenumber >= 1",
    "PF15_refusals": "SELECT idx FROM fx_option WHERE idx % 5 <> 0 AND idx % 7 <> 0 AND idx % 11 <> 0 AND NOT contains(prediction, 'I can''t') AND NOT contains(prediction, 'I cannot') AND NOT contains(lower(prediction), 'sorry')",
    "PF19_small_regions": "SELECT vec_id FROM embeddings WHERE least(floor(abs(embedding[1]) * 200), floor(abs(embedding[2]) * 200), floor(abs(embedding[3]) * 200), floor(abs(embedding[4]) * 200)) >= 4",
    "PF20_flatten": "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation",
    "PF21_merged": "SELECT n_nationkey, n_name AS name, 'r' || n_regionkey AS region, n_nationkey::VARCHAR AS key FROM nation",
    "PF23_subset": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_suppkey % 25 FROM supplier) ORDER BY n_nationkey LIMIT 7",
    "JN03_ref_join": "SELECT c_nationkey AS image_id, c_nationkey % 5 AS category_id, count(*) AS n_refs, count(DISTINCT o_custkey) AS n_anns, max(o_orderkey) AS last_ref, min(replace(replace(o_orderpriority, '-', ''), ' ', '')) AS first_text FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey",
    "JN08_paired_pivot": "WITH k AS (SELECT sample_id FROM fx_pair GROUP BY sample_id HAVING count(DISTINCT variant) = 7 AND max(variant) = 7) SELECT sample_id, " + ", ".join(f"max(CASE WHEN variant = {v} THEN inter_px END) AS v{v}" for v in range(1, 8)) + " FROM fx_pair JOIN k USING (sample_id) GROUP BY sample_id",
    "JN10_pointer_resolution": "SELECT a.p_partkey AS idx, CASE WHEN a.p_partkey % 3 <> 0 THEN a.p_name || repeat('#', 64) WHEN b.p_partkey IS NULL THEN a.p_size::VARCHAR WHEN b.p_partkey % 3 = 0 THEN b.p_size::VARCHAR ELSE b.p_name || repeat('#', 64) END AS image FROM part a LEFT JOIN part b ON b.p_partkey = a.p_size AND a.p_partkey % 3 = 0",
    "JN11_video_join": "WITH e AS (SELECT o_orderkey AS vid, x.exp, f.frame FROM orders, (VALUES (0), (1)) x(exp), (VALUES (1), (2), (3)) f(frame) WHERE o_orderkey % 4 = 0), a AS (SELECT l_orderkey AS vid, l_partkey % 3 AS anno, l_linenumber AS frame, max(l_partkey % 251) AS mask FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey AS vid, l_suppkey % 2 AS exp, l_linenumber AS frame, max(l_suppkey % 251) AS mask FROM lineitem GROUP BY ALL), j AS (SELECT e.vid, e.exp, e.frame, coalesce(a1.mask, 0) | coalesce(a2.mask, 0) AS t, coalesce(p.mask, 0) AS p FROM e LEFT JOIN a a1 ON a1.vid = e.vid AND a1.anno = e.exp AND a1.frame = e.frame LEFT JOIN a a2 ON a2.vid = e.vid AND a2.anno = e.exp + 1 AND a2.frame = e.frame LEFT JOIN p ON p.vid = e.vid AND p.exp = e.exp AND p.frame = e.frame) SELECT vid, exp, frame, bit_count((t & p)::BIGINT)::INT AS inter, bit_count((t | p)::BIGINT)::INT AS total FROM j",
    "JN12_near_thumbnails": "WITH d AS (SELECT vec_id, vec_id % 3 = 0 AS val, list_transform(embedding[1:6], lambda x: round_even(x * 100, 0)::DOUBLE) AS px FROM embeddings), j AS (SELECT a.vec_id AS a, b.vec_id AS b, (abs(a.px[1] - b.px[1]) + abs(a.px[2] - b.px[2]) + abs(a.px[3] - b.px[3]) + abs(a.px[4] - b.px[4]) + abs(a.px[5] - b.px[5]) + abs(a.px[6] - b.px[6])) / 6 / 255 AS d FROM d a JOIN d b ON a.vec_id < b.vec_id AND a.val <> b.val) SELECT a, b, round(d, 8) AS distance FROM j WHERE d <= 0.03",
    "JN14_cross_version": "WITH d AS (SELECT split, sample_id, md5(text) AS digest FROM fx_manifest WHERE text IS NOT NULL), a AS (SELECT digest, count(*) AS n_a, min(sample_id) AS first_a FROM d WHERE split = 'train' GROUP BY digest), b AS (SELECT digest, count(*) AS n_b, min(sample_id) AS first_b FROM d WHERE split = 'test' GROUP BY digest) SELECT * FROM a JOIN b USING (digest)",
    "JN16_pack_answers": "SELECT s_suppkey, n_name AS answer FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = s_suppkey % 6",
    "JN18_objects": "WITH d AS (SELECT l_orderkey, max(l_partkey) AS pk, list_sort(list_distinct(list(1 + l_suppkey % 9))) AS ids FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, array_to_string(list_transform(ids, lambda i: (pk * i) % 97), ',') AS masks FROM d",
    "TX01_option": f"WITH {_OPT} SELECT idx, {_LETTER} AS opt FROM op",
    "TX02_option_text": f"WITH {_OPT} SELECT idx, {_TEXT} AS opt FROM op",
    "TX03_can_infer": f"WITH {_OPT} SELECT idx, coalesce({_LETTER}, {_TEXT}) AS opt FROM op",
    "TX05_yes_no": f"WITH {_SAID}, src AS (SELECT id, lower(text) AS text FROM sd), w AS (SELECT id, string_split_regex(trim(y), '\\s+') AS w FROM ({_PLAIN})) SELECT id, CASE WHEN list_contains(w, 'yes') = list_contains(w, 'no') THEN 'Unknown' WHEN list_contains(w, 'yes') THEN 'Yes' ELSE 'No' END AS extracted FROM w",
    "TX06_punctuation": f"WITH {_SAID}, src AS (SELECT * FROM sd) SELECT id, y AS text FROM ({_PLAIN})",
    "TX07_digits_articles": f"WITH {_SAID}, src AS (SELECT id, text AS y FROM sd) {_articles('src')}",
    "TX08_answer_text": f"WITH {_SAID}, src AS (SELECT id, trim(replace(replace(text, chr(10), ' '), chr(9), ' ')) AS text FROM sd) {_articles(_PLAIN)}",
    "TX09_agreement": "WITH g AS (SELECT p_partkey AS id, CASE WHEN (p_partkey * i) % 7 < 3 THEN 1 ELSE 0 END AS ok FROM part, generate_series(1, 10) t(i)), n AS (SELECT id, sum(ok) AS n FROM g GROUP BY id) SELECT id, round(avg(least(1.0, (n - ok) / 3)), 9) AS score FROM g JOIN n USING (id) GROUP BY id",
    "TX10_exact": "SELECT idx, CASE WHEN lower(trim(b)) = lower(trim(prediction)) OR lower(trim(a)) = lower(trim(prediction)) THEN 1 ELSE 0 END AS exact FROM fx_option",
    "TX11_relaxed": "WITH k AS (SELECT o_orderkey AS k FROM orders) SELECT k AS idx, CASE k % 9 WHEN 0 THEN k % 2 = 0 WHEN 1 THEN k % 2 = 0 WHEN 2 THEN k % 2 = 0 ELSE CASE WHEN k % 1000 = 0 THEN true ELSE abs(k % 5 - 2) * 20 <= 20 END END AS ok FROM k",
    "TX13_anls": "WITH p AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey), s AS (SELECT *, 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) AS v, 1 - levenshtein(lower(x) || ' ' || lower(x), lower(y) || ' ' || lower(y))::DOUBLE / greatest(2 * length(x) + 2, 2 * length(y) + 1) AS w FROM p) SELECT a, b, round(CASE WHEN v <= 0.5 THEN 0 ELSE v END, 9) AS anls, round(CASE WHEN w < 0.5 THEN 0 ELSE w END, 9) AS collapsed FROM s",
    "TX15_clean_string": "SELECT p_partkey, lower(trim(p_name)) || CASE WHEN p_partkey % 5 = 0 OR p_partkey % 3 <> 1 OR p_partkey % 3 = 1 THEN '' END AS clean FROM part",
    "TX16_exact_patterns": "SELECT p_partkey, p_partkey % 14 NOT IN (9, 11, 12, 13) AS exact FROM part",
    "TX17_float_equal": "WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE AS rf, (l_partkey % 50)::DOUBLE AS p FROM lineitem), x AS (SELECT *, unnest([rf / 100, rf, rf * 100]) AS i FROM v) SELECT l_orderkey, l_linenumber, l_partkey, bool_or(abs(p - i) <= 0.01 * greatest(abs(p), abs(i)) OR round_even(p * 100, 0) = round_even(i * 100, 0)) AS same FROM x GROUP BY l_orderkey, l_linenumber, l_partkey, rf, p",
    "TX18_typed_score": "SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1 - 1.0 / (length(p_brand) + 1) ELSE CASE WHEN p_partkey % 8 = 3 THEN 1.0 ELSE 0.0 END END::DOUBLE, 9) AS score FROM part",
    "TX19_first_token": "WITH d AS (SELECT p_partkey AS k, substr('abcd', (p_partkey % 4 + 1)::INT, 1) AS g, substr('abc', (p_partkey % 3 + 1)::INT, 1) AS p, ['two', 'three', 'seven'][(p_partkey % 3 + 1)::INT] AS n FROM part) SELECT k AS p_partkey, g = p AS ok, g = p OR ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'][(k % 10 + 1)::INT] = n AS advanced FROM d",
    "TX20_verdict": "SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN NULL WHEN 0 THEN (p_partkey % 2)::INT WHEN 1 THEN (1 - p_partkey % 2)::INT ELSE 0 END AS verdict, p_partkey % 2 = 0 AS denotes, CASE p_partkey % 6 WHEN 0 THEN p_partkey % 3 = 0 WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN p_partkey % 3 = 1 ELSE p_partkey % 3 = 2 END AS amount FROM part",
    "TX21_normalized": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'cafe ' || lower(p_name) WHEN 1 THEN 'zurich' WHEN 2 THEN 'łodz - ' || lower(p_name) ELSE 'l''ete ' || lower(p_name) END AS text FROM part",
    "TX22_value_kind": "SELECT p_partkey, ['number', 'date', 'string', 'number', 'date'][(p_partkey % 5 + 1)::INT] AS kind, p_partkey % 5 <> 4 AS same FROM part",
    "TX23_unescape": "SELECT p_partkey, p_brand || '|' || p_type || chr(10) || ';x' || chr(92) AS cell FROM part",
    "TX25_math_equal": "SELECT p_partkey, coalesce([0.5, 0.75, 2.5, -1.5, NULL][(p_partkey % 5 + 1)::INT] = [0.5, 0.75, 2.5, -1.5, NULL, 0.7][(p_partkey % 6 + 1)::INT], false) OR p_partkey % 30 = 4 AS same FROM part",
    "TX26_think_answer": f"WITH {_TAG} SELECT id, CASE id % 3 WHEN 0 THEN '[SEG] ' || p_name WHEN 1 THEN p_name ELSE 'hm [SEG]' END AS think, ans AS answer, CASE WHEN id % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS ok FROM tg",
    "TX27_seg_partition": f"WITH {_TAG} SELECT id, CASE id % 3 WHEN 0 THEN '0,2' WHEN 1 THEN '0,1' ELSE '0,1,2' END AS reasoning, CASE id % 3 WHEN 0 THEN '1' ELSE '' END AS answer FROM tg",
    "TX28_mask_tokens": f"WITH {_TAG}, x AS (SELECT *, replace(replace(s, '<|mt_0000|>', ''), '<|mt_0002|>', '') AS b FROM tg), y AS (SELECT *, regexp_replace(regexp_replace(b, '(<\\|mt_start\\|>)(<\\|mt_[0-9]+\\|>)(<\\|mt_end\\|>)', '\\1\\2<|mt_9999|>\\3', 'g'), '$', '') AS r FROM x) SELECT id, array_to_string(list_transform(regexp_extract_all(s, 'mt_([0-9]{{4}})', 1), lambda v: v::INT), ' ') AS tokens, array_to_string(list_transform(regexp_extract_all(s, 'mt_([0-9]{{4}})', 1), lambda v: v::INT), ' ') AS pairs, r AS repaired FROM y",
    "TX29_token_grade": "WITH d AS (SELECT p_partkey AS id, p_partkey % 5 = 0 AS odd, p_partkey % 3 = p_partkey % 2 AS one, p_partkey % 4 = p_partkey % 6 AS two FROM part) SELECT id, CASE WHEN odd THEN 0.8 WHEN one AND two THEN 1.0 WHEN one THEN 0.4 ELSE 0.0 END::DOUBLE AS grade FROM d",
    "TX35_boxes": "SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber || ',2,' || least(l_partkey % 20, 16) || ',9' AS box FROM lineitem WHERE least(l_partkey % 20, 16) > l_linenumber",
    "TX36_box_format": "WITH d AS (SELECT p_partkey, ['yxyx_norm1000', 'xyxy_norm1000', 'xyxy_norm1000', 'yxyx_norm1000'][(p_partkey % 4 + 1)::INT] AS format, p_size AS a, p_partkey % 400 AS b, 900 AS c, 400 + p_partkey % 500 AS d FROM part), x AS (SELECT p_partkey, format, CASE WHEN format[1] = 'y' THEN [b, a, d, c] ELSE [a, b, c, d] END AS v FROM d), y AS (SELECT p_partkey, format, list_transform(v, lambda q, i: round_even(q / 1000 * CASE WHEN i % 2 = 1 THEN 64 ELSE 48 END, 0)::INT) AS p FROM x) SELECT p_partkey, format, CASE WHEN least(p[3], 64) > least(p[1], 63) AND least(p[4], 48) > least(p[2], 47) THEN least(p[1], 63) || ',' || least(p[2], 47) || ',' || least(p[3], 64) || ',' || least(p[4], 48) END AS box FROM y",
    "TX37_tagged_caption": "SELECT p_partkey, '<p> ' || p_name[1:1] || ' </p> [SEG]' || p_name[2:2] || '<p> ' || p_name[3:6] || ' </p> [SEG]' || p_name[7:] AS tagged FROM part",
    "TX40_one_object": "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_size::VARCHAR END AS score FROM part",
    "TX41_cjk": "SELECT p_partkey, p_partkey % 3 = 0 AS cjk FROM part",
    "TX42_split_length": "SELECT p_partkey, len(string_split(p_type, ' '))::INT AS n, p_size::VARCHAR AS rate, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ';' || p_type ELSE p_type END AS items FROM part",
    "TX44_content_list": "WITH s AS (SELECT p_partkey AS id, string_split(replace(p_name, 'a', '<image>') || CASE WHEN p_partkey % 2 = 0 THEN '<image>' ELSE '' END, '<image>') AS x FROM part), e AS (SELECT id, unnest(x) AS t, unnest(range(len(x))) AS i FROM s), k AS (SELECT id, 2 * i AS o, 'image' AS kind, NULL AS text FROM e WHERE i > 0 UNION ALL SELECT id, 2 * i + 1, 'text', t FROM e WHERE t <> '') SELECT id, (row_number() OVER (PARTITION BY id ORDER BY o) - 1)::INT AS pos, kind, text FROM k",
    "TX45_judge_score": "SELECT idx, CASE WHEN c IS NULL THEN -1.0::DOUBLE ELSE c::DOUBLE END AS first, CASE WHEN c IS NULL THEN -1.0 ELSE (idx % 10)::DOUBLE END AS second FROM fx_option",
    "TX47_containment": "SELECT idx, CASE WHEN idx % 2 = 0 THEN contains(replace(prediction, ' ', '') || CASE WHEN idx % 4 = 0 THEN replace(a, ' ', '') ELSE '' END, replace(a, ' ', '')) OR contains(replace(prediction, ' ', ''), replace(b, ' ', '')) ELSE contains(lower(prediction), lower(a)) OR contains(lower(prediction), lower(b)) END AS hit FROM fx_option",
    "TX48_by_letters": "SELECT p_partkey, p_partkey % 5 = 0 OR 2 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END >= 3 AS abc FROM part",
    "TX49_renumbered": "WITH d AS (SELECT p_partkey AS id, p_size AS a, p_partkey % 12 AS b FROM part), n AS (SELECT *, CASE WHEN b = a THEN 1 ELSE 2 END AS nb, CASE WHEN a = 1 THEN 1 WHEN b = 1 THEN CASE WHEN b = a THEN 1 ELSE 2 END WHEN a = b THEN 2 ELSE 3 END AS nc FROM d) SELECT id, '<obj1> a <obj' || nb || '> b <obj1> <obj' || nc || '>' AS text FROM n",
    "TX50_interleaved": "SELECT p_partkey AS id, 'image:' || p_brand || '|text:' || p_name || '|image:' || p_name || '|text:x' AS parts, 'text:see |image:' || coalesce([p_brand, p_name, NULL][(p_partkey % 3 + 1)::INT], 'none') || '|text: and|image:' || p_brand || '|text:' AS numbered FROM part",
    "GE01_decoded": "WITH d AS (SELECT p_partkey, (p_partkey % 9)::INT AS a, (p_size % 7)::INT AS b FROM part), f AS (SELECT p_partkey, repeat('0', a) || repeat('1', b) || '00' || repeat('1', 28 - a - b) AS s FROM d) SELECT p_partkey, array_to_string([s[(i % 6) * 5 + (i // 6) + 1] FOR i IN range(30)], '') AS mask FROM f",
    "GE02_run_lengths": f"WITH {_MASK}, f AS (SELECT id, [m[(i % 8) * 8 + i // 8 + 1] FOR i IN range(64)] AS f FROM m), e AS (SELECT id, list_filter(range(64), lambda i: i > 0 AND f[i + 1] <> f[i]) AS e, f[1] AS first FROM f), g AS (SELECT id, CASE WHEN first = 1 THEN [0, 0] ELSE [0] END || e || [64] AS g FROM e) SELECT id, array_to_string([g[k + 1] - g[k] FOR k IN range(1, len(g))], ',') AS runs FROM g",
    "GE03_union": f"WITH {_MASK}, x AS (SELECT label, unnest(m) AS v, unnest(range(64)) AS i FROM m) SELECT label, count(DISTINCT i) FILTER (v = 1) AS union_px FROM x GROUP BY label",
    "GE04_iou": f'WITH {_PX}, u AS (SELECT id, inter, pred + gt - inter AS t FROM px) SELECT id, round(CASE WHEN t = 0 THEN 1 ELSE inter / t END, 9) AS one, round(CASE WHEN t = 0 THEN 0 ELSE inter / t END, 9) AS zero, round(CASE WHEN t > 0 THEN inter / t END, 9) AS "null", round(CASE WHEN t = 0 THEN 1 ELSE inter / (t + 1e-5) END, 9) AS smoothed FROM u',
    "GE05_dice": f"WITH {_PX} SELECT id, round(CASE WHEN pred + gt = 0 THEN 1 ELSE 2 * inter / (pred + gt) END, 9) AS d FROM px",
    "GE06_pixel_counts": f"WITH {_PX} SELECT id, pred::BIGINT AS pred, gt::BIGINT AS gt, inter::BIGINT AS inter, (pred + gt - inter)::BIGINT AS total FROM px",
    "GE07_class_areas": f"WITH {_MASK}, l AS (SELECT unnest(m) AS a, unnest(o) AS b, unnest(range(64)) AS i FROM pr), q AS (SELECT CASE WHEN a = 1 THEN i % 3 WHEN i % 70 = 0 THEN 255 ELSE 3 END AS o, CASE WHEN b = 1 THEN i % 3 WHEN i % 9 = 0 THEN 255 ELSE 3 END AS t FROM l), k AS (SELECT * FROM q WHERE t <> 255) SELECT c.c::INT AS class, (SELECT count(*) FROM k WHERE o = c AND t = c) AS inter, (SELECT count(*) FROM k WHERE o = c OR t = c) AS total, (SELECT count(*) FROM k WHERE t = c) AS target FROM range(5) c(c)",
    "GE08_box_iou": "WITH b AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey, l_suppkey % 20 AS x, l_partkey % 20 AS y, 5 + floor(l_quantity)::INT % 10 AS w FROM lineitem), i AS (SELECT *, greatest(0, least(x + w, 18) - greatest(x, 4)) * greatest(0, least(y + 5, 18) - greatest(y, 4)) AS i FROM b) SELECT o, n, l_partkey, round(i / (w * 5 + 196 - i), 9) AS xyxy, round(i / (w * 5 + 196 - i), 9) AS xywh FROM i",
    "GE09_box": f"WITH {_MASK}, x AS (SELECT id, unnest(m) AS v, unnest(range(64)) AS i FROM m) SELECT id, min(i % 8)::INT AS x0, min(i // 8)::INT AS y0, max(i % 8)::INT AS x1, max(i // 8)::INT AS y1 FROM x WHERE v = 1 GROUP BY id",
    "GE11_accuracy": f"WITH {_PX} SELECT id, round(CASE WHEN gt = 0 AND pred = 0 THEN 1 WHEN gt = 0 THEN 0 ELSE inter / gt END, 9) AS a, round(greatest(1 - (pred - inter) / (gt + 1e-6), 0), 9) AS robustness FROM px",
    "GE12_overlaps": f"WITH {_SETS}, q AS (SELECT id, {_IOU3} AS x FROM st), e AS (SELECT id, unnest(x) AS row, unnest(range(len(x)))::INT AS i FROM q), f AS (SELECT id, i, unnest(row) AS iou, unnest(range(len(row)))::INT AS j FROM e) SELECT id, i, j, round(iou, 9) AS iou FROM f",
    "GE17_resized": f"WITH {_MASK}, r AS (SELECT id, [m[((i // 12) * 8 // 4) * 8 + ((i % 12) * 8 // 12) + 1] FOR i IN range(48)] AS r FROM m) SELECT id, array_to_string(r, '') AS mask, list_sum(r)::BIGINT AS px FROM r",
    "GE18_binary": f"WITH {_MASK} SELECT id, id % 3 <> 1 AS ok FROM m",
    "GE19_first_mask": f"WITH {_MASK} SELECT id, CASE WHEN id % 5 > 0 THEN list_sum(m)::BIGINT END AS px FROM m",
    "GE20_taxonomy": "WITH d AS (SELECT CASE WHEN pred_px = 0 THEN 'empty' WHEN inter_px = 0 OR sample_id % 7 > inter_px THEN 'wrong' WHEN (pred_px - inter_px) * 2 > gt_px THEN 'over' WHEN (gt_px - inter_px) * 2 > gt_px THEN 'under' WHEN iou > 0.8 THEN 'boundary' ELSE 'partial' END AS failure FROM fx_iou) SELECT failure, count(*) AS n FROM d GROUP BY failure",
    "GE21_edited": f"WITH {_MASK}, x AS (SELECT id, unnest(m) AS v, unnest(range(64)) % 10 / 10 AS g FROM m) SELECT id, round(sum(CASE WHEN v = 1 THEN g ELSE g * 0.5 END), 6) AS highlight, round(sum(CASE WHEN v = 1 THEN 0.5 ELSE g END), 6) AS recolor, round(sum(g * v), 6) AS extract, round(sum(g * (1 - v)), 6) AS remove FROM x GROUP BY id",
    "GE22_transforms": f"WITH {_MASK} SELECT id, array_to_string(m[11:13] || m[19:21], '') AS crop, array_to_string(list_reverse(m[1:8]), '') AS flip FROM m",
    "GE25_filled": f"WITH {_MASK}, x AS (SELECT id, unnest(m) AS v, unnest(range(64)) AS i FROM m), b AS (SELECT id, (max(i % 8) - min(i % 8) + 1) * (max(i // 8) - min(i // 8) + 1) AS px FROM x WHERE v = 1 AND i % 8 > 1 AND i < 40 GROUP BY id) SELECT m.id, coalesce(px, 0)::BIGINT AS px FROM m LEFT JOIN b USING (id)",
    "GE27_panoptic_remap": "SELECT s_suppkey AS segment, CASE WHEN s_nationkey < 9 THEN 'thing' ELSE 'stuff' END AS kind, s_nationkey::INT AS place, n_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 2 = 0",
    "ST05_constrained_pick": "SELECT chart_type, ref_type, variant, min(sample_id) FILTER (pred_px % 10 >= nth) AS pick FROM fx_attempt JOIN (VALUES ('A', 'F', 1, 3), ('N', 'O', 2, 5), ('R', 'F', 3, 2), ('R', 'X', 1, 1)) w(chart_type, ref_type, variant, nth) USING (chart_type, ref_type, variant) GROUP BY chart_type, ref_type, variant",
    "ST07_phrase_order": "WITH e AS (SELECT p_partkey, unnest([p_partkey % 7, p_partkey % 5, p_partkey % 3]) AS s, unnest([p_brand, p_name, p_type]) AS t FROM part) SELECT p_partkey, string_agg(t, '|' ORDER BY s, t) AS phrases FROM e GROUP BY p_partkey",
    "SE05_folded": "SELECT (n_nationkey // 5)::INT AS row, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS ids FROM nation GROUP BY n_nationkey // 5",
    "SE06_collate": "SELECT n_regionkey, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS ids, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
    "SE11_circular": """WITH q AS (SELECT idx, a, CASE WHEN idx % 5 = 0 THEN 'All of the above' ELSE b END AS b, CASE WHEN idx % 7 = 0 THEN 'None of these; all of above' ELSE c END AS c, d, answer FROM fx_option),
      o AS (SELECT *, list_filter([a, b, c, d], lambda x: x IS NOT NULL) AS o FROM q), n AS (SELECT *, len(o) AS n, len(o) > 2 AND regexp_matches(lower(o[-1]), '(all|none|both|neither|any) of|(^| )(above|other)( |\\.|$)|not given') AS fixed FROM o), k AS (SELECT *, CASE WHEN fixed THEN n - 1 ELSE n END AS k FROM n), t AS (SELECT *, unnest(range(k)) AS turn FROM k),
      p AS (SELECT *, position(answer IN 'ABCD') - 1 AS pl, [CASE WHEN i < k THEN [a, b, c, d][(i + turn) % k + 1] WHEN i < n THEN [a, b, c, d][i + 1] END FOR i IN range(4)] AS r FROM t)
      SELECT idx + turn * 1000000 AS idx, idx AS base, r[1] AS opt_a, r[2] AS opt_b, r[3] AS opt_c, r[4] AS opt_d, substr('ABCD', (CASE WHEN pl < k THEN (pl - turn + 4 * k) % k ELSE pl END + 1)::INT, 1) AS answer FROM p""",
    "SE13_distinct_boxes": "SELECT l_orderkey, count(DISTINCT (l_linenumber, l_partkey % 3))::INT AS n FROM lineitem GROUP BY l_orderkey",
    "VA01_violations": "WITH d AS (SELECT p_partkey, p_partkey % 5 AS maker, p_size - 3 AS size FROM part) SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 6 = 0 THEN 'name: missing' END, CASE WHEN maker > 2 THEN 'maker: unknown value' END, CASE WHEN p_partkey % 9 = 0 THEN 'code: malformed' END, CASE WHEN size < 0 THEN 'size: negative' END, CASE WHEN p_partkey % 4 = 0 THEN 'path: unsafe path' END], lambda x: x IS NOT NULL), '; ') AS violations FROM d",
    "VA02_uniqueness": "SELECT 'text' AS field, md5(text) AS value, count(*) AS n FROM fx_manifest WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1 UNION ALL SELECT 'sample_id', sample_id::VARCHAR, count(*) FROM fx_manifest WHERE text IS NOT NULL GROUP BY sample_id HAVING count(*) > 1",
    "VA03_expected_count": "SELECT e.split, count(m.sample_id) AS n, count(m.sample_id) = any_value(e.k) AS ok FROM (VALUES ('train', 600), ('val', 200), ('test', 200), ('none', 0)) e(split, k) LEFT JOIN fx_manifest m ON m.split = e.split GROUP BY e.split",
    "VA04_duplicate_groups": "SELECT md5(text) AS digest, min(sample_id) OVER (PARTITION BY text) AS first_id, sample_id AS member FROM fx_manifest WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY text) > 1",
    "VA08_near_pairs": "WITH d AS (SELECT vec_id, vec_id % 3 = 0 AS val, list_transform(embedding[1:6], lambda x: round_even(x * 100, 0)::DOUBLE) AS px FROM embeddings), j AS (SELECT a.vec_id AS a, b.vec_id AS b, (abs(a.px[1] - b.px[1]) + abs(a.px[2] - b.px[2]) + abs(a.px[3] - b.px[3]) + abs(a.px[4] - b.px[4]) + abs(a.px[5] - b.px[5]) + abs(a.px[6] - b.px[6])) / 6 / 255 AS d FROM d a JOIN d b ON a.vec_id < b.vec_id AND a.val <> b.val), k AS (SELECT a, b, round(d, 8) AS distance FROM j WHERE d <= 0.03), n AS (SELECT count(*) AS n FROM k) SELECT a, b, distance, n AS n_pairs, n > 20 AS truncated FROM k, n ORDER BY distance, a, b LIMIT 20",
    "VA13_completeness": "WITH g AS (SELECT sample_id, count(*) AS n, list(DISTINCT variant) AS s FROM fx_pair GROUP BY sample_id), m AS (SELECT sample_id, n, array_to_string(list_filter([1, 2, 3], lambda v: NOT list_contains(s, v)), ',') AS missing FROM g) SELECT * FROM m WHERE missing <> '' OR n <> 3",
    "VA14_manifest_digest": "SELECT n_regionkey, sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS digest, count(*) AS n FROM nation GROUP BY n_regionkey",
    "VA16_supervised": "WITH e AS (SELECT p_partkey, (p_partkey % 3)::INT AS expected, [i FOR i IN range(12) IF (p_partkey * (i + 3)) % 5 = 2 AND (p_partkey + i) % 4 <> 0] AS ps FROM part) SELECT p_partkey, array_to_string(ps, ',') AS positions, len(ps)::INT AS n, expected FROM e WHERE len(ps) <> expected",
    "MA01_kl": "WITH d AS (SELECT sample_id, greatest(least(reward / 100 - (sample_id % 13) / 10, 20), -20) AS d FROM fx_rollout) SELECT sample_id, round(d, 9) AS kl, round(abs(d), 9) AS abs_kl, round(d * d / 2, 9) AS mse, round(least(greatest(exp(-d) + d - 1, -10), 10), 9) AS low_var FROM d",
    "MA02_ppo_clip": "WITH d AS (SELECT sample_id, reward / 100 AS p, exp(reward / 100 - (sample_id % 13) / 10) AS x, reward - 50 AS a FROM fx_rollout), k AS (SELECT *, CASE WHEN x < 0.8 THEN 0.8 WHEN x > 1.3 THEN 1.3 ELSE x END AS h FROM d) SELECT sample_id, round(CASE WHEN a < 0 THEN least(greatest(-a * x, -a * h), -3 * a) ELSE greatest(-a * x, -a * h) END, 6) AS loss, round(-a * h * p, 9) AS cispo FROM k",
    "MA03_value_loss": "WITH d AS (SELECT sample_id, reward AS v, 50.0 + sample_id % 7 AS o, 40.0 + uid % 3 AS t FROM fx_rollout), k AS (SELECT *, least(greatest(v, o - 5), o + 5) AS h FROM d) SELECT sample_id, round(greatest((v - t) ** 2, (h - t) ** 2) / 2, 6) AS loss FROM k",
    "MA04_kl_reward": "SELECT sample_id, round(reward - 0.05 * 1.002 * abs(reward / 100 - (sample_id % 13) / 10), 9) AS r FROM fx_rollout",
    "MA05_cosine": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1",
    "MA07_pixel_budget": "SELECT p_partkey, floor(p_size * 10 * sqrt(least(1, 50000 / (p_size * 10 * 200))))::BIGINT AS w, floor(200 * sqrt(least(1, 50000 / (p_size * 10 * 200))))::BIGINT AS h FROM part",
    "MA08_codebook": "WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 300 AS a, l_suppkey % 280 AS b, l_partkey % 256 AS c, l_partkey % 7 AS e FROM lineitem), g AS (SELECT *, CASE WHEN a < 256 THEN a || '-' || CASE WHEN b < 256 THEN b ELSE -1 END END AS one, c || '-' || e AS two FROM d) SELECT l_orderkey, l_linenumber, l_partkey, a || ',' || (256 + b) || ',' || (512 + c) || ',' || (768 + e) AS codes, concat_ws(',', one, two) AS back FROM g",
    "MA09_stable_index": "SELECT p_partkey, (('0x' || substr(sha256(p_name), 1, 8))::BIGINT % 97)::INT AS bucket FROM part",
    "MA10_hamming": f"WITH {_MASK} SELECT id, list_sum([abs(x - o[i]) FOR x, i IN m[1:62]])::INT AS distance FROM pr",
    "MA11_distances": "WITH x AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS p, unnest(b.embedding)::DOUBLE AS q FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1) SELECT vec_id, round(sum(abs(p - q)) / 3, 5) AS l1, round(avg(abs(p - q)), 5) AS mae FROM x GROUP BY vec_id",
    "MA12_colours": "WITH d AS (SELECT p_partkey, [p_partkey * 3 % 256, p_partkey * 5 % 256, p_partkey * 7 % 256] AS a, [p_partkey * 11 % 256, p_partkey * 13 % 256, p_partkey * 17 % 256] AS b FROM part) SELECT p_partkey, printf('#%02x%02x%02x', a[1], a[2], a[3]) AS a, array_to_string(a, ',') AS rgb, round(sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) / sqrt(3 * 255 ** 2), 9) AS distance FROM d",
    "MA13_frames": "SELECT p_partkey, array_to_string([((i + 1) * p_size // 9)::INT FOR i IN range(8)], ',') AS inner, array_to_string([floor((p_size - 1) / 8 / 2 + (p_size - 1) / 8 * i)::INT FOR i IN range(8)], ',') AS middle, array_to_string(list_sort(list_distinct([(i * (p_size - 1) // 7)::INT FOR i IN range(8)])), ',') AS even FROM part",
    "MA14_dates": "SELECT o_orderkey, strftime(o_orderdate, '%y%m%d') AS short, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    "MA15_digest": "SELECT doc_id, md5(coalesce(text, '')) AS digest, sha256('{\"doc_id\":' || doc_id || CASE WHEN lang IS NULL THEN '' ELSE ',\"lang\":\"' || lang || '\"' END || '}') AS canonical FROM documents",
    "PA04_restored": "WITH b AS (SELECT l_orderkey % 7 AS batch, count(DISTINCT l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_orderkey % 40 = 0 GROUP BY l_orderkey % 7) SELECT batch, n, (n * (n - 1) // 2)::BIGINT AS at_sum, n AS ids FROM b",
    "PA06_word_lengths": f"SELECT conv_id, sum({_WORDS})::BIGINT AS n_words FROM conversations GROUP BY conv_id",
    "PA07_repeats": "WITH n AS (SELECT n_nationkey AS id, row_number() OVER (ORDER BY md5('7-' || n_nationkey), n_nationkey) AS r, count(*) OVER () AS n FROM nation), s AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY md5('7-' || s_suppkey), s_suppkey) AS r, count(*) OVER () AS n FROM supplier) SELECT 'nation' AS t, id, unnest([0, 1]) AS copy FROM n UNION ALL SELECT 'nation', id, 2 FROM n WHERE r <= floor(n * 0.4 + 1e-9) UNION ALL SELECT 'supplier', id, 0 FROM s WHERE r <= floor(n * 0.3 + 1e-9)",
    "PA10_schedule": "SELECT e::INT AS epoch, s_suppkey AS id, row_number() OVER (PARTITION BY e ORDER BY md5('7-' || e || '-' || s_suppkey), s_suppkey)::INT AS pos FROM supplier, range(3) t(e)",
    "PA13_page_batches": "WITH n AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, n, greatest(ceil(n / CASE WHEN n / 5 > 20 THEN ceil(n / 20) ELSE 5 END), 1)::BIGINT AS interval_n FROM n",
    "BS01_bootstrap_estimate": f"WITH g AS (SELECT chart_type, ref_type, avg(iou) AS m FROM fx_iou GROUP BY ALL), v AS (SELECT list(m ORDER BY chart_type, ref_type) AS v, count(*) AS n, avg(m) AS e FROM g), d AS (SELECT b, e, avg(v[{_DRAW} % n + 1]) AS s FROM v, range(2000) x(b), range((SELECT n FROM v)) y(j) GROUP BY b, e) SELECT round(any_value(e), 6) AS estimate, round(quantile_cont(s, 0.025), 6) AS lower, round(quantile_cont(s, 0.975), 6) AS upper FROM d",
    "BS02_paired_bootstrap": f"WITH m AS (SELECT variant, chart_type, ref_type, avg(iou) AS m FROM fx_iou GROUP BY ALL), d AS (SELECT b.variant, b.chart_type, b.ref_type, a.m - b.m AS d FROM m a JOIN m b ON a.variant = 1 AND b.variant <> 1 AND a.chart_type = b.chart_type AND a.ref_type = b.ref_type), v AS (SELECT variant, list(d ORDER BY chart_type, ref_type) AS v, count(*) AS n, avg(d) AS e FROM d GROUP BY variant), s AS (SELECT variant, b, e, avg(v[{_DRAW} % n + 1]) AS s FROM v, range(500) x(b), range(64) y(j) WHERE j < n GROUP BY variant, b, e), q AS (SELECT variant, any_value(e) AS e, quantile_cont(s, 0.025) AS l, quantile_cont(s, 0.975) AS u FROM s GROUP BY variant) SELECT variant, round(e, 6) AS estimate, round(l, 6) AS lower, round(u, 6) AS upper, l <= 0 AND u >= 0 AS contains_zero FROM q",
    "SC02_tsv_scan": "SELECT n_nationkey, n_name, n_regionkey, 'a \"q\"' || chr(9) || n_name || chr(10) || 'b' AS note FROM nation",
    "SC03_jsonl_scan": "SELECT s_suppkey, s_name FROM supplier",
    "SC05_parquet_scan": "SELECT r_regionkey, r_name FROM region",
    "SC06_dataset": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 1",
    "SC09_mapped": "WITH u AS (SELECT 0 AS p, 'nation' AS kind, n_name AS name, n_nationkey::VARCHAR AS key FROM nation UNION ALL SELECT 1, 'region', r_name, r_regionkey::VARCHAR FROM region) SELECT kind, name, key, row_number() OVER (ORDER BY p, kind, name, key) - 1 AS index FROM u",
    "SC12_tolerant_jsonl": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 6 <> 0 AND n_nationkey % 7 <> 0",
    "SK02_sharded": "WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS s FROM orders) SELECT printf('refs-%05d', s) AS shard, count(*) AS n, min(o_orderkey) AS first FROM r GROUP BY s",
    "SK03_checkpoints": "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'FAIL' END AS out FROM nation",
    "SK04_metric_rows": "WITH s AS (SELECT chart_type, count(*)::DOUBLE AS n, avg(iou) AS mean_iou, median(iou) AS median_iou, sum(inter_px) / sum(union_px) AS micro_iou, 2 * sum(inter_px) / (sum(pred_px) + sum(gt_px)) AS micro_dice FROM fx_iou GROUP BY chart_type) SELECT chart_type, metric, round(value, 6) AS value FROM (UNPIVOT s ON n, mean_iou, median_iou, micro_iou, micro_dice INTO NAME metric VALUE value)",
    "SK05_latex": "SELECT chart_type, printf('%.1f', floor(sum(inter_px) / (sum(union_px) + 1e-10) * 1000) / 10) || ' & ' || printf('%.1f', floor(avg(inter_px / (union_px + 1e-5)) * 1000) / 10) || ' ' || chr(92) || chr(92) AS line FROM fx_iou GROUP BY chart_type",
    "SK06_submission": "SELECT '{' || string_agg('\"' || n_nationkey || '\":\"' || n_name || '\"', ',' ORDER BY n_nationkey) || '}' AS submission FROM nation",
    "SM01_incremental": "SELECT sample_id, uid FROM fx_rollout",
    "SM02_pending": "SELECT idx FROM fx_option WHERE idx % 3 = 0 OR idx % 5 = 0",
    "SM03_meters": "SELECT source, round(sum(reward), 4) AS total, count(reward) AS n, round(avg(reward), 4) AS mean FROM fx_rollout GROUP BY source",
    "SM05_resumed": "SELECT sample_id, uid FROM fx_rollout",
}

"""Derived input tables of the queries, as common table expressions that both engines read alike."""

from __future__ import annotations

FX = {
    "fx_eval": "SELECT d.doc_id AS idx, d.lang AS split, d.source AS category, cast(l.toxic AS string) AS l2, l.quality AS hit FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "fx_attempt": """SELECT l_orderkey AS sample_id, l_linenumber AS variant, l_returnflag AS chart_type, l_linestatus AS ref_type, cast(l_quantity AS int) AS pred_px, cast(1 + l_partkey % 50 AS int) AS gt_px,
  CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN cast(floor(least(cast(l_quantity AS int), cast(1 + l_partkey % 50 AS int)) / 2.0) AS int) ELSE least(cast(l_quantity AS int), cast(1 + l_partkey % 50 AS int)) END AS inter_px FROM lineitem""",
    "fx_iou": "SELECT *, pred_px + gt_px - inter_px AS union_px, cast(inter_px AS double) / (pred_px + gt_px - inter_px) AS iou, 2.0E0 * inter_px / (pred_px + gt_px) AS dice FROM fx_attempt",
    "fx_pair": "SELECT sample_id, variant, max(chart_type) AS chart_type, max(ref_type) AS ref_type, max(inter_px) AS inter_px, max(pred_px) AS pred_px, max(gt_px) AS gt_px, max(iou) AS iou FROM fx_iou GROUP BY sample_id, variant",
    "fx_rollout": "SELECT user_id AS uid, event_id AS sample_id, value AS reward, event_type AS source FROM events",
    "fx_turn": "SELECT conv_id, turn, role, text FROM conversations",
    "fx_manifest": "SELECT doc_id AS sample_id, CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'val' ELSE 'test' END AS split, source AS style_family, lang AS chart_type, n_chars, text FROM documents",
    "fx_option": """SELECT p_partkey AS idx, p_brand AS a, p_type AS b, CASE WHEN p_partkey % 4 < 2 THEN cast(p_size AS string) END AS c, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS d, substr('ABCD', cast(1 + p_partkey % 2 AS int), 1) AS answer,
  CASE p_partkey % 3 WHEN 0 THEN concat('The answer is ', substr('ABCD', cast(1 + p_partkey % 2 AS int), 1), '.') WHEN 1 THEN p_type ELSE 'Cannot determine the answer' END AS prediction FROM part""",
    "fx_ref": "SELECT o.o_orderkey AS ref_id, o.o_custkey AS ann_id, c.c_nationkey AS image_id, n.n_regionkey AS category_id, o.o_orderstatus AS split FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey",
}
NEEDS = {"fx_iou": ["fx_attempt"], "fx_pair": ["fx_iou"]}


def with_fixtures(sql: str) -> str:
    """The query after a WITH clause of the fixtures that it names."""
    wanted: list[str] = []

    def add(name: str):
        for n in NEEDS.get(name, []):
            add(n)
        if name not in wanted:
            wanted.append(name)

    for name in FX:
        if name in sql:
            add(name)
    if not wanted:
        return sql
    ctes = ",\n".join(f"{n} AS ({FX[n]})" for n in wanted)
    body = sql.lstrip()
    return f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"

"""The domain tables of ``sources.fixtures`` as DuckDB common table expressions."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "kg_pages": """SELECT o_orderkey AS page_id, o_custkey AS event_id, o_orderdate AS pub_time, o_orderstatus AS status, c_nationkey AS publisher_id,
      'Report ' || o_orderkey AS title, (o_orderkey * 13) % 400 AS word_count FROM orders JOIN customer ON o_custkey = c_custkey""",
    "kg_publishers": """SELECT n_nationkey AS publisher_id, n_name AS publisher,
      ['wire', 'newspaper', 'broadcaster', 'magazine', 'official'][n_nationkey % 5 + 1] AS source_type, round(0.5::DOUBLE + 0.01::DOUBLE * (n_nationkey % 11), 2) AS base_prior FROM nation""",
    "kg_claims": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS claim_id, l_orderkey AS page_id,
      o_custkey AS event_id, l_shipdate AS event_time, o_orderdate AS reported_time, value, round(1 - disc, 2) AS confidence, p_brand AS topic_key,
      CASE value % 4 WHEN 0 THEN value || ' people were killed near ' || p_name WHEN 1 THEN 'at least ' || value || ' people were injured by ' || p_name
        WHEN 2 THEN value || ' people are missing, officials said of ' || p_name ELSE 'alarm raised to level ' || value || ' at ' || p_name END AS text,
      'P' || l_partkey AS part_entity, 'S' || l_suppkey AS supp_entity
      FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(min(l_quantity) AS BIGINT) AS value, min(l_discount) AS disc
            FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "kg_mentions": "SELECT claim_id, event_id, page_id, unnest([part_entity, supp_entity]) AS entity_id FROM kg_claims",
    "kg_entities": """SELECT 'P' || p_partkey AS entity_id, p_name AS canonical_name, 'PRODUCT' AS entity_type,
      CASE WHEN p_partkey % 3 = 0 THEN 'Q' || p_size END AS wikidata_qid, (p_partkey * 7) % 50 AS mention_count FROM part
      UNION ALL SELECT 'S' || s_suppkey, s_name, 'ORGANIZATION', NULL, (s_suppkey * 7) % 50 FROM supplier""",
    "kg_events": """SELECT c_custkey AS event_id, c_name AS name, CAST(1000000 + c_nationkey AS BIGINT) AS parent_id, CASE WHEN c_acctbal < 0 THEN 'provisional' ELSE 'active' END AS status,
      'micro' AS scale, CASE WHEN c_custkey % 7 <> 0 THEN round(((c_custkey * 37) % 100)::DOUBLE / 100, 2) END AS coherence,
      CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS summary, make_timestamp(CAST((1704067200 + (c_custkey % 365) * 86400) * 1000000 AS BIGINT)) AS updated_at FROM customer
      UNION ALL SELECT 1000000 + n_nationkey, n_name, 2000000 + n_regionkey, 'active', 'meso', 0.5, n_name, TIMESTAMP '2024-01-01' FROM nation
      UNION ALL SELECT 2000000 + r_regionkey, r_name, NULL, 'active', 'macro', 0.5, r_name, TIMESTAMP '2024-01-01' FROM region""",
    "kg_claim_edges": """SELECT a.claim_id AS src, b.claim_id AS dst, CASE WHEN a.value = b.value THEN 'CORROBORATES'
      WHEN (b.event_time > a.event_time AND b.value > a.value) OR (a.event_time > b.event_time AND a.value > b.value) THEN 'UPDATES' ELSE 'CONTRADICTS' END AS rel, a.event_id
      FROM kg_claims a JOIN kg_claims b ON a.event_id = b.event_id AND a.topic_key = b.topic_key AND a.claim_id < b.claim_id""",
    "kg_entity_edges": """SELECT part_entity AS src, supp_entity AS dst, least(1.0::DOUBLE, round(0.52::DOUBLE + 0.1::DOUBLE * count(*), 2)) AS confidence, count(*) AS evidence_count FROM kg_claims GROUP BY ALL
      UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 0.9, 1 FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 0.9, 1 FROM nation""",
    "kg_thoughts": "SELECT event_id AS thought_id, user_id AS event_id, ts AS created_at, event_id % 2 = 0 AS acknowledged FROM events WHERE event_type = 'error'",
    "kg_comments": """SELECT conv_id || ':' || turn AS comment_id, conv_id AS event_id, turn, role AS "user", text, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent_id FROM conversations""",
    "kg_tasks": """SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status, o_orderdate AS started_at FROM orders""",
    "kg_ledger": """SELECT event_id, user_id, ts, event_type, round(CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN -1 ELSE 0 END, 2) AS delta FROM events""",
}


#: Small expressions that are computed once, since several others name them; whole tables of claims would not fit.
COSTLY = ("kg_pairs", "kg_prior", "kg_post")


def with_tables(body: str, **more: str) -> str:
    """``body`` after the expressions that it names, directly or through others; ``more`` adds its own."""
    tables = CTES | more
    need: list[str] = []

    def visit(text: str) -> None:
        for name in tables:
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(tables[name])
                if name not in need:
                    need.append(name)

    visit(body)
    if not need:
        return body
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in COSTLY else ''}({tables[n]})" for n in need) + "\n" + body

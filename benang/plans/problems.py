"""Queries of the general problems: orphan references and reply trees."""

from __future__ import annotations

from benang.operators import hierarchy, orphans
from benang.sources.tables import table as t


def queries() -> dict:
    return {
        "p2_found": lambda s, d: orphans.found(t(s, d, "threads"), t(s, d, "pilot_raw"), t(s, d, "removal_log")),
        "p2_report": lambda s, d: orphans.report(t(s, d, "threads"), t(s, d, "pilot_raw"), t(s, d, "removal_log")),
        "p2_maintained": lambda s, d: orphans.maintained(t(s, d, "threads"), t(s, d, "pilot_raw"), t(s, d, "removal_log")),
        "p6_found": lambda s, d: hierarchy.found(t(s, d, "threads")),
        "p6_paths": lambda s, d: hierarchy.paths(t(s, d, "threads")),
        "p6_descendants": lambda s, d: hierarchy.descendant_counts(hierarchy.paths(t(s, d, "threads"))),
        "p6_relations": lambda s, d: hierarchy.relations(t(s, d, "threads")),
        "p6_family_sizes": lambda s, d: hierarchy.family_sizes(t(s, d, "threads")),
    }


ID = "CASE WHEN trim({0}) <> '' AND lower(trim({0})) <> 'none' THEN trim({0}) END"

P2_REFS = f"""
WITH refs AS (
  SELECT 'threads' AS src_table, {ID.format('tweet_id')} AS tweet_id, 'root_tweet_id' AS ref_field, {ID.format('root_tweet_id')} AS missing_id, coalesce(substr(waktu_posting, 1, 7), '') AS period FROM threads
  UNION ALL SELECT 'threads', {ID.format('tweet_id')}, 'in_reply_to_tweet_id', {ID.format('in_reply_to_tweet_id')}, coalesce(substr(waktu_posting, 1, 7), '') FROM threads
  UNION ALL SELECT 'pilot_raw', {ID.format('tweet_id')}, 'root_tweet_id', {ID.format('root_tweet_id')}, '' FROM pilot_raw),
gone AS (SELECT trim(tweet_id) AS id FROM removal_log WHERE tweet_id IS NOT NULL GROUP BY 1
  HAVING max(CASE WHEN lower(trim(event_kind)) = 'removed' THEN event_at END) >= coalesce(max(CASE WHEN lower(trim(event_kind)) <> 'removed' THEN event_at END), TIMESTAMPTZ '1900-01-01 00:00:00+00')),
live AS (SELECT {ID.format('tweet_id')} AS id FROM threads WHERE {ID.format('tweet_id')} IS NOT NULL),
orphan AS (SELECT * FROM refs WHERE missing_id IS NOT NULL AND missing_id IS DISTINCT FROM tweet_id AND (missing_id NOT IN (SELECT id FROM live) OR missing_id IN (SELECT id FROM gone)))
"""

P6_TREE = f"""
WITH RECURSIVE node AS (SELECT {ID.format('tweet_id')} AS id, min({ID.format('in_reply_to_tweet_id')}) AS parent, min({ID.format('root_tweet_id')}) AS r1, max({ID.format('root_tweet_id')}) AS r2,
  min(nullif(lower(regexp_replace(hierarki_komentar, '[\\s_]+', '', 'g')), '')) AS l1, max(nullif(lower(regexp_replace(hierarki_komentar, '[\\s_]+', '', 'g')), '')) AS l2
  FROM threads GROUP BY 1 HAVING {ID.format('tweet_id')} IS NOT NULL),
down AS (SELECT id, id AS top, 0 AS depth, id AS path FROM node WHERE parent IS NULL
  UNION ALL SELECT n.id, d.top, d.depth + 1, d.path || '/' || n.id FROM node n JOIN down d ON n.parent = d.id),
up AS (SELECT id AS start, parent AS cur FROM node WHERE parent IS NOT NULL AND id NOT IN (SELECT id FROM down)
  UNION SELECT u.start, n.parent FROM up u JOIN node n ON n.id = u.cur WHERE n.parent IS NOT NULL)
"""


P6_PATHS = P6_TREE.replace("up AS (", "lost AS (SELECT id, parent AS top, 1 AS depth, parent || '/' || id AS path FROM node WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM node) UNION ALL SELECT n.id, d.top, d.depth + 1, d.path || '/' || n.id FROM node n JOIN lost d ON n.parent = d.id),\nup AS (") + """,
paths AS (SELECT id AS tweet_id, top, depth, 'top' AS ends, path FROM down UNION ALL SELECT id, top, depth, 'missing', path FROM lost
  UNION ALL SELECT id, NULL, NULL, CASE WHEN id IN (SELECT start FROM up WHERE cur = start) THEN 'cycle' ELSE 'into_cycle' END, NULL FROM node WHERE id NOT IN (SELECT id FROM down) AND id NOT IN (SELECT id FROM lost))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_paths": P6_PATHS + "SELECT tweet_id, top, depth::BIGINT AS depth, ends, path FROM paths",
        "p6_descendants": P6_PATHS + ", steps AS (SELECT tweet_id, depth, unnest(string_split(path, '/')) AS ancestor, generate_subscripts(string_split(path, '/'), 1) - 1 AS pos FROM paths WHERE path IS NOT NULL) SELECT ancestor AS tweet_id, count(*) AS n_descendants, max(depth - pos) AS height FROM steps WHERE ancestor <> tweet_id GROUP BY 1",
        "p2_found": P2_REFS + "SELECT DISTINCT src_table, tweet_id, ref_field, missing_id FROM orphan",
        "p2_maintained": P2_REFS + "SELECT DISTINCT missing_id FROM orphan",
        "p2_report": P2_REFS + "SELECT src_table, ref_field, period, count(*) AS n_refs, count(DISTINCT missing_id) AS n_missing FROM (SELECT DISTINCT * FROM orphan) GROUP BY ALL",
        "p6_found": P6_TREE + """
SELECT start AS tweet_id, 'cycle' AS fault FROM up WHERE cur = start
UNION ALL SELECT d.id, 'wrong_root' FROM down d JOIN node n USING (id) WHERE n.r1 <> d.top OR n.r2 <> d.top
UNION ALL SELECT d.id, 'wrong_level' FROM (SELECT *, CASE depth WHEN 0 THEN 'roottweet' WHEN 1 THEN 'directreply' ELSE 'nestedreply' END AS want FROM down) d JOIN node n USING (id) WHERE n.l1 <> want OR n.l2 <> want""",
    }

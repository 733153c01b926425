"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from benang.llm import abuse, consensus, leaks, mixing, pii, quota, residue, splits
from benang.sources.tables import table as t


def queries() -> dict:
    return {
        "p1_found": lambda s, d: pii.found(t(s, d, "threads")),
        "p1_redacted": lambda s, d: pii.redact(t(s, d, "threads")),
        "p3_found": lambda s, d: splits.found(t(s, d, "threads")),
        "p3_components": lambda s, d: splits.tied(t(s, d, "threads")),
        "p3_splits": lambda s, d: splits.assign(t(s, d, "threads")),
        "p3_shares": lambda s, d: splits.shares(t(s, d, "threads")),
        "p4_found": lambda s, d: abuse.found(t(s, d, "threads")),
        "p4_scores": lambda s, d: abuse.scores(t(s, d, "threads")),
        "p4_rates": lambda s, d: abuse.rates(t(s, d, "threads")),
        "p5_found": lambda s, d: quota.found(t(s, d, "coordinator_sampling"), t(s, d, "threads"), t(s, d, "sampling_plans")),
        "p5_allocation": lambda s, d: quota.allocate(quota.available(quota.candidates(t(s, d, "coordinator_sampling"), t(s, d, "threads")), t(s, d, "sampling_plans"))),
        "p5_sample": lambda s, d: quota.draw(t(s, d, "coordinator_sampling"), t(s, d, "threads"), t(s, d, "sampling_plans")),
        "p7_found": lambda s, d: consensus.found(t(s, d, "pilot_raw"), t(s, d, "annotation_marks")),
        "p7_consensus": lambda s, d: consensus.consensus(t(s, d, "pilot_raw"), t(s, d, "annotation_marks")),
        "p7_with_words": lambda s, d: consensus.with_words(t(s, d, "pilot_raw"), t(s, d, "annotation_marks")),
        "p7_reliability": lambda s, d: consensus.reliability(t(s, d, "pilot_raw"), t(s, d, "annotation_marks")),
        "p8_found": lambda s, d: leaks.found(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_spans": lambda s, d: leaks.spans(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_report": lambda s, d: leaks.report(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_found": lambda s, d: mixing.found(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_shares": lambda s, d: mixing.shares(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_mixture": lambda s, d: mixing.realise(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p10_found": lambda s, d: residue.found(t(s, d, "documents")),
        "p10_rates": lambda s, d: residue.rates(t(s, d, "documents")),
        "p10_clean": lambda s, d: residue.clean(t(s, d, "documents")),
    }


ID = "CASE WHEN trim({0}) <> '' AND lower(trim({0})) <> 'none' THEN trim({0}) END"
ROOTS = f"""
rows AS (SELECT DISTINCT {ID.format('tweet_id')} AS post, {ID.format('root_tweet_id')} AS root FROM threads),
filled AS (SELECT * FROM rows WHERE post IS NOT NULL AND root IS NOT NULL)"""

P5_AVAILABLE = f"""
WITH {ROOTS.strip()},
c AS (SELECT DISTINCT {ID.format('tweet_id')} AS post, lower(regexp_replace(sampling_stratum, '[^\\p{{L}}]', '', 'g')) AS stratum FROM coordinator_sampling),
cands AS (SELECT c.post, c.stratum, coalesce(min(f.root), c.post) AS root FROM c LEFT JOIN filled f ON f.post = c.post WHERE c.post IS NOT NULL AND c.stratum <> '' GROUP BY c.post, c.stratum),
held AS (SELECT stratum, root, count(*) AS n FROM cands GROUP BY stratum, root),
p AS (SELECT *, lower(regexp_replace(sampling_stratum, '[^\\p{{L}}]', '', 'g')) AS stratum_ FROM sampling_plans),
a AS (SELECT p.plan_name, p.sampling_stratum, any_value(p.target_share) AS target_share, any_value(p.sample_rows) AS sample_rows, any_value(p.min_rows) AS min_rows, any_value(stratum_) AS stratum, any_value(coalesce(p.max_per_root, 2147483647)) AS cap,
      coalesce(sum(least(held.n, p.max_per_root)), 0) AS available FROM p LEFT JOIN held ON held.stratum = p.stratum_ GROUP BY p.plan_name, p.sampling_stratum)
"""
P5_SPREAD = """
a{k} AS (SELECT *, (sum(room{k}) OVER w)::BIGINT AS total_, least(sum(pool{k}) OVER w, sum(room{k}) OVER w)::BIGINT AS give_ FROM l{k} WINDOW w AS (PARTITION BY {by})),
b{k} AS (SELECT *, CASE WHEN total_ > 0 THEN give_ * room{k} // total_ ELSE 0 END AS base_, CASE WHEN total_ > 0 THEN give_ * room{k} % total_ ELSE 0 END AS rem_ FROM a{k}),
c{k} AS (SELECT *, base_ + CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY rem_ DESC, idx) <= give_ - sum(base_) OVER (PARTITION BY {by}) THEN 1 ELSE 0 END AS got{k} FROM b{k})"""
#: the tree of the query: three single strata beside overlap and no signal
P5_ALLOCATION = P5_AVAILABLE.strip() + """,
l0 AS (SELECT *, row_number() OVER (PARTITION BY plan_name ORDER BY sampling_stratum) AS idx, CASE WHEN stratum IN ('mutugizisignal', 'tatakelolasignal', 'distribusisignal') THEN 'single' ELSE 'other' END AS grp, greatest(target_share * sample_rows, min_rows) AS want FROM a),
l00 AS (SELECT *, CASE WHEN want < 1 THEN ceil(want) ELSE floor(want + 0.5) END::BIGINT AS goal FROM l0),
l1 AS (SELECT *, least(goal, available)::BIGINT AS take0, goal - least(goal, available)::BIGINT AS pool1, (available - least(goal, available))::BIGINT AS room1 FROM l00),""" + P5_SPREAD.format(k=1, by="plan_name, grp") + """,
l2 AS (SELECT * EXCLUDE (total_, give_, base_, rem_), pool1 - got1 AS pool2, room1 - got1 AS room2 FROM c1),""" + P5_SPREAD.format(k=2, by="plan_name") + """,
quotas AS (SELECT plan_name, sampling_stratum, stratum, cap, available, want AS target_rows, greatest(0.0, want - available) AS unmet, (take0 + got1 + got2)::BIGINT AS quota, (got1 + got2)::BIGINT AS received FROM c2)
"""


def score(split: str, weight: float) -> str:
    return f"-{weight} / ln((('0x' || substr(md5('benang|{split}|' || component), 1, 12))::BIGINT + 0.5) / {float(16**12)!r})"


P3_SPLITS = f"""
WITH RECURSIVE {ROOTS.strip()},
e AS (SELECT DISTINCT a.root AS a, b.root AS b FROM filled a JOIN filled b ON a.post = b.post AND a.root <> b.root),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
comp AS (SELECT a AS root, least(a, min(b)) AS component FROM reach GROUP BY a),
r AS (SELECT DISTINCT x.post, coalesce(x.root, l.least_, x.post) AS root FROM rows x LEFT JOIN (SELECT post, min(root) AS least_ FROM rows GROUP BY 1) l ON l.post = x.post WHERE x.post IS NOT NULL),
n AS (SELECT r.post AS tweet_id, r.root AS root_tweet_id, coalesce(c.component, r.root) AS component FROM r LEFT JOIN comp c ON c.root = r.root),
s AS (SELECT *, {score('train', 0.8)} AS s1, {score('validation', 0.1)} AS s2, {score('test', 0.1)} AS s3 FROM n),
splits AS (SELECT tweet_id, root_tweet_id, component, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 'train' WHEN s2 >= s3 THEN 'validation' ELSE 'test' END AS split FROM s)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_splits": P3_SPLITS + "SELECT * FROM splits",
        "p3_components": P3_SPLITS + "SELECT root AS root_tweet_id, component FROM comp",
        "p3_shares": P3_SPLITS + "SELECT split, count(*) AS n_rows, count(DISTINCT component) AS n_components, count(*) / (SELECT count(*) FROM splits) AS share, CASE split WHEN 'train' THEN 0.8 ELSE 0.1 END AS target_share FROM splits GROUP BY split",
        "p3_found": f"""
WITH RECURSIVE {ROOTS.strip()},
e AS (SELECT DISTINCT a.root AS a, b.root AS b FROM filled a JOIN filled b ON a.post = b.post AND a.root <> b.root),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT a AS root_a, b AS root_b FROM reach WHERE a < b""",
        "p5_allocation": P5_ALLOCATION + "SELECT * FROM quotas",
        "p5_sample": P5_ALLOCATION + """, ranked AS (SELECT post, stratum, root, md5('benang|' || post) AS h, dense_rank() OVER (PARTITION BY stratum, root ORDER BY md5('benang|' || post), post) AS in_root FROM cands),
drawn AS (SELECT q.plan_name, q.sampling_stratum, q.quota, r.post, r.root, dense_rank() OVER (PARTITION BY q.plan_name, q.sampling_stratum, q.cap ORDER BY r.h, r.post) AS at_ FROM ranked r JOIN quotas q ON q.stratum = r.stratum AND r.in_root <= q.cap)
SELECT plan_name, sampling_stratum, post AS tweet_id, root AS root_tweet_id FROM drawn WHERE at_ <= quota""",
        "p5_found": P5_AVAILABLE + "SELECT DISTINCT plan_name, sampling_stratum FROM a WHERE available < target_share * sample_rows OR available < min_rows",
    }

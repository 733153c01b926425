import random

import pytest

from benang.operators import hierarchy as h

SCHEMA = "id string, parent string, root string"


def brute(links):
    parent, out = dict(links), {}
    for v in parent:
        cur, seen, steps = v, {v}, 0
        while True:
            up = parent[cur]
            if up is None:
                out[v] = ("top", cur, steps)
                break
            if up not in parent:
                out[v] = ("missing", up, steps + 1)
                break
            if up == v:
                out[v] = ("cycle", None, None)
                break
            if up in seen:
                out[v] = ("into_cycle", None, None)
                break
            cur, steps = up, steps + 1
            seen.add(up)
    return out


def forest(seed, n=50):
    r = random.Random(seed)
    ids = [str(i) for i in range(n)]
    return [(i, r.choice([*ids, "x", None]) if r.random() < 0.85 else None, r.choice("abc")) for i in ids]


@pytest.mark.parametrize("seed,block,tasks", [(1, 1000, 3), (2, 1000, 3), (3, 4, 5), (4, 4, 5)])
def test_against_brute_force(spark, seed, block, tasks):
    links = forest(seed)
    got = h.resolve(spark.createDataFrame(links, SCHEMA), with_path=True, block=block, tasks=tasks).collect()
    want = brute([x[:2] for x in links])
    assert {r.id: (r.ends, r.top, r.depth) for r in got} == want
    parent = {a: b for a, b, _ in links}
    for r in got:
        if r.ends in ("top", "missing"):
            steps, cur = [r.id], r.id
            while parent.get(cur) is not None:
                cur = parent[cur]
                steps.append(cur)
            assert r.path == "/".join(reversed(steps))


def test_chain_over_many_tasks(spark):
    links = [(str(i), str(i - 1) if i else None, str(i % 7)) for i in range(120)]
    got = {r.id: r.depth for r in h.resolve(spark.createDataFrame(links, SCHEMA), block=10, tasks=7).collect()}
    assert got == {str(i): i for i in range(120)}


def test_circle_over_many_tasks(spark):
    links = [(str(i), str((i + 1) % 40), str(i % 7)) for i in range(40)] + [("t", "3", "q"), ("u", "t", "w")]
    for block in (1000, 5):
        got = {r.id: r.ends for r in h.resolve(spark.createDataFrame(links, SCHEMA), block=block, tasks=7).collect()}
        assert all(got[str(i)] == "cycle" for i in range(40)) and got["t"] == got["u"] == "into_cycle"


THREADS = "tweet_id string, root_tweet_id string, in_reply_to_tweet_id string, hierarki_komentar string, id string, top string, path string, parent int"


def test_faults_and_blanks(spark):
    rows = [
        ("1", "1", "", "Root_Tweet"), ("2", "1", "1", "direct reply"), ("2", "1", "1", "direct reply"), ("3", "1", "2", "Nested_Reply"), ("4", "9", "1", "Direct_Reply"), ("5", "1", "1", "Nested_Reply"),
        ("6", "1", "6", "Direct_Reply"), ("7", None, "8", None), ("8", " ", "7", ""), ("10", "1", "77", "Root_Tweet"), (None, "1", "1", "Root_Tweet"), ("11", "11", "None", "Root_Tweet"), ("12", "11", "11", None),
    ]
    df = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], THREADS)
    got = {(r.tweet_id, r.fault) for r in h.found(df).collect()}
    assert got == {("4", "wrong_root"), ("5", "wrong_level"), ("6", "cycle"), ("7", "cycle"), ("8", "cycle")}


def test_empty(spark):
    df = spark.createDataFrame([], THREADS)
    assert h.found(df).count() == 0 and h.paths(df).count() == 0 and h.descendant_counts(h.paths(df)).count() == 0


def test_descendants(spark):
    df = spark.createDataFrame([(a, "1", p, "Root_Tweet", "", "", "", 0) for a, p in (("1", ""), ("2", "1"), ("3", "2"), ("4", "1"))], THREADS)
    tree = h.paths(df)
    assert {(r.ancestor, r.tweet_id, r.distance) for r in h.descendants(tree).collect()} == {("1", "2", 1), ("1", "3", 2), ("2", "3", 1), ("1", "4", 1)}
    assert {r.tweet_id: r.n_descendants for r in h.descendant_counts(tree).collect()} == {"1": 3, "2": 1}


def test_hot_thread(spark):
    links = [("r", None, "r")] + [(str(i), "r" if i % 3 else (str(i - 1) if i else "r"), "r") for i in range(300)]
    got = h.resolve(spark.createDataFrame(links, SCHEMA), block=20, tasks=4).collect()
    want = brute([x[:2] for x in links])
    assert {r.id: (r.ends, r.top, r.depth) for r in got} == want


def climbed(links):
    parent, out = {a: b for a, b, *_ in links}, {}
    for v in parent:
        cur, steps = parent[v], 1
        while cur is not None and cur != v and (cur, v) not in out:
            out[cur, v] = steps
            cur, steps = parent.get(cur), steps + 1
    return out


@pytest.mark.parametrize("seed,block,tasks", [(1, 1000, 3), (2, 4, 5), (3, 4, 5)])
def test_relations_of_every_post(spark, seed, block, tasks):
    links = forest(seed) + [(f"c{i}", f"c{(i + 1) % 7}", "r") for i in range(7)] + [("d", "c3", "r"), ("e", "d", "q"), ("s", "s", "q"), ("u", "s", "q"), ("leaf", None, "a")]
    df = spark.createDataFrame([(a, r, p, "", "", "", "", 0) for a, p, r in links], THREADS)
    want = climbed(links)
    got = [(r.ancestor, r.tweet_id, r.distance) for r in h.relations(df, block, tasks).collect()]
    assert sorted(got) == sorted((a, b, n) for (a, b), n in want.items())
    assert {("d", "e", 1), ("c3", "e", 2), ("c4", "e", 3), ("s", "u", 1)} <= set(got)
    sizes = {r.tweet_id: (r.n_descendants, r.height) for r in h.family_sizes(df, block, tasks).collect()}
    assert sizes["leaf"] == (0, 0) and {a for a, *_ in links} <= set(sizes)
    assert all(n == sum(a == k for a, _ in want) for k, (n, _) in sizes.items())


def test_relations_empty(spark):
    df = spark.createDataFrame([], THREADS)
    assert h.relations(df).count() == 0 and h.family_sizes(df).count() == 0

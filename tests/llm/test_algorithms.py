import itertools
import random

import pytest
from pyspark.sql import functions as F

from benang.llm import consensus, mixing, quota, splits

THREADS = "tweet_id string, root_tweet_id string, node string, component string, split string"


def threads(spark, rows):
    return spark.createDataFrame([(*r, "n", "c", "s") for r in rows], THREADS)


def closure(rows):
    groups = {}
    for t, r in rows:
        if t and r and r.strip():
            groups.setdefault(t, set()).add(r)
    comps = []
    for g in groups.values():
        if len(g) < 2:
            continue
        touching = [c for c in comps if c & g]
        for c in touching:
            comps.remove(c)
        comps.append(g.union(*touching))
    return {p for c in comps for p in itertools.combinations(sorted(c), 2)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    r = random.Random(seed)
    rows = [(f"t{r.randrange(60)}", f"r{r.randrange(40):02d}") for _ in range(70)] + [("t1", None), (None, "r01"), ("t1", " ")]
    assert {tuple(x) for x in splits.found(threads(spark, rows + rows[:5])).collect()} == closure(rows)


def test_long_chain_stays_together(spark):
    rows = [(f"t{i}", f"r{i:03d}") for i in range(60)] + [(f"t{i}", f"r{i + 1:03d}") for i in range(60)]
    got = splits.assign(threads(spark, rows)).collect()
    assert len({x.split for x in got}) == 1 and len({x.component for x in got}) == 1


def test_hot_least_node_is_salted(spark):
    edges = spark.createDataFrame([("a", f"n{i:03d}") for i in range(200)] + [("x", "y"), ("y", "z"), ("n000", "m")], "a string, b string")
    want = {(r.node, r.component) for r in splits.components(edges).collect()}
    assert {(r.node, r.component) for r in splits.components(edges, hot=20).collect()} == want
    assert {c for n, c in want if n not in "xyz"} == {"a"} and {c for n, c in want if n in "xyz"} == {"x"}


def test_no_thread_or_post_is_spread(spark):
    r = random.Random(5)
    rows = [(f"t{r.randrange(300)}", f"r{r.randrange(200)}" if r.random() < 0.9 else None) for _ in range(600)]
    got = splits.assign(threads(spark, rows)).toPandas()
    assert got.groupby("root_tweet_id").split.nunique().max() == 1 and got.groupby("tweet_id").split.nunique().max() == 1
    assert splits.assign(threads(spark, [])).count() == 0 and splits.found(threads(spark, [])).count() == 0


def test_rendezvous_shares_and_stability(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    a = df.withColumn("s", splits.rendezvous(F.col("k"), {"train": 0.8, "test": 0.2})).toPandas()
    assert abs((a.s == "train").mean() - 0.8) < 0.03
    b = df.withColumn("s", splits.rendezvous(F.col("k"), {"train": 0.8, "test": 0.4})).toPandas()
    assert not ((a.s == "test") & (b.s == "train")).any()


PLANS = "plan_name string, sampling_stratum string, target_share double, min_rows int, max_per_root int, sample_rows long, stratum string"


def sampling(spark, cands, roots, plans):
    return (
        spark.createDataFrame([(*c, "why", "root") for c in cands], "tweet_id string, sampling_stratum string, sampling_reason string, root string"), threads(spark, roots),
        spark.createDataFrame([(*p, "x") for p in plans], PLANS),
    )


def test_quota(spark):
    cands = [(f"a{i}", ["Overlap", " overlap", "OVER-LAP"][i % 3]) for i in range(10)] + [(f"a{i}", "Overlap") for i in range(3)] + [(f"n{i}", "No_Signal") for i in range(50)] + [(None, "Overlap"), ("z", None), ("y", " ")]
    roots = [(f"a{i}", "r1" if i < 8 else None) for i in range(10)] + [(f"n{i}", f"q{i % 25}") for i in range(50)]
    plans = [("p", "Overlap", 0.5, 0, 2, 20), ("p", "No_Signal", 0.5, 0, 2, 20), ("q", "Overlap", 0.1, 3, 5, 20), ("q", "Distribusi_Signal", 0.0, 1, None, None)]
    c, t, p = sampling(spark, cands, roots, plans)
    a = {(r.plan_name, r.sampling_stratum): r for r in quota.allocate(quota.available(quota.candidates(c, t), p)).collect()}
    assert a["p", "Overlap"].available == 4 and a["q", "Overlap"].available == 7 and a["q", "Distribusi_Signal"].available == 0
    assert a["p", "Overlap"].quota == 4 and a["p", "No_Signal"].quota == 16
    assert {tuple(r) for r in quota.found(c, t, p).collect()} == {("p", "Overlap"), ("q", "Distribusi_Signal")}
    drawn = quota.draw(c, t, p).toPandas()
    assert len(drawn[(drawn.plan_name == "p") & (drawn.sampling_stratum == "Overlap")]) == 4
    assert drawn[drawn.plan_name == "p"].groupby(["sampling_stratum", "root_tweet_id"]).size().max() <= 2
    assert not drawn.duplicated(["plan_name", "sampling_stratum", "tweet_id"]).any()


def test_quota_empty(spark):
    c, t, p = sampling(spark, [], [], [])
    assert quota.found(c, t, p).count() == 0 and quota.draw(c, t, p).count() == 0
    c, t, p = sampling(spark, [], [], [("p", "Overlap", 0.5, 1, 2, 20)])
    assert quota.found(c, t, p).count() == 1


def test_siblings_before_cousins():
    import pandas as pd

    rows = [("p", n, k, s, 100, 0, 5, a) for n, k, s, a in (("M", "mutugizisignal", 0.5, 10), ("T", "tatakelolasignal", 0.25, 60), ("N", "nosignal", 0.25, 500))]
    out = quota.allocate_plan(pd.DataFrame(rows, columns=["plan_name", "sampling_stratum", "stratum", "target_share", "sample_rows", "min_rows", "cap", "available"])).set_index("sampling_stratum")
    assert out.loc["M", "quota"] == 10 and out.loc["T", "quota"] == 60 and out.loc["N", "quota"] == 30 and out.quota.sum() == 100


PILOT = "tweet_id string, root_tweet_id string, teks_komentar string, annotator_1 string, annotator_2 string, adjudicated_label string, item string, p double"
MARKS = "tweet_id string, annotator_code string, slot int, mark string, marked_at timestamp, label int"


def crowd(spark, n=200, seed=3):
    from datetime import datetime, timedelta

    r = random.Random(seed)
    texts = {"Mutu_Gizi": "rasa sayur hambar", "Tata_Kelola": "audit dana vendor", "Distribusi": "paket tumpah telat"}
    truth, pilot, marks = {}, [], []
    t0 = datetime(2026, 1, 1)
    for i in range(n):
        c = r.choice(consensus.CATEGORIES)
        truth[f"i{i}"] = c
        pilot.append((f"i{i}", "r", texts[c], "", "", "", "x", 0.0))
        for a, skill in (("good", 0.95), ("fair", 0.75), ("spam", 0.0), ("lazy", 0.3)):
            m = c if r.random() < skill else ("Mutu_Gizi" if a == "lazy" else r.choice(consensus.CATEGORIES))
            marks.append((f"i{i}", a, 1, r.choice([m, m.lower(), m.replace("_", " "), m[:-2] + m[-1]]), t0 + timedelta(minutes=i), 0))
    return truth, spark.createDataFrame(pilot + pilot[:5], PILOT), spark.createDataFrame(marks + marks[:9], MARKS)


def test_consensus_and_reliability(spark):
    truth, p, m = crowd(spark)
    got = {r.tweet_id: r.category for r in consensus.found(p, m).collect()}
    assert len(got) == len(truth) and sum(got[k] == v for k, v in truth.items()) / len(truth) > 0.97
    rel = {r.annotator: r for r in consensus.reliability(p, m).collect()}
    assert rel["good"].competence > rel["fair"].competence > rel["spam"].competence
    assert rel["lazy"].guess[0] > 0.8


def test_people_outvote_words(spark):
    # three good annotators agree against what the item's words are everywhere else
    from datetime import datetime

    truth, p, m = crowd(spark, 120)
    odd_p = spark.createDataFrame([("odd", "r", "paket tumpah telat", "", "", "", "x", 0.0)], PILOT)
    odd_m = spark.createDataFrame([("odd", a, 1, "Mutu_Gizi", datetime(2026, 1, 1), 0) for a in ("good", "fair", "lazy")] + [(i, a, 1, c, datetime(2026, 1, 3), 0) for i, c in truth.items() for a in ("good", "fair")], MARKS)
    p, m = p.unionByName(odd_p), m.unionByName(odd_m)
    got = {r.tweet_id: r for r in consensus.with_words(p, m).collect()}
    assert got["odd"].category == "Mutu_Gizi" and {r.tweet_id: r.category for r in consensus.found(p, m).collect()}["odd"] == "Mutu_Gizi"


def test_patterns_count_like_items(spark):
    _, p, m = crowd(spark, 60)
    table = consensus.items(p, consensus.votes(p, m))
    n = consensus.patterns(table)
    assert n.agg(F.sum("n")).first()[0] == table.count() > n.count()


def test_marks_that_hold(spark):
    from datetime import datetime

    p = spark.createDataFrame([("1", "r", "teks", "Distribusi", "mutu gizi", "", "", 0.0), ("2", "r", None, "UNCLEAR", None, "Tata-Kelola", "", 0.0), ("3", None, "", None, None, None, "", 0.0), (None, "r", "x", "Distribusi", "", "", "", 0.0)], PILOT)
    m = spark.createDataFrame([("1", "a", 1, "Mutu_Gizi", datetime(2026, 1, 1), 0), ("1", "a", 1, "Tata_Kelola", datetime(2026, 1, 2), 0), ("1", "b", 4, "unclear", datetime(2026, 1, 2), 0), (None, "a", 1, "Distribusi", None, 0), ("1", None, 1, "Distribusi", None, 0)], MARKS)
    got = {(r.item, r.annotator, r.label) for r in consensus.votes(p, m).collect()}
    assert got == {("1", "a", 1), ("1", "#slot2", 0), ("2", consensus.ADJUDICATOR, 1)}
    assert {r.tweet_id for r in consensus.found(p, m).collect()} == {"1", "2", "3"}


def test_consensus_empty(spark):
    p, m = spark.createDataFrame([], PILOT), spark.createDataFrame([], MARKS)
    assert consensus.found(p, m).count() == 0 and consensus.reliability(p, m).count() == 0


DOCS = "doc_id long, source string, text string, tokens long, n_tokens int, title string"
TARGETS = "mix_name string, source string, target_share double, max_repeats int, tokens int"


def mix(spark, docs, targets):
    return spark.createDataFrame([(*d, 0, 0, None) for d in docs], DOCS), spark.createDataFrame([(*t, 0) for t in targets], TARGETS)


def test_tokens_of_whole_texts():
    import tiktoken  # noqa: F401

    path = mixing.TOKENIZER
    assert mixing.count_tokens("Makan siang sekolah.", path) == len(mixing.encoder(path).encode_ordinary("Makan siang sekolah."))
    assert mixing.count_tokens("a" * 300_000, path) > 10_000 and mixing.count_tokens("", path) == 0


def test_mix(spark):
    docs = [(i, "besar", "kata " * 100) for i in range(20)] + [(100, "kecil", "kata " * 100), (101, None, None), (102, "kosong", "")]
    d, t = mix(spark, docs, [("m", "besar", 0.5, 2), ("m", "kecil", 0.4, 3), ("m", "tiada", 0.1, 5), ("n", "besar", 1.0, 1)])
    assert {tuple(r) for r in mixing.found(d, t).collect()} == {("m", "kecil"), ("m", "tiada"), ("n", "besar")}
    plan = {(r.mix_name, r.source): r for r in mixing.plan(d, t).collect()}
    assert plan["m", "kecil"].passes == 3.0 and plan["m", "tiada"].budget_tokens == 0 and abs(sum(r.weight for k, r in plan.items() if k[0] == "m") - 1) < 1e-9
    made = mixing.realise(d, t).toPandas()
    assert made[(made.mix_name == "m") & (made.source == "kecil")]["pass"].max() == 3
    for (m, s), g in made.groupby(["mix_name", "source"]):
        assert plan[m, s].budget_tokens <= g.n_tokens.sum() < plan[m, s].budget_tokens + 200


def test_mix_empty(spark):
    d, t = mix(spark, [], [])
    assert mixing.found(d, t).count() == 0 and mixing.realise(d, t).count() == 0
    d, t = mix(spark, [], [("m", "a", 0.5, 2)])
    assert mixing.found(d, t).count() == 0  # half of nothing is no more than nothing


def test_exponent_meets_target_or_limit():
    for share, target, limit in ((0.2, 0.5, 1.0), (0.5, 0.2, 1.0), (0.01, 0.4, 0.03), (0.999999, 0.001, 5.0)):
        w = mixing.tempered(share, mixing.exponent_for(share, target, limit))
        assert abs(w - min(target, limit)) < 1e-9
    assert mixing.exponent_for(0.3, 0.3, 1.0) == pytest.approx(1.0) and mixing.tempered(0.3, mixing.exponent_for(0.3, 0.0, 1.0)) == 0
    assert mixing.entropy([0.5, 0.5]) == pytest.approx(0.6931471805599453)


def test_the_exponent_carries_the_mix(spark):
    import pandas as pd

    rows = pd.DataFrame([("m", "a", 0.5, 2, 900, 1000), ("m", "b", 0.5, 2, 100, 1000)], columns=["mix_name", "source", "target_share", "max_repeats", "tokens", "all_tokens"])
    bisected, plain = mixing.mix_plan(rows), mixing.mix_plan(rows, lambda s, t, c: 1.0)
    assert bisected.short.tolist() == [False, True] and bisected.budget_tokens.tolist() == [500, 200]
    assert plain.budget_tokens.tolist() == [899, 100] and plain.short.tolist() == [False, True]
    assert mixing.mix_plan(rows, lambda s, t, c: 9.0).short.tolist() == [True, True]


def test_realised_shares(spark):
    docs = [(i, "besar", "kata " * 100) for i in range(40)] + [(100 + i, "kecil", "kata " * 100) for i in range(4)]
    d, t = mix(spark, docs, [("m", "besar", 0.7, 2), ("m", "kecil", 0.3, 2)])
    made = mixing.realise(d, t).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    got = {r.source: r for r in mixing.shares(d, t).collect()}
    total = sum(r.n for r in made)
    for r in made:
        assert (got[r.source].mixed_tokens, got[r.source].mixed_rows) == (r.n, r.k) and abs(got[r.source].actual_share - r.n / total) < 1e-12
    assert got["kecil"].short and not got["besar"].short


def test_long_runs_alone_are_cut():
    path, words = mixing.TOKENIZER, "makan siang sekolah gratis " * 200
    run = "b" * 2500
    assert mixing.count_tokens(words + run + " " + words, path) == mixing.count_tokens(words, path) + mixing.count_tokens(run, path) + mixing.count_tokens(" " + words, path)


def test_tree_is_data(spark):
    # three levels: the unmet quota of a goes to its sibling b, then to the cousin c, then to d under the root
    tree = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("x", "u"), ("y", "u"), ("u", "top"), ("d", "top")], "node string, parent string")
    cands = [(f"{k}{i}", k) for k, n in (("a", 2), ("b", 13), ("c", 13), ("d", 99)) for i in range(n)]
    c, t, p = sampling(spark, cands, [], [("p", k, 0.25, 0, 5, 40) for k in "abcd"])
    avail = quota.available(quota.candidates(c, t), p)
    got = {r.sampling_stratum: (r.quota, r.unmet) for r in quota.allocate(avail, tree).collect()}
    assert got == {"a": (2, 8.0), "b": (13, 0.0), "c": (13, 0.0), "d": (12, 0.0)}
    flat = spark.createDataFrame([("a", "z"), ("d", "z")], "node string, parent string")
    assert {r.sampling_stratum: r.quota for r in quota.allocate(avail, flat).collect()} == {"a": 2, "b": 10, "c": 10, "d": 18}
    assert {tuple(r) for r in quota.found(c, t, p, tree).collect()} == {("p", "a")}
    with pytest.raises(ValueError):
        quota.allocate(avail, spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"))


def test_exact_quotas():
    from fractions import Fraction

    for s, n in ((0.1, 30), (0.07, 100), (0.29, 100), (1 / 3, 7)):
        assert float(quota.descend([Fraction(s), Fraction(1.0 - s)], [["g", ""], ["h", ""]], n)[0]) == s * n

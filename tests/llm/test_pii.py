import pytest

from benang.llm import pii
from benang.session import Scratch

SCHEMA = "tweet_id string, teks_komentar string, kind string, s int, row string"
KNOWN = [  # enough ordinary rows for patterns and name parts to be learnt
    *[(f"k{i}", f"nama saya {a} {b}") for i, (a, b) in enumerate([("Darjito", "Sokralaras"), ("Wurtini", "Hadipala"), ("Sulmono", "Bratadipa"), ("Rasminah", "Luwihsanga")])],
    *[(f"m{i}", f"tanya ke Bu {a} {b} ya") for i, (a, b) in enumerate([("Darjito", "Hadipala"), ("Wurtini", "Sokralaras"), ("Sulmono", "Luwihsanga"), ("Rasminah", "Bratadipa")])],
    *[(f"n{i}", f"wali dari {a} {b} kemarin") for i, (a, b) in enumerate([("Darjito", "Bratadipa"), ("Wurtini", "Luwihsanga"), ("Sulmono", "Sokralaras"), ("Rasminah", "Hadipala")])],
]


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return {(r.tweet_id, r.kind) for r in pii.found(df).collect()}


FINDS = [
    ("email saya darjito.sokra7@surelku.test ya", "email"), ("kirim ke a_b88 (at) posdesa (dot) example", "email"), ("kirim ke ab88 et posdesa titik test ya", "email"), ("surel ab12＠posdesa.test", "email"),
    ("kirim ke ab88 @ posdesa . example", "email"), ("surel a_b@surelku.test. Nyimak dulu", "email"), ("hub 0864 1234 5678", "phone"), ("no hp 086412345678 4584245004830004 itu nomor saya", "phone"), ("56 paket kena, 086723725310 (sms)", "phone"), ("WA +62 864-1234-5678", "phone"), ("no hp ０８６４１２３４５６７８", "phone"), ("telepon (0493) 769238 aja", "phone"), ("WA nol delapan enam empat satu dua tiga empat lima enam", "phone"),
    ("NIK 431916-590802-0094", "id_number"), ("KTP: 4345 3059 1182 0143", "id_number"), ("datanya 5617011511910009 belum masuk", "id_number"),
    ("rumah saya Jl. Merak Ungu No. 56", "street_address"), ("tinggal di komplek Melur kav 93", "street_address"), ("titip di RT 04 RW 01 Lembah", "street_address"), ("alamat Kenari Biru Street 20", "street_address"), ("antar ke dusun Waru Doyong RT 4 RW 7 no. 110", "street_address"),
    ("nama saya Darjito Hadipala", "person_name"), ("kata darjito hadipala kemarin", "person_name"), ("WALI DARI WURTINI BRATADIPA SAKIT", "person_name"), ("a.n. Sokralaras, Darjito", "person_name"),
]


def test_finds(spark):
    got = found(spark, [*KNOWN, *[(str(i), text) for i, (text, _) in enumerate(FINDS)]])
    assert [FINDS[i] for i in range(len(FINDS)) if (str(i), FINDS[i][1]) not in got] == []


LEAVES = [
    "hubungi admin lewat @dapur_Watu. kontrak 840 juta", "nomor resi 7222687780845268 belum sampai", "nomor batch 07836467 kedaluwarsa", "total 811573419 butir telur", "audit dana Rp 1,1 miliar", "paket tumpah di jalan ke Girigadung", "Bu Guru dan Pak Kades sudah tahu", "dekat gang masuk TK Watutawing 3",
    "kode pesanan 082613/5837/KRM", "jam 10.30 sudah sampai", "", "   ", "anak saya diare",
]


def test_leaves_alone(spark):
    got = found(spark, [*KNOWN, *[(f"x{i}", text) for i, text in enumerate(LEAVES)]])
    assert {(LEAVES[int(i[1:])], k) for i, k in got if i.startswith("x")} == set()


def test_nulls_empty_repeats_long(spark):
    assert found(spark, []) == set()
    long = "kata biasa " * 50_000 + "WA 0864 1234 5678"
    got = found(spark, [*KNOWN, ("1", None), (None, "WA 0864 1234 5678"), ("2", long), ("2", long)])
    assert {k for i, k in got if i == "2"} == {"phone"} and not {i for i, _ in got if i in ("1", None)}


def test_redaction_keeps_the_rest(spark):
    rows = [*KNOWN, ("1", "halo, hub 0864 1234 5678 atau ab@surelku.test 😀 ya"), ("2", None), ("3", "biasa saja")]
    got = {r.tweet_id: (r.text, r.redacted) for r in pii.redact(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)).collect()}
    assert got["1"][1] == "halo, hub [PHONE] atau [EMAIL] 😀 ya" and got["2"][1] is None and got["3"][0] == got["3"][1]


def test_longer_of_overlapping_spans():
    assert pii.redact_text("abcdefgh", [(1, 3, "phone"), (0, 4, "email"), (6, 8, "phone")]) == "[EMAIL]ef[PHONE]"


def test_unseen_name_by_good_pattern(spark):
    rows = [*KNOWN, *[(f"p{i}", f"tanya ke Bu {n} ya") for i, n in enumerate(["Darjito Hadipala", "Wurtini Bratadipa", "Sulmono Hadipala"])], ("1", "tanya ke bu darjito xyzawan ya")]
    assert ("1", "person_name") in found(spark, rows)


def test_bootstrap_scores(spark):
    cands = spark.createDataFrame([(0, "1", "phone", 0, 1, "a", "hub", "", 1.0), (1, "1", "phone", 0, 1, "b", "hub", "", None), (2, "1", "phone", 0, 1, "c", "resi", "", 0.0), (3, "1", "phone", 0, 1, "d", "resi", "", None)], pii.CANDIDATES)
    _, inst = pii.bootstrap(pii.edges(cands), Scratch(spark))
    s = {r.instance: r.score for r in inst.collect()}
    assert s["a"] > s["b"] > 0.5 > s["d"] > s["c"]


def test_unseen_form_of_a_number_by_its_context(spark):
    rows = [*KNOWN, *[(f"h{i}", f"no hp saya 0864{i:08d} ya") for i in range(12)], ("1", "no hp saya 77.123.4567 ya"), ("2", "jumlah porsi 77.123.4567 ya")]
    got = found(spark, rows)
    assert ("1", "phone") in got and not {i for i, _ in got} & {"2"}


def test_names_of_any_length(spark):
    rows = [*KNOWN, ("1", "tanya ke Pak Darjito Budira Cahyota Darmira Ekota Fajarun ya")]
    got = {r.tweet_id: r.redacted for r in pii.redact(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)).collect()}
    assert got["1"] == "tanya ke Pak [PERSON_NAME] ya"


@pytest.mark.parametrize("text", ["hubungi kosong delapan satu dua tiga empat lima enam tujuh ya", "hubungi nol-delapan-satu-dua-tiga-empat-lima-enam ya"])
def test_no_text_is_left_out(spark, text):
    assert ("1", "phone") in found(spark, [*KNOWN, ("1", text)])


def test_bit_table(spark):
    words = [f"w{i}" for i in range(40_000)]
    table = pii.bit_table(spark.createDataFrame([(w,) for w in words], "w string"), "w")
    assert len(table) == 1 << 17 and all(pii.held(table, w) for w in words)
    assert sum(pii.held(table, f"x{i}") for i in range(10_000)) < 1000
    assert pii.bit_table(spark.createDataFrame([], "w string"), "w") == bytes(1 << 15)


def test_chance_words_are_taken_out():
    import pandas as pd

    b = pd.DataFrame([(1, "t", ["ayu", "lestari", "kotak", "budi", "s"], [0, 4, 12, 18, 23], [3, 11, 17, 22, 24], False, [True, True, False, True, False])], columns=["row", "tweet_id", "parts", "starts", "ends", "lead", "known"])
    assert [tuple(r) for r in next(pii.stretches(iter([b]))).itertuples(index=False)] == [(1, "t", 0, 11), (1, "t", 18, 24)]

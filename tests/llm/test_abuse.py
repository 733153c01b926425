import pytest

from benang.llm import abuse

SCHEMA = "tweet_id string, sumber_akuisisi string, teks_komentar string, label double, score double, h long"


@pytest.mark.parametrize("text", [
    "dasar goblok", "lo t0l0l atau gimana", "b.a.n.g.s.a.t semua nih pengurusnya", "t o l o l", "k*mpr*t kok dipelihara", "eh bangsax, baca dulu", "mending lo mati aja", "kaum X memang parasit, usir smua", "jangan kasih makan orang Y, mereka bukan manusia", "hot nudes tonight, no clothes",
    "buka dong bajunya", "sini duel, kepala lo gue injak", "kirim preman ke rumah lurah, beres?", "mulut sampah kayak lo mending diam", "you are such a dumbass", "percuma sekolah tinggi kalau jadi m0ny3t",
])
def test_abusive(text):
    assert abuse.featurize(text)[1] == 1


@pytest.mark.parametrize("text", [
    "sampah bekas kotak menumpuk di SD", "monyet dari hutan ambil kotak makan lagi", "menu bebas babi dan sudah halal", "guru tidak boleh sebut murid \"goblok\", itu melukai", "jangan bilang anak orang tolol hanya karena tidak habis makan", "kata \"tolol\" di komentar atas sudah kami laporkan", "ayam dada montok, porsinya gede",
    "habis dibacok harga cabai", "telanjang kaki ke sekolah lewat sawah", "racun tikus jangan disimpan dekat soto", "kita bakar ikan bareng", "tai ayam dipakai pupuk kebun", "kebijakan ini gagal total", "susu ibu tetap utama", "lawan komentar cabul, laporkan", "", None, "bangsa Indonesia", "sampai besok",
    "wali murid dikatai \"t0l0l\" sampai nangis, tolong admin hapus",
])
def test_harmless(text):
    assert abuse.featurize(text)[1] == 0


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.0, 0.0, 0) for r in rows], SCHEMA)


BAD = ["dasar goblok kamu", "mending lo mati aja", "usir semua, kaum itu hama", "sini temani om di ranjang", "lo bego atau gimana"]
FINE = ["menunya enak sekali", "paket tumpah di jalan", "audit dana mana hasilnya", "nyimak dulu", "terima kasih infonya", "besok rapat guru", "sampah menumpuk di SD"]


def rows():
    return [(f"b{i}", "KEYWORD_SEARCH" if i % 2 else None, f"{BAD[i % len(BAD)]} {i}") for i in range(60)] + [(f"f{i}", "REPLY_TWEET_ID", f"{FINE[i % len(FINE)]} {i}") for i in range(140)]


def test_model_finds_them(spark):
    df = frame(spark, [*rows(), ("n", None, None), (None, None, "dasar goblok"), ("b0", "X", "biasa saja")])
    got = {r.tweet_id for r in abuse.found(df).collect()}
    assert got == {f"b{i}" for i in range(60)}
    s = {r.tweet_id: r.score for r in abuse.scores(df).collect()}
    assert all(0 <= x <= 1 for x in s.values()) and s["b1"] > s["f1"] and s["b0"] >= 0.5
    r = {x.source: (x.n_rows, x.n_abusive) for x in abuse.rates(df).collect()}
    assert r["REPLY_TWEET_ID"] == (140, 0) and r["KEYWORD_SEARCH"] == (30, 30)


def test_one_label_only_and_empty(spark):
    assert abuse.found(frame(spark, [])).count() == 0 and abuse.rates(frame(spark, [])).count() == 0
    assert abuse.found(frame(spark, [("1", "a", "enak"), ("2", "a", "sedap")])).count() == 0
    assert [r.tweet_id for r in abuse.found(frame(spark, [("1", "a", "dasar goblok")])).collect()] == ["1"]


def test_long_text(spark):
    assert abuse.featurize("kata " * 200_000 + "dasar goblok")[1] == 1


@pytest.mark.parametrize("text", ["sini sama gw", "sama gua semalam", "sini sm gw semalam", "you are a disgusting pathetic waste of space", "dasar manusia tak berguna, enyahlah dari sini"])
def test_expressions_in_every_spelling(text):
    assert abuse.featurize(text)[1] == 1


def test_odds_see_what_no_list_holds(spark):
    # a clause with an unlisted word is said like clauses with listed ones; a listed word in harmless company is not
    df = frame(spark, [(f"b{i}", "A", f"{w} semua nih pengurusnya {i}") for i in range(100) for w in ("goblok", "tolol", "bego")] + [(f"f{i}", "A", f"{FINE[i % len(FINE)]} {i}") for i in range(3000)])
    model = abuse.fit_odds(abuse.rows_of(df))
    row = lambda text: dict(zip(abuse.FEATURES, abuse.featurize(text, model)[0]))
    assert abuse.featurize("zurbax semua nih pengurusnya")[1] == 0 and row("zurbax semua nih pengurusnya")["peak"] > 0 > row("sampah bekas kotak menumpuk di SD")["peak"]


def test_parts_are_bounded_and_disjoint():
    a, b, c = abuse.cuts(10**9, abuse.Parameters())
    assert (a, b - a, c - b) == (100, 40, 40) and abuse.cuts(10, abuse.Parameters())[2] == 1_000_000


def test_peak_is_not_weighed_down():
    model = abuse.odds.Odds(-3.0, {"bad": 6.0, "fine": -1.0})
    assert abuse.weigh(model, ["fine"] * 8 + ["bad"] + ["x y"] * 8) == (-5.0, 3.0)

import itertools
import random

import numpy as np
import pytest

from benang.llm import leaks, residue


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        seq = rng.integers(1, 5, n)
        seq[-1] = 0
        assert leaks.suffix_array(seq).tolist() == sorted(range(n), key=lambda i: seq[i:].tolist())
    index = leaks.FMIndex(seq, 5)
    phrases = np.array([[a, b] for a in range(1, 5) for b in range(1, 5)])
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - 1) if (seq[i:i + 2] == p).all()]


def test_wavelet_ranks():
    rng = np.random.default_rng(2)
    seq = rng.integers(0, 37, 500)
    tree = leaks.WaveletTree(seq, 37)
    at, sym = rng.integers(0, 501, 200), rng.integers(0, 37, 200)
    assert tree.rank(sym, at).tolist() == [int((seq[:a] == s).sum()) for a, s in zip(at, sym)]


DOCS = "doc_id long, text string, source string, item_id long, title string"
EVALS = "item_id long, text string, split_name string, doc_id int"
R = random.Random(9)
VOCAB = [f"kata{i}" for i in range(60)]
ITEMS = [" ".join(R.choice(VOCAB) for _ in range(60)) for _ in range(5)]
NOISE = [f"lain{i}" for i in range(200)]


def noise(n):
    return " ".join(R.choice(NOISE) for _ in range(n))


def run(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(i, t, "s", 0, None) for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, t, "test", 0) for i, t in enumerate(items)], EVALS)
    return {tuple(r) for r in leaks.found(d, e).collect()}


def piece(item, a, n):
    return ITEMS[item].split()[a:a + n]


@pytest.mark.parametrize("change", ["none", "case", "accents", "marks", "changed", "dropped", "added", "markup"])
def test_passages(spark, change):
    w = piece(2, 10, 30)
    if change == "case":
        w = [x.upper() for x in w]
    if change == "accents":
        w = [x.replace("a", "á") + "​" for x in w]
    if change == "marks":
        w = [x + ",\n" for x in w]
    if change == "changed":
        w = [("ganti" if i % 7 == 3 else x) for i, x in enumerate(w)]
    if change == "dropped":
        w = [x for i, x in enumerate(w) if i % 8 != 3]
    if change == "added":
        w = [y for i, x in enumerate(w) for y in ([x, "tambah"] if i % 8 == 3 else [x])]
    if change == "markup":
        w = [f"<b>{x}</b>" if i == 4 else x for i, x in enumerate(w)]
    assert run(spark, [(1, f"{noise(40)} {' '.join(w)} {noise(40)}"), (2, noise(90))]) == {(1, 2)}


def test_short_quotes_and_other_orders(spark):
    shuffled = piece(1, 0, 40)
    random.Random(1).shuffle(shuffled)
    chunks = [piece(1, i, 4) for i in range(0, 40, 4)]
    random.Random(2).shuffle(chunks)
    docs = [(1, f"{noise(30)} {' '.join(piece(0, 5, 9))} {noise(30)}"), (2, f"{noise(9)} {' '.join(shuffled)}"), (3, " ".join(x for c in chunks for x in c)), (4, f"{noise(20)} {' '.join(piece(3, 0, 15))} {noise(5)}")]
    assert run(spark, docs) == {(4, 3)}


def test_defined_results(spark):
    whole = ITEMS[0]
    docs = [(1, whole), (1, whole), (2, None), (3, ""), (None, whole), (4, f"{noise(400_000)} {whole}"), (5, whole)]
    assert run(spark, docs) == {(1, 0), (4, 0), (5, 0)}
    assert run(spark, []) == set() and run(spark, docs, []) == set() and run(spark, docs, [None, " "]) == set()


def test_spans_merge_and_report(spark):
    text = f"{noise(10)} {' '.join(piece(0, 0, 30))} {noise(10)}"
    d = spark.createDataFrame([(1, text, None, 0, None)], DOCS)
    e = spark.createDataFrame([(0, ITEMS[0], "test", 0), (1, " ".join(piece(0, 10, 20)), "test", 0), (2, ITEMS[4], "test", 0)], EVALS)
    s = leaks.spans(d, e).collect()
    assert len(s) == 1 and (s[0].first_word, s[0].end_word, s[0].n_items) == (10, 40, 2)
    assert {r.item_id: r.n_docs for r in leaks.report(d, e).collect()} == {0: 1, 1: 1, 2: 0}


def scanned(words, item=0):
    known = leaks.Items(list(enumerate(ITEMS)), 3)
    ids = [np.array([known.vocab.get(x, leaks.OTHER) for x in words], np.int64)]
    return [x[2:] for x in leaks.scan([(1, ids[0])], known, 15, 0.2, leaks.worst_cover(15, 1 / 6, 3)) if x[1] == item]


def test_changes_at_every_place():
    foreign = noise(20).split()
    cases = [(15, c) for k in (1, 2) for c in itertools.combinations(range(15), k)] + [(17, (2, 14)), (18, (2, 5, 8))]
    for n, places in cases:
        for how in ("changed", "dropped", "added"):
            w = piece(0, 20, n)
            for at in reversed(places):
                w[at:at + 1] = {"changed": ["ganti"], "dropped": [], "added": [w[at], "tambah"]}[how]
            kept = [x for x in range(n) if x not in places or how == "added"]
            if how != "added" and kept[-1] - kept[0] + 1 < 14:  # unbroken, its neighbours changed: a short quotation
                continue
            assert scanned(foreign + w + foreign), (n, places, how)
    assert leaks.worst_cover(15, 1 / 6, 3) == 9


def test_short_quotation_hides_no_passage():
    w = piece(0, 40, 15)
    w[2] = w[12] = "ganti"
    assert scanned(noise(9).split() + piece(0, 2, 13) + noise(9).split() + w + noise(9).split())


@pytest.mark.parametrize("gap", [25, 50, 79])
def test_every_passage_of_an_item_has_a_span(gap):
    a, b, c = (noise(n).split() for n in (10, gap, 10))
    whole = piece(0, 0, 60)
    assert scanned(a + whole + b + whole + c) == [(10, 70), (70 + gap, 130 + gap)]
    assert scanned(a + whole[:30] + b + whole[30:] + c) == [(10, 40), (40 + gap, 70 + gap)]


def test_items_in_blocks(spark):
    d = spark.createDataFrame([(i, ITEMS[i], None, 0, None) for i in range(5)], DOCS)
    e = spark.createDataFrame([(i, t, "test", 0) for i, t in enumerate(ITEMS)], EVALS)
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(d, e, block=2).collect()} == {(i, i) for i in range(5)}


RESIDUE = "doc_id long, source string, title string, text string, n_chars long, flagged boolean, copies int"
ARTICLE = "Dalam rapat kemarin, relawan meminta data dapur dibuka. Kalau hujan, mobil tidak bisa naik ke desa, jadi warga menunggu di balai. "


@pytest.mark.parametrize("text", [
    "Yth. {{nama}}, bersama ini kami sampaikan", ARTICLE + "Warga [nama_sekolah] menilai rapi.", ARTICLE + "Harga <%= LOKASI %> naik.", "Halo ${nama dapur}! Jadwal @@isi di sini@@", "%judul% tetap", "Pada #N/A, None porsi dibagikan di (null) oleh #REF!.", "Total undefined kotak, rata-rata null per anak.",
    ARTICLE + "\nNama sekolah: .............\nJumlah porsi: _______", "Coret yang tidak perlu: puas / tidak puas", "Lorem ipsum dolor sit amet consectetur", "Teks contoh. Teks contoh. Teks contoh. Teks contoh. Teks contoh.", "xxx xxx xxx xxx xxx xxx xxx xxx xxx " + ARTICLE, "Isi berita ditulis di sini.",
    "Error 502: Server sedang sibuk", "Galat 404 — Permintaan melewati batas waktu", "Oops!  Halaman  tidak  ditemukan.", "NullPointerException at PostView.render(221)\n" + ARTICLE, "Memuat… memuat…", "Just another new site. Edit this text from your dashboard.", "Please turn on JavaScript in your browser to view this post.",
    "This page needs scripts to run; yours are blocked.", "Browser lama terdeteksi. Perbarui peramban atau izinkan skrip.", "TODO: lengkapi isi, foto menyusul.", "Checking that you are not a robot…", "Tessera fermas ulmen tessera adipra nolit ulmen mavum nolit mavum fermas nolit sitera conspet elunt sitera fermas ulmen elunt",
])
def test_residue(text):
    assert sum(residue.detect(text)) > 0


@pytest.mark.parametrize("text", [
    ARTICLE, "Di pelatihan, lurah belajar bahwa {{nama}} dalam surat akan diganti nama siswa oleh sistem.", "Harga per kotak {naik} menurut catatan lurah, tanda kurung itu memang dari relawan.", "Kode 404 dipakai sebagai nama regu relawan desa, katanya biar gampang diingat.",
    "Situs sekolah minta JavaScript dinyalakan, jadi lurah membantu orang tua satu per satu.", "Aplikasi aduan menampilkan tulisan \"Halaman tidak ditemukan\" waktu relawan mencoba melapor.", "Akses ke gudang desa ditolak petugas karena wali murid lupa membawa kartu.", "Brosur lama masih memakai lorem ipsum dan lurah menertawakannya bersama.",
    "Server dapur sempat error 502 selama 40 menit, lalu guru piket mencatat satu per satu.", "Form kosong dengan titik-titik dibagikan ke 17 orang tua.", "(Redaksi menerima 9 surat senada.) <3 untuk relawan!", "Catatan [1] dan <b>tebal</b> biasa", "Nobody at the meeting could explain the budget sheet.", "Bocah kelas loro seneng capcay. Bocah kelas loro seneng susu. Bocah kelas loro seneng tempe.",
])
def test_no_residue(text):
    assert sum(residue.detect(text)) == 0


def test_repeated_notices_of_hosts(spark):
    rows = [(i, f"h{i % 2}", "Kabar desa", "Silakan tunggu sebentar saja", 1, False, 1) for i in range(4)] + [(10, "h1", "Kabar", ARTICLE, 1, False, 1), (11, None, None, None, 1, False, 1), (12, "h", None, "", 1, False, 1), (None, "h", None, "{{x}}", 1, False, 1), (13, None, None, "Memuat…", 1, False, 1), (13, None, None, "Memuat…", 1, False, 1)]
    df = spark.createDataFrame(rows, RESIDUE)
    assert {r.doc_id for r in residue.found(df).collect()} == {0, 1, 2, 3, 13}
    assert residue.clean(df).where("doc_id in (10, 11, 12)").count() == 3
    assert residue.found(spark.createDataFrame([], RESIDUE)).count() == 0


def test_long_text():
    assert sum(residue.detect(ARTICLE * 5000)) == 0 and sum(residue.detect(ARTICLE * 5000 + "{{judul}}")) == 1


@pytest.mark.parametrize("text", ["Selesaikan reCAPTCHA untuk melanjutkan.", "Reloading...", "404 - laman hilang", "Warga pulang.\n503: mohon bersabar"])
def test_notices_inside_words_and_status_lines(text):
    assert residue.detect(text)[3] > 0


def test_long_filler_without_function_words():
    text = ". ".join(f"kata{chr(97 + i % 26)} isi{chr(97 + i // 26)} lain{chr(97 + i % 7)}" for i in range(80))
    assert len(text.split()) >= 200 and residue.detect(text)[2] > 0


HELD_OUT = [  # notices of systems at large; none stands in the test tables
    "Error establishing a database connection", "This site can't be reached", "The requested URL was not found on this server.", "Your session has expired. Please log in again.", "Sorry, the page you are looking for does not exist.", "503 Service Temporarily Unavailable",
    "Halaman yang Anda cari tidak tersedia.", "Mohon tunggu, halaman sedang dimuat", "Situs sedang dalam perawatan, silakan kembali nanti.", "Enable cookies to continue", "Your browser is not supported. Please upgrade.", "Insert sample text here", "Koneksi ke server gagal",
    "Berkas yang diminta telah dihapus", "Request timed out", "Too many requests, please wait", "Aktifkan JavaScript pada peramban Anda", "Laman tidak valid", "Checking your browser before accessing this site", "ReferenceError: total is not defined", "Access to this resource is forbidden",
    "Uncaught TypeError in app.js line 12", "Maaf, konten sudah dipindah.", "Welcome to your new site. Edit or delete this post.", "Judul contoh untuk halaman baru", "Deskripsi singkat situs (maks. 160 karakter)", "This content is blocked. Allow cookies and reload.", "Gambar tidak dapat ditampilkan",
    "Please verify that you are not a robot", "Layanan tidak merespons, coba lagi nanti",
]


def test_held_out_notices():
    assert sum(residue.detect(t)[3] > 0 for t in HELD_OUT) >= 0.9 * len(HELD_OUT)


@pytest.mark.parametrize("text", ["404 - Oops", "403 – tidak boleh", "Notice in /var/www/html/index.php on line 12", "Halo {{ " + "nama" * 12 + " }}", "kata " * 210 + "${judul " + "x" * 60 + "}"])
def test_no_gate_and_no_size(text):
    assert sum(residue.detect(text)) > 0


def test_words_beside_seeds_are_learnt_and_hosts_raise(spark):
    # "kabarnya lenyap" is in no list: it stands beside seeds in short responses of several hosts
    rows = [(i, f"h{i % 5}", "Kabar desa", f"Error {500 + i % 4}: server sedang sibuk\nKabarnya lenyap begitu", 1, False, 1) for i in range(20)]
    rows += [(100 + i, f"h{i % 5}", "Kabar desa", ARTICLE + f"Relawan ke-{i} pulang.", 1, False, 1) for i in range(200)] + [(900, "h1", "Kabar desa", "Kabarnya lenyap begitu", 1, False, 1)]
    got = {r.doc_id: r for r in residue.score(spark.createDataFrame(rows, RESIDUE)).collect()}
    assert got[900].flagged and got[900].seeds == 0 and got[900].odds_hosts > got[900].odds
    assert not any(got[100 + i].flagged for i in range(200))

"""Template residue, filler and error-page text: title against body, repeated low-information responses, evidence of
hosts, placeholder detectors.

A text is read as segments (sentences and lines). What a segment gives:

* marks of unfilled placeholders, blank forms and filler runs, from their form alone; they flag a document by themselves;
* how much of it is system speech: words of pages, servers, scripts and samples, of their states and of requests to
  the reader. A segment made of little else is low in information and serves as a seed;
* log odds of its words and pairs of words, of whether it tells about somebody, how its document's title agrees with
  the body, and how short the document is. They are fitted on a bounded sample (``Parameters``) to the seeds and to what
  stands beside seeds in short responses, so words that no list holds count too;
* its fingerprint (words without digits and names). Over all documents the hosts (sources) that repeat it, and the
  share of its copies that stand with residue, raise or lower the odds by at most ``lift``; segments whose odds lie
  further off cannot be flagged by any host and are left out before the fingerprints are shuffled.

Documents carry no address, so the title stands for the slug and the source for the host.

Defined results: null and blank texts hold nothing and are not flagged; a null title never mismatches by itself, it
is a kind of evidence of its own; repeated documents are flagged alike; rows with a null doc_id are ignored; empty
tables give empty results. Whole texts are read; only the named columns are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benang.llm import odds
from benang.session import Scratch


@dataclass(frozen=True)
class Parameters:
    """fit_docs bounds the documents the log odds are fitted on; lift bounds what hosts can add or take."""

    fit_docs: int = 20_000
    lift: float = 6.0
    seed_bonus: float = 8.0
    density: float = 0.4
    response: int = 40


#: names that slots of templates carry; single brackets count only with such a name, an underscore, a dot or capitals
SLOTS = "nama|name|judul|title|tanggal|date|lokasi|location|kota|city|total|tautan|link|url|penulis|author|isi|sekolah|dapur|wali|jumlah|email|alamat|address|user|first|last|post|number|nomor|placeholder|teks|text|konten|content"
SLOT = rf"(?:[A-Z][A-Z_. ]+|\w*[_.]\w+(?:[_. ]\w+)*|(?:{SLOTS})(?:[_. ]\w+)*|[a-z]+(?:[_. ](?:{SLOTS})))"
STRONG = re.compile(
    r"\{\{[^{}\n]*\}\}|\[\[[^\[\]\n]*\]\]|\$\{[^{}\n]*\}|#\{[^{}\n]*\}|<%[^%\n]*%>|\{%[^%\n]*%\}|@@[^@\n]+@@|<<[^<>\n]+>>"
    r"|(?<!\w)__[A-Za-z][\w. ]*?__(?!\w)"
    rf"|%{SLOT}%|\${SLOT}\$|\{{{SLOT}\}}|\[{SLOT}\]|<{SLOT}>"
)
#: every alternative of STRONG holds one of these signs
SIGNS = frozenset("{[$#<%@_")
#: markup is no slot
MARKUP = re.compile(r"</?(?:a|b|i|p|u|br|hr|em|li|ul|ol|td|tr|th|div|img|span|strong|table|h[1-6]|code|pre)\b[^<>]*/?>|&lt;/?\w+&gt;", re.I)
ABSENT = re.compile(r"\[object Object\]|#N/A|#REF!|\(null\)|\bundefined\b|\bnull\b|\bNaN\b|\bNone\b")
SURE_ABSENT = re.compile(r"\[object Object\]|#N/A|#REF!|#VALUE!|\(null\)")
FORM = re.compile(r"[:=]\s*(?:\.{6,}|…{3,}|_{5,}|\( {4,}\))|coret yang tidak perlu|strike out|\{\} \w+|\w+ \{\}|huruf cetak|block capitals|\((?:tanda tangan|signature)\)", re.I)


def _lexicon(*groups: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for bit, words in enumerate(groups):
        for w in words.split():
            out[w] = out.get(w, 0) | 1 << bit
    return out


#: system speech: what pages and programs are made of; in what state they are; what they ask of the reader; samples
THINGS, STATES, REQUESTS, SAMPLES = 1, 2, 4, 8
SPEECH = _lexicon(
    "page pages halaman laman situs site website web server peladen koneksi connection konten content url tautan link browser peramban javascript java js skrip script scripts cookie cookies captcha recaptcha robot session sesi akses access request permintaan"
    " gateway host upstream database layanan service cache app aplikasi plugin dashboard dasbor template templat noscript php sql sqlstate http https exception traceback stack trace memory variable variabel index"
    " beranda homepage login render iklan ads adblock post blog kode code bot jaringan network file berkas dokumen gambar image video pemutar player komentar comments formulir form alamat address pengelola administrator webmaster mode ref reference id proxy domain dns ssl api json xml null www html line",
    "error galat kesalahan gagal fail failed failure fatal denied ditolak forbidden unavailable expired kedaluwarsa kadaluarsa berakhir timeout time out waktu batas melewati terputus refused lost disabled dimatikan nonaktif menonaktifkan diblokir blocked required diperlukan"
    " membutuhkan memerlukan requires needs need sibuk busy overloaded perawatan maintenance loading reloading memuat broken rusak wrong salah invalid valid moved dipindah pindah removed dihapus hilang gone anymore unsupported supported didukung undefined defined exhausted found ditemukan"
    " tersedia available dimuat tampil ditampilkan displayed missing exist oops ups whoops warning notice bad internal terlalu banyak too many gangguan apologies sorry maaf terdeteksi detected checking memeriksa verifying soon segera hadir coming construction offline down crashed unexpected terduga went answer respond",
    "please silakan mohon harap enable turn allow allowed aktifkan nyalakan izinkan hidupkan dinyalakan diaktifkan diizinkan perbarui update upgrade refresh reload muat ulang segarkan coba try again lagi retry masuk kembali back return go click klik verify verifikasi matikan disable support anda you your yours bersabar"
    " tunggu wait contact hubungi selesaikan complete continue melanjutkan melihat view melihatnya melanjutkannya membuka open izin permission sebutkan ketik search searching check periksa moment sebentar later nanti",
    "lorem ipsum dolor sit amet consectetur adipiscing contoh sample example placeholder dummy percobaan percontohan default bawaan todo tbd hello world lengkapi isi ganti gantilah sunting edit delete hapus teks text paragraf paragraph kiriman postingan tulisan deskripsi description"
    " judul title diterbitkan published another new baru maks max huruf karakter characters here sini goes welcome first pertama profil profile singkat",
)
#: a sentence that tells about such a thing: a person or time beside it, a quotation, an outcome
TELLS = re.compile(
    r"\bwaktu (?!habis)\w|\bketika\b|\bsaat\b|\bkatanya\b|menertawakan|dipakai sebagai|belajar bahwa|akan diganti|menurut catatan|tanda kurung|jadi (?:\w+ ){0,4}(?:membantu|harus)|satu per satu|sempat|selama \d+ menit|dibagikan ke|masih memakai|menampilkan tulisan|karena \w+ \w* ?lupa|ditolak petugas|said|laughed|told|noticed|explained|while \w+ (?:was|were)|training",
    re.I,
)
#: a sentence that tells about a placeholder
TELLS_SLOT = re.compile(r"belajar bahwa|akan diganti|tanda kurung|katanya|menertawakan|will be replaced|placeholder (?:is|means)", re.I)
FUNCTION_WORDS = frozenset(
    "yang dan di ke dari untuk dengan pada ini itu tidak ada akan oleh karena atau juga sudah saya kami kita mereka dia ia sebagai dalam bisa lebih saat hanya belum jadi bila kalau agar bagi soal tetapi namun bukan masih lagi tiap setiap antara sampai sejak selama setelah sebelum sambil tanpa lewat menurut hingga sehingga maka walau meski padahal supaya ialah adalah siapa mengapa apa bagaimana seorang sebuah para begitu hasilnya datang"
    " the of and to in a is was were for on with at by from that this it as be are not no an or but had has have they we you he she their our its before after near about same day spent nobody everyone who"
    " ing lan karo saka kanggo wis isih nanging yen kuwi iki sing ora arep nang menyang luwih saiki kandha bocah njaluk tambah durung".split()
)
SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
STRETCH = re.compile(r"[.!?…,;:()\"\n|]+")
BLANKS = re.compile(r"[^\S\n]+")
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+|\d+")
CODE = re.compile(r"[45]\d\d")
DIGIT = re.compile(r"\d")
#: a line that begins with a status code and a separator
STATUS = re.compile(r"\s*[45]\d\d\s*[|:—–-]")


def repeated_run(words: list[str], least: int = 8, most: int = 3) -> bool:
    """A run of ``least`` words with at most ``most`` different ones."""
    # among any most + 1 words of such a run one comes back
    if not any(any(map(eq, words, words[k:])) for k in range(1, most + 1)):
        return False
    for i in range(0, len(words) - least + 1):
        if len(set(words[i:i + least])) <= most:
            return True
    return False


def filler_run(words: list[str], least: int = 12) -> bool:
    """A stretch without punctuation in which ``least`` words follow each other without any function word of the
    languages at hand, and some of them come back."""
    run: list[str] = []
    for w in [*words, "yang"]:
        if w in FUNCTION_WORDS:
            if len(run) >= least and len(run) - len(set(run)) >= 0.3 * len(run):
                return True
            run = []
        else:
            run.append(w)
    return False


def speech(segment: str, tokens: list[str]) -> tuple[int, int, int]:
    """Words, words of system speech, and the bits of their groups, of a segment and its lower-case tokens. A status
    code counts as a state, but is no word of its own; at the head of a status line it counts twice."""
    n, k, bits = len(tokens), 0, 0
    for b in map(SPEECH.get, tokens):
        if b:
            k, bits = k + 1, bits | b
    if DIGIT.search(segment):
        numbers = [t for t in tokens if t[0].isdigit()]
        codes = sum(CODE.fullmatch(t) is not None for t in numbers)
        n, k = n - len(numbers), k + codes
        if codes:
            bits |= STATES
        if STATUS.match(segment):
            k, bits = k + 1, bits | THINGS
    low = segment.lower()
    if "exception" in low or "error" in low:
        # names of errors are compound words: KeyError, NullPointerException
        named = sum(t.endswith(("exception", "error")) and t not in SPEECH for t in tokens)
        if named:
            k, bits = k + named, bits | THINGS | STATES
    return n, k, bits


def seeded(n: int, k: int, bits: int, density: float = Parameters.density) -> bool:
    """Whether a segment is little else than system speech: two words of it at least, of things alone none, of
    requests alone half as many again; or nothing but one word of a state."""
    if n and k == 1 == n:
        return bool(bits & STATES)
    return k >= 2 and bits != THINGS and k >= (1.5 * density if bits == REQUESTS else density) * n


#: every alternative of FORM, SURE_ABSENT and ABSENT holds one of these
FORM_PARTS = (":", "=", "coret", "strike", "{}", "cetak", "capitals", "tangan)", "signature)")
ABSENT_PARTS = ("[object Object]", "#N/A", "#REF!", "#VALUE!", "null", "undefined", "NaN", "None")


def marks(segment: str, absent: bool = True) -> tuple[int, int]:
    """Slots and blank forms of a segment; ``absent`` says whether its text holds any of ABSENT_PARTS."""
    slots = 0
    if not SIGNS.isdisjoint(segment):
        flat = BLANKS.sub(" ", segment)
        slots = len(STRONG.findall(flat))
        slots = 0 if slots < 2 and slots and TELLS_SLOT.search(flat) else slots
    if absent:
        slots += len(SURE_ABSENT.findall(segment)) + (len(ABSENT.findall(segment)) >= 2)
    low = segment.lower()
    return slots, int(any(x in low for x in FORM_PARTS) and FORM.search(segment) is not None)


def unmarked(text: str) -> str:
    return MARKUP.sub(" ", text) if "<" in text or "&" in text else text


def segments(text: str) -> list[str]:
    return [s for s in SENTENCE.split(unmarked(text)) if s and not s.isspace()]


def filler(text: str, words: list[str]) -> bool:
    only = len(words) >= 4 and len(set(words)) <= 2 or len(words) >= 10 and FUNCTION_WORDS.isdisjoint(words)
    return only or repeated_run(words) or any(filler_run([w.lower() for w in WORD.findall(s)]) for s in STRETCH.split(text) if len(s) > 60)


def detect(text: str) -> tuple[int, int, int, int]:
    """Counts of slots, forms, filler runs and seeds (segments of system speech) that are used, not told about."""
    direct, _, _, parts = read(None, text, Parameters.density)
    return *direct, sum(seed for *_, seed, _ in parts)


def agreement(title: object, words: set[str]) -> str:
    """How the title's terms meet the body's: none without a title, else miss, some or all."""
    slug = {w for w in WORD.findall(title.lower()) if w not in FUNCTION_WORDS} if isinstance(title, str) else set()
    if not slug:
        return "none"
    met = len(slug & words)
    return "miss" if not met else "all" if met == len(slug) else "some"


def terms(tokens: list[str], told: bool, title: str, size: int) -> list[str]:
    """What is weighed of a segment: words, pairs of words, and the evidence that is no word (after '=')."""
    w = ["0" if t[0].isdigit() else t for t in tokens] if any(map(str.isdigit, tokens)) else tokens
    return [*w, *[f"{a} {b}" for a, b in zip(w, w[1:])], "=told" if told else "=used", f"=title-{title}", f"=size{min(size, 511).bit_length()}"]


def fingerprint(segment: str) -> str:
    """Lower-case words without digits and without the capitalised names inside a line."""
    line = segment.split()
    return " ".join(WORD.findall(" ".join(w for i, w in enumerate(line) if i == 0 or not w[:1].isupper() or segment.isupper()).lower()))


def read(title: object, text: str, density: float):
    """Of a document: (slots, forms, fillers), words, the title's agreement, and its segments as (text, tokens, told, seed,
    mark). Only a segment with system speech can tell about it."""
    slots = forms = 0
    parts, words = [], []
    absent = any(x in text for x in ABSENT_PARTS)
    for s in segments(text):
        a, b = marks(s, absent)
        slots, forms = slots + a, forms + b
        tokens = TOKEN.findall(s.lower())
        n, k, bits = speech(s, tokens)
        told = k > 0 and TELLS.search(s) is not None
        parts.append((s, tokens, told, not told and seeded(n, k, bits, density), a + b > 0))
        words += tokens if n == len(tokens) else [t for t in tokens if not t[0].isdigit()]
    return (slots, forms, int(filler(BLANKS.sub(" ", unmarked(text)), words))), words, agreement(title, set(words)), parts


def fit(docs: DataFrame, p: Parameters = Parameters()) -> odds.Odds:
    """The log odds of terms in residue, from seeds and from what stands beside seeds in short responses."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "title", "text")
    sample = odds.sampled(texts, F.col("doc_id"), p.fit_docs, texts.count())

    def labelled(b: pd.DataFrame):
        for title, text in zip(b["title"], b["text"]):
            if not text.strip():
                continue
            _, words, agrees, parts = read(title, text, p.density)
            response = len(words) <= p.response and any(seed for *_, seed, _ in parts)
            for _, tokens, told, seed, mark in parts:
                if tokens and not mark:
                    yield terms(tokens, told, agrees, len(words)), 1.0 if seed or response and not told else 0.0

    return odds.fit(sample, labelled)


FEATURES = "doc_id long, source string, slots int, forms int, fillers int, seeds int, n_words int, title string, prints array<struct<print: long, odds: double>>"


def features(docs: DataFrame, model: odds.Odds, p: Parameters = Parameters()) -> DataFrame:
    """Per document: marks, seeds, size, how the title agrees, and fingerprints and odds of the segments that hosts can
    still raise or lower over the line."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        known = shared.value
        for b in batches:
            rows = []
            for doc, source, title, text in zip(b["doc_id"], b["source"], b["title"], b["text"]):
                if not isinstance(text, str) or not text.strip():
                    continue
                direct, words, agrees, parts = read(title, text, p.density)
                seeds, prints = 0, {}
                for s, tokens, told, seed, _ in parts:
                    if not tokens:
                        continue
                    seeds += seed
                    weight = known.of(terms(tokens, told, agrees, len(words))) + (p.seed_bonus if seed else 0.0)
                    if weight >= -p.lift:
                        key = xxhash.xxh64_intdigest(fingerprint(s)) - (1 << 63)
                        prints[key] = max(prints.get(key, weight), weight)
                rows.append((doc, source, *direct, seeds, len(words), agrees, [{"print": k, "odds": w} for k, w in prints.items()]))
            yield pd.DataFrame(rows, columns=["doc_id", "source", "slots", "forms", "fillers", "seeds", "n_words", "title", "prints"])

    return docs.where("doc_id is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "title", "text").mapInPandas(run, FEATURES)


def hosts(parts: DataFrame, lift: float) -> DataFrame:
    """Per fingerprint of two copies or more: copies, hosts, copies beside residue, and what they add to the odds.
    Counted per host first, so a fingerprint that is in a third of all documents costs a row per host and task."""
    per = parts.groupBy("print", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("int")).alias("bad"))
    per = per.groupBy("print").agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("n_hosts"), F.sum("bad").alias("bad")).where("copies > 1")
    beside = F.log((F.col("bad") + 0.5) / (F.col("copies") - F.col("bad") + 0.5))
    spread = F.log(F.col("n_hosts").cast("double")) * F.signum(beside)
    return per.withColumn("lift", F.greatest(F.lit(-lift), F.least(F.lit(lift), beside + spread)))


def score(docs: DataFrame, p: Parameters = Parameters(), salts: int = 16) -> DataFrame:
    """doc_id, source, evidence counts, odds without and with the hosts, and ``flagged``."""
    scratch = Scratch(docs.sparkSession)
    f = scratch.save(features(docs, fit(docs, p), p))
    direct = (F.col("slots") + F.col("forms") + F.col("fillers")) > 0
    parts = f.select("doc_id", "source", (direct | (F.col("seeds") > 0)).alias("bad"), F.explode("prints").alias("p")).select("doc_id", "source", "bad", "p.print", "p.odds")
    table = hosts(parts, p.lift).select("print", "lift", "copies", "n_hosts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(table, ["print", "salt"], "left")
    weighed = met.groupBy("doc_id").agg(
        F.max("odds").alias("odds"), F.max(F.col("odds") + F.coalesce("lift", F.lit(0.0))).alias("odds_hosts"), F.max(F.coalesce("copies", F.lit(1))).cast("long").alias("copies"), F.max(F.coalesce("n_hosts", F.lit(1))).cast("long").alias("n_hosts"),
    )
    out = f.drop("prints").join(weighed, "doc_id", "left")
    return out.withColumn("copies", F.coalesce("copies", F.lit(1).cast("long"))).withColumn("n_hosts", F.coalesce("n_hosts", F.lit(1).cast("long"))).withColumn("flagged", direct | F.coalesce(F.col("odds_hosts") >= 0, F.lit(False)))


def found(docs: DataFrame) -> DataFrame:
    return score(docs).where("flagged").select("doc_id").distinct()


def clean(docs: DataFrame) -> DataFrame:
    """The documents without the flagged ones."""
    return docs.join(found(docs), "doc_id", "left_anti")


def rates(docs: DataFrame) -> DataFrame:
    s = score(docs)
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("flagged").cast("int")).alias("n_flagged"), F.avg(F.col("flagged").cast("int")).alias("rate"))

"""Personal information inside free text: bootstrapped contextual extraction.

1. Every text is read once; spans that could be an e-mail address, phone, identity number, street address or name
   come out as candidates, each with what stands left and right of it (its patterns) and its instance: the shape of
   a number or address, the parts of a name. Unmistakable spans are seeds, for or against.
2. Spark scores the graph of patterns and instances in turns: a pattern is as good as its instances, an instance
   as its patterns; seeds keep their worth. Counts are smoothed, so rare patterns weigh little.
3. High-confidence patterns discover what no rule proposes. Numbers of unknown form are taken where their left context
   is sure of a kind. Patterns and the name parts they taught go back over the texts, through two bit tables (Bloom
   filters of 16 bits a row, at most 32 MB), and find names written small, in capitals, or misspelt. What the bit tables
   let through is joined exactly with the scores, word by word.
4. Spans whose pattern or instance is good enough are personal information; ``redact`` puts placeholders there.

Defined results: null and blank texts hold nothing; rows of one post count together; a handle, a title alone, a
school or place, an order, batch or parcel number and a sum of money are none; of overlapping spans the longer
counts; null ids are ignored in ``found``; empty tables give empty results. Whole texts are read; only the named
columns are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benang.functions.ids import filled_id
from benang.session import Scratch

KINDS = ["email", "phone", "id_number", "street_address", "person_name"]
#: same length as the text, so that spans stay valid: full-width forms, typographic quotes
WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0x00A0: 0x20, 0x2019: 0x27, 0x2018: 0x27}

EMAIL = re.compile(
    r"(?<![\w.+-])[a-z0-9][\w.+-]*(?:\s{1,3}@\s{1,3}|@|\s?(?:\(at\)|\[at\]|\{at\})\s?|\s{1,3}(?:at|et)\s{1,3})[a-z0-9][\w-]*(?:(?:\.|\s{1,3}\.\s{1,3}|\s?(?:\(dot\)|\[dot\])\s?|\s{1,3}(?:dot|titik)\s{1,3})[a-z][\w-]*)+", re.I
)
_S = r"(?: {1,3}|[.-])"
ID = re.compile(rf"(?<![\d/])(?:\d{{16}}|\d{{4}}({_S})\d{{4}}\1\d{{4}}\1\d{{4}}|\d{{6}}({_S})\d{{6}}\2\d{{4}}|\d{{6}}{_S}\d{{10}})(?![\d/])")
PHONE = re.compile(rf"(?<![\w/.-])(?:\+?62{_S}?(?=[2-9])|\(?[0o](?=[1-9]\d))\d{{2,4}}\)?(?:{_S}?\d{{2,9}}){{1,4}}(?![\w/])", re.I)
#: any run of digit groups; what is neither phone nor id by its form is open, and only its context can tell
NUMBER = re.compile(r"(?<![\w/.,@-])\+?\(?\d(?:[ ()./-]{0,2}\d){6,19}(?![\w/@])")
DIGIT_WORDS = {"nol": "0", "kosong": "0", "satu": "1", "dua": "2", "tiga": "3", "empat": "4", "lima": "5", "enam": "6", "tujuh": "7", "delapan": "8", "lapan": "8", "sembilan": "9"}
SPOKEN = re.compile(r"\b(?:nol|kosong)(?:[ -]{1,3}(?:" + "|".join(DIGIT_WORDS) + r")){7,14}\b", re.I)
_NUM = r"(?:(?:no|nomor|nomer|kav|kavling|blok|km|#)\.? {0,3})?[a-z]?\d{1,4}(?:/\d{1,4})?[a-z]?\b"
_RT = r"rt\.? {0,3}\d{1,3} ?[/,]? {0,3}(?:rw\.? {0,3})?\d{1,3}\b"
_STREET = r"(?:jl|jln|jalan|gg|gang|lorong|dusun|dsn|kampung|kp|perum|perumahan|komplek|kompleks|kompl|asrama|apartemen|cluster|lr)"
_NAME = r"(?:(?!(?:ke|di|dari|terus|trs|masuk|rusak|yang|yg|buat|kami|saya|no|nomor|nomer|kav|blok|km|rt|rw|sd|sdn|smpn|sman|smp|mts|tk|mi|paud|street|st|lain|itu|ini|aja|dr|kelas|murid|mrd|porsi|paket)\b)[a-z][a-z']*)"
ADDRESS = re.compile(
    rf"\b{_STREET}\b\.? {{0,3}}{_NAME}\.?(?: {{1,3}}{_NAME}\.?){{0,3}},? {{1,3}}(?:{_RT}|blok {{0,3}}[a-z]{{0,2}}\d{{0,3}} {{0,3}}(?:no\.? ?)?[/-]?\d{{1,4}}[a-z]?\b|{_NUM})(?:[ ,]+{_RT})?(?:[ ,]+(?:no|nomor)\.? {{0,3}}\d{{1,4}}[a-z]?\b)?"
    rf"|\b(?:{_NAME} {{1,3}}){{1,3}}(?:street|st|road|avenue|lane)\.? {{1,3}}(?:no\.? ?)?\d{{1,4}}[a-z]?\b"
    rf"|\brt\.? {{0,3}}\d{{1,3}} ?[/,]? {{0,3}}rw\.? {{0,3}}\d{{1,3}}\b|\brt\.? {{0,3}}\d{{1,3}} ?/ ?\d{{1,3}}\b"
)
ADDRESS_CUE = re.compile(rf"\b(?:{_STREET}|rt|street|road|avenue|lane)\b")

TITLES = frozenset("pak bu ibu bapak mbak mas bang kang teh kak om tante drs dra ir dr prof h hj ust ustadz ustaz sdr sdri tn ny haji hajah nyai gus den raden".split())
#: words that never are part of a person's name here; seeds against
STOP = frozenset(
    "yang dan di ke dari untuk dengan pada ini itu tidak ada akan oleh karena atau juga sudah saya kami kita mereka dia sebagai dalam bisa lebih hanya belum jadi kalau agar bagi soal tetapi tapi bukan masih lagi sampai sejak selama setelah sebelum sambil tanpa lewat menurut siapa mengapa apa bagaimana hari pagi siang sore malam kemarin besok"
    " guru dapur antar kades desa sekolah kelas murid wali kepala komite petugas relawan lurah bidan kader posyandu ahli gizi sopir penjaga anak adik cucu orang org tetangga mitra vendor panitia kecamatan camat bupati gubernur menteri presiden pemda dinas puskesmas balai"
    " jl jln jalan gg gang dusun perum griya komplek kompleks kampung kav blok street no nomor nomer rt rw km alamat rumah street"
    " sd sdn smp smpn sma sman smk mts mi tk paud min lapor menurutku katanya eh nah loh tadi yah duh oh btw fyi jujur serius info buat maaf halo astaga semoga ya ampun kakak min aja sih dong hehe thanks cmiiw tolong dicek pantau terus gimana nih cepat beres wkwkwk wkwk"
    " senin selasa rabu kamis jumat sabtu minggu januari februari maret april mei juni juli agustus september oktober november desember"
    " nama wali belum dapat jatah sakit kemarin selaku pegang kunci titip tinggal dekat kelas".split()
)
PLACE_BEFORE = frozenset("di ke orang org warga suku kaum pendatang penganut jemaat wong dusun desa kampung perum griya komplek jl jln jalan gang gg gg. jl. sd sdn smp smpn sman sma mts mi tk paud balai pasar kecamatan kabupaten kota".split())
PLACE_AFTER = frozenset("street blok no no. nomor kav rt rw km road".split())
#: left contexts that make what follows a name
SEED_LEFT = frozenset(["nama saya", "saya bernama", "murid bernama", "atas nama", "panggil saya", "a.n", "an"])
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?\.?|\d+|[^\w\s]")
CAP = re.compile(r"[A-Z][a-z'’]+$|[A-Z]\.$")
NAME_GAP = frozenset([","])


#: words before a number that is no person's: seeds against
NUMBER_BEFORE = frozenset("resi batch pesanan order invoice faktur kode total status urut absen rekening barcode seri".split())


#: begins the instance of a form no rule knows
OPEN = "?"


def digits_of(s: str) -> str:
    return "".join(c for c in s.lower().replace("o", "0") if c.isdigit())


def left_words(low: str, at: int) -> list[str]:
    return re.findall(r"[a-z.@]+[a-z@.]*|\d+", low[max(0, at - 40):at].rsplit("\n", 1)[-1])[-2:]


def right_word(low: str, at: int) -> str:
    m = re.match(r"\W*([a-z]+)", low[at:at + 20])
    return m.group(1) if m else ""


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with signs that are no word in place of spans."""
    for a, b in spans:
        text = text[:a] + "\x02" * (b - a) + text[b:]
    return text


def trim_phone(span: str) -> str | None:
    """The leading groups of a number that make a phone number of 9 to 14 digits."""
    groups = list(re.finditer(r"\d+", span.replace("o", "0").replace("O", "0")))
    total, end = 0, None
    for g in groups:
        n = len(g.group())
        if total >= 9 and (total + n > 13 or span[groups[0].start()] == "("):
            break
        total += n
        end = g.end()
    return span[:end] if end and 9 <= total <= 14 else None


def number_candidates(text: str, low: str) -> list[tuple]:
    """(kind, start, end, instance, prior) of e-mails, ids, phones. prior: 1 seed for, 0 seed against, nan open."""
    out: list[tuple] = []
    taken: list[tuple[int, int]] = []
    if "@" in low or "(at" in low or "[at" in low or " at " in low or " et " in low:
        for m in EMAIL.finditer(text):
            s = m.group()
            plain = "@" in s and " " not in s
            if " at " in s.lower() and not re.search(r"dot|titik|\.", s, re.I):
                continue
            out.append(("email", m.start(), m.end(), "plain" if plain else "veiled", 1.0 if plain else float("nan")))
            taken.append(m.span())
    if any(c.isdigit() for c in low):
        for m in ID.finditer(low):
            d = digits_of(m.group())
            day, month = int(d[6:8]) % 40, int(d[8:10])
            ok = 1 <= day <= 31 and 1 <= month <= 12
            other = not NUMBER_BEFORE.isdisjoint(left_words(low, m.start())[-1:])
            out.append(("id_number", m.start(), m.end(), ("dated" if ok else "undated") + ("_grouped" if not m.group().isdigit() else ""), 0.0 if other else 1.0 if ok else float("nan")))
            taken.append(m.span())
        for m in PHONE.finditer(masked(low, taken)):
            s = trim_phone(m.group())
            if s is None:
                continue
            d = digits_of(s)
            d = "0" + d[2:] if d.startswith("62") else d
            mobile = d.startswith("08") and len(d) >= 10
            other = not NUMBER_BEFORE.isdisjoint(left_words(low, m.start())[-1:])
            prior = 0.0 if other else 1.0 if mobile or s[0] in "(+" else float("nan")
            out.append(("phone", m.start(), m.start() + len(s), ("mobile" if mobile else "fixed") + ("_grouped" if not s.isdigit() else ""), prior))
            taken.append((m.start(), m.start() + len(s)))
        for m in NUMBER.finditer(masked(low, taken)):
            shape = OPEN + re.sub(r"\d+", lambda g: str(len(g.group())), m.group())
            out += [(kind, m.start(), m.end(), shape, float("nan")) for kind in ("phone", "id_number")]
    if "nol" in low or "kosong" in low:
        for m in SPOKEN.finditer(low):
            out.append(("phone", m.start(), m.end(), "spoken", 1.0))
    return out


def address_candidates(low: str) -> list[tuple]:
    out = []
    if ADDRESS_CUE.search(low):
        flat = low.replace("\n", "\x01")
        for m in ADDRESS.finditer(flat):
            s = m.group()
            head = s.split(" ", 1)[0].strip(".")
            kind = "street" if re.search(r"street|road|avenue|lane", s) else "rt" if head.startswith("rt") else head
            exact = bool(re.search(r"\bno\b|nomor|kav|blok|rt", s))
            out.append(("street_address", m.start(), m.end(), f"{kind}:{'exact' if exact else 'bare'}", 1.0 if exact or kind == "street" else float("nan")))
    return out


def tokens_of(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer(text)]


def name_runs(text: str, tokens: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of capitalised tokens (token ranges) in texts that are not written in capitals throughout."""
    runs, i, n = [], 0, len(tokens)
    while i < n:
        if CAP.match(tokens[i][0]) and tokens[i][0].rstrip(".").lower() not in STOP and tokens[i][0].rstrip(".").lower() not in TITLES:
            j = i + 1
            while j < n and CAP.match(tokens[j][0]) and tokens[j][0].rstrip(".").lower() not in STOP and "\n" not in text[tokens[j - 1][2]:tokens[j][1]]:
                j += 1
            if j - i >= 2:
                runs.append((i, j))
            i = j
        else:
            i += 1
    return runs


def name_pattern(tokens: list[tuple[str, int, int]], i: int) -> tuple[str, str]:
    """Left patterns of the name that begins at token i: the last two words, and the last one."""
    words = [t[0].lower().rstrip(".") for t in tokens[max(0, i - 5):i] if t[0][0].isalnum() or t[0] in ":,@"]
    k = len(words)
    while k and words[k - 1] in TITLES:
        k -= 1
    titled = k < len(words)
    two = [w for w in words[:k] if w not in ":,@"][-2:]
    return ("T:" if titled else "") + " ".join(two), "title" if titled else ""


def name_candidates(text: str) -> list[tuple]:
    """(start, end, parts, left pattern, right pattern, prior) of capitalised names."""
    out = []
    if not re.search(r"[a-z]", text) or not re.search(r"[A-Z][a-z'.]+ +[A-Z]", text):
        return out
    tokens = tokens_of(text)
    for i, j in name_runs(text, tokens):
        parts = [t[0].lower().rstrip(".") for t in tokens[i:j]]
        full = [p for p in parts if len(p) > 1]
        if not full:
            continue
        before = tokens[i - 1][0].lower() if i else ""
        after = tokens[j][0].lower() if j < len(tokens) else ""
        left, titled = name_pattern(tokens, i)
        prior = float("nan")
        if before.rstrip(".") in PLACE_BEFORE or after.rstrip(".") in PLACE_AFTER or (before == "@"):
            prior = 0.0
        elif titled or left in SEED_LEFT:
            prior = 1.0
        out.append((tokens[i][1], tokens[j - 1][2], " ".join(parts), left, after, prior))
    return out


CANDIDATES = "row long, tweet_id string, kind string, s int, e int, instance string, left string, right string, prior double"


def candidates(rows: DataFrame) -> DataFrame:
    """All spans that rules propose, from (row, tweet_id, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, tweet, text in zip(b["row"], b["tweet_id"], b["text"]):
                if not isinstance(text, str):
                    continue
                if not text.isascii():
                    text = text.translate(WIDE)
                low = lower_same(text)
                for kind, s, e, inst, prior in number_candidates(text, low) + address_candidates(low):
                    out.append((row, tweet, kind, s, e, inst, " ".join(left_words(low, s)), right_word(low, e), prior))
                for s, e, parts, left, right, prior in name_candidates(text):
                    out.append((row, tweet, "person_name", s, e, parts, left, right, prior))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    return rows.mapInPandas(run, CANDIDATES)


def lower_same(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def edges(cands: DataFrame) -> DataFrame:
    """Pattern-instance edges with counts and seed sums: a name gives one edge per part and pattern."""
    parts = F.when(F.col("kind") == "person_name", F.filter(F.split("instance", " "), lambda x: F.length(x) > 1)).otherwise(F.array("instance"))
    last = F.concat(F.when(F.col("left").startswith("T:"), F.lit("T:")).otherwise(F.lit("")), F.element_at(F.split("left", " "), -1))
    patterns = F.array(F.concat(F.lit("L:"), "left"), F.concat(F.lit("l:"), last), F.concat(F.lit("R:"), "right"))
    seed = F.when(~F.isnan("prior"), F.col("prior"))
    flat = cands.select("kind", F.explode(parts).alias("instance"), patterns.alias("ps"), seed.alias("seed")).select("kind", "instance", F.explode("ps").alias("pattern"), "seed").where("length(pattern) > 2")
    return flat.groupBy("kind", "instance", "pattern").agg(F.count(F.lit(1)).alias("n"), F.count("seed").alias("seeded"), F.coalesce(F.sum("seed"), F.lit(0.0)).alias("good"))


def bootstrap(edge: DataFrame, scratch: Scratch, rounds: int = 3, smooth: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) with scores. A round scores patterns by their instances, then instances by their seeds
    and patterns. What has no evidence yet weighs nothing (``trust``), so seeds spread without being watered down."""
    seeds = edge.groupBy("kind", "instance").agg(F.sum("seeded").alias("seeded"), F.sum("good").alias("good"), F.sum("n").alias("n"))
    seeds = scratch.save(seeds)
    score = lambda good, all_: ((good + smooth * 0.5) / (all_ + smooth)).alias("score")
    trust = lambda all_: (all_ / (all_ + smooth)).alias("trust")
    inst = seeds.select("kind", "instance", "n", score(F.col("good"), F.col("seeded")), trust(F.col("seeded")))
    patterns = None
    for _ in range(rounds):
        known = edge.join(inst.select("kind", "instance", "score", "trust"), ["kind", "instance"])
        open_n = F.col("n") - F.col("seeded")
        patterns = known.groupBy("kind", "pattern").agg(
            F.sum(open_n * F.col("trust") * F.col("score") + F.col("good")).alias("good"), F.sum(open_n * F.col("trust") + F.col("seeded")).alias("all"), F.sum("n").alias("n"),
        )
        patterns = scratch.save(patterns.select("kind", "pattern", "n", score(F.col("good"), F.col("all")), trust(F.col("all"))))
        met = edge.join(patterns.select("kind", "pattern", "score", "trust"), ["kind", "pattern"]).groupBy("kind", "instance").agg(
            F.sum(F.col("n") * F.col("trust") * F.col("score")).alias("told"), F.sum(F.col("n") * F.col("trust")).alias("all"),
        )
        both = seeds.join(met, ["kind", "instance"])
        inst = scratch.save(both.select("kind", "instance", "n", score(F.col("good") * 3 + F.col("told"), F.col("seeded") * 3 + F.col("all")), trust(F.col("seeded") + F.col("all"))))
    return patterns, inst


CHUNK = 19


def bit_table(df: DataFrame, column: str, per_row: int = 16, least: int = 18, most: int = 28) -> bytes:
    """A bit table of the crc32 of a column, sized by its count: ``per_row`` bits a row, 2**18 to 2**28 bits (32 MB).
    Bits are set on the executors in chunks of 64 KB; the driver gets the finished table only."""
    df = df.select(F.crc32(F.encode(F.col(column).cast("string"), "utf-8")).alias("h")).distinct()
    size = min(most, max(least, (per_row * max(1, df.count()) - 1).bit_length()))
    bits = df.select((F.col("h") % F.lit(1 << size)).alias("bit")).distinct().withColumn("chunk", F.shiftright("bit", CHUNK).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << min(size, CHUNK), bool)
        on[pdf["bit"].to_numpy(np.int64) & ((1 << CHUNK) - 1)] = True
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    out = bytearray(1 << (size - 3))
    width = 1 << (min(size, CHUNK) - 3)
    for r in bits.groupBy("chunk").applyInPandas(pack, "chunk int, bits binary").toLocalIterator():
        out[r["chunk"] * width:(r["chunk"] + 1) * width] = r["bits"]
    return bytes(out)


def held(table: bytes, word: str) -> bool:
    h = zlib.crc32(word.encode()) & (len(table) * 8 - 1)
    return bool(table[h >> 3] >> (h & 7) & 1)


FOUND = "row long, tweet_id string, s int, e int, parts array<string>, starts array<int>, ends array<int>, left string"


def discover(rows: DataFrame, names: bytes, lefts: bytes) -> DataFrame:
    """Runs of words that may be known name parts, or that follow a good pattern, however written; with the places of
    the words, since a word the bit table lets through by chance is taken out again by the exact check."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, bool] = {}

        def part(w: str) -> bool:
            if w not in cache:
                if len(cache) > 500_000:
                    cache.clear()
                cache[w] = len(w) > 2 and w not in STOP and w not in TITLES and held(names, w)
            return cache[w]

        for b in batches:
            out = []
            for row, tweet, text in zip(b["row"], b["tweet_id"], b["text"]):
                if not isinstance(text, str):
                    continue
                if not text.isascii():
                    text = text.translate(WIDE)
                low = lower_same(text)
                if "@" in low or "(at" in low or "[at" in low or " at " in low or " et " in low:
                    low = masked(low, [m.span() for m in EMAIL.finditer(low)])
                if not any(part(w) for w in low.replace(",", " ").replace(".", " ").split()):
                    continue
                tokens = tokens_of(low)
                n, i = len(tokens), 0
                while i < n:
                    if not part(tokens[i][0].rstrip(".")):
                        i += 1
                        continue
                    a = i
                    # an initial or a misspelt first name before, when a good pattern stands left of it
                    if a and tokens[a - 1][0][:-1].isalpha() and len(tokens[a - 1][0]) == 2 and tokens[a - 1][0].endswith("."):
                        a -= 1
                    j = i + 1
                    while j < n and "\n" not in low[tokens[j - 1][2]:tokens[j][1]]:
                        w = tokens[j][0]
                        if part(w.rstrip(".")) or (len(w) == 2 and w.endswith(".") and w[0].isalpha()):
                            j += 1
                            if w.endswith(".") and len(w) > 2:
                                break
                        elif w == "," and j + 1 < n and part(tokens[j + 1][0].rstrip(".")):
                            j += 2
                        else:
                            break
                    words = [t[0].rstrip(".") for t in tokens[a:j] if t[0] != ","]
                    left = name_pattern(tokens, a)[0]
                    if len(words) == 1:
                        # one known part: its neighbour may be an unseen one, if the pattern left of the pair is good
                        for x, y in ((a - 1, j), (a, j + 1)):
                            other = x if x < a else j
                            if 0 <= x and y <= n and tokens[other][0].isalpha() and len(tokens[other][0]) > 3 and tokens[other][0] not in STOP and tokens[other][0] not in TITLES and "\n" not in low[tokens[x][1]:tokens[y - 1][2]]:
                                l2 = name_pattern(tokens, x)[0]
                                if held(lefts, "L:" + l2):
                                    out.append((row, tweet, tokens[x][1], tokens[y - 1][2], [t[0].rstrip(".") for t in tokens[x:y]], [t[1] for t in tokens[x:y]], [t[2] for t in tokens[x:y]], l2))
                                    break
                    elif a == 0 or tokens[a - 1][0] != "@":
                        kept = [t for t in tokens[a:j] if t[0] != ","]
                        ends = [t[2] - (t[0].endswith(".") and len(t[0]) > 2) for t in kept]
                        out.append((row, tweet, tokens[a][1], ends[-1], words, [t[1] for t in kept], ends, left))
                    i = j
            yield pd.DataFrame(out, columns=["row", "tweet_id", "s", "e", "parts", "starts", "ends", "left"])

    return rows.mapInPandas(run, FOUND)


def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The names in runs of words, of which each is known or not."""
    for b in batches:
        out = []
        for row, tweet, parts, starts, ends, lead, known in zip(b["row"], b["tweet_id"], b["parts"], b["starts"], b["ends"], b["lead"], b["known"]):
            n, i = len(parts), 0
            if lead and n >= 2 and any(known):
                out.append((row, tweet, starts[0], ends[-1]))
                continue
            while i < n:
                j = i
                while j < n and (known[j] or len(parts[j]) == 1):
                    j += 1
                if j - i >= 2 and any(known[k] for k in range(i, j)):
                    out.append((row, tweet, starts[i], ends[j - 1]))
                i = max(j, i + 1)
        yield pd.DataFrame(out, columns=["row", "tweet_id", "s", "e"])


def rows_of(threads: DataFrame) -> DataFrame:
    """(row, tweet_id, text); the row number only ties spans to their text within one run."""
    return threads.select(F.monotonically_increasing_id().alias("row"), filled_id(F.col("tweet_id")).alias("tweet_id"), F.col("teks_komentar").alias("text"))


def spans(rows: DataFrame, scratch: Scratch, good: float = 0.5, part_good: float = 0.6) -> DataFrame:
    """row, tweet_id, kind, s, e: the spans that hold personal information."""
    cands = scratch.save(candidates(rows))
    edge = scratch.save(edges(cands))
    patterns, inst = bootstrap(edge, scratch)

    def side(code: str, key: str, name: str, df: DataFrame) -> DataFrame:
        return df.where(F.col("pattern").startswith(code)).select("kind", F.substring("pattern", 3, 1000).alias(key), F.col("score").alias(name), F.when(F.col("n") >= 3, F.col("trust")).otherwise(F.lit(0.0)).alias(name + "t"))

    numbers = cands.where(F.col("kind") != "person_name").withColumn("last", F.element_at(F.split("left", " "), -1))
    pats = scratch.save(patterns.where(F.col("kind") != "person_name"))
    for code, key, name in (("L:", "left", "l2"), ("l:", "last", "l1"), ("R:", "right", "r")):
        numbers = numbers.join(side(code, key, name, pats), ["kind", key], "left")
    numbers = numbers.join(inst.where(F.col("kind") != "person_name").select("kind", "instance", F.col("score").alias("i")), ["kind", "instance"], "left")
    # patterns weigh with the evidence they have; the rest of the weight is the shape's
    evidence = F.lit(0.0)
    weight = F.lit(0.0)
    for name, w in (("l2", 2.0), ("l1", 1.0), ("r", 0.5)):
        part = F.coalesce(F.col(name + "t"), F.lit(0.0)) * w
        weight, evidence = weight + part, evidence + part * F.coalesce(name, F.lit(0.0))
    mean = (evidence + F.coalesce("i", F.lit(0.5))) / (weight + 1.0)
    # a form no rule knows needs a left context that is sure by itself, and surer for this kind than for the other
    is_open = F.col("instance").startswith(OPEN)
    sure = (F.coalesce("l2", F.lit(0.0)) >= 0.8) & (F.coalesce("l2t", F.lit(0.0)) >= 0.75)
    ok = F.when(is_open, sure).when(F.col("prior") == 1.0, F.coalesce("l2", F.lit(1.0)) >= 0.2).when(F.col("prior") == 0.0, F.lit(False)).otherwise(mean >= good)
    accepted = numbers.where(ok).select("row", "tweet_id", "kind", "s", "e")
    parts = scratch.save(inst.where((F.col("kind") == "person_name") & (F.col("score") >= part_good)).select(F.col("instance").alias("part"), F.col("score")))
    lefts = scratch.save(patterns.where((F.col("kind") == "person_name") & F.col("pattern").startswith("L:") & (F.col("score") >= 0.8) & (F.col("n") >= 4)).select("pattern"))
    seen = scratch.save(discover(rows, bit_table(parts, "part"), bit_table(lefts, "pattern")))
    # exact check of what the bit tables let through: of every run the stretches of known parts and initials with at
    # least two words of which one is no initial, or one known part under a good pattern
    each = seen.select("row", "s", F.posexplode("parts").alias("pos", "part"))
    flags = each.join(parts, "part", "left").groupBy("row", "s").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("score").isNotNull().alias("known")))).alias("f"))
    lead = seen.withColumn("pattern", F.concat(F.lit("L:"), "left")).join(lefts.withColumn("lead", F.lit(True)), "pattern", "left")
    names = lead.join(flags, ["row", "s"]).select("row", "tweet_id", "parts", "starts", "ends", F.coalesce("lead", F.lit(False)).alias("lead"), F.col("f.known").alias("known")).mapInPandas(stretches, "row long, tweet_id string, s int, e int")
    strong = cands.where((F.col("kind") == "person_name") & (F.col("prior") == 1.0))
    return accepted.unionByName(names.select("row", "tweet_id", F.lit("person_name").alias("kind"), "s", "e")).unionByName(strong.select("row", "tweet_id", "kind", "s", "e"))


def found(threads: DataFrame) -> DataFrame:
    scratch = Scratch(threads.sparkSession)
    return spans(rows_of(threads), scratch).where("tweet_id is not null").select("tweet_id", "kind").distinct()


PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}


def redact_text(text: str, marks: list[tuple[int, int, str]]) -> str:
    """Placeholders for spans; of overlapping ones the longer counts."""
    kept: list[tuple[int, int, str]] = []
    for s, e, k in sorted(marks, key=lambda m: (m[0] - m[1], m[0])):
        if all(e <= a or s >= b for a, b, _ in kept):
            kept.append((s, e, k))
    for s, e, k in sorted(kept, reverse=True):
        text = text[:s] + PLACEHOLDERS[k] + text[e:]
    return text


def redact(threads: DataFrame) -> DataFrame:
    """tweet_id, text, redacted, n_spans of every row of threads. Rows that a bit table of the marked row numbers rules
    out go straight through; only the others are shuffled to meet their marks."""
    scratch = Scratch(threads.sparkSession)
    rows = scratch.save(rows_of(threads))
    marks = scratch.save(spans(rows, scratch).groupBy("row").agg(F.collect_set(F.struct("s", "e", "kind")).alias("marks")))
    shared = threads.sparkSession.sparkContext.broadcast(bit_table(marks, "row"))

    @F.pandas_udf("boolean")
    def maybe(row: pd.Series) -> pd.Series:
        table = shared.value
        return row.map(lambda r: held(table, str(r)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [t if not isinstance(t, str) or m is None else redact_text(t, [(x["s"], x["e"], x["kind"]) for x in m]) for t, m in zip(b["text"], b["marks"])]
            yield pd.DataFrame({"tweet_id": b["tweet_id"], "text": b["text"], "redacted": made, "n_spans": [0 if m is None else len(m) for m in b["marks"]]})

    tagged = rows.withColumn("maybe", maybe("row"))
    met = tagged.where("maybe").join(marks, "row", "left").select("tweet_id", "text", "marks").mapInPandas(run, "tweet_id string, text string, redacted string, n_spans int")
    return met.unionByName(tagged.where("not maybe").select("tweet_id", "text", F.col("text").alias("redacted"), F.lit(0).alias("n_spans")))

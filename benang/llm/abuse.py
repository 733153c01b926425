"""Abusive, hateful or sexual content: boosted trees over dense features, isotonically calibrated.

Features per text: densities of the lexicons (insults, words with a harmless sense too, violence, sexual words,
dehumanising and degrading words), of hits that are only quoted or objected to and of harmless senses; nearness of the
second person to such words; shares of capitals and punctuation; rate of obfuscated words; length; and the greatest log
odds of its parts (between commas and clause ends), and of runs of words in them.

No table says what is abusive, so labels are weak: a clause is a seed where lexicon words meet in a telling way (an
insult; violence and a person spoken to; a group and a dehumanising word; ...). Three disjoint parts of a bounded sample
(``Parameters``), taken by hash, serve in turn: on the first the log odds of words and pairs of words are fitted to
the seeds, on the second the trees are fitted, on the third they are calibrated. The odds see every word of a clause, the
seeds only listed ones, so what is said like a seed scores like one although no list holds it, and a listed word in
harmless company does not. Every row is scored.

Defined results: null and blank texts score as texts without any hit; rows of one post are scored apart and a post
counts with its greatest score; where a part of the sample lacks a label no trees can be fitted and the weak label is
the score; null ids are ignored in ``found``; empty tables give empty results. Whole texts are
read; only the named columns are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benang.functions.ids import filled_id
from benang.llm import odds
from benang.session import Scratch


@dataclass(frozen=True)
class Parameters:
    """word_rows bounds the rows the log odds are fitted on, sample_rows those for the trees and for the calibration, each."""

    word_rows: int = 100_000
    sample_rows: int = 40_000
    trees: int = 16
    depth: int = 4
    threshold: float = 0.5


INSULTS = frozenset(
    "goblok tolol bego dungu idiot brengsek bangsat bajingan kampret keparat sontoloyo pecundang sinting imbecile dumbass moron scumbag"
    " kunyuk jancuk geblek biadab bejat laknat lonte jablay bangke asshole bastard bitch retard stupid cunt fucker goblog ndasmu ndhasmu pekok"
    " gendheng jancok bedebah tengik bangsad anjrit kontol memek ngentot".split()
)
#: insults that also have a harmless sense
DOUBLE = frozenset("sampah monyet anjing babi pig tai udang kerbau bodoh gila rat rats dog".split())
HARMLESS = frozenset(
    "bekas menumpuk hutan liar bebas ayam pupuk buang bak plastik organik kandang ternak daging kebun kompos angkut pengangkut tempat truk dipilah rebus goreng balado bakar amat enak nagih halal guling panggang kambing sapi".split()
)
SECOND = frozenset("lo lu loe kamu kau elu kowe maneh kalian anda mu you your sampeyan ente elo situ lho".split())
SLANG = {
    "yg": "yang", "yng": "yang", "sm": "sama", "ama": "sama", "aja": "saja", "aj": "saja", "gak": "tidak", "ga": "tidak", "nggak": "tidak", "enggak": "tidak", "tdk": "tidak", "gk": "tidak", "tak": "tak",
    "org": "orang", "smua": "semua", "smp": "sampai", "nyampe": "sampai", "udah": "sudah", "dah": "sudah", "sdh": "sudah", "dr": "dari", "trs": "terus", "br": "baru", "mkn": "makan", "maem": "makan", "ank": "anak",
    "tpi": "tapi", "tp": "tapi", "lu": "lo", "loe": "lo", "elu": "lo", "elo": "lo", "gua": "gue", "gw": "gue", "gwe": "gue", "klo": "kalau", "kl": "kalau", "kalo": "kalau", "dgn": "dengan", "dg": "dengan", "cm": "cuma", "cuman": "cuma", "kpl": "kepala", "msh": "masih", "jgn": "jangan", "dpr": "dapur", "tau": "tahu",
}
#: who speaks, and groups of people
FIRST = frozenset("gue gua gw gwe aku ane tak i".split())
GROUP = frozenset("kaum suku ras orang penganut jemaat pendatang perantau wong warga umat etnis agama bangsa those people they them mereka semua".split())
#: doing harm and wishing it
VIOLENCE = frozenset(
    "bakar bacok bunuh hajar gebuk tusuk cekik tembak injak habisi gantung digantung bantai gorok tampar tonjok duel bonyok rontok preman racun mati mampus mampusin kelindas tabrak lompat bleach kill die hurt break hang stab shoot beat burn"
    " modar pateni lindas hidup nyari nyenyak celaka legs jembatan alun".split()
)
SEXUAL = frozenset(
    "bugil telanjang vcs sange sangek crot ngentot entot bokep mesum cabul porno porn nude nudes naked ranjang remas ditunggangi montok onlyfans cam cams girls sexy seksi hot horny coli ngocok memek kontol toket tetek payudara ngamar pijat plus-plus plus baju bajunya buka impoten"
    " tidur semalam janda om tante sensor lonte jablay clothes sex seks boobs dick cock pussy suck ranjangmu goyang desah desahan dewasa".split()
)
DEHUMAN = frozenset(
    "parasit hama kutu vermin cockroach cockroaches kecoa najis haram budak punah usir pulangin pulangkan bersihkan ludahi sewakan jijik kotor malas busuk busuknya penipu rusuh pantesan breed send manusia rugi pantas maling subhuman"
    " animals darahnya kitchens isinya tangan dasarnya".split()
)
DEGRADE = frozenset(
    "otak otaknya mulut mulutmu mulutnya muka mukamu bangkai comberan jerami dengkul eneg jijik iq kolam sekolam talenan karung kaca cacat jilat nyesel ngelahirin ibumu bapakmu turunan maling penipu becus dipelihara worthless disgusting pathetic"
    " useless cry tebal cih najis enyah enyahlah sialan shut".split()
)
#: words that tell by themselves, the second beside a group of people
EXPLICIT = frozenset("bugil ngentot entot bokep vcs sange sangek crot porn porno nude nudes onlyfans ngocok memek kontol pengentot".split())
HARSH = frozenset("parasit vermin budak ludahi sewakan punah pulangin jijik najis haram subhuman penipu".split())
#: expressions of two words, with the lexicon they count for
EXPRESSIONS = {
    **dict.fromkeys(["awas kalau", "minum racun", "drink bleach", "kirim preman", "tinggal nama", "sini duel", "lo mati", "mending mati", "kill yourself", "rumah lo", "bakar sekalian", "sekalian orangnya", "perlu digantung", "tunggu waktu", "tak bacok"], "violence"),
    **dict.fromkeys(["tanpa baju", "teman tidur", "remas dada", "buka baju", "buka bajunya", "no clothes", "plus plus", "om di", "temani om", "sama gue", "sini sama", "janda muda", "bodi tante", "adegan ranjang"], "sexual"),
    **dict.fromkeys(["bukan manusia", "bersihkan kampung", "jangan sewakan", "kasih makan", "dari lahir", "punah juga", "send them", "in our", "usir semua", "isinya orang"], "dehuman"),
    **dict.fromkeys(["otak udang", "otak kosong", "punya otak", "otaknya cuma", "bau bangkai", "isi kepala", "punya akun", "keturunan maling", "bikin eneg", "muka tebal", "makan tuh", "lahir dari", "waste of", "tak berguna", "tidak berguna", "cry somewhere", "tukang jilat", "jilat terus"], "degrade"),
}
LEXICONS = {"insult": INSULTS, "double": DOUBLE, "violence": VIOLENCE, "sexual": SEXUAL, "dehuman": DEHUMAN, "degrade": DEGRADE}
OBJECTS = re.compile(r"\b(?:dihina|dikatai|jangan bilang|jangan sebut|tidak boleh sebut|boleh sebut|stop ujaran|ujaran benci|melukai|laporkan|keberatan|admin hapus|tidak mendidik|lawan komentar|jangan menghina|mengaku diancam|kata kasar)\b")
TOKEN = re.compile(r"[^\W_]+(?:[*@$!]+[^\W_]+|\*+)*|[\"“”,]")
SPLIT_LETTERS = re.compile(r"(?<![\w.])(?:\w[ .\-_*]){2,}\w(?!\w)")
WIDE = {0xFF01 + i: 0x21 + i for i in range(94)}
LEET = str.maketrans("4310578@$!", "aeiostbasi")
CLAUSE = re.compile(r"[;\n]| - |\.(?:\s|$)|(?<=[?!])\s")
LONG = re.compile(r"(.)\1{2,}")
PAIR = re.compile(r"(.)\1+")
VOWELS = str.maketrans("", "", "aeiou")
PLAIN = frozenset("bangsa bangsal sampai sampan samping sinting1 masing bangsawan bangka keparatan monitor brangkas".split())


def _near() -> dict[str, str]:
    out: dict[str, str] = {}
    for w in INSULTS:
        if len(w) >= 6:
            for i in range(len(w)):
                out.setdefault(w[:i] + w[i + 1:], w)
    return out


_NEAR = _near()
_LAST = {(w[:-1], len(w)): w for w in INSULTS | {"monyet"} if len(w) >= 5}
_SKELETON = {w.translate(VOWELS): w for w in INSULTS | DOUBLE if len(w.translate(VOWELS)) >= 3}
_MASKED = {len(w): [x for x in INSULTS | DOUBLE if len(x) == len(w)] for w in INSULTS | DOUBLE}


@lru_cache(maxsize=200_000)
def lexical(token: str) -> tuple[str, bool]:
    """('insult' | 'double' | 'second' | '', whether it was obfuscated) of a lower-case token; a star after a whole word
    marks one that was written letter by letter."""
    if token[-1] == "*" and (lexical(token[:-1])[0] in ("insult", "double")) and "*" not in token[:-1]:
        return "insult", True
    if token in INSULTS:
        return "insult", False
    if token in DOUBLE:
        return "double", False
    if token in SECOND:
        return "second", False
    if len(token) < 3 or token in PLAIN or token in SLANG:
        return "", False
    if "*" in token:
        for w in _MASKED.get(len(token), []):
            if all(a == b or a == "*" for a, b in zip(token, w)) and sum(a != "*" for a in token) >= 2:
                return "insult", True
        return "", False
    if not token.isalpha():
        plain = token.translate(LEET)
        if plain.isalpha() and not token.isdigit() and token[0].isalpha():
            if plain in INSULTS or plain in DOUBLE:
                return "insult", True
            kind = lexical(plain)[0] if plain != token else ""
            return (kind, True) if kind == "insult" else ("", False)
        return "", False
    squeezed = PAIR.sub(r"\1", token)
    if squeezed != token:
        if squeezed in INSULTS:
            return "insult", LONG.search(token) is None
        if squeezed in DOUBLE:
            return "double", False
    if (token[:-1], len(token)) in _LAST:
        return "insult", True
    if token in _SKELETON and not set(token) & set("aeiou"):
        return "insult", True
    if len(token) >= 6:
        if token in _NEAR and token not in PLAIN and len(token) >= 6:
            return "insult", True
        for i in range(len(token)):
            cut = token[:i] + token[i + 1:]
            if (cut in INSULTS and len(cut) >= 6) or (cut in _NEAR and _NEAR[cut][0] == token[0] and len(_NEAR[cut]) >= 7):
                return "insult", True
    return "", False

QUOTES = frozenset('"“”')
SIGN = re.compile(r"[^\w\s]|_")
CAPITAL = re.compile(r"[A-Z]")
LETTER = re.compile(r"[^\W\d_]")
NAMES = list(LEXICONS)
EXPRESSION_FIRST = frozenset(e.split()[0] for e in EXPRESSIONS)
#: every alternative of OBJECTS begins with one of these words
OBJECT_FIRST = frozenset(x.split()[0] for x in OBJECTS.pattern.removeprefix(r"\b(?:").removesuffix(r")\b").split("|"))


def _general() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for name in ("violence", "sexual", "dehuman", "degrade"):
        for w in LEXICONS[name]:
            out[w] = (*out.get(w, ()), name)
    return out


GENERAL = _general()
#: spellings with one letter left out, of the longer lexicon words
_GENERAL_NEAR = {w[:i] + w[i + 1:]: w for w in sorted(GENERAL) if len(w) >= 6 for i in range(len(w))}


@lru_cache(maxsize=200_000)
def normal(token: str) -> str:
    """A token as it is looked up: repeated letters and slang undone, a slip in a longer lexicon word put right."""
    w = LONG.sub(r"\1", token)
    w = SLANG.get(w, w)
    if w not in GENERAL and len(w) >= 5 and w.isalpha():
        near = _GENERAL_NEAR.get(w)
        if near is None and len(w) >= 6:
            near = next((x for x in (_GENERAL_NEAR.get(w[:i] + w[i + 1:]) for i in range(len(w))) if x is not None and len(x) == len(w) and sorted(x) == sorted(w)), None)
        if near is not None and near[0] == w[0]:
            return near
    return w


FEATURES = ["insult", "double", "violence", "sexual", "dehuman", "degrade", "quoted", "harmless", "near_second", "capitals", "punctuation", "obfuscated", "words", "odds", "peak"]
#: log odds of a part of a clause are kept within this; a text without clauses has the lower end
SPAN = 20.0


@dataclass
class Clause:
    """The terms of a clause's parts (between commas), which parts have hits, and what the lexicons say of it."""

    parts: list[list[str]]
    telling: list[bool]
    hits: list[int]
    seed: bool
    quoted: int
    harmless: int
    obfuscated: int
    near: float
    words: int


@lru_cache(maxsize=200_000)
def known(token: str) -> tuple[str, str, bool, tuple[int, ...], bool, bool, bool]:
    """All the lexicons say of a token: how it is looked up, what it is, whether it was hidden, the lexicons it counts
    for, and whether it is a first person, a group, the first word of an expression."""
    w = normal(token)
    kind, hidden = lexical(token)
    return w, kind, hidden, tuple(NAMES.index(n) for n in GENERAL.get(w, ())), w in FIRST, w in GROUP, w in EXPRESSION_FIRST


def reads(clause: str) -> Clause | None:
    tokens, breaks = [], [0]
    quotes = 0
    for t in TOKEN.findall(clause):
        if t == ",":
            if len(tokens) > breaks[-1]:
                breaks.append(len(tokens))
            continue
        quotes += t in QUOTES
        tokens.append(t)
    if len(tokens) == quotes:
        return None
    read = [known(t) for t in tokens]
    flat = [r[0] for r in read]
    hits = [0] * len(NAMES)
    quoted = harmless = obfuscated = strong = 0
    objects = [] if OBJECT_FIRST.isdisjoint(flat) else [m.start() for m in OBJECTS.finditer(" ".join(flat))]
    marks = [i for i, t in enumerate(tokens) if t in QUOTES] if quotes else []

    def told(i: int, reach: int) -> bool:
        """Whether the word stands in quotes or near an objection."""
        if marks and any(i - reach <= m < i for m in marks) and any(i < m <= i + reach for m in marks):
            return True
        at = len(" ".join(flat[:i])) if objects else 0
        return any(at - 45 <= o <= at + 40 for o in objects)

    terms: list[str] = []
    second, harm = [], []
    first = group = explicit = harsh = opened = False
    for i, (w, kind, hidden, names, is_first, is_group, opens) in enumerate(read):
        pair = EXPRESSIONS.get(f"{flat[i - 1]} {w}") if opened else None
        opened = opens
        if not kind and not names and not pair:
            if is_group or (w == "cucu" and i and flat[i - 1] == "anak"):
                group = True
            elif is_first:
                first = True
            elif i and read[i - 1][5] and w.isalpha():
                w = "<of>"  # the name of a group tells nothing of what is said of it
            elif w in QUOTES:
                w = '"'
            elif w.isdigit():
                w = "0"
            terms.append(w)
            continue
        if kind == "insult" or kind == "double":
            if told(i, 2):
                quoted += 1
                terms.append("<quoted>")
                continue
            harm.append(i)
            if kind == "double" and not hidden:
                hits[1] += 1
                if not (HARMLESS.isdisjoint(flat[max(0, i - 3):i] + flat[i + 1:i + 4]) and framed(flat, i)):
                    harmless += 1
                    terms.append(w)
                    continue
            hits[0] += 1
            strong += 1
            obfuscated += hidden
            terms.append("<insult>")
            continue
        group, first = group or is_group, first or is_first
        if kind == "second":
            second.append(i)
        if pair or names:
            if told(i, 3):
                quoted += 1
                terms.append("<quoted>")
                continue
            explicit, harsh = explicit or w in EXPLICIT, harsh or w in HARSH
            harm.append(i)
            for n in names:
                hits[n] += 1
            if pair:
                hits[NAMES.index(pair)] += 1
        terms.append("<you>" if kind == "second" else w)
    near = max((1.0 / (1 + min(abs(i - j) for j in second)) for i in harm), default=0.0) if second else 0.0
    person = bool(second) or first
    _, _, violence, sexual, dehuman, degrade = hits
    seed = strong > 0 or bool(harm) and not objects and (
        explicit or violence >= 2 or violence and person or sexual >= 2 or dehuman and group and (harsh or dehuman >= 2) or harsh and dehuman >= 2 or degrade >= 2 or degrade and bool(second)
    )
    ends = [*breaks[1:], len(terms)]
    parts = [[*terms[a:b], *[f"{x} {y}" for x, y in zip(terms[a:b], terms[a + 1:b])], *["=objection"] * bool(objects)] for a, b in zip(breaks, ends) if a < b]
    telling = [any(a <= i < b for i in harm) for a, b in zip(breaks, ends) if a < b] if harm else [False] * len(parts)
    return Clause(parts, telling, hits, bool(seed), quoted + len(objects), harmless, obfuscated, near, len(tokens) - quotes)


def joined(m: re.Match) -> str:
    """A word written letter by letter, put together where it is a lexicon word; what stands before it stays."""
    word = re.sub(r"[^a-z0-9]", "", m.group())
    for start in range(0, min(3, len(word))):
        if len(word) - start >= 3 and lexical(word[start:])[0] in ("insult", "double"):
            return f"{word[:start]} {word[start:]}*" if start else f"{word}*"
    return m.group()


def clauses(text: str) -> list[Clause]:
    low = (text.translate(WIDE) if not text.isascii() else text).lower()
    return [c for c in map(reads, CLAUSE.split(SPLIT_LETTERS.sub(joined, low))) if c is not None]


def weigh(model: odds.Odds, terms: list[str]) -> tuple[float, float]:
    """Log odds of a part, and the greatest of a run of its words: harmless words around do not weigh that down."""
    objected = terms[-1] == "=objection"
    n = (len(terms) - objected + 1) // 2
    get = model.weights.get
    all_ = best = run = 0.0
    for i in range(n):
        w = get(terms[i], 0.0)
        if i:
            pair = get(terms[n + i - 1], 0.0)
            all_ += w + pair
            run += w + pair
            if run < w:
                run = w
        else:
            all_ = run = w
        if run > best:
            best = run
    base = model.prior + (get(terms[-1], 0.0) if objected else 0.0)
    return max(-SPAN, min(SPAN, base + all_)), max(-SPAN, min(SPAN, base + best))


def featurize(text: object, model: odds.Odds | None = None) -> tuple[list[float], int]:
    """Features in the order of FEATURES and the weak label."""
    if not isinstance(text, str) or not text.strip():
        return [0.0] * (len(FEATURES) - 2) + [-SPAN, -SPAN], 0
    hits = [0] * len(NAMES)
    quoted = harmless = obfuscated = words = seed = 0
    near, mark, top = 0.0, -SPAN, -SPAN
    for c in clauses(text):
        words += c.words
        quoted, harmless, obfuscated, seed = quoted + c.quoted, harmless + c.harmless, obfuscated + c.obfuscated, seed or c.seed
        if any(c.hits):
            hits = [a + b for a, b in zip(hits, c.hits)]
            near = max(near, c.near)
        if model:
            for terms in c.parts:
                a, b = weigh(model, terms)
                mark, top = max(mark, a), max(top, b)
    per = 1.0 / max(1, words)
    letters = len(LETTER.findall(text)) or 1
    return [*[h * per for h in hits], quoted * per, harmless * per, near, len(CAPITAL.findall(text)) / letters, len(SIGN.findall(text)) / len(text), obfuscated * per, float(words), mark, top], int(seed)


FRAMES = frozenset("dasar lo kowe emang memang kok semua yang lebih turunan admin mah mulut jadi you such worthless what eh cih tebal piring kering kampret kayak".split())


def framed(tokens: list[str], i: int) -> bool:
    """Whether a word with a harmless sense stands where insults stand."""
    if len([t for t in tokens if t not in QUOTES]) <= 2:
        return True
    return not FRAMES.isdisjoint(tokens[max(0, i - 2):i] + tokens[i + 1:i + 2]) or any(lexical(t)[0] == "insult" for t in tokens[max(0, i - 1):i] + tokens[i + 1:i + 2])


SCHEMA = "tweet_id string, source string, h long, label double, " + ", ".join(f"{f} double" for f in FEATURES)
PART = 1_000_000


def rows_of(threads: DataFrame) -> DataFrame:
    text = F.col("teks_komentar")
    return threads.select(filled_id(F.col("tweet_id")).alias("tweet_id"), F.coalesce(F.trim("sumber_akuisisi"), F.lit("")).alias("source"), F.pmod(F.xxhash64("tweet_id", text), F.lit(PART)).alias("h"), text.alias("text"))


def fit_odds(rows: DataFrame) -> odds.Odds:
    """Log odds of words and pairs of words between seeds and other clauses."""
    def labelled(b: pd.DataFrame):
        for text in b["text"]:
            if isinstance(text, str) and text.strip():
                for c in clauses(text):
                    for terms, tells in zip(c.parts, c.telling):
                        yield terms, float(c.seed and tells)

    return odds.fit(rows, labelled)


def features(rows: DataFrame, model: odds.Odds) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            made = [featurize(t, known) for t in b["text"]]
            out = pd.DataFrame([m[0] for m in made], columns=FEATURES)
            out.insert(0, "label", [float(m[1]) for m in made])
            for c in ("h", "source", "tweet_id"):
                out.insert(0, c, b[c].to_numpy())
            yield out

    return rows.mapInPandas(run, SCHEMA)


def cuts(total: int, p: Parameters) -> tuple[int, int, int]:
    """Thresholds on the hash that give the parts for odds, trees and calibration their bounded sizes; small tables are
    shared out whole in the same proportions."""
    wanted = (p.word_rows, p.sample_rows, p.sample_rows)
    scale = PART / max(total, sum(wanted))
    ends = [int(sum(wanted[:i + 1]) * scale) for i in range(3)]
    return ends[0], ends[1], ends[2]


def scored(threads: DataFrame, parameters: Parameters = Parameters()) -> DataFrame:
    """tweet_id, source, score in [0, 1] per row."""
    scratch = Scratch(threads.sparkSession)
    rows = rows_of(threads)
    a, b, c = cuts(threads.count(), parameters)
    table = scratch.save(features(rows, fit_odds(rows.where(F.col("h") < a))))
    fit, calibrate = table.where((F.col("h") >= a) & (F.col("h") < b)), table.where((F.col("h") >= b) & (F.col("h") < c))
    kinds = fit.unionByName(calibrate).groupBy((F.col("h") < b).alias("part"), "label").count().count()
    if kinds < 4:
        return table.select("tweet_id", "source", F.col("label").alias("score"))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    fit, calibrate = scratch.save(vector.transform(fit).select("features", "label")), vector.transform(calibrate)
    trees = GBTClassifier(maxIter=parameters.trees, maxDepth=parameters.depth, seed=7, labelCol="label", featuresCol="features").fit(fit)
    raw = lambda df: trees.transform(df).withColumn("p", vector_to_array("probability")[1])
    curve = IsotonicRegression(labelCol="label", featuresCol="p", predictionCol="score").fit(raw(calibrate))
    return curve.transform(raw(vector.transform(table))).select("tweet_id", "source", "score")


def found(threads: DataFrame, parameters: Parameters = Parameters()) -> DataFrame:
    return scored(threads, parameters).where((F.col("score") >= parameters.threshold) & F.col("tweet_id").isNotNull()).select("tweet_id").distinct()


def scores(threads: DataFrame, parameters: Parameters = Parameters()) -> DataFrame:
    return scored(threads, parameters).where("tweet_id is not null").groupBy("tweet_id").agg(F.max("score").alias("score"))


def rates(threads: DataFrame, parameters: Parameters = Parameters()) -> DataFrame:
    """Per sumber_akuisisi: rows, abusive rows, rate and mean score."""
    bad = (F.col("score") >= parameters.threshold).cast("int")
    return scored(threads, parameters).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(bad).alias("n_abusive"), F.avg(bad).alias("rate"), F.avg("score").alias("mean_score"))

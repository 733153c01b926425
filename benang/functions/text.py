"""Text expressions: cleansing, token replacement, predicates over comments.

Patterns name their character classes in full, so that they mean the same to every regular-expression engine.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: white space and word characters as Unicode has them
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = r"[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LETTER = r"[\p{L}\p{N}_]"
# fixed values: the patterns of the data contract
URL = rf"(?i)(https?://{NOT_SPACE}+|www\.{NOT_SPACE}+)"
HTTP = rf"https?://{NOT_SPACE}+"
HANDLE = rf"@{LETTER}+"
MENTION = r"(^|[^\p{L}\p{N}_])@[A-Za-z0-9_]+"
EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]+"
PUNCTUATION = rf"[^\p{{L}}\p{{N}}_\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}'-]"
TOKEN = r"[a-z0-9]+(?:[-'][a-z0-9]+)*"
SCIENTIFIC = r"^[+-]?[0-9]+(\.[0-9]+)?[Ee][+-]?[0-9]+$"
BOOLEAN = r"(?i)(\b(OR|AND|NOT)\b|[()]|(^|\s)-?filter:)"
SEED = r"(?i)(?:status/)?([0-9]{6,})/?(\?.*)?$"
NEGATIVE_FILTERS = ("-filter:links", "-filter:media")
RETWEET_FLAGS = ("1", "true", "yes", "y")
NEGATIONS = ("tidak", "bukan", "belum", "jangan", "kurang", "tanpa")
DOMAIN_TERMS = ("mbg", "sppg", "bgn", "3t", "slhs", "haccp")
TOPIC = rf"(?i)(?<!{LETTER})mbg(?!{LETTER})|makan{SPACE}+bergizi|makan{SPACE}+siang{SPACE}+gratis|makan{SPACE}+gratis{SPACE}+(?:anak{SPACE}+)?sekolah|embege|makanbergizigratis"
# hosts of the programme in these data; a parameter
OFFICIAL = ("linimasa.example", "tautan.example")
# fixed values again
STOPWORDS = ("yang", "dan", "di", "ke", "dari", "ini", "itu", "untuk", "dengan", "pada", "adalah", "akan", "juga", "sudah", "saya", "kami", "mereka", "kita", "ada", "bisa", "atau", "oleh", "jika", "saat", "agar", "hanya", "lebih", "serta", "antara", "karena", "tetapi", "namun", "maka", "lalu", "pun", "kalau", "supaya", "demi", "selain", "sebagai", "yakni", "bahwa")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) and not t.isascii() else t)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) and not t.isascii() else t)


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def nfc(c: Column) -> Column:
    return _nfc(text_or_blank(c))


def nfkc(c: Column) -> Column:
    return _nfkc(text_or_blank(c))


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


@dataclass(frozen=True)
class Cleansing:
    """What cleansing keeps, replaces or removes; modes are token, remove, keep."""

    lowercase: bool = True
    url_mode: str = "token"
    mention_mode: str = "token"
    keep_emoji: bool = True
    keep_punctuation: bool = True

    def __post_init__(self):
        for mode in (self.url_mode, self.mention_mode):
            if mode not in ("token", "remove", "keep"):
                raise ValueError(f"unknown mode: {mode}")


def cleanse(c: Column, options: Cleansing = Cleansing()) -> Column:
    t = nfc(c)
    if options.lowercase:
        t = F.lower(t)
    if options.url_mode != "keep":
        t = F.regexp_replace(t, URL, " url " if options.url_mode == "token" else " ")
    if options.mention_mode != "keep":
        # the character before the mention stays; neighbours share it, hence twice
        by = "$1 user " if options.mention_mode == "token" else "$1 "
        t = F.regexp_replace(F.regexp_replace(t, MENTION, by), MENTION, by)
    if not options.keep_emoji:
        t = F.regexp_replace(t, EMOJI, " ")
    if not options.keep_punctuation:
        t = F.regexp_replace(t, PUNCTUATION, " ")
    return collapse(t)


def replace_tokens(c: Column, lookup: Column) -> Column:
    """Whole tokens replaced by a map column keyed in lower case; all else unchanged."""
    pieces = F.regexp_extract_all(c, F.lit(rf"(?i)({TOKEN}|[^a-z0-9]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(lookup, F.lower(x)), x)), "")


def replace_words(c: Column, lookup: Column) -> Column:
    """Words between white space replaced; a trailing mark keeps a word from matching."""
    words = F.filter(F.split(c, rf"{SPACE}+"), lambda x: x != "")
    return F.array_join(F.transform(words, lambda x: F.coalesce(F.try_element_at(lookup, F.lower(x)), x)), " ")


def drop_stopwords(c: Column, stop: tuple[str, ...] = STOPWORDS, keep: tuple[str, ...] = NEGATIONS + DOMAIN_TERMS) -> Column:
    """Words between white space without the stop words; negations and terms of the domain always stay."""
    words = F.filter(F.split(c, rf"{SPACE}+"), lambda x: (x != "") & (F.lower(x).isin(*keep) | ~F.lower(x).isin(*stop)))
    return F.array_join(words, " ")


def model_text(c: Column, lookup: Column | None = None, remove_stopwords: bool = False, stem=None) -> Column:
    """The model's text: NFC, lower case, URL and USER tokens, slang by words, optional stop words and stemmer."""
    t = F.lower(nfc(c))
    t = F.regexp_replace(F.regexp_replace(t, HTTP, "URL"), HANDLE, "USER")
    if lookup is not None:
        t = replace_words(t, lookup)
    if remove_stopwords:
        t = drop_stopwords(t)
    if stem is not None:
        t = stem(t)
    return collapse(t)


def pair_text(root: Column, comment: Column) -> Column:
    """root [SEP] comment, or the comment alone where the root is blank."""
    r, t = collapse(nfc(root)), collapse(nfc(comment))
    return F.when(r != "", F.concat_ws(" [SEP] ", r, t)).otherwise(t)


def language(c: Column) -> Column:
    low = F.lower(F.trim(text_or_blank(c)))
    return F.when(low.isin("", "*", "all", "semua"), "").when(low.isin("id", "ind", "indonesia", "bahasa indonesia", "in"), "in").otherwise(low)


def language_matches(actual: Column, required: str) -> Column:
    want = language(F.lit(required))
    return (want == "") | ((language(actual) != "") & (language(actual) == want))


def meaningful(c: Column, least: int = 3) -> Column:
    bare = collapse(F.regexp_replace(F.regexp_replace(text_or_blank(c), URL, " "), HANDLE, " "))
    return F.length(bare) >= least


def relevant(c: Column, topic: str = TOPIC) -> Column:
    return text_or_blank(c).rlike(topic)


def only_official_link(c: Column, hosts: tuple[str, ...] = OFFICIAL, below: int = 30) -> Column:
    low = F.lower(text_or_blank(c))
    named = F.lit(False)
    for h in hosts:
        named = named | low.contains(h)
    return named & (F.length(F.trim(F.regexp_replace(text_or_blank(c), URL, ""))) < below)


def has_url(c: Column) -> Column:
    return text_or_blank(c).rlike(URL)


def good_quality(c: Column, topic: str = TOPIC) -> Column:
    return meaningful(c) & relevant(c, topic) & ~has_url(c) & ~only_official_link(c)


def search_query(c: Column) -> Column:
    """Several words quoted unless quoted or Boolean already; each missing filter appended."""
    term = F.trim(c)
    term = F.when(term.contains(" ") & ~term.startswith('"') & ~term.rlike(BOOLEAN), F.concat(F.lit('"'), term, F.lit('"'))).otherwise(term)
    return F.concat_ws(" ", term, *[F.when(~F.contains(F.lower(term), F.lit(f)), F.lit(f)) for f in NEGATIVE_FILTERS])


def query_key(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def retry_wait(error: Column, rate_wait: int, default_wait: int) -> Column:
    low = F.lower(error)
    return F.when(low.contains("rate") | low.contains("429") | low.contains("no account available"), rate_wait).otherwise(default_wait)


def formula_guard(c: Column) -> Column:
    """An apostrophe before text a spreadsheet would read as a formula."""
    return F.when(c.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def progress(c: Column, total: int) -> Column:
    """Percent of ``total`` of the first grouped number in a line, at most 100."""
    n = F.regexp_replace(F.regexp_extract(c, r"([0-9][0-9.,]*)", 1), "[.,]", "").try_cast("bigint")
    return F.least(F.coalesce(F.try_divide(n * 100.0, F.lit(float(total))), F.lit(0.0)), F.lit(100.0))


def top_two(probabilities: Column) -> tuple[Column, Column, Column]:
    """Index of the greatest probability (of ties the later), its value, and the margin to the second."""
    ranked = F.sort_array(F.transform(probabilities, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), asc=False)
    first, second = F.element_at(ranked, 1), F.try_element_at(ranked, F.lit(2))
    return first["i"], first["p"], F.coalesce(first["p"] - second["p"], F.lit(0.0))


def squeeze(c: Column) -> Column:
    """Repeated letters to one."""
    return F.regexp_replace(c, r"(.)\1+", "$1")


def stamp(c: Column) -> Column:
    """A time as ISO text of the +07:00 zone."""
    return F.date_format(F.from_utc_timestamp(c, "+07:00"), "yyyy-MM-dd'T'HH:mm:ss'+07:00'")


def id_of(text: Column, number: Column) -> Column:
    """The text form of an id where it is filled, else its number."""
    return F.coalesce(F.when(F.trim(text) != "", F.trim(text)), number.cast("string"), F.lit(""))

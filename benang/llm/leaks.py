"""Evaluation texts leaking into training text: an FM-index per training shard.

A shard is the word sequence of the documents of one task, as ids over the words of the evaluation items. Its
suffix array gives the Burrows-Wheeler transform, kept as a wavelet tree; every phrase of ``seed`` words of the
items is found by backward search with wavelet-tree ranks and its occurrences are located through sampled suffix
positions. Where phrases of an item come close to each other in a document, every unbroken stretch is extended over
both ends word by word; a passage of at least ``least`` words of the item with at most one in six of them changed,
dropped or put in is a leak. All passages of an item are given; spans of several items are merged for removal.

Why ``seed`` = 3: fifteen words with up to three changes keep an unbroken stretch of three words. Thirteen unbroken
words whose both neighbours differ are a short quotation: no changed word can be told from a foreign one there.

Defined results: case, punctuation, spacing, accents, zero-width characters and markup do not count; null and
blank texts and items hold nothing; copies of a document are each reported; very long texts make a shard of their
own; rows with a null doc_id are ignored; empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from benang.session import Scratch

MARKUP = re.compile(r"</?[a-zA-Z][^<>\n]{0,40}>|&(?:nbsp|amp|lt|gt|quot);")
WORD = re.compile(r"[^\W_]+")
ZERO_WIDTH = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])
#: words of a shard before its index is built
SHARD_WORDS = 300_000
OTHER, END = 1, 0
#: changes a passage is extended over at a time, to each side
STEP = 6
#: changes a passage of fewer than thirty words can have
PROBE = 4


def fold(text: str) -> str:
    """Lower case without accents, zero-width characters and markup."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(ZERO_WIDTH))
        text = "".join(c for c in text if not unicodedata.combining(c))
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    return text.lower()


def words_of(text: object) -> list[str]:
    return WORD.findall(fold(text)) if isinstance(text, str) else []


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:] if k < n else second[: max(0, n - k)]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        k *= 2
        if n == 0 or rank[order[-1]] == n - 1 or k >= n:
            return order


class WaveletTree:
    """Ranks of symbols over a sequence: one bit array with running sums per level of the alphabet (wavelet matrix)."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.sums: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq
        for level in range(self.bits - 1, -1, -1):
            bit = (cur >> level) & 1
            self.sums.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(cur) - bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at`` (both arrays)."""
        lo, hi = np.zeros_like(at), at.copy()
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            s, z = self.sums[i], self.zeros[i]
            lo = np.where(one, z + s[lo], lo - s[lo])
            hi = np.where(one, z + s[hi], hi - s[hi])
        return hi - lo


class FMIndex:
    def __init__(self, seq: np.ndarray, symbols: int, step: int = 8):
        sa = suffix_array(seq)
        n = len(seq)
        self.n = n
        self.bwt = seq[sa - 1]
        self.tree = WaveletTree(self.bwt, symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))]).astype(np.int64)
        self.marked = (sa % step) == 0
        self.before = np.concatenate([[0], np.cumsum(self.marked)])
        self.sample = sa[self.marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases (one per row), by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for col in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, col]
            lo = self.first[c] + self.tree.rank(c, lo)
            hi = self.first[c] + self.tree.rank(c, hi)
            hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: walk back to a sampled row, counting steps."""
        pos = np.full(len(rows), -1, np.int64)
        cur, steps = rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            r = cur[open_]
            at = self.marked[r]
            done = open_[at]
            pos[done] = self.sample[self.before[r[at]]] + steps
            open_ = open_[~at]
            if len(open_):
                r = cur[open_]
                c = self.bwt[r]
                cur[open_] = self.first[c] + self.tree.rank(c, r)
            steps += 1
        return pos % self.n


class Items:
    """A block of evaluation items as word ids, and their phrases with where they stand. Blocks share a vocabulary, so
    that one index of a shard serves them all."""

    def __init__(self, rows: list[tuple[int, str]], seed: int, vocab: dict[str, int] | None = None):
        self.vocab: dict[str, int] = {} if vocab is None else vocab
        self.seed = seed
        self.seqs: dict[int, np.ndarray] = {}
        for item, text in rows:
            w = words_of(text)
            self.seqs[item] = np.array([self.vocab.setdefault(x, len(self.vocab) + 2) for x in w], np.int64)
        where: dict[tuple, list] = defaultdict(list)
        for item, seq in self.seqs.items():
            for i in range(len(seq) - seed + 1):
                where[tuple(seq[i:i + seed])].append((item, i))
        self.phrases = np.array(list(where), np.int64).reshape(-1, seed)
        self.where = list(where.values())

    def without_vocab(self) -> Items:
        """The block as it is handed out: the vocabulary goes once, beside all blocks."""
        self.vocab = {}
        return self


def worst_cover(least: int, share: float, seed: int) -> int:
    """Fewest words in unbroken stretches of ``seed`` that a passage of ``least`` words or more keeps with up to
    ``share`` of its words changed: every change may leave seed - 1 words alone, the rest stands in one stretch.
    (Fifteen words with two changes, matched 2, 2, 9: nine.)"""
    return min(n - k - (seed - 1) * k for n in range(least, 3 * least) for k in [int(n * share + 1e-9)])


def runs_of(hits: list[tuple[int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Unbroken stretches (doc position, item position, words) of phrase hits, longest first."""
    out: list[list[int]] = []
    for _, d, i in sorted({(i - d, d, i) for d, i in hits}):
        if out and i - d == out[-1][1] - out[-1][0] and d <= out[-1][0] + out[-1][2]:
            out[-1][2] = d + seed - out[-1][0]
        else:
            out.append([d, i, seed])
    return sorted(((d, i, n) for d, i, n in out), key=lambda r: (-r[2], r[0], r[1]))


def reaches(doc: list[int], item: list[int], edits: int) -> np.ndarray:
    """How far the beginnings of two sequences agree with 0, 1, ... ``edits`` words changed, dropped or put in: rows
    (doc words, item words, matched words, changes), each ending on a match; by furthest points per diagonal."""
    n, m = len(doc), len(item)
    out = [(0, 0, 0, 0)]
    far: dict[int, tuple[int, int]] = {0: (0, 0)}
    for e in range(edits + 1):
        if e:
            nxt: dict[int, tuple[int, int]] = {}
            for k, (x, got) in far.items():
                for k2, x2 in ((k, x + 1), (k - 1, x + 1), (k + 1, x)):
                    if x2 <= n and x2 + k2 <= m and (x2, got) > nxt.get(k2, (-1, 0)):
                        nxt[k2] = (x2, got)
            far = nxt
        for k, (x, got) in far.items():
            x0 = x
            while x < n and x + k < m and doc[x] == item[x + k]:
                x += 1
            if x > x0:
                got += x - x0
                far[k] = (x, got)
                out.append((x, x + k, got, e))
    return np.array(out, np.int64)


def supported(runs: list[tuple[int, int, int]], least: int, need: int) -> list[tuple[int, int, int]]:
    """The runs round which runs near the same diagonal cover ``need`` words within the length of a shortest passage.
    An acceptable passage of twice ``least`` words or more has an acceptable half, so the shortest acceptable part
    round some of its runs has fewer words and PROBE changes at most."""
    order = sorted(runs)
    reach = 2 * least + PROBE
    kept, low = set(), 0
    longest = max((n for _, _, n in order), default=0)
    for d, i, n in order:
        while order[low][0] + longest < d - reach:
            low += 1
        covered = 0
        for d2, i2, n2 in itertools.islice(order, low, None):
            if d2 > d + n + reach or covered >= need:
                break
            if abs((i2 - d2) - (i - d)) <= PROBE and d2 + n2 >= d - reach:
                covered += n2
        if covered >= need:
            kept.add((d, i, n))
    return [r for r in runs if r in kept]


def passages(doc: np.ndarray, item: np.ndarray, runs: list[tuple[int, int, int]], least: int, slack: float, need: int = 0) -> list[tuple[int, int]]:
    """Doc spans of the passages of ``item``: every unbroken stretch is extended over both ends and the longest
    extension of at least ``least`` words with few enough changes is taken, and extended again while it grows;
    stretches inside an accepted passage are spent, all others go on.

    A change is paid by 1 / ``slack`` matched words anywhere in the passage (0.2: five, which is one word in six).
    A stretch is first extended over PROBE changes a side (see supported), an accepted passage over STEP at a time.
    A passage whose first or last word was itself changed shows one word less, hence least - 1."""
    words, whole = item.tolist(), doc.tolist()
    margin = len(words) + STEP
    taken: list[tuple[int, int, int, int]] = []
    for d, i, n in supported(runs, least, need):
        if any(a <= d and d + n <= b and ia <= i and i + n <= ib for a, b, ia, ib in taken):
            continue
        a, b, ia, ib, core, changed, grown = d, d + n, i, i + n, n, 0, True
        accepted = False
        while grown:
            edits_a_side = STEP if accepted else PROBE
            left = reaches(whole[max(0, a - margin):a][::-1], words[:ia][::-1], edits_a_side)
            right = reaches(whole[b:b + margin], words[ib:], edits_a_side)
            span_d, span_i, matched, edits = (left[:, None, c] + right[None, :, c] for c in range(4))
            span_d, span_i, matched, edits = span_d + b - a, span_i + ib - ia, matched + core, edits + changed
            good = (edits <= slack * matched + 1e-9) & ((span_i >= least) | ((span_i >= least - 1) & (matched >= least - 2)))
            if not good.any():
                break
            at_l, at_r = np.unravel_index(int(np.where(good, span_d * 1_000 + matched, -1).argmax()), good.shape)
            grown = bool(at_l or at_r) or not accepted
            core, changed, accepted = int(matched[at_l, at_r]), int(edits[at_l, at_r]), True
            a, b, ia, ib = a - int(left[at_l, 0]), b + int(right[at_r, 0]), ia - int(left[at_l, 1]), ib + int(right[at_r, 1])
        if accepted:
            taken.append((a, b, ia, ib))
    return sorted({(a, b) for a, b, _, _ in taken})


def candidates(hits: list[tuple[int, int]], seed: int, need: int, window: int = 40, drift: int = 10) -> list[tuple[int, int]]:
    """Doc ranges in which phrase hits of an item lie close together and near one diagonal and cover at least
    ``need`` words (worst_cover)."""
    hits = sorted(set(hits))
    out: list[tuple[int, int]] = []
    for k, (d, i) in enumerate(hits):
        if out and d <= out[-1][1]:
            continue
        covered, reach = 0, d
        for d2, i2 in hits[k:]:
            if d2 - d > window:
                break
            if abs((d2 - i2) - (d - i)) <= drift:
                covered += min(seed, max(0, d2 + seed - reach))
                reach = max(reach, d2 + seed)
        if covered >= need:
            if out and d - out[-1][1] <= 2 * window:
                out[-1] = (out[-1][0], reach)
            else:
                out.append((d, reach))
    return out


class Shard:
    """The FM-index of some documents (id, word ids), built once for all blocks of items."""

    def __init__(self, docs: list[tuple[int, np.ndarray]], symbols: int):
        self.docs = docs
        self.starts = np.concatenate([[0], np.cumsum([len(d) + 1 for _, d in docs])])
        self.index = FMIndex(np.concatenate([x for _, d in docs for x in (d, np.zeros(1, np.int64))]), symbols)


def scan(docs: list[tuple[int, np.ndarray]], items: Items, least: int, slack: float, need: int) -> list[tuple]:
    """Leaks (doc, item, first word, end word) of documents: one shard, one block of items."""
    return search(Shard(docs, len(items.vocab) + 2), items, least, slack, need) if docs else []


def search(shard: Shard, items: Items, least: int, slack: float, need: int) -> list[tuple]:
    """Leaks (doc, item, first word, end word) of a block of items in the documents of a shard."""
    if not len(items.phrases):
        return []
    docs, starts, index = shard.docs, shard.starts, shard.index
    lo, hi = index.search(items.phrases)
    some = np.nonzero(hi > lo)[0]
    if not len(some):
        return []
    counts = hi[some] - lo[some]
    rows = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    phrase = np.repeat(some, counts)
    pos = index.locate(rows)
    doc = np.searchsorted(starts, pos, side="right") - 1
    hits: dict[tuple[int, int], list] = defaultdict(list)
    for p, d, at in zip(phrase.tolist(), doc.tolist(), (pos - starts[doc]).tolist()):
        for item, i in items.where[p]:
            hits[d, item].append((at, i))
    found = []
    for (d, item), h in hits.items():
        if len(h) * items.seed < need:
            continue
        seq_i = items.seqs[item]
        ranges = candidates(h, items.seed, need)
        if ranges:
            near = [x for x in h if any(first <= x[0] < last for first, last in ranges)]
            for first, end in passages(docs[d][1], seq_i, runs_of(near, items.seed), least, slack, need):
                found.append((docs[d][0], item, first, end))
    return found


LEAKS = "doc_id long, item_id long, first_word int, end_word int"


def leaks(docs: DataFrame, evals: DataFrame, least: int = 15, slack: float = 0.2, seed: int = 3, need: int | None = None, block: int = 5_000) -> DataFrame:
    """doc_id, item_id and the word span of each leaked passage. The items are the query set; they are handed out in
    blocks of ``block`` items. A document is read and indexed once; each index is searched for one block after the other."""
    need = worst_cover(least, 1 / 6, seed) if need is None else need
    rows = ((int(r[0]), r[1]) for r in evals.where("item_id is not null").select("item_id", "text").distinct().orderBy("item_id").toLocalIterator())
    context = docs.sparkSession.sparkContext
    vocab: dict[str, int] = {}
    blocks = []
    while part := list(itertools.islice(rows, block)):
        blocks.append(context.broadcast(Items(part, seed, vocab).without_vocab()))
    words = context.broadcast(vocab)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = words.value

        def leaked(held: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
            shard = Shard(held, len(known) + 2) if held else None
            return pd.DataFrame([x for b in blocks if shard for x in search(shard, b.value, least, slack, need)], columns=["doc_id", "item_id", "first_word", "end_word"])

        held, size = [], 0
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                w = words_of(text)
                if not w:
                    continue
                held.append((int(doc), np.fromiter((known.get(x, OTHER) for x in w), np.int64, len(w))))
                size += len(w) + 1
                if size >= SHARD_WORDS:
                    yield leaked(held)
                    held, size = [], 0
        yield leaked(held)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, LEAKS)


def found(docs: DataFrame, evals: DataFrame) -> DataFrame:
    return leaks(docs, evals).select("doc_id", "item_id").distinct()


def spans(docs: DataFrame, evals: DataFrame) -> DataFrame:
    """Removal spans per document: overlapping and adjoining word spans of all items merged."""
    s = Scratch(docs.sparkSession).save(leaks(docs, evals))
    w = W.partitionBy("doc_id").orderBy("first_word", "end_word")
    reach = s.withColumn("reach", F.max("end_word").over(w.rowsBetween(W.unboundedPreceding, -1)))
    part = reach.withColumn("part", F.sum((F.coalesce(F.col("first_word") > F.col("reach"), F.lit(True))).cast("int")).over(w))
    return part.groupBy("doc_id", "part").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.count_distinct("item_id").alias("n_items")).drop("part")


def report(docs: DataFrame, evals: DataFrame) -> DataFrame:
    """Per evaluation item: how many documents and sources hold it (0 where none)."""
    f = found(docs, evals).join(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source")).distinct(), "doc_id")
    per = f.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("source").alias("n_sources"))
    every = evals.where("item_id is not null").select("item_id", "split_name").distinct()
    return every.join(per, "item_id", "left").na.fill(0, ["n_docs", "n_sources"])

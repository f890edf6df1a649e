"""Languages of texts and of their segments by prediction by partial matching.

For each language there is a tree of byte contexts of up to ORDER bytes with the counts of the
bytes that followed.  The code length of a byte is that of its longest known context; where that
context hasn't seen the byte, an escape is coded and the next shorter context asked (method C:
escape q / (n + q) after n bytes of q kinds).  Trees are frozen once trained.  Contexts begin anew
with every word, so the exact code length of a text is the sum over its words, and a word's lengths
under all languages are computed once for each task.

A text has the language of the shortest code.  Its confidence is that language's share of the
likelihoods 2^-bits, with bits divided by TEMPER because words of a text depend on each other.
A text is segmented by the cheapest path over its sentences, a change of language costing
SWITCH bits.

A text, or segment, whose words in lower case are long in every language (STRANGE) is in none of them: `und`.

Training takes a bounded sample of labelled texts (about SAMPLE rows of each table, in even shares of the languages, by hash
of the row number); labels are checked by training twice: texts whose code is shortest in another language
than their label's are left out of the second training.

Defined cases: null, empty and blank texts and those without a letter have no language (null,
confidence 0); repeated rows are labelled alike; ties go to the first language in the order of
LANGUAGES; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

#: What a text in none of the languages is labelled.
OTHER = "und"
LANGUAGES = ("eng", "spa", "deu", "fra", "por", "ita")
ORDER = 5
SAMPLE = 20_000
TEMPER = 4.0
SWITCH = 22.0
#: A whole sentence has a closing mark and at least so many words; other lines weigh PART of their bits.
WORDS = 4
PART = 0.25
STOPS = tuple(".!?…")
CLOSING = " \t\r\n\"'»”’)]"
CACHE = 400_000
#: Bits a byte of words in lower case, in the language that has fewest, from which on a text of FEW such words or more is in none of them.
STRANGE, FEW = 6.4, 6
CLIP, NAME = 14.0, 0.03

WORD = re.compile(r"(?<![\w/])[^\W\d_]+(?![\w/])")
#: Letters set apart, as in headings; they say nothing of a language.
SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]\s{1,3}){5,}")
#: Sentences end at . ! ? … with closing quotes before white space, at blank lines, and before list items.
SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|\n[^\S\n]*\n\s*|\n(?=[^\S\n]*(?:[-*•|]|\d+[.)]\s))")


class ContextTree:
    """Counts of bytes after contexts of 0 to order bytes within a word."""

    def __init__(self, words: dict[str, int], order: int = ORDER):
        self.order = order
        seen: dict[bytes, Counter] = defaultdict(Counter)
        for word, n in words.items():
            w = b" " + word.encode("utf-8", "replace") + b" "
            for i in range(1, len(w)):
                for k in range(min(order, i) + 1):
                    seen[w[i - k : i]][w[i]] += n
        #: context -> (bits of an escape, {byte: bits})
        self.bits: dict[bytes, tuple[float, dict[int, float]]] = {}
        for context, counts in seen.items():
            total = sum(counts.values()) + len(counts)
            self.bits[context] = (
                -math.log2(len(counts) / total),
                {b: -math.log2(c / total) for b, c in counts.items()},
            )

    def word_bits(self, word: str) -> float:
        w, total, known = b" " + word.encode("utf-8", "replace") + b" ", 0.0, self.bits
        for i in range(1, len(w)):
            for k in range(min(self.order, i), -1, -1):
                node = known.get(w[i - k : i])
                if node is not None:
                    got = node[1].get(w[i])
                    if got is not None:
                        total += got
                        break
                    total += node[0]
            else:
                total += 8.0
        return total


class WordBits(dict):
    """Row number of each word in a growing table of code lengths, one column per language.

    Lengths are kept as what they exceed the shortest by, CLIP bits at most, so one odd word can't
    outvote a text; of capitalised words, which may be names from anywhere, NAME of it.
    """

    def __init__(self, trees: list[ContextTree]):
        super().__init__()
        # beside the lengths: the shortest as it is, bytes and number of words, of words in lower case
        self.trees, self.table = trees, np.zeros((1024, len(trees) + 3))

    def __missing__(self, word: str) -> int:
        no = len(self)
        if no == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        bits = np.array([t.word_bits(word.lower()) for t in self.trees])
        if word.islower():
            self.table[no, len(self.trees) :] = bits.min(), len(word.encode("utf-8", "replace")) + 1, 1
        self.table[no, : len(self.trees)] = np.minimum(bits - bits.min(), CLIP) * (NAME if word[0].isupper() and not (len(word) > 3 and word.isupper()) else 1.0)
        self[word] = no
        return no

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text in each language, and its number of words."""
        sums, n = self.sums(texts)
        return sums[:, : len(self.trees)], n

    def strangeness(self, sums: np.ndarray) -> np.ndarray:
        """Bits a byte of the words in lower case, 0 where there are too few of them."""
        least, size, words = sums[:, len(self.trees) :].T
        return np.where(words >= FEW, least / np.maximum(size, 1), 0.0)

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of each text's rows of the table, and its number of words."""
        if len(self) > CACHE:
            self.clear()
        numbers: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        row = self.__getitem__
        for i, t in enumerate(texts):
            if t:
                if SPACED.search(t):
                    t = SPACED.sub(" ", t)
                numbers.extend(map(row, WORD.findall(t)))
            ends[i + 1] = len(numbers)
        run = np.zeros((len(numbers) + 1, self.table.shape[1]))
        if numbers:
            np.cumsum(self.table[np.array(numbers)], axis=0, out=run[1:])
        return run[ends[1:]] - run[ends[:-1]], np.diff(ends)


def confidence(bits: np.ndarray) -> np.ndarray:
    """Share of the best column in each row."""
    gap = (bits - bits.min(axis=1, keepdims=True)) / TEMPER
    return 1.0 / np.exp2(-gap).sum(axis=1)


def train(rows: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES) -> list[ContextTree]:
    """Trees of labelled texts (label, text); wrong labels are found by a first training and left out of the second."""
    kept = [(lab, t) for lab, t in rows if lab in languages and t and t.strip()]
    trees: list[ContextTree] = []
    for turn in range(2):
        words: dict[str, Counter] = {lab: Counter() for lab in languages}
        for lab, t in kept:
            words[lab].update(WORD.findall(t.lower()))
        trees = [ContextTree(words[lab]) for lab in languages]
        if turn == 0:
            best = WordBits(trees).of([t for _, t in kept])[0].argmin(axis=1)
            kept = [r for r, b in zip(kept, best) if languages[b] == r[0]]
    return trees


def labelled_sample(df: DataFrame, number: str, text: str, label: str, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """About sample labelled rows with their whole texts, as many of each language as there are, up to its even share; picked by hash of their number."""
    df = df.where(F.col(label).isin(*LANGUAGES) & F.col(text).isNotNull())
    share = -(-sample // len(LANGUAGES))
    every = {r[label]: -(-r["count"] // share) for r in df.groupBy(label).count().collect()}
    if not every:
        return []
    step = F.create_map(*(F.lit(x) for kv in every.items() for x in kv))[F.col(label)]
    kept = df.where(F.pmod(F.xxhash64(F.lit("language"), F.col(number)), step) == 0)
    return [(r[0], r[1]) for r in kept.select(label, text).collect()]


def label_texts(df: DataFrame, keys: dict[str, str], trees) -> DataFrame:
    """keys, lang, confidence, n_words of each row's text; trees is a broadcast list of trees."""
    names = tuple(keys)

    def make():
        table = WordBits(trees.value)

        def step(b):
            sums, n = table.sums(b["text"])
            bits, strange = sums[:, : len(LANGUAGES)], table.strangeness(sums)
            best, sure = bits.argmin(axis=1), confidence(bits)
            return {
                **{k: b[k] for k in names},
                "lang": [OTHER if x >= STRANGE else LANGUAGES[i] if w else None for i, w, x in zip(best, n, strange)],
                "confidence": np.where(strange >= STRANGE, np.minimum(strange / (2 * STRANGE), 1.0), np.where(n > 0, sure, 0.0)),
                "n_words": n,
            }

        return step

    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", lang string, confidence double, n_words long"
    return arrow_rows(df.select(*names, "text"), schema, make)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences; together they cover the text."""
    cuts = [0, *(m.end() for m in SENTENCE.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def path(bits: np.ndarray, switch: float = SWITCH) -> list[int]:
    """Language of each sentence on the cheapest path."""
    n, k = bits.shape
    cost, back = bits[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        low = int(cost.argmin())
        stay = cost <= cost[low] + switch
        back[i] = np.where(stay, np.arange(k), low)
        cost = np.where(stay, cost, cost[low] + switch) + bits[i]
    out = [int(cost.argmin())]
    for i in range(n - 1, 0, -1):
        out.append(int(back[i, out[-1]]))
    return out[::-1]


def segment_texts(df: DataFrame, keys: dict[str, str], trees) -> DataFrame:
    """keys, segment_no, start, end, lang, confidence, n_words: runs of sentences in one language.

    Every text with a letter has at least one segment.
    """
    names = tuple(keys)

    def make():
        table = WordBits(trees.value)

        def step(b):
            out: dict[str, list] = {k: [] for k in (*names, "segment_no", "start", "end", "lang", "confidence", "n_words")}
            spans = [sentences(t) if t else [] for t in b["text"]]
            parts = [t[a:z] for t, own in zip(b["text"], spans) for a, z in own]
            sums, n = table.sums(parts)
            bits = sums[:, : len(LANGUAGES)]
            whole = np.array([p.rstrip(CLOSING)[-1:] in STOPS for p in parts], bool) & (n >= WORDS)
            bits = np.where(whole[:, None], bits, bits * PART)
            gap = bits.min(axis=1)
            at = 0
            for row, own in enumerate(spans):
                m = len(own)
                mine, words, low, own_sums = bits[at : at + m], n[at : at + m], gap[at : at + m], sums[at : at + m]
                at += m
                if not words.sum():
                    continue
                main = int(mine.sum(axis=0).argmin())
                if (mine[:, main] - low).sum() > SWITCH:  # else no change of language can pay
                    langs = path(mine)
                else:
                    langs = [main] * m
                i = no = 0
                while i < m:
                    j = i
                    while j < m and langs[j] == langs[i]:
                        j += 1
                    if words[i:j].sum():
                        for k in names:
                            out[k].append(b[k][row])
                        sure, lang = float(confidence(mine[i:j].sum(axis=0)[None])[0]), LANGUAGES[langs[i]]
                        strange = float(table.strangeness(own_sums[i:j].sum(axis=0)[None])[0])
                        if strange >= STRANGE:
                            sure, lang = min(strange / (2 * STRANGE), 1.0), OTHER
                        for k, v in zip(("segment_no", "start", "end", "lang", "confidence", "n_words"), (no, own[i][0], own[j - 1][1], lang, sure, int(words[i:j].sum()))):
                            out[k].append(v)
                        no += 1
                    i = j
            return out

        return step

    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", segment_no int, start int, end int, lang string, confidence double, n_words long"
    return arrow_rows(df.where(F.col("text").isNotNull()).select(*names, "text"), schema, make)

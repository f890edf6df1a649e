"""Defects of prompt and response pairs.

The response of each pair gets the first defect that applies:

* empty: null, blank, without letters and digits, or a placeholder;
* copied: most of its runs of words, or its text as a whole, stand in the prompt, or most of it is the prompt's beginning;
* refusal: it declines the task, in any of the languages;
* other_language: the language posteriors of prompt and response, by naive Bayes over character
  n-grams, are sure and differ, and no sentence of the prompt is in the response's language;
* truncated: it does not end as sentences of this kind end.  Counted over responses that end with
  a full stop is how often a sentence with this opening goes on, and how often it ends, after these
  last words; the most specific of four such n-gram counts that is known decides by its likelihood
  of an end.  A last word that is no known word is a word broken off.

The language models are fitted on a bounded sample (SAMPLE labelled texts, by hash); the ends of texts
are counted over all responses, and joined to the last words of those left open.

Defined cases: a null prompt can be neither copied nor of another language; for pairs that the
caller marks (images) no language is compared; texts without letters have no language; repeated
rows are judged alike; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from os.path import commonprefix

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import arrow_rows
from .language import LANGUAGES, WORD, WordBits, sentences

SAMPLE = 20_000
RUN, COPIED = 5, 0.6
#: A sentence ends after words that ended at least this share of the sentences that came to them.
LIKELY = 0.02
KNOWN = 4
#: Bits by which one language must lead.
SURE = 16.0

#: What stands for no answer, as letters and digits in lower case.
PLACEHOLDERS = frozenset(
    "none null na nan nil tbd tba todo undefined unknown empty missing notavailable notapplicable nodescription "
    "nosummary noanswer noresponse summary description placeholder pending keine leer nichts sinresumen sindescripcion "
    "aucun aucune vide nenhum nenhuma vazio nessuno nessuna vuoto".split()
)
#: Ways to decline a task, in the six languages, in lower case.
REFUSALS = re.compile(
    r"\b(?:i(?:'m|’m| am) (?:so |very |really )?(?:sorry|afraid)|i apologi[sz]e|my apologies"
    r"|i (?:can't|can’t|cannot|can not|won't|won’t|will not|am unable|am not able|am not allowed|do not feel able|must decline|have to decline|must refuse|refuse)\b"
    r"|i(?:'m|’m) (?:unable|not able|not allowed)|as an? (?:ai|large language model|language model|assistant)\b|my (?:guidelines|policies|instructions|programming)\b"
    r"|(?:is|was) not possible for me|unable to (?:help|assist|comply|fulfil|fulfill)"
    r"|als (?:ki|sprachmodell|ki-modell|assistent)\b|(?:es )?tut mir leid|ich (?:kann|darf|möchte) (?:\w+ ){0,4}nicht\b|kann ich (?:\w+ ){0,3}nicht|(?:muss|möchte) ich (?:\w+ ){0,3}ablehnen|ist (?:es )?mir (?:leider )?nicht (?:möglich|erlaubt)|es mir nicht möglich"
    r"|lo siento|lo lamento|como (?:modelo de lenguaje|asistente|inteligencia artificial|una ia)|no (?:puedo|estoy autorizad[oa]|estoy en condiciones)\b|me temo que|no me es posible|debo (?:rechazar|negarme|declinar)"
    r"|désolée?\b|je (?:ne peux|ne suis pas|regrette|refuse|dois (?:refuser|décliner))|en tant que (?:modèle|assistant|ia)\b|il m['’]est impossible|je suis dans l['’]impossibilité"
    r"|desculpe|sinto muito|lamento\b|infelizmente (?:\w+ ){0,3}(?:não|recusar)|como (?:modelo de linguagem|assistente|uma ia)|não (?:posso|consigo|me é possível|estou autorizad[oa])\b|tenho de recusar"
    r"|mi (?:dispiace|spiace|scuso)|come (?:modello linguistico|modello di linguaggio|assistente|intelligenza artificiale)|non (?:posso|sono in grado|mi è possibile|sono autorizzat[oa])\b|devo (?:rifiutare|declinare)|non mi è (?:possibile|consentito))"
)
_PLAIN = re.compile(r"[\W_]+")
_TOKEN = re.compile(r"\d[\d.,;:]*\d|\d+|[^\W\d_]+")
_STRIP = " \t\r\n\"'»”’)]*_`"


class NaiveBayes:
    """Bits of a word by character n-grams of 1 to order letters, the word's edges counting as characters."""

    def __init__(self, words: dict[str, int], order: int = 3):
        self.order, counts = order, Counter()
        for w, n in words.items():
            for g in self.grams(w):
                counts[g] += n
        total = sum(counts.values()) + len(counts) + 1
        self.bits = {g: -math.log2((c + 1) / total) for g, c in counts.items()}
        self.unseen = math.log2(total)

    def grams(self, word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + k] for k in range(1, self.order + 1) for i in range(len(w) - k + 1)]

    def word_bits(self, word: str) -> float:
        return sum(self.bits.get(g, self.unseen) for g in self.grams(word)) / self.order


def train_languages(rows: list[tuple[str, str]]) -> list[NaiveBayes]:
    """Models of labelled texts; texts that another language explains better are left out of a second training."""
    kept, models = [r for r in rows if r[0] in LANGUAGES and r[1]], []
    for turn in range(2):
        words = {lab: Counter() for lab in LANGUAGES}
        for lab, t in kept:
            words[lab].update(WORD.findall(t.lower()))
        models = [NaiveBayes(words[lab]) for lab in LANGUAGES]
        if turn == 0:
            best = WordBits(models).of([t for _, t in kept])[0].argmin(axis=1)
            kept = [r for r, b in zip(kept, best) if LANGUAGES[b] == r[0]]
    return models


def classes(text: str) -> list[str]:
    """Words of a text in lower case; numbers are one class."""
    return ["#" if w[0].isdigit() else w.lower() for w in _TOKEN.findall(text)]


def _keys(words: list[str], i: int) -> tuple:
    last, two = words[i], (words[i - 1] if i else "")
    opening = tuple(words[:2])
    return (opening, two, last), (opening, last), (two, last), last


class Endings:
    """How often sentences go on and end after their last words."""

    def __init__(self, texts: list[str]):
        self.seen: Counter = Counter()
        self.ends: Counter = Counter()
        for t in texts:
            self.add(t)

    def add(self, text: str | None) -> None:
        t = (text or "").strip()
        if not t.rstrip(_STRIP).endswith((".", "!", "?")) or t.rstrip(_STRIP).endswith("..."):
            return
        for a, z in sentences(t):
            if "|" in t[a:z]:
                continue
            words = classes(t[a:z])
            for i in range(len(words)):
                for k in _keys(words, i):
                    self.seen[k] += 1
            if words:
                for k in _keys(words, len(words) - 1):
                    self.ends[k] += 1

    @staticmethod
    def last(text: str) -> tuple | bool:
        """The keys of the last words; or whether the text breaks off, where no count is needed for that."""
        t = text.strip()
        bare = t.rstrip(_STRIP)
        if bare.endswith((".", "!", "?", "。")) and not bare.endswith(("..", "…")):
            return False
        spans = sentences(t)
        if not spans:
            return False
        words = classes(t[spans[-1][0] :])
        return _keys(words, len(words) - 1) if words else len(spans) == 1

    def broken(self, text: str) -> bool:
        """Whether the text breaks off before its last sentence is complete."""
        keys = self.last(text)
        if isinstance(keys, bool):
            return keys
        if self.seen[keys[-1]] < 2:
            return True
        for k in keys:
            n = self.seen[k]
            if n >= KNOWN:
                return self.ends[k] < LIKELY * n
        return True


def key_number(key) -> int:
    """A key of the counts as a signed number of 64 bits."""
    import xxhash

    h = xxhash.xxh64_intdigest(repr(key))
    return h - (1 << 64) if h >> 63 else h


def ending_counts(texts: DataFrame) -> DataFrame:
    """Partial counts (key, seen, ends) over all texts (text)."""

    def make():
        def step(b):
            e = Endings(b["text"])
            return {"key": list(map(key_number, e.seen)), "seen": list(e.seen.values()), "ends": [e.ends[k] for k in e.seen]}

        return step

    return arrow_rows(texts.select("text"), "key long, seen long, ends long", make)


def open_ends(last: DataFrame, texts: DataFrame) -> DataFrame:
    """(first, broken) of the distinct last words (last: key numbers, the most specific first), as Endings of all texts judges them."""
    each = last.select("last").distinct().select(F.col("last")[0].alias("first"), F.posexplode("last").alias("pos", "key"))
    total = ending_counts(texts).groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))
    met = each.join(total, "key", "left")
    known = F.when(F.col("seen") >= KNOWN, F.struct("pos", (F.col("ends") < LIKELY * F.col("seen")).alias("broken")))
    judged = met.groupBy("first").agg(F.min(known).alias("k"), F.max(F.when(F.col("pos") == 3, F.coalesce("seen", F.lit(0)))).alias("word"))
    return judged.select("first", ((F.col("word") < 2) | F.coalesce("k.broken", F.lit(True))).alias("broken"))


def copied(prompt: str, response: str) -> bool:
    """Whether the response repeats the prompt or part of it."""
    body = response
    lead = body.find(":")
    if 0 <= lead < 60 and body[lead + 1 : lead + 2] in ("\n", " "):
        after = body[lead + 1 :]
        if len(after) > len(body) // 2:
            body = after
    plain = _PLAIN.sub("", body.lower())
    if not plain:
        return False
    head = _PLAIN.sub("", prompt[: 4 * len(body) + 200].lower())
    if len(plain) >= 20 and (plain in head or plain in _PLAIN.sub("", prompt.lower()) or len(plain) > 40 and len(commonprefix((head, plain))) >= COPIED * len(plain)):
        return True
    d = _TOKEN.findall(body.lower())
    if len(d) < RUN + 3:
        return False
    c = _TOKEN.findall(prompt.lower())
    have = set(zip(*(c[i:] for i in range(RUN))))
    runs = list(zip(*(d[i:] for i in range(RUN))))
    return sum(r in have for r in runs) >= COPIED * len(runs)


def placeholder(response: str | None) -> bool:
    plain = _PLAIN.sub("", (response or "").lower())
    return not plain or plain in PLACEHOLDERS


def refusal(response: str) -> bool:
    return REFUSALS.search(response.lower()) is not None


def defects(pairs: DataFrame, keys: dict[str, str], models) -> DataFrame:
    """keys and defect (null where there is none) of each pair (keys, prompt, response, compare).

    models is a broadcast of the language models; compare false leaves the languages out.
    """
    names = tuple(keys)

    def make():
        table = WordBits(models.value)

        def step(b):
            prompts, responses = b["prompt"], b["response"]
            out: list[str | None] = [None] * len(responses)
            judged = []
            for i, (p, r) in enumerate(zip(prompts, responses)):
                if placeholder(r):
                    out[i] = "empty"
                elif p and copied(p, r):
                    out[i] = "copied"
                elif refusal(r):
                    out[i] = "refusal"
                else:
                    judged.append(i)
            told = [i for i in judged if b["compare"][i] and prompts[i]]
            both, n = table.of([x for i in told for x in (prompts[i], responses[i])])
            lead = np.sort(both, axis=1)
            sure = (lead[:, 1] - lead[:, 0] >= SURE) & (n >= 4) if len(both) else np.zeros(0, bool)
            best = both.argmin(axis=1) if len(both) else np.zeros(0, int)
            for k, i in enumerate(told):
                a, z = 2 * k, 2 * k + 1
                if sure[a] and sure[z] and best[a] != best[z]:
                    parts, m = table.of([prompts[i][x:y] for x, y in sentences(prompts[i])])
                    if not ((parts.argmin(axis=1) == best[z]) & (m >= 4)).any():
                        out[i] = "other_language"
            last: list[list[int] | None] = [None] * len(responses)
            for i in judged:
                if out[i] is None:
                    got = Endings.last(responses[i])
                    if got is True:
                        out[i] = "truncated"
                    elif got:
                        last[i] = list(map(key_number, got))
            return {**{k: b[k] for k in names}, "defect": out, "last": last}

        return step

    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", defect string, last array<long>"
    judged = cut(arrow_rows(pairs.select(*names, "prompt", "response", "compare"), schema, make))
    left = judged.where("last IS NOT NULL").withColumn("first", F.col("last")[0])
    ends = open_ends(left, pairs.where("response IS NOT NULL").select(F.col("response").alias("text")))
    told = left.join(ends, "first").select(*names, F.when(F.col("broken"), "truncated").alias("defect"))
    return judged.where("last IS NULL").select(*names, "defect").unionByName(told)

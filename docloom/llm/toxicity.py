"""Abusive, hateful and sexual language by a classifier chain.

Categories are predicted one after another (CHAIN), each by a linear model that also gets the
probabilities of the categories before it.  For training those are out-of-fold predictions, so a
later model sees earlier ones make the errors they make on new texts.  Rows whose last sentences begin
alike are in one fold, and all that is taken from the samples (names of groups, words of harmless
mentions) is taken from the other folds, so what is held out is new to the model that scores it.

Models see hashed n-grams, of words, of word pairs and of the characters of words, and counts of
words of the public word lists below, some of them together.  Every sentence is scored; no
list decides whether.  A document has the highest score of its sentences in each category.

Writing meant to hide words is undone first: invisible characters, letters set apart, stretched
letters, digits and signs for letters, signs inside words.

Defined cases: null, empty and blank texts score 0 in all categories, and so do texts without a
word; texts of any length are scored whole; repeated rows score alike; null sources form a group of
their own in the rates; training on an empty sample table gives scores of 0.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

CHAIN = ("sexual", "hateful", "abusive")
FOLDS = 5
#: Labelled rows that training takes at most.
LABELLED = 20_000
AT_LEAST = 0.5

# Word lists: beginnings of words in lower case; those with $ are whole words.
INSULTS = (
    "idiot imbecil imbécil moron nincompoop buffoon simpleton numbskull blockhead dunce$ scoundrel lowlife$ sleazebag bellend$ tosser$ bugger$ cunt cocksucker cretin crétin dimwit halfwit nitwit dumbass jackass asshole arsehole scumbag dirtbag douche bastard$ bastards$ bitch "
    "whore slut$ wanker twat prick$ jerk$ fool$ loser clown$ swine pig$ scum$ crap$ shit bullshit fuck piece-of-shit garbage$ turd wretch coward liar$ maggot weasel$ parasite$ bugiard mentiros menteur "
    "depp$ trottel arschloch schwein$ mistkerl drecksau wichser hurensohn dummkopf vollidiot versager lügner$ schlampe penner$ abschaum$ "
    "gilipoll cabrón cabron$ mierda hijo-de-puta puta$ puto$ pendejo capullo basura$ desgraciad tont[oa]$ estúpid cerdo$ asqueros escoria "
    "connard connasse pauvre-con sale-con salaud salope salopard ordure abruti crétin bouffon enfoiré merde pourriture raclure gueule$ "
    "lixo$ otári burro$ merda cabrão filho-da-puta canalha palhaço nojent porco$ desgraçad vagabund "
    "stronz coglion cretin deficient bastard[oi]$ pagliaccio schifos spazzatura verme$ vermi$ maiale feccia vaffanculo"
).split()
SLURS = (
    "stupid dumb$ useless worthless pathetic miserable brainless brain-dead braindead spineless slimy disgusting lying$ filthy ugly lousy rotten bloody$ damn miserably vile witless repulsive goddamn revolting wicked wretched hideous "
    "wertlos dumme[rs]?$ dreckig verlogen erbärmlich inútil patétic inutile$ sale$ pauvre$ minable seu$ sua$ inútil patetic inutil lurid"
).split()
THREATS = (
    "cut-your-throat slit-your-throat kill-you i-will-hurt you-will-die you-will-pay will-find-you come-for-you burn-your beat-you-up bring-dich-um te-voy-a-matar vais-te-tuer vou-te-matar ti-ammazzo rot-in-hell to-hell kill-yourself drop-dead shut-up get-lost damn-you hope-you-die should-slap who-drew you-suffer beat-you smash-your break-your "
    "halt-die verschwinde fahr-zur cállate vete-al muérete lárgate ferme-ta va-te-faire casse-toi va-au au-diable espèce-de crève cala-a vai-para cala-te some-daqui stai-zitt vai-all crepa$ sparisci"
).split()
PERSONS = "you$ your$ yourself dich$ du-bist du-dumm du-wert du-arsch dein tú$ eres$ toi$ tu-es és$ sei-un whoever$ nobody$ somebody$".split()
DEGRADING = (
    "vermin subhuman parasit inferior disease$ plague leech rats$ animals$ dirt$ thieves thief$ diebe$ ladron ladrão ladrões voleur ladri$ inférieur filth stain$ cockroach breed$ filthy too-stupid savage scum$ pest$ born-liar liars$ dirty$ "
    "ungeziefer minderwertig untermensch ratten$ seuche dreckig parasiten schmutz pack$ raza-inferior plaga$ ratas$ suci[oa]s?$ alimañas escoria basura$ "
    "vermine race-inférieure rats$ sales$ nuisibles parasites$ peste$ raça-inferior praga$ ratos$ suj[oa]s?$ escória razza-inferiore parassit sporchi$ topi$ feccia inferiore$ bestie$"
).split()
EXPELLING = (
    "wipe-out driven-out get-rid burn-down locked-in only-good keep-the send-the who-let do-not-want don't-want not-share not-sit never-trust deserves-to betrays-our hate$ dead-one out-of-here deport exterminat hang-them hang-all "
    "müssen-weg raus$ ausrott echarlos expuls fuera-de no-queremos hay-que dehors$ virer dégage expulsos$ fora-com não-queremos devem-ser cacciat fuori-i$ vanno-cacciat non-vogliamo via-i$ sterminat"
).split()
SEXUAL = (
    "porn nude naked$ sex$ sexo$ sesso$ orgasm erotic horny aroused lustful swinger blowjob oral-sex having-sex casual-sex sex-tape uncensored topless nipple erection moan "
    "hookup xxx$ undressed escort taken-from-behind explicit bare-breast cam-model strip$ stripped stripper made-love half-undressed half-naked thigh begged cum$ cock$ lover couples$ performers$ parejas$ casais$ paaren$ coppie$ pussy dildo masturbat fetish slutty threesome kinky sweaty "
    "nackt geil bettelte stöhn ficken titten muschi desnud follar follam polla tetas coño cachond gemi[dr] rogó suplicó nue$ nus$ baiser$ seins$ bite$ chatte$ excit suppli gémi "
    "nua$ nus$ foder gozar tesão implorou transar peitos nud[aieo]$ scopar eccitat implor orgasmo cazzo$ figa$ tette amant"
).split()
#: Groups of people beside those that the labelled samples name.
GROUPS = (
    "foreigners immigrants migrants refugees women jews muslims blacks gypsies gays lesbians ausländer flüchtlinge frauen juden "
    "extranjeros inmigrantes mujeres étrangers immigrés femmes juifs estrangeiros imigrantes mulheres stranieri immigrati donne ebrei"
).split()
LISTS = {"insult": INSULTS, "slur": SLURS, "threat": THREATS, "person": PERSONS, "degrade": DEGRADING, "expel": EXPELLING, "sexual": SEXUAL}
#: Of these lists only hits beside the name of a group count.
OF_GROUPS = ("degrade", "expel")
#: Counts that a sentence has; "neutral" are words of harmless mentions that the samples show.
DENSE = (*(k for k in LISTS if k not in OF_GROUPS), "neutral", "group", "group_degrade", "group_expel", "insult_person", "slur_person", "two_sexual", "slur_insult")

#: What the models start from, as a person would weigh the lists: training moves the weights away from it as far as the samples say so.
PRIOR = {
    "sexual": {"sexual": 4.0, "two_sexual": 3.0, "neutral": -3.0},
    "hateful": {"group": 2.0, "group_degrade": 5.0, "group_expel": 5.0, "neutral": -3.0},
    "abusive": {"insult": 3.5, "slur_insult": 4.0, "insult_person": 4.0, "threat": 3.0, "neutral": -3.0},
}
#: Buckets of hashed n-grams; lengths of those of characters; penalties of weights of lists, n-grams, and earlier categories.
BUCKETS, GRAMS = 1 << 18, (3, 4, 5)
PENALTIES = (0.3, 0.5, 1.0)
CACHE = 300_000
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_APART = re.compile(r"(?<![^\W\d_])((?:[^\W\d_] ){2,}[^\W\d_])(?![^\W\d_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_INSIDE = re.compile(r"(?<=[^\W\d_])[_.·•](?=[^\W\d_])")
_SIGNS = str.maketrans("013457@$€!|", "oieastase" + "il")
_WORD = re.compile(r"[^\W_*#@$€]*[^\W\d_*#@$€][\w*#@$€]*(?:-[^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+|\s*\|\s*")


def plain(text: str) -> str:
    """The text in lower case with hidden writing undone as far as it needs no dictionary."""
    t = text.lower() if text.isascii() else _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower()
    t = _APART.sub(lambda m: m.group().replace(" ", ""), t)
    return _INSIDE.sub("", t)


class Lexicon:
    """Word lists with lookup of disguised words, and vectors of words."""

    def __init__(self, groups: set[str], neutral: set[str]):
        plain = {k: [w for w in v if "-" not in w] for k, v in LISTS.items()}
        self.lists = {k: re.compile("|".join(f"{w[:-1]}$" if w.endswith("$") else w for w in v)) for k, v in plain.items()}
        #: first word -> (list, the words after it)
        self.phrases: dict[str, list[tuple[int, tuple[str, ...]]]] = {}
        for no, v in enumerate(LISTS.values()):
            for w in v:
                if "-" in w:
                    first, *rest = w.rstrip("$").split("-")
                    self.phrases.setdefault(first, []).append((no, tuple(rest)))
        self.groups, self.neutral = groups | set(GROUPS), neutral
        self.parts = {x for k, v in self.phrases.items() for x in (k, *(y for _, p in v for y in p)) if len(x) > 3}
        self.stems = sorted({re.sub(r"\[.*?\]\??|[$?]", "", w) for v in plain.values() for w in v if len(w) > 3} | self.groups | self.parts)
        self.looked: dict[str, tuple[str, tuple[int, ...]]] = {}

    def kinds(self, word: str) -> tuple[int, ...]:
        """How often each list, the groups, and the harmless mentions have the word."""
        got = [int(p.match(word) is not None) for p in self.lists.values()]
        return (*got, int(word in self.groups), int(word in self.neutral))

    def look(self, word: str) -> tuple[str, tuple[int, ...]]:
        """The word undisguised, and its kinds."""
        got = self.looked.get(word)
        if got is None:
            got = self._look(word)
            if len(self.looked) > CACHE:
                self.looked.clear()
            self.looked[word] = got
        return got

    def _look(self, word: str) -> tuple[str, tuple[int, ...]]:
        none = (0,) * (len(LISTS) + 2)
        own = self.kinds(word) if "-" not in word else none
        if any(own) or word.isalpha() and not _STRETCHED.search(word):
            return word, own
        tries = []
        if any(c in word for c in "0123457@$€!") and any(c.isalpha() for c in word):
            tries += [word.translate(_SIGNS), word.replace("1", "l").translate(_SIGNS)]
        if _STRETCHED.search(word):
            tries += [_STRETCHED.sub(r"\1", word), _STRETCHED.sub(r"\1\1", word)]
        if "-" in word:
            tries += [word.replace("-", "")]
        if "*" in word or "#" in word:
            masked = re.escape(word).replace(r"\*", ".").replace(r"\#", ".")
            gap = re.compile(masked)
            tries += [t for t in self.stems if len(t) >= 4 and gap.match(t)] or [
                t + word[len(t) :] for t in self.stems if 4 <= len(t) < len(word) and re.fullmatch(re.escape(word[: len(t)]).replace(r"\*", ".").replace(r"\#", "."), t)
            ]
        for t in tries:
            kinds = self.kinds(t)
            if any(kinds) or t in self.parts:
                return t, kinds
        return (tries[0] if tries and "-" not in word else word), none


def _fnv(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Rows(dict):
    """Number of each word's row; a new word gets one."""

    def __init__(self, reader: Reader):
        super().__init__()
        self.reader = reader

    def __missing__(self, raw: str) -> int:
        self[raw] = no = self.reader.new(raw)
        return no

    def __reduce__(self):
        return _Rows, (self.reader,)


class Reader:
    """Vectors of sentences: counts of the lists, and the numbers of their words.

    A word's row is made once: its kinds, a hash, and the buckets of its n-grams.
    """

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.clear()

    def clear(self) -> None:
        self.rows = _Rows(self)
        self.table = np.zeros((1024, len(LISTS) + 2))
        self.hashes = np.zeros(1024, np.uint64)
        self.starts = np.zeros(1024, bool)
        self.words: list[str] = []
        self.flat: list[list[str]] = []
        self.grams: list[np.ndarray] = []

    def new(self, raw: str) -> int:
        import xxhash

        word, kinds = self.lexicon.look(raw)
        no = len(self.words)
        if no == len(self.table):
            self.table, self.hashes, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.hashes, self.starts))
        self.table[no], self.hashes[no] = kinds, xxhash.xxh64_intdigest(word)
        flat = re.split("[-'’]", word)
        self.starts[no] = any(w in self.lexicon.phrases for w in flat)
        self.words.append(word)
        self.flat.append(flat)
        w = f"^{word}$"
        self.grams.append(np.array([xxhash.xxh64_intdigest(g) % BUCKETS for g in {w, *(w[i : i + k] for k in GRAMS for i in range(len(w) - k + 1))}], np.int64))
        return no

    def read(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of the words of all sentences, number of words of each, counts for DENSE of each); every sentence has a word."""
        row = self.rows.__getitem__
        rows = [list(map(row, _WORD.findall(p))) for p in parts]
        sizes = np.array(list(map(len, rows)), np.int64)
        at = np.array([r for own in rows for r in own], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        kinds = np.add.reduceat(self.table[at], first, axis=0) if len(parts) else np.zeros((0, self.table.shape[1]))
        # phrases: only where a word begins one
        of = np.repeat(np.arange(len(parts)), sizes)
        for i in dict.fromkeys(of[self.starts[at]].tolist()) if len(at) else ():
            flat = [p for r in rows[i] for p in self.flat[r]]
            for j, w in enumerate(flat):
                if w not in self.lexicon.phrases:
                    continue
                for no, rest in self.lexicon.phrases[w]:
                    if len(flat) - j > len(rest) and all(flat[j + 1 + k].startswith(x) for k, x in enumerate(rest)):
                        kinds[i, no] += 1
        n = dict(zip((*LISTS, "group", "neutral"), kinds.T))
        n["person"] = n["person"] + n["threat"]
        one = lambda k: np.minimum(n[k], 1)
        n |= {"group_degrade": one("group") * n["degrade"], "group_expel": one("group") * n["expel"], "insult_person": n["insult"] * one("person")}
        n |= {"slur_person": n["slur"] * one("person"), "slur_insult": n["slur"] * one("insult"), "two_sexual": (n["sexual"] > 1).astype(float)}
        return at, sizes, np.minimum(np.stack([n[k] for k in DENSE], axis=1), 3.0) if len(parts) else np.zeros((0, len(DENSE)))

    def pairs(self, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, bucket) of each pair of neighbouring words."""
        of = np.repeat(np.arange(len(sizes)), sizes)
        h = self.hashes[at]
        same = of[1:] == of[:-1]
        return of[1:][same], (_fnv(h[:-1][same] * np.uint64(3) + h[1:][same]) % np.uint64(BUCKETS)).astype(np.int64)


def fit(rows: np.ndarray, cols: np.ndarray, data: np.ndarray, dense: np.ndarray, y: np.ndarray, penalty: np.ndarray, prior: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights (of the dense columns, then of the sparse ones, then the constant) of a logistic model penalised by their distance from prior.

    Sparse columns are (rows, cols, data); classes weigh alike.  By accelerated gradients, which always run alike.
    """
    n, d = dense.shape
    width = len(prior) - 1
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))

    def times(w):
        return dense @ w[:d] + np.bincount(rows, data * w[d + cols], n) + w[-1]

    def back(g):
        return np.concatenate([dense.T @ g, np.bincount(cols, data * g[rows], width - d), [g.sum()]])

    v = np.ones(width + 1)
    for _ in range(15):
        v = back(weight * times(v))
        v /= np.linalg.norm(v)
    pace = 1 / (0.25 * np.linalg.norm(back(weight * times(v))) * 1.05 + penalty.max())
    w, ahead, t = prior.copy(), prior.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(ahead), -30, 30)))
        new = ahead - pace * (back(weight * (p - y)) + penalty * (ahead - prior))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return w


class Chain:
    """The trained chain: scores of sentences."""

    def __init__(self, rows: list[tuple[str, str]]):
        """rows (text, label); labels out of CHAIN are none of them."""
        self.models: list[tuple[np.ndarray, np.ndarray, np.ndarray | None, float]] = []
        self.lexicon = Lexicon(*mentions(rows))
        self.reader = Reader(self.lexicon)
        if not rows:
            return
        import xxhash

        fold = np.array([xxhash.xxh64_intdigest(" ".join(_WORD.findall(_SENTENCE.split(plain(t).strip())[-1])[:3])) % FOLDS for t, _ in rows])
        labels = {c: np.array([lab == c for _, lab in rows], float) for c in CHAIN}
        whole = self._vectors(self.reader, rows)
        apart = [self._vectors(Reader(Lexicon(*mentions([r for r, k in zip(rows, fold) if k != f]))), rows) for f in range(FOLDS)]
        earlier = np.zeros((len(rows), 0))
        for category in CHAIN:
            out = np.zeros(len(rows))
            for f in range(FOLDS):
                if (fold == f).any():
                    w = self._fit(apart[f], earlier, labels[category], category, fold != f)
                    z = self._scores(apart[f], earlier, w)
                    out[fold == f] = 1 / (1 + np.exp(-np.clip(z[fold == f], -30, 30)))
            w = self._fit(whole, earlier, labels[category], category, np.ones(len(rows), bool))
            d, e = len(DENSE), earlier.shape[1]
            self.models.append((w[:d], w[d : d + e], w[d + e : -1], float(w[-1])))
            earlier = np.hstack([earlier, out[:, None]])
        self.held_out = {c: earlier[:, i] for i, c in enumerate(CHAIN)}
        self.grams = np.stack([m[2] for m in self.models], axis=1).astype(np.float32)
        self.models = [(a, b, None, c) for a, b, _, c in self.models]
        self.clear()

    @staticmethod
    def _vectors(reader: Reader, rows: list[tuple[str, str]]):
        """Vectors of texts: of each count the highest of its sentences; n-grams of all words."""
        own = [[s for s in _SENTENCE.split(plain(t)) if _WORD.search(s)] or ["-a-"] for t, _ in rows]
        at, sizes, dense = reader.read([s for ss in own for s in ss])
        many = np.array([len(ss) for ss in own])
        first = np.concatenate(([0], np.cumsum(many)[:-1]))
        words = np.add.reduceat(sizes, first)
        of = np.repeat(np.arange(len(rows)), words)
        share = 1 / np.sqrt(words)
        text_of = np.repeat(np.arange(len(rows)), many)
        pair_of, pair = reader.pairs(at, sizes)
        pair_of = text_of[pair_of]
        n = np.array([len(reader.grams[r]) for r in at])
        i = np.concatenate([np.repeat(of, n), pair_of])
        j = np.concatenate([*(reader.grams[r] for r in at), pair])
        return np.maximum.reduceat(dense, first, axis=0), i, j, share[i]

    @staticmethod
    def _fit(vectors, earlier, y, category, use) -> np.ndarray:
        dense, i, j, data = vectors
        full = np.hstack([dense, earlier])
        new = np.cumsum(use) - 1
        keep = use[i]
        have, cols = np.unique(j[keep], return_inverse=True)  # the weights of other buckets stay 0
        a, b, c = PENALTIES
        penalty = np.concatenate([np.full(len(DENSE), a), np.full(earlier.shape[1], c), np.full(len(have), b), [1e-3]])
        prior = np.zeros(len(penalty))
        for k, v in PRIOR[category].items():
            prior[DENSE.index(k)] = v
        w = fit(new[i[keep]], cols, data[keep], full[use], y[use], penalty, prior)
        d = full.shape[1]
        out = np.zeros(d + BUCKETS + 1)
        out[:d], out[d + have], out[-1] = w[:d], w[d:-1], w[-1]
        return out

    @staticmethod
    def _scores(vectors, earlier, w) -> np.ndarray:
        dense, i, j, data = vectors
        full = np.hstack([dense, earlier])
        return full @ w[: full.shape[1]] + np.bincount(i, data * w[full.shape[1] + j], len(full)) + w[-1]

    def clear(self) -> None:
        self.reader.clear()
        self.of_word = np.zeros((1024, len(CHAIN)))
        self.known = 0

    def probabilities(self, parts: list[str]) -> np.ndarray:
        """Probabilities in the order of CHAIN of sentences, each with a word."""
        reader = self.reader
        if len(reader.words) > CACHE:
            self.clear()
        at, sizes, dense = reader.read(parts)
        while len(self.of_word) < len(reader.words):
            self.of_word = np.concatenate([self.of_word, np.zeros_like(self.of_word)])
        for no in range(self.known, len(reader.words)):
            self.of_word[no] = self.grams[reader.grams[no]].sum(axis=0)
        self.known = len(reader.words)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        z = np.add.reduceat(self.of_word[at], first, axis=0).astype(float)
        pair_of, pair = reader.pairs(at, sizes)
        z += np.stack([np.bincount(pair_of, self.grams[pair, k], len(parts)) for k in range(len(CHAIN))], axis=1)
        z /= np.sqrt(sizes)[:, None]
        got = np.zeros((len(parts), len(CHAIN)))
        for k, (lists, before, _, constant) in enumerate(self.models):
            own = z[:, k] + dense @ lists + got[:, :k] @ before + constant
            got[:, k] = 1 / (1 + np.exp(-np.clip(own, -30, 30)))
        return got

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores in the order of CHAIN of texts."""
        own = [[s for s in _SENTENCE.split(plain(t)) if _WORD.search(s)] if t else [] for t in texts]
        best = np.zeros((len(texts), len(CHAIN)))
        have = [i for i, ss in enumerate(own) if ss]
        if have and self.models:
            p = self.probabilities([s for ss in own for s in ss])
            first = np.concatenate(([0], np.cumsum([len(own[i]) for i in have])[:-1]))
            best[have] = np.maximum.reduceat(p, first, axis=0)
        return best

    def score(self, text: str | None) -> tuple[float, ...]:
        return tuple(self.scores([text])[0].tolist())


def mentions(rows: list[tuple[str, str]]) -> tuple[set[str], set[str]]:
    """(names of groups of people, words of harmless mentions) that labelled rows (text, label) show.

    Names are words always capitalised inside sentences that hateful rows repeat and others hardly have.
    Words of harmless mentions stand in sentences, of rows that are none of CHAIN, that a list has a
    word of, and in no other row's.
    """
    names: dict[str, list[int]] = {}
    usual: set[str] = set()
    for text, label in rows:
        usual.update(w.lower() for w in re.findall(r"[^\W\d_]+", text) if w[0].islower())
        for s in re.split(r"(?<=[.!?])\s+", text):
            for w in re.findall(r"[^\W\d_]+", s):
                if w[0].isupper() and w[1:].islower() and len(w) > 3:
                    names.setdefault(w.lower(), [0, 0])[label == "hateful"] += 1
    groups = {w for w, (other, hate) in names.items() if hate >= 3 and hate > other and w not in usual}
    lexicon = Lexicon(groups, set())
    harmless: set[str] = set()
    others: set[str] = set()
    for text, label in rows:
        for s in _SENTENCE.split(plain(text)):
            found = _WORD.findall(s)
            if label in CHAIN:
                others.update(found)
            elif any(any(lexicon.look(w)[1]) for w in found):
                harmless.update(w for w in found if len(w) > 3 and not any(lexicon.look(w)[1]))
    return groups, harmless - others


def scores(docs: DataFrame, keys: dict[str, str], chain) -> DataFrame:
    """keys, abusive, hateful, sexual of each row (keys, text); chain is a broadcast Chain."""
    names = tuple(keys)

    def make():
        c = chain.value

        def step(b):
            got = c.scores(b["text"])
            return {**{k: b[k] for k in names}, **{cat: got[:, i] for i, cat in enumerate(CHAIN)}}

        return step

    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + "".join(f", {c} double" for c in CHAIN)
    return arrow_rows(docs.select(*names, "text"), schema, make).select(*names, "abusive", "hateful", "sexual")


def rates(scored: DataFrame, at_least: float = AT_LEAST) -> DataFrame:
    """source, documents, and the share of documents at or above the score in each category."""
    share = lambda c: F.avg((F.col(c) >= at_least).cast("double")).alias(f"{c}_rate")
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), *(share(c) for c in ("abusive", "hateful", "sexual")))

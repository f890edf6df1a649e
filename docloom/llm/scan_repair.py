"""Repair of text read from scanned pages.

Words of all texts are counted first, apart for running lines and for lines set like titles.  The
commonest words are the vocabulary, held as a trie; lines that recur in a file give the words that
mark running headers.  Each text is then repaired:

* furniture: lines set like titles that hold header words, and printed page numbers, alone or beside
  such a line, are removed;
* hyphenation: a word broken across a line end is joined, unless the hyphen belongs to a known
  compound;
* characters: a token outside the vocabulary, or far rarer in it than a word it looks like, is looked
  up in the trie by intersecting it with the token's Levenshtein automaton, which yields every word
  within DISTANCE edits.  Of those whose difference is made of confusions of shapes only, words that
  stand beside the same neighbours elsewhere in the text come first, then those that the text has, then the more frequent;
* spelling: in a text with any of these damages, a token that no text has and no confusion explains becomes a word one edit away
  where that stands beside the same neighbour elsewhere in the text;
* reflow: lines of a paragraph are joined; list items, table rows and blank lines keep their place.

Defined cases: null texts give no row, blank ones no damage; texts of any length are repaired whole;
repeated rows are repaired alike; a damage is reported for a text once; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import arrow_rows

#: Most words of the vocabulary, and the least count of one.
VOCABULARY, LEAST = 100_000, 4
DISTANCE = 2
#: A word that is known but looks like one so many times as frequent is taken for damaged.
RARER = 20
#: Words of this share of all are never damaged.
SURE = 2e-5
#: Least letters of a token that is read as a word without a confusion of shapes.
SPELLED = 5
DAMAGES = ("hyphenation", "characters", "header", "page_number")

#: Shapes that are taken for others, (printed, read).
CONFUSIONS = (
    ("e", "c"), ("a", "@"), ("t", "†"), ("i", "|"), ("i", "1"), ("l", "1"), ("l", "|"), ("o", "0"), ("s", "5"), ("g", "9"), ("b", "6"),
    ("z", "2"), ("b", "8"), ("n", "ri"), ("d", "cl"), ("u", "ii"), ("m", "rn"), ("h", "li"), ("w", "vv"), ("s", "$"), ("c", "¢"), ("e", "€"),
)
_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    _BY_FIRST.setdefault(_a, []).append((_a, _b))
# longer shapes first, so that 'cl' is one shape and not a 'c'
_READ = re.compile("|".join(re.escape(b) for b in sorted({b for _, b in CONFUSIONS}, key=lambda b: (-len(b), b))) + "|�")
_FROM = str.maketrans("@†|01569", "atioisbg")

HYPHENS = "\\-¬‐‑\u00ad"
WORD = re.compile(r"(?<![\w-])[^\W\d_]+(?:-[^\W\d_]+)?(?![\w-])")
TOKEN = re.compile(r"[^\s.,;:()\"'’«»“”·/\\<>=+*~#&%?!\[\]{}^" + HYPHENS + r"–—…]+")
LINE_END = re.compile(rf"[{HYPHENS}][^\S\n]*\n\s*")
LEFT = re.compile(r"[\w@†|�]*(?:[^\W\d_]|[^\W\d_][@†|�\d])$")
RIGHT = re.compile(r"[^\W_A-Z@†|�][\w@†|�]*|[@†|�\d][\w@†|�]*[^\W\d_][\w@†|�]*|[A-ZÀ-Þ]+\b")
_PAGE = r"(?:page|seite|blatt|página|pagina|pág\.?|pag\.?|p\.|s\.)"
PAGE_LINE = re.compile(rf"[-—–~*\[({{|\s]*(?:{_PAGE}\s*)?\d{{1,4}}(?:\s*(?:/|of|von|de|di|sur)\s*\d{{1,4}})?[-—–~*\])}}|\s]*", re.I)
PAGE_BEFORE = re.compile(rf"^\s*[-—–~\[(]*\s*(?:{_PAGE}\s*)?(\d{{1,4}})\s*[-—–~\])]*\s*(?:[|·•]|\s{{2,}})\s*", re.I)
PAGE_AFTER = re.compile(rf"(?:\s*[|·•]\s*|\s+)[-—–~\[(]*\s*(?:{_PAGE}\s*)?(\d{{1,4}})\s*[-—–~\])]*\s*$", re.I)
_NUMBERED = re.compile(r"(?:volume|vol\.?|band|bd\.?|tome|tomo|no\.?|nr\.?|part|issue)\s*$", re.I)
_ITEM = re.compile(r"\s*(?:[-*•|#>]|\d{1,3}[.)]\s)")
_LETTERS = re.compile(r"[^\W\d_][^\W_]*")


def unspaced(line: str) -> str:
    """The line with letters set apart drawn together; words are then two spaces or more from one another."""
    parts = line.split()
    if len(parts) >= 6 and sum(len(p) == 1 for p in parts) >= 0.7 * len(parts):
        return " ".join(w.replace(" ", "") for w in re.split(r"\s{2,}", line.strip()))
    return line


def title_words(line: str) -> list[str] | None:
    """Words of a line set like a title, in lower case; None for any other line."""
    s = line.strip()
    if len(s) <= 3 or s[-1] in ".,;!?" or _ITEM.match(s) and not PAGE_BEFORE.match(s):
        return None
    s = unspaced(s)
    words = _LETTERS.findall(s.replace("@", "a").replace("†", "t"))
    if not words:
        return None
    for w in words:
        if w[0].islower() and len(w) > 3:
            return None
    return [w.lower() for w in words]


def counts(texts: DataFrame) -> DataFrame:
    """Partial counts (word, n_text, n_cap) of running lines, and a row (file, key, text_no) for each line set like a title.

    texts has text and file; key is the line's letters.
    """

    def make():
        def step(b):
            run: Counter = Counter()
            out: dict[str, list] = {k: [] for k in ("word", "n_text", "n_cap", "file", "key", "text_no")}
            for t, file in zip(b["text"], b["file"]):
                for line in t.split("\n"):
                    words = title_words(line)
                    if words is None:
                        run.update(WORD.findall(line))
                    else:
                        for k, v in zip(out, (None, 0, 0, file, " ".join(w.translate(_FROM) for w in words), zlib.crc32(t.encode('utf-8', 'replace')))):
                            out[k].append(v)
            every: Counter = Counter()
            caps: Counter = Counter()
            for w, n in run.items():
                every[w.lower()] += n
                if w[0].isupper():
                    caps[w.lower()] += n
            for w, n in every.items():
                for k, v in zip(out, (w, n, caps[w], None, None, 0)):
                    out[k].append(v)
            return out

        return step

    return arrow_rows(texts.select("text", "file"), "word string, n_text long, n_cap long, file string, key string, text_no long", make)


def header_words(part: DataFrame) -> DataFrame:
    """Words of running headers: of title lines that recur in a file, mostly, in two files or more, and not capitalised in running text."""
    lines = part.where("key IS NOT NULL").groupBy("file", "key").agg(F.countDistinct("text_no").alias("n"))
    words = lines.select("file", "n", F.explode(F.array_distinct(F.split("key", " "))).alias("word")).where(F.length("word") > 3)
    again = F.col("n") > 1
    seen = words.groupBy("word").agg(
        F.sum("n").alias("n_title"), F.sum(F.when(again, F.col("n")).otherwise(0)).alias("n_again"), F.countDistinct(F.when(again, F.col("file"))).alias("files")
    )
    caps = part.where("word IS NOT NULL").groupBy("word").agg(F.sum("n_cap").alias("n_cap"))
    return (
        seen.where("files >= 2 AND 2 * n_again >= n_title")
        .join(caps, "word", "left")
        .where(F.coalesce("n_cap", F.lit(0)) * 5 <= F.col("n_title"))
        .select("word")
    )


class Trie:
    """Words by their letters; words within some edits of another are found without passing over the rest."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, token: str, most: int) -> list[str]:
        """Every word within most edits: the automaton's states are bits, one row for each number of edits."""
        n = len(token)
        at: dict[str, int] = {}
        for i, c in enumerate(token):
            at[c] = at.get(c, 0) | 1 << i
        full, goal, found = (1 << n + 1) - 1, 1 << n, []
        stack = [(self.root, tuple((1 << e + 1) - 1 for e in range(most + 1)))]
        while stack:
            node, rows = stack.pop()
            for c, child in node.items():
                if c == "":
                    if rows[most] & goal:
                        found.append(child)
                    continue
                m = at.get(c, 0)
                new = [(rows[0] & m) << 1]
                for e in range(1, most + 1):
                    new.append((((rows[e] & m) << 1) | rows[e - 1] | rows[e - 1] << 1 | new[-1] << 1) & full)
                if new[most]:
                    stack.append((child, tuple(new)))
        return found


def looks_like(read: str, printed: str) -> int:
    """Number of confusions that turn printed into read; 0 where none do."""
    best: dict[tuple[int, int], int] = {}

    def go(i: int, j: int) -> int:
        if (i, j) in best:
            return best[i, j]
        if i == len(printed):
            return 0 if j == len(read) else 99
        if j == len(read):
            return 99
        got = go(i + 1, j + 1) if printed[i] == read[j] else 99
        if read[j] == "�":
            got = min(got, 1 + go(i + 1, j + 1))
        for a, b in _BY_FIRST.get(printed[i], ()):
            if printed.startswith(a, i) and read.startswith(b, j):
                got = min(got, 1 + go(i + len(a), j + len(b)))
        best[i, j] = got
        return got

    n = go(0, 0)
    return n if 0 < n < 99 else 0


class Repairer:
    def __init__(self, rows: list[tuple[str, int]], headers: set[str]):
        """rows (word, count) of the vocabulary; headers are the words of running headers."""
        self.n = dict(rows)
        self.headers = headers
        total = max(1, sum(self.n.values()))
        self.frequent = {w for w, n in self.n.items() if n >= max(LEAST, SURE * total)}
        self.trie = Trie(w for w in self.frequent | headers if len(w) > 2 and "-" not in w)
        self.known: dict[str, tuple[str, ...]] = {}

    def candidates(self, token: str) -> tuple[str, ...]:
        """Words that a token was misread for, the more frequent first; none for an undamaged one."""
        got = self.known.get(token)
        if got is None:
            got = ()
            letters = sum(c.isalpha() for c in token)
            sites = _READ.findall(token) if len(token) >= 3 and letters * 2 > len(token) and len(token) - letters <= DISTANCE else []
            if sites and not re.fullmatch(r"[a-z]\d+", token):
                own = self.n.get(token, 0)
                # one shape of one letter is one edit; more of them, or one of two letters, are two
                for d in range(1, DISTANCE + 1 if len(sites) > 1 or len(sites[0]) > 1 else 2):
                    near = [(w, looks_like(token, w)) for w in self.trie.within(token, d)]
                    near = [w for w, k in near if k and self.n.get(w, RARER) >= RARER * own]
                    if near:
                        got = tuple(sorted(near, key=lambda w: (-self.n.get(w, 0), w)))
                        break
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[token] = got
        return got

    def spellings(self, token: str) -> tuple[str, ...]:
        """Words at one edit of a token of letters that no text has."""
        key = f" {token}"
        got = self.known.get(key)
        if got is None:
            plain = len(token) >= SPELLED and token.isalpha() and token not in self.n
            got = self.known[key] = tuple(sorted(self.trie.within(token, 1))) if plain else ()
        return got

    @staticmethod
    def _in_context(order: list[str], unknown: set[str]) -> dict[str, Counter]:
        """For each unknown token the words that stand elsewhere beside one of its neighbours, with how many of these they stand beside."""
        after: dict[str, set[str]] = {}
        before: dict[str, set[str]] = {}
        for a, b in zip(order, order[1:]):
            after.setdefault(a, set()).add(b)
            before.setdefault(b, set()).add(a)
        out: dict[str, Counter] = {x: Counter() for x in unknown}
        for i, x in enumerate(order):
            if x in out:
                if i:
                    out[x].update(after[order[i - 1]])
                if i + 1 < len(order):
                    out[x].update(before[order[i + 1]])
        return out

    def furniture(self, line: str) -> tuple[bool, bool]:
        """Whether a line is a running header, and whether it is or has a printed page number."""
        s = line.strip()
        if not s:
            return False, False
        if PAGE_LINE.fullmatch(s) and not re.fullmatch(r"[\s|:-]*", s) and not s.startswith("|"):
            return False, True
        words = title_words(line)
        if words is None:
            return False, False
        if not any(w in self.headers or w.translate(_FROM) in self.headers for w in words) and not any(c in self.headers for w in words if len(w) > 3 for c in self.candidates(w)):
            return False, False
        s = unspaced(s)
        number = PAGE_BEFORE.match(s)
        if not number:
            after = PAGE_AFTER.search(s)
            if after and not _NUMBERED.search(s[: after.start()]) and not (len(after.group(1)) == 4 and 1500 <= int(after.group(1)) < 2100):
                number = after
        return True, number is not None

    def repair(self, text: str) -> tuple[str, list[str]]:
        """The repaired text and the damages it had."""
        found: set[str] = set()
        t = text.replace("\r\n", "\n").replace("\r", "\n")
        tokens = set(TOKEN.findall(t.lower()))
        kept = []
        lines = t.split("\n")
        for line in lines:
            header, page = self.furniture(line)
            if header:
                found.add("header")
            if page:
                found.add("page_number")
            if not (header or page):
                kept.append(line)
        if len(kept) < len(lines):
            t = "\n".join(self._closed(kept, lines))
        here = {x for x in tokens if x in self.frequent}

        parts, at = [], 0
        for m in LINE_END.finditer(t):
            left = LEFT.search(t[max(at, m.start() - 40) : m.start()])
            right = RIGHT.match(t, m.end())
            if not left or not right:
                continue
            a, b = left.group().lower(), right.group().lower()
            whole, compound = self.n.get(a + b, 0), self.n.get(f"{a}-{b}", 0)
            mere = m.group()[0] == "-" and not whole and a in self.frequent and b in self.frequent and not self.candidates(a + b)
            parts.append(t[at : m.start()])
            if compound > whole or mere:
                parts.append("-")
            else:
                found.add("hyphenation")
            at = m.end()
        if parts:
            t = "".join(parts) + t[at:]
        after = {x.strip("|") for x in TOKEN.findall(t.lower())} if t is not text else {x.strip("|") for x in tokens}
        wrong = {}
        options: dict[str, tuple[str, ...]] = {}
        for x in after | tokens:
            if x and x not in self.frequent:
                c = self.candidates(x)
                # halves of a broken word are no misread words
                if c and (x in after or self._whole(x, text)):
                    wrong[x] = next((w for w in c if w in here), c[0])
                    if len(c) > 1:
                        options[x] = c
        if wrong:
            found.add("characters")
        spelled = {x: c for x in after if found and x not in wrong and (c := self.spellings(x))}
        if options or spelled:
            near = self._in_context([x.strip("|") for x in TOKEN.findall(t.lower())], options.keys() | spelled.keys())
            for x, c in options.items():
                wrong[x] = max(c, key=lambda w: (near[x][w], w in here, -c.index(w)))
            for x, c in spelled.items():
                best = max(c, key=lambda w: (near[x][w], self.n.get(w, 0), w))
                if near[x][best]:
                    wrong[x] = best
                    found.add("spelling")
        if wrong:
            t = TOKEN.sub(lambda m: self._cased(m.group(), wrong), t)
        return reflow(t), sorted(found)

    @staticmethod
    def _whole(token: str, text: str) -> bool:
        return re.search(rf"(?<![\w{HYPHENS}]){re.escape(token)}(?![\w{HYPHENS}])", text.lower()) is not None

    @staticmethod
    def _closed(kept: list[str], lines: list[str]) -> list[str]:
        """Lines left after furniture, without the blank lines that stood around it inside a sentence."""
        out: list[str] = []
        for line in kept:
            if not line.strip() and out and out[-1].strip() and not out[-1].rstrip().endswith((".", "!", "?", ":", "|")):
                continue
            out.append(line)
        return out

    @staticmethod
    def _cased(token: str, wrong: dict[str, str]) -> str:
        bare = token.strip("|")
        word = wrong.get(bare.lower())
        if word is None:
            return token
        letters = [c for c in bare if c.isalpha()]
        if len(letters) > 1 and all(c.isupper() for c in letters):
            word = word.upper()
        elif bare[0].isupper() or (not bare[0].isalpha() and len(letters) > 3 and letters[0].isupper()):
            word = word[0].upper() + word[1:]
        return token.replace(bare, word)


def reflow(text: str) -> str:
    """Paragraphs on one line each."""
    out: list[str] = []
    for block in re.split(r"\n[^\S\n]*\n\s*", text):
        lines: list[str] = []
        for line in block.split("\n"):
            s = line.strip()
            if not s:
                continue
            if lines and not _ITEM.match(line):
                lines[-1] += " " + s
            else:
                lines.append(s)
        if lines:
            out.append("\n".join(lines))
    return "\n\n".join(out)


def vocabulary(texts: DataFrame, size: int = VOCABULARY) -> tuple[list[tuple[str, int]], set[str]]:
    """The size commonest words of all texts with their counts, and as many words of running headers at most."""
    part = cut(counts(texts))
    words = part.where("word IS NOT NULL").groupBy("word").agg(F.sum("n_text").alias("n")).where(F.col("n") >= LEAST)
    best = words.orderBy(F.desc("n"), "word").limit(size).collect()
    heads = header_words(part).orderBy("word").limit(size).collect()
    return [(r[0], r[1]) for r in best], {r[0] for r in heads}


def repaired(texts: DataFrame, keys: dict[str, str], size: int = VOCABULARY) -> DataFrame:
    """keys, damages, repaired of each row (keys, text, file)."""
    names = tuple(keys)
    words = texts.sparkSession.sparkContext.broadcast(vocabulary(texts.where("text IS NOT NULL"), size))

    def make():
        r = Repairer(*words.value)

        def step(b):
            got = [r.repair(t) for t in b["text"]]
            return {**{k: b[k] for k in names}, "damages": [d for _, d in got], "repaired": [t for t, _ in got]}

        return step

    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", damages array<string>, repaired string"
    return arrow_rows(texts.where(F.col("text").isNotNull()).select(*names, "text"), schema, make)

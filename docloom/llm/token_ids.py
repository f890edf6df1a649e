"""Ids of a public byte-level BPE tokenizer, with chunks shared between texts encoded once.

Texts are cut where a rolling hash of the last bytes hits a mask, so equal stretches fall into
equal chunks wherever they stand.  Chunks are known by 128 bits of their hash: only these hashes are
shuffled to find the chunks that stand in several texts.  A text without any is encoded where it is
read.  Shared chunks are encoded once each, and texts that have one are put together from ids.

A chunk's own ids are right only away from its ends.  Between a letter or digit and a space the
tokenizer's pattern always splits, and what it does on one side depends on nothing on the other, so ids
between the first and the last such point of a chunk stand in every text that has the chunk.  At every join
the text from the last point before it to the first one after it is encoded again; where a chunk has no
such point the open text grows by the next chunk.  So joined ids agree exactly with those of the whole text.

Defined cases: null and empty texts have the empty list; strings of special tokens are ordinary
text; repeated rows are all returned; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import arrow_rows, bounded, tasks

#: Sizes of chunks in characters; on average a chunk goes on AVERAGE bytes beyond the least size.
LEAST, AVERAGE, MOST = 1024, 2048, 16_384
WINDOW = 16
#: A point where the pattern of the public byte-level tokenizers always splits.
_POINT = re.compile(r"[^\W_](?= )")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """The tokenizer of a rank file."""

    def __init__(self, ranks: str, pattern: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        #: split points are known of this pattern only; texts of another are encoded whole
        self.has_points = pattern in (None, public_tokenizers.PATTERN)

    def ids(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)


def _gear() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


_GEAR = _gear()


def chunks(texts: list[str]) -> list[list[str]]:
    """Content-defined chunks of each text; joined they are the text."""
    long = [t for t in texts if len(t) > LEAST]
    if not long:
        return [[t] if t else [] for t in texts]
    # the window never reaches back into another text where it counts, beyond LEAST characters
    own = [t.encode("utf-8", "surrogatepass") for t in long]
    raw = np.frombuffer(b"".join(own), np.uint8)
    mixed = _GEAR[raw]
    roll = np.zeros(len(raw), np.uint32)
    for k in range(WINDOW):
        roll[k:] += mixed[: len(raw) - k] << np.uint32(2 * k)
    lead = (raw & 0xC0) != 0x80  # first byte of a character
    hit = (roll >> np.uint32(32 - int(np.log2(AVERAGE)))) == 0
    hit[:-1] &= lead[1:]  # a chunk ends only between characters
    at_byte = np.concatenate(([0], np.cumsum([len(x) for x in own])))
    at_char = np.concatenate(([0], np.cumsum([len(t) for t in long])))
    hits = np.flatnonzero(hit)
    ends = np.cumsum(lead)[hits]  # characters up to and with this byte
    spans = np.searchsorted(hits, at_byte)
    cut = iter([(ends[spans[i] : spans[i + 1]] - at_char[i]).tolist() for i in range(len(long))])
    out = []
    for t in texts:
        n = len(t)
        if n <= LEAST:
            out.append([t] if t else [])
            continue
        mine, parts, at = next(cut), [], 0
        while n - at > LEAST:
            i = bisect_left(mine, at + LEAST)
            to = min(mine[i] if i < len(mine) else n, at + MOST, n)
            parts.append(t[at:to])
            at = to
        if at < n:
            parts.append(t[at:])
        out.append(parts)
    return out


def encode_chunk(enc: Encoder, chunk: str) -> tuple[str, list[int] | None, str]:
    """The text before the first split point, the ids up to the last one, the text after it; no ids where there is no point."""
    first = _POINT.search(chunk) if enc.has_points else None
    if first is None:
        return chunk, None, ""
    a, z = first.end(), chunk.rfind(" ")
    while z > a and not chunk[z - 1].isalnum():
        z = chunk.rfind(" ", a, z)
    z = max(z, a)
    return chunk[:a], enc.ids(chunk[a:z]), chunk[z:]


def join_chunks(enc: Encoder, parts: list[tuple[str, list[int] | None, str]]) -> list[int]:
    """Ids of the joined text from (head, ids, tail) of its chunks in order."""
    out: list[int] = []
    open_text = ""
    for head, ids, tail in parts:
        open_text += head
        if ids is not None:
            out += enc.ids(open_text)
            out += ids
            open_text = tail
    return out + enc.ids(open_text)


def _number(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def chunk_hashes(docs: DataFrame) -> DataFrame:
    """(t1, t2, seq, c1, c2) of the chunks of each row of docs (t1, t2, text): hashes of text and chunk."""

    def make():
        import xxhash

        def step(b):
            out: dict[str, list] = {k: [] for k in ("t1", "t2", "seq", "c1", "c2")}
            for t1, t2, parts in zip(b["t1"], b["t2"], chunks(b["text"])):
                for i, c in enumerate(parts):
                    h = xxhash.xxh3_128_intdigest(c.encode("utf-8", "surrogatepass"))
                    for k, v in zip(out, (t1, t2, i, _number(h >> 64), _number(h & (1 << 64) - 1))):
                        out[k].append(v)
            return out

        return step

    return arrow_rows(docs.select("t1", "t2", "text"), "t1 long, t2 long, seq int, c1 long, c2 long", make)


def token_ids(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row of docs (doc_id, text).

    Texts with a chunk that stands twice or more meet their chunks' ids by shuffling; the others never
    leave their task.
    """
    path = ranks or default_ranks()
    none = F.array().cast("array<int>")
    empty = docs.where("text IS NULL OR text = ''").select("doc_id", none.alias("ids"))
    full = docs.where("text <> ''").select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    text, chunk = ["t1", "t2"], ["c1", "c2"]
    hashes = store(chunk_hashes(full))
    shared = hashes.groupBy(*chunk).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*chunk)
    some = bounded(hashes.join(shared, chunk, "left_semi").select(*text).distinct())

    def whole():
        enc = Encoder(path)
        return lambda b: {"doc_id": b["doc_id"], "ids": [enc.ids(t) for t in b["text"]]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    alone = arrow_rows(full.join(some, text, "left_anti").select("doc_id", "text"), f"doc_id {kind}, ids array<int>", whole)

    def encoder():
        enc = Encoder(path)

        def step(b):
            return {**{k: b[k] for k in chunk}, **dict(zip(("head", "ids", "tail"), map(list, zip(*(encode_chunk(enc, c) for c in b["chunk"])))))}

        return step

    def cutter():
        import xxhash

        def step(b):
            out: dict[str, list] = {k: [] for k in ("c1", "c2", "chunk")}
            for parts in chunks(b["text"]):
                for c in parts:
                    h = xxhash.xxh3_128_intdigest(c.encode("utf-8", "surrogatepass"))
                    for k, v in zip(out, (_number(h >> 64), _number(h & (1 << 64) - 1), c)):
                        out[k].append(v)
            return out

        return step

    joined = full.join(some, text, "left_semi")
    texts = joined.groupBy(*text).agg(F.first("text").alias("text"))
    distinct = arrow_rows(texts.select("text"), "c1 long, c2 long, chunk string", cutter).groupBy(*chunk).agg(F.first("chunk").alias("chunk"))
    coded = arrow_rows(distinct.repartition(tasks(docs), *chunk), "c1 long, c2 long, head string, ids array<int>, tail string", encoder)
    placed = hashes.join(some, text, "left_semi").dropDuplicates([*text, "seq"])
    parts = placed.join(coded, chunk).groupBy(*text).agg(F.array_sort(F.collect_list(F.struct("seq", "head", "ids", "tail"))).alias("parts"))

    def joiner():
        enc = Encoder(path)
        return lambda b: {**{k: b[k] for k in text}, "ids": [join_chunks(enc, [(p["head"], p["ids"], p["tail"]) for p in own]) for own in b["parts"]]}

    ids = arrow_rows(parts, "t1 long, t2 long, ids array<int>", joiner)
    return empty.unionByName(alone).unionByName(joined.select("doc_id", *text).join(ids, text).select("doc_id", "ids"))


def token_counts(docs: DataFrame, keys: dict[str, str], ranks: str | None = None) -> DataFrame:
    """keys and n_tokens of each row; null and empty texts have 0.  No shuffle."""
    path = ranks or default_ranks()
    names = tuple(keys)

    def make():
        enc = Encoder(path)
        return lambda b: {**{k: b[k] for k in names}, "n_tokens": [len(enc.ids(t)) if t else 0 for t in b["text"]]}

    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", n_tokens long"
    return arrow_rows(docs.select(*names, "text"), schema, make)

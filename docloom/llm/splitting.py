"""Cutting long texts at natural boundaries with overlap, by pointer doubling.

Every position of a text is joined to its farthest legal successor: the last paragraph, else
sentence or line, else word boundary that a piece starting `overlap` characters before the position
can reach within `limit`, else the limit itself.  A paragraph or sentence boundary is taken only
where the piece gets at least `fill` of the limit.  The successor table is then squared again and
again: after k squarings all of the first 2^k greedy cuts of every text of the batch are known, so
cuts are not found one after another.

Defined cases: texts of at most `limit` characters (empty ones too) stay whole and give no rows
here; null texts give none; texts without any boundary are cut at the limit; whole texts of any
length are cut, and joining the pieces without their overlaps gives back the text exactly.
Characters are code points.  Repeated rows give repeated pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

LIMIT, OVERLAP, FILL = 2000, 200, 0.5
#: Characters of all texts that are cut together, a longer text alone.
TOGETHER = 1_000_000
KINDS = ("limit", "word", "sentence", "paragraph", "end")
_SPACE = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)
#: Marks that end a sentence.
_STOPS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Level of the boundary before each position (0 none, 1 word, 2 sentence or line, 3 paragraph); one more than codes."""
    n = len(codes)
    level = np.zeros(n + 1, np.int8)
    if n < 2:
        return level
    space = np.isin(codes, _SPACE)
    newline = codes == 10
    at = np.flatnonzero(space[:-1] & ~space[1:]) + 1  # after a run of white space
    # positions of the last character that is no space, and of newlines before it
    idx = np.arange(n)
    last = np.maximum.accumulate(np.where(~space, idx, -1))[at - 1]
    lines = np.concatenate(([0], np.cumsum(newline)))
    in_run = lines[at] - lines[last + 1]
    ends = (last >= 0) & np.isin(codes[np.maximum(last, 0)], _STOPS)
    level[at] = np.where(in_run >= 2, 3, np.where((in_run == 1) | ends, 2, 1))
    return level


def cuts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP, fill: float = FILL) -> list[list[tuple[int, int, int]]]:
    """For each text the pieces (start, end, kind); kind indexes KINDS."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below limit")
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]  # node of each text's position 0
    n = int(sizes.sum() + len(texts))
    level, end = np.zeros(n, np.int8), np.zeros(n, np.int32)
    for f, c in zip(first, codes):
        level[f : f + len(c) + 1], end[f : f + len(c) + 1] = boundaries(c), f + len(c)
    node = np.arange(n, dtype=np.int32)
    begin = node - overlap
    starts = np.zeros(n, bool)
    starts[first] = True
    begin[starts] = node[starts]
    reach = np.minimum(np.maximum(begin, 0) + limit, end)
    least = np.minimum(node + 1, end)
    enough = np.maximum(begin + int(limit * fill), least)
    succ, kind = reach.copy(), np.zeros(n, np.int8)
    for want, floor in ((1, least), (2, enough), (3, enough)):
        near = np.maximum.accumulate(np.where(level >= want, node, -1))[reach]
        ok = near >= floor
        succ, kind = np.where(ok, near, succ), np.where(ok, np.int8(want), kind)
    done = reach == end
    succ, kind = np.where(done, end, succ).astype(np.int32), np.where(done, np.int8(4), kind)
    cut = starts.copy()
    jump = succ
    while True:
        known = np.flatnonzero(cut)
        cut[jump[known]] = True
        if cut.sum() == len(known):
            break
        jump = jump[jump]
    at = np.flatnonzero(cut)
    out: list[list[tuple[int, int, int]]] = []
    of = np.searchsorted(first, at, side="right") - 1
    by = np.split(at, np.flatnonzero(np.diff(of)) + 1)
    for f, nodes in zip(first, by):
        p = (nodes - f).tolist()
        out.append([(max(a - overlap, 0) if i else 0, b, int(kind[f + a])) for i, (a, b) in enumerate(zip(p, p[1:]))])
    return out


def _splitter(limit: int, overlap: int, fill: float, keys: tuple[str, ...]):
    def step(batch: dict[str, list]) -> dict[str, list]:
        texts = batch["text"]
        out: dict[str, list] = {k: [] for k in (*keys, "piece_no", "n_pieces", "start", "end", "boundary", "piece")}
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= TOGETHER):
                size += len(texts[j])
                j += 1
            for row, pieces in zip(range(i, j), cuts(texts[i:j], limit, overlap, fill)):
                for no, (a, b, kind) in enumerate(pieces):
                    for k in keys:
                        out[k].append(batch[k][row])
                    for k, v in zip(("piece_no", "n_pieces", "start", "end", "boundary", "piece"), (no, len(pieces), a, b, KINDS[kind], texts[row][a:b])):
                        out[k].append(v)
            i = j
        return out

    return step


def split_long(fields: DataFrame, keys: dict[str, str], limit: int = LIMIT, overlap: int = OVERLAP, fill: float = FILL) -> DataFrame:
    """Pieces of the texts above limit: keys, piece_no, n_pieces, start, end, boundary, piece.

    fields has the columns of keys (name to type) and text.  No shuffle: short texts never leave the scan.
    """
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", piece_no int, n_pieces int, start int, end int, boundary string, piece string"
    names = tuple(keys)
    return arrow_rows(
        fields.where(F.length("text") > limit).select(*names, "text"), schema, lambda: _splitter(limit, overlap, fill, names)
    )

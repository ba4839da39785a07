"""Splitting oversized texts: a recursive hierarchy of separators, packed greedily with overlap.

A text is split into sections, those above the limit into paragraphs, then lines, sentences, words and characters. Pieces
take as many whole units as fit; a unit that fits into a piece of its own is never cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokens import DEFAULT_VOCABULARY, PATTERN, byte_bpe

#: What ends a unit (bytes of UTF-8), from the coarsest to the finest; the names of all levels.
BOUNDARIES = [
    re.compile(rb"\n(?=#{1,6} )|\f"),
    re.compile(rb"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)(?:[ \t]*(?:\r\n?|\n))*"),
    re.compile(rb"\r\n?|\n"),
    re.compile(rb"[.!?]+[\"')\]]*(?=\s)|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)"),
]
LEVELS = ["section", "paragraph", "line", "sentence", "word", "character", "end"]
_SPACE = b" \t\n\r\x0b\x0c"


class Splitter:
    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        import regex

        self.encoding, tokens = byte_bpe(vocabulary)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t[:1] in (b" ", b"\n", b"\t", b"\r") for t in tokens])
        self.first = regex.compile(PATTERN)

    def pieces(self, text: str, limits: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, int, int, int, str, str]]:
        """(limit_name, piece_no, char_start, char_end, n_tokens, shared tokens, boundary, piece) for each limit exceeded."""
        raw = text.encode()
        least = min((cap for _, cap, _ in limits), default=len(raw))
        if len(raw) <= least:  # no token is shorter than a byte
            return
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        n = len(ids)
        if n <= least:
            return
        ends = np.cumsum(self.length[ids])
        plain = len(raw) == len(text)
        starts = np.r_[0, ends]  # byte offset of token i
        if plain:
            whole, chars = None, starts
        else:
            head = (np.frombuffer(raw + b" ", np.uint8) & 0xC0) != 0x80
            whole = np.flatnonzero(head[starts]).tolist()  # tokens that start with a character
            chars = (np.cumsum(head) - 1)[starts]
        levels = self._levels(raw, starts, n)
        words = np.flatnonzero(self.spaced[ids]).tolist()
        offset = starts.tolist()
        for name, cap, overlap in limits:
            if n <= cap:
                continue
            s = no = shared = 0
            while True:
                room = cap
                while True:
                    e, level = (n, 6) if s + room >= n else self._end(s + shared, s + room, n, cap - overlap, levels, words, whole)
                    piece = raw[offset[s] : offset[e]].decode()
                    over = self._alone(piece, raw, offset, s, e) - cap if s else 0
                    if over <= 0 or room <= shared + 1:
                        break
                    room = e - s - over
                yield name, no, int(chars[s]), int(chars[e]), e - s, shared, LEVELS[level], piece
                if e == n:
                    break
                back = max(s + 1, e - overlap) if overlap else e
                if whole is not None:
                    back = whole[bisect_right(whole, back) - 1]
                s, shared, no = back, e - back, no + 1

    def _alone(self, piece: str, raw: bytes, offset: list[int], s: int, e: int) -> int:
        """Tokens of the piece by itself: a start within a word is merged anew."""
        if raw[offset[s] : offset[s] + 1] in (b" ", b"\n") or raw[offset[s] - 1 : offset[s]] in (b" ", b"\n", b"."):
            return e - s
        head = self.first.match(piece)[0]
        k = bisect_left(offset, offset[s] + len(head.encode()), s, e)
        return e - k + len(self.encoding.encode_ordinary(head))

    def _levels(self, raw: bytes, starts: np.ndarray, n: int) -> list[list[int]]:
        """Token indices before which a unit of a level or a coarser one ends."""
        out, known = [], np.zeros(0, np.int64)
        for pattern in BOUNDARIES:
            at = np.array([m.end() for m in pattern.finditer(raw)], np.int64)
            i = np.searchsorted(starts, at)
            exact = starts[i] == at
            if not exact.all():  # a token that reaches over the boundary: blanks may follow it, nothing else
                exact |= np.array([ok or not raw[a:b].strip(_SPACE) for ok, a, b in zip(exact, at, starts[i])], bool)
            known = np.union1d(known, i[exact])
            known = known[(known > 0) & (known < n)]
            out.append(known.tolist())
        return out

    @staticmethod
    def _end(lo: int, hi: int, n: int, unit: int, levels: list[list[int]], words: list[int], whole: list[int] | None) -> tuple[int, int]:
        """The end of a piece in (lo, hi], and its level."""
        end, found = 0, -1
        for level, at in enumerate(levels):
            i = bisect_right(at, hi)
            if i and at[i - 1] > max(lo, end):
                end, found = at[i - 1], level
            if end and (at[i] if i < len(at) else n) - end <= unit:
                break  # the next unit fits into a piece of its own
        if end:
            return end, found
        i = bisect_right(words, hi)
        if i and words[i - 1] > lo:
            return words[i - 1], 4
        if whole is None:
            return hi, 5
        i = bisect_right(whole, hi)
        return (whole[i - 1], 5) if whole[i - 1] > lo else (whole[i] if i < len(whole) else n, 5)


def split_texts(docs: DataFrame, key: str, text: str, limits: list[tuple[str, int, int]], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, limit_name, piece_no, char_start, char_end, n_tokens, shared_tokens, boundary, piece) of texts above a limit.

    limits: (name, max_tokens, overlap_tokens). Sizes and overlaps are counted in the text's own tokens, and a piece has
    at most max_tokens of its own too. A piece but the last ends at the last section, paragraph, line or sentence end in
    reach that keeps the next unit whole, at a word's end only where there is none of these, within a word only where
    there are no words; a single character of more tokens than fit makes a piece of its own. The next piece starts
    overlap_tokens before that end (a few more, to start with a whole character; fewer if the piece itself is shorter); cutting each piece's shared tokens
    and joining the rest gives the text. NULL, empty and small texts have no pieces. Rows with NULL or repeated keys are
    split each by itself. An overlap that is NULL counts 0; it must be below half the limit. One pass without a shuffle.
    """
    limits = [(name, int(cap), int(overlap or 0)) for name, cap, overlap in limits]
    if len(limits) > 1000:
        raise ValueError("more than 1000 limits")
    if bad := [x for x in limits if x[1] < 1 or x[2] < 0 or 2 * x[2] >= max(2, x[1])]:
        raise ValueError(f"limits {bad}")
    cols = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = ["limit_name", "piece_no", "char_start", "char_end", "n_tokens", "shared_tokens", "boundary", "piece"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(vocabulary)
        for b in batches:
            rows, at, held = [], [], 0

            def out(b=b):
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[key, *names])

            for i, t in enumerate(b.column(1)):
                for row in splitter.pieces(t.as_py() or "", limits):
                    rows.append(row)
                    at.append(i)
                    held += len(row[-1])
                if held > 8 << 20:
                    yield out()
                    rows, at, held = [], [], 0
            if rows:
                yield out()

    schema = f"`{key}` {cols.schema['key'].dataType.simpleString()}, limit_name string, piece_no long, char_start long, char_end long, n_tokens long, shared_tokens long, boundary string, piece string"
    return cols.mapInArrow(run, schema)

"""Encode texts through the chunks between single spaces, each distinct chunk once.

Words of running text repeat, so a task looks most of them up.  A chunk starts with the
space before it where the tokenizer keeps spaces.  Cutting is safe for a tokenizer whose
pre-tokens never reach across a space that has other characters on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np

from drillsight.llm.common import ranges

#: White space beside a space: such texts are cut with a pattern, others with split().
_RUN = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def cut_keeping_spaces(text: str) -> list[str]:
    """Chunks that joined give ``text``; all but the first start with their space."""
    if not text:
        return []
    parts = _CUT.split(text) if _RUN.search(text) else text.split(" ")
    return [parts[0], *[" " + x for x in parts[1:]]] if parts[0] else [" " + x for x in parts[1:]]


def cut_dropping_spaces(text: str) -> list[str]:
    """Chunks between spaces and line ends, for tokenizers that drop white space."""
    return text.replace("\n", " ").split(" ")


class _Numbers(dict):
    """Numbers for chunks in order of appearance; new ones are noted in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.fresh.append(chunk)
        return number


def grown(data: np.ndarray, used: int, size: int) -> np.ndarray:
    """``data`` with room for ``size`` entries: itself, or twice as long with the first ``used``."""
    if size <= len(data):
        return data
    out = np.zeros(max(size, 2 * len(data)), data.dtype)
    out[:used] = data[:used]
    return out


class ChunkEncoder:
    """Ids of texts by way of their chunks; remembers chunks up to a bound, then starts anew.

    ``split`` cuts a chunk where the tokenizer begins anew whatever stands around (``dog,`` into
    ``dog`` and ``,``); its parts are remembered like chunks, so each is encoded once.  The
    bound is on the bytes that are held: those of the chunks, of their ids, and
    :data:`CHUNK_COST` for each chunk.
    """

    #: What a chunk costs beside its letters and ids: string, number and dictionary entry.
    CHUNK_COST = 200

    def __init__(
        self,
        cut: Callable[[str], list[str]],
        encode: Callable[[list[str]], Sequence[Sequence[int]]],
        split: Callable[[str], list[str]] | None = None,
        most_bytes: int = 128 << 20,
    ) -> None:
        self.cut, self.encode, self.split, self.most_bytes = cut, encode, split, most_bytes
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.used = np.zeros(1024, np.int32), 0
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.held = 0

    def _put(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keep the ids of chunks, given one after the other."""
        end = self.used + len(ids)
        self.ids = grown(self.ids, self.used, end)
        self.ids[self.used : end] = ids
        self.starts[numbers] = self.used + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.used = end
        self.held += 4 * len(ids)

    def _take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[numbers]
        return self.ids[ranges(self.starts[numbers], lengths)], lengths

    def _learn(self, before: int) -> None:
        """Encode the chunks that are new since there were ``before``."""
        fresh = self.numbers.fresh
        if not fresh:
            return
        look = self.numbers.__getitem__
        whole, parted, parts, counts = [], [], [], []
        for number, chunk in enumerate(fresh, before):  # parts that are new are added at its end
            cut = self.split(chunk) if self.split else (chunk,)
            if len(cut) > 1:
                parted.append(number)
                parts += map(look, cut)
                counts.append(len(cut))
            else:
                whole.append(number)
        total = len(self.numbers)
        self.starts, self.lengths = grown(self.starts, before, total), grown(self.lengths, before, total)
        found = self.encode([fresh[n - before] for n in whole])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int32, int(lengths.sum()))
        self._put(np.array(whole, np.int64), flat, lengths)
        if parted:
            ids, lengths = self._take(np.array(parts, np.int64))
            firsts = np.cumsum(counts) - counts
            self._put(np.array(parted, np.int64), ids, np.add.reduceat(lengths, firsts))
        self.held += sum(map(len, fresh)) + self.CHUNK_COST * len(fresh)
        self.numbers.fresh = []

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if self.held > self.most_bytes:
            self._forget()
        before, look = len(self.numbers), self.numbers.__getitem__
        found: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts, 1):
            found += map(look, self.cut(text))
            ends[k] = len(found)
        self._learn(before)
        ids, lengths = self._take(np.array(found, np.int64))
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[ends])

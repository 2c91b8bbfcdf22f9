"""Texts as lists of chunks in Arrow: each distinct chunk of a batch is answered once, the answers are taken by index."""

from __future__ import annotations

from collections.abc import Callable, Hashable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_CHARS = 4 << 20


class Memo:
    """Answers asked for lately: at most twice ``size`` entries."""

    def __init__(self, size: int, longest: int = 64):
        self.size, self.longest = size, longest
        self.young: dict[Hashable, object] = {}
        self.older: dict[Hashable, object] = {}

    def all_of(self, keys: list[str], answer: Callable[[list[str]], list]) -> list:
        """The answer to each of the distinct ``keys``; what is not known is asked for in one call."""
        look = self.young.get
        found = [look(k) for k in keys]
        gaps = [n for n, f in enumerate(found) if f is None]
        if gaps:
            look = self.older.get
            unknown = []
            for n in gaps:
                found[n] = look(keys[n])
                if found[n] is None:
                    unknown.append(n)
            if unknown:
                for n, value in zip(unknown, answer([keys[n] for n in unknown]), strict=True):
                    found[n] = value
            if len(self.young) + len(gaps) > self.size:
                self.young, self.older = {}, self.young
            self.young.update((keys[n], found[n]) for n in gaps[: self.size] if len(keys[n]) <= self.longest)
        return found


class Chunked:
    """The blank-separated chunks of some texts, as a dictionary of distinct chunks and indices."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts, " ")
        self.bounds = lists.offsets.to_numpy()
        encoded = lists.flatten().dictionary_encode()
        self.dictionary, self.indices = encoded.dictionary, encoded.indices

    @property
    def distinct(self) -> list[str]:
        return self.dictionary.to_pylist()

    def joined(self, answers: list[bytes] | pa.LargeBinaryArray) -> list[memoryview]:
        """Per text, the answers to its chunks one after the other."""
        if not isinstance(answers, pa.Array):
            answers = pa.array(answers, type=pa.large_binary())
        taken = answers.take(self.indices)
        _, offsets, data = taken.buffers()
        places = np.frombuffer(offsets, dtype=np.int64)[taken.offset + self.bounds]
        view = memoryview(data) if data is not None else memoryview(b"")
        return [view[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]


def groups(texts: list[str], chars: int = GROUP_CHARS) -> list[list[str]]:
    """Consecutive texts in groups of at most about ``chars`` characters."""
    out: list[list[str]] = []
    size = 0
    for text in texts:
        if not out or size + len(text) > chars:
            out.append([])
            size = 0
        out[-1].append(text)
        size += len(text)
    return out

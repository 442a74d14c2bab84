"""Places of many excerpts in one text (H9, H10): the text is prepared once, in Arrow batches, and never copied per excerpt."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: White space as Unicode has it, as in the Column forms.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_PLACES = "array<struct<start:int,length:int>>"


class Searched:
    """A text to be searched for excerpts; with runs of white space as one blank once an excerpt needs that."""

    def __init__(self, text: str):
        self.text, self._flat, self._cuts, self._lost = text, None, [], []

    def exact(self, needle: str) -> tuple[int, int] | None:
        at = self.text.find(needle)
        return (at, len(needle)) if at >= 0 else None

    def _origin(self, at: int) -> int:
        """Where a place of the flat text is in the text."""
        k = bisect_right(self._cuts, at)
        return at + (self._lost[k - 1] if k else 0)

    def flexible(self, needle: str) -> tuple[int, int] | None:
        """The first place where the needle stands with any white space for its own."""
        if self._flat is None:
            lost = 0
            for run in _SPACE.finditer(self.text):
                if run.end() - run.start() > 1:
                    self._cuts.append(run.start() - lost + 1)
                    lost += run.end() - run.start() - 1
                    self._lost.append(lost)
            self._flat = _SPACE.sub(" ", self.text)
        wanted = _SPACE.sub(" ", needle)
        at = self._flat.find(wanted)
        if at < 0:
            return None
        start = self._origin(at)
        return start, self._origin(at + len(wanted)) - start

    def anchor(self, excerpt: str) -> tuple[int, int] | None:
        """H9: ever shorter prefixes, each as it stands and then with flexible white space."""
        longest = min(len(excerpt), 100)
        for size in range(longest, 19, -15):
            found = self.exact(excerpt[:size]) or self.flexible(excerpt[:size])
            if found:
                return found
        return None

    def anchor_loose(self, excerpt: str) -> tuple[int, int] | None:
        """Exact, then white space as any gap of up to 10 characters, then a 40-character prefix."""
        if len(excerpt) < 5:
            return None
        found = self.exact(excerpt)
        if found is None:
            m = re.search(r"[\s\S]{0,10}".join(map(re.escape, _SPACE.split(excerpt))), self.text)
            found = (m.start(), m.end() - m.start()) if m else None
        return found or (self.exact(excerpt[:40]) if len(excerpt) > 40 else None)


def anchor_excerpts(text: Column, excerpts: Column, loose: bool = False) -> Column:
    """array<struct<start, length>> (1-based; null if not found) of a text's excerpts, in their order: H9, or H10 if ``loose``."""
    @F.arrow_udf(_PLACES)
    def places(texts: pa.Array, lists: pa.Array) -> pa.Array:
        offsets, starts, lengths = [0], [], []
        for held, wanted in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
            searched = Searched(held or "")
            search = searched.anchor_loose if loose else searched.anchor
            for excerpt in wanted or ():
                found = search(excerpt) if excerpt is not None and held is not None else None
                starts.append(found and found[0] + 1)
                lengths.append(found and found[1])
            offsets.append(len(starts))
        columns = [pa.array(c, pa.int32()) for c in (starts, lengths)]
        rows = pa.StructArray.from_arrays(columns, ["start", "length"], mask=pa.array([s is None for s in starts], pa.bool_()))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return places.asNondeterministic()(text, excerpts)

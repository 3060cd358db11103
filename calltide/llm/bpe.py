"""Byte-level BPE on pretokens: the merge loop, the pretoken cut, and a memo of units between spaces.

``heap_merges`` is the operator's core: a heap of adjacent pairs by rank and a doubly linked list of symbols.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

#: Fixed value: the pretoken pattern of byte-level BPE files without an own split pattern.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries and characters after which a worker's memo is emptied, which bounds its memory.
MEMO, MEMO_CHARS = 500_000, 25_000_000


def vocabulary_path(name_or_path: str) -> str:
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


@lru_cache(maxsize=2)
def load(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Ranks of the merges, and the special strings that the library finds inside texts."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"])
    return {pair: rank for rank, pair in enumerate(merges)}, [t["content"] for t in data.get("added_tokens", [])]


def heap_merges(pretoken: str, ranks: dict[tuple[str, str], int], symbols: list[str]) -> int:
    """Merges that byte-pair encoding makes in one pretoken: pop the lowest-ranked adjacent pair, leftmost first, until none is left."""
    part: list[str | None] = [symbols[b] for b in pretoken.encode()]
    n, rank = len(part), ranks.get
    heap = [(r, i) for i in range(n - 1) if (r := rank((part[i], part[i + 1]))) is not None]
    heapq.heapify(heap)
    after, before, merged = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        r, i = heapq.heappop(heap)
        left, j = part[i], after[i]
        if left is None or j >= n or rank((left, part[j])) != r:
            continue  # one side has been merged away since
        part[i] = joined = left + part[j]
        part[j] = None
        merged += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (q := rank((joined, part[k]))) is not None:
                heapq.heappush(heap, (q, i))
        h = before[i]
        if h >= 0 and (q := rank((part[h], joined))) is not None:
            heapq.heappush(heap, (q, h))
    return merged


class Units:
    """Cuts a text at single spaces into units that are encoded alone, with a bounded memo of each unit's value.

    A space between two other characters always begins a pretoken, so units can be encoded apart from one another. A line
    feed goes with the unit that follows it. Where white space stands in runs (or is of another kind), units aren't
    independent and the whole text is cut by the pattern.
    """

    #: Put before the first unit of a text, which has no space before it.
    FIRST = "\x00"

    def __init__(self, value, combine, specials: list[str]):
        """``value``: list of pretokens -> list of values; ``combine``: list of values -> the value of their pretokens in a row."""
        import regex

        self.value, self.combine, self.specials = value, combine, specials
        self.cut, self.blank, self.memo, self.tokens, self.chars = regex.compile(PRETOKEN), regex.compile(r"\s"), {}, {}, 0

    def parts(self, text: str) -> list[str | None]:
        """Stretches between special strings; None stands for a special string."""
        out: list[str | None] = [text]
        for special in self.specials:
            if special in text:
                out = [y for x in out for y in (self._around(x, special) if x else [x])]
        return out

    @staticmethod
    def _around(text: str, special: str) -> list[str | None]:
        out: list[str | None] = []
        for piece in text.split(special):
            out += [piece, None]
        return out[:-1]

    def units(self, text: str) -> list[str] | None:
        """Units of a text, or None where they'd not be independent."""
        if self.FIRST in text:
            return None
        units = text.replace("\n", " \n").split(" ")
        units[0] = self.FIRST + units[0]
        return units

    def dependent(self, unit: str) -> bool:
        body = unit[1:] if unit[:1] in (self.FIRST, "\n") else unit
        return not body or bool(self.blank.search(body)) or any(c.isspace() for c in body)

    def learn(self, units: set[str]) -> None:
        """Works out the values of units that aren't in the memo."""
        new = [u for u in units if u not in self.memo]
        if len(self.memo) + len(new) > MEMO or self.chars > MEMO_CHARS:
            self.memo.clear()
            new, self.chars = list(units), 0
        self.chars += sum(map(len, new))
        self.memo.update(dict.fromkeys(new))
        alone = [u for u in new if not self.dependent(u)]
        spelled = [self.cut.findall(u[1:] if u[0] == self.FIRST else u if u[0] == "\n" else " " + u) for u in alone]
        self.memo.update(zip(alone, self.encoded(spelled), strict=True))

    def encoded(self, rows: list[list[str]]) -> list:
        """The value of each row of pretokens, by a memo of pretokens below that of units."""
        missing = list(set().union(*rows).difference(self.tokens))
        if len(self.tokens) + len(missing) > MEMO or self.chars > MEMO_CHARS:
            self.tokens.clear()
            missing = list(set().union(*rows))
        self.tokens.update(zip(missing, self.value(missing), strict=True))
        of = self.tokens.__getitem__
        return [self.combine(list(map(of, row))) for row in rows]

    def values(self, text: str) -> list:
        """Values whose sum or concatenation is the whole text's."""
        units = self.units(text)
        if units is not None:
            if missing := set(units).difference(self.memo):
                self.learn(missing if len(missing) <= MEMO else set())
            try:
                found = [self.memo[u] for u in units] if missing else list(map(self.memo.__getitem__, units))
                if None not in found:
                    return found
            except KeyError:  # the memo was emptied, or the text has more units than it takes
                pass
        return self.encoded([self.cut.findall(text)]) if text else []

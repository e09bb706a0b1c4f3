"""Files of one shape: texts that are equal but for numbers inside words are parsed once, and the numbers put into what was found."""

from __future__ import annotations

import re
from quillspan.functions.extract import WIDTH, digest, undigested_facts

#: Digits that follow a letter. The parser knows no name with two or more of them, and equally long ones leave every place as it is.
NUMBER = re.compile(r"(?<=[A-Za-z_$])([0-9]{2,})")
#: Facts whose items are sorted.
SORTED = ("returns", "template")
#: Characters of texts that are remembered at most, and of one text.
CHARACTERS, LONGEST = 1_000_000, 100_000


class Shape:
    """The facts of a first text as columns, and, once a text with other numbers has shown that they can be, the same with places for numbers."""

    __slots__ = ("columns", "numbers", "state", "size", "formats", "fixed", "cells", "items", "digests")

    def __init__(self, rows: list[tuple], numbers: list[str], size: int):
        self.columns, self.numbers, self.size, self.state = columns_of(rows), numbers, size, "new"
        self.digests = digests_of(self.columns)

    def _compile(self) -> None:
        """formats: the different texts that hold numbers; fixed: columns without such; cells: (row, format) of the others; items: (row, sorted or not, (item, format))."""
        place, known = {n: i for i, n in enumerate(self.numbers)}, {}

        def format_of(text) -> int | None:
            parts = NUMBER.split(text) if isinstance(text, str) else [text]
            if len(parts) == 1:
                return None
            plain = [p.replace("{", "{{").replace("}", "}}") for p in parts[::2]]
            return known.setdefault(plain[0] + "".join(f"{{{place[n]}}}{p}" for n, p in zip(parts[1::2], plain[1:], strict=True)), len(known))

        numbered = lambda values: [(i, j) for i, v in enumerate(values) if (j := format_of(v)) is not None]
        self.cells = [numbered(c) for c in self.columns[:-1]]
        self.items = [(i, self.columns[0][i] in SORTED, cells) for i, v in enumerate(self.columns[-1]) if (cells := numbered(v or ()))]
        self.formats = [f.format for f in known]

    def filled(self, numbers: list[str]) -> list[list]:
        texts, out = [f(*numbers) for f in self.formats], []
        for column, cells in zip(self.columns, self.cells):
            if cells:
                column = column[:]
                for i, j in cells:
                    column[i] = texts[j]
            out.append(column)
        lists = self.columns[-1]
        if self.items:
            lists = lists[:]
            for i, in_order, cells in self.items:
                lists[i] = lists[i][:]
                for k, j in cells:
                    lists[i][k] = texts[j]
                if in_order:
                    lists[i].sort()
        return [*out, lists]

    def proven(self, numbers: list[str], columns: list[list]) -> bool:
        """Whether the facts of the first text, with these numbers, are those that parsing found."""
        try:
            self._compile()
        except KeyError:  # a number that the text doesn't have at such a place
            return False
        return self.filled(numbers) == columns


def columns_of(rows: list[tuple]) -> list[list]:
    return [list(c) for c in zip(*rows)] or [[] for _ in range(WIDTH)]


def digests_of(columns: list[list]) -> list[tuple[int, int]]:
    """(column, row) of digests to be made."""
    return [(i, k) for i, c in enumerate(columns) for k, v in enumerate(c) if isinstance(v, slice)]


class Shapes:
    """facts_of() for many files, with a memory of shapes that is bounded by characters; the oldest are forgotten first."""

    def __init__(self, only: frozenset[str] | None = None):
        """only: the facts to keep; all without."""
        self.seen, self.size, self.only = {}, 0, only

    def add(self, kind: str | None, content: str | None, to: list[list]) -> int:
        """Adds the facts of a file to columns; their number."""
        columns, digests = self._columns(kind, content)
        at = len(to[0])
        for column, more in zip(to, columns):
            column += more
        for i, k in digests:
            to[i][at + k] = digest(content, to[i][at + k])
        return len(columns[0])

    def _parsed(self, kind: str | None, content: str | None) -> list[tuple]:
        return [f for f in undigested_facts(kind, content) if self.only is None or f[0] in self.only]

    def _columns(self, kind: str | None, content: str | None) -> tuple[list[list], list[tuple[int, int]]]:
        if not content or len(content) > LONGEST or "\\" in content:  # an escaped number may stand after a letter in a value
            columns = columns_of(self._parsed(kind, content))
            return columns, digests_of(columns)
        parts, place = NUMBER.split(content), {}
        key = (kind, *[place.setdefault(n, len(place)) for n in parts[1::2]], *parts[::2])
        numbers = list(place)
        key = (*key, *map(len, numbers))
        shape = self.seen.get(key)
        if shape is not None and numbers == shape.numbers:
            return shape.columns, shape.digests
        if shape is not None and shape.state == "proven":
            return shape.filled(numbers), shape.digests
        made = Shape(self._parsed(kind, content), numbers, len(content))
        if shape is None:
            self._remember(key, made)
        elif shape.state == "new":
            shape.state = "proven" if shape.proven(numbers, made.columns) else "apart"
        return made.columns, made.digests

    def _remember(self, key: tuple, shape: Shape) -> None:
        self.seen[key] = shape
        self.size += shape.size
        while self.size > CHARACTERS:
            self.size -= self.seen.pop(next(iter(self.seen))).size

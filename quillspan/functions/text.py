"""Scalar functions over source text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as scripts define it.
SCRIPT_SPACE = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"


def body_fingerprint(text: Column) -> Column:
    """First 16 hexadecimal digits of the sha256 of the text with white space collapsed and trimmed."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(text, SCRIPT_SPACE, " ")).cast("binary"), 256), 1, 16)


@lru_cache
def _marks() -> tuple[str, str]:
    """Characters and what each becomes: what is left of it without its marks once decomposed; marks themselves, at the end, become nothing.

    Of all scripts; syllables that decompose to several letters stay as they
    are. Marks are what combines with a class of its own (accents, points,
    strokes, not vowel signs), and signs that stand for one.
    """
    bases, lost = {}, [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.combining(c)]
    marks = set(lost)
    for c in map(chr, [*range(0xC0, 0xD800), *range(0xF900, 0x110000)]):
        if c in marks or not unicodedata.decomposition(c) or unicodedata.decomposition(c).startswith("<"):
            continue
        left = [x for x in unicodedata.normalize("NFD", c) if x not in marks]
        if len(left) == 1:
            bases[c] = left[0]
    signs = [c for c in map(chr, range(0x20, 0x100)) if unicodedata.category(c) == "Sk"] + ["\u00b7"]
    return "".join(bases) + "".join(lost) + "".join(signs), "".join(bases.values())


def unmarked(text: Column) -> Column:
    """The text without accents and other marks, whether they are characters of their own or not."""
    return F.translate(text, *_marks())


def normalised(text: Column) -> Column:
    """Lower case without marks; runs of what is neither a letter nor a digit of any script are one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(unmarked(text)), r"[^\p{L}\p{N}]+", " "))


def short_hash(text: Column) -> Column:
    """The short id of a text: h = h * 33 xor c over its UTF-16 code units from 5381, in 32 bits, unsigned, to the base 36."""
    code = lambda c: F.ascii(c)
    units = F.flatten(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(code(c) < 0x10000, F.array(code(c))).otherwise(F.array(F.lit(0xD800) + F.floor((code(c) - 0x10000) / 1024).cast("int"), F.lit(0xDC00) + code(c) % 1024))))
    h = F.aggregate(units, F.lit(5381).cast("long"), lambda h, c: (h * 33).bitwiseXOR(c.cast("long")).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def rounded(x: Column) -> Column:
    """Halves go up, as in scripts."""
    return F.floor(x + 0.5).cast("long")

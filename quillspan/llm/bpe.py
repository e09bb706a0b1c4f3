"""Operator 7, BPE encoding and decoding: a backtracking encoder over Aho-Corasick matches, a decoder over an offset table."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .pieces import BEYOND, Encoder

#: Encodings of pieces, and of pre-tokens, that a worker keeps, at the most; then it starts anew.
CACHE = 600_000
#: Fixed value: the pre-token pattern of byte-level BPE; white space is spelled out, as engines differ on U+001C to U+001F.
_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: The same pattern for characters below U+02B0, whose classes are few and fixed.
_FEW = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ʯ]+| ?[0-9²³¹¼-¾]+| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ʯ0-9²³¹¼-¾]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")


_ANY = regex.compile(PATTERN)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text without special strings; no merge crosses their borders."""
    return (_FEW if text.isascii() or not BEYOND.search(text) else _ANY).findall(text)


class Texts:
    """Ids of whole texts by what `encode` says of pre-tokens: by pieces in numpy up to U+02AF, else pre-token by pre-token.

    `whole` encodes texts with special strings. Of pieces and of pre-tokens, `most` each are kept at the most.
    """

    def __init__(self, encode: Callable[[str], list[int]], special: list[str], whole: Callable[[str], list[int]], most: int):
        self.encode, self.special, self.whole, self.most = encode, special, whole, most
        self.known: dict[str, list[int]] = {}
        self.encoder = Encoder(self._piece, most)

    def _piece(self, piece: str) -> list[int]:
        if piece.removeprefix(" ").isalpha():  # letters are one pre-token
            return self.encode(piece)
        found = pretokens(piece)
        return self.encode(piece) if len(found) == 1 else [i for p in found for i in self.encode(p)]

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for p in pretokens(text):
            if (ids := self.known.get(p)) is None:
                if len(self.known) >= self.most:
                    self.known.clear()
                ids = self.known[p] = self.encode(p)
            out += ids
        return out

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null one has none."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if any(s in t for s in self.special):
                out[i] = np.array(self.whole(t), np.uint32)
            elif t.isascii() or not BEYOND.search(t):
                plain.append(i)
            else:
                out[i] = np.array(self.ids(t), np.uint32)
        for i, ids in zip(plain, self.encoder.many([texts[i] for i in plain])):
            out[i] = ids
        return out


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable ones stand for themselves, the others follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Exact merges of a byte-level BPE file, encoded in linear time.

    A piece's encoding is the one sequence in which each neighbouring pair is
    compatible: merging by rank would not have crossed their border. The
    longest token at a place is tried first; if it isn't compatible with the
    one before, its next shorter prefix; if none is, the one before is undone.
    Places from which no encoding goes on are marked, so none is tried twice.
    """

    def __init__(self, tokenizer_json: str, cache: int = CACHE):
        import ahocorasick

        spec = json.loads(tokenizer_json)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of: dict[int, bytes] = {i: raw(t) for t, i in vocab.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        # inside, a token's number is its byte, or 256 and its merge's rank: what is made later is greater
        self.ids, self.texts = [0] * 256, [bytes([b]) for b in range(256)]
        for c, b in letters.items():
            self.ids[b] = vocab[c]
        number = {t: i for i, t in enumerate(self.texts)}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        for m in spec["model"]["merges"]:
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b = raw(left), raw(right)
            if a + b not in number:
                number[a + b] = len(self.texts)
                self.texts.append(a + b)
                self.ids.append(vocab[left + right])
                self.halves.append((number[a], number[b]))
                self.merged[number[a], number[b]] = number[a + b]
        self.matcher = ahocorasick.Automaton()
        for t, i in number.items():
            self.matcher.add_word(t.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in self.texts]
        self.sizes = [len(t) for t in self.texts]
        self.fits: dict[tuple[int, int], bool] = {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.most = cache
        self.coder = Texts(self._ids, list(self.special), self._with_special, cache)
        # the offset table: token i is blob[start[i] : start[i] + size[i]]
        top = max(self.text_of) + 1
        self.size = np.array([len(self.text_of.get(i, b"")) for i in range(top)], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(self.text_of.get(i, b"") for i in range(top)), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: undoing merges on both sides of the border, latest first, none that joins it came before those undone."""
        if len(self.fits) > self.most:
            self.fits.clear()
        x, y, limit, out = a, b, 1 << 30, True
        while True:
            if self.merged.get((x, y), 1 << 30) < limit:
                out = False
                break
            if x > y:
                if x < 256:
                    break
                limit, x = x, self.halves[x][1]
            else:
                if y < 256:
                    break
                limit, y = y + 1, self.halves[y][0]
        self.fits[a, b] = out
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """The numbers of a pre-token's tokens."""
        text, out, at, fits, sizes = piece.decode("latin-1"), [], 0, self.fits, self.sizes
        last = -1
        for _, token in self.matcher.iter_long(text):  # leftmost and longest: mostly that is it
            if last >= 0:
                fit = fits.get((last, token))
                if not (self.compatible(last, token) if fit is None else fit):
                    break
            out.append(token)
            at += sizes[token]
            last = token
        else:
            return out
        n, longest = len(piece), {}
        for end, other in self.matcher.iter(text):
            start = end - sizes[other] + 1
            if start not in longest or sizes[other] > sizes[longest[start]]:
                longest[start] = other
        open_at = bytearray(b"\1" * (n + 1))
        while True:
            end = at + sizes[token]
            if open_at[end]:
                fit = fits.get((out[-1], token)) if out else True
                if self.compatible(out[-1], token) if fit is None else fit:
                    out.append(token)
                    at = end
                    if at == n:
                        return out
                    token = longest[at]
                    continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: undo the token before, and go on with its next shorter one
                open_at[at] = 0
                last = out.pop()
                at -= sizes[last]
                token = self.shorter[last]

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; special strings in it become their ids."""
        return self.coder.many(texts)

    def _with_special(self, text: str) -> list[int]:
        return [i for t in self.split.split(text) if t for i in ([self.special[t]] if t in self.special else self.coder.ids(t))]

    def _ids(self, piece: str) -> list[int]:
        return [self.ids[t] for t in self.encode_piece(piece.encode())]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        return self.blob[at + np.repeat(self.start[ids] - (ends - size), size)].tobytes()


def _digests(shared, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, cache)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for p in range(0, batch.num_rows, 512):
                for ids in codec.many(batch.column("text").slice(p, 512).to_pylist()):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(codec.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, tokenizer_json: str, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again; one pass, no shuffle.

    Null texts count as empty: no ids, and the digests of nothing. Rows may
    repeat; an empty table gives no rows. A very long text is encoded piece by
    piece; its ids are held by one task, four bytes each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(_digests(shared, cache), f"doc_id {dict(slim.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(shared, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, cache)
        for batch in batches:
            for p in range(0, batch.num_rows, 512):
                part = batch.slice(p, 512)
                ids = [x.astype(np.int32) for x in codec.many(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))], ["doc_id", "ids"])

    return run


def encoded(docs: DataFrame, tokenizer_json: str, cache: int = CACHE) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(_encoded(shared, cache), f"doc_id {dict(slim.dtypes)['doc_id']}, ids array<int>")

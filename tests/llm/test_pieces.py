"""Pieces of texts: their hashes, and what a worker keeps of them."""

import numpy as np
import pyarrow as pa
from quillspan.llm import pieces, token_binary
from quillspan.llm.tokenizer_files import tokenizer_json


class Shared:
    def __init__(self, value):
        self.value = value


def test_hashes_tell_pieces_apart():
    """Every length up to 40, null bytes and the buffer's end included; equal pieces agree wherever they are."""
    rng = np.random.default_rng(3)
    different = [bytes(n) for n in range(1, 41)] + [b"a" * n + b"\0" * m for n in range(1, 20) for m in range(20)] + [bytes(rng.integers(0, 256, n)) for n in range(4, 41) for _ in range(20)]
    different = list(dict.fromkeys(different))
    order = [int(k) for k in rng.permutation(len(different))]
    both = different + [different[k] for k in order]
    raw = np.frombuffer(b"".join(both), np.uint8)
    one, two = pieces.hashes(raw, np.cumsum([0, *map(len, both[:-1])]))
    found = list(zip(one.tolist(), two.tolist()))
    assert len(set(found)) == len(different) and (one > 0).all()
    assert found[len(different) :] == [found[k] for k in order]
    # a piece alone in its buffer is the same piece
    assert found[: len(different)] == [tuple(int(h[0]) for h in pieces.hashes(np.frombuffer(p, np.uint8), np.zeros(1, np.int64))) for p in different]


def test_a_full_table_keeps_pieces_asked_for_again():
    asked: list[str] = []

    def encode(piece):
        asked.append(piece)
        return [len(piece), *piece.encode()]

    encoder = pieces.Encoder(encode, 100)
    common = [f"common{chr(97 + k)}" for k in range(26)]
    for k in range(40):
        fresh = [f"fresh{chr(97 + k % 26) * (1 + k // 26)}x{chr(97 + j) * 3}" for j in range(20)]
        for t, ids in zip([*common, *fresh], encoder.many([*common, *fresh])):
            assert ids.tolist() == [len(t), *t.encode()]
        assert encoder.table.size <= encoder.most == 100
    assert all(asked.count(t) == 1 for t in common) and len(asked) == 26 + 800
    # more pieces at once than the table holds, all of them asked for again
    many = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuv"]
    for _ in range(3):
        assert [x.tolist() for x in encoder.many(many)] == [[2, *t.encode()] for t in many]


def test_a_worker_goes_on_with_the_pieces_of_its_last_task(monkeypatch):
    asked: list[str] = []
    plain = token_binary.Library.pretoken
    monkeypatch.setattr(token_binary.Library, "pretoken", lambda self, p: asked.append(p) or plain(self, p))
    task = token_binary._tokenized(Shared((tokenizer_json(), np.zeros(0, np.int64))), 2, 1000)
    texts = ["Plain words, 12 of them, it's so", "accents: \xe9t\xe9\x1c\x7f \t\n end", None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    first = [b.to_pylist() for b in task(iter([batch]))]
    assert len(asked) > 10
    asked.clear()
    assert [b.to_pylist() for b in task(iter([batch]))] == first and not asked
    library = token_binary.Library(tokenizer_json())
    assert [np.frombuffer(r["ids"], f"<u{r['width']}").tolist() for r in first[0]] == [[*library.with_special(t or ""), 2] for t in texts]

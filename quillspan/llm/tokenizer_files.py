"""Where vocabulary files are read; the path is a parameter."""

from __future__ import annotations


def tokenizer_json(path: str | None = None, name: str = "byte_bpe_50k.json") -> str:
    """The file's content, read on the driver (it is of fixed size) and sent to the workers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()

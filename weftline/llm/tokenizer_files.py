"""Where the public tokenizer files lie; any path can be given instead."""

from __future__ import annotations


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

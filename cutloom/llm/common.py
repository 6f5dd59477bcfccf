"""What the operators share: shared storage between stages (as in ``cutloom.tables``), free names, caches and tokenizer files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cutloom.tables import shared_dir, written  # noqa: F401


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with as many ``_`` before it as it takes to be none of ``df``'s columns (case aside)."""
    taken = {c.lower() for c in df.columns}
    depth = 1
    while taken & {"_" * depth + w.lower() for w in wanted}:
        depth += 1
    return ["_" * depth + w for w in wanted]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer's file on this machine (every executor has the package)."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Longer keys are made each time and not kept: a text without spaces is one key, and whole texts must not pile up in a cache.
LONGEST_KEY = 64


class TwoAgeCache(dict):
    """A bounded cache that looks up in C: what is missing is taken from the former age or else made by
    ``make(key)``; when the present age holds ``most`` keys it becomes the former one. No key is longer than LONGEST_KEY
    characters, so ``most`` bounds the bytes as well."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.former = most, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        found = self.former.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > LONGEST_KEY:
                return found
        if len(self) >= self.most:
            self.former = dict(self)
            self.clear()
        self[key] = found
        return found


class ChunkCache(TwoAgeCache):
    """Values of text chunks without spaces, where a word's value does not depend on its case or on what follows it.

    Only words are made by ``make_new``; a capitalised word has the value of the plain one, and a word with a full stop
    or comma that of both together.
    """

    def make_new(self, chunk: str):
        raise NotImplementedError

    def make(self, chunk: str):
        if chunk.isalpha():
            plain = chunk.lower() if chunk.isascii() else chunk
            return self[plain] if plain != chunk else self.make_new(chunk)
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self[chunk[-1]]
        return self.make_new(chunk)

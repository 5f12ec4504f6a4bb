"""Sizes of texts in tokens of a public tokenizer, read from a vocabulary file that every executor can reach."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published splitting pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def counter(path: str = DEFAULT):
    """A function from a list of texts to their numbers of tokens. ``.tiktoken``, ``.json`` and ``.model`` files are read."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]


def n_tokens(text: Column, path: str = DEFAULT) -> Column:
    """Tokens of a text; null for a null text, 0 for an empty one."""

    def run(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        sizes = counter(path)([v for v in values if v is not None])
        it: Iterator[int] = iter(sizes)
        return pa.array([None if v is None else next(it) for v in values], pa.int64())

    return F.arrow_udf(run, "bigint")(text)

"""Sizes of texts in tokens of a public tokenizer; the vocabulary file's path is a parameter, executors read it there."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabularies' tokenizer cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def byte_bpe(path: str):
    """The byte-level tokenizer of a file of ranks, and the byte strings of its tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), tokens


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[str], int]:
    """Number of tokens of a text; the kind of tokenizer follows from the file's ending."""
    if path.endswith(".tiktoken"):
        encode = byte_bpe(path)[0].encode_ordinary
        return lambda t: len(encode(t))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: len(t.encode(text, add_special_tokens=False))
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(p.encode(text))
    raise ValueError(f"no tokenizer for {path}")


def token_counts(docs: DataFrame, text: str, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(keep, n_tokens long): whole texts, NULL and empty ones having 0 tokens. One pass without a shuffle."""
    cols = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            n = pa.array([count(t) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    schema = ", ".join([*(f"`{k}` {cols.schema[k].dataType.simpleString()}" for k in keep), "n_tokens long"])
    return cols.mapInArrow(run, schema)

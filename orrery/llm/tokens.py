"""Token counts of texts under a public tokenizer."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in pieces that end before white space, so that no single call grows without bound.
PIECE_CHARS = 200_000


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE_CHARS):
    """Cuts text before white space into pieces of at most `most` characters; a run without white space is cut hard."""
    at = 0
    while len(text) - at > most:
        cut = max((m.start() for m in re.finditer(r"\s\S", text[at + most - 2000 : at + most])), default=-1)
        end = at + most - 2000 + cut if cut > 0 else at + most
        yield text[at:end]
        at = end
    yield text[at:]


def exact_pieces(text: str, most: int = PIECE_CHARS):
    """Cuts text between words of the vocabulary's pattern into pieces of about `most` characters.

    Words are encoded one by one, so the pieces have as many tokens as the whole. A word longer than `most` stays whole.
    """
    import regex

    begin = last = 0
    for m in regex.compile(PATTERN).finditer(text):
        if m.end() - begin > most and last > begin:
            yield text[begin:last]
            begin = last
        if not m.group().isspace():
            last = m.end()  # white space looks at what follows it
    yield text[begin:]


def count_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(vocabulary)
        return pd.Series([sum(len(enc.encode_ordinary(p)) for p in (exact_pieces(t) if len(t) > PIECE_CHARS else (t,))) if t else 0 for t in texts])

    return count(text)


def document_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens and the columns `carry`; a doc_id that occurs more than once counts once, with its longest text."""
    carry = carry or []
    counted = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", count_tokens(F.col("text"), vocabulary).alias("n_tokens"), *carry)
    most = counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", *carry)).alias("m"))
    return most.select("doc_id", "m.*")

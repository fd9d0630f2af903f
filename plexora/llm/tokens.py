"""Sizes of texts in tokens of a public tokenizer; the vocabulary file is a parameter, nothing is trained."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Where the vocabulary file lies unless the caller says otherwise.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the usual pre-tokenisation pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """A tiktoken encoding of a .tiktoken rank file, or a tokenizers file (.json)."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Replaces `text` by its size in tokens; null and empty texts have 0. Whole texts are counted.

    The vocabulary file is sent to the executors, so that it need not lie on each of them.
    """
    sent = os.path.isfile(vocabulary)
    if sent:
        docs.sparkSession.sparkContext.addFile(vocabulary)
    keep = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + f", `{out}` bigint"

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = encoder(SparkFiles.get(Path(vocabulary).name) if sent else vocabulary)
        for pdf in it:
            yield pdf.drop(columns=[text]).assign(**{out: size([t or "" for t in pdf[text]])})

    return docs.mapInPandas(work, schema)

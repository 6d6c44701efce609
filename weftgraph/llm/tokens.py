"""Token counts with the public tokenizers."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; another one can be given by the environment or as a parameter.
TOKENIZERS = os.environ.get("WEFTGRAPH_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that cuts a text into pieces before byte-pair merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoder(path: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    """A byte-level tokenizer from a rank file. Special tokens are ordinary text."""
    import tiktoken

    with open(os.path.join(path, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if b}
    return tiktoken.Encoding("weftgraph", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken", keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and n_tokens of each row; null and empty texts have 0 tokens. Whole texts count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, name)
        for pdf in batches:
            pdf["n_tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf.pop("__text")]
            yield pdf

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("__text")).mapInPandas(run, f"{fields}, n_tokens bigint")

"""Token counts of texts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of vocabulary files and the one that counts by default.
VOCABULARY = os.path.join(os.environ.get("SIDERITE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Fixed value: the public pattern that parts text before byte pairs are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space from this length on are taken out before the pattern runs, which can't hold them; the counts stay the same.
LONG_BLANK = 1_000


def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(code, text: str) -> int:
    """The number of tokens of a text, however long its runs of white space are.

    The pattern makes all of a run but its last character one piece, and the whole run at the end of a text, so
    such a piece can be counted by itself.
    """
    import regex

    if len(text) < LONG_BLANK:
        return len(code.encode_ordinary(text))
    count, at = 0, 0
    for run in regex.finditer(r"\s{%d,}" % LONG_BLANK, text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        count += len(code.encode_ordinary(text[at : run.start()])) + len(code._encode_single_piece(text[run.start() : end]))
        at = end
    return count + len(code.encode_ordinary(text[at:]))


def token_counts(texts: DataFrame, text: str = "text", out: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """texts without their text and with the number of its tokens; null and empty texts have 0.

    Nothing moves: whole texts are counted where they are read.
    """
    if importlib.util.find_spec("tiktoken") is None:
        raise ImportError("token_counts needs tiktoken")
    kept = [c for c in texts.columns if c != text]
    kinds = dict(texts.dtypes)
    source = texts.select(*kept, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            numbers = pa.array([count_tokens(code, t) if t else 0 for t in batch["_text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), numbers], [*kept, out])

    return source.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{out}` bigint"]))

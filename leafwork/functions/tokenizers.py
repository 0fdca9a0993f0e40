"""Token counts by any of three kinds of vocabulary files; the path is always a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def installed() -> list[str]:
    """Vocabularies of the public tokenizers package, if there is one."""
    try:
        import public_tokenizers
    except ImportError:
        return []
    folder = Path(public_tokenizers.__file__).parent
    return sorted(str(p) for p in folder.iterdir() if p.suffix in (".json", ".tiktoken", ".model"))


def name_of(path: str) -> str:
    return Path(path).stem if Path(path).suffix != ".tiktoken" else Path(path).name


@lru_cache(8)
def counter(path: str):
    """texts -> token counts, by the kind of file."""
    kind = Path(path).suffix
    if kind == ".json":
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        return lambda texts: [len(e.ids) for e in found.encode_batch_fast(texts, add_special_tokens=False)]
    if kind == ".tiktoken":
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines())}
        found = tiktoken.Encoding(Path(path).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(found.encode_ordinary(t)) for t in texts]
    if kind == ".model":
        import sentencepiece

        found = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in found.encode(texts, num_threads=1)]
    raise ValueError(f"no tokenizer is known for {path}")


@lru_cache(16)
def _counts(path: str):
    def run(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        there = [t for t in values if t is not None]
        found = iter(counter(path)(there) if there else ())
        return pa.array([None if t is None else next(found) for t in values], pa.int64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType="bigint")


def token_count(text: Column | str, path: str) -> Column:
    """Tokens of a text, without special ones added; null for null."""
    return _counts(path)(text)


@lru_cache(8)
def cutter(path: str | None):
    """(size of a text, its beginning of at most so much): in tokens of a vocabulary that gives texts back, or in UTF-8 bytes."""
    if path is None:
        return lambda text: len(text.encode()), lambda text, n: text.encode()[:n].decode(errors="ignore")
    if Path(path).suffix == ".json":
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        ends = lambda text: [end for _, end in found.encode(text, add_special_tokens=False).offsets]
        return lambda text: len(ends(text)), lambda text, n: text[: max(ends(text)[:n], default=0)]
    raise ValueError(f"no cut is known for {path}")

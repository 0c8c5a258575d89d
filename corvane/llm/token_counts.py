"""Token counts of whole texts: Arrow batches in, lengths only out.

A text is cut at safe boundaries (:func:`corvane.llm.common.safe_pieces`), so that no call of the
library gets more than one piece of a very long text, and the pieces of all texts in a byte-balanced
slice are encoded in one batch. A short piece that came before in the same worker, in whatever task, isn't encoded again: its
length is kept in a dictionary of pieces of at most ``KEPT`` characters, which is emptied once it holds more than ``CACHE``.

Defined results: null and empty texts have 0 tokens and 0 bytes; very long texts go in pieces; repeated rows give repeated rows;
an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import functools
import os

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import batched, byte_lengths, safe_pieces, slices

CACHE, KEPT = 600_000, 64
OVER = 512


def _lengths(encode, texts: list[str | None], known: dict[str, int]) -> list[int]:
    """Token counts of ``texts``; ``encode`` gives the counts of a list of pieces."""
    cut = [safe_pieces(t) if t else () for t in texts]
    if len(known) > CACHE:
        known.clear()
    new = list(set().union(*cut).difference(known))
    known.update(zip(new, encode(new), strict=True))
    counts = [sum(map(known.__getitem__, pieces)) for pieces in cut]
    for p in new:
        if len(p) > KEPT:
            del known[p]
    return counts


def _encoder(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(1)
def _worker(path: str):
    """The encoder of a vocabulary and the lengths it has found, for as long as the worker lives."""
    return _encoder(path), {}


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", over: int = OVER) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    ``tokenizer`` is a vocabulary file that every executor has at that path. Only byte-level
    ``.json`` vocabularies are cut into pieces; others get whole texts.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches):
        (encode, known), whole = _worker(tokenizer), not byte_level(tokenizer)
        for part in slices(batches, text_col, 1 << 20):
            texts = part.column(text_col).to_pylist()
            counts = encode([t or "" for t in texts]) if whole else _lengths(encode, texts, known)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(id_col),
                    pa.array(byte_lengths(part.column(text_col)), pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > over for n in counts], pa.bool_()),
                ],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    out = f"`{id_col}` {id_type.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return batched(docs.select(id_col, text_col)).mapInArrow(run, out)


def byte_level(path: str) -> bool:
    """Whether the vocabulary's pre-tokenizer cuts at safe boundaries and nothing normalises the text."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    pre = model.get("pre_tokenizer") or {}
    plain = not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in model["added_tokens"])
    return plain and not model["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]

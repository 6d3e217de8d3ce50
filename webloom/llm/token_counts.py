"""Token counts: batch encoding inside an Arrow function that returns lengths only.

Long texts are split at boundaries where the tokenizer cannot join text: for a tokenizers file whose
pre-tokenizer keeps only matches without white space, every run of ASCII white space is such a boundary
(NFC, lower-casing, the split pattern and the special strings never reach across it).  Pieces are encoded by
the library in batches balanced by bytes; a piece seen before in the same worker (the same bytes) is not encoded again,
and the store of known lengths is bounded by KNOWN pieces of KNOWN_BYTES at most.  Other tokenizers get whole texts.

Defined results: null and empty texts count 0 tokens; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import session
from .textvec import Remembered, Words, distinct, row_sums, slices, utf8

#: Distinct pieces whose lengths a worker remembers, and the bytes of the longest one remembered.
KNOWN, KNOWN_BYTES = 400_000, 64
#: Bytes of pieces in one call of the library.
CALL_BYTES = 1 << 18


class Lengths:
    """Token counts of texts by one tokenizer file."""

    def __init__(self, path: str):
        self.whole = True
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.whole = not splits_at_space(path)
        self.known = Remembered(KNOWN)

    def batches(self, pieces: list[str]):
        """Lists of pieces of about CALL_BYTES each."""
        at, size = 0, 0
        for i, x in enumerate(pieces):
            if size and size + len(x) > CALL_BYTES:
                yield pieces[at:i]
                at, size = i, 0
            size += len(x)
        if pieces[at:]:
            yield pieces[at:]

    def lengths(self, pieces: list[str]) -> np.ndarray:
        return np.array([n for part in self.batches(pieces) for n in self.encode(part)], np.int64)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        if self.whole:
            return self.lengths([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        words = Words(data, offsets, lower=False, hashed=False)
        first, back = distinct(data, words.starts, words.ends)
        keys = [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())]
        counts = np.array([-1 if n is None else n for n in self.known.many(keys)], np.int64)
        new = np.flatnonzero(counts < 0)
        if len(new):
            counts[new] = self.lengths([keys[i].decode("utf-8", "replace") for i in new.tolist()])
            for i in new.tolist():
                if len(keys[i]) <= KNOWN_BYTES:
                    self.known.put(keys[i], int(counts[i]))
        return row_sums(counts[back], words.rows)


def splits_at_space(path: str) -> bool:
    """Whether the tokenizers file drops white space between pieces, so that it is a safe boundary."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [made.get("pre_tokenizer") or {}]
    first = steps[0]
    plain = all(x["type"] in {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"} or (x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+" and x["content"] == " ") for x in (made.get("normalizer") or {}).get("normalizers", [made["normalizer"]] if made.get("normalizer") else []))
    return bool(plain and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and r"[^\s" in first["pattern"].get("Regex", "") and not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in made.get("added_tokens", [])))


_MODELS: dict[str, Lengths] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row's whole text under the tokenizer file at `tokenizer`."""
    session.arrow(docs.sparkSession)

    def run(batches):
        model = _MODELS.get(tokenizer) or _MODELS.setdefault(tokenizer, Lengths(tokenizer))
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                data, offsets = utf8(part.column(1))
                n = model.of(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(session.documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))

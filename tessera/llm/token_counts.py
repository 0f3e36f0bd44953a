"""Token counts (operator 1): batch encoding inside Arrow functions that return
lengths only.

Texts are taken in runs of about ``batch_bytes`` bytes, so a batch of few long
texts and one of many short texts cost the same. Each text is cut at safe
boundaries (``pieces``); every distinct piece of a run is encoded once, by the
library itself, in one batch call, and a text's count is the sum over its
pieces. Counts of short pieces are kept between runs in a table of at most
``cache_pieces`` entries per worker. No shuffle: one map over the input
partitions, and a lost task is simply run again.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows
give repeated rows; an empty table gives an empty result; a text without any
white space is one piece, encoded whole. Columns other than the id and the text
are not read, so extra columns cannot clash.
"""

from __future__ import annotations

import gc
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.pieces import byte_batches, number

BATCH_BYTES = 8 << 20
CACHE_PIECES = 800_000
SHORT = 48


def load_counter(path: str):
    """A function from a list of strings to their token counts, by the library
    that the file belongs to, without special tokens around the text."""
    if path.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
    import tokenizers
    tok = tokenizers.Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def splits_at_space(path: str) -> bool:
    """Whether ``pieces`` are safe for this file: a byte-level pre-tokeniser
    with its own pattern, no normaliser and no added token that takes white
    space with it."""
    if not path.endswith(".json"):
        return False
    import json
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and not spec.get("post_processor")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])
                        for t in spec.get("added_tokens", [])))


#: Counts of short pieces, by tokenizer file; kept while a worker lives.
_known: dict[str, dict[bytes, int]] = {}


def count_texts(texts, count, cache: dict[bytes, int], cache_pieces: int) -> np.ndarray:
    """Tokens of each text, by the counts of its distinct pieces."""
    found, of_text = number(texts)
    new = [p for p in found if p not in cache]
    kept = {p: cache[p] for p in found if p in cache}
    if len(cache) + len(new) > cache_pieces:  # keep what this run uses
        cache.clear()
        cache.update(itertools.islice(kept.items(), cache_pieces // 2))
    fresh = dict(zip(new, count([p.decode() for p in new]))) if new else {}
    n_tokens = np.array([fresh[p] if p in fresh else kept[p] for p in found], dtype=np.int64)
    room = cache_pieces - len(cache)
    cache.update(itertools.islice(((p, c) for p, c in fresh.items() if len(p) <= SHORT), room))
    return np.array([n_tokens[ps].sum() for ps in of_text], dtype=np.int64)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512, batch_bytes: int = BATCH_BYTES, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """(id, n_bytes long, n_tokens long, over_limit boolean) for each row of
    ``docs``; ``over_limit`` is n_tokens > ``limit``. ``tokenizer_path`` is a
    ``.json`` or ``.model`` file that every worker can read."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # a run makes many objects and no cycles
        count = load_counter(tokenizer_path)
        cut, cache = splits_at_space(tokenizer_path), _known.setdefault(tokenizer_path, {})
        for b in batches:
            at = 0
            for texts in byte_batches(b.column(1).to_pylist(), batch_bytes):
                n = count_texts(texts, count, cache, cache_pieces) if cut else count(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])
                at += len(texts)

    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))

"""Token counts and byte-level BPE against the libraries."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import regex
import tiktoken
import tokenizers

from tessera.llm import bpe, pieces, token_counts

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
LIBRARY = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
PARTS = [" ", "  ", "\n", "\t", "a", "b", "ab", "the", "in", "!", "?", "\x85", "\x1c", "　", "1", "٣", "ß", "é", "你", "😀", "'s", "'",
         "ll", "aaaa", "....", "​", "<|endoftext|>", "\r\n", "\xa0", " "]


def fuzz(n):
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [
        "a" * 30000, " " * 5000, "ab" * 9000, "." * 7777, ""]


def test_pieces_join_to_the_text():
    texts = fuzz(500)
    found, of = pieces.number(texts)
    assert [b"".join(found[k] for k in ps).decode() for ps in of] == texts and len(set(found)) == len(found)


def test_replay_equals_library():
    texts = fuzz(4000)
    block = bpe.Block(texts, bpe.Merges(P.path("byte_bpe_50k.tiktoken")), regex.compile(P.PATTERN))
    assert [block.of(k).tolist() for k in range(len(texts))] == [TIKTOKEN.encode_ordinary(t) for t in texts]


def test_lone_words_equal_library():
    for w in ["aaaaaaa", "abababab", "thing", "ßß", "\n\n\n"]:  # one match of the pattern each
        assert bpe.encode_word(w.encode(), RANKS) == TIKTOKEN.encode_ordinary(w)
    assert bpe.encode_word(b"", RANKS) == []


@pytest.mark.parametrize("cache", [10, 100_000])
def test_counts_equal_library(cache):
    texts, known = fuzz(4000), {}
    count = token_counts.load_counter(P.path("byte_bpe_50k.json"))
    got = [n for k in range(0, len(texts), 700) for n in token_counts.count_texts(texts[k:k + 700], count, known, cache)]
    assert got == [len(LIBRARY.encode(t, add_special_tokens=False)) for t in texts] and len(known) <= cache


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_rows(spark, documents, file):
    rows = token_counts.token_counts(documents, P.path(file), batch_bytes=3000).collect()
    texts = [r.text or "" for r in documents.collect()]
    want = sorted((len(t.encode()), n, n > 512) for t, n in zip(texts, token_counts.load_counter(P.path(file))(texts)))
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert token_counts.token_counts(documents.limit(0), P.path(file)).count() == 0


def test_encode_decode_round_trip(spark, documents):
    path = P.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode_texts(documents, path, P.PATTERN, block_bytes=4000)
    back = sorted(bytes(r.decoded) for r in bpe.decode_ids(ids, path).collect())
    texts = [r.text or "" for r in documents.collect()]
    assert back == sorted(t.encode() for t in texts)
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(documents, path, P.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((len(i), sha(" ".join(map(str, i)).encode()), sha(t.encode()))
                         for t in texts for i in [TIKTOKEN.encode_ordinary(t)])
    assert bpe.encode_digests(documents.limit(0), path, P.PATTERN).count() == 0

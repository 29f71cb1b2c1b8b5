import hashlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken

from strata.llm import bpe

PATH = public.path("byte_bpe_multi_50k.tiktoken")

TEXTS = [
    "", " ", "plain words, and 123 numbers don't", "  two  \n\n lines\t\ttabs ", "é́ ﷽ \U0001f600‍\U0001f525 Ⅷ ½",
    "a\x85b\xa0c　 d   e", "\x1c\x1d x \x00\x01​ y᠎z", "x" * 30_000, "ab " * 20_000, "﻿a �",
    "<|endoftext|> stays text", "tail   ", "　", "don't I'LL 'S",
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own(ranks):
    return bpe.Codec(bpe.tokenizer_json(ranks, public.PATTERN))


def odd_texts():
    rng = np.random.default_rng(5)
    pools = [range(0x20, 0x7F), range(0x3000), range(0x2000, 0x2070), range(0xE000, 0x2FA20), [0x20, 0x0A, 0xA0, 0x85]]
    for _ in range(400):
        codes = [int(rng.choice(pools[rng.integers(len(pools))])) for _ in range(rng.integers(1, 40))]
        yield "".join(chr(c) for c in codes if not 0xD800 <= c < 0xE000)


def test_ids_and_decoding_equal_the_reference(own, reference):
    texts = [*TEXTS, *odd_texts()]
    for text, packed in zip(texts, own.encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text), ascii(text)
        assert own.decode(packed) == text


def test_cache_is_bounded(own, monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 3)
    texts = ["one two three four five", "six seven one two", "eight"]
    for text, packed in zip(texts, own.encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text)


def test_offsets_cover_split_characters(own):
    for text in ["a \U0001f525b", "né ﷽ x", ""]:
        packed = next(own.encode([text]))
        first, last = own.offsets(packed)
        assert len(first) == len(packed) // 4
        if len(first):
            assert first[0] == 0 and last[-1] == len(text)
        for i, (a, b) in enumerate(zip(first, last)):
            part = own.decode_bytes(packed[4 * i : 4 * i + 4])
            assert part in text[a:b].encode()


def test_part_of_a_character_decodes_to_a_replacement(own):
    packed = next(own.encode(["\U0001f525"]))
    assert len(packed) > 4
    assert "�" in own.decode(packed[:4])


def test_rows(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(90, None, None), (None, "a b", None), (0, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string").repartition(3)
    got = sorted(map(tuple, bpe.round_trips(docs, PATH, public.PATTERN).collect()), key=str)
    want = []
    for i, text, _ in rows:
        ids = reference.encode_ordinary(text or "")
        packed = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    coded = bpe.encode(docs, PATH, public.PATTERN, offsets=True)
    assert coded.columns == ["doc_id", "text", "token_ids", "token_starts", "token_ends"]
    back = bpe.decode(coded, PATH, public.PATTERN).collect()
    assert all(r.decoded == (r.text or "") for r in back) and len(back) == len(rows)
    assert bpe.round_trips(docs.limit(0), PATH, public.PATTERN).count() == 0

import hashlib
import random
import time
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers as public
import pytest

from strata.llm import align_tokens as al

STORED = al.tokenizers(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), public.PATTERN)

TEXTS = [
    "", " ", "  ", "\n", "a  b", " x", "x ", "a\n b", "a \n b", "a\r b\r\n c", "\t x", "a▁ b", "▁", "a　 b", "don't I'll",
    "<|endoftext|> <s> x", "x" * 1000, "aaaa " * 50, "é́ ﷽ \U0001f600‍\U0001f525 Ⅷ ½", "12345 678,90 \r; {\r }\r",
    "日本語 の文", "日本語の文です" * 30, "\x00 a", "a\x85 b", "​ x ᠎ y", "\x1c a \x1d b", "the cat and the cat",
]


@pytest.fixture(scope="module")
def own():
    return al.Aligner(STORED)


def ends_of(own, text):
    """Ids and ends in bytes of both tokenizers over a space and a whole text; none if one does not give it back."""
    a = own.first.encode(" " + text, add_special_tokens=False).ids
    b = own.second.encode(text, num_threads=1)
    parts = [own.first_bytes[i] for i in a], [own.second_bytes[i] for i in b]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    return a, b, *(list(accumulate(map(len, p))) for p in parts)


def plainly(own, text):
    """Groups of a whole text from the set of shared ends."""
    told = ends_of(own, text) if text else None
    if told is None:
        return None
    a, b, *ends = told
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        i2, j2 = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        groups.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    return groups


def shown(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def random_texts(n):
    rng = random.Random(3)
    pools = [range(0x20, 0x7F), range(0x3000), range(0x2000, 0x2070), range(0xE000, 0x2FA20), [0x20, 0x0A, 0xA0, 0x85, 0x0D]]
    for _ in range(n):
        yield "".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(1, 40)))


def divided(a, b):
    a, b, zero = np.array(a), np.array(b), np.zeros(1, np.int64)
    last_a, last_b = al.shared_cuts(a, b, zero, np.array([len(a)]), zero, np.array([len(b)]))
    return a[last_a].tolist(), b[last_b].tolist()


def test_division_finds_every_shared_end():
    rng = random.Random(5)
    for _ in range(500):
        size = rng.randint(1, 60)
        a, b = (sorted({size, *rng.sample(range(1, size + 1), rng.randint(1, size))}) for _ in range(2))
        assert divided(a, b) == (sorted(set(a) & set(b)),) * 2
    # Several intervals at once.
    a, b = np.array([2, 3, 7, 9, 10, 14]), np.array([1, 3, 7, 8, 9, 11, 14])
    cuts = al.shared_cuts(a, b, np.array([0, 2]), np.array([2, 6]), np.array([0, 2]), np.array([2, 7]))
    assert a[cuts[0]].tolist() == b[cuts[1]].tolist() == [3, 7, 9, 14]


def test_long_interval_without_cuts():
    n = 600_000
    began = time.time()
    assert divided([*range(2, 2 * n, 2), 4 * n], [*range(1, 2 * n, 2), 4 * n]) == ([4 * n], [4 * n])
    same = list(range(1, n))
    assert divided(same, same) == (same, same)
    assert time.time() - began < 20


def test_groups_equal_the_whole_text(own):
    texts = [*TEXTS, *random_texts(800)]
    known = [own.ids(text) for text in texts]
    found = iter(own.shown(own.align([p for p in known if p is not None])))
    for text, pieces in zip(texts, known):
        want = plainly(own, text)
        assert (want is None) == (pieces is None), ascii(text)
        if want is not None:
            assert next(found).decode() == shown(want), ascii(text)
            assert [(x, y) for _, _, x, y in own.groups(text)] == want
            assert own.groups(text)[-1][1] == len((" " + text).encode())
            assert [g[0] for g in own.groups(text)] == [0, *[g[1] for g in own.groups(text)[:-1]]]


def test_both_libraries_give_the_same_ids(own):
    assert own.ranked is not None
    for text in [*TEXTS, *random_texts(300), "a" + " " * 30_000 + "b", "\n" * 12_000]:
        assert own._first_ids(text) == own.first.encode(text, add_special_tokens=False).ids
    blank = own.ids("x" + " " * 1_500_000)
    assert blank is None or sum(own.first_sizes[blank[0]]) == 1_500_002


def expected(own, texts):
    every, holders = [], Counter()
    for text in texts:
        groups = plainly(own, text)
        links = Counter((x, y) for left, right in groups or [] for x in left for y in right)
        every.append((groups, links))
        holders.update(set(links))
    best = {}
    for (x, _), n in holders.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for groups, links in every:
        groups = groups or []
        rows.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            sum(n for (x, y), n in links.items() if holders[x, y] == best[x]),
            sum(n * holders[pair] for pair, n in links.items()),
            hashlib.sha256(shown(groups).encode()).hexdigest() if groups else "",
        ))
    return rows


@pytest.mark.parametrize("hot_parts", [1, 40, al.HOT_PARTS])
def test_rows_against_brute_force(spark, own, monkeypatch, hot_parts):
    texts = [*TEXTS, *random_texts(60), "the cat", "the cat", "the cat and the hat " * 20, None]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "other words", "y"), (None, "the hat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keys string").repartition(3)
    got = sorted(map(tuple, al.report(docs, STORED, hot_parts).collect()), key=str)
    want = [(i, *w) for (i, _, _), w in zip(rows, expected(own, [t for _, t, _ in rows]))]
    assert got == sorted(want, key=str)


def test_large_groups_are_counted_by_id(spark, own, monkeypatch):
    monkeypatch.setattr(al, "LISTED_LINKS", 1)
    texts = ["日本語の文です" * 30, "naïve ﷽﷽﷽ x", "the"]
    other = al.Aligner(STORED)
    for text in texts:
        keys, times = other.links(other.align([other.ids(text)]))[0]
        links = Counter(x * STORED.width() + y for left, right in plainly(own, text) for x in left for y in right)
        assert dict(zip(keys.tolist(), times.tolist())) == links


def test_empty_table_and_groups_column(spark, own):
    docs = spark.createDataFrame([(1, "naïve words", 5), (2, None, 6)], "doc_id long, text string, token_groups int")
    rows = {r.doc_id: r.token_groups for r in al.align(docs, STORED).collect()}
    assert [(g.first_byte, g.last_byte, g.first_ids, g.second_ids) for g in rows[1]] == own.groups("naïve words")
    assert rows[2] == []
    assert al.report(docs.limit(0), STORED).count() == 0

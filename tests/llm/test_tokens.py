import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trolley.llm import packing, token_counts
from trolley.llm.tokens import WordTokens, tokenizer_path


_own, _whole = WordTokens(tokenizer_path()), Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_alone_give_the_ids_of_the_text(text):
    own = np.frombuffer(_own.encode(text.encode()), "<u4").tolist()
    assert own == _whole.encode(text, add_special_tokens=False).ids



TEXTS = [None, "", "a", "It's <|endoftext|> É́ ﬁ x", "word " * 9000, "same text", "same text", "1234 ++ don't", "x" * 5000]


def docs_of(spark, texts):
    return spark.createDataFrame([(i if i != 2 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, length int")


def check_packing(docs, got, tokenizer, limit):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, at, len(ids[at : at + limit])) for k, at in enumerate(range(0, len(ids), limit))]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[at : at + limit], "<u4").tobytes()) for at in range(0, len(ids), limit)]
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins)


def test_packing(spark, tokenizer):
    docs = docs_of(spark, TEXTS)
    got = packing.pack(docs).collect()
    n = check_packing([(r.doc_id, r.text) for r in docs.collect()], got, tokenizer, 4096)
    assert n == -(-sum(r.length for r in got) // 4096)
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_documents(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack(docs, limit=4096).collect()
    n = check_packing([(r.doc_id, r.text) for r in docs.collect()], got, tokenizer, 4096)
    assert n <= -(-sum(r.length for r in got) // 4096) + 1


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_piece_once(counts):
    places, ranks = defaultdict(list), defaultdict(list)
    plan = packing.plan_bins(counts, 30)
    for i, (n, first, repeats, sequence, offset) in enumerate(plan):
        after = min([p[1] for p in plan if p[0] == n and p[1] > first], default=counts[n])
        for r in range(after - first):
            ranks[n].append(first + r)
            places[sequence + r % repeats].append((offset + r // repeats * n, n))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for own in places.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 30


def test_fullest_is_best():
    assert packing.fullest([7, 5, 3], {7: 1, 5: 2, 3: 5}, 11) == {5: 1, 3: 2}
    assert packing.fullest([7], {7: 3}, 6) == {}


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 16])
def test_token_counts(spark, tokenizer, block):
    docs = docs_of(spark, TEXTS).repartition(3)
    stream = token_counts.write_stream(docs, block_ids=block if block > 3 else block + 20)
    got = token_counts.name_documents(stream, token_counts.count_tokens(stream)).collect()
    tokenizer.encode_special_tokens = True
    want = [(r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    tokenizer.encode_special_tokens = False
    key = lambda x: (x[0] is None, x)
    assert sorted([(r.doc_id, r.n_tokens) for r in got], key=key) == sorted(want, key=key)
    assert all(r.complete for r in got)


def test_scan_of_bare_blocks(spark):
    block = lambda *ids: bytearray(np.array(ids, "<u2").tobytes())
    stream = spark.createDataFrame([(0, 0, block(5, 5, 5)), (0, 1, block(5, 5)), (0, 2, block(9, 9, 5)), (0, 3, block(9, 5)), (1, 0, block(9)), (2, 0, block())],
                                   "stream int, block long, payload binary")
    got = token_counts.count_tokens(stream, end_id=9).collect()
    assert sorted((r.stream, r.ordinal, r.start, r.n_tokens, r.complete) for r in got) == [
        (0, 0, 0, 5, True), (0, 1, 6, 0, True), (0, 2, 7, 1, True), (0, 3, 9, 1, False), (1, 0, 0, 0, True)]


def test_the_fullest_combination_is_found():
    """Against all combinations of up to nine pieces."""
    from itertools import combinations
    from random import Random

    from trolley.llm.packing import fullest

    rng = Random(2)
    for _ in range(200):
        have = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 10))]
        room = rng.randrange(0, 60)
        counts = {n: have.count(n) for n in have}
        used = fullest(sorted(counts, reverse=True), counts, room)
        best = max(sum(c) for k in range(len(have) + 1) for c in combinations(have, k) if sum(c) <= room)
        assert sum(n * k for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())


def test_token_counts_of_odd_tables(spark):
    from trolley.llm import token_counts as C

    count = lambda rows, kind: sorted((r.doc_id, r.n_tokens) for s in [C.write_stream(spark.createDataFrame(rows, f"doc_id {kind}, text string"))] for r in C.name_documents(s, C.count_tokens(s)).collect())
    assert count([], "long") == [] and count([(3, None), (3, "a")], "short") == [(3, 0), (3, 1)]

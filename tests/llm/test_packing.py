import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinetrail.llm import packing

from .common_cases import clashing, corpus, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_offsets_and_sequences(spark):
    rows = corpus(12, 120) + [(900, "<|endoftext|> a <|endoftext|>", "en", "x", 0), (901, "  \n\n x'll 123 ☃", "en", "x", 0)]
    got = packing.pack(clashing(table(spark, rows)), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    ids = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *own))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, ps in pieces.items():
        copies = sum(r[0] == doc for r in rows)
        ps = sorted(set(ps)) if copies > 1 else sorted(ps)
        assert [p for p, _, _ in ps] == list(range(len(ps))) and ps[0][1] == 0
        assert all(a[1] + a[2] == b[1] for a, b in zip(ps, ps[1:], strict=False)) and sum(p[2] for p in ps) == len(ids[doc])
        assert all(p[2] == 2048 for p in ps[1:])
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(len(ids[r[0]]) for r in rows) // 2048) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_near_the_lower_bound(seed):
    rng = random.Random(seed)
    histogram = defaultdict(int)
    for _ in range(5000):
        histogram[min(2048, max(1, int(rng.lognormvariate(5.5, 1.2 + seed / 10))))] += rng.choice((1, 1, 1, 30))
    rows = packing.plan(histogram)
    bound = -(-sum(k * n for k, n in histogram.items()) // 2048)
    used = max(r[3] + (r[2] - 1) // r[5] for r in rows) + 1
    assert bound <= used <= 1.01 * bound + 1
    assert {k: sum(r[2] for r in rows if r[0] == k) for k in histogram} == histogram


def test_empty_table_and_one_length_for_all(spark):
    assert packing.pack(table(spark, []), PATH).collect() == []
    got = packing.pack(table(spark, [(k, None, None, None, None) for k in range(5000)]), PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 5000 and len({r.sequence_id for r in got}) == 3

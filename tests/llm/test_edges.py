"""Null ids and very long texts, for every operator on documents."""

import random
import time
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import chains, licenses, mixing, packing, pii, quality, simhash, suffixes

from .common_cases import clashing, rows_of, sentence, table

BIG = (1 << 53) + 1  # not a double
PATH = public_tokenizers.path("byte_bpe_50k.json")
OPERATORS = {
    "quality": lambda d: quality.quality(d, d.where("doc_id = 1").select("doc_id")),
    "mixing": mixing.mix,
    "pii": pii.detect,
    "simhash": simhash.simhash,
    "suffixes": suffixes.digested,
    "packing": lambda d: packing.pack(d, PATH),
    "licenses": licenses.scan,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_null_and_large_ids_stay(spark, name):
    rng = random.Random(1)
    rows = [(None, sentence(rng, 30), "en", "x", 0), (BIG, sentence(rng, 30), "en", "y", 0), (1, sentence(rng, 30), "en", None, 0), (None, None, None, None, None)]
    got = OPERATORS[name](clashing(table(spark, rows)))
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted((r[0] for r in rows), key=repr)


def test_repeats_of_nameless_documents(spark):
    rng = random.Random(2)
    hot = sentence(rng, 80)
    rows = [(None, "ab" * 400, "e", "x", 0), (None, f"one {hot}", "e", "x", 0), (BIG, f"two {hot}", "e", "x", 0)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffixes.digested(table(spark, rows)).collect()}
    assert got[None, 800] == 800 and got[None, len(rows[1][1])] == got[BIG, len(rows[2][1])] >= len(hot)
    links = chains.passages(table(spark, rows)).collect()
    assert {(r.doc_id, r.partner_id) for r in links} == {(None, BIG), (BIG, None)}
    text = sentence(rng, 200)
    near = rows_of(simhash.simhash(table(spark, [(None, text, "e", "x", 0), (9, text, "e", "x", 0), (None, "lone one here", "e", "x", 0)])).drop("fingerprint"))
    assert near == [(9, 9), (None, 9), (None, None)]


def test_hot_contexts_are_counted_by_window(spark):
    from .test_suffixes import brute

    rng = random.Random(3)
    middle = sentence(rng, 30)[:170]
    rows = [(k, f"{sentence(rng, 8)}{'abcd'[k % 4] * 9}{middle}{'wxyz'[k // 4 % 4] * 20}{sentence(rng, 8)}", "e", "x", 0) for k in range(160)]
    assert rows_of(suffixes.digested(table(spark, rows), together=10)) == brute(rows)


def test_long_runs_and_long_texts_in_personal_data(spark):
    rows = [(1, "0" * 5000 + ".1.1.1", "e", "x", 0), (2, "7" * 200_000, "e", "x", 0), (3, " ".join(["a@b.co 4111111111111111 zzzz1234567890123456"] * 20_000), "e", "x", 0)]
    rows += [(4, "the password is correcthorsebatterystapleXY now", "e", "x", 0), (5, "a_" * 100_000, "e", "x", 0)]
    began = time.time()
    got = {r.doc_id: r for r in pii.detect(table(spark, rows)).collect()}
    assert time.time() - began < 60
    assert got[1].n_ip == 1 and got[1].spans == "ip:0:5006" and got[3].n_email == got[3].n_card == 20_000


def test_long_white_runs_are_tokenized_as_the_library_does(spark):
    from tokenizers import Tokenizer

    texts = ["\n" * 1_000_000, "a" + " " * 1_200_000 + "b", "x" * 500_000]
    got = packing.tokenized(table(spark, [(k, t, "e", "x", 0) for k, t in enumerate(texts)]), PATH, 1 << 30).collect()
    tokenizer = Tokenizer.from_file(PATH)
    for r in got:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_license_scans_are_linear_in_the_text(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(("water", "road", "hill", "sun")) for _ in range(1_000_000))
    began = time.time()
    (row,) = licenses.scan(table(spark, [(1, f"{long} Released under the MIT License. {long}", "e", "x", 0)])).collect()
    assert time.time() - began < 90 and row.n_words == 2_000_005 and row.labels == "mit" and row.first_word == 1_000_003


def test_mixed_texts_keep_their_lines(spark):
    rng = random.Random(5)
    rows = [(k, "\n".join(sentence(rng, 9) for _ in range(30)), "en", "xyz"[k % 3], 0) for k in range(60)]
    texts = {r[0]: r[1] for r in rows}
    mixed = mixing.mixed(table(spark, rows)).collect()
    whole = sum(r.text == texts[r.doc_id] for r in mixed)
    assert whole > 0.7 * len(mixed)
    # A shard's run may end in the document where it begins, so that a line is joined from two.
    assert sum(line not in texts[r.doc_id] for r in mixed for line in r.text.split("\n")) <= 3
    assert mixing.mixed(table(spark, rows)).select(F.sum(F.length("text"))).first()[0] > 0

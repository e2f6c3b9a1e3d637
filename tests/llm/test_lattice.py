import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from kinetrail.llm import lattice

from .common_cases import clashing, corpus, rows_of, table

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.vocabulary(PATH)


def pieces():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    usable = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return usable, {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}


def paths(word, usable, of_byte):
    """All segmentations of a word as lists of ids, by recursion."""

    def from_(rest):
        if not rest:
            yield []
        for k in range(1, len(rest) + 1):
            if rest[:k] in usable:
                head = [usable[rest[:k]]]
            elif k == 1:
                head = [of_byte[b] for b in rest[0].encode()]
            else:
                continue
            for tail in from_(rest[k:]):
                yield head + tail

    return list(from_("▁" + word))


def brute_expected(words, p, usable, of_byte):
    mass, logs = np.zeros(len(p)), []
    for word, count in words:
        ways = paths(word, usable, of_byte)
        probability = [math.prod(p[i] for i in way) for way in ways]
        logs.append(math.log(sum(probability)))
        for way, q in zip(ways, probability, strict=True):
            for i in way:
                mass[i] += count * q / sum(probability)
    return np.array(logs), mass


WORDS = [("the", 5), ("tionhan", 2), ("ünïcødé", 1), ("漢字☃", 3), ("\U0001f9ea", 1), ("a", 7), ("zzzz", 1)]


def test_sums_over_all_segmentations(vocabulary):
    usable, of_byte = pieces()
    p = vocabulary["weight"]
    logs, mass = brute_expected(WORDS, p, usable, of_byte)
    words, counts = [w.encode() for w, _ in WORDS], np.array([c for _, c in WORDS], float)
    with np.errstate(divide="ignore"):
        logp = np.log(p)
    assert np.allclose(lattice.log_probabilities(vocabulary, words, logp), logs, rtol=1e-12)
    assert np.allclose(lattice.expected_counts(vocabulary, words, counts, logp), mass, rtol=1e-9, atol=1e-15)
    for (w, c), want in zip(WORDS, logs, strict=True):  # the way of long words
        got, expected = lattice._walked(vocabulary, w.encode(), logp, float(c))
        assert math.isclose(got, want, rel_tol=1e-12)
        assert np.allclose(expected, lattice.expected_counts(vocabulary, [w.encode()], np.array([float(c)]), logp), atol=1e-12)


def brute(rows, rounds, prior, vocabulary):
    usable, of_byte = pieces()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: [w for w in "".join("\n" if c in " \t\n\x0b\x0c\r" else c for c in lower(t)).split("\n") if w]
    c, ends = Counter(), 0
    for i, t, *_ in rows:
        if not held(i):
            c.update(split(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    p = vocabulary["weight"]
    for _ in range(rounds):
        _, mass = brute_expected(c.items(), p, usable, of_byte)
        mass[vocabulary["end"]] = ends
        p = (mass + prior * vocabulary["weight"]) / (mass.sum() + prior)
    cached = {}

    def log10_of(w):
        if w not in cached:
            cached[w] = brute_expected([(w, 1)], p, usable, of_byte)[0][0] / math.log(10)
        return cached[w]

    out = []
    for i, t, *_ in rows:
        words = split(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        out.append((i, held(i), len(words) + 1, sum(w in c for w in words) + (ends > 0), n, base, sum(map(log10_of, words)) + math.log10(p[vocabulary["end"]])))
    return out


def agree(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


@pytest.mark.parametrize("hot", [lattice.HOT, 3])
def test_against_brute_force(spark, vocabulary, monkeypatch, hot):
    monkeypatch.setattr(lattice.frequent, "__defaults__", (hot,))
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("the of thing ABLE ti on é 漢 x1 été".split()) for _ in range(rng.randrange(9))), "e", "x", 0) for i in range(40)]
    rows += [(None, "null id", "e", "x", 0), (100, None, "e", "x", 0), (101, " \t\n", "e", "x", 0), rows[0], (102, "a b\u0085c\x1cd", "e", "x", 0)]
    agree(lattice.score(clashing(table(spark, rows)), PATH).collect(), brute(rows, lattice.ROUNDS, lattice.PRIOR, vocabulary))


def test_training_raises_what_held_out_texts_score(spark, vocabulary):
    rows = corpus(4, 80)
    counts = lattice.word_counts(lattice._texts(table(spark, rows)))
    held = [w for i, t, *_ in rows if t and zlib.crc32(str(i).encode()) % 7 == 2 for w in t.lower().encode().split()]
    before, after = (lattice.log_probabilities(vocabulary, held, lattice.fit(counts, vocabulary, rounds)).sum() for rounds in (0, 3))
    assert after > 0.8 * before and after < 0
    assert abs(np.exp(lattice.fit(counts, vocabulary)).sum() - 1) < 1e-9


def test_very_long_texts_and_words(spark):
    word = "longword" * 30_000
    rows = [(1, word, "e", "x", 0), (3, "the of " * 300_000, "e", "x", 0), (4, "the of", "e", "x", 0), (5, word, "e", "x", 0), (6, "x", "e", "x", 0), (7, "y", "e", "x", 0)]
    got = {r.doc_id: r for r in lattice.score(table(spark, rows), PATH).collect()}
    assert got[3].n_tokens == 600_001 and all(np.isfinite(r.score) and r.score < 0 for r in got.values())
    assert got[1].score < 1000 * got[6].score


def test_empty_tables_and_nothing_to_train_on(spark):
    assert rows_of(lattice.score(table(spark, []), PATH)) == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = lattice.score(table(spark, [(held, "some words", "e", "x", 0)]), PATH).collect()
    assert row.train_tokens == row.n_known == 0 and row.base_score == 0 and row.score < 0

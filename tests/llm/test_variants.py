import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinetrail.llm import variants

from .common_cases import clashing, rows_of, table


def near(a, b):
    """Exactly one edit apart."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute(words):
    beside = {a: [b for b in words if near(a, b)] for a in words}
    form = {}
    for a, n in words.items():
        best = min(beside[a], key=lambda b: (-words[b], b), default=None)
        form[a] = best if best and words[best] >= 5 * n else None

    def root(a):
        while form[a]:
            a = form[a]
        return a

    return sorted(((a, form[a], root(a), n, len(beside[a]), form[a] and words[form[a]]) for a, n in words.items()), key=repr)


def mangled(rng, word):
    at = rng.randrange(len(word) + 1)
    letter = rng.choice("abéü")
    return rng.choice((word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]))


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnop", "aéüßÀ"])
def test_against_brute_force(spark, letters):
    rng = random.Random(letters)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(25)]
    words = [w for b in base for w in [b] * rng.choice((5, 30, 200)) + [mangled(rng, b)] * 5 + [mangled(rng, mangled(rng, b))] * 5]
    rng.shuffle(words)
    rows = [(k, " ".join(words[k::150]), "e", "x", 0) for k in range(150)]
    rows += [(None, " ".join(base * 3), "e", "x", 0), (500, None, "e", "x", 0), (501, "", "e", "x", 0), rows[0], (502, base[0].upper() + "漢" + base[1] + "1" + base[2] + "ÿ×÷", "e", "x", 0)]
    want = brute(counted(rows))
    assert rows_of(variants.variants(clashing(table(spark, rows))).select("word", "form", "root", "n", "n_near", "form_n")) == want
    assert any(r[1] for r in want)


def test_a_character_goes_from_one_run_in_199(spark):
    rows = [(k, "abcdefgh " * 3, "e", "x", 0) for k in range(2000)]
    assert {r.word: r.n for r in variants.word_counts(table(spark, rows)).collect()} == counted(rows)
    assert len(counted(rows)) > 1


def test_chains_of_forms_and_ties(spark):
    chain = {"abcdef": 5, "abcdefg": 25, "abcdefgh": 125, "abcdefghi": 625, "zbcdefg": 25}
    words = spark.createDataFrame(list(chain.items()), "word string, n long")
    pairs = {frozenset((r.a, r.b)) for r in variants.near_pairs(words).collect()}
    assert pairs == {frozenset((a, b)) for a in chain for b in chain if near(a, b)}
    ends = variants.roots(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "e")], "word string, form string"))
    assert rows_of(ends) == [(a, "e") for a in "abcdx"]
    assert rows_of(variants.variants(table(spark, []))) == []


def test_long_words_and_texts(spark):
    long = "abcdefghij" * 5000
    rows = [(k, f"{long} " + "filler words " * 30_000, "e", "x", 0) for k in range(6)] + [(k, long[:-1], "e", "x", 0) for k in range(10, 40)]
    got = rows_of(variants.variants(table(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n"))
    assert got == brute(counted(rows)) and any(len(r[0]) == 50_000 and r[1] for r in got)


def test_rare_bigrams_bound_what_meets(spark):
    rng = random.Random(9)
    words = list({"".join(rng.choice("abcdefghijklmnopqrst") for _ in range(8)) for _ in range(20_000)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    keys = variants._keys(df)
    assert keys.groupBy("word").count().agg(F.max("count")).first()[0] == 6
    assert keys.groupBy("side", "size", "text").count().agg(F.max("count")).first()[0] < 200

import hashlib
import random
import re

import numpy as np

from kinetrail.llm import pii

from .common_cases import clashing, corpus, rows_of, table

#: The base patterns as given.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        if not 14 <= len(digits) <= 19:
            return False
        return sum(sum(divmod(d * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), k, m.end()) for k, (name, p) in enumerate(GIVEN.items()) for m in re.finditer(p, text or "") if holds(name, m[0])]
    return sorted(found)


def test_base_spans_against_the_patterns(spark):
    rng = random.Random(3)
    parts = ["a.b@c.d", "x@y", "@", "1.2.3.4", "256.1.1.1", "001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "١٢٣.1.1.1", "q@w.e.r", ".", "-", " ", "7", "é", "+49 30 1234567", "\n", "..@-.-", "a@b.c@d.e", "1.2.3.4.5.6.7.8"]
    rows = corpus(8, 30)
    rows += [(1000 + k, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 25))), "en", "x", 0) for k in range(400)]
    got = pii.detect(clashing(table(spark, rows))).collect()
    names = list(GIVEN)
    want = []
    for r in rows:
        b = base(r[1])
        said = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in b)
        want.append((r[0], *[sum(k == x for _, x, _ in b) for k in range(4)], hashlib.sha256(said.encode()).hexdigest(), said))
    assert sorted(tuple(r)[:6] for r in got) == sorted(w[:6] for w in want)
    base_of = {w[0]: w[6] for w in want}
    for r in got:
        assert set(filter(None, base_of[r.doc_id].split(","))) <= set(filter(None, r.spans.split(",")))


def test_learns_which_opaque_strings_are_private(spark):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(32))
    rows = [(k, f"the api key is {key()} for you" if k % 2 else f"a word like section00000000000000000{k} here", "en", "x", 0) for k in range(80)]
    got = {r.doc_id: r.spans for r in pii.detect(table(spark, rows)).collect()}
    assert all(("secret:" in got[k]) == bool(k % 2) for k in range(80))
    masked = {r.doc_id: r.text for r in pii.masked(table(spark, rows)).collect()}
    assert masked[1] == "the api key is [SECRET] for you" and masked[2] == rows[2][1]


def test_em_finds_the_better_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.4
    votes = np.stack([np.where(rng.random(20_000) < p, truth, ~truth) for p in (0.95, 0.8, 0.7)], 1).astype(int)
    codes, counts = np.unique((votes[:, 0] * 9 + votes[:, 1] * 3 + votes[:, 2]) * 32, return_counts=True)
    posterior, table_ = pii.reliabilities(codes, counts.astype(float))
    right = [table_[k, 1, 1] for k in range(3)]
    assert right[0] > right[1] > right[2] and abs(right[0] - 0.95) < 0.05
    v = codes // 32
    by_code = dict(zip(codes.tolist(), posterior, strict=True))
    mine = np.array([by_code[c] > 0.5 for c in ((votes[:, 0] * 9 + votes[:, 1] * 3 + votes[:, 2]) * 32).tolist()])
    assert (mine == truth).mean() > 0.93 and len(v)


def test_empty_null_and_stage_columns(spark):
    assert pii.detect(table(spark, [])).collect() == []
    docs = clashing(table(spark, [(1, None, None, None, None), (2, "", "e", "x", 0), (2, "mail a@b.co", "e", "x", 0)]))
    got = rows_of(pii.detect(docs).select("doc_id", "n_email", "spans"))
    assert got == [(1, 0, ""), (2, 0, ""), (2, 1, "email:5:11")]
    masked = pii.masked(docs)
    assert masked.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in masked.collect()) == [(1, ""), (2, ""), (2, "mail [EMAIL]")]


def test_secrets_of_any_length(spark):
    rng = random.Random(12)
    key = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789+/") for _ in range(n))
    rows = [(k, f"private key: {key(n)}= end", "en", "x", 0) for k, n in enumerate([16, 40, 511, 512, 513, 1600, 100_000] * 6)]
    rows += [(len(rows) + k, f"a word like sectionnnnnnnnnnnnnnnnnn{k} here", "en", "x", 0) for k in range(42)]
    masked = {r.doc_id: r.text for r in pii.masked(table(spark, rows)).collect()}
    assert all(masked[k] == ("private key: [SECRET] end" if k < 42 else rows[k][1]) for k in range(84))

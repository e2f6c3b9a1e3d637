import random
import re

from kinetrail.llm import licenses

from .common_cases import clashing, corpus, rows_of, sentence, table


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark):
    rows = corpus(14, 40)
    rows += [
        (500, "MIT License mit  LICENSE; the General\nPublic-License of apache... license", "e", "x", 0),
        (501, "license mit license license", "e", "x", 0),
        (502, "general public licensed", "e", "x", 0),
        (503, "public license", "e", "x", 0),
    ]
    got = licenses.scan(clashing(table(spark, rows)))
    assert rows_of(got.drop("labels", "score")) == sorted(((r[0], *base(r[1])) for r in rows), key=repr)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got.collect())
    assert "Python" not in got._jdf.queryExecution().toString()


def test_templates_found_with_edits_and_not_in_plain_text(spark):
    bsd = next(t for label, t, _ in licenses.TEMPLATES if label == "bsd")
    isc = next(t for label, t, _ in licenses.TEMPLATES if label == "isc").split()
    edited = " ".join([*isc[:8], "really", *isc[8:20], *isc[21:]])
    rows = [(1, f"Some words first. {bsd}. Then more.", "e", "x", 0), (2, f"x y {edited} z", "e", "x", 0), (3, "Redistribution and use of water is a plain matter of fact", "e", "x", 0), (4, bsd, "e", "x", 0), (4, bsd, "e", "x", 0)]
    got = sorted((r.doc_id, r.labels) for r in licenses.scan(table(spark, rows)).collect())
    assert got == [(1, "bsd"), (2, "isc"), (3, ""), (4, "bsd"), (4, "bsd")]


def plain_labels(text):
    """By brute force: labels of templates 60% of whose grams are in the text, which holds their core words."""
    low = [w for w in re.findall(r"[a-z0-9]+", text.lower())]
    have = {tuple(low[i : i + 4]) for i in range(len(low) - 3)}
    out = set(filter(None, base(text)[-1].split(",")))
    for label, template, core in licenses.TEMPLATES:
        ws = re.findall(r"[a-z0-9]+", template.lower())
        own = [tuple(ws[i : i + 4]) for i in range(len(ws) - 3)]
        if sum(g in have for g in own) >= licenses.LEAST * len(own) and (core is None or tuple(core.split()) in have):
            out.add(label)
    return ",".join(sorted(out))


def test_each_template_with_edits_and_none_of_its_kin(spark):
    rng = random.Random(19)
    rows = []
    for label, template, core in licenses.TEMPLATES:
        words = template.split()
        rows.append((len(rows), f"{sentence(rng, 30)} {template} {sentence(rng, 30)}", "e", "x", 0))
        if len(words) > 25:
            for at in range(20, len(words), 40):
                if not core or not set(re.findall("[a-z]+", words[at].lower())) & set(core.split()):
                    words[at] = "changed"
            rows.append((len(rows), f"{sentence(rng, 30)} {' '.join(words)} {sentence(rng, 30)}", "e", "x", 0))
        rows.append((len(rows), f"{sentence(rng, 30)} {' '.join(template.split()[: len(template.split()) // 3])} {sentence(rng, 30)}", "e", "x", 0))
    rows += [(len(rows) + k, sentence(rng, 200), "e", "x", 0) for k in range(20)]
    got = {r.doc_id: r.labels for r in licenses.scan(table(spark, rows)).collect()}
    assert got == {r[0]: plain_labels(r[1]) for r in rows}
    labels = {label for label, *_ in licenses.TEMPLATES}
    assert labels == {x for v in got.values() for x in v.split(",") if x}
    assert sum(v == "" for v in got.values()) >= 20


def test_grams_of_texts_are_dropped_before_rows_are_made(spark):
    grams = licenses.template_grams(spark).collect()
    assert all(r.core >= -1 for r in grams) and {r.core >= 0 for r in grams} == {True, False}
    assert all(core is None or any(r.template == k and r.core == r.at for r in grams) for k, (*_, core) in enumerate(licenses.TEMPLATES))


def test_empty_table(spark):
    assert licenses.scan(table(spark, [])).collect() == []

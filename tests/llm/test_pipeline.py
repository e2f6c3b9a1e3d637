import random
import re

import corpus_pipeline

from kinetrail.llm.common import written

from .common_cases import corpus, sentence, table


def test_stages_keep_columns_and_pack_what_is_left(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, sf))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[5] > 0
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(docs.columns)


def test_stages_take_nulls_repeated_rows_and_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus(21, 40) + [(None, sentence(random.Random(22), 30), None, None, None), (60, "mail a.b@c.org or +49 30 1234567 now " + sentence(random.Random(23), 20), "en", "x", None)]
    for docs in (table(spark, rows), table(spark, [])):
        seen = []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = written(stage(spark, docs, sf))
            seen.append(docs.collect())
            assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        kept, one_each, masked, mixed, packed = seen
        words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert all(words(r) >= 10 for r in kept) and {tuple(r) for r in kept} <= set(rows)
        assert {tuple(r) for r in one_each} <= {tuple(r) for r in kept}
        # Equal texts have equal fingerprints, of which one document stays.
        texts = [r.text for r in one_each]
        assert len(texts) == len(set(texts))
        assert sorted(map(repr, (r.doc_id for r in masked))) == sorted(map(repr, (r.doc_id for r in one_each)))
        assert not any("a.b@c.org" in r.text or "1234567" in r.text for r in masked)
        assert all(r.n_chars == len(r.text) for r in masked + mixed)
        assert {r.doc_id for r in mixed} <= {r.doc_id for r in masked}
        places = {}
        for r in packed:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for held in places.values():
            held.sort()
            assert all(o == sum(n for _, n in held[:i]) for i, (o, _) in enumerate(held)) and sum(n for _, n in held) <= 2048
        assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}

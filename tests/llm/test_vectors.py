import numpy as np

from kinetrail.llm import vectors
from kinetrail.llm.common import table as stored

from .common_cases import components_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    good = {}
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            v = np.array(v, np.float64)
            good[i] = v / np.linalg.norm(v)
    ids = list(good)
    return good, ids


def planted(seed, n=600, width=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    for k in range(0, n, 5):  # families of near vectors
        x[k + 1 : k + 4] = x[k] + 0.25 * rng.standard_normal((len(x[k + 1 : k + 4]), width))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def checked(spark, rows, recall=0.99):
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()}
    good, ids = brute(rows)
    near = lambda a, b: a in good and b in good and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9
    true = {a: sum(near(a, b) for b in ids if b != a) for a in good}
    assert len(got) == len(rows)
    assert all(got[i].n_links <= true.get(i, 0) for i, _ in rows)
    assert sum(r.n_links for r in got.values()) >= recall * sum(true.values())
    want = components_of([i for i, _ in rows], near)
    assert np.mean([got[i].component_id == want[i] for i, _ in rows]) >= recall
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_recall_against_brute_force(spark):
    checked(spark, planted(1))


def test_unusable_vectors_copies_and_other_lengths(spark):
    rows = planted(2, 100)
    nan, inf = float("nan"), float("inf")
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [nan] * 16), (204, [inf] + [1.0] * 15), (205, [None] + [1.0] * 15)]
    rows += [(300 + k, rows[0][1]) for k in range(30)] + [(400, [2 * c for c in rows[0][1]]), (401, [1.0, 2.0]), (402, [1.0, 2.1])]
    checked(spark, rows)


def test_query_table_recall(spark):
    df = stored(spark, "/root/testdata/sf0.001", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    checked(spark, rows)


def test_empty_table(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_graph_that_misses_is_searched_whole_before_beams_grow_wide(monkeypatch):
    x = np.random.default_rng(4).standard_normal((2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vectors.build(x.astype(np.float32), np.random.default_rng(5).random(len(x)))
    graph["links0"][:] = len(x)  # no path leads on
    layers = []
    for at in range(int(graph["levels"][0]), -1, -1):
        links = np.full((len(x), graph[f"links{at}"].shape[1]), len(x))
        links[graph[f"members{at}"]] = graph[f"links{at}"]
        layers.append((graph[f"members{at}"], links))
    widths, found = [], vectors._found
    monkeypatch.setattr(vectors, "_found", lambda g, q, beam, floor: widths.append(beam) or found(g, q, beam, floor))
    asked = x[:300].astype(np.float32)
    assert vectors.audited([x, x.astype(np.float32), layers], asked, 0.9, vectors.BEAM)[0] == -1
    assert max(widths) <= len(x) // 16
    ids, sims = found([x, x.astype(np.float32), layers], asked, -1, 0.9)
    assert [set(i[s >= 0.9]) for i, s in zip(ids, sims)] == [set(np.flatnonzero(row >= 0.9)) for row in asked @ x.astype(np.float32).T]


def test_a_far_narrow_cluster_is_entered_by_its_own_member():
    rng = np.random.default_rng(6)
    x = np.vstack([rng.standard_normal((1500, 64)), rng.standard_normal(64) + 0.02 * rng.standard_normal((200, 64))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x = x[rng.permutation(len(x))]
    graph = vectors._opened(x.astype(np.float64), vectors.build(x, rng.random(len(x))))
    assert vectors.audited(graph, x, 0.9, vectors.BEAM) == (vectors.BEAM, 1.0)


def test_many_shards_count_each_link_for_both_sides(spark):
    rows = planted(7, 300)
    few, many = ({(r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), shards=k).collect()} for k in (1, 9))
    assert few == many and any(n for _, n, _ in few)

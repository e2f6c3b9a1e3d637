"""Embedding near-duplicates with a hierarchical navigable small-world graph for each shard.

Equal vectors are one class. Classes are dealt to ``SHARDS`` shards by hash, and each shard builds
its graph (Malkov and Yashunin 2016): a class reaches level l with probability 16^-l; its level's
members are inserted in batches, linked to diverse near ones found by beam search, and
members that no path reaches are linked from their nearest. A search begins at the best of the lowest level with at
most ``TOP`` members, all compared, so that a narrow cluster far from all else is entered by its own member. Every class queries
its own shard and, of any two shards, the classes of one query the other: what is found counts for both sides.
A beam that overflows with vectors over the threshold goes on at twice its width, nothing over the threshold
being dropped; a query that has reached the threshold follows only what is within ``LEEWAY`` of it.

When a graph is built, an audit compares its answers with brute force over the shard, to ``AUDIT`` queries of the table (the
first classes by hash, a bounded sample) and as many made at the threshold's border from
the shard's own vectors. The start width doubles until the recall of both reaches TARGET; a shard whose
graph does not reach it at a ``WIDEST`` part of its vectors is searched whole, which costs less than wider beams.
Candidates are verified by cosine in double precision.

A task holds one shard's graph and a block of queries at a time. It returns for each query how many
rows it links to, and links that connect what is connected: one a query and one a member, not
all pairs. There are SHARDS shards at least, and more so that none has over about SHARD_ROWS
classes, which bounds a graph's memory (about 700 bytes a class); slices grow alike, and (shard, slice) is dealt by range, so that tasks have equal numbers of blocks.

Null, empty, zero, or otherwise unusable vectors (null or non-finite components) link with
nothing; vectors of other lengths than the most frequent only with those of their own length.
Repeated rows link with each other, a null vec_id is like any other (after all others as a component's id).
An empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small, written

THRESHOLD = 0.9
SHARDS = 8
SLICES = 8
SHARD_ROWS = 200_000
DEGREE = 16
BUILD_BEAM = 64
BEAM = 16
TOP = 4096
WIDEST = 16
AUDIT = 256
LEEWAY = 0.2
BROADCAST_ROWS = 1_000_000
TARGET = 0.99
BATCH = 256
BLOCK = 512
#: Float sums may fall this short of the double ones; verification decides.
SHORT = 1e-4


def search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, floor: float | None = None):
    """Beam search for all queries at once: (ids, similarities), best first, -1 padded.

    With ``floor``, a query with more than ``beam`` vectors at or over it goes on with a beam of twice the width.
    """
    n, b = len(x), len(queries)
    beam = min(beam, n)
    entry = np.sort(entry, axis=1)
    entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = n  # an entry named twice counts once
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    seen[np.arange(b)[:, None], entry] = True
    sims = np.where(entry == n, -np.inf, np.einsum("bd,bkd->bk", queries, x[np.minimum(entry, n - 1)]))
    padded = np.vstack([links, np.full((1, links.shape[1]), n, links.dtype)])
    ids, sims = _beams(x, padded, queries, entry, sims, np.zeros_like(entry, bool), seen, beam, floor)
    order = np.argsort(-sims, axis=1)
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(ids == n, -1, ids), sims


def _beams(x: np.ndarray, padded: np.ndarray, queries: np.ndarray, first_ids: np.ndarray, first_sims: np.ndarray, first_done: np.ndarray, seen: np.ndarray, beam: int, floor: float | None):
    """Beams from a state on, until all in them is expanded: (ids, sims), as wide as the widest needs."""
    n, b = len(x), len(queries)
    ids, sims, done = np.full((b, beam), n), np.full((b, beam), -np.inf, np.float32), np.zeros((b, beam), bool)
    live = np.arange(b)
    over: list[tuple[np.ndarray, ...]] = []

    def keep(all_ids: np.ndarray, all_sims: np.ndarray, all_done: np.ndarray) -> None:
        nonlocal live
        if floor is not None and beam < n:
            full = (all_sims >= floor).sum(1) > beam
            if full.any():
                over.append((live[full], all_ids[full], all_sims[full], all_done[full]))
                live, all_ids, all_sims, all_done = (v[~full] for v in (live, all_ids, all_sims, all_done))
        if all_ids.shape[1] > beam:
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            all_ids, all_sims, all_done = (np.take_along_axis(v, top, 1) for v in (all_ids, all_sims, all_done))
        k = all_ids.shape[1]
        ids[live, :k], sims[live, :k], done[live, :k] = all_ids, all_sims, all_done

    keep(first_ids, first_sims, first_done)
    width = min(4, beam)
    while len(live):
        score = np.where(done[live] | (ids[live] == n), -np.inf, sims[live])
        if floor is not None:  # once at the threshold, what lies far below it leads nowhere
            score[(sims[live].max(1) >= floor)[:, None] & (score < floor - LEEWAY)] = -np.inf
        pick = np.argpartition(-score, width - 1, axis=1)[:, :width]
        good = np.take_along_axis(score, pick, 1) > -np.inf
        on = good.any(1)
        live, pick, good = live[on], pick[on], good[on]
        if not len(live):
            break
        done[live[:, None], pick] |= good
        new = padded[np.where(good, ids[live[:, None], pick], n)].reshape(len(live), -1)
        new = np.where(seen[live[:, None], new], n, new)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new.sort(axis=1)
        new = new[:, : max(int((new < n).sum(1).max()), 1)]
        seen[live[:, None], new] = True
        near = np.full(new.shape, -np.inf, np.float32)
        r, c = np.nonzero(new < n)
        near[r, c] = np.einsum("kd,kd->k", queries[live[r]], x[new[r, c]])
        keep(np.hstack([ids[live], new]), np.hstack([sims[live], near]), np.hstack([done[live], np.zeros_like(new, bool)]))
    if over:
        width = max(v[1].shape[1] for v in over)
        rows = np.concatenate([v[0] for v in over])
        fill = lambda v, value: np.pad(v, ((0, 0), (0, width - v.shape[1])), constant_values=value)
        state = (np.vstack([fill(v[k], value) for v in over]) for k, value in ((1, n), (2, -np.inf), (3, False)))
        more_ids, more_sims = _beams(x, padded, queries[rows], *state, seen[rows], min(2 * beam, n), floor)
        pad = more_ids.shape[1] - beam
        ids, sims = np.pad(ids, ((0, 0), (0, pad)), constant_values=n), np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf)
        ids[rows], sims[rows] = more_ids, more_sims
    return ids, sims


def diverse(x: np.ndarray, me: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of candidates best first, those nearer to the row's vector than to any chosen before; then the best left."""
    b, width = ids.shape
    usable = (ids >= 0) & (ids != me[:, None])
    near = x[np.maximum(ids, 0)]
    between = near @ near.transpose(0, 2, 1)
    blocked = np.full((b, width), -np.inf, np.float32)
    chosen = np.zeros((b, width), bool)
    room = np.full(b, degree)
    for j in range(width):
        take = usable[:, j] & (sims[:, j] > blocked[:, j]) & (room > 0)
        if take.any():
            chosen[:, j] = take
            room -= take
            blocked = np.where(take[:, None], np.maximum(blocked, between[:, j]), blocked)
    rank = np.where(chosen, np.arange(width), np.where(usable, np.arange(width) + width, 2 * width + np.arange(width)))
    order = np.argsort(rank, axis=1)[:, :degree]
    out = np.where(np.take_along_axis(usable, order, 1), np.take_along_axis(ids, order, 1), -1)
    return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


def build(x: np.ndarray, draws: np.ndarray) -> dict[str, np.ndarray]:
    """Graph of unit vectors (float32); draws: uniform numbers that set levels. Layers hold member ids and links."""
    n = len(x)
    level = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(DEGREE)).astype(int), 5)
    level[int(level.argmax())] = level.max()
    graph: dict[str, np.ndarray] = {"levels": np.array([level.max()])}
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(level.max(), -1, -1):
        members = np.argsort(-level, kind="stable")[: int((level >= at).sum())]
        links = np.full((n, DEGREE * (2 if at == 0 else 1)), n)
        _fill(x, links, members, layers)
        layers.append((members, links))
        graph[f"links{at}"] = links[members].astype(np.int32)
        graph[f"members{at}"] = members.astype(np.int32)
    return graph


def _descend(x: np.ndarray, layers: list, queries: np.ndarray) -> np.ndarray:
    top = max((k for k, (members, _) in enumerate(layers) if len(members) <= TOP), default=0)
    members = layers[top][0][:TOP]
    near = queries @ x[members].T
    some = min(8, len(members))
    entry = members[np.argpartition(-near, some - 1, axis=1)[:, :some]]
    for _, links in layers[top + 1 :]:
        ids, _ = search(x, links, queries, entry, 8)
        entry = np.where(ids < 0, ids[:, :1], ids)
    return entry


def _fill(x: np.ndarray, links: np.ndarray, members: np.ndarray, layers: list) -> None:
    degree, n = links.shape[1], len(x)
    at = 0
    while at < len(members):
        size = max(1, min(BATCH, at))
        batch = members[at : at + size]
        if at:
            entry = _descend(x, layers, x[batch]) if layers else np.full((len(batch), 1), members[0])
            entry = np.where(np.isin(entry, members[:at]), entry, members[0])
            ids, sims = search(x, links, x[batch], entry, BUILD_BEAM)
            among = x[batch] @ x[batch].T  # a batch's members see each other too
            ids = np.hstack([ids, np.broadcast_to(batch, (len(batch), len(batch)))])
            sims = np.hstack([sims, among])
            order = np.argsort(-sims, axis=1, kind="stable")[:, : BUILD_BEAM + 1]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            _connect(x, links, batch, diverse(x, batch, ids, sims, max(degree // 2, 1)))
        at += len(batch)
    # What no path reaches gets a link from its nearest reached member, in place of that one's last.
    for _ in range(20):
        reached = np.zeros(n + 1, bool)
        edge = members[:1]
        reached[edge] = True
        reached[n] = True
        while len(edge):
            edge = np.unique(links[edge])
            edge = edge[~reached[edge]]
            reached[edge] = True
        lost = members[~reached[members]]
        if not len(lost):
            break
        ids, _ = search(x, links, x[lost], np.full((len(lost), 1), members[0]), BUILD_BEAM)
        for one, near in zip(lost.tolist(), ids, strict=True):
            for k, target in enumerate(near[near >= 0].tolist()):
                free = np.flatnonzero(links[target] == n)
                if len(free) or k >= 8:
                    links[target, free[0] if len(free) else -1] = one
                    break


def _connect(x: np.ndarray, links: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
    n, degree = len(x), links.shape[1]
    links[batch, : chosen.shape[1]] = np.where(chosen < 0, n, chosen)
    a = np.repeat(batch, chosen.shape[1])[chosen.ravel() >= 0]
    b = chosen.ravel()[chosen.ravel() >= 0]
    full: dict[int, list[int]] = {}
    for source, target in zip(a.tolist(), b.tolist(), strict=True):
        row = links[target]
        if (row == source).any():
            continue
        free = np.flatnonzero(row == n)
        if len(free):
            row[free[0]] = source
        else:
            full.setdefault(target, []).append(source)
    if full:
        me = np.array(list(full))
        width = degree + max(map(len, full.values()))
        ids = np.full((len(me), width), -1)
        for r, (target, more) in enumerate(full.items()):
            ids[r, : degree + len(more)] = [*links[target].tolist(), *more]
        sims = np.where(ids < 0, -np.inf, np.einsum("bd,bkd->bk", x[me], x[np.maximum(ids, 0)]))
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        best = diverse(x, me, ids, sims, degree)
        links[me] = np.where(best < 0, n, best)


def _unit(vector: np.ndarray | None) -> np.ndarray | None:
    if vector is None or not len(vector):
        return None
    v = np.array([np.nan if c is None else c for c in vector], np.float64)
    size = np.abs(v).max()
    if not np.isfinite(size) or not np.isfinite(v).all() or size == 0:
        return None
    v = v / size
    return v / np.sqrt(v @ v)


def _classes(vectors: pd.Series) -> pd.DataFrame:
    raw = [None if (u := _unit(v)) is None else u.tobytes() for v in vectors]
    return pd.DataFrame({"class": [r and xxhash.xxh128_hexdigest(r) for r in raw], "unit": raw})


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _index(threshold: float, sample: list[bytes]):
    """A shard's graph and the start width its audits set, a row for each length of vectors; a partition is a shard."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        rows = pd.concat(held).sort_values("class") if held else pd.DataFrame(columns=["shard", "class", "rows", "unit"])
        for size, part in rows.groupby(rows["unit"].map(len)):
            unit = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(len(part), -1)
            draws = np.array([xxhash.xxh32_intdigest(c) for c in part["class"]]) / 2**32
            graph = build(unit.astype(np.float32), draws)
            own = [np.frombuffer(v, np.float64) for v in sample if len(v) == size]
            beam = _start(_opened(unit, graph), threshold, np.array(own).reshape(len(own), -1))
            blob = _packed(unit=unit, rows=part["rows"].to_numpy(), names=part["class"].to_numpy().astype("S32"), beam=np.array([beam]), **graph)
            yield pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "size": [int(size)], "blob": [blob]})

    return index


def _answers(threshold: float):
    """Answers of shards to blocks of queries; rows come sorted by (shard, slice, kind), a slice's graphs before its queries."""

    def members(graphs: dict[int, list]) -> Iterator[pd.DataFrame]:
        for _, _, _, names, _, root, counts in graphs.values():
            found = np.array([_find(root, i) for i in range(len(root))])
            i = np.flatnonzero((found != np.arange(len(root))) | (counts > 0))
            linked = np.where(found[i] == i, None, names[found[i]].astype(str).astype(object))
            yield pd.DataFrame({"class": names[i].astype(str), "linked": linked, "n": counts[i]})

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}
        for batch in batches:
            for kind, shard, part, size, blob in zip(batch["kind"], batch["shard"], batch["slice"], batch["size"], batch["blob"], strict=True):
                if (shard, part) != at:
                    yield from members(held)
                    at, held = (shard, part), {}
                loaded = np.load(io.BytesIO(blob))
                if kind == 0:
                    unit = loaded["unit"]
                    n = len(unit)
                    held[size] = [*_opened(unit, loaded), loaded["names"], (loaded["rows"], int(loaded["beam"][0])), np.arange(n), np.zeros(n, np.int64)]
                elif size in held:
                    yield _ask(held[size], loaded, threshold)
        yield from members(held)

    return answer


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _found(graph: list, queries: np.ndarray, beam: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of unit vectors by the graph; by the whole shard if beam is -1."""
    _, x, layers = graph[:3]
    if beam < 0:
        near = queries @ x.T
        r, c = np.nonzero(near >= floor)
        best = np.lexsort([-near[r, c], r])
        r, c = r[best], c[best]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        ids = np.full((len(queries), int(place.max(initial=0)) + 1), -1)
        sims = np.full(ids.shape, -np.inf, np.float32)
        ids[r, place], sims[r, place] = c, near[r, c]
        return ids, sims
    entry = _descend(x, layers[:-1], queries) if layers[:-1] else np.zeros((len(queries), 1), int)
    return search(x, layers[-1][1], queries, entry, beam, floor)


def border(x: np.ndarray, threshold: float, many: int) -> np.ndarray:
    """Queries about as far from some of the vectors as the threshold allows."""
    rng = np.random.default_rng(0)
    some = x[rng.permutation(len(x))[:many]]
    noise = rng.standard_normal(some.shape).astype(np.float32)
    noise -= (noise * some).sum(1, keepdims=True) * some
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-9)
    cosine = min(threshold + 0.02, 1.0)
    return cosine * some + np.sqrt(1 - cosine**2) * noise


def audited(graph: list, queries: np.ndarray, threshold: float, beam: int) -> tuple[int, float]:
    """(start width, recall) at which the graph finds TARGET of what brute force finds; -1 if it takes too wide a one."""
    x, n = graph[1], len(graph[1])
    true = [set(np.flatnonzero(row >= threshold).tolist()) for row in queries @ x.T]
    of = sum(map(len, true))
    while True:
        got = 0
        for k in range(0, len(queries), BATCH):
            ids, sims = _found(graph, queries[k : k + BATCH], beam, threshold)
            got += sum(len(t & set(i[s >= threshold].tolist())) for t, i, s in zip(true[k : k + BATCH], ids, sims, strict=True))
        if got >= TARGET * of:
            return beam, got / of if of else 1.0
        beam *= 2
        if beam > max(n // WIDEST, BEAM):
            return -1, 1.0


def _opened(unit: np.ndarray, graph) -> list:
    """Unit vectors and layers of a graph, ready for queries."""
    n, layers = len(unit), []
    for at in range(int(graph["levels"][0]), -1, -1):
        links = np.full((n, graph[f"links{at}"].shape[1]), n)
        links[graph[f"members{at}"]] = graph[f"links{at}"]
        layers.append((graph[f"members{at}"], links))
    return [unit, unit.astype(np.float32), layers]


def _start(graph: list, threshold: float, sample: np.ndarray) -> int:
    """The start width that the audits set."""
    beam = BEAM
    for asked in (sample.astype(np.float32), border(graph[1], threshold, AUDIT)):
        if len(asked) and beam > 0:
            beam, _ = audited(graph, asked, threshold, beam)
    return beam


def _ask(graph: list, queries, threshold: float) -> pd.DataFrame:
    """Numbers of rows linked to the queries, and one link each; what other shards' queries link to is counted in the graph."""
    unit, _, _, names, (rows, beam), root, members = graph
    asked, asker, many, others = queries["unit"], queries["names"], queries["rows"], bool(queries["others"][0])
    counts, linked = np.zeros(len(asked), np.int64), [None] * len(asked)
    for k in range(0, len(asked), BATCH):
        part = asked[k : k + BATCH]
        ids, sims = _found(graph, part.astype(np.float32), beam, threshold - SHORT)
        for r in np.flatnonzero(sims[:, 0] >= threshold - SHORT).tolist():
            near = ids[r][sims[r] >= threshold - SHORT]
            near = near[(unit[near] @ part[r] >= threshold) & (names[near] != asker[k + r])]
            if len(near):
                counts[k + r] = rows[near].sum()
                if others:
                    members[near] += many[k + r]
                linked[k + r] = names[near[0]].decode()
                tops = {_find(root, i) for i in np.unique(root[near]).tolist()}
                root[list(tops)] = min(tops)
    return pd.DataFrame({"class": asker.astype(str), "linked": linked, "n": counts})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shards: int = SHARDS, slices: int = SLICES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    told = F.pandas_udf(_classes, "class string, unit binary")
    known = written(vectors.select("vec_id", told("embedding").alias("k")).select("vec_id", "k.class", "k.unit"))
    classes = written(known.where("class is not null").groupBy("class").agg(F.count("*").alias("rows"), F.min("vec_id").alias("least"), F.first("unit").alias("unit")))
    many = -(-classes.count() // shard_rows)
    shards, slices = max(shards, many), max(slices, many)
    sharded = classes.withColumn("shard", F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int"))
    # For the audits: a sample of AUDIT vectors comes to the driver.
    sample = [bytes(r["unit"]) for r in classes.orderBy("class").limit(AUDIT).select("unit").collect()]
    graphs = written(sharded.select("shard", "class", "rows", "unit").repartitionById(shards, "shard").mapInPandas(_index(threshold, sample), "shard int, size int, blob binary"))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (shard, size), part in batch.groupby([batch["shard"], batch["unit"].map(len)]):
                for k in range(0, len(part), BLOCK):
                    some = part.iloc[k : k + BLOCK]
                    unit = np.frombuffer(b"".join(some["unit"]), np.float64).reshape(len(some), -1)
                    data = {"unit": unit, "names": some["class"].to_numpy().astype("S32"), "rows": some["rows"].to_numpy()}
                    blobs = [_packed(**data, others=np.array([others])) for others in (0, 1)]
                    yield pd.DataFrame({"own": [int(shard)], "size": [int(size)], "mine": blobs[:1], "others": blobs[1:]})

    # Of two shards one asks the other, each about half of the others.
    ahead = lambda k: F.pmod(k - F.col("own"), F.lit(shards))
    turn = lambda k: (2 * ahead(k) < shards) | ((2 * ahead(k) == shards) & (F.col("own") < k))
    every = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), turn))
    asked = sharded.select("shard", "class", "rows", "unit").sortWithinPartitions("shard").mapInPandas(blocks, "own int, size int, mine binary, others binary")
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("mine"), F.lit(slices)).cast("int")).select("*", every.alias("shard"))
    asked = asked.select(F.lit(1).alias("kind"), "shard", "slice", "size", F.when(F.col("shard") == F.col("own"), F.col("mine")).otherwise(F.col("others")).alias("blob"))
    copies = graphs.select(F.lit(0).alias("kind"), "shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "size", "blob")
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards * slices // 8)
    met = copies.unionByName(asked).repartitionByRange(tasks, "shard", "slice").sortWithinPartitions("shard", "slice", "kind")
    found = written(met.mapInPandas(_answers(threshold), "class string, linked string, n long"))
    linked = components(found.where("linked is not null").select(F.col("class").alias("a"), F.col("linked").alias("b")))
    counts = found.groupBy(F.col("class").alias("_class")).agg(F.sum("n").alias("n"))
    met = classes.select("class", "rows", "least").join(counts, F.col("class") == F.col("_class"), "left").join(linked, F.col("class") == F.col("node"), "left")
    met = written(met.select("class", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component", "class").alias("top"), "least"))
    least = written(met.groupBy(F.col("top").alias("_top")).agg(F.min("least").alias("component")))
    # Components as a table to look up: one with very many members is no hot key of a shuffle.
    done = written(met.join(small(least, BROADCAST_ROWS), F.col("top") == F.col("_top")).select(F.col("class").alias("_class"), "n_links", "component"))
    joined = known.select("vec_id", "class").join(done, F.col("class") == F.col("_class"), "left")
    component = F.coalesce("component", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(False))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))

"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

Equal vectors are one, and vectors within half the linking angle of their
cluster's centre are one ball: they all link with each other, so that a crowd of
near copies is a single node of the graph. Nodes go to the shards of their nearest
centres; each shard builds a graph of its own by inserting its nodes in batches, the lists
of a node's neighbours are united, and every shard searches from its medoid, and from the node
itself, for each of its nodes, with a beam that widens while all it holds is in range. Found pairs are verified in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlytics.llm.components import connected_components
from postlytics.sources.staging import cut_lineage, free

COSINE = 0.95
#: Nodes for each centre, before overlap; centres at most; vectors they are fitted on at most.
SHARD = 300
CENTRES = 4096
SAMPLE = 20_000
#: Shards that each node is in.
OVERLAP = 3
#: Shards over so many nodes are dealt with in pairs of blocks of half that size.
LARGEST = 4096
DEGREE = 16
ALPHA = 1.2
BEAM = 16
#: The beam of balls, whose range is wide; there are no more of them than centres.
BALL_BEAM = 256
#: Rows inserted into a graph at once, at most.
BATCH = 256
#: Rows of its batch that are candidates of a row.
MATES = 8
#: Lists of a searched graph that name a row, at least, as far as its own names so many.
FEWEST = 16
#: Vectors compared with all rows after each search; shards of a node at most.
AUDITED = 1000
MOST_OVERLAP = 12
RECALL = 0.9


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # Scaled first, so that no square is too large or too small.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for at, row in enumerate(column):
        out[at, : len(row)] = row
    return out


def fit_centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of ``x``; centres closer than a quarter of the linking angle are one."""
    if not len(x):
        return x
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums**2).sum(axis=1))
        some = size > 1e-9
        centres = sums[some] / size[some, None]
    apart = np.cos(np.arccos(COSINE) / 4)
    kept: list[int] = []
    for at in range(len(centres)):
        if not kept or (centres[kept] @ centres[at]).max() < apart:
            kept.append(at)
    return centres[kept]


def _chunks(n: int, values: int) -> Iterator[slice]:
    """Slices of ``n`` rows of so many numbers each that fit a few tens of megabytes."""
    step = max(1, (1 << 23) // max(1, values))
    return (slice(at, min(n, at + step)) for at in range(0, n, step))


def beam_search(
    x: np.ndarray, radius: np.ndarray, graph: np.ndarray, start: int, asked: np.ndarray, beam: int, known: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """For each row in ``asked`` the ``beam`` nearest rows that it finds, and how far off their balls are.

    ``graph`` holds neighbours, padded with -1. All rows search at once: from ``start``, and from themselves if they
    are ``known`` to the graph, each opens the nearest row it keeps and has not opened, until all rows it keeps are open.
    """
    ids = np.full((len(asked), beam), -1)
    away = np.full((len(asked), beam), np.inf, dtype=np.float32)
    for part in _chunks(len(asked), graph.shape[1] * (x.shape[1] + beam)):
        at = asked[part]
        kept, far, todo = ids[part], away[part], np.zeros((len(at), beam), dtype=bool)
        kept[:, 0], todo[:, 0] = start, True
        far[:, 0] = np.arccos(np.clip(x[at] @ x[start], -1, 1)) - radius[start]
        if known and beam > 1:
            own = at != start
            kept[own, 1], far[own, 1], todo[own, 1] = at[own], -radius[at[own]], True
        active = np.arange(len(at))
        while len(active):
            best = np.where(todo[active], far[active], np.inf).argmin(axis=1)
            go = todo[active, best]
            active, best = active[go], best[go]
            if not len(active):
                break
            todo[active, best] = False
            reached = graph[kept[active, best]]
            mine = kept[active]
            fresh = (reached >= 0) & ~(reached[:, :, None] == mine[:, None, :]).any(axis=2)
            sims = np.matmul(x[reached], x[at[active], :, None])[:, :, 0]
            turn = np.where(fresh, np.arccos(np.clip(sims, -1, 1)) - radius[reached], np.inf).astype(np.float32)
            both = np.concatenate((far[active], turn), axis=1)
            top = np.argpartition(both, beam - 1, axis=1)[:, :beam]
            far[active] = np.take_along_axis(both, top, axis=1)
            kept[active] = np.take_along_axis(np.concatenate((mine, np.where(fresh, reached, -1)), axis=1), top, axis=1)
            todo[active] = np.take_along_axis(np.concatenate((todo[active], fresh), axis=1), top, axis=1)
    return ids, away


def robust_prune(x: np.ndarray, rows: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each of ``rows`` at most ``degree`` of its candidates ``near`` (padded with -1).

    The nearest come first; candidates much nearer to a chosen one than to the row are left out.
    """
    out = np.full((len(rows), degree), -1)
    for part in _chunks(len(rows), near.shape[1] * (x.shape[1] + near.shape[1])):
        found = np.sort(near[part], axis=1)
        twice = np.concatenate((np.zeros((len(found), 1), dtype=bool), found[:, 1:] == found[:, :-1]), axis=1)
        alive = (found >= 0) & ~twice & (found != rows[part, None])
        off = np.where(alive, 1 - np.matmul(x[found], x[rows[part], :, None])[:, :, 0], np.inf)
        order = np.argsort(off, axis=1, kind="stable")
        found, off, alive = (np.take_along_axis(v, order, axis=1) for v in (found, off, alive))
        theirs = x[found]
        apart = alpha * (1 - np.matmul(theirs, theirs.transpose(0, 2, 1)))
        every = np.arange(len(found))
        for turn in range(min(degree, near.shape[1])):
            first = alive.argmax(axis=1)
            some = alive[every, first]
            if not some.any():
                break
            out[part][some, turn] = found[every, first][some]
            alive[every, first] = False
            alive &= ~some[:, None] | (apart[every, first] > off)
    return out


def _grouped(keys: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and for each its first ``most`` values, padded with -1."""
    order = np.argsort(keys, kind="stable")
    names, first, counts = np.unique(keys[order], return_index=True, return_counts=True)
    place = np.arange(len(keys)) - np.repeat(first, counts)
    out = np.full((len(names), min(most, int(counts.max(initial=1)))), -1)
    fits = place < out.shape[1]
    out[np.repeat(np.arange(len(names)), counts)[fits], place[fits]] = values[order][fits]
    return names, out


def build_graph(x: np.ndarray, radius: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> np.ndarray:
    """Neighbours of each row, padded with -1: rows are inserted in batches.

    Each batch searches the graph of those before it, and its rows are candidates of each other; what the rows
    choose is told to the chosen, which choose anew once they have half as many again as ``degree``.
    """
    # Some room, so that not every new neighbour makes a row choose anew.
    graph = np.full((len(x), degree + degree // 2), -1)
    start = _medoid(x)
    order = np.random.default_rng(0).permutation(len(x))
    order = np.concatenate(([start], order[order != start]))
    at = 1
    while at < len(x):
        batch = order[at : at + min(at + 15, BATCH)]
        at += len(batch)
        found, _ = beam_search(x, radius, graph, start, batch, beam)
        mates = x[batch] @ x[batch].T
        np.fill_diagonal(mates, -2.0)
        wide = min(len(batch), MATES)
        found = np.concatenate((found, batch[np.argpartition(-mates, wide - 1, axis=1)[:, :wide]]), axis=1)
        chosen = robust_prune(x, batch, found, degree)
        graph[batch, :degree] = chosen
        told = chosen >= 0
        # A row's own neighbours come first; the nearest of those that chose it after them.
        by = np.repeat(batch, told.sum(axis=1))
        whom = chosen[told]
        nearest = np.argsort(-np.einsum("ij,ij->i", x[by], x[whom]), kind="stable")
        names, new = _grouped(whom[nearest], by[nearest], degree)
        # Rows of a batch may have chosen each other.
        new = np.where((new[:, :, None] == graph[names][:, None, :]).any(axis=2), -1, new)
        theirs = np.concatenate((graph[names], new), axis=1)
        few = (theirs >= 0).sum(axis=1) <= graph.shape[1]
        graph[names[few]] = -np.sort(-theirs[few], axis=1)[:, : graph.shape[1]]
        graph[names[~few]] = -1
        graph[names[~few], :degree] = robust_prune(x, names[~few], theirs[~few], degree)
    return graph


def _medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def search_range(x: np.ndarray, radius: np.ndarray, graph: np.ndarray, angle: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (a below b) whose balls come within ``angle`` of each other, as far as the search of either finds them.

    Rows that find nothing but rows in range search on with twice the beam.
    """
    start, ball = _medoid(x), radius > 0
    pairs = np.zeros(0, dtype=np.int64)
    for asked, wide in ((np.flatnonzero(~ball), beam), (np.flatnonzero(ball), BALL_BEAM)):
        wide = min(wide, len(x))
        while len(asked):
            ids, away = beam_search(x, radius, graph, start, asked, wide, known=True)
            near = (ids >= 0) & (away <= angle + radius[asked, None] + 1e-5)
            rows, cols = np.nonzero(near)
            a, b = asked[rows], ids[rows, cols]
            pairs = np.union1d(pairs, np.minimum(a, b)[a != b] * len(x) + np.maximum(a, b)[a != b])
            asked = asked[near.all(axis=1)] if wide < len(x) else asked[:0]
            wide = min(2 * wide, len(x))
    return pairs // len(x), pairs % len(x)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the first row of its component under the links between ``a`` and ``b``."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _shards(nodes: DataFrame, centres, width: int, overlap: int) -> DataFrame:
    """A row for each node and shard of it; ``shards`` names all of them."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = _unit(_matrix(batch["x"], width)) @ centres.value.T
            top = min(overlap, near.shape[1])
            own = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :top], axis=1)
            batch["shards"] = own.tolist()
            yield batch

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    dealt = nodes.mapInPandas(deal, f"{names}, shards array<int>")
    return dealt.withColumn("shard", F.explode("shards"))


def _blocks(sharded: DataFrame) -> DataFrame:
    """Rows with the block pair that they meet in: ``pair`` is 0 for shards that fit into one task."""
    sizes = sharded.groupBy("shard").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / F.lit(LARGEST // 2)).cast("int")
    sizes = sizes.select("shard", F.when(F.col("size") > LARGEST, blocks).otherwise(F.lit(1)).alias("blocks"))
    # One row of sizes for each centre.
    placed = sharded.join(F.broadcast(sizes), "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A block meets every block, and itself.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return placed.withColumn("pair", low * F.col("blocks") + high).withColumn("key", F.concat_ws(":", "shard", "pair"))


def link_vectors(vectors: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    ``n_links`` counts the other rows at a cosine of ``cosine`` or more,
    ``component_id`` is the smallest vec_id that links lead to, and ``kept`` says
    that it is the row's own. Vectors that are NULL, empty or zero or hold NULL
    or non-finite numbers link with nothing, nor do vectors of unequal length;
    equal vectors and repeated rows link with each other. An
    empty table gives an empty result, and further columns are not read.

    No pair below ``cosine`` is linked; pairs above can be missed. After every
    search a sample of vectors is compared with all rows, and while fewer than nine in ten
    links of an average vector are found, nodes go to twice as many shards, up
    to ``MOST_OVERLAP``; a search that is not good enough even so is an error.
    """
    good = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, v -> coalesce(abs(v) < double('Infinity'), false)) AND exists(embedding, v -> v <> 0)"
    rows = vectors.select("vec_id", "embedding")
    same = rows.filter(good).groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    same = cut_lineage(same.filter("id IS NOT NULL").select("id", "n", F.col("embedding").cast("array<double>").alias("x"), "embedding"), "vectors")
    width, count = same.agg(F.coalesce(F.max(F.size("x")), F.lit(1)), F.count("*")).first()
    found = _search(same, width, count, cosine, overlap)
    while (recall := audit_recall(same, found, width, cosine)) < RECALL:
        if overlap >= MOST_OVERLAP:
            raise RuntimeError(f"a search in {overlap} shards of each node found {recall:.3f} of the audited links; raise SHARD or MOST_OVERLAP")
        free(found)
        overlap = min(2 * overlap, MOST_OVERLAP)
        found = _search(same, width, count, cosine, overlap)
    named = rows.join(same.select("embedding", "id").join(found, "id"), "embedding", "left")
    own = F.coalesce("component", "vec_id")
    return named.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"),
    )


def _search(same: DataFrame, width: int, count: int, cosine: float, overlap: int) -> DataFrame:
    """(id, links, component) for each of the distinct vectors ``same`` (id, n, x)."""
    spark = same.sparkSession
    angle = float(np.arccos(cosine))
    k = int(min(CENTRES, max(1, count // SHARD)))
    sampled = same.select("x").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    sample = _unit(_matrix(sampled["x"], width)) if len(sampled) else np.zeros((0, width))
    fitted = fit_centres(sample, k)
    centres = spark.sparkContext.broadcast(fitted if len(fitted) else np.eye(1, width))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = _unit(_matrix(batch["x"], width)) @ centres.value.T
            own = near.argmax(axis=1)
            turn = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
            # A ball for each centre and vector length; a margin for rounding.
            core = turn <= angle / 2 - 1e-9
            size = batch["x"].map(len).to_numpy()
            batch["ball"] = pd.array([f"{c}:{s}" if y else None for c, s, y in zip(own, size, core, strict=True)], dtype="object")
            batch["turn"] = turn
            yield batch[["id", "n", "x", "ball", "turn"]]

    assigned = cut_lineage(same.select("id", "n", "x").mapInPandas(assign, "id long, n long, x array<double>, ball string, turn double"), "assigned")
    balls = assigned.filter("ball IS NOT NULL").groupBy("ball").agg(F.min("id").alias("node"), F.sum("n").alias("weight"), F.max("turn").alias("radius"))

    def centre_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["ball"].str.split(":", expand=True).astype(int) if len(batch) else None
            batch["x"] = [] if at is None else [centres.value[c][:s].tolist() for c, s in at.to_numpy()]
            batch["dim"] = [] if at is None else at[1]
            yield batch[["id", "weight", "radius", "x", "dim", "ball"]]

    shape = "id long, weight long, radius double, x array<double>, dim int, ball string"
    crowds = balls.withColumnRenamed("node", "id").mapInPandas(centre_of, shape)
    single = assigned.filter("ball IS NULL").select(
        "id", F.col("n").alias("weight"), F.lit(0.0).alias("radius"), "x", F.size("x").alias("dim"), F.lit(None).cast("string").alias("ball")
    )
    nodes = cut_lineage(crowds.unionByName(single), "nodes")
    placed = cut_lineage(_blocks(_shards(nodes, centres, width, overlap)), "placed")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        x, radius, ids = _unit(_matrix(part["x"], width)).astype(np.float32), part["radius"].to_numpy(), part["id"].to_numpy()
        graph = build_graph(x, radius)
        return pd.DataFrame({"id": ids, "near": [ids[row[row >= 0]].tolist() for row in graph]})

    lists = placed.groupBy("key").applyInPandas(build, "id long, near array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    flat = placed.join(united, "id", "left")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("id").sort_values("id").reset_index(drop=True)
        ids, radius, dim = (part[c].to_numpy() for c in ("id", "radius", "dim"))
        x = _unit(_matrix(part["x"], width))
        place = {v: at for at, v in enumerate(ids.tolist())}
        near = [[place[v] for v in row if v in place] for row in part["near"]]
        # Rows that few lists name are told to those in their own, so that a search can reach them.
        named = np.bincount(np.array([v for row in near for v in row], dtype=np.int64), minlength=len(near))
        for at, row in [(at, list(near[at])) for at in np.flatnonzero(named < FEWEST)]:
            for other in row:
                if at not in near[other]:
                    near[other].append(int(at))
        graph = np.full((len(ids), max(1, max(map(len, near)))), -1)
        for at, row in enumerate(near):
            graph[at, : len(row)] = row
        a, b = search_range(x.astype(np.float32), radius, graph, angle)
        shards = part["shards"].map(frozenset)
        block, blocks = part["block"].to_numpy(), int(part["blocks"].iloc[0])
        lonely = blocks > 1 and len(np.unique(block)) > 1
        here = int(part["shard"].iloc[0])
        # Each pair counts where it meets first: in the first shard, and there in the blocks of its two sides.
        ours = np.array([min(shards[i] & shards[j]) == here and not (lonely and block[i] == block[j]) for i, j in zip(a, b, strict=True)], dtype=bool)
        a, b = a[ours], b[ours]
        a, b = a[dim[a] == dim[b]], b[dim[a] == dim[b]]
        value = np.einsum("ij,ij->i", x[a], x[b])
        turn = np.arccos(np.clip(value, -1, 1))
        both = radius[a] + radius[b]
        crowd = part["ball"].notna().to_numpy()
        plain = ~crowd[a] & ~crowd[b]
        sure = np.where(plain, value >= cosine, turn + both <= angle - 1e-9)
        maybe = ~plain & ~sure & (turn - both <= angle + 1e-9)
        weight = part["weight"].to_numpy()
        links = np.zeros(len(ids), dtype=np.int64)
        np.add.at(links, a[sure], weight[b[sure]])
        np.add.at(links, b[sure], weight[a[sure]])
        counted = pd.DataFrame({"id": ids, "links": links, "other": ids[_roots(len(ids), a[sure], b[sure])], "open": False})
        open_ = pd.DataFrame({"id": ids[a[maybe]], "links": 0, "other": ids[b[maybe]], "open": True})
        return pd.concat([counted[links > 0], open_], ignore_index=True)

    linked = cut_lineage(flat.groupBy("key").applyInPandas(search, "id long, links long, other long, open boolean"), "linked")
    # Pairs with a ball that is neither wholly in reach nor wholly out of it: member by member.
    member = assigned.join(balls.select("ball", "node"), "ball", "left").select("id", "n", "x", F.coalesce("node", "id").alias("node"))
    left = member.select(F.col("node").alias("left_node"), F.col("id").alias("a"), F.col("n").alias("an"), F.col("x").alias("ax"))
    right = member.select(F.col("node").alias("right_node"), F.col("id").alias("b"), F.col("n").alias("bn"), F.col("x").alias("bx"))
    border = linked.filter("open").select(F.col("id").alias("left_node"), F.col("other").alias("right_node"))
    met = border.join(left, "left_node").join(right, "right_node").select("a", "an", "ax", "b", "bn", "bx")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                value = np.einsum("ij,ij->i", _unit(_matrix(batch["ax"], width)), _unit(_matrix(batch["bx"], width)))
                batch = batch[value >= cosine]
            yield batch[["a", "an", "b", "bn"]]

    borderline = cut_lineage(met.mapInPandas(verify, "a long, an long, b long, bn long"), "borderline")
    more = borderline.select(F.col("a").alias("id"), F.col("bn").alias("more")).unionByName(borderline.select(F.col("b").alias("id"), F.col("an").alias("more")))
    more = more.groupBy("id").agg(F.sum("more").alias("more"))
    by_node = linked.filter("NOT open").groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "node")
    sizes = balls.select("node", "weight", F.col("ball").isNotNull().alias("crowd"))
    edges = (
        linked.filter("NOT open").select(F.col("id").alias("a"), F.col("other").alias("b"))
        .unionByName(borderline.select("a", "b"))
        .unionByName(member.select(F.col("id").alias("a"), F.col("node").alias("b")))
    )
    components = connected_components(edges).withColumnRenamed("node", "id")
    counted = (
        member.select("id", "n", "node").join(by_node, "node", "left").join(sizes, "node", "left").join(more, "id", "left").join(components, "id", "left")
    )
    links = F.coalesce("weight", "n") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0))
    return cut_lineage(counted.select("id", links.alias("links"), F.coalesce("component", "id").alias("component")), "found")


def audit_recall(same: DataFrame, found: DataFrame, width: int, cosine: float = COSINE, audited: int = AUDITED) -> float:
    """Share of a vector's links that ``found`` counts, averaged over those with links among ``audited`` vectors, those of the smallest hashes.

    Each vector weighs the same, so that the links of a crowd cannot hide those
    that small groups lost; 1 if no audited vector has links.
    """
    asked = same.select("id", "n", "x").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(audited).toPandas()
    if not len(asked):
        return 1.0
    queries = same.sparkSession.sparkContext.broadcast((_unit(_matrix(asked["x"], width)), asked["x"].map(len).to_numpy()))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, size = queries.value
        for batch in batches:
            if len(batch):
                linked = (_unit(_matrix(batch["x"], width)) @ x.T >= cosine) & (batch["x"].map(len).to_numpy()[:, None] == size)
                yield pd.DataFrame({"at": np.arange(len(x)), "n": batch["n"].to_numpy() @ linked})

    true = same.select("n", "x").mapInPandas(compare, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    true = true.set_index("at")["n"].reindex(range(len(asked))).to_numpy() - 1
    told = found.join(F.broadcast(same.sparkSession.createDataFrame(asked[["id"]])), "id").toPandas().set_index("id")["links"]
    told = told.reindex(asked["id"]).fillna(0).to_numpy()
    linked = true > 0
    return float((np.minimum(told, true)[linked] / true[linked]).mean()) if linked.any() else 1.0

"""Problem 4: the most similar vectors of every vector, by robust-pruned directed graphs.

The vectors are dealt into overlapping cells of bounded size: a vector belongs to the cell of its nearest centre and to
those of all centres nearly as near, so that vectors close to each other share a cell wherever the borders run.  Each
cell is one graph, built in one task: greedy searches propose neighbours of a point, and pruning keeps of them the
nearest and those no kept one is much nearer to, so that edges stay diverse.  Every vector is then searched for by beam
in the graph of each cell it belongs to, from its own place there, and keeps the best it found in any.  So a vector is
shipped once per cell, and neither graphs nor queries travel.  Copies of a vector are indexed and searched once and
expanded at the end.  All graph work runs on many points at a time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

#: Vectors a cell should have, and the most it has before it is split again; the latter bounds a task's memory.
CELL_VECTORS = 2048
MOST_VECTORS = 8192
#: A vector belongs to the cells whose centres are within this factor of its distance to the nearest, at most so many.
CLOSE = 1.15
MOST_CELLS = 8
#: What this comes to, about; used to choose the number of centres.
COPIES = 2.5
#: Vectors in the sample the centres of a cell are fitted on, and centres fitted in one cell.
SAMPLE_VECTORS = 16_384
LEAST_CENTRES, MOST_CENTRES = 4, 1024
#: Cells split in one pass, and centres fitted in it, which is what the driver and the tasks hold (17 MB at 64 numbers).
SPLIT_CELLS, PASS_CENTRES = 16_384, 65_536
MOST_PASSES = 12
#: Edges of a point, and the beam of a search while a point is inserted, while its edges are refined, and at the end.
DEGREE = 16
BUILD_BEAM = 24
REFINE_BEAM = 32
SEARCH_BEAM = 24
#: The relaxation of the pruning rule.
ALPHA = 1.2
#: Points a search starts from (the best few of them), and the least number of edges that lead to a point.
ENTRIES = 256
STARTS = 8
LEAST_IN_EDGES = 3
#: Points the graph starts with, points inserted at once (they see the graph of all before them), and points searched at once.
FIRST_POINTS = 512
INSERT_BATCH = 2048
SEARCH_BATCH = 512
#: An empty place of a beam, below every similarity.
NOTHING = -2.0
#: Points pruned at once, so that what this takes stays in the processor's cache.
PRUNE_BATCH = 128


def usable(vector: str | Column, dimensions: int) -> Column:
    """Whether a vector has exactly ``dimensions`` finite numbers, not all zero."""
    column = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast("float"))
    )
    return F.coalesce((F.size(column) == dimensions) & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def _packed(similar: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Similarities in single precision as numbers in double precision whose idle last bits hold a point and whether it is open.

    So beams can be sorted and cut as plain numbers.  A point's number must be below 2^27.
    """
    keys = similar.astype(np.float64)
    bits = keys.view(np.int64)
    bits |= points.astype(np.int64) << 1
    return keys


def _numbers(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.int64) & (1 << 28) - 1) >> 1


def beam_search(
    vectors: np.ndarray,
    edges: np.ndarray,
    entry: np.ndarray,
    queries: np.ndarray,
    beam: int,
    expand: int = 4,
    own: np.ndarray | None = None,
    room: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities, best first, of the ``beam`` best points each query's search saw; -1 where it saw fewer.

    All queries advance together.  In each round every query opens its ``expand`` best unopened points of the beam and
    merges their unseen neighbours into it; a query is done when its whole beam is open.  A query that is itself a
    point of the graph (``own`` is its number, else -1) starts from there, too.

    One matrix product gives the similarities that the search looks up, since in a cell it costs less than fetching the
    vectors of the points seen.  What was in a beam is blotted out there; what failed to enter one can't enter it later.
    ``room`` is memory for them that several searches can use in turn, a row per query and a column more than points.
    """
    n, stride = len(queries), len(vectors) + 1
    near = np.empty((n, stride), np.float32) if room is None else room[:n]
    np.matmul(queries, vectors.T, out=near[:, :-1])
    near[:, -1] = -np.inf  # no neighbour, -1, leads to one of these
    looked_up, edges = near.reshape(-1), edges.astype(np.intp)
    best = np.full((n, beam), NOTHING)
    width = min(len(entry), beam, STARTS)
    best[:, :width] = np.partition(_packed(near[:, entry], entry), len(entry) - width, axis=1)[:, len(entry) - width :]
    if own is not None and width < beam:
        inside = np.flatnonzero((own >= 0) & ~(_numbers(best[:, :width]) == own[:, None]).any(1))
        best[inside, width] = _packed(near[inside, own[inside]], own[inside])
        near[inside, own[inside]] = -np.inf
    near[:, entry] = -np.inf
    active, beams = np.arange(n), best.copy()
    while len(active):
        waiting = np.where(beams.view(np.int64) & 1, NOTHING, beams)
        pick = np.partition(waiting, -min(expand, beam), axis=1)[:, -min(expand, beam) :]
        go = pick.max(1) > NOTHING
        if not go.all():
            best[active[~go]] = beams[~go]
            active, beams, waiting, pick = (x[go] for x in (active, beams, waiting, pick))
            if not len(active):
                break
        beams.view(np.int64)[(waiting >= pick.min(1)[:, None]) & (waiting > NOTHING)] |= 1
        found = edges[_numbers(pick)]
        found[pick == NOTHING] = -1
        found = found.reshape(len(active), -1)
        found += (active * stride)[:, None]
        similar = looked_up.take(found)
        new = np.flatnonzero(similar > beams.min(1)[:, None])  # only what beats the worst of the beam can enter it
        place, number = found.ravel()[new], np.arange(len(new), dtype=np.float32)
        looked_up[place] = number  # of a point that several edges lead to, the last stays
        last = np.flatnonzero(looked_up[place] == number)
        looked_up[place] = -np.inf
        new, place = new[last], place[last]
        row, similar = new // found.shape[1], similar.ravel()[new]
        # Lay the new points of each query side by side and merge them with its beam.
        count = np.bincount(row, minlength=len(active))
        some = np.flatnonzero(count)
        if not len(some):
            continue
        slot = np.arange(len(row)) - np.repeat(np.cumsum(count)[some] - count[some], count[some])
        at = np.repeat(np.arange(len(some)), count[some])
        more = int(count.max())
        merged = np.full((len(some), beam + more), NOTHING)
        merged[:, :beam] = beams[some]
        merged[at, beam + slot] = _packed(similar, place - active[row] * stride)
        beams[some] = np.partition(merged, more, axis=1)[:, more:]
    best = np.sort(best, axis=1)[:, ::-1]
    there = best > NOTHING
    return np.where(there, _numbers(best), -1).astype(np.int32), np.where(there, best, -np.inf).astype(np.float32)


def robust_prune(
    vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float
) -> np.ndarray:
    """Out-edges of each point: its nearest candidate again and again, less those an edge already covers.

    A candidate is covered if ``alpha`` times its distance to a kept neighbour is within its distance to the point, so
    that a larger ``alpha`` keeps more long edges.  Candidates are ids, -1 for none.
    """
    if len(points) > PRUNE_BATCH:
        parts = range(0, len(points), PRUNE_BATCH)
        cut = lambda x, at: x[at : at + PRUNE_BATCH]
        return np.concatenate([robust_prune(vectors, cut(points, at), cut(candidates, at), degree, alpha) for at in parts])
    every = np.sort(np.where(candidates == points[:, None], -1, candidates), axis=1)
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
    every = np.sort(every, axis=1)[:, ::-1]  # each once, those there are to the left
    edges = np.full((len(points), degree), -1, np.int32)
    by_number = np.argsort((every >= 0).sum(1), kind="stable")
    for at in range(0, len(points), PRUNE_BATCH):
        some = by_number[at : at + PRUNE_BATCH]
        width = int((every[some[-1]] >= 0).sum())
        near, rows = every[some, :width], np.arange(len(some))
        both = vectors[np.concatenate([points[some, None], near], 1)]
        similar = both @ both.transpose(0, 2, 1)
        between, distance = similar[:, 1:, 1:], 1 - similar[:, 0, 1:]
        left = np.where(near < 0, np.float32(np.inf), distance)
        for slot in range(degree if width else 0):
            best = left.argmin(1)
            there = left[rows, best] < np.inf
            if not there.any():
                break
            edges[some[there], slot] = near[rows[there], best[there]]
            left[alpha * (1 - between[rows, best]) <= distance] = np.inf
            left[rows, best] = np.inf
    return edges


def build_graph(vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, seed: int = 7):
    """Out-edges of every point (-1 for none) and the entry points of a robust-pruned graph over unit vectors.

    A point has ``degree`` edges of its own and room for as many that lead back to points which chose it; when the room
    is full, all of them are pruned to ``degree``.
    """
    n = len(vectors)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    centre = int(np.argmax(vectors @ vectors.mean(0)))
    entry = np.unique(np.concatenate([[centre], order[: ENTRIES - 1]])).astype(np.int32)
    edges = np.full((n, 2 * degree), -1, np.int32)
    first = order[: min(n, FIRST_POINTS)]
    near = vectors[first] @ vectors[first].T
    width = min(len(first), 2 * degree)
    nearest = np.argpartition(-near, width - 1, axis=1)[:, :width]
    edges[first, :degree] = robust_prune(vectors, first, first[nearest], degree, alpha)
    at = len(first)
    while at < n:
        batch = order[at : at + min(INSERT_BATCH, at)]
        at += len(batch)
        edges[batch, :degree] = robust_prune(vectors, batch, _seen(vectors, edges, entry, batch, BUILD_BEAM), degree, alpha)
        add_back_edges(vectors, edges, batch, degree, alpha)
    # A second round lets early points see late ones, each from its own place.
    for at in range(0, n, INSERT_BATCH):
        batch = order[at : at + INSERT_BATCH]
        found = np.concatenate([_seen(vectors, edges, entry, batch, REFINE_BEAM, batch), edges[batch]], 1)
        edges[batch, :degree] = robust_prune(vectors, batch, found, degree, alpha)
        edges[batch, degree:] = -1
        add_back_edges(vectors, edges, batch, degree, alpha)
    # A point that no edge leads to would never be found: its nearest neighbours get one edge more.
    lonely = np.flatnonzero(np.bincount(edges[edges >= 0], minlength=n) < LEAST_IN_EDGES).astype(np.int32)
    if len(lonely) and n > 1:
        extra = np.full((n, LEAST_IN_EDGES), -1, np.int32)
        for point, near in zip(lonely, _seen(vectors, edges, entry, lonely, BUILD_BEAM, lonely), strict=True):
            for other in near[(near >= 0) & (near != point)][: 2 * LEAST_IN_EDGES]:
                free = np.flatnonzero(extra[other] < 0)
                if len(free):
                    extra[other, free[0]] = point
        edges = np.concatenate([edges, extra], 1)
    return edges, entry


def _seen(vectors: np.ndarray, edges: np.ndarray, entry: np.ndarray, of: np.ndarray, beam: int, own: np.ndarray | None = None) -> np.ndarray:
    """What the searches for the points ``of`` saw, a few hundred at a time."""
    parts = range(0, len(of), SEARCH_BATCH)
    cut = lambda x, at: None if x is None else x[at : at + SEARCH_BATCH]
    room = np.empty((min(len(of), SEARCH_BATCH), len(vectors) + 1), np.float32)
    return np.concatenate([beam_search(vectors, edges, entry, vectors[cut(of, at)], beam, own=cut(own, at), room=room)[0] for at in parts])


def add_back_edges(vectors: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Make every new edge lead back, pruning the points that then have too many."""
    to = edges[batch, :degree].ravel()
    source = np.repeat(batch, degree)
    source, to = source[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    source, to = source[order], to[order]
    points, start, count = np.unique(to, return_index=True, return_counts=True)
    # Edges are kept to the left, so the first free slot follows from their number.
    edges[points] = np.take_along_axis(edges[points], np.argsort(edges[points] < 0, axis=1, kind="stable"), 1)
    used = (edges[points] >= 0).sum(1)
    slot = np.arange(len(to)) - np.repeat(start - used, count)
    fits = slot < edges.shape[1]
    edges[to[fits], slot[fits]] = source[fits]
    full = used + count > edges.shape[1]
    rest = [[] for _ in range(int(full.sum()))]
    if not rest:
        return
    number = np.full(len(points), -1)
    number[full] = np.arange(len(rest))
    for who, point in zip(number[np.repeat(np.arange(len(points)), count)[~fits]], source[~fits], strict=True):
        rest[who].append(point)
    width = min(max(map(len, rest)), 4 * degree)
    fresh = np.array([(x + [-1] * width)[:width] for x in rest], np.int32)
    crowded = points[full].astype(np.int32)
    for at in range(0, len(crowded), 1024):
        some = crowded[at : at + 1024]
        pruned = robust_prune(
            vectors, some, np.concatenate([edges[some], fresh[at : at + 1024]], 1), degree, alpha
        )
        edges[some, :degree] = pruned
        edges[some, degree:] = -1


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres of a spherical k-means over the sample; a cell left empty takes the worst-served vector."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        similar = sample @ centres.T
        nearest = similar.argmax(1)
        for cell in range(len(centres)):
            own = sample[nearest == cell]
            centre = own.sum(0) if len(own) else sample[similar.max(1).argmin()]
            centres[cell] = centre / max(float(np.linalg.norm(centre)), 1e-12)
    return centres.astype(np.float32)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)


def _unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            vectors = np.stack(batch["vector"].to_numpy()).astype(np.float64)
            vectors /= np.abs(vectors).max(1, keepdims=True)  # keeps the squares of huge and tiny values finite
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.DataFrame({"id": batch["id"], "unit": [v.tobytes() for v in vectors.astype(np.float32)]})


def close_cells(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per vector the numbers of the centres nearest to it, the first and others within CLOSE of its distance, and the distances.

    At most MOST_CELLS, and at most half of all, so that cells get smaller; -1 and infinity where there are fewer.
    """
    similar = units @ centres.T
    width = max(1, min(MOST_CELLS, len(centres) // 2))
    near = np.argpartition(-similar, width - 1, axis=1)[:, :width]
    order = np.take_along_axis(near, np.argsort(-np.take_along_axis(similar, near, 1), axis=1, kind="stable"), 1)
    distance = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(similar, order, 1), 0))
    keep = distance <= CLOSE * distance[:, :1]
    return np.where(keep, order, -1).astype(np.int32), np.where(keep, distance, np.inf)


def finer_cells(units: np.ndarray, cells: list[np.ndarray], centres: dict[int, np.ndarray]) -> list[list[tuple[int, int]]]:
    """Per vector its ``cells``, each that has ``centres`` replaced by the close ones of its parts: pairs of cell and part, -1 if whole.

    Closeness is to the nearest part of any of the vector's cells, so that splitting again and again doesn't multiply
    the cells a vector belongs to: there are at most MOST_CELLS.
    """
    every = np.concatenate(cells) if len(cells) else np.empty(0, np.int64)
    of = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    result: list[list[tuple[int, int]]] = [[] for _ in cells]
    parts: list[tuple[np.ndarray, ...]] = []
    by_cell = np.argsort(every, kind="stable")
    for rows in np.split(by_cell, np.flatnonzero(np.diff(every[by_cell])) + 1) if len(every) else []:
        cell = int(every[rows[0]])
        if cell in centres:
            part, distance = close_cells(units[of[rows]], centres[cell])
            r, c = np.nonzero(part >= 0)
            parts.append((of[rows][r], np.full(len(r), cell), part[r, c], distance[r, c]))
        else:
            for row in of[rows]:
                result[row].append((cell, -1))
    if parts:
        row, cell, part, distance = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((part, cell, distance, row))
        row, cell, part, distance = row[order], cell[order], part[order], distance[order]
        nearest = distance[np.searchsorted(row, row)]
        for r, c, p in zip(*(x[distance <= CLOSE * nearest].tolist() for x in (row, cell, part)), strict=True):
            if len(result[r]) < MOST_CELLS:
                result[r].append((c, p))
    return result


def _split(members: DataFrame, dimensions: int, most: int, cell_vectors: int) -> DataFrame | None:
    """``members`` (id, unit, cells) with the cells of more than ``most`` of them split; None if there is no such cell.

    The largest cells are split first; the others in the next pass.
    """
    hot = (
        members.select(F.explode("cells").alias("cell"))
        .groupBy("cell").count().where(F.col("count") > most).orderBy(F.desc("count")).limit(SPLIT_CELLS).collect()
    )
    if not hot:
        return None
    parts = {r["cell"]: min(MOST_CENTRES, max(LEAST_CENTRES, round(r["count"] * COPIES / cell_vectors))) for r in hot}
    parts = {cell: min(n, PASS_CENTRES // len(parts)) for cell, n in parts.items()}
    sizes = {r["cell"]: r["count"] for r in hot}

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.explode("cells", ignore_index=True).rename(columns={"cells": "cell"}).astype({"cell": "int64"})
            share = batch["cell"].map(sizes)
            yield batch[share.notna() & (batch["lot"] < SAMPLE_VECTORS / share)].drop(columns="lot")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        centres = fit_centres(_matrix(rows.sort_values("id")["unit"]), parts[key[0]])
        return pd.DataFrame({"cell": [key[0]], "centres": [centres.tobytes()]})

    lot = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) / (1 << 20)
    fitted = (
        members.select("id", "unit", "cells", lot.alias("lot"))
        .mapInPandas(sample, "id long, unit binary, cell long")
        .groupBy("cell")
        .applyInPandas(fit, "cell long, centres binary")
        .collect()
    )
    centres = {r["cell"]: np.frombuffer(r["centres"], np.float32).reshape(-1, dimensions) for r in fitted}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            finer = finer_cells(_matrix(batch["unit"]), list(batch["cells"]), centres) if len(batch) else []
            yield batch.drop(columns="cells").assign(parts=[[{"cell": c, "part": p} for c, p in x] for x in finer])

    finer = members.mapInPandas(assign, "id long, unit binary, parts array<struct<cell:bigint,part:int>>")
    cell = lambda x: F.when(x["part"] < 0, x["cell"]).otherwise(F.xxhash64(x["cell"], x["part"]))
    return finer.select("id", "unit", F.transform("parts", cell).alias("cells"))


def cells_of(distinct: DataFrame, dimensions: int, most: int, cell_vectors: int) -> DataFrame:
    """``id, unit, cell`` for every cell that a vector of ``distinct`` (id, unit) belongs to, none of more than ``most``.

    Each pass splits every cell that is too large into LEAST_CENTRES or more, so a few passes do for any table.
    """
    members = distinct.select("id", "unit", F.array(F.lit(0).cast("long")).alias("cells"))
    for _ in range(MOST_PASSES):
        finer = _split(members, dimensions, most, cell_vectors)
        if finer is None:
            break
        members = cut_lineage(finer)  # counted, sampled and split again
    return members.select("id", "unit", F.explode("cells").alias("cell"))


def _search_cell(k: int):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = rows["id"].to_numpy(np.int64), _matrix(rows["unit"])
        order = np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        edges, entry = build_graph(vectors)
        every = np.arange(len(ids), dtype=np.int32)
        near = _seen(vectors, edges, entry, every, max(SEARCH_BEAM, k + 1), every)
        near = np.where(near == every[:, None], -1, near)[:, : k + 1]  # one of them may be the vector itself
        exact = np.einsum("qd,qkd->qk", vectors.astype(np.float64), vectors[near].astype(np.float64))
        good = near >= 0
        return pd.DataFrame(
            {
                "id": ids,
                "found": [ids[n[g]] for n, g in zip(near, good, strict=True)],
                "minus": [-x[g] for x, g in zip(exact, good, strict=True)],
            }
        )

    return search


def nearest(
    table: DataFrame,
    id_column: str = "chunk_ord",
    vector_column: str = "embedding",
    k: int = 5,
    dimensions: int = 64,
    cell_vectors: int = CELL_VECTORS,
    most_vectors: int = MOST_VECTORS,
) -> DataFrame:
    """For every usable vector the ``k`` other ids most similar by cosine: ``id, rank, neighbour, similarity``.

    Usable vectors have ``dimensions`` finite numbers, not all zero; rows with others, or without an id, are left out.
    Rows repeating an id count once.  Equal similarities go by id; vectors equal to six digits after scaling to
    length one are copies of each other.  Fewer than k + 1 usable vectors give all pairs; none give no rows.
    Approximate: a neighbour can be missed, none is invented, and similarities are exact.
    """
    spark = table.sparkSession
    vectors = (
        table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
        .where(F.col("id").isNotNull() & usable("vector", dimensions))
        .dropDuplicates(["id"])
        .mapInPandas(_unit, "id long, unit binary")
    )

    # Copies: the k + 1 lowest ids of each distinct vector are all that its neighbours' lists can need.
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rounded = np.round(_matrix(batch["unit"]) * 1e6).astype(np.int32) if len(batch) else []
            yield batch.assign(key=[r.tobytes() for r in rounded])

    keyed = vectors.mapInPandas(keys, "id long, unit binary, key binary").select(
        "id", "unit", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2")
    )
    keyed = cut_lineage(keyed)
    lowest = Window.partitionBy("h1", "h2").orderBy("id")
    copies = (
        keyed.withColumn("nth", F.row_number().over(lowest))
        .where(F.col("nth") <= k + 1)
        .groupBy("h1", "h2")
        .agg(
            F.sort_array(F.collect_list("id")).alias("members"),
            F.min_by("unit", "nth").alias("unit"),
            F.min("id").alias("id"),
        )
    )
    distinct = cut_lineage(copies)
    hits = cells_of(distinct, dimensions, most_vectors, cell_vectors).groupBy("cell").applyInPandas(
        lambda rows: _search_cell(k)(rows), "id long, found array<long>, minus array<double>"
    )
    # The best of what a vector found in all its cells; what it found in several counts once.
    of_cell = F.collect_list(F.arrays_zip("minus", "found"))
    top = (
        hits.groupBy("id")
        .agg(F.slice(F.sort_array(F.array_distinct(F.flatten(of_cell))), 1, k).alias("best"))
        .select("id", F.explode("best").alias("hit"))
        .select("id", F.col("hit.found").alias("found"), (-F.col("hit.minus")).alias("similarity"))
    )
    # Back from distinct vectors to ids: the copies of a vector first, then the members of its neighbours.
    members = distinct.select(F.col("id").alias("found"), F.col("members").alias("other"))
    lists = (
        top.join(members, "found")
        .groupBy("id")
        .agg(
            F.flatten(
                F.collect_list(
                    F.transform("other", lambda m: F.struct((-F.col("similarity")).alias("minus"), m.alias("neighbour")))
                )
            ).alias("near")
        )
    )
    same = F.transform("members", lambda m: F.struct(F.lit(-1.0).alias("minus"), m.alias("neighbour")))
    answers = distinct.join(lists, "id", "left").select(
        "h1", "h2", F.sort_array(F.concat(same, F.coalesce("near", F.array().cast("array<struct<minus:double,neighbour:bigint>>")))).alias("near")
    )
    others = lambda me: F.slice(F.filter("near", lambda x: x["neighbour"] != me), 1, k)
    return (
        keyed.select("id", "h1", "h2")
        .join(answers, ["h1", "h2"])
        .select("id", F.posexplode(others(F.col("id"))).alias("rank", "hit"))
        .select(
            "id",
            (F.col("rank") + 1).alias("rank"),
            F.col("hit.neighbour").alias("neighbour"),
            F.least(F.lit(1.0), -F.col("hit.minus")).alias("similarity"),
        )
    )


def similar_pairs(neighbours: DataFrame, least: float = 0.9) -> DataFrame:
    """Unordered pairs of at least this similarity in which one is among the nearest of the other, each once."""
    return (
        neighbours.where(F.col("similarity") >= least)
        .select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"))
        .distinct()
    )

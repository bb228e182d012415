"""Approximate nearest neighbours: a navigable small-world graph with layers for each shard.

Equal vectors are one vertex, so that thousands of copies can't cut the graph
off; their smallest ids are kept beside it. Distinct vectors are dealt over cells
by their nearest centre (centres are fitted on a bounded sample; every vector is
indexed), and cells over shards of bounded size by hash. A shard's graph is a
stack of layers; each layer is a flat array of neighbour places, filled with -1,
built from the top down in batches. Shards are landed as rows of binary arrays.

A query visits the shards of its nearest cells, and the shards' nearest are merged.
How many cells is measured on the sample, against brute force there: the fewest that
hold ``HELD`` of the true neighbours. Vectors that lie in clusters need few cells at
any size; those without structure need most, as nothing less would find them. A
shard is sent to one task, unless its queries fill several blocks. Cells grow in
number with the vectors up to ``SAMPLE / PER_CENTRE``; beyond that each takes more shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellurion.llm.common import bounded, land, run_dir, table

#: Neighbours a vertex has above and in the lowest layer; candidates kept while building and searching.
DEGREE, DEGREE_0, BUILD, SEARCH = 16, 32, 80, 160
#: Distinct vectors in a shard: at least, and, where there are more than ``SHARDS`` such shards, at most.
SHARD, SHARD_MOST, SHARDS = 8192, 65536, 1024
#: Queries in a block, about.
BLOCK = 8192
#: Share of true neighbours that the visited cells must hold, measured for so many vectors of the sample.
HELD, MEASURED = 0.97, 500
#: Vectors that centres are fitted on at most, in number and bytes, how many for each centre, and rounds of fitting.
SAMPLE, SAMPLE_BYTES, PER_CENTRE, ROUNDS = 50_000, 32 << 20, 20, 8
AT_ONCE, BATCH = 4, 256


def squared(x: np.ndarray, places: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its row of places; infinite at -1."""
    d = x[places] - q[:, None, :]
    out = np.einsum("bmd,bmd->bm", d, d)
    out[places < 0] = np.inf
    return out


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query, the ``width`` nearest places found from its entries, and their squared distances."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x) + 1), bool)  # the last column stands for -1
    seen[:, -1] = True
    seen[rows, entry] = True
    seen[:, -1] = True
    place = np.full((n, width), -1)
    place[:, : entry.shape[1]] = entry[:, :width]
    dist = squared(x, place, q)
    done = np.zeros((n, width), bool)
    active = np.arange(n)
    while len(active):
        open_ = np.where(done[active], np.inf, dist[active])
        k = min(AT_ONCE, width)
        best = np.argpartition(open_, k - 1, axis=1)[:, :k]
        there = np.isfinite(np.take_along_axis(open_, best, 1))
        more = there.any(axis=1)
        active, best, there = active[more], best[more], there[more]
        if not len(active):
            break
        a = active[:, None]
        done[a, best] |= there
        from_ = np.where(there, place[a, best], -1)
        new = np.where((from_ >= 0)[:, :, None], links[from_], -1).reshape(len(active), -1)
        # A place may come from two of the vertices opened at once.
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[a, new]] = -1
        seen[a, new] = True
        d = squared(x, new, q[active])
        all_d = np.concatenate([dist[active], d], axis=1)
        keep = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        place[active] = np.take_along_axis(np.concatenate([place[active], new], axis=1), keep, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(new.shape, bool)], axis=1), keep, 1)
        dist[active] = np.take_along_axis(all_d, keep, 1)
        place[active] = np.where(np.isfinite(dist[active]), place[active], -1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(place, order, 1), np.take_along_axis(dist, order, 1)


def diverse(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates, those nearer to the vertex than to any chosen before; then the nearest of the rest."""
    out = np.full((len(own), degree), -1)
    for lo in range(0, len(own), BATCH):
        c = cand[lo : lo + BATCH]
        d = squared(x, c, x[own[lo : lo + BATCH]])
        order = np.argsort(d, axis=1, kind="stable")[:, : 3 * degree]
        c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        v = x[c]
        norm = np.einsum("bcd,bcd->bc", v, v)
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.einsum("bid,bjd->bij", v, v, optimize=True)
        kept = np.zeros(c.shape, bool)
        for i in range(c.shape[1]):
            near = (kept[:, :i] & (between[:, i, :i] < d[:, i : i + 1])).any(axis=1)
            kept[:, i] = np.isfinite(d[:, i]) & ~near & (kept.sum(axis=1) < degree)
        rank = np.argsort(np.where(kept, 0, np.where(np.isfinite(d), 1, 2)), axis=1, kind="stable")[:, :degree]
        c, d = np.take_along_axis(c, rank, 1), np.take_along_axis(d, rank, 1)
        out[lo : lo + BATCH, : c.shape[1]] = np.where(np.isfinite(d), c, -1)
    return out


def build(x: np.ndarray, seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top down: the places in the layer, and links (place x degree, -1 where none)."""
    n = len(x)
    level = np.floor(-np.log(1 - np.random.Generator(np.random.PCG64(seed)).random(n)) / math.log(DEGREE)).astype(int)
    level[0] = max(level.max(), 0)
    by_level = np.argsort(-level, kind="stable")
    by_level = np.concatenate([[0], by_level[by_level != 0]])
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(level[0], -1, -1):
        own = by_level[: int((level >= at).sum())]
        degree = DEGREE_0 if at == 0 else DEGREE
        links = np.full((n + 1, degree), -1)  # the last row stands for -1
        done = 1
        while done < len(own):
            new = own[done : done + min(BATCH, max(1, done))]
            q = x[new]
            near, _ = beam(x, links, q, descend(x, layers, q, own[0]), BUILD)
            # The batch's own vectors are each other's candidates too.
            gram = np.einsum("id,id->i", q, q)
            mutual = gram[:, None] + gram[None] - 2 * q @ q.T
            np.fill_diagonal(mutual, np.inf)
            k = min(degree, len(new) - 1)
            if k > 0:
                near = np.concatenate([near, new[np.argpartition(mutual, k - 1, axis=1)[:, :k]]], axis=1)
            near[near == new[:, None]] = -1
            chosen = diverse(x, new, near, degree)
            links[new] = chosen
            back(x, links, new, chosen, degree)
            done += len(new)
        layers.append((own, links[:n]))
        layers[-1] = (own, np.concatenate([links[:n], np.full((1, degree), -1)]))
    return layers


def back(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray, degree: int) -> None:
    """Link the chosen back to the new, and cut those with too many."""
    src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    known = (links[dst] == src[:, None]).any(axis=1)
    src, dst = src[~known], dst[~known]
    if not len(dst):
        return
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    at, first, count = np.unique(dst, return_index=True, return_counts=True)
    extra = np.full((len(at), int(count.max())), -1)
    extra[np.repeat(np.arange(len(at)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
    links[at] = diverse(x, at, np.concatenate([links[at], extra], axis=1), degree)


def descend(x: np.ndarray, layers: list, q: np.ndarray, top: int) -> np.ndarray:
    """Entries for the next layer: the nearest few of the layers above."""
    entry = np.full((len(q), 1), top)
    for _, links in layers:
        entry = beam(x, links, q, entry, 8)[0]
    return entry


def scaled(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors in single precision, which graphs are built and walked in, and what they were divided by."""
    by = float(np.abs(x).max()) or 1.0
    return (x / by).astype(np.float32), by


def search(x: np.ndarray, layers: list, q: np.ndarray, k: int, width: int = SEARCH) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest found; what the walk keeps is measured again in double precision."""
    place, dist = [], []
    near, by = scaled(x)
    for lo in range(0, len(q), BATCH):
        own = q[lo : lo + BATCH]
        walk = np.clip(own / by, -1e18, 1e18).astype(np.float32)
        p, _ = beam(near, layers[-1][1], walk, descend(near, layers[:-1], walk, 0), max(width, k))
        with np.errstate(over="ignore"):
            d = squared(x, p, own)
        order = np.lexsort((p, d), axis=1)[:, :k]
        place.append(np.take_along_axis(p, order, 1))
        dist.append(np.sqrt(np.take_along_axis(d, order, 1)))
    return np.concatenate(place), np.concatenate(dist)


def fit_centres(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """k centres by a few rounds of Lloyd's algorithm from a fixed choice of rows."""
    x, _ = scaled(x)
    c = x[np.random.Generator(np.random.PCG64(seed)).choice(len(x), k, replace=False)]
    for _ in range(ROUNDS if k > 1 else 0):
        own = nearest_centres(x, c, 1)[:, 0]
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def nearest_centres(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Numbers of each row's k nearest centres, in blocks."""
    norm, out = np.einsum("id,id->i", c, c), []
    for lo in range(0, len(x), 1024):
        d = norm[None] - 2 * (x[lo : lo + 1024] @ c.T)
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(d), 1)))
    return np.concatenate(out) if out else np.zeros((0, k), int)


def probes_needed(x: np.ndarray, c: np.ndarray, k: int = 10, held: float = HELD) -> int:
    """The fewest nearest cells of a row that hold so many of its k nearest rows, over the first rows of a sample."""
    if len(c) == 1 or len(x) < 2:
        return len(c)
    own = nearest_centres(x, c, 1)[:, 0]
    q = x[:MEASURED]
    norm, needed = np.einsum("id,id->i", x, x), []
    for lo in range(0, len(q), 64):
        d = norm[None] - 2 * (q[lo : lo + 64] @ x.T)
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        near = own[np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]]
        order = np.argsort(np.einsum("id,id->i", c, c)[None] - 2 * (q[lo : lo + 64] @ c.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(c))[None].repeat(len(order), 0), 1)
        needed.append(np.take_along_axis(place, near, 1).ravel())
    return int(np.quantile(np.concatenate(needed), held, method="higher")) + 1


#: A class of equal vectors goes by its smallest id and a hash of the vector, since an id may come with several.
INDEX = "dim int, cell int, shard int, ids binary, marks binary, vectors binary, layers array<binary>"


class Cells:
    """Centres for each length of vector, what they were scaled by, and how many cells a query visits."""

    def __init__(self, centres: dict[int, tuple[np.ndarray, float, int]]):
        self.centres = centres

    def of(self, rows: DataFrame, every_probe: bool) -> DataFrame:
        """``rows`` (with v, array<double>) with dim and cell added, in their nearest cell or in each that they visit."""
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        centres, at = self.centres, rows.columns.index("v")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes = np.asarray(pc.list_value_length(b.column(at)))
                for dim in np.unique(sizes):
                    if dim in centres:
                        x = b.filter(pa.array(sizes == dim))
                        c, by, probes = centres[dim]
                        v = x.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                        near = nearest_centres(np.clip(v / by, -1e18, 1e18).astype(np.float32), c, probes if every_probe else 1)
                        rows = x.take(pa.array(np.repeat(np.arange(len(v)), near.shape[1])))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(near.size, dim), pa.int32()), pa.array(near.ravel(), pa.int32())], [*rows.schema.names, "dim", "cell"])

        return rows.mapInArrow(bounded(run), f"{fields}, dim int, cell int")


def fit_cells(vectors: DataFrame, shard: int | None = None) -> tuple[Cells, int]:
    """Cells from a sample that a hash of the ids chooses, and the size of a shard."""
    counts = {r["dim"]: r["n"] for r in vectors.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(counts.values(), default=0)
    size = shard or min(SHARD_MOST, max(SHARD, most // SHARDS))
    centres = {}
    for dim, n in counts.items():
        cap = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        rows = vectors.filter(F.size("v") == dim).orderBy(F.xxhash64("rep"), "rep").limit(min(n, cap)) if n > size else None
        # The bounded sample is all that the driver sees of the vectors.
        x = rows.select("v").toArrow().column(0).combine_chunks().flatten().to_numpy().reshape(-1, dim) if rows is not None else np.zeros((1, dim))
        k = max(1, min(-(-n // size), len(x) // PER_CENTRE)) if rows is not None else 1
        c, (own, by) = fit_centres(x, k), scaled(x)
        centres[dim] = (c, by, probes_needed(own, c))
    return Cells(centres), size


def build_index(vectors: DataFrame, path: str, shard: int | None = None) -> tuple[DataFrame, Cells]:
    """A row per shard from distinct vectors (rep long, mark long, v array<double>), landed: ids, vectors and flat neighbour arrays."""
    cells, size = fit_cells(vectors, shard)
    dealt = land(cells.of(vectors.select("rep", "mark", "v"), False), f"{path}/dealt")
    counts = dealt.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("shards"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep", "mark"])
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        layers = build(scaled(x)[0])
        flat = [np.concatenate([[links.shape[1]], links[:-1].ravel()]).astype(np.int32).tobytes() for _, links in layers]
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "shard": [key[2]], "ids": [pdf["rep"].to_numpy(np.int64).tobytes()], "marks": [pdf["mark"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "layers": [flat]})

    dealt = dealt.join(F.broadcast(counts), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards").cast("long")).cast("int"))
    return land(dealt.groupBy("dim", "cell", "shard").applyInPandas(run, INDEX), f"{path}/index"), cells


def search_index(index: DataFrame, cells: Cells, queries: DataFrame, k: int, path: str, block: int = BLOCK, width: int = SEARCH) -> DataFrame:
    """query_id, rep, mark, score: the k nearest distinct vectors of each query (query_id long, v array<double>) in each shard that it visits."""
    asked = land(cells.of(queries.select("query_id", "v"), True), f"{path}/asked")
    # One row a cell, as many as there are centres.
    blocks = asked.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    shards = index.select("dim", "cell", F.col("shard").alias("shard"))
    own = asked.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks").cast("long")).cast("int")).drop("blocks")
    own = own.join(shards, ["dim", "cell"])
    dealt = index.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    by = ["dim", "cell", "shard", "block"]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in ("query_id", "rep", "mark", "score")})
        row = left.iloc[0]
        ids, marks = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["marks"], np.int64)
        x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
        layers = []
        for raw in row["layers"]:
            flat = np.frombuffer(raw, np.int32)
            layers.append((None, np.concatenate([flat[1:].reshape(len(ids), flat[0]), np.full((1, flat[0]), -1, np.int32)])))
        q = np.stack(right["v"].to_numpy()).astype(np.float64)
        place, dist = search(x, layers, q, min(k, len(ids)), width)
        found = pd.DataFrame({"query_id": np.repeat(right["query_id"].to_numpy(), place.shape[1]), "rep": ids[place.ravel()], "mark": marks[place.ravel()], "score": dist.ravel()})
        return found[place.ravel() >= 0]

    return dealt.groupBy(*by).cogroup(own.groupBy(*by)).applyInPandas(run, "query_id long, rep long, mark long, score double")


def first_of(df: DataFrame, by: str, order: list[str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; the engine cuts groups to k in each task before they are shuffled."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(rank) <= k)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", shard: int | None = None, width: int = SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each row whose id is divisible by ``every``.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows with a null id. Vectors of another length than the query's
    are not its candidates. Ties go to the smaller id. Rows that repeat an id are
    one row where their vectors are equal; an id with several vectors is as near
    as the nearest of them, and asks with the least of them. An empty table gives
    an empty result; other columns play no part.
    """
    path = run_dir(vectors.sparkSession, "hnsw")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite & F.exists("v", lambda c: c != 0), F.lit(False)))
    # Of equal vectors, the k + 1 smallest ids are all that any result can name.
    members = land(first_of(rows.dropDuplicates(["v", "vec_id"]), "v", ["vec_id"], k + 1, "place"), f"{path}/members")
    reps = members.filter("place = 1").select(F.col("vec_id").alias("rep"), F.xxhash64("v").alias("mark"), "v")
    index, cells = build_index(reps, path, shard)
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    found = search_index(index, cells, queries, k + 1, path, width=width)
    # Ties are settled by ids, so every class that may hold one of the k stays: those as near as the last.
    found = found.withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy("score"))).filter(F.col("place") <= k + 1).drop("place")
    owners = members.select("v", "vec_id").join(reps, "v").select("rep", "mark", "vec_id")
    out = found.join(owners, ["rep", "mark"]).filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return first_of(out, "query_id", ["score", "vec_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_hnsw(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))

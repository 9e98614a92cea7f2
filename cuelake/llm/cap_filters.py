"""Embedding near-duplicates by spherical-cap filters (operator 1).

Filter directions are random product codes: the vector is cut in BLOCKS
parts, each with its own random unit code words, and a direction is one word of each
part. Each vector is list-decoded to all directions that exceed its cap, which is
set so that it has CAPS of them (those of the largest inner products; a product's best sums lie among the
best words of its parts, so no list of all directions is ever made). Vectors of a label
that share a direction meet, and their cosines are computed in double
precision. The code has more words where there are more vectors, so that few vectors share a direction but those that
are near; directions that one vector alone has go before vectors are sent.

Equal vectors become one node first. A direction with many vectors is cut in
blocks, and pairs of blocks meet in tasks. A pair counts at the first direction that both have.
A task gives each node its number of links there and one
representative of those it reaches, never the pairs.

Vectors that are null, zero, or hold null or non-finite components, and those
without a label, link with nothing; vectors of different length neither. Ids
may be null or repeat, and ties do: rows are told apart by label and vector, each counts as a
vector of its own, and a null id is no component's id while another is there. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import arrow_task, connected_components, materialize

COSINE = 0.98
BLOCKS = 2
#: Directions of a vector. Two vectors at cosine 0.98 share none by chance alone: none of 2,000 pairs with 64 to 4,096 words in 32 to 256
#: dimensions, and fewer than one in 1,000 in 16 (with 24 directions, one was met in 16 dimensions).
CAPS = 32
#: Vectors that meet in one task.
TOGETHER = 1024
#: Code words of a part are doubled until a direction has this many vectors on average, but are no more than MOST_WORDS.
FILL, MOST_WORDS = 512, 4096
#: Directions with at most so many vectors are compared many at once.
FEW = 64


def code_words(dim: int, words: int, seed: int = 20) -> list[np.ndarray]:
    """Random unit code words of each part of ``dim`` dimensions."""
    rng = np.random.default_rng([seed, dim])
    out = []
    for part in np.array_split(np.arange(dim), min(BLOCKS, dim)):
        c = rng.normal(size=(words, len(part)))
        out.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return out


def decode(x: np.ndarray, code: list[np.ndarray], caps: int = CAPS) -> np.ndarray:
    """The ``caps`` directions of the largest inner products with each row of x, in order of their numbers."""
    rows, at = np.arange(len(x))[:, None], 0
    sums, names = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int32)
    for c in code:
        inner = x[:, at : at + c.shape[1]] @ c.T
        at += c.shape[1]
        k = min(caps, inner.shape[1])
        best = np.argpartition(-inner, k - 1, axis=1)[:, :k]
        sums = (sums[:, :, None] + inner[rows, best][:, None, :]).reshape(len(x), -1)
        names = (names[:, :, None] * len(c) + best[:, None, :]).reshape(len(x), -1)
        k = min(caps, sums.shape[1])
        top = np.argpartition(-sums, k - 1, axis=1)[:, :k]
        sums, names = sums[rows, top], names[rows, top]
    return np.sort(names, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(embedding: str = "embedding", label: str = "label") -> Column:
    v = F.col(embedding)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def _filters(nodes: DataFrame, words: int, kind: type) -> DataFrame:
    """node, label, dim, copies, vector (its bytes), filters of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            held = batch.column("embedding")
            dims = np.diff(held.offsets.to_numpy())
            found: list[np.ndarray | None] = [None] * len(dims)
            raw: list[bytes] = [b""] * len(dims)
            flat = held.flatten().to_numpy(zero_copy_only=False).astype(kind)
            begin = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                code = codes.setdefault(dim, code_words(dim, words))
                at = np.flatnonzero(dims == dim)
                for k in range(0, len(at), 512):
                    rows = at[k : k + 512]
                    x = flat[begin[rows][:, None] + np.arange(dim)]
                    for r, f, v in zip(rows, decode(unit(x), code), x, strict=True):
                        found[r], raw[r] = f, v.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("label"), pa.array(dims, pa.int32()), batch.column("copies"), pa.array(raw, pa.binary()), pa.array(found, pa.list_(pa.int32()))],
                names=["node", "label", "dim", "copies", "vector", "filters"],
            )

    return nodes.select("node", "label", "copies", "embedding").mapInArrow(arrow_task(run), "node long, label long, dim int, copies long, vector binary, filters array<int>")


def _meet(x: np.ndarray, filters: np.ndarray, own: int, node: np.ndarray, copies: np.ndarray, block: np.ndarray, cosine: float) -> tuple[np.ndarray, ...]:
    """Of the nodes of one direction: (node, vectors linked with, representative) of those with links."""
    g = np.triu(x @ x.T >= cosine, 1)
    if (block != block[0]).any():
        g &= block[:, None] != block[None, :]  # pairs inside a block meet elsewhere
    i, j = np.nonzero(g)
    distinct = node[i] != node[j]
    i, j = i[distinct], j[distinct]
    if len(i):
        # directions before this one that two or more nodes have
        earlier, place, count = np.unique(np.where(filters < own, filters, -1), return_inverse=True, return_counts=True)
        shared = np.flatnonzero((earlier >= 0) & (count > 1))
        if len(shared):
            column = np.full(len(earlier), -1)
            column[shared] = np.arange(len(shared))
            has = np.zeros((len(x), -(-len(shared) // 64) * 64), bool)
            where = column[place.reshape(filters.shape)]
            r, c = np.nonzero(where >= 0)
            has[r, where[r, c]] = True
            bits = np.packbits(has, axis=1).view(np.uint64)
            first = np.ones(len(i), bool)
            for k in range(0, len(i), 1 << 18):
                s = slice(k, k + (1 << 18))
                first[s] = ~(bits[i[s]] & bits[j[s]]).any(1)
            i, j = i[first], j[first]
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
    group = np.arange(len(x))
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    for s, e in zip(starts, np.r_[starts[1:], len(i)], strict=True):
        seen = np.unique(group[np.r_[i[s], j[s:e]]])
        if len(seen) > 1:
            group[np.isin(group, seen)] = seen[0]
    at = np.flatnonzero(n)
    return node[at], n[at].astype(np.int64), node[group[at]]


def _first_shared(f: np.ndarray, i: np.ndarray, j: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether rows i and j of f (their directions, in order) share none before ``own``."""
    out = np.ones(len(i), bool)
    for k in range(0, len(i), 4096):
        p = slice(k, k + 4096)
        a, b = f[i[p]], f[j[p]]
        same = (a[:, :, None] == b[:, None, :]).any(2)
        out[p] = a[np.arange(len(a)), same.argmax(1)] == own[p]
    return out


def _meet_few(x: np.ndarray, filters: np.ndarray, own: np.ndarray, node: np.ndarray, copies: np.ndarray, block: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cosine: float) -> tuple[np.ndarray, ...]:
    """(node, vectors linked with, node) of the linked pairs of many small groups, both ways round."""
    found_i, found_j = [], []
    x = np.concatenate([x, np.zeros((1, x.shape[1]))])  # the last row fills groups up
    width = 2
    while width <= FEW:
        g = np.flatnonzero((sizes <= width) & (sizes > width // 2)) if width > 2 else np.flatnonzero(sizes == 2)
        step = max(1, (1 << 21) // (width * max(width, x.shape[1])))
        for k in range(0, len(g), step):
            some = g[k : k + step]
            at = starts[some, None] + np.arange(width)
            at[np.arange(width) >= sizes[some, None]] = len(x) - 1
            v = x[at]
            hit = np.triu(v @ v.transpose(0, 2, 1) >= cosine, 1)
            q, a, b = np.nonzero(hit)
            found_i.append(at[q, a])
            found_j.append(at[q, b])
        width *= 2
    i, j = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (found_i, found_j))
    group = np.repeat(np.arange(len(starts)), sizes)
    two = np.minimum.reduceat(block, starts) != np.maximum.reduceat(block, starts)  # two blocks: pairs inside one meet elsewhere
    ok = (node[i] != node[j]) & (~two[group[i]] | (block[i] != block[j]))
    i, j = i[ok], j[ok]
    ok = _first_shared(filters, i, j, own[i])
    i, j = i[ok], j[ok]
    return np.concatenate([node[i], node[j]]), np.concatenate([copies[j], copies[i]]), np.concatenate([node[j], node[i]])


def _links(spread: DataFrame, kind: type, cosine: float) -> DataFrame:
    """a (node), b (a node it reaches), n (vectors it links with), for each direction; of large ones one row a node, of small ones one a pair, both ways round."""

    def arrays(t: pa.Table) -> list[np.ndarray]:
        x = unit(np.frombuffer(b"".join(t["vector"].combine_chunks().to_pylist()), kind).reshape(t.num_rows, -1))
        filters = t["filters"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        return [x, filters, *(t[c].to_numpy() for c in ("filter", "node", "copies", "block"))]

    def found(t: pa.Table, starts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        sizes, out = np.diff(starts), []
        for k in np.flatnonzero(sizes > FEW):
            x, filters, own, node, copies, block = arrays(t.slice(int(starts[k]), int(sizes[k])))
            out.append(_meet(x, filters, int(own[0]), node, copies, block, cosine))
        few = (sizes > 1) & (sizes <= FEW)
        dims = t["dim"].to_numpy()[starts[:-1]]
        for dim in np.unique(dims[few]).tolist():
            g = np.flatnonzero(few & (dims == dim))
            rows = np.repeat(starts[g] - np.concatenate([[0], np.cumsum(sizes[g])[:-1]]), sizes[g]) + np.arange(sizes[g].sum())
            out.append(_meet_few(*arrays(t.take(pa.array(rows))), np.cumsum(sizes[g]) - sizes[g], sizes[g], cosine))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            made = found(t, starts)
            cols = [np.concatenate([f[k] for f in made]) if made else np.zeros(0, np.int64) for k in (0, 2, 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])

        held: pa.Table | None = None
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = pa.Table.from_batches([batch.slice(k, 4096)])
                held = (part if held is None else pa.concat_tables([held, part])).combine_chunks()
                starts = _starts(held)
                if len(starts) > 1:
                    yield out(held, starts)
                    held = held.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            yield out(held, np.r_[_starts(held), held.num_rows])

    keys = ["label", "dim", "filter", "pair"]
    rows = spread.repartition(*keys).sortWithinPartitions(*keys, "node")
    return rows.select(*keys, "block", "node", "copies", "vector", "filters").mapInArrow(arrow_task(run), "a long, b long, n long")


def _starts(t: pa.Table) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in ("label", "dim", "filter", "pair"):
        v = t[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _spread(made: DataFrame) -> DataFrame:
    """A row for each node, direction that others have too, and pair of blocks of the direction. Directions are counted without vectors."""
    keys = ["label", "dim", "filter"]
    thin = made.select("node", "label", "dim", F.explode("filters").alias("filter"))
    shared = thin.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1")
    shared = materialize(shared.select(*keys, F.ceil(F.col("c") / TOGETHER).cast("long").alias("blocks")), "cap-filters-shared")
    met = thin.join(shared, keys).select("node", "filter", "blocks")
    rows = made.join(met, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.least("block", k) * F.col("blocks") + F.greatest("block", k))
    return rows.withColumn("pair", F.explode(pair))


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, words: int | None = None) -> DataFrame:
    """embeddings (vec_id, embedding, label) to vec_id, n_links, component_id, kept: a row for each vector."""
    kind = np.float64 if dict(embeddings.dtypes)["embedding"] == "array<double>" else np.float32
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"), usable().alias("ok"))
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    distinct = rows.where("ok").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "cap-filters-nodes")
    if words is None:
        words, n = 64, nodes.count()
        while n * CAPS / words**BLOCKS > FILL and words < MOST_WORDS:
            words *= 2
    made = materialize(_filters(nodes, words, kind), "cap-filters")
    links = materialize(_links(_spread(made), kind, cosine), "cap-filters-links")
    classes = connected_components(links.where("a <> b").select("a", "b").distinct()).select("node", F.col("component").alias("class"))
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = nodes.select("node", "label", "h1", "h2", "least", "copies").join(counts, "node", "left").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    labels = materialize(labels, "cap-filters-labels")
    least = labels.groupBy("class").agg(F.min("least").alias("component"))
    place = labels.join(least, "class").select(F.col("label").alias("_l"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "copies", "n", "component")
    out = rows.drop("embedding").join(place, F.col("ok") & (F.col("label") == F.col("_l")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("n", F.lit(0).cast("long")), F.lit(0).cast("long"))
    out = out.select("vec_id", n_links.alias("n_links"), F.when(F.col("ok"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

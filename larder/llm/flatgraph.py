"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Equal vectors of a label are one node with a weight.
2. Pivots are a hashed sample of the nodes; a node belongs to the shards of its nearest
   pivots, which is how shards overlap, and has its home in the nearest one.
3. Every shard links each of its nodes to near and to random ones, robustly pruned: a
   candidate goes when one already taken is clearly nearer to it than the node is.
4. The lists of all shards are united by node.
5. Every node is a query, searched in its home shard and in what this shard's lists lead
   to nearby in two steps: greedily from the shard's medoid and the node itself, then outwards as long
   as nodes are in range. Whole blocks of queries take each step together.
6. Links are those visited nodes whose cosine, in double precision, is high enough, whichever
   of the two found the other. They are counted where they are found and never listed: for
   a node and a shard that is not its home, both sides give the number and a digest of the
   links found. Where these differ, the node is compared with all that are at home there.
7. Samples of nodes, of those with no, few and any links found, are compared with all
   others. When a node of few or of many links missed too many of them on average, the
   graph is built again with more overlap; when that doesn't help either, all nodes of
   a label are compared with one another, in blocks.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larder.llm.graph import components
from larder.llm.words import constants, mix
from larder.session import Workspace

MIN_COSINE = 0.93
#: Rows of a shard aimed at; pivots at most, which bounds what is broadcast.
SHARD_ROWS, MAX_PIVOTS = 512, 8192
#: Components of all pivots, where that allows for more of them.
PIVOT_NUMBERS = 1 << 22
#: Shards a node belongs to at first, and how many more each further attempt takes.
OVERLAP, MORE_OVERLAP, ATTEMPTS = 3, 3, 3
#: Near and random candidates of a node; its links after pruning; how strictly it prunes.
NEAR, RANDOM, DEGREE, ALPHA = 40, 8, 20, 1.2
#: Queries of a step, nodes each keeps open on its way, and how far out of range it goes on.
QUERIES, BEAM, SLACK = 128, 8, 0.06
#: Steps along lists of nearby nodes that a home shard is extended by.
HOPS = 2
#: Nodes of each sample that the audit compares with all others, the share of its links
#: that a node has to find on average, and up to how many links are few.
AUDITED, MIN_RECALL, FEW = 256, 0.999, 64
#: Nodes of a block when all are compared.
BLOCK = 2048
#: Numbers that a task holds at once of queries by nodes, nodes by pivots and lists followed.
CELLS = 1 << 20

_log = logging.getLogger(__name__)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.array(column.flatten(), np.float64).reshape(len(column), -1)
    for part in np.split(rows, range(BLOCK, len(rows), BLOCK)):
        part /= np.sqrt((part * part).sum(axis=1, keepdims=True))
    return rows


def _parts(places: np.ndarray, width: int, most: int | None = None) -> Iterator[np.ndarray]:
    """Pieces of places that ``width`` numbers each can be held of."""
    step = max(1, min(CELLS // max(width, 1), most or CELLS))
    return (places[lo:lo + step] for lo in range(0, len(places), step))


def nodes_of(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(label, size, embedding, id, weight): usable vectors, equal ones as one node."""
    vector = F.col(vector_col)
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vector.isNotNull() & F.col(label_col).isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)
    return (embeddings.filter(usable & F.col(id_col).isNotNull())
            .groupBy(F.col(label_col).alias("label"), F.size(vector).alias("size"), vector.alias("embedding"))
            .agg(F.min(F.col(id_col).cast("long")).alias("id"), F.count(F.lit(1)).alias("weight")))


def _assigned(pivots: dict, overlap: int):
    """Nodes with the shards of their nearest pivots, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict = {}
            for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist())):
                groups.setdefault(key, []).append(i)
            for key, of_key in groups.items():
                numbers, centres = pivots[key]
                k = min(overlap, len(numbers))
                for rows in _parts(np.array(of_key), len(numbers)):
                    take = batch.take(pa.array(rows))
                    far = -(_matrix(take.column("embedding")) @ centres.T)
                    top = np.sort(np.argpartition(far, k - 1, axis=1)[:, :k], axis=1)
                    order = np.argsort(np.take_along_axis(far, top, axis=1), axis=1, kind="stable")
                    shard = numbers[np.take_along_axis(top, order, axis=1)]
                    out = take.take(pa.array(np.repeat(np.arange(len(rows)), k)))
                    yield pa.RecordBatch.from_arrays(
                        [out.column("id"), out.column("embedding"), pa.array(shard.reshape(-1), pa.int64()),
                         pa.array(np.tile(np.arange(k) == 0, len(rows)))], ["id", "embedding", "shard", "home"])

    return run


def _pruned(vectors: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each node of a shard, as places in it."""
    n = len(vectors)
    near, out = min(NEAR, n - 1), []
    if n == 1:
        return [np.empty(0, np.int64)]
    order = np.argsort(mix(ids.astype(np.uint64)))
    for own in _parts(np.arange(n), max(n, (near + RANDOM) * vectors.shape[1]), 256):
        like = vectors[own] @ vectors.T
        like[np.arange(len(own)), own] = -2
        close = np.argpartition(-like, near - 1, axis=1)[:, :near]
        # the same for all layouts: places drawn from the ids
        far = order[(mix(ids[own, None].astype(np.uint64) + constants(RANDOM, 31)) % np.uint64(n)).astype(np.int64)]
        pool = np.concatenate([close, far], axis=1)
        to_node = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(like, pool, axis=1), 0))
        rank = np.argsort(to_node, axis=1, kind="stable")
        pool, to_node = np.take_along_axis(pool, rank, axis=1), np.take_along_axis(to_node, rank, axis=1)
        among = vectors[pool]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("bid,bjd->bij", among, among), 0))
        taken = np.zeros(pool.shape, bool)
        for j in range(pool.shape[1]):
            covered = (taken[:, :j] & (ALPHA * between[:, j, :j] <= to_node[:, j, None])).any(axis=1)
            taken[:, j] = ~covered & (taken[:, :j].sum(axis=1) < DEGREE) & (pool[:, j] != own)
        # the nearest few always stay, so that tight groups hang together
        taken[:, :4] = pool[:, :4] != own[:, None]
        out += [np.unique(p[t]) for p, t in zip(pool, taken)]
    return out


def _built(reach: float):
    return lambda table: _shard(table, reach)


def _shard(table: pa.Table, reach: float) -> pa.Table:
    """A shard's links, both ways, those to nodes nearby, and whether a node is its medoid."""
    ids, vectors = table["id"].to_numpy(), _matrix(table["embedding"])
    at = np.argsort(ids)
    ids, vectors = ids[at], vectors[at]
    links = _pruned(vectors, ids)
    source = np.repeat(np.arange(len(ids)), [len(x) for x in links])
    target = np.concatenate(links)
    code = np.unique(np.concatenate([source * len(ids) + target, target * len(ids) + source]))
    source, target = code // len(ids), code % len(ids)
    close = np.einsum("ij,ij->i", vectors[source], vectors[target]) >= reach
    cuts = np.arange(1, len(ids))
    both = np.split(ids[target], np.searchsorted(source, cuts))
    nearby = np.split(ids[target[close]], np.searchsorted(source[close], cuts))
    medoid = np.arange(len(ids)) == np.argmax(vectors @ vectors.mean(axis=0))
    return pa.table({"id": ids, "shard": pa.array([table["shard"][0].as_py()] * len(ids), pa.int64()),
                     "medoid": medoid, "neighbours": pa.array(both, pa.list_(pa.int64())),
                     "nearby": pa.array(nearby, pa.list_(pa.int64()))})


def _followed(first: np.ndarray, flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple]:
    """The lists of places b, each entry with the a beside it, in pieces."""
    sizes = first[1][b]
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(ends, np.arange(CELLS, ends[-1] if len(ends) else 0, CELLS))
    for lo, hi in zip([0, *cuts], [*cuts, len(b)]):
        n = sizes[lo:hi]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(a[lo:hi], n), flat[np.repeat(first[0][b[lo:hi]], n) + within]


def _search(vectors: np.ndarray, first: np.ndarray, flat: np.ndarray, queries: np.ndarray, start: np.ndarray,
            min_cosine: float) -> np.ndarray:
    """Queries by nodes: whether a node was found in range, the queries taken in one block.

    The list of place i is ``flat[first[0, i]:][:first[1, i]]``.
    """
    n, q = len(vectors), len(queries)
    seen, opened = np.zeros((q, n), bool), np.zeros((q, n), bool)
    like = np.full((q, n), -2.0)
    fresh = np.zeros((q, n), bool)
    fresh[:, start] = True
    fresh[np.arange(q), queries] = True
    beam = min(BEAM, n)
    while True:
        a, b = np.nonzero(fresh)
        if not len(a):
            break
        for part in _parts(np.arange(len(a)), vectors.shape[1]):
            x, y = a[part], b[part]
            like[x, y] = np.einsum("ij,ij->i", vectors[queries[x]], vectors[y])
        seen |= fresh
        bound = np.minimum(np.partition(like, n - beam, axis=1)[:, n - beam], min_cosine - SLACK)
        a, b = np.nonzero(seen & ~opened & (like >= bound[:, None]))
        opened[a, b] = True
        fresh = np.zeros((q, n), bool)
        for x, y in _followed(first, flat, a, b):
            fresh[x, y] = True
        fresh &= ~seen
    like[np.arange(q), queries] = -2
    return like >= min_cosine


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places is tied to by the pairs."""
    own = np.arange(n)
    while True:
        before = own.copy()
        np.minimum.at(own, a, own[b])
        np.minimum.at(own, b, own[a])
        own = own[own]
        if (own == before).all():
            return own


def _merged(root: np.ndarray, rows: np.ndarray, columns: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The least place each place is tied to, once rows and columns that hit are tied too."""
    a, b = np.nonzero(hit & (root[rows][:, None] != root[columns]))
    pairs = np.unique(root[rows[a]] * len(root) + root[columns[b]])
    return _least(len(root), pairs // len(root), pairs % len(root))[root] if len(pairs) else root


def _compare(vectors: np.ndarray, weight: np.ndarray, asked: np.ndarray, others: np.ndarray, root: np.ndarray,
             min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of the links of asked places with others, of others with asked ones, and the ties with these."""
    found, back, there = np.zeros(len(asked), np.int64), np.zeros(len(others), np.int64), vectors[others]
    for at in _parts(np.arange(len(asked)), max(len(others), vectors.shape[1])):
        rows = asked[at]
        hit = (vectors[rows] @ there.T >= min_cosine) & (rows[:, None] != others)
        found[at] = hit @ weight[others]
        back += weight[rows] @ hit
        root = _merged(root, rows, others, hit)
    return found, back, root


def _lists(ids: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(beginnings and sizes, entries) of the lists as places in ids, without what isn't there."""
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    flat, by_id = lists.flatten(), np.argsort(ids)
    out, there = [np.empty(0, np.int32)], np.zeros(len(flat) + 1, np.int64)
    for lo in range(0, len(flat), CELLS):
        part = flat.slice(lo, CELLS).to_numpy()
        place = by_id[np.minimum(np.searchsorted(ids, part, sorter=by_id), len(ids) - 1)]
        inside = ids[place] == part
        there[lo + 1:lo + 1 + len(part)] = inside
        out.append(place[inside].astype(np.int32))
    np.cumsum(there, out=there)
    ends = np.cumsum(sizes)
    return np.stack([there[ends - sizes], there[ends] - there[ends - sizes]]), np.concatenate(out)


FOUND = "id long, place long, found long, digest long, out boolean, tied long"


def _searched(min_cosine: float):
    def run(table: pa.Table) -> pa.Table:
        """One shard with what its lists lead to: how many links were found, by node and shard.

        Rows with out null: a node at home here, and the weight of its links at home. Rows
        with out true: a node at home here, the weight of the links it found to nodes at home
        in another shard (place), and their digest. Rows with out false: a node at home
        elsewhere, and the same of the nodes at home here that found it. tied is a node of
        the same component.
        """
        table = table.sort_by([("at", "ascending"), ("id", "ascending")])
        ids, at, shard = table["id"].to_numpy(), table["at"].to_numpy(), table["shard"][0].as_py()
        vectors, weight = _matrix(table["embedding"]), table["weight"].to_numpy()
        first, flat = _lists(ids, table["neighbours"].combine_chunks())
        own, start = np.flatnonzero(at == shard), np.flatnonzero(table["medoid"].to_numpy(zero_copy_only=False))
        code = mix(ids.astype(np.uint64))
        begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        home = int(np.searchsorted(at[begins], shard))
        root, found, codes = np.arange(len(ids)), [], []
        back, back_codes = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.uint64)
        out = [[np.empty(0, np.int64)] * 4]
        for queries in _parts(own, len(ids), QUERIES):
            hit = _search(vectors, first, flat, queries, start, min_cosine)
            back += np.where(hit, weight[queries, None], 0).sum(axis=0)
            back_codes += np.where(hit, code[queries, None], 0).sum(axis=0, dtype=np.uint64)
            links = np.add.reduceat(np.where(hit, weight, 0), begins, axis=1)
            digests = np.add.reduceat(np.where(hit, code, 0), begins, axis=1, dtype=np.uint64)
            root = _merged(root, queries, np.arange(len(ids)), hit)
            found.append(links[:, home].copy())
            codes.append(digests[:, home].copy())
            links[:, home] = 0
            x, y = np.nonzero(links)
            out.append([ids[queries[x]], at[begins[y]], links[x, y], digests[x, y].view(np.int64)])
        found, codes = np.concatenate(found), np.concatenate(codes)
        odd = np.flatnonzero(codes != back_codes[own])
        found[odd], _, root = _compare(vectors, weight, own[odd], own, root, min_cosine)
        met = np.flatnonzero((at != shard) & (back > 0))
        led, n, k = [np.concatenate(x) for x in zip(*out)], len(own), len(met)
        parts = [  # a node at home, its links elsewhere, links from elsewhere
            [ids[own], np.full(n, shard), found, np.zeros(n, np.int64), [None] * n, ids[root[own]]],
            [*led, [True] * len(led[0]), led[0]],
            [ids[met], np.full(k, shard), back[met], back_codes[met].view(np.int64), [False] * k, ids[root[met]]]]
        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64()]
        return pa.Table.from_arrays([pa.concat_arrays([pa.array(x, kind) for x in column])
                                     for column, kind in zip(zip(*parts), kinds)], ["id", "place", "found", "digest", "out", "tied"])

    return run


def _recounted(min_cosine: float):
    def run(table: pa.Table) -> pa.Table:
        """Nodes that are asked for against all that are at home in a shard."""
        ids, vectors, weight = table["id"].to_numpy(), _matrix(table["embedding"]), table["weight"].to_numpy()
        asked = table["asked"].to_numpy(zero_copy_only=False)
        found = np.zeros(len(ids), np.int64)
        found[asked], _, root = _compare(
            vectors, weight, np.flatnonzero(asked), np.flatnonzero(~asked), np.arange(len(ids)), min_cosine)
        return pa.table({"id": ids, "found": found, "tied": ids[root]})

    return run


def links_of(nodes: DataFrame, overlap: int, min_cosine: float, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(per node: id, n_links to others; edges u, v that tie all components) of kept nodes."""
    n, size = nodes.agg(F.count(F.lit(1)), F.max("size")).first()
    most = max(MAX_PIVOTS, PIVOT_NUMBERS // max(size or 1, 1))
    threshold = int((1 << 30) * min(1 / SHARD_ROWS, most / 2 / max(n, 1))) + 1
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    first = nodes.groupBy("label", "size").agg(F.min_by("id", place).alias("id"))
    chosen = nodes.join(first.select("id", F.lit(True).alias("first")), "id", "left").filter(
        F.col("first") | (place < threshold)).select("label", "size", "id", "embedding")
    pivots, groups = chosen.orderBy("id").toArrow(), {}
    for i, key in enumerate(zip(pivots["label"].to_pylist(), pivots["size"].to_pylist())):
        groups.setdefault(key, []).append(i)
    packed = {k: (pivots["id"].to_numpy()[i], _matrix(pivots["embedding"].take(pa.array(i)))) for k, i in groups.items()}
    member = work.keep(nodes.mapInArrow(
        _assigned(packed, overlap), f"id long, embedding {dict(nodes.dtypes)['embedding']}, shard long, home boolean"), "members")
    built = work.keep(member.groupBy("shard").applyInArrow(
        _built(min_cosine - 2 * SLACK),
        "id long, shard long, medoid boolean, neighbours array<long>, nearby array<long>"), "built")
    home = work.keep(member.filter("home").select("id", F.col("shard").alias("at")), "home")
    united = work.keep(built.groupBy("id").agg(*[
        F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("neighbours", "nearby")]), "united")
    step = united.select("id", F.explode("nearby").alias("next"))
    led = home.select("id", F.col("at").alias("shard"))
    for _ in range(HOPS):
        led = led.join(step, "id").select("shard", F.col("next").alias("id")).unionByName(led.select("shard", "id")).distinct()
    inside = member.select("shard", "id").unionByName(led.select("shard", "id")).distinct()
    loaded = inside.join(built.filter("medoid").select("shard", "id", "medoid"), ["shard", "id"], "left")
    rows = (loaded.withColumn("medoid", F.coalesce("medoid", F.lit(False))).join(united.drop("nearby"), "id")
            .join(home, "id").join(nodes.select("id", "embedding", "weight"), "id"))
    found = work.keep(rows.groupBy("shard").applyInArrow(_searched(min_cosine), FOUND), "found")
    for done in (member, built, united):
        work.drop(done)
    sides = work.keep(found.filter("out is not null").groupBy("id", "place").agg(
        ((F.count(F.lit(1)) == 2) & (F.min("digest") == F.max("digest"))).alias("agreed"), F.max("found").alias("found")),
        "sides")
    parts = [found.filter("out is null").select("id", "found"), sides.filter("agreed").select("id", "found")]
    ties = [found.filter("id != tied").select("id", "tied")]
    asked = sides.filter("not agreed").select("id", F.col("place").alias("shard"))
    if not asked.isEmpty():
        there = home.withColumnRenamed("at", "shard").join(asked.select("shard"), "shard", "left_semi")
        rows = asked.withColumn("asked", F.lit(True)).unionByName(there.withColumn("asked", F.lit(False))).join(
            nodes.select("id", "embedding", "weight"), "id")
        again = work.keep(rows.groupBy("shard").applyInArrow(_recounted(min_cosine), "id long, found long, tied long"), "again")
        parts.append(again.select("id", "found"))
        ties.append(again.filter("id != tied").select("id", "tied"))
    counts = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("found").alias("n_links"))
    return counts, reduce(DataFrame.unionByName, ties).toDF("u", "v")


def _compared(min_cosine: float):
    def run(table: pa.Table) -> pa.Table:
        """Two blocks, or one with itself: per node the weight of its links there, and a node it is tied to."""
        ids, vectors, weight = table["id"].to_numpy(), _matrix(table["embedding"]), table["weight"].to_numpy()
        at = np.argsort(ids)
        ids, vectors, weight, block = ids[at], vectors[at], weight[at], table["block"].to_numpy()[at]
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        a, b, found = np.flatnonzero(block == lo), np.flatnonzero(block == hi), np.zeros(len(ids), np.int64)
        found[a], back, root = _compare(vectors, weight, a, b, np.arange(len(ids)), min_cosine)
        if lo != hi:
            found[b] = back
        return pa.table({"id": ids, "found": found, "tied": ids[root]})

    return run


def compared(nodes: DataFrame, min_cosine: float, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """As ``links_of``, exactly: every two blocks of the nodes of a label meet in a task."""
    blocks = nodes.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = nodes.join(blocks, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "label", "size", "id", "embedding", "weight", "block",
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = work.keep(rows.groupBy("label", "size", "lo", "hi").applyInArrow(
        _compared(min_cosine), "id long, found long, tied long"), "compared")
    return (found.groupBy("id").agg(F.sum("found").alias("n_links")),
            found.select(F.col("id").alias("u"), F.col("tied").alias("v")))


def audit(nodes: DataFrame, counts: DataFrame, min_cosine: float, sample: int = AUDITED) -> float:
    """Share of its links that a node has found: the mean over audited nodes that have any.

    The lower of two means, that of nodes of few links and that of the others, so that a
    large group doesn't hide what small ones miss. Audited are three hashed samples, of
    all nodes and of those with no and few links found. Each is bounded by ``sample`` and
    compared with every node of its labels.
    """
    known = nodes.join(counts, "id").select("id", "label", "embedding", "size", "n_links")
    parts = [known.filter(x).orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
             for x in ("true", "n_links = 0", f"n_links between 1 and {FEW}")]
    asked = pd.concat([x for x in parts if len(x)] or parts[:1]).drop_duplicates("id", ignore_index=True)
    if asked.empty:
        return 1.0
    own = asked["id"].to_numpy(np.int64)
    groups = {key: (rows.index.to_numpy(), np.stack([v / np.linalg.norm(v) for v in (
        np.asarray(x, np.float64) for x in rows["embedding"])])) for key, rows in asked.groupby(["label", "size"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(len(own), np.int64)
            keys = list(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist()))
            for key in set(keys) & set(groups):
                places, vectors = groups[key]
                for rows in _parts(np.array([i for i, k in enumerate(keys) if k == key]), len(places)):
                    part = batch.take(pa.array(rows))
                    near = (_matrix(part.column("embedding")) @ vectors.T >= min_cosine) & (
                        part.column("id").to_numpy()[:, None] != own[places])
                    total[places] += (near * part.column("weight").to_numpy()[:, None]).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total)], ["id", "true_links"])

    true = nodes.mapInArrow(run, "id long, true_links long").groupBy("id").agg(F.sum("true_links").alias("true_links"))
    linked = asked.merge(true.toPandas(), on="id").query("true_links > 0")
    share = np.minimum(linked["n_links"], linked["true_links"]) / linked["true_links"]
    return float(share.groupby(linked["true_links"] <= FEW).mean().min()) if len(linked) else 1.0


def near_duplicates(embeddings: DataFrame, min_cosine: float = MIN_COSINE, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors of one label are linked when their cosine is at least ``min_cosine``. n_links
    counts the other rows linked directly, component_id is the smallest vec_id reachable,
    itself included, and kept marks that one.

    A null, empty or zero vector, one with a null or non-finite component, a null label
    or a null vec_id: no links, its own component. Vectors of different length are never
    linked. Equal vectors are linked with one another, repeated rows too, and come back
    each. An empty table gives an empty result. Other columns are not read.
    """
    spark = embeddings.sparkSession
    work = Workspace(spark, "flatgraph")
    kind = "float" if dict(embeddings.dtypes)[vector_col] == "array<float>" else "double"
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"),
                             F.col(vector_col).cast(f"array<{kind}>").alias("embedding"), F.col(label_col).alias("label"))
    nodes = work.keep(nodes_of(rows, "vec_id", "embedding", "label"), "nodes")
    for attempt in range(ATTEMPTS):
        counts, edges = links_of(nodes, OVERLAP + attempt * MORE_OVERLAP, min_cosine, work)
        counts = work.keep(counts, "counts")
        recall = audit(nodes, counts, min_cosine)
        _log.info("attempt %d: recall %.5f", attempt + 1, recall)
        if recall >= MIN_RECALL:
            break
    else:
        _log.warning("recall %.5f after %d attempts: comparing all nodes of a label", recall, ATTEMPTS)
        counts, edges = compared(nodes, min_cosine, work)
    found = components(edges, work)
    facts = nodes.join(counts, "id").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "label", "embedding", (F.col("n_links") + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    out = rows.join(facts, ["label", "embedding"], "left")
    own = F.col("vec_id").isNull()
    component = F.when(own, F.col("vec_id")).otherwise(F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id", F.when(own, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))

"""Near-duplicate embeddings through one HNSW graph per shard.

Equal vectors are one vector with a count. The distinct vectors are dealt
into shards by a hash; each shard's graph (``hnsw``) is built in a task and
written to the shared folder. Every vector is then searched for in every
shard (a pair of shards is searched in one direction, as links have none), in
units of one graph and a few blocks of vectors, so a task holds one graph and
one block. What a search finds is verified by cosine in double precision.

An audit compares one vector in ``AUDIT_EVERY`` (of small tables more, up to
all) with all others by brute force, in blocks. Of each audited vector with
links the share that the search found counts alike; the shares are averaged
for vectors of like numbers of links (by powers of two), so that a large group
hides no small one. While an average is below ``RECALL``, the beam is doubled
and the search repeated, at the end by comparing all. Links become
components by star steps.

Links are not listed one by one: a search task counts them for both ends and
passes on its components as one edge a vector, so a large group of near
vectors costs rows in proportion to its size. A pair across shards is met
in one search; a pair inside a shard in two, one from each end, and each
counts for the vector that was searched for.

A search task meets the pairs in bounded parts (``hnsw``) and keeps of each
its counts and its forest.

Shards: at least ``SHARDS``, and so many that none has over about
``SHARD_ROWS`` vectors or ``SHARD_BYTES`` of them in double precision.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components link with nothing; vectors link only with those of
their own length; rows with one vec_id are vectors of their own; a null
vec_id is never the least id of a component unless all are null; an empty
table gives an empty result.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmetrics.llm.common import in_arrow, running_total, stored
from segmetrics.llm.components import components
from segmetrics.llm.hnsw import Graph

SHARDS = 8
SHARD_ROWS = 50_000
SHARD_BYTES = 64 << 20
BLOCK = 4096
UNIT_BLOCKS = 16
BEAM = 48
AUDITED = 256  # vectors at least
AUDIT_EVERY = 20
AUDIT_BLOCK = 16384
RECALL = 0.995
SLACK = 1e-5  # single precision in the search
COSINES = 1 << 15  # pairs verified at a time


def _usable(v: Column) -> Column:
    """Not null, not empty, all components finite, one not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _vectors(batch: pa.RecordBatch, name: str = "vector") -> np.ndarray:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest component, so that no
    square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _rows_by(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows sorted by the keys -> (key, its rows)."""
    held, last = [], None
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        at = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[at]:
                if values[at] != last and held:
                    yield last, pa.Table.from_batches(held)
                    held = []
                last = values[at]
                held.append(batch.slice(at, i - at))
                at = i
    if held:
        yield last, pa.Table.from_batches(held)


def _blob(arrays: list[np.ndarray]) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _arrays(blob: bytes) -> list[np.ndarray]:
    import io

    with np.load(io.BytesIO(blob)) as z:
        return [z[k] for k in z.files]


def _build(beam: int, piece: int = 8 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's vectors -> its graph, in pieces (kind 0), and its vectors
        in blocks (kind 1)."""
        for (size, shard), rows in _rows_by(batches, "size", "shard"):
            rows = rows.combine_chunks()
            for batch in rows.to_batches(max_chunksize=max(1, rows.num_rows)):
                x, ids, n = _vectors(batch), batch.column("node").to_numpy(), batch.column("n").to_numpy()
                data = _blob([ids, n, x, *Graph.build(_unit(x), beam).arrays()])
                out = [(0, k, data[at:at + piece]) for k, at in enumerate(range(0, len(data), piece))]
                out += [(1, k, _blob([ids[at:at + BLOCK], n[at:at + BLOCK], x[at:at + BLOCK]])) for k, at in enumerate(range(0, len(ids), BLOCK))]
                for kind, part, blob in out:
                    yield pa.record_batch([pa.array([size], pa.int32()), pa.array([shard], pa.int32()), pa.array([kind], pa.int32()),
                                           pa.array([part], pa.int32()), pa.array([blob], pa.binary())],
                                          names=["size", "shard", "kind", "part", "blob"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among nodes -> one edge a node, to the least of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[:a.size], ends[a.size:]
    label = np.arange(nodes.size)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(nodes.size)
    return nodes[other], nodes[label[other]]


FOUND = "kind int, a long, b long, n long"


def _search(least: float, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units: a graph's pieces, then blocks of vectors to search for ->
        counts (kind 0: node, links, links with copies) and edges (kind 1)."""
        def found(graph: Graph, ids, copies, v, own: bool, q_ids, q_copies, q):
            u = _unit(q)
            mine, heavy = np.zeros(q_ids.size, np.int64), np.zeros(q_ids.size)
            theirs, t_heavy = np.zeros(ids.size, np.int64), np.zeros(ids.size)
            edges = np.empty((2, 0), np.int64)
            for a, b in graph.near(u.astype(np.float32), least - SLACK, beam):
                for at in range(0, a.size, 1 << 19):
                    s, t = a[at:at + (1 << 19)], b[at:at + (1 << 19)]
                    cosine = np.concatenate([np.einsum("ij,ij->i", u[s[i:i + COSINES]], v[t[i:i + COSINES]])
                                             for i in range(0, s.size, COSINES)])
                    ok = (cosine >= least) & (q_ids[s] != ids[t])
                    s, t = s[ok], t[ok]
                    mine += np.bincount(s, minlength=mine.size)
                    heavy += np.bincount(s, copies[t], heavy.size)
                    if not own:
                        theirs += np.bincount(t, minlength=theirs.size)
                        t_heavy += np.bincount(t, q_copies[s], t_heavy.size)
                    edges = np.array(_forest(*np.concatenate([edges, [q_ids[s], ids[t]]], axis=1)))
            node, links, n = (np.concatenate(c) for c in ((q_ids, ids), (mine, theirs), (heavy, t_heavy)))
            some = links > 0
            kind = np.repeat(np.array([0, 1], np.int32), [int(some.sum()), edges.shape[1]])
            return pa.record_batch([pa.array(kind), pa.array(np.concatenate([node[some], edges[0]])),
                                    pa.array(np.concatenate([links[some], edges[1]])),
                                    pa.array(np.concatenate([n[some].astype(np.int64), np.zeros(edges.shape[1], np.int64)]))],
                                   names=["kind", "a", "b", "n"])

        now, pieces, state = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                unit = (row["size"], row["graph"], row["unit"])
                if unit != now:
                    now, pieces, state = unit, [], None
                if row["kind"] == 0:
                    pieces.append(row["blob"])
                    continue
                if state is None and not pieces:
                    continue  # a shard without vectors of this length
                if state is None:
                    ids, copies, x, *rest = _arrays(b"".join(pieces))
                    own = row["unit"].split("-")[0] == str(row["graph"])
                    state, pieces = (Graph.of(rest), ids, copies, _unit(x), own), []
                yield found(*state, *_arrays(row["blob"]))

    return run


def _audit(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units: audited vectors, then blocks of others -> (node, links) of
        the audited, by brute force."""
        now, blobs, ids, u, links = None, [], None, None, None

        def result():
            return pa.record_batch([pa.array(ids), pa.array(links)], names=["node", "links"])

        for batch in batches:
            for row in batch.to_pylist():
                unit = (row["size"], row["unit"], row["shard"])
                if unit != now:
                    if links is not None:
                        yield result()
                    now, blobs, links = unit, [], None
                if row["kind"] == 0:
                    blobs.append((row["node"], row["vector"]))
                    continue
                if links is None and not blobs:
                    continue  # no audited vector of this length
                if links is None:
                    ids, u = np.array([b[0] for b in blobs]), _unit(np.array([b[1] for b in blobs], np.float64))
                    links, blobs = np.zeros(len(ids), np.int64), []
                nodes, _, x = _arrays(row["blob"])
                v = _unit(x).T
                for at in range(0, len(ids), 1024):
                    near = (u[at:at + 1024] @ v >= least) & (ids[at:at + 1024, None] != nodes[None, :])
                    links[at:at + 1024] += near.sum(1)
        if links is not None:
            yield result()

    return run


def _true_links(nodes: DataFrame, graphs: DataFrame, least: float, shards: int, count: int) -> DataFrame:
    """(node, links) of the audited vectors. ``node`` numbers the vectors in
    the order of their hashes, so each k-th is a sample of all groups."""
    every = max(1, min(AUDIT_EVERY, count // AUDITED))
    last = max(0, (count - 1) // every // AUDIT_BLOCK)
    none = F.lit(None)
    audited = nodes.where(F.col("node") % every == 0).select(
        "size", F.floor(F.col("node") / every / AUDIT_BLOCK).cast("int").alias("unit"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("kind"), "node",
        F.col("vector").cast("array<double>").alias("vector"), none.cast("binary").alias("blob"))
    blocks = graphs.where("kind = 1").select(
        "size", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("unit"), "shard", "kind", none.cast("long").alias("node"),
        none.cast("array<double>").alias("vector"), "blob")
    work = audited.union(blocks).repartition("size", "unit", "shard").sortWithinPartitions("size", "unit", "shard", "kind")
    return stored(in_arrow(work, _audit(least), "node long, links long").groupBy("node").agg(
        F.sum("links").alias("links")), "hnsw-audit")


def worst_share(found: DataFrame, true: DataFrame) -> float:
    """The least average share of their links that the search found, over
    audited vectors of like numbers of links; 1 if none has links."""
    seen = found.where("kind = 0").join(true.select("node"), F.col("a") == F.col("node"), "left_semi").groupBy(
        "a").agg(F.sum("b").alias("seen"))
    share = F.least(F.coalesce(F.col("seen"), F.lit(0)) / F.col("links"), F.lit(1.0))
    like = true.where("links > 0").join(seen, F.col("node") == F.col("a"), "left").groupBy(
        F.floor(F.log2("links")).alias("like")).agg(F.avg(share).alias("share"))
    least = like.agg(F.min("share")).first()[0]
    return 1.0 if least is None else least


def _links(nodes: DataFrame, least: float, shards: int, beam: int, count: int) -> DataFrame:
    """What the searches found (``FOUND``), with beams that pass the audit."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.select("node", "n", "vector", "size", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"))
    graphs = stored(in_arrow(
        dealt.repartitionById(shards, "shard").sortWithinPartitions("size", "shard", "node"), _build(2 * BEAM),
        "size int, shard int, kind int, part int, blob binary"), "hnsw-graphs")
    true = _true_links(nodes, graphs, least, shards, count)
    # blocks of a shard go to its own graph and those of smaller numbers
    blocks = graphs.where("kind = 1").select(
        "size", F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("graph"),
        F.concat_ws("-", F.col("shard").cast("string"), F.floor(F.col("part") / UNIT_BLOCKS).cast("string")).alias("unit"),
        "kind", "part", "blob")
    units = blocks.select("size", "graph", "unit").distinct()
    g = graphs.where("kind = 0").select(F.col("size").alias("g_size"), "shard", "part", "blob")
    graph_rows = units.join(g, (F.col("size") == F.col("g_size")) & (F.col("graph") == F.col("shard"))).select(
        "size", "graph", "unit", F.lit(0).alias("kind"), "part", "blob")
    work = graph_rows.union(blocks).repartition(parts, "size", "graph", "unit").sortWithinPartitions(
        "size", "graph", "unit", "kind", "part")
    while True:
        found = stored(in_arrow(work, _search(least, beam), FOUND), "hnsw-found")
        share = worst_share(found, true)
        if share >= RECALL:
            return found
        if beam > 2 * SHARD_ROWS:
            raise RuntimeError(f"the audit found a share of {share} of the links with beams of {beam}")
        beam *= 2


def near_vectors(embeddings: DataFrame, least: float = 0.9, beam: int = BEAM, shards: int = SHARDS) -> DataFrame:
    """Vectors (vec_id, embedding) -> one row per vector: vec_id, n_links,
    component_id, kept."""
    v = F.col("vector")
    rows = stored(embeddings.select(embeddings["vec_id"].alias("vec_id"), embeddings["embedding"].alias("vector")).select(
        "vec_id", "vector", F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("vector"), v).alias("h2"), _usable(v).alias("usable")),
        "hnsw-vectors")
    one = rows.where("usable").groupBy("h1", "h2", "vector").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"))
    nodes = stored(running_total(one, ["h1", "h2"], F.lit(1), "node", "hnsw-distinct").withColumn(
        "size", F.size("vector")), "hnsw-nodes")
    count, size = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("size").cast("long") * 8), F.lit(0))).first()
    found = _links(nodes, least, max(shards, -(-count // SHARD_ROWS), -(-size // SHARD_BYTES)), beam, count)
    partners = found.where("kind = 0").groupBy(F.col("a").alias("from")).agg(F.sum("n").alias("partners"))
    links = found.where("kind = 1").select("a", "b")
    grouped = nodes.join(components(links).withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left").select(
        "node", "h1", "h2", "n", "least_id", F.coalesce("component", "node").alias("component"))
    # stored: the join deals both sides anew, and Spark may split a large group
    ids = stored(grouped.groupBy(F.col("component").alias("i_component")).agg(F.min("least_id").alias("component_id")), "hnsw-ids")
    known = grouped.join(ids, F.col("component") == F.col("i_component")).join(
        partners, F.col("node") == F.col("from"), "left").select(
        F.col("h1").alias("k1"), F.col("h2").alias("k2"),
        (F.col("n") - 1 + F.coalesce("partners", F.lit(0).cast("long"))).alias("links"), F.col("component_id").alias("k_id"))
    out = rows.select("vec_id", "h1", "h2", "usable").join(
        known, F.col("usable") & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.when(F.col("usable"), F.col("k_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))

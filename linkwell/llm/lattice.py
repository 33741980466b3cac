"""Near-duplicate vectors by E8 lattice hashing with exact cosine checks.

Each of TABLES tables projects the unit vector by a random orthonormal map to BLOCKS x 8 dimensions,
scales it and decodes each block of eight to its nearest point of the E8 lattice. A vector is posted
under its own cell and, block by block, under the neighbouring cell (of the lattice's 240) nearest to
it. Vectors of one label that share a cell are compared by cosine in double precision.

Copies of one vector are one class, so they never form pairs. A cell's members are dealt into chunks
and each pair of chunks is one block of work for one matrix product; no pair is emitted, only each
member's number of links and the least member of its connected part of the block. A pair that shares
several cells is counted in the first of them. No cell is capped: a large one is more blocks.

Cases: a vector that is null, empty, zero or holds null or non-finite parts, or whose label is null,
links with nothing; labels may be of any type; vectors of different lengths are not compared, those
of any finite size are; equal rows are separate vectors that link; rows with one id are one node of
the components; a null id gives a null component; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components
from .textkit import U, mix

TABLES, BLOCKS, SCALE = 8, 2, 5.0
PROBES = 1 << BLOCKS  # each block's own or neighbouring cell
CHUNK = 256  # members of a cell that one side of a block of work holds


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    whole = [np.eye(8, dtype=int)[i] * a + np.eye(8, dtype=int)[j] * b for i in range(8) for j in range(i) for a in (2, -2) for b in (2, -2)]
    half = [np.array(s) for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(whole + half)


_STEPS = _shortest()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates and an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    if len(odd):
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(axis=1)
        row = np.arange(len(odd))
        near[odd, worst] += np.where(off[row, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubled nearest E8 points of the rows of x, and the doubled nearest neighbours of those points."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    own = np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)
    own2 = np.rint(2 * own).astype(np.int64)
    return own2, own2 + _STEPS[((x - own) @ _STEPS.T).argmax(axis=1)]


def _maps(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The tables' projections (dims x all) and the multipliers that hash a point; the same in every task."""
    rng = np.random.default_rng(88)
    width = 8 * BLOCKS
    maps = []
    for _ in range(TABLES):
        m = rng.normal(size=(dims, width))
        maps.append((np.linalg.qr(m)[0] if dims >= width else m / np.sqrt(width)) * SCALE)
    return np.concatenate(maps, axis=1), rng.integers(1, 1 << 62, size=(8,)).astype(U) * U(2) + U(1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by their largest part first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cells(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Keys of each vector's cells, (vectors, TABLES, PROBES)."""
    n, dims = vectors.shape
    maps, multipliers = _maps(dims)
    unit = _unit(vectors)
    points = (unit @ maps).reshape(n, TABLES, BLOCKS, 8)
    keys = np.empty((n, TABLES, PROBES), U)
    head = mix(labels.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15) + U(dims))
    for t in range(TABLES):
        hashes = []
        for b in range(BLOCKS):
            hashes.append([mix((p.view(U) * multipliers).sum(axis=1, dtype=U) + U(b + 1)) for p in decode(points[:, t, b])])
        for probe in range(PROBES):
            h = head + U(t)
            for b in range(BLOCKS):
                h = mix(h ^ hashes[b][probe >> b & 1])
            keys[:, t, probe] = h
    return keys.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as rows."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _postings(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column(2)))
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                keys = cells(_matrix(part.column(2)), np.asarray(part.column(1)))
                flat = keys.reshape(len(keys), -1)
                ids = np.repeat(np.asarray(part.column(0)), flat.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(flat.ravel()), pa.array(ids)], ["key", "cls"])

    return classes.select("cls", "label", "embedding").mapInArrow(run, "key bigint, cls bigint")


def _first_shared(ka: np.ndarray, kb: np.ndarray, key: int) -> np.ndarray:
    """For pairs of key rows (pairs, TABLES, PROBES), whether key is the first that both hold: by table, then by value."""
    ok = np.ones(len(ka), bool)
    table = -1
    for t in range(TABLES):
        if (ka[:, t] == key).any():
            table = t
            break
    for t in range(table + 1):
        same = ka[:, t, :, None] == kb[:, t, None, :]
        if t == table:
            same &= ka[:, t, :, None] < key
        ok &= ~same.any(axis=(1, 2))
    return ok


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id of each member's connected part, by repeated minimum over links."""
    root = ids.copy()
    far = np.iinfo(np.int64).max
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], far).min(axis=1))
        if (new == root).all():
            return root
        root = new


def _compared(members: DataFrame, least: float) -> DataFrame:
    """(cls, links, root) from rows of blocks of work that arrive sorted by block."""

    def block(key: int, i: int, j: int, chunk, ids, size, vectors, keys):
        unit = _unit(vectors)
        linked = unit @ unit.T >= least
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= chunk[:, None] != chunk[None, :]  # pairs within a chunk belong to its own block
        if not linked.any():
            return None
        links = np.zeros(len(ids), np.int64)
        a, b = np.nonzero(np.triu(linked))
        for s in range(0, len(a), 50_000):
            x, y = a[s : s + 50_000], b[s : s + 50_000]
            first = _first_shared(keys[x], keys[y], key)
            np.add.at(links, x[first], size[y[first]])
            np.add.at(links, y[first], size[x[first]])
        hold = linked.any(axis=1)
        return ids[hold], links[hold], _roots(linked, ids)[hold]

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            key, i, j = (np.asarray(table.column(c)) for c in ("key", "i", "j"))
            bounds = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            done = int(bounds[-1]) if len(bounds) else 0
            if done:
                yield from results(table.slice(0, done), np.concatenate(([0], bounds)))
            rest = table.slice(done)
        if rest is not None and rest.num_rows:
            yield from results(rest, np.array([0, rest.num_rows]))

    def results(table: pa.Table, bounds: np.ndarray):
        out = []
        columns = [np.asarray(table.column(c)) for c in ("key", "i", "j", "chunk", "cls", "size")]
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e - s < 2:
                continue
            rows = table.slice(s, e - s)
            key, i, j, chunk, ids, size = (c[s:e] for c in columns)
            keys = np.asarray(rows.column("cells").combine_chunks().flatten()).reshape(e - s, TABLES, PROBES)
            found = block(int(key[0]), int(i[0]), int(j[0]), chunk, ids, size, _matrix(rows.column("embedding").combine_chunks()), keys)
            if found:
                out.append(found)
        if out:
            ids, links, roots = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(roots)], ["cls", "links", "root"])

    return members.mapInArrow(run, "cls bigint, links bigint, root bigint")


def _with_cells(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column(2)))
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                keys = cells(_matrix(part.column(2)), np.asarray(part.column(1)))
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, TABLES * PROBES, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "cells"])

    return classes.select("cls", "label", "embedding", "size").mapInArrow(run, "cls bigint, label bigint, embedding array<double>, size bigint, cells array<bigint>")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row."""
    vector = F.col(vector_col).cast("array<double>")
    label = F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))  # of any type; equal labels have equal hashes
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), label.alias("label"), vector.alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    rows = rows.withColumn("f1", F.when(usable, F.xxhash64("label", "embedding"))).withColumn("f2", F.when(usable, F.xxhash64(F.lit(1), "embedding", "label")))
    classes = stage(
        rows.filter("f1 is not null").groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("embedding").alias("embedding")),
        "classes",
    )
    classes = classes.withColumn("cls", F.col("f1"))
    posted = _postings(classes).distinct()
    shared = posted.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    parts = F.ceil(F.col("members") / CHUNK).cast("int")
    members = posted.join(shared, "key").withColumn("parts", parts).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    members = members.withColumn("other", other).select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "cls")
    work = members.join(_with_cells(classes), "cls").select("key", "i", "j", "chunk", "cls", "size", "embedding", "cells")
    work = work.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cls")
    found = stage(_compared(work, least), "linked")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    name = classes.select("cls", "rep")
    edges = found.filter("cls <> root").select("cls", "root").distinct()
    edges = edges.join(name, "cls").join(name.toDF("root", "root_rep"), "root")
    named = components(edges, "rep", "root_rep").select(F.col("id").alias("rep"), "component_id")
    by_class = classes.select("f1", "f2", "cls", "rep", "size").join(links, "cls", "left").join(named, "rep", "left")
    out = rows.select("id", "f1", "f2").join(by_class, ["f1", "f2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "rep", "id"))
    return out.select(
        F.col("id").alias(id_col),
        (F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )

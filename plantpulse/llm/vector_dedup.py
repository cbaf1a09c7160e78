"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group.

Vectors that are equal within a label form one node, so copies cost nothing. A spherical k-means fitted on a bounded
sample gives at most ``MAX_CELLS`` directions; every node lives in the cell of its nearest one. A linked pair can fall on
two sides of a border between cells. Unit vectors with cosine of at least ``t`` lie within sqrt(2 - 2t) of each other, so
their distances to the plane between the two cells add up to at most that, and one of the two lies within half of it. Each
node visits the cells whose border is that near. So no link is lost: the sample decides the cost, never the result.

Cells of a label are cut into blocks of about ``BLOCK`` nodes; a task multiplies two blocks and keeps no pairs: it returns the
number of links of each node (weighted with the copies behind the partner) and a spanning forest of the block's links.
Components follow from the forests. A cell that grows with the data costs more tasks, not larger ones.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components, or whose label is null, has no
links and is its own component. Vectors of different lengths are never linked. Rows that repeat an id are vectors of their
own, so equal rows link each other. A null id counts as larger than any other; a component of null ids has a null id.
``kept`` is true where the id is the component's. An empty table gives an empty result. Other columns play no part.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import hash_sample, join_groups, table
from plantpulse.llm.jaccard_join import components
from plantpulse.session import broadcast_if_small, checkpointed

THRESHOLD = 0.98
# Vectors that the cells are fitted on, aim for the nodes of a label in one cell, bound of cells, rounds of k-means.
SAMPLE, CELL_NODES, MAX_CELLS, ROUNDS = 20_000, 2048, 2048, 8
# Nodes of one side of a block product: 2 * BLOCK vectors and BLOCK**2 products in a task.
BLOCK = 2048


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; the largest component goes first so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_k_means(vectors: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit directions of at most ``cells`` cells. Starts are chosen far apart (each the vector least like the ones
    before among a seeded few); a cell without vectors is dropped."""
    if not len(vectors):
        return vectors
    rng = np.random.default_rng(seed)
    starts = [int(rng.integers(len(vectors)))]
    closest = vectors @ vectors[starts[0]]
    while len(starts) < min(cells, len(vectors)):
        tried = rng.integers(len(vectors), size=8)
        starts.append(int(tried[np.argmin(closest[tried])]))
        closest = np.maximum(closest, vectors @ vectors[starts[-1]])
    centres = vectors[starts]
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        lengths = np.sqrt((sums * sums).sum(axis=1))
        centres = sums[lengths > 1e-9] / lengths[lengths > 1e-9, None]
    return np.unique(centres, axis=0)


def cells_of(vectors: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, near): the cell of each unit vector, and a mask of the other cells whose border is within half of the
    largest distance of a linked pair."""
    likeness = vectors @ centres.T
    home = np.argmax(likeness, axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))
    gap = likeness[np.arange(len(vectors)), home][:, None] - likeness
    near = gap <= (np.sqrt(2 - 2 * threshold) / 2 + 1e-9) * apart[home] + 1e-9
    near[np.arange(len(vectors)), home] = False
    return home, near


def links(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    return left @ right.T >= threshold


def forest(hit: np.ndarray) -> np.ndarray:
    """For each row and column of a link matrix (rows first) the smallest member of its component."""
    a, b = np.nonzero(hit)
    b = b + hit.shape[0]
    label = np.arange(sum(hit.shape))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)  # roots hang below smaller ones
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while (jumped := new[new]).tolist() != new.tolist():
            new = jumped
        if (new == label).all():
            return label
        label = new


def _valid(df: DataFrame) -> DataFrame:
    """id, label, digest of the vector (null if it links with nothing), its length, the vector."""
    kinds = dict(df.dtypes)

    def run(batches):
        for batch in batches:
            digests, sizes = [], []
            for label, vector in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                values = vector.values
                digest = None
                if label is not None and values is not None and len(values) and not values.null_count:
                    row = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zeros
                    if np.isfinite(row).all() and row.any():
                        digest = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
                digests.append(digest), sizes.append(0 if digest is None else len(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), batch.column(2)],
                                             names=["id", "label", "digest", "dims", "vector"])

    return df.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, digest binary, dims int, vector {kinds['vector']}")


def _matrix(column) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return unit(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _placed(nodes: DataFrame, centres: np.ndarray, threshold: float) -> DataFrame:
    """A row for each node in its cell (with the cells it visits), and one for each visit (with the cell it is from).
    Vectors of another length than the centres live in cell 0 of their own length."""
    label = dict(nodes.dtypes)["label"]
    kind = dict(nodes.dtypes)["vector"]

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                sizes = part.column(2).to_numpy()
                home, near = np.zeros(len(part), dtype=np.int64), np.zeros((len(part), max(1, len(centres))), dtype=bool)
                fitting = np.flatnonzero(sizes == (centres.shape[1] if len(centres) else 0))
                if len(fitting):
                    home[fitting], near[fitting] = cells_of(_matrix(part.column(4).take(pa.array(fitting))), centres, threshold)
                who, where = np.nonzero(near)
                rows = pa.array(np.concatenate([np.arange(len(part)), who]))
                offsets = pa.array(np.concatenate([np.cumsum([0, *near.sum(axis=1)]), np.full(len(who), len(who))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k).take(rows) for k in (0, 1, 2, 3)], pa.array(np.concatenate([home, where]), pa.int32()),
                     pa.array(np.concatenate([home, home[who]]), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(where, pa.int32())),
                     part.column(4).take(rows)],
                    names=["node", "label", "dims", "copies", "cell", "origin", "visits", "vector"])

    return nodes.select("node", "label", "dims", "copies", "vector").mapInArrow(
        run, f"node long, label {label}, dims int, copies long, cell int, origin int, visits array<int>, vector {kind}")


def _compare(threshold: float):
    """Group function of a block product. Rows of side 0 and 1 are the two blocks; side 2 are visitors of the cell."""
    def run(key, rows):
        side = rows.column("side").to_numpy()
        left, right = rows.filter(pa.array(side == 0)), rows.filter(pa.array(side != 0))
        alone = key[-1].as_py() == key[-2].as_py()  # a block with itself
        right = left if alone else right
        out = {"node": np.zeros(0, dtype=np.int64), "links": np.zeros(0, dtype=np.int64), "root": np.zeros(0, dtype=np.int64)}
        if len(left) and len(right):
            hit = links(_matrix(left.column("vector")), _matrix(right.column("vector")), threshold)
            if alone:
                np.fill_diagonal(hit, False)
            elif (side == 2).any():
                # A pair that meets in both cells counts in the one with the smaller number.
                cell, origin = left.column("cell")[0].as_py(), right.column("origin").to_numpy()
                visits = left.column("visits").combine_chunks()
                who = np.repeat(np.arange(len(left)), visits.value_lengths().to_numpy())
                both = np.zeros((len(left), max(origin.max(), cell) + 1), dtype=bool)
                to = visits.flatten().to_numpy()
                inside = to < both.shape[1]
                both[who[inside], to[inside]] = True
                hit &= ~(both[:, origin] & (origin < cell)[None, :])
            nodes = np.concatenate([left.column("node").to_numpy(), right.column("node").to_numpy()])
            copies = [t.column("copies").to_numpy() for t in (left, right)]
            counts = np.concatenate([hit @ copies[1], np.zeros(len(right), dtype=np.int64) if alone else hit.T @ copies[0]])
            roots = nodes[forest(hit)]
            told = (counts > 0) | (roots != nodes)
            out = {"node": nodes[told], "links": counts[told], "root": roots[told]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
                 block: int = BLOCK, cell_nodes: int = CELL_NODES, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``df``: id, ``n_links``, ``component_id``, ``kept``."""
    rows = checkpointed(_valid(df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))))
    total, full = rows.count(), rows.filter("digest is not null")
    nodes = full.groupBy("label", "digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("dims").alias("dims"), F.first("vector").alias("vector"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))

    # Cells are fitted on a sample of the vectors that have the most common length.
    lengths = nodes.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(1).collect()
    centres = np.zeros((0, 0))
    if lengths:
        usual = nodes.filter(F.col("dims") == lengths[0].dims)
        largest = usual.groupBy("label").count().agg(F.max("count")).first()[0]
        seen = hash_sample(usual, "digest", sample, lengths[0]["count"]).select("digest", "vector").orderBy("digest").toArrow()
        wanted = min(MAX_CELLS, max(1, -(-largest // cell_nodes)), max(1, len(seen) // 4))
        if len(seen):
            centres = spherical_k_means(_matrix(seen.column("vector")), wanted)

    placed = checkpointed(_placed(nodes, centres, threshold))
    key = ["label", "dims", "cell"]
    home = F.col("cell") == F.col("origin")
    sizes = placed.groupBy(*key).agg(F.count_if(home).alias("homes"), F.count_if(~home).alias("guests"))
    sizes = checkpointed(sizes.filter("homes > 0").select(
        *key, F.ceil(F.col("homes") / block).cast("int").alias("parts"), F.ceil(F.col("guests") / block).cast("int").alias("guest_parts")))
    cut = placed.join(broadcast_if_small(sizes, sizes.count()), key)
    part = F.pmod(F.xxhash64("node"), F.when(home, F.col("parts")).otherwise(F.col("guest_parts"))).cast("int")
    cut = cut.withColumn("part", part)
    # Tasks (x, y): blocks x <= y of the cell, or block x and the visitors' block -1 - y.
    own = F.flatten(F.array(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(
            F.least("part", k).alias("x"), F.greatest("part", k).alias("y"), F.when(F.col("part") <= k, 0).otherwise(1).alias("side"))),
        F.when(F.col("guest_parts") > 0, F.transform(F.sequence(F.lit(1), F.col("guest_parts")), lambda k: F.struct(
            F.col("part").alias("x"), (-k).alias("y"), F.lit(0).alias("side")))).otherwise(F.array())))
    guest = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(k.alias("x"), (-1 - F.col("part")).alias("y"), F.lit(2).alias("side")))
    tasks = cut.withColumn("t", F.explode(F.when(home, own).otherwise(guest))).select(
        *key, "t.x", "t.y", "t.side", "node", "copies", "origin", "visits", "vector")
    found = checkpointed(tasks.groupBy(*key, "x", "y").applyInArrow(_compare(threshold), "node long, links long, root long"))

    labels = components(found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = checkpointed(nodes.select("node", "label", "digest", "first", "copies").join(
        labels.withColumnRenamed("label", "component"), "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node")))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = checkpointed(grouped.join(smallest, "component").select(
        F.struct("label", "digest").alias("key"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    linked = join_groups(full.select("id", F.struct("label", "digest").alias("key")), named, "key", "copies", total).select("id", "n_links", "component_id")
    alone = rows.filter("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, (SELECT min(y) FROM reach r WHERE r.x = vec_id) AS component_id,
  vec_id = (SELECT min(y) FROM reach r WHERE r.x = vec_id) AS kept FROM embeddings
"""

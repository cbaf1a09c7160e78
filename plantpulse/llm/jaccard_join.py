"""Near-duplicate documents by an exact Jaccard join of word n-grams with adaptive multi-match prefixes.

Two sets with similarity of at least ``t`` share at least ``t`` times the larger set. Under any order of all shingles
that is the same for every document, the first ``n - ceil(t n) + k`` shingles of two such sets share at least ``k``.
Each document picks its own ``k``: from the estimated number of candidates that its shortest prefix would meet, a longer
prefix is chosen, and a pair is verified only if it shares the smaller ``k`` of its two documents.

The order puts rare shingles first. Frequencies come from a count sketch over all documents of fixed size (2**22 cells,
16 MB, the only thing that is gathered and broadcast besides size-checked ids); shingles in a frequent cell go to the
end. The order decides costs only, never results.

Steps: 1. set size, set hash and sketch of every document; documents with equal sets form one node. 2. prefixes of the
nodes; shingles that only one node has are dropped by a bitmap filter. 3. Each node is verified against the node that
leads most of its shingle lists (the one with the fewest rare shingles of its own), and linked nodes are joined into components. This settles groups of near copies with
one comparison a member. 4. Lists that still hold several components yield all pairs across components that the
sizes, the number of shared prefix shingles and the triangle inequality to a common leader allow; these are verified too. No pair
within one component is ever listed, so no link between components is lost and no group is squared.

Defined cases: words are runs of non-blank characters, A-Z lower-cased. Fewer than ``width`` words form one shingle; a
null text or one without words has an empty set and is linked with nothing. Rows that repeat an id are separate
documents with one id. A null id counts as larger than any other. Shingles are compared by 64-bit hashes. An empty
table gives an empty result. Other columns play no part.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import BLANKS, chunks, join_groups, mix64, table, with_ids, without_ids
from plantpulse.llm.exact_dedup import cells_for, hit_cells, marked
from plantpulse.session import checkpointed, discard

WIDTH, PERCENT = 5, 80
CELLS, CELLS_PER_CHUNK = 1 << 22, 1 << 12
# A cell is frequent if it holds this many more shingles than an average cell (plus eight standard deviations).
FREQUENT = 32
# Estimated candidates above which a document lengthens its prefix, by these shares of its set. A pair must then share as
# many more shingles, which tells copies just below the threshold apart without reading their sets.
COSTS, LONGER = (64, 1024, 16384), (0.02, 0.1, 0.3)

# Leader rounds: parts of a list with a leader each, and leaders that a node is verified against.
ROUNDS = ((1, 1), (8, 4))

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[ord(c) for c in BLANKS]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_table(size: int):
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < size:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def _word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash per word: a polynomial of its bytes, made free of its place in the text, then mixed."""
    codes = np.frombuffer(data, dtype=np.uint8)
    solid = ~_BLANK[codes]
    edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_table(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts], 1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    parts = [_word_hashes(part) for part in chunks((text or "").encode().lower()) if part]
    words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    if not len(words):
        return words
    size = min(width, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mix64(out ^ words[k: len(words) - size + 1 + k], k + 2)
    return np.unique(out)


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (mix64(tokens, 77) >> np.uint64(64 - 22)).astype(np.int64)


def _set_hash(tokens: np.ndarray) -> int:
    return int((mix64(tokens, 99).sum(dtype=np.uint64) ^ np.uint64(len(tokens))).astype(np.int64))


def _spare(n: int, percent: int) -> int:
    """Shingles that a partner may lack: n - ceil(percent n / 100)."""
    return n - -(-percent * n // 100)


def _signatures(df: DataFrame, width: int) -> DataFrame:
    """Rows of kind 0: id, set size, set hash of each document. Rows of kind 1: parts of the sketch of each task."""
    def run(batches):
        sketch, held, waiting = np.zeros(CELLS, dtype=np.uint32), [], 0

        def settle():
            nonlocal sketch, held, waiting
            if held:
                sketch += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
            held, waiting = [], 0

        for batch in batches:
            sizes, keys = [], []
            for text in batch.column(1):
                tokens = shingles(text.as_py(), width)
                sizes.append(len(tokens)), keys.append(_set_hash(tokens))
                held.append(_cells(tokens))
                waiting += len(tokens)
                if waiting > 1_000_000:
                    settle()
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        settle()
        used = [c for c in range(CELLS // CELLS_PER_CHUNK) if sketch[c * CELLS_PER_CHUNK:(c + 1) * CELLS_PER_CHUNK].any()]
        packed = [zlib.compress(sketch[c * CELLS_PER_CHUNK:(c + 1) * CELLS_PER_CHUNK].tobytes(), 1) for c in used]
        n = len(used)
        yield pa.RecordBatch.from_arrays(
            [pa.array([1] * n, pa.int32()), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
             pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=names)

    names = ["kind", "id", "n", "node", "chunk", "payload"]
    id_kind = df.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(id_kind)
    return df.mapInArrow(run, f"kind int, id {id_kind.simpleString()}, n long, node long, chunk int, payload binary")


def _merged_sketch(parts: DataFrame) -> np.ndarray:
    """Sum of the sketches of all tasks. Each task of the second stage adds up the chunks dealt to it, row by row."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(payload), dtype=np.uint32).astype(np.int64)
                if chunk in sums:
                    sums[chunk] += counts
                else:
                    sums[chunk] = counts
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "payload"])

    dealt = parts.repartition(32, "chunk").mapInArrow(run, "chunk int, payload binary")
    sketch = np.zeros(CELLS, dtype=np.int64)
    for row in dealt.toLocalIterator():  # CELLS / CELLS_PER_CHUNK rows of fixed size
        sketch[row.chunk * CELLS_PER_CHUNK:(row.chunk + 1) * CELLS_PER_CHUNK] = np.frombuffer(row.payload, dtype=np.int64)
    return sketch


def prefix(tokens: np.ndarray, counts: np.ndarray, mean: float, frequent: float, percent: int, costs=COSTS):
    """(prefix, required matches) of a sorted set, given the sketch count of each of its shingles."""
    # Class 0: not frequent; then one class for each doubling. Within a class the hash decides.
    classes = np.where(counts >= frequent, 1 + np.floor(np.log2(np.maximum(counts, 1) / frequent)), 0)
    order = np.argsort(classes, kind="stable")
    shortest = _spare(len(tokens), percent) + 1
    cost = float(np.maximum(counts[order[:shortest]] - mean - 1, 0).sum())
    level = sum(cost > c for c in costs)
    need = min(1 + (max(1, int(LONGER[level - 1] * len(tokens))) if level else 0), len(tokens) - shortest + 1)
    return tokens[order[: shortest + need - 1]], need


def _prefixes(df: DataFrame, sketch: np.ndarray, width: int, percent: int) -> DataFrame:
    mean = float(sketch.mean())
    frequent = mean + FREQUENT + 8 * mean**0.5
    shared = df.sparkSession.sparkContext.broadcast(np.minimum(sketch, 2**31 - 1).astype(np.int32))

    def run(batches):
        for batch in batches:
            tokens, nodes, sizes, needs, places = [], [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py(), width)
                if len(own):
                    first, need = prefix(own, shared.value[_cells(own)], mean, frequent, percent)
                    tokens.append(first.view(np.int64))
                    nodes.append(np.full(len(first), _set_hash(own)))
                    sizes.append(np.full(len(first), len(own)))
                    needs.append(np.full(len(first), need, dtype=np.int32))
                    places.append(np.arange(len(first), dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (tokens, nodes, sizes, needs, places)],
                                                 names=["token", "node", "n", "need", "place"])

    return df.mapInArrow(run, "token long, node long, n long, need int, place int")


def _sets(df: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [r for r in (shingles(t.as_py(), width) for t in batch.column(1)) if len(r)]
            offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_hash(r) for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["node", "tokens"])

    return df.mapInArrow(run, "node long, tokens array<long>")


def _least_shared(percent: int):
    """Smallest number of prefix shingles that a linked pair shares. Of the two prefixes the one that ends first holds all
    common shingles up to its end, so the sets share at most these and what lies behind that prefix."""
    together = F.ceil(percent * (F.col("a_n") + F.col("b_n")) / (100 + percent))
    own = lambda x: F.col(f"{x}_need") - F.ceil(percent * F.col(f"{x}_n") / 100)
    return F.greatest(together + F.least(own("a"), own("b")), F.least("a_need", "b_need"))


def _latest_first(n, other, percent: int):
    """Latest place of the first shared shingle in the prefix of a set of ``n``, given the partner's size. It does not
    depend on how long the prefixes are: what a longer one adds to its length it adds to the shingles that must follow."""
    ceil = lambda x: F.ceil(percent * x / 100)
    return n - ceil(n) + F.greatest(ceil(n), ceil(other)) - F.ceil(percent * (n + other) / (100 + percent))


def _mixed(rows: DataFrame) -> DataFrame:
    """The lists that hold more than one component."""
    open_ones = rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("token")
    return rows.join(open_ones, "token", "left_semi")


def _led(lists: DataFrame, salts: int, best: int, percent: int) -> DataFrame:
    """Pairs (a, b) of each node with the ``best`` leaders of another component that lead most of its lists, if those
    lists suffice for a link. The members of a list are dealt to ``salts`` parts; a part is led by the document that has
    the fewest rarer shingles before this one: the one closest to what all copies have in common."""
    salt = F.pmod(F.xxhash64("node", F.lit(salts)), F.lit(salts))
    leaders = lists.groupBy("token", salt).agg(F.min(F.struct("place", "node", "n", "need", "label")).alias("b")).select("token", "b.*")
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "need", "label")]
    met = lists.select("token", *side("a")).join(leaders.select("token", *side("b")), "token").filter(
        (F.col("a_label") != F.col("b_label")) & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")))
    counted = met.groupBy(*[f"{x}_{c}" for x in "ab" for c in ("node", "n", "need")]).agg(F.count("*").alias("count"))
    ranked = counted.filter(F.col("count") >= _least_shared(percent)).groupBy(F.col("a_node").alias("a")).agg(
        F.slice(F.sort_array(F.collect_list(F.struct("count", F.col("b_node").alias("b"))), asc=False), 1, best).alias("top"))
    return ranked.select("a", F.explode("top").alias("top")).select("a", "top.b")


def _early_enough(lists: DataFrame, percent: int) -> DataFrame:
    """Entries of the lists that can be the first shingle that two linked documents share. Many more must follow it, so
    it stands early in the prefix; how early depends on the partner's size, and the sizes in the list bound that. In a
    group of much edited copies the shingles that all have in common stand late, so this keeps long lists short."""
    sizes = lists.groupBy("token").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    n = F.col("n")
    low, high = F.greatest(F.col("lo"), F.ceil(percent * n / 100)), F.least(F.col("hi"), F.floor(100 * n / percent))
    latest = F.greatest(_latest_first(n, low, percent), _latest_first(n, high, percent)) + 1
    return lists.join(sizes, "token").filter(F.col("place") <= latest).select(*lists.columns)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Adds ``near`` (similarity reached) and ``apart`` (one minus similarity) to pairs (a, b)."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("__x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("__y"))
    counted = pairs.join(left, "a").join(right, "b").select(
        "a", "b", F.size(F.array_intersect("__x", "__y")).alias("both"), (F.size("__x") + F.size("__y")).alias("total"))
    union = F.col("total") - F.col("both")
    return counted.select("a", "b", (100 * F.col("both") >= percent * union).alias("near"), (1 - F.col("both") / union).alias("apart"))


def _sets_of(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, repeated: bool) -> DataFrame:
    """Shingle sets of the nodes in ``pairs``, read again from one document of each, written once."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = checkpointed(nodes.join(classes, "node").select("first").filter("first is not null").distinct().withColumnRenamed("first", "id"))
    sets = _sets(with_ids(docs, first, "id").unionByName(docs.filter(F.col("id").isNull())), width)
    return checkpointed(sets.dropDuplicates(["node"]) if repeated else sets)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): label is the smallest node that links reach. Labels spread along
    the links and jump to the label of the label, so long chains take a logarithmic number of rounds."""
    both = checkpointed(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = checkpointed(spread.join(jump, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        if moved.filter("label != old").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles``, ``component_id``."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = checkpointed(_signatures(docs, width))
    signed = out.filter("kind = 0").select("id", "n", "node")
    total = signed.count()
    full = signed.filter("n > 0")
    classes = checkpointed(full.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("size")))
    sketch = _merged_sketch(out.filter("kind = 1").select("chunk", "payload"))

    # Documents that lead no class add nothing to the lists.
    followers = checkpointed(signed.select("id").filter("id is not null").distinct().join(classes.select(F.col("first").alias("id")), "id", "left_anti"))
    every = checkpointed(_prefixes(without_ids(docs, followers, "id"), sketch, width, percent))
    shared = checkpointed(every.groupBy("token").count().filter("count > 1").select("token"))
    cells = cells_for(shared.count())
    bitmaps = checkpointed(hit_cells(shared, "token", cells))
    lists = checkpointed(marked(every, bitmaps, cells, "token").filter("__suspect").drop("__suspect").join(shared, "token", "left_semi"))
    discard(every, bitmaps, shared, followers)

    ids = signed.agg(F.count("id").alias("rows"), F.count_distinct("id").alias("ids"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    repeated = ids.rows != ids.ids or ids.nulls > 0

    def settled(tested, rows):
        """Lists with the component of each node, as far as the verified pairs tell."""
        labels = components(tested.filter("near").select("a", "b"))
        return rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    # Leader rounds: a node is verified against documents that lead many of its lists.
    state, tested = lists.withColumn("label", F.col("node")), None
    for salts, best in ROUNDS:
        chosen = checkpointed(_led(state, salts, best, percent))
        found = checkpointed(_verified(chosen, _sets_of(chosen, docs, classes, width, repeated), percent))
        tested = found if tested is None else tested.unionByName(found)
        before, state = state, checkpointed(_mixed(settled(tested, state)))
        if hasattr(before, "scratch_path"):  # the first state is a view of the lists, which are needed again
            discard(before)

    # Last round: pairs across components in lists that are not settled.
    known = tested.groupBy(F.col("a").alias("node")).agg(F.min_by(F.struct("b", "apart"), "apart").alias("k"))
    before = state
    state = state.join(known, "node", "left").select(
        "token", "node", "n", "need", "place", "label", F.coalesce("k.b", "node").alias("leader"), F.coalesce("k.apart", F.lit(0.0)).alias("apart"))
    led = checkpointed(state)
    early = checkpointed(_early_enough(led, percent))
    open_lists = checkpointed(_mixed(early))
    discard(before, led, early)
    a, b = (open_lists.select("token", *[F.col(c).alias(f"{x}_{c}") for c in open_lists.columns[1:]]) for x in "ab")
    slack, least = 1 - percent / 100 + 1e-9, _least_shared(percent)
    met = a.join(b, (a["token"] == b["token"]) & (F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label"))
                 & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
                 & ((F.col("a_leader") != F.col("b_leader")) | (F.abs(F.col("a_apart") - F.col("b_apart")) <= slack))
                 & (F.col("a_place") <= _latest_first(F.col("a_n"), F.col("b_n"), percent))
                 & (F.col("b_place") <= _latest_first(F.col("b_n"), F.col("a_n"), percent)))
    sides = [f"{x}_{c}" for x in "ab" for c in ("node", "n", "need")]
    pairs = checkpointed(met.select(*sides).distinct())
    discard(open_lists)
    heads = checkpointed(lists.groupBy("node").agg(F.collect_set("token").alias("head")))
    for x in "ab":
        pairs = pairs.join(heads.select(F.col("node").alias(f"{x}_node"), F.col("head").alias(f"{x}_head")), f"{x}_node")
    enough = pairs.filter(F.size(F.array_intersect("a_head", "b_head")) >= least).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    enough = checkpointed(enough.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    second = checkpointed(_verified(enough, _sets_of(enough, docs, classes, width, repeated), percent))
    labels = components(tested.unionByName(second).filter("near").select("a", "b"))

    grouped = checkpointed(classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    smallest = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    named = checkpointed(grouped.join(smallest, "label").select("node", "size", "component_id"))
    linked = join_groups(full, named, "node", "size", total).select("id", "n", "component_id")
    alone = signed.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS items FROM w),
t AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, (SELECT min(y) FROM reach r WHERE r.x = s.doc_id) AS component_id FROM s
"""

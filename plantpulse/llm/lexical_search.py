"""Ranked lexical search by pipelined term partitioning.

Documents are taken in slices. The postings of a slice are split by term among four owners, by how common the term is:
rare terms belong to the first owner, the commonest to the last. A bundle of items (at most ``BUNDLE``) visits the owners
one after another. At each it meets that owner's postings by cogroup, adds their integer contributions to its sparse
accumulators (one per item and document), and travels on with them. After the last owner every bundle gives up its best
documents per slice, and the best of all slices are chosen.

Accumulators are pruned without loss: a bundle carries, per item, the largest sum that the owners still ahead can add in
this slice. A document whose score plus that sum is below the present ``top``-th score of the slice cannot be among the
best, and no new accumulator is opened once that sum alone is below it. Ties are never pruned. As rare terms come first,
few accumulators reach the owners of common terms.

Slices hold at most ``SLICE`` documents, so a cogroup task sees BUNDLE x SLICE accumulators at most whatever the table
holds. Only the items' terms are gathered (broadcast when counted to be at most ``MAX_TERMS``; otherwise all postings are
kept and meet the items by a join). Statistics cover all documents.

Defined cases: a null text or one without terms has none and is never returned. Rows that repeat an id are documents of
their own; equal scores order by id, null ids last. Items that repeat an id are ranked each; an item without terms has no
rows. Empty tables give an empty result. Texts are read whole; other columns play no part.
"""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.llm.common import table
from plantpulse.session import broadcast_if_small, checkpointed

TOP = 10
# Documents of a slice, items of a bundle, item terms that a join may broadcast.
SLICE, BUNDLE, MAX_TERMS = 8192, 256, 200_000
# A slice is also closed at this many postings.
MAX_POSTINGS = 2_000_000
# Owners by the share of documents that hold a term: up to the first bound, up to the second, and so on.
OWNERS = (0.01, 0.05, 0.2)

# Fixed value: [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+ over the bytes of a UTF-8 text.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text: str | None) -> list[bytes]:
    return _TERM.findall((text or "").encode().lower())


def _slices(docs: DataFrame, wanted: frozenset | None, size: int) -> DataFrame:
    """Two kinds of rows for each slice: one without a term holds the ids and term counts of its documents, in order of
    id; the others hold a term's documents (places in that order) and occurrences. Every partition cuts its own slices."""
    id_kind = docs.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(id_kind)
    names = ["slice", "term", "ids", "lengths", "docs", "times"]
    kinds = [pa.int64(), pa.string(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def cut(number, held):
        order = sorted(range(len(held)), key=lambda k: (held[k][0] is None, held[k][0] if held[k][0] is not None else 0))
        posted = defaultdict(lambda: ([], []))
        for place, k in enumerate(order):
            for term, times in held[k][2].items():
                posted[term][0].append(place)
                posted[term][1].append(times)
        rows = [(number, None, [held[k][0] for k in order], [held[k][1] for k in order], None, None)]
        rows += [(number, term.decode(), None, None, *lists) for term, lists in posted.items()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        base, number, held, waiting = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(terms(text.as_py()))
                held.append((doc, found.total(), found if wanted is None else {t: found[t] for t in found.keys() & wanted}))
                waiting += len(held[-1][2])
                if len(held) == size or waiting > MAX_POSTINGS:
                    yield cut(base + number, held)
                    number, held, waiting = number + 1, [], 0
        if held:
            yield cut(base + number, held)

    id_name = id_kind.simpleString()
    return docs.mapInArrow(run, f"slice long, term string, ids array<{id_name}>, lengths array<long>, docs array<int>, times array<int>")


def _bundled(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(bundles, terms): the items of each bundle in order, and for each term and bundle the places of the items that
    hold it."""
    def cut(batches):
        for batch in batches:
            rows = [sorted(t.decode() for t in set(terms(text.as_py()))) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.string()))],
                                             names=["row", "item", "terms"])

    numbered = items.select(F.monotonically_increasing_id().alias("row"), "item", "text")
    cut_items = checkpointed(numbered.mapInArrow(cut, f"row long, item {items.schema['item'].dataType.simpleString()}, terms array<string>"))
    count = max(1, -(-cut_items.count() // size) * 2)  # hashed, so bundles hold about half of what they may
    placed = cut_items.withColumn("bundle", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
    bundles = placed.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("row", "item", "terms"))).alias("items"))
    bundles = checkpointed(bundles)
    flat = bundles.select("bundle", F.posexplode("items").alias("place", "x")).select("bundle", "place", F.explode("x.terms").alias("term"))
    return bundles.select("bundle", F.col("items.item").alias("items")), flat.groupBy("term", "bundle").agg(F.collect_list("place").alias("places"))


def least_needed(scores: np.ndarray, top: int) -> np.ndarray:
    """The present ``top``-th score of each row; 0 while fewer documents have one."""
    if scores.shape[1] < top:
        return np.zeros(len(scores), dtype=np.int64)
    return np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]


def _stage(owner: int, owners: int, top: int):
    """Cogroup function: adds the postings of one owner to the accumulators of a bundle."""
    def run(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        lists = {name: bundle.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
                 for name in ("most_item", "most_owner", "most", "at_item", "at_doc", "score")}
        items, docs = len(bundle.column("items")[0]), len(bundle.column("ids")[0])
        ahead = np.zeros((owners + 1, items), dtype=np.int64)
        np.add.at(ahead, (lists["most_owner"], lists["most_item"]), lists["most"])
        ahead = ahead[::-1].cumsum(axis=0)[::-1]  # what this owner and the later ones can add
        scores = np.zeros((items, docs), dtype=np.int64)
        scores[lists["at_item"], lists["at_doc"]] = lists["score"]
        unopened = (scores == 0) & (ahead[owner] < least_needed(scores, top))[:, None]
        for places, at, adds in zip(*(postings.column(c) for c in ("places", "docs", "adds")), strict=True):
            scores[np.ix_(places.values.to_numpy(), at.values.to_numpy())] += adds.values.to_numpy()
        scores[unopened] = 0
        if owner + 1 < owners:
            keep = (scores > 0) & (scores + ahead[owner + 1][:, None] >= least_needed(scores, top)[:, None])
        else:  # the best of each item; ties by place, which follows the id
            keep = np.zeros(scores.shape, dtype=bool)
            np.put_along_axis(keep, np.argsort(-scores, axis=1, kind="stable")[:, :top], True, axis=1)
            keep &= scores > 0
        at_item, at_doc = np.nonzero(keep)
        for name, values, kind in (("at_item", at_item, pa.int32()), ("at_doc", at_doc, pa.int32()), ("score", scores[keep], pa.int64())):
            bundle = bundle.set_column(bundle.schema.get_field_index(name), name, pa.array([values], pa.list_(kind)))
        return bundle

    return run


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", top: int = TOP,
           slice_rows: int = SLICE, bundle_items: int = BUNDLE, max_terms: int = MAX_TERMS) -> DataFrame:
    """The ``top`` best documents of each item: item id, ``rank``, document id, ``score``."""
    bundles, item_terms = _bundled(items.select(F.col(item_id).alias("item"), F.col(text_col).alias("text")), bundle_items)
    item_terms = checkpointed(item_terms)
    distinct = item_terms.select("term").distinct()
    known = distinct.limit(max_terms + 1).count()
    wanted = frozenset(r.term.encode() for r in distinct.collect()) if known <= max_terms else None
    cut = checkpointed(_slices(docs.select(F.col(doc_id).alias("id"), F.col(text_col).alias("text")), wanted, slice_rows))

    slices, postings = cut.filter("term is null").select("slice", "ids", "lengths"), cut.filter("term is not null")
    sums = slices.select(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n).alias("l"), F.size(F.filter("lengths", lambda n: n > 0)).alias("n"))
    totals = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    n = F.lit(totals.n)

    # Weights and owners of the items' terms; terms of weight 0 add nothing.
    held = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    owner = sum(((F.col("df") > share * n).cast("int") for share in OWNERS), F.lit(0))
    weighed = item_terms.join(held, "term").select(
        "term", "bundle", "places", owner.alias("owner"),
        F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long").alias("w")).filter("w > 0")
    weighed = checkpointed(weighed)

    # Integer contribution of each posting.
    m = F.expr(f"transform(lengths, k -> 10L + (90L * k * {totals.n}L) div {max(totals.l, 1)}L)")
    met = postings.select("slice", "term", "docs", "times").join(broadcast_if_small(weighed, weighed.count()), "term")
    met = met.join(slices.select("slice", m.alias("m")), "slice")
    adds = F.expr("transform(arrays_zip(docs, times), p -> w * ((1000000000L * p.times) div (1000L * p.times + 8L * m[p.docs])))")
    posted = checkpointed(met.select("slice", "bundle", "owner", "places", "docs", adds.alias("adds")))

    most = posted.select("slice", "bundle", "owner", F.explode("places").alias("item"), F.array_max("adds").alias("most")).groupBy(
        "slice", "bundle", "owner", "item").agg(F.sum("most").alias("most"))
    bounds = most.groupBy("slice", "bundle").agg(F.collect_list(F.struct("item", "owner", "most")).alias("x")).select(
        "slice", "bundle", F.col("x.item").alias("most_item"), F.col("x.owner").alias("most_owner"), F.col("x.most").alias("most"))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    travelling = bounds.join(bundles, "bundle").join(slices.select("slice", "ids"), "slice").select(
        "slice", "bundle", "items", "ids", "most_item", "most_owner", "most",
        empty("int").alias("at_item"), empty("int").alias("at_doc"), empty("long").alias("score"))
    owners, shape = len(OWNERS) + 1, travelling.schema
    for k in range(owners):
        own = posted.filter(F.col("owner") == k).select(*[F.col(c).alias(c) for c in ("slice", "bundle", "places", "docs", "adds")])
        # Every slice and bundle with postings has a bundle row, so no cogroup lacks its left side.
        travelling = travelling.groupBy("slice", "bundle").cogroup(own.groupBy("slice", "bundle")).applyInArrow(_stage(k, owners, top), shape)

    found = travelling.select("bundle", "items", "ids", F.explode(F.arrays_zip("at_item", "at_doc", "score")).alias("x")).select(
        "bundle", F.col("x.at_item").alias("place"), F.get("items", F.col("x.at_item")).alias("item"),
        F.get("ids", F.col("x.at_doc")).alias("doc"), F.col("x.score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("bundle", "place").orderBy(F.desc("score"), F.asc_nulls_last("doc"))))
    return ranked.filter(F.col("rank") <= top).select(
        F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_id), "score")


def query(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
totals AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM words),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM words)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, totals GROUP BY term, n_docs),
adds AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS score
  FROM tf JOIN weights USING (term), totals),
ranked AS (
  SELECT item_id, doc_id, CAST(sum(score) AS BIGINT) AS score FROM wanted JOIN adds USING (term) GROUP BY item_id, doc_id HAVING sum(score) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM ranked
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

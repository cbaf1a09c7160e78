"""Density clustering (DBSCAN) by grid cells.

A cell has the side ``eps / sqrt(dimensions)``, so all its points are neighbours of each other and a cell with
``min_samples`` points consists of core points. Most decisions are then made on cells, whose number depends on
the volume the data fills and not on the number of rows. What a cell's bounding box cannot decide is decided on
smaller and smaller boxes inside it, until the boxes are single points; pairs of points are never listed.

Labels follow the usual contract: the neighbour count includes the point, clusters are numbered by the smallest
row id among their core points, a border point takes the smallest number next to it, noise is -1."""

import itertools
import math

from pyspark.sql import functions as F

from plantpulse.operators.ranks import running_counts
from plantpulse.session import broadcast_if_small, checkpointed

SMALL_BOX = 32  # a box with at most this many points is refined to its points at once


def dbscan(df, row_id, cols, eps, min_samples, label="label"):
    """``df`` with an integer label column. ``row_id`` is unique and gives the row order."""
    return _Run(df, row_id, list(cols), eps, min_samples).labels(label)


class _Run:
    def __init__(self, df, row_id, cols, eps, min_samples):
        df = checkpointed(df)  # read by nearly every step
        self.df, self.row_id, self.dim, self.need = df, row_id, len(cols), min_samples
        self.eps2 = eps * eps
        self.side = eps / math.sqrt(self.dim)
        self.cols = cols
        self.points = df.select(
            F.col(row_id).alias("rid"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
        ).withColumn("cell", self._box_at(0))
        axes = range(self.dim)
        self.bounds = [f"{e}{i}" for e in ("lo", "hi") for i in axes]
        self.stats = [F.count(F.lit(1)).alias("n")] + [
            f(f"x{i}").alias(f"{e}{i}") for e, f in (("lo", F.min), ("hi", F.max)) for i in axes
        ]

    def _box_at(self, level):
        scale = float(1 << level)
        return F.array(*[F.floor(F.col(f"x{i}") * scale / self.side) for i in range(self.dim)])

    def _gap2(self, a="a_", b="b_"):
        """Smallest possible squared distance between two boxes."""
        return F.expr(" + ".join(
            f"pow(greatest(0D, {a}lo{i} - {b}hi{i}, {b}lo{i} - {a}hi{i}), 2D)" for i in range(self.dim)
        ))

    def _span2(self, a="a_", b="b_"):
        """Largest possible squared distance between two boxes."""
        return F.expr(" + ".join(
            f"pow(greatest({a}hi{i} - {b}lo{i}, {b}hi{i} - {a}lo{i}), 2D)" for i in range(self.dim)
        ))

    def _near(self, pairs):
        """Pairs of boxes that may hold neighbours, with ``sure`` when every pair of points is one."""
        return pairs.where(self._gap2() <= self.eps2).withColumn("sure", self._span2() <= self.eps2)

    @staticmethod
    def _prefixed(df, prefix, names):
        return df.select(*[F.col(n).alias(f"{prefix}{n}") for n in names])

    def _children(self, points, parents, level):
        """Boxes inside ``parents(box, n)`` of the level before. A box that is a single point already has itself
        as its only child; its key is longer than that of a grid box."""
        rows = parents.count()
        inside = points.withColumn("parent", self._box_at(level - 1)).join(
            broadcast_if_small(parents.select(F.col("box").alias("parent"), F.col("n").alias("_n")), rows), "parent"
        )
        point = F.array(F.col("rid").cast("long"), *[F.lit(0).cast("long")] * self.dim)
        child = F.when(F.col("_n") <= SMALL_BOX, point).otherwise(self._box_at(level))
        kids = inside.groupBy("parent", child.alias("box")).agg(*self.stats)
        if "lo0" not in parents.columns:
            return kids
        points_again = parents.where(F.size("box") > self.dim)
        return kids.unionByName(points_again.select(F.col("box").alias("parent"), "box", "n", *self.bounds))

    def labels(self, label):
        cells = checkpointed(self.points.groupBy("cell").agg(*self.stats, F.min("rid").alias("first")))
        n_cells = cells.count()
        few = lambda d: broadcast_if_small(d, n_cells)
        dense = cells.where(F.col("n") >= self.need)
        sparse = checkpointed(
            self.points.join(few(cells.where(F.col("n") < self.need).select("cell", "n")), "cell")
        )
        around = self._neighbour_cells(cells)

        core_sparse, border = self._split_sparse(sparse, around)
        core_points = (
            self.points.join(few(dense.select("cell")), "cell", "left_semi")
            .unionByName(core_sparse.select(*self.points.columns))
        )
        boxes = checkpointed(
            dense.select("cell", "n", *self.bounds, "first").unionByName(
                core_sparse.groupBy("cell").agg(*self.stats, F.min("rid").alias("first"))
            )
        )
        groups = self._connect(boxes, around, core_points)
        numbered = self._numbers(groups)
        border_group = self._adopt(border, around, boxes, groups, core_points)

        of_cell = few(dense.select("cell").join(numbered, "cell").select("cell", F.col("number").alias("_dense")))
        by_group = numbered.select("group", "number").distinct()
        of_point = (
            core_sparse.join(groups, "cell").select("rid", "group")
            .unionByName(border_group)
            .join(by_group, "group")
            .select(F.col("rid").alias("_rid"), F.col("number").alias("_sparse"))
        )
        of_point = broadcast_if_small(of_point, sparse.count())
        cell = F.array(*[F.floor(F.col(c).cast("double") * 1.0 / self.side) for c in self.cols])
        return (
            self.df.withColumn("cell", cell)
            .join(of_cell, "cell", "left")
            .join(of_point, F.col(self.row_id) == F.col("_rid"), "left")
            .withColumn(label, F.coalesce("_sparse", "_dense", F.lit(-1)).cast("int"))
            .select(*self.df.columns, label)
        )

    def _neighbour_cells(self, cells):
        """Pairs of different cells that are close enough to matter, with their distance in cells."""
        reach = math.ceil(math.sqrt(self.dim))
        offsets = [o for o in itertools.product(range(-reach, reach + 1), repeat=self.dim) if any(o)]
        text = ", ".join(f"array({', '.join(f'{v}L' for v in o)})" for o in offsets)
        names = ["cell", "n", *self.bounds]
        moved = self._prefixed(cells, "a_", names).withColumn("o", F.explode(F.expr(f"array({text})")))
        moved = moved.withColumn("b_cell", F.zip_with("a_cell", "o", lambda x, y: x + y))
        steps = F.aggregate("o", F.lit(0).cast("long"), lambda acc, v: acc + F.abs(v))
        pairs = moved.withColumn("steps", steps).drop("o").join(self._prefixed(cells, "b_", names), "b_cell")
        return checkpointed(self._near(pairs).select("a_cell", "b_cell", "steps"))

    def _point_boxes(self, sparse):
        """Sparse points as boxes of zero size."""
        return sparse.select(
            "rid", F.col("cell").alias("a_cell"), F.col("n").alias("own"),
            *[F.col(f"x{i}").alias(f"a_{e}{i}") for e in ("lo", "hi") for i in range(self.dim)],
        )

    def _with_target(self, queries, targets, on):
        return queries.join(
            targets.select(F.col(on).alias("b_on"), F.col("box").alias("b_box"), F.col("n").alias("b_n"),
                           *[F.col(c).alias(f"b_{c}") for c in self.bounds]), "b_on"
        )

    def _split_sparse(self, sparse, around):
        """Points of sparse cells as ``(core, rest)``: count neighbours until the answer is certain."""
        points = self._point_boxes(sparse)
        whole = self.points.groupBy("cell").agg(*self.stats).withColumn("box", F.col("cell"))
        pairs = self._near(
            self._with_target(points.join(around, "a_cell").withColumn("b_on", F.col("b_cell")), whole, "cell")
        )
        known = points.select("rid", F.col("own").alias("known"))
        decided, level = None, 0
        while True:
            pairs = checkpointed(pairs)
            seen = pairs.groupBy("rid").agg(
                F.coalesce(F.sum(F.when(F.col("sure"), F.col("b_n"))), F.lit(0)).alias("more"),
                F.coalesce(F.sum(F.when(~F.col("sure"), F.col("b_n"))), F.lit(0)).alias("open"),
            )
            count = checkpointed(
                known.join(seen, "rid", "left").select(
                    "rid", (F.col("known") + F.coalesce("more", F.lit(0))).alias("known"),
                    F.coalesce("open", F.lit(0)).alias("open"),
                )
            )
            is_open = (F.col("known") < self.need) & (F.col("known") + F.col("open") >= self.need)
            done = count.where(~is_open).select("rid", (F.col("known") >= self.need).alias("core"))
            decided = done if decided is None else decided.unionByName(done)
            known = count.where(is_open).select("rid", "known")
            if known.isEmpty():
                break
            level += 1
            pairs = pairs.where(~F.col("sure")).join(known.select("rid"), "rid", "left_semi")
            parents = pairs.select(F.col("b_box").alias("box"), F.col("b_n").alias("n")).distinct()
            keep = ["rid", *[f"a_{c}" for c in self.bounds], F.col("b_box").alias("b_on")]
            pairs = self._near(
                self._with_target(pairs.select(*keep), self._children(self.points, parents, level), "parent")
            )
        flags = checkpointed(sparse.join(decided, "rid"))
        return flags.where("core").drop("core", "n"), flags.where(~F.col("core")).drop("core")

    def _connect(self, boxes, around, core_points):
        """Group of each core cell; a group is named by the smallest row id of its core points."""
        names = ["cell", "n", *self.bounds, "first"]
        pairs = (
            around.where(F.col("a_cell") < F.col("b_cell"))
            .join(self._prefixed(boxes, "a_", names), "a_cell")
            .join(self._prefixed(boxes, "b_", names), "b_cell")
        )
        pairs = checkpointed(
            self._near(pairs).withColumn("a_box", F.col("a_cell")).withColumn("b_box", F.col("b_cell"))
        )
        groups = boxes.select("cell", F.col("first").alias("group"))
        groups = self._merge(groups, pairs.where("sure"))
        # Adjacent cells first: once they are joined, nearly all wider pairs lie within one group.
        for part in (pairs.where(F.col("steps") == 1), pairs.where(F.col("steps") > 1)):
            groups = self._refine(part.where(~F.col("sure")), groups, core_points)
        return groups

    def _apart(self, pairs, groups):
        """Pairs whose cells are still in different groups."""
        a = groups.select(F.col("cell").alias("a_cell"), F.col("group").alias("ga"))
        b = groups.select(F.col("cell").alias("b_cell"), F.col("group").alias("gb"))
        return pairs.join(a, "a_cell").join(b, "b_cell").where(F.col("ga") != F.col("gb")).drop("ga", "gb")

    def _refine(self, pairs, groups, core_points):
        level = 0
        while True:
            pairs = checkpointed(self._apart(pairs, groups))
            if pairs.isEmpty():
                return groups
            level += 1
            sides = [
                pairs.select(*[F.col(f"{s}_{c}").alias(c) for c in ("box", "n", *self.bounds)]) for s in "ab"
            ]
            parents = checkpointed(sides[0].unionByName(sides[1]).distinct())
            kids = checkpointed(self._children(core_points, parents, level))
            names = ["parent", "box", "n", *self.bounds]
            opened = (
                pairs.select("a_cell", "b_cell", F.col("a_box").alias("a_parent"), F.col("b_box").alias("b_parent"))
                .join(self._prefixed(kids, "a_", names), "a_parent")
                .join(self._prefixed(kids, "b_", names), "b_parent")
            )
            pairs = checkpointed(self._near(opened))
            groups = self._merge(groups, pairs.where("sure"))
            pairs = pairs.where(~F.col("sure"))

    def _merge(self, groups, joined):
        """Merge the groups of all joined cells: spread the smallest name, halving chains at every step."""
        a = groups.select(F.col("cell").alias("a_cell"), F.col("group").alias("u"))
        b = groups.select(F.col("cell").alias("b_cell"), F.col("group").alias("v"))
        links = joined.select("a_cell", "b_cell").distinct().join(a, "a_cell").join(b, "b_cell").select("u", "v")
        links = checkpointed(links.where(F.col("u") != F.col("v")).distinct())
        if links.isEmpty():
            return groups
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        names = checkpointed(groups.select(F.col("group").alias("u")).distinct().withColumn("name", F.col("u")))
        while True:
            least = (
                both.join(names.select(F.col("u").alias("v"), "name"), "v").groupBy("u").agg(F.min("name").alias("m"))
            )
            step = names.join(least, "u", "left").select("u", "name", F.least("name", "m").alias("m"))
            hop = names.select(F.col("u").alias("m"), F.col("name").alias("further"))
            moved = checkpointed(
                step.join(hop, "m").select("u", F.col("name").alias("old"), F.least("m", "further").alias("name"))
            )
            settled = moved.where(F.col("old") != F.col("name")).isEmpty()
            names = moved.select("u", "name")
            if settled:
                break
        return checkpointed(
            groups.join(names, groups["group"] == names["u"]).select("cell", F.col("name").alias("group"))
        )

    def _numbers(self, groups):
        """Cluster number of each core cell: rank of its group's name."""
        distinct = groups.select(F.lit(0).alias("_all"), "group").distinct().withColumn("w", F.lit(1))
        ranked = running_counts(distinct, ["_all"], "group", ["w"], groups.count())
        return checkpointed(
            groups.join(ranked.select("group", (F.col("cum_w") - 1).alias("number")), "group")
        )

    def _adopt(self, border, around, boxes, groups, core_points):
        """``(rid, group)`` of border points: the smallest group with a core point in reach."""
        points = self._point_boxes(border).drop("own")
        target = boxes.withColumn("box", F.col("cell"))
        pairs = self._with_target(points.join(around, "a_cell").withColumn("b_on", F.col("b_cell")), target, "cell")
        of_cell = groups.select(F.col("cell").alias("b_cell"), "group")
        pairs = self._near(pairs).join(of_cell, "b_cell")
        best, level = None, 0
        while True:
            pairs = checkpointed(pairs)
            found = pairs.where("sure").groupBy("rid").agg(F.min("group").alias("best"))
            if best is not None:
                found = best.unionByName(found).groupBy("rid").agg(F.min("best").alias("best"))
            best = checkpointed(found)
            pairs = (
                pairs.where(~F.col("sure")).join(best, "rid", "left")
                .where(F.col("best").isNull() | (F.col("group") < F.col("best"))).drop("best")
            )
            if pairs.isEmpty():
                return best.select("rid", F.col("best").alias("group"))
            level += 1
            parents = pairs.select(F.col("b_box").alias("box"), F.col("b_n").alias("n")).distinct()
            keep = ["rid", "group", *[f"a_{c}" for c in self.bounds], F.col("b_box").alias("b_on")]
            pairs = self._near(
                self._with_target(pairs.select(*keep), self._children(core_points, parents, level), "parent")
            )

"""Grids, neighbourhoods, smoothing, clusters and region tables.

A voxel is a row; being in a mask means being present. Neighbourhoods are equi-joins on
shifted lattice indices, never distance joins over all pairs. They merge: Spark's size check does not count
the rows that ``explode`` adds and would broadcast them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtrail.session import cut_lineage

IJK = ["i", "j", "k"]


def ball_offsets(radius: float, size: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """Lattice offsets within the radius; their number depends on the radius only."""
    r = [int(radius // s) for s in size]
    return [(a, b, c) for a in range(-r[0], r[0] + 1) for b in range(-r[1], r[1] + 1) for c in range(-r[2], r[2] + 1)
            if (a * size[0]) ** 2 + (b * size[1]) ** 2 + (c * size[2]) ** 2 <= radius ** 2 + 1e-9]


def _shifted(df: DataFrame, offsets) -> DataFrame:
    arr = F.explode(F.array(*[F.struct(*[F.lit(o).cast("bigint").alias("d" + n) for n, o in zip(IJK, off)])
                              for off in offsets]))
    d = df.withColumn("__o", arr)
    for n in IJK:
        d = d.withColumn(n, F.col(n) + F.col(f"__o.d{n}"))
    return d.drop("__o")


def lattice_neighbours(voxels: DataFrame, voxel: str, radius: float,
                       size: tuple[float, float, float] = (1.0, 1.0, 1.0), least: int = 1) -> DataFrame:
    """(centre, voxel) for all voxels within the radius; small neighbourhoods are left out."""
    c = _shifted(voxels.select(F.col(voxel).alias("centre"), *IJK), ball_offsets(radius, size))
    j = c.join(voxels.select(voxel, *IJK).hint("merge"), IJK).select("centre", voxel)
    if least <= 1:
        return j
    n = j.groupBy("centre").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    return j.join(n.select("centre"), "centre", "left_semi")


CROWDED = 2048  # points of a cell that meet in one piece


def point_neighbours(points: DataFrame, ident: str, xyz: list[str], radius: float, crowded: int = CROWDED) -> DataFrame:
    """Pairs (centre, neighbour) of irregular points within the radius: cells of that size, the
    27 cells around a centre, equi-join on the cell, exact distance afterwards.

    A cell of more than ``crowded`` points is cut into S parts by a hash of the point, and its centres too:
    each of the S x S pieces joins one part of the centres with one part of the points, so a cell that holds most
    points is many tasks. Only the counts of crowded cells are joined for that."""
    cells = [F.floor(F.col(c) / radius).alias(n) for c, n in zip(xyz, IJK)]
    p = points.select(F.col(ident).alias("centre"), *[F.col(c).alias("c" + c) for c in xyz], *cells)
    around = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    q = points.select(F.col(ident).alias("neighbour"), *xyz, *cells)
    parts = cut_lineage(q.groupBy(*IJK).agg(F.ceil(F.count(F.lit(1)) / crowded).cast("int").alias("__s")).filter("__s > 1"))

    def dealt(df: DataFrame, own: str, other: str, name: str) -> DataFrame:
        d = df.join(parts.select(*[F.col(c).alias(c) for c in parts.columns]), IJK, "left").withColumn("__s", F.coalesce("__s", F.lit(1)))
        d = d.withColumn(own, F.pmod(F.xxhash64(name), F.col("__s")).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("__s") - 1))).drop("__s")

    j = dealt(_shifted(p, around), "__a", "__b", "centre").join(
        dealt(q, "__b", "__a", "neighbour").hint("merge"), [*IJK, "__a", "__b"])
    d2 = sum((F.pow(F.col(c) - F.col("c" + c), 2) for c in xyz), F.lit(0.0))
    return j.filter(d2 <= radius * radius).select("centre", "neighbour")


def transfer_nearest(voxels: DataFrame, source: DataFrame, origin: tuple, size: tuple, value: str,
                     default) -> DataFrame:
    """Looks each voxel's coordinates up in another grid (nearest cell); outside is default."""
    d = voxels
    for n, c, o, s in zip(IJK, ("x", "y", "z"), origin, size):
        d = d.withColumn("__" + n, F.rint((F.col(c) - o) / s).cast("bigint"))
    src = source.select(*[F.col(n).alias("__" + n) for n in IJK], value)
    return d.join(src, ["__" + n for n in IJK], "left").fillna({value: default}).drop(*["__" + n for n in IJK])


def overlay(base: DataFrame, top: DataFrame, voxel: str, label: str) -> DataFrame:
    """Labels of ``top`` overwrite those of ``base``; the names get new dense ids (base first)."""
    j = base.select(voxel, F.col(label).alias("__b")).join(top.select(voxel, F.col(label).alias("__t")), voxel, "full")
    m = j.select(voxel, F.coalesce("__t", "__b").alias(label),
                 F.when(F.col("__t").isNotNull(), 1).otherwise(0).alias("layer"))
    names = m.select("layer", label).distinct()  # one row per label of the atlas
    ids = names.withColumn("roi_id", F.dense_rank().over(Window.orderBy("layer", label)))
    return m.join(ids, ["layer", label]).select(voxel, label, "roi_id")


def paint(voxels: DataFrame, values: DataFrame, roi: str) -> DataFrame:
    return voxels.join(values, roi, "left")


def smooth(df: DataFrame, keys: list[str], value: str, fwhm: float, size: tuple[float, float, float],
           truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing inside a mask, divided by the same filter applied to the mask.

    Three one-axis passes; a pass spreads each voxel over its offsets and adds up, combined
    map-side. Voxels outside the mask are kept between passes and dropped at the end."""
    d = df.select(*keys, *IJK, F.col(value).alias("__v"), F.lit(1.0).alias("__w"))
    for n, s in zip(IJK, size):
        sigma = fwhm / math.sqrt(8 * math.log(2)) / s
        reach = int(truncate * sigma + 0.5)
        raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-reach, reach + 1)]
        total = sum(raw)
        taps = F.array(*[F.struct(F.lit(o - reach).cast("bigint").alias("o"), F.lit(r / total).alias("g"))
                         for o, r in enumerate(raw)])
        e = d.withColumn("__t", F.explode(taps)).withColumn(n, F.col(n) + F.col("__t.o"))
        d = e.groupBy(*keys, *IJK).agg(F.sum(F.col("__v") * F.col("__t.g")).alias("__v"),
                                       F.sum(F.col("__w") * F.col("__t.g")).alias("__w"))
    return df.join(d.hint("merge"), [*keys, *IJK]).withColumn("smoothed", F.col("__v") / F.col("__w")).drop("__v", "__w")


# The 13 half-neighbourhood offsets of 26-connectivity; the other half is symmetric.
HALF = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]


def _roots(parent: DataFrame, keys: list[str]) -> DataFrame:
    """Follows (a -> p) to the end by pointer jumping: the path halves every time."""
    while True:
        hop = parent.select(*keys, F.col("a").alias("p"), F.col("p").alias("pp"))
        new = cut_lineage(parent.join(hop, [*keys, "p"]).select(*keys, "a", "p", "pp"))
        parent = new.select(*keys, "a", F.col("pp").alias("p"))
        if not new.filter("p <> pp").take(1):
            return parent


def components(voxels: DataFrame, keys: list[str], voxel: str) -> DataFrame:
    """Connected components (26 neighbours); the label is the smallest voxel id.

    Every round each tree hooks onto its smallest neighbour, hooks are followed to their
    roots, and the edges are contracted to edges between roots. At least half of the trees
    that have a neighbour disappear per round, so the rounds grow with the logarithm of the
    size, whatever the shape. Tables are checkpointed per round; it ends without edges."""
    v = voxels.select(*keys, voxel, *IJK)
    a = _shifted(v.select(*keys, F.col(voxel).alias("a"), *IJK), HALF)
    e = a.join(v.select(*keys, F.col(voxel).alias("b"), *IJK).hint("merge"), [*keys, *IJK]).select(*keys, "a", "b")
    edges = cut_lineage(e.unionByName(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    lab = v.select(*keys, voxel, F.col(voxel).alias("label"))
    while edges.take(1):
        hook = edges.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        root = _roots(cut_lineage(hook.select(*keys, "a", F.least("a", "m").alias("p"))), keys)
        lab = cut_lineage(lab.join(root.withColumnRenamed("a", "label"), [*keys, "label"], "left").select(
            *keys, voxel, F.coalesce("p", "label").alias("label")))
        other = root.select(*keys, F.col("a").alias("b"), F.col("p").alias("q"))
        edges = cut_lineage(edges.join(root, [*keys, "a"]).join(other, [*keys, "b"]).filter("p <> q").select(
            *keys, F.col("p").alias("a"), F.col("q").alias("b")).distinct())
    return lab


def cluster_table(labelled: DataFrame, keys: list[str], voxel: str, value: str, least: int) -> DataFrame:
    """Size, extreme value and its voxel for each cluster of at least ``least`` voxels."""
    g = labelled.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("n_voxels"),
        F.max_by(F.struct(voxel, value), F.struct(F.abs(value), -F.col(voxel))).alias("__p"))
    return g.filter(F.col("n_voxels") >= least).select(
        *keys, "label", "n_voxels", F.col("__p")[voxel].alias("peak_voxel"), F.col("__p")[value].alias("peak_value"))


def label_peaks(clusters: DataFrame, atlas: DataFrame, voxel: str, label: str) -> DataFrame:
    """The region of each cluster's peak voxel; null outside every region."""
    of = atlas.select(F.col(voxel).alias("peak_voxel"), F.col(label).alias("peak_region"))
    return clusters.join(of, "peak_voxel", "left")


# ---- overlap and region tables ---------------------------------------------------------

def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def compare_volumes(df: DataFrame, a: str, b: str, dice_limit: float = 0.99, match_limit: float = 0.99,
                    corr_limit: float = 0.99) -> DataFrame:
    """Dice of the positive parts, share of equal voxels and correlation, with pass flags.
    ``df`` is the full outer join of both volumes; an absent voxel is zero."""
    x, y = F.coalesce(F.col(a), F.lit(0.0)), F.coalesce(F.col(b), F.lit(0.0))
    na, nb = F.count_if(x > 0), F.count_if(y > 0)
    g = df.agg(F.coalesce(_div(2 * F.count_if((x > 0) & (y > 0)), na + nb), F.lit(1.0)).alias("dice"),
               F.avg((x == y).cast("double")).alias("match_fraction"), F.corr(x, y).alias("correlation"))
    return (g.withColumn("dice_pass", F.col("dice") >= dice_limit)
            .withColumn("match_pass", F.col("match_fraction") >= match_limit)
            .withColumn("correlation_pass", F.coalesce(F.col("correlation") >= corr_limit, F.col("match_fraction") == 1)))


def conjunction(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    pa, pb = F.coalesce(F.col(a) > 0, F.lit(False)), F.coalesce(F.col(b) > 0, F.lit(False))
    g = df.groupBy(*keys).agg(F.count_if(pa).alias("n_a"), F.count_if(pb).alias("n_b"), F.count_if(pa & pb).alias("n_both"))
    return g.withColumn("dice", _div(2 * F.col("n_both"), F.col("n_a") + F.col("n_b")))


def _centroid(weight: Column, xyz: list[str]) -> list[Column]:
    """Weighted centre; plain mean if a weight is not finite or the sum is not positive."""
    total = F.sum(weight)
    good = F.bool_and(weight.isNotNull() & ~F.isnan(weight) & (F.abs(weight) < float("inf"))) & (total > 0)
    return [F.when(good, F.sum(weight * F.col(c)) / total).otherwise(F.avg(c)).alias("centre_" + c) for c in xyz]


def region_overlap(df: DataFrame, roi: list[str], a: str, b: str, xyz: list[str],
                   voxel_volume: float) -> DataFrame:
    """Per region with overlap: voxels, volume, share of the region, centre, pair values."""
    sel = (F.col(a) > 0) & (F.col(b) > 0)
    w = (F.col(a) + F.col(b)) / 2
    size = df.groupBy(*roi).agg(F.count(F.lit(1)).alias("roi_voxels"))
    g = df.filter(sel).groupBy(*roi).agg(
        F.count(F.lit(1)).alias("overlap_voxels"), *_centroid(w, xyz), F.avg(w).alias("mean_pair"),
        F.max(w).alias("max_pair"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))
    return (g.join(size, roi).withColumn("overlap_volume", F.col("overlap_voxels") * voxel_volume)
            .withColumn("percent_of_roi", 100.0 * F.col("overlap_voxels") / F.col("roi_voxels")))


def merged_regions(df: DataFrame, name: str, value: str, xyz: list[str], voxel_volume: float) -> DataFrame:
    """Regions whose names differ only in a trailing _<number> as one: members, positive
    voxels and volume, centre, mean and largest value."""
    d = df.withColumn("merged", F.regexp_replace(name, r"_[0-9]+$", ""))
    pos = F.col(value) > 0
    v = F.when(pos, F.col(value))
    size = d.groupBy("merged").agg(F.count(F.lit(1)).alias("roi_voxels"))
    g = d.filter(pos).groupBy("merged").agg(
        F.array_join(F.array_sort(F.collect_set(name)), ", ").alias("members"),
        F.count(F.lit(1)).alias("positive_voxels"), *_centroid(F.col(value), xyz),
        F.avg(v).alias("mean_value"), F.max(v).alias("max_value"))
    return (g.join(size, "merged").withColumn("positive_volume", F.col("positive_voxels") * voxel_volume)
            .withColumn("percent_positive", 100.0 * F.col("positive_voxels") / F.col("roi_voxels")))


# Words in a region name that decide its lobe, first match wins.
LOBES = (
    ("Occipital", ("calcarine", "cuneus", "lingual", "occipital")),
    ("Temporal", ("fusiform", "temporal", "heschl")),
    ("Frontal/Motor", ("frontal", "precentral", "supp_motor", "rolandic")),
    ("Parietal", ("parietal", "postcentral", "precuneus", "angular", "supramarginal")),
    ("Cingulate", ("cingulum",)),
    ("Medial temporal", ("hippocampus", "amygdala", "parahippocampal")),
    ("Subcortical", ("caudate", "putamen", "pallidum", "thalamus")),
    ("Cerebellum", ("cerebel", "vermis")),
    ("Insula", ("insula",)),
)


def lobe(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit("Other")
    for label, words in reversed(LOBES):
        out = F.when(low.rlike("|".join(words)), label).otherwise(out)
    return out


def majority_label(df: DataFrame, roi: list[str], label_id: str, label_name: str) -> DataFrame:
    """Most frequent positive label of each region, smallest id on ties, and its share."""
    c = df.groupBy(*roi, label_id, label_name).agg(F.count(F.lit(1)).alias("__c"))
    ok = F.col(label_id) > 0
    g = c.groupBy(*roi).agg(
        F.max_by(F.when(ok, F.struct(label_id, label_name, "__c")),
                 F.when(ok, F.struct("__c", -F.col(label_id)))).alias("__m"), F.sum("__c").alias("__n"))
    return g.select(*roi, F.coalesce(F.col("__m")[label_name], F.lit("")).alias("label"),
                    F.coalesce(F.col("__m")["__c"], F.lit(0)).alias("label_voxels"),
                    F.coalesce(100.0 * F.col("__m")["__c"] / F.col("__n"), F.lit(0.0)).alias("label_percent"))


def atlas_overlap(df: DataFrame, in_roi: Column, region: str) -> DataFrame:
    """Voxels of a region of interest per atlas region; shares of both."""
    g = df.groupBy(region).agg(F.count_if(in_roi).alias("overlap"), F.count(F.lit(1)).alias("region_voxels"))
    every = Window.partitionBy()  # one row per region of the atlas
    return (g.withColumn("roi_voxels", F.sum("overlap").over(every)).filter("overlap > 0")
            .withColumn("percent_of_roi", 100.0 * F.col("overlap") / F.col("roi_voxels"))
            .withColumn("percent_of_region", 100.0 * F.col("overlap") / F.col("region_voxels")))

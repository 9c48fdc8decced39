"""Hard-negative mining by anchor-clustered shared lists.

Anchors of one label are clustered by direction (spherical k-means). For a
cluster, the candidates of a block are sorted once by an upper bound of their
inner product with any member of unit length: their length times the cosine of
the angle to the centre, less the widest angle of a member. Every member walks
that list until what it holds can no longer change: all that is left lies below
its last place or below the scores it asks for. Results are exact whatever the
clusters are.

Anchors are dealt to tiles by cluster and candidates to blocks by a hash, so that
a task holds one tile and one block at a time; the best rows of each block are
merged by rank. A cluster of more than MAX_MEMBERS anchors (copies of one
vector, say) is split. The first walk finds the positives, whose scores set the
window of the second walk, which finds the negatives.

Rows with a null label, vector, component or with a component that is not finite
take no part. Shorter vectors count as filled up with 0. Repeated rows are rows of
their own: a copy of an anchor is one of its positives. A null vec_id is no anchor,
and is the last of equal scores. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbspark.llm.common import staged, table

#: Positives of an anchor and negatives of a positive.
POSITIVES = 5
NEGATIVES = 3
#: Negatives score between these percentages of their positive.
LEAST_PERCENT, MOST_PERCENT = 50, 95
#: Anchors that a cluster has on average and at most, clusters at most, and anchors that the centres are fitted on.
MEAN_MEMBERS = 64
MAX_MEMBERS = 1024
MAX_CLUSTERS = 1024
MAX_FITTED = 20_000
#: Anchors of a tile and candidates of a block, in expectation: what a task holds.
TILE = 16_384
BLOCK = 16_384
#: Candidates of the first step down a list; every step doubles.
FIRST_STEP = 256
MAX_SCORES = 1 << 22
#: Bounds are widened by this share against rounding.
SLACK = 1e-9

_LONG = np.iinfo(np.int64)


def usable_vectors(rows: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, components (256 times each one, rounded down) and a number of its own for each usable row."""
    finite = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))
    return (
        rows.select("vec_id", label.cast("long").alias("label"), "embedding")
        .where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))
        .select(
            "vec_id",
            "label",
            F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("components"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def _directions(anchors: DataFrame) -> DataFrame:
    """anchors with cluster: the number of the nearest centre, -1 for vectors that have no direction."""
    length = F.sqrt(F.aggregate("components", F.lit(0.0), lambda s, x: s + x * x))
    alike = anchors.agg(F.count("*"), F.min(F.size("components")), F.max(F.size("components"))).first()
    n, least, most = alike
    clusters = min(MAX_CLUSTERS, n // MEAN_MEMBERS)
    if clusters < 2 or least != most or not most:
        return anchors.withColumn("cluster", F.lit(0))
    pointed = anchors.withColumn("_length", length).withColumn("_features", array_to_vector("components"))
    fitted = pointed.where("_length > 0").orderBy(F.xxhash64("components"), "row").limit(MAX_FITTED)
    if fitted.isEmpty():
        return anchors.withColumn("cluster", F.lit(0))
    model = KMeans(
        k=clusters, maxIter=5, seed=17, distanceMeasure="cosine", featuresCol="_features", predictionCol="cluster"
    ).fit(fitted)
    placed = model.transform(pointed.where("_length > 0")).select(*anchors.columns, "cluster")
    return placed.unionByName(pointed.where("_length = 0").select(*anchors.columns, F.lit(-1).alias("cluster")))


def tiled(anchors: DataFrame, members: int = MAX_MEMBERS, tile: int = TILE) -> DataFrame:
    """anchors with cluster and tile; whole clusters of at most about so many members to a tile."""
    placed = staged(_directions(anchors), "negatives")
    sizes = placed.groupBy("label", "cluster").agg(F.count("*").alias("_size"))
    tiles = max(1, -(-placed.count() // tile))
    parts = F.ceil(F.col("_size") / members)
    return (
        placed.join(sizes, ["label", "cluster"])
        .withColumn("part", F.pmod(F.xxhash64("row"), parts))
        .withColumn("tile", F.pmod(F.xxhash64("label", "cluster", "part"), F.lit(tiles)).cast("int"))
        .drop("_size")
    )


class _Rows:
    """Rows of a task as arrays: numbers, ids (null last), labels, and a matrix whose products are exact."""

    def __init__(self, data: pa.Table):
        self.row = data.column("row").to_numpy()
        ids = data.column("vec_id")
        self.no_id = ids.is_null().to_numpy()
        self.id = ids.fill_null(0).to_numpy()
        self.label = data.column("label").to_numpy()
        lists = data.column("components").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        self.matrix = np.zeros((len(sizes), int(sizes.max(initial=0))))
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.matrix[np.repeat(np.arange(len(sizes)), sizes), at] = flat

    def widened(self, width: int) -> None:
        if self.matrix.shape[1] < width:
            self.matrix = np.pad(self.matrix, ((0, 0), (0, width - self.matrix.shape[1])))


def _lengths(matrix: np.ndarray) -> np.ndarray:
    """Vector lengths without overflow."""
    top = np.abs(matrix).max(1, initial=0)
    scale = np.where(top > 0, top, 1)
    return np.sqrt(((matrix / scale[:, None]) ** 2).sum(1)) * scale


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Whole-number products; beyond what doubles hold exactly they are made of Python's integers, ends of long cut off."""
    if exact:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = whole(a).dot(whole(b).T) if a.size and b.size else np.zeros((len(a), len(b)), object)
    return np.clip(out, _LONG.min, _LONG.max).astype(np.int64)


class _Best:
    """The best rows of each slot: by score, then smaller id, null last."""

    def __init__(self, most: int, slots: int):
        self.most = most
        self.slot = self.at = self.score = np.zeros(0, np.int64)
        self.last = np.full(slots, _LONG.min)

    def add(self, slot: np.ndarray, at: np.ndarray, score: np.ndarray, rows: _Rows) -> None:
        slot, at, score = (np.concatenate(x) for x in ((self.slot, slot), (self.at, at), (self.score, score)))
        # ~score grows as score falls, without overflow at the least long.
        order = np.lexsort((rows.id[at], rows.no_id[at], ~score, slot))
        slot, at, score = slot[order], at[order], score[order]
        opens = np.concatenate(([True], slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, bool)
        place = np.arange(len(slot)) - np.maximum.accumulate(np.where(opens, np.arange(len(slot)), 0)) if len(slot) else slot
        keep = place < self.most
        self.slot, self.at, self.score = slot[keep], at[keep], score[keep]
        full = place[keep] == self.most - 1
        self.last[self.slot[full]] = self.score[full]


def _walk(members: np.ndarray, lengths: np.ndarray, listed: np.ndarray, rows: _Rows, exact: bool, least: np.ndarray, most: np.ndarray, held: int) -> Iterator[tuple]:
    """slot, row position and score of the best held rows in each window least..most of each member (members x windows).

    listed holds positions of the candidates; they are sorted by their bound once, for all members.
    """
    windows = least.shape[1]
    best = _Best(held, least.size)
    matrix = rows.matrix[listed]
    norms = _lengths(matrix)
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = np.where(lengths[:, None] > 0, members / lengths[:, None], 0)
        centre = unit.sum(0)
        size = np.sqrt((centre**2).sum())
        centre = centre / size if size > 0 else centre
        # Without a direction every angle is possible.
        spread = np.arccos(np.clip((unit @ centre).min(), -1, 1)) + SLACK if size > 0 and (lengths > 0).all() else np.pi
        cosine = np.where(norms > 0, (matrix @ centre) / np.where(norms > 0, norms, 1), 0)
    bound = norms * np.cos(np.maximum(0, np.arccos(np.clip(cosine, -1, 1)) - spread - SLACK))
    order = np.argsort(-bound, kind="stable")
    bound, listed = bound[order], listed[order]
    live = np.arange(len(members))
    begin, step = 0, FIRST_STEP
    while begin < len(listed) and len(live):
        end = min(len(listed), begin + max(1, min(step, MAX_SCORES // (len(live) * windows))))
        part = listed[begin:end]
        scores = _products(members[live], rows.matrix[part], exact)
        slots = live[:, None] * windows + np.arange(windows)
        floor = np.maximum(least[live], best.last[slots])
        hit = (scores[:, None, :] >= floor[:, :, None]) & (scores[:, None, :] <= most[live][:, :, None])
        m, w, c = np.nonzero(hit)
        best.add(live[m] * windows + w, part[c], scores[m, c], rows)
        begin, step = end, step * 2
        if begin < len(listed):
            # No later row exceeds this; equal scores may still win by id.
            ceiling = lengths[live] * bound[begin]
            ceiling = ceiling + np.abs(ceiling) * SLACK + SLACK
            open_window = np.maximum(least[live], best.last[slots]) <= np.minimum(ceiling[:, None], most[live])
            live = live[open_window.any(1)]
    return best.slot, best.at, best.score


#: Of an anchor row: the slot (0, or the number of the positive), the row found and its score.
FOUND = "anchor_row long, anchor_id long, slot int, row long, vec_id long, score long"


def _searcher(same_label: bool):
    """A function of one tile and one block: for every anchor the best rows of its own label, or of all others in its windows."""

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, rows = _Rows(left), _Rows(right)
        names = [f.split()[0] for f in FOUND.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        out = []
        if len(anchors.row) and len(rows.row):
            width = max(anchors.matrix.shape[1], rows.matrix.shape[1])
            anchors.widened(width), rows.widened(width)
            top = np.abs(anchors.matrix).max(initial=0) * np.abs(rows.matrix).max(initial=0) * max(1, width)
            exact = bool(top < 2**53)
            lengths = _lengths(anchors.matrix)
            if same_label:
                least, most = np.full((len(anchors.row), 1), _LONG.min), np.full((len(anchors.row), 1), _LONG.max)
            else:
                windows = left.column("windows").to_pylist()
                least, most = np.full((len(windows), POSITIVES), _LONG.max), np.full((len(windows), POSITIVES), _LONG.min)
                for k, w in enumerate(windows):
                    for j, bounds in enumerate(w):
                        least[k, j], most[k, j] = bounds["low"], bounds["high"]
            keys = np.stack([anchors.label, left.column("cluster").to_numpy(), left.column("part").to_numpy()])
            _, group = np.unique(keys, axis=1, return_inverse=True)
            group = group.ravel()
            for g in range(group.max() + 1):
                at = np.flatnonzero(group == g)
                mine = rows.label == anchors.label[at[0]]
                listed = np.flatnonzero(mine if same_label else ~mine)
                slot, found, score = _walk(
                    anchors.matrix[at], lengths[at], listed, rows, exact, least[at], most[at], POSITIVES + 1 if same_label else NEGATIVES
                )
                who, window = at[slot // least.shape[1]], slot % least.shape[1]
                other = anchors.row[who] != rows.row[found]
                out.append(np.stack([who[other], window[other], found[other], score[other]]))
        who, window, found, score = np.concatenate(out, 1) if out else np.zeros((4, 0), np.int64)
        return pa.table(
            [
                pa.array(x, k, mask=m)
                for x, k, m in zip(
                    [left.column("row").to_numpy()[who], left.column("vec_id").to_numpy()[who], window, rows.row[found], rows.id[found], score],
                    kinds,
                    [None, None, None, None, rows.no_id[found], None],
                    strict=True,
                )
            ],
            names=names,
        )

    return run


def _searched(anchors: DataFrame, blocks: DataFrame, n_tiles: int, n_blocks: int, same_label: bool) -> DataFrame:
    """Every tile against every block: anchors go to each block, rows to each tile."""
    left = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = blocks.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))
    return left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(_searcher(same_label), FOUND)


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The best rows of each slot over all blocks; a slot has at most a few rows a block."""
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, is_anchor: Column, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and scores for vectors (vec_id, label, components, row)."""
    vectors = staged(vectors, "negatives")
    anchors = staged(tiled(vectors.where(is_anchor), tile=tile), "negatives")
    n_tiles = (anchors.agg(F.max("tile")).first()[0] or 0) + 1
    n_blocks = max(1, -(-vectors.count() // block))
    blocks = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    positives = staged(_ranked(_searched(anchors, blocks, n_tiles, n_blocks, True), POSITIVES), "negatives")
    window = F.struct(_ceil_share(LEAST_PERCENT).alias("low"), _floor_share(MOST_PERCENT).alias("high"))
    windows = positives.groupBy(F.col("anchor_row").alias("row")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", window.alias("w")))), lambda x: x["w"]).alias("windows")
    )
    found = _ranked(_searched(anchors.join(windows, "row"), blocks, n_tiles, n_blocks, False), NEGATIVES)
    chosen = positives.select(
        "anchor_row", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return found.join(chosen, ["anchor_row", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _floor_share(percent: int) -> Column:
    """The whole part, rounded down, of a percentage of score; in parts, so that no product leaves the range of long."""
    low = F.pmod("score", F.lit(100))
    return ((F.col("score") - low) / 100).cast("long") * percent + F.floor(low * percent / 100)


def _ceil_share(percent: int) -> Column:
    low = F.pmod("score", F.lit(100))
    return ((F.col("score") - low) / 100).cast("long") * percent + F.ceil(low * percent / 100)


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable_vectors(rows, label), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_inner_product(a.c, b.c)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE same
  QUALIFY k <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST)::INTEGER AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

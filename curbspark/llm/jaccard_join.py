"""N-gram Jaccard self-join by chosen paths.

Texts become sets of five-word shingles; equal sets become one class. Then, in
each of several runs, sets are split recursively: a node picks coordinates of the
min-hash signature by a hash of its path, 1 / threshold of them on average, and a
set goes on to the child of the token it has there. Two sets share a child with
the odds of their similarity. Small buckets are compared by brute force,
larger ones split again, and what is still large at the last level is compared
in blocks. The runs are as many as the target recall asks for at the threshold.

Brute force on signatures, with a margin below the threshold, only has to find
which sets hang together: within a block every set is compared with all that it is
not connected with yet, so that no link between two groups is missed. The groups
that come out are small, and inside each all pairs are then compared exactly, by
products of incidence matrices, in blocks. Pairs are counted where they are
compared and never emitted; a block emits one row a set. Thus every pair is found
whose sets are connected, over all runs, by pairs that share a leaf and have
LEAST_EQUAL equal coordinates. A pair that shares a leaf falls below that with odds
of 0.001 at the threshold.

Words are runs of other than ASCII white space. A text of one to four words has
one shingle of them all; one without words has no links and is a class of its
own. Null counts as empty, a null doc_id as the largest one. Repeated rows are
copies of each other. Ids may repeat or be null: a set has a number of its own, and
of a class the row of least id stays, then of least text digest. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbspark.llm.common import shielded, staged, table, whole_text
from curbspark.llm.components import components
from curbspark.llm.shingles import COORDINATES, shingle_sets, signature

#: Similarity of a link, as a fraction: 4 / 5.
THRESHOLD = (4, 5)
#: Odds that the runs bring a pair at the threshold into one bucket.
TARGET_RECALL = 0.99
#: Levels of splits in a run.
LEVELS = 3
#: Buckets of up to so many sets are compared at once.
SMALL_BUCKET = 256
#: Sets, and shingles, in a block of a larger bucket or group.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 21
#: Of COORDINATES, so many equal ones make two sets hang together: three standard deviations below the threshold.
LEAST_EQUAL = math.floor(COORDINATES * 0.8 - 3 * math.sqrt(COORDINATES * 0.8 * 0.2))

NO_ID = 2**63 - 1


def runs_needed(recall: float = TARGET_RECALL, levels: int = LEVELS) -> int:
    """A run keeps a pair at the threshold together through all levels with odds of threshold ** levels at least."""
    kept = (THRESHOLD[0] / THRESHOLD[1]) ** levels
    return math.ceil(math.log(1 - recall) / math.log(1 - kept))


# Sets


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, digest, least = [], [], []
        for hashes in shingle_sets(batch.column("text")):
            size.append(len(hashes))
            digest.append(_digest(hashes))
            least.append(signature(hashes).view(np.int32) if len(hashes) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array(size, pa.int32()),
                pa.array(digest, pa.binary()),
                pa.array(least, pa.list_(pa.int32())),
            ],
            ["doc_id", "text_key", "size", "digest", "signature"],
        )


def _named() -> list[Column]:
    """doc_id and text_key: together they name a row, as ids may repeat or be null."""
    return [
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"),
        F.unhex(F.sha2(whole_text(), 256)).alias("text_key"),
    ]


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, size, digest and signature of every text's shingle set."""
    return docs.select(*_named(), "text").mapInArrow(
        _to_sets, "doc_id long, text_key binary, size int, digest binary, signature array<int>"
    )


def set_classes(rows: DataFrame) -> DataFrame:
    """One row for each different set with shingles: set_id (a number of its own, fixed once the rows are staged),
    digest, doc_id and text_key of its least row, copies, size, signature."""
    return (
        rows.where("size > 0")
        .groupBy("digest")
        .agg(
            F.min(F.struct("doc_id", "text_key")).alias("_least"),
            F.count("*").alias("copies"),
            F.any_value("size").alias("size"),
            F.any_value("signature").alias("signature"),
        )
        .select(F.monotonically_increasing_id().alias("set_id"), "digest", "_least.*", "copies", "size", "signature")
    )


# Groups of rows in tasks


def _by_task(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies work to the rows of each key; a partition holds many keys, and one key's rows at a time are in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        held_key = None

        def finished():
            if held and (out := work(pa.concat_tables(held).combine_chunks())) is not None:
                yield out
            held.clear()

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                key = tuple(c[a] for c in columns)
                if key != held_key:
                    yield from finished()
                    held_key = key
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        yield from finished()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in: _i <= _j, _block."""
    return (
        rows.withColumn("_blocks", F.greatest(F.lit(1), blocks).cast("int"))
        .withColumn("_block", F.pmod(F.xxhash64("set_id"), "_blocks").cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")})
        .drop("_blocks", "_other")
    )


# Splitting


def _children(path: Column, sig: Column) -> Column:
    """The buckets that a set goes on to: one coordinate always, a second with odds of 1 / threshold - 1."""

    def child(name: str) -> Column:
        at = F.pmod(F.xxhash64(path, F.lit(name)), F.lit(COORDINATES)).cast("int")
        return F.xxhash64(path, at, F.get(sig, at))

    extra = F.pmod(F.xxhash64(path, F.lit("extra")), F.lit(THRESHOLD[0])) < THRESHOLD[1] - THRESHOLD[0]
    return F.when(extra, F.array(child("first"), child("second"))).otherwise(F.array(child("first")))


def buckets(sets: DataFrame, runs: int, levels: int = LEVELS) -> DataFrame:
    """bucket, n (its sets), set_id: the leaves of all runs that hold two sets or more."""
    split = sets.select("set_id", "signature", F.explode(F.expr(f"sequence(1L, {runs}L)")).alias("path"))
    leaves = None
    for level in range(1, levels + 1):
        members = staged(
            split.select("set_id", F.explode(_children(F.col("path"), F.col("signature"))).alias("bucket")), "paths"
        )
        # As a table of its own, so that the join below shuffles both sides and can split a hot bucket.
        counts = staged(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "paths")
        counted = members.join(counts, "bucket")
        leaf = counted if level == levels else counted.where(F.col("n") <= SMALL_BUCKET)
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        if level < levels:
            large = counted.where(F.col("n") > SMALL_BUCKET).select("set_id", F.col("bucket").alias("path"))
            split = large.join(sets.select("set_id", "signature"), "set_id")
    return leaves


def _hang_together(group: pa.Table) -> pa.RecordBatch | None:
    """Edges to the least set of those that similar pairs connect: at most one for each set."""
    ids = group.column("set_id").to_numpy()
    ids, first = np.unique(ids, return_index=True)
    n = len(ids)
    if n < 2:
        return None
    sig = np.asarray(group.column("signature").combine_chunks().flatten()).reshape(-1, COORDINATES)[first]
    root = np.arange(n)
    for p in range(n - 1):
        # Pairs with earlier sets were looked at in their turn; a pair already connected adds nothing.
        apart = p + 1 + np.flatnonzero(root[p + 1 :] != root[p])
        if not len(apart):
            continue
        others = sig[p + 1 :] if len(apart) == n - 1 - p else sig[apart]
        near = apart[(others == sig[p]).sum(1) >= LEAST_EQUAL]
        if len(near):
            # The least member stands for what hangs together.
            met = np.unique(np.append(root[near], root[p]))
            root[np.isin(root, met)] = met[0]
    a = np.flatnonzero(root != np.arange(n))
    if not len(a):
        return None
    return pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[root[a]], pa.int64())], ["a", "b"])


def loose_edges(sets: DataFrame, runs: int) -> DataFrame:
    leaves = _in_blocks(buckets(sets, runs), F.when(F.col("n") > SMALL_BUCKET, F.ceil(F.col("n") / BLOCK_SETS)))
    rows = leaves.join(sets.select("set_id", "signature"), "set_id").select("bucket", "_i", "_j", "set_id", "signature")
    return _by_task(rows, ["bucket", "_i", "_j"], _hang_together, "a long, b long").distinct()


# Exact comparison


def _with_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = list(shingle_sets(batch.column("text")))
        wanted = batch.column("digest").to_pylist()
        keep = [k for k, h in enumerate(hashes) if _digest(h) == wanted[k]]
        rest = batch.select([n for n in batch.schema.names if n not in ("text", "digest")]).take(pa.array(keep))
        yield pa.RecordBatch.from_arrays(
            [*rest.columns, pa.array([hashes[k].tobytes() for k in keep], pa.binary())], [*rest.schema.names, "hashes"]
        )


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right]."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.concatenate(([True], every[1:] != every[:-1]))
    column = np.cumsum(start) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    # Runs of shared tokens in dense pieces.
    column = np.unique(column, return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    top = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, top, 4096):
        a, b = np.searchsorted(column, [c, c + 4096])
        piece = np.zeros((len(sets), min(4096, top - c)), np.float32)
        piece[owner[a:b], column[a:b] - c] = 1
        out += piece[left] @ piece[right].T
    return out.astype(np.int64)


def _linked(group: pa.Table) -> pa.RecordBatch:
    """Of each set: links with other sets and with documents in this pair of blocks, and an edge that keeps it connected."""
    group = group.sort_by("set_id").combine_chunks()
    ids, block = group.column("set_id").to_numpy(), group.column("_block").to_numpy()
    copies = group.column("copies").to_numpy()
    sets = [np.frombuffer(h, np.uint64) for h in group.column("hashes").to_pylist()]
    i, j = group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    size = np.array([len(s) for s in sets])
    common = _common(sets, left, right) if len(left) and len(right) else np.zeros((len(left), len(right)), np.int64)
    num, den = THRESHOLD
    link = (num + den) * common >= num * (size[left][:, None] + size[right][None, :])
    if i == j:
        np.fill_diagonal(link, False)
    n_sets, n_docs = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    n_sets[left] += link.sum(1)
    n_docs[left] += link @ copies[right]
    if i != j:
        n_sets[right] += link.sum(0)
        n_docs[right] += copies[left] @ link
    # A forest over the links, breadth first.
    parent = np.full(len(ids), -1)
    rows_at, columns_at = {x: k for k, x in enumerate(left)}, {x: k for k, x in enumerate(right)}
    for root in range(len(ids)):
        if parent[root] >= 0:
            continue
        parent[root] = root
        queue = [root]
        while queue:
            x = queue.pop()
            near = []
            if x in rows_at:
                near.append(right[link[rows_at[x]]])
            if i != j and x in columns_at:
                near.append(left[link[:, columns_at[x]]])
            for ys in near:
                new = ys[parent[ys] < 0]
                parent[new] = root
                queue += new.tolist()
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in (ids, n_sets, n_docs, ids[parent])], ["set_id", "set_links", "doc_links", "root"]
    )


def exact_links(docs: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """set_id, set_links, doc_links, root of each set of a group, one row for each pair of blocks it is in."""
    member = sets.join(groups, sets.set_id == groups.node).select(
        "set_id", "doc_id", "text_key", "copies", "size", "digest", "component"
    )
    totals = member.groupBy("component").agg(F.count("*").alias("_n"), F.sum("size").alias("_shingles"))
    member = member.join(totals, "component").withColumn(
        "_wanted", F.greatest(F.ceil(F.col("_n") / BLOCK_SETS), F.ceil(F.col("_shingles") / BLOCK_SHINGLES))
    )
    hashed = (
        docs.select(*_named(), "text")
        .join(member.drop("size", "_n", "_shingles"), ["doc_id", "text_key"])
        .select("set_id", "component", "copies", "_wanted", "text", "digest")
        .mapInArrow(_with_hashes, "set_id long, component long, copies long, _wanted long, hashes binary")
        # Rows that share the id and the text.
        .dropDuplicates(["component", "set_id"])
    )
    rows = _in_blocks(hashed, F.col("_wanted")).select("component", "_i", "_j", "_block", "set_id", "copies", "hashes")
    return _by_task(
        rows, ["component", "_i", "_j"], _linked, "set_id long, set_links long, doc_links long, root long"
    )


def _classed(docs: DataFrame, recall: float) -> DataFrame:
    """doc_id, text_key, class_id, stays (it is the least row of its class), n_links and n_set_links of every document."""
    rows = staged(signed(docs), "sets")
    sets = staged(set_classes(rows), "sets")
    groups = components(loose_edges(sets, runs_needed(recall)), "loose")
    links = staged(exact_links(docs, sets, groups), "links")
    found = components(links.select(F.col("set_id").alias("a"), F.col("root").alias("b")), "links").withColumnRenamed(
        "node", "set_id"
    )
    # As a table of its own, so that the join below can split a hot class.
    least = staged(
        found.join(sets.select("set_id", "doc_id", "text_key"), "set_id")
        .groupBy("component")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("_least")),
        "links",
    )
    sums = links.groupBy("set_id").agg(F.sum("set_links").alias("n_set_links"), F.sum("doc_links").alias("_doc_links"))
    per_set = (
        sets.select("digest", "set_id", "doc_id", "text_key", "copies")
        .join(sums, "set_id", "left")
        .join(found.join(least, "component").select("set_id", "_least"), "set_id", "left")
        .select(
            "digest",
            F.coalesce("_least.doc_id", "doc_id").alias("_class"),
            F.coalesce("_least.text_key", "text_key").alias("_class_key"),
            (F.coalesce("_doc_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("n_set_links", F.lit(0)).alias("n_set_links"),
        )
    )
    return rows.select("doc_id", "text_key", "digest").join(per_set, "digest", "left").select(
        "doc_id",
        "text_key",
        F.coalesce("_class", "doc_id").alias("class_id"),
        F.coalesce((F.col("_class") == F.col("doc_id")) & (F.col("_class_key") == F.col("text_key")), F.lit(True)).alias("stays"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_set_links", F.lit(0)).alias("n_set_links"),
    )


def joined(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id (the least doc_id that it hangs together with by links), n_links (documents at least as
    similar as the threshold) and n_set_links (different shingle sets among them) of every document."""
    return _classed(docs, recall).select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        F.nullif("class_id", F.lit(NO_ID)).alias("class_id"),
        "n_links",
        "n_set_links",
    )


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


def join_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each class, columns as they came. Rows that share id and text stay or go together."""
    keep = _classed(docs, TARGET_RECALL).where("stays").select("doc_id", "text_key").distinct()
    inner, back = shielded(docs, "doc_id", "text")
    # Names that no column of inner has.
    kept = keep.select(F.col("doc_id").alias("_kept"), F.col("text_key").alias("_kept_key"))
    doc_id, text_key = _named()
    return back(inner.join(kept, (doc_id == F.col("_kept")) & (text_key == F.col("_kept_key")), "left_semi"))

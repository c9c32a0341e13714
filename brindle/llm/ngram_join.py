"""Jaccard self-join on word shingles by a MinHash LSH forest.

Every tree is a trie over signatures of min-hashes. Two documents meet in a tree
where they share a prefix that is long enough for one of them. How long that is
each document decides by itself: from the full depth its matched prefixes are
shortened, in all trees together, until a partner of the least similarity that a
set of its size can have at the threshold would meet it with the target recall.
Levels of the trie grow only where documents meet: the first levels, which every
document needs, are one key a tree; the deeper ones are worked out for documents
that share such a key. What shares a chosen prefix is compared exactly, by whole
shingle sets.

Equal texts are one document with a number of copies before anything else.
Documents that hang together by chosen prefixes are compared as one group if
that is less work than comparing within each prefix: then each set moves once. A
group of more than ``cell`` documents or ``cell_bytes`` of sets is dealt out as
pairs of parts, each of which one task compares by products of incidence blocks,
so no pair becomes a row: a task returns each document's number of links and one
edge to the least document it hangs together with. Within prefixes a pair counts
only in the first tree where it meets, and prefixes with the same documents as
an earlier tree's are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hot_join, perhaps_in, removed, surely_not_in, written
from .components import components
from .words import mixed, parted, shingles

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.999
CELL = 256
CELL_BYTES = 16 << 20
#: Min-hashes below the first levels are kept by so many bits; so many fit a long.
LEVEL_BITS, MAX_LEVELS = 16, 4
#: Sets of more shingles come as near to the threshold as matters.
EXACT_SIZES = 64
_A = np.random.default_rng(7).integers(1, 1 << 63, 4096, np.uint64) | np.uint64(1)
_B = np.random.default_rng(8).integers(1, 1 << 63, 4096, np.uint64)


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, shortened from ``depth``, with which pairs at the threshold meet in one of ``trees`` with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    if 1 - (1 - threshold**depth) ** trees < recall:
        raise ValueError("more trees are needed for this recall")
    return depth


def least_similarity(size: int, threshold: float = THRESHOLD) -> float:
    """The least Jaccard similarity from ``threshold`` up that a set of ``size`` can have with any set."""
    # i shingles in common, of a union as large as the threshold lets it be.
    found = [i / u for i in range(max(1, math.ceil(threshold * size - 1e-9)), size + 1) if (u := math.floor(i / threshold + 1e-9)) >= size]
    return min(found, default=1.0)


def own_depths(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> list[int]:
    """By number of shingles, from 0: the prefix that a document's matches are shortened to; the last entry holds for all larger sets."""
    return [prefix_depth(least_similarity(n, threshold), trees, depth, recall) for n in range(EXACT_SIZES)] + [prefix_depth(threshold, trees, depth, recall)]


def _least(values: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.minimum.reduceat((values ^ _B[k]) * _A[k], begin)


def tree_roots(values: np.ndarray, counts: np.ndarray, trees: int, root: int, depth: int) -> np.ndarray:
    """For each document with shingles, its first ``root`` levels in each tree as a 64-bit key."""
    counts = counts[counts > 0]
    begin = np.cumsum(counts) - counts
    out = np.zeros((len(counts), trees), np.uint64)
    with np.errstate(over="ignore"):
        for t in range(trees if len(begin) else 0):
            key = np.full(len(counts), t + 1, np.uint64)
            for k in range(t * depth, t * depth + root):
                key = mixed(key * np.uint64(0x2545F4914F6CDD1D) + _least(values, begin, k))
            out[:, t] = key
    return out.view(np.int64)


def tree_rests(values: np.ndarray, counts: np.ndarray, trees: int, root: int, depth: int) -> np.ndarray:
    """For each document with shingles, its levels below the first ``root`` in each tree, ``LEVEL_BITS`` bits each."""
    counts = counts[counts > 0]
    begin = np.cumsum(counts) - counts
    out = np.zeros((len(counts), trees), np.uint64)
    for t in range(trees if len(begin) else 0):
        for k in range(t * depth + root, (t + 1) * depth):
            out[:, t] = out[:, t] << np.uint64(LEVEL_BITS) | (mixed(_least(values, begin, k)) >> np.uint64(64 - LEVEL_BITS))
    return out.view(np.int64)


def _lists(has: np.ndarray, rows: np.ndarray, trees: int) -> pa.ListArray:
    """An array of longs for each text; null where it has no shingles."""
    ends = np.cumsum(np.where(has, trees, 0))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(rows.ravel()), mask=pa.array(~has))


def signed(docs: DataFrame, shingle: int, trees: int, root: int, depth: int) -> DataFrame:
    """``(doc_id, node, size, roots)`` of each row of ``(doc_id, node, text)``: the number of shingles, and null roots without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in parted(batch, 2):
                values, counts = shingles(texts, shingle)
                roots = _lists(counts > 0, tree_roots(values, counts, trees, root, depth), trees)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(counts, pa.int64()), roots], names=["doc_id", "node", "size", "roots"])

    return docs.mapInArrow(run, "doc_id long, node binary, size long, roots array<long>")


def _grown(docs: DataFrame, shingle: int, trees: int, root: int, depth: int) -> DataFrame:
    """``(rank, shingles, rests)``: the sorted distinct shingles of ``(rank, text)`` as bytes, and the deeper levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in parted(batch, 1):
                values, counts = shingles(texts, shingle)
                rests = _lists(counts > 0, tree_rests(values, counts, trees, root, depth), trees)
                ends = np.cumsum(counts)
                sets = [np.unique(values[e - n : e]).tobytes() for n, e in zip(counts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.binary()), rests], names=["rank", "shingles", "rests"])

    return docs.mapInArrow(run, "rank binary, shingles binary, rests array<long>")


_SIGN = -(1 << 63)


def _rank(doc_id: Column, node: Column) -> Column:
    """A document id (null last) and the digest of its text as bytes that sort like the pair."""
    flipped = F.lpad(F.hex(F.coalesce(doc_id, F.lit(0)).bitwiseXOR(F.lit(_SIGN))), 16, "0")
    return F.unhex(F.concat(F.when(doc_id.isNull(), "01").otherwise("00"), flipped, F.hex(node)))


def _id_of(rank: Column) -> Column:
    flipped = F.conv(F.hex(F.substring(rank, 2, 8)), 16, -10).cast("long")
    return F.when(F.substring(rank, 1, 1) == F.lit(b"\x00"), flipped.bitwiseXOR(F.lit(_SIGN)))


def linked(sets: list[np.ndarray], keys: np.ndarray, tree: int, side: np.ndarray | None, threshold: float) -> np.ndarray:
    """Whether each pair is similar enough and not met in an earlier tree (key 0 meets nothing); with sides, only pairs across."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    common = times[place] > 1
    owner = owner[common]
    _, place = np.unique(place[common], return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((n, n), np.int64)
    width = max(64, (1 << 21) // n)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [low, low + width])
        block = np.zeros((n, width), np.float32)
        block[owner[a:b], place[a:b] - low] = 1
        both += np.rint(block @ block.T).astype(np.int64)
    out = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    for t in range(tree):
        out &= (keys[:, None, t] != keys[None, :, t]) | (keys[:, None, t] == 0)
    np.fill_diagonal(out, False)
    if side is not None:
        out &= side[:, None] != side[None, :]
    return out


def _compared(cells: DataFrame, threshold: float) -> DataFrame:
    """``(rank, links, root, whole)`` of each document with links in a cell; rows of a cell stand together."""

    def verified(cell: tuple, rows: list[tuple]) -> pa.RecordBatch | None:
        ranks, copies, keys, sets, sides, trees = zip(*rows)
        seen = np.array(keys, np.int64) if trees[0] > 0 else np.zeros((0, 0), np.int64)
        link = linked(list(sets), seen, max(0, trees[0]), np.array(sides) if cell[1] != cell[2] else None, threshold)
        if not link.any():
            return None
        order = sorted(range(len(ranks)), key=ranks.__getitem__)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        root = place.copy()
        while True:
            new = np.minimum(root, np.where(link, root[None, :], len(order)).min(axis=1))
            if (new == root).all():
                break
            root = new
        some = np.flatnonzero(link.any(axis=1))
        links = link.astype(np.int64) @ np.array(copies, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([ranks[i] for i in some], pa.binary()), pa.array(links[some]), pa.array([ranks[order[r]] for r in root[some]], pa.binary()), pa.array([cell[3]] * len(some), pa.bool_())], names=["rank", "links", "root", "whole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            # Sets stay where Arrow holds them.
            held = batch.column(batch.num_columns - 1)
            for i, (*at, side, tree, rank, copies, keys) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:-1]])):
                if at != cell:
                    if len(rows) > 1 and (out := verified(cell, rows)) is not None:
                        yield out
                    cell, rows = at, []
                rows.append((rank, copies, keys, np.frombuffer(held[i].as_buffer(), np.uint64), side, tree))
        if len(rows) > 1 and (out := verified(cell, rows)) is not None:
            yield out

    return cells.mapInArrow(run, "rank binary, links long, root binary, whole boolean")


def _assigned(met: DataFrame, grown: DataFrame, root: int, depth: int) -> DataFrame:
    """``(rank, size, tree, key)``: in each tree the shortest prefix of a document that some document chose, where others share it.

    A document's choice is its prefix of ``own`` levels; a prefix is chosen if
    one document chose it and another has it. ``low`` is the least choice among
    documents with the same root: where it is the root, that holds for all.
    """
    plain = met.where(F.col("low") == root).select("rank", "size", "tree", F.col("root").alias("key"))
    deep = met.where(F.col("low") > root).join(grown.select("rank", "rests").hint("merge"), "rank").withColumn("rest", F.col("rests")[F.col("tree")])
    prefix = F.lit(None).cast("long")
    for d in range(root + 1, depth + 1):
        prefix = F.when(F.col("level") == d, F.xxhash64(F.col("root"), F.shiftrightunsigned("rest", LEVEL_BITS * (depth - d)), F.lit(d))).otherwise(prefix)
    deep = deep.withColumn("level", F.explode(F.sequence(F.lit(root), F.lit(depth)))).where(F.col("level") > root)
    at = written(deep.select("rank", "size", "tree", "level", (F.col("level") == F.col("own")).alias("own"), prefix.alias("key")), "levels")
    chosen = at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("chosen")).where("n > 1 and chosen")
    chosen = written(chosen.select("key", "n"), "chosen")
    deep = hot_join(at.drop("own"), chosen, "key", at.count()).groupBy("rank", "size", "tree").agg(F.min(F.struct("level", "key")).alias("at"))
    out = plain.unionByName(deep.select("rank", "size", "tree", "at.key"))
    out = written(out.withColumn("key", F.when(F.col("key") == 0, 1).otherwise(F.col("key"))), "prefixes")
    removed(at, chosen)
    return out


def _groups(at: DataFrame, cell: int, cell_bytes: int) -> DataFrame:
    """``(rank, g, n, shingles, tree, whole)``: the groups that a document is compared in.

    ``g`` names a whole component of documents that share prefixes (``tree``
    -1), where that is less to compare than each prefix by itself, or a prefix.
    """
    rows = at.count()
    keys = at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("tree").alias("tree"), F.bit_xor(F.xxhash64("rank")).alias("who"), F.sum("size").alias("shingles"), F.min("rank").alias("least")).where("n > 1")
    # Of prefixes with the same documents only the first tree's is compared.
    keys = written(keys.groupBy("n", "who").agg(F.min(F.struct("tree", "key", "shingles", "least")).alias("at")).select("n", "at.*"), "keys")
    met = written(hot_join(at.drop("tree"), keys, "key", rows), "met")
    comps = components(met.select(F.col("rank").alias("u"), F.col("least").alias("v"))).select(F.col("node").alias("rank"), F.col("root").alias("comp"))
    members = met.count()
    sizes = met.select("rank", "size").distinct().join(comps.hint("merge"), "rank").groupBy("comp").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("of"))
    # Prefixes by component; a component has at most as many prefixes as rows of ``met``.
    of_key = keys.join(comps.withColumnRenamed("rank", "least").hint("merge"), "least")
    work = of_key.groupBy("comp").agg(F.sum(F.col("n") * F.col("n")).alias("by_keys"))
    small = (F.col("docs") <= cell) & (F.col("of") * 8 <= cell_bytes)
    sizes = written(sizes.join(work, "comp").withColumn("whole", small | (F.col("docs") * F.col("docs") <= F.col("by_keys"))), "hanging-sizes")
    whole = hot_join(comps, sizes.where("whole").select("comp", "docs", "of"), "comp", members, "docs")
    whole = whole.select("rank", F.col("comp").alias("g"), F.col("docs").alias("n"), F.col("of").alias("shingles"), F.lit(-1).alias("tree"))
    apart = sizes.where("not whole").select("comp", "docs")
    apart = written(apart.join(of_key.groupBy("comp").agg(F.count(F.lit(1)).alias("keys")), "comp"), "apart")
    by_key = hot_join(of_key.select("comp", "key", F.col("n").alias("docs")), apart.select("comp", "keys"), "comp", members, "keys")
    by_key = written(by_key.select("key", "docs"), "apart-keys")
    met_keys, by_key = by_key, hot_join(met, by_key, "key", members, "docs")
    by_key = by_key.select("rank", F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("g"), "n", "shingles", F.col("tree").cast("int").alias("tree"))
    out = written(whole.unionByName(by_key), "groups")
    removed(keys, met, sizes, apart, met_keys)
    return out


def classes(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, cell: int = CELL, cell_bytes: int = CELL_BYTES) -> tuple[DataFrame, DataFrame]:
    """For rows of ``(doc_id, text)``: ``(doc_id, node)`` of each row, and ``(node, copies, rank, n_links, class_rank)`` of each text.

    ``node`` is a text's digest, ``rank`` the least id among its rows with the
    digest, ``class_rank`` the least rank of the class.
    """
    depths = own_depths(threshold, trees, depth, recall)
    root = min(depths)
    depth = min(depth, root + MAX_LEVELS)
    depths = [min(d, depth) for d in depths]
    texts = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("node"), "text")
    rows = written(signed(texts, size, trees, root, depth), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("least")
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), least, F.first("size").alias("size"), F.first("roots").alias("roots"))
    nodes = written(nodes.select("node", "copies", "size", "roots", _rank(F.col("least.doc_id"), F.col("node")).alias("rank")), "nodes")

    own = F.element_at(F.array(*[F.lit(d) for d in depths]), F.least(F.col("size"), F.lit(len(depths) - 1)).cast("int") + 1)
    met = nodes.select("rank", "size", own.alias("own"), F.posexplode("roots").alias("tree", "root"))
    shared = written(met.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("low")).where("n > 1"), "roots")
    met = written(hot_join(perhaps_in(met, shared, "root"), shared, "root", nodes.count() * trees).drop("n"), "met")
    wanted = met.select("rank").distinct()
    held = perhaps_in(texts.select(_rank(F.col("doc_id"), F.col("node")).alias("rank"), "text"), wanted, "rank")
    held = held.join(wanted.hint("merge"), "rank").dropDuplicates(["rank"])
    grown = written(_grown(held, size, trees, root, depth), "grown")
    at = _assigned(met, grown, root, depth)
    groups = _groups(at, cell, cell_bytes)

    parts = F.greatest(F.ceil(F.col("n") / cell), F.ceil(F.col("shingles") * 8 / cell_bytes)).cast("int")
    seen = F.map_from_entries(F.collect_list(F.struct("tree", "key")))
    seen = at.groupBy("rank").agg(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.element_at(seen, t), F.lit(0))).alias("keys"))
    cells = groups.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rank", "g"), F.col("parts")).cast("int"))
    cells = cells.groupBy("rank").agg(F.collect_list(F.struct("g", "parts", "part", "tree")).alias("cells"), F.max("tree").alias("last"))
    cells = cells.join(seen.hint("merge"), "rank").select("rank", "cells", F.when(F.col("last") > 0, F.col("keys")).alias("keys"))
    cells = cells.join(nodes.select("rank", "copies").hint("merge"), "rank")
    cells = cells.join(grown.select("rank", "shingles").hint("merge"), "rank").withColumn("cell", F.explode("cells")).select("*", "cell.*").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    whole = (F.col("parts") == 1) & (F.col("tree") < 0)
    cells = cells.select("g", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), whole.alias("whole"), (F.col("part") > F.col("other")).cast("int").alias("side"), "tree", "rank", "copies", "keys", "shingles")
    found = written(_compared(cells.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b"), threshold), "links")

    links = found.groupBy("rank").agg(F.sum("links").alias("links"))
    # A component that was one cell is settled; the rest hangs together across cells.
    roots = components(found.where("not whole").select(F.col("rank").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("rank"), "root")
    roots = roots.unionByName(found.where("whole").select("rank", "root"))
    each = nodes.select("node", "rank", "copies").join(links.hint("merge"), "rank", "left").join(roots.hint("merge"), "rank", "left")
    each = each.select("node", "copies", "rank", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rank").alias("class_rank"))
    each = written(each, "classes")
    removed(nodes, shared, met, grown, at, groups, found)
    return rows.select("doc_id", "node"), each


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, class_id, n_links)``, one row for each row of ``docs``.

    ``n_links``: how many other rows have a Jaccard similarity of at least the
    threshold, copies included (exact among pairs that meet; all but one in a
    thousand at the threshold do, and more above). ``class_id``: the least id
    that links lead to. Equal texts are copies; null is the empty text; texts
    without words link to their copies only. Null ids are kept and name a class
    only if no other id does; repeated rows count as copies. An empty table
    gives no rows. Other columns are not read.
    """
    rows, each = classes(_plain(docs, id_col, text_col), **options)
    each = each.select("node", "copies", _id_of(F.col("class_rank")).alias("class_id"), "n_links")
    return hot_join(rows, each, "node", rows.count(), "copies").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with the least id of their class, one for each class, with all columns.

    A null text is the empty text; texts without words are near only to equal
    ones. A null id stays where its class has no other. Of rows with the same id
    and text one stays, any of them; of different texts with the least id, that
    with the least digest. An empty table stays empty. Columns may have any
    names. Rows that go are found by an anti join, after a bitmap has told most
    of those that stay, which don't move.
    """
    rows, each = classes(_plain(docs, id_col, text_col), **options)
    # (id, text) of rows that go, and of rows that stay once though they come several times.
    listed = rows.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("times"))
    alone = (F.col("copies") == 1) & (F.col("rank") == F.col("class_rank"))
    listed = hot_join(listed, each.where(~alone).select("node", "copies", "class_rank"), "node", rows.count(), "copies")
    listed = listed.select(_rank(F.col("doc_id"), F.col("node")).alias("own"), "class_rank", "times")
    listed = written(listed.select("own", (F.col("own") == F.col("class_rank")).alias("stays"), "times").where("not stays or times > 1"), "decided")
    own = fresh(docs, "own")
    named = docs.withColumn(own, _rank(F.col(f"`{id_col}`").cast("long"), F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")))))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    decided = listed.select(F.col("own").alias(own), "stays")
    # A row that the bitmap of these does not hold stays where it is.
    perhaps = perhaps_in(named, decided.select(own), own)
    out = surely_not_in(named, decided.select(own), own).select(*columns)
    out = out.unionByName(perhaps.join(decided.select(own).hint("merge"), own, "left_anti").select(*columns))
    if listed.where("stays").isEmpty():
        return out
    return out.unionByName(perhaps.join(decided.where("stays").select(own).hint("merge"), own, "left_semi").dropDuplicates([own]).select(*columns))

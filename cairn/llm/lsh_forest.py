"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly (operator 10).

Every text has TREES labels of DEPTH minimum hashes each; the labels of a tree, cut to a prefix, are the nodes of its
sorted prefix trie. Texts that share a trie node are candidates.

Whole labels first: a text is compared with the text that is the least of most of its nodes, its pivot. Jaccard distance is
a metric, so all texts within half of the threshold's distance of one pivot are linked with each other: such a cluster needs
no further comparison within, however large it is. Then prefixes shorten, FIRST values and then one less at a time, and at
each length pairs of different clusters that meet for the first time are verified. A pair of similarity s shares a
prefix of p values in some tree with probability 1 - (1 - s^p)^TREES; the links found, each weighted by the inverse of
its own, tell how many there are, and shortening ends when RECALL of these are found. At the length whose probability is RECALL
even at the threshold it ends in any case.

Each pair of different texts that share a node is verified once, by the exact Jaccard similarity of their sets of word
shingles, in the first node that they share. A node's members are dealt over blocks of bounded rows and bytes, and each
two blocks meet in a group of bounded size, which gives a row for each text: how many it is linked with, and the least one that it
reaches there. Blocks of one cluster do not meet, nor do those of two clusters with pivots so far apart that no members can
be linked. So every link is counted and joins its classes, and pairs are never rows.

Result: a row for each document: class_id (the least doc_id that it is linked with, directly or by others), copy_of (the
least doc_id of the same text), links (how many different texts that share a trie node or cluster with its text reach the
threshold).

Cases: null and empty texts, and those without words, are linked with equal texts only (null with null); texts of fewer
than five words have one shingle, all their words; very long texts are compared whole, in blocks with few others; repeated
rows are copies; rows that share a doc_id count as one document, of the least text, and each gets its class, and one row of the least text
stays; rows with a null doc_id get null class and no links; an empty table gives an empty table; ties go to the lower
doc_id; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import arrow_map, components, discard, documents, likely, one_row_each, one_text_each, slices, stored
from cairn.llm.shingles import THRESHOLD, WORDS, MinHash, jaccard, shingles, word_hashes

TREES, DEPTH, FIRST, RECALL = 16, 8, 6, 0.9995
BLOCK, BYTES = 512, 8 << 20  # of a block: texts, and characters of all of them (or one text)


def shortest_prefix(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix with the recall, so the last one that shortening comes to."""
    return max([1, *(p for p in range(1, depth + 1) if 1 - (1 - threshold**p) ** trees >= recall)])


def sketches(docs: DataFrame, trees: int, depth: int, words: int) -> DataFrame:
    """doc_id, key (the text's 128-bit digest; empty for null), signature (null without words)."""

    def make():
        minhash = MinHash(trees * depth)

        def step(columns: dict) -> dict:
            out = {"doc_id": columns["doc_id"], "key": [], "signature": []}
            for text in columns["text"]:
                hashes = shingles(word_hashes(text or ""), words)
                out["key"].append(b"" if text is None else xxhash.xxh3_128_digest(text.encode()))
                out["signature"].append(minhash.of(hashes).astype(">u4").tobytes() if len(hashes) else None)
            return out

        return step

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, key binary, signature binary", ["doc_id", "key", "signature"])


def trie_node(tree, prefix, depth: int):
    """The node that a signature's label has in a tree under a prefix."""
    return F.xxhash64(tree, prefix, F.substr(F.col("signature"), tree * (4 * depth) + 1, prefix * 4))


def trie_nodes(trees: int, depth: int, prefix: int):
    """The nodes of a signature, one for each tree."""
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: trie_node(t, F.lit(prefix), depth))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the documents in ids, and some others. docs: distinct ids."""
    return likely(docs.select(F.col("doc_id").alias("id"), "text").where("id IS NOT NULL"), ids)


def with_texts(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """pairs (id, other) with text and text_other; of bodies only what pairs name is shuffled, but for some."""
    own = likely(bodies.select("id", "text"), pairs.select("id"))
    others = likely(bodies.select(F.col("id").alias("other"), F.col("text").alias("text_other")), pairs.select("other"), "other")
    return pairs.join(own, "id").join(others, "other")


def candidates(texts: DataFrame, trees: int, depth: int, prefix: int) -> DataFrame:
    """The texts (id, signature) that share a node of this prefix with another."""
    rows = texts.where("signature IS NOT NULL").select("id", F.explode(trie_nodes(trees, depth, prefix)).alias("node"))
    pairs = rows.groupBy("node").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("node")
    return texts.join(rows.join(pairs, "node", "left_semi").select("id").distinct(), "id", "left_semi")


def likeness(pairs: DataFrame, bodies: DataFrame, words: int) -> DataFrame:
    """id, other, alike: the exact similarity of pairs (id, other)."""
    both = with_texts(pairs, bodies)

    def run(batches):
        last, last_set = None, None
        for batch in slices(batches):
            out = []
            for j, text, text_other in zip(*(batch.column(c).to_pylist() for c in ("other", "text", "text_other")), strict=True):
                if j != last:  # a text that many are compared with comes many times in a row
                    last, last_set = j, np.unique(shingles(word_hashes(text_other), words))
                out.append(jaccard(np.unique(shingles(word_hashes(text), words)), last_set))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "other": batch.column("other"), "alike": pa.array(out, pa.float64())})

    return both.select("id", "other", "text", "text_other").mapInArrow(run, "id long, other long, alike double")


def clusters(texts: DataFrame, bodies: DataFrame, threshold: float, trees: int, depth: int, words: int) -> DataFrame:
    """id, cluster: the pivot (the least text of most nodes of a text's whole labels) if it is so near that all that are as
    near to it are linked, else the text itself."""
    rows = texts.select("id", F.explode(trie_nodes(trees, depth, depth)).alias("node"))
    least = stored(rows.groupBy("node").agg(F.min("id").alias("pivot"), F.max("id").alias("most")).where("pivot < most").select("node", "pivot"), "least")
    votes = rows.join(least, "node").where("pivot < id").groupBy("id", "pivot").count()
    chosen = stored(votes.groupBy("id").agg(F.max(F.struct("count", -F.col("pivot"))).alias("v")).select("id", (-F.col("v.col2")).alias("other")), "chosen")
    near = likeness(chosen, bodies, words).where(F.col("alike") >= (1 + threshold) / 2).select("id", F.col("other").alias("cluster"))
    found = stored(texts.select("id").join(near, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster")), "clusters")
    discard(least, chosen)
    return found


def dealt(members: DataFrame, bodies: DataFrame, threshold: float, words: int, block: int, size: int) -> DataFrame:
    """node, x, y, id, own (x or y): a row for each two blocks that meet and each member of either. members: node, id, cluster, size.

    Members of a cluster that fills blocks in a node have blocks of their own.
    """
    of = lambda rows, total: F.greatest(F.ceil(rows / block), F.ceil(total / size)).cast("int")
    nodes = members.groupBy("node").agg(of(F.count("*"), F.sum("size")).alias("blocks"))
    hot = stored(nodes.where("blocks > 1").select("node"), "hot")
    zero = F.lit(0).cast("long")
    one_block = lambda rows: rows.select("node", zero.alias("x"), zero.alias("y"), "id", zero.alias("own"))
    if hot.isEmpty():
        discard(hot)
        return one_block(members)
    small = one_block(members.join(hot, "node", "left_anti"))
    large = stored(members.join(hot, "node", "left_semi"), "large")
    cells = large.groupBy("node", "cluster").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    full = of(F.col("n"), F.col("total")) > 1
    cells = stored(cells.select("node", "cluster", F.when(full, F.col("cluster")).alias("alone"), "n", "total"), "cells")
    parts = stored(cells.groupBy("node", "alone").agg(of(F.sum("n"), F.sum("total")).alias("parts")), "parts")
    name = lambda part: F.xxhash64("node", "alone", part)
    held = large.join(cells.select("node", "cluster", "alone"), ["node", "cluster"]).alias("l").join(parts.alias("r"), F.expr("l.node = r.node AND l.alone <=> r.alone")).select("l.*", "parts")
    held = held.select("node", "id", name(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("own"))
    blocks = parts.select("node", "alone", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("node", "alone", name(F.col("part")).alias("own"))
    meets = blocks.alias("a").join(blocks.alias("b"), F.expr("a.node = b.node AND a.own <= b.own AND NOT coalesce(a.alone = b.alone, false)"))
    meets = stored(meets.select(F.col("a.node").alias("node"), F.col("a.own").alias("x"), F.col("b.own").alias("y"), F.least("a.alone", "b.alone").alias("id"), F.when(F.expr("a.alone <> b.alone"), F.greatest("a.alone", "b.alone")).alias("other")), "meets")
    apart = likeness(stored(meets.where("other IS NOT NULL").select("id", "other").distinct(), "apart"), bodies, words)
    # members are within (1 - threshold) / 2 of their pivots
    far = apart.where(F.col("alike") < 1 - 2 * (1 - threshold) - 1e-9).select("id", "other")
    meets = meets.join(far, ["id", "other"], "left_anti").select("node", "x", "y")
    sides = meets.select("node", F.col("x").alias("own"), "x", "y").union(meets.where("x <> y").select("node", F.col("y").alias("own"), "x", "y"))
    return small.union(held.join(sides, ["node", "own"]).select("node", "x", "y", "id", "own"))


def links(texts: DataFrame, docs: DataFrame, threshold: float, trees: int, depth: int, recall: float, words: int, block: int = BLOCK, size: int = BYTES) -> DataFrame:
    """id, least, n: the texts that have links in a cluster or a group of two blocks of a trie node; least: the least text
    that these links reach; n: how many there are. texts: id, signature."""
    shortest = shortest_prefix(threshold, trees, depth, recall)
    some = stored(candidates(texts, trees, depth, shortest), "candidates")
    bodies = stored(texts_of(docs, some.select("id")), "texts")
    cluster = clusters(some, bodies, threshold, trees, depth, words)
    sizes = cluster.groupBy("cluster").agg((F.count("*") - 1).alias("n")).where("n > 0")
    found = [stored(cluster.join(sizes, "cluster").select("id", F.col("cluster").alias("least"), "n"), "links")]
    about = stored(some.join(cluster, "id").join(bodies.select("id", F.char_length("text").cast("long").alias("size")), "id"), "about")
    lengths = [p for p in range(min(FIRST, depth), shortest, -1)] + [shortest]
    n, expected = 0, dict.fromkeys(lengths, 0.0)
    for p, longer in zip(lengths, [None, *lengths[:-1]], strict=True):
        own = trie_nodes(trees, depth, p)
        before = trie_nodes(trees, depth, longer) if longer else F.transform(own, lambda _: F.lit(0).cast("long"))
        labelled = about.select("id", "cluster", "size", own.alias("nodes"), before.alias("before"))
        rows = labelled.select("id", "cluster", "size", F.explode(F.arrays_zip("nodes", "before")).alias("z")).select("id", "cluster", "size", "z.nodes", "z.before").withColumnRenamed("nodes", "node")
        mixed = "low < high" + (" AND first < last" if longer else "")
        nodes = rows.groupBy("node").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.min("before").alias("first"), F.max("before").alias("last")).where(mixed).select("node")
        members = stored(rows.join(nodes, "node").select("node", "id", "cluster", "size"), "members")
        groups = dealt(members, bodies, threshold, words, block, size)
        told = labelled.select("id", "cluster", "nodes", "before").join(bodies, "id")
        meet = met(threshold, words, longer is not None, lengths, trees)
        found.append(stored(groups.join(told, "id").groupBy("node", "x", "y").applyInArrow(meet, "id long, least long, n long, weights array<double>"), "links"))
        sums = found[-1].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *(F.coalesce(F.sum(F.col("weights")[i]), F.lit(0.0)).alias(f"w{i}") for i in range(len(lengths)))).first()
        n += sums.n
        expected = {q: x + sums[f"w{i}"] for i, (q, x) in enumerate(expected.items())}
        discard(members)
        if n >= recall * expected[p]:
            break
    discard(some, bodies, cluster, about)
    out = found[0]
    for more in found[1:]:
        out = out.union(more.select("id", "least", "n"))
    return out


def met(threshold: float, words: int, shortened: bool, lengths: list[int], trees: int):
    """`meeting` with its options; a link's weight for each prefix length is the inverse of the probability to find it."""
    weights = lambda alike: np.stack([1 / (1 - (1 - alike**p) ** trees) for p in lengths], -1)
    return lambda key, table: meeting(key, table, threshold, words, shortened, weights)


def meeting(key, table: pa.Table, threshold: float, words: int, shortened: bool, weights) -> pa.Table:
    """The links between two blocks of a node (or within one), of pairs of different clusters that shared no longer prefix
    and share no node of a tree before."""
    node, x, y = (k.as_py() for k in key)
    ids, own, cluster = (table[c].to_numpy() for c in ("id", "own", "cluster"))
    labels = lambda c: table[c].combine_chunks().values.to_numpy().reshape(len(ids), -1)
    nodes = labels("nodes")
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    todo = cluster[left][:, None] != cluster[right]
    if x == y:
        todo &= ids[left][:, None] < ids[right]
    for tree in range(int((nodes[0] == node).argmax())):
        todo &= nodes[left, tree][:, None] != nodes[right, tree]
    if shortened:
        for column in labels("before").T:
            todo &= column[left][:, None] != column[right]
    asked = np.zeros(len(ids), bool)
    asked[left[todo.any(1)]] = asked[right[todo.any(0)]] = True
    links, alike = np.zeros((len(ids), len(ids)), bool), np.zeros((len(ids), len(ids)))
    if asked.any():
        sets = [np.unique(shingles(word_hashes(t), words)) if some else np.zeros(0, np.uint64) for t, some in zip(table["text"].to_pylist(), asked, strict=True)]
        sizes = np.array([len(s) for s in sets])
        both = in_common(sets, left, right)
        alike[np.ix_(left, right)] = both / np.maximum(sizes[left][:, None] + sizes[right] - both, 1)
        links[np.ix_(left, right)] = todo & (alike[np.ix_(left, right)] >= threshold - 1e-12)
    return linked(ids, links | links.T, np.maximum(alike, alike.T), weights)


def in_common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 1 << 15) -> np.ndarray:
    """How many values each set of left has in common with each of right, by bits for the values of several sets."""
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    several = counts > 1
    column, row = (np.cumsum(several) - 1)[column[several[column]]], row[several[column]]
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(several.sum()), width):
        now = (column >= at) & (column < at + width)
        bits = np.zeros((len(sets), -(-min(width, int(several.sum()) - at) // 64) * 64), bool)
        bits[row[now], column[now] - at] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        there = packed[right]
        for i, k in enumerate(left):
            if packed[k].any():
                out[i] += np.bitwise_count(packed[k] & there).sum(1, dtype=np.int64)
    return out


def linked(ids: np.ndarray, links: np.ndarray, alike: np.ndarray, weights) -> pa.Table:
    """id, least, n, weights (summed over the links) of the texts with links (a symmetric table)."""
    some = np.flatnonzero(links.any(1))
    ids, links, alike = ids[some], links[np.ix_(some, some)], alike[np.ix_(some, some)]
    counts, least = links.sum(1), ids.copy()
    while len(ids):
        after = np.minimum(least, np.where(links, least, np.iinfo(np.int64).max).min(1))
        if (after == least).all():
            break
        least = after
    row, column = np.nonzero(links)
    each = weights(alike[row, column])
    first = np.cumsum(counts) - counts
    sums = np.add.reduceat(each, first) if len(ids) else each
    return pa.table({"id": pa.array(ids, pa.int64()), "least": pa.array(least, pa.int64()), "n": pa.array(counts, pa.int64()), "weights": pa.array(sums.tolist(), pa.list_(pa.float64()))})


def join_documents(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, words: int = WORDS, **blocks: int) -> DataFrame:
    """doc_id, class_id, copy_of, links."""
    single = one_text_each(docs)
    sketched = stored(sketches(single, trees, depth, words), "sketches")
    texts = sketched.groupBy("key").agg(F.min(F.struct(F.col("doc_id").alias("id"), "signature")).alias("x")).select("x.*")
    edges = links(texts, single, threshold, trees, depth, recall, words, **blocks)
    classes = components(edges.select(F.col("id").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("copy_of"), "root")
    degree = edges.groupBy("id").agg(F.sum("n").alias("count")).select(F.col("id").alias("copy_of"), "count")
    least = sketched.groupBy("key").agg(F.min("doc_id").alias("copy_of"))
    about = least.join(classes, "copy_of", "left").join(degree, "copy_of", "left")
    # stored, so that the join on a text's key, of which many may be copies, is split where it is hot
    about = stored(about.select("key", "copy_of", F.coalesce("root", "copy_of").alias("class_id"), F.coalesce("count", F.lit(0)).alias("links")), "about")
    known = sketched.select("doc_id", "key").join(about, "key").select("doc_id", "class_id", "copy_of", "links")
    if hasattr(single, "_repeated"):
        known = docs.select("doc_id").join(known, "doc_id")
    return known.union(docs.where("doc_id IS NULL").select("doc_id", *(F.lit(None).cast("long").alias(c) for c in ("class_id", "copy_of")), F.lit(0).cast("long").alias("links")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class, the least doc_id (of rows that share it, one with the least text); rows without an id stay."""
    joined = join_documents(docs, **options)
    kept = joined.where("doc_id = class_id").select("doc_id").distinct()
    first = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    return one_row_each(first).unionByName(docs.where("doc_id IS NULL"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(documents(spark, sf_dir))

"""Jaccard join on word n-grams as a blocked product of the document by n-gram incidence matrix.

1. Documents with the same n-gram set become one row of the matrix (128-bit set key, combined per task).
2. Column blocks. Two sets of sizes a and b that are similar enough differ in at most a bounded number of n-grams, which
   follows from a and b. A hash cuts the columns into more blocks than that, so similar sets agree on several whole column
   blocks that are not empty; a set with fewer blocks in common with all others together has no partner. The number of blocks depends on the size class of the smaller set; a set takes part in its
   own class and in those of sets that may be the smaller partner. Rows that agree on a block are chained to each other,
   first within each batch, then across, so no list of rows is formed. Per size class, components of these edges are
   the diagonal blocks outside which the product is below the bound.
3. Within a diagonal block, overlaps are accumulated over chunks of columns by a dense product; pairs whose overlap so
   far plus what is left of the smaller row is below the needed overlap are discarded. A block of many rows is cut by
   hash into parts that are multiplied pairwise. Rows travel to their products as texts, and where parts make many copies of
   them, products are computed in rounds, each of which moves no more than the texts of the table. Each product returns a
   spanning forest of its links and the number of links per row, so pairs never leave the task.
4. Components of the forests are the result.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from launchlens.llm.common import cuts, map_texts, mix, semi_filter, stored
from launchlens.llm.components import components
from launchlens.llm.shingles import Words, set_keys

#: Rows, and n-grams, of a part of a block: a task holds two.
PART_ROWS = 4096
PART_GRAMS = 1 << 22
#: Rows, and n-grams, of one side of a dense product.
BLOCK_ROWS = 512
BLOCK_GRAMS = 1 << 19
#: N-grams that a round of products may move in any case; larger tables may move as many as they have.
ROUND_GRAMS = 1 << 26
#: Columns multiplied at once.
COLUMNS = 4096


class Schemes:
    """Size classes and their column blocks. Scheme c holds the pairs whose smaller set is in class c."""

    def __init__(self, percent: int):
        self.bounds, self.top, self.blocks, self.spare = [1], [], [], []
        while self.bounds[-1] < 1 << 40:
            lo = self.bounds[-1]
            self.bounds.append(lo * 100 // percent + 1)
            hi = self.bounds[-1] - 1
            top = hi * 100 // percent
            differ = max(s - 2 * -(-percent * s // (100 + percent)) for s in (hi + top - 1, hi + top))
            # blocks that are empty in both sets agree too: keep more agreeing blocks than a set has empty ones
            d = max(0, differ)
            log_odds = lambda g, d=d, n=lo: (  # noqa: E731  that a set of the class has g empty blocks
                math.lgamma(d + g + 1) - math.lgamma(g + 1) - math.lgamma(d + 1) + n * math.log(d / (d + g)) if d else -99)
            rare = -5.5 if lo < 28 else -7  # blocks should hold more than one n-gram
            spare = next((g for g in range(1, 64) if log_odds(g) < rare), 64)
            self.top.append(top)
            self.blocks.append(d + spare)
            self.spare.append(spare)

    def of(self, n: int) -> list[int]:
        c = bisect.bisect_right(self.bounds, n) - 1
        out = [c]
        while c > 0 and n <= self.top[c - 1]:
            c -= 1
            out.append(c)
        return out


def block_signatures(schemes: Schemes, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, index of the set, scheme, signatures that a similar set shares at least) of every column block that is not empty, for all schemes of each set. A set with so
    many empty blocks that they could be all it shares gets one more signature, common to such sets of the scheme."""
    signatures, owners = [], []
    work = [(i, c) for i, s in enumerate(sets) if len(s) for c in schemes.of(len(s))]
    if not work:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = np.array([schemes.blocks[c] for _, c in work], np.int64)
    scheme = np.array([c for _, c in work], np.uint64)
    start = np.concatenate([[0], np.cumsum(blocks)])
    sizes = [len(sets[i]) for i, _ in work]
    grams = np.concatenate([sets[i] for i, _ in work])
    which = np.repeat(np.arange(len(work)), sizes)
    drawn = mix(grams + (scheme[which] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    slot = start[which] + ((drawn >> np.uint64(32)) * blocks[which].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    by = np.argsort(slot, kind="stable")
    slot, value = slot[by], mix(grams[by] ^ np.uint64(0x5DEECE66D))
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    sums = np.add.reduceat(value, first)
    slot = slot[first]
    at = which[by][first]
    signatures.append(mix(sums * np.uint64(0xD6E8FEB86659FD93) + (scheme[at] << np.uint64(40)) + (slot - start[at]).astype(np.uint64)))
    owners.append(at)
    empty = blocks - np.bincount(at, minlength=len(work))
    # all but `differ` blocks agree, and of these no more than the set's own empty ones have no signature
    shared = np.array([schemes.spare[c] for _, c in work]) - empty
    odd = np.flatnonzero(shared <= 0)
    signatures.append(mix(scheme[odd] + np.uint64(0x7F4A7C15)))
    owners.append(odd)
    to_set = np.array([i for i, _ in work])
    at = np.concatenate(owners)
    return np.concatenate(signatures), to_set[at], scheme[at], np.maximum(shared, 1)[at]


def _set_keys(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    schemes = Schemes(percent)

    def worker():
        def step(texts):
            sets = Words(texts).shingles(k)
            keys = [set_keys(s) for s in sets]
            return [[len(s) for s in sets], [a for a, _ in keys], [b for _, b in keys],
                    [schemes.of(len(s)) if len(s) else [] for s in sets]]
        return step

    return map_texts(docs, id_col, text_col, worker, "n long, k1 long, k2 long, schemes array<int>", rows_at_once=256)


def _node(id_col: str, scheme: str):
    """A document in a scheme, as a number. Two that share a number only make a block larger."""
    return F.xxhash64(id_col).bitwiseXOR(F.shiftleft(F.col(scheme).cast("long"), 56))


def _nodes_with_partners(picked: DataFrame, k: int, percent: int) -> DataFrame:
    """node: those that have as many signatures in common with other nodes, whichever, as two similar sets have at least.

    A document that only shares a passage with others has a few such signatures and drops out here.
    A row of the shuffle, the largest of the join, is 40 bits of signature, 8 of needed and counted and 48 of node.
    Signatures or nodes that are equal in these bits only let more nodes remain. Returns the nodes' low 48 bits."""
    schemes = Schemes(percent)

    def sign(batches):
        """counts = 0: a signature, 2 * needed + whether it is counted; counts > 0: needed, and so many counted signatures."""
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy().view(np.uint64)
            for start, end in cuts(texts, 1024, 1 << 21):
                sig, at, scheme, need = block_signatures(schemes, Words(texts[start:end]).shingles(k))
                by = np.argsort(sig, kind="stable")
                sig, need = sig[by].view(np.int64), np.minimum(need[by], 127)
                node = (ids[start:end][at] & np.uint64((1 << 40) - 1) | (scheme & np.uint64(255)) << np.uint64(40))[by]
                first = np.concatenate([np.ones(min(1, len(sig)), bool), sig[1:] != sig[:-1]])
                more = np.concatenate([sig[1:] == sig[:-1], np.zeros(min(1, len(sig)), bool)]) | ~first
                names, place, count = np.unique(node[more], return_index=True, return_counts=True)
                sig, meta = np.concatenate([sig[first].view(np.uint64), mix(names)]), np.concatenate([2 * need[first] + more[first], 2 * need[more][place]])
                node = np.concatenate([node[first], names])
                packed = sig & np.uint64(0xFFFFFFFFFF000000) | meta.astype(np.uint64) << np.uint64(16) | node >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(packed.view(np.int64)), pa.array(node.astype(np.uint32).view(np.int32)),
                    pa.array(np.concatenate([np.zeros(int(first.sum()), np.int32), count.astype(np.int32)])),
                ], names=["packed", "low", "counts"])

    def count(batches):
        """(node, needed, counted) of count rows, and of signatures that have a neighbour with the same one."""
        held = None
        for batch in batches:
            packed, low, counts = (batch.column(i).to_numpy() for i in range(3))
            packed = packed.view(np.uint64)
            sig, meta = packed >> np.uint64(24), (packed >> np.uint64(16)).astype(np.int64) & 255
            node = ((packed & np.uint64(0xFFFF)) << np.uint64(32) | low.view(np.uint32).astype(np.uint64)).view(np.int64)
            direct, own = counts > 0, counts == 0
            out = [(node[direct], meta[direct] // 2, counts[direct].astype(np.int64))]
            if own.any():
                sig, node, meta = sig[own], node[own], meta[own]
                if held is not None:
                    sig, node, meta = (np.concatenate([[h], x]) for h, x in zip(held[:3], (sig, node, meta), strict=True))
                same = sig[1:] == sig[:-1]
                twice = np.zeros(len(sig), bool)
                twice[1:] |= same
                twice[:-1] |= same
                last = bool(twice[-1])
                if held is not None:
                    last = last or (len(sig) == 1 and held[3])
                    twice[0] &= not held[3]
                held = (sig[-1], node[-1], meta[-1], last)
                new = twice & (meta % 2 == 0)
                out.append((node[new], meta[new] // 2, np.ones(int(new.sum()), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], names=["node", "need", "n"])

    return (
        picked.mapInArrow(sign, "packed long, low int, counts int").repartition(F.shiftright("packed", 24)).sortWithinPartitions("packed")
        .mapInArrow(count, "node long, need long, n long").groupBy("node").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
        .filter("n >= need").select("node")
    )


#: Hash cells of the table of remaining nodes.
NODE_BITS = 20


def _candidate_edges(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): nodes that agree on a column block, as chains. Nodes without enough signatures in common are left out: a bit table
    of fixed size tells the tasks which remain, and lets a few others pass."""
    picked = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.xxhash64(id_col).alias("id"), F.col(text_col).alias("text"))
    schemes = Schemes(percent)
    nodes = stored(_nodes_with_partners(picked, k, percent).withColumn("cell", F.col("node").bitwiseAND((1 << NODE_BITS) - 1)))
    bits = np.zeros(1 << NODE_BITS, bool)
    bits[nodes.select("cell").distinct().toPandas()["cell"].to_numpy(np.int64)] = True
    table = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    # a document's bits differ from its node's in the upper eight only
    cells = nodes.select("cell").distinct()
    picked = picked.join(F.broadcast(cells), F.col("id").bitwiseAND((1 << NODE_BITS) - 1) == F.col("cell"), "left_semi")

    def sign(batches):
        """Per batch one row for each signature, and edges between the rows of the batch that have it."""
        kept = np.unpackbits(table.value).astype(bool)
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy().view(np.uint64)
            for start, end in cuts(texts, 1024, 1 << 21):
                sig, at, scheme, _ = block_signatures(schemes, Words(texts[start:end]).shingles(k))
                stays = kept[((ids[start:end][at] ^ (scheme << np.uint64(56))) & np.uint64((1 << NODE_BITS) - 1)).astype(np.int64)]
                sig, at, scheme = sig[stays], at[stays], scheme[stays]
                by = np.argsort(sig, kind="stable")
                sig, node = sig[by].view(np.int64), (ids[start:end][at] ^ (scheme << np.uint64(56)))[by].view(np.int64)
                first = np.concatenate([np.ones(min(1, len(sig)), bool), sig[1:] != sig[:-1]])
                hub = node[first][np.cumsum(first) - 1] if len(sig) else node
                inner = np.unique(np.stack([node, hub])[:, node != hub], axis=1)
                spread = mix(inner[0].view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([sig[first], spread])), pa.array(np.concatenate([node[first], inner[0]])),
                    pa.concat_arrays([pa.nulls(int(first.sum()), pa.int64()), pa.array(inner[1])]),
                ], names=["sig", "a", "b"])

    def chain(batches):
        """Edges as they are, and one between neighbours that have the same signature."""
        last_sig = last_a = None
        for batch in batches:
            inner = pc.is_valid(batch.column(2))
            rows, edges = batch.filter(pc.invert(inner)), batch.filter(inner)
            a, b = [edges.column(1).to_numpy()], [edges.column(2).to_numpy()]
            if rows.num_rows:
                sig, node = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                if last_sig == sig[0]:
                    a.append(node[:1])
                    b.append(np.array([last_a]))
                same = np.flatnonzero(sig[1:] == sig[:-1])
                a.append(node[same + 1])
                b.append(node[same])
                last_sig, last_a = sig[-1], node[-1]
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return (
        picked.mapInArrow(sign, "sig long, a long, b long").repartition("sig").sortWithinPartitions("sig")
        .mapInArrow(chain, "a long, b long").distinct()
    )


def _links(sets: list[np.ndarray], big: np.ndarray, split: int, percent: int):
    """Yield (row, array of linked rows). split > 0: only pairs of the first split rows with the others. Pairs of two
    sets above the size class belong to another product."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    a, b = (np.arange(split), np.arange(split, m)) if split else (np.arange(m), np.arange(m))
    # overlap o needs 100 o >= percent (na + nb - o)
    need = -((-percent * (sizes[a][:, None] + sizes[b][None, :])) // (100 + percent))
    alive = (np.minimum(sizes[a][:, None], sizes[b][None, :]) >= need) & ~(big[a][:, None] & big[b][None, :])
    if not split:
        alive &= a[:, None] < b[None, :]
    if not alive.any():
        return
    row = np.repeat(np.arange(m), sizes)
    names, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = counts[column] > 1
    row, column = row[again], np.cumsum(counts > 1)[column[again]] - 1
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    left = np.bincount(row, minlength=m)
    overlap = np.zeros(need.shape, np.int64)
    alive &= np.minimum(left[a][:, None], left[b][None, :]) >= need
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, n_columns, COLUMNS):
        rows_a, rows_b = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows_a):
            return
        i, j = np.searchsorted(column, [start, start + COLUMNS])
        r, c = row[i:j], column[i:j] - start
        left -= np.bincount(r, minlength=m)
        width = int(min(COLUMNS, n_columns - start))
        x = np.zeros((m, width), np.float32)
        x[r, c] = 1
        part = x[a[rows_a]] @ x[b[rows_b]].T
        grid = np.ix_(rows_a, rows_b)
        overlap[grid] += np.rint(part).astype(np.int64)
        alive[grid] &= overlap[grid] + np.minimum(left[a[rows_a]][:, None], left[b[rows_b]][None, :]) >= need[grid]
    alive &= overlap >= need
    for i in np.flatnonzero(alive.any(axis=1)):
        yield int(a[i]), b[np.flatnonzero(alive[i])]


def _blocks(sets: list[np.ndarray], start: int, end: int) -> list[np.ndarray]:
    """The rows start to end - 1, cut for dense products."""
    out, first, held = [], start, 0
    for i in range(start, end):
        if i > first and (i - first >= BLOCK_ROWS or held + len(sets[i]) > BLOCK_GRAMS):
            out.append(np.arange(first, i))
            first, held = i, 0
        held += len(sets[i])
    return [*out, np.arange(first, end)]


def _product(rows: list[tuple], percent: int):
    """(doc, smallest doc that its links of this product reach, number of linked documents) of each row."""
    rows = list({r[5:9]: r for r in rows}.values())  # an id may be repeated with its text
    _, lo, hi = rows[0][:3]
    if lo != hi:
        rows.sort(key=lambda r: r[3] != lo)
    split = sum(r[3] == lo for r in rows) if lo != hi else 0
    if len(rows) < 2 or (lo != hi and split in (0, len(rows))):
        return
    big, docs, copies = np.array([r[4] for r in rows]), [r[5] for r in rows], np.array([r[6] for r in rows])
    sets = [r[9] for r in rows]
    by_doc = sorted(range(len(rows)), key=docs.__getitem__)
    group = np.empty(len(rows), np.int64)  # place by id of the smallest row reached
    group[by_doc] = np.arange(len(rows))
    links = np.zeros(len(rows), np.int64)
    if split:
        pairs = itertools.product(_blocks(sets, 0, split), _blocks(sets, split, len(rows)))
    else:
        pairs = itertools.combinations_with_replacement(_blocks(sets, 0, len(rows)), 2)
    for x, y in pairs:
        at, cut = (x, 0) if x is y else (np.concatenate([x, y]), len(x))
        for i, js in _links([sets[i] for i in at], big[at], cut, percent):
            i, js = at[i], at[js]
            links[i] += copies[js].sum()
            links[js] += copies[i]
            met = np.unique(np.append(group[js], group[i]))
            if len(met) > 1:
                group[np.isin(group, met)] = met[0]
    for i in np.flatnonzero(links).tolist():
        yield docs[i], docs[by_doc[group[i]]], int(links[i])


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, n_links, component_id, one row per row of docs.

    Words are runs of non-space characters with A-Z lowered; documents link when the Jaccard similarity of their sets of
    k-word shingles is at least percent / 100. A shorter document has its whole word sequence as one shingle; without words
    (null or empty text) it has none and links with nothing. component_id is the smallest id reachable. Ids are the
    nodes: rows that repeat an id belong together. A row without id links with nothing and has no component. n_links
    counts the linked documents, copies included. An empty table gives an empty result; other columns are not read."""
    signed = stored(_set_keys(docs, k, percent, id_col, text_col))
    usable = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy("n", "k1", "k2", "schemes").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    blocks = stored(components(_candidate_edges(docs, k, percent, id_col, text_col), "a", "b"))
    forest = stored(_products(docs, classes, blocks, k, percent, id_col, text_col))
    linked = forest.groupBy("doc").agg(F.sum("links").alias("links"))
    joined = components(forest, "doc", "root")
    members = stored(
        classes.select("n", "k1", "k2", "rep", "copies")
        .join(linked, F.col("rep") == F.col("doc"), "left").join(joined, F.col("rep") == F.col("node"), "left")
        .select("n", "k1", "k2", F.coalesce("component", "rep").alias("component"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    with_id = usable.select("doc_id", "n", "k1", "k2").join(members, ["n", "k1", "k2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    rest = signed.filter("n = 0 OR doc_id IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return with_id.unionByName(rest)


def _products(docs: DataFrame, classes: DataFrame, blocks: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, root, links) of every product of the blocks."""
    spread = classes.withColumn("scheme", F.explode("schemes")).withColumn("node", _node("rep", "scheme"))
    rows = stored(spread.join(blocks, "node").select(
        "rep", "n", "k1", "k2", "copies", "component", (F.col("scheme") != F.col("schemes")[0]).alias("big")))
    cut = lambda m, grams: F.greatest(F.ceil(m / PART_ROWS), F.ceil(grams / PART_GRAMS)).cast("long")
    small = lambda x: F.sum(F.when(~F.col("big"), x).otherwise(0))
    sizes = rows.groupBy("component").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams"), small(F.lit(1)).alias("small"), small(F.col("n")).alias("small_grams"))
    parts = stored(
        sizes.filter("m > 1 AND small > 0").withColumn("whole", cut(F.col("m"), F.col("grams")) <= 1)
        .select("component", "whole", cut(F.col("small"), F.col("small_grams")).alias("p"),
                cut(F.col("m") - F.col("small"), F.col("grams") - F.col("small_grams")).alias("q"),
                "grams", "small_grams")
    )
    # parts 0 to p-1 hold the sets of the size class, parts p to p+q-1 larger ones, which meet the former only
    hashed = F.xxhash64("rep", F.lit("part"))
    own = F.when(F.col("whole"), 0).when(F.col("big"), F.col("p") + F.pmod(hashed, F.col("q"))).otherwise(F.pmod(hashed, F.col("p")))
    others = F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.when(F.col("big"), F.col("p")).otherwise(F.col("p") + F.col("q")) - 1))
    moved = F.when(F.col("whole"), F.col("grams")).otherwise(
        F.col("small_grams") * (F.col("p") + F.col("q")) + (F.col("grams") - F.col("small_grams")) * F.col("p"))
    rounds = -(-(parts.agg(F.sum(moved)).first()[0] or 0) // max(ROUND_GRAMS, classes.agg(F.sum("n")).first()[0] or 0))
    planned = (
        rows.join(parts.drop("grams", "small_grams"), "component").withColumn("own", own.cast("long"))
        .select("rep", "k1", "k2", "copies", "big", "component", "own", F.explode(others).alias("other"))
        .select("rep", "k1", "k2", "copies", "big", "component", F.least("own", "other").alias("lo"),
                F.greatest("own", "other").alias("hi"), "own")
    )
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")

    def worker():
        def step(texts):
            keys = [set_keys(s) for s in Words(texts).shingles(k)]
            return [[a for a, _ in keys], [b for _, b in keys], texts]
        return step

    id_type = T._parse_datatype_string(f"doc {classes.schema['rep'].dataType.simpleString()}")[0].dataType
    schema = T.StructType([T.StructField("doc", id_type), T.StructField("root", id_type), T.StructField("links", T.LongType())])

    def multiply(batches):
        held, at = [], None
        for batch in batches:
            cols, texts = [c.to_pylist() for c in batch.columns[:-1]], batch.column(batch.num_columns - 1).to_pylist()
            sets = (s for start, end in cuts(texts, 256, 1 << 21) for s in Words(texts[start:end]).shingles(k))
            done = []
            for key, *rest, grams in zip(zip(*cols[:3], strict=True), *cols[3:], sets, strict=True):
                if key != at:
                    done += _product(held, percent) if held else []
                    held, at = [], key
                held.append((*key, *rest, grams))
            yield _forest(done, schema)
        yield _forest(list(_product(held, percent)) if held else [], schema)

    def multiplied(cells: DataFrame) -> DataFrame:
        texts = map_texts(semi_filter(ids, "doc_id", cells, "rep"), "doc_id", "text", worker, "k1 long, k2 long, text string", rows_at_once=256)
        return (
            cells.join(texts.withColumnRenamed("doc_id", "rep"), ["rep", "k1", "k2"])
            .select("component", "lo", "hi", "own", "big", "rep", "copies", "k1", "k2", "text")
            .repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(multiply, schema)
        )

    if rounds <= 1:
        return multiplied(planned)
    turn = F.pmod(F.xxhash64("component", "lo", "hi", F.lit("round")), F.lit(rounds))
    return functools.reduce(DataFrame.unionByName, [stored(multiplied(planned.filter(turn == i))) for i in range(rounds)])


def _forest(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)], schema=arrow)

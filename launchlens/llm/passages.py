"""Substring deduplication: MinHash banding of passages.

A passage is WINDOW words long and begins at an anchor: a word whose shingle hash is the smallest of some ANCHOR_SPAN
words in a row. Anchors depend on the words alone, so a text of WINDOW + ANCHOR_SPAN words that stands in two
documents, in whatever surroundings, gives both the same passage; a shorter document is one passage. Each
passage has BANDS signatures of ROWS minima over its five-word shingles. Signatures are dealt to tasks by their first bits, as lists, and
sorted there in arrays, cell by cell. Passages with a band in common form a bucket. The
exact Jaccard similarity is computed first against the first and the previous passage of the bucket; in buckets that do
not become one cluster by that, all passages are compared with each other. Components of similar passages are
clusters, and every place of their passages is looked up in the documents by key. All passages of a cluster but the first are
removals.

Recall: identical passages always collide. One at similarity s does with 1 - (1 - s^ROWS)^BANDS, 0.97 at 0.8 and 0.998
at 0.9, and a repeated text of n words holds about n / 10 overlapping passages, each of which has its chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from launchlens.llm.common import cuts, mix, semi_filter, stored
from launchlens.llm.components import components
from launchlens.llm.shingles import Words, run_hashes

SHINGLE = 5
WINDOW = 32
ANCHOR_SPAN = 18
BANDS = 5
ROWS = 3
PERCENT = 80
#: Passages of several shingles that are all alike are one word over and over, and not compared.
LEAST_SHINGLES = 2
#: Passages of a bucket that one task compares with each other; larger buckets are cut, and each two parts compared.
BLOCK = 1024
#: A cell holds the signatures with the same CELL_BITS first bits, and is grouped at once in memory.
CELL_BITS = 12
#: Signatures of a task that are dealt to the cells together.
SIGNED = 1 << 19
#: Groups of up to so many passages are compared together, larger ones each by itself.
SMALL = 32


#: Runs are well mixed already, so an odd factor orders them anew.
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _halves(x: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Minima of the largest power of two up to width; two of them, so far apart, make a window."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out, width - have


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width] for every i with a full window."""
    if len(x) < width:
        return x[:0]
    out, rest = _halves(x, width)
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _min_at(x: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Minimum of x[i:i + width] for the i given."""
    if not len(at):
        return x[:0]
    out, rest = _halves(x, width)
    return np.minimum(out[at], out[at + rest])


class Passages:
    """Passages of several texts: text, first and last word, set key, signatures (one row per band)."""

    def __init__(self, texts: list[str], bands: int = BANDS):
        words = Words(texts)
        runs = run_hashes(words.hashes, SHINGLE)
        n, per = len(words.hashes), WINDOW - SHINGLE + 1
        owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
        full = np.arange(max(0, n - WINDOW + 1))
        full = full[owner[full] == owner[full + WINDOW - 1]] if len(full) else full
        # anchors: the place of the minimum in each span of shingles that lies in one text
        span = _sliding_min(runs, ANCHOR_SPAN)
        m = len(span)
        one = owner[:m] == owner[ANCHOR_SPAN + SHINGLE - 2:][:m]
        # the largest of the minima of all spans that hold a shingle is the shingle itself if one of them is
        anchor, lows = np.zeros(n, bool), np.zeros(m + 2 * (ANCHOR_SPAN - 1), np.uint64)
        lows[ANCHOR_SPAN - 1:][:m][one] = span[one]
        anchor[:m + ANCHOR_SPAN - 1] = runs[:m + ANCHOR_SPAN - 1] == ~_sliding_min(~lows, ANCHOR_SPAN) if m else False
        self.first = full[anchor[full]]
        self.last = self.first + WINDOW - 1
        sig = [_min_at(runs * _FACTORS[j], per, self.first) for j in range(bands * ROWS)]
        values = mix(runs + np.uint64(0x51ED270B))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        key = mix(sums[self.first + per] - sums[self.first]) if len(self.first) else np.zeros(0, np.uint64)
        whole = np.flatnonzero((np.diff(words.bounds) < WINDOW + ANCHOR_SPAN) & (np.diff(words.bounds) >= SHINGLE))
        if len(whole):
            a, b = words.bounds[whole], words.bounds[whole + 1]
            self.first, self.last = np.concatenate([self.first, a]), np.concatenate([self.last, b - 1])
            pieces = [runs[i:j - SHINGLE + 1] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            sig = [np.concatenate([s, [(p * _FACTORS[j]).min() for p in pieces]]) for j, s in enumerate(sig)]
            key = np.concatenate([key, mix(np.array([mix(p + np.uint64(0x51ED270B)).sum(dtype=np.uint64) for p in pieces], np.uint64))])
        rich = self._rich(runs)
        self.first, self.last = self.first[rich], self.last[rich]
        self.key = key[rich].view(np.int64)
        self.text, self._words = owner[self.first], words
        self.signatures = []
        for band in range(bands):
            code = np.full(len(self.first), band + 1, np.uint64)
            for s in sig[band * ROWS:(band + 1) * ROWS]:
                code = mix(code * np.uint64(0xD6E8FEB86659FD93) + s.astype(np.uint64)[rich])
            self.signatures.append(code.view(np.int64))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last character (exclusive) of each passage in its text."""
        words = self._words
        if not len(self.first):
            return self.first, self.first
        chars = np.cumsum((words.bytes & 0xC0) != 0x80)  # characters up to and with each byte
        base = np.concatenate([[0], chars])[words.text_start[self.text]]
        return chars[words.begin[self.first]] - 1 - base, chars[words.end[self.last] - 1] - base

    def sets(self, rows: np.ndarray) -> pa.ListArray:
        """Sorted distinct shingles of the passages in these rows."""
        runs = run_hashes(self._words.hashes, SHINGLE).view(np.int64)
        first, width = self.first[rows], self.last[rows] - self.first[rows] - SHINGLE + 2
        stop = np.cumsum(width)
        values, new = np.zeros(stop[-1] if len(rows) else 0, np.int64), np.ones(stop[-1] if len(rows) else 0, bool)
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            to = (stop[own] - w)[:, None] + np.arange(w)
            values[to] = cells = np.sort(runs[first[own][:, None] + np.arange(w)], axis=1)
            new[to[:, 1:]] = cells[:, 1:] != cells[:, :-1]
        ends = np.concatenate([[0], np.cumsum(new)[stop - 1]]) if len(rows) else np.zeros(1)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[new]))

    def _rich(self, runs: np.ndarray) -> np.ndarray:
        """Whether a passage has different shingles, or only one."""
        changes = np.concatenate([[0, 0], np.cumsum(runs[1:] != runs[:-1])])
        stop = self.last - SHINGLE + 2
        return (changes[stop] - changes[self.first + 1] >= LEAST_SHINGLES - 1) | (stop - self.first == 1)


def _texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))


def _edges(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows with the smallest and the largest document of each key; equal keys have equal signatures."""
    by = np.argsort(key)
    same = key[by[1:]] == key[by[:-1]]
    often = np.zeros(len(key), bool)
    often[1:] |= same
    often[:-1] |= same
    once, by = by[~often], by[often]  # few come often, only they are sorted in full
    by = by[np.lexsort((doc[by], key[by]))]
    edge = np.flatnonzero(key[by[1:]] != key[by[:-1]])
    first, last = np.concatenate([by[:1], by[edge + 1]]), np.concatenate([by[edge], by[-1:]])
    return np.concatenate([once, first, last[doc[last] != doc[first]]])


def _shared(sig: np.ndarray, key: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """sig, key, smallest doc, first and previous key of the signature, of each key of the signatures that several docs have, in order."""
    by = np.argsort(sig)
    same = sig[by[1:]] == sig[by[:-1]]
    often = np.zeros(len(sig), bool)
    often[1:] |= same
    often[:-1] |= same
    by = by[often]  # most stand alone, only the others are sorted in full
    by = by[np.lexsort((doc[by], key[by], sig[by]))]
    sig, key, doc = sig[by], key[by], doc[by]
    if not len(by):
        return [sig, key, doc, key, key]
    new = np.concatenate([[True], sig[1:] != sig[:-1]])
    begin = np.flatnonzero(new)
    wide = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
    rows = np.flatnonzero(wide[np.cumsum(new) - 1] & (new | np.concatenate([[True], key[1:] != key[:-1]])))
    sig, key, doc, new = sig[rows], key[rows], doc[rows], new[rows]
    first = key[new][np.cumsum(new) - 1]
    return [sig, key, doc, first, np.where(new, key, np.concatenate([key[:1], key[:-1]]))]


def _colliding(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """sig, key, doc, first, previous, several: the different passages of each band signature that more than one document has.

    doc is the smallest document with the passage, several whether the signature has several passages; then first and
    previous are the smallest of their keys and the one before this, each null where it is the key itself."""
    picked = _texts_of(docs, id_col, text_col)
    id_type = picked.schema["doc"].dataType
    schema = T.StructType([T.StructField("cell", T.LongType()), *(T.StructField(name, T.ArrayType(t)) for name, t in (
        ("sigs", T.LongType()), ("keys", T.LongType()), ("docs", id_type)))])
    arrow = to_arrow_schema(schema)
    found = T.StructType([T.StructField("sig", T.LongType()), T.StructField("key", T.LongType()), T.StructField("doc", id_type), T.StructField("first", T.LongType()), T.StructField("previous", T.LongType()), T.StructField("several", T.BooleanType())])
    found_arrow = to_arrow_schema(found)

    def ranked(ids):
        """Numbers in the order of the ids, and the function from such numbers to ids."""
        if pa.types.is_integer(ids.type):
            return ids.to_numpy(zero_copy_only=False), lambda numbers: pa.array(numbers, ids.type)
        different = pc.unique(ids)
        different = different.take(pc.sort_indices(different))
        return pc.index_in(ids, different).to_numpy(zero_copy_only=False), lambda numbers: different.take(pa.array(numbers))

    def sign(batches):
        """Signatures, keys and documents by cell; of a key that a batch holds often, the smallest and the largest document."""
        for batch in batches:
            texts, rows, many = batch.column(1).to_pylist(), [], 0
            rank, ids_of = ranked(batch.column(0))
            for begin, stop in cuts(texts, 1024, 1 << 21):
                p = Passages(texts[begin:stop])
                doc = rank[begin + p.text]
                edges = _edges(p.key, doc)
                rows += [(sig[edges], p.key[edges], doc[edges]) for sig in p.signatures]
                many += BANDS * len(edges)
                if many >= SIGNED or stop == len(texts):
                    sig, key, doc = (np.concatenate(x) for x in zip(*rows, strict=True))
                    rows, many = [], 0
                    by = np.argsort(sig)
                    cell = sig[by] >> (64 - CELL_BITS)
                    edge = np.concatenate([np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[:len(cell)]), [len(cell)]])
                    lists = [pa.array(sig[by]), pa.array(key[by]), ids_of(doc[by])]
                    yield pa.RecordBatch.from_arrays([pa.array(cell[edge[:-1]])] + [
                        pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), x).cast(arrow.field(i).type) for i, x in enumerate(lists, 1)], schema=arrow)

    def shared(cells):
        """What the signatures of whole cells share."""
        sig, key, ids = (cells.column(i).combine_chunks().flatten() for i in (1, 2, 3))
        rank, ids_of = ranked(ids)
        sig, key, doc, first, previous = _shared(sig.to_numpy(), key.to_numpy(), rank)
        several = (first != key) | (np.concatenate([sig[1:], sig[:1] + 1]) == sig)  # one alone is the first and the last of its signature
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(key), ids_of(doc), pa.array(first, mask=first == key),
                                           pa.array(previous, mask=previous == key), pa.array(several)], schema=found_arrow)

    def share(batches):
        """The cells of each batch; the last one waits for the next batch."""
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            if held and cell[0] != held[-1].column(0)[-1].as_py():
                yield shared(pa.Table.from_batches(held))
                held = []
            last = int(np.searchsorted(cell, cell[-1]))
            if last:
                yield shared(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield shared(pa.Table.from_batches(held))

    return picked.mapInArrow(sign, schema).repartition("cell").sortWithinPartitions("cell").mapInArrow(share, found)


def _places(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, doc, start, end: every place of the passages with one of the keys."""
    picked = _texts_of(docs, id_col, text_col)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc", picked.schema["doc"].dataType),
                           T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def place(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, stop in cuts(texts, 1024, 1 << 21):
                p = Passages(texts[begin:stop], 0)
                start, end = p.places()
                yield pa.RecordBatch.from_arrays([
                    pa.array(p.key), ids.take(pa.array(begin + p.text)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], schema=arrow)

    return semi_filter(picked.mapInArrow(place, schema), "key", keys, "key").join(keys, "key", "left_semi").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, shingles: the shingle set of each wanted passage (key, doc), cut from a text of its document."""
    places = stored(wanted.groupBy("doc").agg(F.collect_list("key").alias("keys")))
    texts = semi_filter(_texts_of(docs, id_col, text_col), "doc", places, "doc").join(places, "doc").select("doc", "text", "keys").distinct()
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def cut(batches):
        for batch in batches:
            texts, keys = batch.column(0).to_pylist(), batch.column(1)
            for begin, stop in cuts(texts, 1024, 1 << 21):
                p, part = Passages(texts[begin:stop], 0), keys.slice(begin, stop - begin)
                ask = np.repeat(np.arange(stop - begin), pc.list_value_length(part).to_numpy())
                # passages and asked keys in one order of (text, key): the first passage of each asked pair
                text, key = np.concatenate([ask, p.text]), np.concatenate([part.flatten().to_numpy(), p.key])
                is_passage = np.arange(len(text)) >= len(ask)
                by = np.lexsort((is_passage, key, text))
                hit = (text[by[1:]] == text[by[:-1]]) & (key[by[1:]] == key[by[:-1]]) & is_passage[by[1:]] & ~is_passage[by[:-1]]
                rows = by[1:][hit] - len(ask)
                yield pa.RecordBatch.from_arrays([pa.array(p.key[rows]), p.sets(rows).cast(arrow.field(1).type)], schema=arrow)

    sets = stored(texts.select("text", "keys").mapInArrow(cut, schema))
    # an id with several texts may hold a key in more than one of them
    if sets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return sets
    return stored(sets.groupBy("key").agg(F.min("shingles").alias("shingles")))


def _similar(sizes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Which of several sets, given one after the other, reach PERCENT with which."""
    n = len(sizes)
    _, at, count = np.unique(shingles, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = count[at] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[at[shared]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    common = np.zeros((n, n), np.float32)
    width = 4096
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [begin, begin + width])
        part = np.zeros((n, min(width, int(column[b - 1]) - begin + 1)), np.float32)
        part[row[a:b], column[a:b] - begin] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    return 100 * common >= PERCENT * (sizes[:, None] + sizes[None, :] - common)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix."""
    free, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not free[root]:
            continue
        free[root], todo = False, [root]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(linked[i] & free)
            free[new] = False
            out += [(i, j) for j in new.tolist()]
            todo += new.tolist()
    return out


def _stars(group: np.ndarray, sizes: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of groups of up to SMALL sets, given one after the other: the first row of its component and the row, for every other row."""
    n, row = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    value = shingles ^ mix(group.astype(np.uint64) + np.uint64(1)).view(np.int64)[row]  # keeps the groups apart
    by = np.argsort(value)
    value, row = value[by], row[by]
    at, pairs = np.arange(len(value)), [np.zeros(0, np.int64)]
    for step in range(1, SMALL):
        at = at[:np.searchsorted(at, len(value) - step)]
        at = at[value[at + step] == value[at]]
        if not len(at):
            break
        a, b = np.minimum(row[at], row[at + step]), np.maximum(row[at], row[at + step])
        pairs.append((a * SMALL + b - a)[group[a] == group[b]])
    pair, common = np.unique(np.concatenate(pairs), return_counts=True)
    a, b = pair // SMALL, pair // SMALL + pair % SMALL
    near = 100 * common >= PERCENT * (sizes[a] + sizes[b] - common)
    a, b, root = a[near], b[near], np.arange(n)
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    rows = np.flatnonzero(root != np.arange(n))
    return root[rows], rows


def _links_inside(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links that join what is similar within each bucket (sig, key); all its keys are compared with each other."""
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("sig")) / (BLOCK // 2))
    cut = buckets.withColumn("parts", F.when(parts > 2, parts).otherwise(1).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "key"), "parts").cast("int"))
    cut = cut.select("sig", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    cut = cut.select("sig", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "key").join(sets, "key")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def links(table):
        """Links of the whole groups of a table."""
        group = np.stack([table.column(i).to_numpy() for i in range(3)])
        edge = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1
        begin, stop = np.concatenate([[0], edge]), np.concatenate([edge, [table.num_rows]])
        key, sets = table.column(3).to_numpy(), table.column(4).combine_chunks()
        sizes, shingles = pc.list_value_length(sets).to_numpy().astype(np.int64), sets.flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(sizes)])
        number = np.repeat(np.arange(len(begin)), stop - begin)
        small = (stop - begin <= SMALL)[number]
        rows = np.flatnonzero(small)
        a, b = _stars(number[rows], sizes[rows], shingles[np.repeat(small, sizes)])
        yield key[rows[a]], key[rows[b]]
        for i, j in zip(begin[stop - begin > SMALL].tolist(), stop[stop - begin > SMALL].tolist(), strict=True):
            edges = np.array(_forest(_similar(sizes[i:j], shingles[at[i]:at[j]])), np.int64).reshape(-1, 2)
            yield key[i + edges[:, 0]], key[i + edges[:, 1]]

    def compare(batches):
        """The groups of each batch; the last one waits for the next batch."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = (pa.concat_tables([held, new]) if held is not None else new).combine_chunks()
            last = np.stack([held.column(i).to_numpy() for i in range(3)])
            changes = np.flatnonzero((last[:, 1:] != last[:, :-1]).any(0))
            if not len(changes):
                continue
            whole, held = held.slice(0, changes[-1] + 1), held.slice(changes[-1] + 1)
            for a, b in links(whole):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if held is not None:
            for a, b in links(held):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return cut.select("sig", "i", "j", "key", "shingles").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(compare, schema)


def _different(buckets: DataFrame) -> DataFrame:
    """buckets (sig, key and more) without those that hold the same keys as another: similar passages meet in most of their bands.

    Which keys a bucket holds is told by their number and 128 bits of hashes."""
    sums = [F.bit_xor(F.xxhash64(F.lit(i), "key")).alias(f"h{i}") for i in (1, 2)]
    same = buckets.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), *sums)
    return buckets.join(same.groupBy("n", "h1", "h2").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi")


def _clusters(buckets: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, component: the passages that are similar to others, by key; buckets are the rows of _colliding with several passages."""
    sets = _sets(docs, buckets.select("key", "doc").distinct(), id_col, text_col)
    pairs = stored(buckets.select(F.explode(F.array("first", "previous")).alias("a"), F.col("key").alias("b")).dropna().distinct())
    common = F.size(F.array_intersect("sa", "sb"))
    links = stored(
        pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
        .filter(100 * common >= PERCENT * (F.size("sa") + F.size("sb") - common)).select("a", "b")
    )
    labels = stored(components(links, "a", "b"))
    label, bucket = F.coalesce("component", "key"), Window.partitionBy("sig")
    rest = buckets.join(labels, F.col("key") == F.col("node"), "left").select("sig", "key", label.alias("label"))
    several = F.min("label").over(bucket) != F.max("label").over(bucket)
    # a bucket of two has been compared as a whole
    rest = stored(rest.select("sig", "key", several.alias("several"), F.count(F.lit(1)).over(bucket).alias("n")).filter("several AND n > 2").select("sig", "key"))
    return _joined(labels, _links_inside(rest, sets))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after links (a, b) between their nodes, or others, are added: only components are joined."""
    ends = links.distinct()
    for end in "ab":
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    merged = stored(components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "a", "b"))
    into = merged.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return stored(labels.join(into, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
                  .unionByName(merged.join(labels, "node", "left_anti")))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, cluster, kept: passages that documents share, one row per span and cluster.

    Places are characters, ends exclusive; a passage reaches from its first to its last word, white space and case of A-Z do
    not count. cluster is the smallest id of the documents that share the passage; there, kept is true and the passage
    stays. Spans of one document that overlap or touch are merged; the merged span is kept only if all its parts are.
    A document without a shared passage has no row, so null, empty and short texts have none. An id is one document:
    its repeated rows share nothing with each other."""
    found = stored(_colliding(docs, id_col, text_col))
    members = stored(_places(docs, stored(found.select("key").distinct()), id_col, text_col))
    labels = _clusters(stored(_different(found.filter("several").drop("several"))), docs, id_col, text_col)
    grouped = stored(members.join(labels, F.col("key") == F.col("node"), "left").select(
        F.coalesce("component", "key").alias("component"), "doc", "start", "end"))
    clusters = stored(grouped.groupBy("component").agg(F.min("doc").alias("cluster"), F.max("doc").alias("last")).filter("cluster <> last"))
    spans = grouped.join(clusters, "component").select("doc", "start", "end", "cluster", (F.col("doc") == F.col("cluster")).alias("kept"))
    # overlapping spans of a document, in order: extend the last one or open a new one
    along = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1))
    span = F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return opened.withColumn("span", span).groupBy(F.col("doc").alias("doc_id"), "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("cluster").alias("cluster"), F.min("kept").alias("kept"),
    ).drop("span")

"""Benchmark decontamination by templates.

Texts become sequences of lowered words in which numbers, units after numbers and, in a second reading, names are typed
placeholders. Windows of five such words are hashed. A bit table of fixed size tells executors which windows any
benchmark item has; only those leave the task and meet the item windows in a hash join. Windows that lie on one diagonal
(document position minus item position) are one occurrence. Its slots must be consistent: equal values in the item stand
for equal values in the document, so a question with other numbers or names is caught, and a chance mixture is not.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens.llm.common import drop_rows, map_texts, mix, stored

WORDS = 5
LEAST_COVER = 0.8
#: Words of a window that must not be placeholders.
LEAST_LITERAL = 2
FILTER_BITS = 22
#: Unit words after a number (fixed values).
UNITS = ("mm cm m km in inch inches ft feet yd yards mi mile miles mg g kg lb lbs oz pound pounds t ton tons ml l liter liters litre "
         "litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar "
         "dollars euro euros cent cents percent mph kmh w kw v a hz").split()

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[[*range(48, 58)]] = 2
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
_STEP = 0x9E3779B97F4A7C15
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x6E756D62, 0x756E6974, 0x6E616D65))


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    power, inverse = np.full(n, _STEP, np.uint64), np.full(n, pow(_STEP, -1, 1 << 64), np.uint64)
    power[:1] = inverse[:1] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * np.cumprod(power))])
    return mix((sums[end] - sums[begin]) * np.cumprod(inverse)[begin])


def _unit_hashes() -> np.ndarray:
    raw = [u.encode() for u in UNITS]
    ends = np.cumsum([len(r) for r in raw])
    return _hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)


class Templates:
    """Word sequences of several texts: hash with placeholders, kind (0 word, 1 number, 2 unit, 3 name), text, byte places."""

    def __init__(self, texts: list[str]):
        clean = [unicodedata.normalize("NFC", t) for t in texts]
        cased = [t.encode("utf-8", "surrogatepass") for t in clean]
        self.raw = [t.lower().encode("utf-8", "surrogatepass") for t in clean]
        # lowering may change a text's length in rare scripts: such texts have no names
        same = [len(a) == len(b) for a, b in zip(cased, self.raw, strict=True)]
        cased = b"\n".join(a if s else b for a, b, s in zip(cased, self.raw, same, strict=True)) + b"\n"
        self.data = np.frombuffer(b"\n".join(self.raw) + b"\n", np.uint8)
        up = np.frombuffer(cased, np.uint8) != self.data
        kind = _KIND[self.data]
        # a point or comma between digits belongs to the number
        digit = kind == 2
        inner = ((self.data == 46) | (self.data == 44)) & np.concatenate([[False], digit[:-1]]) & np.concatenate([digit[1:], [False]])
        kind = np.where(inner, 2, kind)
        change = np.diff(kind, prepend=0) != 0
        self.begin = np.flatnonzero(change & (kind > 0))
        self.end = np.flatnonzero((np.diff(kind, append=0) != 0) & (kind > 0)) + 1
        starts = np.cumsum([0] + [len(r) + 1 for r in self.raw])
        self.text = np.searchsorted(starts, self.begin, side="right") - 1
        h = _hashes(self.data, self.begin, self.end)
        self.kind = (kind[self.begin] == 2).astype(np.int8)
        after_number = np.concatenate([[False], (self.kind[:-1] == 1) & (self.text[1:] == self.text[:-1])])
        at = np.flatnonzero(after_number & (self.kind == 0))
        self.kind[at[np.isin(h[at], _unit_hashes())]] = 2
        # a name begins with a capital, has no other at its second letter, and does not begin a sentence
        capital = up[self.begin] | up[np.minimum(self.begin + 1, len(up) - 1)] & (self.data[self.begin] >= 195)
        second = np.minimum(self.begin + 1 + (self.data[self.begin] >= 195), len(up) - 1)
        shouted = (second < self.end) & (up[second] | up[np.minimum(second + 1, len(up) - 1)] & (self.data[second] >= 195))
        stops = np.cumsum(np.isin(self.data, np.frombuffer(b".!?:;\n\"'", np.uint8)))
        opens = np.concatenate([[True], (self.text[1:] != self.text[:-1]) | (stops[self.begin[1:]] != stops[self.end[:-1] - 1])])
        self.name = capital & ~shouted & ~opens & (self.kind == 0)
        self.hash = np.where(self.kind == 1, _NUMBER, np.where(self.kind == 2, _UNIT, h))

    def sequence(self, names: bool) -> np.ndarray:
        """Indices of the words of a reading; with names, runs of them count as one."""
        if not names:
            return np.arange(len(self.hash))
        again = np.concatenate([[False], self.name[1:] & self.name[:-1] & (self.text[1:] == self.text[:-1])])
        return np.flatnonzero(~again)

    def windows(self, names: bool):
        """Windows of a reading, a text of fewer words as one: hash, text, position, sequence, kinds, first word, size."""
        seq = self.sequence(names)
        text = self.text[seq]
        kind = np.where(self.name[seq], 3, self.kind[seq]) if names else self.kind[seq]
        h = np.where(kind == 3, _NAME, self.hash[seq]) if names else self.hash[seq]
        n = max(0, len(seq) - WORDS + 1)
        code, literal = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        for i in range(WORDS):
            code = code * _ROLL + h[i:i + n]
            literal += kind[i:i + n] == 0
        first = np.searchsorted(text, np.arange(len(self.raw) + 1))
        keep = np.flatnonzero((text[:n] == text[WORDS - 1:WORDS - 1 + n]) & (literal >= LEAST_LITERAL))
        out = [(mix(code[keep] + np.uint64(names)), text[keep], keep - first[text[keep]], keep, np.full(len(keep), WORDS))]
        for t in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < WORDS)).tolist():
            a, b = int(first[t]), int(first[t + 1])
            if (kind[a:b] == 0).any():
                code = np.array([b - a], np.uint64)
                for i in range(a, b):
                    code = code * _ROLL + h[i:i + 1]
                out.append((mix(code + np.uint64(names)), np.array([t]), np.array([0]), np.array([a]), np.array([b - a])))
        code, text, pos, at, size = (np.concatenate([o[i] for o in out]) for i in range(5))
        return code, text, pos, seq, kind, at, size

    def value(self, word: int, names: bool) -> str:
        """The text of a slot; of a run of names the whole."""
        last = word
        while names and self.name[word] and last + 1 < len(self.name) and self.name[last + 1] and self.text[last + 1] == self.text[word]:
            last += 1
        return bytes(self.data[self.begin[word]:self.end[last]]).decode("utf-8", "replace")


_WINDOWS = "windows array<struct<reading:int,hash:long,pos:int,slots:array<string>>>"


def _window_rows(texts: list[str], wanted: np.ndarray | None) -> list[list[dict]]:
    templates = Templates(texts)
    out: list[list[dict]] = [[] for _ in texts]
    for names in (False, True):
        if names and not templates.name.any():
            continue  # both readings are the same
        code, text, pos, seq, kind, at, size = templates.windows(names)
        if wanted is not None:
            a, b = _cells(code)
            hit = np.flatnonzero(wanted[a] & wanted[b])
        else:
            hit = np.arange(len(code))
        for i in hit.tolist():
            words = range(int(at[i]), int(at[i] + size[i]))
            out[text[i]].append({"reading": int(names), "hash": int(code[i].astype(np.int64)), "pos": int(pos[i]),
                                 "slots": [templates.value(int(seq[w]), names) for w in words if kind[w]]})
    return out


def _cells(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (code & mask).astype(np.int64), ((code >> np.uint64(32)) & mask).astype(np.int64)


def _windows_of(df: DataFrame, id_col: str, text_col: str, wanted) -> DataFrame:
    """id, text_key, reading, hash, pos, slots of each window."""
    def worker():
        bits = None if wanted is None else np.unpackbits(wanted.value).astype(bool)
        return lambda texts: [_window_rows(texts, bits)]

    keyed = df.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key")).alias("row"), F.col(text_col).alias("text"))
    return map_texts(keyed, "row", "text", worker, _WINDOWS, rows_at_once=256).select(
        F.col("doc_id.id").alias("id"), F.col("doc_id.text_key").alias("text_key"), F.explode("windows").alias("w")
    ).select("id", "text_key", "w.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, text_key, item_id, cover, changed: the documents that hold LEAST_COVER of an item's windows, and the item.

    Windows are WORDS words; a text with fewer is one window, so a short item is found in texts of the same length only. cover is the
    share of the item's windows found in consistent occurrences, in the better of both readings; changed tells that a slot
    has another value than the item. Nulls, empty texts and items without two plain words match nothing. A row
    that repeats id and text gives no second result; text_key (xxhash64 of the text) tells texts of one id apart."""
    spark = docs.sparkSession
    items = stored(_windows_of(benchmark, item_col, item_text_col, None).select(
        F.col("id").alias("item_id"), "reading", "hash", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots")).distinct())
    sizes = items.groupBy("item_id", "reading").agg(F.countDistinct("item_pos").alias("n"))
    found = items.select("hash").distinct().select(
        F.explode(F.array(F.col("hash").bitwiseAND((1 << FILTER_BITS) - 1),
                          F.shiftrightunsigned("hash", 32).bitwiseAND((1 << FILTER_BITS) - 1))).alias("cell")).distinct().toPandas()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[found["cell"].to_numpy(np.int64)] = True
    table = spark.sparkContext.broadcast(np.packbits(bits))  # 2**FILTER_BITS bits, whatever the benchmark
    hits = _windows_of(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, table).withColumnRenamed("id", "doc_id").distinct()
    met = hits.join(items, ["hash", "reading"]).withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    met = stored(met.filter(F.size("slots") == F.size("item_slots")))
    occurrence = ["doc_id", "text_key", "item_id", "reading", "diagonal"]
    slots = met.select(*occurrence, F.explode(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))).alias("s"))
    slots = slots.select(*occurrence, F.col("s.i").alias("item_value"), F.col("s.d").alias("value"))
    mixed = slots.groupBy(*occurrence, "item_value").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo <> hi")
    changed = slots.filter("item_value <> value").select(*occurrence).distinct().withColumn("other", F.lit(True))
    return (
        met.join(mixed.select(*occurrence).distinct(), occurrence, "left_anti").join(changed, occurrence, "left")
        .groupBy("doc_id", "text_key", "item_id", "reading", "item_pos").agg(F.max(F.coalesce("other", F.lit(False))).alias("other"))
        .groupBy("doc_id", "text_key", "item_id", "reading").agg(F.count(F.lit(1)).alias("got"), F.max("other").alias("changed"))
        .join(sizes, ["item_id", "reading"]).withColumn("cover", F.col("got") / F.col("n")).filter(F.col("cover") >= LEAST_COVER)
        .groupBy("doc_id", "text_key", "item_id").agg(F.max("cover").alias("cover"), F.min("changed").alias("changed"))
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns. Rows with a null id are kept."""
    bad = stored(contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_text")).distinct())
    return drop_rows(docs, id_col, bad, "_bad_id", F.xxhash64(docs[text_col]) == bad["_bad_text"])

"""Secret scan by a trigram inverted index, on DataFrame functions alone.

`trigram_query` derives from a rule's regular expression a Boolean query over trigrams, as alternatives of trigrams that
must all occur in every text with a match. The index has one posting (trigram, text key) per distinct trigram of a text,
for the trigrams that the rules ask for. Postings are intersected per text key by counting, and only candidates are
verified with the expression itself. A rule without a mandatory trigram scans every text.

The index folds A-Z, so its answer is a superset whatever the case; a text key is a hash of id and text, so rows that
share one only make more candidates. Candidates reach the texts through a table of at most FILTER_CELLS cells; only
texts of those cells are shuffled. Places are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchlens.llm.common import FILTER_CELLS, stored


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches whose `group` has at least `least` characters; the others are dropped, not retried."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base rules. A run of 32 and more hex digits is the same as a longest run that has 32.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Published formats of access tokens, keys and credentials in addresses.
FORMAT_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url", r"://[^\x00-\x20:/@]{1,64}:[^\x00-\x20:/@]{8,64}@"),
)
RULES = BASE_RULES + FORMAT_RULES

# ---------------------------------------------------------------------------------------------------------------------
# Trigram queries

#: A query is a set of alternatives, each a set of trigrams that must all occur; EVERYTHING asks for nothing.
Query = frozenset[frozenset[str]]
EVERYTHING: Query = frozenset([frozenset()])
#: Sets of strings, alternatives and character classes beyond these sizes ask for nothing, which is always right.
MANY_STRINGS, MANY_ALTERNATIVES, WIDE_CLASS = 64, 64, 8


def _either(queries: Iterable[Query]) -> Query:
    found = frozenset().union(*queries)
    least = frozenset(a for a in found if not any(b < a for b in found))
    return least if len(least) <= MANY_ALTERNATIVES else EVERYTHING


def _both(a: Query, b: Query) -> Query:
    if EVERYTHING in (a, b):
        return b if a == EVERYTHING else a
    if len(a) * len(b) > MANY_ALTERNATIVES:
        return min(a, b, key=len)
    return _either([frozenset(x | y for x in a for y in b)])


def _of_strings(strings: Iterable[str]) -> Query:
    return _either([frozenset([frozenset(s[i:i + 3] for i in range(len(s) - 2))]) for s in strings])


@dataclass(frozen=True)
class _Known:
    """What is known of all matches of a part: the whole strings (exact), or two characters of both ends and a query."""

    exact: frozenset[str] | None
    heads: frozenset[str]
    tails: frozenset[str]
    query: Query

    @staticmethod
    def strings(found: Iterable[str]) -> _Known:
        found = frozenset(found)
        whole = _Known(found, found, found, EVERYTHING)
        return whole if len(found) <= MANY_STRINGS else whole.opened()

    def opened(self) -> _Known:
        """The same without whole strings."""
        if self.exact is None:
            return self
        return _Known(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), _of_strings(self.exact))

    def then(self, other: _Known) -> _Known:
        if self.exact is not None and other.exact is not None:
            return _Known.strings(a + b for a in self.exact for b in other.exact)
        if len(self.tails) * len(other.heads) > MANY_STRINGS:
            across = EVERYTHING
        else:
            across = _of_strings(a + b for a in self.tails for b in other.heads)
        heads = self.heads if self.exact is None else frozenset((a + b)[:2] for a in self.exact for b in other.heads)
        tails = other.tails if other.exact is None else frozenset((a + b)[-2:] for a in self.tails for b in other.exact)
        return _Known(None, heads, tails, reduce(_both, [self.opened().query, other.opened().query, across]))

    def otherwise(self, other: _Known) -> _Known:
        if self.exact is not None and other.exact is not None:
            return _Known.strings(self.exact | other.exact)
        a, b = self.opened(), other.opened()
        return _Known(None, a.heads | b.heads, a.tails | b.tails, _either([a.query, b.query]))


_NOTHING = _Known.strings([""])
_ANYTHING = _Known(None, frozenset([""]), frozenset([""]), EVERYTHING)


def _fold(code: int) -> str:
    return chr(code + 32 if 65 <= code <= 90 else code)


def _known(parts) -> _Known:
    return reduce(_Known.then, (_part(str(op), value) for op, value in parts), _NOTHING)


def _part(op: str, value) -> _Known:
    if op == "LITERAL":
        return _Known.strings([_fold(value)])
    if op == "IN":
        spans = [(v, v) if str(o) == "LITERAL" else v if str(o) == "RANGE" else None for o, v in value]
        if None in spans or sum(b - a + 1 for a, b in spans) > WIDE_CLASS:
            return _ANYTHING
        return _Known.strings(_fold(c) for a, b in spans for c in range(a, b + 1))
    if op == "SUBPATTERN":
        return _known(value[-1])
    if op == "BRANCH":
        return reduce(_Known.otherwise, (_known(p) for p in value[1]))
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, inner = value
        one = _known(inner)
        if least == 0:
            return _NOTHING.otherwise(one) if most == 1 else _ANYTHING
        some = reduce(_Known.then, [one] * min(least, 4))
        return some if least == most and least <= 4 else some.then(_ANYTHING)
    return _NOTHING if op == "AT" else _ANYTHING


def trigram_query(pattern: str) -> Query:
    """The trigrams, with A-Z folded, of every text in which pattern matches; EVERYTHING if it has no mandatory one."""
    return _known(re._parser.parse(pattern)).opened().query


# ---------------------------------------------------------------------------------------------------------------------
# Index


def _finder(grams: Iterable[str]) -> str:
    """An expression whose group 1 at a place is the trigram that begins there, if it is one of grams."""
    tree: dict = {}
    for g in sorted(grams):
        tree.setdefault(g[0], {}).setdefault(g[1], set()).add(g[2])
    lit = lambda c: f"\\x{{{ord(c):x}}}"
    pairs = lambda sub: "|".join(f"{lit(b)}[{''.join(map(lit, sorted(cs)))}]" for b, cs in sorted(sub.items()))
    starts = "".join(map(lit, sorted(tree)))
    return f"(?i)(?=[{starts}])(?=({'|'.join(f'{lit(a)}(?:{pairs(sub)})' for a, sub in sorted(tree.items()))}))"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def build_index(docs: DataFrame, grams: Iterable[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings (gram, key): one row per text and distinct trigram out of grams that it holds."""
    grams = sorted(set(grams))
    rows = _keyed(docs, id_col, text_col)
    if not grams:
        return stored(rows.select(F.lit("").alias("gram"), "key").limit(0))
    found = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(_finder(grams)), F.lit(1)))
    rows = rows.select("key", F.explode(found).alias("gram")).select(F.translate("gram", _UPPER, _LOWER).alias("gram"), "key")
    return stored(rows)


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(key, rules): the numbers of the queries that the text of key can satisfy, from the postings alone."""
    asked = [(g, rule, branch, len(alt)) for rule, q in queries.items() for branch, alt in enumerate(sorted(q, key=sorted)) for g in sorted(alt)]
    table = index.sparkSession.createDataFrame(asked, "gram string, rule int, branch int, need int")  # as long as the rules
    hits = index.distinct().join(F.broadcast(table), "gram").groupBy("key", "rule", "branch").agg(
        F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    return hits.filter("n >= need").groupBy("key").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


# ---------------------------------------------------------------------------------------------------------------------
# Verification

_STEP = 256


def _running(values: Column) -> Column:
    """Running totals of a non-empty array of longs; pieces of _STEP keep the copying of long arrays in check."""
    empty = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("out"))

    def add(acc, x):
        return F.struct((acc["total"] + x).alias("total"), F.concat(acc["out"], F.array(acc["total"] + x)).alias("out"))

    last = F.floor((F.size(values) - 1) / _STEP).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(values, b * _STEP + 1, F.lit(_STEP)), empty, add))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<array<bigint>>").alias("out"))
    joined = F.aggregate(pieces, start, lambda acc, p: F.struct(
        (acc["total"] + p["total"]).alias("total"),
        F.concat(acc["out"], F.array(F.transform(p["out"], lambda x: x + acc["total"]))).alias("out")))
    return F.flatten(joined["out"])


SPAN = "struct<start:bigint,number:int,kind:string,end:bigint>"


def _with_spans(rows: DataFrame, number: int, rule: Rule, wanted: Column | None) -> DataFrame:
    """rows plus s{number}, the spans of one rule; rows where wanted is not true get none.

    Matches come without places, so they are counted from the stretches between them."""
    n = str(number)
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    rows = rows.withColumn("m" + n, found if wanted is None else F.when(wanted, found).otherwise(F.array().cast("array<string>")))
    some = F.size("m" + n) > 0
    steps = F.when(some, F.zip_with(
        F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size("m" + n)), F.col("m" + n), lambda gap, m: (F.length(gap) + F.length(m)).cast("long")))
    held = F.col("m" + n) if not rule.group else F.when(some, F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    rows = rows.withColumn("e" + n, F.when(some, _running(steps))).withColumn("g" + n, held)
    spans = F.transform(
        F.filter(F.arrays_zip(F.col("e" + n).alias("e"), F.col("m" + n).alias("m"), F.col("g" + n).alias("g")), lambda z: F.length(z["g"]) >= rule.least),
        lambda z: F.struct((z["e"] - F.length(z["m"])).alias("start"), F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), z["e"].alias("end")))
    return rows.withColumn("s" + n, F.when(some, spans).otherwise(F.array()).cast(f"array<{SPAN}>")).drop("m" + n, "e" + n, "g" + n)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (start, number of the rule, kind, end) in order of start and rule; one row per row of docs.

    A null or empty text has no span. Rows that repeat id and text all get their spans; of texts with the same id each
    has its own. Whole texts are searched, however long. Other columns are not read. An empty table gives an empty result."""
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    indexed = {i: q for i, q in queries.items() if q != EVERYTHING}
    rows = _keyed(docs, id_col, text_col)
    index = build_index(docs, {g for q in indexed.values() for alt in q for g in alt}, id_col, text_col)
    hits = stored(candidates(index, indexed))
    cell = F.pmod(F.xxhash64("key"), F.lit(FILTER_CELLS))
    cells = F.broadcast(stored(hits.select(cell.alias("cell")).distinct()))  # at most FILTER_CELLS numbers
    none = F.array().cast("array<int>")
    near = rows.join(cells, cell == F.col("cell"), "left_semi").join(hits, "key", "left").select("doc_id", "text", F.coalesce("rules", none).alias("rules"))
    far = rows.join(cells, cell == F.col("cell"), "left_anti")
    for i, rule in enumerate(rules):
        near = _with_spans(near, i, rule, F.array_contains("rules", i) if i in indexed else None)
        far = far if i in indexed else _with_spans(far, i, rule, None)
    spans = lambda numbers: F.array_sort(F.concat(*[F.col(f"s{i}") for i in numbers], F.array().cast(f"array<{SPAN}>")))
    return near.select("doc_id", spans(queries).alias("spans")).unionByName(
        far.select("doc_id", spans([i for i in queries if i not in indexed]).alias("spans")))


def span_digests(found: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """doc_id, the number of spans of each base rule, base_sha256 and spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = F.filter("spans", lambda s: s["number"] < base)
    count = lambda i: F.size(F.filter("spans", lambda s: s["number"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{rules[i].kind}") for i in range(base)],
                        F.sha2(text(own), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))

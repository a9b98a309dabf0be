"""Personal data: exact base patterns, and identifiers found by bootstrapped context patterns.

Base matches (email, ip, card, phone) are the seeds. Every mention, which is a base match, another token with a digit or
an at sign, or a run of digit groups over several tokens, has context patterns: the words around it. Mentions and patterns form a bipartite graph. Spark scores it in
rounds: a pattern's precision for a kind is the share of its mentions whose instances are believed to be of that kind,
an instance's belief is the noisy-or of its patterns. Mentions whose patterns reach the limits are added to the base.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlens.llm.common import map_texts, stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern counts from this many different believed instances and this precision on.
LEAST_SUPPORT = 4
LEAST_PRECISION = 0.8

_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MENTION = re.compile(r"[\d@]\S*")
#: Digit groups joined by single spaces, dots, hyphens or brackets.
_RUN = re.compile(r"(?<![\w@+.-])\+?\(?[0-9]+(?:(?:\)[ .-]?|[ .-]\(?|\()[0-9]+)+(?![\w@])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EDGES = "\"'`.,;:!?()[]{}<>|*#$%&="


def _emails(text: str):
    """Leftmost non-overlapping emails, from each at sign outwards: the pattern's local part cannot hold one."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and _LOCAL_END.match(text, begin - 1):
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind in KINDS, end), in that order."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _word(w: str) -> str:
    """A context word: letters lowered, digits alike, cut at 32 characters; trailing : = # kept, other edges dropped."""
    mark = w[-1:] if w[-1:] in ":=#" else ""
    return re.sub(r"[0-9]+", "0", w.strip(_EDGES).lower())[:32] + mark


def context_patterns(text: str, start: int, end: int) -> list[str]:
    """Patterns of a mention: two words before it, and the words on both sides; "^" and "$" stand for the text's ends."""
    left = [w for w in map(_word, text[max(0, start - 96):start].split()[-2:]) if w]
    right = [w for w in map(_word, text[end:end + 64].split()[:1]) if w]
    before, after = (left[-1] if left else "^"), (right[0] if right else "$")
    out = [f"around|{before}|{after}"]
    if len(left) == 2:
        out.append(f"before|{left[0]}|{left[1]}")
    if before[-1:] in ":=#":
        out.append(f"field|{before}")
    return out


def _runs(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of digit groups that reach over several tokens and overlap no base match."""
    out, starts, i, reach = [], sorted((a, b) for a, _, b in base), 0, 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        if text[a] == "(" and ")" not in m[0]:
            a += 1
        while i < len(starts) and starts[i][0] < b:
            reach = max(reach, starts[i][1])
            i += 1
        if " " in m[0] and reach <= a:
            out.append((a, b))
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int | None, bool, int, int, str, list[str]]]:
    """(rank of the kind or None, whether it is part of a run, start, end, instance, patterns) of base matches, of runs of
    digit groups, and of other tokens with a digit or @."""
    out = [(k, False, a, b, text[a:b].lower(), context_patterns(text, a, b)) for a, k, b in base]
    runs, r = _runs(text, base), 0
    out += [(None, False, a, b, text[a:b][:256], context_patterns(text, a, b)) for a, b in runs]
    starts, i, done = sorted((a, b) for a, _, b in base), 0, 0
    reach = 0  # end of the base matches that begin before the token
    for m in _MENTION.finditer(text):
        a, b = m.start(), m.end()
        while a > done and not text[a - 1].isspace():
            a -= 1
        done = b
        while a < b and text[a] in _EDGES:
            a += 1
        while b > a and text[b - 1] in _EDGES:
            b -= 1
        while i < len(starts) and starts[i][0] < b:
            reach = max(reach, starts[i][1])
            i += 1
        while r < len(runs) and runs[r][1] <= a:
            r += 1
        if b > a and reach <= a and any(c.isdigit() or c == "@" for c in text[a:b]):
            part = r < len(runs) and runs[r][0] < b
            out.append((None, part, a, b, text[a:b].lower()[:256], context_patterns(text, a, b)))
    return out


def find_mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, base (kind, start, end) and mentions of each row."""
    def worker():
        def step(texts):
            bases, found = [], []
            for t in texts:
                base = base_spans(t)
                bases.append([{"kind": k, "start": a, "end": b} for a, k, b in base])
                found.append([{"kind": k, "part": o, "start": a, "end": b, "instance": x, "patterns": p} for k, o, a, b, x, p in mentions(t, base)])
            return [bases, found]
        return step

    keyed = map_texts(
        docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key")).alias("row"), F.col(text_col).alias("text")),
        "row", "text", worker,
        "base array<struct<kind:int,start:int,end:int>>, "
        "mentions array<struct<kind:int,part:boolean,start:int,end:int,instance:string,patterns:array<string>>>")
    return keyed.select("doc_id.doc_id", "doc_id.text_key", "base", "mentions")


def score_patterns(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, precision) of the patterns that reach the limits after the rounds.

    graph has one row per (pattern, instance, kind) with the number n of mentions; kind is null for tokens that are no
    base match. Beliefs in base instances stay 1, so that later rounds only add to them."""
    seeds = graph.filter("kind IS NOT NULL").select("instance", "kind", F.lit(1.0).alias("belief")).distinct()
    totals = graph.groupBy("pattern").agg(F.sum("n").alias("total"))
    edges = graph.groupBy("pattern", "instance").agg(F.sum("n").alias("n"))
    beliefs, patterns = seeds, None
    for i in range(rounds):
        sums = edges.join(beliefs, "instance").groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("belief")).alias("mass"), F.count(F.when(F.col("belief") >= LEAST_PRECISION, 1)).alias("support"))
        patterns = stored(
            sums.join(totals, "pattern").withColumn("precision", F.col("mass") / F.col("total"))
            .filter((F.col("precision") >= LEAST_PRECISION) & (F.col("support") >= LEAST_SUPPORT)).select("pattern", "kind", "precision"))
        if i + 1 < rounds:
            doubt = F.sum(F.log1p(-F.least(F.col("precision"), F.lit(0.99))))
            new = edges.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("belief"))
            beliefs = stored(seeds.unionByName(new.join(seeds.select("instance").distinct(), "instance", "left_anti")))
    return patterns


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base and added spans (kind: rank in KINDS, start, end; in characters, end exclusive), one row per row of docs.

    A null text is empty and has none. Base matches are leftmost and non-overlapping per kind; matches that fail the
    check of their kind (parts of an ip, Luhn and length of a card, length of a phone) are dropped whole. Added spans
    overlap no base span, nor each other: of a run of digit groups and its parts the run goes first. Parts are not counted
    in the scores of patterns. With several patterns a mention gets the most precise one's kind, the first in KINDS on ties.
    Rows that repeat id and text get the same spans. Other columns are not read."""
    found = stored(find_mentions(docs, id_col, text_col))
    each = found.select("doc_id", "text_key", F.explode("mentions").alias("m")).select("doc_id", "text_key", "m.*")
    graph = stored(each.filter("NOT part").select("kind", "instance", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance", "kind").agg(
        F.count(F.lit(1)).alias("n")))
    patterns = score_patterns(graph, rounds)
    hits = (
        each.filter("kind IS NULL").select("doc_id", "text_key", "part", "start", "end", F.explode("patterns").alias("pattern"))
        .join(patterns, "pattern").groupBy("doc_id", "text_key", "part", "start", "end")
        .agg(F.max(F.struct("precision", (-F.col("kind")).alias("minus"))).alias("best"))
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("best.minus")).alias("kind"), "start", "end"))).alias("added"),
             F.collect_list(F.when(~F.col("part"), F.struct("start", "end"))).alias("whole"))
        .withColumn("added", F.filter("added", lambda x: ~F.exists("whole", lambda w: (
            (w["start"] < x["end"]) & (w["end"] > x["start"]) & (w["end"] - w["start"] > x["end"] - x["start"])))))
    )
    joined = found.select("doc_id", "text_key", "base").alias("l").join(
        hits.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.text_key").eqNullSafe(F.col("r.text_key")), "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return joined.select("l.doc_id", "base", F.coalesce("added", none).alias("added"))


def span_digests(spans: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, from the result of find_personal_data."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def line(col):
        order = F.array_sort(F.transform(col, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
        return F.array_join(F.transform(order, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(rank):
        return F.size(F.filter("base", lambda s: s["kind"] == rank)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.concat("base", "added")).alias("spans"))

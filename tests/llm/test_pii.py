import hashlib
import random
import re

from launchlens.llm import pii, queries
from launchlens.llm.common import read

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The stated patterns and checks, literally."""
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_base_matches_the_stated_patterns():
    rng = random.Random(9)
    tokens = ["a@b.c", "@", ".", "-", "+", "12", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1.9", "0001.2.3.04", "x", " ", "\n", "é", "+1 (017) 555-7713",
              "a.b%c@d-e.f", "٣", "5", "(", ")", "4111-1111-1111-1111"]
    for _ in range(3000):
        t = "".join(rng.choice(tokens) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(t) == plain(t), t


def test_context_finds_unseen_identifiers(spark):
    rng = random.Random(1)
    seen = [(i, f"word{i} please call me at +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} before noon") for i in range(12)]
    rows = seen + [(100, "you may call me at 555-7788 before noon"), (101, "call me at 555-7788 before noon"), (102, "chapter 1234 begins"),
                   (103, None), (104, ""), (105, "x" * 100_000 + " 10.0.0.1"), (105, "x" * 100_000 + " 10.0.0.1"), (None, "a@b.cd")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, spans string, kind int")
    got = {}
    for r in pii.span_digests(pii.find_personal_data(df)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[100][0].spans == "phone:19:27" and got[100][0].n_phone == 0 and got[101][0].spans == "phone:11:19"
    assert got[102][0].spans == got[103][0].spans == got[104][0].spans == ""
    assert got[104][0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert [r.spans for r in got[105]] == ["ip:100001:100009"] * 2 and got[None][0].spans == "email:0:6"
    assert sum(map(len, got.values())) == len(rows) and pii.find_personal_data(df.limit(0)).count() == 0


def test_query_keeps_every_base_span(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in read(spark, sf, "documents").collect()}
    got = queries.op9_pii(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base = plain(texts[r.doc_id])
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_context_finds_emails_without_digits_and_spaced_numbers(spark):
    rng = random.Random(6)
    rows = [(i, f"please send email: {'abcdefghijkl'[i]}x@mail.example today") for i in range(12)]
    rows += [(20 + i, f"you may call me at +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} before noon") for i in range(12)]
    rows += [(100, "please send email: jane@intranet today"), (101, "please send email: j\u00f6rg@m\u00fcller.de today"),
             (102, "you may call me at 555 123 4567 before noon"), (103, "you may call me at (555) 123-4567 before noon"),
             (104, "there were 3 of them in 12 rooms")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(pii.KINDS[s.kind], rows_[s.start:s.end]) for s in r.added]
           for r in pii.find_personal_data(df).collect() for rows_ in [dict(rows)[r.doc_id]]}
    assert got[100] == [("email", "jane@intranet")] and got[102] == [("phone", "555 123 4567")] and got[103] == [("phone", "(555) 123-4567")]
    assert ("email", "j\u00f6rg@m\u00fcller.de") in got[101] or pii.base_spans(dict(rows)[101])
    assert got[104] == []

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from made_documents import documents  # noqa: F401
from factorspark.llm import pii

KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WORD = re.compile(r"[^\W_]+")


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return True


def base(text):
    found = [(m.start(), i, k, m.end(), m[0]) for i, (k, p) in enumerate(KINDS.items()) for m in p.finditer(text or "") if valid(k, m[0])]
    return sorted(found)


def brute(docs, rule=pii.Disclosure()):
    """All rows of the report, by counting in Python."""
    entities = [{f"{k}:{v.lower() if k == 'email' else re.sub('[^0-9.]', '', v)}" for _, _, k, _, v in base(t)} for _, t in docs]
    terms = [{w for w in WORD.findall((t or "").lower()) if len(w) >= rule.least_length} for _, t in docs]
    n, n_entity, n_term, n_pair = len(docs), Counter(), Counter(), Counter()
    texts, pair_texts = defaultdict(set), defaultdict(set)
    for (_, t), es, ts in zip(docs, entities, terms):
        n_term.update(ts)
        n_entity.update(es)
        for e in es:
            texts[e].add(t)
            n_pair.update((e, x) for x in ts)
            for x in ts:
                pair_texts[e, x].add(t)
    strong = set()
    for (e, x), k in n_pair.items():
        ic = -math.log(n_entity[e] / n)
        if len(pair_texts[e, x]) >= rule.support and ic > 0 and math.log(k * n / n_entity[e] / n_term[x]) / ic >= rule.generalise:
            strong.add((e, x))
    out = []
    for (key, t), es in zip(docs, entities):
        spans = base(t)
        more = [(m.start(), 4, "term", m.end(), "") for m in WORD.finditer(t or "") if any((e, m[0].lower()) in strong for e in es)]
        more = [s for s in more if not any(b[0] < s[3] and s[0] < b[3] for b in spans)]
        join = lambda x: ",".join(f"{k}:{a}:{b}" for a, _, k, b, _ in sorted(x))
        counts = [sum(s[2] == k for s in spans) for k in KINDS]
        out.append(str((key, *counts, hashlib.sha256(join(spans).encode()).hexdigest(), join(spans + more))))
    return sorted(out)


CARD, PHONE = "4111 1111 1111 1111", "+1 (499) 555-6503"
TEXTS = [
    "a@b.com_x@y.de and a@b.c@d.e @x.y z@ q@w é@é.com ü.a-b+c%d@e-f.g-h.i.",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.0255.3.4 99999999999999999999.1.1.1 1.2.3",
    f"card {CARD}, {CARD[:-1]}2 4111-1111-1111-1111 41111111111111 378282246310005 1 2 3",
    f"call {PHONE} or +49.30.1234567 +1 23 +123456789012345678 +4(0)30-1234567) ++44 20 7946 0958",
    "日本語 😀 x@y.zz " + PHONE + " 😀 10.0.0.1",
    "", None, "no digits at all", "a" * 3_000 + "@", "1" * 3_000, "9 " * 3_000,
    "a.b@c." + "d." * 3_000 + "e", "+1" * 3_000, "1." * 3_000,
]
SECRET = [f"Zorblatt signed the {w} letter as jane@corp.example.com today {'Quillon' * (i % 2)}" for i, w in enumerate(["first", "second", "third", "fourth"])]
OTHER = ["the letter came today"] * 5 + ["Quillon wrote the letter"] + [f"the word{i} today as letter signed" for i in range(30)]


def test_base_spans(documents):
    got = sorted(str(tuple(r)) for r in pii.report(pii.find_spans(documents(*TEXTS))).collect())
    assert got == brute(list(enumerate(TEXTS)))


def test_long_texts(documents):
    """Linear in time, where the plain patterns are quadratic."""
    texts = ["a" * 200_000 + "@", "1" * 200_000, "9 " * 90_000, "a.b@c." + "d." * 90_000 + "e", "+1" * 90_000, "+1(" + "." * 90_000, "1." * 30_000]
    got = sorted(tuple(r)[:5] for r in pii.report(pii.find_spans(documents(*texts))).collect())
    assert [r[1:] for r in got] == [(0, 0, 0, 0)] * 3 + [(1, 0, 0, 0)] + [(0, 0, 0, 0)] * 2 + [(0, 7_500, 0, 0)]


def test_terms_and_copies(documents):
    rows = list(enumerate(SECRET + SECRET[:1] * 3 + OTHER)) + [(0, SECRET[0]), (None, SECRET[1])]
    found = pii.find_spans(documents(*rows))
    assert sorted(str(tuple(r)) for r in pii.report(found).collect()) == brute(rows)
    clean = {r.doc_id: r.text for r in pii.sanitise(found).collect()}
    assert clean[0] == " signed the first letter as [EMAIL] today " and clean[7] == rows[7][1]


def test_copies_are_no_evidence(documents):
    rows = list(enumerate(SECRET[:1] * 9 + OTHER))
    spans = {r.doc_id: r.spans for r in pii.report(pii.find_spans(documents(*rows))).collect()}
    assert spans[0] == "email:35:56" or "term" not in spans[0]


def test_sanitised_text(documents):
    rows = ["x a@b.com y", "+1 234 567 8901 and 10.0.0.1.", "ip mail 1.2.3.4@host.org", None, "é a@b.cc é"]
    got = {r.doc_id: r.text for r in pii.sanitise(pii.find_spans(documents(*rows))).collect()}
    assert got == {0: "x [EMAIL] y", 1: "[PHONE] and [IP].", 2: "ip mail [EMAIL]", 3: None, 4: "é [EMAIL] é"}


def test_names_and_empty_table(documents):
    df = documents("a@b.com").withColumnsRenamed({"lang": "mark", "source": "_ip", "n_chars": "spans2"})
    assert pii.find_spans(df).columns == ["doc_id", "text", "mark", "spans2", "spans"]
    assert pii.report(pii.find_spans(df.where("false"))).count() == 0


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = pii.op4_pii(spark, sf_dir)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())


@pytest.mark.parametrize("rule", [pii.Disclosure(0.5, 0.8, 2, 3), pii.Disclosure(0.3, 0.9, 1, 1)])
def test_other_thresholds(documents, rule):
    rows = list(enumerate(SECRET + OTHER + [f"call {PHONE} about Wumpus", f"{PHONE} wumpus again"]))
    got = pii.report(pii.find_spans(documents(*rows), rule)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, rule)

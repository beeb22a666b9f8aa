"""Personal data: base spans against plain Python, the weak supervision, redaction."""

import hashlib
import ipaddress
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import pii

from . import helpers

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    odd = sum(int(x) for x in d[::-1][::2])
    return (odd + sum(sum(divmod(2 * int(x), 10)) for x in d[::-1][1::2])) % 10 == 0


def base(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            fits = {
                "email": lambda: True,
                "ip": lambda: all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]
            if fits():
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).encode()).hexdigest()


def noise(seed, n):
    rng = random.Random(seed)
    bits = ["a@b.c", "x.y@mail.com", "@", ".", "..", "é", "😀", " ", "-", "+1 (234) 555-0199", "+", "4111 1111 1111 1111", "4111111111111112", "1.2.3.4", "999.1.2.3", "00255.1.1.1",
            "12", "0", "token = \"0123456789abcdef0123456789abcdef\"", "_", "%", "(", ")", "123456789012345678901", "\n", "3400-0000-0000-009", "a", "Z9"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def compare(spark, df, rows):
    model = pii.train(df)
    found = pii.find(df, model).withColumn("base", F.filter("spans", lambda s: s["base"]))
    got = Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r.base)) for r in found.collect())
    want = Counter((i, tuple((a, o, b) for a, o, b, _ in base(t))) for i, t in rows)
    assert got == want
    return model


@pytest.mark.parametrize("make", [helpers.docs, helpers.clashing])
def test_base_spans_equal_plain_python(spark, make):
    rows = helpers.awkward() + list(enumerate(noise(7, 300), 1000)) + [(5000, "a" * 5000), (5001, "1." * 5000), (5002, "a@" + "b." * 20000 + "c"), (5003, "1 2-" * 30000), (5004, "+1" + "(" * 100000)]
    compare(spark, make(spark, rows), rows)


def test_query_over_real_texts(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pii.op8_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r.doc_id])
        n = Counter(k for *_, k in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (n["email"], n["ip"], n["card"], n["phone"], digest(want))
        listed = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for a, _, b, k in want} <= set(listed)
        if " token = \"" in texts[r.doc_id]:
            assert any(x.startswith("secret:") for x in listed)


def test_expectation_maximisation_learns_reliabilities():
    kind, votes, _ = pii._factors()
    rng, counts = np.random.default_rng(4), np.zeros(pii.N_PATTERNS)
    lookup = {(k, *v): i for i, (k, v) in enumerate(zip(kind, map(tuple, votes))) if i % pii.LENGTH_CLASSES == 0}
    good = [0.95, 0.9, 0.55, 0.8]
    truth = rng.random(20000) < 0.4
    for y in truth:
        v = [pii.YES if (rng.random() < g) == y else pii.NO for g in good]
        counts[lookup[(0, *v)]] += 1
    label, reliability = pii.expectation_maximisation(counts)
    for j, g in enumerate(good):
        assert abs(reliability[0, j, 1, pii.YES] - g) < 0.04 and abs(reliability[0, j, 0, pii.NO] - g) < 0.04
    p = pii.fit_span_classifier(counts, label)
    assert p[lookup[(0, 1, 1, 1, 1)]] > 0.95 and p[lookup[(0, 2, 2, 2, 2)]] < 0.05


def test_redaction(spark):
    text = "é mail me.x@mail.com, or +1 (234) 555-0199 ok 4111 1111 1111 1111. token = \"0123456789abcdef0123456789abcdef\" end"
    rows = [(1, text), (2, None), (3, ""), (4, "clean")]
    df = helpers.clashing(spark, rows)
    model = [1.0 if k == 4 else 0.0 for k in pii._factors()[0]]
    out = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert out == {1: "é mail [email], or [phone] ok [card]. token = \"[secret]\" end", 2: None, 3: "", 4: "clean"}
    assert pii.redact(df, model).columns == df.columns
    assert pii.find(df.limit(0), pii.train(df.limit(0))).count() == 0

WIDER = {
    "email_written": r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]*(?: ?[\[({] ?at ?[\])}] ?| at )[a-z0-9-]+(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[a-z0-9-]+)+",
    "ip_v6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]+(?![0-9A-Za-z:])",
    "card_separated": r"[0-9](?:[ ._/-]{0,3}[0-9]){11,}",
    "phone_national": r"(?<![0-9A-Za-z+().,_/-])(?<![0-9)] )\(?[0-9](?:\)?[ ./-]?\(?[0-9]){6,}",
}


def plain_wider(text):
    """Wider spans with a valid form and, for numbers, the word before them, as (kind, start, end); found without the operator."""
    out = []
    for form, pattern in WIDER.items():
        for m in re.finditer(pattern, text):
            before, digits = text[max(0, m.start() - 40) : m.start()], re.sub("[^0-9]", "", m.group())
            if form == "ip_v6":
                try:
                    ipaddress.IPv6Address(m.group())
                except ValueError:
                    continue
            if form == "card_separated" and not (12 <= len(digits) <= 19 and luhn(digits) and re.search(r"[._/]|  ", m.group()) and re.search(r"(?i)(card|visa|payment)\W*$", before)):
                continue
            if form == "phone_national" and not (7 <= len(digits) <= 15 and not (len(digits) >= 12 and luhn(digits)) and re.search(r"(?i)(phone|tel\b|call|fax)\W*$", before)):
                continue
            out.append((form.split("_")[0], m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def wider_rows():
    rng = random.Random(5)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        while True:
            d = rng.choice("3456") + num(15)
            if luhn(d):
                return d

    rows = []
    for i in range(240):
        d, sep = card(), rng.choice([".", " / ", "  ", "_"])
        split = sep.join(d[k : k + 4] for k in range(0, 16, 4))
        v6 = ":".join(f"{rng.randrange(0x1000, 0x10000):x}" for _ in range(7))
        made = [
            f"write {rng.choice(['ann', 'bo.li', 'c-d'])} {rng.choice(['(at)', '[at]', '{ at }'])} host{i} {rng.choice(['(dot)', '[dot]'])} org today",
            f"address 2{num(3)}:{v6} ok",
            f"server 2001:db8::{rng.randrange(1, 65000):x} ok",
            f"visa: {split} paid",
            f"tel. (0{num(2)}) 55{num(1)}-{num(4)}.",
            f"Phone 0{num(3)} {num(3)} {num(3)}, thanks",
        ]
        clean = [f"at {rng.randrange(10, 24)}:{rng.randrange(10, 60)}:{rng.randrange(10, 60)} we left", f"order {num(4)} {num(4)} items", f"on {rng.randrange(10, 28)}.0{rng.randrange(1, 9)}.2024 it rained", f"about {num(8)} rows", "look at the house", f"isbn {split}"]
        rows.append((i, " é ".join(rng.sample(made, 2) + rng.sample(clean, 3))))
    return rows


def test_wider_forms_are_decided_by_the_classifier(spark):
    """Added spans of every kind, recomputed without the operator; clean numbers, times and dates are left alone."""
    rows = wider_rows()
    df = helpers.docs(spark, rows + [(9000, None), (9001, "")])
    model = pii.train(df)
    got = {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans if not s.base] for r in pii.find(df, model).collect()}
    assert got.pop(9000) == got.pop(9001) == []
    assert got == {i: plain_wider(t) for i, t in rows}
    assert {k for found in got.values() for k, *_ in found} == {"email", "ip", "card", "phone"}
    never = {r.doc_id: r.spans for r in pii.find(df, [0.0] * pii.N_PATTERNS).collect()}
    assert all(s.base for found in never.values() for s in found)  # the classifier, not the pattern, adds them


def test_wider_patterns_are_linear(spark):
    rows = [(1, "1 ." * 40000), (2, "a at b" * 30000), (3, "a:" * 60000), (4, "(1)" * 50000), (5, "a (at) b" + ".c" * 40000), (6, ("1" * 11 + "   ") * 9000)]
    assert pii.find(helpers.docs(spark, rows), [1.0] * pii.N_PATTERNS).count() == 6


def test_stored_candidates_give_the_same_spans(spark):
    rows = helpers.awkward() + wider_rows()[:60] + [(7, "mail a@b.co"), (7, "mail a@b.co")]
    df = helpers.clashing(spark, rows)
    plain = lambda found: Counter((r.doc_id, tuple(r.spans)) for r in found.collect())
    assert plain(pii.train_and_find(df)) == plain(pii.find(df, pii.train(df)))
    assert pii.train_and_find(df.limit(0)).count() == 0

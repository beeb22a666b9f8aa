"""The filter audit against plain Python, filter by filter in every order."""

import re
from collections import Counter, defaultdict
from itertools import permutations

from strandline.llm import filter_audit

from . import helpers

SCHEMA = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {
            "A": len(ws) < 50,
            "B": 100 * len(set(ws)) < 65 * len(ws),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and least[t] < d,
        }
        fails[s or ""].append((d, {x for x in f if f[x]}))
    out, shapley = [], Counter()
    for part, docs in fails.items():
        for order in permutations("ABCDE"):
            alive = list(docs)
            for step, f in enumerate(order, 1):
                gone = [(d, x) for d, x in alive if f in x]
                alive = [(d, x) for d, x in alive if f not in x]
                shapley[(part, f)] += len(gone)
                out.append(
                    [part, "".join(order), step, len(alive), len(gone), sum(f in x for _, x in docs) - len(gone), sum(x == {f} for _, x in docs),
                     sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                )
    return sorted((*r, shapley[(r[0], r[1][r[2] - 1])]) for r in out)


def audit(spark, rows, labels, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema)
    found = filter_audit.audit_filters(docs, spark.createDataFrame(labels, LABELS))
    assert dict(found.dtypes)["step"] == "int" and {t for c, t in found.dtypes if c in COLUMNS[3:]} == {"bigint"}
    return sorted(tuple(r[c] for c in COLUMNS) for r in found.collect())


def awkward():
    rows = [(d, t, [None, "", "s1", "s2"][i % 4]) for i, (d, t) in enumerate(helpers.awkward())]
    rows += [(1000 + i, "word " * 60 + "X" * (i % 3) + "#" * (i % 2), "s1") for i in range(20)]
    rows += [(2000 + i, " ".join(f"w{j}" for j in range(80)) + " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJ"[: 1 + i % 37], "s3") for i in range(40)]
    return rows


def test_awkward_rows_equal_plain_python(spark):
    rows = awkward()
    labels = [(d, i % 2, int(i % 5 == 0)) for i, (d, _, _) in enumerate(rows[:70])] + [(1001, None, 1), (1001, 1, None), (None, 1, 1), (77777, 1, 1)]
    assert audit(spark, rows, labels) == plain(rows, labels)


def test_one_text_and_one_part_hold_most_rows(spark):
    rows = [(i, "same text here", "hot" if i % 10 else "cold") for i in range(3000)] + [(i, f"text {i}", "hot") for i in range(3000, 4000)]
    got = audit(spark, rows, [])
    assert got == plain(rows, [])
    assert {r[6] for r in got if r[0] == "hot" and r[1][r[2] - 1] == "E"} == {0}


def test_repeated_and_null_ids(spark):
    rows = [(5, "a", "p"), (5, "a", "q"), (6, "a", "q"), (None, "a", "q"), (None, "b", None), (None, "b", None)]
    assert audit(spark, rows, [(5, 1, 1), (5, 1, 0)]) == plain(rows, [(5, 1, 1)])


def test_clashing_columns_and_empty_tables(spark):
    rows = [(1, "some words", "p"), (2, "some words", "p")]
    wide = spark.createDataFrame([(*r, 7, "x", 8, "y") for r in rows], SCHEMA + ", part int, mask string, n int, digest string")
    labels = spark.createDataFrame([], LABELS)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in filter_audit.audit_filters(wide, labels).collect()) == plain(rows, [])
    assert filter_audit.audit_filters(spark.createDataFrame([], SCHEMA), labels).count() == 0

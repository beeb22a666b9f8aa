"""Benchmark passages against a plain search, exact and near."""

import hashlib
import random
import re

import pytest

from strandline.llm import decontamination as dc

from . import helpers

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, size=10):
    windows = []
    for item, text in items:
        ws = words(text)
        for i in range(max(len(ws) - size, 0) + 1 if ws else 0):
            windows.append((ws[i : i + size], item))
    out = []
    for doc, text in docs:
        ws, hit, found = words(text), set(), set()
        for w, item in windows:
            for i in range(len(ws) - len(w) + 1):
                if ws[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    found |= {str(item)} - {"None"}
        out.append((doc, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, make=helpers.docs, size=10):
    found = dc.contamination(make(spark, docs), spark.createDataFrame(items, ITEMS), size)
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in found.collect()), key=str)


def passages(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "ÉTÉ", "straße", "don't", "x.y", "日本語"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    docs = []
    for d in range(60):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            text = rng.choice(items)[1].split(" ")
            text = text[: rng.randrange(1, len(text) + 1)] if rng.random() < 0.3 else text
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = text
        docs.append((d, " ".join(p.upper() if rng.random() < 0.1 else p for p in parts)))
    return docs, items


@pytest.mark.parametrize("make", [helpers.docs, helpers.clashing])
def test_planted_and_awkward_rows(spark, make):
    docs, items = passages()
    docs += [(100 + (i or 0), t) for i, t in helpers.awkward()] + [(None, items[0][1]), (7, items[3][1]), (7, items[3][1])]
    items += [(50, None), (51, ""), (52, " .,"), (3, items[3][1]), (3, items[5][1]), (None, items[6][1]), (None, "one"), (60, "one"), (61, "long " * 12), (62, "the the the")]
    got = run(spark, docs, items, make)
    assert got == plain(docs, items)
    assert sum(r[2] > 0 for r in got) > 30


def test_other_window_sizes(spark):
    docs, items = passages(5)
    assert run(spark, docs, items, size=3) == plain(docs, items, 3)


def test_larger_tables_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    docs, items = passages(7)
    assert run(spark, docs, items) == plain(docs, items)


def test_one_passage_in_half_of_all_documents(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, f"text {i} " + passage if i % 2 else f"other text {i}") for i in range(4000)]
    got = run(spark, docs, [(1, passage), (2, passage + " more")])
    assert [r[2] for r in sorted(got)] == [30 * (i % 2) for i in range(4000)]


def test_overlapping_occurrences_count_words_once(spark):
    docs = [(1, "a " * 15), (2, "b a b a b a b"), (3, "x a b")]
    items = [(1, "a " * 10), (2, "a b a"), (3, "b a b")]
    assert run(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = passages()
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == plain(docs, [])


def test_near_matches(spark):
    docs, items = passages(9)
    items = [i for i in items if len(words(i[1])) <= 10]
    index = dc.build_index(helpers.docs(spark, docs), spark.createDataFrame(items, ITEMS))
    ids = {r["doc"]: r["doc_id"] for r in index.postings.where("term = -1").collect()}
    of = {r["window"]: r["words"] for r in index.windows.collect()}
    rare = {r["window"]: r["off"] for r in index.window_terms.where("rank = 1").collect()}
    for slop in (0, 2, 7):
        got = {(ids[r["doc"]], r["pos"], tuple(of[r["window"]])) for r in dc.near_matches(index, slop).collect()}
        want = set()
        for d, text in docs:
            ws = words(text)
            for w, off in rare.items():
                for p, x in enumerate(ws):
                    if x == of[w][off] and set(of[w]) <= set(ws[max(p - slop, 0) : p + slop + 1]):
                        want.add((d, p, tuple(of[w])))
        assert got == want and (slop == 0 or want)
    exact = {(ids[r["doc"]], r["start"], tuple(of[r["window"]])) for r in dc.phrase_matches(index).collect()}
    assert exact == {(d, i, tuple(w)) for d, text in docs for w in of.values() for i in range(len(words(text)) - len(w) + 1) if words(text)[i : i + len(w)] == w}

import random
from itertools import pairwise

import numpy as np
import pytest

from codexa.llm import line_dedup, near_dedup
from codexa.llm._base import buffers, grouped
from tests.llm.helpers import awkward, none_of, prose
from tests.oracle import DATA


def roots(n, edges):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(k) for k in range(n)]


def test_near_copies_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    t = docs.select("doc_id", "text").orderBy("doc_id").toArrow()
    ids = t.column(0).to_numpy()
    rows, sig = near_dedup.signatures(*buffers(t.column(1).combine_chunks()))
    edges = [(a, b) for a in range(len(rows)) for b in np.flatnonzero((sig == sig[a]).sum(axis=1) >= near_dedup.MATCHES) if a < b]
    want = {(int(ids[rows[k]]), int(ids[rows[r]])) for k, r in enumerate(roots(len(rows), edges)) if r != k}
    assert {tuple(r) for r in near_dedup.near_copies(docs).collect()} == want and want


def test_near_copies_with_hot_values_and_long_lists(spark):
    """A template shared by all, families of near copies and exact ones: hot values, short lists and long ones give the groups of all pairs."""
    r = random.Random(11)
    template, rows = prose(40, 60).split(), []
    for family in range(12):
        base = template + prose(100 + family, r.choice([15, 40, 90])).split()
        for _ in range(r.choice([1, 2, 3, 12])):
            words = list(base)
            for _ in range(r.randint(0, 12)):
                words[r.randrange(len(words))] = r.choice(["zza", "zzb", "zzc"])
            rows += [" ".join(words)] * r.choice([1, 1, 3])
    rows *= 2
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    t = docs.orderBy("doc_id").toArrow()
    taken, sig = near_dedup.signatures(*buffers(t.column(1).combine_chunks()))
    edges = [(a, b) for a in range(len(taken)) for b in np.flatnonzero((sig == sig[a]).sum(axis=1) >= near_dedup.MATCHES) if a < b]
    want = roots(len(rows), edges)
    signed = near_dedup.signed(docs)
    for hot in (1, 1000):
        assert near_dedup.hot_tokens(signed, hot).isEmpty() == (hot == 1)
        found = grouped(near_dedup.near_classes(signed, hot=hot), "class_a", "class_b")
        root = {x["node"]: x["root"] for x in found.collect()}
        least = {}
        for x in sorted(signed.collect(), key=lambda x: x["doc_id"]):
            least.setdefault(root.get(x["same"], x["same"]), x["doc_id"])
        assert [least[root.get(x["same"], x["same"])] for x in sorted(signed.collect(), key=lambda x: x["doc_id"])] == want


def test_a_repeated_id_with_other_text_loses_nothing(spark):
    a, b = prose(50), prose(51)
    docs = spark.createDataFrame([(3, a), (4, a), (3, b), (1, b)], "doc_id long, text string")
    assert {tuple(r) for r in near_dedup.near_copies(docs).collect()} == {(4, 3), (3, 1)}
    assert sorted(map(tuple, near_dedup.deduplicate(docs).collect())) == [(1, b), (3, a)]


def test_near_dedup_awkward_rows(spark):
    got = [tuple(r) for r in near_dedup.near_copies(awkward(spark)).collect()]
    assert (4, 3) in got and {a for a, _ in got} <= {4, 9}
    kept = near_dedup.deduplicate(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids.count("3") == 1 and ids.count("None") == 2 and "4" not in ids and {"1", "2", "5", "6", "7", "8", "10"} <= set(ids)
    assert near_dedup.deduplicate(none_of(spark)).count() == 0 and near_dedup.near_copies(none_of(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in pairwise(order)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in grouped(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(200), 0), 500: 500, 501: 500}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 4])
def test_banded_distance(most):
    r = random.Random(most)
    a, b = [], []
    for _ in range(400):
        x = bytes(r.choice(b"abc") for _ in range(r.randint(2 * most + 1, 70)))
        y = bytearray(x)
        for _ in range(r.randint(0, most + 2)):
            k = r.randrange(len(y) + 1)
            y[k : k + r.randint(0, 1)] = bytes(r.choice(b"abc") for _ in range(r.randint(0, 1)))
        if len(y) > 2 * most:
            a.append(x)
            b.append(bytes(y))
    got = line_dedup.edit_distances(a, b, most)
    for x, y, d in zip(a, b, got, strict=True):
        true = levenshtein(x, y)
        assert (d == true) if true <= most else d > most


def test_distance_of_long_lines():
    r = random.Random(4)
    for _ in range(200):
        x = bytes(r.choice(b"ab") for _ in range(r.randint(4, 40)))
        y = bytearray(x)
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(y) + 1)
            y[k : k + r.randint(0, 1)] = bytes(r.choice(b"ab") for _ in range(r.randint(0, 1)))
        for most in (1, 2, 4):
            assert line_dedup.diagonal_distance(x, bytes(y), most) == min(levenshtein(x, y), most + 1)
    long = b"abc" * 400_000
    assert list(line_dedup.edit_distances([long, long], [long[:1000] + b"x" + long[1000:-1], long[5:] + b"zzzzz"], 2)) == [2, 3]


def test_a_repeated_id_keeps_its_other_lines(spark):
    a, b = prose(60), prose(61)
    docs = spark.createDataFrame([(1, a), (3, a), (3, b)], "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.without_repeats(docs).collect())) == [(1, a), (3, b)]


def test_a_line_of_a_megabyte(spark):
    long = "x1 " * 350_000
    docs = spark.createDataFrame([(1, long), (2, long + "y"), (3, "other " * 20)], "doc_id long, text string")
    assert {tuple(r) for r in line_dedup.repeated_lines(docs).collect()} == {(2, 0, 1, 0)}


def test_line_dedup_awkward_rows(spark):
    got = {tuple(r) for r in line_dedup.repeated_lines(awkward(spark)).collect()}
    assert got == {(4, 0, 3, 0), (9, 0, 8, 0)}
    shuffled = {tuple(r) for r in line_dedup.repeated_lines(awkward(spark), wanted_rows=0).collect()}
    assert shuffled == got
    out = line_dedup.without_repeats(awkward(spark))
    assert out.columns == awkward(spark).columns
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert 4 not in by and len(by[3]) == 2 and len(by[None]) == 2
    assert by[9][0]["text"] == prose(6) and by[9][0]["n_chars"] == len(prose(6))
    assert line_dedup.repeated_lines(none_of(spark)).count() == 0 and line_dedup.without_repeats(none_of(spark)).count() == 0


def test_short_lines_that_repeat_go(spark):
    docs = spark.createDataFrame([(1, "And so.\n\nx\nAnd so."), (2, "  \n\nAnd so.\nAnd so!"), (3, "x\n \n  ")], "doc_id long, text string")
    assert {tuple(r) for r in line_dedup.repeated_lines(docs).collect()} == {(1, 3, 1, 0), (2, 2, 1, 0), (3, 0, 1, 2)}
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs).collect()} == {1: "And so.\n\nx", 2: "  \n\nAnd so!"}

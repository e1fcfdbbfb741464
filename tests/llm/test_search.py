"""Decontamination, top-k, repeats and near duplicates against brute force, and their edge cases."""

import random
from collections import Counter

import numpy as np
import plain
import pytest

from concordat.llm import near_dedup
from concordat.llm.decontamination import contamination, matches
from concordat.llm.substring_dedup import remove_repeats
from concordat.llm.topk import SortedLists, top_k

FOLDER = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n))


def test_decontamination_edge_cases(spark, docs):
    item, short = prose(1, 30), "Only Four Words Here"
    rows = [(1, None), (2, ""), (3, "... !!"), (4, f"x {item.upper()} y"), (5, prose(2, 5000) + " " + " ".join(item.split()[5:20]) + " " + prose(3, 5000)),
            (6, "só only four words here, and ONLY four. words-here"), (7, " ".join(item.split()[:9])), (8, "Éa éa éa"), (4, "another text of the same id"), (9, prose(9, 40))]
    bench = [(10, item), (2, short), (3, None), (4, ""), (11, item), (None, prose(9, 12)), (5, "éa éa")]
    got = contamination(docs(rows), spark.createDataFrame(bench, "item_id long, text string"))
    assert Counter(tuple(r)[:6] for r in got.collect()) == Counter(plain.contamination(rows, bench))
    none = contamination(docs(rows), spark.createDataFrame([], "item_id long, text string"))
    assert {r["n_hit"] for r in none.collect()} == {0} and none.count() == len(rows)
    assert contamination(docs([]), spark.createDataFrame(bench, "item_id long, text string")).count() == 0
    without_id = contamination(docs([(None, item)]), spark.createDataFrame(bench, "item_id long, text string")).first()
    assert (without_id["n_words"], without_id["contaminated"]) == (30, False)


def test_proximity_matches(spark, docs):
    item = [f"rare{i}" for i in range(10)]
    near = item[:3] + ["other"] + item[4:]
    rows = matches(docs([(1, " ".join(near)), (2, " ".join(item)), (3, "rare0 rare1 x y z")]), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    found = {r["doc_id"]: (len(r["phrases"]), len(r["near_phrases"])) for r in rows}
    assert found[2] == (1, 0) and found[3] == (0, 0) and found[1][0] == 0


def test_proximity_matches_whatever_word_differs(spark, docs):
    item = [f"rare{i}" for i in range(10)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "five short words are here"), (3, "a b c")], "item_id long, text string")
    changed = {i: " ".join(item[:i] + ["other"] + item[i + 1 :]) for i in range(10)}  # each word of document 50 is rarer than in it
    rows = [*changed.items(), (20, "x y " + " ".join(item[:4] + ["new"] + item[4:])), (21, " ".join(item[:4] + item[5:])), (22, " ".join(item[:2] + ["p"] + item[3:7] + ["q"] + item[8:])),
            (23, " ".join(item[:2] + ["p"] + item[3:5] + ["q"] + item[6:8] + ["r"] + item[9:])), (24, " ".join(item)), (25, "five short other are here"), (26, "five words are here"),
            (27, " ".join(item[::-1])), (28, "a b"), (50, "rare3 " * 5)]
    got = {r["doc_id"]: r for r in matches(docs(rows), bench).collect()}
    near = {i: [(m["words"], m["item_id"]) for m in r["near_phrases"]] for i, r in got.items()}
    assert all((10, "1") in near[i] for i in (*range(10), 20, 21, 22)) and all((5, "2") in near[i] for i in (25, 26))
    assert all(near[i] == [] for i in (23, 24, 27, 28, 50)) and len(got[24]["phrases"]) == 1
    assert [m["start"] for m in got[3]["near_phrases"]] == [0] and {m["start"] for m in got[20]["near_phrases"]} == {2, 3}
    counted = {r["doc_id"]: r["n_near"] for r in contamination(docs(rows), bench).collect()}
    assert counted == {i: len(r["near_phrases"]) for i, r in got.items()}


def test_repeats_edge_cases(docs):
    passage = prose(4, 60)
    rows = [(5, passage), (3, prose(5, 30) + "\n" + passage + "\t" + prose(6, 30)), (9, prose(7, 9) + " " + " ".join(passage.split()[10:22])), (10, " ".join(passage.split()[10:23])),
            (1, None), (2, ""), (4, "a " * 40), (8, "a " * 14), (11, "A " * 14), (12, prose(8, 20000) + " " + passage), (5, passage + " more"), (-7, " ".join(passage.split()[:20]))]
    got = remove_repeats(docs(rows), block_bytes=1 << 14).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter(plain.repeats(rows))
    for r in got:
        assert sum(s["words"] for s in r["spans"]) == r["n_removed"] and all(s["words"] >= 13 for s in r["spans"])
    assert remove_repeats(docs([])).count() == 0
    without_id = remove_repeats(docs([(None, passage), (1, passage)])).collect()
    assert {r["n_removed"] for r in without_id} == {0}


def test_repeats_of_the_tables(spark):
    rows = plain.given(spark, FOLDER, "documents", "doc_id", "text")
    got = remove_repeats(spark.read.parquet(f"{FOLDER}/documents.parquet"), block_bytes=1 << 16).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter(plain.repeats(rows))


def test_weighted_signatures_are_unbiased():
    pick = np.random.default_rng(5)
    a = {int(k): int(w) for k, w in zip(pick.integers(0, 1 << 62, 200), pick.integers(1, 12, 200))}
    b = {k: max(1, w - int(pick.integers(0, 8))) for k, w in list(a.items())[:170]}
    exact = sum(min(w, b.get(k, 0)) for k, w in a.items()) / sum(max(w, b.get(k, 0)) for k, w in a.items())
    found = []
    for shift in range(80):
        own = [(i, (k * 2654435761 + shift * 987654321987654321) % (1 << 64), w) for i, c in enumerate((a, b)) for k, w in c.items()]
        signs = near_dedup.signatures(np.array([o for o, _, _ in own]), np.array([h for _, h, _ in own], np.uint64), np.array([w for *_, w in own]), 2)
        found.append((signs[0] == signs[1]).mean())
    assert abs(np.mean(found) - exact) < 4 * np.std(found) / 80**0.5


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 4])
def test_near_duplicates(spark, docs, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    base = prose(11, 300).split()
    rows = [(i, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for i, k in zip(range(20, 40), range(10, 290, 14))]
    rows += [(50, " ".join(base)), (51, " ".join(base).upper() + "!"), (60, None), (61, ""), (62, "..."), (63, "short one"), (64, "Short, one"), (65, "short two"), (66, prose(12, 20000)),
             (67, prose(13, 300)), (68, "go " * 200), (69, "go " * 190), (70, "go " * 100)]
    got = {r["doc_id"]: r for r in near_dedup.near_duplicate_classes(docs(rows)).collect()}
    want = plain.classes(rows)
    assert {i: r["class_id"] for i, r in got.items()} == want and len(got) == len(rows)
    assert got[51]["copy_of"] == 50 and got[64]["class_id"] == 63 and got[60]["class_id"] == 60 and got[61]["n_shingles"] == 0
    twice = near_dedup.near_duplicate_classes(docs([(1, "one two three four five six"), (1, "one two three four five six"), (None, "x y"), (None, None)])).collect()
    assert sorted((r["class_id"] or -1) for r in twice) == [-1, -1, 1, 1]
    assert near_dedup.near_duplicate_classes(docs([])).count() == 0


def test_near_duplicates_of_the_tables(spark):
    rows = plain.given(spark, FOLDER, "documents", "doc_id", "text")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    assert got == plain.classes(rows)


def test_top_k_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [0.5, -0.25]), (50, [0.0, 0.0]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1.0, -1.0]), (7, []), (8, [float("inf"), 0.0]), (9, [-1.0, 1.0]), (None, [1.0, 1.0]), (10, [1.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, block int")
    got = sorted(map(tuple, top_k(table, table.where("vec_id % 50 = 0"), k=3).collect()))
    assert got == [(0, 1, 6, 49152), (0, 2, 1, 20480), (0, 3, 2, 20480), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]
    assert top_k(table.limit(0), table, k=3).count() == 0 and top_k(table, table.limit(0), k=3).count() == 0


def test_lists_stop_early_and_are_exact():
    pick = np.random.default_rng(3)
    vectors = np.floor(pick.normal(size=(3000, 16)) * 60).astype(np.int64)
    vectors[100:160] = vectors[100]
    ids = pick.permutation(3000)
    block = SortedLists(ids, vectors)
    for at in range(0, 3000, 150):
        query = vectors[at]
        found, scores = block.top(query, ids[at], 5, few=16)
        every = vectors @ query
        order = [j for j in np.lexsort((ids, -every)) if ids[j] != ids[at]][:5]
        assert list(found) == [ids[j] for j in order] and list(scores) == [every[j] for j in order]
    assert block._aggregate(vectors[7], block.ids != ids[7], 5, 64).sum() < 3000

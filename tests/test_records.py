"""Hand-checked cases of the record operators, and properties on random sets."""

import random

import pytest
from pyspark.sql import functions as F

from twinfold.functions import text as T
from twinfold.functions import udfs as U
from twinfold.operators import containment as C
from twinfold.operators import evaluate as E
from twinfold.operators import generalize as G
from twinfold.operators import mentions as M
from twinfold.operators import phrases as P
from twinfold.operators import represent as R
from twinfold.operators import simhash as H
from twinfold.operators import specify as S
from twinfold.operators.components import connected_components
from twinfold.operators.lattice import block_rates, gini, refine


def reps_of(spark, sets):
    """rep_id is the set's text, so that results can be read."""
    rows = [("".join(sorted(s)), sorted(f"x:{c}" for c in set(s)), 1.0, len(set(s))) for s in sets]
    return spark.createDataFrame(rows, "rep_id string, features array<string>, freq double, n int")


def partition(rows):
    groups = {}
    for k, v in rows:
        groups.setdefault(v, set()).add(k)
    return {frozenset(g) for g in groups.values()}


def test_letter_sets(spark):
    sets = "a ab abc b c ac ad bc ce fg ghf g hi hij".split()
    reps = reps_of(spark, sets)
    pairs = C.containment_pairs(reps)
    assert {(r[0], r[1]) for r in pairs.collect()} == {("".join(sorted(a)), "".join(sorted(b))) for a in sets for b in sets if set(a) < set(b)}
    assert {r[0] for r in C.minimal_elements(pairs).collect()} == {"a", "b", "c", "g", "hi"}
    found = C.poset_components(reps, C.minel_edges(pairs)).collect()
    assert partition(found) == {frozenset("a ab abc b c ac ad bc ce".split()), frozenset(["fg", "fgh", "g"]), frozenset(["hi", "hij"])}


def test_no_inclusions_leave_singletons(spark):
    reps = reps_of(spark, ["ab", "cd", "ef"])
    pairs = C.containment_pairs(reps)
    assert pairs.count() == 0
    assert {tuple(r) for r in C.poset_components(reps, C.minel_edges(pairs)).collect()} == {("ab", "ab"), ("cd", "cd"), ("ef", "ef")}


def test_containment_against_brute_force(spark):
    rng = random.Random(5)
    sets = list({"".join(sorted(rng.sample("abcdefghij", rng.randint(1, 6)))) for _ in range(120)})
    found = {(r[0], r[1]) for r in C.containment_pairs(reps_of(spark, sets)).collect()}
    assert found == {(a, b) for a in sets for b in sets if set(a) < set(b)}
    direct = {(r[0], r[1]) for r in C.direct_edges(C.containment_pairs(reps_of(spark, sets))).collect()}
    assert direct == {(a, b) for a, b in found if not any((a, m) in found and (m, b) in found for m in sets)}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(90)], [(7, i) for i in range(40)], [(1, None), (2, 2), (3, 4)], []])
def test_components(spark, edges):
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {v: find(v) for v in parent}


def test_bundle_and_represent(spark):
    df = spark.createDataFrame([("b", None, "a", "b", 1.0), ("a", "b", None, None, 2.0), (None,) * 4 + (1.0,)], "t1 string, t2 string, t3 string, t4 string, freq double")
    assert df.select(R.bundle("t1", "t2", "t3", "t4")).first()[0] == ["a", "b"]
    reps = R.represent(R.with_reps(df, {"term": ["t1", "t2", "t3", "t4"]}))
    assert sorted((tuple(r.features), r.freq) for r in reps.collect()) == [((), 1.0), (("term:a", "term:b"), 3.0)]


def test_specify_first_violated_only(spark):
    df = spark.createDataFrame([("r1", None, None), ("r2", "s", None), ("r3", "s", "t")], "id string, a1sur string, term1 string")
    got = {r.id: (r.a1sur, r.term1) for r in S.specify(df, [["a1sur"], ["term1"]], F.col("id")).collect()}
    assert got == {"r1": ("r1", None), "r2": ("s", "r2"), "r3": ("s", "t")}


def test_generalize(spark):
    rules = G.parse_scheme("2 x 1 y --> 1 x 1 y")
    rows = [("1", ["x:p", "x:q", "y:r"], 1.0, 3), ("2", ["x:p", "y:r"], 1.0, 2)]
    reps = spark.createDataFrame(rows, "rep_id string, features array<string>, freq double, n int")
    got = {(tuple(r.features), r.freq) for r in G.generalize(reps, rules).collect()}
    assert got == {(("x:p", "x:q", "y:r"), 1.0), (("x:p", "y:r"), 1.0), (("x:q", "y:r"), 0.0)}


def test_text(spark):
    df = spark.createDataFrame([("abcdef", "2020-01-02", "ab cd"), ("abc", "99-1", None)], "t string, d string, s string")
    rows = df.select(T.char_ngrams(F.col("t"), 4).alias("g"), T.publication_year(F.col("d")).alias("y"), T.ascii_fold(F.lit("Éçß—x")).alias("a")).collect()
    assert [r.g for r in rows] == [["abcd", "bcde", "cdef"], []] and [r.y for r in rows] == [2020, None] and rows[0].a == "Ecssx"
    one, two = T.year_windows(F.lit(2020))
    assert tuple(df.select(one, two).first()) == (20192020, 20202021)
    sections = T.sections(F.lit("One two. Three! Four five six"))
    assert df.select(T.word_bigrams(sections)).first()[0] == ["one two", "three", "four five", "five six"]


@pytest.mark.parametrize(
    "name,expected",
    [
        ("Smith, John", ("smith", "j", "john")), ("John Smith", ("smith", "j", "john")), ("Smith, Jo", ("smith", "j", None)), ("de la Cruz, J.-P.", ("cruz", "j", None)),
        ("Li, Wei", ("li", "w", "wei")), ("X, Anna", ("anna", "x", "x")), ("Beethoven, van Ludwig", ("van", "l", "ludwig")), ("anonymous", (None, None, None)), (None, (None, None, None)),
    ],
)
def test_authors(name, expected):
    assert U.parse_author(name) == expected


def test_hashes_and_distances():
    assert [hex(int(h)) for h in U.fnv1a64([b"", b"a", b"foobar"])] == ["0xcbf29ce484222325", "0xaf63dc4c8601ec8c", "0x85944171f73967e8"]
    assert U.osa("ca", "abc") == 3 and U.osa("ab", "ba") == 1 and U.osa("", "abc") == 3
    assert U.split_compound("arbeitsmarkt", {"arbeit", "markt"}) == ["arbeit", "markt"] and U.edits("dokument", {"document"}) == "document"


def test_simhash_pairs_at_the_border(spark):
    base = 0x0123456789ABCDEF
    near, far = base ^ 0b111, base ^ 0b1111
    df = spark.createDataFrame([("a", base), ("b", near), ("c", far ^ (1 << 40))], "rep_id string, hash long")
    assert {tuple(r) for r in H.similar_pairs(df, 3).collect()} == {("a", "b"), ("b", "c")}


def test_evaluation(spark):
    rows = [("1", "g", "r1", "x"), ("2", "g", "r1", "x"), ("3", "h", "r2", "x")]
    labelled = spark.createDataFrame(rows, "mention_id string, gold_id string, rep_id string, label string")
    got = E.pairwise(labelled).first()
    assert (got.t, got.p, got.tp, got.prec, got.rec) == (5, 9, 5, 55.55, 100.0)
    assert spark.range(1).select(E.percent(F.lit(2), F.lit(3))).first()[0] == 66.66
    assert tuple(E.core_counts(labelled).first()) == (2, 1, 0, 0) or E.core_counts(labelled).first().tp + E.core_counts(labelled).first().fp == 3
    split = E.pairwise(labelled, max_label=2).first()
    assert (split.p, split.tp) == (5, 5)
    table = E.sweep(labelled, [1], [10], [2, 10]).orderBy("max_label").collect()
    assert [(r.p, r.tp) for r in table] == [(5, 5), (9, 5)]


def test_lattice():
    import numpy as np
    import pandas as pd

    assert gini(np.ones(3)) == pytest.approx(0) and block_rates(np.zeros((2, 1))) == (1.0, 1.0, 1.0)
    nodes = pd.DataFrame({"rep_id": ["a", "b", "c"], "features": [["x"], ["x", "y"], ["x", "y", "z"]], "freq": [1.0, 1.0, 1.0], "gold": ["g", "g", "h"]})
    out = refine(nodes, step=0.1)
    assert len(out) == 10 and out[0][2] >= out[-1][2] and all(0 <= r[3] <= 1 for r in out)


def test_neighbours_and_groups(spark):
    terms = spark.createDataFrame([(t,) for t in "b a d c a e".split()], "term string")
    assert {tuple(r) for r in P.neighbours(terms, 2).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d"), ("c", "e"), ("d", "e")}
    freq = spark.createDataFrame([("a", 1), ("b", 5), ("c", 5)], "term string, freq long")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "term string, other string")
    assert {tuple(r) for r in P.term_groups(pairs, freq).collect()} == {("a", "c"), ("b", "c"), ("c", "c")}
    weights = spark.createDataFrame([("a", "x", 0.25), ("a", "y", 0.75)], "term string, other string, weight double")
    rows = spark.createDataFrame([(1, ["a", "q", "a"])], "id long, terms array<string>")
    got = {tuple(r.terms): r.weight for r in P.substitutions(rows, "terms", weights).collect()}
    assert len(got) == 4 and got["x", "q", "y"] == pytest.approx(0.1875)


def test_sources(spark, tmp_path):
    from twinfold.sources import readers

    (tmp_path / "dois.txt").write_text("10.1/a HTTP/2 302\n10.1/b HTTP/1.1 404\n10.1/c\n")
    assert {tuple(r) for r in readers.doi_status(spark, str(tmp_path / "dois.txt")).collect()} == {("10.1/a", 302, 1), ("10.1/b", 404, 0), ("10.1/c", None, 0)}
    (tmp_path / "t.json").write_text('{"core_id": "1", "labelled_duplicates": ["2"]}\n{"core_id": "3"}\n')
    assert {tuple(r) for r in readers.ground_truth(spark, str(tmp_path / "t.json")).collect()} == {("1", "1"), ("1", "2"), ("3", "3")}
    assert readers.parse_constraints("a > b\nc - d\n") == ([("a", "b")], [("c", "d")])
    assert readers.parse_types("term:t1 t2\nyear:y\n") == {"term": ["t1", "t2"], "year": ["y"]}


def test_streaming_ingest(spark, tmp_path):
    from twinfold.streaming.ingest import current, ingest

    spark.createDataFrame([("a", 1.0), ("b", 1.0), ("a", 1.0)], "t string, freq double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string, freq double").parquet(str(tmp_path / "in"))
    ingest(stream, {"term": ["t"]}, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.features[0], r.freq) for r in current(spark, str(tmp_path / "out")).collect()} == {("term:a", 2.0), ("term:b", 1.0)}


def test_lattice_run_has_all_thresholds(spark, tmp_path):
    from datetime import date

    from twinfold.plans import queries as Q

    rows = [(o, 7, s, n, date(1995, 1, 1), "A", "F", 1.0, 1.0, 0.0, 0.0) for o, s, n in ((3, 1, 1), (5, 1, 2), (15, 2, 1), (7, 2, 2))]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate date, l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = Q.lattice_run(spark, str(tmp_path)).collect()
    by_label = {}
    for r in found:
        by_label.setdefault(r.label, []).append((r.iteration, r.thr))
    assert by_label and all(sorted(x) == [(i, round(1 - i * 0.01, 4)) for i in range(1, 101)] for x in by_label.values())


def test_sweep_of_the_reference_settings(spark, tmp_path):
    from datetime import date

    from twinfold.plans import queries as Q

    # 120 lines of one order: beyond the former gold limits, within the reference's
    rows = [(3, 7 + k % 4, 1, k, date(1995, 1, 1), "A", "F", 1.0, 1.0, 0.0, 0.0) for k in range(120)] + [(5, 1, 2, 1, date(1995, 1, 1), "A", "F", 1.0, 1.0, 0.0, 0.0)] * 2
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate date, l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {(r.min_gold, r.max_gold, r.max_label): r.t for r in Q.QUERIES["eval_sweep_reference"](spark, str(tmp_path)).collect()}
    assert set(found) == {(a, b, c) for a in (1, 2) for b in (10, 25, 50, 100, 1000, 10000) for c in (10, 100, 1000, 10000, 100000, 1000000)}
    assert all(t == (4 if b <= 100 else 4 + 120**2) for (_, b, _), t in found.items())


def test_author_particles_and_dots():
    assert U.parse_author("Berg, van der Jan") == ("der", "j", "jan")
    assert U.split_author("Berg, van der Jan") == ("van der", "j", "jan")
    assert U.parse_author("Müller, Jean-Paul") == ("muller", "j", "jean-paul") and U.parse_author("Müller, J-Paul") == ("muller", "j", None)
    assert U.parse_author("J.P., Smith") == ("smith", "j", None) and U.parse_author("Garcia Marquez, Gabriel") == ("marquez", "g", "gabriel")
    assert U.parse_author("Unknown Person") == ("person", "u", None) and U.parse_author(" ,") == (None, None, None)


def test_mentions(spark):
    schema = "coreId string, doi string, title string, datePublished string, authors array<string>"
    rows = [("1", "d", "A  Title", "2020-05", ["Smith, Anna", "X, Bob", None]), ("2", None, None, None, None), ("3", "", "T", "20", [])]
    surnames, firsts = spark.createDataFrame([("anna", 9), ("smith", 1)], "name string, freq long"), spark.createDataFrame([("smith", 9), ("anna", 1)], "name string, freq long")
    got = {r.mention_id: r for r in M.publication_mentions(spark.createDataFrame(rows, schema), surnames, firsts).collect()}
    assert len(got["1"]) == 31 and (got["1"].title, got["1"].year1, got["1"].year2) == ("a title", 20192020, 20202021)
    assert (got["1"].a1sur, got["1"].a1init, got["1"].a1first, got["1"].a2sur, got["1"].a3sur) == ("anna", "anna_s", "anna_smith", "bob", None)
    assert (got["1"].term1, got["1"].term2, got["1"].term3) == ("a", "title", None)
    assert got["2"].a1sur is None and got["2"].title is None and got["3"].gold_id is None and got["3"].year1 is None
    plain = {r.mention_id: r for r in M.publication_mentions(spark.createDataFrame(rows, schema)).collect()}
    assert plain["1"].a1first == "smith_anna"
    assert M.publication_mentions(spark.createDataFrame([], schema)).count() == 0


def test_similar_fingerprints_by_all_pairs(spark):
    rng = random.Random(3)
    hashes = [rng.getrandbits(64) for _ in range(40)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))) for h in hashes for _ in range(3)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame([(f"{i:03}", h) for i, h in enumerate(signed)], "rep_id string, hash long")
    for k in (3, 7):
        want = {(f"{i:03}", f"{j:03}") for j in range(len(hashes)) for i in range(j) if 0 < (hashes[i] ^ hashes[j]).bit_count() <= k}
        assert {tuple(r) for r in H.similar_pairs(df, k).collect()} == want
    assert {len(r.label) for r in H.hyperplane_labels(reps_of(spark, ["ab", "c"]), 100).collect()} == {100}


def test_replacements_in_a_circle_raise(spark):
    words = spark.createDataFrame([(1, 0, "a")], "id long, pos int, term string")
    chain = spark.createDataFrame([(f"{'abcdefgh'[i]}", "abcdefgh"[i + 1]) for i in range(7)], "term string, chosen string")
    assert P.replace_until_stable(words, chain).first().term == "h"
    with pytest.raises(ValueError):
        P.replace_until_stable(words, spark.createDataFrame([("a", "b"), ("b", "a")], "term string, chosen string"), rounds=3)


def test_verified_groups(spark):
    rows = [("g", "s1", 2000, "On the Origin"), ("g", "s2", 2001, "on the orgiin"), ("h", "s1", None, "Same"), ("h", "s2", None, "same thing again"), ("i", "s1", 2000, "one"), ("i", "s1", 2000, "one"), ("j", "s1", 1, "alone"), ("k", "s1", 1, None), ("k", "s2", 1, "x")]
    got = {r.gold_id: r.verified for r in S.verify_groups(spark.createDataFrame(rows, "gold_id string, source string, year int, title string")).collect()}
    assert got == {"g": True, "h": True, "i": False, "k": False}


def test_node_levels(spark):
    reps = reps_of(spark, ["a", "ab", "b", "abc", "x"])
    assert {r.rep_id: r.level for r in C.node_levels(reps, C.containment_pairs(reps)).collect()} == {"a": 0, "b": 0, "ab": 1, "abc": 2, "x": 0}

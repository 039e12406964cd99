"""What is made list by list: the same as from tables of all sets and pairs, and without such tables."""

import random
from datetime import date

import pytest

from twinfold.operators import lists
from twinfold.plans import fixtures as X
from twinfold.plans import queries as Q
from twinfold.plans import storage

QUERIES = "apply_labels components core_tn_fn cut_overconnected eval_negatives generalization_levels group_concat_minels lattice_weights minel_combination_rates minel_edges minels node_levels topk_components transitive_reduction component_sizes core_tp_fp duplicate_documents eval_pairwise eval_sweep gold_labels minel_combinations minel_stats spanning_parent eval_sweep_reference".split()


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Few parts with many suppliers, so that lists have over 64 features, and lines that agree in all ids."""
    rng, folder = random.Random(11), tmp_path_factory.mktemp("lists")
    rows = [(rng.randrange(60), rng.randrange(3), rng.randrange(90), rng.randrange(1, 9), date(1992 + rng.randrange(4), 1, 1), rng.choice("ARN"), "F", 1.0, 1.0, 0.0, 0.0) for _ in range(700)]
    rows += [(7, 1, 1, 7, date(1992 + i % 3, 1, 1), "AR"[i % 2], "F", 1.0, 1.0, 0.0, 0.0) for i in range(6)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate date, l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, names).write.parquet(str(folder / "lineitem.parquet"))
    return str(folder)


def rows_of(df):
    return sorted(map(str, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())))


@pytest.mark.parametrize("name", QUERIES)
def test_by_list_as_by_tables(spark, lines, monkeypatch, name):
    stored = []
    write = storage.save
    for place in (Q, storage):
        monkeypatch.setattr(place, "save", lambda df, name: stored.append(name) or write(df, name))
    monkeypatch.setattr(lists, "BLOCK", 50)  # in this process; workers take their own
    found = Q.QUERIES[name](spark, lines)
    got, kinds = rows_of(found), found.dtypes
    assert not {"reps", "pairs", "minel-edges", "mentions", "labelled"} & set(stored)  # these outgrew the disk
    monkeypatch.setattr(X, "falls_apart", lambda *_: False)
    general = Q.QUERIES[name](spark, lines)
    assert got == rows_of(general) and kinds == general.dtypes and got


def test_missing_part_takes_the_general_way(spark, lines, tmp_path):
    table = spark.read.parquet(f"{lines}/lineitem.parquet")
    table.selectExpr("l_orderkey", "nullif(l_partkey, 1) as l_partkey", *table.columns[2:]).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert X.falls_apart(spark, lines) and not X.falls_apart(spark, lines, 100) and not X.falls_apart(spark, str(tmp_path))
    assert Q.QUERIES["minels"](spark, str(tmp_path)).count() > 0


def test_blocks_of_whole_lists(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lists, "BLOCK", 4)
    monkeypatch.setattr(lists, "COMPARED", 3)
    rng = random.Random(2)
    rows = [(k, "\x1f".join([f"a:{k}", *sorted(f"b:{x:02}" for x in rng.sample(range(70 if k == 3 else 6), rng.randint(0, 4)))])) for k in range(6) for _ in range(300 if k == 3 else k)]
    rows.sort(key=lambda r: r[0])
    batches = [pa.RecordBatch.from_pydict({"key": [k for k, _ in rows[i : i + 7]], "text": [t for _, t in rows[i : i + 7]]}) for i in range(0, len(rows), 7)]
    got, keys = set(), []
    for table in lists._tables(iter(batches)):
        order = lists.Order(table)
        keys += sorted(set(table.column("key").to_pylist()))
        pairs = [(order.texts[int(a)].as_py(), order.texts[int(b)].as_py()) for a, b in zip(order.sub, order.sup, strict=True)]
        assert len(pairs) == len(set(pairs)) and not got & set(pairs)
        got |= set(pairs)
    alone = lists.Order(pa.table({"key": [1, 2], "text": ["a:1", "a:2"]}))
    assert alone.size == 2 and len(alone.sub) == 0 and lists._direct(alone)[0].to_pylist() == []
    sets = {t: set(t.split("\x1f")) for _, t in rows}
    assert keys == sorted(set(keys)) and got == {(a, b) for a in sets for b in sets if sets[a] < sets[b]} and any("b:6" in a for a, _ in got)

"""Intermediate tables: each piece of work deletes its own only."""

import os
import threading

import pytest
from lodestone.operators import graph
from lodestone.sources import shared
from pyspark.sql import functions as F


def folder(df):
    return df.inputFiles()[0].split("/part-")[0].removeprefix("file://")


def test_a_scope_drops_its_own_tables(spark):
    mine = shared.written(spark.range(5), "outside")
    with shared.scope(spark) as tables:
        one, two = (shared.written(spark.range(5), f"t{i}") for i in range(2))
        gone, kept = folder(one), folder(two)
        with shared.scope(spark):
            three = shared.written(spark.range(5), "inner")
        tables.drop(spark, keep=[two, three])
        assert not os.path.exists(gone) and two.count() == three.count() == mine.count() == 5
        tables.drop(spark)
        assert not os.path.exists(kept) and mine.count() == 5
    shared.clean(spark)
    assert not os.path.exists(folder(mine)) if mine.inputFiles() else True


def test_a_failed_scope_leaves_nothing(spark):
    before = set(os.listdir(shared.shared_dir(spark)))
    with pytest.raises(ZeroDivisionError), shared.scope(spark):
        shared.written(spark.range(5), "t")
        with shared.scope(spark):
            shared.written(spark.range(5), "inner")
        raise ZeroDivisionError
    assert set(os.listdir(shared.shared_dir(spark))) == before


def test_queries_side_by_side(spark):
    """Components, which drop their rounds, run in threads beside work that writes and reads tables of its own."""
    edges = spark.range(200).select(F.concat(F.lit("n"), F.col("id")).alias("source"), F.concat(F.lit("n"), F.col("id") + F.when(F.col("id") % 20 == 19, 0).otherwise(1)).alias("target"))
    found, faults = [], []

    def work(f):
        try:
            found.append(f())
        except Exception as e:
            faults.append(e)

    def tables():
        frames = []
        for i in range(12):
            frames.append(shared.written(spark.range(i + 1), "beside"))
            assert [f.count() for f in frames] == list(range(1, i + 2))
        return None

    threads = [threading.Thread(target=work, args=(f,)) for f in (lambda: graph.component_sizes(graph.connected_components(edges)).collect(), tables, lambda: graph.component_sizes(graph.connected_components(edges)).collect(), tables)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not faults
    a, b = (f for f in found if f is not None)
    assert a == b and len(a) == 10 and {r.n for r in a} == {20}

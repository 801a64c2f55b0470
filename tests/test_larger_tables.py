"""What only larger tables showed: keys that are cut to six digits meet, so firms share a gvkey."""

from __future__ import annotations

from datetime import date
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as bt
from tidemark.operators import exposure_panel, models, panel
from tidemark.operators import set_models as sm
from tidemark.operators.set_networks import DeepSets, SetTransformer, packed
from tidemark.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The smallest tables twice: part n also as 1,000,000 + 10 * n, whose first six digits are those of 100,000 + n."""
    out, con = tmp_path_factory.mktemp("shifted"), duckdb.connect()
    again = {"part": "100000 + p_partkey as p_partkey", "lineitem": "100000 + l_partkey as l_partkey"}, {"part": "1000000 + 10 * p_partkey as p_partkey", "lineitem": "1000000 + 10 * l_partkey as l_partkey"}
    for f in DATA.glob("*.parquet"):
        parts = [f"select * replace ({x[f.stem]}) from '{f}'" for x in again] if f.stem in again[0] else [f"select * from '{f}'"]
        con.execute(f"copy ({' union all '.join(parts)}) to '{out / f.name}' (format parquet)")
    return out


def test_the_latest_report_of_firms_that_share_a_gvkey_is_the_same_in_any_order(spark):
    """Reports of one gvkey, date and shard: the largest stays, however the rows are dealt."""
    rows = [("100000", date(2000, 12, 31), float(ni), 2000) for ni in range(7)]
    firms = spark.createDataFrame([("100000", 1)], "gvkey string, permno long")
    for given in (rows, rows[::-1], rows[3:] + rows[:3]):
        out = exposure_panel.with_latest_report(firms, spark.createDataFrame(given, "gvkey string, datadate date, ni double, year int").coalesce(1)).collect()
        assert [tuple(r) for r in out] == [("100000", 1, date(2000, 12, 31), 6.0)]


def test_reports_of_firms_that_share_a_gvkey_are_each_extracted_once(spark, shifted):
    con = duckdb.connect()
    for f in shifted.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    got = registry.queries()["funda_extract"](spark, str(shifted))
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in got.columns)} from ({registry.oracle_sql()['funda_extract']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > len({r[:2] for r in want})


@pytest.mark.parametrize("name", ["funda_available", "monthly_panel", "feature_frame", "standardised"])
def test_only_ties_that_the_sql_leaves_open_differ_where_firms_share_a_gvkey(spark, shifted, name):
    """Of several reports of one gvkey, public date, fiscal date and shard the SQL keeps any. With the largest other columns
    first, as the query has it, all rows are equal; and the query's reports are among those that the SQL may keep."""
    con = duckdb.connect()
    for f in shifted.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    got, sql = registry.queries()[name](spark, str(shifted)), registry.oracle_sql()[name]
    columns, mine = ", ".join(f'"{c}"' for c in got.columns), sorted(repr(tuple(r)) for r in got.collect())
    first, order = "row_number() over (partition by gvkey, funda_avail_date ", "order by funda_datadate desc, year desc"
    assert sql.count(first + order) == 1
    closed = sql.replace(first + order, first + order + "".join(f', fund."{c}" desc nulls last' for c in ("at", "capx", "ceq", "dlc", "dltt", "ni", "sale", "xrd")))
    assert mine == sorted(map(repr, con.execute(f"select {columns} from ({closed})").fetchall()))
    if name == "funda_available":
        may = list(map(repr, con.execute(f"select {columns} from ({sql.replace(first, first.replace('row_number', 'rank'))})").fetchall()))
        assert set(mine) <= set(may) and len(may) > len(mine)


@pytest.mark.parametrize("tasks", [1, 7])
def test_the_mean_of_many_rows_keeps_its_digits_however_they_are_dealt(spark, tasks):
    """A plain mean of 700,000 rows near a million moves the results by 8e-7, which the query's six digits show."""
    train = spark.range(0, 700_000, 1, tasks).select((F.lit(1e6) + F.col("id") % 7 * 0.1).alias("x"))
    values = [1e6 + i * 0.1 for i in range(7)]
    mean = sum(map(Fraction, values)) / 7
    deviation = float(sum((Fraction(v) - mean) ** 2 for v in values) / 7) ** 0.5
    out = models.standardised(train, spark.createDataFrame([(v,) for v in values], "x double"), ["x"]).orderBy("x").collect()
    assert np.allclose([r.x for r in out], [float(Fraction(v) - mean) / deviation for v in values], rtol=0, atol=3e-9)


def test_features_that_vary_together_are_counted_together_with_the_same_sums():
    rng = np.random.default_rng(3)
    month = rng.integers(0, 60, 5000)
    codes = np.stack([rng.integers(0, 255, 5000), month, 7 * month % 60, month // 12, rng.integers(0, 255, 5000)], 1).astype(np.uint8)
    codes[rng.random(5000) < 0.1, 4] = bt.MISSING
    g, used = rng.normal(size=5000), np.array([0, 1, 3, 4])
    bundled = bt.bundles(codes)
    assert sorted(sorted(b.bins) for b in bundled) == [[0], [1, 2, 3], [4]]
    grow = bt.Growing(codes, g, used, bt.Settings(), bundled)
    for rows in (np.arange(5000), np.arange(0, 5000, 3)):
        got = grow.local(bt.Node(rows))
        for k, j in enumerate(used):
            assert np.allclose(got[0, k], np.bincount(codes[rows, j], g[rows], 256)) and (got[1, k] == np.bincount(codes[rows, j], minlength=256)).all()


def test_sets_are_computed_at_their_own_length_with_the_same_gradients():
    rng = np.random.default_rng(5)
    ids = rng.integers(1, 9, (300, 12)) * (np.arange(12) < rng.choice([0, 1, 1, 1, 2, 3, 12], 300)[:, None])
    rows = {"day": np.full(300, 730_000), "target": rng.normal(size=300), "ids": ids, "shares": rng.random((300, 12)), "controls": np.zeros((300, 0))}
    parts = sm.by_length(ids)
    assert sorted(np.concatenate([at for _, at in parts])) == list(range(300)) and sum(n * len(at) for n, at in parts) < 300 * 12 / 2
    fold = sm.Fold(2003, date(2002, 12, 31), date(2003, 1, 31), date(2003, 12, 31))
    for network in (DeepSets(9, 0), SetTransformer(9, 0)):
        m = sm.Model("any", fold, network, (0.0, 1.0), np.zeros((3, 0)), 7)
        n, loss, g = m.sums(rows, None)
        out, kept, p = m.output(rows, np.arange(300))
        off = out - rows["target"]
        assert n == 300 and np.isclose(loss, off @ off) and np.allclose(g, packed(network.gradient(p, kept, 2 * off))) and np.allclose(m.outputs(rows, np.arange(300)), out)


def test_a_few_steps_are_one_job(spark, tmp_path):
    out = [(f"{i:03d}", i, date(2001, 1, 28), float(i % 3), [1 + i % 5, 0], [1.0, 0.0], [0.5]) for i in range(200)]
    rows = spark.createDataFrame(out, "gvkey string, permno long, date date, target double, geo_ids array<int>, shares array<double>, controls array<double>")
    models = [m for m, _ in sm.made_models(rows, [sm.Fold(2003, date(2002, 12, 31), date(2003, 1, 31), date(2003, 12, 31))], ["set_only"], 9, 1, 137)]
    slices = sm.dealt(rows, 5, 1, 137)
    spark.sparkContext.setJobGroup("steps", "steps")
    sm.train(slices, models, str(tmp_path / "s"), epochs=4, every=20, tasks=2)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("steps"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 20  # one a step before


@pytest.mark.parametrize("make", [panel.snapshots, panel.geo_tokens])
def test_segments_are_dealt_once(spark, make):
    rows = [("1", "a", date(2001, 3, 31), date(2001, 2, 28), "x", "y", 1.0, None, None)]
    segments = spark.createDataFrame(rows, "gvkey string, sid string, srcdate date, datadate date, gareag string, gareat string, sales double, revts double, ias double")
    plan = make(segments)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # two before

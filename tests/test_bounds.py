"""No task holds a whole table, and what lies beyond a bound is not lost."""

from __future__ import annotations

import random
from datetime import date

import pandas as pd

from tidemark.llm import html, mixing
from tidemark.operators import xsec
from tidemark.sources import sinks


def test_ranks_are_dealt_by_a_number_in_more_parts_than_groups(spark):
    rng = random.Random(5)
    rows = [(m, date(2000, k + 1, 1), i, rng.randrange(9) / 8, rng.random() if i % 9 else None) for m in ("a", None) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "m string, date date, permno long, x double, y double")
    numbered, places = xsec.numbered(df, ["m", "date"])
    assert numbered.columns == ["permno", "x", "y", "_g"] and places.count() == 6 and numbered.rdd.getNumPartitions() == 12
    got = {(r["m"], r["date"]): (r["rank_ic"], r["n"]) for r in xsec.rank_ic(df, "x", "y", by=["m"]).collect()}
    pdf = pd.DataFrame(rows, columns=["m", "date", "permno", "x", "y"]).dropna(subset=["y"])
    for (m, day), part in pdf.fillna({"m": "-"}).groupby(["m", "date"]):
        ic, n = got.pop((None if m == "-" else m, day))
        assert n == len(part) and abs(ic - part["x"].rank().corr(part["y"].rank())) < 1e-12
    assert not got
    whole = xsec.quintiles(df, "x", by=["m"])
    assert whole.columns == [*df.columns, "quintile"] and whole.where("quintile is not null").count() == 240


def test_csv_tables_of_many_parts_are_one_table_each(spark, tmp_path):
    sinks.write_csv(spark.range(100).repartition(4), str(tmp_path / "f_t"), parts=True)
    assert len(list((tmp_path / "f_t").glob("part-*.csv"))) == 4
    assert [tuple(r) for r in sinks.table_inventory(spark, {"f": str(tmp_path / "f_*")}).collect()] == [("f", "f_t", "id")]


def tree(text):
    return html.folded(root := html.Tree(text).root, html.masses(html.blocks(root)))


def test_slots_beyond_the_aligned_children_and_levels_are_found():
    w = None
    for page in range(3):  # the article has another label than the 40 short blocks that most pages share
        own = f"<div class='text'>{'word ' * 400}{page}</div>" if page == 1 else ""
        part = tree("<body>" + "".join(f"<div class='a{k}'>x{page}</div>" for k in range(html.MOST_CHILDREN)) + own)
        w = html.combined(w, part) if w else part
    assert html.slot(html.varying(w, {})) == ["#", "body.", "div.text"]
    deep = 3 * html.DEEPEST
    w = tree("<body>" + "<div class='d'>" * deep + f"<p>n</p><div class='text'><p>{'word ' * 50}</p><p>{'more ' * 50}</p></div>")
    w = html.combined(w, w)
    assert html.slot(html.varying(w, {})) == ["#", "body.", *["div.d"] * deep, "div.text"]


def test_a_mix_does_not_depend_on_the_number_of_patterns_held(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.randrange(1, 50), [f"={s}" for s in rng.sample(range(5), rng.randrange(3, 6))]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, size long, sources array<string>")
    taken = []
    for most in (100_000, 3):
        monkeypatch.setattr(mixing, "MOST_PATTERNS", most)
        taken.append(sorted((r["id"], tuple(r["sources"]), r["copies"]) for r in mixing.mix(df)[0].collect()))
    assert taken[0] == taken[1] and {x[0]: x[1] for x in taken[1]} == {i: tuple(sorted(s)) for i, _, s in rows}

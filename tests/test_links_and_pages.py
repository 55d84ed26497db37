"""Components, entities along chains, nested tables, encodings, scratch space."""

import os
import random

from pyspark.sql import functions as F

from statloom.operators.components import connected_components
from statloom.operators.entities import consolidate, entity_chains
from statloom.session import cut, scratch, ship
from statloom.sources import html_tables, tables


def brute(links):
    label = {x: x for pair in links for x in pair}
    while True:
        before = dict(label)
        for u, v in links:
            label[u] = label[v] = min(label[u], label[v])
        if label == before:
            return label


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)]  # a chain
    links += [(1000, 1000 + i) for i in range(1, 80)] + [(5000 - i, 5000) for i in range(30)]  # stars
    links += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(7, 7), (9000, 9000)]
    got = connected_components(spark.createDataFrame([*links, (None, 1), (2, None)], "u long, v long"))
    assert {r["node"]: r["label"] for r in got.collect()} == brute(links)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_entities_along_chains(spark):
    rng = random.Random(5)
    rows = [(n, rng.choice([None, *range(40)]), rng.choice([None, "", *[f"Ann{i}" for i in range(60)]])) for n in range(90)]
    rows += [(100, 500, "Bo One"), (101, 500, "bo two"), (102, 501, "Bó One"), (103, 502, "Bo Two"), (104, None, "BO TWO")]  # one id, two names, each shared
    df = spark.createDataFrame(rows, "n long, id long, name string")
    got = {r["n"]: r["entity"] for r in entity_chains(df, "id", "name", "n").collect()}
    assert len({got[i] for i in range(100, 105)}) == 1 and got[100] == "id:500"
    nodes = {n: [x for x in (f"id:{i}" if i is not None else None, f"name:{(k or '').lower()}" if k else None) if x] for n, i, k in rows[:90]}
    label = brute([(v[0], v[-1]) for v in nodes.values() if v])
    assert all(got[n] == (label[v[0]] if v else f"row:{n}") for n, v in nodes.items())
    assert consolidate(df, "id", "name", "n", chains=True).count() == len(set(got.values()))


def test_nested_tables(spark):
    page = """<!-- <table><tr><td>no</td></tr></table> --><script>"<table>"</script>
      <table id=outer><tr><th>A</th><th>B</th></tr>
      <tr><td>1<td><table><tr><td>x</td><td>y</td></tr><tr><td>z</td></tr></table> tail
      <tr><td>2</td><td>two &amp; more</td></tr><tr><td>3</td><td>three</td></table><p>after</p>"""
    pages = [(1, page), (2, "<p>none</p>"), (3, None), (4, "<TABLE><TR><TD>only"), (5, "<table><tr><td>a</td></tr></table><table><tr><td>b<tr><td>c</table></table>")]
    df = spark.createDataFrame(pages, "id long, html string")
    got = {}
    for r in html_tables.block_rows(df, ["id"], "html").orderBy("id", "row_no").collect():
        got.setdefault(r["id"], []).append(r["cells"])
    assert got == {1: [["A", "B"], ["1", "x y z tail"], ["2", "two & more"], ["3", "three"]], 4: [["only"]], 5: [["b"], ["c"]]}
    records = [r["record"] for r in html_tables.table_records(df.filter("id = 1"), ["id"], "html").orderBy("row_no").collect()]
    assert records == [{"A": "1", "B": "x y z tail"}, {"A": "2", "B": "two & more"}, {"A": "3", "B": "three"}]
    plan = html_tables.table_records(df, ["id"], "html")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_encodings_by_one_scan(spark, tmp_path):
    names = []
    for i in range(6):
        path = tmp_path / f"a file {i}.csv"
        head = "name,v\n" if i < 4 else "name,w\n"
        path.write_bytes((head + f"José{i},{i}\n").encode("latin-1" if i % 2 else "utf-8"))
        names.append(str(path))
    out = tables.csv_any_encoding(spark, names)
    assert sorted((r["name"], r["v"], r["w"]) for r in out.collect()) == [(f"José{i}", str(i) if i < 4 else None, str(i) if i > 3 else None) for i in range(6)]
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan csv") <= 4  # two encodings, two headers


def test_scratch_space_is_given_back(spark):
    with scratch(spark) as paths:
        assert cut(spark.range(1000), "mine").count() == 1000
        assert len(paths) == 1
    assert spark.read.parquet(paths[0]).count() == 0


def test_package_goes_to_workers(spark):
    ship(spark)

    def where(batches):
        import statloom

        for b in batches:
            yield b.assign(p=os.path.basename(os.path.dirname(statloom.__file__)))

    assert spark.range(2).select(F.lit("").alias("p")).mapInPandas(where, "p string").first()["p"] == "statloom"

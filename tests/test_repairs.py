"""Cases that clean tables do not show: NaN, big numbers, dotted names, wide rows, many columns, repeated commits."""

import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException

from sondage.operators import ordered, profile, quality, relational
from sondage.plans.joins import is_small
from sondage.session import shared_folder
from sondage.sources.versions import VersionedTable

NAN = float("nan")


def test_fill_backward_is_linear(spark, conf):
    conf(buckets=1)
    df = spark.range(200_000).selectExpr("id", "CASE WHEN id % 1000 = 999 THEN id END AS v")
    start = time.perf_counter()
    out = ordered.fill_backward(df, "v", "id").selectExpr("count_if(v = id - id % 1000 + 999) AS n").first()
    assert out["n"] == 200_000 and time.perf_counter() - start < 30


@pytest.mark.parametrize("values,kind,ranks", [
    ([1_700_000_000_000_000_001, 1_700_000_000_000_000_002, 1_700_000_000_000_000_003, None], "long", [3, 2, 1, None]),
    ([1.0, NAN, 3.0, 3.0], "double", [3, None, 1, 1]),
    (["b", "a", "c", None], "string", [2, 3, 1, None]),
])
def test_rank_keeps_types(rows, values, kind, ranks):
    df = rows([(i, v) for i, v in enumerate(values)], f"k int, v {kind}")
    got = {r["k"]: r["rank"] for r in ordered.rank_by(df, "v").collect()}
    assert [got[i] for i in range(len(values))] == ranks


def test_rank_within_parts(rows):
    df = rows([("a", 1), ("a", 5), ("a", 5), ("b", 2), (None, 7)], "g string, v long")
    got = sorted((str(r["g"]), r["v"], r["rank"]) for r in ordered.rank_by(df, "v", "g").collect())
    assert got == [("None", 7, 1), ("a", 1, 3), ("a", 5, 1), ("a", 5, 1), ("b", 2, 1)]


def test_nan_is_missing_everywhere(rows):
    df = rows([(1, 1.0), (2, NAN), (3, None), (4, 4.0)], "k int, v double")
    assert {r["column"]: r["missing"] for r in profile.missing_table(df).collect()} == {"k": 0, "v": 2}
    assert {r["column"]: (r["nunique"], r["missing"]) for r in profile.nunique_table(df).collect()}["v"] == (2, 2)
    filled = lambda t: [r["v"] for r in t.orderBy("k").collect()]
    assert filled(quality.fill_missing(df, "v", "constant", 9)) == [1.0, 9.0, 9.0, 4.0]
    assert filled(ordered.fill_forward(df, "v", "k")) == [1.0, 1.0, 1.0, 4.0]
    assert filled(ordered.fill_backward(df, "v", "k")) == [1.0, 4.0, 4.0, 4.0]
    assert [r["running_total"] for r in ordered.running_total(df, "v", "k").orderBy("k").collect()] == [1.0, None, None, 5.0]


def test_integers_in_text_are_exact(rows):
    df = rows([(1, "9007199254740993"), (2, "12.0"), (3, "n/a"), (4, None)], "k int, t string")
    assert [r["t"] for r in relational.convert(df, "t", "integer").orderBy("k").collect()] == [9007199254740993, 12, None, None]
    with pytest.raises(ValueError):
        relational.convert(rows([(1, "1.5")], "k int, t string"), "t", "integer")


def test_dotted_names_and_long_lists(rows):
    df = rows([(i, i * 2) for i in range(1000)], "`a.b` int, c int")
    assert [r["a.b"] for r in relational.top_n(df, "a.b", 2).collect()] == [999, 998]
    assert relational.filter_in(df, "c", list(range(0, 2000, 4))).count() == 500


def test_sql_leaves_no_view(spark, rows):
    rows([(7,)], "x int").createOrReplaceTempView("other")
    assert relational.sql(rows([(1,), (2,)], "x int"), "SELECT count(*) AS s FROM dataset UNION ALL SELECT x FROM other").count() == 2
    assert not spark.catalog.tableExists("dataset") and spark.catalog.tableExists("other")
    spark.catalog.dropTempView("other")


def test_size_is_measured_in_bytes_too(rows, conf):
    wide = rows([(i, "x" * 1000) for i in range(100)], "k int, t string")
    assert is_small(wide)
    conf(broadcast_bytes=50_000)
    assert not is_small(wide) and is_small(wide.select("k"))


def test_duplicate_rows_tell_nulls_apart(rows):
    df = rows([("a", None), (None, "a"), ("a", None), ("b", "b"), (None, None), (None, None), (None, None)], "x string, y string")
    assert sorted(map(str, profile.duplicate_rows(df).collect())) == sorted(map(str, [r for r in df.collect() if (r.x, r.y) in {("a", None), (None, None)}]))


def test_versions_are_never_overwritten(spark, rows, tmp_path):
    root = str(tmp_path / "table")
    v = VersionedTable(spark, root)
    assert v.commit(rows([(1,)], "x int")) == 1 and v.commit(rows([(1,), (2,)], "x int")) == 2
    v.restore(1)
    assert v.load().count() == 1 and v.latest() == 3 and not (tmp_path / "table" / "v000003").exists()
    assert v.commit(rows([(1,), (2,), (3,)], "x int")) == 4 and v.load(3).count() == 1 and v.load(4).count() == 3
    late = VersionedTable(spark, root)
    late.latest = lambda: 1  # another writer that has not seen version 2
    with pytest.raises(AnalysisException):
        late.commit(rows([(9,)], "x int"))
    (tmp_path / "table" / "log").rename(tmp_path / "kept")
    (tmp_path / "table" / "log").write_text("not a table")
    with pytest.raises(Exception):
        VersionedTable(spark, root).commit(rows([(9,)], "x int"))
    (kept,) = (tmp_path / "table").glob("v000001-*")
    assert v.spark.read.parquet(str(kept)).count() == 1


def test_versions_of_two_writers_and_of_one_that_dies(spark, rows, tmp_path):
    root = str(tmp_path / "table")
    v = VersionedTable(spark, root)
    v.commit(rows([(1,)], "x int"))
    v.commit(rows([(1,), (2,)], "x int"))
    late = VersionedTable(spark, root)
    late.latest = lambda: 2  # both start from version 2
    v.restore(1)
    with pytest.raises(AnalysisException):
        late.restore(2)
    with pytest.raises(AnalysisException):
        late.commit(rows([(9,)], "x int"))
    assert [r["version"] for r in v.log().orderBy("version").collect()] == [1, 2, 3] and v.load(3).count() == 1
    dying = VersionedTable(spark, root)
    dying._record = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        dying.commit(rows([(7,)], "x int"))
    assert v.latest() == 3 and v.commit(rows([(1,), (2,), (3,)], "x int")) == 4 and v.load().count() == 3
    assert not list((tmp_path / "table" / "_drafts").glob("[!.]*"))

    taken = VersionedTable(spark, str(tmp_path / "race"))
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: taken._put("log/000001.json", f"{i}\n"), range(8)))
    assert sum(made) == 1 and (tmp_path / "race" / "log" / "000001.json").read_text() == f"{made.index(True)}\n"


def test_no_temporary_folder_on_a_cluster():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_findings_cover_every_column(spark):
    names = [f"n{i}" for i in range(14)]
    df = spark.range(400).selectExpr("id", *[f"CASE WHEN id % 20 = {i % 7} THEN id * 1000 ELSE pmod(id * {7 + 2 * i}, 40) * 1.0 END AS {c}" for i, c in enumerate(names)])
    types = {"id": "text", **dict.fromkeys(names, "numeric")}
    issues = quality.detect_issues(df, types).where("issue = 'outliers'").collect()
    assert {r["column"] for r in issues} == set(names)
    assert {r["column"] for r in quality.root_causes(df, types).where("factor = 'extreme values'").collect()} == set(names)
    assert quality.detect_issues(df, types, most=3).count() == 3


def test_crosstab_with_zeros_gathers_no_levels(rows):
    df = rows([("a", 1), ("a", 2), ("b", 3), ("b", 3), (None, 4), ("c", None)], "x string, y int")
    made = relational.crosstab(df, "x", "y", zeros=True)
    want = {("a", "1"): 1, ("a", "2"): 1, ("b", "3"): 2, ("a", "3"): 0, ("b", "1"): 0, ("b", "2"): 0}
    assert {(r[0], r[1]): r[2] for r in made.collect()} == want and made.count() == len(want)
    assert "collect_" not in made._jdf.queryExecution().optimizedPlan().toString()

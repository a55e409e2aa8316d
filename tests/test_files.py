"""Files of several splits: lines in place, ranking blocks, results of runs."""

import json

import pytest
from pyspark.sql import functions as F

from graphlens.plans import files
from graphlens.sources import kg
from graphlens.sources.lines import scan_lines, split_bytes


def write(path, lines, end="\n"):
    path.write_text("".join(x + end for x in lines), encoding="utf-8")
    return str(path)


def test_lines_of_many_splits_and_files(spark, tmp_path):
    lines = [f"line {i} " + "é" * (i % 60) for i in range(2000)]
    for k in range(4):  # the files differ in size: Spark reads the largest splits first
        write(tmp_path / f"{k}.txt", lines[: 100 * k * k + 7])
    want = [x for k in range(4) for x in lines[: 100 * k * k + 7]]
    with split_bytes(spark, 2048):
        df = scan_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 20
        assert [r["value"] for r in df.orderBy("pos").collect()] == want and df.agg(F.min("pos"), F.max("pos")).first() == (0, len(want) - 1)
        some = scan_lines(spark, str(tmp_path), F.col("value").rlike("^line [0-9]*7 ")).orderBy("pos").collect()
        assert [(r["pos"], r["value"]) for r in some] == list(enumerate(x for x in want if x.split()[1].endswith("7")))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "2048"


def test_last_line_of_an_id_wins_over_splits(spark, tmp_path):
    lines = [f"id{i % 50}\tvalue {i}" for i in range(3000)] + ["short"]
    with split_bytes(spark, 2048):
        got = {r["id"]: r["text"] for r in kg.scan_map(spark, write(tmp_path / "map.txt", lines)).collect()}
    assert got == {f"id{k}": f"value {2950 + k}" for k in range(50)}


def ranking(slot, blocks, n):
    row = lambda b, j: f"h{b}\tr\tt{j}" if slot == "tail" else f"h{j}\tr\tt{b}"
    return [row(b, j) for b in range(blocks) for j in range(n)]


@pytest.mark.parametrize("slot", ["tail", "head"])
def test_ranking_file_of_many_splits(spark, tmp_path, slot):
    n, blocks = 7, 400
    lines = ranking(slot, blocks, n)
    lines[5 * n + 2] = "other\tr\telse"  # block 5 is not its query's
    lines[9 * n] = lines[9 * n + 1]  # block 9 lacks the answer
    lines[20 * n : 20 * n] = ["too\tshort"] * 3  # these do not count
    lines += ["left\tover\trow"]  # no whole block
    queries = [f"h{b}\tr\tt0" if slot == "tail" else f"h0\tr\tt{b}" for b in range(blocks + 2)]
    with split_bytes(spark, 2048):
        rows = kg.scan_triples(spark, write(tmp_path / "rank.txt", lines))
        assert rows.rdd.getNumPartitions() > 5 and kg.ranking_slot(rows, n) == slot
        kinds = {r["slot"]: r["count"] for r in kg.scan_rankings(rows, n).filter(f"n_rows = {n}").groupBy("slot").count().collect()}
        assert kinds == {slot: blocks - 1, "mixed": 1}
        got = {r["pos"]: r for r in kg.convert_rankings(rows, kg.scan_triples(spark, write(tmp_path / "q.txt", queries)), n, slot).collect()}
    assert sorted(got) == list(range(blocks)) and {k: r["status"] for k, r in got.items() if r["status"] != "ok"} == {5: "block_mismatch", 9: "gold_missing"}
    assert got[300]["candidates"] == [f"{'t' if slot == 'tail' else 'h'}{j}" for j in range(n)]
    assert kg.ranking_slot(rows.limit(0), n) == "mixed"


def test_problem_column(spark, tmp_path):
    path = write(tmp_path / "t.tsv", ["a\tr\tb\t1", "a\tr", "a\tr\tc\tyes", "a\tr\td", ""])
    got = [(r["pos"], r["problem"]) for r in kg.scan_triples(spark, path, has_label=True, problems=True).orderBy("pos").collect()]
    assert got == [(0, None), (1, "short"), (2, "bad_label"), (3, None), (4, "short")]


@pytest.mark.parametrize(("raw", "want"), [(["a , r,b ,x", "a,r", "c,r,d"], ["a\tr\tb", "c\tr\td"]), (["a\tr, s\tb", "c\tr\td\t1"], ["a\tr, s\tb", "c\tr\td"])])
def test_convert_delimited(spark, tmp_path, raw, want):
    kg.convert_delimited(spark, write(tmp_path / "raw", raw), str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == want


def test_result_files_as_people_write_them(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"ch1-S{k}.json").write_text(json.dumps({"config": {"seed": k, "lr": 0.1}, "env": {"python": "3"}, "metrics": {"mrr": k / 2}, "note": "a\nb"}, indent=2))
    (tmp_path / "ch1-cut.json").write_text('{\n  "config": {"seed":')
    (tmp_path / "ch1-rows.json").write_text('{"metrics": {"mrr": 0.25}}\n{"metrics": {"mrr": 0.5}}\n{"metr\n')
    (tmp_path / "ch1-one row.json").write_text('{"metrics": {"mrr": 0.75}}')
    got = sorted((r["file"], r["config"]["seed"] if r["config"] else None, r["metrics"]["mrr"]) for r in kg.read_results(spark, f"{tmp_path}/ch1-*").collect())
    assert got == [("ch1-S0.json", 0, 0.0), ("ch1-S1.json", 1, 0.5), ("ch1-S2.json", 2, 1.0), ("ch1-one row.json", None, 0.75), ("ch1-rows.json", None, 0.25), ("ch1-rows.json", None, 0.5)]
    (tmp_path / "none").mkdir()
    assert kg.read_results(spark, str(tmp_path / "none")).count() == 0


def test_result_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a b", 1, [0.5]), ("c=d/e", 2, [])], "run string, n int, scores array<double>")
    kg.write_result_files(df, str(tmp_path / "r"), {"seed": "7"})
    got = {r["file"]: r for r in kg.read_results(spark, str(tmp_path / "r")).collect()}
    assert {k: r["n"] for k, r in got.items() if k == "a b.json"} == {"a b.json": 1} and sorted(r["n"] for r in got.values()) == [1, 2]
    assert all(r["config"]["seed"] == "7" and r["env"]["spark"] == spark.version for r in got.values())
    with pytest.raises(ValueError, match="more than one"):
        kg.write_result_files(df.unionAll(df), str(tmp_path / "twice"), {})


def test_splits_grow_with_what_is_written(spark):
    """A split of fixed size made a task of each 2 KB of a large table."""
    seen = []

    def back(path):
        df = spark.read.text(path)
        seen.append(df.rdd.getNumPartitions())
        return df

    for n in (200, 60_000):
        rows = spark.range(n).select(F.format_string("line %040d", "id").alias("value"))
        assert files.round_trip(spark, lambda path, rows=rows: rows.write.text(path), back).distinct().count() == n
    assert 4 < seen[0] <= 12 and 200 < seen[1] <= files.SPLITS + 8  # 4 files

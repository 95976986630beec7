"""Files in and out, the command line, the stream, and the driver's contract."""

import io

import pytest

from tideline.cli import run
from tideline.sources.transfer import export_collections, import_collections, write_csv_text
from tideline.store.repo import Repo
from tideline.store.schema import Schema
from tideline.streaming.sink import write_stream

S = Schema(timestamp="timestamp*", value="float")


@pytest.fixture
def repo(spark, tmp_path):
    r = Repo(spark, str(tmp_path / "store"))
    c = r.create_collection(S, "wea/ther")
    for label, n in (("a", 3), ("b c", 2)):
        (c / label).write({"timestamp": list(range(n)), "value": [float(i) for i in range(n)]})
    return r


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_export_import(spark, repo, tmp_path, kind):
    export_collections(repo, str(tmp_path / "out"), kind=kind)
    other = Repo(spark, str(tmp_path / "other"))
    made = import_collections(other, str(tmp_path / "out"))
    assert [c.label for c in made] == ["wea/ther"] and made[0].schema == S
    assert sorted(map(tuple, made[0].df().collect())) == sorted(map(tuple, repo.collection("wea/ther").df().collect()))


def test_flat_files(spark, tmp_path):
    d = tmp_path / "in" / "c"
    d.mkdir(parents=True)
    (d / "_schema.json").write_text(S.dumps())
    (d / "x.csv").write_text("value,timestamp\n1.5,2020-01-01T00:00\n")
    (d / "_skip.csv").write_text("nonsense\n")
    r = Repo(spark, str(tmp_path / "s"))
    import_collections(r, str(tmp_path / "in"))
    assert r.collection("c").ls() == ["x"] and (r.collection("c") / "x").df().first().value == 1.5
    (d / "y.csv").write_text("other\n1\n")
    with pytest.raises(ValueError):
        import_collections(r, str(tmp_path / "in"))


def test_cli(spark, tmp_path):
    uri = str(tmp_path / "s")

    def cli(*argv, text=None):
        out = io.StringIO()
        run(spark, ["--repo", uri, *argv], out, text)
        return out.getvalue().split("\n")[:-1]

    cli("create", "timestamp timestamp*", "value float", "--collection", "temperature")
    cli("write", "temp/Brussels", text="timestamp,value\n2020-01-01,1\n2020-01-02,2\n2020-02-01,5\n")
    assert cli("ls") == ["temperature"] and cli("ls", "temp") == ["Brussels"]
    assert cli("read", "temp/Bru", "(floor self.timestamp 'M')", "(max self.value)")[1:] == ["2020-01-01T00:00:00,2.0", "2020-02-01T00:00:00,5.0"]
    assert cli("read", "temp/Bru", "value", "--mask", "(> self.value 1)", "--limit", "1") == ["value", "2.0"]
    assert cli("read", "temp/Bru", "value", "--less-than", "2020-02-01", "--tail", "1") == ["value", "2.0"]
    assert cli("length", "temp/Bru") == ["3"] and len(cli("rev", "temp", "--extend")) == 1
    assert cli("gc") == ["0 0"] and cli("defrag") == ["temperature 0"]
    cli("rename", "temperature/Brussels", "temperature/Paris")
    assert cli("ls", "temperature") == ["Paris"]
    run(spark, ["--repo", str(tmp_path / "t"), "pull", uri])
    cli("delete", "temperature/Paris")
    assert cli("ls", "temperature") == []
    with pytest.raises(SystemExit):
        cli("read", "nope/x")


def test_command_line_pages_and_tails(spark, tmp_path):
    uri = str(tmp_path / "s")
    repo = Repo(spark, uri)
    s = repo.create_collection(Schema(k="int*", v="int", note="str"), "c") / "x"
    s.write({"k": list(range(7)), "v": [5, 1, 4, 2, 8, 3, 9], "note": list("abcdefg")})

    def cli(*argv):
        out = io.StringIO()
        run(spark, ["--repo", uri, *argv], out)
        return out.getvalue().splitlines()

    assert cli("read", "c/x", "(sum self.v)", "--paginate", "3")[1:] == ["10", "13", "9"]
    assert cli("read", "c/x", "(sum self.v)", "--tail", "2")[1:] == ["12"]
    assert cli("read", "c/x", "k", "--paginate", "4") == ["k", *map(str, range(7))]
    assert cli("read", "c/x", "k", "note", "--paginate", "2", "--offset", "3", "--limit", "2") == ["k,note", "3,d", "4,e"]
    assert cli("--pretty", "read", "c/x", "v", "note", "--limit", "1") == ["v  note", "5  a"]
    assert len(cli("rev", "c", "--extend", "--extend")) == 2 and any("paginate" in x or "read" in x for x in cli("help"))


def test_export_replaces_an_export(spark, repo, tmp_path):
    folder = str(tmp_path / "out")
    for _ in range(2):
        export_collections(repo, folder, kind="parquet")
    target = Repo(spark, str(tmp_path / "target"))
    import_collections(target, folder)
    for c in repo:
        assert target.collection(c.label).df().count() == c.df().count()


def test_csv_text(spark, repo):
    notes = repo.create_collection(Schema(k="int*", note="str"), "notes")
    write_csv_text(repo, "notes", "n", 'k,note\n1,"two\nlines, one ""field"""\n\n2,\n')
    assert [(r.k, r.note) for r in (notes / "n").df().orderBy("k").collect()] == [(1, 'two\nlines, one "field"'), (2, None)]
    with pytest.raises(ValueError):
        write_csv_text(repo, "notes", "n", "k,note\n1\n")
    write_csv_text(repo, "wea/ther", "z", "timestamp,value\n2020-01-01T00:00,nan\n")
    assert (repo.collection("wea/ther") / "z").df().count() == 1


def test_stream_once(spark, repo, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("s", 1, 1.0)], "label string, timestamp long, value double").write.parquet(source)
    c = repo.create_collection(Schema(timestamp="int*", value="float"), "live")

    def go(checkpoint):
        stream = spark.readStream.schema("label string, timestamp long, value double").parquet(source)
        write_stream(stream, c, str(tmp_path / checkpoint), "q").awaitTermination()
        c.refresh()

    go("ck")
    assert c.df().count() == 1 and len(c.changelog.log()) == 1
    go("ck2")  # the same batch number again, as after a failure
    assert len(c.changelog.log()) == 1
    spark.createDataFrame([("s", 2, 2.0), ("t", 1, 3.0)], "label string, timestamp long, value double").write.mode("append").parquet(source)
    go("ck")
    assert c.ls() == ["s", "t"] and c.df().count() == 3


def test_contract():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())
    assert {f"p{n}_found" for n in range(1, 6)} <= set(queries)


def test_core_needs_no_texts():
    """Nothing outside of the folder llm imports it, but for the entry, which does without."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "tideline"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "tideline.llm" not in f.read_text() and "from .llm" not in f.read_text()


def test_workers_need_no_installation(tmp_path):
    """From another folder and without PYTHONPATH, as on a cluster, the package travels with the plan."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
from tideline.operators.grid import regular_grid
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
r = spark.sql("select 'c' collection, 'x' label, timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, 20 * id) timestamp, timestamp_ntz'2020-01-02 00:00:00' pubtime, 1.0D value from range(3)")
i = spark.sql("select 'c' collection, 10 period_s, 'm' unit, 0.0D low, 9.0D high")
print("rows", regular_grid(r, i).count(), regular_grid(r, i).where("missing").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 5 2" in done.stdout, done.stderr[-2000:]

import pytest
from pyspark.sql import functions as F

from codequarry.sources import files as S
from codequarry.sources import sinks


def write(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_scan_and_quarantine(spark, tmp_path):
    write(tmp_path, "a/A.java", "class A { } // é".encode())
    write(tmp_path, "a/b/B.java", b"class B { } \xff")
    write(tmp_path, "c.txt", b"no")
    good, bad = S.split_valid(S.read_raw(spark, str(tmp_path)))
    assert [r.content for r in good.collect()] == ["class A { } // é"]
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in bad.collect()] == [("B.java", 13)]
    assert S.scan_files(spark, str(tmp_path), "txt").first().content == "no"


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(f"p{i}", f"c{i}") for i in range(50)]
    df = lambda r: spark.createDataFrame(r, "path string, content string")
    first = S.corpus_fingerprint(df(rows)).first()
    assert first == S.corpus_fingerprint(df(rows[::-1]).repartition(7)).first()
    assert first != S.corpus_fingerprint(df(rows[:-1] + [("p49", "other")])).first()
    twice = S.corpus_fingerprint(df(rows + rows[:1])).first()
    assert twice.n_files == 51 and twice.digest != first.digest
    assert S.corpus_fingerprint(df([])).first().n_files == 0


def test_index_is_built_once_per_content(spark, tmp_path):
    built = []

    def build(files):
        built.append(1)
        return files.select("path", F.length("content").alias("n"))

    df = spark.createDataFrame([("p", "abc")], "path string, content string")
    root = str(tmp_path / "index")
    for expected, force in ((1, False), (1, False), (2, True)):
        assert S.load_or_create(spark, df, root, build, force).collect() == [("p", 3)]
        assert len(built) == expected
    S.load_or_create(spark, df.withColumn("content", F.lit("abcd")), root, build)
    assert len(built) == 3
    S.load_or_create(spark, df, root, build, version="2")
    assert len(built) == 4


def test_hidden_and_empty_files_are_found(spark, tmp_path):
    names = ["A.java", "_B.java", ".C.java", ".git/D.java", "_x/y/E.java", "Größe $1.java"]
    for n in names:
        write(tmp_path, n, b"" if n == "A.java" else b"class X { }")
    found = S.scan_files(spark, str(tmp_path)).collect()
    assert len(found) == len(names) and sum(r.content == "" for r in found) == 1
    assert S.list_files(spark, str(tmp_path / "_x" / "y")).count() == 1


def test_no_shared_folder_on_a_cluster(monkeypatch):
    from codequarry.sources import storage

    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())


def test_changed_files(spark):
    df = lambda r: spark.createDataFrame(r, "path string, content_md5 string")
    change = S.changed_files(df([("a", "1"), ("b", "1"), ("c", "1")]), df([("a", "1"), ("b", "2"), ("d", "1")]))
    assert sorted(tuple(r) for r in change.collect()) == [("b", "changed"), ("c", "removed"), ("d", "added")]


def test_diagram_files_keep_their_order(spark, tmp_path):
    lines = spark.range(1000).select(
        F.when(F.col("id") < 900, "big").otherwise("small").alias("g"), "id", F.concat(F.lit("line "), "id").alias("line")
    )
    out = tmp_path / "d"
    sinks.write_diagram(lines.repartition(5), str(out), "g", ["id"])
    text = "".join(p.read_text() for p in sorted((out / "g=big").glob("part-*")))
    assert text.splitlines() == [f"line {i}" for i in range(900)]

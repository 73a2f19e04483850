import pytest
from pyspark.sql import functions as F

from codequarry.sources import versions as V
from codequarry.streaming.index import follow_files


class Counting:
    """A build that counts the files it is given, where they are read."""

    def __init__(self, spark):
        self.seen = spark.sparkContext.accumulator(0)

    def __call__(self, files):
        seen = self.seen

        def look(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        lines = files.select("path", "content").mapInArrow(look, "path string, content string")
        return lines.select("path", F.explode(F.split("content", "\n")).alias("line"))

    def taken(self):
        n, self.seen.value = self.seen.value, 0
        return n


def files(spark, **contents):
    return spark.createDataFrame(list(contents.items()), "path string, content string")


def rows(df):
    return sorted((r.path, r.line) for r in df.collect())


def whole(contents):
    return sorted((p, line) for p, text in contents.items() for line in text.split("\n"))


def test_every_version_equals_a_full_build_and_only_changes_are_built(spark, tmp_path):
    root, build = str(tmp_path / "ix"), Counting(spark)
    steps = [
        ({f"f{i}": f"a{i}\nb" for i in range(20)}, 20),
        ({f"f{i}": f"a{i}\nb" for i in range(20)}, 0),
        ({f"f{i}": f"a{i}\nb" for i in range(18)} | {"f3": "new", "g": ""}, 2),
        ({f"f{i}": f"a{i}\nb" for i in range(20)} | {"g": ""}, 3),
        ({"g": ""}, 0),
        ({"g": "back", "f1": "a1\nb"}, 2),
    ]
    seen = {}
    for contents, built in steps:
        number = V.apply_changes(spark, root, files(spark, **contents), build)
        assert build.taken() == built
        assert rows(V.read(spark, root)) == whole(contents)
        seen[number] = contents
    assert sorted(seen) == [0, 1, 2, 3, 4]
    assert V.compact(spark, root) == 5
    seen[5] = seen[4]
    contents = {"g": "back", "h": "x"}
    assert V.apply_changes(spark, root, files(spark, **contents), build) == 6 and build.taken() == 1
    seen[6] = contents
    for number, contents in seen.items():  # versions stay readable
        assert rows(V.read(spark, root, number)) == whole(contents)
        assert {r.path for r in V.state(spark, root, number).collect()} == set(contents)
    assert {r.since for r in V.read(spark, root).filter("path = 'g'").collect()} == {4}


def test_a_job_that_died_before_its_commit_leaves_nothing(spark, tmp_path):
    root, build = str(tmp_path / "ix"), Counting(spark)
    V.create(spark, root, files(spark, a="1", b="2"), build)

    def dies(changed):
        build(changed).write.parquet(f"{root}/rows/version=1")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        V.apply_changes(spark, root, files(spark, a="3", b="2"), dies)
    assert rows(V.read(spark, root)) == [("a", "1"), ("b", "2")]
    assert V.apply_changes(spark, root, files(spark, a="4", b="2"), build) == 1
    assert rows(V.read(spark, root)) == [("a", "4"), ("b", "2")]
    with pytest.raises(ValueError):
        V.read(spark, root, 7)
    with pytest.raises(ValueError):
        V.read(spark, str(tmp_path / "none"))


def test_long_lists_of_changes_are_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BROADCAST_PATHS", 0)
    root, build = str(tmp_path / "ix"), Counting(spark)
    V.create(spark, root, files(spark, a="1", b="2", c="3"), build)
    V.apply_changes(spark, root, files(spark, a="1", b="5"), build)
    assert rows(V.read(spark, root)) == [("a", "1"), ("b", "5")]


def test_empty_tables(spark, tmp_path):
    root, build = str(tmp_path / "ix"), Counting(spark)
    none = spark.createDataFrame([], "path string, content string")
    assert V.apply_changes(spark, root, none, build) == 0 and rows(V.read(spark, root)) == []
    assert V.apply_changes(spark, root, files(spark, a="1"), build) == 1 and rows(V.read(spark, root)) == [("a", "1")]
    assert V.apply_changes(spark, root, none, build) == 2 and rows(V.read(spark, root)) == []


def test_a_stream_gives_the_same_rows_and_a_batch_again_changes_nothing(spark, tmp_path):
    root, build = str(tmp_path / "ix"), Counting(spark)
    arrived, state = tmp_path / "in", str(tmp_path / "state")
    batches = [[("a", "1"), ("b", "2"), ("c", "3")], [("b", "4"), ("a", "1"), ("d", "5")], [("c", None), ("x", None)]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, "path string, content string").write.parquet(f"{arrived}/{i}")
        follow_files(spark, f"{arrived}/*", root, build, state)
    assert build.taken() == 3 + 2
    assert rows(V.read(spark, root)) == [("a", "1"), ("b", "4"), ("d", "5")]
    again = spark.createDataFrame([("b", "2")], "path string, content string")
    assert V.apply_batch(spark, root, again, build, 1) == 1 and build.taken() == 0
    twice = spark.createDataFrame([("b", "old", 1), ("b", "new", 2)], "path string, content string, seq int")
    V.apply_batch(spark, root, twice, build, 9)
    assert rows(V.read(spark, root)) == [("a", "1"), ("b", "new"), ("d", "5")]
    assert [v.batch for v in V.versions(spark, root)] == [0, 1, 2, 9]

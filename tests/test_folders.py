"""Digests by folder against dictionaries, and what a comparison reads."""

import random

import pytest

from codequarry.sources import files as S
from codequarry.sources import folders as T


def table_of(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content_md5 string")


def compared(spark, tmp_path, name, old, new):
    roots = [str(tmp_path / name / side) for side in ("old", "new")]
    for files, root in zip((old, new), roots):
        T.store_tree(T.folder_tree(table_of(spark, files)), root)
    return roots, T.compare_trees(spark, *roots)


def corpus(n=120):
    draw = random.Random(3)
    return {"/".join(draw.choice("abcd") for _ in range(draw.randint(0, 4))) + f"/f{i}": f"m{i}" for i in range(n)}


def test_tree_adds_up(spark):
    files = corpus() | {"/": "x", "a//b": "y", "top": None, "é/ü": "z"}
    rows = T.folder_tree(table_of(spark, files).repartition(5)).collect()
    hashes = {r.path: int(r.digest) for r in rows if r.is_file}
    assert len(rows) == len({(r.level, r.path, r.is_file) for r in rows}) and set(hashes) == set(files)
    for r in rows:
        below = [p for p in files if p.split("/")[: r.level] == (r.path.split("/") if r.level else [])]
        assert r.n_files == len(below) and int(r.digest) == sum(hashes[p] for p in below)
        assert r.parent == (None if r.level == 0 else "/".join(r.path.split("/")[:-1]))
    assert T.folder_tree(table_of(spark, {}).union(table_of(spark, {None: "m"}))).count() == 0
    twice = T.folder_tree(table_of(spark, {"a/b": "m"}).union(table_of(spark, {"a/b": "m"}))).filter("level = 0").first()
    assert twice.n_files == 2


def test_comparison_equals_the_one_of_all_files(spark, tmp_path):
    old, draw = corpus(), random.Random(5)
    new = {p: m for p, m in old.items() if draw.random() > 0.05}
    new |= {p: "other" for p in list(new)[::17]} | {"new/deep/er/x": "1", "top": "2"}
    _, got = compared(spark, tmp_path, "some", old, new)
    files = got.filter("is_file").select("path", "change")
    want = S.changed_files(table_of(spark, old), table_of(spark, new))
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, want.collect()))
    kinds = {r.path: r.change for r in got.filter("NOT is_file").collect()}
    assert kinds["new/deep"] == "added" and kinds[""] == "changed"


@pytest.mark.parametrize("old, new, change", [({}, {"a/b": "1"}, "added"), ({"a/b": "1"}, {}, "removed"), ({}, {}, None), ({"a": "1"}, {"a": "1"}, None)])
def test_empty_and_equal_trees(spark, tmp_path, old, new, change):
    _, got = compared(spark, tmp_path, "edge", old, new)
    assert [(r.path, r.change) for r in got.orderBy("level").collect()] == ([] if change is None else [(p, change) for p in ("", "a", "a/b")])


def test_only_folders_on_the_way_are_read(spark, tmp_path):
    old = {f"r/{a}/{b}/f{i}": "m" for a in range(6) for b in range(6) for i in range(3)}
    new = old | {"r/2/3/f1": "other"}
    roots, got = compared(spark, tmp_path, "one", old, new)
    want = [(0, ""), (1, "r"), (2, "r/2"), (3, "r/2/3"), (4, "r/2/3/f1")]
    assert sorted((r.level, r.path) for r in got.collect()) == want
    parts = spark.createDataFrame([(None, 0), ("", 1), ("r", 2), ("r/2", 3), ("r/2/3", 4)], "parent string, level int")
    on_the_way = {(r.level, r.part) for r in parts.select("level", T._part("parent").alias("part")).collect()}
    spoiled = 0
    for root in roots:  # everything else is made unreadable
        for path in (tmp_path / "one" / root.rsplit("/", 1)[1] / "rows").glob("level=*/part=*/*.parquet"):
            at = tuple(int(f.split("=")[1]) for f in path.parts[-3:-1])
            if at not in on_the_way:
                path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
                path.write_bytes(b"spoiled")
                spoiled += 1
    assert spoiled > 20
    spark.catalog.clearCache()
    assert sorted((r.level, r.path) for r in T.compare_trees(spark, *roots).collect()) == want


def test_a_tree_that_was_not_finished_is_refused(spark, tmp_path):
    T.store_tree(T.folder_tree(table_of(spark, {"a": "1"})), str(tmp_path / "whole"))
    with pytest.raises(ValueError):
        T.compare_trees(spark, str(tmp_path / "whole"), str(tmp_path / "none"))

"""Versioned tables under crashes, array files, saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.operators import mlp
from sunloom.sources import arrays, versions


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, path)
    assert versions.replace_table(spark.range(3), path) == 1
    assert versions.replace_table(versions.read_table(spark, path).filter("id > 0"), path) == 2  # reads what it replaces
    assert ids(versions.read_table(spark, path)) == [1, 2] and ids(versions.read_table(spark, path, 1)) == [0, 1, 2]
    assert versions.replace_table(spark.range(9), path, keep=1) == 3
    assert ids(versions.read_table(spark, path)) == list(range(9)) and list(versions.versions(spark, path)) == [3]
    assert len(list((tmp_path / "t/data").iterdir())) == 1
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, path, 2)
    spark.range(1).write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="no versioned table"):
        versions.replace_table(spark.range(2), str(tmp_path / "plain"))


@pytest.mark.parametrize("step", ["_stage", "_enter", "_prune"])
@pytest.mark.parametrize("after", [False, True])
def test_a_writer_that_dies_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch, step, after):
    path, real = str(tmp_path / "t"), getattr(versions, step)
    versions.replace_table(spark.range(3), path)

    def dies(*a):
        if after:
            real(*a)
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(versions, step, dies)
        with pytest.raises(RuntimeError):
            versions.replace_table(spark.range(5), path)
    new = step == "_prune" or (step == "_enter" and after)
    assert ids(versions.read_table(spark, path)) == list(range(5 if new else 3))
    versions.replace_table(spark.range(7), path, keep=1)  # the next writer goes on, and clears up
    assert ids(versions.read_table(spark, path)) == list(range(7)) and len(list((tmp_path / "t/data").iterdir())) == 1


def test_half_an_entry_does_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace_table(spark.range(3), path)
    (tmp_path / "t/log/000000000002").write_text("000000000002-abc")  # its writer died before the line was whole
    assert ids(versions.read_table(spark, path)) == [0, 1, 2]
    assert versions.replace_table(spark.range(4), path) == 3 and ids(versions.read_table(spark, path)) == [0, 1, 2, 3]


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    path, stage = str(tmp_path / "t"), versions._stage
    versions.replace_table(spark.range(3), path)

    def meanwhile(df, folder):
        monkeypatch.setattr(versions, "_stage", stage)
        versions.replace_table(spark.range(4), path)  # another writer enters the number first
        stage(df, folder)

    monkeypatch.setattr(versions, "_stage", meanwhile)
    with pytest.raises(FileExistsError):
        versions.replace_table(spark.range(9), path)
    assert ids(versions.read_table(spark, path)) == [0, 1, 2, 3]


def test_models_are_kept_by_version(spark, tmp_path):
    path = str(tmp_path / "m")
    row = (3, [2, 2, 1], 1, [0.1 * i for i in range(9)], [], [0.5], [2.0], 4, 0.25)
    one, two = (spark.createDataFrame([r], mlp.WEIGHTS) for r in (row, (3, [2, 2, 1], 1, [0.2] * 9, [], [0.5], [2.0], 9, 0.125)))
    assert (mlp.save_models(one, path), mlp.save_models(two, path)) == (1, 2)
    assert mlp.load_models(spark, path).collect() == two.collect() and mlp.load_models(spark, path, 1).collect() == one.collect()
    rows = spark.createDataFrame([([0], [0.5], [1.0])], "at array<int>, phi array<double>, x array<double>")
    assert mlp.score(rows, one).collect() == mlp.score(rows, mlp.load_models(spark, path, 1)).collect()
    mlp.save_models(one.withColumn("weights", F.slice("weights", 1, 4)), path)
    with pytest.raises(ValueError):
        mlp.load_models(spark, path)


@pytest.fixture
def npy(spark):
    spark.dataSource.register(arrays.NpySource)
    return lambda path: spark.read.format("npy").load(str(path))


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["<f4", "<f8", ">f4", "<i2", "<i8"])
def test_arrays_are_read_by_ranges_of_rows(spark, npy, tmp_path, monkeypatch, order, kind):
    matrix = np.asarray(np.arange(350).reshape(50, 7) % 97, dtype=kind, order=order)
    np.save(tmp_path / "m.npy", matrix)
    df = npy(tmp_path / "m.npy")
    assert dict(df.dtypes) == {"row": "bigint", "x": f"array<{arrays.KINDS[kind[1:]]}>"}
    assert [r["x"] for r in df.orderBy("row").collect()] == matrix.tolist()
    parts = arrays.NpyReader(str(tmp_path / "m.npy"), df.schema)
    monkeypatch.setattr(arrays, "PART", 300)  # few rows a partition
    found = [b for p in parts.partitions() for b in parts.read(p)]
    assert len(found) > 2 and [v for b in found for v in b.column(1).to_pylist()] == matrix.tolist() and [v for b in found for v in b.column(0).to_pylist()] == list(range(50))


def test_other_arrays(spark, npy, tmp_path):
    np.save(tmp_path / "v.npy", np.array([1.5, 2.5], "<f4"))
    assert [tuple(r) for r in npy(tmp_path / "v.npy").orderBy("row").collect()] == [(0, 1.5), (1, 2.5)]
    for order in "CF":
        cube = np.asarray(np.arange(24).reshape(2, 3, 4), dtype="<f8", order=order)
        np.save(tmp_path / "c.npy", cube)
        assert [r["x"] for r in npy(tmp_path / "c.npy").orderBy("row").collect()] == cube.reshape(2, -1).tolist()
    np.save(tmp_path / "e.npy", np.zeros((0, 3)))
    assert npy(tmp_path / "e.npy").count() == 0
    np.save(tmp_path / "s.npy", np.array(["a"]))
    with pytest.raises(Exception, match="no rows of numbers"):
        npy(tmp_path / "s.npy").count()


def test_a_matrix_of_many_partitions_makes_the_round_trip(spark, npy, tmp_path, monkeypatch):
    folder = str(tmp_path / "a")
    rows = spark.range(0, 1000, 1, 8).select("id", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (F.col("id") * 5 + k).cast("float")).alias("x"))
    rows.select("x").write.format("npy").mode("append").save(folder)
    assert [r["x"] for r in npy(folder).orderBy("row").collect()] == np.arange(5000.0).reshape(1000, 5).tolist()
    rows.filter("id < 10").coalesce(1).select("x").write.format("npy").mode("append").save(folder)
    assert npy(folder).count() == 1010 and npy(folder).filter("row = 1009").first()["x"] == [45.0, 46.0, 47.0, 48.0, 49.0]
    files = list((tmp_path / "a").rglob("*.npy"))
    assert len(files) == 9 and all(np.load(f).dtype == np.float32 for f in files)
    rows.filter("id = 3").select("x").write.format("npy").mode("overwrite").save(folder)
    assert [r["x"] for r in npy(folder).collect()] == [[15.0, 16.0, 17.0, 18.0, 19.0]]


def test_a_write_that_fails_leaves_what_was_there(spark, npy, tmp_path):
    folder = str(tmp_path / "a")
    spark.createDataFrame([([1.0, 2.0],)], "x array<double>").write.format("npy").mode("append").save(folder)
    for bad in ([([1.0, 2.0],), ([1.0],)], [([1.0, None],)], [(None,)], [([1.0, 2.0, 3.0],)]):
        with pytest.raises(Exception, match="array"):
            spark.createDataFrame(bad, "x array<double>").write.format("npy").mode("append").save(folder)
        assert [r["x"] for r in npy(folder).collect()] == [[1.0, 2.0]]
    assert len(list((tmp_path / "a").rglob("*.npy"))) == 1

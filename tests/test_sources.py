import zipfile

import pytest
from pyspark.sql import functions as F

from tracemill.functions import hashing
from tracemill.operators import mixing, sampling
from tracemill.sources import readers, writers

SMALL = "id string, value double, run_signature string"


def test_id_lists(spark, tmp_path):
    p = tmp_path / "ids.txt"
    p.write_text(" a \n\nb\n")
    assert sorted(r.id for r in readers.id_list(spark, str(p)).collect()) == ["a", "b"]
    p.write_text("a\na\n")
    assert readers.id_list(spark, str(p), unique=False).count() == 1
    with pytest.raises(Exception, match="repeated id a"):
        readers.id_list(spark, str(p)).collect()


def test_predictions_and_checkpoints(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    p.write_text('{"id":"a","value":1,"run_signature":"x"}\n\n{"id":"b","value":2,"run_signature":"x"}\n{"id":"a","value":3,"run_signature":"x"}\n')
    assert {r.id: r.value for r in readers.predictions(spark, str(p), SMALL).collect()} == {"a": 3.0, "b": 2.0}
    p.write_text('{"id":"a","value":1,"run_signature":"x"}\n{"id":"a","va\n{"id":"c","value":2,"run_signature":"y"}\n')
    targets = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = readers.checkpoint(spark, str(p), targets, SMALL)
    assert [(r.id, r.value) for r in rows.collect()] == [("a", 1.0)]
    assert readers.resumable(rows, "run_signature", "x").count() == 1 and readers.resumable(rows, "run_signature", "z").count() == 0


def test_splits(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "id string, split string")
    writers.splits(df, path)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        writers.splits(df, path)
    assert readers.splits(spark, path, "id string, split string", ("train", "test")).count() == 2
    assert readers.one_split(spark, path, "test", "id string, split string").first().id == "b"
    with pytest.raises(ValueError):
        readers.splits(spark, path, "id string, split string", ("train",))


def test_archives_documents_and_samples(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m/metrics.json", '{"a": 1}')
        z.writestr("skip.txt", "x")
    got = readers.zip_members(spark, str(tmp_path / "z.zip")).collect()
    assert [(r.member, r.content) for r in got] == [("m/metrics.json", '{"a": 1}')]
    (tmp_path / "d.json").write_text('{\n "a": 1\n}\n')
    assert readers.document(spark, str(tmp_path / "d.json")).first().a == 1
    s = spark.range(1).select(readers.device_sample(F.lit("10, 20,x,5,7.5"), F.lit("t")).alias("s")).first().s
    assert (s.memory_used_mib, s.memory_free_mib, s.power_draw_watts) == (10.0, None, 7.5)
    files = spark.createDataFrame([(f"f{i}.{'json' if i % 3 else 'txt'}", bytearray(f"text {i} é".encode() * (i + 1))) for i in range(40)], "name string, content binary")
    made = writers.bundles(files, f"file://{tmp_path}/bundles", ["f0.txt"], shards=3).collect()
    assert sum(r.n_files for r in made) == 40 and len(list((tmp_path / "bundles").iterdir())) == 3
    read = readers.zip_members(spark, f"{tmp_path}/bundles", wide=5).collect()
    assert sorted((r.member, r.content) for r in read) == sorted((f"f{i}.json", f"text {i} é" * (i + 1)) for i in range(40) if i % 3)
    assert sorted(z for p in (tmp_path / "bundles").iterdir() for z in zipfile.ZipFile(p).namelist()) == sorted(r.name for r in files.collect())
    with pytest.raises(FileNotFoundError, match="not in the bundle"):
        writers.bundles(files, f"file://{tmp_path}/more", ["b.txt"])
    broken = bytearray((tmp_path / "z.zip").read_bytes())
    broken[broken.index(b'{"a": 1}')] ^= 1
    (tmp_path / "broken.zip").write_bytes(bytes(broken))
    with pytest.raises(Exception, match="another checksum"):
        readers.zip_members(spark, str(tmp_path / "broken.zip")).collect()


def test_sparse_and_canonical(spark):
    df = spark.range(1).select(F.struct(F.lit("é").alias("b"), F.lit(None).cast("int").alias("a")).alias("s"))
    assert df.select(readers.sparse_json(F.col("s"))).first()[0] == '{"b":"é"}'
    assert df.select(hashing.canonical_json(F.col("s"), df.schema["s"].dataType)).first()[0] == '{"a":null,"b":"é"}'
    assert df.select(hashing.is_revision(F.lit("a" * 40)), hashing.is_revision(F.lit("A" * 40))).first()[:] == (True, False)


def test_lookup_misses_and_strict_zip(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no row for 2"):
        mixing.lookup(a, b, "k").collect()
    with pytest.raises(Exception, match="different lengths"):
        spark.range(1).select(mixing.zip_strict(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))).collect()


def test_quota_edges(spark):
    sizes = spark.createDataFrame([("a", 0), ("b", 0)], "name string, size long")
    assert {r.quota for r in sampling.quotas(sizes, "name", "size", 0).collect()} == {0}
    with pytest.raises(Exception, match="target outside"):
        sampling.quotas(spark.createDataFrame([("a", 2)], "name string, size long"), "name", "size", 3).collect()
    even = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "name string, size long")
    assert {r.name: r.quota for r in sampling.quotas(even, "name", "size", 4).collect()} == {"a": 1, "b": 1, "c": 2}


def test_document_is_replaced_whole(spark, tmp_path):
    path = tmp_path / "r.json"
    for n in (1, 2):
        writers.document(spark.range(1).select(F.lit(n).alias("n")), str(path))
        assert path.is_file() and readers.document(spark, str(path)).first().n == n
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["r.json"]

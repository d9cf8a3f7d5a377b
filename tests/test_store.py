import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.sources.store import Collection, Conflict, DuplicateKey
from quarrylens.sources.views import raw_documents

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("n", T.LongType()), T.StructField("parent", T.StringType())])


def stored(spark, root, **more):
    return Collection(spark, str(root), "things", SCHEMA, unique=[("name",)], **more)


def rows(spark, *given):
    return spark.createDataFrame([(*r, None) if len(r) == 3 else r for r in given], SCHEMA)


def held(store):
    return sorted(tuple(r)[:3] for r in store.read().collect())


def test_saves_deletes_and_versions(spark, tmp_path):
    store = stored(spark, tmp_path)
    assert store.read().count() == 0 and not store.holds("a")
    store.save(rows(spark, ("a", "A", 1), ("b", "B", 2), ("c", None, 3), ("d", None, 4)))
    store.save(rows(spark, ("b", "B2", 5), ("e", "B", 6)))  # B is free again
    assert held(store) == [("a", "A", 1), ("b", "B2", 5), ("c", None, 3), ("d", None, 4), ("e", "B", 6)]
    assert store.delete("a") and not store.delete("a") and not store.holds("a") and store.holds("e") and not store.delete(None)
    store.save(rows(spark, ("f", "A", 7)))  # so is A
    with pytest.raises(DuplicateKey):
        store.save(rows(spark, ("g", "B2", 1)))
    with pytest.raises(DuplicateKey):
        store.save(rows(spark, ("g", "new", 1), ("h", "new", 1)))
    assert held(store) == [("b", "B2", 5), ("c", None, 3), ("d", None, 4), ("e", "B", 6), ("f", "A", 7)]
    assert sorted(r["id"] for r in store.read(version=1).collect()) == ["a", "b", "c", "d"]
    store.save(rows(spark, ("b", "B", 1), ("e", "B2", 1)))  # two ids swap their keys in one save
    assert {("b", "B", 1), ("e", "B2", 1)} <= set(held(store))


def test_two_rows_of_one_id_in_a_save(spark, tmp_path):
    store = stored(spark, tmp_path)
    store.save(rows(spark, ("a", "A", 1), ("a", "A", 3), ("a", "B", 2), ("b", "A2", None), ("b", "A3", None)), latest=["n"])
    assert [r for r in held(store) if r[0] == "a"] == [("a", "A", 3)] and len(held(store)) == 2
    again = stored(spark, tmp_path / "again")
    again.save(rows(spark, ("b", "A3", None), ("a", "B", 2), ("b", "A2", None), ("a", "A", 3), ("a", "A", 1)), latest=["n"])
    assert held(again) == held(store)  # whatever the order rows come in


def test_stale_writer_and_racing_writer(spark, tmp_path):
    one, two = stored(spark, tmp_path), stored(spark, tmp_path)
    one.save(rows(spark, ("a", "A", 1)))
    seen = two.manifest()
    one.save(rows(spark, ("b", "B", 1)))
    for _ in range(2):  # again and again, long after the other has finished
        with pytest.raises(Conflict):
            two.save(rows(spark, ("c", "C", 1)), seen=seen)
    two.save(rows(spark, ("c", "C", 1)))
    assert [r[0] for r in held(one)] == ["a", "b", "c"]
    with pytest.raises(Conflict):
        one._commit(seen, [])
    assert not [s for s in (tmp_path / "things" / "log").iterdir() if s.name.startswith("_")]


@pytest.mark.parametrize("scheme", ["file:", "file://"])
def test_roots_with_a_scheme(spark, tmp_path, scheme):
    store = stored(spark, f"{scheme}{tmp_path}")
    store.save(rows(spark, ("a", "A", 1)))
    store.save(rows(spark, ("a", "A", 2)))
    assert held(store) == [("a", "A", 2)] and store.versions() == [1, 2] and (tmp_path / "things" / "log").is_dir()


def test_writer_that_dies(spark, tmp_path, monkeypatch):
    store = stored(spark, tmp_path)
    store.save(rows(spark, ("a", "A", 1)))

    class Killed(BaseException):
        pass

    def dies(*_):
        raise Killed

    for step in ("_check", "_commit"):  # with rows and index written; nothing is tidied up
        with monkeypatch.context() as m:
            m.setattr(store, step, dies)
            with pytest.raises(Killed):
                store.save(rows(spark, ("b", "B", 1)))
    bad = F.udf(lambda n: 1 // 0, "bigint")
    with pytest.raises(Exception, match="division|ZeroDivision"):
        store.save(rows(spark, ("z", "Z", 1)).withColumn("n", bad("n")))
    assert held(store) == [("a", "A", 1)]
    store.save(rows(spark, ("b", "B", 2)))
    store.save(rows(spark, ("c", "C", 3)))
    assert held(store) == [("a", "A", 1), ("b", "B", 2), ("c", "C", 3)]
    assert store.vacuum() >= 2 and held(store) == [("a", "A", 1), ("b", "B", 2), ("c", "C", 3)]


def test_compaction(spark, tmp_path):
    store = stored(spark, tmp_path, most_parts=3)
    for n in range(8):
        store.save(rows(spark, (f"k{n % 5}", f"N{n}", n), (f"own{n}", None, n)))
    assert len(store.manifest()["parts"]) <= 4
    want = sorted([(f"k{n % 5}", f"N{n}", n) for n in range(3, 8)] + [(f"own{n}", None, n) for n in range(8)], key=str)
    assert sorted(held(store), key=str) == want
    store.delete("own0")
    store.compact()
    assert len(store.manifest()["parts"]) == 1 and sorted(held(store), key=str) == [r for r in want if r[0] != "own0"]
    with pytest.raises(DuplicateKey):
        store.save(rows(spark, ("x", "N7", 1)))
    store.vacuum()
    assert len([p for p in (tmp_path / "things").iterdir() if p.name.startswith("part-")]) == 1


def test_batches_count_once(spark, tmp_path):
    store = stored(spark, tmp_path)
    store.save(rows(spark, ("a", "A", 1)), batch=("s", 0))
    store.save(rows(spark, ("a", "A", 2)), batch=("s", 1))
    before = store.versions()
    store.save(rows(spark, ("a", "A", 1)), batch=("s", 0))  # run again
    assert store.versions() == before and held(store) == [("a", "A", 2)]
    store.save(rows(spark, ("a", "A", 3)), batch=("other", 0))
    store.compact()
    assert held(store) == [("a", "A", 3)] and store.manifest()["batches"] == {"s": 1, "other": 0}


def test_replace_children(spark, tmp_path):
    store = stored(spark, tmp_path)
    store.replace_children(rows(spark, ("1", "x1", 0, "p"), ("2", "x2", 0, "p"), ("3", "y1", 0, "q")), "parent")
    for _ in range(2):
        store.replace_children(rows(spark, ("4", "x2", 1, "p")), "parent")
        assert held(store) == [("3", "y1", 0), ("4", "x2", 1)]


def test_saving_one_row_reads_and_writes_few_files(spark, tmp_path):
    """One row into all documents of sf0.1: under 5 % of the files, and no rows but its own."""
    docs = raw_documents(spark, "/root/testdata/sf0.1").withColumns({"source_id": F.concat_ws("/", "source_id", "id"), "raw_content": F.lit(None).cast("binary")})
    store = Collection(spark, str(tmp_path), "raw_documents", keys_in_file=500)
    docs = docs.select(*[(F.col(f.name) if f.name in docs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in store.schema.fields])
    store.save(docs.repartition(20))
    files = lambda: {p for p in tmp_path.rglob("*.parquet")}
    before = files()
    one = docs.orderBy("id").limit(1).withColumn("metadata", F.lit("again"))
    _, read = store._known(store.manifest(), store._keys(one))
    assert 1 <= len(read) <= 0.05 * len(before), (len(read), len(before))
    store.save(one)
    assert len(files() - before) <= 0.05 * len(before)
    assert store.read().count() == docs.count() and store.read().filter("metadata = 'again'").count() == 1

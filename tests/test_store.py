import pytest
from pyspark.sql import functions as F

from bitempo.model import conform, empty
from bitempo.sources.store import Store, StoreError


def _rows(spark, *ids):
    return conform(empty(spark, "sources").unionByName(spark.createDataFrame([(i,) for i in ids], "id string").select("id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in empty(spark, "sources").schema if f.name != "id"))), "sources")


def test_an_append_adds_a_folder(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert store.write({"sources": _rows(spark, "a")}) == 1
    first = store.manifest()["tables"]["sources"]
    assert store.append("sources", _rows(spark, "b")) == 2
    assert store.manifest()["tables"]["sources"][:1] == first and sorted(r.id for r in store.read("sources").collect()) == ["a", "b"]
    assert store.write({"sources": _rows(spark, "c")}) == 3 and store.vacuum() == 2 and store.version == 3


def test_two_writers_lose_no_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.write({"sources": _rows(spark, "a")})
    store._put(f"{store.path}/_claim-2", "")  # another writer has begun
    with pytest.raises(StoreError):
        store.append("sources", _rows(spark, "b"))
    assert store.version == 1 and [r.id for r in store.read("sources").collect()] == ["a"]
    store.vacuum()
    assert store.append("sources", _rows(spark, "b")) == 2

import time

import pytest

from lintmill.schemas import TABLES
from lintmill.sources import runs, sinks, tables

NAME = "review_issues"


def issue(review, path, rule):
    return (review, path, 1, None, "bug", "low", 0.5, rule, "t", "e", "s", None)


@pytest.fixture
def store(spark, tmp_path):
    class Store:
        folder = str(tmp_path)

        def rows(self, *issues):
            return spark.createDataFrame([issue(*i) for i in issues], TABLES[NAME])

        def ids(self, *reviews, column="review_id"):
            return spark.createDataFrame([(r,) for r in reviews], f"{column} string")

        def write(self, *issues, finished=None):
            named = self.ids(*(finished or {i[0] for i in issues}))
            sinks.write_children(self.rows(*issues), self.folder, NAME, named)

        def seen(self, review=None):
            return sorted((r.review_id, r.file_path, r.rule_id) for r in tables.read_table(spark, self.folder, NAME, review).collect())

        def folders(self):
            return len(list(tmp_path.glob(f"{NAME}/review_bucket=*/run=*/*.parquet")))

        def compact(self):
            return runs.compact(spark, self.folder, NAME)

        def vacuum(self):
            return runs.vacuum(spark, self.folder, NAME, time.time_ns())

    return Store()


def old_layout(store, *issues):
    """As stored before there were runs."""
    rows = store.rows(*issues)
    rows = rows.withColumn("review_bucket", runs.review_bucket(rows["review_id"]))
    rows.write.mode("append").partitionBy("review_bucket").parquet(f"{store.folder}/{NAME}")


def test_children_from_before_there_were_runs(store):
    old_layout(store, ("r1", "a", "old"), ("r2", "b", "old"), ("r3", "c", "old"))
    assert store.seen() == [("r1", "a", "old"), ("r2", "b", "old"), ("r3", "c", "old")]
    assert store.seen("r2") == [("r2", "b", "old")]
    store.write(("r1", "a", "new"), finished=["r1", "r3"])
    expected = [("r1", "a", "new"), ("r2", "b", "old")]
    assert store.seen() == expected and store.seen("r3") == []
    assert store.compact() and store.seen() == expected
    # Everything seen is in runs now; the files of old are not.
    store.vacuum()
    assert store.seen() == expected


def test_nothing_stored_yet(spark, store):
    assert store.seen() == [] and store.compact() == 0 and store.vacuum() == 0


def test_compaction_keeps_what_is_seen(store):
    for n in range(4):
        store.write(*[(f"r{i}", f"f{n}", f"v{n}") for i in range(n, 12)])
    store.write(("gone", "f", "v"))
    store.write(finished=["gone"])
    expected, before = store.seen(), store.folders()
    assert len(expected) == 12 and "gone" not in {r[0] for r in expected}
    assert store.compact() > 0 and store.seen() == expected
    assert store.vacuum() > 0 and store.seen() == expected and store.folders() < before
    assert store.folders() == len({r.b for r in store.ids(*{r[0] for r in expected}).select(runs.review_bucket("review_id").alias("b")).collect()})


def test_compaction_leaves_clean_buckets_alone(store):
    store.write(*[(f"r{i}", "f", "v") for i in range(40)])
    assert store.compact() == 0
    store.write(("r7", "f", "w"))
    assert store.compact() == 1 and store.compact() == 1  # the superseded folder is there until it is removed
    store.vacuum()
    assert store.compact() == 0 and ("r7", "f", "w") in store.seen()


def test_compaction_that_stops_half_way(store, monkeypatch):
    store.write(("r1", "a", "v1"), ("r2", "a", "v1"))
    store.write(("r1", "a", "v2"))
    expected = store.seen()
    writer, writes = type(store.ids("x").write), []
    parquet = writer.parquet

    def stops(self, path, *args, **options):
        writes.append(path)
        if path.endswith("_runs"):
            raise RuntimeError("stopped")
        return parquet(self, path, *args, **options)

    with monkeypatch.context() as patch:  # between the rows and their names
        patch.setattr(writer, "parquet", stops)
        with pytest.raises(RuntimeError):
            store.compact()
    assert len(writes) == 2 and store.seen() == expected
    assert store.compact() and store.seen() == expected
    store.vacuum()
    assert store.seen() == expected


@pytest.mark.parametrize("named_first", [True, False])
def test_two_writers_and_a_compaction(store, named_first):
    """A run that was begun before the compaction and finished after it still counts."""
    store.write(("r1", "a", "v1"), ("r2", "a", "v1"))
    slow = runs.append_rows(store.rows(("r1", "a", "slow")), store.folder, NAME)
    store.write(("r2", "a", "fast"))
    if named_first:
        runs.name_run(store.ids("r1"), store.folder, NAME, slow)
    store.compact()
    if not named_first:
        assert store.seen() == [("r1", "a", "v1"), ("r2", "a", "fast")]
        runs.name_run(store.ids("r1"), store.folder, NAME, slow)
    assert store.seen() == [("r1", "a", "slow"), ("r2", "a", "fast")]
    store.compact()
    store.vacuum()
    assert store.seen() == [("r1", "a", "slow"), ("r2", "a", "fast")]


def test_delete_writes_ids_only(spark, store, tmp_path):
    store.write(*[(f"r{i}", f"f{j}", "v") for i in range(6) for j in range(50)])
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob(f"{NAME}/**/*.parquet")}
    runs.delete_reviews(store.ids("r1", "r4", column="id"), store.folder)
    assert {p: p.stat().st_mtime_ns for p in tmp_path.glob(f"{NAME}/**/*.parquet")} == before
    assert {r[0] for r in store.seen()} == {"r0", "r2", "r3", "r5"} and store.seen("r4") == []
    assert store.compact() == 2 and store.vacuum() == 2
    assert {r[0] for r in store.seen()} == {"r0", "r2", "r3", "r5"}
    reviews = spark.createDataFrame([("r1", "p"), ("r2", "p")], "id string, repository_id string")
    reviews.write.parquet(f"{store.folder}/reviews")
    assert [r.id for r in tables.read_table(spark, store.folder, "reviews").collect()] == ["r2"]


def test_a_run_after_the_delete_counts(store):
    store.write(("r1", "a", "v1"))
    runs.delete_reviews(store.ids("r1", column="id"), store.folder)
    assert store.seen() == []
    store.write(("r1", "a", "v2"))
    assert store.seen() == [("r1", "a", "v2")]


def test_ids(spark, store):
    """Equal rows differ in their ids, a repeated run does not; older rows get ids by compaction."""
    twice = [("r1", "a", "v")] * 3 + [("r1", "b", "v"), ("r2", "a", "v")]

    def ids():
        return sorted(r.id for r in tables.read_table(spark, store.folder, NAME).collect())

    store.write(*twice)
    first = ids()
    assert len(set(first)) == 5
    store.write(*twice[::-1])
    assert ids() == first and store.compact() and ids() == first
    from lintmill.operators.maintenance import audit_unique

    stored = {NAME: tables.read_table(spark, store.folder, NAME)}
    assert audit_unique(stored).count() == 0
    assert audit_unique({NAME: stored[NAME].unionByName(stored[NAME].where("file_path = 'b'"))}).count() == 1


def test_ids_of_rows_from_before_they_had_any(spark, store):
    rows = store.rows(("r1", "a", "old"), ("r1", "a", "old")).drop("id")
    rows.withColumn("review_bucket", runs.review_bucket(rows["review_id"])).write.partitionBy("review_bucket").parquet(f"{store.folder}/{NAME}")
    assert {r.id for r in tables.read_table(spark, store.folder, NAME).collect()} == {None}
    assert store.compact() == 1
    found = [r.id for r in tables.read_table(spark, store.folder, NAME).collect()]
    assert len(found) == len(set(found)) == 2 and None not in found

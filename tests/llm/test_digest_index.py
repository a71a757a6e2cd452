"""The index across sessions and numbers of buckets, and with batches without rows."""

import pytest

from strandlake.llm import exact_dedup

SCHEMA = "doc_id bigint, text string"


def batch(spark, ids):
    return spark.createDataFrame([(i, f"text {i % 400}") for i in ids], SCHEMA)


def kept(rows):
    return sorted(r.doc_id for r in rows.filter("kept").collect())


@pytest.mark.parametrize("first, later", [(8, 4), (4, 8), (3, 7)])
def test_reopened_in_another_session(spark, tmp_path, first, later):
    """Texts that the index holds stay out, with whatever number of shuffle partitions it is opened again."""
    path = f"file://{tmp_path}/index"
    one, two = spark.newSession(), spark.newSession()
    one.conf.set("spark.sql.shuffle.partitions", first)
    two.conf.set("spark.sql.shuffle.partitions", later)
    index = exact_dedup.DigestIndex(one, path)
    assert kept(exact_dedup.deduplicated(batch(one, range(400)), index)) == list(range(400))
    # the catalog is one process's; another process knows the folder alone
    one.sql(f"DROP TABLE {index.name}")
    again = exact_dedup.DigestIndex(two, path + "/")
    assert again.buckets == first
    assert kept(exact_dedup.deduplicated(batch(two, range(400, 800)), again)) == []
    assert kept(exact_dedup.deduplicated(two.createDataFrame([(900, "new"), (901, "new")], SCHEMA), again)) == [901]
    assert again.rows().count() == 401
    # the first session meets what the second has added
    back = exact_dedup.DigestIndex(one, path)
    assert kept(exact_dedup.deduplicated(one.createDataFrame([(950, "new"), (951, "newer")], SCHEMA), back)) == [951]
    with pytest.raises(ValueError, match=f"has {first} buckets, not {later}"):
        exact_dedup.DigestIndex(two, path, later)
    assert exact_dedup.DigestIndex(two, path, first).buckets == first
    back.drop()
    assert not (tmp_path / "index").exists()


def test_folder_without_a_number(spark, tmp_path):
    batch(spark, range(3)).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError, match="no number of buckets"):
        exact_dedup.DigestIndex(spark, f"file://{tmp_path}/other")


def test_empty_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index")
    for ids in ([], [1, 2], []):
        assert kept(exact_dedup.deduplicated(batch(spark, ids), index)) == ids
    assert index.rows().count() == 2
    index.drop()

import pytest

import __spark_entry__ as entry
from contract import QUERIES, base

SMALL = "/root/testdata/sf0.001"


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["source", "split", "samples", "hours", "avg_chars"]
    assert frame.count() > 0


def test_every_reference_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_rows(spark, name):
    frame = QUERIES[name](spark, SMALL)
    assert frame.columns and len(frame.take(1)) == 1


def test_heavy_tables_are_dealt_out_by_their_bytes(spark, tmp_path, monkeypatch):
    """Several files, a bound on a task's share: the number of parts follows the bytes, all rows stay."""
    folder = tmp_path / "documents.parquet"
    spark.range(20_000).withColumnRenamed("id", "doc_id").repartition(3).write.parquet(str(folder))
    size = sum(f.stat().st_size for f in folder.glob("part-*"))
    monkeypatch.setattr(base, "PART_BYTES", size // 100, raising=False)
    rows = base.table(spark, str(tmp_path), "documents")
    assert rows.rdd.getNumPartitions() >= 100
    assert rows.count() == rows.distinct().count() == 20_000


def test_sound_files_are_built_by_many_tasks(spark):
    """A supplier's sound file is much work beside its row of a few bytes."""
    from contract.operator_queries import wav_files

    assert wav_files(spark, SMALL).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism

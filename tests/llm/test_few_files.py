"""What the operators cost an executor beside their work: files and processes of checkpoints, and Arrow batches."""

from __future__ import annotations

import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonora.llm import language, mixing, neardup, packing
from sonora.llm.common import ROWS_A_FILE, n_words, read, settled
from sonora.runtime import BATCH, BATCH_BYTES, checkpoint_folder, ship_package

PARTITIONS = 64


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def part_files(spark) -> set[str]:
    return {str(p) for p in Path(checkpoint_folder(spark).removeprefix("file:")).rglob("part-*")}


def test_settled_keeps_rows_and_deals_them_to_few_files(many_partitions):
    rows = many_partitions.range(3 * ROWS_A_FILE).withColumn("x", F.col("id") % 7)
    out = settled(rows, 3 * ROWS_A_FILE)
    assert out.rdd.getNumPartitions() == 4
    assert out.agg(F.count("*"), F.countDistinct("id"), F.sum("x")).first() == rows.agg(F.count("*"), F.countDistinct("id"), F.sum("x")).first()
    assert settled(rows.limit(0), 0).count() == 0


@pytest.mark.parametrize("job, files_at_most", [
    (lambda docs: neardup.near_duplicates(docs), 6 * PARTITIONS),
    (lambda docs: packing.pack_documents(docs), 4 * PARTITIONS),
    (lambda docs: mixing.mix_documents(docs, F.array("source"), n_words(F.col("text"))), 5 * PARTITIONS),
])
def test_small_tables_make_few_checkpoint_files(many_partitions, sf_dir, job, files_at_most):
    docs = read(many_partitions, sf_dir, "documents")
    before = part_files(many_partitions)
    assert job(docs).count()
    assert len(part_files(many_partitions) - before) <= files_at_most


def test_texts_go_to_python_in_small_batches(spark):
    ship_package(spark)
    assert int(spark.conf.get(BATCH).removesuffix("b")) == BATCH_BYTES

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    docs = spark.range(3000).coalesce(1).select("id", F.repeat(F.lit("long text "), 1000).alias("text"))
    found = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in found) == 3000
    assert max(r["bytes"] for r in found) < 2 * BATCH_BYTES


def test_a_bound_that_the_session_names_stays(spark):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(1 << 20))
    ship_package(spark)
    held = spark.conf.get(BATCH)
    spark.conf.set(BATCH, before)
    assert int(held.removesuffix("b")) == 1 << 20


def test_the_driver_holds_a_sample_once(spark):
    rows = spark.range(1600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"))
    docs = rows.withColumn("text", F.concat_ws(" ", F.when(F.col("lang") == "en", "the house by the river").otherwise("la maison au bord de l'eau"), F.hex(F.sha2(F.col("doc_id").cast("string"), 512).cast("binary"))))
    tracemalloc.start()
    try:
        model = language.fit(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.languages == {"germanic": ["en"], "romance": ["fr"]}
    assert peak < 1.75 * 1600 * (language.DIMS + 1) * 4  # packed in half precision, and once in single


def test_all_numbered_operators_are_registered():
    import __spark_entry__

    names = {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()}
    assert names == {f"op{n}" for n in range(1, 14)}

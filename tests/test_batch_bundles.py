from pyspark.sql import functions as F

from beaconry.plans import io_plans
from beaconry.plans.common import read
from beaconry.session import scratch_path
from beaconry.sources import files

SMOKE = "/root/testdata/sf0.001"


def test_batches_of_a_chunk_share_a_file(spark):
    path = scratch_path(spark, "bundles")
    content, pointers = io_plans.published(spark, SMOKE, path)
    chunks = read(spark, SMOKE, "documents").select(F.expr(f"doc_id div {io_plans.CHUNK}")).distinct().count()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{path}/files")
    assert found.count() == chunks < content.count()
    rows, refused = files.read_batch(content, pointers)
    assert rows.select("batch_id").distinct().count() + refused.count() == pointers.count()


def test_a_line_keeps_its_bytes(spark):
    path = scratch_path(spark, "lines")
    values = {"a-x0": '{"t": "Ä\\tb "}', "b-x0": '{"t": "\tz\r"}', "c-x1": "{}"}
    lines = [(f"{k}\t{v}", k[-1]) for k, v in values.items()]
    spark.createDataFrame(lines, "value string, bundle string").repartition("bundle").write.partitionBy("bundle").text(path)
    got = {r.path: (bytes(r.content), r.length, r.bundle) for r in files.batch_files(spark, path).collect()}
    assert got == {f"/{k}.json": ((v + "\n").encode(), len(v.encode()) + 1, k[-1]) for k, v in values.items()}

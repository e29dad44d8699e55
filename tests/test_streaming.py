from palimpsest.operators.curate import WIDE_TABLE_RULE
from palimpsest.streaming import curated_stream


def test_row_wise_operators_accept_a_stream(spark, tmp_path):
    rows = [(i, ("o" * 400) + str(i), "r" * 250 if i % 2 else "short", "prompt") for i in range(10)]
    table = spark.createDataFrame(rows, "id long, original_text string, rewritten_text string, rewrite_prompt string")
    table.write.parquet(f"{tmp_path}/in")
    seen = table.filter("id = 3").select("original_text")
    stream = curated_stream(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), seen, rule=WIDE_TABLE_RULE, keep=("id",))
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 5, 7, 9]

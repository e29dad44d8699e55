import json

from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.sources import readers, writers


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_csv_with_quotes_and_newlines(spark, tmp_path):
    one = put(tmp_path / "a.csv", 'original_text,rewrite_prompt,rewritten_text,subject\n"a ""b""\nc",p,r,s\n')
    two = put(tmp_path / "b.csv", "rewritten_text,original_text\nr2,o2\n")
    rows = readers.read_csv_files(spark, [two, one], schemas.REWRITE_SUBJECT).collect()
    got = {(r["original_text"], r["rewrite_prompt"], r["subject"]) for r in rows}
    assert got == {('a "b"\nc', "p", "s"), ("o2", None, None)}


def test_headers_of_many_files_take_one_job(spark, tmp_path):
    for i in range(300):
        header, row = ("original_text,subject", f'"t{i}, ""q"" \n",s{i}') if i % 2 else ("subject,note,original_text", f"s{i},x,t{i}")
        put(tmp_path / "many" / f"{i:04d}.csv", f"{header}\n{row}\n")
    put(tmp_path / "many" / "quoted.csv", '"a ""b""\nc",original_text\n1,last\n')
    put(tmp_path / "many" / "empty.csv", "")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        headers = readers._headers(spark, f"{tmp_path}/many/*.csv").collect()
        assert len(tracker.getJobIdsForGroup("headers")) <= 2  # Spark lists many paths in a job of its own
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(headers) == 301 and ['a "b"\nc', "original_text"] in [r["names"] for r in headers]
    rows = readers.read_csv_folder(spark, f"{tmp_path}/many/*.csv", schemas.REWRITE_SUBJECT).collect()
    got = {r["original_text"]: (r["subject"], r["rewrite_prompt"], r["source_file"].rsplit("/", 1)[1]) for r in rows}
    assert len(rows) == 301 and got["last"] == (None, None, "quoted.csv")
    assert got['t7, "q" \n'] == ("s7", None, "0007.csv") and got["t8"] == ("s8", None, "0008.csv")


def test_json_readers_take_whole_files(spark, tmp_path):
    put(tmp_path / "list.json", ["a", "b"])
    assert [r[0] for r in readers.read_prompt_list(spark, f"{tmp_path}/list.json").collect()] == ["a", "b"]
    put(tmp_path / "free" / "1.json", [{"prompt": "p1", "subject": "s1"}, {"prompt": "p2", "subject": "s2"}])
    put(tmp_path / "free" / readers.METADATA_FILE, [{"prompt": "no", "subject": "no"}])
    assert {r["prompt"] for r in readers.read_prompt_objects(spark, f"{tmp_path}/free/*.json").collect()} == {"p1", "p2"}
    put(tmp_path / "nested" / "1.json", {"prompts": [{"prompt": "p", "subject": "s"}]})
    assert [tuple(r) for r in readers.read_nested_prompts(spark, f"{tmp_path}/nested/*.json").collect()] == [("p", "s")]
    put(tmp_path / "exp.json", [[{"original_prompt": "o", "rewritten_prompts": ["x", "y"]}], [{"original_prompt": "q", "rewritten_prompts": []}]])
    rows = readers.read_expansions(spark, f"{tmp_path}/exp.json").orderBy("entry").collect()
    assert [(r["prompt"], r["variants"]) for r in rows] == [("o", ["x", "y"]), ("q", [])]


def test_traces_with_and_without_steps(spark, tmp_path):
    put(tmp_path / "t" / "old.json", [{"score": 0.5, "text": "a"}])
    put(tmp_path / "t" / "new.json", [{"step": 0, "score": 0.6, "text": "b"}])
    rows = readers.read_trace_texts(spark, f"{tmp_path}/t/*.json").collect()
    assert {(r["file_name"], r["step"], r["text"]) for r in rows} == {("old.json", None, "a"), ("new.json", 0, "b")}


def test_lines(spark, tmp_path):
    path = put(tmp_path / "w.txt", " a \nb\n")
    assert [r[0] for r in readers.read_lines(spark, path).collect()] == ["a", "b"]
    assert [r[0] for r in readers.read_lines(spark, path, "word", stripped=False).collect()] == [" a ", "b"]


def test_vectors_prune_by_dataset(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0])], "id long, dataset string, embedding array<double>")
    writers.write_vectors(rows, f"{tmp_path}/v")
    assert [r["id"] for r in readers.read_vectors(spark, f"{tmp_path}/v", ["b"]).collect()] == [2]


def test_written_split_and_run_folders(spark, tmp_path):
    rows = spark.range(4).withColumn("split", F.when(F.col("id") < 1, "validation").otherwise("train"))
    writers.write_split(rows, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s/split=train").count() == 3
    assert writers.write_csv(rows, f"{tmp_path}/c", "run-1").endswith("/run-1")


def test_small_scans_are_spread(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/p")
    spread = readers.spread_small(spark.read.parquet(f"{tmp_path}/p"))
    assert spread.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread.count() == 10

"""Every query of the package: against its SQL where it has one, and the pipeline stage by stage."""

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from palimpsest.llm import ORACLES, QUERIES, decontaminate, ngram_join, quality, toxicity
from palimpsest.llm.pieces import Pieces, tokenizer_path
from scripts.verify import compare, connect

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark, name):
    assert compare(name, QUERIES[name], ORACLES[name], spark, FOLDER, connect(FOLDER))[0] == "ok"


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_pipeline_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    (_, toxic), (_, good), (_, near), (_, clean), (_, encode) = corpus_pipeline.STAGES

    kept = toxic(spark, docs, FOLDER).cache()
    model = toxicity.fit_toxicity(docs, labels.filter(toxicity.fold("doc_id", 5) != 0))
    assert ids(kept) == ids(toxicity.toxicity_scores(docs, model).filter("predicted = 0")) and kept.columns == docs.columns

    better = good(spark, kept, FOLDER).cache()
    assert ids(better) == ids(quality.quality_scores(kept, labels).filter("accepted")) and better.columns == docs.columns

    single = near(spark, better, FOLDER).cache()
    assert ids(single) == ids(ngram_join.near_duplicates(better).filter("doc_id = class_id")) and single.columns == docs.columns

    fresh = clean(spark, single, FOLDER).cache()
    hits = decontaminate.benchmark_hits(single, benchmark)
    assert ids(fresh) == {r["doc_id"] for r in hits.collect() if not (r["n_hit"] and 20 * r["n_hit"] >= r["n_words"])}

    texts = {r["doc_id"]: r["text"] for r in fresh.collect()}
    pieces = Pieces(tokenizer_path("piece_bpe_32k.model"))
    rows = encode(spark, fresh, FOLDER).collect()
    assert {r["doc_id"]: pieces.decode(r["ids"]) for r in rows} == {k: t or "" for k, t in texts.items()}
    assert 0 < len(rows) < docs.count()

    assert sorted(corpus_pipeline.run(spark, FOLDER).select("doc_id", "ids_crc32").collect()) == sorted((r["doc_id"], r["ids_crc32"]) for r in rows)


def test_entry_works_without_the_package():
    code = (
        "import sys; sys.modules['palimpsest.llm'] = None; sys.path.insert(0, '.')\n"
        "import importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('palimpsest.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "del sys.modules['palimpsest.llm']; sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e; names = e.queries(); assert 'length_rule_general' in names and 'pipeline' not in names; e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)

"""The registered queries on the smallest tables: against their SQL, with
the contracts' columns, and the pipeline stage by stage."""
import os
import sys
import zlib
from collections import defaultdict

from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as e  # noqa: E402
import corpus_pipeline  # noqa: E402
from checks.compare import digest, duck  # noqa: E402
from segmetrics.llm import queries, simhash  # noqa: E402
from segmetrics.llm.sql import ORACLE_SQL  # noqa: E402
from tests.conftest import SF001  # noqa: E402
from tests.llm.test_text_operators import brute_lines, check_pieces  # noqa: E402

COLUMNS = {
    "op2_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3_embedding_dedup": "vec_id n_links component_id kept",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7_license_scans": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op8_simhash": "doc_id fingerprint component_id",
    "op9_mixing": "doc_id size source_size target taken",
    "op10_quality_classifier": "doc_id held_out score predicted",
    "op11_importance_resampling": "doc_id n_features weight score rank",
    "op12_language_id": "doc_id held_out lang_pred score",
    "op13_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) <= set(e.queries()) and "pipeline" in e.queries()
    assert set(ORACLE_SQL) <= set(queries.QUERIES)


def test_columns(spark):
    n = spark.read.parquet(f"{SF001}/documents.parquet").count()
    for name, columns in COLUMNS.items():
        df = e.queries()[name](spark, SF001)
        assert df.columns[:len(columns.split())] == columns.split() or set(columns.split()) <= set(df.columns), name
        if name not in ("op5_packing", "op3_embedding_dedup"):
            assert df.count() == n, name


def test_held_out_labels(spark):
    for r in queries.op10_quality_classifier(spark, SF001).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_sql(spark):
    con = duck(SF001)
    for name, sql in ORACLE_SQL.items():
        df = e.queries()[name](spark, SF001)
        rows, res = [tuple(r) for r in df.collect()], con.execute(sql)
        columns = [d[0] for d in res.description]
        assert sorted(columns) == sorted(df.columns), name
        assert digest(rows, df.columns)[0] == digest(res.fetchall(), columns)[0], name


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    """Nulls, empty texts, repeated rows and extra columns go through all
    stages; reruns on other layouts keep the same texts."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    def stages(frame):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, str(tmp_path))
            assert frame.columns == docs.columns
        return frame

    mixed = stages(docs)
    texts = sorted(str(r.text) for r in mixed.collect())
    again = stages(docs.repartition(5, "text"))
    assert sorted(str(r.text) for r in again.collect()) == texts and texts
    pieces = corpus_pipeline.packed(spark, mixed, str(tmp_path)).collect()
    assert pieces and all(0 < p.length <= 4096 for p in pieces)


def test_pipeline_on_an_empty_table(spark, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = no_docs
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
    assert frame.collect() == []


def test_pipeline_stages(spark):
    """Each stage's decisions, from its own input."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names = docs.columns
    kept = corpus_pipeline.quality(spark, docs, SF001).cache()
    scores = {r.doc_id: r.predicted for r in queries.op10_quality_classifier(spark, SF001).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if p == 1}
    lined = corpus_pipeline.lines(spark, kept, SF001).cache()
    want = brute_lines([tuple(r) for r in kept.collect()])
    assert {(r.doc_id, r.text) for r in lined.collect()} == {(i, x[3]) for (i, _), x in want.items()}
    single = corpus_pipeline.near_copies(spark, lined, SF001).cache()
    groups = simhash.near_duplicates(lined).select("component_id").distinct().collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.component_id for r in groups)
    mixed = corpus_pipeline.mixture(spark, single, SF001).cache()
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in single.collect()}
    for df in (kept, lined, single, mixed):
        assert df.columns == names
    pieces = corpus_pipeline.packed(spark, mixed, SF001).collect()
    full, ids = Tokenizer.from_file(queries.TOKENIZER), defaultdict(list)
    for r in mixed.collect():
        ids[r.doc_id].append(full.encode(r.text, add_special_tokens=False).ids + [2])
    check_pieces(pieces, ids)
    # where pieces end depends on the splits of the scan; the tokens do not
    run = corpus_pipeline.run(spark, SF001).collect()
    check_pieces(run, ids)
    assert sum(p.length for p in run) == sum(p.length for p in pieces) > 0

"""The registered queries on a small table: rows, columns, and SQL where there is some."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gaugeline.llm import queries

D = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ordinal_quality": "doc_id bigint, score double, expected_grade double, tail_probability double, kept boolean",
    "op2_sum_of_squares_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3_suffix_tree_repeats": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op4_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codes array<int>, times array<int>",
    "op5_seekable_frames": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_weighted_sampling": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op7_bootstrapped_contexts": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_revealed bigint",
    "op8_pareto_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_circulant_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op12_pigeonhole_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op13_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op10_noisy_channel_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, documents, name):
    found = __spark_entry__.queries()[name](spark, D)
    kinds = dict(found.dtypes)
    wanted = dict(c.split() for c in COLUMNS[name].split(", "))
    assert {c: kinds.get(c) for c in wanted} == wanted
    rows = found.collect()
    if name.startswith("op2_"):
        assert {r["doc_id"] for r in rows} == set(documents) and sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
        return
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    if name.startswith("op4_"):
        assert all(r["feature"].split(":")[0] == str(len(r["codes"])) and len(r["codes"]) == len(r["times"]) for r in rows)
    if name.startswith("op7_"):
        assert all(sum(r[f"n_{k}"] for k in ("email", "ip", "card", "phone")) <= len([s for s in r["spans"].split(",") if s]) for r in rows)
    if name.startswith("op9_"):
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    if name.startswith("op10_"):
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows) and {r["held_out"] for r in rows} == {True, False}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{D}/{table}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, D)
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda rows: sorted(tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in rows)
    assert plain(map(tuple, got.select(*want.columns).collect())) == plain(want.fetchall())


def test_likeness_follows_the_texts(spark, documents):
    """The estimates of op6 against the exact similarity of the bags of words."""
    from test_training_data import jaccard

    order = sorted(documents, reverse=True)
    rows = {r["doc_id"]: r for r in queries.op6_weighted_sampling(spark, D).select("doc_id", F.col("near_next"), F.col("near_edited")).collect()}
    off_next, off_edited = [], []
    for d, after in zip(order, [*order[1:], order[0]]):
        text, following = documents[d], documents[after]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        for off, near, other in ((off_next, rows[d]["near_next"], following), (off_edited, rows[d]["near_edited"], edited)):
            exact = jaccard(text, other) if text.split() or other.split() else 1.0
            off.append(near - exact)
    for off in (off_next, off_edited):
        assert abs(sum(off) / len(off)) < 0.01 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.0625 and max(map(abs, off)) < 0.3

"""Every registered corpus query against its SQL twin, on the smallest tables and on awkward rows."""

import oracle
import pytest
from pitspark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    if name in ORACLES:
        assert oracle.differences(got, oracle.connect(sf_dir).execute(ORACLES[name]).df()) == ""


def _ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_awkward_rows(spark, awkward_dir, name):
    frame = QUERIES[name](spark, awkward_dir)
    want = oracle.connect(awkward_dir).execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    rows = want.fetchall()
    names = [c[0] for c in want.description]
    got = [[r[c] for c in columns] for r in frame.collect()]
    expected = [[row[names.index(c)] for c in columns] for row in rows]
    if name in ("op5_substring_dedup", "op10_near_dedup"):  # SQL joins on the id, so a repeated row comes twice as often
        got, expected = set(map(tuple, got)), set(map(tuple, expected))
        if name == "op5_substring_dedup":
            got, expected = {r for r in got if r[0] != 13}, {r for r in expected if r[0] != 13}
        assert got == expected
    else:
        assert _ordered(got) == _ordered(expected)


#: what stays of a stage's input, by the SQL twin of its operator; a row as often as it is taken
STAYS = {"quality rules": ("op7_quality", "kept::int"), "exact dedup": ("op4_exact_dedup", "kept::int"),
         "near dedup": ("op10_near_dedup", "kept::int"), "source mixing": ("op3_mixing", "times")}


def test_pipeline_against_sql_stage_by_stage(spark, sf_dir, tmp_path):
    """Each stage's rows are those its SQL keeps of the input it had, column by column; packing is held against the tokenizer."""
    import corpus_pipeline
    import duckdb
    from pitspark.llm.common import dataset
    from test_packing import check
    docs = dataset(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = f"{tmp_path}/{name}-in"
        docs.write.parquet(before)
        after = stage(spark, spark.read.parquet(before), sf_dir)
        assert after.schema == docs.schema, name
        after.write.parquet(f"{tmp_path}/{name}-out")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{before}/*.parquet'")
        twin, times = STAYS[name]
        want = con.execute(f"SELECT d.*, unnest(range(t.times)) AS nth FROM documents d JOIN (SELECT doc_id, {times} AS times FROM ({ORACLES[twin]})) t USING (doc_id)").df()
        docs = spark.read.parquet(f"{tmp_path}/{name}-out")
        got = docs.toPandas()
        assert 0 < len(got) == len(want), name
        assert _ordered(got.itertuples(index=False)) == _ordered(want.drop(columns="nth").itertuples(index=False)), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    check(packed, {r.doc_id: r.text or "" for r in docs.collect()})
    assert len(packed[packed["piece"] == 0]) == docs.count()


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, nothing, awkward_dir, tmp_path):
    import corpus_pipeline
    from test_packing import check
    ids = {r.doc_id: r.text or "" for r in awkward.collect()}
    twice = awkward.unionByName(awkward)
    for rows in (awkward, twice):
        docs = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, awkward_dir).collect(), awkward.schema)
            assert docs.columns == awkward.columns, name
        check(corpus_pipeline.STAGES[-1][1](spark, docs, awkward_dir).toPandas(), ids)
    docs = nothing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, awkward_dir)
        assert docs.columns == nothing.columns and docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, awkward_dir).count() == 0
    assert len(corpus_pipeline.run(spark, awkward_dir).columns) == 7

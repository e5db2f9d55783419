import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipe
from corrvox.llm import queries


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    words = {"de": "der die das und ist ein nicht auf mit sich".split(), "fr": "le la les et une est dans pour que qui".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))
    item = text("fr", 20)
    rows = {d: (text("de" if d % 2 else "fr", 80), "de" if d % 2 else "fr") for d in range(60)}
    rows[60] = (rows[3][0].replace(" ", "\n"), "de")  # an exact copy after white space
    rows[61] = (rows[4][0] + " " + text("fr", 2), "fr")  # a near copy
    rows[62] = (text("fr", 30) + " " + item + " " + text("fr", 30), "fr")  # a leak
    rows[63], rows[64] = ("12 !", None), (None, "fr")  # no language
    data = [(d, t, lang, "s", len(t or "")) for d, (t, lang) in rows.items()] + [(5, *rows[5], "s", 1)]  # a repeated row
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {d for d in rows if d not in (60, 61, 62, 63, 64)}
    state, gone = docs, {"language_id": {63, 64}, "exact_dedup": {60}, "jaccard_dedup": {61}, "decontamination": {62}}
    left = set(rows)
    for name, stage in pipe.STAGES[:-1]:
        state = stage(spark, state, str(tmp_path))
        left -= gone[name]
        assert state.columns == docs.columns
        ids = [r.doc_id for r in state.select("doc_id").collect()]
        assert set(ids) == left, name
        if name != "language_id":
            assert len(ids) == len(left)
    out = pipe.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == want and all(r.offset + r.length <= 2048 for r in out)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in pipe.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
    assert pipe.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = queries.queries()
    assert sorted(n.split("_")[0] for n in names) == sorted(f"op{k}" for k in range(1, 14)) and len(pipe.STAGES) == 5


def test_op2_and_op9_same_as_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, "/root/testdata/sf0.001")
        got = c.execute(sql)
        cols = [d[0] for d in got.description]
        assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(got.fetchall(), key=repr), name

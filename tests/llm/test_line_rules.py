import duckdb
import pytest

from bandwarden.llm import line_rules as R

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def by_sql(path):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    return sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({R.ORACLE})").fetchall())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_matches_sql(spark, sf):
    path = f"/root/testdata/sf{sf}/documents.parquet"
    got, hits = R.line_frequency_rules(spark.read.parquet(path))
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == by_sql(path)


def test_common_lines_deplete_and_edges(spark, tmp_path):
    own = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"Shared  Line of {'t1 t2 t3 t4 t5 t6 '}host\n\n{own} {i}", "h") for i in range(30)]
    rows += [(100 + i, "shared line OF t1 t2 t3 t4 t5 t6 host\nsmall rest here", "h") for i in range(3)]
    rows += [(200, "shared line of t1 t2 t3 t4 t5 t6 host\nsmall rest here but in another host", "g"), (201, None, None), (202, "", None),
             (203, "a b c d e f a b c d e f a b", None), (204, "x y\nx y\nX y\n \n", "h"), (205, "q " * 3000, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS words", "'z' AS host")
    docs.write.parquet(str(tmp_path / "d"))
    got, _ = R.line_frequency_rules(docs)
    rows_got = sorted(map(tuple, got.select(*COLUMNS).collect()))
    assert rows_got == by_sql(f"{tmp_path}/d/*.parquet")
    kept = {r[0]: r[-1] for r in rows_got}
    assert all(kept[i] for i in range(30)) and not kept[100] and kept[200] and not kept[203]
    clean = R.clean_documents(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[0] == f"\n{own} 0" and texts[200].startswith("shared line") and set(texts) == {d for d, k in kept.items() if k}


def test_repeated_rows_and_empty_table(spark):
    schema = "doc_id long, text string, source string"
    assert R.line_frequency_rules(spark.createDataFrame([], schema))[0].count() == 0
    rows = [(1, "a b c d e f g h i j k l", "s")] * 25
    got = R.line_frequency_rules(spark.createDataFrame(rows, schema))[0].collect()
    assert len(got) == 25 and len({tuple(r) for r in got}) == 1


def test_a_growing_host_excuses_no_line(spark):
    line = "the same line in twenty five documents of each host"
    rows = [(i, line, "small") for i in range(25)] + [(1000 + i, line, "large") for i in range(25)]
    rows += [(2000 + i, f"a line that is all of document {i} and of no other one at all", "large") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = R.line_frequency_rules(docs)[0].collect()
    assert {r["kept"] for r in got if r["doc_id"] < 2000} == {False} and {r["kept"] for r in got if r["doc_id"] >= 2000} == {True}


def test_cleaning_returns_every_kept_row_once(spark):
    own = "one two three four five six seven eight nine ten"
    rows = [(None, f"{own} a", "s", 1, "r"), (None, f"{own} b", "s", 2, "r"), (7, f"{own} c", "s", 3, "r"), (7, f"{own} d", "s", 4, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, gone int, row string")
    clean = R.clean_documents(docs)
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect()), key=str) == sorted(rows, key=str)

"""Every query of the catalog against its SQL, over the smallest tables."""

import duckdb
import pytest
from compare import connect, spark_rows, sql_rows

from fabula.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got, expected = spark_rows(QUERIES[name](spark, SF)), sql_rows(con, SQL[name])
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    assert got[1] == expected[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


#: Rewritings that must change what their rule sees: the query differs from the text it starts with.
@pytest.mark.parametrize("name", ["comma_strip", "numbers_in_documents", "dash_fold", "mark_fold", "vosk_normalize", "accent_normalize", "isolate_headings", "short_title", "unescape", "symbol_filter"])
def test_rule_fires(spark, name):
    plain = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert any(r.value != plain[r.doc_id] for r in QUERIES[name](spark, SF).collect())


def equals_sql(spark, path, name, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert spark_rows(QUERIES[name](spark, str(path))) == sql_rows(con, SQL[name])


@pytest.mark.parametrize("name", ["texts_filled", "texts_strict"])
def test_odd_texts_equal_sql(spark, tmp_path, name):
    """Empty, blank and missing texts stop nothing."""
    equals_sql(spark, tmp_path, name, ["", " \n\t", None, "\u00a0\u2003", " да \n", "a\n\nb"])


@pytest.mark.parametrize("name", ["dialogue_chunks", "adjacent_merge"])
def test_capitals_equal_sql(spark, tmp_path, name):
    """Letters whose capital takes several, at the start of a text, a line, a sentence and a remark."""
    equals_sql(spark, tmp_path, name, ["ßheit", "Von. ßpfber.\nß ensch", "a, ßb. c the ßd", "straße", ""])


def test_capitals_of_pieces_equal_sql(spark, tmp_path):
    """Pieces of long speech and of long remarks that start with such a letter, and a chunk just at the limit."""
    equals_sql(spark, tmp_path, "parse_book", ["ßpfch " * 120, "ab, " + "ßcd ef. " * 60, "ß" + "x" * 198, "ß" + "x" * 450])


@pytest.mark.parametrize("name", ["dialogue_chunks", "parse_book"])
def test_word_edges_and_digits_equal_sql(spark, tmp_path, name):
    """Marks, number signs and letters beyond 16 bits beside verbs and words without commas, other scripts' digits, İ, control characters."""
    beside = [x for c in "\u0301\u203f\u200d²ⅠⒶª_𐐀😀" for x in (f"a\n- сказал{c} b", f"b, блин{c}, c", f"b, {c}блин, c", f"b, вообще{c} c")]
    texts = ["a ٣ b 12 c५ d", "a\nİa сказал b", "ab, İ кивнул. Cd", "a \x01 b\x02, \x01блин\x02, c", "Да, КОРОЧЕ, нет", "x\n- " + "сказал\u0301 ab. " * 40]
    equals_sql(spark, tmp_path, name, texts + beside)

"""Queries over texts that no fixture has, empty ones and odd line ends, against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from codestrata import catalog

MESSAGES = ["Merge pull request #7 from x/y", "merge requeſt PR #9  ", "a (#12)", "a (#12)\x0b", "a (#12)\r", "a (#12) \t\nb (#3)"]
TEXTS = [None, "", "\n", "\n\n", " ", "\t", "a\n", "a\n\n\n", "\ta\r\nb\r\n", "  a \nb", "a\x0bb\x0cc\x1cd\x1ee\x85f g", "a\rb\rc\rd\re", " \n a \x85 \n\n b \n ", *MESSAGES]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder, each = tmp_path_factory.mktemp("odd"), 14  # of each form of message
    texts = [t for t in TEXTS for _ in range(each)]
    ids = pa.array(range(len(texts)), pa.int64())
    sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
    pq.write_table(pa.table({"doc_id": ids, "text": pa.array(texts, pa.string()), "lang": ["en"] * len(texts), "source": ["src1"] * len(texts), "n_chars": sizes}), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": ids, "quality": pa.array([1] * len(texts), pa.int32()), "toxic": pa.array([0] * len(texts), pa.int32())}), folder / "labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["flt_trivial", "prj_first_line", "ref_bare_message", "ref_pull_number", "ref_simple"])
def test_odd_texts_give_the_rows_of_the_sql(spark, odd, name):
    connection = duckdb.connect()
    for t in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet'")
    df = catalog.queries()[name](spark, odd)
    connection.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in connection.description]
    wanted = sorted((tuple(r[names.index(c)] for c in df.columns) for r in connection.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == wanted

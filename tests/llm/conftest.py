import duckdb
import pytest

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Write the given rows as tables, each of a name and rows, and return the folder."""

    def write(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, schema in SCHEMAS.items():
            rows = spark.createDataFrame(tables.get(name, []), schema)
            rows.coalesce(3).write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return write


@pytest.fixture
def matches(spark):
    """Whether a query gives what its SQL gives on the same tables."""

    def compare(module, name, path):
        df = module.QUERIES[name](spark, path)
        order = sorted(df.columns)
        con = duckdb.connect()
        for table in SCHEMAS:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
        result = con.execute(module.CHECKS[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == order
        want = [tuple(r[names.index(c)] for c in order) for r in result.fetchall()]
        got = [tuple(r[c] for c in order) for r in df.collect()]
        assert sorted(map(_rounded, got), key=str) == sorted(map(_rounded, want), key=str)
        return got

    return compare


def _rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)

import pytest
from pyspark.sql import Row


@pytest.fixture()
def make(spark):
    """Builds a documents table from dicts; an extra column has a clashing name."""

    def build(rows, extra="size string"):
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
        full = [
            Row(
                r.get("doc_id"), r.get("text"), r.get("lang"), r.get("source", "src0"),
                len(r["text"]) if r.get("text") else None, None if extra.split()[-1].startswith("map<") else "x",
            )
            for r in rows
        ]
        return spark.createDataFrame(full, schema)

    return build

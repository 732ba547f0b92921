import pytest

CLASH = ["row_key", "size", "start", "token", "node", "n", "h", "range", "Text2", "__key", "__id", "__text", "__n", "gone", "copy",
         "copies", "ranges", "evidence", "quality", "host_rate", "n_sentences", "n_removed", "prompt", "sequence_id", "offset", "a.b"]


@pytest.fixture(scope="session")
def documents(spark):
    """Frame of documents from (doc_id, text, source, lang) rows, with columns whose names the operators use inside."""
    def make(rows):
        rows = [(*r, *[None] * (4 - len(r))) for r in rows]
        df = spark.createDataFrame([(*r, *[str(i)] * len(CLASH)) for i, r in enumerate(rows)],
                                   "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` string" for c in CLASH))
        return df
    return make

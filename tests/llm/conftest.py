import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, id long, cluster string, z string, component_id long, score string, n_lines string, gone int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) rows, with more columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), 1, 2, "c", "z", 3, "x", "y", 4) for d, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def words():
    """Pseudo-words, different for each seed."""

    def make(n, seed=0):
        state, out = seed * 7919 + 17, []
        for _ in range(n):
            state = (state * 1103515245 + 12345) % 2**31
            out.append("".join("bcdfghklmnprstvz"[(state >> s) % 16] + "aeiou"[(state >> s + 4) % 5] for s in (3, 9, 15)))
        return out

    return make


@pytest.fixture(scope="session")
def awkward(docs_of, words):
    """Nulls, empty and very long texts, repeated rows, and odd characters."""
    long = " ".join(words(30000, 1))
    return docs_of([(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, long + " more"), (7, "a\x00b c \U0001f389"), (8, "same row"), (8, "same row"), (None, "no id"), (None, None), (9, "a b\r\nc\x0bd\x0ce")])


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}

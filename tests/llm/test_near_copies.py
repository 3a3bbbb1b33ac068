"""One row of every group of near copies, whatever its ids."""

from collections import Counter

from quillgauge.llm import simhash


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


NAMELESS = [
    (None, "one text without any id that is about rivers and their many bridges"),
    (None, "quite another text without id that tells of mountains snow and ice"),
    (None, "a numbered text about ships on the sea that has a nameless copy"),
    (7, "a numbered text about ships on the sea that has a nameless copy"),
    (8, "the same id with this text on gardens and old trees in the town"),
    (8, "the same id with that text on trains stations and long iron roads"),
    (8, "the same id with that text on trains stations and long iron roads"),
]


def test_one_row_per_group(spark):
    """Null ids and repeated ids name no group: every text without a copy stays, once."""
    df = spark.createDataFrame(NAMELESS, "doc_id long, text string").repartition(3)
    assert rows_of(simhash.one_of_each(df)) == Counter({NAMELESS[i]: 1 for i in (0, 1, 3, 4, 5)})
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_names_of_the_input_are_kept(spark):
    """Columns named like the operator's own ones come back as they were."""
    own = "__rid long, __fp string, __id int, __root string, __row int, __of int, __first int, node string, doc_id long, TEXT string, root double"
    rows = [(1, "a", 2, "b", 3, 4, 5, "c", i, t, 0.5) for i, t in NAMELESS]
    df = spark.createDataFrame(rows, own)
    out = simhash.one_of_each(df, text="TEXT")
    assert out.columns == df.columns
    assert rows_of(out) == Counter({rows[i]: 1 for i in (0, 1, 3, 4, 5)})

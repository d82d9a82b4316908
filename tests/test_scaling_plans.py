"""Plans whose cost per task must not grow with the table."""

import random

from pyspark.sql import functions as F

from presswire.functions import fixed_values as V
from presswire.functions import text as T
from presswire.plans import registry as R
from presswire.session import work_path
from presswire.sources import tables
from presswire.sources.driver_tables import events_raw
from presswire.sources.key_index import KeyIndex


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_without_a_sort(spark, sf_dir):
    for df in (events_raw(spark, sf_dir, wide=True), R.document_lines(spark, sf_dir)):
        text = plan(df)
        assert "Exchange hashpartitioning" in text and "RoundRobin" not in text


def test_an_append_deals_wide_rows_once_and_sorts_after(spark):
    path = work_path(spark, "t")
    rows = spark.createDataFrame([("a", "20240101"), (None, "20240102"), ("", "20240103")], "EVENT_ID string, DATE string")
    tables.append_new(rows, path, "EVENT_ID", "DATE")
    index = KeyIndex(spark, path, "EVENT_ID", "DATE")
    for held, exchanges in ((None, 1), (index, 2)):
        text = plan(tables.one_row_per_key(rows, "EVENT_ID", "DATE", held))
        below = text[text.index("Exchange"):] if held is None else ""
        assert "Sort" not in below and text.count("Exchange") <= exchanges
    # a null and an empty key are two keys, and both are known now
    more = rows.unionByName(spark.createDataFrame([("b", "20240101")], rows.schema))
    assert sorted(r.EVENT_ID for r in tables.one_row_per_key(more, "EVENT_ID", "DATE", index).collect()) == ["b"]
    assert tables.append_new(more, path, "EVENT_ID", "DATE").count() == 4


def test_an_append_picks_rows_before_it_widens_them(spark, sf_dir):
    batch = R.vector_events(spark, sf_dir)
    keys = tables.unseen_keys(batch, "EVENT_ID", "DATE")
    text = plan(tables.rows_of_keys(batch, "EVENT_ID", "DATE", keys, False))
    # deeper steps come later: known rows leave before the vectors are joined
    assert text.index("LeftOuter") < text.index("LeftSemi")


def test_patterns_that_look_at_a_character_first_match_as_before(spark):
    r = random.Random(3)
    parts = [" ", "  ", "\t", "A", "B", "Ab", "apos", "Apos", "a", "for", "was", "x1", "1 2", "-", ".", "É", "é", "\x1c"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t")
    edge, space = V.EDGE_PUNCTUATION, T.SPACE
    pairs = [
        (rf"^{space}+|(?<!{space}){space}+$", rf"^{space}+|(?={space})(?<!{space}){space}+$", False),
        ("(?<=[a-z])(?=[A-Z])", "(?=[A-Z])(?<=[a-z])", False),
        ("(?<=[A-Z])(?=[A-Z][a-z])", "(?=[A-Z][a-z])(?<=[A-Z])", False),
        (r"\bApos\b", r"(?=a)\bApos\b", True),
        (r"\b([A-Z])\s+([A-Z])\b", r"(?=[A-Z]\s)\b([A-Z])\s+([A-Z])\b", False),
        (r"(?<!\s)" + V.TRUNCATED_PREPOSITION, r"(?=\s)(?<!\s)" + V.TRUNCATED_PREPOSITION, False),
        (r"(?<!\s)" + V.TRUNCATED_AUXILIARY, r"(?=\s)(?<!\s)" + V.TRUNCATED_AUXILIARY, True),
        (f"(?<!{edge}){edge}+$|^{edge}+$", f"(?={edge})(?<!{edge}){edge}+$|^{edge}+$", False),
    ]
    for before, after, ignore_case in pairs:
        same = F.sum((T.replace(F.col("t"), before, "|", ignore_case) != T.replace(F.col("t"), after, "|", ignore_case)).cast("int"))
        assert df.select(same).first()[0] == 0, after

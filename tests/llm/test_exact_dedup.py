import hashlib
import re

from plantpulse.llm import exact_dedup
from plantpulse.llm.common import table


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc, text or ""))
    out = []
    for key, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        for doc, text in members:
            out.append((doc, best[0], len(members), doc == best[0] and len(text) == len(best[1]), hashlib.sha256(key.encode()).hexdigest()))
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_odd_rows_equal_brute_force(odd):
    assert rows_of(exact_dedup.verdicts(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_saturated_filter_gives_the_same_result(spark, sf):
    docs = table(spark, sf, "documents")
    assert rows_of(exact_dedup.verdicts(docs, max_cells=64)) == rows_of(exact_dedup.verdicts(docs))


def test_unique_rows_pass_the_filter_unsuspected(spark, docs):
    copies = exact_dedup.Copies(docs([(i, f"text {i}") for i in range(500)] + [(1000, "text 7")]), "doc_id", "text")
    suspects = exact_dedup.marked(copies.digests, copies.bitmaps, copies.cells).filter("__suspect")
    assert {r["__id"] for r in suspects.collect()} >= {7, 1000}
    assert suspects.count() <= 6


def test_drop_copies_keeps_columns(odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts}) == 5


def test_empty(docs):
    assert exact_dedup.verdicts(docs([])).count() == 0
    assert exact_dedup.drop_copies(docs([])).count() == 0


def test_drop_copies_keeps_one_of_repeated_rows_and_any_column_name(spark):
    rows = [(1, "a b", "x", "y", "z"), (1, "a b", "x", "y", "z"), (2, "ab", "x", "y", "z"), (3, "c", "x", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string, __size string, `odd.name` string")
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[3]]

"""Corpus pipeline: quality filter, exact copies, near copies, source mix, token counts.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as Parquet and the next stage reads
that. All stages but the last return the columns of ``documents``. The first stage learns from ``labels``. Its operator
keeps its model out of the result, so every stage judges only the rows it is given.

Decisions meet the rows by id and text digest (``row_key``), never by the id alone: rows with a null id are judged like
all others, and texts that share an id are judged each. Of rows that repeat id and text the second stage leaves one. A
null text counts as empty: quality judges it like any text, and all empty texts are exact copies of each other; what is
left without words is not taken by the mix. Empty tables stay empty."""

from plantpulse.llm import byte_bpe, exact_dedup, jaccard_join, mixing, quality
from plantpulse.llm.common import packed, row_key, table, unpacked, without_ids
from plantpulse.session import checkpointed


def _without(docs, keys):
    """The rows of ``docs`` whose key is not among ``keys``."""
    return unpacked(without_ids(packed(docs, key=row_key("doc_id", "text")), keys, "key"), docs.columns)


def keep_quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    rows = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    scored = quality.score_quality(rows, table(spark, sf_dir, "labels"), carry="key")
    return _without(docs, checkpointed(scored.filter("predicted = 0").select("key").distinct()))


def drop_exact_copies(spark, docs, sf_dir):
    """Of equal texts the longest original stays, then the smallest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of each component of linked documents the one with the smallest id stays."""
    rows = docs.select("text", row_key("doc_id", "text").alias("key"))
    marked = jaccard_join.near_duplicates(rows, id_col="key")
    return _without(docs, checkpointed(marked.filter("component_id != key").select("key").distinct()))


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes their words."""
    return mixing.mixed_documents(docs)


def count_tokens(spark, docs, sf_dir):
    """Number and digest of the tokens of each document, and digest of the decoded text."""
    import public_tokenizers
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    # A third of the frequent words of the default: the literal stays beside what earlier stages left in the driver.
    return byte_bpe.token_digests(docs, ranks, public_tokenizers.PATTERN, max_words=byte_bpe.MAX_WORDS // 3)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("near-duplicate join", drop_near_copies),
    ("source mix", mix_sources),
    ("byte-level BPE", count_tokens),
]

# The fitted classifier of the first stage has no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Byte-level BPE: encoding by ranked merges in Spark higher-order functions, decoding by concatenating binary pieces.

The ranks become one literal table: an array of small maps, addressed by the hash of a byte string (one character per
byte), so a look-up costs the same for any vocabulary. ``merged`` folds over the bytes of one word: the state is one array
of numbers, the cuts between the parts; each holds its place and, above it, the rank of the pair that it keeps apart. Every
step takes out the leftmost cut of lowest rank and looks up its two neighbours anew.

Words are cut by the tokenizer's pattern. All distinct words are counted over all texts; the most frequent ones, up to
``MAX_WORDS``, are folded once, and their packed ids become a second literal table of bounded size. Other words, each of
which is rare, are folded where they stand. That changes no id: a word has one encoding wherever it is computed. The ids
of every folded word are decoded and compared with the word, so the decoded bytes of a text are those of its words.
Texts are never shuffled. The binary pieces of a text are joined in one pass, at a cost in proportion to its length.

Defined cases: a null or empty text has no ids and decodes to the empty string. Special tokens are ordinary text. Rows
that repeat an id are encoded each. An empty table gives an empty result. The cost of one fold grows with the square
of the length of a word, its memory linearly. With a vocabulary that lacks single bytes, a text that needs them has null
results. Other columns play no part.
"""

import base64
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.llm.common import table
from plantpulse.session import checkpointed, discard

# Bound of the table of frequent words: at most this many entries (about 50 MB), three to six in a map.
MAX_WORDS = 3 << 18
# Numbers of slots are powers of two.
RANK_SLOTS = 1 << 14
# A cut: its place in the low bits, the rank of its pair above.
PLACE_BITS = 31
PLACE = (1 << PLACE_BITS) - 1
NO_RANK = PLACE << PLACE_BITS
# Unicode white space as a character class. Java's \s covers ASCII only.
SPACE_CLASS = "\\t-\\r\\x85\\p{Z}"


def java_pattern(pattern: str) -> str:
    """The tokenizer's pattern with white space as Unicode defines it."""
    return (pattern.replace("[^\\s", f"[^{SPACE_CLASS}").replace("\\S", f"[^{SPACE_CLASS}]").replace("\\s", f"[{SPACE_CLASS}]"))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _slot(key, slots: int):
    return F.hash(key).bitwiseAND(F.lit(slots - 1))


def lookup_table(entries: DataFrame, key: str, value: str, slots: int) -> DataFrame:
    """One row, one column: array of ``slots`` maps; an entry lies in the map with the number of its key's hash.
    Callers bound the number of entries."""
    spark, kinds = entries.sparkSession, dict(entries.dtypes)
    maps = entries.groupBy(_slot(F.col(key), slots).cast("long").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))
    empty = F.expr(f"cast(map() as map<{kinds[key]},{kinds[value]}>)")
    every = spark.range(slots).join(maps, "id", "left").select("id", F.coalesce("m", empty).alias("m"))
    return every.coalesce(1).sortWithinPartitions("id").agg(F.collect_list("m").alias("table"))


def as_literal(one_value: DataFrame):
    """The single value of a one-row table as a literal column: a session variable, which Spark folds into the plan.
    (Scalar subqueries are not allowed inside higher-order functions.) Plans keep the value; once they are built, the
    variable can be dropped with ``drop_literals``."""
    spark, name = one_value.sparkSession, f"literal_{uuid.uuid4().hex}"
    kind = one_value.dtypes[0][1]
    one_value.createOrReplaceTempView(name)
    spark.sql(f"DECLARE VARIABLE {name} {kind}")
    spark.sql(f"SET VARIABLE {name} = (SELECT * FROM {name})")
    spark.catalog.dropTempView(name)
    return name


def drop_literals(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")


def literal(name: str):
    return F.expr(f"system.session.{name}")


def look_up(name: str, key, slots: int):
    return F.try_element_at(F.get(literal(name), _slot(key, slots)), key)


def _bind(value, body):
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Codec:
    """Literal tables of one vocabulary, as columns."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.pattern = java_pattern(pattern)
        size = max(ranks.values(), default=-1) + 1
        rows = spark.createDataFrame([(token.decode("latin-1"), rank) for token, rank in ranks.items()], "token string, rank int")
        self._ranks = as_literal(lookup_table(rows, "token", "rank", RANK_SLOTS))
        high = rows.select("token", F.shiftleft(F.col("rank").cast("long"), PLACE_BITS).alias("high"))
        self._high_ranks = as_literal(lookup_table(high, "token", "high", RANK_SLOTS))
        pieces = [b""] * size
        for token, rank in ranks.items():
            pieces[rank] = token
        numbers = [rank.to_bytes(4, "little") for rank in range(size)]
        self._pieces = as_literal(spark.createDataFrame([(pieces,)], "pieces array<binary>").select(F.col("pieces").cast("array<string>")))
        self._numbers = as_literal(spark.createDataFrame([(numbers,)], "numbers array<binary>").select(F.col("numbers").cast("array<string>")))

        self.literals = [self._ranks, self._high_ranks, self._pieces, self._numbers]

    def rank(self, token):
        return _bind(token, lambda key: look_up(self._ranks, key, RANK_SLOTS))

    def cut(self, token, place):
        """A cut at ``place`` inside ``token``."""
        return F.coalesce(_bind(token, lambda key: look_up(self._high_ranks, key, RANK_SLOTS)), F.lit(NO_RANK)).bitwiseOR(place)

    def words(self, text):
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def merged(self, word):
        """Ids of one word, by a fold over its bytes."""
        place = lambda cut: cut.bitwiseAND(F.lit(PLACE))

        def fold(code):
            n, rest = F.length(code), F.lit(PLACE >> 1)
            between = lambda left, right: F.substring(
                F.substring(code, F.lit(1), place(right).cast("int")), place(left).cast("int") + 1, rest)

            def merge(cuts, k):
                # Both ends of the word are cuts too. Beyond them lies null, a token without rank: an end is never taken out.
                left, right = F.get(cuts, k - 2), F.get(cuts, k)
                before = self.cut(between(F.get(cuts, k - 3), right), place(left))
                after = self.cut(between(left, F.get(cuts, k + 1)), place(right))
                return F.concat(F.slice(cuts, F.lit(1), k - 2), F.array(before, after), F.slice(cuts, k + 2, rest))

            def step(cuts, _):
                def lowest_out(lowest):
                    merge_there = _bind(F.array_position(cuts, lowest).cast("int"), lambda k: merge(cuts, k))
                    return F.when(lowest >= NO_RANK, cuts).otherwise(merge_there)

                return _bind(F.array_min(cuts), lowest_out)

            inner = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: self.cut(F.substring(code, i, F.lit(2)), i.cast("long")))
            start = F.concat(F.array(F.lit(NO_RANK)), inner, F.array(F.lit(NO_RANK).bitwiseOR(n.cast("long"))))
            ids = lambda cuts: F.transform(
                F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: self.rank(between(F.get(cuts, i - 1), F.get(cuts, i))))
            many = F.aggregate(F.sequence(F.lit(2), n), start, step, ids)
            return _bind(self.rank(code), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(many))

        return _bind(F.decode(word.cast("binary"), "ISO-8859-1"), fold)

    def decode(self, ids):
        """Bytes of an array of ids."""
        return concatenated(F.transform(ids, lambda i: F.get(literal(self._pieces), i)))

    def packed(self, ids):
        """Ids as little-endian unsigned 32-bit integers."""
        return concatenated(F.transform(ids, lambda i: F.get(literal(self._numbers), i)))

    def coded(self, word):
        """Packed ids of a word, null unless they decode to the word."""
        return _bind(self.merged(word), lambda ids: F.when(self.decode(ids) == word.cast("binary"), self.packed(ids)))


def concatenated(pieces):
    """All binary values of an array in one. (Strings hold any bytes here, and only strings have a joining function.)"""
    return F.array_join(pieces.cast("array<string>"), "").cast("binary")


def most_frequent(counted: DataFrame, max_words: int) -> DataFrame:
    """Words above a frequency that at most ``max_words`` words reach. The frequency is found from a histogram of a few
    hundred classes, so nothing is sorted."""
    level = F.floor(F.log2("count") * 8).cast("int")
    words, least = 0, None
    for row in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):
        words += row.words
        if words > max_words:
            break
        least = row.level
    return counted.filter(level >= least) if least is not None else counted.limit(0)


def coded_words(df: DataFrame, codec: Codec, text_col: str, max_words: int = MAX_WORDS):
    """Function from a column with the words of ``text_col`` to their packed ids (see ``Codec.coded``, each a string of bytes)."""
    counted = checkpointed(df.select(F.explode(codec.words(F.col(text_col))).alias("word")).groupBy("word").count())
    # Words are dealt out anew: the counts stand in few large files.
    known = checkpointed(most_frequent(counted, max_words).select("word").repartition("word").select("word", codec.coded(F.col("word")).alias("coded")))
    discard(counted)
    decoded = known.filter(F.col("coded").isNotNull()).select("word", F.col("coded").cast("string").alias("coded"))
    slots = 1 << max((max_words // 3).bit_length() - 1, 0)
    words = as_literal(lookup_table(decoded, "word", "coded", slots))
    codec.literals.append(words)
    discard(known)
    return lambda all_words: F.transform(
        all_words, lambda word: F.coalesce(look_up(words, word, slots), codec.coded(word).cast("string")))


def token_digests(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """Id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row of ``df``."""
    codec = Codec(df.sparkSession, ranks, pattern)
    coded = coded_words(df, codec, text_col, max_words)
    split = df.select(F.col(id_col).alias("__id"), codec.words(F.col(text_col)).alias("__words"))
    joined = split.select("__id", "__words", coded(F.col("__words")).alias("__coded"))
    # No packed id is empty: the test is false, or null where a word does not decode to itself.
    whole = ~F.array_contains("__coded", "")
    joined = joined.select("__id", F.when(whole, concatenated(F.col("__coded"))).alias("__ids"), F.when(whole, concatenated(F.col("__words"))).alias("__bytes"))
    out = joined.select(
        F.col("__id").alias(id_col), (F.length("__ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("__ids", 256).alias("ids_sha256"), F.sha2("__bytes", 256).alias("decoded_sha256"))
    drop_literals(df.sparkSession, codec.literals)
    return out


def query(spark, sf_dir):
    import public_tokenizers
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)

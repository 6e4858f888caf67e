"""Token ids of all documents by way of a table of distinct words, and back."""

from __future__ import annotations

import functools
import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.tables import cut, table

#: Where the vocabulary files lie; a parameter of every function here.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
#: Fixed value: the byte-level pattern that splits text into words, white space and letters as Unicode has them.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that make up at least one in so many of all words are joined by broadcast: there are at most so many of them.
HEAD_WORDS = 20_000
#: Longest word that is broadcast, in characters; with HEAD_WORDS it bounds the broadcast to a few MB.
HEAD_CHARS = 32
#: Tasks over which the occurrences of a frequent longer word are spread.
SALTS = 64


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def word_table(documents: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(word, n, ids): every distinct word of all documents, how often it occurs, and its ids. Each is encoded once."""
    path = path or f"{FOLDER}/{BYTE_BPE}"
    counts = documents.select(F.explode(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("array<int>")
    def encode(words: pd.Series) -> pd.Series:
        batch = _tokenizer(path).encode_batch_fast(words.tolist(), add_special_tokens=False)
        return pd.Series([e.ids for e in batch])

    return counts.select("word", "n", encode("word").alias("ids"))


class _Vocabulary:
    """The distinct words of all documents in two parts: ``head``, frequent and short, small enough to broadcast; and the others.

    Of the others, frequent longer ones are known by their hashes, of which there are at most ``HEAD_WORDS``,
    and spread over ``SALTS`` tasks. No other word is frequent enough to be hot.
    """

    def __init__(self, documents: DataFrame, text: str, path: str | None):
        self.table = cut(word_table(documents, text=text, path=path))
        total = self.table.agg(F.sum("n")).first()[0] or 0
        frequent, short = F.col("n") * HEAD_WORDS >= total, F.length("word") <= HEAD_CHARS
        self.head = self.table.where(frequent & short).select(F.col("word").alias("_word"), F.col("ids").alias("_ids"))
        self.hot = F.broadcast(self.table.where(frequent & ~short).select(F.xxhash64("word").alias("_hash")).distinct().withColumn("_hot", F.lit(True)))
        self.tail = self.table.where(~(frequent & short))

    def with_ids(self, words: DataFrame, columns: list[str]) -> DataFrame:
        """(columns, _ids) of rows (columns, _word) whose words are none of the head."""
        tail = self.tail.select(F.col("word").alias("_word"), F.col("ids").alias("_ids"), F.xxhash64("word").alias("_hash")).join(self.hot, "_hash", "left")
        salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        marked = words.withColumn("_hash", F.xxhash64("_word")).join(self.hot, "_hash", "left")
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")).otherwise(0)
        return marked.select(*columns, "_word", salt.alias("_salt")).join(tail.select("_word", "_ids", F.explode(salts).alias("_salt")), ["_word", "_salt"]).select(*columns, "_ids")


def _words(text: str):
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def _each_once(documents: DataFrame) -> DataFrame:
    """(_id, _t) with one row per id: only rows whose id repeats are brought together."""
    again = cut(documents.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("_id").alias("_again")))
    if again.isEmpty():
        return documents
    same = F.col("_id").eqNullSafe(F.col("_again"))
    return documents.join(again, same, "left_anti").unionByName(documents.join(again, same, "left_semi").dropDuplicates(["_id"]))


def token_ids(documents: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id_column, ids): the token ids of each document's whole text, without special tokens.

    Empty and null texts get an empty list. Strings that look like special tokens are ordinary text.
    Texts are split into words by Spark and every distinct word is encoded once. The ids of frequent words, of
    which there are at most ``HEAD_WORDS`` short ones, are put in their places where the text is read; only the
    other words are shuffled, and come back by position to the documents that hold them. Rows that repeat
    an id with the same text give one row; an id with several texts has no defined one and must not
    occur; a null id is one document. Other columns aren't read.
    """
    own = _each_once(documents.select(F.col(id_column).alias("_id"), F.col(text).alias("_t")))
    vocabulary = _Vocabulary(own, "_t", path)
    held = vocabulary.head.toArrow()
    told = documents.sparkSession.sparkContext.broadcast(dict(zip(held["_word"].to_pylist(), held["_ids"].to_pylist(), strict=True)))

    def place(frames):
        """The ids known here, where the others belong among them, and the others' words."""
        known = told.value.get
        for frame in frames:
            rows = []
            for words in frame["_words"]:
                ids, gaps, others = [], [], []
                for word in words:
                    if (found := known(word)) is None:
                        gaps.append(len(ids))
                        others.append(word)
                    else:
                        ids += found
                rows.append((ids, gaps, others))
            out = pd.DataFrame(rows, columns=["_ids", "_gaps", "_others"], dtype=object)
            out.insert(0, "_id", frame["_id"].to_numpy())
            yield out

    kind = own.schema["_id"].dataType.simpleString()
    placed = cut(own.select("_id", _words("_t").alias("_words")).mapInPandas(place, f"_id {kind}, _ids array<int>, _gaps array<int>, _others array<string>"))
    part = placed.where(F.size("_gaps") > 0)
    each = part.select("_id", F.posexplode("_others").alias("_no", "_word"))
    rare = vocabulary.with_ids(each, ["_id", "_no"])
    gathered = rare.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_no", "_ids"))).alias("_rows")).select(F.col("_id").alias("_key"), F.transform("_rows", lambda r: r["_ids"]).alias("_found"))
    both = part.select("_id", "_ids", "_gaps").join(gathered, F.col("_id").eqNullSafe(F.col("_key")))
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(F.col("_gaps"), i - 1))
    pieces_ = F.transform("_gaps", lambda g, i: F.concat(F.slice("_ids", start(i) + 1, g - start(i)), F.get(F.col("_found"), i)))
    last = F.element_at("_gaps", -1)
    whole = F.concat(F.flatten(pieces_), F.slice("_ids", last + 1, F.size("_ids")))
    out = placed.where(F.size("_gaps") == 0).select("_id", "_ids").unionByName(both.select("_id", whole.alias("_ids")))
    return out.select(F.col("_id").alias(id_column), F.col("_ids").alias("ids"))


def token_counts(documents: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of every document, by the same table of words: lengths are summed before they are shuffled, no ids are built.

    Rows that repeat an id and source count once; empty and null texts have 0 tokens; other columns aren't read.
    """
    columns = ["doc_id", "source"]
    named = documents.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("_t"))
    vocabulary = _Vocabulary(named, "_t", path)
    near = named.select(*columns, F.posexplode_outer(_words("_t")).alias("_pos", "_word")).join(F.broadcast(vocabulary.head), "_word", "left")
    known = near.where("_ids is not null or _word is null").select(*columns, "_pos", "_ids")
    found = vocabulary.with_ids(near.where("_ids is null and _word is not null").select(*columns, "_pos", "_word"), [*columns, "_pos"])
    copies = F.greatest(F.count(F.when(F.coalesce("_pos", F.lit(0)) == 0, 1)), F.lit(1))
    sums = known.unionByName(found).groupBy(*columns).agg(F.sum(F.coalesce(F.size("_ids"), F.lit(0)).cast("bigint")).alias("_n"), copies.alias("_copies"))
    return sums.select(*columns, (F.greatest("_n", F.lit(0)) / F.col("_copies")).cast("bigint").alias("n_tokens"))


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, piece): the bytes of each id in hexadecimal digits; as many rows as the vocabulary has."""
    with open(path or f"{FOLDER}/{BYTE_BPE}") as f:
        model = json.load(f)
    # The vocabulary writes bytes as printable characters: those that are printable as themselves, the others from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    rows = [(i, bytes(byte[c] for c in p).hex()) for p, i in model["model"]["vocab"].items()]
    rows += [(a["id"], a["content"].encode().hex()) for a in model["added_tokens"]]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece string")


def decoded(ids: DataFrame, id_column: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id_column, text): the text of each list of ids, by a join with the pieces; an empty or null list is the empty text, unknown ids add nothing."""
    spread = ids.select(F.col(id_column).alias("_id"), F.posexplode_outer("ids").alias("_pos", "_piece_id"))
    known = pieces(ids.sparkSession, path)
    joined = spread.join(F.broadcast(known), F.col("_piece_id") == F.col("id"), "left").select("_id", F.struct("_pos", "piece").alias("_p"))
    digits = F.array_join(F.transform(F.array_sort("_ps"), lambda p: p["piece"]), "")
    return joined.groupBy("_id").agg(F.collect_list("_p").alias("_ps")).select(F.col("_id").alias(id_column), F.unhex(digits).cast("string").alias("text"))


def p7_ids(spark, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents"))


def p7_decoded(spark, folder: str) -> DataFrame:
    """Encoded and decoded again: every text must come back as it was."""
    return decoded(p7_ids(spark, folder))


QUERIES = {"p7_ids": p7_ids, "p7_decoded": p7_decoded}
SQL = {"p7_decoded": "select doc_id, coalesce(text, '') as text from documents"}

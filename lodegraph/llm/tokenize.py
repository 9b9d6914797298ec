"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Texts are split into pre-tokens inside the JVM.  Each distinct pre-token is
encoded once, however often it occurs; its ids join back to the occurrences,
which are put together again by position.  Pre-tokens frequent enough to be a
burden for a shuffle are few by definition; their ids are broadcast and looked
up where the text is, so only rare ones travel.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import materialize, release, ship

#: Fixed value: how the vocabulary's authors split a text, with Unicode meaning of white space.
PRE_TOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pre-token is frequent from this share of all occurrences on, so at most so many are broadcast.
MAX_FREQUENT = 20_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a vocabulary file lies: ``folder``, else LODEGRAPH_TOKENIZERS, else the installed collection."""
    folder = folder or os.environ.get("LODEGRAPH_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


_encoders: dict[str, object] = {}


def _encoder(path: str, held: Broadcast):
    """The encoder of a vocabulary file, made once in a worker from what the driver read."""
    if path not in _encoders:
        import tiktoken

        _encoders[path] = tiktoken.Encoding("corpus", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(held.value), special_tokens={})
    return _encoders[path]


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, n, ids) for distinct pre-tokens (word, n); a pre-token of any length is one piece.

    The vocabulary file need lie where the driver runs only.
    """
    held = words.sparkSession.sparkContext.broadcast(read_file(path))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(path, held)
        for b in batches:
            yield b.assign(ids=[enc._encode_single_piece(w.encode()) for w in b["word"]])

    return words.mapInPandas(encode, "word string, n bigint, ids array<int>")


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0))


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """(key, ids) for every row; an empty list for a null or empty text, special-token strings are plain text.

    Each row gives one row, repeated rows too.
    """
    path = path or vocabulary_path()
    ship(documents.sparkSession)
    rows = documents.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    # texts are split once; all that follows reads their words
    full = materialize(rows.where(F.col("_text") != "").select("_key", "_row", pre_tokens(F.col("_text")).alias("_words")), "split")
    counted = materialize(full.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    codes = materialize(encode_words(counted, path), "codes")
    release(counted)
    # at most max_frequent words
    frequent = {r["word"]: list(r["ids"]) for r in codes.where(F.col("n") * max_frequent > total).select("word", "ids").toLocalIterator()}
    held = documents.sparkSession.sparkContext.broadcast(frequent)

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = held.value
        for b in batches:
            runs, holes = [], []
            for words in b["_words"]:
                run: list[int] = []
                mine, rare = [run], []
                for w in words:
                    ids = table.get(w)
                    if ids is None:
                        rare.append(w)
                        run = []
                        mine.append(run)
                    else:
                        run += ids
                runs.append(mine)
                holes.append(rare)
            yield pd.DataFrame({"_key": b["_key"], "_row": b["_row"], "runs": runs, "holes": holes})

    kind = dict(rows.dtypes)["_key"]
    near = full.mapInPandas(look_up, f"_key {kind}, _row bigint, runs array<array<int>>, holes array<string>")
    near = materialize(near, "near")  # ids of frequent words, split where a rare word stands, and those words
    rare = codes.where(F.col("n") * max_frequent <= total).select("word", "ids")
    far = near.select("_row", F.posexplode("holes").alias("at", "word")).join(rare.hint("shuffle_hash"), "word").select("_row", "at", "ids")
    whole = near.where(F.size("holes") == 0).select("_key", F.flatten("runs").alias("ids"))
    # a row and its rare words meet by row, once
    none = F.lit(None)
    parts = near.where(F.size("holes") > 0).select("_row", "_key", "runs", none.cast("int").alias("at"), none.cast("array<int>").alias("ids")).unionByName(far.select("_row", none.cast(kind).alias("_key"), none.cast("array<array<int>>").alias("runs"), "at", "ids"))
    met = parts.groupBy("_row").agg(F.max("_key").alias("_key"), F.first("runs", True).alias("runs"), F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "ids")))).alias("_p"))
    filled = F.concat(F.element_at("runs", 1), F.flatten(F.zip_with("_p", F.slice("runs", F.lit(2), F.size("runs")), lambda x, run: F.concat(x["ids"], run))))
    none = rows.where(F.col("_text").isNull() | (F.col("_text") == "")).select("_key", F.array().cast("array<int>").alias("ids"))
    return whole.unionByName(met.select("_key", filled.alias("ids"))).unionByName(none).select(F.col("_key").alias(key), "ids")


def token_bytes(spark, path: str | None = None) -> DataFrame:
    """(id, piece): the bytes of every token; the table is as large as the vocabulary."""
    ranks = read_ranks(read_file(path or vocabulary_path()))
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks.items()], "id int, piece binary")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text) from ids by joining the token-byte table; an empty list gives an empty text.

    An id that names no token makes the row's text null.
    """
    table = F.broadcast(token_bytes(encoded.sparkSession, path))
    rows = encoded.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.col(ids).alias("_ids"))
    spread = rows.select("_key", "_row", F.posexplode_outer("_ids").alias("pos", "id")).join(table, "id", "left")
    parts = spread.groupBy("_key", "_row").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))).alias("_p"), F.count_if(F.col("id").isNotNull() & F.col("piece").isNull()).alias("_bad"))
    text = F.decode(F.unhex(F.array_join(F.transform("_p", lambda x: x["h"]), "")), "UTF-8")
    return parts.select(F.col("_key").alias(key), F.when(F.col("_bad") == 0, text).alias("text"))

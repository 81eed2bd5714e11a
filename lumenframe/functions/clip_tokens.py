"""Token ids of a word-level byte-pair vocabulary, framed to a fixed length for a text encoder."""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The frame's length, its first and last id, and the pattern of word pieces.
LENGTH, START, END = 77, 49_406, 49_407
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a vocabulary file, one JSON object of ids by token."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """(rank, left, right) of a merges file: blank lines and those that begin with # have no rank."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where("trim(value) <> '' AND NOT startswith(value, '#')")
    parts = F.split(F.trim("value"), " ")
    # a merges file is one small file, so one task orders it
    return lines.select((F.row_number().over(Window.orderBy("at")) - 1).alias("rank"), F.get(parts, F.lit(0)).alias("left"), F.get(parts, F.lit(1)).alias("right"))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies of this kind (fixed values)."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, more = [], 256
    for b in range(256):
        letters.append(chr(b) if b in shown else chr(more))
        more += b not in shown
    return letters


class WordPieces:
    """Ids of a text's pieces: in each piece the earliest merge comes first."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab, self.rank, self.letters = vocab, {tuple(m): i for i, m in enumerate(merges)}, byte_letters()
        self.find = regex.compile(PATTERN)
        self.piece = lru_cache(20_000)(self._piece)

    @classmethod
    def of_file(cls, path: str) -> WordPieces:
        """From a tokenizer file that holds both vocabulary and merges."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])

    def _piece(self, piece: str) -> tuple[int, ...]:
        parts = [self.letters[b] for b in piece.encode()]
        parts[-1] += WORD_END
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), len(self.rank)))
            pair = parts[at], parts[at + 1]
            if pair not in self.rank:
                break
            joined, i = [], 0
            while i < len(parts):
                both = tuple(parts[i : i + 2]) == pair
                joined.append("".join(pair) if both else parts[i])
                i += 1 + both
            parts = joined
        return tuple(self.vocab[p] for p in parts if p in self.vocab)

    def ids(self, text: str | None) -> list[int]:
        return [i for piece in self.find.findall(" ".join((text or "").split()).lower()) for i in self.piece(piece)]

    def framed(self, text: str | None) -> list[int]:
        """Start, ids, end and zeros: always LENGTH numbers. Longer texts lose what does not fit, the end too."""
        found = [START, *self.ids(text), END][:LENGTH]
        return found + [0] * (LENGTH - len(found))


@lru_cache(2)
def _pieces(path: str) -> WordPieces:
    return WordPieces.of_file(path)


def framed_ids(text: Column, path: str) -> Column:
    """The framed ids of a text column, in Arrow batches."""

    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_pieces(path).framed)

    return run(text)

"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding.

Every prefix of a piece has one last token: the one that ends there and may follow the last token
of the prefix before it. Two tokens may stand side by side if no merge across their border comes
before the merges that use up its two sides. So the transducer reads a piece byte by byte and
notes the last token of each prefix.

``lookahead`` is worked out from the merge list. Take two texts that agree on their first n bytes, and run
their merges side by side. Their tokens agree up to a border that is at n at first and goes back by the
left side of each merge across it; the token behind it is then that side or the merged one, and grows by
later merges only. So one pass over the merges, in order, gives for every token how far the border can have gone
back when that token is behind it. Tokens that end before the greatest of these distances are the same whatever
follows: they are stable and go out, and the transducer keeps no more than two lookaheads of prefixes.

Decoding is a state machine from tokens' bytes to text that holds at most one unfinished character.
Digests are updated block by block, so neither tokens nor decoded text of a long text are ever held whole for them.

Edge cases: null counts as the empty text, which has no tokens; special tokens in a text are found
first, as the vocabulary file says; repeated rows come back as often as they went in; empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from struct import pack
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from ahocorasick import Automaton
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.shared import freed, held, only, quoted

#: Fixed pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of remembered pieces in a worker, about, and the longest piece that is remembered; remembered pairs of tokens.
CACHE_BYTES, CACHE_CHARS, CACHE_PAIRS = 96_000_000, 64, 400_000
#: What an entry of a dictionary takes besides its key and value.
ENTRY = 100
#: Pieces that are encoded at a time, and bytes of a batch that goes out.
BLOCK_PIECES, BATCH_BYTES = 20_000, 2_000_000
FAR = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files (fixed values)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int] | None = None):
        letters, self.special = byte_letters(), special or {}
        size = max([*vocab.values(), *self.special.values()], default=-1) + 1
        self.bytes_of = [b""] * size
        for t, i in vocab.items():
            if t not in self.special:
                self.bytes_of[i] = bytes(letters[c] for c in t)
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size  # of the merge that makes a token
        self.merge: dict[int, int] = {}
        for k, m in enumerate(merges):
            a, b = m if isinstance(m, (list, tuple)) else m.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge[left << 32 | right] = k
            self.rank[whole], self.left[whole], self.right[whole] = k, left, right
            if max(self.rank[left], self.rank[right]) >= k:
                raise ValueError("a merge comes before the merges that make its sides")
        self.longest = max(map(len, self.bytes_of), default=0)
        self.lookahead = self.sufficient_lookahead()
        self.most_kept = 2 * max(1, self.lookahead) + self.longest
        self.fits: dict[int, bool] = {}
        sound: dict[int, bool] = {}
        #: Finds all tokens that end at each byte of a text.
        self.ending = Automaton()
        for i, b in enumerate(self.bytes_of):
            if b and self.usable(i, sound):
                self.ending.add_word(b.decode("latin-1"), i)
        self.ending.make_automaton()
        self.size_of = list(map(len, self.bytes_of))
        self.table = list(self.bytes_of)
        for text, i in self.special.items():
            self.table[i] = text.encode()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        return cls(spec["model"]["vocab"], spec["model"]["merges"], {t["content"]: t["id"] for t in spec.get("added_tokens", [])})

    def sufficient_lookahead(self) -> int:
        """Bytes after which a token can no longer change, whatever follows."""
        back = [0] * len(self.bytes_of)
        for whole in sorted((i for i, k in enumerate(self.rank) if k >= 0), key=self.rank.__getitem__):
            left, right = self.left[whole], self.right[whole]
            moved = back[right] + len(self.bytes_of[left])  # the merge goes across the border
            back[whole] = max(back[whole], back[left], moved)  # or makes the token behind it grow
            back[left] = max(back[left], moved)
        return max(back, default=0)

    def border(self, left: int, right: int) -> Iterator[int]:
        """Ranks of the merges across the border that come before both of its sides are used up."""
        a, until = left, FAR
        while True:
            b, ends = right, FAR
            while True:
                k = self.merge.get(a << 32 | b)
                if k is not None and k < until and k <= ends:
                    yield k
                if self.rank[b] < 0:
                    break
                ends, b = self.rank[b], self.left[b]
            if self.rank[a] < 0:
                return
            until, a = self.rank[a], self.right[a]

    def usable(self, token: int, sound: dict[int, bool]) -> bool:
        """Its own bytes are encoded as this token."""
        found = sound.get(token)
        if found is None:
            left, right = self.left[token], self.right[token]
            found = left < 0 or (self.usable(left, sound) and self.usable(right, sound) and min(self.border(left, right)) == self.rank[token])
            sound[token] = found
        return found

    def may_follow(self, left: int, right: int) -> bool:
        found = self.fits.get(key := left << 32 | right)
        if found is None:
            if len(self.fits) >= CACHE_PAIRS:
                self.fits.clear()
            found = self.fits[key] = next(self.border(left, right), None) is None
        return found

    def transduce(self, data: bytes) -> Iterator[int]:
        """The tokens of one piece, each once it is stable."""
        last = [-1]  # last token of each kept prefix; the first one ends where the stable tokens end
        base, most = 0, self.most_kept
        size_of, fits, may_follow = self.size_of, self.fits.get, self.may_follow
        for end, token in self.ending.iter(data.decode("latin-1")):  # the longest first
            here = end + 1 - base
            start = here - size_of[token]
            if here < len(last) or start < 0:
                continue  # the prefix has its last token, and only one may be
            ahead = last[start]
            if ahead < 0 or (fit if (fit := fits(ahead << 32 | token)) is not None else may_follow(ahead, token)):
                last.append(token)
                if here > most:
                    stable = [at for at in self.way_back(last, here) if at <= here - self.lookahead]
                    if not stable:
                        raise AssertionError("a token is longer than the vocabulary allows")
                    yield from self.tokens_on(last, stable)
                    del last[: stable[0]]
                    base += stable[0]
        yield from self.tokens_on(last, self.way_back(last, len(last) - 1))

    def way_back(self, last: list[int], at: int) -> list[int]:
        """The borders of the tokens of a kept prefix, the newest first."""
        way = [at]
        while at > 0:
            at -= self.size_of[last[at]]
            way.append(at)
        return way

    def tokens_on(self, last: list[int], way: list[int]) -> list[int]:
        return [last[k] for k in reversed(way[:-1])]


class Pieces(dict):
    """Packed ids of pieces, remembered up to a bound in bytes.

    What fills half of the bound becomes the old half, whose place the next one takes; pieces that are met again move over.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = CACHE_BYTES):
        super().__init__()
        self.vocabulary, self.most, self.held, self.old = vocabulary, most, 0, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            ids = list(self.vocabulary.transduce(piece.encode("utf-8", "surrogatepass")))
            packed = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_CHARS:
            if self.held >= self.most // 2:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[piece] = packed
            self.held += getsizeof(piece) + getsizeof(packed) + ENTRY
        return packed


class Codec:
    """Encodes texts to packed little-endian ids in blocks, and decodes them."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary.read(path)
        self.pieces = Pieces(self.vocabulary)
        self.find = regex.compile(PATTERN)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, special))) if special else None

    def parts(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """Bounds of the special tokens in a text and of what lies between them."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield at, m.start(), False
            yield m.start(), m.end(), True
            at = m.end()
        yield at, len(text), False

    def encode(self, text: str) -> Iterator[bytes]:
        for start, end, special in self.parts(text):
            part = text if end - start == len(text) else text[start:end]
            if special:
                yield pack("<I", self.vocabulary.special[part])
            elif len(part) < BLOCK_PIECES:
                yield b"".join(map(self.pieces.__getitem__, self.find.findall(part)))
            else:
                found = self.find.finditer(part)
                while block := list(islice(found, BLOCK_PIECES)):
                    few: list[bytes] = []
                    for m in block:
                        if m.end() - m.start() <= BLOCK_PIECES:
                            few.append(self.pieces[m[0]])
                        else:
                            yield b"".join(few)
                            few = []
                            yield from self.blocks(m[0])
                    yield b"".join(few)

    def blocks(self, piece: str) -> Iterator[bytes]:
        """Packed ids of a long piece, as they become stable."""
        ids = self.vocabulary.transduce(piece.encode("utf-8", "surrogatepass"))
        while some := list(islice(ids, BLOCK_PIECES)):
            yield pack(f"<{len(some)}I", *some)

    def decode(self, blocks: Iterator[bytes]) -> Iterator[str]:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        table = self.vocabulary.table
        for block in blocks:
            yield machine.decode(b"".join(map(table.__getitem__, np.frombuffer(block, "<u4").tolist())))
        yield machine.decode(b"", True)

    def digests(self, blocks: Iterator[bytes]) -> tuple[int, str, str]:
        """Tokens, and the digests of the ids and of the text that they decode to."""
        size, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

        def counted() -> Iterator[bytes]:
            nonlocal size
            for block in blocks:
                size += len(block)
                of_ids.update(block)
                yield block

        for text in self.decode(counted()):
            of_text.update(text.encode("utf-8", "surrogatepass"))
        return size // 4, of_ids.hexdigest(), of_text.hexdigest()


@held
@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


DIGESTS = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]


def _mapped(rows: DataFrame, make, fields: list[pa.Field]) -> DataFrame:
    """The first column, and the fields that make(value) gives for the second, in batches of about BATCH_BYTES."""
    name, kind = rows.columns[0], rows.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, values, out, size, start = batch.column(0), batch.column(1), [], 0, 0
            for i in range(batch.num_rows):
                out.append(make(values[i].as_py()))
                size += len(out[-1][0]) if isinstance(out[-1][0], (bytes, str)) else 1
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.slice(start, len(out)), *columns], schema=pa.schema([pa.field(name, keys.type), *fields]))
                    start, out, size = i + 1, [], 0

    types = {pa.binary(): "binary", pa.string(): "string", pa.int64(): "long"}
    return rows.mapInArrow(freed(run), ", ".join([f"{quoted(name)} {kind}", *(f"{f.name} {types[f.type]}" for f in fields)]))


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(key, ids): packed little-endian unsigned 32-bit ids of every whole text; with digests also n_tokens, ids_sha256 and decoded_sha256."""

    def make(s: str | None) -> tuple:
        c = codec(path)
        ids = b"".join(c.encode(s or ""))
        return (ids, *c.digests(ids[i : i + 4 * BLOCK_PIECES] for i in range(0, len(ids), 4 * BLOCK_PIECES))) if digests else (ids,)

    return _mapped(only(docs, key, text), make, [pa.field("ids", pa.binary()), *(DIGESTS if digests else [])])


def digest_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every whole text, in constant memory besides the text."""

    def make(s: str | None) -> tuple:
        c = codec(path)
        return c.digests(c.encode(s or ""))

    return _mapped(only(docs, key, text), make, DIGESTS)


def decode_documents(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the text of packed ids."""

    def make(b: bytes | None) -> tuple:
        return ("".join(codec(path).decode((b or b"")[i : i + 4 * BLOCK_PIECES] for i in range(0, len(b or b""), 4 * BLOCK_PIECES))),)

    return _mapped(only(tokens, key, ids), make, [pa.field("text", pa.string())])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())

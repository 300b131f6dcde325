r"""BPE encoding and decoding, exact merges in linear time, without running the merges.

An Aho-Corasick automaton over the vocabulary finds the longest token at each position of a word, a table the shorter ones
that it begins with.  The encoder goes from left to right, takes the longest token at each position that is compatible with
the one before it, and steps back where none is; a position that once had no way on is never visited again.  Two tokens are compatible if merging their joined text
leaves just them; the table of pairs is filled as pairs are met.  Decoding cuts the tokens' texts out of one string
by a table of offsets.

Words are encoded once for each worker while they stay in a cache of two halves, the older of which goes when the other is full;
long words aren't kept.
Texts are never cut.  Nothing is shuffled: one pass, in batches of bounded size, so a lost executor costs its tasks.

Edge cases: null and empty texts have no ids and decode to an empty text; special tokens in a text have their own
ids; repeated rows are encoded each; extra columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, pieces, table

#: The pieces that the vocabulary's pre-tokenizer keeps, and the mark that stands for the end of a word.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIX = "</w>"
END = "\n"
#: Outside these blocks Unicode versions differ in what is a letter or a number; texts with such characters are cut into
#: pieces by the tokenizers library itself.
OTHERS = "[^\u0000-\u0557\u0559-\u058a\u058d-\u088e\u2000-\u2064\u20a0-\u20bf\u3000-\u3096\u3099-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]"
CACHED_WORDS, CACHED_LENGTH, CACHED_PAIRS = 50_000, 48, 60_000
ROWS = 512


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Cache(dict):
    """Words to the bytes of their ids: those met lately and, in ``old``, those met before them; each holds half of ``CACHED_WORDS``.

    A word that is met again moves up, so frequent words stay while those met once go."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS // 2:
                self.old = self.copy()
                super().clear()
            self[word] = ids
        return ids

    def clear(self) -> None:
        super().clear()
        self.old = {}


class Codec:
    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        # Inside, a word's end is a letter of its own; joining it to the last letter comes before all other merges.
        inner = lambda token: token[: -len(SUFFIX)] + END if token.endswith(SUFFIX) else token
        self.token: list[str] = [*self.letters, END]
        number = {t: i for i, t in enumerate(self.token)}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: list[tuple[int, int] | None] = [None] * len(self.token)
        self.rank: list[int] = [-1] * len(self.token)
        ordered = chain(((0, x, END) for x in self.letters), ((i, inner(a), inner(b)) for i, (a, b) in enumerate(model["merges"], 1)))
        for rank, a, b in ordered:
            if (whole := a + b) not in number:
                number[whole] = len(self.token)
                self.token.append(whole)
                self.parts.append((number[a], number[b]))
                self.rank.append(rank)
            self.merge.setdefault((number[a], number[b]), (rank, number[whole]))
        self.length = [len(t) for t in self.token]
        outer = [t[:-1] + SUFFIX if t.endswith(END) else t for t in self.token]
        self.packed = [self.ids.get(t, 0).to_bytes(4, "little") for t in outer]
        self.automaton = ahocorasick.Automaton()
        for t, i in number.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        # The longest token that a token begins with: with the longest one at a position, these are all that start there.
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in self.token]
        self.fits: dict[int, bool] = {}
        self.words = _Cache(self._word)
        self.find = regex.compile(PIECES).findall
        self.odd = re.compile(OTHERS).search
        self.spec = vocabulary
        self.cutter = None
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        by_id = sorted([*((i, t) for t, i in self.ids.items() if t not in self.special), *((i, t) for t, i in self.special.items())])
        texts = {i: (t + " ").encode() for i, t in by_id}
        lengths = [len(texts.get(i, b"")) for i in range(max(texts) + 1)]
        self.blob = b"".join(texts.get(i, b"") for i in range(max(texts) + 1))
        self.offsets = np.concatenate(([0], np.cumsum(lengths))).tolist()
        self.pieces = [self.blob[a:b] for a, b in zip(self.offsets, self.offsets[1:], strict=False)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b side by side is what merging their text ends with.

        Their merges are undone from the last to the first; at no time may the two parts at the border have been a
        merge that was due before the one undone.  Equal merges go from left to right, so the left one was first."""
        known = self.fits.get(a << 20 | b)
        if known is not None:
            return known
        x, y, due, good = a, b, float("inf"), True
        while True:
            joined = self.merge.get((x, y))
            if joined is not None and joined[0] < due:
                good = False
                break
            if self.rank[x] < 0 and self.rank[y] < 0:
                break
            if self.rank[x] > self.rank[y]:
                due, x = self.rank[x], self.parts[x][1]
            else:
                due, y = self.rank[y] + 0.5, self.parts[y][0]
        if len(self.fits) >= CACHED_PAIRS:
            self.fits.clear()
        self.fits[a << 20 | b] = good
        return good

    def encode_letters(self, word: str) -> list[int]:
        """Inner tokens of a word in byte letters with its end."""
        longest, compatible, known, length, shorter = self.automaton.iter_long, self.compatible, self.fits.get, self.length, self.shorter
        out: list[int] = []
        at, token, before = 0, -1, -1
        # Every letter is a token, so these follow each other without a gap; where all are compatible, nothing is stepped back.
        for _, token in longest(word):
            if before >= 0 and not (known(before << 20 | token) or compatible(before, token)):
                break
            out.append(token)
            at += length[token]
            before = token
        closed = bytearray(len(word) + 1)
        while at < len(word):
            while token >= 0 and (closed[at + length[token]] or (out and not compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = next(longest(word, at))[1] if at < len(word) else -1
            else:
                closed[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))
        return b"".join(map(self.packed.__getitem__, self.encode_letters(letters + END)))

    def segment(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text.isascii() and self.odd(text):
            if self.cutter is None:
                from tokenizers import Tokenizer

                self.cutter = Tokenizer.from_str(self.spec)
            pieces = self.cutter.pre_tokenizer.pre_tokenize_str(self.cutter.normalizer.normalize_str(text))
            return b"".join(b"".join(map(self.packed.__getitem__, self.encode_letters(x + END))) for x, _ in pieces)
        return b"".join(map(self.words.__getitem__, self.find(self.normal(text))))

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # Letter by letter: a final capital sigma has no form of its own.
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or not any(x in text for x in self.special):
            return self.segment(text)
        return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self.segment(x) for x in self.cut(text) if x)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))[:-1]


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def encode_documents(df: DataFrame, vocabulary_path: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text", decoded: bool = True) -> DataFrame:
    """``keep``, then ``ids`` (binary: little-endian unsigned 32-bit integers) and, if asked for, ``decoded``.

    The vocabulary, a file of fixed size, is read by the driver and broadcast."""
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    kept = df.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*kept.drop("__text").schema.fields, T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.StringType())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for whole in batches:
            for batch in pieces(whole, whole.num_columns - 1, ROWS):
                ids = [c.encode(x.as_py()) for x in batch.column(batch.num_columns - 1)]
                out = [*batch.columns[:-1], pa.array(ids, pa.binary())]
                if decoded:
                    out.append(pa.array([c.decode(x) for x in ids], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=schema.fieldNames())
        c.words.clear()
        c.fits.clear()

    return arrow_map(kept, run, schema)


def decode_documents(df: DataFrame, vocabulary_path: str, keep: Sequence[str] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """``keep`` and the ``decoded`` text of ``ids_col``; null ids decode to an empty text."""
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    kept = df.select(*keep, F.col(ids_col).alias("__ids"))
    schema = T.StructType([*kept.drop("__ids").schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            texts = pa.array([c.decode(x.as_py() or b"") for x in batch.column(batch.num_columns - 1)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=schema.fieldNames())

    return arrow_map(kept, run, schema)


def ids_array(ids):
    """Packed ids as an array of integers."""
    digits = F.hex(ids)
    at = F.sequence(F.lit(1), F.length(digits), F.lit(8))
    swapped = lambda i: F.concat(*[F.substring(digits, i + k, F.lit(2)) for k in (6, 4, 2, 0)])
    return F.when(F.length(digits) == 0, F.array().cast("array<int>")).otherwise(F.transform(at, lambda i: F.conv(swapped(i), 16, 10).cast("int")))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(encoded: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    return encoded.select(
        *keep,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), default_vocabulary()))

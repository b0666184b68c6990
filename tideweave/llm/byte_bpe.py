"""Byte-level BPE by dynamic programming over prefixes.

Two tokens may follow each other if merging their bytes on their own ends at exactly these two. A sequence is the encoding
of its bytes if and only if each token may follow the one before it: the first merge across a border would also be made
in the pair alone. So the encoding of a prefix, less its last token, is the encoding of a shorter prefix, and each prefix
has one valid last token: of the tokens that it ends with, the one that may follow the shorter prefix's last token. A
Prefixes object holds these last tokens; bytes appended need only their own, and after an edit the old ones hold again
as soon as as many of them in a row as the longest token has bytes are the same.

Texts are split into pieces by a pattern first, and a piece that is a token is that token, as in the tiktoken library.
Workers remember the pieces and the pairs of tokens that they have seen. Encoding is one pass without a shuffle over
whole texts; the ranks, a table of fixed size, are broadcast.

Defined results: null and empty texts have no tokens; repeated documents each have a row, null ids stay null; an empty
table gives an empty result; other columns are ignored. Ids that aren't ranks can't be decoded: an error names them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideweave.llm.common import small_batches, table

#: Pieces that a worker remembers (of each of two generations), the longest of them, and pairs of tokens.
PIECES, LONGEST, PAIRS = 300_000, 64, 500_000

# Letters and numbers that Unicode has from version 17 on. The library's classes are those of version 16,
# in which these code points are neither; the pattern reads them as OTHER, which is neither in any version.
NEWER = (
    "՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    "\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    "\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    "\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
OTHER = "͸"
_NEWER = re.compile(f"[{NEWER}]")


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines `base64 rank`."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


class Vocabulary:
    """Ranks, the pattern of pieces, and what is known of pieces and of pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        if len(self.bytes_of) < len(ranks):
            raise ValueError("ranks aren't unique")
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.longest = max(map(len, ranks))
        # one automaton finds the tokens that end at each byte, the longest first; bytes are read as code points below 256
        self.finder = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.finder.add_word(token.decode("latin-1"), (rank, len(token)))
        self.finder.make_automaton()
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The tokens that merging the lowest-ranked neighbours, the leftmost of equals, leaves; for short pieces."""
        rank_of, none = self.ranks.get, 1 << 60
        parts = [piece[k : k + 1] for k in range(len(piece))]
        ranks = [rank_of(piece[k : k + 2], none) for k in range(len(piece) - 1)]
        while ranks and (rank := min(ranks)) < none:
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        found = self.whole.get(token)
        if found is None:
            found = self.whole[token] = self.merged(self.bytes_of[token]) == [token]
        return found

    def may_follow(self, first: int, second: int) -> bool:
        """Whether merging the bytes of two tokens ends at these two."""
        found = self.pairs.get(first << 32 | second)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            both = self.bytes_of[first] + self.bytes_of[second]
            found = self.pairs[first << 32 | second] = both not in self.ranks and self.merged(both) == [first, second]
        return found

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if not text.isascii() and _NEWER.search(text):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(_NEWER.sub(OTHER, text))]
        return self.pattern.findall(text)

    def piece(self, piece: str) -> tuple[int, ...]:
        """The tokens of one match."""
        found = self.pieces.get(piece) or self.older.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "surrogatepass")
            token = self.ranks.get(raw)
            found = (*Prefixes(self, raw).tokens(),) if token is None else (token,)
        if len(piece) <= LONGEST:
            if len(self.pieces) >= PIECES:  # pieces that come often move on to the next generation
                self.pieces, self.older = {}, self.pieces
            self.pieces[piece] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        out = []
        for piece in self.split(text or ""):
            out += self.pieces.get(piece) or self.piece(piece)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError as e:
            raise ValueError(f"no token has the id {e.args[0]}") from None


class Prefixes:
    """The last token of each prefix of some bytes, which are encoded as one piece."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last = vocabulary, b"", []
        self.append(raw)

    def append(self, raw: bytes) -> None:
        """Adds bytes at the end; earlier prefixes stay as they are."""
        low = len(self.raw)
        self.raw += raw
        self._extend(low, len(self.raw))

    def _extend(self, low: int, high: int) -> None:
        """The last tokens of the prefixes of low + 1 .. high bytes, given those of the shorter ones."""
        v, last = self.vocabulary, self.last
        known = v.pairs.get
        first = max(0, low + 1 - v.longest)
        for end, (token, size) in v.finder.iter(self.raw[first:high].decode("latin-1")):
            end += first
            if end < len(last):
                continue
            if end >= size:
                before = last[end - size]
                fits = known(before << 32 | token)
                if fits or fits is None and v.may_follow(before, token):
                    last.append(token)
            elif v.reachable(token):
                last.append(token)

    def splice(self, at: int, removed: int, added: bytes) -> int:
        """Puts `added` in place of `removed` bytes from `at` on; tells how many last tokens were worked out anew."""
        old, after = self.last, at + removed
        tail = self.raw[after:]
        self.raw, self.last = self.raw[:at] + added + tail, old[:at]
        end, same = at, 0
        while end < len(self.raw):
            self._extend(end, end + 1)
            end += 1
            was = after + end - at - len(added)  # where this prefix ended before
            # the old last token holds from here on if it is the same over the reach of the longest token, none of which sees the edit
            same = same + 1 if end > at + len(added) and self.last[-1] == old[was - 1] else 0
            if same >= self.vocabulary.longest:
                self.last += old[was:]
                break
        return end - at

    def tokens(self) -> list[int]:
        """The encoding: last tokens, from the end."""
        out, end = [], len(self.raw)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


@lru_cache(maxsize=2)
def _vocabulary(digest: str, held) -> Vocabulary:
    return Vocabulary(read_ranks(held.lines), held.pattern)


class _Ranks:
    """A vocabulary's file on its way to the workers, each of which builds it once."""

    def __init__(self, lines: bytes, pattern: str):
        self.lines, self.pattern = lines, pattern
        self.digest = hashlib.sha256(lines + pattern.encode()).hexdigest()

    def __eq__(self, other):
        return isinstance(other, _Ranks) and self.digest == other.digest

    def __hash__(self):
        return hash(self.digest)

    def vocabulary(self) -> Vocabulary:
        return _vocabulary(self.digest, self)


def ranks_of(spark: SparkSession, path: str, pattern: str):
    """The broadcast of a file of ranks, as encode() and decode() take it."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(_Ranks(file.read(), pattern))


def _packed(ids: list[int]) -> bytes:
    """Little-endian, 32 bits each."""
    return np.array(ids, "<u4").tobytes()


def encode(docs: DataFrame, ranks, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", packed: bool = True) -> DataFrame:
    """id, n_tokens and the ids of every document: packed (binary, 32 bits each, little-endian) or as array<int>."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = ranks.value.vocabulary()
        for b in source:
            found = [v.encode(t) for t in b.column(1).to_pylist()]
            ids = pa.array([_packed(f) for f in found], pa.binary()) if packed else pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, found), pa.int64()), ids], names=[id_col, "n_tokens", ids_col])

    small_batches(docs.sparkSession)
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField(ids_col, kind)])
    return docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias(text_col)).mapInArrow(batches, schema)


def decode(encoded: DataFrame, ranks, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows, with their columns, and the bytes of their ids (packed or an array); null ids are none."""
    at, packed = encoded.columns.index(ids_col), isinstance(encoded.schema[ids_col].dataType, T.BinaryType)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = ranks.value.vocabulary()
        for b in source:
            rows = (np.frombuffer(i or b"", "<u4").tolist() if packed else i or [] for i in b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v.decode(i) for i in rows], pa.binary())], names=[*b.schema.names, out_col])

    return encoded.mapInArrow(batches, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())]))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the public ranks, and decoded again."""
    import public_tokenizers

    ranks = ranks_of(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    both = decode(encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Fill-in-middle: a text's prefix, suffix and middle, cut at code points and set in another order between marks.

The bytes at which code points begin are the ones of a packed bitvector over all bytes of an Arrow batch. A directory holds
how many ones come before each block, so that rank(byte) is an entry of the directory and the popcounts of a few words, and
select(number) is a search in the directory and in the words of one block. A text's popcount is its number of code
points; the two cuts are selected, and all parts are sliced as bytes: no text is decoded or walked.

The form and the cuts follow from hashes of the id, so that reruns agree wherever a row is. restored() undoes it exactly: a
text with a mark in it stays plain, so that the first mark of each kind is the one set here.

Defined results: null and empty texts are plain and empty; null ids hash as the seed alone; repeated rows each have a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideweave.llm.common import small_batches, table

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of 64 bits in a block of the directory.
BLOCK = 8


class Boundaries:
    """Rank and select over the bytes at which code points begin."""

    def __init__(self, data: np.ndarray):
        size = BLOCK * 8 * max(1, -(-len(data) // (BLOCK * 64)))
        bits = np.zeros(size, np.uint8)
        packed = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        bits[: len(packed)] = packed
        self.words = bits.view("<u8")
        count = np.bitwise_count(self.words).reshape(-1, BLOCK).astype(np.int64)
        self.inside = np.cumsum(count, axis=1) - count  # before each word, in its block
        self.directory = np.concatenate([[0], np.cumsum(count.sum(axis=1))])  # before each block

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones come before each byte."""
        word, bit = np.divmod(np.asarray(at, np.int64), 64)
        past = word >= len(self.words)
        word = np.minimum(word, len(self.words) - 1)
        below = self.words[word] & ((np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1))
        found = self.directory[word // BLOCK] + self.inside.ravel()[word] + np.bitwise_count(below)
        return np.where(past, self.directory[-1], found)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The byte of the one that `number` others come before; the numbers lie below the total."""
        number = np.asarray(number, np.int64)
        block = np.searchsorted(self.directory, number, side="right") - 1
        left = number - self.directory[block]
        inside = self.inside[block]
        word = (inside <= left[:, None]).sum(axis=1) - 1
        left = left - inside[np.arange(len(number)), word]
        at = block * BLOCK + word
        bits = np.unpackbits(self.words[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)
        return at * 64 + bit


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and where each begins (and the last ends)."""
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    return (np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)), ends


def transformed(texts: pa.Array, first: np.ndarray, second: np.ndarray, plain: np.ndarray, suffix_first: np.ndarray) -> tuple[pa.Array, ...]:
    """n, form, prefix_chars, middle_chars and output of each text. first, second: unsigned hashes that the cuts are remainders of."""
    data, starts = raw(texts)
    low, high = (int(starts[0]), int(starts[-1])) if len(texts) else (0, 0)
    data, starts = data[low:high], starts - low
    vector = Boundaries(data)
    before = vector.rank(starts)
    n = np.diff(before)
    marked = np.zeros(len(texts), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = plain | marked | (n == 0)
    a, b = first % (n + 1), second % (n + 1)
    cuts = np.sort(np.stack([a, b], axis=1), axis=1)
    # the cut after the last code point is the text's end; the others are where the next code point begins
    number = before[:-1, None] + cuts
    at = np.where(cuts == n[:, None], starts[1:, None], 0)
    inner = cuts < n[:, None]
    at[inner] = vector.select(number[inner])
    held, out = data.tobytes(), []
    p, s, m = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
    for start, end, one, two, is_plain, spm in zip(starts[:-1].tolist(), starts[1:].tolist(), at[:, 0].tolist(), at[:, 1].tolist(), plain.tolist(), suffix_first.tolist()):
        if is_plain:
            out.append(held[start:end])
        elif spm:
            out.append(b"".join((s, held[two:end], p, held[start:one], m, held[one:two])))
        else:
            out.append(b"".join((p, held[start:one], s, held[two:end], m, held[one:two])))
    form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    chars = pa.array(cuts[:, 0], pa.int64(), mask=plain), pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=plain)
    return pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *chars, pa.array(out, pa.binary()).cast(pa.string())


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_percent: int = 10, suffix_first_percent: int = 20
) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output of every document.

    Two cuts, the form and the order follow from the first four groups of eight digits of the sha256 of `seed:id`.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            hashes = [b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
            found = transformed(b.column(1), hashes[0], hashes[1], hashes[2] % 100 >= 100 - plain_percent, hashes[3] % 100 < suffix_first_percent)
            yield pa.RecordBatch.from_arrays([b.column(0), *found], names=schema.names)

    small_batches(docs.sparkSession)
    kinds = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(k, t) for k, t in kinds.items())])
    return docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")), *h).mapInArrow(batches, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle() was made of, from its form."""
    part = lambda c, mark, k: F.split_part(c, F.lit(mark), F.lit(k))
    body = F.substring(output, len(PREFIX) + 1, F.length(output))  # less the first mark
    head, rest = part(body, SUFFIX, 1), part(body, SUFFIX, 2)
    psm = F.concat(head, part(rest, MIDDLE, 2), part(rest, MIDDLE, 1))
    tail, rest = part(body, PREFIX, 1), part(body, PREFIX, 2)
    spm = F.concat(part(rest, MIDDLE, 1), part(rest, MIDDLE, 2), tail)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, transformed and restored."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, text, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
  CAST('0x' || h[17:24] AS BIGINT) % 100 AS r3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS r4 FROM d),
c AS (SELECT doc_id, text, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r3 >= 90 THEN 'plain' WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""

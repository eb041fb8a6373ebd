"""Fill-in-the-middle transformation by in-place block rotations, and its exact inverse.

A text is a row of units: runs of ASCII letters, and every other code point on its own. Two cuts, drawn from a hash of the
document's id, make three blocks. The transformation works in one bytearray:

1. A scan of the bytes finds where the two cuts lie.
2. The sentinels are inserted in front of the blocks: ``<P>prefix<M>middle<S>suffix``.
3. Neighbouring blocks change places by a rotation, which is three reversals (each block, then both together): prefix,
   suffix, middle (psm) exchanges the last two; suffix, prefix, middle (spm) exchanges that result's first two.

``restore_texts`` finds the sentinels in an output, undoes the rotations in reverse order and deletes the sentinels. A text
that holds a sentinel stays as it is (plain), and no sentinel can arise where two blocks meet, so this is exact.

Every text is worked on alone, so a task needs memory for a batch of rows and a few copies of its longest text. Nothing is
shuffled or kept.

Defined cases: a null or empty text is plain and empty, of 0 units; a null id is hashed as an empty one; rows that share an
id are cut by the same draw, each in its own text; repeated rows are transformed each; a very long text is cut like any
other; an empty table gives no rows; extra columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterank.llm.common import columns

#: Sentinels before prefix, suffix and middle, and the seed of the draw (fixed values of the contract).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = "1"

ROTATED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ROTATED = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def draws(doc_id: int | None, seed: str = SEED) -> tuple[int, ...]:
    """Four numbers of 32 bits from the document's id."""
    named = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(named[k : k + 8], 16) for k in range(0, 32, 8))


def unit_starts(raw: bytes | bytearray) -> np.ndarray:
    """Where each unit of a UTF-8 text begins, in bytes."""
    data = np.frombuffer(raw, np.uint8)
    begins = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def rotate(blocks: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange the neighbouring blocks start:middle and middle:end where they stand."""
    blocks[start:middle] = blocks[start:middle][::-1]
    blocks[middle:end] = blocks[middle:end][::-1]
    blocks[start:end] = blocks[start:end][::-1]


def transform(raw: bytes, first: int, second: int, form: str) -> bytearray:
    """The bytes of a text, cut at two places, in the order that ``form`` names."""
    out = bytearray(raw)
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        out[at:at] = sentinel
    middle = len(PREFIX) + first
    suffix = len(PREFIX) + len(MIDDLE) + second
    rotate(out, middle, suffix, len(out))
    if form == "spm":  # prefix and suffix, both in front of the middle now
        rotate(out, 0, middle, middle + len(out) - suffix)
    return out


def restore(output: bytes, form: str) -> bytearray:
    """The bytes of the text from which ``transform`` made ``output``."""
    out = bytearray(output)
    if form == "plain":
        return out
    if form == "spm":
        prefix, middle = out.index(PREFIX), out.index(MIDDLE)
        rotate(out, 0, prefix, middle)
    suffix, middle = out.index(SUFFIX), out.index(MIDDLE)
    rotate(out, suffix, middle, len(out))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):  # from the end, so that earlier places stay
        at = out.index(sentinel)
        del out[at : at + len(sentinel)]
    return out


def _code_points(raw: bytes) -> int:
    return len(raw) - int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80))


def one_text(doc_id: int | None, raw: bytes, *, plain_percent: int, spm_percent: int, seed: str) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    starts = unit_starts(raw)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain_percent:
        return n, "plain", None, None, raw
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (int(starts[k]) if k < n else len(raw) for k in (low, high))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    return n, form, _code_points(raw[:first]), _code_points(raw[first:second]), bytes(transform(raw, first, second, form))


def rotate_texts(documents: DataFrame, *, plain_percent: int = 10, spm_percent: int = 20, seed: str = SEED) -> DataFrame:
    """ROTATED: every text of ``documents`` (doc_id, text) with its middle moved to the end.

    ``plain_percent`` of the texts stay as they are; of the others ``spm_percent`` begin with the suffix.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.large_binary())
            found = [
                one_text(i, t.as_py() or b"", plain_percent=plain_percent, spm_percent=spm_percent, seed=seed)
                for i, t in zip(ids, texts, strict=True)
            ]
            *some, outputs = zip(*found, strict=True) if found else ((), (), (), (), ())
            arrays = [pa.array(c, f.type) for c, f in zip((ids, *some), _ROTATED, strict=False)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(outputs, pa.binary()).cast(pa.string())], schema=_ROTATED)

    return columns(documents, doc_id="long", text="string").mapInArrow(work, ROTATED)


def restore_texts(rotated: DataFrame) -> DataFrame:
    """The rows of ``rotated`` (with columns ``form`` and ``output``) and ``restored``, the text that each output was made of."""
    fields = rotated.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column("form").to_pylist()
            outputs = batch.column("output").cast(pa.large_binary())
            texts = pa.array([bytes(restore(o.as_py(), f)) for o, f in zip(outputs, forms, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "restored"])

    return rotated.mapInArrow(work, f"{fields},restored:string")


def op11_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and what its output gives back."""
    both = restore_texts(rotate_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return both.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', doc_id)) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), k AS (
  SELECT doc_id, t, u, len(u) AS n, CAST(concat('0x', h[1:8]) AS BIGINT) % (len(u) + 1) AS x,
    CAST(concat('0x', h[9:16]) AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
        OR CAST(concat('0x', h[17:24]) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST(concat('0x', h[25:32]) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS pre,
    coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS mid,
    coalesce(array_to_string(u[greatest(x, y) + 1:n], ''), '') AS suf FROM k
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid)
    ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

"""Language mixtures by expectation-maximisation over letter trigrams.

* Training counts hashed trigrams per language on a sample drawn by a hash of id and text: about ``per_language``
  documents of each language (the documented bound of the classifier's sample), each as a whole. At most ``languages``
  values of ``lang`` are learned, those of the most documents (ties by name), which bounds the model.
* A text is a mixture: each trigram is drawn from one of the languages. Expectation-maximisation gives the shares.
* The set of languages is grown from the best single one while the likelihood gains more than the penalty
  ``penalty * log(trigrams)`` per language.

The prediction is the language with the largest share in that set, the score its share among all languages.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text if nothing could be
learned; a null id is held out; a null language is not learned from; repeated rows are predicted each; rows without
a language are predicted like all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterank.llm.common import columns, held_out

UNDETERMINED = "und"
BITS = 15
SAMPLE_BITS = 62
MIXTURES = (
    "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"
)


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str, letters: np.ndarray) -> np.ndarray:
    """Hashed trigrams of the lower-cased letters; any run of other characters is one blank. Empty without a letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[codes]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    codes = np.where(is_letter, codes, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the blank after a word
    keep[0] = True
    codes = codes[keep]
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA6B) + codes[2:] * np.uint32(0xC2B2AE35)
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)


@dataclass
class Model:
    languages: list[str]
    chance: np.ndarray  #: trigram x language: likelihood, float64

    def shares(self, grams: np.ndarray, times: np.ndarray, among: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, float]:
        """Shares of the languages ``among`` and the log-likelihood, by expectation-maximisation."""
        p = self.chance[grams][:, among]
        mix, total = np.full(len(among), 1 / len(among)), times.sum()
        for _ in range(rounds if len(among) > 1 else 0):
            of = p * mix
            new = (times / of.sum(1)) @ of / total
            done = np.abs(new - mix).max() < 1e-4
            mix = new
            if done:
                break
        return mix, float(times @ np.log(p @ mix))

    def predict(self, hashed: np.ndarray, penalty: float) -> tuple[str, float, list[str], list[float]]:
        if not len(hashed) or not self.languages:
            return UNDETERMINED, 0.0, [], []
        grams, times = np.unique(hashed, return_counts=True)
        times = times.astype(float)
        every = np.arange(len(self.languages))
        whole, _ = self.shares(grams, times, every)
        single = times @ np.log(self.chance[grams])
        chosen, best = [int(single.argmax())], float(single.max())
        mix, cost = np.ones(1), penalty * np.log(times.sum() + 1)
        rest = [int(k) for k in np.argsort(-whole) if k != chosen[0]]
        while rest:
            # the likelihood is concave in the shares: its slopes bound what a further language can gain
            p = self.chance[grams]
            slopes = (times / (p[:, chosen] @ mix)) @ p
            able = [k for k in rest if max(slopes[k], slopes[chosen].max()) - times.sum() > cost]
            if not able:
                break
            tried = [(*self.shares(grams, times, np.array([*chosen, k])), k) for k in able]
            some, likely, k = max(tried, key=lambda t: t[1])
            if likely - best <= cost:
                break
            chosen, best, mix = [*chosen, k], likely, some
            rest.remove(k)
        order = np.argsort(-mix, kind="stable")
        top = chosen[int(order[0])]
        names = [self.languages[chosen[int(i)]] for i in order]
        return self.languages[top], float(min(1.0, whole[top])), names, [float(mix[int(i)]) for i in order]


def sample_bar(per_language: int, size: int) -> int:
    """Hashes of SAMPLE_BITS bits below this draw about ``per_language`` of ``size`` rows; whole numbers, never 0."""
    return max(1, min(1 << SAMPLE_BITS, (per_language << SAMPLE_BITS) // size))


def train(documents: DataFrame, *, per_language: int = 1500, languages: int = 256, smoothing: float = 0.05) -> Model:
    """Trigram likelihoods per language from rows (text, lang) of a bounded sample."""
    docs = columns(documents, doc_id="long", text="string", lang="string")
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    frequent = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    sizes = {r["lang"]: r["count"] for r in frequent.collect()}
    names = sorted(sizes)
    if not names:
        return Model([], np.empty((1 << BITS, 0)))
    bars = [F.lit(v) for k in names for v in (k, sample_bar(per_language, sizes[k]))]
    bar = F.create_map(*[b.cast("long") if n % 2 else b for n, b in enumerate(bars)])
    drawn = docs.where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - SAMPLE_BITS) < F.try_element_at(bar, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, found = letter_table(), {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                sums = found.setdefault(lang, np.zeros(1 << BITS, np.int64))
                sums += np.bincount(trigrams(text.as_py(), letters), minlength=1 << BITS)
        for lang, sums in found.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype("i4")), pa.array(sums[at])], names=["lang", "gram", "n"]
            )

    counts = np.zeros((1 << BITS, len(names)))
    summed = drawn.select("text", "lang").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n"))
    for lang, gram, n in summed.toLocalIterator():  # at most 2^BITS rows per language
        counts[gram, names.index(lang)] = n
    used = counts.sum(0) > 0
    counts = counts[:, used] + smoothing
    return Model([n for n, u in zip(names, used, strict=True) if u], counts / counts.sum(0))


def identify(documents: DataFrame, model: Model, *, penalty: float = 3.0) -> DataFrame:
    """MIXTURES of every whole text."""
    known = documents.sparkSession.sparkContext.broadcast((model.languages, model.chance))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, model = letter_table(), Model(*known.value)
        for batch in batches:
            found = [model.predict(trigrams(t.as_py() or "", letters), penalty) for t in batch.column("text")]
            columns_ = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
            head = [batch.column("doc_id"), batch.column("held_out")]
            yield pa.RecordBatch.from_arrays([*head, *columns_], names=names)

    kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
    names = ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"]
    rows = columns(documents, doc_id="long", text="string").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predict, MIXTURES)


def keep_identified(documents: DataFrame, model: Model, *, penalty: float = 3.0) -> DataFrame:
    """The rows of ``documents`` whose language can be told; a missing ``lang`` is filled in. Nothing is shuffled."""
    known = documents.sparkSession.sparkContext.broadcast((model.languages, model.chance))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, model = letter_table(), Model(*known.value)
        for batch in batches:
            at, held = batch.schema.get_field_index("text"), batch.schema.get_field_index("lang")
            found = [model.predict(trigrams(t.as_py() or "", letters), penalty)[0] for t in batch.column(at)]
            filled = pc.coalesce(batch.column(held), pa.array(found, batch.column(held).type))
            yield batch.set_column(held, batch.schema.field(held), filled).filter(pa.array([f != UNDETERMINED for f in found]))

    return documents.mapInArrow(choose, documents.schema)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(documents, train(documents)).select("doc_id", "held_out", "lang_pred", "score")

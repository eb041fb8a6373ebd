"""Words and word pairs of many texts at a time, as integer codes in arrays: counts per set of texts, TF-IDF sums per description.

A text comes lower-cased. What else makes words of it is done here: for ASCII a whole batch at once, and each different token with
other characters once a slice (accents are folded, and what is no word character separates). Words of one character don't count; a
pair is two neighbours of those that do.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts of one text between which there is no pair are joined by this; neither ASCII nor a word's character.
BREAK = "\u2028"
SLICE_BYTES, SLICE_ROWS = 16 << 20, 4096
#: Counts of hash buckets leave a task in blocks of so many.
BLOCK = 1 << 14
MARK_BITS = 22
#: Rows of counts that a task holds to sum them up.
SUM_ROWS = 2_000_000


_ASCII_WORDS = bytes(c if c >= 128 or c == 95 or chr(c).isalnum() else 32 for c in range(256)).lower()


def _spaced_ascii(texts: pa.StringArray) -> pa.StringArray:
    """ASCII letters lower-cased, spaces instead of all ASCII that is in no word; other characters as they are."""
    valid, offsets, data = texts.buffers()
    data = pa.py_buffer((data.to_pybytes() if data else b"").translate(_ASCII_WORDS))
    return pa.StringArray.from_buffers(len(texts), offsets, data, valid, offset=texts.offset)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most SLICE_ROWS rows and SLICE_BYTES of ``text``, or one longer text."""
    for batch in batches:
        place = batch.schema.get_field_index("text")
        batch = batch.set_column(place, "text", _spaced_ascii(batch.column(place)))
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < len(batch):
            end = int(np.searchsorted(ends, before + SLICE_BYTES, "right"))
            end = min(max(end, at + 1), at + SLICE_ROWS, len(batch))
            yield batch.slice(at, end - at)
            at, before = end, int(ends[end - 1])


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists (none is null) and the list that each is in."""
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


class _Folds(dict):
    """What a character becomes in a word: its compatibility decomposition without marks, with spaces for what no word holds."""

    def __missing__(self, code: int) -> str:
        plain = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        plain = [c.lower() if c < "\x80" else c for c in plain]
        self[code] = "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in plain)
        return self[code]


_FOLDS = _Folds()


def _words_of(tokens: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(different words, places, start, times): token k holds ``times[k]`` words, at ``places`` from ``start[k]`` on."""
    sizes, chars = (f(tokens).to_numpy(zero_copy_only=False) for f in (pc.binary_length, pc.utf8_length))
    plain = (sizes == chars) & (chars > 1)
    times, other = plain.astype(np.int64), np.flatnonzero(sizes != chars)
    words = tokens.filter(pa.array(plain))
    if not len(other):
        return words, np.arange(len(words)), np.cumsum(times) - times, times
    found = [[w for w in token.translate(_FOLDS).split(" ") if len(w) > 1] for token in tokens.take(pa.array(other)).to_pylist()]
    times[other] = some = np.array([len(x) for x in found])
    start = np.cumsum(times) - times
    coded = pa.concat_arrays([words, pa.array([w for x in found for w in x], pa.string())]).dictionary_encode()
    code, places = coded.indices.to_numpy(), np.empty(times.sum(), np.int64)
    places[start[plain]] = code[: len(words)]
    places[np.repeat(start[other] - np.cumsum(some) + some, some) + np.arange(some.sum())] = code[len(words) :]
    return coded.dictionary, places, start, times


@dataclass
class Tokens:
    """The words of a slice in their order: each one's place in ``words`` and its text; ``linked`` are those with a next one."""

    words: pa.Array
    code: np.ndarray
    row: np.ndarray
    linked: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        pieces, row = _flat(pc.split_pattern(pc.fill_null(texts, ""), BREAK))
        tokens, piece = _flat(pc.split_pattern(pieces, " "))
        coded = tokens.dictionary_encode()
        words, places, start, times = _words_of(coded.dictionary)
        code = coded.indices.to_numpy()
        if len(times) and times.max() > 1:
            held = times[code]
            code = places[np.repeat(start[code] - np.cumsum(held) + held, held) + np.arange(held.sum())]
            piece = np.repeat(piece, held)
        else:
            held = times[code] > 0
            code, piece = places[start[code[held]]], piece[held]
        return cls(words, code, row[piece], np.flatnonzero(piece[1:] == piece[:-1]))

    @property
    def pairs(self) -> np.ndarray:
        """The code of each pair."""
        n = len(self.words)
        return n + self.code[self.linked] * n + self.code[self.linked + 1]

    def parts(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two words of pairs."""
        return np.divmod(code - len(self.words), max(len(self.words), 1))

    def spelled(self, code: np.ndarray) -> pa.Array:
        """The terms of ascending codes."""
        single = int(np.searchsorted(code, len(self.words)))
        a, b = self.parts(code[single:])
        pairs = pc.binary_join_element_wise(self.words.take(pa.array(a)), self.words.take(pa.array(b)), " ")
        return pa.concat_arrays([self.words.take(pa.array(code[:single])), pairs])

    def buckets(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash bucket of each different word and of each pair, the same in every slice."""
        valid, offsets, data = self.words.buffers()
        ends = np.frombuffer(offsets, np.int32)[self.words.offset : self.words.offset + len(self.words) + 1].astype(np.int64)
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.diff(ends)
        chars = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
        at = np.arange(len(chars)) - np.repeat(ends[:-1] - ends[0], sizes)
        powers = np.cumprod(np.full(sizes.max(), 0x9E3779B97F4A7C15, np.uint64))
        hashed = np.add.reduceat((chars + np.uint64(1)) * powers[at], ends[:-1] - ends[0])
        hashed = (hashed ^ (hashed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        hashed ^= hashed >> np.uint64(32)
        bucket = lambda x: ((x * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - bits)).astype(np.int64)
        first = hashed * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(1)
        return bucket(hashed), bucket(first[self.code[self.linked]] + hashed[self.code[self.linked + 1]])


@dataclass
class Terms:
    """Different (row, code, tf), ascending, of a slice; code: a word's place, or for a pair ``n + first * n + second``."""

    words: pa.Array
    row: np.ndarray
    code: np.ndarray
    tf: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Terms:
        tokens = Tokens.of(texts)
        n = len(tokens.words)
        span = n + n * n
        keys = np.concatenate([tokens.row * span + tokens.code, tokens.row[tokens.linked] * span + tokens.pairs])
        keys, tf = np.unique(keys, return_counts=True)
        row, code = np.divmod(keys, max(span, 1))
        return cls(tokens.words, row, code, tf)

    def parts(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two words of pairs."""
        return np.divmod(code - len(self.words), max(len(self.words), 1))


def slice_words(texts: pa.Array) -> pa.Array:
    """The different words of a slice."""
    return Tokens.of(texts).words


def leading_terms(set_ids: pa.Array, tokens: Tokens, max_terms: int) -> pa.RecordBatch:
    """(set_id, term, n) of about the ``max_terms`` terms that come most often in a slice's texts of each set, if more than once."""
    known, place = np.unique(set_ids.to_numpy(zero_copy_only=False), return_inverse=True)
    span = max(len(tokens.words) * (len(tokens.words) + 1), 1)
    keys = np.concatenate([place[tokens.row] * span + tokens.code, place[tokens.row[tokens.linked]] * span + tokens.pairs])
    keys, n = np.unique(keys, return_counts=True)
    keys, n = keys[n > 1], n[n > 1]
    edges = np.searchsorted(keys, np.arange(len(known) + 1) * span)
    kept = [np.zeros(0, np.int64)]
    for start, end in zip(edges, edges[1:], strict=False):
        some = n[start:end]
        if len(some) > max_terms:
            least = np.partition(some, len(some) - max_terms)[len(some) - max_terms]
            some = some > least if np.count_nonzero(some >= least) > 2 * max_terms else some >= least
        kept.append(start + np.flatnonzero(some))
    kept = np.concatenate(kept)
    at, code = np.divmod(keys[kept], span)
    order = np.argsort(code, kind="stable")
    return pa.RecordBatch.from_arrays([pa.array(known[at[order]], pa.int64()), tokens.spelled(code[order]), pa.array(n[kept][order], pa.int64())], names=["set_id", "term", "n"])


def add_buckets(totals: np.ndarray, classes: np.ndarray, tokens: Tokens) -> None:
    """Add how often the texts of each class (bit k of ``classes``: the text is in class k) hold the terms of each bucket."""
    words, pairs = tokens.buckets(totals.shape[1].bit_length() - 1)
    row = tokens.row[tokens.linked]
    for k, total in enumerate(totals):
        member = (classes >> k & 1).astype(bool)
        if member.any():
            np.add.at(total, words, np.bincount(tokens.code[member[tokens.row]], minlength=len(tokens.words)).astype(total.dtype))
            total += np.bincount(pairs[member[row]], minlength=len(total)).astype(total.dtype)


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of one byte, up to 254: no count has a higher level than a larger one."""
    return np.where(counts > 0, np.minimum(1 + 8 * np.log2(np.maximum(counts, 1)), 254), 0).astype(np.uint8)


def likely_counts(set_ids: pa.Array, bounds: pa.Array, texts: pa.Array, heat: np.ndarray) -> pa.RecordBatch:
    """(set_id, term, cf, df) over the texts of a slice, of the terms whose bucket has in some class of ``heat`` the level of the
    text's bound there; a negative bound is of no class of the text."""
    tokens = Tokens.of(texts)
    known, place = np.unique(set_ids.to_numpy(zero_copy_only=False), return_inverse=True)
    least = bounds.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(heat))
    least = np.where(least < 0, 255, levels(least))
    words, pairs = tokens.buckets(heat.shape[1].bit_length() - 1)
    row = tokens.row[tokens.linked]
    of_word, of_pair = np.zeros(len(tokens.row), bool), np.zeros(len(row), bool)
    for of_class, hot in zip(least.T, heat, strict=True):
        if (of_class < 255).any():
            of_word |= hot[words][tokens.code] >= of_class[tokens.row]
            of_pair |= hot[pairs] >= of_class[row]
    row = np.concatenate([tokens.row[of_word], row[of_pair]])
    code = np.concatenate([tokens.code[of_word], tokens.pairs[of_pair]])
    span = max(len(tokens.words) * (len(tokens.words) + 1), 1)
    keys, cf = np.unique(place[row] * span + code, return_counts=True)
    rows = np.sort(row * span + code)  # np.unique without counts is several times slower
    row, code = np.divmod(rows[np.append(True, rows[1:] != rows[:-1])[: len(rows)]], span)
    df = np.unique(place[row] * span + code, return_counts=True)[1]
    at, code = np.divmod(keys, span)
    order = np.argsort(code, kind="stable")
    columns = [pa.array(known[at[order]], pa.int64()), tokens.spelled(code[order]), pa.array(cf[order], pa.int64()), pa.array(df[order], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["set_id", "term", "cf", "df"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per (set_id, term) of the other columns, over SUM_ROWS rows at a time."""
    held, rows = [], 0

    def added() -> Iterator[pa.RecordBatch]:
        names = held[0].schema.names
        table = pa.Table.from_batches(held)
        if len(held) > 1:
            table = table.group_by(names[:2]).aggregate([(name, "sum") for name in names[2:]]).rename_columns(names)
        yield from table.to_batches(max_chunksize=1 << 16)

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows > SUM_ROWS:
            yield from added()
            held, rows = [], 0
    if held:
        yield from added()


def set_words(set_ids: pa.Array, texts: pa.Array, max_terms: int) -> Iterator[pa.RecordBatch]:
    """(set_id, word, n) of the texts of a slice, how often they hold the word; with a null word, n is how often the slice holds
    the set's term that is the ``max_terms``-th in frequency (1 if there are fewer)."""
    terms = Terms.of(texts)
    known, place = np.unique(set_ids.to_numpy(zero_copy_only=False), return_inverse=True)
    n = len(terms.words)
    span = max(n + n * n, 1)
    keys = place[terms.row] * span + terms.code
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    cf = np.add.reduceat(terms.tf[order], first) if len(first) else first
    at, code = np.divmod(keys[first], span)
    bounds = np.ones(len(known), np.int64)
    edges = np.searchsorted(at, np.arange(len(known) + 1))
    for k, (start, end) in enumerate(zip(edges, edges[1:], strict=False)):
        if end - start >= max_terms:
            bounds[k] = np.partition(cf[start:end], end - start - max_terms)[end - start - max_terms]
    single = code < n
    batch = lambda ids, words, counts: pa.RecordBatch.from_arrays([pa.array(ids), words, pa.array(counts.astype(np.int64))], names=["set_id", "word", "n"])
    yield batch(known, pa.nulls(len(known), pa.string()), bounds)
    yield batch(known[at[single]], terms.words.take(pa.array(code[single])), cf[single])


def set_counts(set_ids: pa.Array, texts: pa.Array, words: pa.Array | None) -> pa.RecordBatch:
    """(set_id, term, cf, df) over the texts of a slice.

    With ``words``, in ascending order, terms with other words are left out, and a term is ``first << 32 | second + 1`` (a single word's second is 0) by their
    places there. That has the order of the terms themselves, because no character of a word is as small as the space.
    """
    terms = Terms.of(texts)
    known, place = np.unique(set_ids.to_numpy(zero_copy_only=False), return_inverse=True)
    n = len(terms.words)
    span = max(n + n * n, 1)
    keys = place[terms.row] * span + terms.code
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    cf = np.add.reduceat(terms.tf[order], first) if len(first) else first
    df = np.diff(np.append(first, len(keys)))
    at, code = np.divmod(keys[first], span)
    single = code < n
    a, b = terms.parts(code[~single])
    listed = slice(None)
    if words is None:
        pairs = pc.binary_join_element_wise(terms.words.take(pa.array(a)), terms.words.take(pa.array(b)), " ")
        written = pa.concat_arrays([terms.words.take(pa.array(code[single])), pairs])
    else:
        ids = pc.fill_null(pc.index_in(terms.words, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([ids[code[single]], ids[b]])
        written = np.concatenate([ids[code[single]] << 32, ids[a] << 32 | ids[b] + 1])
        listed = (ends >= 0) & (written >= 0)
        written = pa.array(written[listed])
    by_kind = lambda x: pa.array(np.concatenate([x[single], x[~single]])[listed].astype(np.int64))
    return pa.RecordBatch.from_arrays([by_kind(known[at]), written, by_kind(cf), by_kind(df)], names=["set_id", "term", "cf", "df"])


@dataclass
class Weights:
    """The vocabularies of some descriptions: ``of_jd`` has (places in ``codes``, idf, own weight, how often listed) of each, and
    ``marks`` is true where a code of theirs is hashed to."""

    words: pa.Array
    codes: np.ndarray
    of_jd: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    marks: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Weights:
        """From (jd_id, term, idf, jd_weight)."""
        if not rows.num_rows:
            return cls(pa.array([], pa.string()), np.zeros(0, np.int64), {}, np.zeros(0, bool))
        column = lambda name: pa.concat_arrays(rows.column(name).chunks)
        parts, _ = _flat(split := pc.split_pattern(column("term"), " "))
        coded = parts.dictionary_encode()
        place, starts = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
        n, pair = len(coded.dictionary), np.diff(starts) == 2
        code = place[starts[:-1]]
        code[pair] = n + code[pair] * n + place[starts[:-1][pair] + 1]
        codes, at = np.unique(code, return_inverse=True)
        jds = column("jd_id").dictionary_encode()
        jd, idf, own = jds.indices.to_numpy(), column("idf").to_numpy(), column("jd_weight").to_numpy()
        order = np.argsort(jd, kind="stable")
        of_jd = {}
        for name, some in zip(jds.dictionary.to_pylist(), np.split(order, np.flatnonzero(np.diff(jd[order])) + 1), strict=True):
            places, first, times = np.unique(at[some], return_index=True, return_counts=True)
            of_jd[name] = (places.astype(np.int32), idf[some][first], own[some][first], times.astype(float))
        marks = np.zeros(1 << MARK_BITS, bool)
        marks[cls.mark(codes)] = True
        return cls(coded.dictionary, codes, of_jd, marks)

    def parts(self) -> tuple:
        """For a broadcast: workers have no class of this name to load."""
        return self.words, self.codes, self.of_jd, self.marks

    def found(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different (row, place in ``codes``, tf), ascending, of a slice, of the terms that some description has."""
        if not len(self.codes):
            return (np.zeros(0, np.int64),) * 3
        known = pc.fill_null(pc.index_in(tokens.words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        word, n = known[tokens.code], len(self.words)
        first, second = word[tokens.linked], word[tokens.linked + 1]
        listed = np.flatnonzero((first >= 0) & (second >= 0))
        pair = n + first[listed] * n + second[listed]
        some = self.marks[self.mark(pair)]  # few pairs that no description has are searched for
        of_word, of_pair = self.place(known)[tokens.code], self.place(pair[some])
        row = np.concatenate([tokens.row[of_word >= 0], tokens.row[tokens.linked[listed[some][of_pair >= 0]]]])
        place = np.concatenate([of_word[of_word >= 0], of_pair[of_pair >= 0]])
        keys, tf = np.unique(row * len(self.codes) + place, return_counts=True)
        return *np.divmod(keys, len(self.codes)), tf

    def place(self, code: np.ndarray) -> np.ndarray:
        """The place in ``codes``, -1 for those that are not there."""
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, at, -1)

    @staticmethod
    def mark(code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def slice_scores(part: pa.RecordBatch, weights: Weights, others: set[str] | None) -> pa.RecordBatch:
    """(jd_id, text_id, dot, squares) of a slice (text_id, jd_ids, text) and the descriptions in ``weights``.

    Of other descriptions only those not in ``others`` give rows, of zeros; with None no other does.
    """
    row, place, tf = weights.found(Tokens.of(part.column("text")))
    tf = 1.0 + np.log(tf)
    bounds = np.searchsorted(row, np.arange(len(part) + 1))
    listed = part.column("jd_ids")
    jds, owner = _flat(pa.array([], listed.type) if not len(listed) else pc.if_else(listed.is_valid(), listed, pa.scalar([], listed.type)))
    jds = jds.dictionary_encode()
    idf, own, times = (np.zeros(len(weights.codes)) for _ in range(3))
    names, rows, dots, squares = [], [], [], []
    for n, name in enumerate(jds.dictionary.to_pylist()):
        if name not in weights.of_jd and (others is None or name in others):
            continue
        of_jd = owner[jds.indices.to_numpy() == n]
        different, lists = np.unique(of_jd, return_counts=True)
        dot = square = np.zeros(len(different))
        if name in weights.of_jd:
            some, *values = weights.of_jd[name]
            for dense, value in zip((idf, own, times), values, strict=True):
                dense[some] = value
            sizes = bounds[different + 1] - bounds[different]
            local = np.repeat(np.arange(len(different)), sizes)
            at = np.repeat(bounds[different] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(local))
            at_place = place[at]
            weight = tf[at] * idf[at_place]
            of_weight = weight * times[at_place]
            dot = np.bincount(local, of_weight * own[at_place], len(different)) * lists
            square = np.bincount(local, of_weight * weight, len(different)) * lists
            for dense in (idf, own, times):
                dense[some] = 0.0
        names.append(np.full(len(of_jd), n))
        rows.append(np.repeat(different, lists))
        dots.append(np.repeat(dot, lists))
        squares.append(np.repeat(square, lists))
    whole = lambda some, kind: np.concatenate(some).astype(kind) if some else np.zeros(0, kind)
    return pa.RecordBatch.from_arrays(
        [
            jds.dictionary.take(pa.array(whole(names, np.int64))), part.column("text_id").take(pa.array(whole(rows, np.int64))),
            pa.array(whole(dots, float)), pa.array(whole(squares, float)),
        ],
        names=["jd_id", "text_id", "dot", "squares"],
    )

"""Toxicity by a bidirectional gated recurrent network, trained and run in numpy.

A run of word characters is cut into words of at most ``WORD_CHARS`` characters, so that the network reads all of a text
without blanks too. A word's input is an embedding of the word (known words only) and the last states of a bidirectional recurrent network
over its characters. A second bidirectional network runs over the words of a window; attention pools its states.
Every text is scored on all windows of ``WINDOW`` words, ``STRIDE`` apart; its score is that of the worst window.

Training sees labelled rows that aren't held out: at most ``per_label`` documents of each label (the smallest hashes of
their ids) and at most ``train_windows`` windows of each. A document's label belongs to its worst window, so each step
learns from the window that the network of that moment finds worst.

At scoring time a word's share of the network (characters, embedding, input weights) is computed once per task and kept
in a bounded table; only the recurrence runs per position.

Defined cases: a null or empty text (or one without words) gets the network's score of an empty window; a null id is
held out; a document with several labels is toxic if one of them says so; repeated rows are scored each; without
labelled rows of both kinds every score is the share of toxic rows (0 without rows).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterank.llm.common import columns, held_out

WINDOW, STRIDE = 64, 32
WORD_CHARS = 16  #: characters of a word at most; longer runs are several words
CHAR_CODES = 192
EMBED, CHAR_EMBED, CHAR_HIDDEN, HIDDEN = 8, 10, 10, 8
TABLE_WORDS = 150_000  #: words a task keeps
WORD = re.compile(rf"\w{{1,{WORD_CHARS}}}")
SCORES = "doc_id long, held_out boolean, score double, worst_window long"


def split_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window_starts(n: int) -> list[int]:
    """Starts of all windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def char_codes(words: list[str]) -> np.ndarray:
    """word x WORD_CHARS codes from 1; 0 is no character. ASCII has own codes, others share the rest."""
    raw = np.frombuffer("".join(w.ljust(WORD_CHARS, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(raw < 128, raw, 128 + raw % (CHAR_CODES - 128)).astype(np.int32)
    return codes.reshape(len(words), WORD_CHARS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over time and rows of the outer products of the last axes."""
    return a.reshape(-1, a.shape[-1]).T @ b.reshape(-1, b.shape[-1])


def gru_forward(x: np.ndarray, u: np.ndarray, b: np.ndarray, valid: np.ndarray, keep: bool):
    """States (time, row, hidden) from projected inputs (time, row, 3 * hidden); rows past their end keep their state."""
    steps, rows, wide = x.shape
    n = wide // 3
    h = np.zeros((rows, n), np.float32)
    states, memory = np.empty((steps, rows, n), np.float32), []
    for t in range(steps):
        pre = h @ u
        gates = sigmoid(x[t, :, : 2 * n] + pre[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        m = pre[:, 2 * n :] + b
        new = np.tanh(x[t, :, 2 * n :] + r * m)
        nxt = new + z * (h - new)
        if keep:
            memory.append((h, z, r, m, new))
        if valid is not None and not valid[t].all():
            nxt = np.where(valid[t][:, None], nxt, h)
        h = states[t] = nxt
    return states, memory


def gru_backward(dstates: np.ndarray, memory: list, u: np.ndarray, valid: np.ndarray):
    """Gradients of projected inputs, recurrent weights and bias; ``dstates`` are those of every state."""
    steps, rows, n = dstates.shape
    dx, du, db = np.zeros((steps, rows, 3 * n), np.float32), np.zeros_like(u), np.zeros(n, np.float32)
    carry = np.zeros((rows, n), np.float32)
    for t in reversed(range(steps)):
        h, z, r, m, new = memory[t]
        grad = dstates[t] + carry
        live = grad * valid[t][:, None]
        carry = grad - live + live * z
        da = live * (1 - z) * (1 - new * new)
        gate = np.concatenate([live * (h - new) * z * (1 - z), da * m * r * (1 - r)], 1)
        pre = np.concatenate([gate, da * r], 1)
        dx[t] = np.concatenate([gate, da], 1)
        du += h.T @ pre
        db += (da * r).sum(0)
        carry = carry + pre @ u.T
    return dx, du, db


@dataclass
class Network:
    known: dict[str, int] = field(default_factory=dict)  #: word: row of the embedding, from 1; row 0 is for others
    w: dict[str, np.ndarray] = field(default_factory=dict)
    base: float = 0.0  #: the score where nothing could be learned

    @staticmethod
    def start(known: dict[str, int], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        shape = {
            "embed": (len(known) + 1, EMBED),
            "char": (CHAR_CODES, CHAR_EMBED),
            "score": (2 * HIDDEN, 1),
            "attend": (2 * HIDDEN, HIDDEN),
            "query": (HIDDEN, 1),
        }
        for side in "fb":
            shape |= {
                f"cw{side}": (CHAR_EMBED, 3 * CHAR_HIDDEN),
                f"cu{side}": (CHAR_HIDDEN, 3 * CHAR_HIDDEN),
                f"w{side}": (EMBED + 2 * CHAR_HIDDEN, 3 * HIDDEN),
                f"u{side}": (HIDDEN, 3 * HIDDEN),
            }
        w = {k: rng.normal(0, 1 / np.sqrt(max(4, s[0] if len(s) > 1 and k not in ("embed", "char") else 4)), s) for k, s in shape.items()}
        zeros = {"score0": 1, "attend0": HIDDEN}
        for side in "fb":
            zeros |= {f"cx{side}": 3 * CHAR_HIDDEN, f"cb{side}": CHAR_HIDDEN, f"x{side}": 3 * HIDDEN, f"b{side}": HIDDEN}
        w |= {k: np.zeros(n) for k, n in zeros.items()}
        return Network(known, {k: v.astype(np.float32) for k, v in w.items()})

    def word_inputs(self, words: list[str], keep: bool = False):
        """word x (embedding and character states)."""
        w, codes = self.w, char_codes(words)
        size = np.maximum(1, (codes > 0).sum(1))
        steps = int(size.max()) if len(words) else 0
        valid = np.arange(steps)[:, None] < size[None, :]
        flip = np.clip(size[None, :] - 1 - np.arange(steps)[:, None], 0, None)
        ends, kept = [], {}
        for side in "fb":
            at = codes[:, :steps].T if side == "f" else np.take_along_axis(codes[:, :steps].T, flip, 0)
            e = w["char"][at]
            states, memory = gru_forward(e @ w[f"cw{side}"] + w[f"cx{side}"], w[f"cu{side}"], w[f"cb{side}"], valid, keep)
            ends.append(states[-1])
            kept[side] = (at, e, memory)
        rows = np.fromiter((self.known.get(x, 0) for x in words), np.int64, len(words))
        return np.concatenate([w["embed"][rows], *ends], 1), (rows, valid, kept)

    def pool(self, fwd: np.ndarray, bwd: np.ndarray, valid: np.ndarray):
        """Attention over the states of both directions; the chance of label 1."""
        w = self.w
        h = np.concatenate([fwd, bwd], 2)
        u = np.tanh(h @ w["attend"] + w["attend0"])
        s = np.where(valid, (u @ w["query"])[..., 0], np.float32(-1e9))
        a = np.exp(s - s.max(0, keepdims=True)) * valid
        a /= np.maximum(a.sum(0, keepdims=True), np.float32(1e-9))
        pooled = (a[..., None] * h).sum(0)
        return sigmoid((pooled @ w["score"])[:, 0] + w["score0"][0]), (h, u, a, pooled)

    def table(self, words: list[str]) -> np.ndarray:
        """word x projected inputs of both directions: all of the network that doesn't depend on the position."""
        x, _ = self.word_inputs(words)
        return np.concatenate([x @ self.w["wf"] + self.w["xf"], x @ self.w["wb"] + self.w["xb"]], 1).astype(np.float32)

    def score(self, table: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Scores of windows given as word rows (window x time, any value past the size)."""
        steps = int(size.max()) if len(size) else 0
        if not steps:
            return np.full(len(size), sigmoid(self.w["score0"])[0])
        valid = np.arange(steps)[:, None] < size[None, :]
        flip = np.clip(size[None, :] - 1 - np.arange(steps)[:, None], 0, None)
        n, at = 3 * HIDDEN, ids[:, :steps].T
        fwd, _ = gru_forward(table[at, :n], self.w["uf"], self.w["bf"], valid, False)
        back, _ = gru_forward(table[np.take_along_axis(at, flip, 0), n:], self.w["ub"], self.w["bb"], valid, False)
        bwd = np.take_along_axis(back, flip[..., None], 0)
        return self.pool(fwd, bwd, valid)[0]

    def gradients(self, windows: list[list[str]], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of the windows and its gradients."""
        w = self.w
        words = sorted({x for win in windows for x in win})
        number = {x: i for i, x in enumerate(words)}
        inputs, (rows, cvalid, ckept) = self.word_inputs(words, True)
        size = np.array([len(x) for x in windows])
        steps = int(size.max())
        ids = np.array([[number[x] for x in win] + [0] * (steps - len(win)) for win in windows])
        valid = np.arange(steps)[:, None] < size[None, :]
        flip = np.clip(size[None, :] - 1 - np.arange(steps)[:, None], 0, None)
        at = {"f": ids.T, "b": np.take_along_axis(ids.T, flip, 0)}
        runs = {s: gru_forward(inputs[at[s]] @ w[f"w{s}"] + w[f"x{s}"], w[f"u{s}"], w[f"b{s}"], valid, True) for s in "fb"}
        bwd = np.take_along_axis(runs["b"][0], flip[..., None], 0)
        p, (h, u, a, pooled) = self.pool(runs["f"][0], bwd, valid)
        loss = float(-np.mean(np.log(np.where(labels == 1, p, 1 - p) + 1e-7)))
        d = ((p - labels) / len(labels)).astype(np.float32)[:, None]
        g = {"score": pooled.T @ d, "score0": d.sum(0)}
        dpool = d @ w["score"].T
        da = (dpool[None] * h).sum(2)
        ds = a * (da - (a * da).sum(0, keepdims=True))
        du = ds[..., None] * w["query"][:, 0] * (1 - u * u)
        g |= {"query": outer(u, ds[..., None]), "attend": outer(h, du), "attend0": du.sum((0, 1))}
        dh = a[..., None] * dpool[None] + du @ w["attend"].T
        dback = np.zeros_like(bwd)
        np.put_along_axis(dback, np.broadcast_to(flip[..., None], dback.shape), dh[..., HIDDEN:] * valid[..., None], 0)
        # positions past the end share target 0 with the last valid one: put the valid ones again
        first = dh[..., HIDDEN:][size - 1, np.arange(len(size))]
        dback[0] = first
        dinputs = np.zeros_like(inputs)
        for s, dstates in (("f", dh[..., :HIDDEN] * valid[..., None]), ("b", dback * valid[..., None])):
            dx, g[f"u{s}"], g[f"b{s}"] = gru_backward(dstates, runs[s][1], w[f"u{s}"], valid)
            g[f"w{s}"] = outer(inputs[at[s]], dx)
            g[f"x{s}"] = dx.sum((0, 1))
            np.add.at(dinputs, at[s], dx @ w[f"w{s}"].T)
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], rows, dinputs[:, :EMBED])
        g["char"] = np.zeros_like(w["char"])
        for k, s in enumerate("fb"):
            codes, e, memory = ckept[s]
            dstates = np.zeros((len(cvalid), len(words), CHAR_HIDDEN), np.float32)
            low = EMBED + k * CHAR_HIDDEN
            dstates[-1] = dinputs[:, low : low + CHAR_HIDDEN]
            dx, g[f"cu{s}"], g[f"cb{s}"] = gru_backward(dstates, memory, w[f"cu{s}"], cvalid)
            g[f"cw{s}"] = outer(e, dx)
            g[f"cx{s}"] = dx.sum((0, 1))
            np.add.at(g["char"], codes, dx @ w[f"cw{s}"].T)
        return loss, g


def fit(texts: list[list[list[str]]], labels: list[int], *, steps: int = 420, batch: int = 16, rate: float = 0.015, seed: int = 7) -> Network:
    """Train on documents given as lists of windows (lists of words)."""
    labels = np.asarray(labels)
    sides = [np.flatnonzero(labels == k) for k in (0, 1)]
    if not len(sides[0]) or not len(sides[1]):
        return Network(base=float(labels.mean()) if len(labels) else 0.0)
    seen = Counter(x for doc in texts for x in {x for win in doc for x in win})
    net = Network.start({x: i + 1 for i, x in enumerate(sorted(x for x, n in seen.items() if n >= 5))}, seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, steps + 1):
        drawn = np.concatenate([rng.choice(s, batch) for s in sides])
        options = [[win for win in texts[i] if win] or [["\0"]] for i in drawn]
        if step <= 60:  # before the network knows anything, any window
            chosen = [o[rng.integers(len(o))] for o in options]
        else:
            options = [o if len(o) <= 6 else [o[i] for i in rng.choice(len(o), 6, replace=False)] for o in options]
            flat = [win for o in options for win in o]
            words = sorted({x for win in flat for x in win})
            number = {x: i for i, x in enumerate(words)}
            size = np.array([len(x) for x in flat])
            ids = np.array([[number[x] for x in win] + [0] * (int(size.max()) - len(win)) for win in flat])
            scores, at, chosen = net.score(net.table(words), ids, size), 0, []
            for o in options:
                chosen.append(o[int(scores[at : at + len(o)].argmax())])
                at += len(o)
        _, grads = net.gradients(chosen, labels[drawn])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(
    documents: DataFrame, labels: DataFrame, *, per_label: int = 1200, train_windows: int = 16, steps: int = 420
) -> Network:
    """Fit on a bounded sample of labelled documents that aren't held out."""
    marked = columns(labels, doc_id="long", toxic="int").where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    few = [marked.where(test).orderBy(order, "doc_id").limit(per_label) for test in ("toxic > 0", "toxic <= 0")]
    sample = few[0].unionByName(few[1])  # 2 * per_label rows at most: small enough to broadcast at any size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wins = []
            for text in batch.column("text"):
                words = split_words(text.as_py())
                starts = window_starts(len(words))
                starts = starts[:: -(-len(starts) // train_windows)]
                wins.append([words[a : a + WINDOW] for a in starts])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(wins, pa.list_(pa.list_(pa.string())))], names=["toxic", "wins"])

    rows = (
        columns(documents, doc_id="long", text="string")
        .where("text IS NOT NULL")
        .join(F.broadcast(sample), "doc_id")
        .select("toxic", "text", F.xxhash64("doc_id", "text").alias("at"))
        .orderBy("at")
        .limit(4 * per_label)
        .select("toxic", "text")
        .mapInArrow(cut, "toxic int, wins array<array<string>>")
        .toArrow()
    )
    return fit(rows["wins"].to_pylist(), [int(t > 0) for t in rows["toxic"].to_pylist()], steps=steps)


class Scorer:
    """Scores texts; keeps the rows of the words that it has met, up to TABLE_WORDS."""

    def __init__(self, net: Network):
        self.net, self.rows, self.table = net, {}, np.empty((0, 6 * HIDDEN), np.float32)

    def learn(self, words: set[str]) -> None:
        new = [x for x in words if x not in self.rows]
        if len(self.rows) + len(new) > TABLE_WORDS:
            self.rows, self.table, new = {}, self.table[:0], list(words)
        parts = [self.table]
        for at in range(0, len(new), 8192):
            parts.append(self.net.table(new[at : at + 8192]))
        base = len(self.rows)
        self.rows.update((x, base + i) for i, x in enumerate(new))
        self.table = np.concatenate(parts)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The worst window's score of each text, and its start in words."""
        starts_of, owners = [], []
        split = [split_words(t) for t in texts]
        self.learn(set().union(*split))
        windows, sizes = [], []
        for k, words in enumerate(split):
            ids = np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))
            for a in window_starts(len(words)):
                windows.append(ids[a : a + WINDOW])
                sizes.append(len(windows[-1]))
                owners.append(k)
                starts_of.append(a)
        size, owner, start = np.array(sizes), np.array(owners), np.array(starts_of)
        grid = np.zeros((len(windows), WINDOW), np.int32)
        for i, ids in enumerate(windows):
            grid[i, : len(ids)] = ids
        got = np.empty(len(windows), np.float32)
        order = np.argsort(size, kind="stable")
        for at in range(0, len(order), 1024):
            part = order[at : at + 1024]
            got[part] = self.net.score(self.table, grid[part], size[part])
        best = np.lexsort((start, -got, owner))
        first = best[np.searchsorted(owner[best], np.arange(len(texts)))]
        return got[first].astype(float), start[first]


def score_documents(documents: DataFrame, net: Network, *, group_chars: int = 2_000_000) -> DataFrame:
    """SCORES of every whole text; a task holds the windows of about ``group_chars`` characters, or of one longer text."""
    known = documents.sparkSession.sparkContext.broadcast((net.known, net.w, net.base))

    def groups(texts: list[str]) -> Iterator[list[str]]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= group_chars:
                yield held
                held, size = [], 0
        if held:
            yield held

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*known.value)
        scorer = Scorer(net) if net.w else None
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            if scorer:
                parts = [scorer.scores(g) for g in groups(texts)]
                value, start = (np.concatenate(c) for c in zip(*parts, strict=True))
            else:
                value, start = np.full(len(texts), net.base), np.zeros(len(texts), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array(start.astype(np.int64))],
                names=["doc_id", "held_out", "score", "worst_window"],
            )

    rows = columns(documents, doc_id="long", text="string")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, SCORES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; 1 from a score of 0.7."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(documents, net)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

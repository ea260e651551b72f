"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes (2 and 3 characters at either end), its character n-grams (1 to 3), and, for each
language, whether the word is in that language's lexicon; they are hashed to BUCKETS weights a language. Transitions
between the languages of neighbouring words are learned too. Training maximises the conditional likelihood with
forward-backward gradients on sequences made of lines of several languages, so that code switches are seen. Prediction
runs forward-backward over every word of a text; a document's language has the largest mean posterior over its words
that hold a letter, which is also the score.

The model is fitted on a bounded sample: for each language the TRAIN_DOCS labelled documents of least hash, and of all
their runs of TRAIN_WORDS words the TRAIN_RUNS of least hash, wherever in a text they stand. Prediction takes whole
texts. Neither the language, source nor id of a document is an input of its prediction. identify_words labels the words
of code-switched text one by one.

Defined cases: null text and text without a letter give `und` with score 0; without any labelled row all texts give
`und`; documents without doc_id are not trained on and not held out; ties go to the language first in order; repeated
rows give repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineproof.llm.shared import batch, sliced

TRAIN_DOCS = 240
TRAIN_RUNS = 1500
TRAIN_WORDS = 40
LEXICON_WORDS = 300
BUCKETS = 1 << 16
EPOCHS = 12
RATE = 0.3
RUNS_EACH = 6
CACHE_ROWS, LEARN_ROWS = 150_000, 8192
UNKNOWN = "und"


def ngram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word numbers) of the affix and n-gram features of words, all by array operations."""
    text = "\n" + "\n".join(words) + "\n"
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    brk = c == 10
    word = np.cumsum(brk) - 1
    found, owner = [], []

    def add(values: np.ndarray, keep: np.ndarray, kind: int) -> None:
        with np.errstate(over="ignore"):
            h = (values + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((h[keep] >> np.uint64(48)).astype(np.int64) % BUCKETS)
        owner.append(word[: len(values)][keep])

    with np.errstate(over="ignore"):
        two = c[:-1] * np.uint64(1_000_003) + c[1:]
        three = two[:-1] * np.uint64(1_000_003) + c[2:]
        four = three[:-1] * np.uint64(1_000_003) + c[3:]
    add(c, ~brk, 1)
    add(two, ~brk[:-1] & ~brk[1:], 2)
    add(three, ~brk[:-2] & ~brk[1:-1] & ~brk[2:], 3)
    # Affixes: n-grams that hold the word break at one end.
    add(three, brk[:-2] & ~brk[1:-1] & ~brk[2:], 4)
    add(four, brk[:-3] & ~brk[1:-2] & ~brk[2:-1] & ~brk[3:], 5)
    ends = [~brk[:-2] & ~brk[1:-1] & brk[2:], ~brk[:-3] & ~brk[1:-2] & ~brk[2:-1] & brk[3:]]
    add(three, ends[0], 6)
    add(four, ends[1], 7)
    return np.concatenate(found), np.concatenate(owner)


WORD = re.compile(r"\S+")


def words_of(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages)
    lexicons: list[frozenset[str]]
    lexicon_weights: np.ndarray  # (lexicons, languages)
    transitions: np.ndarray  # (from, to)
    start: np.ndarray
    place: dict[str, int] = field(default_factory=dict, repr=False)
    held: np.ndarray | None = field(default=None, repr=False)  # potentials and whether there is a letter, a row a cached word

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (words, languages)."""
        bucket, owner = ngram_features(words)
        out = np.empty((len(words), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, self.weights[bucket, k], len(words) + 1)[: len(words)]
        return out + self.in_lexicons(words) @ self.lexicon_weights

    def in_lexicons(self, words: list[str]) -> np.ndarray:
        return np.array([[w in lex for lex in self.lexicons] for w in words], float).reshape(len(words), len(self.lexicons))

    def learn(self, words: set[str]) -> None:
        """Afterwards the cache has every word; a full cache starts anew."""
        if len(self.place) > CACHE_ROWS or self.held is None:
            self.place, self.held = {}, np.empty((1024, len(self.languages) + 1), np.float32)
        known = len(self.place)
        new = [w for w in words if w not in self.place]
        if not new:
            return
        while len(self.held) < known + len(new):
            self.held = np.concatenate([self.held, np.empty_like(self.held)])
        for at in range(0, len(new), LEARN_ROWS):
            some = new[at : at + LEARN_ROWS]
            e = self.emissions(some)
            e = np.exp(e - e.max(1, keepdims=True)) + 1e-9
            letters = np.array([w.isalpha() or any(map(str.isalpha, w)) for w in some])
            e[~letters] = 1.0
            self.held[known + at : known + at + len(some)] = np.column_stack([e, letters])
        self.place.update(zip(new, range(known, known + len(new)), strict=True))

    def marginals(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(posteriors, whether the word holds a letter) of the words of all texts, with the texts' starts and lengths."""
        self.learn(set().union(*split))
        n, lengths = len(self.languages), np.array([len(s) for s in split], np.int64)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        table = self.held[at]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        found = posteriors(table[:, :n], starts, lengths, np.exp(self.transitions).astype(np.float32), np.exp(self.start).astype(np.float32))
        return found, table[:, n], starts, lengths

    def label(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, language, posterior) of every word with a letter, in characters of the text."""
        places = [[m.span() for m in WORD.finditer(t)] for t in texts]
        split = [[t[a:b].lower() for a, b in spans] for t, spans in zip(texts, places, strict=True)]
        found, letters, starts, _ = self.marginals(split)
        best = found.argmax(1)
        return [[(*span, self.languages[best[i]], float(found[i, best[i]])) for i, span in enumerate(spans, start) if letters[i]] for start, spans in zip(starts.tolist(), places, strict=True)]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        n = len(self.languages)
        marginals, counted, starts, lengths = self.marginals([words_of(t) for t in texts])
        full = lengths > 0
        total = np.zeros((len(texts), n + 1))
        total[full] = np.add.reduceat(np.column_stack([marginals * counted[:, None], counted]), starts[full], 0, np.float64) if full.any() else 0
        mean = total[:, :n] / np.maximum(total[:, n:], 1)
        best = mean.argmax(1)
        return [(self.languages[b], min(1.0, float(m[b]))) if has else (UNKNOWN, 0.0) for b, m, has in zip(best, mean, total[:, n], strict=True)]


def posteriors(potentials: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Word marginals by scaled forward-backward; sequences run side by side, the longest first, the ended ones leave.

    pairs, where given, receives the expected number of each transition: the sum over neighbours of their joint marginals.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left").tolist()
    if not active:
        return np.empty_like(potentials)
    # Step-major layout: the words of one step stand together, so a step reads and writes slices.
    base = np.concatenate([[0], np.cumsum(active)])
    at = np.concatenate([starts[:a] + t for t, a in enumerate(active)])
    pot = potentials[at]
    alpha, ones = np.empty_like(pot), np.ones(pot.shape[1], pot.dtype)
    now = pot[: active[0]] * start
    for t, a in enumerate(active):
        if t:
            now = (now[:a] @ trans) * pot[base[t] : base[t + 1]]
        now /= (now @ ones)[:, None]
        alpha[base[t] : base[t + 1]] = now
    beta, back = np.ones((0, pot.shape[1]), pot.dtype), np.ascontiguousarray(trans.T)
    for t in range(len(active) - 1, -1, -1):
        a, span = active[t], slice(base[t], base[t + 1])
        if a > len(beta):
            beta = np.concatenate([beta, np.ones((a - len(beta), pot.shape[1]), pot.dtype)])
        right = beta * pot[span]
        if pairs is not None and t:
            # Joint marginal of words t - 1 and t: alpha[t - 1] * trans * potential[t] * beta[t], normalised a sequence.
            joint = alpha[base[t - 1] : base[t - 1] + a, :, None] * trans * right[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        alpha[span] *= beta
        beta = right @ back
        beta /= (beta @ ones)[:, None]
    alpha /= (alpha @ ones)[:, None]
    out = np.empty_like(pot)
    out[at] = alpha
    return out


def train(rows: list[tuple[str, str]], seed: int = 1, epochs: int = EPOCHS) -> Crf:
    """rows: (language, run of words). Stochastic gradient steps with per-weight rates (AdaGrad) on batches of sequences."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in rows})
    n = len(languages)
    lines = [(languages.index(lang), w) for lang, text in rows if (w := words_of(text))]
    counts = [Counter(w for k, ws in lines if k == lang for w in ws) for lang in range(n)]
    lexicons = [frozenset(w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]) for c in counts]
    model = Crf(languages, np.zeros((BUCKETS, n)), lexicons, np.zeros((n, n)), np.zeros((n, n)), np.zeros(n))
    if not lines:
        return model
    vocabulary = sorted({w for _, ws in lines for w in ws})
    number = {w: i for i, w in enumerate(vocabulary)}
    bucket, owner = ngram_features(vocabulary)
    order = np.argsort(owner, kind="stable")
    bucket, ends = bucket[order], np.searchsorted(owner[order], np.arange(len(vocabulary) + 1))
    in_lexicons = model.in_lexicons(vocabulary)
    squares = [np.full(x.shape, 1e-6) for x in (model.weights, model.lexicon_weights, model.transitions, model.start)]
    for _ in range(epochs):
        mixed = rng.permutation(len(lines))
        for at in range(0, len(mixed), 32 * RUNS_EACH):
            some = mixed[at : at + 32 * RUNS_EACH]
            sequences = [[lines[j] for j in some[i : i + RUNS_EACH]] for i in range(0, len(some), RUNS_EACH)]
            ids = np.array([number[w] for seq in sequences for _, ws in seq for w in ws])
            gold = np.array([k for seq in sequences for k, ws in seq for _ in ws])
            lengths = np.array([sum(len(ws) for _, ws in seq) for seq in sequences])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            types, place = np.unique(ids, return_inverse=True)
            spans = [bucket[ends[i] : ends[i + 1]] for i in types]
            flat, own = np.concatenate(spans), np.repeat(np.arange(len(types)), [len(s) for s in spans])
            scores = np.stack([np.bincount(own, model.weights[flat, k], len(types)) for k in range(n)], 1) + in_lexicons[types] @ model.lexicon_weights
            pot = np.exp(scores - scores.max(1, keepdims=True))[place] + 1e-12
            trans = np.exp(model.transitions)
            expected = np.zeros((n, n))
            post = posteriors(pot, starts, lengths, trans, np.exp(model.start), expected)
            diff = -post
            diff[np.arange(len(gold)), gold] += 1
            by_type = np.stack([np.bincount(place, diff[:, k], len(types)) for k in range(n)], 1)
            inner = np.ones(len(ids), bool)
            inner[starts] = False
            right = np.flatnonzero(inner)
            seen = np.zeros((n, n))
            np.add.at(seen, (gold[right - 1], gold[right]), 1)
            grads = [
                np.stack([np.bincount(flat, by_type[own, k], BUCKETS) for k in range(n)], 1),
                in_lexicons[types].T @ by_type, seen - expected, np.bincount(gold[starts], minlength=n) - post[starts].sum(0),
            ]
            for w, g, s in zip((model.weights, model.lexicon_weights, model.transitions, model.start), grads, squares, strict=True):
                s += g * g
                w += RATE * g / np.sqrt(s) * (g != 0)
        model.transitions -= model.transitions.mean()
        np.clip(model.transitions, -6, 6, out=model.transitions)
    return model


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_ids(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())


def sample(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_runs: int = TRAIN_RUNS, train_words: int = TRAIN_WORDS) -> list[tuple[str, str]]:
    """(language, run of words) to fit on, of labelled documents that are not held out; both bounds hold a language."""
    fit = fit_ids(docs).filter(F.col("text").rlike(r"\p{L}"))
    least = lambda *by: F.row_number().over(Window.partitionBy("lang").orderBy(*by))
    # One count a language tells from which hash on a document cannot be among the least: few more than are taken move.
    counts = {r.lang: r["count"] for r in fit_ids(docs).groupBy("lang").count().collect()}
    if not counts:
        return []
    draw = F.xxhash64(F.col("doc_id").cast("string"))
    share = F.element_at(F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(4.0 * train_docs / n))]), F.col("lang"))
    near = F.shiftrightunsigned(draw, 24) < share * 2.0**40
    picked = fit.filter(near).select("doc_id", "lang", "text").withColumn("n", least(draw, "doc_id", "text")).filter(F.col("n") <= train_docs)
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / train_words)), lambda i: F.array_join(F.slice("w", (i * train_words + 1).cast("int"), train_words), " "))
    cut = picked.withColumn("w", words).select("doc_id", "lang", F.posexplode(runs).alias("place", "run"))
    kept = cut.withColumn("n", least(F.xxhash64("place", "doc_id", "run"), "doc_id", "place", "run")).filter(F.col("n") <= train_runs)
    return sorted((r.lang, r.run) for r in kept.select("lang", "run").collect())


def _predict(model: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 1 << 20):
            texts = [t or "" for t in b["text"].to_pylist()]
            found = model.predict(texts) if model.languages else [(UNKNOWN, 0.0)] * len(texts)
            cols = [*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "lang_pred", "lang_score"])

    return run


def _label(model: Crf):
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("score", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 1 << 20):
            texts = [t or "" for t in b["text"].to_pylist()]
            found = model.label(texts) if model.languages else [[]] * len(texts)
            yield batch(schema, doc_id=b["doc_id"], words=[[dict(zip(("start", "end", "lang", "score"), w, strict=True)) for w in words] for words in found])

    return run


def identify(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    told = identify_rows(docs.select("doc_id", "text", held_out().alias("held_out")), model or train(sample(docs)))
    return told.select(F.col("doc_id").cast("long"), "held_out", "lang_pred", F.col("lang_score").alias("score"))


def identify_words(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """(doc_id, words): places, language and posterior of each word that holds a letter; none for null texts."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_label(model or train(sample(docs))), "doc_id long, words array<struct<start: int, end: int, lang: string, score: double>>")


def identify_rows(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """docs with lang_pred and lang_score beside its own columns (own columns of these names give way)."""
    model = model or train(sample(docs))
    own = docs.drop("lang_pred", "lang_score")
    schema = T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return own.mapInArrow(_predict(model), schema)

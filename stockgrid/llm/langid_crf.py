"""Language ID: a linear-chain conditional random field over the words of a text.

Affix, character n-gram and lexicon features give each word a score per language; learned transitions tie neighbouring
words together, and forward-backward gives every word a posterior, so code-switched texts get a language per word.

* Fit: at most ``per_lang`` labelled documents per language, chosen by hash of ``doc_id``, and of each at most
  ``words_per_doc`` consecutive words. Of these, training draws ``per_lang_sequences`` sequences of 32 words for each
  language, 1,200 at least; the three bounds are the only sampling. Sequences splice runs from different
  documents, so transitions between languages are learned too.
* Predict: one streaming pass over whole texts, no shuffle. Memory is one Arrow batch and a bounded word cache.
* A run of over ``LONGEST`` letters (scripts without blanks) is several places of the chain, pieces of at most ``PIECE``
  letters: every letter is read, n-grams reach across the cuts, and the language may switch inside the run.

Null or letterless texts: ``und`` with score 0. Repeated rows are predicted alike. An empty training set gives ``und``
for everything. Ties go to the language that sorts first. Other columns are never read.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from stockgrid.llm.common import pick, position, remainder, slices, small_batches

LETTERS = re.compile(r"[^\W\d_]+")  # runs of letters and, rarely, of numerals that are no digits: see letter_words
SLOTS = 1 << 16
LONGEST, PIECE = 40, 10  # letters
CUT = "-"                # never a letter: marks the ends of a piece that are cuts
UNDETERMINED = "und"
SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()),
                   ("words", pa.int64())])

FOUND = StructType().add("lang_pred", "string").add("score", "double")


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, long ones in pieces."""
    found = LETTERS.findall(text.lower()) if text else []
    if not "".join(found).isalpha():
        found = [w for w in found if any(c.isalpha() for c in w)]
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [p for w in found for p in ([w] if len(w) <= LONGEST else [piece(w, a, b) for a, b in cuts(len(w))])]


def cuts(n: int) -> list[tuple[int, int]]:
    """Even pieces of a run of ``n`` letters, one if it is not long."""
    k = -(-n // PIECE) if n > LONGEST else 1
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


def piece(run: str, a: int, b: int) -> str:
    """Letters ``a`` to ``b`` of a run: ``CUT`` before them if others precede, ``CUT`` and the next two if others follow."""
    return (CUT if a else "") + run[a:b] + (CUT + run[b:b + 2] if b < len(run) else "")


@dataclass(frozen=True)
class LangModel:
    langs: tuple[str, ...]
    weights: np.ndarray      # feature slot x language
    transitions: np.ndarray  # language x language, log potentials
    lexicon: dict[str, int]  # frequent word -> bit set of languages

    def emissions(self, new_words: list[str]) -> np.ndarray:
        return summed(self.weights, *feature_slots(new_words, self.lexicon))


def feature_slots(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words' features, flat, and how many each word has: prefixes and suffixes of 1 to 3 letters, 2- and
    3-grams with word ends, and for lexicon words the word and its languages. A piece of a long run has the n-grams that
    start in it, and prefixes or suffixes only where the run itself begins or ends."""
    n = len(words)
    opens, ahead = np.ones(n, bool), np.zeros(n, np.int64)
    plain = words
    if any(CUT in x for x in words):
        opens = np.fromiter((x[0] != CUT for x in words), bool, n)
        ahead = np.fromiter((len(x) - 1 - x.rindex(CUT) if CUT in x[1:] else 0 for x in words), np.int64, n)
        plain = [x.replace(CUT, "") for x in words]
    closes = ahead == 0
    width = max(map(len, plain))
    letters = np.array(plain, dtype=f"U{width}").view(np.uint32).reshape(n, width).astype(np.uint64)
    size = (letters != 0).sum(axis=1)
    w = int(size.max())
    m = np.zeros((n, w + 2), np.uint64)
    m[:, 0], m[:, 1:w + 1] = ord("^"), letters[:, :w]
    rows = np.arange(n)
    m[rows, size + 1] = ord("$")
    one, two, three, spread = (np.full(1, x, np.uint64) for x in (
        0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))  # odd mixing constants

    def mixed(kind: int, *chars: np.ndarray) -> np.ndarray:
        h = np.full(1, kind, np.uint64) * spread
        for c, k in zip(chars, (one, two, three)):
            h = h ^ (c * k)
        h = (h ^ (h >> np.uint64(29))) * spread
        return (h >> np.uint64(40)).astype(np.int64) % SLOTS

    at = np.arange(w + 2)[None, :]
    cols = [mixed(1, m[:, :-1], m[:, 1:]), mixed(2, m[:, :-2], m[:, 1:-1], m[:, 2:])]
    first, last = ~opens[:, None], (size - ahead)[:, None]  # n-grams start at a place of the piece itself
    live = [(at[:, :-1] >= first) & (at[:, :-1] <= last), (at[:, :-2] >= first) & np.where(
        closes[:, None], at[:, :-2] < last, at[:, :-2] <= last)]
    for k in (1, 2, 3):
        cols.append(mixed(2 + k, *[m[:, min(i + 1, w)] for i in range(k)])[:, None])
        cols.append(mixed(5 + k, *[m[rows, np.maximum(size - i, 0)] for i in range(k)])[:, None])
        live += [((size >= k) & opens)[:, None], ((size >= k) & closes)[:, None]]
    sets = np.fromiter((lexicon.get(x, 0) for x in words), np.int64, n)
    whole = np.zeros(n, np.uint64)
    for i in range(w):
        whole = np.where(i < size, whole * three + letters[:, i], whole)  # the same whatever the widest word beside it
    cols += [mixed(9, sets.astype(np.uint64))[:, None], mixed(10, whole)[:, None]]
    live += [(sets != 0)[:, None]] * 2
    mask = np.concatenate(live, axis=1)
    return np.concatenate(cols, axis=1)[mask], mask.sum(axis=1)


def summed(weights: np.ndarray, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[slots], np.cumsum(sizes) - sizes, axis=0)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Word posteriors (sequence x word x language) for padded ``scores``; with ``pairs``, also the expected count of
    each transition. Scaled at each word, so no underflow however long the text."""
    n, most, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(transitions - transitions.max())
    live = np.arange(most)[None, :] < lengths[:, None]
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, most):
        a = (alpha[:, i - 1] @ t) * e[:, i]
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    for i in range(most - 2, -1, -1):
        b = (e[:, i + 1] * beta[:, i + 1]) @ t.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:, i] = np.where(live[:, i + 1, None], b, 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    gamma *= live[:, :, None]
    if not pairs:
        return gamma
    joint = alpha[:, :-1, :, None] * t[None, None] * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return gamma, (joint * live[:, 1:, None, None]).sum(axis=(0, 1))


def posteriors(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, segment: int = 1024) -> np.ndarray:
    """Word posteriors for texts laid end to end in ``scores`` (words x languages); ``lengths`` has each text's words.

    Exact forward-backward in time that doesn't depend on the longest text: texts are cut into segments, the product of
    each segment's transfer matrices carries the forward and backward messages across it, and the words inside all
    segments are then filled in side by side. Arrays are language x segment, the words at one place of all segments
    lying together."""
    k = scores.shape[1]
    t = np.exp(transitions - transitions.max())
    pieces = -(-lengths // segment)
    base = np.cumsum(pieces) - pieces
    text = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(len(text)) - base[text]
    size = np.minimum(segment, lengths[text] - number * segment)
    order = np.argsort(-size, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    start = ((np.cumsum(lengths) - lengths)[text] + number * segment)[order]
    size, first, n = size[order], number[order] == 0, len(order)
    most = int(size[0])
    live = np.searchsorted(-size, -np.arange(most), side="left")  # segments with a word at i come first
    begin = np.cumsum(live) - live
    words = np.concatenate([start[:m] + i for i, m in enumerate(live)])
    e = np.ascontiguousarray(scores[words].T)
    e = np.exp(e - e.max(axis=0))
    at = [slice(b, b + m) for b, m in zip(begin, live)]
    cut = np.flatnonzero(pieces[text[order]] > 1)  # only texts of several segments need transfer matrices
    spot = np.zeros(n, np.int64)
    spot[cut] = np.arange(len(cut))
    product = np.repeat(np.eye(k)[:, :, None], len(cut), axis=2)  # to, from, segment
    for i in range(most if len(cut) else 0):
        m = int(np.searchsorted(cut, live[i]))
        p = (t.T @ product[:, :, :m].reshape(k, -1)).reshape(k, k, m)
        if i == 0:
            p[:, :, first[cut[:m]]] = product[:, :, :m][:, :, first[cut[:m]]]
        p *= e[:, at[i]][:, None, cut[:m]]
        product[:, :, :m] = p / p.sum(axis=(0, 1))
    into, after = np.ones((k, n)), np.ones((k, n))
    longest = int(pieces.max())
    for j in range(1, longest):
        some = np.flatnonzero(pieces > j)
        a, b = place[base[some] + j - 1], place[base[some] + j]
        x = np.einsum("kn,lkn->ln", into[:, a], product[:, :, spot[a]])
        into[:, b] = x / x.sum(axis=0)
    for j in range(longest - 1, 0, -1):
        some = np.flatnonzero(pieces > j)
        a, b = place[base[some] + j - 1], place[base[some] + j]
        x = np.einsum("lkn,ln->kn", product[:, :, spot[b]], after[:, b])
        after[:, a] = x / x.sum(axis=0)
    out = np.empty_like(e)
    current = into
    for i, m in enumerate(live):
        x = t.T @ current[:, :m]
        if i == 0:
            x[:, first[:m]] = 1.0
        x *= e[:, at[i]]
        out[:, at[i]] = current = x / x.sum(axis=0)
    current = after.copy()
    for i in range(most - 1, -1, -1):
        m = live[i]
        out[:, at[i]] *= current[:, :m]
        x = t @ (current[:, :m] * e[:, at[i]])
        current[:, :m] = x / x.sum(axis=0)
    gamma = np.empty_like(scores, dtype=np.float64)
    gamma[words] = (out / out.sum(axis=0)).T
    return gamma


def train(samples: list[tuple[str, list[str]]], sequences: int | None = None, length: int = 32, rounds: int = 30,
          lexicon_size: int = 150, seed: int = 7, per_lang_sequences: int = 300) -> LangModel:
    """Fit by AdaGrad on the conditional likelihood of spliced sequences drawn from (language, words) samples.
    Without ``sequences``, ``per_lang_sequences`` for each language and 1,200 at least are drawn."""
    samples = [(g, ws) for g, ws in samples if ws]
    langs = tuple(sorted({g for g, _ in samples}))
    k = len(langs)
    if k == 0:
        return LangModel((), np.zeros((SLOTS, 0), np.float32), np.zeros((0, 0)), {})
    sequences = sequences or max(1200, per_lang_sequences * k)
    lexicon: dict[str, int] = {}
    for j, g in enumerate(langs):
        counts = Counter(w for h, ws in samples if h == g for w in ws)
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]:
            lexicon[w] = lexicon.get(w, 0) | 1 << j
    rng = np.random.default_rng(seed)
    of_lang = [[ws for h, ws in samples if h == g] for g in langs]
    vocabulary: dict[str, int] = {}
    ids = np.zeros((sequences, length), np.int64)
    gold = np.zeros((sequences, length), np.int64)
    for s in range(sequences):
        at = 0
        while at < length:
            j = int(rng.integers(k))
            ws = of_lang[j][int(rng.integers(len(of_lang[j])))]
            run = min(length - at, int(rng.integers(8, 33)))
            start = int(rng.integers(max(1, len(ws) - run + 1)))
            for w in ws[start:start + run]:
                ids[s, at], gold[s, at] = vocabulary.setdefault(w, len(vocabulary)), j
                at += 1
    flat, sizes = feature_slots(list(vocabulary), lexicon)
    weights, transitions = np.zeros((SLOTS, k)), np.zeros((k, k))
    gw, gt = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    lengths = np.full(sequences, length)
    observed = np.zeros((len(vocabulary), k))
    np.add.at(observed, (ids.ravel(), gold.ravel()), 1)
    steps = np.zeros((k, k))
    np.add.at(steps, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    ends = np.cumsum(sizes)  # many languages: words and sequences are taken in blocks of bounded memory
    parts = [(i, ends[i] - sizes[i], ends[min(i + 4_000, len(ends)) - 1]) for i in range(0, len(ends), 4_000)]
    block = max(1, 4_000_000 // (length * k * k))
    for _ in range(rounds):
        scores = np.concatenate([summed(weights, flat[a:b], sizes[i:i + 4_000]) for i, a, b in parts])
        expected, pairs = np.zeros_like(observed), np.zeros_like(steps)
        for i in range(0, sequences, block):
            some = ids[i:i + block]
            gamma, moves = forward_backward(scores[some], lengths[i:i + block], transitions, pairs=True)
            np.add.at(expected, some.ravel(), gamma.reshape(-1, k))
            pairs += moves
        rest = observed - expected
        grad = np.stack([np.bincount(flat, np.repeat(rest[:, j], sizes), SLOTS) for j in range(k)], axis=1) - 0.5 * weights
        tgrad = steps - pairs - 0.5 * transitions
        gw += grad ** 2
        gt += tgrad ** 2
        weights += 0.3 * grad / np.sqrt(gw)
        transitions += 0.1 * tgrad / np.sqrt(gt)
    return LangModel(langs, weights.astype(np.float32), transitions, lexicon)


def fit(docs: DataFrame, per_lang: int = 120, words_per_doc: int = 400, per_lang_sequences: int = 300) -> LangModel:
    """Train on rows of ``docs`` (doc_id, text, lang) with a non-null language.

    The sample is taken by hash threshold per language from exact counts, so no window or sort over a language is
    needed; only the sample reaches the driver."""
    d = pick(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
    d = d.withColumn("__h", F.xxhash64("doc_id", F.lit("langid")).cast("double") / F.lit(2.0 ** 64) + F.lit(0.5))
    counts = d.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return train([])
    keep = None
    for r in counts:
        part = (F.col("lang") == F.lit(r["lang"])) & (F.col("__h") < F.lit(1.3 * per_lang / r["n"]))
        keep = part if keep is None else keep | part
    middle = F.greatest(F.lit(1), F.floor(F.length("text") / 2) - F.lit(words_per_doc * 4)).cast("int")
    some = d.where(keep).select("lang", "__h", F.substring("text", middle, F.lit(words_per_doc * 8)).alias("run"))
    rows = some.orderBy("__h", "lang", "run").limit(2 * per_lang * len(counts)).collect()
    taken: Counter = Counter()
    samples = []
    for r in rows:
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= per_lang:
            ws = letter_words(r["run"])
            samples.append((r["lang"], ws[1:-1][:words_per_doc] or ws))
    return train(samples, per_lang_sequences=per_lang_sequences)


class Numbered(dict):
    """Numbers its keys in order of first use."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Scorer:
    """Word scores of a model, computed once per distinct word; the cache is emptied when it exceeds ``most`` words."""

    def __init__(self, model: LangModel, most: int = 150_000):
        self.model, self.most = model, most
        self.at = Numbered()
        self.rows = np.zeros((0, len(model.langs)))

    def lookup(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.at) > self.most:
            self.at, self.rows = Numbered(), self.rows[:0]
        ids = [np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws)) for ws in texts]
        new = list(islice(self.at, len(self.rows), None))
        parts = [self.model.emissions(new[i:i + 4_000]) for i in range(0, len(new), 4_000)]
        self.rows = np.concatenate([self.rows, *parts])
        return ids

    def posteriors(self, texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, word posteriors) for texts with words."""
        ids = self.lookup(texts)
        some = [i for i in range(len(ids)) if len(ids[i])]
        if some:
            lengths = np.array([len(ids[i]) for i in some])
            gamma = posteriors(self.rows[np.concatenate([ids[i] for i in some])], lengths, self.model.transitions)
            for i, end, n in zip(some, np.cumsum(lengths), lengths):
                yield i, gamma[end - n:end]


def predict(docs: DataFrame, model: LangModel, whole: bool = False) -> DataFrame:
    """One row a row: ``doc_id``, ``lang_pred`` and ``score``, the mean posterior of the winning language over the words.
    With ``whole``, every column of ``docs`` (names must be unique) comes before the two."""
    d = small_batches(docs) if whole else pick(small_batches(docs), "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots x languages numbers: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, langs = Scorer(shared.value), shared.value.langs
        for part in slices(batches, 2_000_000):
            pred, score = [UNDETERMINED] * len(part), np.zeros(len(part))
            if langs:
                texts = [letter_words(t) for t in part.column("text").to_pylist()]
                for i, gamma in scorer.posteriors(texts):
                    mean = gamma.mean(axis=0)
                    pred[i], score[i] = langs[int(mean.argmax())], float(min(1.0, mean.max()))
            kept = part if whole else part.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(pred, pa.string()), pa.array(score)],
                                             names=[*kept.schema.names, "lang_pred", "score"])

    schema = d.schema if whole else d.drop("text").schema
    return d.mapInArrow(run, StructType([*schema.fields, *FOUND.fields]))


def label_spans(docs: DataFrame, model: LangModel) -> DataFrame:
    """Runs of words of one language in each text: ``doc_id``, ``start``, ``end`` (code points, end exclusive),
    ``lang``, ``words`` (pieces of long runs count as words). Texts without letters have no row."""
    d = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, langs = Scorer(shared.value), shared.value.langs
        for part in slices(batches, 4_000_000):
            ids = part.column("doc_id").to_pylist()
            found = [[(m.start() + a, m.start() + b, piece(m.group(), a, b)) for m in LETTERS.finditer(t or "")
                      if any(c.isalpha() for c in m.group()) for a, b in cuts(m.end() - m.start())]
                     for t in part.column("text").to_pylist()]
            out = []
            for i, gamma in scorer.posteriors([[w.lower() for *_, w in f] for f in found]) if langs else ():
                best = gamma.argmax(axis=1)
                turns = [0, *(np.flatnonzero(np.diff(best)) + 1), len(best)]
                out += [(ids[i], found[i][a][0], found[i][b - 1][1], langs[best[a]], int(b - a))
                        for a, b in zip(turns, turns[1:])]
            yield pa.RecordBatch.from_pylist([dict(zip(SPANS.names, r)) for r in out], SPANS)

    return d.mapInArrow(run, "doc_id long, start long, end long, lang string, words long")


def language_id(docs: DataFrame, held_out_modulus: int = 5) -> DataFrame:
    """Contract query: fit on rows whose remainder is not 0, predict every row."""
    d = pick(docs, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(d.where(remainder(held_out_modulus) != 0))
    out = predict(d.drop("lang"), model)
    return out.select("doc_id", (remainder(held_out_modulus) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LangModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has letters. The score is no ground to drop a text: in a code-switched
    one it is about the winner's share of the words, however sure the model is of each word. The columns travel through
    the same single pass."""
    names, at = docs.columns, position(docs, "text")
    unique = ["text" if i == at else f"__{i}" for i in range(len(names))]
    passed = predict(docs.toDF(*unique), model, whole=True)
    passed = passed.where(F.col("lang_pred") != UNDETERMINED)
    return passed.select(*unique).toDF(*names)

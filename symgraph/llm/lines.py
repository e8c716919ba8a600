"""Quality rules: base counts, and a linear-chain conditional random field that labels lines.

Each line with a word gets a vector of shape features (length, closing punctuation, share of symbols,
capitals and digits, separators, repetition, stock phrases).  A two-state chain (0 content, 1 boilerplate)
is scored by feature and transition weights; Viterbi decoding gives the labels, and a document is kept if
lines labelled content hold at least MIN_SHARE of its word characters.

There are no labels of lines.  A document's label says only on which side of MIN_SHARE its share of content lies, so
the labels of its lines are hidden and learned under that constraint (posterior regularisation): in turns, each
line's chance of being boilerplate is that of its features, tilted as little as brings the document's expected share
of content to MIN_SHARE + MARGIN or more (label 1) or MIN_SHARE - MARGIN or less (label 0), and feature weights are
fitted to these chances by Newton steps.  A document may so hold lines of both kinds.  Transition weights are learned
after that, by forward-backward on the documents whose lines have got both labels: a chain of one label throughout
says nothing of where labels change.  Without any such document they stay 0.

Training takes at most MAX_LABELLED labelled documents of the training fold (crc32 of the id modulo FOLDS is not 0),
those with the smallest xxhash64 of their id, as many as SAMPLE_BYTES of text hold, none over LONGEST_BYTES; of each
the whole text.  Whole texts are judged.

Null and empty texts have no words: all counts are 0, base_failed is true, kept is false.  A line counts as
repeated if an earlier line of the same text is equal to it.  Repeated rows are judged each for itself.  Label rows
with a null id or label are ignored; of several labels of one id the smallest counts, of several texts of a labelled
id the first in order.  Without labels of both kinds every line is content, so the base rules alone decide.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, crc_mod, map_rows

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_SHARE = 0.5
MAX_LABELLED = 2000
#: Bounds of the training sample: rows are left out, never parts of texts.
SAMPLE_BYTES, LONGEST_BYTES = 1 << 24, 1 << 20
FOLDS = 5
#: How far beyond MIN_SHARE the share of content of a labelled document is taken to lie.
MARGIN = 0.25
TURNS, STEPS, RATE, DECAY = 30, 60, 4.0, 0.002
_SYMBOLS = b"#*$%&|<>"
_STOCK = re.compile(
    r"(?i)\b(?:all rights reserved|copyright|licensed under|license|cookies?|privacy policy|terms of (?:use|service)"
    r"|click here|subscribe|sign (?:in|up)|log ?in|read more|share this|newsletter|powered by|back to top|home page)\b|©"
)
_LINK = re.compile(r"https?://|www\.|@")
N_FEATURES = 13


def features(line: str, words: list[str], seen: bool) -> list[int]:
    """Numbers of the features that a line has."""
    n, size = len(words), sum(map(len, words))
    letters = sum(map(str.isalpha, line)) if len(line) < 200 or not line.isascii() else len(re.findall("[A-Za-z]", line))
    out = [0]
    if n < 4:
        out.append(1)
    if n >= 8:
        out.append(2)
    if words[-1][-1] in ".?!…\"'":
        out.append(3)
    odd = size - letters
    if odd > 0.3 * size:
        out.append(4)
    elif odd > 0.15 * size:
        out.append(5)
    upper = sum(map(str.isupper, words))
    if n > 1 and upper > 0.5 * n:
        out.append(6)
    if size and sum(map(line.count, "0123456789")) > 0.3 * size:
        out.append(7)
    if seen:
        out.append(8)
    if line.count("|") + line.count("•") + line.count("»") >= max(1, n // 6):
        out.append(9)
    if _STOCK.search(line):
        out.append(10)
    if _LINK.search(line):
        out.append(11)
    if n >= 8 and len(set(words)) < 0.4 * n:
        out.append(12)
    return out


def line_rows(text: str | None) -> tuple[list[list[int]], list[int], list[list[str]], int]:
    """Of the lines with a word: features, word characters and words; and how many equal an earlier line."""
    rows, sizes, words, seen, dups = [], [], [], set(), 0
    for line in (text or "").split("\n"):
        own = WORD.findall(line)
        if not own:
            continue
        again = line in seen
        dups += again
        seen.add(line)
        rows.append(features(line, own, again))
        sizes.append(sum(map(len, own)))
        words.append(own)
    return rows, sizes, words, dups


def log_sum(x: np.ndarray) -> np.ndarray:
    """Over the last axis."""
    top = x.max(axis=-1)
    return top + np.log(np.exp(x - top[..., None]).sum(axis=-1))


class Chains:
    """Labelled sequences of lines, the longest first, so that those with a line t are a prefix of the list."""

    def __init__(self, docs: list[tuple[list[list[int]], list[int]]], weights: list[float]):
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i][0]))
        self.sizes = np.array([len(docs[i][0]) for i in order])
        self.start = np.cumsum(self.sizes) - self.sizes
        self.x = np.zeros((self.sizes.sum(), N_FEATURES))
        self.y = np.zeros((len(self.x), 2))
        self.moved = np.zeros((2, 2))
        self.weight = np.repeat([weights[i] for i in order], self.sizes)
        for i, at in zip(order, self.start.tolist()):
            rows, labels = docs[i]
            for t, (r, label) in enumerate(zip(rows, labels)):
                self.x[at + t, r] = 1
                self.y[at + t, label] = 1
                if t:
                    self.moved[labels[t - 1], label] += weights[i]
        self.active = [int((self.sizes > t).sum()) for t in range(self.sizes.max(initial=0))]

    def gradient(self, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Observed less expected counts of features and transitions (forward-backward), and the log-likelihood."""
        score = self.x @ weights.T
        fore, back = score.copy(), np.zeros_like(score)
        for t in range(1, len(self.active)):
            at = self.start[: self.active[t]] + t
            fore[at] += log_sum((fore[at - 1][:, :, None] + moves).transpose(0, 2, 1))
        for t in range(len(self.active) - 1, 0, -1):
            at = self.start[: self.active[t]] + t
            back[at - 1] = log_sum(moves + (score[at] + back[at])[:, None, :])
        total = np.repeat(log_sum(fore[self.start + self.sizes - 1]), self.sizes)
        p = np.exp(fore + back - total[:, None])
        later = np.ones(len(score), bool)
        later[self.start] = False
        at = np.flatnonzero(later)
        pairs = np.exp(fore[at - 1][:, :, None] + moves + (score[at] + back[at])[:, None, :] - total[at][:, None, None])
        gw = ((self.y - p) * self.weight[:, None]).T @ self.x
        gm = self.moved - (pairs * self.weight[at][:, None, None]).sum(axis=0)
        seen = (self.weight * (self.y * score).sum(axis=1)).sum() + (self.moved * moves).sum()
        return gw, gm, float(seen - (total * self.weight / np.repeat(self.sizes, self.sizes)).sum())


def hidden_labels(odds: np.ndarray, share: np.ndarray, start: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Chance of each line to be boilerplate: that of its log odds, tilted by its share of the document's size as little
    as the document's label asks for (bisection on one number a document, all documents at once)."""
    size = np.diff(np.append(start, len(odds)))
    side = np.where(good, -1.0, 1.0)
    aim = np.where(good, MIN_SHARE, 1 - MIN_SHARE) + MARGIN  # for the share of the label's own kind of lines

    def chances(tilt: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(odds + np.repeat(side * tilt * size, size) * share, -500, 500)))

    def short(tilt: np.ndarray) -> np.ndarray:
        bad = np.add.reduceat(chances(tilt) * share, start)
        return np.where(good, 1 - bad, bad) < aim

    low, high = np.zeros(len(start)), np.ones(len(start))
    high[~short(low)] = 0
    while (more := short(high) & (high < 2.0**40)).any():
        high[more] *= 2
    for _ in range(40):
        middle = (low + high) / 2
        under = short(middle)
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return chances(high)


def fit_chances(x: np.ndarray, chance: np.ndarray, weight: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Weights of features for the log odds of boilerplate (logistic regression by Newton steps, from `found` on)."""
    for _ in range(12):
        p = 1 / (1 + np.exp(-x @ found))
        step = np.linalg.solve(
            (x * (weight * p * (1 - p))[:, None]).T @ x + DECAY * np.eye(len(found)),
            x.T @ (weight * (chance - p)) - DECAY * found,
        )
        found = found + step
        if np.abs(step).max() < 1e-6:
            break
    return found


def train(docs: list[tuple[list[list[int]], list[int], int]]) -> tuple[tuple, tuple]:
    """(feature weights by state, transition weights) from (line features, word characters, label of the document) rows.

    Both labels have the same total weight.  Without both labels all weights are 0, by which every line is content.
    """
    docs = [d for d in docs if d[0]]
    good = np.array([label == 1 for *_, label in docs], bool)
    weights, moves = np.zeros((2, N_FEATURES)), np.zeros((2, 2))
    if good.any() and not good.all():
        size = np.array([len(rows) for rows, *_ in docs])
        start = np.cumsum(size) - size
        chars = np.concatenate([sizes for _, sizes, _ in docs]).astype(float)
        share = chars / np.repeat(np.add.reduceat(chars, start), size)
        x = np.zeros((len(chars), N_FEATURES))
        for t, r in enumerate(r for rows, *_ in docs for r in rows):
            x[t, r] = 1
        weight = np.repeat(0.5 / np.where(good, good.sum(), (~good).sum()) / size, size)
        chance, odds = np.repeat(~good, size).astype(float), np.zeros(N_FEATURES)
        for _ in range(TURNS):
            odds = fit_chances(x, chance, weight, odds)
            before, chance = chance, hidden_labels(x @ odds, share, start, good)
            if np.abs(chance - before).max() < 1e-3:
                break
        weights = np.stack([-odds / 2, odds / 2])
        label = (chance > 0.5).astype(int)
        mixed = np.flatnonzero((np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start))).tolist()
        if mixed:
            chains = Chains([(docs[i][0], label[start[i] : start[i] + size[i]].tolist()) for i in mixed], [1 / len(mixed) / size[i] for i in mixed])
            for _ in range(STEPS):
                moves += RATE * (chains.gradient(weights, moves)[1] - DECAY * moves)
    return tuple(map(tuple, weights.tolist())), tuple(map(tuple, moves.tolist()))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> list[tuple[list[list[int]], list[int], int]]:
    """(line features, word characters of lines, label) of the labelled documents within the bounds of the sample."""
    spark = docs.sparkSession
    ids = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (crc_mod(id_col, FOLDS) != 0))
        .groupBy(F.col(id_col).cast("string").alias("_id"), F.xxhash64(id_col).alias("_order"))
        .agg(F.min(label_col).cast("int").alias("_label"))
        .orderBy("_order", "_id")
        .limit(MAX_LABELLED)
    )
    texts = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    sized = texts.select("_id", F.octet_length("_text").alias("n")).join(F.broadcast(ids), "_id")  # at most MAX_LABELLED ids
    drawn, total = [], 0
    for r in sized.groupBy("_id", "_order", "_label").agg(F.max("n").alias("n")).orderBy("_order", "_id").collect():
        n = r["n"] or 0
        if n <= LONGEST_BYTES:
            total += n
            if total > SAMPLE_BYTES:
                break
            drawn.append((r["_id"], r["_label"]))
    few = spark.createDataFrame(drawn, "_id string, _label int")
    mine = texts.join(F.broadcast(few), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))  # one text an id, however often it is there

    def fn(cols: dict) -> dict:
        found = [line_rows(text)[:2] for text in cols["_text"]]
        masks = [np.array([sum(1 << f for f in r) for r in rows], "<u4").tobytes() for rows, _ in found]
        return {"_id": cols["_id"], "_label": cols["_label"], "_masks": masks, "_sizes": [np.array(sizes, "<u4").tobytes() for _, sizes in found]}

    rows = map_rows(mine.select("_id", "_label", "_text"), fn, "_id string, _label int, _masks binary, _sizes binary", 64)
    listed = sorted(rows.collect(), key=lambda r: r["_id"])
    masks = lambda r: np.frombuffer(r["_masks"], "<u4").tolist()
    return [([[f for f in range(N_FEATURES) if m >> f & 1] for m in masks(r)], np.frombuffer(r["_sizes"], "<u4").tolist(), r["_label"]) for r in listed]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> tuple[tuple, tuple]:
    """The chain's weights, learned from labelled documents of the training fold."""
    return train(labelled_sample(docs, labels, label_col, id_col, text_col))


def viterbi(rows: list[list[int]], weights, moves) -> list[int]:
    """The likeliest labels; ties go to content."""
    w0, w1 = weights
    (m00, m01), (m10, m11) = moves
    a = b = 0.0
    back: list[tuple[int, int]] = []
    for t, r in enumerate(rows):
        s0 = s1 = 0.0
        for f in r:
            s0 += w0[f]
            s1 += w1[f]
        if t:
            c, d = a + m00, b + m10
            e, f = a + m01, b + m11
            back.append((0 if c >= d else 1, 0 if e >= f else 1))
            a, b = max(c, d) + s0, max(e, f) + s1
        else:
            a, b = s0, s1
    state = 0 if a >= b else 1
    out = [state]
    for pair in reversed(back):
        state = pair[state]
        out.append(state)
    return out[::-1]


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    triples = list(zip(words, words[1:], words[2:]))
    counts = Counter(triples)
    if len(counts) == len(triples):
        return 0
    total, covered = 0, 0
    for i, x in enumerate(triples):
        if counts[x] > 1:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


def judge(text: str | None, weights, moves) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share)."""
    rows, sizes, by_line, dups = line_rows(text)
    if not rows:
        return 0, 0, 0, 0, 0, True, False, 0.0  # white space only, so no symbols either
    words = [w for line in by_line for w in line]
    raw = text.encode("utf-8", "surrogatepass")
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    n, chars, again = len(words), sum(sizes), repeated_words(words)
    failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
    share = sum(s for s, x in zip(sizes, viterbi(rows, weights, moves)) if x == 0) / chars
    return n, chars, symbols, dups, again, failed, not failed and share >= MIN_SHARE, share


def rules(docs: DataFrame, model: tuple[tuple, tuple], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts, base verdict, verdict, share of content; model: what `fit` gives."""
    weights, moves = model
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")

    def fn(cols: dict) -> dict:
        found = [judge(t, weights, moves) for t in cols["_text"]]
        return {id_col: cols["_id"]} | {k: [x[i] for x in found] for i, k in enumerate(names)}

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return map_rows(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), fn, schema)

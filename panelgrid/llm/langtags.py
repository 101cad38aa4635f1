"""Language of every word by a linear-chain conditional random field, and from that of every document.

A word is a run of letters, lower-cased. Its emission scores are sums of weights of its affixes, its character n-grams
and itself (the lexicon), each looked up by hash in a table of fixed size. A line is one sequence; transitions between
the languages of neighbouring words are learned too. Forward-backward gives each word's language probabilities, so a
line may switch language midway. The document's language has the largest mean probability over the words, each
weighted by its letters; the score is that mean. The certainty is the mean probability of each word's own best
language: a text of two languages has a low score but a high certainty.

Neither tells a text of a language that was not learned, as the probabilities are shared among the learned ones only.
The evidence does: the log likelihood of the words' letters under smoothed frequencies of letter trigrams, in each
language by the word's probability of it, less that of a background which charges every letter the entropy of the sample's
letters. It is a sum over the text in nats, so that few words weigh little: below zero the background explains it better.

Fitting: at most `per_language` labelled documents of each language, of at most `fit_chars` characters, taken in an
order of hashed ids, and at most `fit_lines` lines of them in all, are read by the driver. Lines of different languages
are joined now and then, so that switches are seen. Tagging reads every text whole.

Defined cases: a null text, or one without a letter, has language `und`, score, certainty and evidence 0; equal scores go to the language
that is first in the alphabet; without any labelled document every text is `und`; words of any length are used whole;
repeated rows are tagged alike; columns other than those named are not read.
"""

from __future__ import annotations

import random
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.llm.simtrie import let_go

WORD = re.compile(r"[^\W\d_]+")
CELLS = 1 << 16  # weights for each language in each of the two tables
TRIGRAM_PRIOR = 0.1  # added to the count of every trigram cell
MEMO_WORDS = 400_000  # distinct words kept by a task before its memo starts anew
BATCH_CHARS = 1_500_000  # texts tagged together


def hashed(codes: np.ndarray, salt: int) -> np.ndarray:
    """Cells of the rows of a matrix of code points."""
    h = np.full(codes.shape[0], (salt * 0x9E3779B1 + 0x7F4A7C15) & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return ((h * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.int64) & (CELLS - 1)


def word_features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the words of each length: their positions, and a matrix of the cells of their features.

    Cells under CELLS are affixes and n-grams, those above are the lexicon. The lexicon is the last column; before it
    come the trigrams, one around each letter.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        codes = np.frombuffer("".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), size)
        padded = np.zeros((len(at), size + 2), np.uint32)
        padded[:, 1:-1] = codes
        padded[:, -1] = 1
        cells = [hashed(codes[:, :k], 10 + k) for k in range(1, min(3, size) + 1)]
        cells += [hashed(codes[:, size - k :], 20 + k) for k in range(1, min(4, size) + 1)]
        cells += [hashed(padded[:, i : i + n], 30 + n) for n in (2, 3) for i in range(size + 3 - n)]
        cells.append(CELLS + hashed(codes, 40))
        yield at, np.stack(cells, 1)


@dataclass
class Tagger:
    languages: list[str]
    weights: np.ndarray  # 2 * CELLS x languages
    start: np.ndarray
    step: np.ndarray  # from x to
    fits: np.ndarray  # CELLS x languages: evidence of the letter in the middle of a trigram, in nats

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for at, cells in word_features(words):
            total = np.zeros((len(at), len(self.languages)), np.float32)
            for k in range(cells.shape[1]):
                total += self.weights[cells[:, k]]
            out[at] = total
        return out

    def evidence(self, words: list[str]) -> np.ndarray:
        """Of each word for each language, against the background."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for at, cells in word_features(words):
            for k in range(len(words[at[0]])):
                out[at] += self.fits[cells[:, -2 - k]]
        return out


def trigram_fits(words: list[str], counts: np.ndarray) -> np.ndarray:
    """Evidence by trigram cell and language, from distinct words and how often each occurs in each language."""
    cell_counts = np.full((CELLS, counts.shape[1]), TRIGRAM_PRIOR)
    for at, cells in word_features(words):
        for k in range(len(words[at[0]])):
            np.add.at(cell_counts, cells[:, -2 - k], counts[at])
    letters: dict[str, float] = {}
    for word, n in zip(words, counts.sum(1)):
        for letter in word:
            letters[letter] = letters.get(letter, 0.0) + n
    share = np.array(list(letters.values())) / sum(letters.values())
    entropy = -(share * np.log(share)).sum()
    return ((np.log(cell_counts / cell_counts.sum(0)) + 3 * entropy) / 3).astype(np.float32)  # a letter is in three trigrams


def time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deal the words of sequences out by their place: the running sequences of each step, the first row of each step,
    and the row of each word. Longer sequences come first in every step."""
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    running = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    first = np.concatenate([[0], np.cumsum(running)])
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return running, first, first[place] + rank[sequence]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of every word, expected transitions, and the posteriors of first words, over sequences of any lengths."""
    running, first, row = time_major(lengths)
    local = np.empty_like(scores)
    local[row] = np.exp(scores - scores.max(1, keepdims=True))
    begin, move = np.exp(start).astype(scores.dtype), np.exp(step).astype(scores.dtype)
    alpha = np.empty_like(local)
    beta = np.ones_like(local)
    for t, n in enumerate(running):
        here = slice(first[t], first[t] + n)
        a = local[here] * (begin if t == 0 else alpha[first[t - 1] : first[t - 1] + n] @ move)
        alpha[here] = a / a.sum(1, keepdims=True)
    expected = np.zeros_like(move)
    for t in range(len(running) - 2, -1, -1):
        n = running[t + 1]
        after = slice(first[t + 1], first[t + 1] + n)
        reach = local[after] * beta[after]
        b = reach @ move.T
        scale = b.sum(1, keepdims=True)
        now = slice(first[t], first[t] + n)
        beta[now] = b / scale
        weight = (alpha[now] * b).sum(1, keepdims=True)
        expected += (alpha[now] / weight).T @ reach
    posterior = alpha * beta
    posterior /= posterior.sum(1, keepdims=True)
    starts = posterior[: running[0]].sum(0) if len(running) else np.zeros(len(start))
    return posterior[row], expected * move, starts


def fit(lines: list[tuple[str, str]], rounds: int = 40, switch: int = 4, rate: float = 0.4, decay: float = 1e-6) -> Tagger:
    """Conditional likelihood by adaptive gradient steps over (text, language) lines; every `switch`-th one goes on with the next."""
    languages = sorted({language for _, language in lines})
    code = {language: i for i, language in enumerate(languages)}
    vocabulary: dict[str, int] = {}
    ids: list[int] = []
    truth: list[int] = []
    lengths: list[int] = []
    for i, (text, language) in enumerate(lines):
        words = WORD.findall(text.lower())
        if not words:
            continue
        ids += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        truth += [code[language]] * len(words)
        if lengths and i % switch == 0:
            lengths[-1] += len(words)
        else:
            lengths.append(len(words))
    k = len(languages)
    words, at, gold, sizes = list(vocabulary), np.array(ids, np.int64), np.array(truth, np.int64), np.array(lengths, np.int64)
    tagger = Tagger(languages, np.zeros((2 * CELLS, k), np.float32), np.zeros(k), np.zeros((k, k)), np.zeros((CELLS, k), np.float32))
    if not len(at):
        return tagger
    tagger.fits = trigram_fits(words, np.stack([np.bincount(at[gold == j], minlength=len(words)) for j in range(k)], 1))
    features = list(word_features(words))
    inside = np.ones(len(at), bool)
    begins = np.cumsum(sizes) - sizes
    inside[begins] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[np.flatnonzero(inside) - 1], gold[inside]), 1)
    seen_start = np.bincount(gold[begins], minlength=k)
    power = [np.full((2 * CELLS, k), 1e-6, np.float32), np.full(k, 1e-6), np.full((k, k), 1e-6)]
    for _ in range(rounds):
        scores = tagger.emissions(words)[at]
        posterior, expected, starts = forward_backward(scores, sizes, tagger.start, tagger.step)
        miss = -posterior
        miss[np.arange(len(at)), gold] += 1
        by_word = np.stack([np.bincount(at, miss[:, j], len(words)) for j in range(k)], 1)
        slope = np.zeros((2 * CELLS, k), np.float32)
        for rows, cells in features:
            for j in range(k):
                slope[:, j] += np.bincount(cells.ravel(), np.repeat(by_word[rows, j], cells.shape[1]), 2 * CELLS)
        slopes = [slope / len(at), (seen_start - starts) / len(sizes), (seen - expected) / len(at)]
        for value, g, p in zip((tagger.weights, tagger.start, tagger.step), slopes, power):
            g = g - decay * value
            p += (g * g).astype(p.dtype)
            value += (rate * g / np.sqrt(p)).astype(value.dtype)
    return tagger


class Memo(dict):
    """Word -> row of the emission scores and the evidence; rows of new words are scored together."""

    def __init__(self, tagger: Tagger, most: int = MEMO_WORDS):
        super().__init__()
        self.tagger, self.most = tagger, most
        self.rows = np.zeros((0, 2 * len(tagger.languages)), np.float32)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self.rows = self.rows[:0]
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.rows = np.concatenate([self.rows, np.hstack([self.tagger.emissions(self.new), self.tagger.evidence(self.new)])])
            self.new = []
        return self.rows[ids]


def tag_texts(memo: Memo, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, score and certainty of each text."""
    return measured_texts(memo, texts)[:3]


def measured_texts(memo: Memo, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[float]]:
    """Language, score, certainty and evidence of each text."""
    tagger = memo.tagger
    words: list[str] = []
    lengths: list[int] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        if not text or not any(map(str.isalpha, text)):
            continue
        for line in text.lower().split("\n"):
            found = WORD.findall(line)
            if found:
                words += found
                lengths.append(len(found))
                owner.append(i)
    names, scores, certain, evidence = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if not words or not tagger.languages:
        return names, scores, certain, evidence
    sizes = np.array(lengths, np.int64)
    k = len(tagger.languages)
    rows = memo.scores(words)
    posterior, _, _ = forward_backward(np.ascontiguousarray(rows[:, :k]), sizes, tagger.start, tagger.step)
    of = np.repeat(np.array(owner, np.int64), sizes)
    letters = np.fromiter(map(len, words), np.float64, len(words))
    total = np.bincount(of, letters, len(texts))
    share = np.stack([np.bincount(of, letters * posterior[:, j], len(texts)) for j in range(len(tagger.languages))], 1)
    clear = np.bincount(of, letters * posterior.max(1), len(texts))
    fit_of = np.bincount(of, (posterior * rows[:, k:]).sum(1), len(texts))
    for i in np.flatnonzero(total):
        best = int(share[i].argmax())
        names[i], scores[i], certain[i] = tagger.languages[best], float(min(1.0, share[i, best] / total[i])), float(min(1.0, clear[i] / total[i]))
        evidence[i] = float(fit_of[i])
    return names, scores, certain, evidence


def fit_sample(docs: DataFrame, language: Column, may_learn: Column, per_language: int = 150, fit_chars: int = 4000, fit_lines: int = 4000) -> list[tuple[str, str]]:
    """A bounded sample of labelled lines, in an order of hashed ids; the bounds are parameters of the fit, not of the tagging."""
    labelled = docs.select("doc_id", F.col("text").alias("__text"), language.alias("__language")).where(may_learn & F.col("__language").isNotNull() & F.col("__text").isNotNull() & (F.length("__text") <= fit_chars))
    order = Window.partitionBy("__language").orderBy(F.xxhash64("doc_id", "__text"), "doc_id")
    rows = labelled.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= per_language)
    rows = rows.orderBy("__place", "__language").limit(64 * per_language).select("__language", "__text", "__place").collect()
    lines = [(line, r[0]) for r in rows for line in r[1].split("\n") if WORD.search(line)]
    random.Random(7).shuffle(lines)  # so that joined lines differ in language
    return lines[:fit_lines]


_MEMOS: dict[str, Memo] = {}


def tag_documents(docs: DataFrame, tagger: Tagger, keep: list[str], text: str = "text", prefix: str = "", most: int = MEMO_WORDS) -> DataFrame:
    """Columns `keep`, then lang_pred, score, certainty and evidence, their names led by `prefix`. The tagger's tables have a fixed size and are broadcast.
    `most`: words that a worker's memo keeps, which changes its memory but no result."""
    shared, key = docs.sparkSession.sparkContext.broadcast(tagger), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MEMOS:
            let_go()
            _MEMOS[key] = Memo(shared.value, most)
        memo = _MEMOS[key]
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            found: tuple[list, list, list, list] = ([], [], [], [])
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < BATCH_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                for column, part in zip(found, measured_texts(memo, texts[at:end])):
                    column += part
                at = end
            columns = [pa.array(found[0], pa.string()), *(pa.array(x, pa.float64()) for x in found[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *(f"{prefix}{n}" for n in ("lang_pred", "score", "certainty", "evidence"))])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, `{prefix}lang_pred` string, `{prefix}score` double, `{prefix}certainty` double, `{prefix}evidence` double")


def held_out() -> Column:
    """Documents that fitting may not see."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, certainty; fitted on documents that are not held out."""
    lines = fit_sample(docs, F.col("lang"), F.coalesce(~held_out(), F.lit(False)))
    tagged = tag_documents(docs, fit(lines), ["doc_id"])
    return tagged.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "certainty")

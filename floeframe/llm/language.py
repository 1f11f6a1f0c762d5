"""Language by unigram pieces, with every segmentation of a word summed.

A fixed public vocabulary gives the pieces. Each language has its own probability for each piece, and the
probability of a word is the sum over all ways of cutting it into pieces (forward algorithm); a text's
likelihood is the product over its words. Probabilities are learned by expectation maximisation
(forward-backward over all segmentations) on counted words of labelled texts.

Words are maximal runs of letters, lower-cased, with the vocabulary's word-start mark in front. A letter
outside the vocabulary is a piece of its own with a small fixed probability, the same in all languages.

Fit bounds (parameters): about ``docs_per_lang`` labelled documents of each language, chosen by a seeded hash
whose cut-off comes from the language's count, and of their words the ``words_per_lang`` most frequent.
Prediction reads every text whole.

Edge cases: a null text or one without a letter is ``und`` with score 0; if nothing was learned all texts
are ``und``; ties go to the language that sorts first; rows with null ids are predicted but teach nothing;
other columns, and their names, do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
WORD = re.compile(r"[^\W\d_]+")
LONG = 32            # longer words are scored one by one with running rescaling
UNKNOWN = 1e-8
CACHE = 400_000      # words a task remembers; beyond that it starts afresh


def load_pieces(path: str = VOCABULARY, longest: int = 12) -> list[str]:
    """The vocabulary's pieces of letters, without case, up to ``longest`` characters."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    keep = {p for p in found if len(p) <= longest and p == p.lower() and (p == START or p.lstrip(START).isalpha()) and p.count(START) <= 1}
    return sorted(keep)


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    pieces: list[str]
    probs: np.ndarray        # (pieces + 1, languages); the last row is the unknown letter
    log_prior: np.ndarray


BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


class Segmenter:
    """Sums over segmentations for words, all languages at once."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.unknown = len(pieces)
        self.probs = probs
        # pieces by length: sorted rolling hashes and whose they are, so that substrings are found in bulk
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, self.longest + 1):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == n], dtype=np.int32)
            h = np.zeros(len(ids), dtype=np.uint64)
            if len(ids):
                grid = _codes("".join(pieces[i] for i in ids)).reshape(len(ids), n)
                for c in range(n):
                    h = h * BASE + grid[:, c]
            order = np.argsort(h)
            self.tables.append((h[order], ids[order]))

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Arrays (word, from, to, piece) of every piece occurrence, sorted by where it ends."""
        codes = _codes("".join(START + w for w in words))
        sizes = np.array([len(w) + 1 for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = (np.arange(len(codes)) - begin).astype(np.int32)
        room = (np.repeat(sizes, sizes) - at).astype(np.int32)        # characters left in the word
        parts, live, h = [], np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, self.longest + 1):
            keep = room[live] >= n
            live, h = live[keep], h[keep]
            h = h * BASE + codes[live + (n - 1)]
            keys, ids = self.tables[n - 1]
            if len(keys) and len(live):
                where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[where] == h
                parts.append((live[hit], n, ids[where[hit]]))
                if n == 1:
                    parts.append((live[~hit], 1, np.full(int((~hit).sum()), self.unknown, dtype=np.int32)))
            elif n == 1:
                parts.append((live, 1, np.full(len(live), self.unknown, dtype=np.int32)))
        pos = np.concatenate([p[0] for p in parts])
        end = np.concatenate([at[p[0]] + np.int32(p[1]) for p in parts])
        piece = np.concatenate([p[2] for p in parts])
        order = np.argsort(end, kind="stable")
        pos = pos[order]
        return word[pos], at[pos], end[order], piece[order]

    def forward(self, words: list[str], edges: tuple[np.ndarray, ...]) -> np.ndarray:
        wi, ss, ee, pp = edges
        most = max(map(len, words)) + 1
        alpha = np.zeros((len(words), most + 1, self.probs.shape[1]))
        alpha[:, 0] = 1.0
        cuts = np.searchsorted(ee, np.arange(1, most + 2))
        for e in range(1, most + 1):
            at = slice(cuts[e - 1], cuts[e])
            if at.start < at.stop:
                np.add.at(alpha, (wi[at], e), alpha[wi[at], ss[at]] * self.probs[pp[at]])
        return alpha

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.empty((len(words), self.probs.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for b in range(0, len(short), 4096):
            some = short[b:b + 4096]
            these = [words[i] for i in some]
            alpha = self.forward(these, self.edges(these))
            out[some] = np.log(alpha[np.arange(len(some)), [len(w) + 1 for w in these]])
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._log_long(w)
        return out

    def _log_long(self, word: str) -> np.ndarray:
        t, keep = START + word, self.longest
        near, scale = [np.ones(self.probs.shape[1])], np.zeros(self.probs.shape[1])     # the last sums, divided by exp(scale)
        for e in range(1, len(t) + 1):
            total = np.zeros(self.probs.shape[1])
            for back in range(1, min(keep, len(near)) + 1):
                p = self.index.get(t[e - back:e], self.unknown if back == 1 else None)
                if p is not None:
                    total += near[-back] * self.probs[p]
            near.append(total)
            near = near[-keep:]
            if e % 8 == 0:
                top = np.maximum.reduce(near)
                near, scale = [a / top for a in near], scale + np.log(top)
        return np.log(near[-1]) + scale

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected piece counts per language over all segmentations of counted words."""
        out = np.zeros_like(self.probs)
        for b in range(0, len(words), 4096):
            these, n = words[b:b + 4096], counts[b:b + 4096]
            wi, ss, ee, pp = edges = self.edges(these)
            alpha = self.forward(these, edges)
            ends = np.array([len(w) + 1 for w in these])
            rows = np.arange(len(these))
            total = alpha[rows, ends]
            beta = np.zeros_like(alpha)
            beta[rows, ends] = n / total
            cuts = np.searchsorted(ee, np.arange(1, alpha.shape[1] + 1))
            for e in range(alpha.shape[1] - 1, 0, -1):
                at = slice(cuts[e - 1], cuts[e])
                if at.start < at.stop:
                    np.add.at(beta, (wi[at], ss[at]), beta[wi[at], e] * self.probs[pp[at]])
            np.add.at(out, pp, alpha[wi, ss] * self.probs[pp] * beta[wi, ee])
        return out


def _words_udf():
    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([[w for w in WORD.findall((t or "").lower()) if len(w) <= LONG] for t in texts])

    return words


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, docs_per_lang: int = 400, words_per_lang: int = 30_000, rounds: int = 3,
        smoothing: float = 0.1, seed: int = 7) -> LanguageModel:
    """Learn piece probabilities from labelled texts outside the held-out remainder."""
    pieces = load_pieces(vocabulary)
    known = (docs.select("doc_id", "text", "lang")
             .where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, docs_per_lang / counts[k]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    counted = (known.where(draw < share[F.col("lang")])
               .select("lang", F.explode(_words_udf()("text")).alias("word"))
               .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    ranked = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    rows = counted.withColumn("_at", F.row_number().over(ranked)).where(F.col("_at") <= words_per_lang).drop("_at").collect()
    words = sorted({r["word"] for r in rows})
    where, col = {w: i for i, w in enumerate(words)}, {k: i for i, k in enumerate(langs)}
    table = np.zeros((len(words), len(langs)))
    for r in rows:
        table[where[r["word"]], col[r["lang"]]] = r["n"]
    probs = np.full((len(pieces) + 1, len(langs)), 1.0 / max(1, len(pieces)))
    probs[-1] = UNKNOWN
    for _ in range(rounds if words else 0):
        got = Segmenter(pieces, probs).expected(words, table)[:-1] + smoothing
        probs[:-1] = got / got.sum(axis=0)
    prior = np.array([counts[k] for k in langs], dtype=float)
    return LanguageModel(langs, pieces, probs, np.log(prior / prior.sum()))


class _Scorer:
    def __init__(self, model: LanguageModel):
        self.seg = Segmenter(model.pieces, model.probs)
        self.model, self.cache = model, {}
        self.table = np.zeros((0, len(model.langs)))

    def batch(self, texts: pd.Series) -> list[tuple[str, float]]:
        bags = [Counter(WORD.findall(t.lower())) if t is not None else {} for t in texts]
        if len(self.cache) > CACHE:
            self.cache, self.table = {}, self.table[:0]
        new = list({w for b in bags for w in b if w not in self.cache})
        if new:
            self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new))))
            self.table = np.vstack([self.table, self.seg.log_words(new)])
        out = []
        for text, bag in zip(texts, bags):
            if not bag or not any(w.isalpha() or any(c.isalpha() for c in w) for w in bag):
                out.append(("und", 0.0))
                continue
            at = [self.cache[w] for w in bag]
            ll = np.fromiter(bag.values(), dtype=float, count=len(at)) @ self.table[at] + self.model.log_prior
            p = np.exp(ll - ll.max())
            best = int(np.argmax(ll))
            out.append((self.model.langs[best], float(p[best] / p.sum())))
        return out


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(shared.value)
        for texts in batches:
            if not scorer.model.langs:
                yield pd.DataFrame({"lang": ["und"] * len(texts), "score": [0.0] * len(texts)})
                continue
            # a few hundred texts at a time, so that the batch's word bags stay small
            got = [x for i in range(0, len(texts), 512) for x in scorer.batch(texts.iloc[i:i + 512])]
            yield pd.DataFrame({"lang": [x[0] for x in got], "score": [x[1] for x in got]})

    return (docs.withColumn("_guess", guess(F.col(text))).withColumn(name, F.col("_guess.lang"))
            .withColumn(score, F.col("_guess.score")).drop("_guess"))

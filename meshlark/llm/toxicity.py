"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and distance-weighted votes.

Training reads a bounded sample of labelled rows (EXAMPLES, by hash, so that classes keep their natural rates). Every term of
the sample is indexed, whatever its frequency; its inverse document frequency counts all documents. A term's weight in a
text is (1 + log count) * idf * relevance. Relevance, between FLOOR and 1, grows with the standard errors by which the
term's presence differs between the classes of the sample: words of one's language or topic count little, yet never nothing.

The index holds postings by term in blocks of BLOCK examples, with the largest weight of each term in each block. A query
bounds every block by the sum of its weights times those maxima, opens the FIRST blocks of largest bound, and then all whose
bound can still reach the k-th best cosine; the result is exact. Examples of like strong terms, then of like languages,
share blocks, which keeps bounds sharp. The NEIGHBOURS nearest examples vote with weight 1 / (1 - cosine + 0.05); examples
tied at the last place share what is left of it. The share of toxic votes becomes a probability by a logistic map, fitted
on the examples themselves, each asked without its own row (leave one out).

Defined results: null and empty texts, and texts without any term of the sample, score the rate of toxic rows in the sample;
documents without a label are scored like any other; rows whose doc_id occurs twice are scored each, and of several texts
under one labelled doc_id the least is the example; without labels of both classes every score is the rate; an empty table
gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meshlark.llm.common import written

#: The bound on labelled rows that are collected and sent to every executor.
EXAMPLES = 4096
NEIGHBOURS, BLOCK, FIRST, PRIOR = 15, 64, 2, 1.0
#: The most frequent terms, whose postings are kept as matrices, and the queries answered together.
COMMON, TOGETHER = 512, 128
#: The least relevance of a term, and the standard errors at which relevance is halfway.
FLOOR, HALFWAY = 0.01, 3.0
_TERM = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that no learning may use: crc32 of the doc_id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms_of(text: str | None) -> Counter:
    return Counter(_TERM.findall((text or "").lower()))


def examples(docs: DataFrame, labels: DataFrame, most: int) -> list[tuple[object, int, dict[str, int]]]:
    """doc_id, label and term counts of at most `most` training rows, by hash of the doc_id."""
    usable = labels.filter(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = written(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return sorted((r["doc_id"], r["label"], terms_of(r["text"])) for r in texts.toLocalIterator())


def by_frequency(rows: list[tuple[object, int, dict[str, int]]]) -> list[str]:
    """All terms of the examples, those of most examples first."""
    found = Counter(t for _, _, c in rows for t in c)
    return sorted(found, key=lambda t: (-found[t], t))


def document_counts(docs: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many have each of the terms; counted in each task before the shuffle."""
    place = {t: k for k, t in enumerate(terms)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(place) + 1, np.int64)  # the last counts documents
        for batch in batches:
            found = [k for t in batch.column("text").to_pylist() for w in set(_TERM.findall((t or "").lower())) if (k := place.get(w)) is not None]
            seen[:-1] += np.bincount(np.array(found, np.int64), minlength=len(place))
            seen[-1] += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["t", "n"])

    table = docs.select("text").mapInArrow(counted, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    every = np.zeros(len(terms) + 1, np.int64)
    every[table["t"].to_numpy()] = table["n"].to_numpy()
    return int(every[-1]), every[:-1]


def relevance(rows: list[tuple[object, int, dict[str, int]]], place: dict[str, int]) -> np.ndarray:
    """FLOOR to 1 for each term: how surely its presence differs between the classes (with a correction for continuity)."""
    labels = np.array([y for _, y, _ in rows])
    n, n_toxic = len(rows), int(labels.sum())
    of = np.fromiter((place[t] for _, _, c in rows for t in c), np.int64)
    toxic = np.bincount(of, np.repeat(labels, [len(c) for _, _, c in rows]), len(place))
    every = np.bincount(of, minlength=len(place))
    expected = every * n_toxic / n
    spread = np.sqrt(np.maximum(every * (n - every), 1) / n * (n_toxic / n) * (1 - n_toxic / n)) + 1e-9
    z = np.maximum(np.abs(toxic - expected) - 1, 0) / spread
    return FLOOR + (1 - FLOOR) * z**4 / (z**4 + HALFWAY**4)


class BlockMaxIndex:
    """Unit vectors of labelled examples, as postings by term and block; queries are answered a batch at a time.

    Terms are numbered by falling frequency. Postings of the COMMON first terms fill their blocks well and are kept as a
    matrix a block, the others as lists; both have their largest weight in each block.
    """

    def __init__(self, rows: list[tuple[object, int, np.ndarray, np.ndarray]], strength: np.ndarray) -> None:
        """rows: id, label, terms (numbers) and their counts; strength: idf times relevance of each term."""
        self.strength = strength
        vectors = [self.vector(names, counts) for _, _, names, counts in rows]
        order = sorted(range(len(rows)), key=lambda k: (*self._likes(rows[k][2], vectors[k]), k))
        self.ids = [rows[k][0] for k in order]
        self.labels = np.array([rows[k][1] for k in order], np.int64)
        n = len(rows)
        self.blocks = max(1, -(-n // BLOCK))
        terms = np.concatenate([np.zeros(0, np.int64), *(rows[k][2] for k in order)]).astype(np.int64)
        weights = np.concatenate([np.zeros(0), *(vectors[k] for k in order)])
        places = np.repeat(np.arange(n), [len(vectors[k]) for k in order])
        self.common = min(COMMON, len(strength))
        self.dense = np.zeros((self.common, self.blocks * BLOCK))
        often = terms < self.common
        self.dense[terms[often], places[often]] = weights[often]
        self.dense_most = self.dense.reshape(self.common, self.blocks, BLOCK).max(2)
        terms, places, weights = terms[~often], places[~often], weights[~often]
        cells = terms * self.blocks + places // BLOCK
        by_cell = np.argsort(cells, kind="stable")
        self.places, self.weights, cells = places[by_cell].astype(np.int32), weights[by_cell], cells[by_cell]
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
        #: For each cell of a term and a block that has postings: where they start, the block, the largest weight.
        self.starts = np.r_[first, len(cells)]
        self.block = (cells[first] % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(cells[first] // self.blocks, np.arange(len(strength) + 1))

    def _likes(self, names: np.ndarray, w: np.ndarray) -> tuple:
        """A sort key that brings examples of like strong terms together, then those of like frequent ones."""
        top = names[np.argsort(-w, kind="stable")[:2]]
        strong = sorted(int(t) for t in top if self.strength[t] > 1.0)
        return tuple(strong), tuple(np.sort(names)[:4].tolist())

    def vector(self, names: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.strength[names]
        return w / np.sqrt(w @ w) if len(w) else w

    @staticmethod
    def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers from low to high of each range, and the length of each."""
        size = high - low
        return np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size), size

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, counts) the k examples of largest cosine, and all tied with the last, without those of
        cosine 0: places and cosines. without: a place for each query that it must not find."""
        n, width = len(queries), self.blocks * BLOCK
        of = np.repeat(np.arange(n), [len(names) for names, _ in queries])
        terms = np.concatenate([np.zeros(0, np.int64), *(names for names, _ in queries)])
        weights = np.concatenate([np.zeros(0), *(self.vector(*q) for q in queries)])
        often = terms < self.common
        dense = np.zeros((n, self.common))
        dense[of[often], terms[often]] = weights[often]
        of, terms, weights = of[~often], terms[~often], weights[~often]
        at, size = self._ranges(self.cells[terms], self.cells[terms + 1])
        of, weights = np.repeat(of, size), np.repeat(weights, size)
        corner = of * self.blocks + self.block[at]
        bounds = dense @ self.dense_most + np.bincount(corner, weights * self.most[at], n * self.blocks).reshape(n, -1)
        scores = np.zeros((n, width))

        def open_blocks(now: np.ndarray) -> None:
            for b in np.flatnonzero(now.any(0)).tolist():
                who = np.flatnonzero(now[:, b])
                scores[who, b * BLOCK : (b + 1) * BLOCK] += dense[who] @ self.dense[:, b * BLOCK : (b + 1) * BLOCK]
            some = now.reshape(-1)[corner]
            posts, lengths = self._ranges(self.starts[at[some]], self.starts[at[some] + 1])
            spots = self.places[posts] + np.repeat(of[some] * width, lengths)
            np.add(scores, np.bincount(spots, self.weights[posts] * np.repeat(weights[some], lengths), n * width).reshape(n, width), out=scores)
            if without is not None:
                scores[np.arange(n), without] = 0.0

        def least() -> np.ndarray:
            return np.partition(scores, width - k, axis=1)[:, width - k] if width >= k else np.zeros(n)

        first = np.zeros((n, self.blocks), bool)
        few = min(FIRST, self.blocks)
        np.put_along_axis(first, np.argpartition(-bounds, few - 1, axis=1)[:, :few], True, axis=1)
        open_blocks(first)
        open_blocks(~first & (bounds > 0) & (bounds >= least()[:, None] - 1e-9))
        out = []
        for row, floor in zip(scores, least().tolist()):
            found = np.flatnonzero(row >= max(1e-12, floor - 1e-9))
            found = found[np.argsort(-row[found], kind="stable")]
            out.append((found, row[found]))
        return out

    def shares(self, queries: list[tuple[np.ndarray, np.ndarray]], rate: float, without: np.ndarray | None = None) -> list[tuple[float, np.ndarray]]:
        """For each query the share of toxic votes, and the places of the nearest three."""
        out = []
        for found, cosine in self.nearest(queries, NEIGHBOURS, without):
            votes = 1 / (np.maximum(0.0, 1 - cosine) + 0.05)
            if len(found) > NEIGHBOURS:
                tied = cosine <= cosine[NEIGHBOURS - 1] + 1e-9
                votes[tied] *= (NEIGHBOURS - (~tied).sum()) / tied.sum()
            out.append((float((votes @ self.labels[found] + PRIOR * rate) / (votes.sum() + PRIOR)), found[:3]))
        return out


def _logit(share: np.ndarray) -> np.ndarray:
    return np.log((share + 0.01) / (1.01 - share))


def logistic_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the most likely logistic map, by damped Newton steps with a weak ridge towards slope 1."""
    beta = np.array([0.0, 1.0])
    design = np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        slope = design.T @ (y - p) - np.array([0.01, 0.01]) * (beta - np.array([0.0, 1.0]))
        curve = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1.0, 2.0 / (1e-12 + np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 1e-3))


class Scorer:
    """Scores whole texts: made from examples and document counts alone, so that every executor makes the same."""

    def __init__(self, rows: list[tuple[object, int, dict[str, int]]], n_docs: int, seen: np.ndarray, terms: list[str], fitted: tuple[float, float] | None = None) -> None:
        labels = np.array([y for _, y, _ in rows], float)
        self.rate = float(labels.mean()) if len(rows) else 0.0
        self.both = 0 < self.rate < 1
        self.fitted = fitted
        if not self.both:
            return
        self.place = {t: k for k, t in enumerate(terms)}
        idf = 1 + np.log((1 + n_docs) / (1 + seen))
        numbered = [(i, y, *self._numbers(c)) for i, y, c in rows]
        self.index = BlockMaxIndex(numbered, idf * relevance(rows, self.place))
        if fitted is None:
            where = {k: n for n, k in enumerate(self.index.ids)}
            shares = []
            for k in range(0, len(numbered), TOGETHER):
                some = numbered[k : k + TOGETHER]
                shares += self.index.shares([(names, n) for _, _, names, n in some], self.rate, np.array([where[i] for i, *_ in some]))
            self.fitted = logistic_fit(_logit(np.array([x for x, _ in shares])), labels)

    def _numbers(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        found = [(k, n) for t, n in counts.items() if (k := self.place.get(t)) is not None]
        names, many = zip(*found) if found else ((), ())
        return np.array(names, np.int64), np.array(many, np.int64)

    def scores(self, texts: list[str | None]) -> list[tuple[float, list]]:
        """For each text the calibrated score, and the ids of the three nearest examples."""
        if not self.both:
            return [(self.rate, [])] * len(texts)
        queries = [self._numbers(terms_of(t)) for t in texts]
        found = self.index.shares(queries, self.rate)
        a, b = self.fitted
        scores = 1 / (1 + np.exp(-(a + b * _logit(np.array([x for x, _ in found])))))
        return [(float(s), [self.index.ids[k] for k in near]) if len(names) else (self.rate, []) for s, (_, near), (names, _) in zip(scores, found, queries)]


def toxicity(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), evidence (doc_ids of the nearest three examples)."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = examples(docs, labels, most)
    terms = by_frequency(rows)
    n_docs, seen = document_counts(docs, terms)
    fitted = Scorer(rows, n_docs, seen, terms).fitted

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Scorer(rows, n_docs, seen, terms, fitted)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            distinct = list(dict.fromkeys(texts))  # copies in a batch are scored once
            known = {}
            for k in range(0, len(distinct), TOGETHER):
                known.update(zip(distinct[k : k + TOGETHER], made.scores(distinct[k : k + TOGETHER])))
            out = [known[t] for t in texts]
            ids = pa.array([e for _, e in out], pa.list_(batch.schema.field("doc_id").type))
            yield pa.record_batch([batch.column("doc_id"), pa.array([s for s, _ in out], pa.float64()), ids], ["doc_id", "score", "evidence"])

    found = docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double, evidence array<{kind}>")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")

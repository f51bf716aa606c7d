"""Main text of pages: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .html_blocks import Block, Place, blocks
from .html_training import MARK, labelled_pages

# Number of labelled pages, drawn anew from a seed; features seen less often are left out.
TRAINING_PAGES, SEED, MIN_SEEN = 900, 11, 3
STEPS, RATE, DECAY = 160, 0.15, 1e-3
_SENTENCE = re.compile(r"[.!?…](?:\s|$)")
_LEGAL = re.compile(r"©|\(c\)|all rights reserved|cookie|privacy policy|terms of|newsletter|advertis|sponsor", re.IGNORECASE)


def _fresh_features(place: Place) -> list[str]:
    """What an element adds to the tags and names around a block."""
    return [*[f"in {place.tag}"] * place.fresh_tag, *[f"named {w}" for w in place.fresh_words]]


def _inner_features(place: Place | None) -> list[str]:
    """What only the innermost elements of a block tell."""
    tag, sections, nearest = (place.tag, place.sections, place.nearest) if place else ("", (), ())
    return ["parent " + tag, "sections " + ">".join(sections), "innermost " + (sections[-1] if sections else ""),
            *[f"nearest {w}" for w in nearest]]


def _path_features(place: Place | None) -> list[str]:
    """Tags and names of the elements around a block."""
    out = _inner_features(place)
    while place:
        out += _fresh_features(place)
        place = place.parent
    return out


def _text_features(b: Block) -> list[str]:
    n = len(b.text)
    linked = b.link_chars / n
    return [f"length {min(n, 2000).bit_length()}", f"links {0 if linked == 0 else 1 + int(linked * 3.99)}",
            f"sentences {min(len(_SENTENCE.findall(b.text)), 3)}", *(["legal"] if n < 200 and _LEGAL.search(b.text) else [])]


@dataclass
class Field:
    """Weights by feature of (left out, article), of neighbours, and of the first block."""

    weights: dict[str, tuple[float, float]]
    steps: list[list[float]]
    start: list[float]

    def _score(self, features: list[str]) -> tuple[float, float]:
        found = [self.weights[f] for f in features if f in self.weights]
        return sum(f[0] for f in found), sum(f[1] for f in found)

    def _around(self, place: Place | None) -> tuple[float, float]:
        """Score of the elements around a block; each element adds its own once."""
        todo, at = [], place
        while at and at.score is None:
            todo.append(at)
            at = at.parent
        total = at.score if at else (0.0, 0.0)
        for p in reversed(todo):
            own = self._score(_fresh_features(p))
            total = p.score = (total[0] + own[0], total[1] + own[1])
        inner = self._score(_inner_features(place))
        return total[0] + inner[0], total[1] + inner[1]

    def decode(self, page: list[Block]) -> list[int]:
        """The best labels together (Viterbi)."""
        back: list[tuple[int, int]] = []
        best = (0.0, 0.0)
        for i, b in enumerate(page):
            around = self._around(b.place)
            own = self._score(_text_features(b))
            if not i:
                best = tuple(self.start[k] + around[k] + own[k] for k in (0, 1))
                continue
            come = [max((best[j] + self.steps[j][k], j) for j in (0, 1)) for k in (0, 1)]
            back.append((come[0][1], come[1][1]))
            best = tuple(come[k][0] + around[k] + own[k] for k in (0, 1))
        if not page:
            return []
        label = int(best[1] > best[0])
        out = [label]
        for pointers in reversed(back):
            label = pointers[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[str]) -> Field:
    """Likelihood of the labels, by forward and backward sums over all pages at once."""
    chains, labels = [], []
    for page in pages:
        found = blocks(page)
        mine = [int(MARK in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(MARK, "").strip() or "-"
        chains.append([_path_features(b.place) + _text_features(b) for b in found])
        labels.append(mine)
    seen: dict[str, int] = {}
    for chain in chains:
        for fs in chain:
            for f in fs:
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= MIN_SEEN))}
    n, most = len(chains), max(map(len, chains))
    inside = np.array([[t < len(c) for t in range(most)] for c in chains])
    y = np.array([m + [0] * (most - len(m)) for m in labels])
    rows = np.array([(p * most + t, index[f]) for p, c in enumerate(chains) for t, fs in enumerate(c) for f in fs
                     if f in index])
    place, feature = rows[:, 0], rows[:, 1]
    parameters = [np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, STEPS + 1):
        weights, steps, start = parameters
        e = np.stack([np.bincount(place, weights[feature, k], n * most) for k in (0, 1)], axis=1).reshape(n, most, 2)
        node, pair = _marginals(e, inside, steps, start)
        d_node = node - np.eye(2)[y] * inside[:, :, None]
        told = np.zeros((2, 2))
        both = inside[:, 1:]
        np.add.at(told, (y[:, :-1][both], y[:, 1:][both]), 1)
        d_weights = np.stack([np.bincount(feature, d_node.reshape(-1, 2)[place, k], len(index)) for k in (0, 1)], axis=1)
        grads = [d_weights / n + DECAY * weights, (pair - told) / n + DECAY * steps, d_node[:, 0].mean(axis=0)]
        for g, p, m, v in zip(grads, parameters, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    weights, steps, start = parameters
    return Field({f: (float(weights[i, 0]), float(weights[i, 1])) for f, i in index.items()}, steps.tolist(), start.tolist())


def _marginals(e: np.ndarray, inside: np.ndarray, steps: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each label at each block, and expected neighbours over all pages."""
    n, most, _ = e.shape
    ahead, behind = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    ahead[:, 0] = e[:, 0] + start
    for t in range(1, most):
        ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + steps, axis=1) + e[:, t]
    for t in range(most - 2, -1, -1):
        come = np.logaddexp.reduce(steps + (e[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
        behind[:, t] = np.where(inside[:, t + 1, None], come, 0)
    both = ahead + behind
    node = np.exp(both - np.logaddexp.reduce(both, axis=2, keepdims=True)) * inside[:, :, None]
    pair = np.zeros((2, 2))
    for t in range(1, most):
        p = ahead[:, t - 1, :, None] + steps + (e[:, t] + behind[:, t])[:, None, :]
        p = np.exp(p - np.logaddexp.reduce(p.reshape(n, 4), axis=1)[:, None, None])
        pair += p[inside[:, t]].sum(axis=0)
    return node, pair


def main_text(model: Field, page: str) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, model.decode(found), strict=True) if label)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, url and the article's text of each page, row by row.

    Null and empty pages, and pages without an article, have the empty text.
    The model is fitted on TRAINING_PAGES labelled pages that are drawn from a
    seed. Repeated rows are treated alike; other columns are not read.
    """
    model = fit(labelled_pages(TRAINING_PAGES, SEED))
    rows = pages.select(F.col(key).alias("page_id"), "url", F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(model, page.as_py()) for page in batch.column(2)], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))

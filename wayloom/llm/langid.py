"""Language identification by a small convolutional network over bytes, trained with numpy.

A text is read as fixed-length windows of bytes. Each byte is looked up in a learned table; filters of several widths
run over the window; the largest response of each filter feeds a softmax. A document's language is the one with the
largest mean probability over all its windows, each weighted by how many bytes it has.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts

WINDOW = 128
#: Of a window's bytes, those that the next one reads again, so that no filter misses what lies across the border.
OVERLAP = 3
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: Windows that go through the network at once.
BATCH = 2048
#: Bounds of the training sample: documents of each language, and windows of each document, spread over all of it.
TRAIN_DOCS = 600
TRAIN_WINDOWS = 6
UNDETERMINED = "und"

#: Letters of any script, and a few numbers that isalpha() tells from them.
find_letters = re.compile(r"[^\W\d_]").finditer


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in find_letters(text))



@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, dict]:
        """Probabilities of each window, and what the training needs again."""
        kept: dict = {"patches": [], "best": [], "pooled": []}
        x = self.embed[windows]
        for width, w, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            n = windows.shape[1] - width + 1
            patches = np.concatenate([x[:, i : i + n] for i in range(width)], axis=2)
            response = patches.reshape(-1, width * EMBED) @ w + b
            response = response.reshape(len(windows), n, FILTERS)
            kept["patches"].append(patches)
            kept["best"].append(response.argmax(1))
            kept["pooled"].append(np.maximum(response.max(1), 0))
        features = np.concatenate(kept["pooled"], axis=1)
        return softmax(features @ self.out + self.out_bias), kept

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """The same by one sum of table rows a filter position: the filters are applied to the 256 byte vectors once."""
        pooled = []
        for table, bias in zip(self.tables(), self.biases, strict=True):
            n = windows.shape[1] - len(table) + 1
            total = table[0][windows[:, :n]]
            for i in range(1, len(table)):
                total += table[i][windows[:, i : i + n]]
            pooled.append(np.maximum(total.max(1) + bias, 0))
        return softmax(np.concatenate(pooled, axis=1) @ self.out + self.out_bias)

    def tables(self) -> list[list[np.ndarray]]:
        return [
            [self.embed @ w[i * EMBED : (i + 1) * EMBED] for i in range(width)]
            for width, w in zip(WIDTHS, self.filters, strict=True)
        ]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut(text: str) -> np.ndarray:
    """All windows of a text, lower-cased; the last is filled with zeros."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    step = WINDOW - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + WINDOW, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross-entropy of single windows; languages weigh alike, however many samples they have."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    windows, target = [], []
    for text, label in zip(texts, labels, strict=True):
        w = cut(text)
        w = w[np.unique(np.linspace(0, len(w) - 1, TRAIN_WINDOWS).astype(int))]
        windows.append(w)
        target += [names.index(label)] * len(w)
    x, y = np.concatenate(windows), np.array(target)
    weight = (len(y) / np.bincount(y, minlength=len(names)) / len(names))[y].astype(np.float32)
    make = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(
        names, make(256, EMBED, scale=0.5), [make(w * EMBED, FILTERS, scale=(w * EMBED) ** -0.5) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], make(FILTERS * len(WIDTHS), len(names), scale=0.1), np.zeros(len(names), np.float32),
    )
    params = [net.embed, *net.filters, *net.biases, net.out, net.out_bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            b = order[i : i + 128]
            t += 1
            for k, (p, g) in enumerate(zip(params, gradients(net, x[b], y[b], weight[b]), strict=True)):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-7)
    return net


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """In the order of train()'s parameters."""
    p, kept = net.forward(x)
    d = p.copy()
    d[np.arange(len(y)), y] -= 1
    d *= weight[:, None] / len(y)
    features = np.concatenate(kept["pooled"], axis=1)
    d_features = d @ net.out.T
    d_embed, d_filters, d_biases = np.zeros_like(net.embed), [], []
    rows = np.arange(len(x))[:, None]
    for k, width in enumerate(WIDTHS):
        g = d_features[:, k * FILTERS : (k + 1) * FILTERS] * (kept["pooled"][k] > 0)
        best = kept["best"][k]
        chosen = kept["patches"][k][rows, best]  # window, filter, width * EMBED
        d_filters.append(np.einsum("nf,nfe->ef", g, chosen))
        d_biases.append(g.sum(0))
        back = (g[:, :, None] * net.filters[k].T[None]).reshape(len(x), FILTERS, width, EMBED)
        for i in range(width):
            np.add.at(d_embed, x[rows, best + i], back[:, :, i])
    return [d_embed, *d_filters, *d_biases, features.T @ d, d.sum(0)]


def classifier(net: Network | None) -> Callable[[list], list[tuple]]:
    """A function from texts to (lang_pred, score)."""

    def predict(texts: list) -> list[tuple]:
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        out: list[tuple] = [(UNDETERMINED, 0.0)] * len(texts)
        if net is None or not known:
            return out
        cuts = [cut(texts[i]) for i in known]
        windows = np.concatenate(cuts)
        p = np.concatenate([net.probabilities(windows[i : i + BATCH]) for i in range(0, len(windows), BATCH)])
        p *= (windows > 0).sum(1, keepdims=True)
        sums = np.add.reduceat(p, np.cumsum([0, *map(len, cuts[:-1])]), axis=0)
        sums /= sums.sum(1, keepdims=True)
        for i, s in zip(known, sums, strict=True):
            out[i] = (net.labels[int(s.argmax())], min(1.0, float(s.max())))
        return out

    return predict


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = TRAIN_DOCS, chars: int = 20_000) -> Network | None:
    """Fits the network on at most docs_per_language texts of up to chars characters for each language of labelled.

    Rows are picked by the hash of their text. None if no labelled text has a letter.
    """
    text, lang = F.col(text_col), F.col(lang_col)
    rows = labelled.where(lang.isNotNull() & (F.char_length(text) <= chars) & text.rlike(r"\p{L}")).select(text.alias("text"), lang.alias("lang"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    some = rows.withColumn("place", place).where(F.col("place") <= docs_per_language).orderBy("lang", "place").collect()
    return train([r["text"] for r in some], [r["lang"] for r in some]) if some else None


def held_out(id_col: str) -> Column:
    """Documents that are never learned from: a quarter, by the checksum of their id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of docs, in one pass without a shuffle; with whole, the row in a struct doc too.

    Whole texts are read, window by window. A null text or one without a letter is 'und' with score 0, and so is any
    text if there is no network. Repeated rows and null ids each give a row of their own; an empty table gives an empty
    result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = [F.struct(*(docs[c] for c in docs.columns)).alias("doc")] if whole else []
    rows = docs.select(*kept, docs[id_col], held_out(id_col).alias("held_out"), docs[text_col].alias("text"))
    return map_texts(rows, lambda: classifier(shared.value), "lang_pred string, score double")

"""Subword bags: hashed word and character n-gram features of many texts, and linear models over their averages.

A bag is a text or a window of its words. Its features are, for every word, the word itself and the n-grams of its
bytes between markers, each hashed to one of a fixed number of vectors. A bag's vector is the average of its features'
vectors, and a softmax over it gives the classes. Vectors and softmax are learned together by stochastic gradient
descent in numpy on a bounded sample. As averages are linear, a trained model is one number per feature, and scoring
looks up each distinct word of a block once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from eventloom.llm.words import _LOWER, hashed, joined, mix, spans

_AS_IS = np.arange(256, dtype=np.uint8)


@dataclass(frozen=True)
class Shape:
    """How texts become bags; fixed before training."""

    buckets: int = 1 << 18
    shortest: int = 3
    longest: int = 5
    lower: bool = True
    #: Words in a bag; 0: the whole text is one bag.
    window: int = 0
    #: Also the pair of each word with the one before it; all pairs of equal words share a feature.
    pairs: bool = False


@dataclass
class Bags:
    """Texts as counted distinct words, and those words as features."""

    features: np.ndarray  # of the distinct words, one word after another
    word_starts: np.ndarray
    words: np.ndarray  # per entry, the distinct word, or a feature of its own as -1 - feature
    counts: np.ndarray
    bags: np.ndarray  # per entry, its bag; ascending
    bag_text: np.ndarray  # per bag, its text


def word_features(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, shape: Shape
) -> tuple[np.ndarray, np.ndarray]:
    """The features of each word: the word's own, then its n-grams; and where each word's begin."""
    letters = _LOWER if shape.lower else _AS_IS
    sizes = ends - starts + 2
    begin = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    text = np.full(total, 1, dtype=np.uint64)  # 1 and 2 mark a word's start and end
    inner = np.ones(total, dtype=bool)
    inner[begin] = inner[begin + sizes - 1] = False
    plain = ends - starts
    at = np.repeat(starts - np.cumsum(plain) + plain, plain) + np.arange(int(plain.sum()))
    text[inner] = letters[data[at]].astype(np.uint64) + np.uint64(3)
    text[begin + sizes - 1] = 2
    owner = np.repeat(np.arange(len(starts)), sizes)
    end = np.repeat(begin + sizes, sizes)
    found, owners = [mix(keys) % np.uint64(shape.buckets)], [np.arange(len(starts))]
    place, gram = np.arange(total), text
    for n in range(2, shape.longest + 1):
        gram = gram[: total - n + 1] * np.uint64(263) + text[n - 1 :] if total >= n else gram[:0]
        if n >= shape.shortest:
            ok = place[: len(gram)] + n <= end[: len(gram)]
            found.append(mix(gram[ok] + np.uint64(n << 56)) % np.uint64(shape.buckets))
            owners.append(owner[: len(gram)][ok])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    word_starts = np.searchsorted(owners[order], np.arange(len(starts) + 1))
    return np.concatenate(found)[order].astype(np.int64), word_starts


def bags_of(texts: list[bytes], shape: Shape) -> Bags:
    """All texts as bags. A text without words is one bag without features."""
    data, begin = joined(texts)
    starts, ends = spans(data)
    first = np.searchsorted(starts, begin)
    counts = np.diff(first)
    keys = hashed(data, starts, ends, _LOWER if shape.lower else _AS_IS)
    place = np.arange(len(keys)) - np.repeat(first[:-1], counts)
    per_text = np.maximum(1, -(-counts // shape.window)) if shape.window else np.ones(len(texts), np.int64)
    bag_text = np.repeat(np.arange(len(texts)), per_text)
    first_bag = np.cumsum(per_text) - per_text
    bag = np.repeat(first_bag, counts) + (place // shape.window if shape.window else 0)
    distinct, one, word = np.unique(keys, return_index=True, return_inverse=True)
    features, word_starts = word_features(data, starts[one], ends[one], distinct, shape)
    code = bag.astype(np.int64) * max(1, len(distinct)) + word
    if shape.pairs:
        before = np.concatenate([[np.uint64(0)], keys[:-1]]) if len(keys) else keys
        pair = np.where(before == keys, np.uint64(1), mix(before * np.uint64(3) + keys)) % np.uint64(shape.buckets)
        inside = place > 0
        pair_code = bag[inside].astype(np.int64) * shape.buckets + pair[inside].astype(np.int64)
    entry, many = np.unique(code, return_counts=True)
    bags, words = entry // max(1, len(distinct)), entry % max(1, len(distinct))
    if shape.pairs:
        entry, more = np.unique(pair_code, return_counts=True)
        bags = np.concatenate([bags, entry // shape.buckets])
        words = np.concatenate([words, -1 - entry % shape.buckets])
        many = np.concatenate([many, more])
        order = np.argsort(bags, kind="stable")
        bags, words, many = bags[order], words[order], many[order]
    return Bags(features, word_starts, words, many, bags, bag_text)


@dataclass
class Model:
    shape: Shape
    weights: np.ndarray  # per feature, what it adds to the log odds of class 1
    bias: float

    def log_odds(self, texts: list[bytes]) -> np.ndarray:
        """Of each text; of several bags the largest counts."""
        b = bags_of(texts, self.shape)
        sizes = np.diff(b.word_starts)
        sums = np.add.reduceat(np.append(self.weights[b.features], 0.0), b.word_starts[:-1]) if len(sizes) else np.empty(0)
        own = b.words < 0
        known = np.maximum(b.words, 0)
        value = np.where(own, self.weights[np.where(own, -1 - b.words, 0)], sums[known] if len(sums) else 0.0)
        size = np.where(own, 1, sizes[known] if len(sizes) else 1)
        n = len(b.bag_text)
        total = np.bincount(b.bags, value * b.counts, n)
        average = total / np.maximum(1, np.bincount(b.bags, size * b.counts, n))
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, b.bag_text, average + self.bias)
        return out


@dataclass(frozen=True)
class Training:
    dimensions: int = 4
    epochs: int = 5
    batch: int = 64
    rate: float = 0.5
    seed: int = 7
    #: How much an example of class 1 counts against one of class 0.
    weight: float = 1.0


def train(texts: list[bytes], labels: np.ndarray, shape: Shape, how: Training) -> Model:
    """Learn vectors and softmax together. With windows, a text's bag of the highest odds stands for the text."""
    if not len(texts):  # nothing to learn from: even odds for all
        return Model(shape, np.zeros(shape.buckets, dtype=np.float32), 0.0)
    rng = np.random.default_rng(how.seed)
    vectors = rng.normal(0, 1.0 / how.dimensions, (shape.buckets, how.dimensions)).astype(np.float32)
    squares = np.full(shape.buckets, 1e-8, dtype=np.float32)
    output = rng.normal(0, 0.5, (how.dimensions, 2)).astype(np.float32)
    output_squares = np.full(output.shape, 1e-8, dtype=np.float32)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    bias = np.array([np.log(1 - share), np.log(share)], dtype=np.float32)
    bias_squares = np.full(2, 1e-8, dtype=np.float32)
    for epoch in range(how.epochs):
        rate = how.rate * (1 - epoch / how.epochs)
        order = rng.permutation(len(texts))
        for i in range(0, len(order), how.batch):
            chosen = order[i : i + how.batch]
            b = bags_of([texts[k] for k in chosen.tolist()], shape)
            n = len(b.bag_text)
            # one row per entry and feature: the entry's bag, the feature, and its share of the bag
            own = b.words < 0
            known = np.maximum(b.words, 0)
            sizes = np.where(own, 1, np.diff(b.word_starts)[known])
            if not len(sizes):
                continue
            begin = np.where(own, 0, b.word_starts[known]) - np.cumsum(sizes) + sizes
            at = np.minimum(np.repeat(begin, sizes) + np.arange(int(sizes.sum())), len(b.features) - 1)
            feature = np.where(np.repeat(own, sizes), np.repeat(-1 - b.words, sizes), b.features[at])
            bag = np.repeat(b.bags, sizes)
            amount = np.repeat(b.counts, sizes).astype(np.float32)
            total = np.maximum(1, np.bincount(bag, amount, n)).astype(np.float32)
            amount /= total[bag]
            parts = [np.bincount(bag, amount * vectors[feature, k], n) for k in range(how.dimensions)]
            hidden = np.stack(parts, 1)
            logits = hidden @ output + bias
            if shape.window and epoch:  # the first epoch learns from all bags
                odds = logits[:, 1] - logits[:, 0]
                best = np.lexsort((odds, b.bag_text))
                last = np.append(np.flatnonzero(np.diff(b.bag_text[best])), n - 1)
                used = np.zeros(n, dtype=bool)
                used[best[last]] = True
            else:
                used = np.ones(n, dtype=bool)
            truth = labels[chosen][b.bag_text]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), truth] -= 1
            p *= (used * np.where(truth == 1, how.weight, 1.0) / max(1, used.sum()) * how.batch / 8)[:, None]
            back = (p @ output.T).astype(np.float32)
            grad = hidden.T @ p
            output_squares += grad**2
            output -= (rate * 0.2 * grad / np.sqrt(output_squares)).astype(np.float32)
            slope = p.sum(0)
            bias_squares += slope**2
            bias -= (rate * 0.2 * slope / np.sqrt(bias_squares)).astype(np.float32)
            keep = used[bag]
            touched, place = np.unique(feature[keep], return_inverse=True)
            share_of, from_bag = amount[keep], bag[keep]
            parts = [np.bincount(place, share_of * back[from_bag, k], len(touched)) for k in range(how.dimensions)]
            grad = np.stack(parts, 1)
            squares[touched] += (grad**2).mean(1)
            vectors[touched] -= rate * grad / np.sqrt(squares[touched])[:, None]
    return Model(shape, (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0]))

"""The language models against Kneser-Ney written out for one language, and ties."""

import math
import random
from collections import Counter, defaultdict

from tidelog.llm import langid


def brute(tokens):
    """Log-probability of a word, by definitions: counts of n-grams of each order over all tokens, not from the longest ones."""
    words = [f" {langid.letters(t)} " for t in tokens if langid.letters(t)]
    grams = [(w[max(0, i - 4) : i + 1]) for w in words for i in range(1, len(w))]
    raw = Counter(grams)
    counts = [Counter() for _ in range(5)]
    before = [defaultdict(set) for _ in range(5)]
    for gram in raw:
        for k in range(1, len(gram)):
            before[k - 1][gram[-k:]].add(gram[-k - 1 :])
    for gram, n in raw.items():
        counts[len(gram) - 1][gram] += n
    for k in range(5):
        for gram, more in before[k].items():
            counts[k][gram] += len(more)

    def discount(k):
        ones, twos = (sum(c == x for c in counts[k].values()) for x in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    discounts = [discount(k) for k in range(5)]
    vocabulary = 2 + len(counts[0])

    def p(gram):
        if not gram:
            return 1 / vocabulary
        k = len(gram) - 1
        follow = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not follow:
            return p(gram[1:])
        total = sum(follow.values())
        return max(0, counts[k][gram] - discounts[k]) / total + discounts[k] * len(follow) / total * p(gram[1:])

    return lambda word: sum(math.log(p(f" {word} "[max(0, i - 4) : i + 1])) for i in range(1, len(word) + 2))


def test_model():
    rng = random.Random(6)
    tokens = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 8))) for _ in range(120)] + ["The", "the,", "9"]
    model, want = langid.Model({"x": langid._grams(Counter(tokens))}), brute(tokens)
    words = ["the", "abc", "zz", "é", "cabbacabba", "bae", *map(langid.letters, tokens[:20])]
    sums, n = model.words(words)
    for w, s, k in zip(words, sums[:, 0], n):
        assert k == len(w) + 1 and abs(s - want(w)) < 1e-5 * max(1, abs(s))


def test_ties():
    grams = langid._grams(Counter(["same", "words"]))
    scorer = langid.Scorer(langid.Model({"b": grams, "a": grams}))
    assert [x[0] for x in scorer.texts(["same words", "other", None, "1 2"])] == ["a", "a", "und", "und"]
    assert scorer.texts(["same words"])[0][1] == 0.5

"""Direct, symbol-by-symbol PPM-C scorer. Slow; for checking small strings only."""

from collections import defaultdict
from math import log2


def fit(text, order):
    counts = [defaultdict(lambda: defaultdict(int)) for _ in range(order + 1)]
    for i, sym in enumerate(text):
        for j in range(min(i, order) + 1):
            counts[j][text[i - j:i]][sym] += 1
    return counts


def score(text, counts, order, alphabet):
    total = 0.0
    for i, sym in enumerate(text):
        excluded = set()
        for j in range(min(i, order), -1, -1):
            seen = counts[j].get(text[i - j:i])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            if not left:
                continue
            weight = sum(left.values()) + len(left)
            if sym in left:
                total -= log2(left[sym] / weight)
                break
            total -= log2(len(left) / weight)
            excluded |= set(left)
        else:
            total += log2(max(1, alphabet - len(excluded)))
    return total


def self_bits(text, order):
    return score(text, fit(text, order), order, 256)

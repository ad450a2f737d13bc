"""Plain restatements of the operators for small inputs."""

import collections
import hashlib
import math
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def kept_words(rows, width):
    """n_words, n_removed and digest of each row."""
    cut = [words(t) for t in rows]
    uses = collections.Counter(tuple(w[i:i + width]) for w in cut for i in range(len(w) - width + 1))
    out = []
    for w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if uses[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def shingles(text, k=5):
    w = words(text)
    k = min(k, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def similar_rows(texts, least=0.8):
    """Numbers of links and group labels (smallest position) of each row."""
    sets = [shingles(t) for t in texts]
    holds = collections.defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            holds[x].append(n)
    links, label = [0] * len(texts), list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, s in enumerate(sets):
        both = collections.Counter(m for x in s for m in holds[x] if m > n)
        for m, v in both.items():
            if v / (len(s) + len(sets[m]) - v) >= least:
                links[n] += 1
                links[m] += 1
                a, b = root(n), root(m)
                label[max(a, b)] = min(a, b)
    return links, [root(n) for n in range(len(texts))]


def backoff(texts, order=3, alpha=0.4):
    cut = [words(t) for t in texts]
    grams = lambda w: collections.Counter(tuple(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    own = [grams(w) for w in cut]
    total = sum(own, collections.Counter())
    n = sum(map(len, cut))
    out = []
    for w, mine in zip(cut, own):
        s = 0.0
        for i in range(len(w)):
            most = min(order, i + 1)
            for k in range(most, 0, -1):
                g = tuple(w[i - k + 1:i + 1])
                c = total[g] - mine[g]
                if c:
                    rest = total[g[:-1]] - mine[g[:-1]] if k > 1 else max(n - len(w), 1)
                    s += math.log(c / rest) + (most - k) * math.log(alpha)
                    break
            else:
                s += -math.log(max(n - len(w), 1)) + most * math.log(alpha)
        out.append(s if w else None)
    return out


def quality_counts(text):
    w = words(text)
    uses = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = [False] * len(w)
    for i in range(len(w) - 7):
        if uses[tuple(w[i:i + 8])] > 1:
            again[i:i + 8] = [True] * 8
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(again)


def best_path(pieces, text, unknown):
    """Greatest total score of all ways to cut a text into pieces or single unknown characters."""
    best = [0.0] + [-math.inf] * len(text)
    longest = max(map(len, pieces))
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + longest) + 1):
            if text[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[text[i:j]][1])
        if text[i] not in pieces:
            best[i + 1] = max(best[i + 1], best[i] + unknown)
    return best[-1]

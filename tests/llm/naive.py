"""Plain versions of the operators, one text at a time, to hold the real ones against."""

import math
import re

import numpy as np

from pathquarry.llm import decontamination as D
from pathquarry.llm import quality_knn as Q
from pathquarry.llm import toxicity as X
from pathquarry.llm.common import SpanHash, mix64


def name(data: bytes) -> int:
    return int(SpanHash(np.frombuffer(data, np.uint8))(np.array([0]), np.array([len(data)]))[0])


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def lower(data: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in data)


# --- quality: features, cosines and votes ---


def features(text) -> np.ndarray:
    out = np.zeros(Q.FEATURES)
    own = words(text)

    def add(value: int, salt: int, weight: float) -> None:
        out[int(mix64(np.array([(value + (salt << 32)) % 2**64], np.uint64))[0]) % Q.FEATURES] += weight

    before, last = 1, []
    for w in own:
        kinds = "".join("a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b) for b in w)
        shape = name(re.sub(r"(.)\1*", r"\1", kinds, flags=re.S).encode("latin-1"))
        low = lower(w)
        same = sum(1 << k for k in (0, 1) if len(last) > k and last[-1 - k] == low)
        add(shape, 1, 1.0)
        add(int(mix64(np.array([(before * 31 + shape) % 2**64], np.uint64))[0]), 2, 1.0)
        add(same, 3, 1.0)
        add(name(low), 4, Q.WORD_WEIGHT)
        before = shape
        last.append(low)
    out /= max(len(own), 1)
    out[int(mix64(np.array([int(math.log2(len(own) + 1)) + (5 << 32)], np.uint64))[0]) % Q.FEATURES] += 0.1
    return np.sqrt(out)


def vote(model, text) -> float:
    if not words(text):
        return 0.0
    v = (features(text) * model.rarity) @ model.basis
    v = v / math.sqrt(float(v @ v))
    cosines = [round(float(v @ w), 5) for w in model.vectors]
    last = sorted(cosines, reverse=True)[: Q.NEIGHBOURS][-1]
    above, tied = sum(c > last for c in cosines), sum(c == last for c in cosines)
    share = [1.0 if c > last else (min(Q.NEIGHBOURS, len(cosines)) - above) / tied if c == last else 0.0 for c in cosines]
    weight = [s * max(c, 0.0) ** 4 for s, c in zip(share, cosines)]
    return sum(w * y for w, y in zip(weight, model.labels)) / sum(weight)


# --- toxicity: the mean of n-gram vectors over words, of words over windows, and the highest window ---


def toxic(model, text) -> float:
    own = re.findall(rb"[a-z0-9\x80-\xff@$*]+", lower((text or "").encode()))
    own = [w for k, w in enumerate(own) if k == 0 or w != own[k - 1]]
    value = {}
    for w in set(own):
        padded = b"<" + w + b">"
        grams = [padded] + [padded[i : i + n] for n in X.SIZES for i in range(len(padded) - n + 1)]
        value[w] = sum(model.value[name(g) % X.BUCKETS] for g in grams) / len(grams)
    best, half = -math.inf, X.WINDOW // 2
    for k in range(max(1, -(-(len(own) - X.WINDOW) // half) + 1) if own else 0):
        end = min(k * half + X.WINDOW, len(own))
        best = max(best, sum(value[w] for w in own[max(end - X.WINDOW, 0) : end]) / X.WINDOW)
    return 1 / (1 + math.exp(-((best if own else 0.0) + model.bias)))


# --- decontamination of ASCII texts ---


def canonical(text):
    """[(template, value)] with slots and joined names, and the plain tokens."""
    tokens, plain, end, number_before = [], [], 0, False
    for k, m in enumerate(re.finditer(r"\d(?:[.,](?=\d)|\d)*|[A-Za-z]+", text or "")):
        said = m.group().lower()
        opens = k == 0 or re.search(r'[.!?:;\n"]', text[end : m.start()]) is not None
        if said[0].isdigit():
            kind = "NUMBER"
        elif number_before and said in D.UNITS:
            kind = "UNIT"
        else:
            kind = None
        if not opens and re.match(r"[A-Z][^A-Z]", m.group()):
            kind = "NAME"
        plain.append(said)
        if kind == "NAME" and tokens and tokens[-1][0] == "NAME":
            tokens[-1] = ("NAME", text[tokens[-1][2] : m.end()].lower(), tokens[-1][2])
        else:
            tokens.append((kind or said, said, m.start()))
        end, number_before = m.end(), said[0].isdigit()
    return [t[:2] for t in tokens], plain


def leaks(text, item) -> bool:
    (theirs, plain_item), (own, plain) = canonical(item), canonical(text)
    slots = ("NUMBER", "UNIT", "NAME")
    n, found = len(theirs), set()
    if n >= D.LEAST:
        width, at = min(D.WIDTH, n), {}
        for j in range(len(own) - width + 1):
            at.setdefault(tuple(t for t, _ in own[j : j + width]), []).append(j)
        shifts = {}
        for i in range(n - width + 1):
            window = tuple(t for t, _ in theirs[i : i + width])
            if sum(t not in slots for t in window) >= D.LITERALS:
                for j in at.get(window, ()):
                    shifts.setdefault(j - i, set()).update(range(i, i + width))
        for shift, places in shifts.items():
            pairs = {(theirs[q][0], theirs[q][1], own[q + shift][1]) for q in places if theirs[q][0] in slots}
            one = all(len({b for k, a, b in pairs if (k, a) == key}) == 1 for key in {(k, a) for k, a, _ in pairs})
            other = all(len({a for k, a, b in pairs if k == "NAME" and b == said}) == 1 for said in {b for k, _, b in pairs if k == "NAME"})
            if one and other:
                found |= places
        if found and (len(found) >= D.SHARE * n or len(found) >= D.LONG):
            return True
    n = len(plain_item)
    longest = 0
    for i in range(n):
        for j in range(len(plain)):
            k = 0
            while i + k < n and j + k < len(plain) and plain_item[i + k] == plain[j + k]:
                k += 1
            longest = max(longest, k)
    return n > 0 and longest >= min(D.WIDTH, n) and (longest >= D.SHARE * n or longest >= D.LONG)


# --- near duplicates ---


def shingles(text, width=5):
    own = [lower(w) for w in words(text)]
    return {tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set()


def similar(a, b) -> bool:
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}

"""Small documents with every awkward case, and plain-Python versions of the operators."""

from __future__ import annotations

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string, n long, id long, score double"


def rows(count: int = 60, seed: int = 3) -> list[tuple]:
    """Nulls, empty and long texts, repeated rows, shared passages, and columns whose names operators use inside."""
    pick = random.Random(seed)
    words = [pick.choice("abdeé") + pick.choice(["ran", "öl", "tin", "mo"]) * pick.randint(1, 3) for _ in range(300)]
    passage = " ".join(pick.choices(words, k=60))
    texts: list[str | None] = [None, "", "   \n\t ", "a", "a b", passage]
    while len(texts) < count:
        own = pick.choices(words, k=pick.randint(1, 120))
        text = " ".join(own)
        texts.append(pick.choice([text, text, f"{text} {passage}", f"{passage}\n\n{text}", text + " !!! a.b@c.example +1 (555) 123-4567"]))
    texts += [texts[-1], texts[7], " ".join(texts[7].split()[:-1]), " ".join(pick.choices(words, k=20_000))]
    made = [(i, t, pick.choice(["en", "fr", None]), None, None, "k", 1, 2, 0.5) for i, t in enumerate(texts)]
    return [*made, made[8], made[8]]


def removed_bytes(docs: list[tuple[int, str | None]], length: int) -> dict[int, tuple[bytes, int]]:
    """What is left of each text, and how many bytes went."""
    first: dict[bytes, int] = {}
    for i, text in docs:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            first[s] = min(first.get(s, i), i)
    left = {}
    for i, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        left[i] = bytes(b for b, g in zip(data, gone) if not g), sum(gone)
    return left


def groups(docs: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """Shingle count and smallest linked id of each text, over all pairs."""
    sets = {}
    for i, text in docs:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        short = {tuple(words)} if words else set()
        sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else short
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and label[a] != label[b] and 100 * len(x & y) >= percent * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(x), label[i]) for i, x in sets.items()}


def kneser_ney(counts: dict[str, int]):
    """The probability of the last character of a four-gram, of interpolated Kneser-Ney orders."""
    orders = []
    while True:
        once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
        less = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
        contexts: dict[str, list[int]] = {}
        for gram, n in counts.items():
            total = contexts.setdefault(gram[:-1], [0, 0])
            total[0], total[1] = total[0] + n, total[1] + 1
        orders.append((counts, less, contexts))
        if "" in contexts:
            break
        shorter: dict[str, int] = {}
        for gram in counts:
            shorter[gram[1:]] = shorter.get(gram[1:], 0) + 1
        counts = shorter

    def probability(gram: str) -> float:
        p = 1 / (len(orders[-1][0]) + 1)
        for size, (own, less, contexts) in enumerate(reversed(orders), 1):
            total, kinds = contexts.get(gram[-size:-1], (0, 0))
            share = (own[gram[-size:]] - less) / total if gram[-size:] in own else 0.0
            p = share + (less * kinds / total if total else 1.0) * p
        return p

    return probability

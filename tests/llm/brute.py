"""Plain forms of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [None, "", " \n\t ", "a", "a b", "one two three", "\x1cx\x1c y", "é à ü", "a\n\na\n\na", "a\r\na\r\n", "x " * 400, "ß" * 3000]


def corpus(seed: int = 3, n: int = 60) -> list[tuple[int, str | None]]:
    """Random texts with shared passages, copies, near copies, repeats and edge cases."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(4)]
    texts: list[str | None] = list(EDGE)
    for _ in range(n):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        if rng.random() < 0.2:
            parts += parts
        texts.append(rng.choice(["\n", " ", ". "]).join(parts))
    for _ in range(n // 3):
        words = rng.choice([t for t in texts if t and len(t) > 50]).split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words))
    ids = list(range(5, 5 + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def windows(docs, window: int) -> dict[int, tuple]:
    """op3's rows."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if k in seen:
                gone[a : a + window] = [True] * window
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def strings(docs, length: int) -> dict[int, tuple]:
    """op2's rows."""
    first: dict[bytes, int] = {}
    out = {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if first.setdefault(b[a : a + length], i) < i:
                gone[a : a + length] = b"\1" * length
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def statistics(text: str | None) -> dict[str, int]:
    t = text or ""
    w = WORD.findall(t)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_distinct": len(set(w)), "n_lines": len(lines)}


def shingles(text: str | None, size: int) -> set:
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near(docs, size: int, percent: int) -> dict[int, tuple]:
    """op10's rows: (n_shingles, component_id)."""
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def lines(docs, window: int, long_words: int | None = None) -> dict[int, tuple]:
    """op9's rows: (n_lines, n_removed, kept text)."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        rows = (t or "").split("\n")
        gone = [False] * len(rows)
        for n, least in ((window, None), (1, long_words)) if long_words else ((window, None),):
            for a in range(len(rows) - n + 1):
                k = (least, *rows[a : a + n])
                if len(words(k[1])) >= least if least else any(WORD.search(x) for x in k[1:]):
                    if k in seen:
                        gone[a : a + n] = [True] * n
                    seen.add(k)
        out[i] = (len(rows), sum(gone), "\n".join(r for r, g in zip(rows, gone, strict=True) if not g))
    return out

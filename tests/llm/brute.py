"""Brute-force versions, in plain Python, of what SQL can't express."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def counts(text: str | None) -> dict:
    """The counts of a text that the quality rules use."""
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if x.strip(SPACES)]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    cover = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    count = lambda f: sum(map(f, text))
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": count(lambda c: c in "#*$%&|<>"), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover),
        "upper": count(lambda c: "A" <= c <= "Z"), "lower": count(lambda c: "a" <= c <= "z"), "wide": count(lambda c: ord(c) > 127), "marks": count(lambda c: c in "!?"), "ends": sum(w[-1] in "#*$%&|<>" for w in words),
    }


def votes(c: dict) -> list[int]:
    def low(value, good, bad):
        return 0 if value is None else -1 if value > bad else 1 if value <= good else 0

    def high(value, good, bad):
        return 0 if value is None else -1 if value < bad else 1 if value >= good else 0

    share = lambda a, b: a / b if b > 0 else None
    letters, size = c["upper"] + c["lower"], share(c["word_chars"], c["n_words"])
    return [
        high(c["n_words"], 40, 20), low(share(c["n_symbols"], c["n_words"]), 0.05, 0.3), low(share(c["n_repeat_words"], c["n_words"]), 0.1, 0.3), low(c["n_dup_lines"] / c["n_lines"] if c["n_lines"] >= 3 else None, 0.1, 0.3),
        low(share(c["upper"], letters), 0.15, 0.4), low(share(c["marks"], c["n_words"]), 0.05, 0.3), high(share(letters + c["wide"], c["word_chars"]), 0.93, 0.84), low(share(c["ends"], c["n_words"]), 0.05, 0.3), low(None if size is None else abs(size - 6), 2.5, 4.5),
    ]


def quality(texts: list[str | None], rounds: int = 100) -> list[tuple[float, bool]]:
    """(posterior of good, kept) of each text: expectation-maximisation document by document."""
    found = [counts(t) for t in texts]
    rows = [votes(c) for c in found]
    n, rules = len(rows), 9
    p, prior = [0.1 if -1 in r else 0.95 for r in rows], 0.5
    for _ in range(rounds):
        new = (sum(p) + 1) / (n + 2)
        table = []
        for j in range(rules):
            side = []
            for weight in (p, [1 - x for x in p]):
                sums = {k: 1 + sum(w for w, r in zip(weight, rows, strict=True) if r[j] == k) for k in (-1, 0, 1)}
                whole = sum(sums.values())
                side.append({k: math.log(x / whole) for k, x in sums.items()})
            table.append(side)
        done, prior = abs(new - prior) < 1e-10, min(max(new, 1e-6), 1 - 1e-6)
        if done:
            break
        odds = [math.log(prior / (1 - prior)) + sum(table[j][0][v] - table[j][1][v] for j, v in enumerate(r)) for r in rows]
        p = [1 / (1 + math.exp(-min(max(x, -500), 500))) for x in odds]
    odds = [math.log(prior / (1 - prior)) + sum(table[j][0][v] - table[j][1][v] for j, v in enumerate(r)) for r in rows]
    post = [1 / (1 + math.exp(-min(max(x, -500), 500))) for x in odds]
    failed = [c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"] for c in found]
    return [(q, not f and q >= 0.5) for q, f in zip(post, failed, strict=True)]


def mixed(rows: list[tuple], budget: float, sweeps: int = 40, groups: int = 4) -> list[bool]:
    """Which of (doc_id, text, lang, source) are sampled."""
    own = ["abcdefghijklmnopqrstuvwxyz"[k::groups] for k in range(groups)]
    firsts = [[w[0] for w in WORD.findall(t or "")] for _, t, _, _ in rows]
    tally = [[sum(c in g or c in g.upper() for c in f) for g in own] for f in firsts]
    sums = [sum(t[k] for t in tally) for k in range(groups)]
    share = [s / sum(sums) for s in sums]
    topics = []
    for t in tally:
        above = [c / s if c else 0.0 for c, s in zip(t, share, strict=True)]
        topics.append(above.index(max(above)) if max(above) > 0 else "none")
    keys = [(s, lang, t) for (_, _, lang, s), t in zip(rows, topics, strict=True)]
    tokens = Counter()
    for k, f in zip(keys, firsts, strict=True):
        tokens[k] += len(f)
    tokens = {k: n for k, n in tokens.items() if n}
    whole, weight, goals = sum(tokens.values()), dict(tokens), []
    for d, power in enumerate((0.5, 0.7, 0.5)):
        m = Counter()
        for k, n in tokens.items():
            m[k[d]] += n
        goal = {v: n**power for v, n in m.items()}
        goals.append({v: whole * g / sum(goal.values()) for v, g in goal.items()})
    for _ in range(sweeps):
        for d, goal in enumerate(goals):
            m = Counter()
            for k, w in weight.items():
                m[k[d]] += w
            weight = {k: w * goal[k[d]] / m[k[d]] for k, w in weight.items()}
    lo, hi = 0.0, 1e9
    for _ in range(200):  # the scale that meets the budget, by bisection
        s = (lo + hi) / 2
        lo, hi = (s, hi) if sum(min(n, s * weight[k]) for k, n in tokens.items()) < budget * whole else (lo, s)
    u = lambda k: int(hashlib.md5(f"mix:{k}".encode()).hexdigest()[:12], 16) / 2**48
    return [k in tokens and u(r[0]) < min(1.0, hi * weight[k] / tokens[k]) for r, k in zip(rows, keys, strict=True)]


RULES = [re.compile(p) for p in (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")]


def masked(text: str | None) -> str | None:
    """The text with all secrets masked, overlapping ones as one."""
    spans = sorted(m.span() for k, rule in enumerate(RULES) for m in rule.finditer(text or "") if k or len(m[1]) >= 6)
    if not spans:
        return text
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]

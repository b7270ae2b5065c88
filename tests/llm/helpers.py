"""Plain Python versions of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    return [tuple(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else []


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def linked(a, b, percent=75):
    common = len(a & b)
    return bool(a) and bool(b) and 100 * common >= percent * (len(a) + len(b) - common)

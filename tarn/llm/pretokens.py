"""Byte-level pre-tokenisation of many texts in one flat array of code points."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points with the property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
APOSTROPHE = 39


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, once a process."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = (p + 0x800 * (p >= 0xD800) for p in (m.start(), m.end() - 1))
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[WHITE] = SPACE
    return out


def segments(texts: list[str], special: str) -> tuple[list[str], list[int], list[int]]:
    """Texts cut at the special string: the parts, each part's text, and the parts that are the special string."""
    parts: list[str] = []
    owner: list[int] = []
    marked: list[int] = []
    for i, t in enumerate(texts):
        if special and special in t:
            for k, p in enumerate(t.split(special)):
                if k:
                    marked.append(len(parts))
                    parts.append(special)
                    owner.append(i)
                if p:
                    parts.append(p)
                    owner.append(i)
        elif t:
            parts.append(t)
            owner.append(i)
    return parts, owner, marked


def starts(points: np.ndarray, part_starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, as a mask over the flat code points.

    part_starts: offsets of the (not empty) parts; a pre-token never crosses one.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, bool)
    c = classes()[points]
    first = np.zeros(n + 1, bool)
    first[part_starts] = True
    first[n] = True
    run = first[:n].copy()
    run[1:] |= c[1:] != c[:-1]
    blank = points == 32
    out = run.copy()

    begin = np.flatnonzero(run)
    end = np.append(begin[1:], n)
    white = c[begin] == SPACE
    # White space before other text in the part: its last character stands alone or leads the next word.
    last = end[white & ~first[end]] - 1
    out[last] = True
    words = begin[~white]
    led = words[(words > 0) & ~first[words]]
    led = led[blank[led - 1]]
    out[led] = False

    # Contractions: an apostrophe alone between a word start and one of the endings.
    alone = words[(points[words] == APOSTROPHE)]
    alone = alone[out[alone]]
    alone = alone[(alone + 1 < n)]
    alone = alone[~first[alone + 1] & (c[np.minimum(alone + 1, n - 1)] == LETTER)]
    if len(alone):
        one = points[alone + 1]
        far = np.minimum(alone + 2, n - 1)
        two = np.where(first[alone + 2], 0, points[far])
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, size in ((alone[short], 2), (alone[long], 3)):
            out[at + 1] = False
            after = at + size
            after = after[after < n]
            out[after] = True
    return out


def words(texts: list[str], special: str) -> tuple[list[str], np.ndarray]:
    """All pre-tokens of the texts in order, and how many each text has."""
    parts, owner, marked = segments(texts, special)
    if not parts:
        return [], np.zeros(len(texts), np.int64)
    big = "".join(parts)
    points = np.frombuffer(big.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    mask = starts(points, offsets[:-1])
    for k in marked:
        mask[offsets[k] + 1 : offsets[k + 1]] = False
    at = np.flatnonzero(mask)
    spots = at.tolist()
    found = [big[a:b] for a, b in zip(spots, [*spots[1:], len(big)], strict=True)]
    each = np.add.reduceat(mask, offsets[:-1], dtype=np.int64)
    return found, np.bincount(np.asarray(owner, np.int64), weights=each, minlength=len(texts)).astype(np.int64)

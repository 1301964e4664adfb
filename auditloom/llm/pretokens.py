"""Where a text is cut before byte pairs are merged, found by arrays instead of a regular expression.

The cutting pattern is a small automaton over code point classes.  Each character is a function from
state to state; composing functions is associative, and all compositions together are few, so they
are numbered and composition is one table lookup.  Prefixes of a long text are then composed block by
block, all blocks at once, and a second short scan joins the blocks.  No step depends on a text's length
or on where it stops, so one very long text costs as much as many short ones of the same size.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

# Symbols.  X: s t m d, R: r v, L2: l, E: e -- the letters that can follow an apostrophe.
LETTER, NUMBER, OTHER, SPACE, WHITE, APOS, X, R, L2, E, END = range(11)
N_SYMBOLS = 11
# States: what the characters so far leave open.
CLEAR, SPACED, LETTERS, NUMBERS, OTHERS, QUOTE, QUOTE_R, QUOTE_L, SHORT = range(9)
N_STATES = 9
#: Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTERLIKE = (LETTER, X, R, L2, E)
BLOCK = 256


@functools.cache
def classes() -> np.ndarray:
    """Symbol of every code point."""
    kind = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kind[c] = LETTER
        elif k == "N":
            kind[c] = NUMBER
    kind[WHITE_SPACE] = WHITE
    kind[0x20] = SPACE
    kind[ord("'")] = APOS
    for letters, s in (("stmd", X), ("rv", R), ("l", L2), ("e", E)):
        kind[[ord(c) for c in letters]] = s
    return kind


def _next(state: int, symbol: int) -> int:
    if symbol in (WHITE, END):
        return CLEAR
    if symbol == SPACE:
        return SPACED
    if symbol == NUMBER:
        return NUMBERS
    if symbol == OTHER:
        return OTHERS
    if symbol == APOS:
        return OTHERS if state in (SPACED, OTHERS, QUOTE) else QUOTE
    if state == QUOTE and symbol in (X, R, L2):
        return {X: SHORT, R: QUOTE_R, L2: QUOTE_L}[symbol]
    if (state, symbol) in ((QUOTE_R, E), (QUOTE_L, L2)):
        return SHORT
    return LETTERS


def _starts(state: int, symbol: int, ahead: int) -> bool:
    """Whether a piece starts at ``symbol``, given the state before it and the symbol after it."""
    if symbol == END:
        return True
    if symbol in (SPACE, WHITE):
        return state not in (CLEAR, SPACED) or ahead not in (SPACE, WHITE, END)
    if state == SPACED:
        return False
    if symbol == NUMBER:
        return state != NUMBERS
    if symbol in (OTHER, APOS):
        return state not in (OTHERS, QUOTE)
    if state == QUOTE:
        return not (symbol == X or (symbol == R and ahead == E) or (symbol == L2 and ahead == L2))
    return state not in (LETTERS, QUOTE_R, QUOTE_L)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Composition of numbered functions, their values, the start table, the number of functions."""
    symbol = [tuple(_next(s, y) for s in range(N_STATES)) for y in range(N_SYMBOLS)]
    known = {f: i for i, f in enumerate(dict.fromkeys(symbol))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in symbol:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    values = np.array(list(known), np.uint8)
    n = len(known)
    then = np.array([[known[tuple(g[x] for x in f)] for g in known] for f in known], np.uint16)
    of_symbol = np.array([known[f] for f in symbol], np.uint16)
    starts = np.array([[[_starts(s, y, a) for a in range(N_SYMBOLS)] for y in range(N_SYMBOLS)] for s in range(N_STATES)], bool)
    return then.ravel(), values, starts.ravel(), n, of_symbol


def states(symbols: np.ndarray) -> np.ndarray:
    """State after every symbol, by a scan over composed functions."""
    then, values, _, n, of_symbol = _tables()
    size = len(symbols)
    rows = -(-size // BLOCK)
    f = np.zeros(rows * BLOCK, np.intp)
    f[:size] = of_symbol[symbols]
    f = np.ascontiguousarray(f.reshape(rows, BLOCK).T)
    for j in range(1, BLOCK):
        f[j] = then[f[j - 1] * n + f[j]]
    total, step = f[-1].copy(), 1
    while step < rows:
        total[step:] = then[total[:-step] * n + total[step:]]
        step *= 2
    entry = np.full(rows, CLEAR, np.intp)
    entry[1:] = values[total[:-1], CLEAR]
    return values[f, entry[None, :]].T.reshape(-1)[:size]


def cut(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts joined, starts of the pieces in it (ends of texts are pieces of one character), and those ends."""
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    symbols = classes()[points]
    symbols[ends] = END
    after = states(symbols)
    before = np.empty_like(after)
    before[0], before[1:] = CLEAR, after[:-1]
    ahead = np.empty_like(symbols)
    ahead[-1], ahead[:-1] = END, symbols[1:]
    start = _tables()[2][(before.astype(np.intp) * N_SYMBOLS + symbols) * N_SYMBOLS + ahead]
    start[0] = True
    start[ends[:-1] + 1] = True
    return joined, np.flatnonzero(start), ends

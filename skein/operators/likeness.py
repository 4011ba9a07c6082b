"""Counts of much alike texts among many, by blocks: the same decisions as jaro_winkler(a, b) > 0.8, many b at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LIKE = 0.8
#: Texts up to this length keep their places as bits of a word, longer ones as rows of bytes, so many bytes at once.
WORD, BYTES = 64, 1 << 25


@lru_cache(maxsize=4096)
def _decisions(la: int, lb: int) -> tuple[np.ndarray, np.ndarray]:
    """[hits, hits out of order, common prefix] -> much alike, by jaro_winkler's own arithmetic; [hits so far plus those
    that may come, greatest prefix that may come] -> may be much alike."""
    most, longest = min(la, lb), min(4, la, lb)
    m, x, p = (v.astype(float) for v in np.ogrid[0 : most + 1, 0 : most + 1, 0 : longest + 1])
    with np.errstate(divide="ignore", invalid="ignore"):  # no hits: not alike
        jaro = (m / la + m / lb + (m - x / 2) / m) / 3
        yes = (jaro + p * 0.1 * (1 - jaro) > LIKE) & (m > 0)
    return yes, np.logical_or.accumulate(np.logical_or.accumulate(yes.any(axis=1), axis=0), axis=1)


def _codes(texts: list[str]) -> np.ndarray:
    """Code points, a row for each text; above all of them where a text has ended."""
    out = np.full((len(texts), max(map(len, texts))), 0xFFFFFFFF, np.uint32)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


class _Words:
    """Texts b; a state says of each which of its places, and which of a's, are taken so far (bits of a word). at: rows, or
    None for all."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, la: int) -> None:
        self.codes, self.lengths, self.la = codes, lengths, la
        self.kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= max(la, codes.shape[1]))
        self.columns = np.ascontiguousarray(codes.T)
        self.places: dict[int, np.ndarray | None] = {}
        self.windows: dict[int, np.ndarray] = {}

    def start(self) -> tuple:
        none = np.zeros(len(self.codes), self.kind)
        return none, none

    def _where(self, c: int) -> np.ndarray | None:
        """The places of a letter in each text; None if no text has it."""
        if c not in self.places:
            if len(self.places) >= 64:
                self.places.clear()
            out = np.zeros(len(self.codes), self.kind)
            for j, column in enumerate(self.columns):
                out |= (column == c).astype(self.kind) << self.kind(j)
            self.places[c] = out if out.any() else None
        return self.places[c]

    def _window(self, i: int) -> np.ndarray:
        """The places of each text that a's letter i may take."""
        if i not in self.windows:
            reach = [max(self.la, lb) // 2 - 1 for lb in range(self.codes.shape[1] + 1)]
            bits = [((1 << max(lb, 0)) - 1) & ((1 << max(i + r + 1, 0)) - 1) & ~((1 << max(i - r, 0)) - 1) for lb, r in enumerate(reach)]
            self.windows[i] = np.array(bits, self.kind).take(self.lengths)
        return self.windows[i]

    def step(self, at: np.ndarray | None, state: tuple, i: int, c: int) -> tuple:
        used, found = state
        if (where := self._where(c)) is None:
            return state, None
        window = self._window(i)
        free = (where & window if at is None else where.take(at) & window.take(at)) & ~used
        first = free & -free
        hit = first != 0
        return (used | first, found | (hit.astype(self.kind) << self.kind(i))), hit

    def hits(self, state: tuple) -> np.ndarray:
        return np.bitwise_count(state[0]).astype(np.int64)

    def disorder(self, at: np.ndarray, state: tuple, a: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """How many hits differ when a's are put beside b's, each in its own order."""
        used, found = state
        one, out = self.kind(1), np.zeros(len(at), np.int64)
        for k in range(int(hits.max(initial=0))):
            x, y = found & -found, used & -used
            more = hits > k
            out += more & (a[np.where(more, np.bitwise_count(x - one), 0)] != self.codes[at, np.where(more, np.bitwise_count(y - one), 0)])
            found, used = found ^ x, used ^ y
        return out


class _Rows:
    """The same for longer texts b of one length; a state holds the taken places as rows of booleans."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, la: int) -> None:
        self.codes, self.lengths, self.la = codes, lengths, la
        self.columns, self.reach = codes.T, max(la, codes.shape[1]) // 2 - 1

    def start(self) -> tuple:
        return np.zeros(self.codes.shape, bool), np.zeros((len(self.codes), self.la), bool)

    def step(self, at: np.ndarray | None, state: tuple, i: int, c: int) -> tuple:
        used, found = state
        low, high = max(0, i - self.reach), max(0, i + self.reach + 1)
        codes = self.codes[:, low:high]
        free = ((codes if at is None else codes[at]) == c) & ~used[:, low:high]
        hit = free.any(axis=1)
        if not hit.any():
            return state, None
        used, found = used.copy(), found.copy()
        used[hit, low + free.argmax(axis=1)[hit]] = True
        found[hit, i] = True
        return (used, found), hit

    def hits(self, state: tuple) -> np.ndarray:
        return state[0].sum(axis=1)

    def disorder(self, at: np.ndarray, state: tuple, a: np.ndarray, hits: np.ndarray) -> np.ndarray:
        used, found = state
        row, place = np.nonzero(found)
        return np.bincount(row, a[place] != self.codes[at][used], len(at)).astype(np.int64)


def _needed(la: int, lb: int) -> list[int]:
    """By the greatest common prefix that may come (0 to 4) the hits needed; more than there are if none suffice."""
    if not lb:
        return [la + 1] * 5
    may = _decisions(la, lb)[1]
    return [int(np.argmax(may[:, p])) if may[-1, p] else la + 1 for p in np.minimum(range(5), may.shape[1] - 1)]


def _search(asked: list[tuple[str, int]], known: list[str], put) -> None:
    """put(i, rows of known) for each asked (text, i), all of one length, in order of their texts: what its first letters
    share with the text before isn't done again, and what can't become alike is left."""
    la, codes, lengths = len(asked[0][0]), _codes(known), np.array([len(b) for b in known])
    texts = (_Rows if max(la, codes.shape[1]) > WORD else _Words)(codes, lengths, la)
    present = set(lengths.tolist())
    need = np.array([_needed(la, lb) if lb in present else [0] * 5 for lb in range(codes.shape[1] + 1)], np.int8 if la < 100 else np.int32)
    if not (need[lengths, 4] <= la).any():
        return
    more = [(need[:, k] - need[:, 4]).take(lengths) for k in range(min(4, la))]
    # Of each text: hits less those needed, and whether all letters so far are the same.
    stack = [(None, texts.start(), -need[:, 4].take(lengths), np.ones(len(known), bool))]
    before = ""
    for text, i in asked:
        del stack[next((k for k in range(la) if k >= len(before) or text[k] != before[k]), la) + 1 :]
        before, a = text, _codes([text])[0]
        while len(stack) <= la and len(stack[-1][2]):
            k = len(stack) - 1
            at, state, short, equal = stack[-1]
            state, hit = texts.step(at, state, k, int(a[k]))
            if hit is not None:
                short = short + hit
            if k < 4:
                column, lack = (texts.columns[k], more[k]) if at is None else (texts.columns[k].take(at), more[k].take(at))
                now = equal & (column == a[k]) if k < codes.shape[1] else np.zeros_like(equal)
                short = short - (equal & ~now) * lack
                equal = now
            keep = short >= k + 1 - la
            # Rows are taken out only if few stay: whole arrays are quicker.
            if np.count_nonzero(keep) * 10 < len(keep):
                rows = np.flatnonzero(keep)
                at, state, short, equal = rows if at is None else at.take(rows), tuple(s.take(rows, axis=0) for s in state), short.take(rows), equal.take(rows)
            stack.append((at, state, short, equal))
        if len(stack) <= la:
            continue
        at, state, short, _ = stack[-1]
        rows = np.flatnonzero(short >= 0)
        if not len(rows):
            continue
        at, state = rows if at is None else at.take(rows), tuple(s.take(rows, axis=0) for s in state)
        m, p, still, good = texts.hits(state), np.zeros(len(at), np.int64), np.ones(len(at), bool), np.zeros(len(at), bool)
        for k in range(min(4, la, codes.shape[1])):
            still &= texts.columns[k].take(at) == a[k]
            p += still
        sizes = lengths.take(at)
        open_ = np.zeros(len(at), bool)
        for lb in np.flatnonzero(np.bincount(sizes)).tolist():
            yes, own = _decisions(la, lb)[0], np.flatnonzero(sizes == lb)
            # Where order can't change the answer, it isn't looked at.
            good[own] = yes[m[own], m[own], p[own]]
            open_[own] = yes[m[own], 0, p[own]] & ~good[own]
        if open_.any():
            left = np.flatnonzero(open_)
            x = texts.disorder(at[left], tuple(s[left] for s in state), a, m[left])
            for lb in np.flatnonzero(np.bincount(sizes[left])).tolist():
                own = sizes[left] == lb
                good[left[own]] = _decisions(la, lb)[0][m[left[own]], x[own], p[left[own]]]
        put(i, at[good])


def alike_counts(asked: list[str], known: list[str], counts: np.ndarray) -> np.ndarray:
    """For each asked text the sum of counts (a row for each known text) over the known ones much like it."""
    out = np.zeros((len(asked), counts.shape[1]), np.int64)
    same: dict[str, list[int]] = {}
    classes: dict[int, list[int]] = {}
    for j, text in enumerate(known):
        if len(text) < 2:
            same.setdefault(text, []).append(j)
        if text:
            classes.setdefault(next((n for n in (8, 16, 32, WORD) if len(text) <= n), len(text)), []).append(j)
    wanted: dict[int, list[tuple[str, int]]] = {}
    for i, text in sorted(enumerate(asked), key=lambda x: x[1]):
        if text in same:
            # Equal texts of one letter have no hits, none of no letter.
            out[i] += counts[same[text]].sum(axis=0)
        if text:
            wanted.setdefault(len(text), []).append((text, i))
    for la, texts in wanted.items():
        for n, js in classes.items():
            parts = [js]
            if la > WORD and n <= WORD:
                parts = [[j for j in js if len(known[j]) == lb] for lb in sorted({len(known[j]) for j in js})]
            for part in parts:
                step = len(part) if max(la, n) <= WORD else max(1, BYTES // (la * (la + n)))
                for s in range(0, len(part), step):
                    some = part[s : s + step]
                    columns = [np.ascontiguousarray(x) for x in counts[some].T]

                    def put(i: int, found: np.ndarray, columns: list = columns) -> None:
                        for k, column in enumerate(columns):
                            out[i, k] += column[found].sum()

                    _search(texts, [known[j] for j in some], put)
    return out

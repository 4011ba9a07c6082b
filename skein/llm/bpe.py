"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental byte-to-text decoder.

A token is stable once no later byte can change it. BPE has the property that the tokens up to a token boundary are
the BPE of the bytes up to it; so last(i), the final token of the first i bytes' BPE, gives the whole encoding by
going back from the end. Whatever follows, the next boundary is one of the last `lookahead` positions (lookahead:
the longest token's bytes), so all tokens that the ways back from those positions share are emitted and forgotten.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import sliced

#: Characters that are read at a time.
BLOCK = 1 << 16
#: Pieces of up to so many characters whose ids a worker remembers, and how many of them.
SHORT, REMEMBERED = 64, 400_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return out


def _class(last: int, *categories: str) -> str:
    """A regular expression's class of the code points up to last whose category starts so."""
    out, start = [], None
    for c in range(last + 2):
        inside = c <= last and not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c))[0] in categories
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = frozenset(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


@cache
def pieces_of(last: int = sys.maxunicode) -> re.Pattern:
    """Finds the pieces that are merged apart; for texts up to the code point last. Up to FFFF, classes are looked up
    in bitmaps instead of lists of ranges."""
    letter, number = _class(last, "L"), _class(last, "N")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _finder(text: str) -> re.Pattern:
    return pieces_of() if _ASTRAL.search(text) else pieces_of(0xFFFF)


class Known(dict):
    """Ids of pieces met so far, as the transducer gave them: two generations of up to REMEMBERED / 2, the older one
    forgotten when the younger is full."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(piece) > SHORT:
            run = Transducer(self.bpe)
            parts = [run.feed(piece[i : i + BLOCK].encode("utf-8", "surrogatepass")) for i in range(0, len(piece), BLOCK)]
            return tuple(chain.from_iterable([*parts, run.end()]))
        got = self.older.get(piece)
        if got is None:
            got = tuple(transduced(self.bpe, piece.encode("utf-8", "surrogatepass")))
        if 2 * len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = got
        return got


class Bpe:
    """A byte-level BPE vocabulary; path: a tokenizers JSON file with a ByteLevel pre-tokenizer."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text("utf-8"))
        model, letters = spec["model"], byte_letters()
        back = {c: b for b, c in letters.items()}
        raw = lambda s: bytes(back[c] for c in s)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in model["vocab"].items() if s not in self.specials}
        self.bytes = [b""] * (1 + max([*self.ids.values(), *self.specials.values()]))
        for s, i in self.ids.items():
            self.bytes[i] = s
        for s, i in self.specials.items():
            self.bytes[i] = s.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: Rank and result of each pair that merges, in one number; pairs are one number, too.
        self.rank = {self.ids[raw(a)] << 20 | self.ids[raw(b)]: r << 20 | self.ids[raw(a) + raw(b)] for r, (a, b) in reversed(list(enumerate(pairs)))}
        #: The longest token that merges make. Whatever follows, the next boundary is one of the last so many positions.
        self.lookahead = max([1, *[len(self.bytes[n & 0xFFFFF]) for n in self.rank.values()]])
        self.single = [self.ids.get(bytes([i]), -1) for i in range(256)]
        self.names = [str(i) for i in range(len(self.bytes))]
        self.cut = re.compile("|".join(sorted(map(re.escape, self.specials), key=len, reverse=True))) if self.specials else None
        self.longest = max([1, *map(len, self.specials)])
        self.known = Known(self)
        self._split = {n & 0xFFFFF: (p >> 20, p & 0xFFFFF, n >> 20) for p, n in reversed(self.rank.items())}
        self._fits: dict[int, bool] = {}  # at most REMEMBERED
        self._edges: dict[int, tuple[list, list]] = {}
        #: Tokens by their bytes from the last to the first: node and byte give the next node; ends: a node's token.
        self.trie: dict[int, int] = {}
        self.ends = [-1]
        for s, i in self.ids.items():
            if self.merge(s) == [i]:
                node = 0
                for b in reversed(s):
                    node = self.trie.setdefault(node << 8 | b, len(self.ends))
                    if node == len(self.ends):
                        self.ends.append(-1)
                self.ends[node] = i

    def merge(self, piece: bytes) -> list[int]:
        """All merges of a piece, lowest rank first and leftmost among equals: the definition of BPE."""
        parts = list(map(self.single.__getitem__, piece))
        get, none = self.rank.get, 1 << 60
        ranks = [get(a << 20 | b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            parts[i] = new = best & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 20 | parts[i + 1], none)
        return parts

    def edges(self, t: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """What stands at t's left and at its right edge while merges make it: (token, made at, merged on at) by rank."""
        known = self._edges.get(t)
        if known is None:
            sides = []
            for side in (0, 1):
                at, until, rows = t, 1 << 40, []
                while True:
                    parts = self._split.get(at)
                    rows.append((at, parts[2] if parts else -1, until))
                    if parts is None:
                        break
                    at, until = parts[side], parts[2]
                sides.append(rows)
            known = self._edges[t] = (sides[0], sides[1])
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether a then b is the BPE of their bytes: no merge joins what stands at a's right edge with what stands at
        b's left edge at that time. Of equal ranks the left one comes first."""
        known = self._fits.get(a << 20 | b)
        if known is None:
            if len(self._fits) >= REMEMBERED:
                self._fits.clear()
            get, known = self.rank.get, True
            left = self.edges(b)[0]
            for x, made_x, until_x in self.edges(a)[1]:
                for y, made_y, until_y in left:
                    n = get(x << 20 | y)
                    if n is not None and (at := max(n >> 20, made_x, made_y)) < until_x and at <= until_y:
                        known = False
            self._fits[a << 20 | b] = known
        return known

    def encode(self, text: str, special: bool = True) -> list[int]:
        return list(chain.from_iterable(self.encode_stream([text], special)))

    def encode_stream(self, chunks: Iterable[str], special: bool = True) -> Iterator[list[int]]:
        """Ids of a text that comes in chunks, in lists, held no longer than they can change.

        What is held back: what follows the last blank after a word (pieces end there whatever comes), or else the last
        piece and as many characters as a special token could begin in. A piece that outgrows the buffer is passed on
        to the transducer as it comes.
        """
        hold, run, kind = "", None, None
        cut = self.cut if special else None

        def plain(text: str) -> list[int]:
            return list(chain.from_iterable(map(self.known.__getitem__, _finder(text).findall(text))))

        def over(text: str, last: bool) -> Iterator[list[int]]:
            nonlocal hold, run, kind
            hold = ""
            while text or last:
                if run is not None:
                    n = kind.match(text).end()
                    n = min(n, max(0, len(text) - self.longest)) if not last else n
                    stop = cut.search(text) if cut else None
                    n = min(n, stop.start()) if stop else n
                    yield run.feed(text[:n].encode("utf-8", "surrogatepass"))
                    text = text[n:]
                    if not last and len(text) <= self.longest:
                        hold = text
                        return
                    yield run.end()
                    run = None
                    continue
                stop = cut.search(text) if cut else None
                if stop:
                    yield [*plain(text[: stop.start()]), self.specials[stop[0]]]
                    text = text[stop.end() :]
                    continue
                if last:
                    yield plain(text)
                    return
                blank = text.rfind(" ")
                while blank > 0 and text[blank - 1] in _SPACES:
                    blank -= 1
                if blank > 0:
                    yield plain(text[:blank])
                    text = text[blank:]
                safe, done, open_at, ids = len(text) - self.longest - 2, 0, 0, []
                for m in _finder(text).finditer(text):
                    open_at = m.start()
                    if m.end() > safe:
                        break
                    ids += self.known[m[0]]
                    done = m.end()
                yield ids
                hold = text[done:]
                if len(hold) > 4 * SHORT + self.longest and open_at == done:
                    body = hold[1:] if hold[0] == " " and len(hold) > 1 else hold
                    kind = next((k for k in _kinds() if k.match(body).end()), None)
                    if kind is not None and not hold.startswith("'"):
                        run, text, hold = Transducer(self), hold, ""
                        if text[0] == " ":
                            yield run.feed(b" ")
                            text = text[1:]
                        continue
                return

        for chunk in chunks:
            yield from over(hold + chunk, False)
        yield from over(hold, True)

    def encode_blocks(self, text: str) -> Iterator[list[int]]:
        """encode_stream() of a text read BLOCK characters at a time."""
        return self.encode_stream(text[i : i + BLOCK] for i in range(0, len(text), BLOCK)) if len(text) > BLOCK else self.encode_stream([text])

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that make no character become U+FFFD."""
        state = Decoder(self)
        return state.feed(ids) + state.end()


@cache
def _kinds() -> list[re.Pattern]:
    letter, number = _class(sys.maxunicode, "L"), _class(sys.maxunicode, "N")
    return [re.compile(f"[{x}]*") for x in (letter, number, f"^{SPACE}{letter}{number}")]


class Decoder:
    """Ids in, text out: a state machine that keeps the bytes of a character until it's whole."""

    def __init__(self, bpe: Bpe) -> None:
        self.bytes, self.state = bpe.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def end(self) -> str:
        return self.state.decode(b"", final=True)


class Transducer:
    """Bytes of a piece in, ids out as soon as they're stable.

    last[k] is the final token of the BPE of the bytes up to k: of the tokens that end there, the one that fits the
    final token of what is before it. Bytes and tokens are forgotten once emitted; what is held is looked through for
    stable tokens whenever it has doubled, so a byte costs as much in a long piece as in a short one.
    """

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.data = bpe, bytearray()
        self.last: list[int] = [-1]  # -1: the start of the piece, which any token fits
        self.most = 4 * bpe.lookahead

    def feed(self, raw: bytes) -> list[int]:
        out: list[int] = []
        data, last, step, ends = self.data, self.last, self.bpe.trie.get, self.bpe.ends
        known, fits = self.bpe._fits.get, self.bpe.fits
        for b in raw:
            data.append(b)
            node = 0
            for j in range(len(data) - 1, -1, -1):
                node = step(node << 8 | data[j])
                if node is None:
                    raise ValueError("a byte without a token")
                t = ends[node]
                if t >= 0:
                    before = last[j]
                    fit = before < 0 or known(before << 20 | t)
                    if fit or fit is None and fits(before, t):
                        last.append(t)
                        break
            if len(data) >= self.most:
                out += self._stable()
                self.most = max(4 * self.bpe.lookahead, 2 * len(data))
        return out

    def _drop(self, end: int) -> list[int]:
        """The tokens up to the boundary end, which are forgotten here but for the last one."""
        ids, at = [], end
        while at > 0:
            ids.append(self.last[at])
            at -= len(self.bpe.bytes[self.last[at]])
        del self.data[:end], self.last[:end]
        return ids[::-1]

    def _stable(self) -> list[int]:
        """Tokens up to the boundary where the ways back from all positions that may be the next boundary have met."""
        n = len(self.data)
        open_at = set(range(max(0, n - self.bpe.lookahead + 1), n + 1))
        while len(open_at) > 1:
            at = max(open_at)
            open_at.remove(at)
            open_at.add(at - len(self.bpe.bytes[self.last[at]]))
        return self._drop(open_at.pop())

    def end(self) -> list[int]:
        return self._drop(len(self.data))


def transduced(bpe: Bpe, raw: bytes) -> list[int]:
    """What a Transducer gives for a short piece that is there as a whole: the same steps, all tokens at its end."""
    last, step, ends, known, fits = [-1], bpe.trie.get, bpe.ends, bpe._fits.get, bpe.fits
    for j in range(len(raw)):
        node = 0
        while True:
            node = step(node << 8 | raw[j])
            t = ends[node]
            if t >= 0:
                before = last[j]
                fit = before < 0 or known(before << 20 | t)
                if fit or fit is None and fits(before, t):
                    last.append(t)
                    break
            j -= 1
    out, at = [], len(raw)
    while at > 0:
        out.append(last[at])
        at -= len(bpe.bytes[last[at]])
    return out[::-1]


@cache
def _bpe(path: str) -> Bpe:
    return Bpe(path)


CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def coded_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens and the digests of ids (decimal, comma-joined) and of the decoded text.

    Null counts as empty: no tokens, digests of no bytes. Rows don't meet, so repeats and ties need nothing; an empty
    table gives none. Ids of a text go to the digest and the decoder block by block, so of a very long one only the
    text itself is held. path: the vocabulary's file, present on all executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in sliced(batches):
            counts, ids_hex, text_hex = [], [], []
            for text in batch.column(1).to_pylist():
                n, names, decoded, state = 0, hashlib.sha256(), hashlib.sha256(), Decoder(bpe)
                for ids in bpe.encode_blocks(text or ""):
                    if ids:
                        names.update(("," * (n > 0) + ",".join(map(bpe.names.__getitem__, ids))).encode())
                        decoded.update(state.feed(ids).encode("utf-8"))
                        n += len(ids)
                decoded.update(state.end().encode("utf-8"))
                counts.append(n)
                ids_hex.append(names.hexdigest())
                text_hex.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, CODED)


def encoded_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id and the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in sliced(batches):
            ids = [list(chain.from_iterable(bpe.encode_blocks(t or ""))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")

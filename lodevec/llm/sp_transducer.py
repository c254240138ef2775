"""SentencePiece encoding and decoding with a weighted finite-state transducer.

A model file compiles to three machines. The normaliser maps characters (dummy prefix, spaces to U+2581).
The piece machine is a trie whose accepting paths emit a piece at its negative score. Byte fallback gives
each character that is no piece a path of byte pieces. Composed with an input they give a lattice over
character positions, and the tropical shortest path through it is the encoding.

For a BPE model the piece machine is also made a bigram machine: piece b may follow piece a only where
merging ``ab`` would leave the border alone; elsewhere its arc is infinitely dear. With that constraint a prefix
has one path of finite cost, so the lattice needs one state a position, the first arc that reaches a position
settles it, and the shortest path is the merge encoding.

Texts are cut where no piece of the model can reach across, before U+2581 after another character and
between characters that no piece has next to each other. The paths of short cuts are kept in a table of bounded bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import map_rows, schema_of, text_or_empty, warm

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The table of paths holds about so many bytes, in two generations; longer cuts aren't kept.
CACHE_BYTES, LONGEST_KEPT = 48 << 20, 48
ENTRY_BYTES = 200
#: So many bytes of texts become Python objects at once; their ids and read-back copies take several times that.
CHUNK_BYTES = 1 << 20
CACHE_PAIRS = 200_000
SHORT = (2, 1)
INF = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7)
        size = number() if size is None else size
        yield tag >> 3, data[at : at + size]
        at += size


class Known(dict):
    """Paths of cuts as bytes; what is missing is searched when it is first asked for. ``room`` is what it still may hold."""

    def __init__(self, find: Callable[[str], bytes], older: dict) -> None:
        self.find, self.older, self.room = find, older, CACHE_BYTES

    def __missing__(self, cut: str) -> bytes:
        found = self.older.get(cut)
        if found is None:
            found = self.find(cut)
        if len(cut) <= LONGEST_KEPT and self.room > 0:
            self[cut] = found
            self.room -= ENTRY_BYTES + 2 * len(cut)
        return found


@dataclass
class Transducer:
    """The compiled machines. ``pieces`` are texts with U+2581 for spaces."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int = UNIGRAM
    dummy_prefix: bool = True
    squeeze_spaces: bool = False

    def __post_init__(self) -> None:
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        self.arc = {self.pieces[i]: i for i in usable}
        self.longest = max(map(len, self.arc), default=1)
        self.byte = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.unknown_cost = 10.0 - min((self.scores[i] for i in usable), default=0.0)
        self.severed = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.arc)
        lengths: dict[str, set[int]] = {}
        for p in self.arc:
            if len(p) > 2:
                lengths.setdefault(p[:3], {2, 1}).add(len(p))
        #: Lengths of arcs by their first three characters, long ones first; other arcs are shorter than three.
        self.reach = {head: tuple(sorted(sizes, reverse=True)) for head, sizes in lengths.items()}
        self.joints = {p[i : i + 2] for p in self.arc for i in range(len(p) - 1)}
        self.known = Known(self._word, {})
        self.ends: dict[str, tuple | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.plain = [self._bytes(i) for i in range(len(self.pieces))]

    def __reduce__(self) -> tuple:
        """Copies in a worker process are one object, so the words that earlier tasks met stay known."""
        parts = (tuple(self.pieces), tuple(self.scores), tuple(self.kinds), self.model_type, self.dummy_prefix, self.squeeze_spaces)
        return _same, (hashlib.sha256(repr(parts).encode()).hexdigest(), parts)

    @classmethod
    def load(cls, path: str) -> Transducer:
        with open(path, "rb") as file:
            return cls.parse(file.read())

    @classmethod
    def parse(cls, data: bytes) -> Transducer:
        pieces, scores, kinds, options = [], [], [], {"model_type": UNIGRAM, "dummy_prefix": True, "squeeze_spaces": True}
        for number, value in _fields(data):
            if number == 1:
                part = dict(_fields(value))
                pieces.append(part[1].decode())
                scores.append(float(np.frombuffer(part.get(2, b"\0" * 4), "<f4")[0]))
                kinds.append(part.get(3, NORMAL))
            elif number == 2:
                options["model_type"] = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                part = dict(_fields(value))
                if part.get(2):
                    raise ValueError("models with a character map aren't supported")
                options |= {"dummy_prefix": bool(part.get(3, 1)), "squeeze_spaces": bool(part.get(4, 1))}
        return cls(pieces, scores, kinds, **options)

    # ------------------------------------------------------------------ normaliser
    def normalise(self, text: str) -> str:
        if self.squeeze_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    # ------------------------------------------------------------------ bigram constraint
    def _rank(self, piece: str) -> float:
        """When a merge into ``piece`` happens: best score first; infinite where there is no such piece."""
        i = self.arc.get(piece)
        return INF if i is None else -self.scores[i]

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first, leftmost of equals; what the bigram machine must agree with."""
        parts = list(text)
        while len(parts) > 1:
            costs = [self._rank(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(costs)
            if best == INF:
                break
            at = costs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _ends(self, piece: str) -> tuple | None:
        """How the first and the last part of a piece grow while it is merged from characters.

        Two lists of (part, when it was made, when it next grows). None for a piece that merging
        doesn't give back.
        """
        if piece not in self.ends:
            parts, first, last = list(piece), [[piece[0], -INF, INF]], [[piece[-1], -INF, INF]]
            clock = -INF
            while len(parts) > 1:
                costs = [self._rank(a + b) for a, b in zip(parts, parts[1:], strict=False)]
                best = min(costs)
                if best == INF:
                    break
                at = costs.index(best)
                clock = max(clock, best)
                whole = parts[at] + parts[at + 1]
                if at == 0:
                    first[-1][2] = best
                    first.append([whole, clock, INF])
                if at == len(parts) - 2:
                    last[-1][2] = best
                    last.append([whole, clock, INF])
                parts[at : at + 2] = [whole]
            self.ends[piece] = (tuple(map(tuple, first)), tuple(map(tuple, last))) if len(parts) == 1 else None
        return self.ends[piece]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` never crosses the border between them.

        The part that ends ``left`` and the part that begins ``right`` grow in the order of their ranks.
        A crossing merge wins where it comes before the next growth on either side; of equals the leftmost
        goes first.
        """
        a, b = self._ends(left), self._ends(right)
        if a is None or b is None:
            return False
        tail, head = a[1], b[0]
        i = j = 0
        arc, scores = self.arc, self.scores
        while True:
            part, _, left_grows = tail[i]
            start, _, right_grows = head[j]
            found = arc.get(part + start)
            if found is not None:
                cost = -scores[found]
                if cost < left_grows and cost <= right_grows:
                    return False
            if left_grows == INF and right_grows == INF:
                return True
            if left_grows <= right_grows:
                i += 1
            else:
                j += 1

    # ------------------------------------------------------------------ shortest path
    def _path(self, text: str) -> bytes:
        """Ids on the tropical shortest path of the lattice of normalised ``text``."""
        out: list[int] = []
        for part in self._shortest(text):
            found = self.arc.get(part)
            out += self._fallback(part) if found is None else (found,)
        return np.asarray(out, np.int32).tobytes()

    def _shortest(self, text: str) -> list[str]:
        return self._settled(text) if self.model_type == BPE else self._relaxed(text)

    def _relaxed(self, text: str) -> list[str]:
        """Relaxation in order of position. Of equal costs the longer last piece wins."""
        size, arc, scores, reach = len(text), self.arc, self.scores, self.reach
        cost = [0.0] + [INF] * size
        last = [""] * (size + 1)
        for at in range(size):
            for length in reach.get(text[at : at + 3], SHORT):
                end = at + length
                if end > size:
                    continue
                part = text[at:end]
                found = arc.get(part)
                if found is not None:
                    total = cost[at] - scores[found]
                elif length == 1:
                    total = cost[at] + self.unknown_cost
                else:
                    continue
                if total < cost[end]:
                    cost[end], last[end] = total, part
        parts = []
        while size:
            parts.append(last[size])
            size -= len(last[size])
        return parts[::-1]

    def _settled(self, text: str) -> list[str]:
        """Label setting under the bigram constraint: all ways of finite cost to a position are one, so its first arrival is its shortest path.

        The search goes on from where it arrives, long arcs first, and comes back to a position only to try its other
        arcs. Each position is settled once, so it is linear in the text.
        """
        size, arc, reach, pairs = len(text), self.arc, self.reach, self.pairs
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()
        settled = bytearray(size + 1)
        path: list[str] = []
        at, before, most = 0, "", self.longest
        while at < size:
            most = min(most, size - at)
            for length in reach.get(text[at : at + 3], SHORT):
                if length > most or settled[at + length]:
                    continue
                part = text[at : at + length]
                if length > 1 and part not in arc:
                    continue
                fits = pairs.get((before, part))
                if fits is None:
                    fits = pairs[before, part] = self.may_follow(before, part) if before else self._ends(part) is not None
                if fits:
                    at += length
                    settled[at] = 1
                    path.append(part)
                    before, most = part, self.longest
                    break
            else:
                part = path.pop()
                at -= len(part)
                before, most = path[-1] if path else "", len(part) - 1
        return path

    def _word(self, word: str) -> bytes:
        """The path of a cut, put together from parts that no piece reaches across."""
        joints, known = self.joints, self.known
        edges = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joints]
        if not edges:
            return self._path(word)
        return b"".join([known[word[a:b]] for a, b in zip([0, *edges], [*edges, len(word)], strict=True)])

    def _fallback(self, char: str) -> list[int]:
        if not self.byte:
            return [self.unknown]
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")]

    def encode_array(self, text: str) -> np.ndarray:
        """Piece ids of a whole text; none for an empty one."""
        text = self.normalise(text)
        if not text:
            return np.empty(0, np.int32)
        if not self.severed:
            return np.frombuffer(self._path(text), np.int32)
        if self.known.room < 0:
            self.known = Known(self._word, dict(self.known))
        # a cut begins at each space that follows another character; runs of spaces stay with what follows them
        words = _CUTS.findall(text) if SPACE * 2 in text or text[0] != SPACE else [SPACE + w for w in text.split(SPACE)[1:]]
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids, without the dummy prefix. Broken byte sequences give U+FFFD, control pieces nothing."""
        text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def _bytes(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else self.pieces[i].encode()


def _same(key: str, parts: tuple) -> Transducer:
    return warm(("pieces", key), lambda: Transducer(*map(list, parts[:3]), *parts[3:]))


_CUTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def encode_column(model: Transducer, text: Column) -> Column:
    """Piece ids of a text column; a null text counts as empty and has none."""

    @F.pandas_udf("array<int>")  # type: ignore[call-overload]
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([model.encode_array(t) for t in texts], dtype=object)

    return encode(F.coalesce(text.cast("string"), F.lit("")))


def decode_column(model: Transducer, ids: Column) -> Column:
    """The text of a column of id arrays; null for null, empty for none. An id that the model doesn't have is an error."""

    @F.pandas_udf("string")  # type: ignore[call-overload]
    def decode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in series:
            yield pd.Series([None if x is None else model.decode(list(x)) for x in lists], dtype=object)

    return decode(ids)


def encoded(docs: DataFrame, model: Transducer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, n_ids, round_trip)``, one row for each row of ``docs``; ids are read back to see that they give the text.

    A null text counts as empty and has no ids; U+2581 in a text reads back as a space, as the model has it
    so; repeated rows repeat; an empty table gives an empty result; other columns aren't looked at.
    """

    def setup():
        plain = (lambda t: t.replace(SPACE, " ")) if not model.squeeze_spaces else (lambda t: re.sub(" +", " ", t.replace(SPACE, " ").strip(" ")))

        def work(ids: list, texts: list) -> list[tuple]:
            rows = []
            for i, t in zip(ids, texts, strict=True):
                found = model.encode_array(t)
                rows.append((i, found, len(found), model.decode(found.tolist()) == plain(t)))
            return rows

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    return map_rows(source, setup, schema_of(f"`{id_col}` {kind}, ids array<int>, n_ids int, round_trip boolean"), chunk_bytes=CHUNK_BYTES)

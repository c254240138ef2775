"""Token ids as Re-Pair grammars: frequent id pairs become nonterminals, shard by shard.

Documents go out in ascending id order, in shards of about ``SHARD_TOKENS`` tokens. In each round all pairs of a
shard are counted; the most frequent get a rank, and a pair is replaced wherever neither pair it overlaps has a
better one, so the most frequent pair is replaced throughout. Rounds go on until no pair occurs ``LEAST_COUNT`` times,
from where on a rule saves more than it takes, or until symbols are used up. A pair never spans two documents.

A shard file holds, little-endian::

    8 bytes   magic RPGRAM01
    4 x u32   width of a symbol in bytes, first nonterminal, rules, documents
    2 x u64   symbols, tokens
    rules     left[], right[] (symbol width), expansion length[] (u32)
    documents key: length-prefixed id text table, first symbol[] (u64), first token[] (u64)
    symbols   symbol[] (symbol width)

The expansion lengths tell which symbol holds the n-th token of a document without expanding those before.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.llm.common import schema_of, scratch, settle, small_batches, text_or_empty, warm
from lodevec.llm.shared_files import RangeReader, write_new

MAGIC = b"RPGRAM01"
SHARD_TOKENS = 1 << 21
#: So many pairs at most get a rank in a round. More make rounds fewer and rules worse: those of rare pairs come before those of frequent longer ones.
PAIRS_A_ROUND, LEAST_COUNT = 3072, 5
#: About so many bytes of texts are cut at once.
PIECE_BYTES = 8 << 20
#: Rows of an Arrow batch at most, which the JVM and the Python worker beside it both hold.
BATCH_ROWS = 2048
#: Tables of words hold about so many bytes; longer cuts aren't kept.
CACHE_BYTES, LONGEST_KEPT = 88 << 20, 48
ENTRY_BYTES = 160
WINDOW = 8


# ---------------------------------------------------------------------- words to ids
class Known(dict):
    """Ids of parts as bytes; what is missing is encoded when it is first asked for. ``room`` is what it still may hold."""

    def __init__(self, encode: Callable[[str], bytes], older: dict) -> None:
        self[""] = b""
        self.encode, self.older, self.room = encode, older, CACHE_BYTES

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        return self.keep(part, self.encode(part) if found is None else found)

    def keep(self, part: str, found: bytes) -> bytes:
        if len(part) <= LONGEST_KEPT and self.room > 0:
            self[part] = found
            self.room -= ENTRY_BYTES + len(part)
        return found


class WordEncoder:
    """Ids of whole texts from a Hugging Face tokenizer whose parts never reach across white space.

    Texts are cut at spaces and line ends, and Arrow finds the different cuts of a few texts, so each is looked at once.
    A cut goes to the library, but for two kinds that its pattern can only split in one way: Latin letters that fold one
    by one, with full stops and commas after them, and printable ASCII. Their runs of letters go to the library's model.
    Ids of folded letters, marks and other cuts are kept in one table of bounded bytes.
    """

    #: The tokenizer's pattern of parts, a fixed value of its file.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 60_000 else "<u4")
        self.code = "H" if self.width.itemsize == 2 else "I"
        self.known = Known(self._part, {})
        # byte-level models name a byte by its Latin-1 character if that is printable, else by one from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = dict(zip((b for b in range(256) if b not in shown), range(256, 512), strict=False))
        self.names = {chr(c): "".join(chr(rest.get(b, b)) for b in chr(c).encode()) for c in range(0x250)}
        letters = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower() < "\u0250")
        #: Of each line its letters and marks, both empty where it has anything else.
        self.lines = re.compile(f"([{letters}]++)([.,]*+)\n|[^\n]*\n")

    def _direct(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def _letters(self, plain: str) -> bytes:
        """Ids of folded Latin letters alone, which are one part, by the model without its other steps."""
        name = plain if plain.isascii() else "".join(map(self.names.__getitem__, plain))
        return array(self.code, [t.id for t in self.model.tokenize(name)]).tobytes()

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isprintable() and "<|" not in part:
            if part.isalpha() and part.islower():
                return self._letters(part)
            parts = self.PARTS.findall(part.lower())
            if parts != [part]:
                return b"".join(map(self.known.__getitem__, parts))
        return self._direct(part)

    def _cuts(self, cuts: list[str], joined: str) -> list[bytes]:
        """Ids of cuts, which have no line ends. Two generations of parts are kept, so what is used often stays known."""
        if self.known.room < 0:
            self.known = Known(self._part, dict(self.known))
        out, known, older, letters = [], self.known, self.known.older, self._letters
        for cut, (word, marks) in zip(cuts, self.lines.findall(joined + "\n"), strict=True):
            if not word:
                out.append(known[cut])
                continue
            plain = word.lower()
            found = known.get(plain)
            if found is None:
                found = older.get(plain)
                found = known.keep(plain, letters(plain) if found is None else found)
            out.append(found + known[marks] if marks else found)
        return out

    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, and where each text's begin, with the end of the last."""
        words = pc.split_pattern(pc.replace_substring(texts.cast(pa.string()), "\n", " "), " ")
        places, coded = words.offsets.to_numpy(), words.values.dictionary_encode()
        different = coded.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(different)], pa.int32()), different), "\n")[0].as_py()
        found = self._cuts(joined.split("\n"), joined) if len(different) else []
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.width.itemsize
        table = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes)))), pa.array(np.frombuffer(b"".join(found), self.width)))
        ids = table.take(coded.indices).flatten().to_numpy()
        return ids, np.concatenate(([0], np.cumsum(sizes[coded.indices.to_numpy()])))[places]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, edges = self.encode_arrow(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in pairwise(edges.tolist())]


def shared_encoder(path: str) -> WordEncoder:
    """One encoder a worker process, so the words that earlier tasks met stay known."""
    return warm(("words", path), lambda: WordEncoder(path))


# ---------------------------------------------------------------------- grammar
def compress(symbols: np.ndarray, last: np.ndarray, first_rule: int, most_rules: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(symbols, last, rules)`` when no pair is left that pays. ``last`` has the place of each document's last symbol."""
    symbols = symbols.copy()
    rules: list[np.ndarray] = [np.empty((0, 2), np.int64)]
    made = 0
    wide = np.uint64 if symbols.dtype.itemsize > 2 else np.uint32
    shift = wide(8 * symbols.dtype.itemsize)
    low = (wide(1) << shift) - wide(1)
    none = np.iinfo(wide).max
    idle = np.empty(0, wide)  # pairs of one id that overlap themselves too often to pay
    while len(symbols) > 1 and made < most_rules:
        keys = symbols[:-1].astype(wide)
        keys <<= shift
        keys |= symbols[1:]
        keys[last[:-1]] = none
        ordered = np.sort(keys)
        starts = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
        counts = np.diff(np.append(starts, len(ordered)))
        often = np.flatnonzero(counts >= LEAST_COUNT)
        often = often[~np.isin(ordered[starts[often]], np.append(idle, wide(none)))]
        often = np.sort(often[np.argsort(-counts[often], kind="stable")][:PAIRS_A_ROUND])
        if not len(often):
            break
        pairs, by_rank = ordered[starts[often]], np.argsort(-counts[often], kind="stable")
        lefts, rights = np.unique(pairs >> shift), np.unique(pairs & low)
        column, row = np.zeros((2, first_rule + made), np.int32)  # 0: no pair begins, or ends, with the id
        row[lefts], column[rights] = np.arange(1, len(lefts) + 1) * (len(rights) + 1), np.arange(1, len(rights) + 1)
        rank = np.full((len(lefts) + 1) * (len(rights) + 1), len(often), np.int16)
        rank[row[pairs[by_rank] >> shift] + column[pairs[by_rank] & low]] = np.arange(len(often))
        of = np.full(len(keys) + 2, len(often), np.int16)
        of[1:-1] = rank[row[symbols[:-1]] + column[symbols[1:]]]
        of[last[:-1] + 1] = len(often)
        own = of[1:-1]
        places = np.flatnonzero((own < len(often)) & (own <= of[:-2]) & (own <= of[2:]))
        ranks = own[places]
        # only a pair of one id overlaps with itself: of a run of such places every second counts
        touching = np.concatenate(([False], np.diff(places) == 1))
        if touching.any():
            run = np.maximum.accumulate(np.where(touching, 0, np.arange(len(places))))
            even = (np.arange(len(places)) - run) % 2 == 0
            places, ranks = places[even], ranks[even]
        used = np.flatnonzero(np.bincount(ranks, minlength=len(often)) >= LEAST_COUNT)[: most_rules - made]
        if not len(used):
            idle = np.union1d(idle, pairs[(pairs >> shift) == (pairs & low)])
            continue
        name = np.zeros(len(often), np.int64)
        name[used] = first_rule + made + np.arange(len(used))
        chosen = pairs[by_rank[used]]
        rules.append(np.stack((chosen >> shift, chosen & low), axis=1).astype(np.int64))
        made += len(used)
        there = name[ranks] > 0
        places = places[there]
        symbols[places] = name[ranks[there]]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        symbols = symbols[keep]
        # a last symbol that became part of a pair is now that pair; each pair before it took one place
        last = last - np.searchsorted(places + 1, last, side="right")
    return symbols, last, np.concatenate(rules)


def flatten(rules: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each symbol: where its tokens begin in a flat table and how many there are; and that table.

    Rules are taken in runs that refer only to symbols before the run, so each run is one gather.
    """
    begins, lengths = np.arange(first_rule, dtype=np.int64), np.ones(first_rule, np.int64)
    flat = np.arange(first_rule, dtype=np.uint32)
    at = 0
    while at < len(rules):
        known = (rules[at:] < len(begins)).all(1)
        stop = at + (int(known.argmin()) if not known.all() else len(known))
        parts = rules[at:stop].ravel()
        sizes = lengths[parts]
        ends = np.cumsum(sizes)
        tokens = flat[np.repeat(begins[parts] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        whole = sizes.reshape(-1, 2).sum(1)
        begins = np.concatenate((begins, len(flat) + np.cumsum(whole) - whole))
        lengths, flat, at = np.concatenate((lengths, whole)), np.concatenate((flat, tokens)), stop
    return begins, lengths, flat


def build_shard(doc_ids: list, docs: list[np.ndarray], vocabulary: int) -> bytes:
    """The bytes of a shard file. Every document has at least one token."""
    width = docs[0].dtype
    tokens = np.concatenate(docs)
    sizes = np.asarray([len(d) for d in docs], np.int64)
    symbols, last, rules = compress(tokens, np.cumsum(sizes) - 1, vocabulary, (1 << 16 if width.itemsize == 2 else 1 << 20) - vocabulary)
    lengths = flatten(rules, vocabulary)[1][vocabulary:]
    first_symbol = np.concatenate(([0], last[:-1] + 1)).astype("<u8")
    first_token = (np.cumsum(sizes) - sizes).astype("<u8")
    names = b"".join(struct.pack("<i", -1) if i is None else struct.pack("<i", len(b := str(i).encode())) + b for i in doc_ids)
    pairs = rules.astype(width)
    head = MAGIC + struct.pack("<4I2QI", width.itemsize, vocabulary, len(rules), len(docs), len(symbols), len(tokens), len(names))
    return b"".join((head, pairs[:, 0].tobytes(), pairs[:, 1].tobytes(), lengths.astype("<u4").tobytes(), names, first_symbol.tobytes(), first_token.tobytes(), symbols.astype(width).tobytes()))


class Shard:
    """A shard file, read by ranges: rules and document table at once, symbols as asked for."""

    HEAD = struct.Struct("<4I2QI")

    def __init__(self, source: RangeReader) -> None:
        head = source.read(0, 8 + self.HEAD.size)
        if head[:8] != MAGIC:
            raise ValueError("not a grammar shard")
        width, self.first_rule, n_rules, self.n_docs, self.n_symbols, self.n_tokens, names = self.HEAD.unpack(head[8:])
        self.source, self.width = source, np.dtype(f"<u{width}")
        self.whole: np.ndarray | None = None
        size = n_rules * (2 * width + 4) + names + 16 * self.n_docs
        body = source.read(len(head), size)
        self.at = len(head) + size
        pairs = np.frombuffer(body, self.width, 2 * n_rules)
        at = 2 * width * n_rules
        self.lengths = np.frombuffer(body, "<u4", n_rules, at)
        at += 4 * n_rules
        self.doc_ids: list[str | None] = []
        for _ in range(self.n_docs):
            (n,) = struct.unpack_from("<i", body, at)
            self.doc_ids.append(None if n < 0 else body[at + 4 : at + 4 + n].decode())
            at += 4 + max(n, 0)
        self.first_symbol = np.frombuffer(body, "<u8", self.n_docs, at).astype(np.int64)
        self.first_token = np.frombuffer(body, "<u8", self.n_docs, at + 8 * self.n_docs).astype(np.int64)
        rules = pairs.astype(np.int64).reshape(2, n_rules).T
        self.begins, self.sizes, self.flat = flatten(rules, self.first_rule)

    def _symbols(self, start: int, stop: int) -> np.ndarray:
        width = self.width.itemsize
        if self.whole is not None:
            return self.whole[start:stop]
        return np.frombuffer(self.source.read(self.at + start * width, (stop - start) * width), self.width)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.sizes[symbols]
        ends = np.cumsum(sizes)
        shift = self.begins[symbols] - (ends - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def all_tokens(self) -> np.ndarray:
        """All tokens; the symbols stay in memory, so ranges asked for later need no reads."""
        self.whole = self._symbols(0, self.n_symbols)
        return self._expand(self.whole)

    def tokens(self, doc: int, start: int = 0, count: int | None = None) -> np.ndarray:
        """Tokens ``start .. start + count`` of the doc-th document; only symbols that hold them are expanded."""
        low = int(self.first_symbol[doc])
        high = int(self.first_symbol[doc + 1]) if doc + 1 < self.n_docs else self.n_symbols
        symbols = self._symbols(low, high)
        ends = np.cumsum(self.sizes[symbols])
        stop = int(ends[-1]) if count is None else min(int(ends[-1]), start + count)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self._expand(symbols[a:b])[start - skipped : stop - skipped]


# ---------------------------------------------------------------------- DataFrame operators
def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode whole texts and write shard files; gives the manifest ``(path, place, shard, n_docs, n_tokens, n_bytes, base)``.

    Documents are in ascending order of id, nulls first, and then of text. A null text is empty; an empty one has only
    the end id; very long ones are shards of their own size; repeated rows repeat; an empty table gives an empty
    manifest; other columns aren't looked at. ``base`` is the number of tokens in all shards before. The id's name and
    type are metadata of ``path``.
    """
    folder = folder or scratch(docs.sparkSession, "grammar")
    told = {"id_name": id_col, "id_type": docs.schema[id_col].dataType.simpleString()}
    out = schema_of("path string, place int, shard int, n_docs bigint, n_tokens bigint, n_bytes bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        vocabulary = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        end = np.asarray([end_id], encoder.width)
        place = TaskContext.get().partitionId()  # type: ignore[union-attr]
        ids: list = []
        held: list[np.ndarray] = []
        waiting, shard = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, held, waiting, shard
            data = build_shard(ids, held, vocabulary)
            path = write_new(folder, f"part-{place:05d}-{shard:05d}", ".rpg", data)
            row = [[path], [place], [shard], [len(ids)], [waiting], [len(data)]]
            ids, held, waiting, shard = [], [], 0, shard + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["path", "place", "shard", "n_docs", "n_tokens", "n_bytes"])

        for batch in batches:
            step = max(1, int(batch.num_rows * PIECE_BYTES / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                tokens, edges = encoder.encode_arrow(piece.column(1))
                for i, (a, b) in zip(piece.column(0).to_pylist(), pairwise(edges.tolist()), strict=True):
                    ids.append(i)
                    held.append(np.concatenate((tokens[a:b], end)))
                    waiting += b - a + 1
                    if waiting >= SHARD_TOKENS:
                        yield flush()
        if ids:
            yield flush()

    ordered = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body")).repartitionByRange(F.col("id").asc_nulls_first())
    with small_batches(docs.sparkSession, BATCH_ROWS):
        manifest = settle(ordered.sortWithinPartitions(F.col("id").asc_nulls_first(), "body").mapInArrow(run, out), "manifest")
    # one row a shard, of two million tokens: the running total over them needs no dealing out
    before = Window.orderBy("place", "shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))
    return manifest.withColumn("path", F.col("path").alias("path", metadata=told))


def read_shards(manifest: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32, window_crc32)`` of each document, from the files of a manifest.

    ``window_crc32`` is of up to ``WINDOW`` tokens from the middle on, which only the symbols that hold them are expanded
    for. An empty manifest gives no rows; ids have the name and type that they had when written.
    """
    told = manifest.schema["path"].metadata

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with RangeReader(path) as source:
                    shard = Shard(source)
                    tokens = shard.all_tokens().astype("<u4")
                edges = [*shard.first_token.tolist(), len(tokens)]
                view = memoryview(tokens).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]
                sizes = np.diff(edges)
                some = [zlib.crc32(shard.tokens(k, n // 2, WINDOW).astype("<u4").tobytes()) for k, n in enumerate(sizes.tolist())]
                columns = (pa.array(shard.doc_ids, pa.string()), pa.array(shard.first_token + base), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(some, pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns), ["id", "start", "n_tokens", "ids_crc32", "window_crc32"])

    read = schema_of("id string, start bigint, n_tokens bigint, ids_crc32 bigint, window_crc32 bigint")
    tasks = manifest.select("path", "base").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4))
    found = tasks.mapInArrow(run, read)
    return found.select(F.col("id").cast(told["id_type"]).alias(told["id_name"]), "start", "n_tokens", "ids_crc32", "window_crc32")

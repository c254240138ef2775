import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodevec.llm import repair_ids as R
from lodevec.llm.queries import op9_repair_ids, tokenizer_path
from lodevec.llm.shared_files import RangeReader, write_new

PATH = tokenizer_path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = R.WordEncoder(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=50))
def test_ids_are_those_of_the_library(text):
    assert ENCODER.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_of_hostile_mixtures():
    rng = random.Random(4)
    alphabet = "abcdeE'sSlLıßÉé́  \n\t.,'\"#12٣中🙂<|endoftext|>Σς\x1c\x85\xa0\u2028"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        text = text[:5] + rng.choice(["", " <|endoftext|>", "<|startoftext|>x", "é.,", "DON'T'll."]) + text[5:]
        assert ENCODER.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_letter_before_marks():
    """All code points that any case rule may touch, and every 31st of the others, before, after and between marks."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x600 or c % 31 == 0 or chr(c).lower() != chr(c))]
    for at in range(0, len(points), 500):
        text = " ".join(f"{c}. a{c}, {c}a., .{c}" for c in map(chr, points[at : at + 500]))
        assert ENCODER.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_turkish_texts():
    assert len(ENCODER.encode(["İZMİRİ."])[0]) == 9
    rng = random.Random(8)
    words = ["İZMİRİ", "istanbul", "IĞDIR", "ığdır", "Şanlıurfa", "çİçek", "İ", "ﬁ", "ǅ", "ŉ", "ß", "ẞ", "µ", "ª"]
    for _ in range(2000):
        text = " ".join(rng.choice(words) + rng.choice(["", ".", ",", "...", ".,", "'s", "!", "\u0307.", "\u0301,"]) for _ in range(6))
        assert ENCODER.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_tables_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(R, "CACHE_BYTES", 20_000)
    encoder = R.WordEncoder(PATH)
    texts = [f"{'x' * 5000}{i} word{i} Wörter{i}." for i in range(600)]
    found = encoder.encode(texts)
    assert [f.tolist() for f in found] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.known) + len(encoder.known.older) < 400 and max(map(len, encoder.known)) <= R.LONGEST_KEPT


def test_each_different_cut_is_looked_at_once(monkeypatch):
    encoder = R.WordEncoder(PATH)
    asked, plain = [], encoder._cuts
    monkeypatch.setattr(encoder, "_cuts", lambda cuts, joined: asked.append(len(cuts)) or plain(cuts, joined))
    texts = ["Word word. WORD, d'Été 12", "", "\n\n word", "word. " * 50_000, "", "x\ry z\u2028 #" * 3] * 20
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [f.tolist() for f in encoder.encode(texts)] == want and asked == [len({c for t in texts for c in t.replace("\n", " ").split(" ")})]
    assert encoder.encode([]) == [] and [f.tolist() for f in encoder.encode(["", ""])] == [[], []]


class Held:
    def __init__(self, data):
        self.data = data

    def read(self, at, size):
        return self.data[at : at + size]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=80), min_size=1, max_size=12))
def test_grammars_round_trip(docs):
    arrays = [np.asarray(d, "<u2") for d in docs]
    shard = R.Shard(Held(R.build_shard(list(range(len(docs))), arrays, 10)))
    assert shard.all_tokens().tolist() == [t for d in docs for t in d]
    for i, d in enumerate(docs):
        assert shard.tokens(i).tolist() == d and shard.tokens(i, 2, 3).tolist() == d[2:5]


def test_rules_compress_and_never_span_documents():
    docs = [np.asarray([1, 2, 3, 4] * 200 + [5], "<u2") for _ in range(30)]
    data = R.build_shard(list(range(30)), docs, 10)
    shard = R.Shard(Held(data))
    assert len(data) < 2 * sum(map(len, docs)) / 8 and len(shard.lengths) and shard.sizes.max() > 4
    assert all((shard.tokens(i) == docs[i]).all() for i in range(30))


def test_runs_of_one_id():
    docs = [np.asarray([7] * n, "<u2") for n in (1, 2, 3, 50, 51, 1000)]
    shard = R.Shard(Held(R.build_shard(list("abcdef"), docs, 10)))
    assert [shard.tokens(i).tolist() for i in range(6)] == [d.tolist() for d in docs] and shard.doc_ids == list("abcdef")


def test_no_pair_that_pays_is_left():
    """Rules go on until no pair occurs often enough: long repeats become one symbol, and only pairs that overlap themselves may stay."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 900, 400)
    docs = [np.concatenate((rng.integers(0, 900, 30), passage, rng.integers(0, 900, 30))).astype("<u2") for _ in range(40)]
    tokens = np.concatenate(docs)
    last = np.cumsum([len(d) for d in docs]) - 1
    symbols, ends, rules = R.compress(tokens, last, 1000, 60_000)
    inner = set(ends.tolist())
    counts = {}
    for i, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)):
        if i not in inner:
            counts[pair] = counts.get(pair, 0) + 1
    assert max(counts.values()) < R.LEAST_COUNT
    assert R.flatten(rules, 1000)[1].max() >= 200
    assert len(R.compress(tokens, last, 1000, 17)[2]) == 17


def test_files_are_read_by_ranges(tmp_path):
    docs = [np.arange(i + 1, dtype="<u2") % 40 for i in range(100)]
    path = write_new(f"file://{tmp_path}", "x", ".rpg", R.build_shard([*range(99), None], docs, 50))
    with RangeReader(path) as source:
        shard = R.Shard(source)
        assert shard.doc_ids[99] is None and shard.tokens(77, 10, 5).tolist() == docs[77][10:15].tolist()


def expected(rows):
    out, at = [], 0
    for doc_id, text in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = np.asarray([*LIBRARY.encode(text, add_special_tokens=False).ids, 2], "<u4")
        window = ids[len(ids) // 2 : len(ids) // 2 + R.WINDOW]
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(window.tobytes())))
        at += len(ids)
    return out


def in_order(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[1])


def test_hostile_rows(docs, no_docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert in_order(R.read_shards(R.write_shards(docs, PATH))) == expected(rows)
    monkeypatch.setattr(R, "SHARD_TOKENS", 50)
    assert in_order(R.read_shards(R.write_shards(docs, PATH))) == expected(rows)
    assert R.read_shards(R.write_shards(no_docs, PATH)).count() == 0
    named = docs.selectExpr("concat('d', doc_id) AS path", "text AS body", "doc_id AS base", "lang AS id")
    back = R.read_shards(R.write_shards(named, PATH, id_col="path", text_col="body"))
    assert back.columns[0] == "path" and {r[0] for r in back.collect()} == {None if r[0] is None else f"d{r[0]}" for r in rows}


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert in_order(op9_repair_ids(spark, sf_dir)) == expected(rows)

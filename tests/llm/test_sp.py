import itertools
import random
import time

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodevec.llm import sp_transducer as P
from lodevec.llm.queries import op4_sentencepiece, piece_model, tokenizer_path

MODEL = piece_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_library(text):
    assert MODEL.encode(text) == LIBRARY.encode(text)


def test_joined_pieces_and_long_runs():
    rng = random.Random(9)
    for _ in range(2000):
        text = "".join(MODEL.pieces[rng.randrange(259, 32000)] for _ in range(rng.randint(0, 6))).replace("▁", " ")
        assert MODEL.encode(text) == LIBRARY.encode(text)
    for text in ("a" * 5000, " " * 100 + "x" + " " * 33, "ab" * 3000, "\n" * 20, "1234567890" * 300):
        ids = MODEL.encode(text)
        assert ids == LIBRARY.encode(text) and MODEL.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40).filter(lambda t: "▁" not in t))
def test_round_trip(text):
    assert MODEL.decode(MODEL.encode(text)) == text


def test_bigram_machine_agrees_with_merging():
    rng = random.Random(1)
    parts = [p for p in MODEL.arc if 1 <= len(p) <= 5]
    for _ in range(3000):
        a, b = rng.choice(parts), rng.choice(parts)
        assert MODEL.may_follow(a, b) == (MODEL.merged(a + b) == [a, b])


def test_unigram_path_is_the_cheapest():
    pieces = ["<unk>", "▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab"]
    scores = [0.0, -3.0, -2.0, -2.5, -3.1, -3.3, -4.9, -3.5, -4.2]
    model = P.Transducer(pieces, scores, [P.UNKNOWN, *[P.NORMAL] * 8], P.UNIGRAM)
    for size in range(1, 8):
        for chars in itertools.product("abx", repeat=size):
            text = "▁" + "".join(chars)

            def cost(cut):
                return sum(model.unknown_cost if p not in model.arc else -scores[model.arc[p]] for p in cut)

            cuts = []
            for mask in range(1 << (len(text) - 1)):
                at = [0, *[i + 1 for i in range(len(text) - 1) if mask >> i & 1], len(text)]
                cut = [text[a:b] for a, b in zip(at, at[1:])]
                if all(p in model.arc or len(p) == 1 for p in cut):
                    cuts.append(cost(cut))
            assert abs(cost(model._shortest(text)) - min(cuts)) < 1e-9


def test_cache_turnover(monkeypatch):
    monkeypatch.setattr(P, "CACHE_BYTES", 600)
    monkeypatch.setattr(P, "CACHE_PAIRS", 5)
    model = piece_model()
    for text in ("one two three four five six seven", "seven eight nine ten one two", "one two"):
        assert model.encode(text) == LIBRARY.encode(text)


def test_a_million_unspaced_characters():
    rng = random.Random(6)
    for alphabet in ([chr(c) for c in range(0x4E00, 0x9FA6)], list("abcdefghij"), list("的一是不了人我在有他这")):
        text = "".join(rng.choice(alphabet) for _ in range(1_000_000))
        model = piece_model()
        began = time.process_time()
        ids = model.encode(text)
        assert time.process_time() - began < 60 and model.decode(ids) == text and max(map(len, model.known)) <= P.LONGEST_KEPT
        assert model.encode(text[:20_000]) == LIBRARY.encode(text[:20_000])


def test_hostile_rows(docs, no_docs):
    rows = P.encoded(docs, MODEL).collect()
    texts = [(d.doc_id, d.text or "") for d in docs.collect()]
    assert sorted(((r.doc_id or 0, list(r.ids)) for r in rows)) == sorted((i or 0, LIBRARY.encode(t)) for i, t in texts)
    assert all(r.round_trip for r in rows) and P.encoded(no_docs, MODEL).count() == 0
    both = docs.select("text", P.decode_column(MODEL, P.encode_column(MODEL, docs.text)).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in both)


def test_query(spark, sf_dir):
    rows = {r.doc_id: r for r in op4_sentencepiece(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert rows[d.doc_id].n_ids == len(LIBRARY.encode(d.text)) and rows[d.doc_id].round_trip

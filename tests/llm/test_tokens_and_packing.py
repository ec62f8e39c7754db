import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures_llm import LONG, ROWS, documents, empty, vocabulary  # noqa: E402

from spendlens.llm import packing, range_coder, tokens  # noqa: E402

ODD = ["", " ", "  a", "a  ", "a\n\n\nb", " a\tb ", "don't we'll  x\n y  z", "日本語 text 1234 ½²", "a\x00b", "it's\x1c x", "x \n y", "ß'S 'RE", "a <|endoftext|> b", "x<|endoftext|>\n\n\ny <|endoftext|",
       "Ⅷ a² b³", "\n\nx", "tab\t\tx", "a\r\nb\r\n\r\nc", "<|endoftext|>", "Word, word. word! word; “quoted” naïve café,", "é" * 500]


def library_ids(texts, plain=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = plain
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_librarys():
    rng = random.Random(1)
    made = ["".join(rng.choice(["a", "B", "é", " ", "  ", "\n", ".", ",", "'s", "1", "日", "\t", "the"]) for _ in range(rng.randrange(40)))
            for _ in range(300)]
    texts = [*ODD, *made, None, LONG[:5000]]
    got = [np.frombuffer(b, "<u4").tolist() for b in tokens.encoder(vocabulary()).encode(texts)]
    assert got == library_ids(texts) and [64, 220, 50256, 275] in got
    got = [np.frombuffer(b, "<u4").tolist() for b in tokens.encoder(vocabulary(), special=False).encode(texts)]
    assert got == library_ids(texts, plain=True)


def test_ids_of_texts_whose_other_white_space_makes_up_for_runs():
    rng = random.Random(4)
    assert all(not c.isprintable() for c in map(chr, range(0x110000)) if c.isspace() and c != " ")
    made = ["".join(rng.choice(["a", "b.", "\t", "\r", "\u00a0", "\u2003", "\n", "\n\n", "\n\n\n", "  ", "   ", " "])
                    for _ in range(rng.randrange(3, 14))) for _ in range(3000)]
    texts = ["a\tb\tc\n\n", "a\tb\tc\n\n\nd", "a\rb\rc\rd   e", "a\u00a0b\u00a0c\n\n", *made]
    got = [np.frombuffer(b, "<u4").tolist() for b in tokens.encoder(vocabulary()).encode(texts)]
    assert got[0] == [64, 197, 65, 197, 66, 628] and got == library_ids(texts)


def test_marks_after_other_than_letters_are_found():
    texts = [a + c + m + b for c in map(chr, range(0x250)) for m in ",.;" for a in ("", "x") for b in ("", " y,")]
    assert [tokens._marked(t) for t in texts] == [bool(tokens._MARKS.search(t)) for t in texts]


def test_ids_around_other_white_space_punctuation_and_accents():
    rng = random.Random(6)
    parts = ["a", "é", "ÿ", "à", "×", " ", "\n", "\u00a0", "\u2003", "\x1c", ".", ",", "!", "'s", "-", "%%", "(", "_", "²", "’", "слово", " naïve", " là"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(5000)]
    texts = ["\u00e9a \u00a0,\t\n", " là là", "\nlà\nx", *made]
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.encoder(vocabulary()).encode(texts)] == library_ids(texts)


def test_new_words_share_calls_of_the_model():
    encoder, calls = tokens.Encoder(vocabulary()), []

    class Model:
        def tokenize(self, text, model=encoder.model):
            calls.append(text)
            return model.tokenize(text)

    encoder.model = Model()
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(640)]
    texts = [" " + " ".join(words[k:k + 64]) + "\n" + words[k] for k in range(0, 640, 64)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == library_ids(texts)
    assert len(calls) <= 650 // 32 + 1


@pytest.mark.parametrize("n", [1, 63, 64, 129, 5000, 40_001])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), np.minimum(rng.zipf(1.3, n), 50_256), np.zeros(n, np.int64), np.arange(n) % 3):
        assert (range_coder.decode_ids(range_coder.encode_ids(ids, 50_257), n, 50_257) == ids).all()


def test_prediction_pays_and_damage_raises():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_257, 50), 800)
    block = range_coder.write_block([1], [ids.astype("<u4").tobytes()], 50_257)
    assert len(block) < len(ids) // 2  # 15.6 bits an id without contexts
    names, lengths, back = range_coder.read_block(block)
    assert names == [1] and lengths.tolist() == [len(ids)] and (back == ids).all()
    damaged = bytearray(block)
    damaged[-5] ^= 1
    with pytest.raises(ValueError):
        range_coder.read_block(bytes(damaged))
    with pytest.raises(ValueError):
        range_coder.write_block([1], [np.array([60_000], "<u4").tobytes()], 50_257)


def test_token_file_holds_all_documents_in_order(spark, monkeypatch, tmp_path):
    file = range_coder.encode_documents(documents(spark), vocabulary())
    file.write.parquet(str(tmp_path / "f"))
    got = range_coder.decode_documents(spark.read.parquet(str(tmp_path / "f")), keep_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    text = {r[0]: r[1] for r in ROWS}
    at = 0
    for r, ids in zip(got, library_ids([text[r["doc_id"]] for r in got]), strict=True):
        raw = np.array([*ids, 0], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids) + 1, zlib.crc32(raw), raw)
        at += len(ids) + 1
    nothing = range_coder.encode_documents(empty(spark), vocabulary())
    nothing.write.parquet(str(tmp_path / "e"))
    assert range_coder.decode_documents(spark.read.parquet(str(tmp_path / "e"))).count() == 0


def brute_two_fit(counts, capacity):
    """Sequence by sequence, on single pieces."""
    left = sorted(n for n, c in counts.items() for _ in range(c))
    out = []
    while left:
        own, gap = [], capacity
        while True:
            fit = [n for n in left if n <= gap]
            if not fit:
                break
            left.remove(fit[-1])
            own.append(fit[-1])
            gap -= fit[-1]
        small = min(own)
        best = max(((a + b, a, b) for i, a in enumerate(left) for b in left[:i] if a + b <= gap + small), default=(0, 0, 0))
        if gap and best[0] > small:
            own.remove(small)
            left.append(small)
            for n in best[1:]:
                left.remove(n)
            own += best[1:]
            left.sort()
        out.append(sorted(own, reverse=True))
    return out


def test_plan_is_the_greedy_one_and_keeps_every_piece():
    rng = random.Random(3)
    for _ in range(30):
        counts = {rng.randrange(1, 60): rng.randrange(1, 6) for _ in range(12)}
        plan = packing.plan(counts, 60)
        used = {}
        for lengths, times in plan:
            assert sum(lengths) <= 60 and times > 0
            for n in lengths:
                used[n] = used.get(n, 0) + times
        assert used == counts
        assert abs(sum(t for _, t in plan) - len(brute_two_fit(counts, 60))) <= 1


def test_packing_places_every_token(spark):
    placed = packing.best_two_fit(documents(spark), vocabulary(), keep_ids=True).cache()
    rows = placed.collect()
    text = {r[0]: r[1] for r in ROWS}
    for doc_id, times in ((None, 1), (2, 1), (3, 1), (4, 1), (6, 2), (7, 1)):
        own = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["piece"])
        want = np.array([*library_ids([text[doc_id]])[0], 2], "<u4").tobytes()
        if times == 1:
            assert b"".join(bytes(r["ids"]) for r in own) == want
            assert [r["length"] for r in own[1:]] == [1024] * (len(own) - 1)
            assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        else:
            assert len(own) == times and all(bytes(r["ids"]) == want for r in own)
    bins = {}
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 1024) + 1
    whole = packing.sequences(placed).where(F.length("ids") != F.col("length") * 4).count()
    assert whole == 0 and packing.best_two_fit(empty(spark), vocabulary()).count() == 0

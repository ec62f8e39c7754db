import random
import sys
from collections import Counter
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures_llm import LONG, ROWS, SCHEMA, documents, empty, vocabulary  # noqa: E402

from spendlens.llm import alignment, collocations, hat_trie, pieces, queries  # noqa: E402

PARTS = ["a", "b", "the", " ", "  ", "     ", "\n", "\t", "é", "日本", "▁", "\x00", "😀", "ing", "er", ".", ",", "1", "<s>", "<0x41>", "�", "ﬁ",
         "\r\n", " t", "​", "x" * 40, "<|endoftext|>", "; ", "()", " “", "².", "a" * 3]


def model():
    return queries.vocabulary("piece_bpe_32k.model")


def made_texts(n, seed=3, most=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(most))) for _ in range(n)]


# ---- pieces


def test_agenda_equals_the_library_on_whole_texts():
    own = pieces.Vocabulary(model())
    for text in [*made_texts(4000), LONG[:40_000], "x" * 3000, " " * 100, "日本語のテキスト" * 40, "a b" * 500]:
        ids = own.library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == own.library.decode(ids)
    assert not own.doubtful


def test_rows_and_single_agendas_agree():
    own = pieces.Vocabulary(model())
    rng = random.Random(8)
    entries = [p for p in own.id_of if len(p) < 12]
    units = ["".join(rng.choices(entries, k=rng.randrange(1, 5)))[:pieces.ROW_LENGTH + 4] for _ in range(3000)]
    assert own._spelled(units) == [own.spell(own.merge(u)) for u in units]


def test_decoding_of_any_ids_equals_the_library():
    own, rng = pieces.Vocabulary(model()), random.Random(5)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(260), 28_705, 259, 0, 1, 2, 3 + 0xE9]) for _ in range(rng.randrange(9))]
        assert own.decode(ids) == own.library.decode(ids)


def test_round_trip_of_awkward_documents(spark):
    rows = [*ROWS, *((100 + k, t, None, None, None) for k, t in enumerate(made_texts(60)))]
    got = {}
    for r in pieces.round_trip(documents(spark, rows), model(), list(pieces.COLUMNS)).collect():
        got.setdefault(r.doc_id, []).append(r)
    library = pieces.Vocabulary(model()).library
    assert sorted(map(len, got.values())) == sorted(Counter(r[0] for r in rows).values())
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "")
        decoded = library.decode(ids) if ids else ""
        for r in got[doc_id]:
            assert (r.n_tokens, r.ids, r.decoded, r.agrees) == (len(ids), ids, decoded, True)
            assert r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == sha256(decoded.encode()).hexdigest()
    encoded = pieces.round_trip(documents(spark, rows), model())
    assert {(r.doc_id, r.decoded) for r in pieces.decode_ids(encoded, model()).collect()} == {(d, r.decoded) for d, x in got.items() for r in x}
    assert pieces.round_trip(empty(spark), model()).count() == 0


def test_memory_of_units_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_UNITS", 20)
    own = pieces.Vocabulary(model())
    texts = made_texts(500, seed=9)
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in own.encode_all(texts)] == own.library.encode(texts)


# ---- alignment


def plain_alignment(texts):
    """(n_a, n_b, n_groups, n_links, digest, links) of every text, byte by byte."""
    own = alignment.Aligner(vocabulary(), model())
    out = []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = own.a.whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = own.b.library.encode(text) if text else []
        a_of = [k for k, t in enumerate(a) for _ in own.a_bytes[t]]
        b_of = [k for k, t in enumerate(b) for _ in own.b_bytes[t]]
        if b"".join(own.a_bytes[t] for t in a) != whole or b"".join(own.b_bytes[t] for t in b) != whole:
            a, b, a_of, b_of = [], [], [], []
        links = sorted(set(zip(a_of, b_of, strict=True)))
        groups, left, right = [], [], []
        for n in range(len(a_of)):
            left += [a_of[n]] * (a_of[n] not in left)
            right += [b_of[n]] * (b_of[n] not in right)
            if n + 1 == len(a_of) or a_of[n] != a_of[n + 1] and b_of[n] != b_of[n + 1]:
                groups.append((left, right))
                left, right = [], []
        written = ";".join(",".join(str(a[k]) for k in x) + "|" + ",".join(str(b[k]) for k in y) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sha256(written.encode()).hexdigest() if a else "",
                    [(a[x], b[y]) for x, y in links]))
    return out


def plain_counts(aligned):
    count = Counter(pair for row in aligned for pair in row[5])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [(*row[:4], sum(count[p] == most[p[1]] for p in row[5]), sum(count[p] for p in row[5]), row[4]) for row in aligned]


@pytest.mark.parametrize("pack, slice_", [(alignment.PACK, alignment.SLICE), (50, 16)])
def test_alignment_equals_bytewise_comparison(spark, pack, slice_, monkeypatch):
    texts = [*made_texts(150), None, "", "▁", "a▁b", "plain words only", "plain words only", "café naïve", "日本語 text", "x" * 300]
    aligner = alignment.Aligner(vocabulary(), model())
    monkeypatch.setattr(alignment, "SLICE", slice_)
    got = aligner.align(aligner.tokens(texts))
    plain = plain_alignment(texts)
    assert list(zip(*(got[c].tolist() for c in ("n_a", "n_b", "n_groups", "n_links")), got["groups_sha256"], strict=True)) == [p[:5] for p in plain]
    assert list(zip(got["links_a"].tolist(), got["links_b"].tolist(), strict=True)) == [x for p in plain for x in p[5]]


def test_alignment_query_counts_over_the_corpus(spark):
    rows = [*[r for r in ROWS if r[1] != LONG], (4, LONG[:3000], None, None, None),
            *((100 + k, t, None, None, None) for k, t in enumerate(made_texts(80)))]
    want = sorted(((r[0] is not None, r[0] or 0, *p) for r, p in zip(rows, plain_counts(plain_alignment([r[1] for r in rows])), strict=True)))
    got = alignment.align(documents(spark, rows), vocabulary(), model()).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in got) == want
    assert alignment.align(empty(spark), vocabulary(), model()).count() == 0


def test_packs_hold_every_pair_once_and_two_bytes_a_link(spark):
    texts = made_texts(40)
    (pack,) = alignment.packs(documents(spark, [(k, t, None, None, None) for k, t in enumerate(texts)]).coalesce(1), vocabulary(), model()).collect()
    links = sorted(x for p in plain_alignment(texts) for x in p[5])
    assert len(pack.links) == 2 * len(links) == 2 * sum(pack.n_links)
    pairs = list(zip(pack.pair_a, pack.pair_b, strict=True))
    assert pairs == sorted(set(links)) and [pack.pair_n[pairs.index(p)] for p in pairs] == [Counter(links)[p] for p in pairs]
    assert sorted(pairs[k] for k in np.frombuffer(pack.links, "<u2")) == links


def test_texts_that_ids_do_not_spell_are_found(monkeypatch):
    entries = [b"a", b"bc", b"", b"d" * 9]
    joined, lengths = np.frombuffer(b"".join(entries), np.uint8), np.array([len(e) for e in entries])
    texts = [b"abc", b"abd", b"", b"dddddddddbc", b"ab", b"a", b"bca"]
    ids = [np.array(x, np.uint32) for x in ([0, 1], [0, 1], [2], [3, 2, 1], [0, 1], [], [1, 0])]
    for slice_ in (4, 8, 1 << 18):
        monkeypatch.setattr(alignment, "SLICE", slice_)
        assert alignment.spells(ids, joined, lengths, texts).tolist() == [True, False, True, True, False, False, True]
    assert alignment.spells([], joined, lengths, []).tolist() == []


def test_a_pack_for_every_few_links_gives_the_same(spark):
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(made_texts(60))], SCHEMA).repartition(5)
    whole = sorted(map(tuple, alignment.align(df, vocabulary(), model()).collect()))
    texts = {r[0]: r[1] for r in df.collect()}
    want = plain_counts(plain_alignment([texts[k] for k in sorted(texts)]))
    assert [r[1:] for r in whole] == want


def test_products_equal_dense_ones():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x, y = rng.integers(0, 2, (5, 7)), rng.integers(0, 2, (7, 4))
        sparse = [alignment.Csr.incidence(np.append(0, np.cumsum(m.sum(1))), np.nonzero(m)[1], m.shape[1]) for m in (x, y)]
        for left, right, dense in ((*sparse, x @ y), (sparse[1].transposed(), sparse[0].transposed(), (x @ y).T)):
            made, out = left @ right, np.zeros(dense.shape, int)
            out[made.rows(), made.columns] = made.values
            assert (out == dense).all()
    left, right = alignment.group_links(np.array([2, 2, 1, 3]), np.array([1, 3, 4]))
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 2)]


def test_segments_stand_for_their_bytes():
    rng = np.random.default_rng(5)
    for _ in range(50):
        ends = [np.sort(np.append(rng.integers(0, 40, n), 40)) for n in (4, 7)]  # tokens without bytes among them
        a, b = (np.diff(e, prepend=0) for e in ends)
        left, right = alignment.segments_of(a, b)
        assert left.width == right.width == len({*ends[0], *ends[1]} - {0}) and right.values.sum() == 40
        whole = alignment.bytes_of(a) @ alignment.bytes_of(b).transposed()
        for got, want in zip(alignment.overlap_links(a, b), (whole.rows(), whole.columns, whole.values), strict=True):
            assert (got == want).all()


def test_ids_taken_from_the_library_are_the_agendas():
    texts = [*made_texts(200), None, "", "▁", "a▁b", "x\ny \n  z", "日本語 <s> text", " "]
    own, taken = pieces.Vocabulary(model()), pieces.Vocabulary(model(), 40, own=False)
    assert [ids for ids, _ in own.encode_all(texts)] == [ids for ids, _ in taken.encode_all(texts)]


# ---- collocations


def plain_collocations(rows, least, share, top):
    import re

    counts, words = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^ \t]+", piece)
            words[lang] += len(w)
            own = counts.setdefault(lang, Counter())
            for size in range(1, 5):
                own.update(tuple(w[k:k + size]) for k in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in held.items():
            if any(p == q[k:k + len(p)] and 100 * b >= share * a for q, b in held.items() if len(q) > len(p) for k in range(len(q))):
                continue
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), " ".join(p), left, right))
        out += [(lang, k, p, -a, left, right, words[lang], -s) for k, (s, a, _, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def made_documents(n=300, seed=2):
    rng = random.Random(seed)
    vocab = ["the", "of", "Of", "river", "BANK", "é", "É", "x y", "日本", "a_b", "it's", "▁"]
    joints = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", ";:", "?!"]
    rows = [(k, "".join(rng.choice(vocab[:3 + k % 10]) + rng.choice(joints) for _ in range(rng.randrange(60))),
             rng.choice(["en", "en", "fr", None, "und", ""]), None, None) for k in range(n)]
    return [*rows, *rows[:5], (None, None, "en", None, None), (None, "the river bank", None, None, None)]


@pytest.mark.parametrize("limit, burst, part", [(1_000_000, 16_384, 100_000), (300, 8, 100_000), (60, 2, 7)])
def test_trie_counts_equal_plain_counts(limit, burst, part, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(hat_trie, "BURST", burst)
    monkeypatch.setattr(collocations, "PART", part)
    monkeypatch.setattr(collocations, "BATCH", 500)
    monkeypatch.setattr(collocations, "WORDS", 40)  # the numbering runs out and starts anew
    rows = [*made_documents(120), (9, " ".join(f"w{k * k % 83}" for k in range(3000)), "xx", None, None)]
    hot = {"en": [("the", "of"), ("of", "the"), ("the", "the"), ("none", "such")], "xx": [("w0", "w1")]}
    counter, got, total = collocations._Counter(limit, hot), Counter(), Counter()
    batches = []
    for _, text, lang, *_ in rows:
        for words in collocations._split(pa.array([text], pa.string())):
            batches += counter.add(lang or "und", words)
    batches += counter.finish()
    for b in batches:
        for lang, phrase, least, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not phrase:
                total[lang] += n
            for size in range(least, len(phrase.split(" ")) + 1) if phrase else ():
                got[lang, " ".join(phrase.split(" ")[:size])] += n
    want, words = Counter(), Counter()
    import re

    for _, text, lang, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^ \t]+", piece)
            words[lang or "und"] += len(w)
            want.update((lang or "und", " ".join(w[k:k + s])) for s in range(1, 5) for k in range(len(w) - s + 1))
    assert got == want and +total == +words


@pytest.mark.parametrize("least, share, top, limit", [(5, 80, 2000, 1_000_000), (3, 50, 20, 100), (2, 101, 40, 1_000_000)])
def test_collocations_equal_plain_ones(spark, least, share, top, limit):
    rows = made_documents()
    got = collocations.collocations(documents(spark, rows), least, share, top, limit)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, share, top)


def test_hot_pairs_decide_only_where_rows_meet(spark, monkeypatch):
    rows = made_documents(80)
    found = collocations.hot_pairs(documents(spark, rows), share=0.01)
    assert 0 < sum(map(len, found.values())) <= 100
    monkeypatch.setattr(collocations, "hot_pairs", lambda docs: {"en": [("the", "of"), ("of", "the")], "fr": [("the", "the")]})
    assert sorted(map(tuple, collocations.collocations(documents(spark, rows), 3).collect())) == plain_collocations(rows, 3, 80, 2000)


def test_only_likely_pairs_leave_their_task(spark):
    rows = [(k, f"common words here, u{k} v{k} w{k} common words here x{k}", "en" if k % 2 else None, None, None) for k in range(400)]
    docs = documents(spark, rows)
    likely = collocations.likely_pairs(docs, 100)
    got = collocations.runs(docs, likely=likely).collect()
    long = [r for r in got if " " in r["phrase"]]
    rare = sum(any(c.isdigit() for c in r["phrase"]) for r in long)
    assert rare < 400  # all of some 2,400 different sequences with numbers without the bitmap, a sixteenth or so of their pairs with it
    for lang in ("en", "und"):
        for phrase in ("common words", "words here", "common words here"):
            n = sum(r["n"] for r in long if r["lang"] == lang and (r["phrase"] + " ").startswith(phrase + " "))
            assert n == 400
        assert sum(r["n"] for r in got if r["lang"] == lang and r["phrase"] == "") == 200 * 10
    found = {(r["lang"], r["phrase"], r["f"]) for r in collocations.frequent(collocations.runs(docs, likely=likely), 100).collect()}
    assert found == {(r["lang"], r["phrase"], r["f"]) for r in collocations.frequent(collocations.runs(docs), 100).collect()}


def test_pair_hashes_leave_a_task_in_small_batches():
    import tracemalloc

    rng = np.random.default_rng(3)
    for size in (0, 1, collocations.ROWS, 260_000):
        held = [rng.integers(0, 200_000, size // 4 + k, dtype=np.uint64) << np.uint64(46) for k in range(4)]
        want = Counter(np.concatenate(held).view(np.int64).tolist())
        tracemalloc.start()
        batches = list(collocations._counts(held))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert not held and all(0 < b.num_rows <= collocations.ROWS for b in batches)
        assert [(k, n) for b in batches for k, n in zip(*(c.to_pylist() for c in b.columns), strict=True)] == sorted(
            want.items(), key=lambda x: x[0] % 2**64)
        assert peak < 32 * size + 500_000  # besides the hashes held: one copy, and the ends of equal ones
    assert list(collocations._counts([])) == list(collocations._counts([np.empty(0, np.uint64)])) == []


def test_pairs_meet_before_they_are_summed(spark, monkeypatch):
    plans, cut = [], collocations.cut
    monkeypatch.setattr(collocations, "cut", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, name))
    collocations.likely_pairs(documents(spark, made_documents(40)), 3)
    summed, met = plans[0].split("Exchange hashpartitioning(pair")
    assert "Aggregate" in summed and "Aggregate" not in met  # no table of a task's own hashes


def test_collocations_of_awkward_and_empty_tables(spark):
    assert sorted(map(tuple, collocations.collocations(documents(spark), 2, 80, 2000).collect())) == plain_collocations(ROWS, 2, 80, 2000)
    assert collocations.collocations(empty(spark)).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 6 * 10**12  # 2,000,000 times it is past 64 bits
    known = spark.createDataFrame([("en", "x", 1, big + 1), ("en", "y", 1, big), ("en", "x y", 2, big - 1), ("en", "", 0, 9 * big)],
                                  "lang string, phrase string, size int, f long")
    monkeypatch.setattr(collocations, "frequent", lambda spilled, least: known)
    got = collocations.collocations(empty(spark)).collect()
    assert [tuple(r) for r in got] == [("en", 1, "x y", big - 1, big + 1, big, 9 * big, 2_000_000 * (big - 1) // (2 * big + 1))]

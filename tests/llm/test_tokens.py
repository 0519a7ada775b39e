"""op11 and op13 against the libraries and brute force, on awkward rows and empty tables."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vintager.llm import alignment, common, pieces

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.read_model(B))


@pytest.fixture(params=["docs", "crowded"])
def either(request):
    return request.getfixturevalue(request.param)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def noise(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    signs = " ▁  aethñé漢字\n\t\x00😀the<0x0A></s><s><unk>"
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(50))) for _ in range(n)]


def test_agenda_equals_the_library(model):
    texts = [*noise(1, 3000), "a" * 20_000, " " * 3000, "▁" * 40, "the " * 3000, "漢" * 900]
    theirs = model.library.encode(texts, add_eos=True)
    assert [i.tolist() for i in model.encode_batch(texts)] == theirs
    assert [model.encode(t).tolist() for t in texts[:50]] == theirs[:50]
    assert [model.decode(np.array(i, np.int32)) for i in theirs] == model.library.decode(theirs)


def test_decoding_any_ids(model):
    """Control and unknown ids, broken byte runs, leading spaces."""
    rng = random.Random(2)
    some = [0, 1, 2, 3 + 0xC3, 3 + 0xE2, 3 + 0x82, 3 + 0xAC, 3 + 255, *map(model.ids.get, "▁t")]
    rows = [[rng.choice(some) for _ in range(rng.randrange(8))] for _ in range(3000)]
    assert [model.decode(np.array(r, np.int32)) for r in rows] == model.library.decode(rows)


@pytest.mark.parametrize("short", [0, 3, 40])
def test_stretches_without_the_memory(model, monkeypatch, short):
    """Forgetting stretches changes nothing, nor do heaps in place of shared rounds, nor no cuts."""
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "SHORT", short)
    whole = pieces.PieceModel(pieces.read_model(B))
    texts = noise(3, 300)
    theirs = model.library.encode(texts, add_eos=True)
    for k in range(0, 300, 50):
        assert [i.tolist() for i in whole.encode_batch(texts[k : k + 50])] == theirs[k : k + 50]
    joined = ["▁" + t.replace(" ", "▁") for t in texts if t]
    spelled = [[model.library.id_to_piece(i) for i in t[:-1]] for t in theirs if len(t) > 1]
    for text, own in zip(joined, spelled, strict=True):
        if not any(p.startswith("<0x") for p in own):
            assert whole.merged(text) == own


def test_rows_of_ids_are_decoded_together(model):
    rng = random.Random(7)
    some = [0, 1, 2, 3 + 0xC3, 3 + 0xE2, 3 + 0x82, 3 + 0xAC, 3 + 255, *map(model.ids.get, "▁t")]
    rows = [[rng.choice(some) for _ in range(rng.randrange(8))] for _ in range(3000)]
    rows += model.library.encode(noise(8, 500), add_eos=True)
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.array([i for r in rows for i in r], np.int32)
    assert model.decode_rows(flat, ends) == model.library.decode(rows)
    assert model.decode_rows(flat[:0], ends[:1]) == []
    assert model.decode_rows(flat[:0], np.zeros(3, np.int64)) == ["", ""]


def test_parts_are_encoded_once(monkeypatch):
    asked = []

    def encode(parts):
        asked.append(parts)
        return [np.array([len(p)], np.int32).tobytes() for p in parts]

    memory = common.Remembered(encode)
    data, rows = common.joined_rows([" é bb é", "", " bb ccccc"])
    starts = np.flatnonzero(data == 32)
    for _ in range(2):
        flat, ends = memory.ids(data, starts, rows, most=100, longest=4)
        assert flat.tolist() == [2, 3, 2, 3, 6] and ends.tolist() == [0, 3, 3, 5]
    # What is longer than four characters is not kept.
    assert asked == [[" é", " bb", " ccccc"], [" ccccc"]]
    memory.ids(data, starts, rows, most=1, longest=4)
    assert len(asked[-1]) == 3
    monkeypatch.setattr(common, "GATHERED", 2)
    assert memory.ids(data, starts, rows, most=100, longest=4)[0].tolist() == [2, 3, 2, 3, 6]
    none = memory.ids(data[:0], starts[:0], np.zeros(3, np.int64), most=1, longest=4)
    assert [x.tolist() for x in none] == [[], [0, 0, 0]]


@pytest.mark.parametrize("change", ["unigram", "bytes", "spaces", "pieces"])
def test_other_models_are_refused(change):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto.FromString(pieces.read_model(B))
    if change == "unigram":
        spec.trainer_spec.model_type = 1
    elif change == "bytes":
        spec.trainer_spec.byte_fallback = False
    elif change == "spaces":
        spec.normalizer_spec.remove_extra_whitespaces = True
    else:
        spec.pieces[400].type = pieces.USER_DEFINED
    with pytest.raises((ValueError, RuntimeError)):
        pieces.PieceModel(spec.SerializeToString())


def test_encoded_documents(either, awkward, no_docs, model):
    ids = pieces.encoded(either, B)
    rows = pieces.digested(pieces.decoded(ids, B)).collect()
    expected = Counter()
    for i, text in awkward:
        theirs = model.library.encode(text or "", add_eos=True)
        back = model.library.decode(theirs)
        expected[i, len(theirs), sha(" ".join(map(str, theirs))), sha(back)] += 1
    assert Counter(tuple(r) for r in rows) == expected
    assert pieces.digested(pieces.decoded(pieces.encoded(no_docs, B), B)).isEmpty()


def test_encoding_null_ids(spark):
    rows = spark.createDataFrame([(1, None), (None, [2])], pieces.ENCODED)
    assert {(r.doc_id, r.text) for r in pieces.decoded(rows, B).collect()} == {(1, ""), (None, "")}


def spelled(side, i):
    start = side.spelled.starts[i]
    return side.spelled.data[start : start + side.spelled.lengths[i]].tobytes()


def test_parts_at_spaces_keep_the_tokens():
    """Whatever white space and unusual characters stand around the spaces."""
    from tokenizers import Tokenizer

    rng = random.Random(6)
    signs = "  '\n\t\r\x0b\x0c\x85\xa0\u180e\u200b\u2003\u2028\u3000\ufeffaé1٣漢😀.!<|endoftext|>'s"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(20))) for _ in range(20_000)]
    texts += ["x" * 5000 + " y", " " * 300, ""]
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    rows = library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
    with open(A, "rb") as file:
        side = alignment.side_a(file.read())
    assert [i.tolist() for i in side.encode(texts)] == [r.ids for r in rows]
    assert all(" ".join(alignment.spaced_parts(t)) == t for t in texts)


def test_both_sides_encode_a_word_once(monkeypatch):
    """Repeated words of either side cost a look-up; letters with a mark need no library."""
    from tokenizers import Tokenizer

    asked = []
    merged = pieces.PairAgenda.merged
    monkeypatch.setattr(
        pieces.PairAgenda, "merged", lambda self, words: asked.append(len(words)) or merged(self, words)
    )
    with open(A, "rb") as a, open(B, "rb") as b:
        one, two = alignment.side_a(a.read()), alignment.side_b(b.read())
    rng = random.Random(9)
    words = ["Straße,", "été.", "Ǆ!", "ſ:", "ıİ?", "word", "ab", "ß;", "x.", "don't", "ª", "×", "Ⅷ", "1."]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(20)]
    rows = Tokenizer.from_file(A).encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
    library = pieces.PieceModel(pieces.read_model(B)).library
    for _ in range(2):
        assert [i.tolist() for i in one.encode(texts)] == [r.ids for r in rows]
        assert [i.tolist() for i in two.encode(texts)] == library.encode(texts)
    assert sorted(asked) == [0, 9, len(words)]


def plain_alignment(texts):
    """Per text (n_a, n_b, groups, links), by comparing all byte ranges."""
    one, two = alignment.sides(open(A, "rb").read(), open(B, "rb").read())
    out = []
    for text in texts:
        out.append((0, 0, [], []))
        if not text:
            continue
        sides = []
        for side in (one, two):
            at, spans = 0, []
            for i in side.encode([text])[0].tolist():
                spans.append((at, at + len(spelled(side, i)), i))
                at = spans[-1][1]
            sides.append(spans)
        raw = (" " + text).encode()
        if any(b"".join(spelled(s, x[2]) for x in sp) != raw for s, sp in zip((one, two), sides)):
            continue
        a, b = sides
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        groups, low = [], 0
        for end in sorted({x[1] for x in a} & {y[1] for y in b}):
            groups.append(tuple([x[2] for x in side if low < x[1] <= end] for side in (a, b)))
            low = end
        out[-1] = (len(a), len(b), groups, links)
    return out


def expected_scores(rows):
    parts = plain_alignment([t for _, t in rows])
    n_docs = Counter(pair for *_, links in parts for pair in set(links))
    most = defaultdict(int)
    for (a, _), n in n_docs.items():
        most[a] = max(most[a], n)
    out = Counter()
    for (doc, _), (n_a, n_b, groups, links) in zip(rows, parts, strict=True):
        named = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n_docs[p] == most[p[0]] for p in links)
        out[
            doc, n_a, n_b, len(groups), len(links), sha(named) if n_a else "", best,
            sum(n_docs[p] for p in links),
        ] += 1
    return out


@pytest.fixture(scope="module")
def brief(spark, awkward):
    """The awkward rows cut to where all pairs of ranges can be compared, and rows of their own."""
    rows = [(i, t and t[:600]) for i, t in awkward] + list(enumerate(noise(5, 60), 500))
    return rows + [(900, " <|endoftext|> </s> "), (901, "é" * 80), (901, "é" * 80), (902, "a▁b")]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.mark.parametrize("block", [1 << 21, 400])
def test_alignment_equals_brute_force(spark, brief, monkeypatch, block):
    """Also with the counts handed back in several blocks."""
    monkeypatch.setattr(alignment, "BLOCK", block)
    docs = spark.createDataFrame(brief, "doc_id long, text string").repartition(3)
    crowd = docs.withColumns({n: F.lit("mine") for n in ("pairs", "times", "row_key", "n_best", "a")})
    rows = alignment.scored(crowd if block == 400 else docs, A, B).select(COLUMNS).collect()
    assert Counter(tuple(r) for r in rows) == expected_scores(brief)


def test_alignment_of_nothing(spark, no_docs):
    assert alignment.scored(no_docs, A, B).isEmpty()
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id long, text string")
    rows = alignment.scored(docs, A, B).select(COLUMNS).collect()
    assert {tuple(r) for r in rows} == {(i, 0, 0, 0, 0, "", 0, 0) for i in (1, 2, None)}


def test_long_text_is_one_row(spark):
    text = " ".join(f"word{i % 977} straße" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    (row,) = alignment.aligned(docs, A, B).filter("doc_id = 1").collect()
    one, two = alignment.sides(open(A, "rb").read(), open(B, "rb").read())
    assert (row.n_a, row.n_b) == (len(one.encode([text])[0]), len(two.encode([text])[0]))
    assert pieces.encoded(docs, B).filter("size(ids) > 100000").count() == 1


def test_groups_as_text(spark):
    docs = spark.createDataFrame([(1, "ok"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.aligned(docs, A, B, groups=True).collect()}
    assert (rows[1].groups, rows[2].groups) == ("12876|3614", "")
    assert rows[1].groups_sha256 == sha("12876|3614")

"""The operators on awkward rows against brute force, and on empty tables."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vintager.llm import (
    chat, decontaminate, mixing, pii, prefix_doubling, quality, recompression, sketch_join,
    toxicity, warc,
)

SMALL = "/root/testdata/sf0.001"


def bag(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(params=["docs", "crowded"])
def either(request):
    return request.getfixturevalue(request.param)


def test_quality_measurements(either, awkward):
    columns = ["doc_id", *quality.MEASURES[:5], "base_failed"]
    rows = quality.judged(either).select(*columns).collect()
    assert bag(rows) == bag((i, *brute.quality(t)) for i, t in awkward)


def test_quality_policies_and_ablations(docs, no_docs):
    rows = quality.judged(docs)
    assert rows.filter("kept AND base_failed").isEmpty()
    bits = [r.fail_bits for r in rows.collect()]
    used = quality.mask(quality.POLICIES["strict-1"])
    for r in quality.ablations(rows).collect():
        bit = quality.mask((r.rule,))
        assert r.failed == sum(bool(b & bit) for b in bits)
        assert r.failed_alone == sum(b & used == bit for b in bits)
        assert r.kept == sum(not b & used for b in bits)
    assert quality.judged(no_docs).isEmpty()
    assert quality.ablations(quality.ledger(no_docs)).isEmpty()


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join(either, awkward, k, percent):
    if (k, percent) != (3, 90) and "core" in either.columns:
        pytest.skip("once is enough")
    expected = brute.components(awkward, k, percent)
    rows = sketch_join.joined(either, k, percent).collect()
    # Texts of one id are told apart; its component is the smallest of each text's own.
    assert bag(rows) == bag((i, *expected[(i, t or "")]) for i, t in awkward)


def test_jaccard_chain_of_near_copies(spark):
    """A chain whose ends differ is one component; the groups need several pivots."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(12):
        words = words[:]
        words[5 * i % 60] = f"n{i}"
        rows.append((100 - i, " ".join(words)))
    rows += [(i, f"{i} alone") for i in range(5)]
    found = sketch_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute.components(rows, 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {
        i: expected[(i, t)] for i, t in rows
    }


def test_jaccard_groups_over_many_cells(spark, monkeypatch):
    """Near copies in one group that is dealt to cells of a few classes."""
    monkeypatch.setattr(sketch_join.links, "__defaults__", (4,))
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(60):
        words = base[:]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(90)] = f"n{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    found = sketch_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute.components(rows, 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {
        i: expected[(i, t)] for i, t in rows
    }


def test_jaccard_representatives(docs, awkward):
    kept = sketch_join.representatives(docs, 5, 80)
    assert kept.columns == docs.columns
    expected = brute.components(awkward, 5, 80)
    groups = defaultdict(set)
    for (i, t), (n, component) in expected.items():
        groups[component if n else (i, t)].add((i, t))
    rows = [(r.doc_id, r.text or "") for r in kept.collect()]
    blank = [(i, t or "") for i, t in awkward if not brute.words(t)]
    assert Counter(r for r in rows if not brute.words(r[1])) == Counter(blank)
    worded = [r for r in rows if brute.words(r[1])]
    assert len(worded) == len(set(worded))
    one = Counter(expected[r][1] for r in worded)
    assert set(one.values()) == {1} and set(one) == {c for n, c in expected.values() if n}
    assert all(r[0] == expected[r][1] for r in worded)


def test_word_repeats(either, awkward):
    rows = recompression.deduplicated(either).drop("kept_text").collect()
    assert bag(rows) == bag(brute.word_repeats(awkward))


def test_byte_repeats(either, awkward):
    rows = prefix_doubling.deduplicated(either).drop("kept").collect()
    assert bag(rows) == bag(brute.byte_repeats(awkward))


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_random_texts(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        if texts and rng.random() < 0.6:
            a = rng.choice(texts)
            i, j = sorted(rng.randrange(len(a) + 1) for _ in range(2))
            body = a[i:j] + "".join(rng.choice("ab ") for _ in range(rng.randrange(30)))
            b = rng.choice(texts)
            i, j = sorted(rng.randrange(len(b) + 1) for _ in range(2))
            texts.append(body + b[i:j])
        else:
            n = rng.choice([10, 300, 900])
            texts.append("".join(rng.choice("abc  ") for _ in range(n)))
    rows = [(rng.randrange(10_000), t) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = recompression.deduplicated(docs).drop("kept_text").collect()
    assert bag(found) == bag(brute.word_repeats(rows))
    found = prefix_doubling.deduplicated(docs).drop("kept").collect()
    assert bag(found) == bag(brute.byte_repeats(rows))


def test_repeats_in_versions_of_one_document(spark):
    """Rows that share a doc_id begin alike; a part of that is in another document too."""
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    # Bytes, and words that are cut into units of several windows.
    part, runs = letters(700), "u " * 30 + "v " * 30
    rows = [(1, part + " A"), (1, part + " B"), (1, part + " B"), (2, "x" + part[80:640] + "y")]
    rows += [(None, runs + "A"), (None, runs + "B"), (-9, "s " + runs[20:100] + "t"), (None, None)]
    for _ in range(40):
        i, a = rng.choice(rows[-20:])
        a = a or letters(900)
        j, k = sorted(rng.randrange(len(a) + 1) for _ in range(2))
        if rng.random() < 0.5:
            rows.append((i, a[:k] + letters(30)))
        else:
            rows.append((rng.randrange(12), letters(20) + a[j:k] + letters(rng.choice([9, 900]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = prefix_doubling.deduplicated(docs).drop("kept").collect()
    assert bag(found) == bag(brute.byte_repeats(rows))
    found = recompression.deduplicated(docs).drop("kept_text").collect()
    assert bag(found) == bag(brute.word_repeats(rows))


def test_long_text_is_cut_for_hashing(spark):
    """A text of several slices repeats inside itself and in another."""
    rng = random.Random(5)
    part = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    body = "".join(chr(97 + x) for x in np.random.default_rng(1).integers(0, 26, 2_300_000))
    # Capitals around the copies, so that neither of them goes on as the other does.
    long = body[:1_048_000] + "X" + part + "Y" + body[1_048_000:] + "Z" + part
    docs = spark.createDataFrame([(1, long), (2, part[:1000])], "doc_id long, text string")
    rows = {r.doc_id: r for r in prefix_doubling.deduplicated(docs).drop("kept").collect()}
    assert (rows[1].n_removed, rows[1].n_spans, rows[2].n_removed) == (4000, 2, 1000)


PERSONAL = [
    (1, "mail a.b@c.de, x@y.z.w_d@e.fg end"), (2, None), (3, ""), (4, "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255"),
    (5, "4111 1111 1111 1111 and 4111-1111-1111-1112 x4737097684299439"), (6, "+1 (743) 555-3824, +12 3 +123456789012345678"),
    (7, "é𝔘 a@b.c é +49 30 1234567. 10.0.0.1@x.y"), (8, "9" * 5000 + "." + "1." * 5000 + "a@" * 3000 + "b.c" * 3000),
    (9, "a" * 100_000), (10, "a@b a@.c @b.c a@b.c.@d.e"), (11, "\n1.1.1.1\n2.2.2.2"), (None, "z@z.zz"),
    (1, "mail a.b@c.de, x@y.z.w_d@e.fg end"), (12, "+" * 2000 + "1" + " " * 2000),
]


def test_personal_data(spark):
    docs = spark.createDataFrame(PERSONAL, "doc_id long, text string")
    rows = pii.reported(docs).collect()
    expected = []
    for i, text in PERSONAL:
        spans = brute.pii(text)
        counts = [sum(s.startswith(kind) for s in spans) for kind in pii.KINDS]
        expected.append((i, *counts, brute.sha(",".join(spans)), ",".join(spans)))
    assert bag(rows) == bag(expected)


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"words here email: user{i}@mail.org and more") for i in range(8)]
    rows += [(20 + i, f"his email: user{i}[at]mail{i}.org ok") for i in range(3)]
    rows += [(30, "the 4999 of the 12 in the 77"), (31, "the a@b.cd the x@y.zz the c@d.ef")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.reported(docs).collect()}
    text = rows[8][1]
    start = text.index("user0[at]")
    assert found[20] == f"context:{start}:{start + len('user0[at]mail0.org')}"
    assert found[30] == "" and found[0].startswith("email:")


def _contexts(spark, rows):
    """Context spans that the operator finds in ``rows``."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = set()
    for r in pii.reported(docs).collect():
        for kind, start, end in (s.split(":") for s in r.spans.split(",") if s):
            if kind == "context":
                out.add((r.doc_id, int(start), int(end)))
    return out


def test_contexts_reach_patterns_without_seeds(spark):
    """handle: precedes no e-mail, ping: only what handle: adds, call: only what ping: adds, ..."""
    rows = [(i, f"email: user{i}@mail.org") for i in range(40)]
    chain = ["email:", "handle:", "ping:", "call:", "nick:", "ask:"]
    for k, (label, following) in enumerate(zip(chain, chain[1:])):
        for j in range(6):
            name = f"u{k}{j}[at]y.org"
            rows += [(100 + 10 * k + j, f"{label} {name}")]
            rows += [(1000 * i + 10 * k + j, f"{following} {name}") for i in range(1, 5)]
    rows += [(300, "ask: u98[at]z.org"), (301, "ask: u99[at]z.org"), (302, "the u97[at]z.org")]
    found = _contexts(spark, rows)
    assert found == brute.contexts(rows)
    texts = dict(rows)
    assert {texts[i][a:b] for i, a, b in found} == {
        *(f"u{k}{j}[at]y.org" for k in range(5) for j in range(6)), "u98[at]z.org", "u99[at]z.org",
    }


def test_contexts_after_other_instances(spark):
    """Second ones of a list, labels with a digit, groups of digits, labels of marks alone."""
    rows = [(i, f"email: a{i}@b.cd, c{i}@x.org so") for i in range(20)]
    rows += [(100, "email: a1@b.cd, u4[at]x.org so"), (101, "email: a1@b.cd, u5[at]x.org, u6@x")]
    rows += [(200 + i, f"call tel2: +{i + 1} {200 + i} {555 - i} {i:04}") for i in range(20)]
    rows += [(300, "tel2: 555-1234"), (301, "call tel2: 303 777 9999 1234 and")]
    rows += [(400 + i, f"by = e{i}@b.cd and") for i in range(9)] + [(500, "by = e9[at]b.cd and")]
    rows += [(600 + i, f"@ f{i}@b.cd and") for i in range(9)] + [(700, "@ f9[at]b.cd and")]
    found = _contexts(spark, rows)
    assert found == brute.contexts(rows)
    texts = dict(rows)
    words = {(i, texts[i][a:b]) for i, a, b in found}
    assert words >= {
        (100, "u4[at]x.org"), (101, "u5[at]x.org"), (300, "555-1234"), (301, "303"), (301, "777"),
        (301, "9999"), (301, "1234"), (500, "e9[at]b.cd"), (700, "f9[at]b.cd"),
    }


@pytest.mark.parametrize("seed", range(3))
def test_contexts_of_random_texts(spark, seed):
    rng = random.Random(seed)
    labels = ["mail:", "at", "(Tel", "id", "tel2:", "--", "@"]
    rows = [(0, None), (1, "")]
    for i in range(2, 90):
        out = []
        for _ in range(rng.randrange(1, 6)):
            out.append(rng.choice(labels[: 3 + 2 * seed]))
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                n = rng.randrange(12)
                mail = [f"u{n}@m.org", f"u{n}@m.org,", f"<U{n}@m.org>"]
                out.append(rng.choice([*mail, *mail, *mail, f"v{n}[at]m", f"(V{n}[at]m.", "so"]))
        rows.append((i, rng.choice([" ", "\n ", "  "]).join(out)))
    assert _contexts(spark, rows) == brute.contexts(rows)


def test_context_spans_are_broadcast_by_their_number(spark, monkeypatch):
    one = spark.sql("SELECT 1L AS doc, 2L AS ver, array(1, 2, 3) AS extra")
    hinted = lambda: "ResolvedHint" in pii._checked(one)._jdf.queryExecution().analyzed().toString()
    assert hinted()
    monkeypatch.setattr(pii, "BROADCAST_SPANS", 2)
    assert not hinted()
    assert pii._checked(one.limit(0)).collect() == []


def test_redaction(spark):
    rows = [(1, "a@b.cd or 4111 1111 1111 1111!", 30), (2, None, 0), (3, "1.2.3.4@x.yz", 12), (4, "no", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.redacted(docs).collect()}
    assert out[1] == ("[EMAIL] or [CARD]!", 18)
    assert out[2] == (None, 0) and out[4] == ("no", 2)
    assert out[3] == ("[EMAIL]", 7)


def test_personal_data_of_nothing(no_docs):
    assert pii.reported(no_docs).isEmpty() and pii.redacted(no_docs).isEmpty()


def test_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for rows in (
        decontaminate.matches(no_docs, bench), decontaminate.clean(no_docs, bench),
        warc.round_trip(pages), toxicity.classified(no_docs, labels), sketch_join.joined(no_docs),
        sketch_join.representatives(no_docs, 5, 80), recompression.deduplicated(no_docs),
        prefix_doubling.deduplicated(no_docs), mixing.mix_sources(no_docs),
        chat.read_back(chat.formatted(turns)),
    ):
        assert rows.collect() == []


def test_myers_distance():
    rng = random.Random(2)
    for _ in range(300):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        distance, end = decontaminate.myers(pattern, text)
        assert distance == brute.edit_distance(pattern, text)
        if distance < len(pattern):
            assert brute.edit_distance(pattern[::-1], text[:end][::-1]) <= distance


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"t{rng.randrange(300)}" for _ in range(40))) for i in range(5)]
    items += [(5, "short one"), (6, None), (7, items[0][1]), (8, " \n "), (9, "Why?")]
    rows = [(1, None), (2, ""), (3, "x y z " * 4000), (4, "A short\tONE"), (4, "A short\tONE")]
    rows += [(5, "two short ones, one short"), (6, "why? no"), (7, "so why?? not"), (None, "short one")]
    for i, item in items[:5]:
        filler = " ".join(f"f{rng.randrange(300)}" for _ in range(60))
        for errors in (0, 4, 9, 40):
            text = list(item)
            for _ in range(errors):
                text[rng.randrange(len(text))] = rng.choice(["", "q", "zz"])
            rows.append((100 * i + errors + 100, f"{filler} {''.join(text).upper()}\n{filler}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({n: F.lit("mine") for n in ("item_id", "distance", "match_start")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = decontaminate.matches(docs, bench).collect()
    expected = []
    for doc_id, text in rows:
        for item_id, item in items:
            item, body = decontaminate.normal(item), decontaminate.normal(text)
            if 0 < len(item) < decontaminate.SHORT_CHARS:
                if f" {item} " in f" {body} ":
                    expected.append((doc_id, item_id, 0))
            elif item:
                distance = brute.edit_distance(item, body)
                if distance <= len(item) // decontaminate.CHARS_PER_ERROR:
                    expected.append((doc_id, item_id, distance))
    assert bag((r.doc_id, r.item_id, r.distance) for r in found) == bag(expected)
    assert {(4, 5, 0), (6, 9, 0), (None, 5, 0)} <= set(expected)
    places = {(r.doc_id, r.item_id): (r.match_start, r.match_end) for r in found}
    assert (places[4, 5], places[6, 9]) == ((2, 11), (0, 4))
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert bag((r.doc_id,) for r in kept.collect()) == bag(
        (i,) for i, _ in rows if i not in {i for i, _, _ in expected}
    )


def test_warc_round_trip(spark):
    import base64
    import hashlib

    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 9000
    rows = [(5, "http://a", "same"), (3, "http://b\r\nX: y%", "same"), (9, None, "same"), (1, "u", None),
            (2, "u", ""), (4, "v", big), (6, "w", big), (7, "q", "x" * 70_000), (7, "q", "x" * 70_000),
            (None, "n", "lone"), (8, "z", "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    for least in (0, 3):
        found = warc.round_trip(pages, least).collect()
        expected = []
        for i, url, html in rows:
            raw = (html or "").encode()
            same = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
            first = min(same) if same else None
            revisit = len(raw) >= least and i != first
            digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
            expected.append((i, url, len(raw), digest, "revisit" if revisit else "response",
                             first if revisit else None))
        assert bag(tuple(r)[:6] for r in found) == bag(expected)
        payloads = {(r.page_id, r.payload) for r in found if r.record_type == "response"}
        assert (4, big.encode()) in payloads and max(r.n_segments for r in found) > 5


def test_warc_rejects_damage():
    block = warc.chunked(b"abc" * 5000)
    assert warc.dechunked(block) == b"abc" * 5000
    with pytest.raises(ValueError):
        warc.dechunked(block[:100] + block[200:])


def test_chat_round_trip(spark):
    nasty = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (2, 1, "assistant", "é𝔘<>\\l\n"), (2, 0, None, None),
            (3, 0, "a>b\n<c", ""), (None, 0, "assistant", "x"), (2, 2, "assistant", ""), (2, None, "user", "first"),
            (4, 0, "assistant", "big " * 200_000), (2, 0, None, None), (5, 1, "system", "</turn>\n<turn assistant>\n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(turns.repartition(3)).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    by = defaultdict(list)
    for row in sorted(rows, key=key):
        by[row[0]].append((row[2] or "", row[3] or ""))
    assert {r.conv_id: chat.parse(r.formatted) for r in out} == dict(by)
    digests = {r.conv_id: r for r in chat.read_back(chat.formatted(turns)).collect()}
    for conv, said in by.items():
        loss = "".join(t for role, t in said if role == "assistant")
        row = digests[conv]
        assert (row.n_turns, row.loss_chars) == (len(said), len(loss))
        assert row.turns_sha256 == brute.sha("".join(f"{r}\n{t}\n" for r, t in said))
        assert row.loss_sha256 == brute.sha(loss)


def test_mixing(either, awkward):
    rows = mixing.mix_sources(either).collect()
    size, total, taken = {}, defaultdict(int), defaultdict(int)
    for i, t in awkward:
        source = f"s{(i or 0) % 4}" if i != 5 else None
        total[source] += len(brute.words(t))
    expected = brute.targets(dict(total))
    assert len(rows) == len(awkward)
    longest = max(len(brute.words(t)) for _, t in awkward)
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(expected[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        size[r.source] = max(size.get(r.source, 0), r.size)
    for source, words in taken.items():
        assert abs(words - expected[source]) <= size[source] / 2 + 1e-6 <= longest
    again = mixing.mix_sources(either.repartition(5)).collect()
    assert bag(rows) == bag(again)


def test_toxicity_learns_misspellings(spark):
    rng = random.Random(4)
    clean = [f"c{rng.randrange(300)}" for _ in range(300)]
    bad = ["dreadful", "rotten", "horrid"]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(clean) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            text[:4] = [rng.choice(bad) for _ in range(4)]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1000, " ".join(["dreadfull", "rottten", "horrrid", "dreadfuls", *clean[:56]])),
             (1001, " ".join(clean[:60])), (1002, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.classified(docs, known).collect()}
    wrong = sum(out[i].predicted != y for i, y in labels if out[i].held_out)
    assert wrong <= 5 and out[1000].predicted == 1 and out[1001].predicted == 0
    assert 0 <= out[1002].score <= 1 and out[None].held_out is False
    assert toxicity.fit([]).word("x") == 0.0 and toxicity.fit([("a", 1)]).bias > 5


def test_toxicity_cuts_many_words_together(monkeypatch):
    """The same n-grams as word by word; only words that repeat an n-gram are cut alone."""
    rng = random.Random(12)
    signs = "abcé漢😀.!"
    words = ["", "a", "ab", "abc", "abcd", "...", "aaaaaa", "漢字漢字漢字", "x" * 300]
    words += ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(3000)]
    expected = [sorted(toxicity.subwords(w)) for w in words]
    weight = np.random.default_rng(1).normal(size=toxicity.BUCKETS) * (np.arange(toxicity.BUCKETS) % 3 > 0)
    alone = []
    cut = toxicity.subwords
    monkeypatch.setattr(toxicity, "subwords", lambda w: alone.append(w) or cut(w))
    owner, bucket = toxicity.subwords_together(words)
    found = [sorted(bucket[owner == k].tolist()) for k in range(len(words))]
    assert found == expected and len(alone) < len(words) / 5
    model = toxicity.Model(weight.astype(np.float32), 0.0)
    scores = model.words(words)
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 7)
    assert model.words(words) == scores and model.words([]) == []
    for score, own in zip(scores, expected, strict=True):
        seen = [x for x in weight.astype(np.float32)[own].tolist() if x]
        assert score == pytest.approx(sum(seen) / len(seen) if seen else 0.0)

r"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A is byte-level BPE (a tokenizers file), B is a sentencepiece model; both see a space and
the text. Words of either side are encoded when first met (B by ``pieces``, whose ids equal the
library's) and looked up afterwards. Each Arrow batch gives one frame of token starts for A and one for B. ``pandas.merge_asof``
keyed by document finds for each token start of one side the token of the other side that covers it;
the union of both directions is every overlapping pair, since of two overlapping tokens one starts
inside the other. Byte offsets where tokens of both sides end cut a document into groups.

How many documents link a pair of ids is counted over all documents: a document's distinct pairs are
written once with their multiplicities, counted by Spark, and the counts are handed back to the
documents in blocks of at most about ``BLOCK`` pairs, so neither the driver nor a task holds more of
them, however many there are. The written lists are read once per block; no list of links is shuffled.

Defined cases: a text that is null, empty or whose tokens' bytes do not spell it (U+2581 in it) has no
tokens: zeros and an empty digest; a text of any length is one row and never cut; repeated rows are
documents of their own, a null doc_id stays null; an empty table gives no rows; other columns,
whatever their names, are left out. The files are read in the driver and travel with the function.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintager.llm.common import Pieces, Remembered, joined_rows, slices, written
from vintager.llm.pieces import PairAgenda, PieceModel, split

BLOCK = 1 << 21
# What follows an id in the written groups: another id of its side, the other side, a group, nothing.
MARKS = (b",", b"|", b";", b"")
# Bytes of an id with its mark: vocabularies are below ten million.
NAME_BYTES = 8
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " pairs array<long>, times array<int>"
)
SCORED = "row_key long, n_best long, count_sum long"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes for 256, 257 and so on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


Rows = tuple[np.ndarray, np.ndarray]


class Side:
    """A tokenizer: the ids of texts, and the bytes that each id stands for.

    ``encode_rows`` gives the ids of all texts and the offsets of each.
    """

    def __init__(self, encode_rows: Callable[[list[str]], Rows], spelled: list[bytes]):
        if len(spelled) > 10 ** (NAME_BYTES - 1):
            raise ValueError(f"A vocabulary of {len(spelled)} ids is too large.")
        self.encode_rows, self.size = encode_rows, len(spelled)
        self.spelled = Pieces(spelled)
        # The decimal id with what follows it in the written groups, filled up with zero bytes;
        # number = mark * size + id.
        names = [b"%d%s" % (i, mark) for mark in MARKS for i in range(len(spelled))]
        self.named = np.array(names, f"S{NAME_BYTES}").view(np.uint64).reshape(-1, NAME_BYTES // 8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return split(*self.encode_rows(texts))


def _rows(lists: list[np.ndarray]) -> Rows:
    flat = np.concatenate([np.zeros(0, np.int32), *lists])
    return flat, np.cumsum([0, *map(len, lists)])


# A word boundary for every reading of the byte-level pattern: a space before a character that is
# certainly not white space. What else stands after a space stays with what is before it.
_SOLID = (
    (0x21, 0x7E), (0xA1, 0x167F), (0x1681, 0x180D), (0x180F, 0x1FFF), (0x2070, 0x2FFF),
    (0x3001, 0xFEFE), (0xFF00, 0x10FFFF),
)
_SOLID_BOUNDS = np.array([(low, high + 1) for low, high in _SOLID]).reshape(-1)
# Letters for every version of Unicode's classes, and marks that are neither letters nor numbers.
_ENDS = ".,;:!?"
_LETTERS = re.compile(rf" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+[{_ENDS}]?").fullmatch
REMEMBERED_CHARS, REMEMBERED = 40, 1 << 19


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The character of UTF-8 text that begins at each place; 0 beyond its end."""
    padded = np.append(data, np.zeros(4, np.uint8))
    code = padded[at].astype(np.int64)
    long = np.flatnonzero(code >= 0xC0)
    lead, at = code[long], at[long]
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    value = lead & (0xFF >> (size + 1))
    for k in (1, 2, 3):
        more = size > k
        value[more] = value[more] << 6 | padded[at[more] + k] & 0x3F
    code[long] = value
    return code


def spaced(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, each after a space, where their parts begin, and the rows.

    The tokens of each part are its own: the byte-level pattern takes a space to the word that
    follows it, and of longer white space the last space alone, whatever stands before.
    """
    data, rows = joined_rows([" " + t for t in texts])
    space = np.flatnonzero(data == ord(" "))
    sure = np.searchsorted(_SOLID_BOUNDS, _code_points(data, space + 1), "right") % 2 == 1
    begins = np.zeros(len(data), bool)
    begins[space[sure]] = True
    begins[rows[:-1]] = True
    return data, np.flatnonzero(begins), rows


def spaced_parts(text: str) -> list[str]:
    """The parts of ``text``, without the space before each."""
    data, starts, _ = spaced([text])
    raw = data.tobytes()
    ends = [*starts[1:].tolist(), len(raw)]
    return [raw[a + 1 : b].decode() for a, b in zip(starts.tolist(), ends, strict=True)]


def _letter_agenda(model: dict, value: dict[str, int]) -> PairAgenda | None:
    """The merges of a byte-level BPE model, for bytes as Latin-1 characters; None for other models."""
    if model["type"] != "BPE" or any(
        model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    ):
        return None
    ids = model["vocab"]
    sign = {byte: character for character, byte in value.items()}
    symbols = np.array([ids[sign[byte]] for byte in range(256)], np.int64)
    pairs = []
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs.append((ids[left], ids[right], rank, ids[left + right]))
    return PairAgenda(symbols, pairs)


def side_a(file: bytes) -> Side:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(file.decode())
    tokenizer.encode_special_tokens = True
    value = byte_level()
    spelled = [b""] * tokenizer.get_vocab_size()
    for entry, i in tokenizer.get_vocab().items():
        spelled[i] = bytes(value[c] for c in entry) if all(c in value for c in entry) else b""

    def library(texts: list[str]) -> list[bytes]:
        rows = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("i", r.ids).tobytes() for r in rows]

    form = json.loads(file)
    before = form["pre_tokenizer"] or {}
    if form["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex", True):
        return Side(
            lambda texts: _rows([np.frombuffer(x, np.int32) for x in library([" " + t for t in texts])]),
            spelled,
        )
    agenda = _letter_agenda(form["model"], value)

    def new_ids(parts: list[str]) -> list[bytes]:
        # A space and letters are one word of the pattern, and a mark at the end another one of a
        # single byte; their merges need no library.
        plain = [len(x) <= REMEMBERED_CHARS and bool(_LETTERS(x)) and agenda is not None for x in parts]
        other = iter(library([x for x, ok in zip(parts, plain, strict=True) if not ok]))
        if not any(plain):
            return list(other)
        words = [x for x, ok in zip(parts, plain, strict=True) if ok]
        ids, owner = agenda.merged([x.rstrip(_ENDS).encode().decode("latin-1") for x in words])
        raw = ids.astype(np.int32).tobytes()
        cuts = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        found = (
            raw[a:b] + ends.get(x[-1], b"") for x, a, b in zip(words, cuts[:-1], cuts[1:], strict=True)
        )
        return [next(found) if ok else next(other) for ok in plain]

    ends = {x: agenda.symbols[ord(x)].astype(np.int32).tobytes() for x in _ENDS} if agenda else {}
    memory = Remembered(new_ids)
    return Side(lambda texts: memory.ids(*spaced(texts), REMEMBERED, REMEMBERED_CHARS), spelled)


def side_b(file: bytes) -> Side:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=file)
    spelled = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        special = model.is_control(i) or model.is_unknown(i)
        spelled.append(
            b"" if special else bytes([int(piece[3:5], 16)]) if model.is_byte(i)
            else piece.replace("▁", " ").encode()
        )
    try:
        pieces = PieceModel(file)
    except ValueError:
        # A model of another type: whole texts by the library.
        return Side(lambda texts: _rows(model.encode(texts, num_threads=1, out_type="numpy")), spelled)
    return Side(pieces.ids_of, spelled)


_sides: dict[str, tuple[Side, Side]] = {}


def sides(file_a: bytes, file_b: bytes) -> tuple[Side, Side]:
    """Both tokenizers, built once per Python worker."""
    key = hashlib.sha256(file_a + file_b).hexdigest()
    if key not in _sides:
        _sides.clear()
        _sides[key] = side_a(file_a), side_b(file_b)
    return _sides[key]


class _Tokens:
    """The tokens of all texts of a batch: document, id and byte range in the texts' joined bytes."""

    def __init__(self, side: Side, flat: np.ndarray, rows: np.ndarray):
        self.counts = np.diff(rows)
        self.ids = flat.astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.bytes, self.ends = side.spelled.joined(self.ids)
        self.starts = self.ends - side.spelled.lengths[self.ids]

    def spell(self, lengths: np.ndarray, raw: np.ndarray) -> bool:
        """Whether every document's tokens spell its text."""
        own = np.bincount(self.doc, self.ends - self.starts, len(lengths))
        return bool((own == lengths).all()) and np.array_equal(self.bytes, raw)

    def frame(self, name: str) -> pd.DataFrame:
        return pd.DataFrame(
            {"at": self.starts, "doc": self.doc, name: np.arange(len(self.ids)), f"{name}_at": self.starts}
        )


def overlaps(a: _Tokens, b: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The token numbers of all pairs whose byte ranges overlap, each pair once."""
    left, right = a.frame("i"), b.frame("j")
    covered = pd.merge_asof(left, right, on="at", by="doc")
    covering = pd.merge_asof(right, left, on="at", by="doc")
    # Tokens that start together are found from both sides.
    covering = covering[covering["at"] != covering["i_at"]]
    return (
        np.concatenate([covered["i"].to_numpy(np.int64), covering["i"].to_numpy(np.int64)]),
        np.concatenate([covered["j"].to_numpy(np.int64), covering["j"].to_numpy(np.int64)]),
    )


def _written_groups(
    a: _Tokens, b: _Tokens, side_1: Side, side_2: Side, n_docs: int
) -> tuple[list[bytes], np.ndarray]:
    """The groups of each document as text, and how many they are."""
    shared = np.intersect1d(a.ends, b.ends, assume_unique=True)
    group = np.concatenate([np.searchsorted(shared, a.ends), np.searchsorted(shared, b.ends)])
    second = np.repeat([0, 1], [len(a.ids), len(b.ids)])
    order = np.argsort(2 * group + second, kind="stable")
    group, second = group[order], second[order]
    ids, doc = np.concatenate([a.ids, b.ids])[order], np.concatenate([a.doc, b.doc])[order]
    last = np.ones(len(ids), bool)
    last[:-1] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
    closes = np.ones(len(ids), bool)
    closes[:-1] = doc[1:] != doc[:-1]
    mark = np.where(last, np.where(second == 0, 1, np.where(closes, 3, 2)), 0)
    # Both sides' names in one array: those of B follow those of A.
    names = _both_names(side_1, side_2)
    size = np.where(second == 0, side_1.size, side_2.size)
    counts = np.bincount(doc, minlength=n_docs)
    cuts = (NAME_BYTES * np.append(0, np.cumsum(counts))).tolist()
    raw = names.take(second * len(side_1.named) + mark * size + ids, axis=0).tobytes()
    texts = [raw[x:y].translate(None, b"\0") for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return texts, np.bincount(doc[last & (second == 1)], minlength=n_docs)


def _both_names(side_1: Side, side_2: Side) -> np.ndarray:
    both = getattr(side_1, "both", None)
    if both is None or both[0] is not side_2:
        both = side_1.both = (side_2, np.concatenate([side_1.named, side_2.named]))
    return both[1]


def align(texts: list[str | None], side_1: Side, side_2: Side) -> list[tuple]:
    """Per text (n_a, n_b, n_groups, n_links, groups, distinct pairs, their multiplicities)."""
    out: list[tuple] = [(0, 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
    good = [i for i, t in enumerate(texts) if t]
    if not good:
        return out
    rows_a, rows_b = (s.encode_rows([texts[i] for i in good]) for s in (side_1, side_2))
    joined, ends = joined_rows([" " + texts[i] for i in good])
    a, b = _Tokens(side_1, *rows_a), _Tokens(side_2, *rows_b)
    lengths = np.diff(ends)
    if not (a.spell(lengths, joined) and b.spell(lengths, joined)):
        rows_a, rows_b = split(*rows_a), split(*rows_b)
        raw = [x.tobytes() for x in split(joined, ends)]
        spelled = [
            n for n, x in enumerate(raw)
            if all(s.spelled.joined(r[n])[0].tobytes() == x for s, r in ((side_1, rows_a), (side_2, rows_b)))
        ]
        if not spelled:
            return out
        good = [good[n] for n in spelled]
        a = _Tokens(side_1, *_rows([rows_a[n] for n in spelled]))
        b = _Tokens(side_2, *_rows([rows_b[n] for n in spelled]))
    i, j = overlaps(a, b)
    written_groups, n_groups = _written_groups(a, b, side_1, side_2, len(good))
    n_links = np.bincount(a.doc[i], minlength=len(good))
    # Sorted by document, then pair. Documents of a batch times both vocabularies stay in 63 bits.
    span = side_1.size * side_2.size
    if len(good) * span >= 1 << 63:
        raise ValueError("The vocabularies are too large for a batch of this many documents.")
    keys = np.sort((a.doc[i] * side_1.size + a.ids[i]) * side_2.size + b.ids[j])
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    times = np.diff(np.append(first, len(keys)))
    doc, pairs = np.divmod(keys[first], span)
    cuts = np.searchsorted(doc, np.arange(len(good) + 1))
    for d, place in enumerate(good):
        own = slice(cuts[d], cuts[d + 1])
        out[place] = (
            int(a.counts[d]), int(b.counts[d]), int(n_groups[d]), int(n_links[d]), written_groups[d],
            pairs[own], times[own],
        )
    return out


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat).cast(kind))


def aligned(docs: DataFrame, path_a: str, path_b: str, groups: bool = False) -> DataFrame:
    """Per row of docs: counts, the digest of its groups, its distinct linked pairs and how often.

    A pair is id of A times the size of B's vocabulary plus id of B. With ``groups`` the groups
    themselves are a column too, as ``a1,a2|b1;a3|b2,b3``.
    """
    files = []
    for path in (path_a, path_b):
        with open(path, "rb") as file:
            files.append(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(*files)
        for batch in slices(batches):
            rows = align(batch.column("text").to_pylist(), *both)
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in columns[4]]
            arrays = [
                batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]),
                pa.array(digests, pa.string()),
                _lists(list(columns[5]), pa.int64()), _lists(list(columns[6]), pa.int32()),
            ]
            if groups:
                arrays.append(pa.array(columns[4], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    schema = ALIGNED + (", groups string" if groups else "")
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, vocabulary: int) -> DataFrame:
    """(pair, n_docs, best): documents that link each pair, and whether none of its A id has more."""
    counted = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count("*").alias("n_docs")
    )
    counted = written(counted.withColumn("a", F.expr(f"pair div {vocabulary}")))
    # One row per id of A: the vocabulary bounds it, whatever the documents.
    most = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counted.join(F.broadcast(most), "a").select(
        "pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")
    )


def _scores(rows: DataFrame, block: DataFrame) -> DataFrame:
    """What one block of counted pairs adds to each row."""
    table = block.toArrow()
    pair = table.column("pair").to_numpy()
    order = np.argsort(pair)
    known = rows.sparkSession.sparkContext.broadcast(
        (pair[order], table.column("n_docs").to_numpy()[order], table.column("best").to_numpy()[order])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n_docs, best = known.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times")
            ends = lists.offsets.to_numpy()
            asked = lists.values.to_numpy()[ends[0] : ends[-1]]
            often = times.values.to_numpy()[times.offsets[0].as_py() : times.offsets[-1].as_py()]
            place = np.minimum(np.searchsorted(pair, asked), len(pair) - 1)
            often = np.where(pair[place] == asked, often, 0)
            sums = []
            for value in (best[place], n_docs[place]):
                total = np.concatenate([[0], np.cumsum(often * value)])
                sums.append(np.diff(total[ends - ends[0]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), *(pa.array(s, pa.int64()) for s in sums)],
                ["row_key", "n_best", "count_sum"],
            )

    return rows.select("row_key", "pairs", "times").mapInArrow(run, SCORED)


def scored(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of docs: counts and groups, and how its links rank among those of all documents."""
    with open(path_b, "rb") as file:
        vocabulary = side_b(file.read()).size
    rows = written(
        aligned(docs, path_a, path_b).withColumn("row_key", F.monotonically_increasing_id())
    )
    counts = written(pair_counts(rows, vocabulary))
    blocks = max(1, math.ceil(counts.count() / BLOCK))
    block = F.pmod(F.xxhash64("pair"), F.lit(blocks))
    sums = None
    for k in range(blocks):
        part = counts.filter(block == k)
        if part.isEmpty():
            continue
        part = _scores(rows, part)
        sums = part if sums is None else sums.union(part)
    plain = rows.drop("pairs", "times")
    if sums is None:
        none = F.lit(0).cast("long")
        return plain.withColumns({"n_best": none, "count_sum": none}).drop("row_key")
    total = sums.groupBy("row_key").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    return plain.join(total, "row_key").drop("row_key")

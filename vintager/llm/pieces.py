r"""SentencePiece encoding and decoding for merge-type (BPE) models.

Encoding puts every pair of adjacent symbols that makes a piece on an agenda ordered by score, then
by position, merges the first, and adds the pairs that the new symbol makes with its neighbours.
Characters that are no piece become their bytes' pieces. Decoding joins the pieces' bytes. In every
Arrow batch the ids and the decoded texts are compared with those of the sentencepiece library; a
difference stops the job with the document's id.

Where no piece holds a space after another character, nothing can be merged across the start of a
run of spaces, so a text is cut there and each stretch has an agenda of its own; the result is the
agenda's over the whole text. The agendas of all new stretches of an Arrow batch are worked off side
by side in numpy, one merge of each at a time; a long stretch has a heap of its own. What a stretch
gave is kept for its next occurrence, within a bound.

The model file is read in the driver and its bytes travel with the function, so executors need no
file. Models are refused by name that are not of merge type, have no byte pieces, change characters
before encoding, drop white space, or hold user-defined or unused pieces.

Defined cases: a null or empty text has the end id alone and decodes to an empty text; a text of any
length is one row and never cut; repeated rows give repeated rows; a null doc_id stays null; an empty
table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintager.llm.common import Pieces, Remembered, joined_rows, slices

SPACE = "▁"
# Fixed values of the model format: the kind of a model and of its pieces.
MERGES = 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, ids array<int>, text string"
NEVER = np.iinfo(np.int64).max
# Stretches of up to so many characters are merged side by side and remembered, about so many.
SHORT, REMEMBERED = 40, 1 << 19


class PairAgenda:
    """Agendas of adjacent symbols worked off side by side.

    ``symbols`` gives the symbol of each code point; a pair (left, right, rank, into) of symbols
    may be merged into another, those of lower rank first.
    """

    def __init__(self, symbols: np.ndarray, pairs: list[tuple[int, int, int, int]]):
        self.symbols = symbols
        left, right, rank, into = np.array(pairs, np.int64).reshape(-1, 4).T
        self.span = int(max(symbols.max(), into.max(initial=0))) + 1
        keys = left * self.span + right
        order = np.argsort(keys)
        # The last entry stands for pairs that are none.
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(rank[order], NEVER)
        self.pair_into = np.append(into[order], 0)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER if they make no piece) and piece of each pair of symbols."""
        keys = left * self.span + right
        place = np.searchsorted(self.pair_keys, keys)
        found = self.pair_keys[place] == keys
        return np.where(found, self.pair_rank[place], NEVER), self.pair_into[place]

    def merged(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of all stretches, and the stretch of each, in order."""
        counts = np.array([len(x) for x in stretches], np.int64)
        points = np.frombuffer("".join(stretches).encode("utf-32-le"), "<u4")
        symbol, owner = self.symbols[points], np.repeat(np.arange(len(counts)), counts)
        rank = np.full(len(symbol), NEVER, np.int64)
        into = np.zeros(len(symbol), np.int64)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside], into[inside] = self._pairs(symbol[inside], symbol[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(owner))))
            open_ = lowest < NEVER
            if not open_.all():
                done.append((owner[~open_], symbol[~open_]))
                symbol, owner, rank, into, lowest = (
                    x[open_] for x in (symbol, owner, rank, into, lowest)
                )
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == lowest)
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]
            symbol[hit] = into[hit]
            rest = np.ones(len(symbol), bool)
            rest[hit + 1] = False
            symbol, owner = symbol[rest], owner[rest]
            # The merged symbol has the pair of the one it took in until its own is looked up.
            rank[hit], into[hit] = rank[hit + 1], into[hit + 1]
            rank, into = rank[rest], into[rest]
            at = hit - np.arange(len(hit))
            for left in (at, at - 1):
                left = left[(left >= 0) & (left + 1 < len(owner))]
                left = left[owner[left] == owner[left + 1]]
                rank[left], into[left] = self._pairs(symbol[left], symbol[left + 1])
        owner = np.concatenate([x for x, _ in done]) if done else np.zeros(0, np.int64)
        symbol = np.concatenate([x for _, x in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return symbol[order], owner[order]


class PieceModel:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        form = spec.normalizer_spec
        kinds = {p.type for p in spec.pieces}
        for wrong, reason in (
            (spec.trainer_spec.model_type != MERGES, "is not of merge type"),
            (not spec.trainer_spec.byte_fallback, "has no byte pieces"),
            (len(form.precompiled_charsmap) > 0, "changes characters"),
            (form.remove_extra_whitespaces, "drops white space"),
            (not form.escape_whitespaces, "keeps plain spaces"),
            (spec.trainer_spec.treat_whitespace_as_suffix, "ends words with a space"),
            (bool(kinds & {USER_DEFINED, UNUSED}), "holds user-defined or unused pieces"),
        ):
            if wrong:
                raise ValueError(f"The sentencepiece model {reason}.")
        self.prefix = " " if form.add_dummy_prefix else ""
        self.end = self.library.eos_id()
        self.order = {p.piece: -p.score for p in spec.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.byte_ids = np.zeros(256, np.int32)
        self.surface: list[bytes] = []
        self.kind = np.array([p.type for p in spec.pieces], np.int8)
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif p.type == CONTROL:
                self.surface.append(b"")
            elif p.type == UNKNOWN:
                self.surface.append(spec.trainer_spec.unk_surface.encode())
            else:
                self.surface.append(p.piece.replace(SPACE, " ").encode())
        self.opens = np.array([p.type == NORMAL and p.piece[:1] == SPACE for p in spec.pieces])
        self.spelled = Pieces(self.surface)
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.order)
        self.memory = Remembered(self._new_ids)
        self.base = len(self.surface)

    @cached_property
    def agenda(self) -> PairAgenda:
        """Every pair of symbols that makes a piece, with the piece's place in the order of scores.

        A symbol is a piece's id, or for a character that is no piece ``base`` plus its code point.
        A plain space is the model's.
        """
        symbols = np.arange(self.base, self.base + 0x110000, dtype=np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                symbols[ord(piece)] = i
        symbols[ord(" ")] = symbols[ord(SPACE)]
        ranks = {score: i for i, score in enumerate(sorted(set(self.order.values())))}
        pairs = []

        def symbol(part: str) -> int | None:
            return int(symbols[ord(part)]) if len(part) == 1 else self.ids.get(part)

        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left, right, ranks[self.order[piece]], i))
        return PairAgenda(symbols, pairs)

    def _ids_together(self, stretches: list[str]) -> list[bytes]:
        """The ids of each stretch, as the bytes of 32-bit integers."""
        symbol, owner = self.agenda.merged(stretches)
        foreign = np.flatnonzero(symbol >= self.base)
        if len(foreign):
            spelled = [chr(x - self.base).encode() for x in symbol[foreign].tolist()]
            counts = np.ones(len(symbol), np.int64)
            counts[foreign] = sizes = np.array([len(x) for x in spelled])
            starts = np.cumsum(counts) - counts
            symbol, owner = np.repeat(symbol, counts), np.repeat(owner, counts)
            within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            values = np.frombuffer(b"".join(spelled), np.uint8)
            symbol[np.repeat(starts[foreign], sizes) + within] = self.byte_ids[values]
        raw = symbol.astype(np.int32).tobytes()
        cuts = (4 * np.searchsorted(owner, np.arange(len(stretches) + 1))).tolist()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def ids_alone(self, stretch: str) -> bytes:
        """The ids of one stretch of any length."""
        parts = self.merged(stretch.replace(" ", SPACE))
        ids = ([self.ids[s]] if s in self.ids else self.byte_ids[list(s.encode())] for s in parts)
        return np.array([i for x in ids for i in x], np.int32).tobytes()

    def _new_ids(self, stretches: list[str]) -> list[bytes]:
        short = iter(self._ids_together([x for x in stretches if len(x) <= SHORT]))
        return [next(short) if len(x) <= SHORT else self.ids_alone(x) for x in stretches]

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all texts with their prefixes, where their stretches begin, and the rows."""
        data, rows = joined_rows([(self.prefix + t).replace(SPACE, " ") if t else "" for t in texts])
        begins = np.zeros(len(data), bool)
        if self.cuts:
            space = data == ord(" ")
            begins[1:] = space[1:] & ~space[:-1]
        begins[rows[:-1][np.diff(rows) > 0]] = True
        return data, np.flatnonzero(begins), rows

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the offsets of each."""
        return self.memory.ids(*self.stretches(texts), REMEMBERED, SHORT)

    def encode_rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, an end id after each, and the offsets of each."""
        flat, rows = self.ids_of(texts)
        return np.insert(flat, rows[1:], self.end), rows + np.arange(len(rows))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        return split(*self.encode_rows(texts))

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def merged(self, text: str) -> list[str]:
        """The symbols that are left of one stretch of any length, with the agenda as a heap."""
        n, order = len(text), self.order
        symbols: list[str] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for left in range(n - 1):
            piece = text[left : left + 2]
            if piece in order:
                agenda.append((order[piece], left, piece))
        heapify(agenda)
        while agenda:
            _, left, piece = heappop(agenda)
            right = after[left]
            # Entries of symbols that were merged since no longer spell their piece.
            if not symbols[left] or right == n or symbols[left] + symbols[right] != piece:
                continue
            symbols[left], symbols[right] = piece, ""
            after[left] = follower = after[right]
            if follower < n:
                before[follower] = left
                longer = piece + symbols[follower]
                if longer in order:
                    heappush(agenda, (order[longer], left, longer))
            if (leader := before[left]) >= 0:
                longer = symbols[leader] + piece
                if longer in order:
                    heappush(agenda, (order[longer], leader, longer))
        return [s for s in symbols if s]

    def decode_rows(self, flat: np.ndarray, rows: np.ndarray) -> list[str]:
        """What each row of ids decodes to."""
        data, ends = self.spelled.joined(flat)
        raw, cuts = data.tobytes(), np.append(0, ends)[rows]
        control = np.append(0, np.cumsum(self.kind[flat] == CONTROL))[rows]
        some = rows[1:] > rows[:-1]
        first, last = (flat[np.where(some, x, 0)] if len(flat) else rows[1:] for x in (rows[:-1], rows[1:] - 1))
        # An end id spells nothing; other control ids part the bytes around them.
        plain = ~some | (np.diff(control) == (self.kind[last] == CONTROL))
        drops = some & self.opens[first] if self.prefix else np.zeros(len(some), bool)
        out = []
        for k, (begin, end, ok) in enumerate(
            zip((cuts[:-1] + drops).tolist(), cuts[1:].tolist(), plain.tolist(), strict=True)
        ):
            try:
                text = raw[begin:end].decode() if ok else None
            except UnicodeDecodeError:
                text = None
            out.append(self.decode(flat[rows[k] : rows[k + 1]]) if text is None else text)
        return out

    def decode(self, ids: np.ndarray) -> str:
        kind = self.kind[ids]
        said = np.flatnonzero(kind != CONTROL)
        if not len(said):
            return ""
        first, last = said[0], said[-1] + 1
        parts = list(map(self.surface.__getitem__, ids[first:last].tolist()))
        if self.prefix and self.opens[ids[first]]:
            parts[0] = parts[0][1:]
        if len(said) == last - first:
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        # Bytes are read run by run, and each one that is not part of a character is replaced.
        out, run = [], b""
        for part, k in zip([*parts, b""], [*kind[first:last], CONTROL], strict=True):
            if k == BYTE:
                run += part
                continue
            out += [_lenient(run), part.decode()]
            run = b""
        return "".join(out)


def _lenient(raw: bytes) -> str:
    out = ""
    while raw:
        try:
            return out + raw.decode()
        except UnicodeDecodeError as error:
            out += raw[: error.start].decode() + "�"
            raw = raw[error.start + 1 :]
    return out


_models: dict[str, PieceModel] = {}


def loaded(model: bytes) -> PieceModel:
    """The model, built once per Python worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = PieceModel(model)
    return _models[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def split(flat: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The rows of joined ids."""
    ends = rows.tolist()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _checked_ids(
    model: PieceModel, texts: list[str], doc_ids: pa.Array
) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts of an Arrow batch; an error where the library has others."""
    flat, rows = model.encode_rows(texts)
    library = model.library.encode(texts, add_eos=True, num_threads=1, out_type="numpy")
    theirs = np.concatenate(library) if library else flat
    if not (np.array_equal(np.diff(rows), [*map(len, library)]) and np.array_equal(flat, theirs)):
        for i, (own, other) in enumerate(zip(split(flat, rows), library, strict=True)):
            if not np.array_equal(own, other):
                raise ValueError(f"Ids differ from the library's: document {doc_ids[i]}")
    return flat, rows


def _checked_texts(
    model: PieceModel, flat: np.ndarray, rows: np.ndarray, doc_ids: pa.Array
) -> list[str]:
    """The decoded texts of an Arrow batch; an error where the library has others."""
    texts = model.decode_rows(flat, rows)
    library = model.library.decode(split(flat, rows)) if texts else []
    for i, (own, theirs) in enumerate(zip(texts, library, strict=True)):
        if own != theirs:
            raise ValueError(f"Text differs from the library's: document {doc_ids[i]}")
    return texts


def _lists(flat: np.ndarray, rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(flat, pa.int32()))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) per row of docs, equal to the library's ids with the end id."""
    return _coded(docs, path, both=False)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) per row of docs: its ids, and what they decode to, in one pass."""
    return _coded(docs, path, both=True)


def _coded(docs: DataFrame, path: str, both: bool) -> DataFrame:
    raw = read_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(raw)
        for batch in slices(batches):
            doc_ids = batch.column("doc_id")
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            ids = _checked_ids(model, texts, doc_ids)
            columns = [doc_ids, _lists(*ids)]
            if both:
                columns.append(pa.array(_checked_texts(model, *ids, doc_ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, DECODED if both else ENCODED)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of encoded rows, the text equal to the library's; null ids count as none."""
    raw = read_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(raw)
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy().astype(np.int64)
            flat = ids.values.to_numpy()[ends[0] : ends[-1]]
            texts = _checked_texts(model, flat, ends - ends[0], batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"]
            )

    slim = rows.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return slim.mapInArrow(run, DECODED)


def digested(rows: DataFrame) -> DataFrame:
    """Counts and digests of decoded rows."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )

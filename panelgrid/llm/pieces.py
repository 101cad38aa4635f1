"""Exact merge-type (BPE) piece encoding by backtracking, and decoding.

Method: an Aho-Corasick automaton over the vocabulary gives the longest piece starting at every position of a
segment. Pieces are laid left to right, longest first. A piece may follow another only if the two are compatible:
re-merging the characters of both, best score first, must give exactly these two pieces again. When no piece fits,
the position is marked as failed in a bit field and the previous piece is tried again with its next shorter prefix.
The sequence in which all neighbours are compatible is the one that merging the whole segment would give, so the
result equals that of the library at a cost linear in the text.

A text is cut into segments before every space symbol that follows another character (no piece crosses there, which
`Vocabulary` checks) and around characters without a piece, which become byte pieces. Segments repeat, so every task
keeps a bounded memo of short ones.

Defined cases: a null or empty text has the begin and end ids only and decodes to the empty text; texts of any length
are encoded whole; repeated rows are encoded like any others; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgrid.llm.simtrie import let_go

SPACE = "▁"
MEMO_SEGMENTS = 350_000  # segments of a generation of a task's memo
MEMO_PAIRS = 1_000_000  # pairs of pieces whose compatibility is kept
MEMO_CHARS = 48  # longer segments are not kept


@dataclass
class Vocabulary:
    """Pieces of a merge-type model. `kinds`: n(ormal), b(yte) or c(ontrol)."""

    pieces: list[str]
    scores: list[float]
    kinds: list[str]
    begin: int
    end: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read the vocabulary file of a model; it must be of merge type with byte pieces and no normalisation."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        with open(path, "rb") as file:
            spec = schema.ModelProto.FromString(file.read())
        rules = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or rules.name != "identity" or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError(f"{path}: only merge-type models with byte pieces and identity normalisation are supported")
        model = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        kinds = ["b" if p.type == 6 else "n" if p.type == 1 else "c" for p in spec.pieces]
        if any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError(f"{path}: user-defined or unused pieces are not supported")
        if any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p, k in zip(spec.pieces, kinds) if k == "n"):
            raise ValueError(f"{path}: a piece crosses a word boundary")
        return cls([p.piece for p in spec.pieces], [p.score for p in spec.pieces], kinds, model.bos_id(), model.eos_id())


class Memo(dict):
    """Segment -> packed ids. Short segments are kept in two generations: when the younger is full it becomes the elder, and
    what is asked for again moves back to the younger, so frequent segments stay."""

    def __init__(self, encode, most: int = MEMO_SEGMENTS):
        super().__init__()
        self.encode, self.most = encode, most
        self.elder: dict[str, bytes] = {}

    def __missing__(self, segment: str) -> bytes:
        packed = self.elder.get(segment)
        if packed is None:
            packed = self.encode(segment)
        if len(segment) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.elder = dict(self)
                self.clear()
            self[segment] = packed
        return packed


class Encoder:
    def __init__(self, vocabulary: Vocabulary, most: int = MEMO_SEGMENTS):
        self.v = vocabulary
        normal = [i for i, k in enumerate(vocabulary.kinds) if k == "n"]
        self.rank = {vocabulary.pieces[i]: -vocabulary.scores[i] for i in normal}
        self.ids = {vocabulary.pieces[i]: i for i in normal}
        self.lengths = [len(p) for p in vocabulary.pieces]
        self.byte_ids = {int(vocabulary.pieces[i][3:5], 16): i for i, k in enumerate(vocabulary.kinds) if k == "b"}
        self.automaton = ahocorasick.Automaton()
        reachable = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        for piece in reachable:
            self.automaton.add_word(piece, (self.ids[piece], len(piece)))
        self.automaton.make_automaton()
        self.shorter = [-1] * len(vocabulary.pieces)
        for piece in reachable:
            prefix = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in reachable), None)
            self.shorter[self.ids[piece]] = -1 if prefix is None else self.ids[prefix]
        self.pairs: dict[int, bool] = {}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.words = Memo(lambda word: self.encode_segment(SPACE + word), most)
        self.parts = Memo(lambda part: array("I", self.encode_known(part)).tobytes())  # what stands between characters without a piece
        self.surfaces = [b"" if k == "c" else bytes([int(p[3:5], 16)]) if k == "b" else p.replace(SPACE, " ").encode() for p, k in zip(vocabulary.pieces, vocabulary.kinds)]

    def merge(self, text: str) -> list[str]:
        """Merge the characters of a short text, best score first and leftmost among equals."""
        parts = list(text)
        while True:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                return parts
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Re-merge the characters of two pieces; the outcome is kept."""
        a, b = self.v.pieces[left], self.v.pieces[right]
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        same = self.pairs[left * len(self.lengths) + right] = self.merge(a + b) == [a, b]
        return same

    def encode_known(self, text: str) -> list[int]:
        """Ids of a segment whose characters all have a piece."""
        size = len(text)
        longest = [0] * size
        for last, (piece, length) in self.automaton.iter(text):
            longest[last - length + 1] = piece  # matches come by their last character, so the longest stays
        lengths, shorter, known, width = self.lengths, self.shorter, self.pairs, len(self.lengths)
        failed = bytearray((size >> 3) + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = True
                if tokens:
                    fits = known.get(tokens[-1] * width + token)
                    if fits is None:
                        fits = self.compatible(tokens[-1], token)
                if fits:
                    tokens.append(token)
                    at = end
                    if at == size:
                        return tokens
                    token = longest[at]
                    continue
            token = shorter[token]
            while token < 0:  # nothing fits here: give the previous piece up for a shorter one
                failed[at >> 3] |= 1 << (at & 7)
                previous = tokens.pop()
                at -= lengths[previous]
                token = shorter[previous]

    def encode_segment(self, text: str) -> bytes:
        """Packed ids of a segment; characters without a piece become byte pieces."""
        if self.chars.issuperset(text):
            return array("I", self.encode_known(text)).tobytes()
        out: list[bytes] = []
        start = 0
        for i, char in enumerate(text):
            if char not in self.chars:
                if i > start:
                    out.append(self.parts[text[start:i]])
                out.append(array("I", [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]).tobytes())
                start = i + 1
        if start < len(text):
            out.append(self.parts[text[start:]])
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Packed 32-bit ids of a whole text, with begin and end."""
        edge = array("I", [self.v.begin]).tobytes(), array("I", [self.v.end]).tobytes()
        if not text:
            return b"".join(edge)
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":  # runs of spaces belong to one segment
            body = [self.encode_segment(x) for x in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        else:
            body = map(self.words.__getitem__, text.split(" "))
        return edge[0] + b"".join(body) + edge[1]

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: control pieces vanish, one leading space of the first piece goes, byte runs are read as UTF-8."""
        ids = array("I")
        ids.frombytes(packed)
        surface = b"".join(map(self.surfaces.__getitem__, ids))
        for i in ids:
            if self.v.kinds[i] != "c":
                if self.v.kinds[i] == "n" and surface.startswith(b" "):
                    surface = surface[1:]
                break
        return surface.decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def _encoder(broadcast) -> Encoder:
    """One encoder for each worker process and vocabulary; its memo lasts over tasks."""
    if broadcast.id_key not in _ENCODERS:
        let_go()
        _ENCODERS[broadcast.id_key] = Encoder(broadcast.vocabulary.value, broadcast.most)
    return _ENCODERS[broadcast.id_key]


@dataclass
class _Shared:
    vocabulary: object
    id_key: str
    most: int


def encode_texts(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, most: int = MEMO_SEGMENTS) -> DataFrame:
    """Columns `keep`, then ids (packed little-endian 32-bit, with begin and end) and decoded (the text of these ids).

    The vocabulary (one file of fixed size) is read by the driver and broadcast; each batch is encoded where it lies.
    `most`: segments of a generation of a worker's memo, which changes its memory but no result.
    """
    keep = ["doc_id"] if keep is None else keep
    vocabulary = Vocabulary.load(model_path)
    with open(model_path, "rb") as file:
        key = f"{hashlib.sha256(file.read()).hexdigest()}-{most}"
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(vocabulary), key, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                packed = [encoder.encode(t) for t in part.column(len(keep)).to_pylist()]
                decoded = [encoder.decode(p) for p in packed]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], names=[*keep, "ids", "decoded"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"{fields}, ids binary, decoded string")


def token_digests(docs: DataFrame, model_path: str, most: int = MEMO_SEGMENTS) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_texts(docs, model_path, most=most).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

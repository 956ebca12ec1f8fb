"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read field by field; from it the normaliser (character map,
removal of extra spaces, dummy prefix, the metaspace mark), the piece model (unigram
scores, or merges in the order of the scores for a BPE model), byte fallback and special
pieces are rebuilt. Where no piece has the metaspace mark inside or at its end, texts are
split before words first: no merge can cross such a place, so the ids are the same. A BPE model's
worker keeps the ids of up to KEPT such segments, those met last. Other batches are encoded in one call, with as many
threads as `RAYON_NUM_THREADS` or the task's cores allow.

Edge cases: a null text gives no ids and decodes to null; an empty text gives no ids;
very long texts are encoded whole; repeated rows are encoded each; an empty table gives
an empty result; other columns are ignored (kept by `encode`, whose `ids` and `decoded`
replace columns of those names). User-defined pieces of a unigram model are found in the
normalised text, the longest first; those of a BPE model in the raw text, with the parts around
normalised by themselves.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, read

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the format: the mark of a space, and piece and model types.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield key >> 3, data[i : i + n]
            i += n
        else:
            raise ValueError(f"wire type {kind}")


def parse(data: bytes) -> Model:
    """Field numbers are those of the public sentencepiece_model.proto."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    m.model_type = v
                elif k == 35:
                    m.byte_fallback = bool(v)
                elif k == 40:
                    m.unk_id = v
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.add_dummy_prefix = bool(v)
                elif k == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif k == 5:
                    m.escape_whitespaces = bool(v)
    return m


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, by the score of the whole, then by its id."""
    usable = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    out = []
    for p, i in usable.items():
        for k in range(1, len(p)):
            a, b = p[:k], p[k:]
            if a in usable and b in usable:
                out.append((-pieces[i][1], i, usable[a], usable[b], a, b))
    return [(a, b) for *_, a, b in sorted(out)]


#: A part of a normalised text that no merge crosses.
SEGMENT = f"{MARK}*[^{MARK}]+|{MARK}+"


def _inner(m: Model) -> bool:
    """Whether a piece has the mark inside or at its end, so that it may cross segments."""
    return any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind == NORMAL)


def build(m: Model):
    """A tokenizers.Tokenizer with the ids of the model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = m.pieces[m.unk_id][0]
    defined = sorted((p for p, _, kind in m.pieces if kind == USER_DEFINED), key=lambda p: (-len(p), p))
    if m.model_type == UNIGRAM:
        # only a text's own characters make normal pieces; a user-defined piece is set apart below and
        # beats what it could be cut into
        top = max([0.0, *(s for _, s, kind in m.pieces if kind == NORMAL)])
        score = {NORMAL: lambda p, s: s, USER_DEFINED: lambda p, s: top * len(p)}
        low = min([0.0, *(s for _, s, kind in m.pieces if kind == NORMAL)]) * 1000 - 1e6
        model = models.Unigram([(p, score[kind](p, s) if kind in score else low) for p, s, kind in m.pieces], m.unk_id, m.byte_fallback)
    elif m.model_type == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab, _merges(m.pieces), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.model_type}")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:  # spaces only: a tab or a line break that the character map leaves stays
        steps += [normalizers.Replace(Regex(r"\A +"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if m.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if m.remove_extra_whitespaces:
        steps.append(normalizers.Replace(Regex(rf"[{MARK if m.escape_whitespaces else ' '}]+\z"), ""))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    inner = _inner(m)
    splits = []
    if defined and m.model_type == UNIGRAM:
        splits.append(pre_tokenizers.Split(Regex("|".join(re.escape(p) for p in defined)), "isolated"))
    elif defined:
        t.add_tokens([AddedToken(p, normalized=False) for p in defined])
    if not inner and not splits:
        # before each run of marks; a piece is marks and then other characters
        splits.append(pre_tokenizers.Split(Regex(SEGMENT), "isolated"))
    if splits:
        t.pre_tokenizer = pre_tokenizers.Sequence(splits)
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if m.add_dummy_prefix:
        undo.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(undo)
    t.encode_special_tokens = True
    return t


_LOADED: dict[str, object] = {}


def load(data: bytes):
    """The tokenizer of a model file's bytes, one for each Python worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = build(parse(data))
    return _LOADED[key]


#: Segments whose ids a worker keeps, and characters of one, at most.
KEPT, SHORT = 1 << 18, 48


class Segments:
    """The ids of segments as packed 32-bit numbers, found by the library's model when first met."""

    def __init__(self, tokenizer, m: Model):
        from tokenizers import Tokenizer

        # nothing but the marks: the library's normaliser takes a call a text
        self.marks = m.add_dummy_prefix and m.escape_whitespaces and not m.charsmap and not m.remove_extra_whitespaces
        self.prefix = b" " if m.add_dummy_prefix else b""
        self.bytes = [bytes([int(p[3:-1], 16)]) if kind == BYTE and m.byte_fallback else p.replace(MARK, " ").encode() for p, _, kind in m.pieces]

        self.alone, self.normalizer = Tokenizer(tokenizer.model), tokenizer.normalizer
        self.parts, self.known = re.compile(SEGMENT).findall, {}
        self.older = {}  # those not met since half of KEPT others were

    def ids(self, texts: list[str]) -> list[memoryview]:
        if self.marks:
            texts = [MARK + x.replace(" ", MARK) if x else "" for x in texts]
        elif self.normalizer is not None:
            texts = [self.normalizer.normalize_str(x) if x else "" for x in texts]
        parts = [self.parts(x) for x in texts]
        known = self.known
        new = []
        for s in set().union(*parts) - known.keys():
            if s in self.older:
                known[s] = self.older.pop(s)
            else:
                new.append(s)
        for s, e in zip(new, self.alone.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[s] = array("i", e.ids).tobytes()
        out = [memoryview(b"".join(map(known.__getitem__, x))).cast("i") for x in parts]
        # long ones come once, and a vocabulary without end is not kept
        for s in new:
            if len(s) > SHORT:
                del known[s]
        if len(known) > KEPT // 2:
            self.older, self.known = known, {}
        return out

    def text(self, ids: memoryview | list[int]) -> str | None:
        """The text of ids; None where their bytes are none, which is the library's to mend."""
        try:
            return b"".join(map(self.bytes.__getitem__, ids)).removeprefix(self.prefix).decode()
        except UnicodeDecodeError:
            return None


_SEGMENTS: dict[str, Segments | None] = {}


def segments(data: bytes) -> Segments | None:
    """Those of a BPE model whose texts fall into segments, one for each Python worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _SEGMENTS:
        m = parse(data)
        apart = m.model_type == BPE and not _inner(m) and all(kind != USER_DEFINED for *_, kind in m.pieces)
        _SEGMENTS[key] = Segments(load(data), m) if apart else None
    return _SEGMENTS[key]


#: Texts are handed to the library in batches of about so many bytes.
BATCH_BYTES = 1 << 18


def _encoder(data: bytes, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, kept = load(data), segments(data)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + 4 * len(texts[j] or "") <= 4 * BATCH_BYTES):
                    size += 4 * len(texts[j] or "")
                    j += 1
                part = texts[i:j]
                if kept is not None:
                    ids = kept.ids([x or "" for x in part])
                else:
                    ids = [e.ids if x else [] for x, e in zip(part, t.encode_batch_fast([x or "" for x in part], add_special_tokens=False), strict=True)]
                back = [None] * len(ids) if kept is None else list(map(kept.text, ids))
                left = [k for k, b in enumerate(back) if b is None]
                for k, b in zip(left, t.decode_batch([list(ids[k]) for k in left], skip_special_tokens=False) if left else [], strict=True):
                    back[k] = b
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
                whole = [None if x is None else (b if x else "") for x, b in zip(part, back, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(i, j - i) for c in extra], pa.array(part, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(whole, pa.string())],
                    [*extra, "text", "ids", "decoded"],
                )
                i = j

    return run


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """All other columns of `docs`, ids (array of int) and decoded (the text read back from the ids)."""
    extra = [c for c in docs.columns if c not in ("text", "ids", "decoded")]
    ordered = docs.select(*extra, "text")
    schema = ordered.schema.simpleString()[len("struct<") : -1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema) if schema else ""
    return in_arrow(ordered, _encoder(model, extra), f"{schema}, ids array<int>, decoded string")


def model_bytes(path: str = MODEL_PATH) -> bytes:
    """The model file, read once on the driver (its size is that of a vocabulary)."""
    with open(path, "rb") as f:
        return f.read()


def op5_sentencepiece(spark: SparkSession, sf_dir: str, path: str = MODEL_PATH) -> DataFrame:
    """ids_sha256 is over the ids joined by commas; round_trip: the decoded text is the input."""
    out = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), model_bytes(path))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("ids_sha256"),
        F.length("decoded").cast("long").alias("decoded_chars"),
        F.coalesce(F.col("decoded") == F.col("text"), F.lit(True)).alias("round_trip"),
    )

"""SentencePiece models run by the tokenizers library.

The model file is parsed from its protobuf wire form and rebuilt: the normaliser (its
compiled character map, if any, the dummy prefix and the metaspace marker), a unigram
model from the scores or a byte-pair model whose merges are ordered by the scores, and
byte fallback. Texts are encoded in multithreaded batches of distinct words where no piece
has a marker after another character: nothing joins across the start of a word, and a
text's ids are those of its words. For other models, texts are encoded whole.

Parity: the ids are the rebuilt tokenizer's. Whatever it encodes is also encoded by the
sentencepiece library, and where the two differ the documents that hold the word or are the text
have ``parity`` false; nothing is replaced. Decoding, by the tokenizers library's decoders, gives back the normalised
text; ``round_trip`` says that it equals the input.

Null texts count as empty: no ids, parity and round_trip true. Repeated rows come out once for each row with
equal ids. Texts of any length are taken whole; where they have other spacing than single spaces and newlines,
in one call. An empty table gives an empty result. Other columns pass through
unchanged; ``ids``, ``n_tokens``, ``parity`` and ``round_trip`` replace columns of these names. Null ids decode to null.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sheaf.llm.chunk_encoder import WordEncoder, simple_spacing, split_at

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = varint() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode("utf-8")
                elif k == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif k == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    model.model_type = v
                elif k == 35:
                    model.byte_fallback = bool(v)
                elif k == 40:
                    model.unk_id = v
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    model.charsmap = v
                elif k == 3:
                    model.add_dummy_prefix = bool(v)
                elif k == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif k == 5:
                    model.escape_whitespaces = bool(v)
    return model


def build_tokenizer(model: Model):
    """The model as a tokenizers pipeline: the whole of it, from raw text to ids and back."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unk = next((p for p, _, kind in model.pieces if kind == UNKNOWN), None)
    if model.model_type == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        usable = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
        merges = [(-s, i, p[:k], p[k:]) for i, (p, s, kind) in enumerate(model.pieces) if kind in (NORMAL, USER) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        merges.sort()
        core = models.BPE(vocab, [(a, b) for _, _, a, b in merges], unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_whitespaces else " "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])])
    return tokenizer


class Codec:
    """Encodes and decodes with one model file; kept by the worker from task to task."""

    def __init__(self, path: str):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        with open(path, "rb") as f:
            raw = f.read()
        self.model = model = parse_model(raw)
        self.tokenizer = build_tokenizer(model)
        self.normalizer, self.tokenizer.normalizer = self.tokenizer.normalizer, None  # from here on it sees normalised text
        # A later message of the same field overrides an earlier one: no prefix and no trimming, words are normalised already.
        own = b"\x18\x00\x20\x00\x28\x01"
        self.their_words = sentencepiece.SentencePieceProcessor(model_proto=raw + b"\x1a" + bytes([len(own)]) + own)
        self.theirs = sentencepiece.SentencePieceProcessor(model_proto=raw)
        usable = [p for p, _, kind in model.pieces if kind in (NORMAL, USER)]
        #: Whether words are encoded apart: nothing joins across a marker or a newline, and text is taken as it is.
        self.apart = model.byte_fallback and model.escape_whitespaces and not model.charsmap and not model.remove_extra_whitespaces and not any(MARK in p.lstrip(MARK) or "\n" in p for p in usable)
        self.control = frozenset(i for i, (_, _, kind) in enumerate(model.pieces) if kind == CONTROL)
        self.opening = MARK if model.add_dummy_prefix else ""
        #: Words by what is before them, and whole texts of the last call, on which the two libraries differ.
        self.odd: dict[str, set[str]] = {"": set(), MARK: set()}
        self.odd_texts: set[str] = set()
        newline = next((i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE and p == "<0x0A>"), 0)
        self.encoder = WordEncoder(self._words("", newline), self._words(MARK, newline), self._whole, np.array([newline], "<u4").tobytes(), self._simple, self._words(self.opening, newline))

    def _simple(self, text: str) -> bool:
        return self.apart and MARK not in text and simple_spacing(text)

    def _words(self, prefix: str, newline: int):
        def encode(new: list[str]) -> list[bytes]:
            parts = [new[i : i + 1000] for i in range(0, len(new), 1000)]
            joined = [prefix + f"\n{prefix}".join(p) for p in parts]
            ours = [e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
            theirs = self.their_words.encode([t.replace(MARK, " ") for t in joined], num_threads=1)
            out = []
            for p, a, b in zip(parts, ours, theirs, strict=True):
                split = split_at(a, newline, "<u4")
                if a != b:
                    self.odd[prefix].update(w for w, x, y in zip(p, split, split_at(b, newline, "<u4"), strict=True) if x != y)
                out += split
            return out

        return encode

    def _whole(self, texts: list[str]) -> list[bytes]:
        ours = [e.ids for e in self.tokenizer.encode_batch_fast([self.normalize(t) for t in texts], add_special_tokens=False)]
        theirs = self.theirs.encode(texts, num_threads=1)
        self.odd_texts.update(t for t, a, b in zip(texts, ours, theirs, strict=True) if a != b)
        return [np.array(x, "<u4").tobytes() for x in ours]

    def normalize(self, text: str) -> str:
        if not text:
            return ""
        model = self.model
        if model.charsmap or model.remove_extra_whitespaces:
            out = self.normalizer.normalize_str(text)
            return "" if out == self.opening else out  # of white space only, nothing is left to have a prefix
        return self.opening + (text.replace(" ", MARK) if model.escape_whitespaces else text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The rebuilt tokenizer's ids."""
        self.odd_texts.clear()
        if sum(map(len, self.odd.values())) > 100_000:  # only those that are still stored matter
            for words in self.odd.values():
                words.intersection_update(*[set().union(*(k for s in (self.encoder.opening, self.encoder.first, self.encoder.later) for k in (s.young, s.old)))])
        return [np.frombuffer(x, "<u4") for x in self.encoder.encode(texts)]

    def parity(self, text: str) -> bool:
        """Whether the sentencepiece library has the same ids for a text that was encoded in the last call."""
        if self.odd_texts and text in self.odd_texts:
            return False
        if not any(self.odd.values()) or not text or not self._simple(text):
            return True
        for k, line in enumerate(text.split("\n")):
            first, *later = line.split(" ")
            if first in self.odd["" if k else self.opening] or not self.odd[MARK].isdisjoint(later):
                return False
        return True

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Markers are spaces, byte pieces their bytes (U+FFFD where they are no UTF-8), control pieces nothing."""
        control = self.control
        return self.tokenizer.decode_batch([y if control.isdisjoint(y) else [i for i in y if i not in control] for x in ids for y in (x.tolist(),)], skip_special_tokens=False)


@functools.lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", rows: int = 512) -> DataFrame:
    """Adds ids, n_tokens, parity and round_trip to every row; all stays in its partition."""
    own = ("ids", "n_tokens", "parity", "round_trip")
    kept = [c for c in docs.columns if c not in own]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["ids array<int>", "n_tokens long", "parity boolean", "round_trip boolean"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = [t or "" for t in part.column(text).to_pylist()]
                ids = c.encode(texts)
                lengths = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)
                back = [x == t for x, t in zip(c.decode(ids), texts, strict=True)]
                columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(lengths), pa.array([c.parity(t) for t in texts]), pa.array(back)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + columns, names=kept + list(own))

    return docs.select(*[docs[c] for c in kept]).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of ``ids`` as column ``text``; null ids give null."""
    kept = [c for c in encoded.columns if c != text]
    schema = ", ".join([f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept] + [f"`{text}` string"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = part.column(ids).to_pylist()
                found = iter(c.decode([np.array(x, np.int64) for x in rows if x is not None]))
                out = [None if x is None else next(found) for x in rows]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [pa.array(out, pa.string())], names=kept + [text])

    return encoded.select(*[encoded[c] for c in kept]).mapInArrow(decode, schema)

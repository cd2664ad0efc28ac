"""SentencePiece encoding and decoding on the tokenizers library, from the model's protobuf.

The model file's wire format is read here; its normalizer settings, pieces, scores and byte pieces are rebuilt as a tokenizers
model (unigram: scores; BPE: merges ranked by the scores of what they make) and decoder. Text is normalized, blanks become the metaspace
mark, and where no piece holds a mark after another character, runs of a mark and what follows are encoded on
their own and remembered. Whatever is encoded for the first time in a worker, run or whole text, by whichever model, is also
encoded by the sentencepiece library; where the two differ, the texts that hold it are flagged, and the reference ids stand.
New runs go to the libraries many at once, as one text: no piece spans two of them, so each one's ids begin where a mark does.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenground.llm.common import whole_texts

MARK = "▁"
#: Runs that one Python worker remembers; then it starts afresh.
REMEMBERED = 750_000
#: New runs that are one text to the libraries.
TOGETHER = 1024
#: Threads of the tokenizers library per Python worker.
THREADS = 2
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
_RUN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of one protobuf message: integers of varints, bytes of all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError("not a model file")
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What of a model file encoding and decoding need."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_blanks: bool = True

    @classmethod
    def read(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
                model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.remove_extra_blanks = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return model

    def tokenizer(self):
        """A tokenizers model over normalized, marked text."""
        from tokenizers import Tokenizer, models

        unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        if self.kind == UNIGRAM:
            return Tokenizer(models.Unigram([p[:2] for p in self.pieces], unknown, self.byte_fallback))
        if self.kind != BPE:
            raise ValueError("neither a unigram nor a BPE model")
        vocab = {p[0]: i for i, p in enumerate(self.pieces)}
        usable = {p[0] for p in self.pieces if p[2] in (NORMAL, USER_DEFINED)}
        merges = []
        for piece, _, kind in sorted((p for p in self.pieces if p[2] in (NORMAL, USER_DEFINED)), key=lambda p: -p[1]):
            halves = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
            merges += sorted(halves, key=lambda h: (vocab[h[0]], vocab[h[1]]))
        return Tokenizer(models.BPE(vocab, merges, unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback))


class PieceEncoder:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(THREADS)
        import sentencepiece
        from tokenizers import normalizers

        with open(path, "rb") as file:
            self.model = PieceModel.read(file.read())
        self.tokenizer = self.model.tokenizer()
        self.charsmap = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        self.judge = sentencepiece.SentencePieceProcessor(model_file=path)
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.model.pieces if kind == NORMAL)
        self.known: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}  # runs that aren't decoded to themselves
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces], bool)
        self.differing: set[str] = set()
        self.named = np.array([kind in (UNKNOWN, CONTROL) for _, _, kind in self.model.pieces], bool)
        self.whole, self.part, self.plain = self._decoder(True, True), self._decoder(False, True), self._decoder(False, False)

    def _decoder(self, strip: bool, named: bool):
        """Unknown and control pieces (``named``), marks and byte pieces as text, in one; ``strip``: the dummy prefix's blank goes."""
        from tokenizers import decoders

        told = {UNKNOWN: " ⁇ ", CONTROL: ""} if named else {}
        steps = [decoders.Replace(piece, told[kind]) for piece, _, kind in self.model.pieces if kind in told]
        steps += [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        return decoders.Sequence(steps + [decoders.Strip(" ", 1, 0)] * (strip and self.model.dummy_prefix))

    def marked(self, text: str) -> str:
        """Normalized, blanks as marks, with the dummy prefix; empty stays empty."""
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if self.model.remove_extra_blanks:
            text = re.sub(" {2,}", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def runs(self, text: str) -> list[str]:
        """The parts of a text that are encoded on their own."""
        return self._runs(self.marked(text))

    def _runs(self, marked: str) -> list[str]:
        if not self.splits:
            return [marked] if marked else []
        return _RUN.findall(marked)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Little-endian unsigned 32-bit ids of every text, and whether both libraries agree on all of its runs."""
        return [(ids, agreed) for ids, agreed, _ in self.round_trips(texts)]

    def round_trips(self, texts: list[str]) -> list[tuple[bytes, bool, str]]:
        """encode, and the text that the ids decode to: a run is decoded once, since no character's bytes lie in two runs."""
        marked = [self.marked(t) for t in texts]
        split = [self._runs(m) for m in marked]
        wanted = set().union(*split)
        if len(self.known) + len(wanted) > REMEMBERED or not self.splits:  # whole texts aren't remembered
            self.known.clear()
            self.shown.clear()
            self.differing.clear()
        self._learn([w for w in wanted if w not in self.known])
        get, done = self.known.__getitem__, []
        for text, runs in zip(marked, split, strict=True):
            if self.shown and not self.shown.keys().isdisjoint(runs):
                told = "".join(self.shown[r] if r in self.shown else r.replace(MARK, " ") for r in runs)
            else:
                told = text.replace(MARK, " ")
            bare = told[1:] if self.model.dummy_prefix and told[:1] == " " else told
            done.append((b"".join(map(get, runs)), not (self.differing and self.differing.intersection(runs)), bare))
        return done

    def _learn(self, runs: list[str]) -> None:
        """Encode, judge and decode new runs: those of one mark and what follows together, all others, and where anything differs, one by one."""
        words = [r for r in runs if r[0] == MARK and len(r) > 1 and r[1] != MARK] if self.splits else []
        alone = [r for r in runs if r[0] != MARK or len(r) == 1 or r[1] == MARK] if self.splits else runs
        parts = [words[low : low + TOGETHER] for low in range(0, len(words), TOGETHER)]
        for part, text, ids, judged, told in zip(parts, *self._judged(["".join(p) for p in parts]), strict=True):
            own = np.array(ids, "<u4")
            places = 4 * np.flatnonzero(self.begins[own])
            if ids != judged or told != text.replace(MARK, " ") or len(places) != len(part):
                alone += part
                continue
            data, cuts = own.tobytes(), [*places.tolist(), 4 * len(own)]
            self.known.update((run, data[a:b]) for run, a, b in zip(part, cuts, cuts[1:], strict=False))
        for run, text, ids, judged, told in zip(alone, *self._judged(alone), strict=True):
            # the judge adds the dummy prefix itself; a run that is nothing but that prefix is no text of its own
            if ids != judged and not (self.model.dummy_prefix and run == MARK):
                self.differing.add(run)
                ids = judged
                told = self._decoded([ids])[0]
            self.known[run] = np.array(ids, "<u4").tobytes()
            if told != text.replace(MARK, " "):
                self.shown[run] = told

    def _judged(self, texts: list[str]) -> tuple[list[str], list[list[int]], list[list[int]], list[str]]:
        """Marked texts; the ids of both libraries; what the first one's are decoded to."""
        if not texts:
            return [], [], [], []
        own = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        bare = [(t[1:] if self.model.dummy_prefix and t[0] == MARK else t).replace(MARK, " ") for t in texts]
        return texts, own, self.judge.encode(bare, num_threads=THREADS), self._decoded(own)

    def _decoded(self, ids: list[list[int]]) -> list[str]:
        named = any(self.named[np.array(i, np.int64)].any() for i in ids)
        self.tokenizer.decoder = self.part if named else self.plain  # every replacement passes over all pieces
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def decode(self, texts: list[bytes]) -> list[str]:
        """The texts of little-endian unsigned 32-bit ids; bytes that form no character become U+FFFD."""
        self.tokenizer.decoder = self.whole
        return self.tokenizer.decode_batch([np.frombuffer(ids, "<u4").tolist() for ids in texts], skip_special_tokens=False)


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and file."""
    return PieceEncoder(path)


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_crc32``, ``decoded_sha256``, ``round_trip``, ``parity`` of every row of ``docs``.

    Whole texts are encoded and decoded again. ids_crc32 is over little-endian unsigned 32-bit ids; round_trip: the decoded text is the text;
    parity: the tokenizers model and the sentencepiece library agree on it; ``with_ids`` adds ``ids``, those bytes. NULL texts count as
    empty (no ids); NULL ids and repeated rows stay; an empty table gives an empty table; other columns are not read.
    """
    whole_texts(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean" + ", ids binary" * with_ids

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for text, (ids, agreed, decoded) in zip(texts, coder.round_trips(texts), strict=True):
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text, agreed, ids))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), *[pa.binary()] * with_ids]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)

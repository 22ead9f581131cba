"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here into pieces, scores, types and normaliser settings, and rebuilt: the character map and
white-space rules as a normaliser, the space marker, a unigram model by its scores or a BPE model by merges in the order of
the scores, byte fallback, and the decoder. A text is normalised and cut before each run of markers; where no piece has a
marker behind another character, no piece can cross such a cut, so encoding segment by segment gives the ids of the whole.
(Where one has, texts are encoded whole.) Each distinct segment of a chunk of texts is encoded once, by the backend's model
without the pipeline around it (whose steps are done here), and remembered within a bound: of two generations the older one
is forgotten, but for what is met again.

Parity: the sentencepiece library encodes every whole text too. The ids stay the backend's; parity tells whether all agree.

Null texts are empty; empty texts have no tokens. Rows are kept, also repeated ones; columns beside doc_id and text are
ignored. Decoding gives the normalised text (a literal U+2581 comes back as a space).
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, prepare, utf8

MARK = "▁"
#: Bytes of segments and ids that a worker remembers, besides what two chunks add; beyond half of them a new generation begins.
REMEMBERED = 64 << 20
#: Bytes of texts that are encoded at once.
CHUNK = 2 << 20
#: Tasks fill the cores; threads within one only cost more.
THREADS = 1

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes):
    """(number, value) of a protobuf message's fields: int for varints, bytes for the others."""
    i, n = 0, len(data)

    def varint(i):
        value = shift = 0
        while True:
            value |= (data[i] & 0x7F) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    while i < n:
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = (8, i) if kind == 1 else (4, i) if kind == 5 else varint(i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class Model:
    """What a .model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk_id = UNIGRAM, False, 0
        self.charsmap, self.dummy_prefix, self.collapse, self.escape = b"", True, True, True
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                own = dict(fields(value))
                self.kind, self.byte_fallback, self.unk_id = own.get(3, UNIGRAM), bool(own.get(35, 0)), own.get(40, 0)
                self.suffix = bool(own.get(24, 0))
            elif number == 3:
                own = dict(fields(value))
                self.charsmap, self.dummy_prefix = own.get(2, b""), bool(own.get(3, 1))
                self.collapse, self.escape = bool(own.get(4, 1)), bool(own.get(5, 1))
        if self.kind not in (UNIGRAM, BPE) or getattr(self, "suffix", False) or not self.escape:
            raise ValueError("only unigram and BPE models with a leading space marker can be rebuilt")
        self.splits = not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))

    def merges(self) -> list[tuple[str, str]]:
        """The pairs that make each piece, best score first."""
        score = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER_DEFINED)}
        order = sorted(score, key=lambda p: -score[p])
        return [(p[:i], p[i:]) for p in order for i in range(1, len(p)) if p[:i] in score and p[i:] in score]


class Codec:
    """Encoder and decoder rebuilt from a model file's bytes."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), str(threads > 1).lower()
        from sentencepiece import SentencePieceProcessor
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        self.model = m = Model(data)
        unk = m.pieces[m.unk_id][0]
        if m.kind == BPE:
            core = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, m.merges(), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback)
        self.core, self.tokenizer = core, Tokenizer(core)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.collapse:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.prior = normalizers.Sequence(steps) if steps else None
        self.added = [p for p, _, kind in m.pieces if kind == USER_DEFINED]
        self.tokenizer.add_tokens([AddedToken(p, normalized=False) for p in self.added])
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.bytes = {i for i, (_, _, kind) in enumerate(m.pieces) if kind == BYTE}
        self.pieces = [p for p, _, _ in m.pieces]
        #: Which pieces the decoder may take for bytes.
        self.coded = np.array([kind == BYTE or p.startswith("<0x") for p, _, kind in m.pieces])
        self.library = SentencePieceProcessor(model_proto=data)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if m.splits else re.compile("(?s).+")
        #: What every segment begins with; segments are remembered without it.
        self.lead = MARK if m.dummy_prefix else ""
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.odd: dict[str, tuple[int, bool]] = {}
        self.young = self.held = 0

    def normalised(self, text: str) -> str:
        if self.prior:
            text = self.prior.normalize_str(text)
        text = text.replace(" ", MARK)
        return MARK + text if text and self.model.dummy_prefix else text

    def segments(self, normal: list[str]) -> tuple[list[int], pa.ListArray]:
        """An order of the normalised texts, and in that order their segments, without what all begin with."""
        plain = [bool(self.lead) and self.model.splits and t != "" and MARK + MARK not in t for t in normal]
        order = [k for k, x in enumerate(plain) if x] + [k for k, x in enumerate(plain) if not x]
        n, begin = sum(plain), len(self.lead)
        runs = [[s[begin:] for s in self.cut.findall(normal[k])] for k in order[n:]]
        return order, pa.concat_arrays([pc.split_pattern(pa.array([normal[k][1:] for k in order[:n]], pa.string()), MARK), pa.array(runs, pa.list_(pa.string()))])

    def learn(self, keys: list[str]) -> list[bytes]:
        """Encode segments; of those with byte tokens, or that decoding doesn't give back, remember (byte tokens, given back)."""
        segments = [self.lead + k for k in keys]
        if self.added:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        else:
            ids = [[t.id for t in tokens] for tokens in map(self.core.tokenize, segments)]
        flat, ends = np.fromiter(chain.from_iterable(ids), "<i4"), np.cumsum([0, *map(len, ids)])
        coded = np.diff(np.concatenate([[0], np.cumsum(self.coded[flat])])[ends]).tolist()
        piece = self.pieces.__getitem__
        for key, s, own, some in zip(keys, segments, ids, coded, strict=True):
            # The decoder joins pieces and makes spaces of their markers, but for those that it takes for bytes.
            if some or "".join(map(piece, own)) != s:
                fallback = sum(x in self.bytes for x in own) if len(own) > 1 else 0
                back = self.tokenizer.decode(own, skip_special_tokens=False) == s.replace(MARK, " ")
                if fallback or not back:
                    self.odd[key] = (fallback, back)
        packed = flat.tobytes()
        return [packed[a:b] for a, b in pairwise((4 * ends).tolist())]

    def recall(self, keys: list[str]) -> list[bytes]:
        """The ids of distinct segments; those that the younger generation lacks come to it."""
        if self.young > REMEMBERED // 2:
            self.before, self.known, self.held, self.young = self.known, {}, self.young, 0
            self.odd = {s: told for s, told in self.odd.items() if s in self.before}
        out = list(map(self.known.get, keys))
        fresh = {s: self.before.get(s) for s, x in zip(keys, out, strict=True) if x is None}
        new = [s for s, x in fresh.items() if x is None]
        fresh.update(zip(new, self.learn(new), strict=True))
        self.known.update(fresh)
        size = 100 * len(fresh) + sum(map(sys.getsizeof, fresh)) + sum(map(sys.getsizeof, fresh.values()))
        self.young += size
        self.held += size
        return [fresh[s] if x is None else x for s, x in zip(keys, out, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, int, bool]]:
        """Of each text: ids as little-endian int32, whether they give the normalised text back, byte tokens, and parity."""
        order, cuts = self.segments([self.normalised(t) for t in texts])
        words = cuts.flatten().dictionary_encode()
        keys = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        coded = pa.array(self.recall(keys), pa.large_binary()).take(words.indices)
        ends, tokens = np.frombuffer(coded.buffers()[1], np.int64, len(coded) + 1), coded.buffers()[2] or b""
        told = [(k, *self.odd[s]) for k, s in enumerate(keys) if s in self.odd]
        fallback, lost = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if told:
            at, some, ok = zip(*told, strict=True)
            fallback[list(at)], lost[list(at)] = some, ~np.array(ok)
        codes, cut = words.indices.to_numpy(), cuts.offsets.to_numpy()
        fallback, lost = (np.concatenate([[0], np.cumsum(x[codes])])[cut] for x in (fallback, lost))
        place, ends = np.argsort(order), ends[cut]
        out = []
        for k, text in zip(place.tolist(), texts, strict=True):
            ids = bytes(tokens[int(ends[k]) : int(ends[k + 1])])
            back = bool(lost[k] == lost[k + 1])
            if not back:  # what one segment lacks, another could bring
                own = np.frombuffer(ids, "<i4").tolist()
                back = self.decode([own])[0] == self.expected(text)
            own = self.library.encode(text)
            out.append((ids, back, int(fallback[k + 1] - fallback[k]), struct.pack(f"<{len(own)}i", *own) == ids))
        return out

    def expected(self, text: str) -> str:
        """What decoding must give back."""
        normal = self.normalised(text).replace(MARK, " ")
        return normal[1:] if self.model.dummy_prefix and normal[:1] == " " else normal

    def decode(self, ids: list[list[int]]) -> list[str]:
        texts = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [t[1:] if self.model.dummy_prefix and t[:1] == " " else t for t in texts]


_codecs: dict[str, Codec] = {}


def codec(data: bytes) -> Codec:
    key = hashlib.sha256(data).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(data)
    return _codecs[key]


SCHEMA = "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean, parity boolean"


def encode(documents: DataFrame, model_path: str, *, ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document (doc_id, text): its tokens, tokens by byte fallback, the digest of the ids (little-endian int32),
    whether decoding gives the normalised text back and whether all ids are those of the sentencepiece library. ids: also the
    ids. The model file is read on the driver and sent to the tasks (it is below one MB)."""
    spark = prepare(documents.sparkSession)
    with open(model_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    names = ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip", "parity"] + ["ids"] * ids

    def run(batches):
        own = codec(data.value)
        for batch in batches:
            texts = utf8(batch.column(1))
            rows: list[tuple] = []
            coded_texts: list[bytes] = []
            for a, b in chunks(texts, CHUNK):
                part = [(t or b"").decode() for t in texts[a:b]]
                for coded, back, fallback, same in own.encode(part):
                    rows.append((len(coded) // 4, fallback, hashlib.sha256(coded).hexdigest(), back, same))
                    if ids:
                        coded_texts.append(coded)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            if ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in coded_texts)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded_texts), "<i4"))))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA + ", ids array<int>" * ids)


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids: array of int)."""
    spark = prepare(rows.sparkSession)
    with open(model_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    def run(batches):
        own = codec(data.value)
        for batch in batches:
            texts = own.decode([x or [] for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


TOKENIZERS = os.environ.get("TOKENIZER_FILES", "/opt/tokenizers")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{TOKENIZERS}/piece_bpe_32k.model")

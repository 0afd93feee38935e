"""SentencePiece encoding and decoding of merge-type models (operator 3).

Encoding fills a prefix table: of every prefix of a text, the one token that
its encoding ends with.  An Aho-Corasick automaton gives the pieces that end at
a position; a piece is the right one if it and the last token of the prefix
before it are compatible, that is, if the two joined encode to just these two.
Ids are then recovered backwards from the last prefix.  The time is linear in
the text whatever its words are, so one endless word does no harm.

No piece holds a space mark after another character, and characters outside
every piece never merge, so a text may be cut at such places first; short
cuts are remembered in a dictionary of a fixed size.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .workers import small_batches, tidy

SPACE = "▁"
#: Cuts remembered by a worker, their greatest length, and pairs of tokens remembered.
REMEMBERED, REMEMBERED_CHARS, PAIRS = 200_000, 48, 300_000

#: Types of a piece in the model's file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


class PieceModel:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, data: bytes):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(data)
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not train.byte_fallback or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only merge-type models with byte fallback, without own normalisation, symbols or unused pieces")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.piece = [p.piece for p in model.pieces]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.kind = [p.type for p in model.pieces]
        self.begin, self.end, self.unknown = ({p.piece: i for i, p in enumerate(model.pieces)}[x] for x in (train.bos_piece, train.eos_piece, train.unk_piece))
        self.raw = [b"" if p.type == CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else train.unk_surface.encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.alphabet = set("".join(self.id_of))
        # Pieces that the merges themselves reach; others never come out of an encoding.
        reached = [p for p in self.id_of if len(p) == 1 or self._merged(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in reached:
            self.automaton.add_word(p, (len(p), self.id_of[p]))
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        outside = "\n" not in self.alphabet
        # Cut before a run of space marks, and around line ends where no piece has them.
        self._cut = None if inner else re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if outside else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def _merged(self, text: str) -> list[str]:
        """The merges as defined, for short texts: again and again the best pair, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            options = [(-self.score[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in self.score]
            if not options:
                break
            _, i = min(options)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        """Whether two pieces side by side encode to themselves; the answer is remembered."""
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        a, b = self.piece[left], self.piece[right]
        fits = self._pairs[left << 32 | right] = self._merged(a + b) == [a, b]
        return fits

    def _encode_known(self, text: str) -> list[int]:
        """Ids of a text whose characters all have pieces, by the prefix table."""
        n = len(text)
        last = [-1] * (n + 1)  # of each prefix, the token that it ends with
        size = [0] * (n + 1)
        pairs = self._pairs
        for at, (length, token) in self.automaton.iter(text):  # by ascending end
            end = at + 1
            if last[end] < 0:
                start = end - length
                if start:
                    left = last[start]
                    fits = pairs.get(left << 32 | token)
                    if fits is None:
                        fits = self._compatible(left, token)
                    if not fits:
                        continue
                last[end], size[end] = token, length
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def _encode_cut(self, cut: str) -> tuple[int, ...]:
        found = self._known.get(cut)
        if found is not None:
            return found
        if self.alphabet.issuperset(cut):
            out = tuple(self._encode_known(cut))
        else:
            ids: list[int] = []
            for known, run in itertools.groupby(cut, self.alphabet.__contains__):
                if known:
                    ids += self._encode_known("".join(run))
                else:
                    ids += [self.byte_id[b] for b in "".join(run).encode()]
            out = tuple(ids)
        if len(cut) <= REMEMBERED_CHARS:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[cut] = out
        return out

    def encode(self, text: str) -> array:
        """Ids of a text, with begin and end."""
        ids, known = [self.begin], self._known.get
        if text:
            whole = self.prefix + text.replace(" ", SPACE)
            for cut in self._cut(whole) if self._cut else [whole]:
                ids += known(cut) or self._encode_cut(cut)
        ids.append(self.end)
        return array("I", ids)

    def decode(self, ids) -> str:
        """The text of ids: control pieces are left out, bytes joined, and the mark before the first word removed."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        if self.prefix and first is not None and self.kind[first] == NORMAL and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model_at(path: str, digest: str) -> PieceModel:
    """A worker's model; digest tells that the file is the one that the driver saw."""
    with open(path, "rb") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"{path} is not the model that the driver has")
    return PieceModel(data)


def _encoder(path: str, digest: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path, digest)
        for batch in batches:
            counts, sums, back, lists = [], [], [], []
            for text in batch.column("text"):
                ids = model.encode(text.as_py() or "")
                counts.append(len(ids))
                sums.append(hashlib.sha256(np.frombuffer(ids, np.uint32).astype("<u4", copy=False).tobytes()).hexdigest())
                back.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
                if with_ids:
                    lists.append(ids.tolist())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_rows(docs: DataFrame, model_path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    A null text counts as empty and has the begin and end ids alone.  Ids are
    those of the whole text.  Rows are independent of each other: nulls in
    doc_id and repeated rows pass through, other columns are ignored.  The
    model's file is at ``model_path`` on every machine.
    """
    with open(model_path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(tidy(_encoder(model_path, digest, with_ids)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

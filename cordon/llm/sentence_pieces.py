"""SentencePiece encoding and decoding: Viterbi over a trie of the distinct marked words.

A text becomes one leading mark, with every blank as a mark (U+2581), and is cut before each run of marks into marked words; no piece of the model
runs over such a cut. The distinct words of a batch are sorted, which lays them out as a trie walked depth first: each word keeps the
forward scores of the prefix that it shares with the word before, and only its own rest is scored.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordon.llm.text import with_arrays

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
KEPT_WORDS = 250_000  # words whose pieces a task remembers between batches
BATCH_CHARS = 4_000_000
_WORD = re.compile(MARK + "+[^" + MARK + "]*")


class Pieces:
    """The model's pieces by string, with scores; built once a process from the model file's content."""

    def __init__(self, content: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        self.by_byte = {int(names[i][3:-1], 16): i for i in range(n) if byte[i]}
        self.unknown = model.unk_id()
        plain = [i for i in range(n) if not byte[i] and not special[i]]
        scores = np.array([model.get_score(i) for i in plain])
        low = scores[scores > -1e8].min() if len(scores) else 0.0
        # scores of ranks (0, -1, -2 ...) are brought to the size of log probabilities, with a fixed cost a piece
        scale = max(1.0, -low / 20.0)
        self.score = {names[i]: (max(float(s), low - 1.0) / scale - 10.0, i) for i, s in zip(plain, scores, strict=True)}
        self.longest = max(map(len, self.score), default=1)
        self.fallback = -60.0  # of a character that no piece covers: its bytes
        self.bytes = [b""] * n
        for i in plain:
            self.bytes[i] = names[i].replace(MARK, " ").encode()
        for value, i in self.by_byte.items():
            self.bytes[i] = bytes([value])
        crossing = [p for p in self.score if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces run over a mark: {crossing[:3]}")
        self.endings = {p[k:] for p in self.score for k in range(len(p))}

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Best pieces of each of the sorted distinct ``words``. best[e] is the highest score of the first e
        characters and back[e] where its last piece starts; ties go to the longer last piece. What a word shares
        with the one before is not scored again."""
        score, endings, longest, out = self.score, self.endings, self.longest, []
        best, back, ids = [0.0], [0], [-1]
        before = ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :], ids[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, start, piece = best[end - 1] + self.fallback, end - 1, -1
                for first in range(end - 1, max(0, end - longest) - 1, -1):
                    part = word[first:end]
                    if part not in endings:
                        break
                    hit = score.get(part)
                    if hit is not None and best[first] + hit[0] >= top:
                        top, start, piece = best[first] + hit[0], first, hit[1]
                best.append(top)
                back.append(start)
                ids.append(piece)
            found, end = [], len(word)
            while end:
                if ids[end] >= 0:
                    found.append(ids[end])
                else:
                    found.extend(self._raw(word[back[end] : end])[::-1])
                end = back[end]
            out.append(found[::-1])
            before = word
        return out

    def _raw(self, character: str) -> list[int]:
        return [self.by_byte.get(b, self.unknown) for b in (" " if character == MARK else character).encode()]

    def literal(self) -> list[int]:
        """A mark that the text itself holds, as bytes, so that it comes back as a mark."""
        return [self.by_byte.get(b, self.unknown) for b in MARK.encode()]


_loaded: dict[int, Pieces] = {}
_kept: dict[str, list[int]] = {}


def _pieces(content: bytes) -> Pieces:
    key = hash(content)
    if key not in _loaded:
        _loaded.clear()
        _kept.clear()
        _loaded[key] = Pieces(content)
    return _loaded[key]


def encode_texts(texts: list[str | None], pieces: Pieces) -> pa.Array:
    """list<int32> of the ids of each text; null stays null, an empty text has none."""
    split, starts = [], [0]
    for text in texts:
        if text:
            for k, part in enumerate(text.split(MARK)):  # marks of the text itself stand between the parts
                if k:
                    split.append("")
                marked = part.replace(" ", MARK)
                found = _WORD.findall(MARK + marked if not k else marked)
                head = "" if not k else marked[: len(marked) - sum(map(len, found))]
                if head:
                    split.append(head)
                split.extend(found)
        starts.append(len(split))
    number: dict[str, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in split), np.int64, len(split))
    fresh = sorted(w for w in number if w and w not in _kept)
    if len(_kept) + len(fresh) > KEPT_WORDS:
        _kept.clear()
        fresh = sorted(w for w in number if w)
    _kept.update(zip(fresh, pieces.encode_sorted(fresh), strict=True))
    lists = [_kept[w] if w else pieces.literal() for w in number]
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(size.sum()))
    first = np.concatenate([[0], np.cumsum(size)])
    per = size[at]
    ends = np.concatenate([[0], np.cumsum(per)])
    ids = flat[np.repeat(first[at] - ends[:-1], per) + np.arange(ends[-1])]
    offsets = pa.array(ends[np.array(starts)], pa.int32(), mask=None)
    missing = np.array([t is None for t in texts], bool)
    if missing.any():
        offsets = pa.array(ends[np.array(starts)], pa.int32(), mask=np.append(missing, False))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


def _batches(column: pa.Array):
    """Whole texts, up to BATCH_CHARS together."""
    texts, size = [], 0
    for t in column.to_pylist():
        texts.append(t)
        size += len(t or "")
        if size >= BATCH_CHARS:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def model_bytes(path: str = MODEL) -> bytes:
    return Path(path).read_bytes()  # on the driver; tasks get the content by broadcast


def encode(docs: DataFrame, model: bytes, text: str = "text", out: str = "ids", keep_text: bool = True) -> DataFrame:
    """``docs`` with the piece ids of whole texts in ``out`` (array of int). Null gives null, an empty text no ids; a column named
    ``out`` is replaced; repeated rows are encoded alike; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> list[pa.Array]:
        pieces = _pieces(shared.value)
        made = [encode_texts(texts, pieces) for texts in _batches(column)]
        return [pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int32()))]

    return with_arrays(docs, text, [T.StructField(out, T.ArrayType(T.IntegerType()))], run, keep_text)


def decode(encoded: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``encoded`` with the text of each row's ids in ``out``. Bytes that are no UTF-8 become U+FFFD; null gives null; unknown ids add nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> list[pa.Array]:
        pieces = _pieces(shared.value)
        names = np.array(pieces.bytes, dtype=object)
        size = np.array([len(b) for b in pieces.bytes])
        out = []
        off = column.offsets.to_numpy()
        flat = pc.fill_null(column.values, -1).to_numpy(zero_copy_only=False)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(column)):
            if not valid[i]:
                out.append(None)
                continue
            own = flat[off[i] : off[i + 1]]
            own = own[(own >= 0) & (own < len(size))]
            body = b"".join(names[own])
            out.append((body[1:] if body[:1] == b" " else body).decode("utf-8", "replace"))
        return [pa.array(out, pa.string())]

    return with_arrays(encoded, ids, [T.StructField(out, T.StringType())], run, keep_ids)


def round_trip(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_pieces, ids_hash, n_chars_back and whether decoding gives the text back, for each row of (doc_id, text)."""
    there = encode(docs.select("doc_id", "text"), model)
    back = decode(there, model).withColumn("same", F.col("decoded").eqNullSafe(F.col("text")))
    return back.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.length("decoded").cast("long").alias("n_chars_back"), "same")

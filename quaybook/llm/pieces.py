"""SentencePiece encoding and decoding by a streaming Viterbi pass.

A lattice over the text has an edge for every piece.  For a unigram model the best path has the largest sum of scores.  For a
merge (BPE) model the path is the one all of whose neighbouring pieces are compatible, that is, encode to themselves when put
together; each prefix of a text has exactly one such path, so its last piece is a back pointer, as in Viterbi's method.
Either way only the last ``longest piece`` positions can still be built upon.  Whenever the paths of all of these run through one
boundary, the ids before it are committed and dropped, so memory does not grow with the text.

No piece joins a character to a following word mark, so paths always meet there and the ids of a word never depend on
its neighbours; words repeat, and their ids are remembered.

Defined cases: a null or empty text has no ids; characters outside the vocabulary become byte pieces, or the unknown id
where the model has none; repeated rows are encoded one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaybook.llm.shared import crc32_of_ids, in_small_batches

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class PieceModel:
    """The vocabulary of a model file, and the compatibility of pieces for merge models."""

    def __init__(self, path: str, kind: str = "bpe") -> None:
        from sentencepiece import SentencePieceProcessor

        reader = SentencePieceProcessor(model_file=path)
        self.kind, self.ids, self.scores = kind, {}, {}
        self.bytes: dict[int, int] = {}
        self.unknown = reader.unk_id()
        self.pieces = [reader.id_to_piece(i) for i in range(reader.vocab_size())]
        for i, piece in enumerate(self.pieces):
            if reader.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, reader.get_score(i)
        self.values = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.scores.values(), default=0.0) - 10.0
        #: All ends of pieces: a longer piece can end a text only if its own ends do.
        self.ends = {p[k:] for p in self.ids for k in range(len(p))}
        self.compatible: dict[tuple[str, str], bool] = {}
        self.by_words = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids)

    def merged(self, text: str) -> list[str]:
        """Merge neighbours by score, leftmost of equal ones first, until none can be merged: the definition, for short strings."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.compatible.get(key)
        if found is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            self.compatible[key] = found = self.merged(left + right) == [left, right]
        return found

    def ids_of(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        raw = piece.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown]


class StreamingEncoder:
    """Encodes marked text that comes in parts; :meth:`feed` returns ids as soon as they are certain."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.text = ""
        #: The last piece on the path to each position since the committed boundary; the piece before that boundary leads.
        self.last: list[str | None] = [None]
        #: For a unigram model, the score of each of these paths.
        self.total: list[float] = [0.0]

    def _extend(self) -> None:
        model, text, last, ids, ends = self.model, self.text, self.last, self.model.ids, self.model.ends
        merges, compatible, total, scores = model.kind == "bpe", model.compatible, self.total, model.scores
        for end in range(len(last), len(text) + 1):
            start = end - 1
            piece = chosen = text[start:end]
            best = -np.inf
            while True:
                if piece in ids or start == end - 1:
                    if merges:
                        previous = last[start]
                        if previous is None or (found := compatible.get((previous, piece))) or (found is None and model.fits(previous, piece)):
                            chosen = piece
                            break
                    elif (score := total[start] + scores.get(piece, model.worst)) > best:
                        chosen, best = piece, score
                elif piece not in ends:
                    break
                if not start:
                    break
                start -= 1
                piece = text[start:end]
            last.append(chosen)
            if not merges:
                total.append(best)

    def _commit(self, boundary: int) -> list[int]:
        pieces, at = [], boundary
        while at:
            piece = self.last[at]
            pieces.append(piece)
            at -= len(piece)
        if pieces:
            self.text = self.text[boundary:]
            # the piece that ends at the boundary leads from now on
            self.last = self.last[boundary:]
            self.total = [t - self.total[boundary] for t in self.total[boundary:]]
        of, ids_of = self.model.ids, self.model.ids_of
        out: list[int] = []
        for piece in reversed(pieces):
            found = of.get(piece)
            if found is None:
                out += ids_of(piece)
            else:
                out.append(found)
        return out

    def meeting(self) -> int:
        """The last boundary that the paths of all positions that can still be built upon run through."""
        live = set(range(max(0, len(self.text) - self.model.longest + 1), len(self.text) + 1))
        while len(live) > 1:
            end = max(live)
            live.remove(end)
            live.add(end - len(self.last[end]))
        return live.pop()

    def feed(self, part: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(part), 256):
            self.text += part[at : at + 256]
            self._extend()
            if len(self.text) > 2 * self.model.longest:
                out += self._commit(self.meeting())
        return out

    def finish(self) -> list[int]:
        out = self._commit(len(self.text))
        self.last = [None]
        return out


class _Decoder(dict):
    """Bytes of an id, for fast decoding of many."""

    def __init__(self, model: PieceModel) -> None:
        # a word mark that a text brings itself is read as a space
        super().__init__({i: bytes([model.values[i]]) if i in model.values else p.replace(MARK, " ").encode() for i, p in enumerate(model.pieces)})

    def gives(self, numbers: np.ndarray, text: bytes) -> bool:
        """Whether ids decode to the text: all of their bytes, without the mark put first, are compared."""
        at = -1
        for k in range(0, len(numbers), 1 << 16):
            part = b"".join(map(self.__getitem__, numbers[k : k + (1 << 16)].tolist()))
            if part[1:] != text[: len(part) - 1] if at < 0 else part != text[at : at + len(part)]:
                return False
            at += len(part)
        return max(at, 0) == len(text)


class _Remembered(dict):
    """Ids of a segment as bytes; a bounded number of short segments is remembered."""

    def __init__(self, model: PieceModel, most: int = 1_000_000, length: int = 40) -> None:
        super().__init__()
        self.model, self.most, self.length = model, most, length
        self.decoder = _Decoder(model)

    def __missing__(self, segment: str) -> bytes:
        encoder = StreamingEncoder(self.model)
        numbers = encoder.feed(segment) + encoder.finish()
        ids = array("I", numbers).tobytes()
        if len(segment) <= self.length:
            if len(self) >= self.most:
                self.clear()
            self[segment] = ids
        return ids


_workers: dict[tuple[str, str], _Remembered] = {}


def remembered(path: str, kind: str = "bpe") -> _Remembered:
    if (path, kind) not in _workers:
        _workers[path, kind] = _Remembered(PieceModel(path, kind))
    return _workers[path, kind]


def segments(text: str | None, model: PieceModel) -> list[str]:
    """The marked text, cut where no piece can reach across."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    return _SEGMENT.findall(marked) if model.by_words else [marked]


def encode(text: str | None, known: _Remembered) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return b"".join(map(known.__getitem__, segments(text, known.model)))


def decode(ids: bytes, model: PieceModel) -> str:
    """The text of ids: byte pieces join to characters, word marks become spaces, and the one put first goes."""
    raw = bytearray()
    for i in np.frombuffer(ids, "<u4").tolist():
        value = model.values.get(i)
        if value is None:
            raw += model.pieces[i].encode()
        else:
            raw.append(value)
    return raw.decode("utf-8", "replace").replace(MARK, " ")[1:]


_ENCODED = "doc_id long, key long, ids binary, n_ids long, ids_crc32 long, n_byte_ids long, round_trip boolean"


def encode_documents(docs: DataFrame, path: str, kind: str = "bpe", with_ids: bool = True) -> DataFrame:
    """``doc_id, key, ids, n_ids, ids_crc32, n_byte_ids, round_trip``; ids are binary, little-endian unsigned 32-bit.

    ``round_trip`` tells whether decoding these ids gives the text back, which a text that holds a word mark of its own does not; ``key`` is ``xxhash64(text)``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(path, kind)
        is_byte = np.zeros(len(known.model.pieces), bool)
        is_byte[list(known.model.values)] = True
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids, n, crc, raw, same = [], [], [], [], []
                for cell in batch.column(2):
                    text = cell.as_py()
                    found = encode(text, known)
                    numbers = np.frombuffer(found, "<u4")
                    ids.append(found if with_ids else None)
                    n.append(len(numbers))
                    crc.append(crc32_of_ids(found))
                    raw.append(int(np.count_nonzero(is_byte[numbers])))
                    same.append(known.decoder.gives(numbers, (text or "").encode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(ids, pa.binary()),
                        pa.array(n, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array(raw, pa.int64()),
                        pa.array(same, pa.bool_()),
                    ],
                    names=["doc_id", "key", "ids", "n_ids", "ids_crc32", "n_byte_ids", "round_trip"],
                )

    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _ENCODED)


def decode_documents(encoded: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = remembered(path, kind).model
        for batch in batches:
            texts = [decode(x, model) if (x := cell.as_py()) else "" for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")

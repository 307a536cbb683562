"""SentencePiece encoding and decoding with a merge-type (BPE) model, by a table over the prefixes of the text.

A sequence of pieces is what the merges give if and only if each pair of neighbours is; so every prefix of a text has
one last piece, found by looking at the pieces that end there (an Aho-Corasick automaton lists them) for the one that
fits the last piece of the prefix before it. The ids are then read backwards from the end of the text.

Words are encoded once per task and remembered in a table of at most CACHE entries: no piece holds a space after
another character, so a text can be cut before its spaces.

Edge cases: a null text is an empty one, which has the begin and end ids only; a character outside the vocabulary
becomes its UTF-8 bytes; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.blocks import SMALL_SLICE_BYTES, slices
from braidwork.session import small_batches

SPACE = "▁"
CACHE = 250_000
_LONG = 80
_NEVER = 1 << 60


class PieceTable:
    """Pieces of a merge-type model with the split that its merges give each of them."""

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        order = sorted(plain, key=lambda i: (-lib.get_score(i), i))
        self.rank = {names[i]: r for r, i in enumerate(order)}
        self.id = {names[i]: i for i in plain}
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.utf8 = [b""] * n
        for i in plain:
            self.utf8[i] = names[i].replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.utf8[i] = bytes([b])
        self.split: dict[str, tuple[str, str] | None] = {}
        matcher = ahocorasick.Automaton()
        for piece in self.rank:
            if (parts := self._merged(piece)) is not None:
                self.split[piece] = parts or None
                matcher.add_word(piece, (self.id[piece], len(piece)))
        matcher.make_automaton()
        self.matcher = matcher
        self.length = {self.id[p]: len(p) for p in self.split}
        self.name = {self.id[p]: p for p in self.split}
        self.known = {p for p in self.split if len(p) == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.split):
            raise ValueError("a piece holds a space after another character, so texts can't be cut before spaces")
        apart = "" if any("\n" in p for p in self.split) else "\n"
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + ("|\n" if apart else ""))
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Best-ranked merge first, leftmost of equals: the definition, used for single pieces and in tests."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank.get(parts[k] + parts[k + 1], _NEVER), k) for k in range(len(parts) - 1)), default=(_NEVER, 0))
            if best[0] == _NEVER:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _merged(self, piece: str) -> tuple[str, str] | tuple[()] | None:
        """The last merge that makes the piece, () for a character, None if the merges never make it."""
        if len(piece) == 1:
            return ()
        parts = list(piece)
        while len(parts) > 2:
            best = min((self.rank.get(parts[k] + parts[k + 1], _NEVER), k) for k in range(len(parts) - 1))
            if best[0] == _NEVER:
                return None
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def fit(self, left: str, right: str) -> bool:
        """Whether the merges of left + right stop at these two pieces.

        The merges of both are undone, the latest first; between them the inner neighbours must never have had a
        merge that comes before the one that consumes either (from the left, equal ranks come first).
        """
        rank, split = self.rank, self.split
        until_left = until_right = _NEVER
        while True:
            r = rank.get(left + right, _NEVER)
            if r < until_left and r <= until_right and r != _NEVER:
                return False
            a, b = split[left], split[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and rank[left] > rank[right]):
                until_left, left = rank[left], a[1]
            else:
                until_right, right = rank[right], b[0]

    def _known_ids(self, text: str) -> list[int]:
        last = [-1] * len(text)
        fits = self.fits
        seen = fits.get
        for end, (piece, n) in self.matcher.iter(text):
            if last[end] >= 0:
                continue
            if n > end:
                last[end] = piece
                continue
            before = last[end - n]
            ok = seen(before << 20 | piece)
            if ok is None:
                if len(fits) > 2 * CACHE:
                    fits.clear()
                ok = fits[before << 20 | piece] = self.fit(self.name[before], self.name[piece])
            if ok:
                last[end] = piece
        out, at = [], len(text) - 1
        while at >= 0:
            piece = last[at]
            out.append(piece)
            at -= self.length[piece]
        out.reverse()
        return out

    def chunk_ids(self, text: str) -> list[int]:
        """Ids of a text without cuts; characters outside the vocabulary stand alone as bytes."""
        if self.known.issuperset(text):
            return self._known_ids(text)
        out, run = [], []
        for c in [*text, ""]:
            if c and c in self.known:
                run.append(c)
                continue
            out += self._known_ids("".join(run)) if run else []
            run = []
            out += [self.byte[b] for b in c.encode()]
        return out

    def packed(self, chunk: str) -> bytes:
        found = self.cache.get(chunk)
        if found is None:
            found = array("I", self.chunk_ids(chunk)).tobytes()
            if len(chunk) <= _LONG:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids with begin and end as little-endian unsigned 32-bit integers."""
        chunks = self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []
        get, packed = self.cache.get, self.packed
        return b"".join([array("I", [self.begin]).tobytes(), *[get(c) or packed(c) for c in chunks], array("I", [self.end]).tobytes()])

    def decode(self, ids: array) -> bytes:
        """UTF-8 of the text: the pieces joined, without the space that encoding puts first."""
        out = b"".join(map(self.utf8.__getitem__, ids))
        return out[1:] if out[:1] == b" " else out


@lru_cache(2)
def table_of(model: bytes) -> PieceTable:
    return PieceTable(model)


def encode_pieces(docs: DataFrame, model: bytes, keep_ids: bool = False) -> DataFrame:
    """docs: (doc_id, text). Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    model: the bytes of the model file, sent to the tasks once by broadcast (its size is fixed by the vocabulary).
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(sent.value)
        for batch in slices(batches, limit=SMALL_SLICE_BYTES):
            counts, id_hashes, text_hashes, ids_out, texts = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = table.encode(text or "")
                numbers = array("I")
                numbers.frombytes(ids)
                decoded = table.decode(numbers)
                counts.append(len(numbers))
                id_hashes.append(hashlib.sha256(ids).hexdigest())
                text_hashes.append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    ids_out.append(list(numbers))
                    texts.append(decoded.decode("utf-8", "replace"))
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encoded, schema)

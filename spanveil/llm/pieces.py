"""SentencePiece encoding and decoding of whole texts by backtracking, for models of the merge type.

A text's pieces are those in which every two neighbours are compatible: merged again from
their characters, the two come out as themselves. They are looked for from the left. At each
place the longest piece is tried (Aho-Corasick gives the longest match at every place), then
its shorter beginnings; where none is compatible with the piece before, that piece is taken
back and its place marked as failed in a bitfield, so that no place is left twice for naught.

No piece joins two characters that stand side by side in no piece, so a text is first cut
there; what lies between such cuts is encoded once for each distinct string and kept by its
64-bit hash (two of 10 million strings collide with a chance of 3 in a million). A character
that no piece has is encoded as its UTF-8 bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BASE, mix, prefix_hash, slices, span_hash, table

#: Fixed values of the format: the space's sign, the types of pieces.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The most strings, and checked pairs of pieces, that a worker keeps before it starts anew.
MOST_STRINGS, MOST_PAIRS = 1_000_000, 500_000
#: Characters below this have their pairs in a square table.
SQUARE = 1024


class Model:
    """Pieces of a model file and their merges."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        form = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            form.ParseFromString(f.read())
        trainer, normal = form.trainer_spec, form.normalizer_spec
        plain = normal.name == "identity" and not normal.precompiled_charsmap and normal.escape_whitespaces and not normal.remove_extra_whitespaces and not trainer.treat_whitespace_as_suffix
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or not plain or any(p.type in (USER_DEFINED, UNUSED) for p in form.pieces):
            raise ValueError("the model must be of the merge type, with bytes for unknown characters, no normalisation and no user-defined or unused pieces")
        self.begins_with_space = normal.add_dummy_prefix
        self.text = [p.piece for p in form.pieces]
        self.ids = {p.piece: i for i, p in enumerate(form.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in form.pieces if p.type == NORMAL}
        self.shorter: dict[int, int] = {}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(form.pieces) if p.type == BYTE}
        self.known = {c for s in self.ids for c in s}
        #: What each id stands for in a text, as bytes; control pieces stand for nothing.
        self.bytes = [b"" if p.type == CONTROL else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else (trainer.unk_surface if p.type == UNKNOWN else p.piece.replace(SPACE, " ")).encode() for p in form.pieces]
        self._machine = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self._machine.add_word(s, (i, len(s)))
        self._machine.make_automaton()
        self._alone: dict[int, bool] = {}
        self._beside: dict[int, bool] = {}

    def merged(self, s: str) -> list[int]:
        """Ids of a short string by its merges: the best score first, the leftmost of equal ones."""
        parts, score, none = list(s), self.score.get, float("-inf")
        found = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while found and (best := max(found)) > none:
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(found):
                found[at] = score(parts[at] + parts[at + 1], none)
        return [self.ids[p] for p in parts]

    def alone(self, i: int) -> bool:
        """Whether a piece's characters merge to the piece itself."""
        got = self._alone.get(i)
        if got is None:
            got = self._alone[i] = self.merged(self.text[i]) == [i]
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether two neighbours, merged again from their characters, stay as they are."""
        got = self._beside.get(a << 20 | b)
        if got is None:
            if len(self._beside) > MOST_PAIRS:
                self._beside.clear()
            got = self._beside[a << 20 | b] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return got

    def encode(self, s: str) -> list[int]:
        """Ids of a string of known characters, or of one unknown character."""
        n = len(s)
        if s in self.ids and self.alone(self.ids[s]):
            return [self.ids[s]]
        if n == 1:
            return [self.byte[b] for b in s.encode()] if s not in self.ids else [self.ids[s]]
        longest = [-1] * n
        for end, (i, size) in self._machine.iter(s):
            longest[end - size + 1] = i  # ends ascend, so the last is the longest
        failed, out, starts, at = bytearray(n // 8 + 1), [], [], 0
        text, shorter, beside = self.text, self._shorter, self._beside
        i, last = longest[0], -1
        while True:
            while i >= 0:
                end = at + len(text[i])
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = beside.get(last << 20 | i) if out else self.alone(i)
                    if fits or fits is None and self.compatible(last, i):
                        break
                i = shorter(i)
            if i >= 0:
                out.append(i)
                if end == n:
                    return out
                starts.append(at)
                at, last, i = end, i, longest[end]
            elif out:
                failed[at >> 3] |= 1 << (at & 7)
                i, at = shorter(out.pop()), starts.pop()
                last = out[-1] if out else -1
            else:  # no sequence of compatible neighbours: scores are tied in a way that merges alone decide
                return self.merged(s)

    def _shorter(self, i: int) -> int:
        """The longest piece that is a proper beginning of a piece; -1 for none."""
        got = self.shorter.get(i)
        if got is None:
            s = self.text[i]
            got = self.shorter[i] = next((self.ids[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.ids), -1)
        return got


def _code(chars) -> np.ndarray:
    return mix(np.asarray(chars, dtype=np.uint64) * BASE + np.uint64(1))


class Codec:
    """Ids of batches of texts, and texts of ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = Model(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.special = np.array([self.library.is_control(i) or self.library.is_unknown(i) for i in range(len(self.model.text))])
        pairs = {(ord(a), ord(b)) for s in self.model.ids for a, b in zip(s, s[1:], strict=False)}
        self.square = np.zeros((SQUARE, SQUARE), dtype=bool)
        for a, b in pairs:
            if a < SQUARE and b < SQUARE:
                self.square[a, b] = True
        self.pairs = np.array(sorted(a << 21 | b for a, b in pairs if a >= SQUARE or b >= SQUARE) or [-1], dtype=np.int64)
        self.codes = _code(np.arange(SQUARE))
        size = np.array([len(b) for b in self.model.bytes], dtype=np.int64)
        self.byte_size, self.byte_start = size, np.cumsum(size) - size
        self.byte_pool = np.frombuffer(b"".join(self.model.bytes), dtype=np.uint8)
        digits = [f",{i}".encode() for i in range(len(size))]
        self.digit_size = np.array([len(d) for d in digits], dtype=np.int64)
        self.digit_start = np.cumsum(self.digit_size) - self.digit_size
        self.digit_pool = np.frombuffer(b"".join(digits), dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.offsets, self.ids = np.zeros(1, np.int64), np.empty(0, np.int32)

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether any piece has the two characters side by side."""
        low = (a < SQUARE) & (b < SQUARE)
        out = self.square[np.where(low, a, 0), np.where(low, b, 0)] & low
        high = np.flatnonzero(~low)
        if len(high):
            key = a[high].astype(np.int64) << 21 | b[high].astype(np.int64)
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            out[high] = self.pairs[at] == key
        return out

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty texts end to end, and where each text's ids end."""
        before = SPACE if self.model.begins_with_space else ""
        texts = [before + t.replace(" ", SPACE) for t in texts]
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        cut = np.empty(len(codes), dtype=bool)
        cut[0] = True
        np.logical_not(self.joins(codes[:-1], codes[1:]), out=cut[1:])
        cut[ends[:-1]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(codes))
        low = codes < SQUARE
        signs = self.codes[np.where(low, codes, 0)]
        signs[~low] = _code(codes[~low])
        known, where, back = np.unique(span_hash(prefix_hash(signs), start, end), return_index=True, return_inverse=True)
        place = self._find(known)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            place[missing] = self._learn(known[missing], [joined[a:b] for a, b in zip(start[where[missing]].tolist(), end[where[missing]].tolist(), strict=True)])
        place = place[back]
        size = self.offsets[place + 1] - self.offsets[place]
        sums = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.offsets[place] - sums[:-1], size) + np.arange(sums[-1])]
        return ids, sums[np.searchsorted(start, ends)]

    def _find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.place[at], -1)

    def _learn(self, h: np.ndarray, strings: list[str]) -> np.ndarray:
        got = [self.model.encode(s) for s in strings]
        first = len(self.offsets) - 1
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate((self.ids, np.array([i for ids in got for i in ids], dtype=np.int32)))
        new = np.arange(first, first + len(h))
        at = np.searchsorted(self.keys, h)  # h ascends
        self.keys, self.place = np.insert(self.keys, at, h), np.insert(self.place, at, new)
        return new

    def encode(self, texts: list[str], most: int = 1_000_000) -> list[np.ndarray]:
        """Ids of each text as the library gives them, without begin or end ids; an empty text has none."""
        out = [np.empty(0, np.int32)] * len(texts)
        run, size = [], 0
        for k, t in enumerate(texts):
            if not t:
                continue
            run.append(k)
            size += len(t)
            if size >= most:
                self._put(out, texts, run)
                run, size = [], 0
        if run:
            self._put(out, texts, run)
        return out

    def _put(self, out: list, texts: list[str], run: list[int]) -> None:
        if len(self.offsets) > MOST_STRINGS:
            self.forget()
        ids, ends = self._run([texts[k] for k in run])
        first = 0
        for k, e in zip(run, ends.tolist(), strict=True):
            out[k] = ids[first:e]
            first = e

    def _gather(self, ids: np.ndarray, pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
        n = size[ids]
        sums = np.cumsum(n)
        return pool[np.repeat(start[ids] - (sums - n), n) + np.arange(int(sums[-1]) if len(sums) else 0)].tobytes()

    def token_sizes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes that each id stands for."""
        return self.byte_size[ids]

    def joined(self, ids: np.ndarray) -> bytes:
        """Bytes of all ids, the first piece's space included."""
        return self._gather(ids, self.byte_pool, self.byte_start, self.byte_size)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids as the library gives it; control ids, unknown ones and bytes that are not UTF-8 are left to the library."""
        if not len(ids):
            return ""
        if not self.special[ids].any():
            body = self.joined(ids)
            if self.model.begins_with_space and self.model.text[ids[0]].startswith(SPACE):
                body = body[1:]
            try:
                return body.decode()
            except UnicodeDecodeError:
                pass
        return self.library.decode(ids.tolist())

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self._gather(ids, self.digit_pool, self.digit_start, self.digit_size)[1:]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a model file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _mapped(docs: DataFrame, text: str, model: str | None, make, fields: dict[str, str]) -> DataFrame:
    """docs with further columns (replaced where docs has them) that make(codec, values) works out for the values of one."""
    import public_tokenizers

    path = model or public_tokenizers.path("piece_bpe_32k.model")
    docs = docs.drop(*fields)
    names = docs.columns
    at = names.index(text)
    schema = ", ".join(f"{f} {t}" for f, t in fields.items())
    out = docs.schema
    for f in docs.sparkSession.createDataFrame([], schema).schema.fields:
        out = type(out)([*out.fields, f])

    def work(batches):
        c = codec(path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, *make(c, b.column(at).to_pylist())], [*names, *fields])

    return docs.mapInArrow(work, out)


def encode_pieces(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """docs with ``ids`` (array of int): the text's piece ids, without begin or end ids.

    A null or empty text has no ids. Texts of any length are encoded whole; what two equal
    texts get is equal, repeated rows each get theirs, and an empty docs gives no rows. A
    column of docs named ids is replaced, all others stay.
    """
    return _mapped(docs, text, model, lambda c, texts: [pa.array(c.encode([t or "" for t in texts]), pa.list_(pa.int32()))], {"ids": "array<int>"})


def decode_pieces(docs: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """docs with ``decoded`` (string): the text that the ids stand for; null or no ids give an empty text."""
    return _mapped(docs, ids, model, lambda c, rows: [pa.array([c.decode(np.array(r or [], dtype=np.int64)) for r in rows], pa.string())], {"decoded": "string"})


def piece_digests(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """docs with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, encoded and decoded where the rows lie.

    As encode_pieces and decode_pieces one after the other, without sending the ids between them.
    """

    def make(c: Codec, texts):
        rows = c.encode([t or "" for t in texts])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [pa.array([len(r) for r in rows], pa.int64()), pa.array([sha(c.decimal(r)) for r in rows]), pa.array([sha(c.decode(r).encode()) for r in rows])]

    return _mapped(docs, text, model, make, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})


def op13_sentencepiece(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    """Piece ids of all documents and the texts decoded from them, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_digests(docs, model=model).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

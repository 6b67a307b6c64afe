"""SentencePiece BPE encoding and decoding with a prefix table.

Whole texts stay in their partition; no shuffle. A text is cut into units where no piece can cross: at
the start of each run of word marks, and around characters that the vocabulary lacks. For every prefix of
a unit the table holds the unique last token of that prefix's encoding: an Aho-Corasick automaton names
the pieces that end there, and the one that is compatible with the last token of what precedes it is
right. The ids are then read backwards from the table's end.

Two tokens are compatible if merging their characters side by side never merges across their boundary.
That is decided from each token's own merge history, recorded once: the histories advance in rank order,
and a merge across the boundary that comes first refutes the pair.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import packed, slices, text_of, unpacked

MARK = "▁"
NEVER = 1 << 60
#: Most units that a worker keeps the ids of, and most pairs of tokens: about 200 bytes each, so 52 MB a table. A
#: full table is emptied.
CACHE = 1 << 18
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 20
#: What normalisation must leave as it is, but for the first mark and marks for spaces.
PROBES = ("a", "  a  b ", "\ufb01\u2460\u00a0\u3000x", "e\u0301 \u00e9", "A\tb\nc")


class Codec:
    """Tables of one vocabulary of BPE pieces with byte fallback, identity normalisation and dummy prefix."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if any(sp.normalize(x) != MARK + x.replace(" ", MARK) for x in PROBES):
            raise ValueError("the model normalises texts: only identity normalisation with a dummy prefix is built")
        if sp.piece_to_id("<0x00>") == sp.unk_id():
            raise ValueError("the model has no byte pieces")
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        self.rank = {sp.id_to_piece(i): r for r, i in enumerate(order)}
        self.text = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.text |= {i: b"" for i in range(sp.get_piece_size()) if sp.is_control(i)} | {sp.unk_id(): " \u2047 ".encode()}
        self.history: dict[str, list[tuple[int, str, str]]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if (h := self.merges(p)) is not None:
                self.history[p] = h
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses a word mark: texts can't be cut there")
        self.bare_lines = not any("\n" in p for p in self.ids)
        self.fits: dict[tuple[str, str], bool] = {}
        self.cached: dict[str, bytes] = {}

    def merges(self, piece: str) -> list[tuple[int, str, str]] | None:
        """(rank, first part, last part) after each merge of the piece's own characters; None if they don't make the piece."""
        parts, done = list(piece), []
        while len(parts) > 1:
            r, k = min((self.rank.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
            if r == NEVER:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            done.append((r, parts[0], parts[-1]))
        return done

    def compatible(self, a: str, b: str) -> bool:
        if (known := self.fits.get((a, b))) is not None:
            return known
        left, right = self.history.get(a, []), self.history.get(b, [])
        i = j = 0
        x, y = a[-1], b[0]
        while True:
            across = self.rank.get(x + y, NEVER)
            ra = left[i][0] if i < len(left) else NEVER
            rb = right[j][0] if j < len(right) else NEVER
            if across < ra and across <= rb:  # of equal ranks the leftmost merges first
                ok = False
                break
            if ra == rb == NEVER:
                ok = True
                break
            if ra <= rb:
                x = left[i][2]
                i += 1
            else:
                y = right[j][1]
                j += 1
        if len(self.fits) >= CACHE:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def tokens(self, unit: str) -> list[str]:
        """Pieces of a unit; a character outside the vocabulary is a piece of its own."""
        if unit in self.history:
            return [unit]
        n = len(unit)
        last: list[str | None] = [None] * (n + 1)
        fits = self.fits
        for end, piece in self.automaton.iter(unit):
            end += 1
            if last[end] is None:
                start = end - len(piece)
                if not start:
                    last[end] = piece
                else:  # where no piece ends, a character outside the vocabulary does
                    before = last[start] or unit[start - 1]
                    ok = fits.get((before, piece))
                    if ok or ok is None and self.compatible(before, piece):
                        last[end] = piece
        out = []
        while n:
            piece = last[n] or unit[n - 1]
            out.append(piece)
            n -= len(piece)
        return out[::-1]

    def unit(self, unit: str) -> bytes:
        """Ids as little-endian 32-bit words."""
        ids: list[int] = []
        for piece in self.tokens(unit):
            if (i := self.ids.get(piece)) is not None:
                ids.append(i)
            else:
                ids.extend([self.bytes[b] for b in piece.encode()])
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) <= 64:
            if len(self.cached) >= CACHE:
                self.cached.clear()
            self.cached[unit] = got
        return got

    def units(self, text: str) -> list[str]:
        """The normalised text cut before each run of marks, and around line ends if the vocabulary lacks them."""
        if self.bare_lines and text[0] != " " and "  " not in text and MARK not in text:
            out = (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")
            return [u for u in out if u] if "" in out else out
        lines = text.split("\n") if self.bare_lines else [text]
        out: list[str] = []
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
            words = (line if k else " " + line).replace(" ", MARK).split(MARK)
            if words[0]:
                out.append(words[0])
            run = MARK
            for word in words[1:]:
                if word:
                    out.append(run + word)
                    run = MARK
                else:
                    run += MARK
            if run != MARK:
                out.append(run[1:])
        return out

    def encode(self, text: str) -> bytes:
        """Ids with begin and end as little-endian 32-bit words."""
        units = self.units(text) if text else []
        got = list(map(self.cached.get, units))
        if None in got:
            got = [self.unit(u) if x is None else x for u, x in zip(units, got, strict=True)]
        return b"".join([struct.pack("<I", self.bos), *got, struct.pack("<I", self.eos)])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of any ids: control ids vanish, the first piece loses its mark, bytes join to characters."""
        parts = [self.text[i] for i in ids]
        text = b"".join(parts).decode("utf-8", "replace")
        first = next((p for p in parts if p), b"")
        return text[1:] if first.startswith(b" ") else text


_codecs: dict[int, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """One codec per worker process and model."""
    if (key := hash(model)) not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with ids (binary, little-endian unsigned 32-bit, begin and end included), n_tokens and decoded.

    Null text counts as empty: begin and end only. Each row is handled for itself, so repeated rows, extra
    columns and empty tables pass through. model_path is read on the driver; the vocabulary (under 1 MB)
    is broadcast.
    """
    ship_package(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    base = packed(docs).withColumn("t", text_of("row.text"))
    schema = base.select("row", F.lit(b"").alias("ids"), F.lit("").alias("decoded")).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for part in slices(batches, 1, SLICE_BYTES):
            ids = [codec.encode(t) for t in part.column(1).to_pylist()]
            texts = [codec.decode(array("I", x)) for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["row", "ids", "decoded"])

    out = base.mapInArrow(encode, schema)
    return unpacked(out, docs.columns, {"ids": F.col("ids"), "n_tokens": (F.octet_length("ids") / 4).cast("long"), "decoded": F.col("decoded")})

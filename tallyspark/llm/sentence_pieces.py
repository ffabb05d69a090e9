"""SentencePiece encoding and decoding with merge-type vocabularies.

A text is normalized as the model says and cut before runs of the space mark, which no piece of the vocabulary holds
after another character.  Within a part the characters are symbols linked to their neighbours; an agenda holds the
adjacent pairs whose joint string is a piece, best score first and leftmost first among equal scores.  Taking a pair
joins its symbols and offers the two new neighbouring pairs; entries whose symbols have changed since are passed over.
The agenda of a long part is a heap.  Those of many short parts are the rows of a table, in the order of the text: each
round takes the first of the best entries of every row.
Symbols that are no piece become byte pieces, or the unknown piece where the vocabulary has no bytes.

Each Arrow batch is then encoded and decoded by the sentencepiece library too, and ``agrees`` says of each row whether
ids and text are the same.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.bpe import _blocks

SPACE = "▁"
#: Piece kinds of the model's format.
UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 2, 3, 4, 5, 6
#: Parts whose ids a task keeps, and the longest that are kept.
KEPT, KEPT_LENGTH = 450_000, 64
#: Parts up to this length share a table of agendas, so many at a time; NONE: a pair that is no piece.
SHORT, TABLE, NONE = 24, 4096, (1 << 31) - 1


PACKED = np.dtype("<u4")


def pack(ids) -> bytes:
    return np.asarray(ids, PACKED).tobytes()


@dataclass
class Pieces:
    """``rank``: the place of a piece's score, the best first (equal scores share one); ``ids``: of pieces."""

    rank: dict[str, int]
    ids: dict[str, int]
    byte_ids: list[int] | None
    unknown: int
    begin: int
    end: int
    frozen: list[str]  #: user-defined pieces, which stand in a text as they are
    cuts: bool  #: no piece holds the space mark after another character
    surface: list[str | bytes]  #: what an id decodes to; bytes: of a byte piece
    prefix: bool  #: normalization puts a space mark before the text
    stripped: set[int]  #: pieces that begin with the space mark
    characters: np.ndarray  #: id of each character that is a piece, or a byte; else -1
    pairs: np.ndarray  #: two pieces that make one (left << 32 | right), sorted
    ranks: np.ndarray  #: its rank
    made: np.ndarray  #: its id
    known: dict[str, bytes] = field(default_factory=dict)  #: packed ids of parts

    @staticmethod
    def load(model: bytes) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        kinds = [p.type for p in spec.pieces]
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or UNUSED in kinds:
            raise ValueError("a merge-type vocabulary without unused pieces is wanted")
        plain = [(p.piece, i, p.score) for i, p in enumerate(spec.pieces) if p.type in (1, USER_DEFINED)]
        place = {s: r for r, s in enumerate(sorted({s for _, _, s in plain}, reverse=True))}
        surface: list[str | bytes] = [
            "" if p.type == CONTROL else spec.trainer_spec.unk_surface if p.type == UNKNOWN
            else bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ") for p in spec.pieces]
        bytes_of = {s: i for i, s in enumerate(surface) if isinstance(s, bytes)}
        # bytes of ASCII are whole characters wherever they stand
        surface = [s.decode() if isinstance(s, bytes) and s < b"\x80" else s for s in surface]
        frozen = [p.piece for p in spec.pieces if p.type == USER_DEFINED]
        ids = {p: i for p, i, _ in plain}
        characters = np.full(0x110000, -1, np.int32)
        if spec.trainer_spec.byte_fallback:
            characters[:128] = [bytes_of[bytes([b])] for b in range(128)]
        for p, i in ids.items():
            if len(p) == 1:
                characters[ord(p)] = i
        joined = np.array([(ids[p[:k]] << 32 | ids[p[k:]], place[s], i) for p, i, s in plain for k in range(1, len(p))
                           if p[:k] in ids and p[k:] in ids], np.int64).reshape(-1, 3)
        joined = joined[np.argsort(joined[:, 0])]
        return Pieces({p: place[s] for p, _, s in plain}, ids,
                      [bytes_of[bytes([b])] for b in range(256)] if spec.trainer_spec.byte_fallback else None,
                      kinds.index(UNKNOWN), spec.trainer_spec.bos_id, spec.trainer_spec.eos_id,
                      sorted(frozen, key=len, reverse=True),
                      not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in plain), surface,
                      spec.normalizer_spec.add_dummy_prefix, {i for p, i in ids.items() if p[:1] == SPACE}, characters,
                      joined[:, 0].copy(), joined[:, 1].astype(np.int32), joined[:, 2].astype(np.int32))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs of symbols among ``pairs``, and their ranks (NONE: they make no piece)."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return at, np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def short_ids(self, parts: list[str]) -> list[bytes]:
        """Packed ids of short parts of known characters, in rounds over a table of their symbols and agendas."""
        sizes = np.array([len(p) for p in parts])
        sym = np.full((len(parts), int(sizes.max())), -1, np.int32)
        sym[np.arange(sym.shape[1]) < sizes[:, None]] = self.symbols("".join(parts))
        out, row = np.full_like(sym, -1), np.arange(len(parts))
        agenda = self.find(sym[:, :-1].ravel(), sym[:, 1:].ravel())[1].reshape(len(parts), -1)
        while agenda.shape[1]:
            line = np.arange(len(row))
            i = agenda.argmin(axis=1)
            live = agenda[line, i] < NONE
            if not live.all():
                out[row[~live], :sym.shape[1]] = sym[~live]
                sym, agenda, row, i = sym[live], agenda[live], row[live], i[live]
                line = np.arange(len(row))
                if not len(row):
                    break
            new = self.made[self.find(sym[line, i], sym[line, i + 1])[0]]
            columns = np.arange(sym.shape[1] - 1)
            sym = np.take_along_axis(sym, columns + (columns > i[:, None]), axis=1)
            agenda = np.take_along_axis(agenda, columns[:-1] + (columns[:-1] >= i[:, None]), axis=1)
            sym[line, i] = new
            inner, outer = np.flatnonzero(i > 0), np.flatnonzero(i < agenda.shape[1])
            agenda[inner, i[inner] - 1] = self.find(sym[inner, i[inner] - 1], new[inner])[1]
            agenda[outer, i[outer]] = self.find(new[outer], sym[outer, i[outer] + 1])[1]
        out[row, :sym.shape[1]] = sym
        ends, ids = np.cumsum(4 * (out >= 0).sum(axis=1)).tolist(), pack(out[out >= 0])
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def symbols(self, text: str) -> np.ndarray:
        return self.characters[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def merged(self, part: str) -> list[str]:
        """Symbols of a part after all merges, the agenda being a heap."""
        sym, n, rank = list(part), len(part), self.rank.get
        agenda = [(r, i, 2) for i in range(n - 1) if (r := rank(sym[i] + sym[i + 1])) is not None]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = after[i]
            if not sym[i] or j >= n or len(sym[i]) + len(sym[j]) != size:
                continue
            new = sym[i] = sym[i] + sym[j]
            sym[j] = ""
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (r := rank(new + sym[j])) is not None:
                    heapq.heappush(agenda, (r, i, size + len(sym[j])))
            h = before[i]
            if h >= 0 and (r := rank(sym[h] + new)) is not None:
                heapq.heappush(agenda, (r, h, size + len(sym[h])))
        return [s for s in sym if s]

    def part_ids(self, part: str) -> list[int]:
        out = []
        for s in self.merged(part):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def parts(self, text: str) -> list[str]:
        """Parts of a normalized text between which no merge can reach."""
        if not self.cuts:
            return [text] if text else []
        if text[:1] == SPACE and SPACE * 2 not in text and text[-1] != SPACE:
            return [SPACE + p for p in text[1:].split(SPACE)]
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of normalized texts, without begin and end."""
        return [np.frombuffer(ids, PACKED).tolist() for ids in self.packed(texts)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Their little-endian unsigned 32-bit form."""
        cut = [self.parts(t) for t in texts]
        if self.frozen:
            around = re.compile("(" + "|".join(map(re.escape, self.frozen)) + ")")
            cut = [[q for k, piece in enumerate(around.split(t)) for q in ([piece] if k % 2 else self.parts(piece))]
                   for t in texts]
        if len(self.known) > KEPT:
            self.known = {}
        known = self.known
        known.update((p, pack([self.ids[p]])) for p in self.frozen)
        new = sorted(set().union(*cut).difference(known), key=len)
        known.update(self.learn(new))
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        for part in reversed(new):  # the longest are at the end
            if len(part) <= KEPT_LENGTH:
                break
            del known[part]
        if self.byte_ids is None:  # neighbouring unknown symbols are one
            flat = [np.frombuffer(ids, PACKED) for ids in out]
            out = [pack(i[(i != self.unknown) | (np.concatenate([[-1], i[:-1]]) != self.unknown)]) if len(i) else b"" for i in flat]
        return out

    def learn(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Packed ids of different parts, the shortest first."""
        at = 0
        while at < len(parts):
            some = [p for p in parts[at:at + TABLE] if 0 < len(p) <= SHORT]
            if some:
                sizes = np.array([len(p) for p in some])
                strange = np.logical_or.reduceat(self.symbols("".join(some)) < 0, np.cumsum(sizes) - sizes)
                some = [p for p, s in zip(some, strange.tolist(), strict=True) if not s]
            yield from zip(some, self.short_ids(some) if some else [], strict=True)
            rest = set(some)
            yield from ((p, pack(self.part_ids(p))) for p in parts[at:at + TABLE] if p not in rest)
            at += TABLE

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control pieces give none, bytes that are not UTF-8 replacement characters."""
        surface = self.surface
        strings = [surface[i] for i in ids]
        try:
            text = "".join(strings)
        except TypeError:
            text = self._with_bytes(strings)
        first = next((i for i in ids if surface[i]), self.unknown)
        return text[1:] if self.prefix and first in self.stripped else text

    @staticmethod
    def _with_bytes(strings: list[str | bytes]) -> str:
        out, at = [], 0
        while at < len(strings):
            if isinstance(strings[at], str):
                out.append(strings[at])
                at += 1
                continue
            stop = at
            while stop < len(strings) and isinstance(strings[stop], bytes):
                stop += 1
            raw, place = b"".join(strings[at:stop]), 0
            while place < len(raw):  # the library replaces byte by byte
                try:
                    out.append(raw[place:].decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(raw[place:place + e.start].decode() + "�")
                    place += e.start + 1
            at = stop
        return "".join(out)


def sentence_pieces(text: Column, model: bytes, begin: bool = True, end: bool = True, packed: bool = False) -> Column:
    """A struct of ``ids`` (array of int; with ``packed`` their little-endian unsigned 32-bit form), ``decoded`` and
    ``agrees`` for whole texts (null: of an empty one)."""
    holder: list = []
    ids_type = "binary" if packed else "array<int>"

    @F.arrow_udf(f"struct<ids: {ids_type}, decoded: string, agrees: boolean>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        if not holder:
            holder.extend([Pieces.load(model), sentencepiece.SentencePieceProcessor(model_proto=model)])
        pieces, library = holder
        head, tail = pack([pieces.begin] * begin), pack([pieces.end] * end)
        for batch in batches:
            packs, decoded, agrees = [], [], []
            for block in _blocks([t or "" for t in batch.to_pylist()]):
                own = [head + ids + tail for ids in pieces.packed(library.normalize(block))]
                mine = [np.frombuffer(ids, PACKED).tolist() for ids in own]
                back = [pieces.decode(i) for i in mine]
                theirs = library.encode(block, add_bos=begin, add_eos=end, num_threads=1)
                again = library.decode(theirs)
                packs += own if packed else mine
                decoded += back
                agrees += [a == b and c == d for a, b, c, d in zip(mine, theirs, back, again, strict=True)]
            yield pa.StructArray.from_arrays(
                [pa.array(packs, pa.binary() if packed else pa.list_(pa.int32())), pa.array(decoded, pa.string()),
                 pa.array(agrees, pa.bool_())], ["ids", "decoded", "agrees"])

    return coded(text)


def piece_documents(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "pieces",
                    packed: bool = False) -> DataFrame:
    """``docs`` with the struct column ``out`` (a column of that name is replaced): ids with begin and end, the text
    that they decode to, and whether the library gives the same.  A null text counts as empty.  Each row is encoded
    for itself, so repeated ones get equal ids, and an empty table gives an empty one.  The model travels with the
    tasks; ``model_path`` need not be readable on executors."""
    with open(model_path, "rb") as f:
        model = f.read()
    return docs.withColumn(out, sentence_pieces(F.col(text_col), model, packed=packed))

"""Token ids of whole texts with a merge-type SentencePiece vocabulary, and texts from ids.

Encoding: a text starts as its characters. All adjacent pairs whose union is a piece stand on an agenda
ordered by the piece's score, ties from left to right; the best pair is merged, and the merged symbol's
pairs with its neighbours join the agenda; entries whose symbols have changed since are passed over.
Characters without a piece become bytes (or the unknown id, if the vocabulary has no bytes).

Characters fall into groups, those that stand side by side in some piece together; no merge joins two
groups. So a text is cut into parts, each some space marks and characters of one group (letters,
punctuation, single digits ...), and a part has its ids to itself. Parts met lately are kept with their
ids.

Check: with ``check`` each part of an Arrow batch is also encoded and decoded by the sentencepiece
library, and ``agrees`` tells for each row whether ids and text are the same.

A task holds about 2 MB of text (or one longer text) with its ids, and two stores of RECENT parts. A
worker keeps the last vocabulary, nothing else.

Defined cases: a null or empty text has no ids; repeated rows are encoded each; an empty table gives an
empty result. Other columns are not read. Vocabularies of other types, or with pieces that normalise,
trim or are defined by users, are refused.
"""

from __future__ import annotations

import heapq
import re
import sys
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyscope.llm.batches import Recent, parts

#: The mark that stands for a space, and the text of an unknown piece when decoded.
SPACE, UNKNOWN = "▁", " ⁇ "
RECENT = 300_000
#: Parts up to this length are merged side by side with others of their length.
SHORT = 48
_NONE = 1 << 24  # above all ranks; with six bits for a place it fits 32 bits
_SLOTS = (1 << 19) - 1


def _slots(keys: np.ndarray) -> np.ndarray:
    """First slot of each pair in the table of pairs."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) & _SLOTS


class Pieces:
    """A merge-type vocabulary: scores and ids of its pieces, and the library's own processor."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(library.get_piece_size())
        texts = [library.id_to_piece(i) for i in ids]
        special = {i for i in ids if library.is_control(i) or library.is_unknown(i) or library.is_byte(i)}
        self._refuse_others(library)
        self.numbers = {texts[i]: i for i in ids if i not in special}
        self.alone = len(texts)
        order = sorted({-library.get_score(i) for i in ids})
        self.rank = [bisect_left(order, -library.get_score(i)) for i in ids]
        self.union = {
            self.numbers[text[:cut]] << 20 | self.numbers[text[cut:]]: i
            for text, i in self.numbers.items()
            for cut in range(1, len(text))
            if text[:cut] in self.numbers and text[cut:] in self.numbers
        }
        if len(self.union) > _SLOTS // 2:
            raise ValueError("the vocabulary has too many pieces")
        self.slot_keys = np.full(_SLOTS + 1, -1, np.int64)
        self.slot_pieces = np.zeros(_SLOTS + 1, np.int32)
        keys = np.array(list(self.union), np.int64)
        for slot, key, piece in zip(_slots(keys).tolist(), keys.tolist(), self.union.values(), strict=True):
            while self.slot_keys[slot] >= 0:
                slot = (slot + 1) & _SLOTS
            self.slot_keys[slot], self.slot_pieces[slot] = key, piece
        self.slot_ranks = np.array(self.rank, np.int32)[self.slot_pieces]
        self.by_point = np.full(sys.maxunicode + 1, self.alone, np.int32)
        for text, i in self.numbers.items():
            if len(text) == 1:
                self.by_point[ord(text)] = i
        self.bytes = {int(texts[i][3:5], 16): i for i in ids if library.is_byte(i)}
        self.unknown = library.unk_id()
        self.out = [self._decoded(library, i, texts[i]) for i in ids]
        self.out_bytes = np.frombuffer(b"".join(self.out), np.uint8)
        self.out_sizes = np.array([len(own) for own in self.out], np.int64)
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes
        self.is_byte = np.array([library.is_byte(i) for i in ids])
        self.is_control = np.array([library.is_control(i) for i in ids])
        if any(SPACE in text.lstrip(SPACE) for text in self.numbers):
            raise ValueError("a piece holds a space after other characters")
        groups = [f"[{''.join(map(re.escape, group))}]+" for group in _groups(self.numbers)]
        self.parts = re.compile(f"{SPACE}*(?:{'|'.join([*groups, '(?s:.)'])})|{SPACE}+")

    @staticmethod
    def _refuse_others(library) -> None:
        from sentencepiece import sentencepiece_model_pb2 as model

        spec = model.ModelProto.FromString(library.serialized_model_proto())
        kinds, form = model.ModelProto.SentencePiece, spec.normalizer_spec
        if spec.trainer_spec.model_type != model.TrainerSpec.BPE:
            raise ValueError("the vocabulary is not of the merge type")
        if any(piece.type in (kinds.USER_DEFINED, kinds.UNUSED) for piece in spec.pieces):
            raise ValueError("the vocabulary has pieces that are unused or defined by users")
        plain = not form.precompiled_charsmap and form.escape_whitespaces and form.add_dummy_prefix
        if not plain or form.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the vocabulary normalises texts beyond a space at the start")

    @staticmethod
    def _decoded(library, i: int, text: str) -> bytes:
        if library.is_byte(i):
            return bytes([int(text[3:5], 16)])
        if library.is_control(i):
            return b""
        return (UNKNOWN if library.is_unknown(i) else text.replace(SPACE, " ")).encode()

    def merged(self, part: str) -> list[tuple[int, int]]:
        """Place and number of each symbol that ``part`` comes to, by the agenda of adjacent pairs.

        Symbols and merged pairs go by their pieces' numbers, ``self.alone`` is a character without a
        piece. An agenda entry is the piece's place in the order of scores and the left symbol's place
        as one number; it holds while the pair at that place still has this score.
        """
        union, rank, alone = self.union, self.rank, self.alone
        symbols = [self.numbers.get(mark, alone) for mark in part]
        last = len(symbols)
        # the piece that a symbol makes with the next one, or ``alone``
        pair = [union.get(a << 20 | b, alone) for a, b in zip(symbols, symbols[1:], strict=False)]
        pair.append(alone)
        agenda = [rank[piece] << 32 | left for left, piece in enumerate(pair) if piece != alone]
        if not agenda:
            return list(enumerate(symbols))
        heapq.heapify(agenda)
        before, after = list(range(-1, last - 1)), list(range(1, last + 1))
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & 0xFFFFFFFF
            whole = pair[left]
            if whole == alone or rank[whole] != entry >> 32:
                continue
            right = after[left]
            follows = after[right]
            symbols[left], symbols[right], pair[right] = whole, -1, alone
            after[left] = follows
            made = alone
            if follows < last:
                before[follows] = left
                made = union.get(whole << 20 | symbols[follows], alone)
                if made != alone:
                    heapq.heappush(agenda, rank[made] << 32 | left)
            pair[left] = made
            leads = before[left]
            if leads >= 0:
                pair[leads] = made = union.get(symbols[leads] << 20 | whole, alone)
                if made != alone:
                    heapq.heappush(agenda, rank[made] << 32 | leads)
        return [(place, symbol) for place, symbol in enumerate(symbols) if symbol >= 0]

    def part_ids(self, part: str) -> bytes:
        """The ids of ``part`` as 32-bit numbers."""
        ids = array("i")
        for place, symbol in self.merged(part):
            if symbol != self.alone:
                ids.append(symbol)
            elif self.bytes:
                ids.extend(self.bytes[byte] for byte in part[place].encode())
            else:
                ids.append(self.unknown)
        return ids.tobytes()

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and number of the piece of each pair; without one, rank _NONE."""
        key = left.astype(np.int64) << 20 | right
        slot = _slots(key)
        held = self.slot_keys[slot]
        asking = np.flatnonzero((held != key) & (held >= 0))
        flat_slot, flat_key = slot.reshape(-1), key.reshape(-1)
        while len(asking):  # the next slot, as others came first
            flat_slot[asking] = (flat_slot[asking] + 1) & _SLOTS
            held = self.slot_keys[flat_slot[asking]]
            asking = asking[(held != flat_key[asking]) & (held >= 0)]
        found = self.slot_keys[slot] == key
        return np.where(found, self.slot_ranks[slot], _NONE), self.slot_pieces[slot]

    def same_length(self, some: list[str], length: int) -> dict[str, bytes]:
        """The ids of parts of one length: a column each, with its symbols and its agenda side by side.

        A step takes the best entry of every column (the first of the least ones), so all columns that
        are still merging have the same number of symbols.
        """
        points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).reshape(-1, length)
        symbols = self.by_point[np.ascontiguousarray(points.T)]
        ranks, wholes = self._pairs(symbols[:-1], symbols[1:])
        names, out = np.arange(len(some)), {}
        while len(names):
            width = len(symbols)
            # the best entry of each column as one number: its rank, then its place
            best = ((ranks << 6) | np.arange(width - 1, dtype=np.int32)[:, None]).min(axis=0, initial=_NONE << 6)
            ended = best >= _NONE << 6
            if ended.any():
                done = np.ascontiguousarray(symbols[:, ended].T, np.int32)
                lacking = (done == self.alone).any(axis=1).tolist()
                raw, size = done.tobytes(), 4 * width
                for i, (name, lacks) in enumerate(zip(names[ended].tolist(), lacking, strict=True)):
                    out[some[name]] = self.part_ids(some[name]) if lacks else raw[i * size : (i + 1) * size]
                names, best = names[~ended], best[~ended]
                symbols, ranks, wholes = symbols[:, ~ended], ranks[:, ~ended], wholes[:, ~ended]
                if not len(names):
                    break
            at = best & 63
            every = np.arange(len(names))
            whole = wholes[at, every]
            later = np.arange(width - 1)[:, None] > at
            symbols = np.where(later, symbols[1:], symbols[:-1])  # the right one of the merged symbols goes
            later = np.arange(width - 2)[:, None] >= at
            ranks = np.where(later, ranks[1:], ranks[:-1])
            wholes = np.where(later, wholes[1:], wholes[:-1])
            symbols[at, every] = whole
            for beside, mine in ((at - 1, at > 0), (at, at < width - 2)):
                column, place = every[mine], beside[mine]
                ranks[place, column], wholes[place, column] = self._pairs(
                    symbols[place, column], symbols[place + 1, column]
                )
        return out

    def new_ids(self, new: set[str]) -> dict[str, bytes]:
        """The ids of parts: short ones by length together, long ones one by one."""
        by_length, out = defaultdict(list), {}
        for part in new:
            by_length[len(part)].append(part)
        for length, some in by_length.items():
            if length > SHORT:
                out.update((part, self.part_ids(part)) for part in some)
            else:
                out |= self.same_length(some, length)
        return out

    def encode(self, texts: list[str | None], recent: Recent) -> list[np.ndarray]:
        cut = [self.parts.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        ids = recent.of(set(chain.from_iterable(cut)), self.new_ids)
        return [np.frombuffer(b"".join(map(ids.__getitem__, own)), np.int32) for own in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become replacement characters, one each."""
        return self.decode_all([ids])[0]

    def decode_all(self, some: list[np.ndarray]) -> list[str]:
        """The text of each of ``some`` ids, their bytes gathered in one go."""
        flat = np.concatenate([*some, np.empty(0, np.int32)])
        sizes = self.out_sizes[flat]
        ends = np.cumsum(sizes)
        places = np.repeat(self.out_starts[flat] + sizes - ends, sizes)
        places += np.arange(len(places))
        raw = self.out_bytes[places].tobytes()
        stops = np.append(0, ends)[np.cumsum([len(ids) for ids in some], dtype=np.int64)].tolist()
        return [self._text(ids, raw[a:b]) for ids, a, b in zip(some, [0, *stops], stops, strict=False)]

    def _text(self, ids: np.ndarray, raw: bytes) -> str:
        if not len(ids):
            return ""
        try:
            text = "".join(self._mended(ids)) if self.is_control[ids].any() else raw.decode()
        except UnicodeDecodeError:
            text = "".join(self._mended(ids))
        first = next((i for i in ids if not self.is_control[i]), self.unknown)
        ordinary = first != self.unknown and not self.is_byte[first]
        return text[1:] if ordinary and self.out[first][:1] == b" " else text

    def _mended(self, ids: np.ndarray) -> Iterator[str]:
        held = bytearray()
        for i, byte in zip(ids.tolist(), self.is_byte[ids].tolist(), strict=True):
            if byte:
                held += self.out[i]
                continue
            yield from _characters(held)
            held.clear()
            yield self.out[i].decode()
        yield from _characters(held)


def _groups(pieces: Iterable[str]) -> list[list[str]]:
    """Characters that stand side by side in pieces, in groups, the largest first."""
    root: dict[str, str] = {}

    def find(mark: str) -> str:
        while root.setdefault(mark, mark) != mark:
            root[mark] = mark = root[root[mark]]
        return mark

    for piece in pieces:
        inner = piece.lstrip(SPACE)
        for a, b in zip(inner, inner[1:], strict=False):
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for mark in sorted(root):
        groups[find(mark)].append(mark)
    return sorted(groups.values(), key=len, reverse=True)


def _characters(raw: bytearray) -> Iterator[str]:
    at = 0
    while at < len(raw):
        for size in range(1, 5):
            try:
                character = bytes(raw[at : at + size]).decode()
            except UnicodeDecodeError:
                continue
            yield character
            at += size
            break
        else:
            yield "�"
            at += 1


@lru_cache(maxsize=1)
def _loaded(path: str) -> Pieces:
    """The vocabulary, which stays with the worker for its next task: its size does not grow with the texts."""
    return Pieces(path)


def encoded(docs: DataFrame, vocabulary: str, check: bool = True) -> DataFrame:
    """doc_id, ids, decoded (the text of the ids) and, with ``check``, agrees."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, decoded string" + ", agrees boolean" * check

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, recent = _loaded(vocabulary), Recent(RECENT)
        for part in parts(batches):
            texts = part.column("text").to_pylist()
            ids = pieces.encode(texts, recent)
            decoded = pieces.decode_all(ids)
            offsets = np.concatenate(([0], np.cumsum([len(own) for own in ids]))).astype(np.int32)
            flat = np.concatenate([*ids, np.empty(0, np.int32)])
            columns = {
                "doc_id": part.column("doc_id"),
                "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                "decoded": pa.array(decoded, pa.string()),
            }
            if check:
                theirs = pieces.library.encode([text or "" for text in texts], num_threads=1)
                back = pieces.library.decode(theirs, num_threads=1)
                columns["agrees"] = pa.array(
                    [
                        own.tolist() == other and text == again
                        for own, other, text, again in zip(ids, theirs, decoded, back, strict=True)
                    ]
                )
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(run, schema)

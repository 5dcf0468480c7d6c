"""SentencePiece encoding and decoding that keep, for each piece, the bytes of the source that it stands for.

Normalisation takes the longest prefix that the model's compiled character map knows, a character where it knows none,
and records the source byte of every character it writes. Pairs are then merged as the model ranks them, and a piece's
span is what its characters were written from. Text falls into units that no piece crosses (a run of spaces and what
follows up to the next space; a character that no piece joins to another), so that merges are looked up by unit, long
texts go through in portions, and neither needs more memory than its longest unit.

Everything is per row: no exchange, the tasks' work is in proportion to their bytes. The model's bytes are read once, on
the driver, from a path that is a parameter.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table

SPACE = "▁"
#: Types of piece in the model's file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters of normalised text that are split into units at a time.
PORTION = 1 << 20
#: Units remembered by a task: characters in all, and the longest.
REMEMBERED, LONGEST = 6_000_000, 64
#: Units of more characters are merged through a heap.
SHORT = 40
#: Texts of an Arrow batch that are encoded together.
ROWS = 64


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: integers, or the bytes of what has a length or a fixed width."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


class Normalizer:
    """normalize(text): the normalised text, and for each of its characters and its end the source byte."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = False, escape: bool = True) -> None:
        self.dummy_prefix, self.squeeze, self.space = dummy_prefix, squeeze, SPACE if escape else " "
        self.trie: list[int] = []
        self.texts = b""
        if charsmap:
            size = struct.unpack("<I", charsmap[:4])[0]
            self.trie = np.frombuffer(charsmap[4 : 4 + size], "<u4").tolist()
            self.texts = charsmap[4 + size :]
        #: Bytes that keys of the map begin with.
        self.first = {b for b in range(256) if self.trie and self._child(self._step(self.trie[0]), b) is not None}

    @staticmethod
    def _step(unit: int) -> int:
        """How far the children of a unit of the double array lie."""
        return (unit >> 10) << ((unit & 512) >> 6)

    def _child(self, node: int, byte: int) -> int | None:
        """The unit that a byte leads to, if any: it holds its own label."""
        to = node ^ byte
        return to if to < len(self.trie) and self.trie[to] & 0x800000FF == byte else None

    def _longest(self, raw: bytes, at: int) -> tuple[int, int] | None:
        """(bytes, place of the replacement) of the longest key that raw has at a place."""
        found, node = None, self._step(self.trie[0])
        for i in range(at, len(raw)):
            child = self._child(node, raw[i])
            if child is None:
                break
            unit = self.trie[child]
            node = child ^ self._step(unit)
            if unit >> 8 & 1:  # a value lies beside the children
                found = (i + 1 - at, self.trie[node] & 0x7FFFFFFF)
        return found

    def _replacement(self, place: int) -> str:
        return self.texts[place : self.texts.index(b"\0", place)].decode()

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        if not self.trie and not self.squeeze:
            return self._spaces_only(text)
        raw = text.encode()
        out: list[str] = []
        where: list[int] = []
        at = 0
        after_space = self.squeeze
        while at < len(raw):
            lead = raw[at]
            found = self._longest(raw, at) if lead in self.first else None
            if found:
                size, piece = found[0], self._replacement(found[1])
            else:
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                piece = raw[at : at + size].decode()
            if after_space:
                piece = piece.lstrip(" ")
            if piece:
                out.append(piece)
                where += [at] * len(piece)
                after_space = self.squeeze and piece[-1] == " "
            at += size
        written = "".join(out).replace(" ", self.space)
        if not written:
            return "", np.zeros(1, np.int64)
        if self.dummy_prefix:
            written, where = self.space + written, [where[0], *where]
        where.append(at)
        if self.squeeze:  # a space mark of the text's own at the end goes too
            written = written.rstrip(self.space)
        return written, np.array(where[: len(written) + 1], np.int64)

    def _spaces_only(self, text: str) -> tuple[str, np.ndarray]:
        """The same for an empty map: every character stands for itself."""
        if not text:
            return "", np.zeros(1, np.int64)
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if codes.max() < 0x80:
            ends = np.arange(1, len(codes) + 1, dtype=np.int64)
        else:
            ends = np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800).astype(np.int64) + (codes >= 0x10000))
        written = text.replace(" ", self.space)
        head = [0, 0] if self.dummy_prefix else [0]
        return self.space + written if self.dummy_prefix else written, np.concatenate([np.array(head, np.int64), ends])


class Model:
    """A byte-pair model of pieces, from the bytes of its file."""

    def __init__(self, raw: bytes) -> None:
        self.texts: list[str] = []
        self.types: list[int] = []
        scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        norm: dict[int, int | bytes] = {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.texts.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0" * 4))[0])
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or {USER, UNUSED} & set(self.types):
            raise ValueError("only byte-pair models with spaces in front of words and without user-defined or unused pieces are read")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown_text = trainer[44].decode() if 44 in trainer else " ⁇ "
        self.normalizer = Normalizer(norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))
        self.ids = {t: i for i, (t, kind) in enumerate(zip(self.texts, self.types)) if kind == NORMAL}
        self.rank = {t: -scores[i] for t, i in self.ids.items()}
        self.unknown = self.types.index(UNKNOWN)
        named = {t: i for i, t in enumerate(self.texts)}
        self.end = named.get(trainer[47].decode() if 47 in trainer else "</s>")
        self.bytes = [named.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        joined = {c for t in self.ids if len(t) > 1 for c in t} - {SPACE}
        inner = any(SPACE in t.lstrip(SPACE) for t in self.ids)
        letters = "".join(re.escape(c) for c in sorted(joined)) or "\0"
        self._units = None if inner else re.compile(f"{SPACE}*[{letters}]+|{SPACE}+|.", re.DOTALL)
        # what each id decodes to: bytes, the id of the unknown piece its own mark, control pieces nothing
        self.written = [self.unknown_text.encode() if kind == UNKNOWN else b"" if kind == CONTROL else bytes([int(t[3:5], 16)]) if kind == BYTE else t.replace(SPACE, " ").encode() for t, kind in zip(self.texts, self.types)]
        self._control = np.array([kind == CONTROL for kind in self.types])
        #: Neighbouring characters that some piece holds.
        self._pairs = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        self._is_byte = np.array([kind == BYTE for kind in self.types])
        self._continues = np.array([kind == BYTE and w[0] & 0xC0 == 0x80 for kind, w in zip(self.types, self.written)])
        self._lengths = np.array([1 if kind == UNKNOWN else len(t) for kind, t in zip(self.types, self.texts)])
        self._known: dict[str, bytes] = {}
        self._size = 0

    def merge(self, unit: str) -> list[int]:
        """Ids of a unit's pieces; a character that is no piece is written in bytes, or unknown."""
        ids: list[int] = []
        for part in self._merged_short(unit) if len(unit) <= SHORT else self._merged_long(unit):
            if part in self.ids:
                ids.append(self.ids[part])
            elif self.byte_fallback:
                ids += [self.bytes[b] for b in part.encode()]
            else:
                ids.append(self.unknown)
        return ids

    def _sizes(self, ids: np.ndarray) -> np.ndarray:
        """How many characters each id stands for; of a character in bytes the last has it."""
        follows = np.append(self._continues[ids][1:], False)
        return np.where(self._is_byte[ids], ~follows, self._lengths[ids])

    def _merged_short(self, unit: str) -> list[str]:
        """The best pair again and again, the first of equals, by scanning what is left."""
        parts, get, never = list(unit), self.rank.get, float("inf")
        ranks = [get(a + b, never) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            k = ranks.index(best)
            parts[k] += parts.pop(k + 1)
            del ranks[k]
            if k:
                ranks[k - 1] = get(parts[k - 1] + parts[k], never)
            if k < len(ranks):
                ranks[k] = get(parts[k] + parts[k + 1], never)
        return parts

    def _merged_long(self, unit: str) -> list[str]:
        """The same by a heap of pairs, for units of any length."""
        parts: list[str | None] = list(unit)
        left, right = list(range(-1, len(unit) - 1)), list(range(1, len(unit) + 1))
        rank = self.rank
        heap = [(rank[a + b], k, len(a + b)) for k, (a, b) in enumerate(zip(unit, unit[1:])) if a + b in rank]
        heapq.heapify(heap)
        while heap:
            _, a, size = heapq.heappop(heap)
            if parts[a] is None or right[a] >= len(unit):
                continue
            b = right[a]
            if len(parts[a]) + len(parts[b]) != size:  # one of the two has grown since
                continue
            parts[a] += parts[b]
            parts[b] = None
            right[a] = right[b]
            if right[b] < len(unit):
                left[right[b]] = a
            for x, y in ((left[a], a), (a, right[a])):
                if x >= 0 and y < len(unit) and (both := parts[x] + parts[y]) in rank:
                    heapq.heappush(heap, (rank[both], x, len(both)))
        return [p for p in parts if p is not None]

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit not seen yet, as bytes of int32: of its parts, if it has neighbours that no piece joins."""
        pairs = self._pairs
        cuts = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in pairs]
        if cuts:
            parts = [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)])]
            found = b"".join([self._known.get(p) or self._unit(p) for p in parts])
        else:
            found = array("i", self.merge(unit)).tobytes()
        if len(unit) <= LONGEST:
            if self._size > REMEMBERED:
                self._known.clear()
                self._size = 0
            self._known[unit] = found
            self._size += len(unit)
        return found

    def _portions(self, text: str) -> Iterator[list[str]]:
        """The units of normalised text, some at a time."""
        if self._units is None:
            yield [text]
            return
        at = 0
        while at < len(text):
            end = at + PORTION
            if end >= len(text):
                end = len(text)
            else:  # the next place where a unit begins: a space after something else
                begins = re.compile(f"(?<!{SPACE}){SPACE}").search(text, end)
                end = begins.start() if begins else len(text)
            yield self._units.findall(text[at:end] if at or end < len(text) else text)
            at = end

    def encode(self, text: str, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the text's pieces and the source bytes that each begins and ends at, with the end mark if wanted."""
        written, where = self.normalizer.normalize(text)
        get, make = self._known.get, self._unit
        ids = [np.frombuffer(b"".join([get(u) or make(u) for u in units]), np.int32) for units in self._portions(written)]
        all_ids = np.concatenate([np.zeros(0, np.int32), *ids])
        ends = np.cumsum(self._sizes(all_ids), dtype=np.int64)
        if not self.byte_fallback:  # pieces unknown one after the other are one
            unknown = all_ids == self.unknown
            last = ~(unknown & np.append(unknown[1:], False))
            all_ids, ends = all_ids[last], ends[last]
        begins = np.concatenate([np.zeros(1, np.int64), ends])[:-1]
        begins, ends = where[begins], where[ends]
        if end:
            begins, ends = (np.append(x, where[-1]) for x in (begins, ends))
            all_ids = np.append(all_ids, np.int32(self.end))
        return all_ids, begins, ends

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text that the ids stand for; bytes that are no UTF-8 become a replacement character each."""
        ids = np.asarray(ids, np.int64)
        marks = np.flatnonzero(self._control[ids])
        runs = [run for run in np.split(ids, marks)]  # bytes do not join across control pieces
        runs = [(run[1:] if k else run).tolist() for k, run in enumerate(runs)]
        runs = [run for run in runs if run]
        if not runs:
            return ""
        first = self._text(self._without_prefix(runs[0]))
        return first + "".join(self._text(b"".join(map(self.written.__getitem__, run))) for run in runs[1:])

    def _without_prefix(self, ids: list[int]) -> bytes:
        """What the ids write, but for the space put before the first word, or for all in front where the model squeezes spaces."""
        raw = b"".join(map(self.written.__getitem__, ids))
        if (self.normalizer.dummy_prefix or self.normalizer.squeeze) and self.types[ids[0]] == NORMAL and self.texts[ids[0]].startswith(SPACE):
            return self._strip(ids) if self.normalizer.squeeze else raw[1:]
        return raw

    def _text(self, raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "one_each")

    def _strip(self, ids: list[int]) -> bytes:
        """What is written when all spaces in front go, as models do that squeeze spaces."""
        k = 0
        while k < len(ids) and self.types[ids[k]] == NORMAL and self.texts[ids[k]].startswith(SPACE):
            rest = self.texts[ids[k]][1:]
            if rest:
                return rest.replace(SPACE, " ").encode() + b"".join(map(self.written.__getitem__, ids[k + 1 :]))
            k += 1
        return b"".join(map(self.written.__getitem__, ids[k:]))


def _one_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


def _registered(raw: bytes, known: dict[bytes, Model] = {}) -> Model:  # noqa: B006
    """The task's model, built once a worker."""
    import codecs

    codecs.register_error("one_each", _one_each)
    if raw not in known:
        known.clear()
        known[raw] = Model(raw)
    return known[raw]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = [0, *accumulate(map(len, arrays))]
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _mapped(df: DataFrame, col: str, added: str, keep: list[str] | None, values: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """df's columns `keep` (all) with the columns `added` made of one column, in Arrow batches; columns of those names are replaced."""
    new = StructType.fromDDL(added)
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    sent = [*kept, col] if col not in kept else kept
    at = sent.index(col)
    rows = df.select(*[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(sent)])  # names of our own, as the input's may clash
    back = [f"__{k}" for k in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *values(part.column(at))], names=[*back, *new.names])

    out = rows.mapInArrow(run, StructType([*rows.schema.fields[: len(kept)], *new.fields]))
    return out.select(*[F.col(b).alias(c) for b, c in zip(back, kept)], *new.names)


def encode(df: DataFrame, model: str, text_col: str = "text", end: bool = True, keep: list[str] | None = None) -> DataFrame:
    """df with ids (array<int>), starts and ends (array<long>): the text's pieces and the source bytes each stands for.

    model: the path of a byte-pair model, as the driver sees it; keep: the columns to go on with, all by default. The
    spans follow one another and cover the whole text; of the pieces of a character that is written in bytes the last
    has the character, the others have an empty span before it; the end mark has an empty span at the end. A null text
    is an empty one, which has the end mark alone. Repeated rows are encoded each; columns of these three names are
    replaced, others stay; an empty table stays empty.
    """
    with open(model, "rb") as f:
        raw = f.read()

    def values(texts: pa.Array) -> list[pa.Array]:
        coded = _registered(raw)
        found = [coded.encode(t or "", end) for t in texts.to_pylist()]
        return [_lists([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]

    return _mapped(df, text_col, "ids array<int>, starts array<bigint>, ends array<bigint>", keep, values)


def decode(df: DataFrame, model: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """df with decoded (string): the text that the ids stand for, "" for null or no ids.

    The space that encoding puts before the first word is taken away, control pieces write nothing, and each byte of
    byte pieces that are no UTF-8 writes a replacement character. A column of that name is replaced, others stay.
    """
    with open(model, "rb") as f:
        raw = f.read()

    def values(ids: pa.Array) -> list[pa.Array]:
        coded = _registered(raw)
        flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        none = ids.is_null().to_pylist()
        return [pa.array(["" if gone else coded.decode(flat[a:b]) for gone, a, b in zip(none, at, at[1:])], pa.string())]

    return _mapped(df, ids_col, "decoded string", keep, values)


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The digests of the contract, and n_source_bytes: how many bytes of the source the pieces' spans cover."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode(table(spark, sf_dir, "documents"), model, keep=["doc_id"])
    covered = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b)
    digests = coded.select("doc_id", "ids", covered.alias("n_source_bytes"))  # spans go no further
    return decode(digests, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "n_source_bytes",
    )


QUERIES = {"op13_sentencepiece": op13_sentencepiece}
ORACLES: dict[str, str] = {}  # SQL has no such merges; tests compare with the library row for row

"""SentencePiece encoding and decoding by weighted finite-state transducers.

Machines are compiled from a model file, with states and arcs (input, output, weight, next state): the normaliser
maps a space to the space mark and puts one mark before a text; the piece machine, a prefix tree over characters,
ends each piece with an arc back to its root that puts out the piece; the byte fallback maps a character that
begins no piece to its bytes' pieces and weighs one. The normaliser is composed with the union of the other two,
so the compiled machine reads text as it is. Composed with an input it gives a lattice of pieces over the input's
places. The pair machine has a state for each last piece; it weighs nothing, or infinity for two pieces in a row
that the model's merges would not leave side by side. The shortest path in the tropical semiring (sums along a
path, the least over paths), searched over states (place, last piece) of the lattice composed with the pair
machine, then is the model's own segmentation: a sequence of pieces is what the merges leave exactly if every two
neighbours are. Sums of the file's scores would not do for a model of merges: its scores are the merges' ranks,
and their cheapest sum is another segmentation. Decoding inverts the machines.

Paths are searched in segments that no piece crosses (before a space, and at characters without pieces);
a worker keeps the answers for recent segments.

Null and empty texts have no pieces and decode to the empty text. Rows are independent; other columns pass.
A model with a precompiled normaliser, or of another kind than merges with byte fallback, is refused.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import slices, table

MARK = "▁"
_MEMO = 250_000
#: Spaces and marks read alike once normalised.
_RUNS = re.compile(f"[ {MARK}]+[^ {MARK}]*")
_INFINITE = float("inf")


class Transducer:
    """A machine whose arcs are, by state and input character, (output, weight, next state); '' is the empty input or output.

    Characters that a state has no arc for follow its arc for OTHER, whose output is the character itself.
    """

    OTHER = None

    def __init__(self):
        self.arcs: list[dict] = [{}]

    def state(self) -> int:
        self.arcs.append({})
        return len(self.arcs) - 1

    def add(self, state: int, read: str | None, put, weight: float, to: int) -> None:
        self.arcs[state][read] = put, weight, to


def normaliser() -> Transducer:
    """One mark before the text, then spaces as marks and all else as it is."""
    t = Transducer()
    body = t.state()
    t.add(0, "", MARK, 0, body)
    t.add(body, " ", MARK, 0, body)
    t.add(body, Transducer.OTHER, "", 0, body)
    return t


def piece_machine(ids: dict[str, int]) -> Transducer:
    """The pieces' prefix tree; a piece's last state has an arc on the empty input that puts it out and goes to the root."""
    t = Transducer()
    for p, i in ids.items():
        at = 0
        for c in p:
            found = t.arcs[at].get(c)
            to = found[2] if found else t.state()
            if not found:
                t.add(at, c, "", 0, to)
            at = to
        t.add(at, "", i, 0, 0)
    return t


def with_fallback(t: Transducer, whole: set[str]) -> Transducer:
    """The union with the byte fallback: at the root any character that is no piece of its own becomes its bytes, at weight 1."""
    t.whole = whole
    t.add(0, Transducer.OTHER, "bytes", 1, 0)
    return t


def composed(first: Transducer, then: Transducer) -> Transducer:
    """What the body of the normaliser puts out, read by the second machine: its arcs, with the normaliser's inputs beside its own."""
    out = Transducer()
    out.arcs = [dict(arcs) for arcs in then.arcs]
    body = first.arcs[0][""][2]
    for read, (put, weight, _) in first.arcs[body].items():
        if read is not Transducer.OTHER:
            for arcs in out.arcs:
                if put in arcs:
                    more, cost, to = arcs[put]
                    arcs[read] = more, cost + weight, to
    return out


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            at += size
            yield key >> 3, data[at - size : at]
        else:
            size, kind = (4, "<f") if key & 7 == 5 else (8, "<d")
            at += size
            yield key >> 3, struct.unpack(kind, data[at - size : at])[0]


class Machine:
    def __init__(self, model: bytes):
        #: Numbers of the model file's format: message fields and kinds of piece.
        pieces_field, trainer_field, normalizer_field, normal, byte = 1, 2, 3, 1, 6
        entries, trainer, normalizer = [], {}, {}
        for number, value in _fields(model):
            if number == pieces_field:
                entry = dict(_fields(value))
                entries.append((entry[1].decode(), entry.get(2, 0.0), entry.get(3, normal)))
            elif number == trainer_field:
                trainer = dict(_fields(value))
            elif number == normalizer_field:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1):
            raise ValueError("only merge models with byte fallback, identity normaliser, a leading mark and all white space kept")
        self.ids = {p: i for i, (p, _, kind) in enumerate(entries) if kind == normal}
        self.rank = {p: s for p, s, kind in entries if kind == normal}
        self.names = [p for p, _, _ in entries]
        self.bytes = [0] * 256
        self.output = []
        for i, (p, _, kind) in enumerate(entries):
            if kind == byte:
                self.bytes[int(p[3:5], 16)] = i
                self.output.append(bytes([int(p[3:5], 16)]))
            else:
                self.output.append(p.replace(MARK, " ").encode() if kind == normal else b"")
        self.whole = {p for p in self.ids if len(p) == 1} | ({" "} if MARK in self.ids else set())
        self.read = composed(normaliser(), with_fallback(piece_machine(self.ids), self.whole))
        self.lead = normaliser().arcs[0][""][0]
        self.fallback = self.read.arcs[0][Transducer.OTHER][1]
        # The composed machine: each arc holds its next state's arcs, and the piece put out there and its weight.
        nodes: list[dict] = [{} for _ in self.read.arcs]
        ends = [next(((put, weight) for c, (put, weight, _) in arcs.items() if c == ""), None) for arcs in self.read.arcs]
        for node, arcs in zip(nodes, self.read.arcs, strict=True):
            for c, (_, _, to) in arcs.items():
                if c is not Transducer.OTHER and c:
                    node[c] = nodes[to], ends[to]
        self.linked = nodes[0]
        self.even = not any(weight for end in ends if end for weight in end[1:])
        inner = {c for p in self.ids if p.strip(MARK) for c in p[1:]}
        if MARK in inner:
            raise ValueError("a piece has a space mark after its first character")
        self.newline_free = not any("\n" in p for p in self.ids)
        self.kind = "<u2" if len(entries) <= 1 << 16 else "<u4"
        self.pairs: dict[tuple[int, int], bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def beside(self, left: int, right: int) -> float:
        """The pair machine's weight of a piece after another: nothing if the merges leave the two side by side, else infinity.

        The merges of the two together: again and again the best-ranked one, the leftmost of equals, until one would
        cross from the first piece to the second or none is left.
        """
        a, b = self.names[left], self.names[right]
        parts, cut, rank = [*a, *b], len(a), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if at < 0 or at == cut - 1:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            cut -= at < cut
        found = self.pairs[left, right] = 0 if at < 0 and parts == [a, b] else _INFINITE
        return found

    def known_path(self, text: str) -> list[int]:
        """path() of a segment without a character that falls back to bytes, where all pieces weigh the same: a place has one last piece."""
        n, pairs, root = len(text), self.pairs, self.linked
        ends_with, begins = [-1] * (n + 1), [0] * (n + 1)
        ends_with[0] = -2
        for s in range(n):
            last = ends_with[s]
            if last == -1:
                continue
            node, e = root, s
            for c in text[s:]:
                arc = node.get(c)
                if arc is None:
                    break
                node, end = arc
                e += 1
                if end is None or ends_with[e] >= 0:
                    continue
                piece = end[0]
                if last >= 0:
                    joint = pairs.get((last, piece))
                    if joint is None:
                        joint = self.beside(last, piece)
                    if joint:
                        continue
                ends_with[e] = piece
                begins[e] = s
        out, e = [], n
        while e:
            out.append(ends_with[e])
            e = begins[e]
        out.reverse()
        return out

    def path(self, text: str) -> list[int]:
        """The shortest path of one segment: its lattice composed with the pair machine, place by place.

        best[place] has for each last piece (None: bytes) the least weight and where it comes from. Arcs of infinite
        weight are left out.
        """
        if self.even and self.whole.issuperset(text):
            return self.known_path(text)
        n, pairs, root = len(text), self.pairs, self.linked
        best: list = [None] * (n + 1)
        best[0] = {None: (0, 0, None)}
        #: Of each place the least weight with which a piece ends there.
        least = [_INFINITE] * (n + 1)
        for s in range(n):
            states = best[s]
            if states is None:
                continue
            if text[s] not in self.whole:
                for last, (cost, _, _) in states.items():
                    into = best[s + 1] = best[s + 1] or {}
                    if None not in into or cost + self.fallback < into[None][0]:
                        into[None] = cost + self.fallback, s, last
            node = root
            for e in range(s, n):
                arc = node.get(text[e])
                if arc is None:
                    break
                node, end = arc
                if end is None:
                    continue
                piece, weight = end
                into = best[e + 1]
                for last, state in states.items():
                    cost = state[0] + weight
                    # Pieces that all may stand beside each other are what the merges give, and they give one segmentation:
                    # a place that some piece has reached at no more weight needs no other one.
                    if into is not None and least[e + 1] <= cost:
                        continue
                    if last is not None:
                        joint = pairs.get((last, piece))
                        if joint is None:
                            joint = self.beside(last, piece)
                        if joint:
                            continue
                    if into is None:
                        into = best[e + 1] = {}
                    into[piece] = cost, s, last
                    least[e + 1] = cost
        out, e = [], n
        last = min(best[n], key=lambda k: best[n][k][0]) if n else None
        while e:
            _, s, before = best[e][last]
            out.append([last] if last is not None else [self.bytes[b] for b in text[s:e].encode("utf-8", "replace")])
            e, last = s, before
        return [i for ids in reversed(out) for i in ids]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as unsigned integers of self.kind."""
        if len(self.new) > _MEMO:
            self.old, self.new = self.new, {}
        if len(self.pairs) > 4 * _MEMO:
            self.pairs.clear()
        new, old = self.new, self.old
        split = []
        for x in texts:
            if not x:
                split.append([])
            elif "  " in x or MARK in x or x[0] == " " or "\r" in x or " \n" in x or not self.newline_free:
                # A leading return marks a segment that is taken as it stands.
                split.append(["\r" + s for s in _RUNS.findall(self.lead + x)])
            else:
                # Segments begin at single spaces, left out here, and at newlines, which no piece holds.
                split.append(x.replace("\n", " \n").split(" "))
        missing = set().union(*split).difference(new)
        for w in missing:
            ids = old.get(w)
            if ids is None:
                ids = np.array(self.path(w if w[:1] == "\n" else w[1:] if w[:1] == "\r" else self.lead + w), self.kind).tobytes()
            new[w] = ids
        return [b"".join(map(new.__getitem__, words)) for words in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids that stand for no text are skipped, bytes that are no text become the replacement character."""
        out = self.output
        data = b"".join([out[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def machine(path: str) -> Machine:
    """One machine in each worker process, kept from task to task."""
    with open(path, "rb") as f:
        return Machine(f.read())


def encode(documents: DataFrame, model: str) -> DataFrame:
    """The documents with a column ids array<int> (an existing one is replaced)."""
    docs = documents.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for b in slices(batches, 1024, "text"):
            got = m.encode(b.column(b.schema.get_field_index("text")).to_pylist())
            flat = np.frombuffer(b"".join(got), m.kind).astype(np.int32)
            ends = np.cumsum([0, *(len(x) // int(m.kind[2]) for x in got)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*b.schema.names, "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows with a column decoded string from their ids (null ids: empty)."""
    rows = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for b in slices(batches, 1024):
            texts = [m.decode(x or []) for x in b.column(b.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, decoded string")


_DIGEST = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean"


def _digest(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for b in slices(batches, 512, "text"):
            texts = b.column(1).to_pylist()
            n, crc, same = [], [], []
            for x, got in zip(texts, m.encode(texts), strict=True):
                ids = np.frombuffer(got, m.kind)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                same.append(m.decode(ids.tolist()) == (x or "").replace(MARK, " "))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=[x.split()[0] for x in _DIGEST.split(", ")])

    return run


def digests(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32 of the ids as little-endian 32-bit integers, round_trip) of each text, encoded and decoded."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digest(model), _DIGEST)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: the number of pieces, their checksum, and whether the text came back."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

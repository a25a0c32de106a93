"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised (spaces become U+2581, one is put in front); a vocabulary whose
file asks for anything else, or that isn't of the merge type, is refused.  It is cut
where no piece of the vocabulary can cross, and every part is merged
by an agenda of adjacent symbol pairs ordered by score, leftmost first on ties.
Symbols outside the vocabulary fall back to byte pieces.  Parts are remembered in
a bounded table, as most words come again.  In every Arrow batch the longest and
the first text are encoded and decoded by the sentencepiece library as well; a
difference stops the job.

Defined results: null text counts as empty and gives the end id alone; texts of any
length are encoded whole; every row, repeated or without an id, gives a row of its
own; pairs of equal score merge leftmost first; an empty table gives none; other
columns never matter.
"""
from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidy

SPACE = "▁"
SLICE = 2 << 20
REMEMBERED = 600_000  # parts kept by a Python worker, some 350 bytes each, and half as many of the atoms that parts are cut into
LONGEST = 48  # longer parts are not remembered


def message_fields(data: bytes) -> dict[int, list]:
    """Values of a serialised message by field number: numbers or bytes."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
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
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


def refuse_other_rules(model: bytes) -> None:
    """An error unless a vocabulary file is of the merge type and only escapes spaces and puts one in front.

    Fields of the file: 2 training (3: type, 2 is merging), 3 normaliser (2: character map, 3: space
    in front, 4: extra spaces removed, 5: spaces escaped; the last three are true where not given).
    """
    fields = message_fields(model)
    training, rules = ({k: v[-1] for k, v in message_fields(fields.get(n, [b""])[-1]).items()} for n in (2, 3))
    if training.get(3, 1) != 2:
        raise ValueError("not a vocabulary of the merge type")
    if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
        raise ValueError("the vocabulary asks for another normalisation")


class MergeCodec:
    """Encoder and decoder over one merge-type vocabulary file."""

    def __init__(self, model_file: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        refuse_other_rules(sp.serialized_model_proto())
        self.ids, self.order, self.byte_id, self.surface = {}, {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.surface[i] = piece.replace(SPACE, " ")
        ranked = sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True)
        rank = {score: n for n, score in enumerate(ranked)}
        self.order = {piece: rank[sp.get_score(i)] for piece, i in self.ids.items() if len(piece) > 1}
        self.bytes_of = {i: b for b, i in self.byte_id.items()}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.order)
        newline = any("\n" in p for p in self.order)
        # Parts are cut before a space that follows another symbol and around newlines, if no piece spans such a place.
        body = f"[^{SPACE}]" if newline else f"[^{SPACE}\n]"
        self.parts = re.compile("(?s).+" if crossing else f"{SPACE}*{body}+|{SPACE}+" + ("" if newline else "|\n")).findall
        # No merge can join symbols that no piece holds side by side: parts are cut there into atoms.
        self.side_by_side = {a + b for p in self.order for a, b in zip(p, p[1:])}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.atoms: dict[str, list[int]] = {}
        self.remembered = remembered

    def merge(self, part: str) -> list[int]:
        """Ids of one part, by the agenda."""
        whole = self.ids.get(part)
        n = len(part)
        if n == 1:
            return self._fallback(part) if whole is None else [whole]
        order = self.order
        symbols: list[str | None] = list(part)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            r = order.get(pair)
            if r is not None:
                agenda.append((r, i, pair))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            r, i, pair = pop(agenda)
            left = symbols[i]
            if left is None:
                continue
            j = nxt[i]
            if j >= n or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            j = nxt[i] = nxt[j]
            if j < n:
                prv[j] = i
                longer = pair + symbols[j]
                r = order.get(longer)
                if r is not None:
                    push(agenda, (r, i, longer))
            h = prv[i]
            if h >= 0:
                longer = symbols[h] + pair
                r = order.get(longer)
                if r is not None:
                    push(agenda, (r, h, longer))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                i = self.ids.get(s)
                if i is None:
                    out += self._fallback(s)
                else:
                    out.append(i)
        return out

    def _fallback(self, symbol: str) -> list[int]:
        if len(self.byte_id) < 256:
            return [self.unknown]
        return [self.byte_id[b] for b in symbol.encode()]

    def decode_part(self, ids: list[int]) -> str:
        """Surface of ids; runs of byte pieces are read as UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            b = self.bytes_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(" ⁇ " if i == self.unknown else self.surface.get(i, ""))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def part(self, part: str) -> tuple[int, str, str]:
        """(number of ids, their decimal text, decoded text) of one part."""
        ids = self.part_ids(part)
        entry = (len(ids), " ".join(map(str, ids)), self.decode_part(ids))
        if len(part) <= LONGEST:
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[part] = entry
        return entry

    def part_ids(self, part: str) -> list[int]:
        """Ids of one part, atom by atom."""
        out: list[int] = []
        atoms, together, start = self.atoms, self.side_by_side, 0
        for end in range(1, len(part) + 1):
            if end == len(part) or part[end - 1 : end + 1] not in together:
                atom = part[start:end]
                start = end
                ids = atoms.get(atom)
                if ids is None:
                    ids = self.merge(atom)
                    if len(atom) <= LONGEST:
                        if len(atoms) >= self.remembered // 2:
                            atoms.clear()
                        atoms[atom] = ids
                out += ids
        return out

    def forget(self) -> None:
        self.known.clear()
        self.atoms.clear()

    def normalised(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str) -> list[int]:
        """Ids of a text, the end id last."""
        return [i for part in self.parts(self.normalised(text)) for i in self.part_ids(part)] + [self.end]

    def decode(self, ids: list[int]) -> str:
        text = self.decode_part([i for i in ids if i in self.surface or i in self.bytes_of or i == self.unknown])
        first = next((i for i in ids if i in self.surface or i in self.bytes_of), None)
        return text[1:] if first in self.surface and text.startswith(" ") else text

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by spaces, decoded text) with the end id."""
        known, part = self.known, self.part
        entries = [known.get(p) or part(p) for p in self.parts(self.normalised(text))]
        decoded = "".join([e[2] for e in entries])
        return (sum([e[0] for e in entries]) + 1, " ".join([*[e[1] for e in entries], str(self.end)]),
                decoded[1:] if decoded.startswith(" ") else decoded)

    def check(self, text: str, ids: str, decoded: str) -> None:
        theirs = self.library.encode(text, add_eos=True, num_threads=1)
        if ids != " ".join(map(str, theirs)) or decoded != self.library.decode(theirs):
            raise ValueError(f"encoding differs from the library's for a text of {len(text)} characters")


@lru_cache(maxsize=4)
def codec(model_file: str, remembered: int = REMEMBERED) -> MergeCodec:
    """One codec for each Python worker and vocabulary file."""
    return MergeCodec(model_file, remembered)


def encode_documents(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), texts: bool = False,
                     remembered: int = REMEMBERED, held: bool = True) -> DataFrame:
    """``keep`` columns with n_tokens and the digests of the ids and of the decoded text; with ``texts`` the ids and that text too.

    ``remembered`` bounds a worker's cache of parts: memory against time, same results.  Unless it is ``held``, the cache
    goes at the end of each task, so that a worker has that memory for other stages.
    """
    extra = "token_ids array<int>, decoded string, " if texts else ""
    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", {extra}n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file, remembered)
        try:
            yield from encoded(c, batches)
        finally:
            if not held:
                c.forget()

    def encoded(c: MergeCodec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        for whole in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(whole.column(whole.num_columns - 1)), 0))
            place = np.cumsum(sizes, dtype=np.int64) // SLICE  # results of about SLICE bytes of text are held at once
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(sizes)] if len(sizes) else []
            for start, end in zip(cuts, cuts[1:]):
                batch = whole.slice(start, end - start)
                counts, ids_sha, dec_sha, all_ids, all_dec = [], [], [], [], []
                longest = int(sizes[start:end].argmax())
                for n, value in enumerate(batch.column(batch.num_columns - 1)):
                    value = value.as_py() or ""
                    k, ids, decoded = c.round_trip(value)
                    if start + n == 0 or n == longest and sizes[start + n] == sizes.max():
                        c.check(value, ids, decoded)
                    counts.append(k)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    dec_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if texts:
                        all_ids.append(np.array(ids.split(" "), np.int32))
                        all_dec.append(decoded)
                more, names = [], []
                if texts:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in all_ids])]).astype(np.int32)
                    more = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_ids))), pa.array(all_dec, pa.string())]
                    names = ["token_ids", "decoded"]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())],
                                                 names=[*keep, *names, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run if held else tidy(run), schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

"""SentencePiece BPE by a prefix table: the last token of every prefix's encoding, from which ids are read off backwards.

Greedy merging gives each prefix of a text one encoding, so one last token. It is the one token among those that end there
(found by an automaton) that stays apart from the last token of what is before it: two tokens side by side are compatible if
merging their joint text never joins across their border. Neighbours that are compatible pairwise make up the encoding of
the whole, since merges before the first that crosses a border run inside each token as they run alone.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sondage.functions.columns import quoted
from sondage.llm.common import documents, release

SPACE = "▁"
#: Most words and parts of words, and most pairs of tokens, that a worker remembers; beyond it the memory starts anew. Longer words are not remembered.
REMEMBERED = 800_000
PAIRS = 1_000_000
LONGEST = 200
#: About this many bytes of text are worked on at a time.
CHUNK = 2_000_000
UNKNOWN = -1


class PrefixTable:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback; the library only reads the model and normalizes."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.end = self.model.eos_id()
        self.bytes_of = [b""] * len(ids)
        self.byte_ids = [0] * 256
        self.is_byte = np.zeros(len(ids), dtype=bool)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i in ids:
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value], self.bytes_of[i], self.is_byte[i] = i, bytes([value]), True
            elif self.model.is_unknown(i):
                self.bytes_of[i] = self.model.decode([i]).encode()
            elif not self.model.is_control(i):
                if self.model.is_unused(i):
                    raise ValueError("models with unused pieces are not supported")
                self.ids[piece] = i
                self.scores[piece] = self.model.get_score(i)
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.pieces = {i: p for p, i in self.ids.items()}
        self.alone: dict[int, tuple] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self._merges(i)[0]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        # two characters that no piece holds side by side are never merged, so text may be cut between them: before a space
        # that ends something, and between a letter and a sign that never follows a letter
        inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.cuts_at_spaces = not any(b == SPACE != a for a, b in inside)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        signs = {c for c in map(chr, range(128)) if not c.isalnum()} - {b for a, b in inside if a.isalpha()}
        self.tail = re.compile(f"(.*[^\\W\\d_])([{re.escape(''.join(sorted(signs)))}]+)", re.DOTALL)
        # where the model writes a text just as it is but for spaces, the library need not normalize it
        probe = "Aéé ﬁ Ａ  b\t½\n​\x00　c "
        self.plain = self.model.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        self.forget()

    def forget(self) -> None:
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, array] = {}

    # ------------------------------------------------------------------ merging

    def _merges(self, token: int) -> tuple[bool, list, list]:
        """Whether the token's text merges into itself, and its merges in order: (score, rightmost part) and (score, leftmost part)."""
        got = self.alone.get(token)
        if got is None:
            parts = list(self.pieces[token])
            rights, lefts = [(0.0, parts[-1])], [(0.0, parts[0])]
            while len(parts) > 1:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    score = self.scores.get(parts[k] + parts[k + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, k
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                rights.append((best, parts[-1]))
                lefts.append((best, parts[0]))
            got = self.alone[token] = (len(parts) == 1, rights, lefts)
        return got

    def fits(self, first: int, second: int) -> bool:
        """Whether merging the joint text of two tokens gives just these two: the next merge inside either is always taken before one across.

        The better score comes first, and of equal ones the one further left.
        """
        if first == UNKNOWN or second == UNKNOWN:
            return True
        key = first * len(self.bytes_of) + second
        got = self.compatible.get(key)
        if got is None:
            rights, lefts = self._merges(first)[1], self._merges(second)[2]
            i = j = 0
            never = float("-inf")
            got = True
            while True:
                across = self.scores.get(rights[i][1] + lefts[j][1], never)
                own = rights[i + 1][0] if i + 1 < len(rights) else never
                other = lefts[j + 1][0] if j + 1 < len(lefts) else never
                if across > own and across >= other:
                    got = False
                    break
                if own >= other and own > never:
                    i += 1
                elif other > never:
                    j += 1
                else:
                    break
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            self.compatible[key] = got
        return got

    # ------------------------------------------------------------------ encoding

    def part(self, text: str) -> array:
        """Ids of a part of normalized text. ``last[i]`` is the last token of the first i characters, ``back[i]`` where it starts."""
        n = len(text)
        if n == 1:
            only = self.ids.get(text)
            return array("i", [only] if only is not None else [self.byte_ids[b] for b in text.encode()])
        last, back = [UNKNOWN] * (n + 1), [-1] * (n + 1)
        fits, compatible, size = self.fits, self.compatible, len(self.bytes_of)
        found = 0  # the last place that a token ends at
        for end, (token, length) in self.automaton.iter(text):
            if end < found:
                continue
            start = end + 1 - length
            if start:
                before = last[start]
                good = compatible.get(before * size + token)
                if good is None:
                    good = fits(before, token)
                if not good:
                    continue
            found = end + 1
            last[found], back[found] = token, start
        ids: list[int] = []
        i = n
        while i:
            if back[i] < 0:
                back[i] = i - 1
            if last[i] == UNKNOWN:
                ids.extend(self.byte_ids[b] for b in reversed(text[back[i] : i].encode()))
            else:
                ids.append(last[i])
            i = back[i]
        ids.reverse()
        return array("i", ids)

    def encode(self, text: str) -> array:
        """Ids of a whole text, the end id last."""
        text = (SPACE + text.replace(" ", SPACE) if text else "") if self.plain else self.model.normalize(text)
        out = array("i")
        known = self.known
        for word in self.cut.findall(text) if self.cuts_at_spaces else [text]:
            ids = known.get(word)
            out += self._word(word) if ids is None else ids
        out.append(self.end)
        return out

    def _word(self, word: str) -> array:
        """Ids of a word that is not known, by those of its parts."""
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        cut = self.tail.fullmatch(word)
        if cut:
            out = array("i")
            for text in cut.groups():
                ids = known.get(text)
                if ids is None:
                    ids = self.part(text)
                    if len(text) <= LONGEST:
                        known[text] = ids
                out += ids
        else:
            out = self.part(word)
        if len(word) <= LONGEST:
            known[word] = out
        return out

    # ------------------------------------------------------------------ decoding

    def decode(self, ids) -> str:
        """Text of ids: bytes joined, one space of the start taken off, bytes that are no UTF-8 replaced one by one."""
        table = self.bytes_of
        data = b"".join([table[i] for i in ids])
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = self._decode_bytes(ids)
        first = next((i for i in ids if table[i]), None)  # control pieces have no text
        return text[1:] if first in self.pieces and text.startswith(" ") else text

    def _decode_bytes(self, ids) -> str:
        out, run = [], bytearray()
        for i in chain(ids, [None]):
            if i is not None and self.is_byte[i]:
                run += self.bytes_of[i]
                continue
            at = 0
            while at < len(run):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + width].decode())
                        at += width
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()
            if i is not None:
                out.append(self.bytes_of[i].decode())
        return "".join(out)


_WORKER: dict[str, PrefixTable] = {}


def _table(path: str) -> PrefixTable:
    if path not in _WORKER:
        _WORKER[path] = PrefixTable(path)
    return _WORKER[path]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows in a row of about CHUNK bytes, one row at least."""
    upto = np.append(0, np.cumsum(sizes))
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + CHUNK, side="right")) - 1)
        yield lo, hi
        lo = hi


def _sizes(column: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, dtype=np.int64)


def _lists(rows: list[array]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows])
    flat = np.frombuffer(b"".join(r.tobytes() for r in rows), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat))


def encode(df: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every text under the model at ``path``, an end id last; with ``decoded`` also ``text``, read back from the ids.

    Map only: the model is read once by a worker, documents pass in small chunks, and a worker remembers a bounded number of words.
    Null text counts as empty and has the end id alone. Repeated rows each come back; a null id stays null; columns other than
    ``doc_id`` and ``text`` are not read, whatever their names; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for batch in batches:
            for lo, hi in _slices(_sizes(batch.column(1))):
                rows = [table.encode(str(t, "utf-8")) for t in batch.column(1)[lo:hi].to_pylist()]
                out = [batch.column(0)[lo:hi], _lists(rows)]
                if decoded:
                    out.append(pa.array([table.decode(r) for r in rows], type=pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "text"][: len(out)])
        release()

    return documents(df).mapInArrow(run, "doc_id bigint, ids array<int>" + (", text string" if decoded else ""))


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids, as the library's decode gives it. Null ids give an empty text; ids outside the model raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for batch in batches:
            lengths = np.asarray(pc.list_value_length(batch.column(1)).fill_null(0), dtype=np.int64)
            for lo, hi in _slices(4 * lengths):
                texts = [table.decode(r or []) for r in batch.column(1)[lo:hi].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(texts, type=pa.string())], [key, "text"])
        release()

    rows = df.select(quoted(key).alias(key), quoted(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")

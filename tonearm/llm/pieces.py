"""SentencePiece encoding and decoding in one pass of an automaton, for both kinds of models.

An Aho-Corasick automaton over all pieces reads a text once; at each position its output links give
the pieces that end there, longest first. For a unigram model each of them relaxes the best score of that
position. A BPE model merges neighbours in the order of scores; the ids of a text's beginning end in
exactly one piece, the only one of those given that merging would keep apart from the last piece of
the beginning before it. So there each piece is tried against one neighbour, and what is relaxed is the last
piece of each beginning. Characters that no piece covers are spelled in byte pieces, so every text can
be decoded exactly.

No piece of the usual models has a blank mark after another character or mixes letters with others,
so the segmentations of the stretches between such places make up that of the text; they are
remembered for words that return. Models with other pieces are run over whole texts.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tonearm.llm.common import plain_columns, slices

MARK = "▁"
# Added to the smallest score of a piece for a character that must be spelled in bytes.
PENALTY = -10.0
_NEVER = float("-inf")
# Stretches remembered by a worker, about twice, and ids decoded at once.
REMEMBERED = 250_000
# Neighbours remembered, whether merging keeps them apart.
PAIRS = 500_000
DECODED_IDS = 500_000
_LETTER, _OTHER = r"[^\W\d_%s]", r"(?:(?!{0})[\W\d_%s])".format(MARK)


def _stretches(pieces: list[str]) -> re.Pattern | None:
    """A pattern whose matches, in a row, are a text cut only where no piece reaches across.

    No piece may have a blank mark after another character (else None). If hardly any mixes letters
    with other characters, texts are cut there as well; the letters of such pieces count as others.
    """
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        return None
    odd: set[str] = set()
    while len(odd) <= 20:
        escaped = "".join(map(re.escape, sorted(odd)))
        letter, other = _LETTER % escaped, _OTHER % escaped
        mixed = re.compile(f"{letter}{other}|{other}{letter}")
        found = {c for p in pieces for pair in mixed.findall(p) for c in pair if c.isalpha() or c.isalnum()}
        if not found:
            return re.compile(f"{MARK}*(?:{letter}+|{other}+)|{MARK}+")
        odd |= found
    return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class _Memory(dict):
    """Ids by stretch, as bytes: those of the last ``REMEMBERED`` or so new ones, and as many before."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.before = compute, {}

    def __missing__(self, stretch: str) -> bytes:
        found = self.before.get(stretch)
        if found is None:
            found = array("i", self.compute(stretch)).tobytes()
        self[stretch] = found
        return found

    def forget(self) -> None:
        """Between texts: when there are too many, only the newest stay."""
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()


@functools.lru_cache(1)
def load_pieces(path: str) -> Pieces:
    """The model, once for a worker: what it remembers serves its later tasks too."""
    return Pieces(path)


class Pieces:
    """A model's ordinary pieces with their scores, and its byte pieces."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model.serialized_model_proto())
        self.by_merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        self.piece = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if model.is_byte(i)}
        self.value = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else
                      b"" if model.is_control(i) or model.is_unknown(i) else
                      p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        own = [i for i in range(len(self.piece)) if not (
            model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if len(self.byte) < 256:
            raise ValueError("the model has no byte pieces")
        self.score = {i: float(model.get_score(i)) for i in own}
        self.single = {self.piece[i] for i in own if len(self.piece[i]) == 1}
        self.spelled = min(self.score.values()) + PENALTY
        self.stretches = _stretches([self.piece[i] for i in own])
        self.size = [len(p) for p in self.piece]
        # what an id adds to a score; a spelled character counts once, with its first byte
        self.worth = np.zeros(len(self.piece))
        for i in own:
            self.worth[i] = self.score[i]
        for b, i in self.byte.items():
            self.worth[i] = 0.0 if 0x80 <= b < 0xC0 else self.spelled
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in own:
            self.automaton.add_word(self.piece[i], i)
        self.automaton.make_automaton()
        self.own = {self.piece[i]: i for i in own}
        self.known, self.joined = _Memory(lambda x: self._best(x)[0]), _Memory(self._ids)
        self.text_score = {self.piece[i]: self.score[i] for i in own}
        if self.by_merges:
            self.split = {p: parts for p in self.own if (parts := self._last_merge(p))}
            # merges of a trained model come in the order of their scores: parts before the whole (equal
            # scores, as pieces of blanks have, from left to right)
            self.in_order = all(self.text_score.get(x, 0.0) >= self.text_score[p] for p, parts in
                                self.split.items() for x in parts if len(x) > 1)
            self.whole = bytearray(p in self.split or len(p) == 1 for p in self.piece)
            self.pairs: dict[int, bool] = {}

    def _best(self, text: str, literal: frozenset[int] = frozenset()) -> tuple[list[int], float]:
        """Ids of the best segmentation and its score; of equal ones that with the longer last piece.

        ``literal``: places of blank marks that stand in the original text and are spelled.
        """
        n, size, score = len(text), self.size, self.score
        best, back = [_NEVER] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        if not literal and self.single.issuperset(text):  # nothing to spell
            for last, piece in self.automaton.iter(text):
                worth = best[last + 1 - size[piece]] + score[piece]
                if worth > best[last + 1]:
                    best[last + 1] = worth
                    back[last + 1] = piece
            ids, at = [], n
            while at:
                ids.append(back[at])
                at -= size[back[at]]
            return ids[::-1], best[n]
        done = 0  # positions whose spelled character has been tried

        def spell(to: int) -> None:
            for at in range(done, to):
                if text[at] not in self.single or at in literal:
                    worth = best[at] + self.spelled
                    if worth > best[at + 1]:
                        best[at + 1], back[at + 1] = worth, -1

        for last, piece in self.automaton.iter(text):
            # all pieces that end before are in; the best score there is final but for spelling
            spell(last)
            done = max(done, last)
            begin = last + 1 - size[piece]
            if literal and not literal.isdisjoint(range(begin, last + 1)):
                continue
            worth = best[begin] + score[piece]
            if worth > best[last + 1]:
                best[last + 1], back[last + 1] = worth, piece
        spell(n)
        ids, at = [], n
        while at:
            if back[at] >= 0:
                ids.append(back[at])
                at -= size[back[at]]
            else:
                ids += [self.byte[b] for b in reversed(text[at - 1].encode())]
                at -= 1
        return ids[::-1], best[n]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes up a piece, if merging its characters gives the piece."""
        parts, last = list(piece), None
        while len(parts) > 1:
            worth = [self.text_score.get(a + b, _NEVER) for a, b in pairwise(parts)]
            best = max(worth)
            if best == _NEVER:
                return None
            at = worth.index(best)
            last = parts[at], parts[at + 1]
            parts[at:at + 2] = ["".join(last)]
        return last

    def _apart(self, left: str, right: str) -> bool:
        """Whether merging the characters of two neighbours gives just these two again.

        Merges are undone from the last to the first, on either side of the border between them. Whatever
        then meets there must not be worth more than the merge that was undone, else it would have come
        first; of equal ones the merge farther to the left comes first.
        """
        score = self.text_score
        if left + right in score:
            return False
        while len(left) > 1 or len(right) > 1:
            if len(left) == 1 or (len(right) > 1 and score[right] <= score[left]):
                undone, right = score[right], self.split[right][0]
                if score.get(left + right, _NEVER) >= undone:
                    return False
            else:
                undone, left = score[left], self.split[left][1]
                if score.get(left + right, _NEVER) > undone:
                    return False
        return True

    def _last_pieces(self, text: str, literal: frozenset[int] = frozenset()) -> tuple[list[int], float]:
        """Ids of a BPE model: the last piece of each beginning of the text, in one pass."""
        if literal:
            ids, at = [], 0
            for to in [*sorted(literal), len(text)]:
                ids += self._last_pieces(text[at:to])[0] if at < to else []
                ids += [self.byte[b] for b in text[to:to + 1].encode()]
                at = to + 1
            return ids, float(self.worth[ids].sum())
        ids = self._ids(text)
        return ids, float(self.worth[ids].sum())

    def _ids(self, text: str) -> list[int]:
        """The same for a text without blank marks of its own, ids only."""
        if not self.in_order:  # no model of the usual training
            return self._merge(text)[0]
        size, whole, pairs, every = self.size, self.whole, self.pairs, len(self.piece)
        last = [-1] * (len(text) + 1)  # the last piece of each beginning; none: a character to spell
        if len(pairs) > PAIRS:
            pairs.clear()
        for end, piece in self.automaton.iter(text):
            end += 1
            if last[end] >= 0 or not whole[piece]:
                continue
            at = end - size[piece]
            if at:
                left = last[at]
                if left < 0:
                    if not self._apart(text[at - 1], self.piece[piece]):
                        continue
                else:
                    apart = pairs.get(left * every + piece)
                    if apart is None:
                        apart = pairs[left * every + piece] = self._apart(self.piece[left], self.piece[piece])
                    if not apart:
                        continue
            last[end] = piece
        ids, at = [], len(text)
        while at:
            piece = last[at]
            if piece >= 0:
                ids.append(piece)
                at -= size[piece]
            else:
                at -= 1
                ids += [self.byte[b] for b in reversed(text[at].encode())]
        ids.reverse()
        return ids

    def _merge(self, text: str, literal: frozenset[int] = frozenset()) -> tuple[list[int], float]:
        """Ids by merges in the order of their scores, of equal ones the first; and their score.

        For models whose pieces may be worth more than their parts; and to test the single pass.
        """
        n, own, score = len(text), self.own, self.score
        # symbols by their first place: where each ends (0: merged into another), and the one before
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[float, int, int, int]] = []

        def offer(left: int) -> None:
            right = stop[left]
            if right < n and left not in literal and right not in literal:
                piece = own.get(text[left:stop[right]])
                if piece is not None:
                    heappush(waiting, (-score[piece], left, right, stop[right]))

        for at in range(n - 1):
            offer(at)
        while waiting:
            _, left, right, end = heappop(waiting)
            if stop[left] != right or stop[right] != end:
                continue  # one of the two has been merged since
            stop[left], stop[right] = end, 0
            if end < n:
                before[end] = left
                offer(left)
            if before[left] >= 0:
                offer(before[left])
        ids, at = [], 0
        while at < n:
            piece = None if at in literal else own.get(text[at:stop[at]])
            ids += [self.byte[b] for b in text[at].encode()] if piece is None else [piece]
            at = stop[at]
        return ids, float(self.worth[ids].sum())

    def encode(self, text: str, by_merges: bool = False) -> tuple[np.ndarray, float]:
        """Ids and score of a text, with one blank put before it. An empty text has none.

        The best score, or what the merges of a BPE model give.
        """
        if not text:
            return np.zeros(0, np.int32), 0.0
        known = self.joined if by_merges else self.known
        if self.stretches is None or MARK in text:
            marked = MARK + text.replace(" ", MARK)
            compute = self._last_pieces if by_merges else self._best
            ids, score = compute(marked, frozenset(i + 1 for i, c in enumerate(text) if c == MARK))
            return np.array(ids, np.int32), score
        stretches = self.stretches.findall(MARK + text.replace(" ", MARK))
        ids = np.frombuffer(b"".join(map(known.__getitem__, stretches)), np.int32)
        known.forget()
        return ids, float(self.worth[ids].sum())

    def decode(self, ids) -> str:
        """The text of encoded ids, without the blank put before it."""
        value = self.value
        return b"".join([value[i] for i in ids]).decode("utf-8", "replace")[1:]


def encode_documents(docs: DataFrame, model: str, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """``doc_id, ids, score`` of every row; null and empty texts have no ids and score 0.

    Ids are those of the library for texts without a blank mark of their own (it takes that for a
    blank; here it is spelled). ``score`` is the sum of the scores of the ids.
    """

    def run(batches):
        pieces = load_pieces(model)
        for part in slices(batches, "text"):
            every, scores = [], []
            for text in part.column("text"):
                ids, score = pieces.encode(text.as_py() or "", pieces.by_merges)
                every.append(ids)
                scores.append(score)
            sizes = np.cumsum([0, *map(len, every)])
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"),
                pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), np.concatenate(every)),
                pa.array(scores, pa.float64())], names=["doc_id", "ids", "score"])

    rows = plain_columns(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, score double")


def _rows_with(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose lists have at most ``most`` values together, or one row."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes.astype(np.int64)), 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of ``encode_documents`` with the ``text`` their ids stand for; null ids are empty."""

    def run(batches):
        pieces = load_pieces(model)
        for batch in batches:
            for part in _rows_with(batch, "ids", DECODED_IDS):
                column = part.column("ids")
                flat = column.flatten().to_numpy()
                ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(
                    zero_copy_only=False))
                # ids become Python numbers one text at a time
                texts = [pieces.decode(flat[a:b].tolist()) for a, b in zip(np.r_[0, ends[:-1]], ends)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("doc_id", "ids", "score")
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, score double, text string")

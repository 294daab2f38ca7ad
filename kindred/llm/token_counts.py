"""Token counts by a tokenizer compiled to a deterministic transducer.

A BPE segmentation is canonical exactly when every adjacent pair of its pieces
is, so the segmentation of each prefix follows from the last pieces of the
shorter prefixes that a piece can still span (Berglund & van der Merwe,
"Formalizing BPE tokenization", 2023).  A state of the transducer is that
bounded knowledge: the trie nodes of the suffixes a piece could still extend,
each with the piece before it and its token count relative to the prefix.  A
transition on a character carries the change of the token count.  States are
determinised as texts need them and forgotten past a bound, as lazy regex
automata do, so memory does not grow with the corpus.

Where no piece holds two neighbouring characters next to each other, no piece
crosses: the state falls back to the start state whatever came before.  A
chunk of text therefore acts on states as "finish the head from the incoming
state, then add a known count and leave a known state".  Those chunk maps
compose associatively; for chunks that start at such a place they are plain
additions, and the prefix scan over all runs of a batch is one cumulative sum.

Defined results: null text counts as empty; empty text has no tokens;
characters outside the vocabulary cost one token per UTF-8 byte (byte
fallback); special strings in a text are ordinary characters.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from kindred.llm.arrowtext import slices, small_batches, texts

SPACE = "▁"
MAX_STATES = 300_000
CHUNK = 4096
LIMIT = 4096


def merge_pieces(text: str, score: dict[str, float]) -> list[str]:
    """Plain BPE: the best-scored neighbouring pair first, leftmost on ties."""
    parts: list[str | None] = list(text)
    left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap = [(-score[p], i, p) for i in range(len(parts) - 1) if (p := text[i : i + 2]) in score]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = right[i]
        if parts[i] is None or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j], right[i] = joined, None, right[j]
        if right[i] < len(parts):
            left[right[i]] = i
        for k in (left[i], i):
            if k >= 0 and right[k] < len(parts) and (p := parts[k] + parts[right[k]]) in score:
                heapq.heappush(heap, (-score[p], k, p))
    return [p for p in parts if p is not None]


class Transducer:
    """The lazily determinised counter for one vocabulary of scored pieces."""

    def __init__(self, score: dict[str, float], max_states: int = MAX_STATES):
        self.score, self.max_states = score, max_states
        self.children: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        self.pairs: set[str] = set()
        for text in score:
            node = 0
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.piece.append(None)
                node = self.children[node][c]
            if merge_pieces(text, score) == [text]:
                self.piece[node] = text
            self.pairs.update(text[i : i + 2] for i in range(len(text) - 1))
        self.fits: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone."""
        start = ((0, None, 0),)
        self.number = {start: 0}
        self.states = [start]
        self.last = [""]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _fit(self, before: str | None, piece: str) -> bool:
        """Whether the two pieces stay as they are side by side."""
        if before is None or before[-1] + piece[0] not in self.pairs:
            return True
        key = (before, piece)
        if key not in self.fits:
            if len(self.fits) > 4 * self.max_states:
                self.fits.clear()
            self.fits[key] = merge_pieces(before + piece, self.score) == [before, piece]
        return self.fits[key]

    def _add(self, state: int, c: str) -> tuple[int, int]:
        """Determinise one transition."""
        if self.last[state] + c not in self.pairs:
            entries = self.states[0]
        else:
            entries = self.states[state]
        if c not in self.children[0]:
            out = (0, len(c.encode()))
            self.moves[state][c] = out
            return out
        alive, found = [], None
        for node, before, count in entries:
            following = self.children[node].get(c)
            if following is None:
                continue
            alive.append((following, before, count))
            piece = self.piece[following]
            if found is None and piece is not None and self._fit(before, piece):
                found = (piece, count + 1)
        piece, change = found
        key = (*((node, before, count - change) for node, before, count in alive if self.children[node]), (0, piece, 0))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            self.last.append(c)
            self.moves.append({})
        self.moves[state][c] = (number, change)
        return number, change

    def run(self, state: int, text: str) -> tuple[int, int]:
        """The state after ``text`` and the tokens added on the way."""
        total, moves = 0, self.moves
        for c in text:
            step = moves[state].get(c)
            if step is None:
                step = self._add(state, c)
            state = step[0]
            total += step[1]
        return state, total

    def count(self, text: str) -> int:
        """Tokens of a text from the start state."""
        if len(self.states) > self.max_states:
            self.forget()
        return self.run(0, text)[1]

    def chunk(self, text: str) -> tuple[str, int | None, int]:
        """A chunk's map: its head up to a place no piece crosses, the rest's end state and count."""
        cut = next((i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.pairs), None)
        return (text, None, 0) if cut is None else (text[:cut], *self.run(0, text[cut:]))

    def compose(self, a: tuple[str, int | None, int], b: tuple[str, int | None, int]) -> tuple[str, int | None, int]:
        """The map of two neighbouring chunks; associative."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        state, more = self.run(a[1], b[0])
        return (a[0], state, a[2] + more) if b[1] is None else (a[0], b[1], a[2] + more + b[2])

    def count_chunks(self, text: str, size: int = CHUNK) -> int:
        """Tokens of a text from its chunks' maps."""
        if len(self.states) > self.max_states:
            self.forget()
        head, _, count = reduce(self.compose, (self.chunk(text[i : i + size]) for i in range(0, len(text), size)))
        return self.run(0, head)[1] + count


def load_pieces(path: str) -> dict[str, float]:
    """The scored pieces of a sentencepiece BPE model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    return {model.id_to_piece(i): model.get_score(i) for i in plain}


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """The transducer of this worker process."""
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(load_pieces(path))
    return _MACHINES[path]


def count_batch(values: pa.Array, counter: Transducer) -> np.ndarray:
    """Token counts of a batch of texts.

    Texts with single spaces inside are cut at them; each distinct run is
    counted once and a cumulative sum composes the runs' maps.  Other texts
    go through chunk maps one by one.
    """
    out = np.zeros(len(values), np.int64)
    odd = pc.match_substring_regex(values, "  |^ | $|" + SPACE)
    full = np.asarray(pc.binary_length(values)) > 0
    plain = np.flatnonzero(~np.asarray(odd) & full)
    for i in np.flatnonzero(np.asarray(odd) & full):
        out[i] = counter.count_chunks(SPACE + values[int(i)].as_py().replace(" ", SPACE))
    if len(plain):
        parts = pc.split_pattern(values.take(pa.array(plain)), " ")
        coded = parts.flatten().dictionary_encode()
        each = np.fromiter((counter.count(SPACE + x) for x in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        scan = np.concatenate(([0], np.cumsum(each[coded.indices.to_numpy()])))
        ends = parts.offsets.to_numpy()
        out[plain] = scan[ends[1:]] - scan[ends[:-1]]
    return out


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = machine(model_path)
        for batch in batches:
            for part in slices(batch, text_col):
                values = texts(part, text_col)
                n = count_batch(values, counter)
                yield pa.RecordBatch.from_pydict({id_col: part.column(id_col), "n_bytes": pc.binary_length(values).cast(pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    used = docs.select(id_col, text_col)
    kind = used.schema[id_col].dataType.simpleString()
    return used.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: piece_bpe_32k counts of all documents, limit 4096."""
    import public_tokenizers

    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))

"""Token counts of a unigram vocabulary by a count-only Viterbi pass over Aho-Corasick matches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import quoted
from .pieces import slices

#: What stands for a space at the start of a word (fixed value of the piece vocabulary).
MARK = "▁"
#: An unknown character's score lies that far below the worst piece's (fixed value of the unigram rule).
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 1_000_000
CACHE_CHARS = 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model, byte and control pieces included, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Number of pieces of a word's best segmentation.

    The automaton enumerates the vocabulary's matches by their end; the pass keeps for each end the best score and its
    number of pieces. A later match replaces an earlier one only with a strictly better score, and matches that
    end together are taken by ascending start, so of equal ones the longest last piece wins, as in the tokenizer.
    A character that no single-character piece covers may stand as an unknown one; neighbouring unknown ones are one,
    which counts a piece for each of its UTF-8 bytes (byte fallback).
    """

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.longest = max((len(p) for p, _ in vocab), default=1)
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in {p for p, _ in vocab} for b in range(256))
        self.cache: dict[str, int] = {}

    def count(self, word: str) -> int:
        # only as many ends as the longest piece are looked back at, so a word of any length takes as much memory
        size = self.longest + 1
        score, pieces = [0.0] * size, [0] * size  # pieces: without the unknown run that ends there
        run = [0] * size  # bytes of the unknown run that ends there
        matches = self.machine.iter(word)
        end_at, match = next(matches, (-1, None))
        for end in range(1, len(word) + 1):
            found = []
            while end_at == end - 1:
                found.append(match)
                end_at, match = next(matches, (-1, None))
            found.sort(reverse=True)  # longest first: ascending start
            best = None
            for length, s in found:
                total = score[(end - length) % size] + s
                if best is None or total > best[0]:
                    best = (total, length, True)
            if not found or found[-1][0] != 1:  # no piece covers the last character alone
                total = score[(end - 1) % size] + self.unknown
                if best is None or total > best[0]:
                    best = (total, 1, False)
            i, at = end % size, (end - best[1]) % size
            score[i] = best[0]
            if best[2]:
                pieces[i], run[i] = pieces[at] + self.closed(run[at]) + 1, 0
            else:
                pieces[i], run[i] = pieces[at], run[at] + len(word[end - 1].encode())
        i = len(word) % size
        return pieces[i] + self.closed(run[i])

    def closed(self, run: int) -> int:
        return (run if self.bytes else 1) if run else 0

    def text(self, text: str) -> int:
        """Spaces become marks, one mark is put in front, and each mark begins a word; an empty text has no pieces."""
        if not text:
            return 0
        text = text.replace(" ", MARK)
        words = (text if text[0] == MARK else MARK + text).split(MARK)[1:]
        get, total = self.cache.get, 0
        for w in words:
            n = get(w)
            if n is None:
                n = self.count(MARK + w)
                if len(w) <= CACHE_CHARS:
                    if len(self.cache) >= CACHE_WORDS:
                        self.cache.clear()
                    self.cache[w] = n
            total += n
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add n_tokens: the number of pieces of each whole text under the unigram vocabulary at `path`.

    Equal to len(encode(text)) of the tokenizers library's Unigram model with these pieces and scores, byte fallback and
    its Metaspace pre-tokenizer. A null or empty text has 0. Each row gives one row with its other columns; an n_tokens
    column of the input is replaced. No rows give no rows.
    """
    columns = [c for c in docs.columns if c.lower() != "n_tokens"]
    kept = [f"c{i}" for i in range(len(columns))]
    rows = docs.select(*map(quoted, columns), quoted(text)).toDF(*kept, "text")
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        own = counter(path)
        for batch in batches:
            column = batch.column(len(kept))
            for a, b in slices([len(x or "") for x in column.to_pylist()]):
                counts = [own.text(t or "") for t in column.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(kept))), pa.array(counts, pa.int64())], [*kept, "n_tokens"])

    return rows.mapInArrow(run, schema).toDF(*columns, "n_tokens")

"""Token counts of a unigram vocabulary by a Viterbi search that keeps counts only.

An Aho-Corasick automaton lists all vocabulary matches of a word; the search
carries, for each end, the best score and the number of pieces, no path.  The
vocabulary and its scores come from a public SentencePiece model file.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far below the worst piece an unknown character scores (a fixed value of unigram tokenizers).
UNKNOWN_PENALTY = 10.0
MARK = "▁"
#: Words whose counts a task remembers at a time.
REMEMBERED = 1 << 18


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a model file with their scores, in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class Counter:
    """Counts the pieces of words under a unigram vocabulary with byte fallback.

    Ties: of equal scores at one end the piece that starts first wins, so the
    longest.  A character without a piece of its own scores UNKNOWN_PENALTY
    below the worst piece and counts one piece for each UTF-8 byte if all bytes
    have pieces; else each run of such characters is one unknown piece.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {piece for piece, _ in pieces}
        self.byte_pieces = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Pieces of one word that the vocabulary search may not leave.

        Matches come by their end, the longest first, so an end is settled
        when the first match behind it turns up.
        """
        n = len(text)
        score, count, from_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best, pieces, single, settled = None, 0, False, 0
        for last, match in chain(self.automaton.iter(text), ((n, None),)):
            while settled < last:
                settled += 1
                lost = score[settled - 1] + self.unknown
                if single or best is not None and best >= lost:
                    score[settled], count[settled] = best, pieces
                else:
                    more = len(text[settled - 1].encode("utf-8", "replace")) if self.byte_pieces else int(not from_unknown[settled - 1])
                    score[settled], count[settled], from_unknown[settled] = lost, count[settled - 1] + more, True
                best, single = None, False
            if match is None:
                break
            size, gain = match
            single |= size == 1
            start = last + 1 - size
            if best is None or score[start] + gain > best:
                best, pieces = score[start] + gain, count[start] + 1
        return count[n]

    def text(self, text: str) -> int:
        """Pieces of a whole text: a mark in front, if no space stands there, and for each space; each mark starts a word."""
        if not text:
            return 0
        known, total = self.known, 0
        for word in text.replace(MARK, " ").removeprefix(" ").split(" "):
            n = known.get(word)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[word] = self.word(MARK + word)
            total += n
        return total


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """Number of tokens of every whole text of docs (doc_id, text, ...).

    model_path names a SentencePiece model on every executor, as installed
    tokenizer files are.  Returns doc_id, n_chars (code points) and n_tokens,
    both 0 for null and empty text.  A text that starts with a space gets no
    second mark.  Repeated rows stay; null doc_ids stay; an empty table gives
    an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(model_path))
        for batch in batches:
            texts = [v.as_py() or "" for v in batch.column(1)]
            counts = [counter.text(t) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, n_tokens long")

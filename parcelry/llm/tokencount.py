"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character of a word; dynamic programming carries
the best score and, with it, only the number of pieces. Among equal scores the piece that starts first (the longest)
stays, as the tokenizer does it. Characters that no piece covers cost the lowest score less 10 each and count
as their UTF-8 bytes where the vocabulary has byte pieces, else as one for each stretch of them.

Words are split at white space and begin with the mark U+2581, so a word's count doesn't depend on its neighbours;
each worker remembers the counts of at most REMEMBERED words of REMEMBERED_BYTES bytes or less. A word of any
length is searched in memory for the longest piece alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fenced, fenced_name

MARK = "▁"
UNKNOWN_COST = 10.0
REMEMBERED, REMEMBERED_BYTES = 300_000, 64
#: A vocabulary is broadcast; no public one is near this bound.
MOST_PIECES = 2_000_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file; control and unknown pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]


class PieceCounter:
    """Counts the pieces of words; pieces like <0x0A> stand for bytes."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.bytes = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in vocabulary}
        for piece, score in vocabulary:
            if piece and not (self.bytes and len(piece) == 6 and piece.startswith("<0x")):
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_COST
        self.longest = max((len(p) for p, _ in vocabulary), default=1)
        self.known: dict[bytes, int] = {}

    def word(self, word: str) -> int:
        """Pieces of MARK + word."""
        text = MARK + word
        size, ring = len(text), self.longest + 1
        # Only the last `longest` places can begin a piece: the search holds no more, however long the word.
        score, count, loose = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(text) if len(self.automaton) else iter(())
        match = next(matches, None)
        for end in range(1, size + 1):
            best, pieces, single = None, 0, False
            while match is not None and match[0] + 1 == end:
                length, value = match[1]
                single |= length == 1
                start = (end - length) % ring
                if best is None or score[start] + value > best:
                    best, pieces = score[start] + value, count[start] + 1
                match = next(matches, None)
            before, unknown = (end - 1) % ring, False
            if not single and (best is None or score[before] + self.unknown > best):
                more = len(text[end - 1].encode()) if self.bytes else int(not loose[before])
                best, pieces, unknown = score[before] + self.unknown, count[before] + more, True
            score[end % ring], count[end % ring], loose[end % ring] = best, pieces, unknown
        return count[size % ring]

    def text(self, text: str | None) -> int:
        known, total = self.known, 0
        for word in (text or "").encode().split():
            n = known.get(word)
            if n is None:
                n = self.word(word.decode())
                if len(word) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: Sequence[tuple[str, float]], text: str = "text") -> DataFrame:
    """docs with n_tokens (long).

    Null and empty texts have 0; repeated rows count alike; an empty table gives an empty one. A column of docs of that
    name is replaced, others of any name stay as they are.
    """
    if len(vocabulary) > MOST_PIECES:
        raise ValueError(f"a vocabulary of more than {MOST_PIECES} pieces isn't broadcast")
    spark: SparkSession = docs.sparkSession
    (inner, back), read = fenced(docs, ["n_tokens"]), fenced_name(docs, text)
    shared = spark.sparkContext.broadcast(list(vocabulary))
    fields = inner.schema.fields

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(shared.value)
        for batch in batches:
            found = [counter.text(t.as_py()) for t in batch.column(read)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*[f.name for f in fields], "n_tokens"])

    return back(inner.mapInArrow(count, T.StructType([*fields, T.StructField("n_tokens", T.LongType())])), "n_tokens")


def token_totals(counted: DataFrame, by: str = "source") -> DataFrame:
    """Documents, tokens and tokens per document of each value of `by`."""
    return counted.groupBy(by).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.avg("n_tokens").alias("mean_tokens"))

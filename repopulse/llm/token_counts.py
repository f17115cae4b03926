"""Token counts of a unigram tokenizer without its tokens.

The text is cut before every space, as the tokenizer does. For each part the
best-scoring segmentation into vocabulary pieces is found: an Aho-Corasick automaton
enumerates all matches by their end, and dynamic programming keeps, for every
position, the best score and how many pieces reach it. Ties go as in the tokenizer:
a later candidate has to be better, and at one end candidates come by rising start,
so the longest piece wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repopulse.llm.storage import checked

#: What an unknown character scores below the worst piece (a fixed value of unigram tokenizers), and the sign for a space.
UNKNOWN_PENALTY, SPACE = 10.0, "▁"
_KEPT, _LONGEST, _AT_ONCE = 700_000, 48, 8_000_000


@dataclass(frozen=True)
class UnigramVocabulary:
    """Pieces with scores; with ``byte_fallback`` an unknown character counts as its UTF-8 bytes, else a run of them as one."""

    pieces: Sequence[tuple[str, float]]
    byte_fallback: bool


def sentencepiece_vocabulary(path: str) -> UnigramVocabulary:
    """Pieces and scores of a SentencePiece model file, read as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(n)]
    return UnigramVocabulary(pieces, sum(model.is_byte(i) for i in range(n)) == 256)


class Counter:
    """Counts of one worker process; parts counted before are looked up."""

    def __init__(self, vocabulary: UnigramVocabulary) -> None:
        self._automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece:
                self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._unknown = min(s for _, s in vocabulary.pieces) - UNKNOWN_PENALTY
        self._bytes = vocabulary.byte_fallback
        self._kept: dict[str, int] = {}

    def part(self, text: str) -> int:
        """Pieces of the best segmentation of one part."""
        n = len(text)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0
        matches = self._automaton.iter(text)
        match = next(matches, None)
        while done < n:
            end = done + 1
            score, pieces, is_unknown, single = None, 0, False, False
            while match is not None and match[0] == done:
                length, value = match[1]
                start = end - length
                if score is None or best[start] + value > score:
                    score, pieces, is_unknown = best[start] + value, count[start] + 1, False
                single = single or length == 1
                match = next(matches, None)
            if not single and (score is None or best[done] + self._unknown > score):
                score, is_unknown = best[done] + self._unknown, True
                if self._bytes:
                    pieces = count[done] + len(text[done].encode("utf-8", "surrogatepass"))
                else:
                    pieces = count[done] + (not unknown[done])
            best[end], count[end], unknown[end] = score, pieces, is_unknown
            done = end
        return count[n]

    def counts(self, texts: pa.Array) -> np.ndarray:
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        out, start = [np.zeros(0, np.int64)], 0
        while start < len(texts):
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + _AT_ONCE)))
            out.append(self._batch(texts.slice(start, stop - start)))
            start = stop
        return np.concatenate(out)

    def _batch(self, texts: pa.Array) -> np.ndarray:
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        kept = self._kept
        found = list(map(kept.get, words))
        room = len(kept) < _KEPT
        for i, x in enumerate(found):
            if x is None:
                found[i] = self.part(SPACE + words[i])
                if room and len(words[i]) <= _LONGEST:
                    kept[words[i]] = found[i]
        own = np.array(found, np.int64)[codes]
        # A text that starts with a space, or is empty, has no part before it.
        heads = bounds[:-1]
        empty = pc.equal(split.flatten().take(pa.array(heads)), "").to_numpy(zero_copy_only=False)
        own[heads[empty]] = 0
        return np.add.reduceat(own, heads) if len(heads) else own


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: UnigramVocabulary) -> Iterator[pa.RecordBatch]:
    counter = Counter(vocabulary)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.counts(batch.column(1)))], ["doc_id", "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary: UnigramVocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every whole text, in one pass without a shuffle.

    A null or empty text has no token; null ids and repeated rows are kept; other
    columns are ignored; an empty table gives no rows.
    """
    rows = checked(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _counted(b, vocabulary), "doc_id long, n_tokens long")

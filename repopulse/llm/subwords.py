"""Encoding whole texts with the tokenizers library, pieces cached.

Documents repeat their words, and the library spends its time on merging the
same words again. A text is cut at single spaces between printable characters;
no token of a word-wise tokenizer spans such a place, so the ids of the parts,
each with its leading space, are the ids of the text. The library encodes every
part that was not seen before.
"""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters beside which a space is certainly a cut: printable ASCII and Latin letters, neither white space nor marks.
_SOLID = "!-~¡-¬®-ɏ"
_ORDINARY = re.compile(rf"[{_SOLID}](?:.*[{_SOLID}])?", re.DOTALL)
_CUT = re.compile(rf"(?<=[{_SOLID}]) (?=[{_SOLID}])")
#: A word and the signs behind it are tokens of their own, as long as there is no apostrophe.
_SIGNED = r"\A(?P<word>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<sign>[!-&(-/:-@\[-`{-~]+)\z"
#: Longer parts are not kept; how many parts are kept, and how many bytes of text are worked on at once.
_LONGEST, _KEPT, _AT_ONCE = 48, 600_000, 4_000_000


class Subwords:
    """One tokenizer file in one worker process.

    The file's pre-tokenizer has to be word-wise: a token either leaves a space
    out or takes it together with what follows.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._kept: dict[str, bytes] = {}
        # New parts are encoded as one text, between marks that always are a token of their own.
        for self._mark in ("\n", " |"):
            alone = self._tokenizer.encode(self._mark, add_special_tokens=False).ids
            if len(alone) == 1:
                self._mark_id = alone[0]
                break
        else:
            raise ValueError(f"{path} has no single token for a line end or a bar")

    def documents(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of consecutive texts, one after another, and how many each has, with
        ``end_id`` after each; nulls count as empty. One text at least at a time."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + _AT_ONCE)))
            yield self._batch(texts.slice(start, stop - start), end_id)
            start = stop

    def _batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        # The first part of a text has no space before it: an entry of its own.
        first, own = np.unique(codes[bounds[:-1]], return_inverse=True)
        heads = [words[i] for i in first.tolist()]
        ids, odd = self._looked_up(words, coded.dictionary)
        odd_texts = np.zeros(len(texts), bool)
        if odd:
            inner = np.ones(len(codes), bool)
            inner[bounds[:-1]] = False
            at = np.flatnonzero(inner & np.isin(codes, odd))
            odd_texts[np.searchsorted(bounds, at, side="right") - 1] = True
        odd_texts |= np.array([bool(x) and not _ORDINARY.fullmatch(x[-1]) for x in heads], bool)[own]
        codes[bounds[:-1]] = len(words) + own
        ids += self._encode(heads)
        # Texts with other white space are cut elsewhere; they make entries of their own.
        whole = np.flatnonzero(odd_texts)
        whole_code = len(ids) + np.arange(len(whole))
        ids += self._cut_elsewhere([texts[i].as_py() for i in whole.tolist()])
        end_code = len(ids)
        ids.append(np.array([end_id], self.dtype).tobytes())
        if len(whole):
            keep = ~np.repeat(odd_texts, np.diff(bounds))
            lengths = np.where(odd_texts, 1, np.diff(bounds))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            mixed = np.zeros(starts[-1], np.int64)
            single = np.repeat(odd_texts, lengths)
            mixed[~single], mixed[single] = codes[keep], whole_code
            codes, bounds = mixed, starts
        codes = np.insert(codes, bounds[1:], end_code)
        # Gather the ids of all parts; Arrow copies each part's bytes as a whole.
        taken = pa.array(ids, pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(codes) + 1)[1:] // self.dtype.itemsize
        found = np.frombuffer(taken.buffers()[2], self.dtype, int(ends[-1]) if len(ends) else 0)
        per_text = ends[bounds[1:] + np.arange(len(texts))]
        return found, np.diff(per_text, prepend=0)

    def _looked_up(self, words: list[str], array: pa.Array) -> tuple[list[bytes], list[int]]:
        """The ids of each part (``words`` and ``array`` are the same parts) with a space before
        it, and the places of parts beside which a space is no sure cut."""
        kept = self._kept
        ids = list(map(kept.get, words))
        missing = np.array([i for i, x in enumerate(ids) if x is None], np.int64)
        unseen = array.take(pa.array(missing))
        ordinary = pc.match_substring_regex(unseen, rf"(?s)\A[{_SOLID}](?:.*[{_SOLID}])?\z").to_numpy(zero_copy_only=False)
        halves = pc.extract_regex(unseen, _SIGNED)
        with_sign = halves.is_valid().to_numpy(zero_copy_only=False)
        odd = missing[~ordinary].tolist()
        for i in odd:
            ids[i] = b""
        plain = [words[i] for i in missing[ordinary & ~with_sign].tolist()]
        parts = halves.filter(pa.array(with_sign))
        signed = list(zip(missing[with_sign].tolist(), parts.field("word").to_pylist(), parts.field("sign").to_pylist(), strict=True))
        stems = [w for w in dict.fromkeys(w for _, w, _ in signed) if w not in kept]
        signs = list({s for _, _, s in signed})
        ends = dict(zip(signs, self._encode(signs), strict=True))
        new = dict(zip(plain + stems, self._encode([" " + x for x in plain + stems]), strict=True))
        for i, word, sign in signed:
            ids[i] = (kept.get(word) or new[word]) + ends[sign]
            new[words[i]] = ids[i]
        for i in missing[ordinary & ~with_sign].tolist():
            ids[i] = new[words[i]]
        if len(kept) < _KEPT:
            kept.update((k, v) for k, v in new.items() if len(k) <= _LONGEST and "\n" not in k)
        return ids, odd

    def _cut_elsewhere(self, texts: list[str]) -> list[bytes]:
        cut = [_CUT.split(x) for x in texts]
        words = list({y for x in cut for y in x[1:]})
        known = dict(zip(words, (self._kept.get(x) for x in words), strict=True))
        new = [x for x, ids in known.items() if ids is None]
        known.update(zip(new, self._encode([" " + x for x in new]), strict=True))
        heads = self._encode([x[0] for x in cut])
        return [head + b"".join(map(known.__getitem__, x[1:])) for x, head in zip(cut, heads, strict=True)]

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Each part as if it were a text of its own."""
        plain = [x for x in parts if x[:1] == " " and self._mark[-1] not in x]
        ids = self._tokenizer.encode_batch_fast(["".join(x + self._mark for x in plain)], add_special_tokens=False)[0].ids
        ids = np.array(ids, self.dtype)
        width, every = self.dtype.itemsize, ids.tobytes()
        ends = np.flatnonzero(ids == self._mark_id) * width
        found, begin = {}, 0
        for x, end in zip(plain, ends.tolist(), strict=True):
            found[x] = every[begin:end]
            begin = end + width
        rest = [x for x in parts if x not in found]
        for x, e in zip(rest, self._tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            found[x] = np.array(e.ids, self.dtype).tobytes()
        return [found[x] for x in parts]


_OPEN: dict[str, Subwords] = {}


def forget() -> None:
    """Close the tokenizers of this worker process and give its free memory back.

    A worker outlives its stages: the next one, which needs no tokenizer, calls this,
    or two hundred megabytes a worker lie beside its own."""
    _OPEN.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def subwords(path: str) -> Subwords:
    """The tokenizer of this worker process, opened once."""
    if path not in _OPEN:
        _OPEN[path] = Subwords(path)
    return _OPEN[path]

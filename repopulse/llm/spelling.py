"""Spelling variants: words one edit apart, by dense prefix-suffix tiles.

Two words are one edit apart exactly when their common prefix and common suffix
together reach the longer length minus one: all that is left is the edited place. The
longer length is cut into three segments. Words that agree outside of the segment
that the edit lies in are filed under one tile; sorted by tile, they become padded
matrices of code points, left- and right-aligned, whose blocks are compared
pair by pair. A pair counts in the tile of the segment where its common prefix ends,
so it counts once.

A tile may hold any number of words. It is cut into pieces of bounded size, which
meet in pairs spread over tasks; only counts and the best partner of a word leave
a piece, never its pairs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repopulse.llm.storage import checked, store

#: Segments of the longer word; a word is filed under each, as the longer and as the shorter one.
SEGMENTS = 3
#: Words of one block, words and code points of one piece, ways that pairs of pieces are spread.
_BLOCK, _PIECE, _CODES, _SALTS = 96, 4096, 1 << 20, 16
#: Filed words take a task for each this part of the rows of a file.
_FINER = 5
#: Runs of Latin letters (and the two signs between them).
RUNS = re.compile("[A-Za-zÀ-ÿ]+")
#: Characters of a text that are read at once, and words counted before they are passed on.
_WINDOW, _COUNTED = 4_000_000, 200_000


def windows(text: str, size: int = _WINDOW) -> Iterator[str]:
    """A text in windows of about ``size`` characters that no run crosses."""
    at = 0
    while len(text) - at > size:
        cut = RUNS.match(text, at + size)
        to = cut.end() if cut else at + size
        yield text[at:to]
        at = to
    yield text[at:]


def thinned(word: bytes, seed: int, one_in: int) -> bytes:
    """A lower-cased run with one code point left out if ``one_in`` divides the
    CRC-32 that ``seed`` has reached once the run is read too."""
    h = zlib.crc32(word, seed)
    if h % one_in:
        return word
    text = word.decode("utf-8", "surrogatepass")
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode("utf-8", "surrogatepass")


def _counted(batches: Iterator[pa.RecordBatch], one_in: int | None, least_length: int) -> Iterator[pa.RecordBatch]:
    """Texts to words and how often this task has met them, in bounded shares."""
    found: dict[bytes, int] = {}

    def out() -> pa.RecordBatch:
        words = [w.decode("utf-8", "surrogatepass") for w in found]
        counts = [n for w, n in zip(words, found.values(), strict=True) if len(w) >= least_length]
        words = [w for w in words if len(w) >= least_length]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            seed = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
            for window in windows(text.as_py()):
                own: dict[bytes, int] = {}
                for run in RUNS.findall(window):
                    own[run] = own.get(run, 0) + 1
                for run, n in own.items():
                    word = run.encode().lower()
                    if one_in:
                        word = thinned(word, seed, one_in)
                    found[word] = found.get(word, 0) + n
                if len(found) > _COUNTED:
                    yield out()
                    found.clear()
    yield out()


def count_words(
    docs: DataFrame, *, one_in: int | None = None, least_length: int = 6, least_n: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, n``: runs of Latin letters of all texts, A-Z lower-cased.

    Words of fewer than ``least_length`` code points or ``least_n`` occurrences are
    left out. With ``one_in`` the runs of a document whose CRC-32 of
    ``id:run`` it divides lose a code point first (a null id is empty). A null text
    has no words; repeated rows count again; other columns are ignored.
    """
    rows = checked(docs, id_col, text_col)
    partial = rows.mapInArrow(lambda b: _counted(b, one_in, least_length), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def filed(words: DataFrame) -> DataFrame:
    """Each word under the tile of each segment, as the longer and as the shorter of
    two: ``kind`` (longer length and segment), ``tile`` (hash of what lies outside)."""
    length = F.char_length("word")
    ways = words.select("word", "n", length.alias("length"), F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENTS - 1))).alias("way"))
    placed = ways.withColumns({"longer": F.col("length") + F.floor(F.col("way") / SEGMENTS).cast("int"), "segment": F.col("way") % SEGMENTS})
    before = F.floor(F.col("segment") * F.col("longer") / SEGMENTS).cast("int")
    after = F.col("longer") - F.floor((F.col("segment") + 1) * F.col("longer") / SEGMENTS).cast("int")
    outside = F.xxhash64(F.substring("word", F.lit(1), before), F.right(F.col("word"), after))
    return placed.select((F.col("longer") * SEGMENTS + F.col("segment")).cast("long").alias("kind"), outside.alias("tile"), "word", "n")


class Tile:
    """Words of one kind, in the order of their tiles, as matrices of code points."""

    def __init__(self, kind: int, tiles: np.ndarray, words: list[str], n: np.ndarray) -> None:
        self.longer, self.segment = divmod(kind, SEGMENTS)
        self.kind, self.tiles, self.words, self.n = kind, tiles, words, n
        self.lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(words)), self.lengths)
        within = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.left = np.zeros((len(words), self.longer), np.uint32)
        self.right = np.zeros((len(words), self.longer), np.uint32)
        self.left[row, within] = flat
        self.right[row, self.longer - 1 - (self.lengths[row] - 1 - within)] = flat

    def near(self, x: slice, other: Tile, y: slice) -> np.ndarray:
        """Which words of two blocks are one edit apart, counted in this segment."""
        equal = self.left[x, None] == other.left[None, y]
        prefix = np.argmin(equal, axis=2)
        suffix = np.argmin((self.right[x, None] == other.right[None, y])[:, :, ::-1], axis=2)
        a, b = self.lengths[x, None], other.lengths[None, y]
        low, high = self.segment * self.longer // SEGMENTS, (self.segment + 1) * self.longer // SEGMENTS
        own = (self.tiles[x, None] == other.tiles[None, y]) & (np.maximum(a, b) == self.longer) & (prefix >= low) & (prefix < high)
        return own & ~equal.all(2) & (prefix + suffix >= self.longer - 1)


class _Best:
    """For each word of a piece how many near words it has met, and the best one."""

    def __init__(self) -> None:
        self.rows: dict[str, list] = {}

    def meet(self, tile: Tile, i: int, other: Tile, j: int) -> None:
        for word, near, n in ((tile.words[i], other.words[j], int(other.n[j])), (other.words[j], tile.words[i], int(tile.n[i]))):
            own = self.rows.setdefault(word, [0, -n, near])
            own[0] += 1
            if (-n, near) < (own[1], own[2]):
                own[1], own[2] = -n, near

    def batch(self) -> pa.RecordBatch:
        rows = [(w, *x) for w, x in self.rows.items()]
        cells = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        self.rows = {}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["word", "near", "rank", "best"])


def compare_within(tile: Tile, best: _Best) -> None:
    """All pairs of blocks that a tile runs through."""
    edges = list(range(0, len(tile.words), _BLOCK))
    for at in edges:
        x = slice(at, min(at + _BLOCK, len(tile.words)))
        for to in range(at, len(tile.words), _BLOCK):
            if tile.tiles[to] != tile.tiles[x.stop - 1] and to != at:
                break
            y = slice(to, min(to + _BLOCK, len(tile.words)))
            for i, j in np.argwhere(tile.near(x, tile, y)).tolist():
                if at + i < to + j:
                    best.meet(tile, at + i, tile, to + j)


def compare_across(a: Tile, b: Tile, best: _Best) -> None:
    """All pairs of a word of ``a`` and one of ``b``, of one tile."""
    for at in range(0, len(a.words), _BLOCK):
        x = slice(at, min(at + _BLOCK, len(a.words)))
        for to in range(0, len(b.words), _BLOCK):
            y = slice(to, min(to + _BLOCK, len(b.words)))
            for i, j in np.argwhere(a.near(x, b, y)).tolist():
                best.meet(a, at + i, b, to + j)


_PIECES = "word string, near long, rank long, best string, kind long, tile long, no long, words array<string>, counts array<long>"


def _pieces(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (kind, tile, word, n) to near words inside pieces, and the words of the
    tiles that may go on beyond a piece: its first and its last one."""
    best = _Best()
    held: list[tuple[int, np.ndarray, list[str], np.ndarray]] = []
    rows = codes = 0

    def close() -> pa.RecordBatch:
        nonlocal held, rows, codes
        kind = held[0][0]
        tile = Tile(kind, np.concatenate([h[1] for h in held]), [w for h in held for w in h[2]], np.concatenate([h[3] for h in held]))
        held, rows, codes = [], 0, 0
        compare_within(tile, best)
        near = best.batch()
        ends = list(dict.fromkeys((int(tile.tiles[0]), int(tile.tiles[-1]))))
        spans = [np.flatnonzero(tile.tiles == t) for t in ends]
        # A word is filed once under a kind, so the first one names the piece, whatever task it is in.
        no = xxhash.xxh64_intdigest(f"{kind}:{tile.words[0]}".encode("utf-8", "surrogatepass")) >> 1
        none = [pa.nulls(len(ends), t) for t in near.schema.types]
        open_tiles = [
            pa.array([kind] * len(ends), pa.int64()),
            pa.array(ends, pa.int64()),
            pa.array([no] * len(ends), pa.int64()),
            pa.array([tile.words[s[0] : s[-1] + 1] for s in spans], pa.list_(pa.string())),
            pa.array([tile.n[s].tolist() for s in spans], pa.list_(pa.int64())),
        ]
        filled = [pa.concat_arrays([c, e]) for c, e in zip(near.columns, none, strict=True)]
        filled += [pa.concat_arrays([pa.nulls(near.num_rows, c.type), c]) for c in open_tiles]
        return pa.RecordBatch.from_arrays(filled, [x.split()[0] for x in _PIECES.split(", ")])

    for batch in batches:
        kind, tiles, n = (np.asarray(batch.column(i)) for i in (0, 1, 3))
        words = batch.column(2).to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(words)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            if held and held[0][0] != kind[at]:
                yield close()
            # Rows of one kind are about one length: so many fit into a piece.
            most = max(2, min(piece, _CODES // (int(kind[at]) // SEGMENTS)))
            while at < to:
                take = min(to - at, most - rows)
                held.append((int(kind[at]), tiles[at : at + take], words[at : at + take], n[at : at + take]))
                rows, at = rows + take, at + take
                if rows >= most:
                    yield close()
    if held:
        yield close()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best = _Best()
    for batch in batches:
        for row in range(batch.num_rows):
            kind, tile, a, an, b, bn = (batch.column(i)[row].as_py() for i in range(6))
            x, y = (Tile(kind, np.full(len(w), tile, np.int64), w, np.array(c, np.int64)) for w, c in ((a, an), (b, bn)))
            compare_across(x, y, best)
            yield best.batch()


def near_words(words: DataFrame, *, piece: int = _PIECE, most: int | None = None) -> DataFrame:
    """``word, n_near, best, best_n`` of the words of ``words`` (word, n; distinct) that have
    a near word: how many, and the one of largest n, of these the first in code-point order.
    ``piece`` is how many words of a tile are held at once. Of ``most`` words, where known, few
    take few tasks and files."""
    rows = filed(checked(words, "word", "n"))
    sorted_ = rows.repartitionByRange("kind", "tile", "word").sortWithinPartitions("kind", "tile", "word")
    found = store(sorted_.select("kind", "tile", "word", F.col("n").cast("long").alias("n")).mapInArrow(lambda b: _pieces(b, piece), _PIECES), "tiles", most and most * 2 * SEGMENTS * _FINER)
    # Most open tiles are whole: only those in two pieces or more go on, in pairs spread over salts.
    pieces = found.where("words is not null").select("kind", "tile", "no", "words", "counts")
    several = pieces.groupBy("kind", "tile").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1").select("kind", "tile")
    going = pieces.join(several, ["kind", "tile"], "left_semi")
    x = going.select("kind", "tile", F.col("no").alias("x"), F.col("words").alias("xw"), F.col("counts").alias("xn"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    y = going.select("kind", "tile", F.col("no").alias("y"), F.col("words").alias("yw"), F.col("counts").alias("yn"), (F.col("no") % _SALTS).cast("int").alias("salt"))
    pairs = x.join(y, ["kind", "tile", "salt"]).where("x < y").select("kind", "tile", "xw", "xn", "yw", "yn")
    across = pairs.mapInArrow(_across, "word string, near long, rank long, best string")
    met = found.where("word is not null").select("word", "near", "rank", "best").unionByName(across)
    best = met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("rank", "best")).alias("first"))
    return best.select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.rank")).alias("best_n"))


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """``word, root`` for the words of ``forms`` (word, form), ``most`` at most: where the chain of forms ends.
    Chains are halved in each round; n grows along them by a factor, so they are short."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = store(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", most)
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def spelling_groups(words: DataFrame, *, times: int = 5, piece: int = _PIECE) -> DataFrame:
    """Every word with its near words and the form it is a variant of:
    ``word, n, n_near, form, form_n, root``.

    ``words`` has distinct ``word`` and ``n``. The form is the near word of largest n, of
    these the first in code-point order, if that n is ``times`` the word's at
    least; else null. ``root`` is where forms end, the word itself without any. No
    words give no rows; a null or empty word comes back without near words.
    """
    words = store(checked(words, "word", "n"), "words")
    most = words.count()
    real = words.where(F.char_length("word") > 0)
    is_form = F.col("best_n") >= F.col("n") * F.lit(times)
    joined = words.join(near_words(real, piece=piece, most=most), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    joined = store(joined, "forms", most)
    roots = _roots(joined.where("form is not null").select("word", "form"), most)
    return joined.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

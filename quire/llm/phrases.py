"""Phrase collocations: phrases whose parts go together, per language.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
these into words ``[^\\x20\\x09]+``.  A candidate is a phrase of 2 to
``max_words`` words that stands at least ``least`` times inside pieces.  Its
score is the worst over its cuts of floor(10^6 a a / (l r)), with a, l and r
the counts of the phrase and of the two parts.

*Method* (direct-address tiling).

1. Each task writes its words as *chunks*: about ``chunk_words`` local word
   numbers of one language, with the list of distinct words and their counts.
   A chunk repeats the last words of its predecessor as uncounted context, so
   no phrase is lost at a cut, and long texts take many chunks.
2. Word counts are summed from these lists, which hold a word once a chunk;
   words that stand ``least`` times are ranked by frequency per language, and
   the rank is the word's id.  Other words and piece ends become 0: no
   candidate holds them.
3. Pairs (id of the first words, id of the next word) fall into tiles of
   ``TILE`` x ``TILE`` ids.  Frequent ids are small, so the mass lies in few
   tiles: a tile with many pairs is counted by one dense ``bincount`` over
   its cells; the pairs of all other tiles are sorted COO codes with counts.
   Tasks add up before they send.  What is sent goes to buckets by sub-tile
   (``SUB`` cells), so that a hot tile is split over many tasks, and a bucket
   is merged in steps of bounded size.
4. Frequent pairs are ranked again, and the rank replaces the id of the first
   words; steps 3 and 4 repeat for three words and more.  A chunk only asks
   for pairs that a fixed-size bitmap lets through (it never holds back a
   frequent one).

Everything after that is joins between tables of frequent phrases.

*Bounds.*  Ids, words and phrases are joined, never broadcast; the only
broadcast is the bitmap of at most 32 MB.  An id of first words may reach
2^33, that of a word 2^30, per language; beyond that the task raises.
Products are decimals of 38 digits, exact for counts below 10^15.

*Defined results.*  Null texts are empty; the null language is ``und``.
Rows are counted as often as they come.  A language without a candidate has
no rows; an empty table gives an empty result.  Columns other than language
and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.bitmap import bits_for, has, of_column
from quire.llm.common import UPPER, arrow_batches, col, text_bytes
from quire.llm.prefix import running_sum
from quire.session import cut_lineage, drop_written

TILE = 10  # bits of an id inside a tile: 2^10 x 2^10 cells
SUB = 12  # bits of a cell inside a sub-tile
FIRST_BITS, WORD_BITS = 33, 30
DENSE = 1 << (2 * TILE - 4)  # pairs of a tile from which it is counted densely
HELD = 1 << 19  # codes that are held before they are merged
WINDOW = 1 << 18  # bytes of text that are split at a time

ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(UPPER.encode() + ENDS + b"\t", UPPER.lower().encode() + b"\n" * len(ENDS) + b" ")


# ---------------------------------------------------------------- chunks


def windows(data: bytes, size: int) -> Iterator[bytes]:
    """Folded text in parts of about ``size`` bytes, cut before a blank or piece end."""
    start = 0
    while len(data) - start > size:
        end = max(data.rfind(b" ", start + 1, start + size), data.rfind(b"\n", start + 1, start + size))
        if end < 0:  # one word fills the window
            later = [x for x in (data.find(b" ", start + size), data.find(b"\n", start + size)) if x >= 0]
            end = min(later, default=len(data))
        yield data[start:end]
        start = end
    yield data[start:]


class Chunk:
    """Word numbers of one language; 0 is the end of a piece, 1 an empty word (never kept)."""

    def __init__(self, before: list[bytes]):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[b"\n"], self.number[b""]
        self.parts, self.size, self.skip = [], 0, len(before)
        self.add(before)

    def add(self, words: list[bytes]) -> None:
        ids = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        ids = ids[ids != 1]
        self.parts.append(ids)
        self.size += len(ids)

    def close(self, context: int):
        """The chunk's row, and the words that its successor repeats."""
        ids, words = np.concatenate(self.parts), list(self.number)
        tail = [words[i] for i in ids[max(0, len(ids) - context) :].tolist()]
        local = np.maximum(ids - 1, 0).astype("<i4")
        counts = np.bincount(local[self.skip :], minlength=len(words) - 1)[1:]
        return (self.skip, int(counts.sum()), [w.decode() for w in words[2:]], counts, local.tobytes()), tail


CHUNK = "chunk long, lang string, skip int, n long, words array<string>, counts array<long>, local binary"


def _chunks(chunk_words: int, context: int):
    def run(batches):
        number = TaskContext.get().partitionId() << 40
        open_: dict[str, Chunk] = {}

        def row(lang):
            nonlocal number
            number += 1
            (skip, n, words, counts, local), tail = open_.pop(lang).close(context)
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.array([skip], pa.int32()), pa.array([n], pa.int64()),
                    pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([local], pa.binary()),
                ],
                ["chunk", "lang", "skip", "n", "words", "counts", "local"],
            )
            return batch, tail

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                for part in windows(text.translate(_FOLD), WINDOW):
                    held = open_.get(lang) or open_.setdefault(lang, Chunk([]))
                    held.add(part.replace(b"\n", b" \n ").split(b" "))
                    if held.size >= chunk_words:
                        out, tail = row(lang)
                        yield out
                        open_[lang] = Chunk(tail)
                open_[lang].add([b"\n"])
                if sum(c.size for c in open_.values()) >= 4 * chunk_words:
                    for other in list(open_):
                        yield row(other)[0]
        for lang in list(open_):
            yield row(lang)[0]

    return run


def chunked(docs: DataFrame, lang_col: str, text_col: str, chunk_words: int, context: int) -> DataFrame:
    rows = docs.select(F.coalesce(col(lang_col), F.lit("und")).alias("lang"), col(text_col).alias("text"))
    return rows.mapInArrow(_chunks(chunk_words, context), CHUNK)


# ---------------------------------------------------------------- ids


def _found(batch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, keys and ids of a column array<struct<key, id>>; a null is an empty array."""
    lists = batch.column(name)
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    flat = lists.flatten()
    return at, flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)


def _numbers(cell: pa.Scalar, kind="<i8") -> np.ndarray:
    """The numbers of a binary cell, without a copy."""
    return np.frombuffer(cell.as_buffer(), kind)


def _packed(ids: np.ndarray) -> bytes:
    """Ids in four bytes each, or in eight if one needs them."""
    return ids.astype("<i4" if not len(ids) or int(ids.max()) < 1 << 31 else "<i8").tobytes()


# ``words`` has four bytes an id; ``firsts`` four or eight, and is null while
# the first words are the words themselves
IDS = "chunk long, lang string, skip int, words binary, firsts binary"


def _id_rows(batch):
    """(chunk, lang, skip, words, firsts) of each row."""
    for chunk, lang, skip, words, firsts in zip(*(batch.column(c) for c in ("chunk", "lang", "skip", "words", "firsts"))):
        w = f = _numbers(words, "<i4").astype(np.int64)
        if firsts.is_valid:
            wide = len(firsts.as_buffer()) > 4 * len(w)
            f = _numbers(firsts, "<i8" if wide else "<i4").astype(np.int64)
        yield chunk.as_py(), lang.as_py(), skip.as_py(), w, f


def _id_batch(batch, i: int, words: np.ndarray, firsts: np.ndarray | None):
    """One row, so that no batch holds many chunks."""
    kept = [batch.column(c).slice(i, 1) for c in ("chunk", "lang", "skip")]
    if len(words) and int(words.max()) >> WORD_BITS:
        raise ValueError("too many frequent words of one language")
    first = None if firsts is None else _packed(firsts)
    return pa.RecordBatch.from_arrays([*kept, pa.array([words.astype("<i4").tobytes()], pa.binary()), pa.array([first], pa.binary())], ["chunk", "lang", "skip", "words", "firsts"])


def _word_ids(batches):
    """Local word numbers become ids; words that are no candidate's become 0."""
    for batch in batches:
        at, place, ids = _found(batch, "found")
        for i, (local, size) in enumerate(zip(batch.column("local"), batch.column("size").to_pylist())):
            table = np.zeros(size + 1, np.int64)
            mine = slice(at[i], at[i + 1])
            table[place[mine] + 1] = ids[mine]
            yield _id_batch(batch, i, table[_numbers(local, "<i4")], None)


def pair_code(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Tile and cell of a pair of ids, as one number that sorts by tile, then cell."""
    if len(first) and (int(first.max()) >> FIRST_BITS or int(word.max()) >> WORD_BITS):
        raise ValueError("too many frequent phrases of one language for a pair code")
    low = (1 << TILE) - 1
    tile = (first >> TILE) << (WORD_BITS - TILE) | word >> TILE
    return tile << 2 * TILE | (first & low) << TILE | word & low


def pair_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, tile = (1 << TILE) - 1, code >> 2 * TILE
    first = (tile >> (WORD_BITS - TILE)) << TILE | code >> TILE & low
    return first, (tile & ((1 << (WORD_BITS - TILE)) - 1)) << TILE | code & low


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash whose leading bits depend on all bits of x."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _codes(w: np.ndarray, f: np.ndarray, skip: int, longer: bool) -> np.ndarray:
    """Codes of the pairs (first words ending before p, word at p) for p >= skip.

    ``longer``: the first words are several, so that the phrase without its
    first word ends at p too, and must be frequent like the first words.
    """
    first, word = f[:-1], w[1:]
    ok = (first > 0) & (word > 0)
    if longer:
        ok &= f[1:] > 0
    ok[: max(skip - 1, 0)] = False
    return pair_code(first[ok], word[ok])


# ---------------------------------------------------------------- counts


def merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted COO: equal codes become one, their counts are added."""
    code, count = np.concatenate(codes), np.concatenate(counts)
    by = np.argsort(code, kind="stable")
    code, count = code[by], count[by]
    first = np.flatnonzero(np.concatenate([[len(code) > 0], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(count, first) if len(first) else count


def tiled(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their counts: dense tiles by bincount, the rest sorted."""
    tile = codes >> 2 * TILE
    names, sizes = np.unique(tile, return_counts=True)
    out, counts = [], []
    rest = np.ones(len(codes), bool)
    for name in names[sizes >= DENSE].tolist():
        here = tile == name
        cells = np.bincount(codes[here] & ((1 << 2 * TILE) - 1), minlength=1 << 2 * TILE)
        cell = np.flatnonzero(cells)
        out.append(name << 2 * TILE | cell)
        counts.append(cells[cell])
        rest &= ~here
    sparse, n = np.unique(codes[rest], return_counts=True)
    return np.concatenate([*out, sparse]), np.concatenate([*counts, n])


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the greatest needs."""
    kinds = ("<u1", "<u2", "<u4", "<i8")
    return counts.astype(next(k for k in kinds if int(counts.max()) <= np.iinfo(k).max)).tobytes()


def _wide(cell: pa.Scalar, n: int) -> np.ndarray:
    """The n counts that ``_narrow`` wrote."""
    kind = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[len(cell.as_buffer()) // n]
    return _numbers(cell, kind).astype(np.int64)


def _partial(buckets: int, longer: bool):
    """Counted pairs of a task, cut into buckets by sub-tile."""

    def rows(lang, codes, counts):
        code, count = merge(codes, counts)
        bucket = (mixed(code >> SUB) >> np.uint64(32)) % np.uint64(buckets)
        by = np.argsort(bucket, kind="stable")
        code, count, bucket = code[by], count[by], bucket[by]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(code) else np.zeros(1, np.int64)
        spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
        if spans:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(spans), pa.string()),
                    pa.array(bucket[cut[:-1]].astype(np.int32), pa.int32()),
                    pa.array([code[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([_narrow(count[a:b]) for a, b in spans], pa.binary()),
                ],
                ["lang", "bucket", "codes", "counts"],
            )

    def run(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for _, lang, skip, words, firsts in _id_rows(batch):
                codes, counts = held.setdefault(lang, [[], []])
                for out, part in zip((codes, counts), tiled(_codes(words, firsts, skip, longer))):
                    out.append(part)
                if sum(len(c) for cs, _ in held.values() for c in cs) >= HELD:
                    for name, parts in held.items():
                        yield from rows(name, *parts)
                    held = {}
        for name, parts in held.items():
            yield from rows(name, *parts)

    return run


PAIR = "lang string, i long, j long, a long, code long, h long"


def _merged(least: int):
    """Buckets, sorted by language and number, become pairs that stand ``least`` times."""

    def pairs(lang, codes, counts):
        code, count = merge(codes, counts)
        code, count = code[count >= least], count[count >= least]
        first, word = pair_of(code)
        columns = [pa.array([lang] * len(code), pa.string()), *(pa.array(x, pa.int64()) for x in (first, word, count, code, mixed(code).view(np.int64)))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "i", "j", "a", "code", "h"])

    def run(batches):
        now, codes, counts, size, after = None, [], [], 0, HELD
        for batch in batches:
            for lang, bucket, code, count in zip(*(batch.column(c) for c in ("lang", "bucket", "codes", "counts"))):
                lang, bucket = lang.as_py(), bucket.as_py()
                if now != (lang, bucket):
                    if now:
                        yield pairs(now[0], codes, counts)
                    now, codes, counts, size, after = (lang, bucket), [], [], 0, HELD
                codes.append(_numbers(code))
                counts.append(_wide(count, len(codes[-1])))
                size += len(codes[-1])
                if size >= after:
                    code, count = merge(codes, counts)
                    codes, counts, size, after = [code], [count], len(code), len(code) + HELD
        if now:
            yield pairs(now[0], codes, counts)

    return run


def frequent_pairs(ids: DataFrame, least: int, buckets: int, longer: bool) -> DataFrame:
    """(lang, i, j, a, code, hash) of the pairs of first words and next word that stand ``least`` times."""
    sent = ids.mapInArrow(_partial(buckets, longer), "lang string, bucket int, codes binary, counts binary")
    parts = max(buckets, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sent.repartition(parts, "lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(_merged(least), PAIR)


def ranked(df: DataFrame, ties: list[str], name: str) -> DataFrame:
    """Adds ``id``: 1 for the most frequent row of each language, and so on."""
    rows = df.withColumn("rare", -F.col("a")).withColumn("one", F.expr("1L"))
    rows = running_sum(rows, ["lang"], ["rare", *ties], "one", "id").withColumn("id", (F.col("id") + 1).cast("long"))
    return cut_lineage(rows.drop("rare", "one"), name)


# ---------------------------------------------------------------- next level


def _asked(held, longer: bool):
    """Distinct pairs of each chunk that the bitmap does not rule out."""

    def run(batches):
        for batch in batches:
            for chunk, lang, _, words, firsts in _id_rows(batch):
                code = np.unique(_codes(words, firsts, 0, longer))
                code = code[has(held.value, mixed(code))]
                columns = [pa.array([chunk] * len(code), pa.int64()), pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "lang", "code"])

    return run


def _next_firsts(longer: bool):
    """The ids of the phrases that end at each place replace those of one word less."""

    def run(batches):
        for batch in batches:
            at, key, ids = _found(batch, "found")
            for i, (_, _, _, w, f) in enumerate(_id_rows(batch)):
                new = np.zeros(len(w), np.int64)
                mine = slice(at[i], at[i + 1])
                by = np.argsort(key[mine])
                known, name = key[mine][by], ids[mine][by]
                place = np.flatnonzero((f[:-1] > 0) & (w[1:] > 0))
                if len(known) and len(place):
                    code = pair_code(f[place], w[place + 1])
                    hit = np.minimum(np.searchsorted(known, code), len(known) - 1)
                    new[place + 1] = np.where(known[hit] == code, name[hit], 0)
                yield _id_batch(batch, i, w, new)

    return run


def gathered(rows: DataFrame, key: str) -> DataFrame:
    """(chunk, found): the ids of a chunk's entries, as many as it has distinct ones."""
    return rows.groupBy("chunk").agg(F.collect_list(F.struct(F.col(key).cast("long").alias("key"), "id")).alias("found"))


def longer_ids(ids: DataFrame, pairs: DataFrame, longer: bool) -> DataFrame:
    spark = ids.sparkSession
    bitmap = of_column(pairs, F.col("h"), bits_for(pairs.count()))
    asked = ids.mapInArrow(_asked(spark.sparkContext.broadcast(bitmap), longer), "chunk long, lang string, code long")
    found = gathered(asked.join(pairs.select("lang", "code", "id"), ["lang", "code"]), "code")
    out = cut_lineage(ids.join(found, "chunk", "left").mapInArrow(_next_firsts(longer), IDS), "ids")
    drop_written(ids)
    return out


# ---------------------------------------------------------------- phrases


def phrase_counts(
    docs: DataFrame,
    least: int = 10,
    max_words: int = 3,
    lang_col: str = "lang",
    text_col: str = "text",
    chunk_words: int = 1 << 18,
) -> tuple[list[DataFrame], DataFrame]:
    """Tables of frequent phrases of 1 to ``max_words`` words, and (lang, n).

    Columns: lang; id; i (id of the phrase without its last word) and suf (id
    without its first word), both among the phrases of one word less; j (id
    of the last word); a (count); words; heads and tails (counts of all
    proper beginnings and ends, by the cut).
    """
    if max_words < 2 or least < 1:
        raise ValueError("phrases have two words or more, and stand at least once")
    with arrow_batches(docs.sparkSession, "8m"):  # a chunk's row has some megabytes
        return _phrase_counts(docs, least, max_words, lang_col, text_col, chunk_words)


def _phrase_counts(docs: DataFrame, least: int, max_words: int, lang_col: str, text_col: str, chunk_words: int):
    spark = docs.sparkSession
    chunks = cut_lineage(chunked(docs, lang_col, text_col, chunk_words, max_words - 1), "chunks")
    entry = F.posexplode(F.arrays_zip("words", "counts")).alias("place", "e")
    entries = chunks.select("chunk", "lang", entry).select("chunk", "lang", "place", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    words = entries.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    words = ranked(words, ["word"], "words")
    found = gathered(entries.join(words.select("lang", "word", "id"), ["lang", "word"]), "place")
    local = chunks.select("chunk", "lang", "skip", F.size("words").alias("size"), "local").join(found, "chunk", "left")
    ids = cut_lineage(local.mapInArrow(_word_ids, IDS), "ids")
    totals = cut_lineage(chunks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    drop_written(chunks)
    # a bucket per 2^22 words, so that a bucket's codes stay small at any size
    buckets = max(1, int((totals.agg(F.sum("n")).first()[0] or 0) >> 22))
    buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    none = F.expr("cast(array() as array<bigint>)")
    levels = [words.select("lang", "id", F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("suf"), F.lit(None).cast("long").alias("j"), "a", F.array("word").alias("words"), none.alias("heads"), none.alias("tails"))]
    for m in range(2, max_words + 1):
        pairs = ranked(frequent_pairs(ids, least, buckets, m > 2), ["i", "j"], "pairs")
        levels.append(cut_lineage(described(pairs, levels), "phrases"))
        if m < max_words:
            ids = longer_ids(ids, pairs, m > 2)
    return levels, totals


def described(pairs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Counted pairs as phrases: words, beginnings and ends from the tables below."""
    below = levels[-1]
    head = below.select(F.col("lang"), F.col("id").alias("i"), F.col("suf").alias("mid"), F.col("words").alias("hw"), F.concat("heads", F.array("a")).alias("heads"))
    rows = pairs.select("lang", "id", "i", "j", "a").join(head, ["lang", "i"])
    if len(levels) == 1:
        tail = below.select("lang", F.col("id").alias("j"), F.col("id").alias("suf"), "words", F.array("a").alias("tails"))
        rows = rows.join(tail, ["lang", "j"])
    else:
        tail = below.select("lang", F.col("i").alias("mid"), "j", F.col("id").alias("suf"), "words", F.concat(F.array("a"), "tails").alias("tails"))
        rows = rows.join(tail, ["lang", "mid", "j"])
    return rows.select("lang", "id", "i", "suf", "j", "a", F.concat("hw", F.slice("words", -1, 1)).alias("words"), "heads", "tails")


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a a / (l r)) without rounding: 38 digits hold every product."""
    d = [x.cast("decimal(20,0)") for x in (a, left, right)]
    top, low = (d[0] * d[0]).cast("decimal(32,0)"), (d[1] * d[2]).cast("decimal(38,0)")
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", (top * million).cast("decimal(38,0)"), low)


def collocations(
    docs: DataFrame,
    least: int = 10,
    max_words: int = 3,
    share: int = 50,
    top: int = 2000,
    lang_col: str = "lang",
    text_col: str = "text",
    chunk_words: int = 1 << 18,
) -> DataFrame:
    """Each language's ``top`` candidates: lang, rank, phrase, a, l, r, n, score.

    A candidate goes if a longer one holds its words and stands in at least
    ``share`` percent of its places; as a longer phrase is never more frequent
    than one of its parts, looking one word further suffices.
    """
    levels, totals = phrase_counts(docs, least, max_words, lang_col, text_col, chunk_words)
    parts = None
    for m, level in enumerate(levels[1:], 2):
        rows = level
        if m < max_words:
            above = levels[m]
            inside = above.select("lang", F.col("i").alias("id"), "a").unionAll(above.select("lang", "suf", "a"))
            most = inside.groupBy("lang", "id").agg(F.max("a").alias("most"))
            rows = rows.join(most, ["lang", "id"], "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True)))
        cuts = [
            F.struct(exact_score(F.col("a"), F.col("heads")[k], F.col("tails")[k]).alias("score"), F.lit(k).alias("k"), F.col("heads")[k].alias("l"), F.col("tails")[k].alias("r"))
            for k in range(m - 1)
        ]
        rows = rows.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.array_min(F.array(*cuts)).alias("cut"))
        parts = rows if parts is None else parts.unionAll(rows)
    rows = parts.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # the best of each part of a language first: no task sees a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(16))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)))
    rows = rows.where(F.col("rank") <= top).drop("part")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.join(totals, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))

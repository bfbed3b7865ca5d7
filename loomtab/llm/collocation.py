"""Phrase collocation mining: n-grams counted in HAT-tries, scored by how much their parts expect them.

A task numbers the words it meets and packs a phrase of up to three word ids into one integer, so that
integers sort as a trie over word ids does.  A ``HatTrie`` is kept flat: the sorted prefixes at which its
containers begin, and the containers, hash tables of a size that caches hold.  A container that grows
beyond ``BURST`` phrases bursts at a word boundary: of the first word if that halves it roughly, of the
second or third if a single word fills it.  When a task's tries hold more than ``HELD`` phrases, whole
subtrees, the largest first, are spilled as runs sorted by phrase until half is left; what is left at a
task's end, or when the word table is full, goes the same way.  A run is cut into cells by the hash of
a phrase's first two words (the third deals it to one of ``SLOTS`` neighbouring cells, so that a pair
that everything follows isn't one cell's) and compressed; a cell's runs meet in one task, which adds
them up.  The number of cells follows the size of the texts.

Only phrases of at least ``least`` occurrences go on: parts of a candidate are at least as frequent as
the candidate itself, so they are all among them.

Defined cases: null texts are empty, a null language is ``und``; only A-Z are lower-cased; pieces end
at ``.,;:!?`` and U+000A to U+000D, words at spaces and tabs; rows are counted whatever their doc_id is,
copies as often as they come; languages without candidates have no rows; an empty table gives none;
extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import give_back, mix, pieces, span_hashes, written

CHUNK_CHARS, CHUNK_WORDS = 500_000, 100_000
#: Bits of a word id in a packed phrase; a task's word table is given up before it has so many words, or bytes.
ID_BITS, WORD_BYTES = 20, 64 << 20
#: Phrases in a container before it bursts, in a task's tries before subtrees are spilled, and in a merge before equal ones are added up.
BURST, HELD, MERGED = 1 << 15, 2_000_000, 4_000_000
#: Phrases of a language that wait before they go into containers together, and phrases of a run at most.
WAITING, RUN = 400_000, 1_000_000
#: Languages whose tries a task holds.
HELD_LANGS = 32
#: Bytes of text that a cell stands for; cells and tasks at most; neighbouring cells of one pair of words.
CELL_BYTES, MOST_CELLS, MOST_TASKS, SLOTS = 8 << 20, 1 << 18, 1 << 15, 16
#: Parts of one word are dealt so many times, as many candidates may begin or end with one word.
SALTS = 8

_ID = (1 << ID_BITS) - 1
_BREAK = b"\xff"  # no byte of UTF-8
_CLASSES = bytearray(range(256))
for _b in range(65, 91):
    _CLASSES[_b] = _b + 32
for _b in b".,;:!?\n\x0b\x0c\r":
    _CLASSES[_b] = 10
_CLASSES[9] = 32


# --- the trie -----------------------------------------------------------------------------------------


class Container:
    """Hash table of packed phrases (above 0) and counts, with open addressing, filled many at a time."""

    def __init__(self, keys: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.used = 0
        self.keys, self.counts = np.zeros(256, np.int64), np.zeros(256, np.int64)
        if keys is not None:
            self.add(keys, counts)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys`` are distinct."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.items()
            size = 1 << int(2 * (self.used + len(keys))).bit_length()
            self.keys, self.counts, self.used = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
            self._put(*old)
        self._put(keys, counts)

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        last = len(self.keys) - 1
        at = (mix(keys.view(np.uint64)) >> np.uint64(32)).astype(np.int64) & last
        while len(keys):
            there = self.keys[at]
            same = there == keys
            self.counts[at[same]] += counts[same]
            free = there == 0
            self.keys[at[free]] = keys[free]  # of several that want a slot, one gets it
            won = free & (self.keys[at] == keys)
            self.counts[at[won]] = counts[won]
            self.used += int(np.count_nonzero(won))
            rest = ~(same | won)
            at, keys, counts = (at[rest] + 1) & last, keys[rest], counts[rest]

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        full = self.keys > 0
        return self.keys[full], self.counts[full]


class HatTrie:
    """Containers by the prefix at which each begins; phrases of a container are below the next one's prefix."""

    def __init__(self):
        self.starts, self.containers = np.zeros(1, np.int64), [Container()]
        self.waiting: list[np.ndarray] = []

    @property
    def used(self) -> int:
        return sum(c.used for c in self.containers)

    def add(self, grams: np.ndarray) -> None:
        """Phrases wait until there are enough to fill many slots of a container at a time."""
        self.waiting.append(grams)
        if sum(map(len, self.waiting)) > WAITING:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        keys, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting = []
        ends = [*np.searchsorted(keys, self.starts).tolist(), len(keys)]
        grown = False
        for c, a, b in zip(self.containers, ends, ends[1:]):
            if a < b:
                c.add(keys[a:b], counts[a:b])
                grown |= c.used > BURST
        if grown:
            self._burst()

    def _burst(self) -> None:
        starts, containers = [], []
        todo = list(zip(self.starts.tolist(), self.containers))[::-1]
        while todo:
            start, c = todo.pop()
            if c.used <= BURST:
                starts.append(start), containers.append(c)
                continue
            keys, counts = c.items()
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            at = boundary(keys)
            todo += [(int(keys[at]), Container(keys[at:], counts[at:])), (start, Container(keys[:at], counts[:at]))]
        self.starts, self.containers = np.array(starts, np.int64), containers

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Give back the phrases of the largest subtrees, until at most ``keep`` phrases are left."""
        self.settle()
        left = self.used
        for i in sorted(range(len(self.containers)), key=lambda i: -self.containers[i].used):
            if left <= keep:
                break
            left -= self.containers[i].used
            if self.containers[i].used:
                yield self.containers[i].items()
            self.containers[i] = Container()


def boundary(keys: np.ndarray) -> int:
    """Where to cut sorted phrases: near the middle, between first words if no side is left with under an eighth, else further down."""
    for shift in (2 * ID_BITS, ID_BITS):
        prefix = keys >> shift
        cuts = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
        if len(cuts):
            at = int(cuts[np.argmin(np.abs(cuts - len(keys) // 2))])
            if min(at, len(keys) - at) * 8 >= len(keys):
                return at
    return len(keys) // 2


class Words(dict):
    """Ids of words in the order they are met; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_BREAK: 0})
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        self.bytes += len(word)
        return i

    def full(self) -> bool:
        return len(self) + CHUNK_WORDS + 2 > _ID or self.bytes > WORD_BYTES


def words_of(texts: Iterable[str]) -> list[bytes]:
    """Lower-cased words of all texts, with ``_BREAK`` after each piece."""
    data = b"\n".join([*(t.encode("utf-8", "surrogatepass") for t in texts), b""])
    return data.translate(bytes(_CLASSES)).replace(b"\n", b" " + _BREAK + b" ").split()


def packed(ids: np.ndarray, longest: int) -> np.ndarray:
    """Packed phrases of one to ``longest`` words that end behind the first two ids."""
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    grams = [c[c > 0] << 2 * ID_BITS]
    if longest > 1:
        grams.append((b << 2 * ID_BITS | c << ID_BITS)[(b > 0) & (c > 0)])
    if longest > 2:
        grams.append((a << 2 * ID_BITS | b << ID_BITS | c)[(a > 0) & (b > 0) & (c > 0)])
    return np.concatenate(grams)


# --- runs ---------------------------------------------------------------------------------------------

RUNS = "cell int, lang string, phrases binary, counts binary"
_RUN_TYPES = [pa.int32(), pa.string(), pa.binary(), pa.binary()]


class Runs:
    """Sorted, compressed runs of phrases, cut into cells, as they are spilled."""

    def __init__(self, words: Words, cells: int):
        own = list(words)
        own[0] = b""
        self.words, self.cells = pa.array(own, pa.binary()), cells
        ends = np.asarray(self.words.buffers()[1]).view(np.int32)[: len(own) + 1].astype(np.int64)
        data = np.frombuffer(self.words.buffers()[2] or b"", np.uint8)
        self.hashes = span_hashes(data, ends[:-1], ends[1:])
        self.hashes[0] = 0
        self.rank = np.empty(len(own), np.int64)
        self.rank[np.asarray(pc.array_sort_indices(self.words))] = np.arange(len(own))

    def batch(self, lang: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ids = [keys >> 2 * ID_BITS, keys >> ID_BITS & _ID, keys & _ID]
        h, rank = self.hashes, self.rank
        slot = (h[ids[2]] >> np.uint64(60)) % np.uint64(SLOTS)
        cell = (mix(mix(h[ids[0]] + np.uint64(1)) + h[ids[1]]) + slot) % np.uint64(self.cells)
        # by phrase, then stably by cell, which is a radix sort for small numbers
        order = np.argsort(rank[ids[0]] << 2 * ID_BITS | rank[ids[1]] << ID_BITS | rank[ids[2]])
        order = order[np.argsort(cell[order].astype(np.uint16 if self.cells <= 1 << 16 else np.int64), kind="stable")]
        cell, counts = cell[order].astype(np.int64), counts[order]
        parts = [self.words.take(pa.array(i[order], mask=i[order] == 0)) for i in ids]
        lines = pc.binary_join_element_wise(pc.binary_join_element_wise(*parts, b" ", null_handling="skip"), b"", b"\n")
        lines = lines.cast(pa.large_binary())
        ends = np.frombuffer(lines.buffers()[1], np.int64)
        data = memoryview(lines.buffers()[2])
        pack = zstandard.ZstdCompressor(level=1).compress
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        rows = [(int(cell[a]), lang, pack(data[ends[a] : ends[b]]), pack(counts[a:b].tobytes())) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RUN_TYPES)], ["cell", "lang", "phrases", "counts"])


def spilled_runs(docs: DataFrame, longest: int, cells: int) -> DataFrame:
    """Runs of all phrases with their counts in the task; the empty phrase has the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tries, totals = Words(), {}, {}

        def spill(keep: int) -> Iterator[pa.RecordBatch]:
            runs = Runs(words, cells)
            for lang, trie in tries.items():
                for keys, counts in joined(trie.spill(keep)):
                    yield runs.batch(lang, keys, counts)

        for batch, texts in pieces(batches, "text", CHUNK_CHARS):
            langs = batch.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                found = words_of(t for t, g in zip(texts, langs) if g == lang)
                before = [_BREAK, _BREAK]
                for i in range(0, len(found), CHUNK_WORDS):
                    if words.full() or len(tries) > HELD_LANGS:
                        yield from spill(0)
                        words = Words()
                        tries.clear()
                    part = before + found[i : i + CHUNK_WORDS]
                    before = part[-2:]
                    ids = np.fromiter(map(words.__getitem__, part), np.int64, len(part))
                    totals[lang] = totals.get(lang, 0) + int(np.count_nonzero(ids[2:]))
                    tries.setdefault(lang, HatTrie()).add(packed(ids, longest))
                    if sum(t.used for t in tries.values()) > HELD:
                        yield from spill(HELD // 2 // len(tries))
                if len(totals) > HELD_LANGS:
                    yield total_rows(totals)
                    totals.clear()
        yield from spill(0)
        yield total_rows(totals)
        give_back()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, RUNS)


def joined(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Subtrees of about RUN phrases together, so that their cells' runs aren't short."""
    keys, counts = [], []
    for k, c in parts:
        keys.append(k), counts.append(c)
        if sum(map(len, keys)) > RUN:
            yield np.concatenate(keys), np.concatenate(counts)
            keys, counts = [], []
    if keys:
        yield np.concatenate(keys), np.concatenate(counts)


def total_rows(totals: dict[str, int]) -> pa.RecordBatch:
    pack = zstandard.ZstdCompressor(level=1).compress
    rows = [(0, lang, pack(b"\n"), pack(np.array([n], np.int64).tobytes())) for lang, n in totals.items()]
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RUN_TYPES)], ["cell", "lang", "phrases", "counts"])


def lines_of(data: bytes) -> pa.Array:
    """The phrases of a run, as a string array over its bytes."""
    raw = np.frombuffer(data, np.uint8)
    clean = raw != 10
    ends = np.flatnonzero(~clean)
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = ends - np.arange(len(ends))
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[clean])])


def added(tables: list[pa.Table]) -> pa.Table:
    """Equal phrases of all tables added up."""
    whole = pa.concat_tables(tables).combine_chunks()
    coded = whole["phrase"].combine_chunks().dictionary_encode()
    order = np.argsort(coded.indices.to_numpy(), kind="stable")
    code, f = coded.indices.to_numpy()[order], whole["f"].to_numpy()[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return pa.table({"phrase": coded.dictionary, "f": np.add.reduceat(f, first)})


def merged_runs(runs: DataFrame, tasks: int, least: int) -> DataFrame:
    """lang, phrase, f of all phrases with f >= least, from the runs of each cell."""
    dealt = runs.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        now, held, size = None, [], 0

        def finished() -> Iterator[pa.RecordBatch]:
            whole = added(held)
            whole = whole.filter(pc.greater_equal(whole["f"], least))
            for b in whole.to_batches():
                names = pa.array([now[1]] * b.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([names, b.column(0).cast(pa.binary()).cast(pa.string()), b.column(1)], ["lang", "phrase", "f"])

        for batch in batches:
            for i in range(batch.num_rows):
                cell, lang, phrases, counts = (batch.column(c)[i].as_py() for c in range(4))
                if (cell, lang) != now:
                    if held:
                        yield from finished()
                    now, held, size = (cell, lang), [], 0
                own = lines_of(unpack(phrases))
                held.append(pa.table({"phrase": own, "f": np.frombuffer(unpack(counts), np.int64)}))
                size += len(own)
                if size > MERGED:
                    held = [added(held)]
                    # a cell of more distinct phrases is added up again only when it has doubled
                    size = min(0, MERGED - 2 * held[0].num_rows) + held[0].num_rows
        if held:
            yield from finished()
        give_back()

    return dealt.mapInArrow(run, "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, least: int = 10, longest: int = 3) -> DataFrame:
    """lang, phrase, f of all phrases of up to ``longest`` (2 or 3) words with f >= least; the empty phrase has the language's number of words."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(1 << max(size // CELL_BYTES, 4).bit_length(), MOST_CELLS)
    return merged_runs(spilled_runs(docs, longest, cells), min(cells, MOST_TASKS), least)


# --- scores -------------------------------------------------------------------------------------------


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, cover_pct: int = 50, top: int = 2000) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    kept = written(frequent_phrases(docs, least, longest), "phrases")
    sized = kept.withColumn("words", F.split("phrase", " ", -1)).withColumn("size", F.size("words"))
    cands = sized.where("size > 1").withColumnRenamed("f", "a")
    # what a longer phrase covers: its first and its last words but one
    longer = cands.where("size > 2")
    inner = longer.select("lang", F.explode(F.array(F.slice("words", F.lit(1), F.col("size") - 1), F.slice("words", F.lit(2), F.col("size") - 1))).alias("w"), F.col("a").alias("f"))
    covers = inner.groupBy(F.col("lang").alias("cl"), F.array_join("w", " ").alias("cp")).agg(F.max("f").alias("most"))
    left = cands.join(covers, (F.col("lang") == F.col("cl")) & (F.col("phrase") == F.col("cp")), "left")
    left = left.where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * cover_pct)).select("lang", "phrase", "words", "size", "a")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("x"), F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("y"))
    salts = F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    parts = sized.where(F.col("size") < longest).select(F.col("lang").alias("pl"), F.col("phrase").alias("pp"), F.explode(salts).alias("ps"), F.col("f").alias("pf"))
    for words, name in (("x", "l"), ("y", "r")):
        salt = F.when(F.size(words) == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(0)
        on = (F.col("lang") == F.col("pl")) & (F.array_join(words, " ") == F.col("pp")) & (salt == F.col("ps"))
        cuts = cuts.join(parts, on).withColumnRenamed("pf", name).drop("pl", "pp", "ps")
    # exact: of 38 digits, a * a * 1000000 may take all; the quotient is at most 1000000
    score = F.expr("(CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(1000000 AS DECIMAL(7, 0))) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    least_cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")
    scored = cuts.groupBy("lang", "phrase", "a").agg(least_cut).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # first within 64 parts of a language, so that the last rank sees at most 64 * top rows
    part = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    part = part.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = part.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = kept.where("phrase = ''").select(F.col("lang").alias("tl"), F.col("f").alias("n"))
    whole = best.join(totals, F.col("lang") == F.col("tl"))
    return whole.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


ORACLE_SQL = r"""
WITH lowered AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
sizes AS (SELECT lang, sum(len(ws)) AS n FROM lists GROUP BY lang),
grams AS (
    SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase
    FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM lists, (VALUES (1), (2), (3)) AS s(size) WHERE len(ws) >= size)),
counted AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
worded AS (SELECT *, string_split(phrase, ' ') AS ws FROM counted WHERE size > 1),
covers AS (
    SELECT lang, phrase, max(f) AS most FROM (
        SELECT lang, ws[1] || ' ' || ws[2] AS phrase, f FROM worded WHERE size = 3
        UNION ALL SELECT lang, ws[2] || ' ' || ws[3], f FROM worded WHERE size = 3) GROUP BY ALL),
cuts AS (
    SELECT w.lang, w.phrase, w.f AS a, k, array_to_string(ws[1 : k], ' ') AS x, array_to_string(ws[k + 1 : size], ' ') AS y
    FROM worded w LEFT JOIN covers c USING (lang, phrase), range(1, 3) AS r(k)
    WHERE k < size AND (c.most IS NULL OR 100 * c.most < 50 * w.f)),
scored AS (
    SELECT u.lang, u.phrase, u.a, u.k, l.f AS l, r.f AS r,
           CAST((1000000::HUGEINT * u.a * u.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM cuts u JOIN counted l ON u.lang = l.lang AND u.x = l.phrase JOIN counted r ON u.lang = r.lang AND u.y = r.phrase),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM scored),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least WHERE cut = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

"""A stored index of texts: what phrase search reads instead of the texts, and how it is kept up to date.

A store is a folder. `manifest/<version>` says which parts make up the index and how many rows and characters it has;
a version is written last and never changed, so readers see whole states, and a writer that fails leaves the last one.
Parts are written once:

- `lists`: of each gram a row for every block of at most BLOCK_ROWS rows that hold it: their numbers (`seqs`), how often
  it stands in each (`tfs`) and their lengths (`ds`), with the largest tf, the least length and the largest number of the
  block. Blocks hold rows of similar length, so these bound what any of their rows can score. Long grams are the
  trigrams of the lower-case text; short ones its single characters and pairs with only A-Z folded.
- `grams`: how many rows hold each gram.
- `dead`: numbers of rows that this part replaces or removes in all parts before it.

`apply` adds a part with the new rows alone. Four parts of about one size are merged into one, without dead rows; so a
row is rewritten as often as its part has grown fourfold, and no other file is touched.

`candidates` answers (query_id, query) with the rows that phrase search ranks. Equal queries are answered once.
Queries of one gram (three characters, or one or two) need no text: blocks are read from the best bound downwards,
and those that can't reach the score of the last place so far are skipped. Longer ones take their rarest gram's rows,
whose texts are then read; they have to count all rows that hold them, which BM25 weighs them by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelore.functions.columns import ascii_lower
from timelore.sources import shared

GRAM = 3
BLOCK_ROWS, BLOCK_CHARS = 1_024, 1 << 22
MERGE_PARTS, LEAST_ROWS = 4, 1_024
#: Bounds are asked for where terms of one gram have more than this many times the rows that are wanted.
BOUND_FROM = 64
#: BM25's k1 and b, and the floor of idf.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6

LISTS = "gram string, short boolean, n int, max_tf int, min_d int, max_seq long, seqs array<long>, tfs array<int>, ds array<int>"
MANIFEST = "part string, no int, part_rows long, has_dead boolean, rows long, chars long"
_LISTS = pa.schema([("gram", pa.string()), ("short", pa.bool_()), ("n", pa.int32()), ("max_tf", pa.int32()), ("min_d", pa.int32()), ("max_seq", pa.int64()), ("seqs", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("ds", pa.list_(pa.int32()))])


def scored_length(text: str = "text") -> Column:
    """The length that BM25 uses: the number of trigrams, as far as there are any."""
    return F.greatest(F.lit(0), F.length(text) - (GRAM - 1)).cast("int")


# ---------------------------------------------------------------- lists


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, the text of each)."""
    sizes = [len(x) for x in texts]
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), np.repeat(np.arange(len(texts)), sizes)


def _by_characters(points: np.ndarray, inside: np.ndarray, size: int) -> np.ndarray:
    """The stable order of the grams that lie in one text: by one character after the other from the last, as 16-bit numbers of
    those that occur, which numpy sorts in linear time."""
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    most = int(seen.sum())
    number = (np.cumsum(seen) - 1)[points].astype(np.uint16 if most <= 1 << 16 else np.int64)
    at = [number[t : t + len(inside)][inside] for t in range(size)]
    while len(at) > 1 and most <= 1 << 8:
        at, most = [*at[:-2], at[-2] << 8 | at[-1]], 1 << 16  # two characters in one number
    order = np.argsort(at[-1], kind="stable")
    for digit in reversed(at[:-1]):
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def _gram_rows(points: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram key, text, times) of all grams of that many characters, by key and text."""
    n = len(points) - size + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    key = reduce(lambda k, t: k << 21 | points[t : t + n], range(1, size), points[:n])
    inside = text[:n] == text[size - 1 :]
    key, owner = key[inside], text[:n][inside]
    order = _by_characters(points, inside, size)
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], owner[first], np.diff(np.append(first, len(key)))


def _block(seqs: np.ndarray, ds: np.ndarray, low: list[str], plain: list[str]) -> Iterator[pa.RecordBatch]:
    low_points, plain_points = _points(low), _points(plain)
    for short, points, size in ((False, low_points, GRAM), (True, plain_points, 2), (True, plain_points, 1)):
        key, owner, tf = _gram_rows(*points, size)
        if not len(key):
            continue
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        offsets = np.append(first, len(key))
        spelled = np.column_stack([key[first] >> 21 * t & 0x1FFFFF for t in reversed(range(size))]).astype("<u4")
        grams = spelled.tobytes().decode("utf-32-le", "surrogatepass")
        seq, d = seqs[owner], ds[owner]
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, t)) for x, t in ((seq, pa.int64()), (tf, pa.int32()), (d, pa.int32()))]
        numbers = [np.diff(offsets), np.maximum.reduceat(tf, first), np.minimum.reduceat(d, first), np.maximum.reduceat(seq, first)]
        columns = [pa.array([grams[i : i + size] for i in range(0, len(grams), size)]), pa.array(np.full(len(first), short)), *[pa.array(x, f.type) for x, f in zip(numbers, list(_LISTS)[2:6], strict=True)], *lists]
        yield pa.RecordBatch.from_arrays(columns, schema=_LISTS)


def lists_of(rows: DataFrame) -> DataFrame:
    """LISTS of rows (evidence_seq, text), made where the rows are; blocks hold rows of similar length."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars = 0

        def out() -> Iterator[pa.RecordBatch]:
            seqs, ds, low, plain = zip(*held, strict=True)
            yield from _block(np.array(seqs, np.int64), np.array(ds, np.int32), list(low), list(plain))

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                chars += len(row[2])
                if len(held) == BLOCK_ROWS or chars >= BLOCK_CHARS:
                    yield from out()
                    held, chars = [], 0
        if held:
            yield from out()

    cut = rows.filter("text is not null").select(F.col("evidence_seq").cast("long").alias("evidence_seq"), scored_length().alias("d"), F.lower("text").alias("low"), ascii_lower(F.col("text")).alias("plain"))
    return cut.sortWithinPartitions("d").mapInArrow(build, LISTS)


# ---------------------------------------------------------------- the store


class TextIndex:
    """The latest version of a store, or the one given."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        written = [int(v) for v in shared.names(spark, f"{self.path}/manifest") if v.isdigit() and shared.exists(spark, f"{self.path}/manifest/{v}/_SUCCESS")]
        self.version = max(written, default=0) if version is None else version
        self.parts = sorted(self._manifest(self.version).collect(), key=lambda r: r.no) if self.version else []  # a few rows

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{version:08d}")

    @property
    def totals(self) -> tuple[int, int]:
        """(rows, the sum of their lengths)."""
        return (self.parts[0].rows, self.parts[0].chars) if self.parts else (0, 0)

    @property
    def mean_length(self) -> float:
        rows, chars = self.totals
        return chars / rows if rows else 1.0

    def _read(self, what: str, schema: str) -> DataFrame:
        """One table of all parts, with the number `no` of its part."""
        parts = [p for p in self.parts if what != "dead" or p.has_dead]
        tables = [self.spark.read.schema(schema).parquet(f"{self.path}/parts/{p.part}/{what}").withColumn("no", F.lit(p.no)) for p in parts]
        return reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], f"{schema}, no int")

    def lists(self) -> DataFrame:
        return self._read("lists", LISTS)

    def grams(self) -> DataFrame:
        """(gram, short, n): how many rows hold each gram, dead ones of older parts included."""
        return self._read("grams", "gram string, short boolean, n long").groupBy("gram", "short").agg(F.sum("n").alias("n"))

    def dead(self) -> DataFrame | None:
        """(evidence_seq, dead_before): rows of parts before that number are dead. None if no part has any."""
        if not any(p.has_dead for p in self.parts):
            return None
        return self._read("dead", "evidence_seq long").groupBy("evidence_seq").agg(F.max("no").alias("dead_before"))

    def living(self, entries: DataFrame) -> DataFrame:
        """Entries (evidence_seq, no, ...) without those of dead rows."""
        dead = self.dead()
        if dead is None:
            return entries
        return shared.meet(entries, shared.settled(dead, "dead"), "evidence_seq", "left").filter("dead_before is null or no >= dead_before").drop("dead_before")

    def entries(self, lists: DataFrame, *kept: str) -> DataFrame:
        """Living (kept columns, evidence_seq, tf, d) of rows of lists."""
        each = lists.select(*kept, "no", F.explode(F.arrays_zip("seqs", "tfs", "ds")).alias("e"))
        return self.living(each.select(*kept, "no", F.col("e.seqs").alias("evidence_seq"), F.col("e.tfs").alias("tf"), F.col("e.ds").alias("d"))).drop("no")

    # ------------------------------------------------------------ changes

    def _write_part(self, lists: DataFrame, dead: DataFrame | None) -> str:
        part = shared.fresh_path(self.spark, "part").rsplit("/", 1)[1]
        base = f"{self.path}/parts/{part}"
        lists.sortWithinPartitions("short", "gram").write.parquet(f"{base}/lists")  # where they are: new rows aren't moved, merged ones are by their blocks
        written = self.spark.read.schema(LISTS).parquet(f"{base}/lists")
        written.groupBy("gram", "short").agg(F.sum("n").alias("n")).write.parquet(f"{base}/grams")
        if dead is not None:
            dead.select(F.col("evidence_seq").cast("long").alias("evidence_seq")).distinct().write.parquet(f"{base}/dead")
        return part

    def _commit(self, parts: list[tuple[str, int, int, bool]], totals: tuple[int, int]) -> TextIndex:
        """The next version: parts (name, number, rows, whether it has dead rows)."""
        table = self.spark.createDataFrame([(*p, *totals) for p in parts], MANIFEST)
        table.coalesce(1).write.parquet(f"{self.path}/manifest/{self.version + 1:08d}")
        return TextIndex(self.spark, self.path, self.version + 1)

    def apply(self, added: DataFrame, removed: DataFrame | None = None) -> TextIndex:
        """The next version, with rows `added` and without rows `removed`, both (evidence_seq, text).

        A changed row is in both, with its new and its old text, as its length leaves the mean. Rows of null texts
        count as rows of length 0, and are in no list.
        """
        count = lambda t: tuple(t.agg(F.count("*"), F.coalesce(F.sum(scored_length()), F.lit(0))).first())
        plus, minus = count(added), (0, 0) if removed is None else count(removed)
        has_dead = bool(minus[0]) and bool(self.parts)
        part = self._write_part(lists_of(added), removed if has_dead else None)
        known = [(p.part, p.no, p.part_rows, p.has_dead) for p in self.parts]
        new = (part, 1 + max((p[1] for p in known), default=0), plus[0], has_dead)
        return self._commit([*known, new], tuple(t + a - b for t, a, b in zip(self.totals, plus, minus)))._merged()

    def _merged(self) -> TextIndex:
        """Without MERGE_PARTS parts of about one size; only neighbours are merged, as later parts kill rows of earlier ones."""
        size = [max(0, int(np.log(max(1, p.part_rows) / LEAST_ROWS) / np.log(MERGE_PARTS))) if p.part_rows > LEAST_ROWS else 0 for p in self.parts]
        for at in range(len(size) - MERGE_PARTS + 1):
            if len(set(size[at : at + MERGE_PARTS])) == 1:
                return self._merge(at, at + MERGE_PARTS)._merged()
        return self

    def _merge(self, a: int, b: int) -> TextIndex:
        gone, first, last = self.parts[a:b], self.parts[a].no, self.parts[b - 1].no
        some = self.lists().filter(F.col("no").between(first, last))
        each = self.entries(some, "gram", "short")
        length_class = F.floor(F.log2(F.col("d") + 1) * 4)
        blocks = max(1, -(-sum(p.part_rows for p in gone) // BLOCK_ROWS))
        block = F.pmod(F.xxhash64("evidence_seq"), F.lit(blocks))  # bounded, whatever the lengths are
        packed = each.groupBy("gram", "short", length_class.alias("c"), block.alias("b")).agg(F.array_sort(F.collect_list(F.struct("evidence_seq", "tf", "d"))).alias("e"))
        lists = packed.select(
            "gram", "short", F.size("e").alias("n"), F.array_max("e.tf").alias("max_tf"), F.array_min("e.d").alias("min_d"), F.array_max("e.evidence_seq").alias("max_seq"), F.col("e.evidence_seq").alias("seqs"), F.col("e.tf").alias("tfs"), F.col("e.d").alias("ds"),
        )
        dead = self._read("dead", "evidence_seq long").filter(F.col("no").between(first, last)) if a and any(p.has_dead for p in gone) else None
        part = self._write_part(lists, dead)
        alive = self.spark.read.schema(LISTS).parquet(f"{self.path}/parts/{part}/lists").filter("short and length(gram) = 1").select(F.explode("seqs").alias("s")).distinct().count()
        keep = lambda p: (p.part, p.no, p.part_rows, p.has_dead)
        parts = [*map(keep, self.parts[:a]), (part, last, alive, dead is not None), *map(keep, self.parts[b:])]
        return self._commit(parts, self.totals)

    # ------------------------------------------------------------ search

    def weight(self, tf: Column, d: Column) -> Column:
        """What BM25 multiplies idf with; it grows with tf and falls with d."""
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * d / F.lit(self.mean_length)))

    def candidates(self, evidence: DataFrame, visible: DataFrame, queries: DataFrame, most: int) -> DataFrame:
        """(query_id, is_long, f, evidence columns, chars, rank, pos): the `most` best visible rows of each query.

        evidence: the indexed rows; visible: evidence_seq of those that may be shown, each once; queries: trimmed
        (query_id, query). Rank is the negative BM25 over all indexed rows; queries of fewer than GRAM characters have
        rank 0 and take the newest rows.
        """
        long_ = F.length("query") >= GRAM
        asked = shared.settled(queries.select("query_id", long_.alias("is_long"), F.when(long_, F.lower("query")).otherwise(ascii_lower(F.col("query"))).alias("term")), "asked")
        terms = shared.settled(asked.groupBy("is_long", "term").agg(F.min("query_id").alias("lead")), "terms")
        wanted = shared.settled(self._wanted(terms), "wanted")
        leads, entries, alone = wanted.agg(F.count("*"), F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("phrase"), F.col("known"))), F.lit(0))).first()
        blocks = shared.meet(self._of(wanted), wanted.drop("known"), ["gram", "short"], most=leads)
        single = blocks.filter("not phrase").withColumn("bound", F.when(F.col("short"), F.col("max_seq").cast("double")).otherwise(self.weight(F.col("max_tf"), F.col("min_d"))))
        reached = single
        if alone > BOUND_FROM * most * leads:
            least = shared.settled(self._least(single, visible, most), "least")
            reached = shared.meet(single, least, "lead", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - F.abs("least") * 1e-9))
        rows = self.entries(blocks.filter("phrase").unionByName(reached.select(*blocks.columns)), "lead", "is_long", "term", "phrase")
        hits = shared.materialise(self._hits(evidence, rows, entries), "hits")
        shown = shared.meet(visible.select("evidence_seq"), hits, "evidence_seq", most=entries)
        found = self._best(self._ranked(shown, self._counts(hits, single), leads), most)
        if leads * most > shared.FEW_ROWS:
            found = shared.materialise(found, "found")
        rows = shared.meet(evidence.withColumn("chars", F.length("text")), found, "evidence_seq", most=leads * most)
        names = asked.join(terms, ["is_long", "term"]).select("lead", "query_id", "is_long")
        few = hasattr(asked, "local_rows")
        return rows.join(F.broadcast(names) if few else names, "lead").drop("lead")

    def _wanted(self, terms: DataFrame) -> DataFrame:
        """(lead, is_long, term, gram, short, phrase, known): the gram whose lists answer each term, the rarest of a phrase's, and how many
        rows hold it. No row for terms with an unknown gram."""
        spots = F.sequence(F.lit(1), F.length("term") - (GRAM - 1))
        phrase = F.length("term") > GRAM
        each = F.when(phrase, F.array_distinct(F.transform(spots, lambda i: F.substring(F.col("term"), i, F.lit(GRAM))))).otherwise(F.array("term"))
        grams = terms.select("lead", "is_long", "term", (~F.col("is_long")).alias("short"), phrase.alias("phrase"), F.size(each).alias("needed"), F.explode(each).alias("gram"))
        grams = F.broadcast(grams) if hasattr(terms, "local_rows") else grams
        keys = ["lead", "is_long", "term", "short", "phrase"]
        known = self.grams().join(grams, ["gram", "short"]).groupBy(*keys, "needed").agg(F.count("*").alias("_k"), F.min(F.struct("n", "gram")).alias("rarest"))
        return known.filter("_k = needed").select(*keys, F.col("rarest.gram").alias("gram"), F.col("rarest.n").alias("known"))

    def _of(self, wanted: DataFrame) -> DataFrame:
        """Lists of the wanted grams: few of them are asked of the files by name, which skips what lies between."""
        lists = self.lists()
        few = {(r["gram"], r["short"]) for r in getattr(wanted, "local_rows", [])}
        return lists.filter(reduce(lambda a, b: a | b, [(F.col("gram") == g) & (F.col("short") == s) for g, s in sorted(few)])) if 0 < len(few) <= 64 else lists

    def _least(self, single: DataFrame, visible: DataFrame, most: int) -> DataFrame:
        """(lead, least): what the `most`-th best of the first blocks by bound scores; no row where they hold fewer."""
        by_bound = Window.partitionBy("lead").orderBy(F.desc("bound"))
        first = single.withColumn("_i", F.row_number().over(by_bound)).filter(F.col("_i") <= 2 * most)  # a block has a row at least
        first = first.withColumn("_before", F.sum("n").over(by_bound.rowsBetween(Window.unboundedPreceding, -1))).filter(F.coalesce("_before", F.lit(0)) < 2 * most)
        value = F.when(F.col("is_long"), self.weight(F.col("tf"), F.col("d"))).otherwise(F.col("evidence_seq").cast("double"))
        seen = self.entries(first, "lead", "is_long").join(visible.select("evidence_seq"), "evidence_seq", "left_semi").withColumn("value", value)
        last = seen.withColumn("_i", F.row_number().over(Window.partitionBy("lead").orderBy(F.desc("value")))).filter(F.col("_i") <= most).groupBy("lead").agg(F.count("*").alias("_n"), F.min("value").alias("least"))
        return last.filter(F.col("_n") == most).select("lead", "least")

    def _hits(self, evidence: DataFrame, rows: DataFrame, bound_on_rows: int) -> DataFrame:
        """(lead, is_long, phrase, evidence_seq, f, d): entries of one gram as they are, those of phrases if their text holds the phrase."""
        columns = ["lead", "is_long", "phrase", "evidence_seq", "f", "d"]
        alone = rows.filter("not phrase").withColumn("f", F.when(F.col("is_long"), F.col("tf")).otherwise(0).cast("long")).select(*columns)
        asked = rows.filter("phrase").groupBy("evidence_seq").agg(F.collect_list("lead").alias("leads"), F.collect_list("term").alias("terms"), F.first("d").alias("d"))
        if bound_on_rows > shared.FEW_ROWS:
            asked = shared.materialise(asked, "asked_rows")
        texts = evidence.select("evidence_seq", F.lower("text").cast("binary").alias("low"))
        held = shared.meet(texts, asked, "evidence_seq", most=bound_on_rows).select("evidence_seq", "low", "leads", F.transform("terms", lambda x: x.cast("binary")).alias("terms"), "d")
        counted = held.mapInArrow(held_phrases, "lead long, evidence_seq long, f long, d int")
        return alone.unionByName(counted.select("lead", F.lit(True).alias("is_long"), F.lit(True).alias("phrase"), "evidence_seq", "f", "d"))

    def _counts(self, hits: DataFrame, single: DataFrame) -> DataFrame:
        """(lead, n): the rows that hold each term."""
        n = F.count("*").alias("n")
        alone = self.entries(single, "lead").groupBy("lead").agg(n) if self.dead() is not None else single.groupBy("lead").agg(F.sum("n").alias("n"))
        return hits.filter("phrase").groupBy("lead").agg(n).unionByName(alone)

    def _ranked(self, hits: DataFrame, counts: DataFrame, leads: int) -> DataFrame:
        """Hits with rank, from the number n of rows of each lead."""
        raw = F.log((F.lit(self.totals[0]) - F.col("n") + 0.5) / (F.col("n") + 0.5))
        idf = F.when(raw <= 0, IDF_FLOOR).otherwise(raw)
        f, d = F.col("f"), F.col("d")
        score = -idf * f * (K1 + 1) / (f + K1 * (1 - B + B * d / F.lit(self.mean_length)))
        return shared.meet(hits, counts, "lead", most=leads).withColumn("rank", F.when(F.col("is_long"), score).otherwise(0.0))

    def _best(self, ranked: DataFrame, most: int) -> DataFrame:
        order = Window.partitionBy("lead").orderBy("rank", F.when(F.col("is_long"), F.col("evidence_seq")).otherwise(-F.col("evidence_seq")))
        return ranked.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most).select("lead", "evidence_seq", "f", "rank", "pos")


def times(text: bytes, term: bytes) -> int:
    """How often the term stands in the text, overlaps included."""
    n = text.count(term)
    if n and any(term.startswith(term[i:]) for i in range(1, len(term))):  # it can overlap itself
        n, at = 0, text.find(term)
        while at >= 0:
            n, at = n + 1, text.find(term, at + 1)
    return n


def held_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (evidence_seq, low, leads, terms, d) those that hold a term: (lead, evidence_seq, f, d)."""
    for batch in batches:
        out = []
        for seq, low, leads, terms, d in zip(*batch.columns, strict=True):
            text, seq, d = low.as_py(), seq.as_py(), d.as_py()
            out += [(lead, seq, f, d) for lead, term in zip(leads.as_py(), terms.as_py(), strict=True) if (f := times(text, term))]
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["lead", "evidence_seq", "f", "d"])


def create(rows: DataFrame, path: str) -> TextIndex:
    """A store of rows (evidence_seq, text) in an empty folder."""
    return TextIndex(rows.sparkSession, path).apply(rows)

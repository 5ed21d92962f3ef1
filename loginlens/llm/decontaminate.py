"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts become lower-case words (letters, marks and digits). A mask such as
11101011 is laid on WIDTH consecutive words; the words under a 1 are hashed, those
under a 0 ignored. The two masks in use are lossless for the overlap looked for:
whichever SUBSTITUTIONS of WIDTH words are replaced, one of the masks fits
somewhere on equal words. Hashes of the benchmark are joined with those of the
documents, and around every hit both texts are compared word by word: the pair
counts if WIDTH consecutive words around the hit differ in at most SUBSTITUTIONS
places.

Items of 5 to 12 words must appear whole and unchanged; shorter items cannot be
told from chance and take no part.

The benchmark's seeds are broadcast below a checked size; beyond it the same
join is a shuffled one. With the broadcast, documents are read, split, hashed,
joined and verified in one stage, and only verified hits are shuffled, added up
on the map side.

Cases: null or empty texts match nothing. Null item ids and document ids are
kept as ids. Repeated document rows are reported row by row; repeated items of
one id count once. Empty tables give an empty result. Other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loginlens.llm.common import carried, uncarried
from loginlens.session import durable

WIDTH = 13
SUBSTITUTIONS = 2
MASKS = ("11101011", "110100111")
SHORTEST = 5
BROADCAST_ROWS = 500_000

NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case words; a wordless text has one empty word, a null text none."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " ")), " ")


def seed(words: Column, at: Column, mask: str) -> Column:
    """Hash of the words under the mask laid at position `at`; null where it does not fit."""
    picked = [F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1"]
    return F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *picked))


def _seeded(rows: DataFrame, masks: list[str], keep: list[str]) -> DataFrame:
    """One row per mask and position of `words` that it fits: the hash `h` and the position `at`.

    Both steps are generators within one compiled stage, so the word list is
    never copied per position.
    """
    last = F.greatest(F.size("words") - 1, F.lit(0))
    spots = rows.select(*keep, "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    hashes = F.array(*[seed(F.col("words"), F.col("at"), m) for m in masks])
    return spots.select(*keep, "words", "at", F.posexplode(hashes).alias("mask", "h")).where("h is not null")


def _close(pair: Column, width: int, substitutions: int) -> Column:
    """Whether the equally long lists `pair.ours`, `pair.theirs` agree but for `substitutions` places
    over some `width` words in a row.

    The list of differing places, with a wall at either end, has the answer: a
    stretch with that few differences lies between two walls that far apart.
    """
    count = F.size(pair["ours"])
    differ = F.filter(F.sequence(F.lit(0), count - 1),
                      lambda i: ~F.get(pair["ours"], i).eqNullSafe(F.get(pair["theirs"], i)))
    walls = F.concat(F.array(F.lit(-1)), differ, F.array(count))
    skip = substitutions + 1
    far = lambda w: F.when(F.size(w) > skip, F.exists(
        F.sequence(F.lit(0), F.size(w) - 1 - skip),
        lambda j: F.get(w, j + skip) - F.get(w, j) > width)).otherwise(F.lit(True))
    return (count >= width) & F.exists(F.array(walls), far)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, substitutions: int = SUBSTITUTIONS,
                 masks: tuple[str, ...] = MASKS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows `_row, doc_id, item_id, alignments`: a document row that repeats an item, and at how many shifts.

    `docs` has `_row` (see `common.with_row_id`), `doc_id`, `text`; `benchmark` has
    `item_id, text`. The masks must be lossless for (width, substitutions).
    """
    items = (benchmark.select("item_id", words_of(F.col("text")).alias("item_words"))
             .where(F.size("item_words") >= SHORTEST).distinct())
    short = sorted(r["n"] for r in items.select(F.size("item_words").alias("n")).where(F.col("n") < width)
                   .distinct().collect())
    every = [*masks, *["1" * n for n in short]]
    exact = F.col("mask") >= len(masks)
    is_short = F.size("item_words") < width
    seeds = _seeded(items.withColumn("words", F.col("item_words")), every, ["item_id", "item_words"])
    seeds = seeds.where((exact & is_short & (F.length(F.element_at(F.lit(every), F.col("mask") + 1))
                                             == F.size("item_words"))) | (~exact & ~is_short))
    reach = max(width - 1, max(map(len, masks)) + width - 1)
    left = F.least(F.col("at"), F.lit(reach))
    seeds = durable(seeds.select(
        "item_id", "mask", "h", F.col("at").alias("item_at"), left.alias("item_left"),
        F.slice("item_words", F.col("at") - left + 1, left + reach).alias("item_near")))
    if seeds.count() <= broadcast_rows:
        seeds = F.broadcast(seeds)
    ours = docs.select("_row", "doc_id", words_of(F.col("text")).alias("words"))
    hits = _seeded(ours, every, ["_row", "doc_id"]).drop("mask").join(seeds, "h")
    back = F.least("at", "item_left")
    ahead = F.least(F.size("words") - F.col("at"), F.size("item_near") - F.col("item_left"))
    near = hits.select(
        "_row", "doc_id", "item_id", "mask", (F.col("at") - F.col("item_at")).alias("shift"),
        F.slice("words", F.col("at") - back + 1, back + ahead).alias("ours"),
        F.slice("item_near", F.col("item_left") - back + 1, back + ahead).alias("theirs"))
    # A generator and not a filter: Spark would move a filter into the join and out of the compiled stage.
    same = lambda p: F.when(p["exact"], p["ours"] == p["theirs"]).otherwise(_close(p, width, substitutions))
    pairs = F.filter(F.array(F.struct("ours", "theirs", (F.col("mask") >= len(masks)).alias("exact"))), same)
    verified = near.select("_row", "doc_id", "item_id", "shift", F.explode(pairs))
    return (verified.select("_row", "doc_id", "item_id", "shift").distinct()
            .groupBy("_row", "doc_id", "item_id").agg(F.count("*").alias("alignments")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The documents that repeat no benchmark item, with their columns."""
    rows = carried(docs, "doc_id", "text")
    hit = durable(contaminated(rows, benchmark, **options).select("_row").distinct())
    return uncarried(rows.join(hit, "_row", "left_anti"), docs)


ORACLE = r"""
with norm as (
  select doc_id as id, false as bench, regexp_replace(lower(text), '^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$', '', 'g') as t
  from documents
  union all
  select item_id, true, regexp_replace(lower(text), '^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$', '', 'g') from benchmark),
lists as (select id, bench, regexp_split_to_array(t, '[^\p{L}\p{M}\p{N}]+') as w from norm where length(t) > 0),
tokens as (select id, bench, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) - 1 as p from lists where len(w) >= 5),
matches as (
  select d.id as doc_id, b.id as item_id, d.p - b.p as shift, b.p, b.n as item_n, d.n as doc_n
  from tokens d join tokens b on d.word = b.word and not d.bench and b.bench),
runs as (
  select *, count(*) over (partition by doc_id, item_id, shift order by p range between current row and 12 following) as m,
         count(*) over (partition by doc_id, item_id, shift) as total
  from matches),
good as (
  select distinct doc_id, item_id, shift from runs
  where (item_n >= 13 and m >= 11
         and least(item_n, doc_n - shift) - greatest(0, -shift) >= 13)
     or (item_n < 13 and total = item_n))
select doc_id, item_id, count(*) as alignments from good group by doc_id, item_id
"""

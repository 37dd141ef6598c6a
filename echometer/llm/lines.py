"""Line dedup with an edit bound of one, by a deletion-neighbourhood join.

A line is dropped where an equal line, or one a single insertion, deletion or substitution of a code
point away, stands at an earlier place; the earliest stays. Places are ordered by document id, then text
hash, then line number. Being near is not carried on: a line is compared with all other lines, dropped
ones included.

Two lines within one edit agree outside a block that holds the edit. So the lines are first keyed by what
is left when half of the line is cut out, then, for those that share such a key with another line, when a
short block is cut out. Only lines which share that too emit the deletion neighbourhood of the block:
the block itself and every variant with one code point deleted, hashed with the key. Equal variants are
joined by their earliest places, one row per line and variant, never as pairs of lines. The edit distance
to the line that would stay is then verified. The cuts lose no pair within the bound.

Copies of one line count as one line from the start: sums and smallest places have partial steps, and the
joins are equi-joins that adaptive execution splits where one line is on a third of all rows. Texts are
shuffled only for lines that share a half with a different line.

Equal lines go whatever their length, but blank ones (empty or white space only, as Python's ``isspace``
says) are never dropped. Only lines of ``MIN_CHARS`` code points or more are compared for one edit: two
short lines one edit apart can be different words. A null text has no lines; an empty text has one empty
line. Rows equal in id and text share their places and are judged
alike; a null id comes first. Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echometer.llm import common

#: Least length of the lines that are compared for one edit; equal lines go at any length.
MIN_CHARS = 16
# The white space of Python's str.isspace; a line of these alone is blank.
NOT_BLANK = r"[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Code points of a block, about, and most blocks in a line.
BLOCK_CHARS = 16
MOST_BLOCKS = 64

LINE = ["line_hash", "line_check"]


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``place`` (id, text hash, number), ``line``, its length and its 128-bit hash, of every line not blank."""
    rows = docs.select(
        common.plain(key).alias("doc_id"), F.xxhash64(common.plain(text)).alias("text_hash"),
        F.posexplode(F.split(common.plain(text), "\n", -1)).alias("line_no", "line"),
    )
    # Lengths are counted once; counting is linear in a line.
    return rows.filter(F.col("line").rlike(NOT_BLANK)).withColumn("chars", F.length("line")).select(
        F.struct("doc_id", "text_hash", "line_no").alias("place"),
        "line",
        "chars",
        F.xxhash64("line").alias("line_hash"),
        F.xxhash64(F.lit("second"), "line").alias("line_check"),
    )


def _half_keys(line: Column, chars: Column) -> Column:
    """What is left of a line when one half of it is cut out, hashed, for its length and for one less."""

    def keys(base: Column) -> tuple[Column, Column]:
        half = F.floor(base / 2).cast("int")
        first, last = F.substr(line, F.lit(1), half), F.substr(line, chars - (base - half) + 1)
        return F.xxhash64(base, F.lit("first"), first), F.xxhash64(base, F.lit("last"), last)

    return F.array(*keys(chars), *keys(chars - 1))


def _block_cuts(line: Column, chars: Column) -> Column:
    """Array of (key, block, shorter): the line without one of its short blocks, hashed, and that block.

    Block bounds are laid out for a base length. A line of that length meets lines of its own length and
    those one longer, so every line is cut for its length and for one less.
    """

    def of(base: Column, more: int) -> Column:
        blocks = F.greatest(F.lit(2), F.least(F.lit(MOST_BLOCKS), F.floor(base / BLOCK_CHARS).cast("int")))

        def one(k: Column) -> Column:
            start = F.floor(base * k / blocks).cast("int")
            stop = F.floor(base * (k + 1) / blocks).cast("int")
            key = F.xxhash64(base, k, F.substr(line, F.lit(1), start), F.substr(line, stop + more + 1))
            return F.struct(
                key.alias("key"), F.substr(line, start + 1, stop - start + more).alias("block"),
                F.lit(more == 0).alias("shorter"),
            )

        return F.transform(F.sequence(F.lit(0), blocks - 1), one)

    return F.concat(of(chars, 0), of(chars - 1, 1))


def _shared_keys(cuts: DataFrame) -> DataFrame:
    """Keys that at least two different lines have."""
    found = cuts.groupBy("key").agg(F.min("line_hash").alias("low"), F.max("line_hash").alias("high"))
    return found.filter("low <> high").select("key")


def _variants(block: Column, shorter: Column) -> Column:
    """Array of (variant, kind) of a block; equal (variant, kind) means one edit, by kind.

    Kind -1: the shorter line's block against the longer line's with one code point deleted. Kind i: both
    without their code point i, which is a substitution.
    """
    deleted = F.transform(
        F.sequence(F.lit(1), F.length(block)),
        lambda i: F.struct(
            F.concat(F.substr(block, F.lit(1), i - 1), F.substr(block, i + 1)).alias("variant"),
            F.when(shorter, i).otherwise(-1).alias("kind"),
        ),
    )
    whole = F.array(F.struct(block.alias("variant"), F.lit(-1).alias("kind")))
    return F.array_distinct(
        F.when(F.length(block) == 0, whole).when(shorter, F.concat(whole, deleted)).otherwise(deleted)
    )


def first_places(lines: DataFrame) -> DataFrame:
    """Earliest ``place`` and number of ``copies`` of every distinct line."""
    return lines.groupBy(*LINE).agg(F.min("place").alias("place"), F.count("*").alias("copies"))


def near_lines(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """Distinct lines with an earlier line one edit away: hash and ``kept``, the earliest such place."""
    halves = lines.select(*LINE, F.explode(_half_keys(F.col("line"), F.col("chars"))).alias("key"))
    sharing = halves.join(_shared_keys(halves), "key", "left_semi").select(*LINE).distinct()
    # The text of each such line at its first place; places are spread evenly, whatever the copies.
    chosen = firsts.join(sharing, LINE, "left_semi").select("place")
    candidates = common.stored(
        lines.join(chosen, "place", "left_semi").select(*LINE, "place", "line", "chars"), "lines-sharing-halves"
    )
    cuts = candidates.select(*LINE, "place", F.explode(_block_cuts(F.col("line"), F.col("chars"))).alias("cut")).select(
        *LINE, "place", "cut.*"
    )
    survivors = cuts.join(_shared_keys(cuts), "key", "left_semi")
    emitted = survivors.select(
        *LINE, "place", "key", "block", "shorter",
        F.explode(_variants(F.col("block"), F.col("shorter"))).alias("emitted"),
    ).select(
        *LINE, "place", "block", "emitted.kind",
        F.xxhash64("key", "emitted.variant", "emitted.kind").alias("variant_key"),
        F.when(F.col("emitted.kind") >= 0, "same").when(F.col("shorter"), "short").otherwise("long").alias("side"),
    )

    def earliest(side: str) -> Column:
        return F.min(F.when(F.col("side") == side, F.struct("place", *LINE, "block"))).alias(f"earliest_{side}")

    groups = emitted.groupBy("variant_key").agg(*map(earliest, ("same", "short", "long")))
    other = (
        F.when(F.col("side") == "same", F.col("earliest_same"))
        .when(F.col("side") == "short", F.col("earliest_long"))
        .otherwise(F.col("earliest_short"))
    )
    met = emitted.join(groups, "variant_key").withColumn("other", other)
    verified = met.filter(
        (F.col("other.place") < F.col("place")) & (F.levenshtein("block", "other.block", 1) >= 0)
    )
    return verified.groupBy(*LINE).agg(F.min("other.place").alias("kept"))


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id``, ``text_hash`` and the ``dropped`` lines of rows that lose any: sorted (number, near)."""
    lines = lines_of(docs, key, text)
    firsts = first_places(lines)
    near = near_lines(lines.filter(F.col("chars") >= min_chars), firsts)
    decided = (
        firsts.withColumnRenamed("place", "first")
        .join(near, LINE, "left")
        .filter((F.col("copies") > 1) | F.col("kept").isNotNull())
    )
    occurrences = lines.select("place", *LINE).join(decided, LINE)
    lost = occurrences.filter(F.col("kept").isNotNull() | (F.col("place") != F.col("first")))
    return lost.groupBy("place.doc_id", "place.text_hash").agg(
        # Equal rows share their places.
        F.array_sort(
            F.collect_set(
                F.struct(F.col("place.line_no").alias("number"), (F.col("place") == F.col("first")).alias("near"))
            )
        ).alias("dropped")
    )


def with_dropped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``document`` (all columns of ``docs``) and its ``dropped`` lines, null where it keeps all."""
    packed = docs.select(
        F.struct(*map(common.plain, docs.columns)).alias("document"),
        common.plain(key).alias("own_id"),
        F.xxhash64(common.plain(text)).alias("own_hash"),
    )
    lost = dropped_lines(docs, key, text)
    return packed.join(
        lost, packed.own_id.eqNullSafe(lost.doc_id) & (packed.own_hash == lost.text_hash), "left"
    ).select("document", "dropped")


def without_lines(text: Column, dropped: Column) -> Column:
    """The text of the lines that stay."""
    numbers = F.transform(dropped, lambda d: d["number"])
    kept = F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains(numbers, i))
    return F.when(dropped.isNull(), text).otherwise(F.array_join(kept, "\n"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    lost = dropped_lines(docs)
    counted = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
    )
    found = counted.join(
        lost, counted.doc_id.eqNullSafe(lost.doc_id) & (counted.text_hash == lost.text_hash), "left"
    )
    return found.select(
        counted.doc_id,
        "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.size(F.filter("dropped", lambda d: d["near"])), F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.array_join(F.transform("dropped", lambda d: d["number"].cast("string")), ","), F.lit("")).alias(
            "dropped_lines"
        ),
    )


OP10_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, line_no) AS place FROM split
  WHERE regexp_matches(line, '[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')
), firsts AS (
  SELECT line, min(place) AS place, length(line) AS n FROM placed GROUP BY line
), halves AS (
  SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS half FROM firsts WHERE n >= 16
), close AS (
  SELECT a.line, a.n, b.line AS other, b.n AS m FROM halves a JOIN halves b
    ON a.half = b.half AND left(a.line, a.half) = left(b.line, b.half) AND b.place < a.place
  UNION
  SELECT a.line, a.n, b.line, b.n FROM halves a JOIN halves b
    ON a.half = b.half AND right(a.line, a.half) = right(b.line, b.half) AND b.place < a.place
), near AS (
  SELECT DISTINCT line FROM close
  WHERE abs(n - m) <= 1 AND len(list_filter(range(greatest(n, m)), lambda i:
    CASE WHEN n >= m THEN left(line, i) || substr(line, i + 2) ELSE line END =
    CASE WHEN m >= n THEN left(other, i) || substr(other, i + 2) ELSE other END)) > 0
), dropped AS (
  SELECT placed.doc_id, placed.line_no, placed.place = firsts.place AS near
  FROM placed JOIN firsts USING (line) LEFT JOIN near USING (line)
  WHERE near.line IS NOT NULL OR placed.place <> firsts.place
), lost AS (
  SELECT doc_id, count(*) AS n_dropped, count(*) FILTER (WHERE near) AS n_near,
         string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS dropped_lines
  FROM dropped GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       coalesce(n_near, 0) AS n_near, coalesce(dropped_lines, '') AS dropped_lines
FROM documents d LEFT JOIN lost USING (doc_id)
"""

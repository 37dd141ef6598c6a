"""How five document filters interact, by count-weighted decision diagrams.

Every document gets a failure mask of five bits, one per filter (A to E below). Spark counts the
documents of each part (``lang``; null is the empty string) by mask, with how many of them are labelled
good (``labels.quality = 1``) and toxic (``toxic = 1``): at most 32 rows a part, whatever the corpus.

Per part these counts become a reduced ordered decision diagram over the five bits whose terminals are
the (documents, good, toxic) weights; equal sub-diagrams are shared. All 120 orders of the filters are
visited by adjacent transpositions (Steinhaus-Johnson-Trotter); each is one swap of two neighbouring
levels of the diagram. In every order the path on which each filter so far passes is walked: the weight
of the failing branch at step k is what filter k removes, the passing branch what stays.

Filters (words: maximal runs of ``[^\\x20\\x09-\\x0D]``, case-sensitive; null text is empty):

- A: fewer than 100 words;
- B: ``100 * distinct words < 80 * words`` (no words: passes);
- C: ``100 * [A-Z] characters > 10 * code points``;
- D: any of ``#$%&*|``;
- E: the text equals that of a smaller doc_id anywhere in the table. Equal ids are not smaller, so
  repeated rows of one id pass; a row without id never fails E and makes no other row fail it.

Repeated rows count once each. A document without labels, or whose labels are null, is neither good
nor toxic; if an id has several label rows, any 1 counts. Empty tables give no rows; a part with
documents gets all 600 rows (120 orders, 5 steps), zeros included. Very long texts are handled by
Spark's regular expressions in the JVM. Extra columns of ``documents`` and ``labels`` are ignored.

Hot texts: a group of copies holding a third of the table is pre-aggregated before it meets its
smallest id, and its value is broadcast, so it never lands in one task (``joins.join_value``).
"""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echometer.llm import common
from echometer.operators.joins import join_value

# Fixed values of the contract: the filter letters in their natural order and their thresholds.
FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
SYMBOLS = "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"

RESULT = (
    "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def failure_masks(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: documents by part and failure mask (bit k: filter k)."""
    text = F.coalesce(common.plain("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    rows = docs.select(
        common.plain("doc_id").cast("long").alias("doc_id"),
        F.coalesce(common.plain("lang"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"),
        (
            F.when(F.size(words) < MIN_WORDS, 1).otherwise(0)
            + F.when(F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_PERCENT, 2).otherwise(0)
            + F.when(upper * 100 > F.length(text) * UPPER_PERCENT, 4).otherwise(0)
            + F.when(text.rlike(SYMBOLS), 8).otherwise(0)
        ).alias("mask"),
    )
    # Repeated rows collapse before any join; partial sums keep a hot group from one task.
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = common.stored(rows, "filter-audit-rows")
    firsts = common.stored(
        rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.sum("n").alias("copies")),
        "filter-audit-firsts",
    )
    rows = join_value(rows, firsts, "digest", "copies")
    rows = rows.withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("first_id"), 16).otherwise(0))
    if labels is not None:
        marks = (
            labels.select(common.plain("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
            .where(F.col("doc_id").isNotNull())
            .groupBy("doc_id")
            .agg(
                F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("is_good"),
                F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("is_toxic"),
            )
        )
        rows = rows.join(marks, "doc_id", "left")
    else:
        rows = rows.withColumn("is_good", F.lit(0)).withColumn("is_toxic", F.lit(0))
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce(F.col("is_good"), F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce(F.col("is_toxic"), F.lit(0))).alias("toxic"),
    )


class Diagram:
    """Reduced ordered decision diagram over failure bits with (documents, good, toxic) weights.

    A node is ``(level, low, high)`` with children as node ids; terminals are weight triples. ``order``
    names the bit tested at each level. ``mass`` of a node counts every assignment of the levels from
    its own down, so a level a node skips counts twice.
    """

    def __init__(self, weights: dict[int, tuple[int, int, int]], bits: int = len(FILTERS)):
        self.bits = bits
        self.order = list(range(bits))
        self.nodes: list[tuple] = []
        self.unique: dict[tuple, int] = {}
        self.root = self._build(0, 0, weights)

    def _make(self, key: tuple) -> int:
        if key not in self.unique:
            self.unique[key] = len(self.nodes)
            self.nodes.append(key)
        return self.unique[key]

    def _terminal(self, weight: tuple[int, int, int]) -> int:
        return self._make(("leaf", *weight))

    def _node(self, level: int, low: int, high: int) -> int:
        return low if low == high else self._make((level, low, high))

    def _build(self, level: int, fixed: int, weights: dict[int, tuple[int, int, int]]) -> int:
        if level == self.bits:
            return self._terminal(weights.get(fixed, (0, 0, 0)))
        bit = 1 << self.order[level]
        return self._node(level, self._build(level + 1, fixed, weights), self._build(level + 1, fixed | bit, weights))

    def level_of(self, node: int) -> int:
        return self.bits if self.nodes[node][0] == "leaf" else self.nodes[node][0]

    def mass(self, node: int, level: int) -> tuple[int, int, int]:
        """Weights summed over all assignments of levels ``level`` and below, below ``node``."""
        key = self.nodes[node]
        times = 1 << (self.level_of(node) - level)
        if key[0] == "leaf":
            return tuple(times * x for x in key[1:])
        low = self.mass(key[1], key[0] + 1)
        high = self.mass(key[2], key[0] + 1)
        return tuple(times * (a + b) for a, b in zip(low, high))

    def _cofactors(self, node: int, level: int) -> tuple[int, int]:
        """Children of ``node`` for the bit at ``level``: itself twice if it skips that level."""
        key = self.nodes[node]
        if key[0] == level:
            return key[1], key[2]
        return node, node

    def swap(self, level: int) -> None:
        """Exchange the bits of ``level`` and ``level + 1``; nodes above are rebuilt as needed."""
        memo: dict[int, int] = {}

        def rebuilt(node: int) -> int:
            if node in memo:
                return memo[node]
            key = self.nodes[node]
            if key[0] == "leaf" or key[0] > level + 1:
                out = node
            elif key[0] < level:
                out = self._node(key[0], rebuilt(key[1]), rebuilt(key[2]))
            else:
                f0, f1 = self._cofactors(node, level)
                f00, f01 = self._cofactors(f0, level + 1)
                f10, f11 = self._cofactors(f1, level + 1)
                # The old bit of level+1 is now tested first.
                out = self._node(level, self._node(level + 1, f00, f10), self._node(level + 1, f01, f11))
            memo[node] = out
            return out

        self.root = rebuilt(self.root)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass_path(self) -> list[tuple[int, tuple, tuple]]:
        """Per level: its bit, the weights failing there after passing all before, and those kept."""
        node, steps = self.root, []
        for level in range(self.bits):
            if self.level_of(node) == level:
                low, high = self.nodes[node][1], self.nodes[node][2]
            else:
                low = high = node
            steps.append((self.order[level], self.mass(high, level + 1), self.mass(low, level + 1)))
            node = low
        return steps


def adjacent_swaps(n: int) -> list[int]:
    """Levels whose swap leads from each order to the next, visiting all n! orders once (Steinhaus-Johnson-Trotter)."""
    items, directions, swaps = list(range(n)), [-1] * n, []
    while True:
        mobile = [i for i in range(n) if 0 <= i + directions[items[i]] < n and items[i + directions[items[i]]] < items[i]]
        if not mobile:
            return swaps
        i = max(mobile, key=lambda k: items[k])
        value, j = items[i], i + directions[items[i]]
        items[i], items[j] = items[j], items[i]
        swaps.append(min(i, j))
        for k in range(n):
            if items[k] > value:
                directions[items[k]] *= -1


def audit_part(part: str, weights: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """The 600 rows of one part from its weights by mask."""
    bits = len(FILTERS)
    fails = [sum(w[0] for m, w in weights.items() if m >> b & 1) for b in range(bits)]
    unique = [weights.get(1 << b, (0, 0, 0))[0] for b in range(bits)]
    diagram, found = Diagram(weights, bits), {}
    for swap in [*adjacent_swaps(bits), None]:
        order = "".join(FILTERS[b] for b in diagram.order)
        found[order] = diagram.all_pass_path()
        if swap is not None:
            diagram.swap(swap)
    shapley = [0] * bits
    for steps in found.values():
        for bit, removed, _ in steps:
            shapley[bit] += removed[0]
    rows = []
    for order in ("".join(p) for p in permutations(FILTERS)):
        for step, (bit, removed, kept) in enumerate(found[order], start=1):
            rows.append(
                (part, order, step, FILTERS[bit], kept[0], removed[0], fails[bit] - removed[0], unique[bit],
                 removed[1], removed[2], shapley[bit])
            )
    return rows


def _audit(group: pd.DataFrame) -> pd.DataFrame:
    weights = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in group.itertuples()}
    return pd.DataFrame(audit_part(group["part"].iloc[0], weights), columns=[f.split()[0] for f in RESULT.split(", ")])


def filter_audit(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Rows of ``RESULT``: per part, order of the filters and step, what is kept, removed and lost."""
    masks = failure_masks(docs, labels)
    # At most 32 rows a part reach one group.
    return masks.groupBy("part").applyInPandas(_audit, RESULT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(common.documents(spark, sf_dir, "doc_id", "text", "lang"), common.table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH RECURSIVE letters(letter, bit) AS (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)),
orders(o) AS (
    SELECT letter FROM letters
    UNION ALL
    SELECT o || letter FROM orders JOIN letters ON strpos(o, letter) = 0 WHERE length(o) < 5
),
steps AS (
    SELECT o AS filter_order, s AS step, substr(o, s, 1) AS filter,
        (SELECT bit FROM letters WHERE letter = substr(o, s, 1)) AS bit,
        (SELECT coalesce(sum(1 << bit), 0) FROM letters WHERE strpos(substr(o, 1, s - 1), letter) > 0) AS earlier
    FROM orders, range(1, 6) t(s) WHERE length(o) = 5
),
d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
),
w AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper
    FROM d
),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
marks AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
        max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
m AS (
    SELECT w.part,
        (CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END)
        + (CASE WHEN len(list_distinct(ws)) * 100 < len(ws) * 80 THEN 2 ELSE 0 END)
        + (CASE WHEN upper * 100 > length(w.t) * 10 THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN w.doc_id > f.first_id THEN 16 ELSE 0 END) AS mask,
        coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic
    FROM w JOIN firsts f ON f.t = w.t LEFT JOIN marks k ON k.doc_id = w.doc_id
),
per AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
),
parts AS (SELECT DISTINCT part FROM per),
counted AS (
    SELECT p.part, s.filter_order, s.step, s.filter, s.bit,
        coalesce(sum(n) FILTER (WHERE (mask & (s.earlier | (1 << s.bit))) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (WHERE (mask & s.earlier) = 0 AND ((mask >> s.bit) & 1) = 1), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE (mask & s.earlier) <> 0 AND ((mask >> s.bit) & 1) = 1), 0) AS redundant,
        coalesce(sum(n) FILTER (WHERE mask = (1 << s.bit)), 0) AS unique_fails,
        coalesce(sum(good) FILTER (WHERE (mask & s.earlier) = 0 AND ((mask >> s.bit) & 1) = 1), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE (mask & s.earlier) = 0 AND ((mask >> s.bit) & 1) = 1), 0) AS toxic_lost
    FROM parts p CROSS JOIN steps s LEFT JOIN per q ON q.part = p.part
    GROUP BY p.part, s.filter_order, s.step, s.filter, s.bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter,
    CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""

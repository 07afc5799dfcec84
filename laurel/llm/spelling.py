"""Spelling variants: words one edit apart, found by pivotal grams.

A word's bigrams are ordered by how rare they are over all words; the rarest ones are its
prefix. Of these, dynamic programming chooses two that do not overlap, its pivots, so that
their words in total are fewest. One edit spoils at most one of two disjoint pivots, and of two
near words the one whose prefix ends earlier has its other pivot within the other's prefix, at a
place that moved by one at most. So pivots are looked up among the prefixes of other words.

The limit on places is used in full: the one edit lies after the first pivot or before the
second, so that the whole text up to the end of the first or from the start of the second is
equal. The index key is that text.

    texts --> words with their counts --> pivots, prefixes --> candidates --> verified links
      --> each word's most frequent near word --> roots by pointer jumping
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.functions.spread import hot_keys, spread_join
from laurel.llm.tables import settled

# Letters as single bytes (Latin-1): A-Z become a-z; a-z and U+00C0 to U+00FF stay; all else parts words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
FLUSH = 500_000
GRAM = 2
EDITS = 1
PREFIX = GRAM * EDITS + 1


# ------------------------------------------------------------------ words


def misspelt(doc_id: object, runs: list[bytes], one_in: int) -> Counter:
    """The runs of one text and their counts, after the stated deletions.

    A run whose crc32 of `<doc_id>:<run>` is a multiple of `one_in` loses one letter.
    """
    found = Counter(runs)
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    hit = [r for r in found if (h := crc32(r if r.isascii() else r.decode("latin-1").encode(), start)) % one_in == 0]
    changed = Counter()
    for run in hit:
        at = crc32(run.decode("latin-1").encode(), start) % len(run)
        changed[run[:at] + run[at + 1:]] += found.pop(run)
    found.update(changed)
    return found


def _counter(least_chars: int, one_in: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(held: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                letters = text.as_py().encode("latin-1", "replace").translate(LETTERS)
                runs = [r for r in letters.split() if len(r) >= least_chars]
                for word, n in misspelt(doc_id, runs, one_in).items():
                    held[word] += n
                if len(held) > FLUSH:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    return count


def vocabulary(docs: DataFrame, least_chars: int = 6, least_count: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n): letter runs of the texts with A-Z in lower case, after the stated deletions."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = texts.mapInArrow(_counter(least_chars, one_in), "word string, n long")
    words = counted.filter(F.length("word") >= least_chars).groupBy("word").agg(F.sum("n").alias("n"))
    return words.filter(F.col("n") >= least_count)


# ------------------------------------------------------------------ pivots


def pivots(grams: list[tuple[tuple[int, str], int]]) -> tuple[list[int], list[int]]:
    """(prefix, pivots) of one word: places of its rarest bigrams, and of two disjoint ones among them.

    `grams` holds ((words with the gram, gram), place). The prefix also takes all bigrams equal to
    its last one, since places move. best[c] is the least total of c disjoint ones so far.
    """
    ordered = sorted(grams)
    last = ordered[min(PREFIX, len(ordered)) - 1][0]
    prefix = sorted((at, rank[0]) for rank, at in ordered if rank <= last)
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * (EDITS + 1)]
    for j, (at, cost) in enumerate(prefix):
        before = next((k for k in range(j, 0, -1) if prefix[k - 1][0] + GRAM <= at), 0)
        row = list(best[j])
        for c in range(1, EDITS + 2):
            base = best[before][c - 1]
            if base is not None:
                here = (base[0] + cost, (*base[1], at))
                row[c] = here if row[c] is None else min(row[c], here)
        best.append(row)
    return [at for at, _ in prefix], list(best[-1][EDITS + 1][1])


def _entries(frequency: dict[str, int]):
    """Index entries of each word: key text, whether it is a pivot's, the word."""
    schema = pa.schema([("key", pa.string()), ("pivot", pa.bool_()), ("word", pa.string())])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, pivot, words = [], [], []
            for word in batch.column("word").to_pylist():
                grams = [word[i:i + GRAM] for i in range(len(word) - GRAM + 1)]
                prefix, chosen = pivots([((frequency[g], g), i) for i, g in enumerate(grams)])
                for at in prefix:
                    # the text up to the gram, or from it on; the mark keeps the two apart
                    key += ["<" + word[:at + GRAM], ">" + word[at:]]
                    pivot += [at == chosen[0], at == chosen[-1]]
                    words += [word] * 2
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(pivot), pa.array(words, pa.string())], schema=schema)

    return entries


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How many words hold each bigram: two letters of the alphabet, 90 squared at most."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda i: F.substring("word", i, F.lit(GRAM)))
    counts = words.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return {r["gram"]: r["n"] for r in counts.collect()}


def links(words: DataFrame) -> DataFrame:
    """(a, b) for each two words exactly one edit apart, both ways round.

    Candidates of a key are cut into slices by their number, pivots times prefixes. Keys travel and
    are sorted as 64-bit hashes: two texts that share one make candidates, which the distance drops.
    A pair is kept once, its words in order, until all its candidates have met.
    """
    made = words.select("word").mapInArrow(_entries(gram_counts(words)), "key string, pivot boolean, word string")
    entries = settled(made.withColumn("key", F.xxhash64("key")))
    size = F.length("word").alias("size")
    of_pivots = entries.filter("pivot").select("key", F.col("word").alias("a"), size.alias("size_a"))
    of_prefixes = entries.select("key", F.col("word").alias("b"), size.alias("size_b"))
    work = entries.groupBy("key").agg((F.count_if("pivot") * F.count(F.lit(1))).alias("n"))
    limit = work.agg(F.greatest(F.lit(10_000), F.expr("sum(n) div 2000")).alias("n")).first()["n"]
    hot = hot_keys(work, ["key"], "n", limit)  # 2,000 keys at most have more than that share
    found = spread_join(of_prefixes, of_pivots, ["key"], hot, "b")
    found = found.filter("a != b and abs(size_a - size_b) <= 1")
    found = found.filter(F.levenshtein("a", "b", EDITS) == EDITS)
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_p")).select("_p.*")


# ------------------------------------------------------------------ forms and roots


def forms(words: DataFrame, near: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n, if that is `times` the word's."""
    counted = near.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    # largest n, then the least text: least (-n, text)
    best = counted.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), "b")).alias("best"))
    rows = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    is_form = -F.col("best.m") >= times * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                       F.when(is_form, F.col("best.b")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"))


def rooted(found: DataFrame) -> DataFrame:
    """Adds root, the end of a word's chain of forms.

    Counts grow by a factor along a chain, so it is short; each round halves what is left of it.
    """
    step = settled(found.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = settled(step.join(onward, "root").select("word", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")))
        step = further.drop("moved")
        if not further.filter("moved").limit(1).count():
            return found.join(step, "word")


def variants(docs: DataFrame, least_chars: int = 6, least_count: int = 5, times: int = 5, one_in: int = 199) -> DataFrame:
    """For each frequent word its correct form, the near word `times` as frequent, and the form's root.

    Words are runs of letters A-Z, a-z, U+00C0 to U+00FF; only A-Z change to lower case. One run
    in `one_in`, chosen by document and run, has a letter deleted. Words of `least_chars` or more
    found `least_count` times count. Every row counts, repeated ones too; a missing text has no
    words, a missing doc_id reads as ''. Other columns are not read. Words as frequent as each
    other take the first in code-point order. Returns word, form, root, n, n_near, form_n.
    """
    if least_chars < GRAM * (EDITS + 1) + 1:
        raise ValueError("words need two disjoint bigrams beside an edit")
    words = settled(vocabulary(docs, least_chars, least_count, one_in))
    found = rooted(settled(forms(words, links(words), times)))
    return found.select("word", "form", "root", "n", "n_near", "form_n")

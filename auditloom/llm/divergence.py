"""How far the sources of a language differ in their words, and which words set a source apart.

A source and a language give each kept term a smoothed share, and two shares p and q differ by (p - q)^2 / (p + q),
rounded down. The sum of that over all terms of a language, for all pairs of its sources, is found from the supports:

* constants: each term costs what it costs where neither source has it,
* one-sided terms: a histogram of a source's counts says how many terms have each count, so what changes where the other
  source lacks the term is priced once for each count that occurs,
* overlaps: postings (term, source, count) joined by term correct the terms that both have.

Terms that one source lacks are thus never listed for a pair. Sums are of whole numbers throughout. Texts are read once:
tasks count (language, source, term) before they shuffle, with each document's first occurrence of a term marked, so
neither documents nor a large source are gathered; the best terms of a source are cut to `top` in each task first.

Defined cases: null text, language and source are empty texts; a group whose documents have no term, or none that is
kept, has shares from smoothing alone and no `term` row; a language that keeps no term has pairs of value 0; a language
of one source has no pair; repeated rows count as documents of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written
from .resampling import words_of

#: What separates terms once A-Z are lower-cased.
BETWEEN = r"[\x00-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000


def term_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """lang, source, term, count, docs (how many documents have it); a null term stands for documents without one, so every group occurs."""
    named = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_column, "lang"), (source_column, "source"))]
    terms = docs.select(*named, words_of(text_of(docs, text_column), BETWEEN).alias("terms"))
    # all terms, then each of them once: what comes after the first n tells documents
    both = terms.select("lang", "source", F.size("terms").alias("n"), F.concat("terms", F.array_distinct("terms")).alias("both"))
    each = both.select("lang", "source", "n", F.posexplode_outer("both").alias("place", "term"))
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("place") < F.col("n")).alias("count"), F.count_if(F.col("place") >= F.col("n")).alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """A smoothed share of a billion, exact at any count."""
    wide = lambda c: c.cast("decimal(20,0)")
    whole = F.call_function("div", wide(F.lit(SCALE)) * wide(count + 2), F.greatest(wide(total) + 2 * wide(terms), F.lit(1).cast("decimal(20,0)")))
    return (F.lit(1) + whole).cast("bigint")


def differ(p: Column, q: Column) -> Column:
    """(p - q)^2 / (p + q), rounded down; shares are below 2^31, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergences(docs: DataFrame, least_docs: int = 10, top: int = 10, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank.

    part 'pair': item is another source of the language, value their divergence over all kept terms. part 'term': item is
    a term that the source has and uses more than its language, the `top` highest. Terms are kept that at least
    least_docs documents of the language have.
    """
    counts = written(term_counts(docs, text_column, lang_column, source_column), "terms")
    of_term = Window.partitionBy("lang", "term")
    seen = counts.where("term IS NOT NULL").select("*", F.sum("docs").over(of_term).alias("all_docs"), F.sum("count").over(of_term).alias("all_count"))
    kept = written(seen.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "count", "all_count"), "kept")

    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    vocabulary = kept.groupBy("lang", "term").agg(F.first("all_count").alias("c")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("all_n"))
    zero = F.lit(0).cast("bigint")
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("n", "v", "all_n"))).withColumn("zero", share(zero, F.col("n"), F.col("v")))
    groups = written(groups, "groups")
    postings = written(kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v"))), "postings")

    left = groups.select("lang", F.col("source").alias("a"), "v", F.col("zero").alias("zero_a"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"))
    pairs = left.join(right, "lang").where("a <> b")
    neither = differ(F.col("zero_a"), F.col("zero_b"))
    constants = pairs.select("lang", "a", "b", (F.col("v") * neither).alias("value"))
    histograms = postings.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count(F.lit(1)).alias("terms"))
    one_sided = pairs.join(histograms, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * (differ(F.col("p"), F.col("zero_b")) - neither)).alias("value"))
    first = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("zero").alias("zero_a"))
    second = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("zero").alias("zero_b"))
    p_a, p_b, zero_a, zero_b = map(F.col, ("p_a", "p_b", "zero_a", "zero_b"))
    correction = differ(p_a, p_b) - differ(p_a, zero_b) - differ(zero_a, p_b) + differ(zero_a, zero_b)
    overlaps = first.join(second, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(correction).alias("value"))
    swapped = lambda rows: rows.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    parts = [constants, one_sided, swapped(one_sided), overlaps, swapped(overlaps)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole = whole.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    place = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair_rows = whole.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").withColumn("rank", place())

    of_lang = share(F.col("all_count"), F.col("all_n"), F.col("v"))
    term_rows = postings.withColumn("q", of_lang).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), differ(F.col("p"), F.col("q")).alias("value"))
    return pair_rows.unionByName(term_rows.withColumn("rank", place()).where(F.col("rank") <= top))

"""Checks over document text. All but the title match are map-only: a document is one row."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import ratio
from ..session import materialise


def phrase_hits(docs: DataFrame, phrases: list[str]) -> DataFrame:
    """Configured phrases found in each document, case-insensitively; documents without hits drop out."""
    low = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(low.contains(p.lower()), F.lit(p)) for p in phrases if p.strip()]))
    return docs.select("doc_id", hits.alias("phrases")).filter(F.size("phrases") > 0)


def unnegated_count(text: Column, term: str, negators: list[str], reach: int = 60) -> Column:
    """Occurrences of ``term`` with no negator in the ``reach`` characters before it, cut at . ; :

    A negated occurrence is one whose look-behind holds a negator and no boundary after it.
    """
    quoted = re.escape(term)
    # The term comes first, so the look-behind only runs where the term stands.
    behind = "|".join(re.escape(n) + r"[^.;:]{0," + str(reach - len(n)) + "}" + quoted for n in negators)
    negated = F.regexp_count(text, F.lit(f"{quoted}(?<={behind})"))
    return F.regexp_count(text, F.lit(quoted)) - negated


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sentence_statistics(docs: DataFrame, long_words: int = 35) -> DataFrame:
    """Per document: sentences, long ones, and the population std of lengths (six sentences or more)."""
    flat = F.array_join(words(F.col("text")), " ")
    lens = F.transform(F.split(flat, r"(?<=\.)\s+"), lambda s: F.size(words(s)))
    d = docs.select("doc_id", lens.alias("_l")).withColumn("_k", F.filter("_l", lambda n: n >= 3))
    total = F.aggregate("_k", F.lit(0), lambda a, n: a + n)
    mean = ratio(total, F.size("_k"))
    var = F.aggregate("_k", F.lit(0.0), lambda a, n: a + (n - F.col("_m")) * (n - F.col("_m")))
    d = d.withColumn("_m", mean)
    return d.select("doc_id", F.size("_l").alias("n_sentences"), F.size(F.filter("_l", lambda n: n > long_words)).alias("n_long"),
                    F.when(F.size("_k") >= 6, F.sqrt(ratio(var, F.size("_k")))).alias("length_std"))


# The patterns that define a written number. Scientific forms come first, in this order.
SCIENTIFIC = [r"(\d+(?:\.\d+)?)\s*\\(?:times|cdot)\s*10\^\{?(-?\d+)\}?", r"(\d+(?:\.\d+)?)[eE]([+-]?\d+)\b"]
POWER_OF_TEN = r"10\^\{?(-?\d+)\}?"
RANGE_DASH = r"(?<=\d)\s*(?:---|--|–|—)\s*(?=\d)"
THOUSANDS = [r"(?<=\d)\{,\}(?=\d{3})", r"(?<=\d),(?=\d{3}(?!\d))"]
PLAIN = r"[+-]?\d+(?:\.\d+)?"
MAX_EXPONENT = 400  # beyond it a number stays as mantissa and exponent


def shifted(mantissa: Column, exponent: Column) -> Column:
    """mantissa x 10^exponent as exact decimal text, by moving the point; no number type is involved.

    Zeros in front and behind the last fraction digit go. Beyond ``MAX_EXPONENT`` the text is
    ``<mantissa>e<exponent>``.
    """
    sign = F.when(F.startswith(exponent, F.lit("-")), -1).otherwise(1)
    size = F.ltrim(F.regexp_replace(exponent, "^[+-]", ""), F.lit("0"))
    far = F.length(size) > len(str(MAX_EXPONENT))
    e = sign * F.when(far | (size == ""), F.lit(0)).otherwise(size.cast("int"))
    whole = F.split_part(mantissa, F.lit("."), F.lit(1))
    digits = F.concat(whole, F.split_part(mantissa, F.lit("."), F.lit(2)))
    point, n = F.length(whole) + e, F.length(digits)
    pad = lambda k: F.repeat(F.lit("0"), F.greatest(k, F.lit(0)))
    left = F.concat(F.left(digits, F.greatest(F.least(point, n), F.lit(0))), pad(point - n))
    right = F.concat(pad(-point), F.substr(digits, F.greatest(point, F.lit(0)) + 1, n))
    left, right = F.ltrim(left, F.lit("0")), F.rtrim(right, F.lit("0"))
    out = F.concat(F.when(left == "", "0").otherwise(left), F.when(right == "", "").otherwise(F.concat(F.lit("."), right)))
    return F.when(far | (F.abs(e) > MAX_EXPONENT), F.concat(mantissa, F.lit("e"), exponent)).otherwise(out)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


# A text without the mark has no match of the pattern. The first two belong to ``SCIENTIFIC``.
MARKS = [r"\\(?:times|cdot)", r"\d[eE][+-]?\d"]
NONE = "array<string>"


def written_numbers(text: Column) -> Column:
    """All numbers of a text: scientific forms and powers of ten as exact decimals, others as written.

    A form is looked for, and cut out, only in texts that hold its mark.
    """
    empty = F.array().cast(NONE)

    def plain(rest: Column) -> Column:
        rest = F.when(rest.contains("--") | rest.contains("–") | rest.contains("—"), F.regexp_replace(rest, RANGE_DASH, " ")).otherwise(rest)
        rest = F.when(rest.contains("{,}"), F.regexp_replace(rest, THOUSANDS[0], "")).otherwise(rest)
        return F.regexp_extract_all(bound(rest, lambda t: F.when(t.rlike(r"\d,\d"), F.regexp_replace(t, THOUSANDS[1], "")).otherwise(t)), F.lit(PLAIN), 0)

    def powers(rest: Column) -> Column:
        has = rest.contains("10^")
        found = F.when(has, F.transform(F.regexp_extract_all(rest, F.lit(POWER_OF_TEN), 1), lambda e: shifted(F.lit("1"), e))).otherwise(empty)
        return F.concat(bound(F.when(has, F.regexp_replace(rest, POWER_OF_TEN, " ")).otherwise(rest), plain), found)

    def scientific(rest: Column, step: int) -> Column:
        if step == len(SCIENTIFIC):
            return powers(rest)
        pattern = SCIENTIFIC[step]

        def cut(hit: Column) -> Column:
            t, has = hit["t"], hit["has"]
            parts = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), 1).alias("m"), F.regexp_extract_all(t, F.lit(pattern), 2).alias("e"))
            found = F.when(has, F.transform(parts, lambda p: shifted(p["m"], p["e"]))).otherwise(empty)
            return F.concat(bound(F.when(has, F.regexp_replace(t, pattern, " ")).otherwise(t), lambda t: scientific(t, step + 1)), found)

        return bound(F.struct(rest.alias("t"), rest.rlike(MARKS[step]).alias("has")), cut)

    return F.when(text.rlike(r"\d"), scientific(text, 0))


def numbers(docs: DataFrame) -> DataFrame:
    """(doc_id, token) of every number, repeats included."""
    return docs.select("doc_id", F.explode(written_numbers(F.col("text"))).alias("token"))


def number_inventory(docs: DataFrame) -> DataFrame:
    """(doc_id, token, n): the multiset of a document's numbers."""
    return numbers(docs).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def number_counts(docs: DataFrame) -> DataFrame:
    """(token, n): the multiset of the numbers of all documents."""
    return numbers(docs).groupBy("token").agg(F.count("*").alias("n"))


def tokens_added(original: DataFrame, candidate: DataFrame) -> DataFrame:
    """Multiset difference: how often each token of the candidate exceeds the original."""
    o = original.groupBy("token").agg(F.sum("n").alias("_o"))
    c = candidate.groupBy("token").agg(F.sum("n").alias("_c"))
    extra = F.col("_c") - F.coalesce("_o", F.lit(0))
    return c.join(o, "token", "left").select("token", extra.alias("n_added")).filter("n_added > 0")


def normal_title(text: Column) -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(text, r"\\[a-zA-Z]+", " "), r"[{}\\$~]", " "))
    return F.array_join(words(F.regexp_replace(s, r"[^a-z0-9 ]", " ")), " ")


def title_match(a: Column, b: Column, threshold: float = 0.6) -> Column:
    """Normalised titles that are equal, contained, or share enough tokens."""
    ta, tb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    jac = F.try_divide(F.size(F.array_intersect(ta, tb)).cast("double"), F.size(F.array_union(ta, tb)).cast("double"))
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a) | (jac >= threshold))


def contained_short(short: DataFrame, s_name: str, whole: DataFrame, w_name: str) -> DataFrame:
    """Pairs (of title numbers) where a title of one or two tokens is text inside another title.

    One token lies inside some token; two tokens are the end of a token and the start of the
    next. The pieces are cut from the distinct tokens and token pairs, not from every title.
    Both tables are (number, title); the numbers bear the names.
    """
    s = short.filter(F.size(F.split("title", " ")) < 3)
    w = F.split("title", " ")
    last = F.size(w) - 1
    pairs = F.when(last > 0, F.zip_with(F.slice(w, F.lit(1), last), F.slice(w, F.lit(2), last),
                                        lambda x, y: F.struct(x.alias("t1"), y.alias("t2"))))
    tokens = whole.select(w_name, F.explode(F.array_distinct(w)).alias("token"))
    bigrams = whole.select(w_name, F.explode(F.array_distinct(pairs)).alias("_b")).select(w_name, "_b.*")
    width = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    longest = s.agg(F.coalesce(F.max(F.length(F.split_part("title", F.lit(" "), F.lit(1)))), F.lit(0)).alias("_max"))
    words_seen = tokens.select("token").distinct().repartition(width, "token")  # few bytes, many pieces
    words_seen = words_seen.crossJoin(F.broadcast(longest)).filter("_max > 0")  # one row: no longer piece can match
    n = F.length("token")
    inside = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(n - i + 1, F.col("_max"))), lambda k: F.substring(F.col("token"), i, k)))))
    ends = F.transform(F.sequence(F.lit(1), F.least(n, F.col("_max"))), lambda i: F.substring(F.col("token"), -i, i))
    one = s.filter(~F.col("title").contains(" ")).select(s_name, F.col("title").alias("piece"))
    two = s.filter(F.col("title").contains(" ")).select(
        s_name, F.split_part("title", F.lit(" "), F.lit(1)).alias("piece"), F.split_part("title", F.lit(" "), F.lit(2)).alias("_y"))
    # Words that hold a short title are written, so that where they are few the tokens of all titles do not move.
    held = materialise(one.join(words_seen.select("token", F.explode(inside).alias("piece")), "piece").select(s_name, "token"), "held")
    begun = materialise(two.join(words_seen.select(F.col("token").alias("t1"), F.explode(ends).alias("piece")), "piece").select(s_name, "t1", "_y"), "begun")
    hit1 = tokens.join(held, "token")
    hit2 = bigrams.join(begun, "t1").filter(F.startswith("t2", "_y"))
    return hit1.select(s_name, w_name).unionByName(hit2.select(s_name, w_name)).distinct()


def numbered_titles(titled: DataFrame, name: str) -> DataFrame:
    """(number, title): the distinct titles, written once; a number stands for its title where rows move."""
    return materialise(titled.select("title").distinct().select(F.monotonically_increasing_id().alias(name), "title"), "titles")


def shared_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """(token, df) of the tokens that titles of both sides hold."""
    def counted(t: DataFrame, name: str) -> DataFrame:
        return t.select(F.explode(F.array_distinct(F.split("title", " "))).alias("token")).groupBy("token").agg(F.count("*").alias(name))

    both = counted(left, "_l").join(counted(right, "_r"), "token")
    return materialise(both.select("token", (F.col("_l") + F.col("_r")).alias("df")), "tokens")


def title_tokens(titles: DataFrame, name: str, shared: DataFrame, threshold: float) -> DataFrame:
    """The shared tokens of each title: whether one is among the rarest (``in_prefix``), and the one to look up (``probe``).

    Tokens of one side alone come before all others in the order of rarity. They are counted, not moved.
    """
    inner = F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 2, F.lit(0)))
    x = titles.select(name, F.split("title", " ").alias("_w"))
    x = x.withColumns({"n_all": F.size("_w"), "_n": F.size(F.array_distinct("_w")), "_n_inner": F.size(F.array_distinct(inner))})  # before the rows multiply
    x = x.select(name, "n_all", "_n", "_n_inner", F.posexplode("_w").alias("at", "token")).join(shared, "token")
    x = x.groupBy(name, "token").agg(F.max((F.col("at") > 0) & (F.col("at") < F.col("n_all") - 1)).alias("inner"),
                                     *[F.first(c).alias(c) for c in ("n_all", "_n", "_n_inner", "df")])
    of = Window.partitionBy(name)  # one title's distinct tokens
    x = x.withColumn("_rk", F.col("_n") - F.count("*").over(of) + F.row_number().over(of.orderBy("df", "token")))
    keep = F.col("_rk") <= F.col("_n") - F.ceil(F.lit(threshold) * F.col("_n")) + 1
    whole = F.count_if("inner").over(of) == F.col("_n_inner")  # else no title of the other side holds this one
    first = F.row_number().over(of.orderBy(F.col("inner").desc(), "df", "token")) == 1
    return x.select(name, "token", keep.alias("in_prefix"), (first & whole & F.col("inner") & (F.col("n_all") >= 3)).alias("probe"))


def title_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.6) -> DataFrame:
    """All matching (left_id, right_id) pairs of two (id, title) tables, exactly.

    Identical titles are grouped first, so copies cannot multiply the comparison, and numbers stand for
    them until a candidate pair is compared. Candidates
    share one token among the rarest of both sides: a pair above the threshold must share one
    of each side's n - ceil(t n) + 1 rarest tokens, and a contained title of three tokens or
    more has its inner tokens in the other, of which the rarest is looked up among all tokens
    there. Titles below three tokens are found by equality with pieces of tokens and of
    neighbouring token pairs. Every step is an equi-join.
    """
    l, r = (t.select("id", normal_title(F.col("title")).alias("title")).filter("title <> ''") for t in (left, right))
    lt, rt = numbered_titles(l, "left_t"), numbered_titles(r, "right_t")
    shared = shared_tokens(lt, rt)
    a = title_tokens(lt, "left_t", shared, threshold)
    b = title_tokens(rt, "right_t", shared, threshold).withColumnsRenamed({"in_prefix": "r_prefix", "probe": "r_probe"})
    a, b = materialise(a, "left-tokens"), materialise(b, "right-tokens")
    # One row per side meets per shared token unless it is a prefix or probe token of either side.
    cand = a.join(b.filter("r_prefix or r_probe"), "token").filter("(in_prefix and r_prefix) or r_probe").select("left_t", "right_t")
    cand2 = a.filter("probe").join(b, "token").select("left_t", "right_t")
    text = contained_short(lt, "left_t", rt, "right_t").unionByName(contained_short(rt, "right_t", lt, "left_t").select("left_t", "right_t"))
    pairs = materialise(cand.unionByName(cand2).unionByName(text).distinct(), "title-pairs")
    named = pairs.join(lt.withColumnRenamed("title", "left_title"), "left_t").join(rt.withColumnRenamed("title", "right_title"), "right_t")
    hit = materialise(named.filter(title_match(F.col("left_title"), F.col("right_title"), threshold)).select("left_title", "right_title"), "title-hits")
    return hit.join(l.select(F.col("id").alias("left_id"), F.col("title").alias("left_title")), "left_title").join(
        r.select(F.col("id").alias("right_id"), F.col("title").alias("right_title")), "right_title").select("left_id", "right_id")


def unanchored_paragraphs(docs: DataFrame, min_words: int, lexicon: list[str]) -> DataFrame:
    """Paragraphs of enough words with neither a number nor a lexicon phrase."""
    p = docs.select("doc_id", F.posexplode(F.filter(F.split("text", r"\n\s*\n"), lambda x: F.trim(x) != "")).alias("_i", "para"))
    low = F.lower("para")
    anchored = F.col("para").rlike(r"\d")
    for phrase in lexicon:
        anchored = anchored | low.contains(phrase.lower())
    p = p.select("doc_id", (F.col("_i") + 1).alias("paragraph"), F.size(words(F.col("para"))).alias("n_words"), anchored.alias("anchored"))
    return p.filter((F.col("n_words") >= min_words) & ~F.col("anchored")).drop("anchored")


def count_text(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(phrase)))) / len(phrase)).cast("long")


def phrase_floors(docs: DataFrame, scope: str, specs: dict[str, tuple[list[str], int]]) -> DataFrame:
    """Hits of any variant per scope against each phrase's floor: one pass, one small aggregate."""
    sums = []
    for name, (variants, _) in specs.items():
        total = F.lit(0).cast("long")
        for v in variants:
            total = total + count_text(F.col("text"), v)
        sums.append(F.sum(total).alias(name))
    g = docs.groupBy(scope).agg(*sums)
    rows = F.array(*[F.struct(F.lit(n).alias("phrase_id"), F.col(n).alias("hits"), F.lit(f).alias("floor")) for n, (_, f) in specs.items()])
    out = g.select(scope, F.explode(rows).alias("_r")).select(scope, "_r.*")
    return out.withColumn("status", F.when(F.col("hits") == 0, "floor_unbound").when(F.col("hits") < F.col("floor"), "missing_required").otherwise("met"))

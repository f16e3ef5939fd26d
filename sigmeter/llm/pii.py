"""Personal data spans with built-in functions only.

Regular expressions propose spans, validators confirm them (part range for ip, Luhn for card, digit
count for phone, mod-97 for iban), and words near a span move its score. Base kinds are always
reported; the extra kinds iban and ssn only from ``MIN_SCORE`` on. No shuffle and no Python: each
document is one row in and one row out.

Patterns are written with possessive runs and start either at the end of the last match or where a
run begins, which finds the same leftmost matches as the plain pattern in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn")
KINDS = BASE + EXTRA

_EMAIL_RUN = r"[A-Za-z0-9._%+-]"
PATTERN = {
    "email": rf"(?:\G|(?<!{_EMAIL_RUN})){_EMAIL_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}",  # the opening; the end is chosen by length and remainder
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# A cheap test that every text with a match passes; most texts end here.
HINT = {
    "email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
START_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": r"mail|contact|write|reply|address", "ip": r"\bip\b|host|server|address|client",
    "card": r"card|visa|credit|payment|account", "phone": r"phone|tel|call|mobile|fax|contact",
    "iban": r"iban|bank|account|transfer|konto|compte|cuenta", "ssn": r"ssn|social|security",
}
AGAINST = r"example|sample|version|build|serial|order|invoice|isbn|test"
# Characters of an account number by country.
IBAN_LENGTH = {n: codes.split() for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}.items()}
IBAN_REST = (11, 30)  # characters behind the opening
IBAN_AHEAD = 2 * IBAN_REST[1] + 1  # code points that they take at most, and one that shows where the last token ends
NEAR = 48  # code points read on either side
# Between members of a list at most one word stands ("and", "2.", a name); such a span shares the context of the one before it.
LISTED = r"^[^\p{L}\p{N}]*+(?:[\p{L}\p{N}]++[^\p{L}\p{N}]*+)?$"
MIN_SCORE = 0.5

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _mod97(c: Column) -> Column:
    """Remainder of an account number with its first four characters moved to the end, letters as 10..35."""
    flat = F.regexp_replace(c, " ", "")
    turned = F.concat(F.substr(flat, F.lit(5), F.length(flat)), F.substr(flat, F.lit(1), F.lit(4)))

    def step(acc, ch):
        code = F.ascii(ch)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise(step(a, ch)))


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return F.regexp_like(match, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "ssn":
        return ~F.regexp_like(match, F.lit("^(?:000|666|9..)|-00-|-0000$"))
    return F.lit(True)


def _named(kind: str, before: Column, after: Column) -> Column:
    return F.regexp_like(F.lower(F.concat_ws(" ", before, after)), F.lit(CONTEXT[kind]))


def _score(kind: str, before: Column, after: Column, named: Column) -> Column:
    near = F.lower(F.concat_ws(" ", before, after))
    up = F.when(named, 0.2).otherwise(0.0)
    down = F.when(F.regexp_like(near, F.lit(AGAINST)), -0.2).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(START_SCORE[kind]) + up + down)), 2)


def _proposals(text: Column, kind: str) -> Column:
    """Spans of one kind, each with what precedes it since the last match and what follows."""
    pattern = rf"(?s)\G(.*?)({PATTERN[kind]})(?=(.{{0,{NEAR}}}))"  # without \G the rest of a text is tried from every start
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    rows = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("gap", "hit", "after"))))
    empty = F.expr(f"struct(0 as pos, '' as tail, false as named, cast(array() as {SPAN}) as found)")

    def step(acc, row):
        start = acc["pos"] + F.length(row["gap"])
        end = start + F.length(row["hit"])
        before = F.right(F.concat(acc["tail"], row["gap"]), F.lit(NEAR))  # the text before the span, other matches included
        named = _named(kind, before, row["after"]) | (acc["named"] & F.regexp_like(row["gap"], F.lit(LISTED)))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"),
                        end.alias("end"), _score(kind, before, row["after"], named).alias("score"))
        ok = valid(kind, row["hit"])
        if kind in EXTRA:
            ok = ok & (span["score"] >= MIN_SCORE)
        return F.struct(end.alias("pos"), F.right(F.concat(before, row["hit"]), F.lit(NEAR)).alias("tail"), named.alias("named"),
                        F.when(ok, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    hint = F.contains(text, F.lit("@")) if kind == "email" else F.regexp_like(text, F.lit(HINT[kind]))
    return F.when(hint, F.aggregate(rows, empty, step)["found"]).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _account_end(opening: Column, ahead: Column) -> Column:
    """Code points of ``ahead`` that belong to the account number begun by ``opening``; 0 if none does.

    Of the token ends where the remainder is 1: the one of the country's length, else the longest.
    """
    length = F.coalesce(*(F.when(F.substr(opening, F.lit(1), F.lit(2)).isin(codes), n) for n, codes in IBAN_LENGTH.items()), F.lit(0))
    tokens = F.regexp_extract_all(F.substr(ahead, F.lit(1), F.lit(IBAN_AHEAD)), F.lit(r"\G( ?[A-Z0-9]++)(?![A-Za-z0-9])"), F.lit(1))

    def step(acc, token):
        upto = F.concat(acc["upto"], token)
        n = F.length(F.replace(upto, F.lit(" "), F.lit("")))
        fits = n.between(*IBAN_REST) & ~acc["exact"]
        ok = F.when(fits, _mod97(F.concat(opening, upto)) == 1).otherwise(False)
        return F.struct(upto.alias("upto"), F.when(ok, F.length(upto)).otherwise(acc["end"]).alias("end"),
                        (acc["exact"] | (ok & (n + 4 == length))).alias("exact"))

    return F.aggregate(tokens, F.expr("struct('' as upto, 0 as end, false as exact)"), step)["end"]


def _account_numbers(text: Column) -> Column:
    """Spans of iban. Every opening is tried, also inside the tokens behind one that came to nothing."""
    pattern = rf"(?s)\G(.*?)({PATTERN['iban']})(?=(.{{0,{IBAN_AHEAD + NEAR}}}))"
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    rows = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("gap", "hit", "ahead"))))
    # The end is found once per opening, before the spans are put together.
    rows = F.transform(rows, lambda row: F.struct(row["gap"].alias("gap"), row["hit"].alias("hit"), row["ahead"].alias("ahead"), _account_end(row["hit"], row["ahead"]).alias("more")))
    empty = F.expr(f"struct(0 as pos, 0 as free, '' as tail, cast(array() as {SPAN}) as found)")

    def step(acc, row):
        start = acc["pos"] + F.length(row["gap"])
        pos = start + F.length(row["hit"])
        end = pos + row["more"]
        before, after = F.right(F.concat(acc["tail"], row["gap"]), F.lit(NEAR)), F.substr(row["ahead"], row["more"] + 1, F.lit(NEAR))
        span = F.struct(start.alias("start"), F.lit(KINDS.index("iban")).alias("rank"), F.lit("iban").alias("kind"),
                        end.alias("end"), _score("iban", before, after, _named("iban", before, after)).alias("score"))
        ok = (row["more"] > 0) & (start >= acc["free"]) & (span["score"] >= MIN_SCORE)
        return F.struct(pos.alias("pos"), F.when(ok, end).otherwise(acc["free"]).alias("free"),
                        F.right(F.concat(before, row["hit"]), F.lit(NEAR)).alias("tail"),
                        F.when(ok, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return F.when(F.regexp_like(text, F.lit(HINT["iban"])), F.aggregate(rows, empty, step)["found"]).otherwise(F.expr(f"cast(array() as {SPAN})"))


def find_spans(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """Adds ``out``: spans (start, rank, kind, end, score) by start, then kind; code points, end exclusive.

    Null and empty texts have none. Other columns pass through; ``out`` must be a free name.
    """
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = F.array_sort(F.concat(*(_account_numbers(value) if k == "iban" else _proposals(value, k) for k in KINDS)))
    has_any = F.regexp_like(value, F.lit("[0-9@]"))
    return docs.withColumn(out, F.when(has_any, found).otherwise(F.expr(f"cast(array() as {SPAN})")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """Replaces every span by its kind in capitals between brackets and refreshes n_chars; same columns.

    Overlapping spans are replaced once, under the name of the first. Null texts stay null.
    """
    columns = docs.columns
    spans = "_pii_" + "_".join(columns)  # longer than any column, so free
    marked = find_spans(docs, "text", spans)
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("done"))

    def step(acc, s):
        piece = F.concat(acc["done"], F.substr(F.col("text"), acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return (F.when(s["start"] >= acc["pos"], F.struct(s["end"].alias("pos"), piece.alias("done")))
                .otherwise(F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["done"].alias("done"))))

    cut = F.aggregate(F.col(f"`{spans}`"), start, step)
    whole = F.concat(cut["done"], F.substr(F.col("text"), cut["pos"] + 1, F.length("text")))
    out = marked.withColumn("text", F.when(F.size(F.col(f"`{spans}`")) > 0, whole).otherwise(F.col("text"))).select(*columns)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, all spans, and the highest score."""
    spans = find_spans(documents(spark, sf_dir).select("doc_id", "text"), "text", "spans")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return spans.select("doc_id", *(count(k) for k in KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))
